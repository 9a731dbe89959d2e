import pytest

from tallyloom.workspace import Workspace


def test_named_results(spark, tmp_path):
    ws = Workspace(spark)
    assert ws.save("a", ws.spark.range(3)).first().success
    status, records = ws.query("SELECT id, double('NaN') AS x FROM a WHERE id = 2", save_as="b")
    assert status.first().success and [r.record for r in records.collect()] == ['{"id":2,"x":null}']
    status, records = ws.query("SELECT nothing FROM a", save_as="bad")
    assert not status.first().success and status.first().error_type == "AnalysisException" and records.count() == 0
    assert sorted((r.name, r.rows, r.columns) for r in ws.inventory().collect()) == [("a", 3, 1), ("b", 1, 2)]
    assert ws.snapshot(str(tmp_path / "s")) == ["a", "b"]
    for name in ("c", "_p", "d"):
        ws.save(name, ws.spark.range(1))
    assert ws.reset() == ["a", "b", "c"] and not ws.spark.catalog.tableExists("d")
    other = Workspace(spark)
    assert other.restore(str(tmp_path / "s")) == [] and other.tables["a"].count() == 3
    with pytest.raises(ValueError):
        ws.save("x", other.spark.range(1))


def test_code_index(spark, tmp_path):
    root = tmp_path / "code"
    (root / "src").mkdir(parents=True)
    (root / "src" / "A.java").write_text("class A {\n  /* d */\n  int go() { return 1; }\n}\n")
    (root / "src" / "b.py").write_text("def go():\n    return 2\n")
    (root / "src" / "c.go").write_text("package c\n")
    (root / "src" / "bad.py").write_text("def (:\n")
    ws = Workspace(spark)
    index = ws.index_code(str(root), str(tmp_path / "index"))
    assert sorted((r.class_name, r.implementation, r.doc_comment) for r in index.find_methods("go").collect()) == [
        ("", "def go():\n    return 2", ""), ("A", "int go() { return 1; }", "/* d */")]
    assert index.find_methods("go", "A").count() == 1 and index.find_methods("Go").count() == 0
    assert index.find_classes("A").columns == ["name", "implementation", "file_path", "line_start", "line_end", "doc_comment", "class_name", "result_type"]
    assert {r.language: r.file_count for r in index.stats().collect()} == {"java": 1, "python": 2, "go": 1}
    assert index.errors.count() == 1
    ws.configure_languages([" Python "])
    assert index.find_methods("go").count() == 1 and index.classes().count() == 0
    with pytest.raises(ValueError):
        ws.configure_languages(["java", "cobol"])


def test_package_lookup(spark):
    ws = Workspace(spark)
    docs = ws.spark.createDataFrame([('{"info": {"name": "My_Pkg", "version": "1"}, "releases": {"0.1": [], "0.2": []}}',)], "doc string")
    names = ws.spark.createDataFrame([("my.pkg",), ("none",), ("-x",)], "package_name string")
    got = {r.package_name: (r.version, r.available_versions, r.download_info, r.error, r.error_type) for r in ws.package_lookup(names, docs).collect()}
    assert got == {
        "my.pkg": ("1", ["0.1", "0.2"], None, None, None),
        "none": (None, None, None, "Package 'none' not found on PyPI", "PackageNotFoundError"),
        "-x": (None, None, None, "Invalid package name: '-x'", "InvalidPackageNameError")}


def test_table_functions_over_an_index(spark, tmp_path):
    """Constants and columns as arguments, nothing found, and the languages of the workspace."""
    root = tmp_path / "code"
    root.mkdir()
    (root / "A.java").write_text("class A { int f() { return 1; } int g() { return 2; } }")
    (root / "b.py").write_text("class B:\n    def f(self):\n        return 'é'\n")
    ws = Workspace(spark)
    index = ws.index_code(str(root), str(tmp_path / "index"))
    assert "tl_find_methods" in index.register()
    run = lambda sql: sorted(map(tuple, ws.spark.sql(sql).collect()), key=str)
    assert run("SELECT class_name, implementation FROM tl_find_methods('f')") == [("A", "int f() { return 1; }"), ("B", "def f(self):\n        return 'é'")]
    assert run("SELECT * FROM tl_find_methods('none')") == [] and run("SELECT * FROM tl_find_methods(NULL)") == []
    wanted = "(VALUES ('f', 'B'), ('g', 'A'), ('g', 'B'), (NULL, 'A'))"
    assert run(f"SELECT v.m, r.class_name FROM {wanted} v(m, c), LATERAL tl_find_methods_of(m, c) r") == [("f", "B"), ("g", "A")]
    assert run(f"SELECT v.m, r.name FROM {wanted} v(m, c) LEFT JOIN LATERAL tl_find_methods_of(m, c) r") == [("f", "f"), ("g", "g"), ("g", None), (None, None)]
    status, records = ws.query("SELECT class_name FROM tl_classes()", save_as="classes")
    assert status.first().success and records.count() == 2
    ws.configure_languages(["java"])
    index.register()
    assert run("SELECT class_name FROM tl_find_methods('f')") == [("A",)] and run("SELECT * FROM tl_code_stats()") == [("java", 1)]
    assert run("SELECT method_name FROM tl_methods()") == [("f",), ("g",)] and run("SELECT file_path IS NOT NULL FROM tl_find_classes('A')") == [(True,)]
