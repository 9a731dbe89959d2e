"""How the code corpus is dealt out, parsed and joined: plans and tasks, beside the results in test_queries and test_symbols."""

import pyarrow as pa

from tallyloom import session
from tallyloom.operators import scanner, symbols as S
from tallyloom.plans import corpus
from tallyloom.plans.base import Tables

FOLDER = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_rows_are_dealt_into_tasks(spark):
    t = Tables(spark, FOLDER)
    assert t.part.rdd.getNumPartitions() == 1
    assert corpus.files(t).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 2000 // session.FEW_ROWS)
    many = spark.range(3 * 8 * session.MANY_ROWS, numPartitions=1)
    assert session.dealt(many, "id").rdd.getNumPartitions() >= 24  # grows with the rows
    assert session.dealt(spark.range(0), "id").count() == 0


def test_small_files_share_a_batch_and_large_ones_are_cut():
    one = "class A { void m() { } }\n"
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b", "big"], "language": ["java"] * 3, "content": [one, one, one * S.TOGETHER]})
    out = list(S._scan(iter([batch])))
    assert len(out) < S.TOGETHER and max(b.num_rows for b in out) <= S.TOGETHER
    heads = [h for b in out for h in zip(*(b.column(c).to_pylist() for c in ("path", "head")))]
    per_file = {path: [n for p, n in heads if p == path] for path in ("a", "b", "big")}
    assert per_file["a"] == per_file["b"] and per_file["big"] == list(range(len(per_file["big"])))
    assert len(list(S._scan(iter([batch.slice(0, 2)])))) == 1
    assert list(S._scan(iter([batch.slice(0, 0)]))) == []


def test_sources_are_merged_not_broadcast(spark):
    assert "Broadcast" not in plan(corpus.k1(Tables(spark, FOLDER)))


def test_outermost_owners_parse_once(spark):
    assert plan(corpus.w1(Tables(spark, FOLDER))).count("MapInArrow _scan") == 1


def test_members_parse_once(spark):
    made = plan(corpus.j2(Tables(spark, FOLDER)))
    assert "MapInArrow _scan" not in made and "Broadcast" not in made


def test_outermost_owner_of_nested_and_free_methods(spark):
    text = "class A { class B { void low() { } } void m() { } }\nclass C { void n() { } }\n"
    files = spark.createDataFrame([("x.java", "java", text), ("y.py", "python", "def free(): pass\n")], "path string, language string, content string")
    found, _ = S.extract(files)
    joined = {(r.path, r.name): r.class_name for r in S.outermost_owners(found).collect()}
    assert joined == {("x.java", "low"): "A", ("x.java", "m"): "A", ("x.java", "n"): "C"}
    laid = {(r.path, r.name): r.class_name for r in S.with_owner(found).where("kind = 'method' AND class_name <> ''").collect()}
    assert laid == joined


def test_files_are_written_by_several_tasks(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(corpus.walk, "write_files", lambda files, root: dealt.append(files.rdd.getNumPartitions()))
    monkeypatch.setattr(corpus.CF, "scan_code_files", lambda spark, root: spark.createDataFrame([("a", "java", b"")], "path string, language string, content binary"))
    corpus.s2(Tables(spark, FOLDER))
    assert dealt[0] > 1


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_chosen_by_all_tasks(spark):
    """Neither paths nor conditions on them move to the few tasks that read the table of parts."""
    reading = plan(corpus.files(Tables(spark, FOLDER))).split("Exchange", 1)[1]
    assert "FileScan" in reading and "arrays_overlap" not in reading and "/repo/" not in reading


def test_patterns_are_looked_for_once(spark):
    made = optimized(S.extract(corpus.files(Tables(spark, FOLDER)))[0])
    assert made.count("companion") == 1


def test_only_files_of_the_language_are_parsed(spark):
    above, below = plan(corpus.p7(Tables(spark, FOLDER))).split("MapInArrow", 1)
    assert "lower(" not in above and "lower(" in below


def test_heads_of_files_cut_short():
    """Blocks, parentheses and strings that never end, and ends that nothing opened."""
    cut = [(h.text, h.around, h.stop, h.close) for h in scanner.heads(b"class A {\n  void m(int a) { if (a", "java")]
    assert cut == [("class A", None, "{", None), ("void m(int a)", "class A", "{", None), ("if (a", "void m(int a)", "", None)]
    assert [(h.text, h.level, h.end, h.end_row) for h in scanner.heads(b"} )\n]; int x\n= 1;", "cpp")] == [(") ]", 0, 5, 2), ("int x = 1", 0, 16, 3)]
    assert [h.opening for h in scanner.heads(b'fn f() { let s = "a\nb', "rust")][1] == b'let s = "a\nb'
