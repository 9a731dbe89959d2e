import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import maps as M, numbers as N, text as X


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'binary' if isinstance(values[n], bytes) else 'string'}" for n in names))
    return row.select(column.alias("x")).first().x


def test_decode_matches_python_for_any_bytes(spark):
    rnd = random.Random(5)
    pool = ["a", "é", "漢", "😀", "�", "", "", "0", "\n"]
    cases = []
    for _ in range(600):
        raw = bytearray("".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 12))).encode())
        for _ in range(rnd.randrange(0, 4)):
            if raw:
                at = rnd.randrange(len(raw))
                rnd.choice([lambda: raw.pop(at), lambda: raw.insert(at, rnd.randrange(256)), lambda: raw.__setitem__(at, rnd.randrange(128, 256))])()
        cases.append((bytes(raw),))
    df = spark.createDataFrame(cases, "b binary")
    for row in df.select("b", X.decode_utf8_ignore(F.col("b")).alias("s")).collect():
        assert row.s == bytes(row.b).decode("utf-8", errors="ignore"), bytes(row.b)


@pytest.mark.parametrize("path,want", [
    ("/a/b.PY", ".py"), ("/a/.bashrc", ""), ("/a.d/noext", ""), ("/a/x.tar.gz", ".gz"), ("/a/.hidden.kt", ".kt"), ("/a/end.", ""),
])
def test_suffix(spark, path, want):
    assert one(spark, X.suffix(F.col("p")), p=path) == want


@pytest.mark.parametrize("text,kind,message", [
    ("Traceback\n  x\nValueError: a: b ", "ValueError", "a: b"), ("KeyboardInterrupt\n", "KeyboardInterrupt", ""), ("  \n ", None, None),
])
def test_exception(spark, text, kind, message):
    assert one(spark, X.exception_type(F.col("t")), t=text) == kind
    assert one(spark, X.exception_message(F.col("t")), t=text) == message


@pytest.mark.parametrize("spec,want", [
    ("a==1 b>=2", ["a", "b"]), ("git+https://h/u/r.git@main", ["r"]), ("git+https://h/u/r", []), ("  x<=1   y@2 ", ["x", "y"]),
])
def test_requirement_names(spark, spec, want):
    assert one(spark, X.requirement_names(F.col("s")), s=spec) == want


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\rc\n\n", ["a", "b", "c", ""]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, X.lines(F.col("t")), t=text) == want


@pytest.mark.parametrize("pattern,name,want", [("*Find*", "reFINDer", True), ("a?c", "abc", True), ("a?c", "abbc", False), ("[xy]*", "_x", False), ("*", "_p", False)])
def test_glob(spark, pattern, name, want):
    assert one(spark, X.glob_match(F.col("n"), pattern), n=name) is want


def test_json_records_clean_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, None), (5, 0.5)], "k int, v double")
    got = [r.record for r in N.json_records(df.orderBy("k")).collect()]
    assert got == ['{"k":1,"v":null}', '{"k":2,"v":"Infinity"}', '{"k":3,"v":"-Infinity"}', '{"k":4,"v":null}', '{"k":5,"v":0.5}']


def test_overlay(spark):
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert spark.range(1).select(M.overlay(m("a", 1, "b", 1), m("b", 2), m("c", 3, "a", 4)).alias("m")).first().m == {"a": 4, "b": 2, "c": 3}
