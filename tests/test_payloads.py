import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import payloads as P


def table(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "payload_id long, payload string")


@pytest.mark.parametrize("payload,kind", [
    ('[{"a": 1}, {"b": 2}]', "records"), ('[["h"], [1]]', "rows"), ('[{"a": 1}, 2]', "scalar"), ("[]", "scalar"), ('{"a": [1], "b": [2]}', "columns"),
    ('{"a": [1], "b": []}', "nested"), ('{"a": 1, "b": null}', "object"), ('{"a": {"b": 1}}', "nested"), ("{}", "columns"), ("null", "null"), (None, "null"),
    ("42", "scalar"), ('"[1, 2]"', "scalar"), ('"\\"[[1]]\\""', "rows"), ("a,b\n1,2", "csv"), ("plain", "csv"), ("  ", "scalar"), ('{"a": 1', "csv"),
])
def test_classify(spark, payload, kind):
    assert P.classify(table(spark, payload)).first().kind == kind


def test_header_rows_short_and_long(spark):
    rows = P.header_rows(table(spark, '[["a", "b"], [1, "x"], [2, "y"]]', '[["b", "a"], ["z", 3]]', '[["only"]]'), {"a": "bigint", "b": "string"}).collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, "x"), (2, "y"), (3, "z")]


def test_csv_quotes_and_line_ends(spark):
    rows = P.csv_rows(table(spark, 'a,b\n1,"two\nlines, ""quoted"""\n\n2,plain\r\n', "b,a\nx,3"), {"a": "bigint", "b": "string"}).collect()
    assert sorted((r.a, r.b) for r in rows) == [(1, 'two\nlines, "quoted"'), (2, "plain"), (3, "x")]


def test_flatten_keeps_lists(spark):
    df = P.flatten(P.object_row(table(spark, '{"a": {"b": {"c": 1}, "d": [1, 2]}, "e": "x"}'), "a struct<b:struct<c:bigint>,d:array<bigint>>,e string"))
    assert df.columns == ["payload_id", "a.b.c", "a.d", "e"]
    assert tuple(df.first())[1:] == (1, [1, 2], "x")


def test_inferred_schema_is_the_union_of_keys(spark):
    rows = P.records_to_rows(table(spark, '[{"a": 1}]', '[{"b": "x"}, {"a": 2, "b": "y"}]')).collect()
    assert sorted((r.a or 0, r.b or "") for r in rows) == [(0, "x"), (1, ""), (2, "y")]


def test_schema_typed_ingest(spark):
    props = {"o": {"type": "number", "default": 1.5}, "r": {"type": "integer"}, "any": {"type": "odd"}, "l": {"type": "array"}}
    v = F.try_parse_json("payload")
    rows = P.typed_or_rejected(table(spark, '{"r": 1, "l": [1]}', '{"o": 2}', "broken"), v, props, ["r"]).orderBy("payload_id").collect()
    assert [(r.r, r.o, r.missing) for r in rows] == [(1, 1.5, []), (None, 2.0, ["r"]), (None, 1.5, ["r"])]
    assert rows[0].asDict().keys() >= {"r", "o", "any", "l", "missing"}


def test_placeholders(spark):
    configs = spark.createDataFrame([(1, '{"mcpServers": {"s": {"env": {"A": "${X}", "B": "${NONE}", "C": 5, "D": "x${X}"}}}}'), (2, "bad")], "config_id long, config string")
    env = spark.createDataFrame([("X", "found")], "name string, env_value string")
    got = {r.key: r.value for r in P.fill_placeholders(P.config_entries(configs), env).collect()}
    assert got == {"A": "found", "B": "", "C": "5", "D": "x${X}"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b"]), st.text(max_size=6), min_size=1), min_size=1, max_size=4))
def test_records_round_trip(spark, records):
    rows = P.records_to_rows(table(spark, json.dumps(records)), "array<struct<a:string,b:string>>").collect()
    assert [(r.a, r.b) for r in rows] == [(x.get("a"), x.get("b")) for x in records]
