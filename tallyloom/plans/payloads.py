"""Payload conversion queries. Payloads are built from the tables in batches of bounded size."""

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import payloads as P
from tallyloom.plans.base import Tables, query
from tallyloom.session import dealt

BATCH = 100  # records per built payload: a payload is one value and must stay small whatever the table holds


def event_payloads(t: Tables):
    """One JSON array per (user, batch of event ids)."""
    r = F.struct("event_id", "event_type", "value", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("extra"))
    return (
        t.events.groupBy("user_id", F.floor(F.col("event_id") / BATCH).alias("b")).agg(F.to_json(F.collect_list(r)).alias("payload"))
        .select(F.concat_ws("-", "user_id", "b").alias("payload_id"), "payload")
    )


TYPED = """SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS with_extra
FROM events GROUP BY event_type"""


def profile(rows):
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count("extra").alias("with_extra"))


@query("c1_json_records", TYPED)
def c1(t: Tables):
    return profile(P.records_to_rows(event_payloads(t), "array<struct<event_id:bigint,event_type:string,value:double,extra:bigint>>"))


@query("c1_json_records_inferred", TYPED)
def c1_inferred(t: Tables):
    return profile(P.records_to_rows(event_payloads(t)))


@query("c2_json_rows_header", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def c2(t: Tables):
    row = F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))
    header = F.array(F.array(F.lit("c_custkey"), F.lit("c_name"), F.lit("c_acctbal")))
    p = t.customer.groupBy(F.floor(F.col("c_custkey") / BATCH).alias("payload_id")).agg(F.to_json(F.concat(header, F.collect_list(row))).alias("payload"))
    return P.header_rows(p, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}).drop("payload_id", "row_no")


@query("c3_json_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def c3(t: Tables):
    p = t.orders.groupBy(F.floor(F.col("o_orderkey") / BATCH).alias("payload_id")).agg(
        F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("r"))
    even = p.select("payload_id", F.to_json(F.struct(F.col("r.o_orderkey").alias("o_orderkey"), F.col("r.o_totalprice").alias("o_totalprice"))).alias("payload"))
    uneven = p.select("payload_id", F.to_json(F.struct(F.col("r.o_orderkey").alias("o_orderkey"), F.array(F.lit(1.5)).alias("o_totalprice"))).alias("payload")).where(F.size("r") != 1)
    return P.column_lists(even.unionByName(uneven), {"o_orderkey": "bigint", "o_totalprice": "double"}).drop("payload_id")


@query("c4_json_object_row", "SELECT event_id AS payload_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c4(t: Tables):
    return P.object_row(t.events.select(F.col("event_id").alias("payload_id"), F.col("props").alias("payload")), "k bigint")


def nested_docs(t: Tables):
    """customer -> nation -> region as nested objects with one list; nation and region are dimension tables of fixed size."""
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.struct(F.col("r_name").alias("name"))
    nation = F.struct(F.col("n_name").alias("name"), region.alias("region"))
    doc = F.struct(F.col("c_name").alias("name"), nation.alias("nation"), F.array("c_nationkey", "n_regionkey").alias("keys"))
    return j.select(F.col("c_custkey").alias("payload_id"), F.to_json(doc).alias("payload"))


NESTED = """FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query("c5_json_normalize", f"""
SELECT c_custkey AS payload_id, c_name AS name, n_name AS "nation.name", r_name AS "nation.region.name",
       concat(c_nationkey, ',', n_regionkey) AS keys {NESTED}""")
def c5(t: Tables):
    docs = nested_docs(t)
    schema = P.infer_schema(docs)
    flat = P.flatten(P.object_row(docs, schema))
    return flat.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query("c6_nested_as_value", f"SELECT c_custkey AS payload_id, r_name AS region, 'nested' AS kind {NESTED}")
def c6(t: Tables):
    docs = P.classify(nested_docs(t)).select("payload_id", "kind", F.col("value").alias("result"))
    return docs.select("payload_id", F.try_variant_get("result", "$.nation.region.name", "string").alias("region"), "kind")


WIDTH = 64


@query("c7_matrix_columns", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS column_{i}" for i in range(WIDTH)) + " FROM embeddings")
def c7(t: Tables):
    return t.embeddings.select("vec_id", *P.matrix_columns(t.embeddings, "embedding", WIDTH))


MIXED = """CASE event_id % 16
    WHEN 0 THEN concat('[{"a": ', CAST(event_id AS STRING), '}, {"a": 2, "b": "x"}]') WHEN 1 THEN concat('[["h", "i"], [1, ', CAST(user_id AS STRING), ']]')
    WHEN 2 THEN '{"a": [1, 2], "b": [3, 4]}' WHEN 3 THEN '{"a": [1], "b": [2, 3]}' WHEN 4 THEN props
    WHEN 5 THEN '{"a": {"b": 1}, "c": [1]}' WHEN 6 THEN CAST(event_id AS STRING) WHEN 7 THEN '"x"' WHEN 8 THEN 'null'
    WHEN 9 THEN '[1, 2, 3]' WHEN 10 THEN '[]' WHEN 11 THEN concat('plain ', event_type)
    WHEN 12 THEN concat('a,b', chr(10), '1,', CAST(user_id AS STRING)) WHEN 13 THEN '' WHEN 14 THEN '{"a": {"b": 1}}' ELSE '"42"' END"""
KIND = """CASE event_id % 16 WHEN 0 THEN 'records' WHEN 1 THEN 'rows' WHEN 2 THEN 'columns' WHEN 3 THEN 'nested' WHEN 4 THEN 'object'
    WHEN 5 THEN 'nested' WHEN 6 THEN 'scalar' WHEN 7 THEN 'csv' WHEN 8 THEN 'null' WHEN 9 THEN 'scalar' WHEN 10 THEN 'scalar'
    WHEN 11 THEN 'csv' WHEN 12 THEN 'csv' WHEN 13 THEN 'scalar' WHEN 14 THEN 'nested' ELSE 'scalar' END"""


def mixed(t: Tables):
    return t.events.select(F.col("event_id").alias("payload_id"), F.expr(MIXED).alias("payload"))


@query("c8_scalar_result", """
SELECT event_id AS payload_id, CASE event_id % 16 WHEN 6 THEN CAST(event_id AS VARCHAR) WHEN 9 THEN '[1,2,3]' WHEN 10 THEN '[]' WHEN 13 THEN '""' ELSE '42' END AS result
FROM events WHERE event_id % 16 IN (6, 9, 10, 13, 15)""")
def c8(t: Tables):
    scalar = P.classify(mixed(t)).where("kind = 'scalar'").select("payload_id", F.col("text").alias("payload"))
    return P.whole_result(scalar).select("payload_id", F.to_json("result").alias("result"))


@query("c9_null_is_empty", "SELECT CAST(event_id % 16 AS BIGINT) AS form, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 16 <> 8 GROUP BY 1")
def c9(t: Tables):
    k = P.classify(mixed(t)).where("kind <> 'null'")
    return k.groupBy((F.col("payload_id") % 16).alias("form")).agg(F.count("*").alias("n"))


@query("c10_text_dispatch", f"SELECT event_id AS payload_id, {KIND} AS kind FROM events")
def c10(t: Tables):
    return P.classify(mixed(t)).select("payload_id", "kind")


@query("c11_csv_wide", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, c_acctbal, CAST(NULL AS VARCHAR) AS absent FROM customer""")
def c11_wide(t: Tables):
    """More columns than wanted, columns without a name, a repeated name, records that end early, quotes and commas."""
    short = F.col("c_custkey") % 3 == 0
    row = F.concat_ws(",", F.lit('"x, ""y"""'), "c_acctbal", F.lit("skipped"), F.lit(""), "c_custkey", F.lit("again"))
    row = F.when(short, row).otherwise(F.concat_ws(",", row, "c_name", F.lit("beyond")))
    p = t.customer.groupBy(F.floor(F.col("c_custkey") / BATCH).alias("payload_id")).agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    p = p.select("payload_id", F.concat(F.lit("note,c_acctbal,,extra,c_custkey,c_custkey,c_name\n"), F.col("body")).alias("payload"))
    return P.csv_rows(p, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "absent": "string"}).drop("payload_id", "row_no")


@query("c2_ragged_rows", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 1 THEN c_name END AS c_name FROM customer")
def c2_ragged(t: Tables):
    """A repeated name in the header; rows that are longer or shorter than it."""
    text = F.to_json(F.array(F.col("c_custkey").cast("string"), F.lit("first"), "c_name", F.lit("beyond")))
    cut = F.to_json(F.array(F.col("c_custkey").cast("string")))
    row = F.when(F.col("c_custkey") % 4 == 1, cut).otherwise(text)
    payload = F.concat(F.lit('[["c_custkey", "other", "c_name", "other"], '), row, F.lit("]"))
    p = t.customer.select(F.col("c_custkey").alias("payload_id"), payload.alias("payload"))
    return P.header_rows(p, {"c_custkey": "bigint", "c_name": "string"}).drop("payload_id", "row_no")


@query("c1_inferred_records", """
SELECT event_id AS payload_id, CASE WHEN event_id % 2 = 0 THEN concat('v', event_id) END AS "VOIDED",
       concat('1', lpad(CAST(event_id AS VARCHAR), 8, '0'), '000000000000000000000') AS big, CAST(NULL AS VARCHAR) AS nothing FROM events WHERE event_id % 5 < 3""")
def c1_odd_records(t: Tables):
    """A field named like a type, whole numbers beyond 64 bits, a field that is always null, and payloads of other shapes."""
    void = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"v'), "event_id", F.lit('"'))).otherwise(F.lit("null"))
    record = F.concat(F.lit('[{"VOIDED": '), void, F.lit(', "big": 1'), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit("000000000000000000000"), F.lit(', "nothing": null}]'))
    other = F.when(F.col("event_id") % 5 == 3, '[1, {"a": 2}]').otherwise('[{"broken": ')
    events = dealt(t.events.select("event_id"), "event_id", most=100_000)  # the payloads are made from short rows
    rows = P.records_to_rows(events.select(F.col("event_id").alias("payload_id"), F.when(F.col("event_id") % 5 < 3, record).otherwise(other).alias("payload")))
    return rows.select("payload_id", "VOIDED", F.col("big").cast("string").alias("big"), "nothing")


@query("c1_rejects", """
SELECT event_id AS payload_id, CASE event_id % 5 WHEN 1 THEN 'malformed JSON' WHEN 2 THEN 'a single list' WHEN 3 THEN 'lists of unequal length' ELSE 'objects and other values mixed' END AS reason
FROM events WHERE event_id % 5 > 0""")
def c1_rejects(t: Tables):
    id_ = F.col("event_id").cast("string")
    payload = F.element_at(F.array(
        F.concat(F.lit('[{"a": '), id_, F.lit("}]")), F.concat(F.lit('[{"a": '), id_), F.concat(F.lit("[["), id_, F.lit("]]")),
        F.concat(F.lit('{"a": [1], "b": [1, '), id_, F.lit("]}")), F.concat(F.lit('[{"a": 1}, '), id_, F.lit("]"))), (F.col("event_id") % 5 + 1).cast("int"))
    return P.rejected(t.events.select(F.col("event_id").alias("payload_id"), payload.alias("payload")))


@query("c14_dotted_and_defaults", """
SELECT event_id, concat('u', user_id) AS "user.name", CASE WHEN event_id % 2 = 0 THEN CAST(len(string_split(event_type, 'e')) AS BIGINT) ELSE 2 END AS items FROM events""")
def c14_dotted(t: Tables):
    """A property with a dot in its name and a list as default."""
    parts = F.to_json(F.split("event_type", "e"))
    body = F.concat(F.lit('{"user.name": "u'), "user_id", F.lit('"'), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "tags": '), parts)).otherwise(""), F.lit("}"))
    rows = t.events.select("event_id", F.try_parse_json(body).alias("v"))
    typed = P.typed_or_rejected(rows, F.col("v"), {"user.name": {"type": "string"}, "tags": {"type": "array", "default": ["a", "b"]}}, ["user.name"])
    return typed.where("size(missing) = 0").select("event_id", "`user.name`", F.size("tags").cast("long").alias("items"))


@query("c11_csv_payload", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN concat('a "q", ', c_name) ELSE c_name END AS c_name, c_acctbal FROM customer""")
def c11(t: Tables):
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('"a ""q"", '), "c_name", F.lit('"'))).otherwise(F.col("c_name"))
    swapped = F.floor(F.col("c_custkey") / BATCH) % 2 == 1  # every other payload names its columns in another order
    row = F.when(swapped, F.concat_ws(",", "c_acctbal", name, "c_custkey")).otherwise(F.concat_ws(",", "c_custkey", name, "c_acctbal"))
    head = F.when(F.col("payload_id") % 2 == 1, "c_acctbal,c_name,c_custkey\n").otherwise("c_custkey,c_name,c_acctbal\n")
    p = t.customer.groupBy(F.floor(F.col("c_custkey") / BATCH).alias("payload_id")).agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    p = p.select("payload_id", F.concat(head, F.col("body")).alias("payload"))
    return P.csv_rows(p, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}).drop("payload_id", "row_no")


@query("c12_convert_gate", "SELECT event_id AS payload_id, event_id % 16 NOT IN (4, 14) AS converted FROM events WHERE event_id % 16 NOT IN (8)")
def c12(t: Tables):
    k = P.classify(mixed(t)).where("kind <> 'null'")
    return k.select("payload_id", F.coalesce(P.convertible(F.col("value")), F.lit(True)).alias("converted"))


# Every 7th document loses its closing brace.
def broken_props(t: Tables):
    cut = F.expr("substring(props, 1, length(props) - 1)")
    return t.events.select(F.col("event_id").alias("payload_id"), F.when(F.col("event_id") % 7 == 0, cut).otherwise(F.col("props")).alias("payload"))


@query("c13_prefer_fallback", """
SELECT event_id AS payload_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) END AS raw,
       CASE WHEN event_id % 7 = 0 THEN 'quarantine' ELSE 'typed' END AS route FROM events""")
def c13(t: Tables):
    b = broken_props(t)
    v = F.try_parse_json("payload")
    k = F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.try_variant_get(v, "$.k", "string").try_cast("bigint"))
    return b.select("payload_id", k.alias("k"), F.when(v.isNull(), F.col("payload")).alias("raw"),
                    F.when(v.isNull(), "quarantine").otherwise("typed").alias("route"))


@query("c14_schema_typed_ingest", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)
SELECT event_id AS payload_id, k, 'n/a' AS note, CAST(NULL AS DOUBLE) AS score, CASE WHEN k IS NULL THEN 'k' ELSE '' END AS missing FROM e""")
def c14(t: Tables):
    props = {"note": {"type": "string", "default": "n/a"}, "k": {"type": "integer"}, "score": {"type": "number"}}
    v = F.try_parse_json("payload")
    typed = P.typed_or_rejected(broken_props(t), v, props, ["k"])
    return typed.select("payload_id", "k", "note", "score", F.array_join("missing", ",").alias("missing"))


TOOL_SCHEMA = """concat('{"type": "object", "properties": {"size": {"type": "integer", "description": "size of ', p_name,
    '"}, "name": {"type": "string"}', CASE WHEN p_partkey % 2 = 0 THEN ', "any": {"description": "free"}' ELSE '' END,
    '}', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', "required": ["size"]' END, '}')"""


@query("c15_schema_catalog", """
WITH p AS (SELECT p_type AS server, concat('tool', p_partkey) AS tool, p_name AS description, p_partkey % 3 <> 0 AS req, p_partkey % 2 = 0 AS free FROM part),
     r AS (SELECT *, 'size' AS param, 'integer' AS type, req AS required, concat('size of ', description) AS param_description FROM p
           UNION ALL SELECT *, 'name', 'string', FALSE, '' FROM p UNION ALL SELECT *, 'any', 'any', FALSE, 'free' FROM p WHERE free)
SELECT server, tool, concat(server, '_', tool) AS full_name, param, type, required, param_description, description FROM r""")
def c15(t: Tables):
    tools = t.part.select(F.col("p_type").alias("server"), F.concat(F.lit("tool"), "p_partkey").alias("tool"),
                          F.col("p_name").alias("description"), F.expr(TOOL_SCHEMA).alias("schema"))
    return P.schema_catalog(tools)


CONFIG = """CASE WHEN p_partkey % 10 = 9 THEN '{broken' ELSE
    concat(CASE WHEN p_partkey % 2 = 0 THEN '{"mcpServers": ' ELSE '' END, '{"srv": {"command": "run", "env": {"A": "${S_',
           CAST(p_partkey % 200 AS STRING), '}", "B": ', CAST(p_size AS STRING), ', "C": "', p_brand, '"}}}',
           CASE WHEN p_partkey % 2 = 0 THEN '}' ELSE '' END) END"""


@query("c16_placeholders", """
WITH p AS (SELECT * FROM part WHERE p_partkey % 10 <> 9)
SELECT p_partkey AS config_id, 'srv' AS server, 'A' AS key, coalesce(s_name, '') AS value FROM p LEFT JOIN supplier ON s_suppkey = p_partkey % 200
UNION ALL SELECT p_partkey, 'srv', 'B', CAST(p_size AS VARCHAR) FROM p UNION ALL SELECT p_partkey, 'srv', 'C', p_brand FROM p""")
def c16(t: Tables):
    configs = t.part.select(F.col("p_partkey").alias("config_id"), F.expr(CONFIG).alias("config"))
    env = t.supplier.select(F.concat(F.lit("S_"), "s_suppkey").alias("name"), F.col("s_name").alias("env_value"))
    return P.fill_placeholders(P.config_entries(configs), env)


@query("s6_json_payload_scan", """
SELECT event_id AS payload_id, event_id % 7 <> 0 AS is_json, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS raw,
       CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def s6(t: Tables):
    v = F.try_parse_json("payload")
    return broken_props(t).select("payload_id", v.isNotNull().alias("is_json"), F.col("payload").alias("raw"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("p16_json_type_filter", """
SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT event_id, 'flag', 'true' FROM events WHERE event_id % 2 = 0""")
def p16(t: Tables):
    merged = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.when(F.col("event_id") % 2 == 0, ', "flag": true, "gone": null}').otherwise(', "gone": null}'))
    m = t.events.select("event_id", F.explode(F.try_variant_get(F.try_parse_json(merged), "$", "map<string,variant>")).alias("key", "v"))
    return m.where(F.schema_of_variant("v") != "VOID").select("event_id", "key", F.try_variant_get("v", "$", "string").alias("value"))
