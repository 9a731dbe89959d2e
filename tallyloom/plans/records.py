"""Table -> JSON records and series, with NaN and infinities made safe."""

from pyspark.sql import functions as F

from tallyloom.functions import numbers as N
from tallyloom.plans.base import Tables, query

# Every 10th value NaN, 11th +Inf, 13th -Inf, 17th null; both engines read the expression alike.
def spoiled(key: str, value: str) -> str:
    return f"""CASE WHEN {key} % 10 = 0 THEN CAST('NaN' AS DOUBLE) WHEN {key} % 11 = 0 THEN CAST('Infinity' AS DOUBLE)
        WHEN {key} % 13 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {key} % 17 = 0 THEN NULL ELSE {value} END"""


def word_and_number(key: str, value: str) -> str:
    return f"""CASE WHEN {key} % 10 = 0 THEN NULL WHEN {key} % 11 = 0 THEN 'Infinity' WHEN {key} % 13 = 0 THEN '-Infinity' END AS word,
       CASE WHEN {key} % 10 = 0 OR {key} % 11 = 0 OR {key} % 13 = 0 OR {key} % 17 = 0 THEN NULL ELSE round({value}, 10) END AS number"""


def split_text(c):
    """JSON scalar text -> infinity word and number, for comparing across engines."""
    word = F.when(c.isin("Infinity", "-Infinity"), c)
    return [word.alias("word"), F.when(word.isNull(), c.try_cast("double")).alias("number")]


ISO = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0'))"


@query("s12_json_records", f"""
SELECT event_id, event_type, {ISO} AS ts, {word_and_number('event_id', 'value')}, TRUE AS keeps_nulls FROM events""")
def s12(t: Tables):
    e = t.events.select("event_id", "event_type", "ts", F.expr(spoiled("event_id", "value")).alias("value"))
    r = N.json_records(e)
    get = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select(get("event_id").cast("long").alias("event_id"), get("event_type").alias("event_type"), get("ts").alias("ts"),
                    *split_text(get("value")), F.array_contains(F.json_object_keys("record"), "value").alias("keeps_nulls"))


# Records are cleaned whatever table library they come from.
@query("s16_arrow_records", f"SELECT s_suppkey, {word_and_number('s_suppkey', 's_acctbal')} FROM supplier")
def s16(t: Tables):
    same = t.supplier.select("s_suppkey", F.expr(spoiled("s_suppkey", "s_acctbal")).alias("v")).mapInArrow(lambda batches: batches, "s_suppkey bigint, v double")
    r = N.json_records(same)
    get = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select(get("s_suppkey").cast("long").alias("s_suppkey"), *split_text(get("v")))


@query("s12_json_records_wide", f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {word_and_number('l_partkey', 'l_tax')} FROM lineitem""")
def s12_wide(t: Tables):
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    r = N.json_records(t.lineitem.select(*cols, F.expr(spoiled("l_partkey", "l_tax")).alias("l_tax")))
    j = F.from_json("record", "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_tax string")
    return r.select(j.alias("j")).select("j.l_orderkey", "j.l_partkey", "j.l_suppkey", "j.l_linenumber", *split_text(F.col("j.l_tax")))


# A series is (index, value); it stays rows keyed by group and index, so that no group is gathered in one place.
@query("s13_json_series", f"""
SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS idx, {word_and_number('o_orderkey', 'o_totalprice')} FROM orders""")
def s13(t: Tables):
    o = t.orders.select("o_custkey", F.col("o_orderkey").cast("string").alias("idx"),
                        N.clean_double(F.expr(spoiled("o_orderkey", "o_totalprice"))).alias("v"))
    return o.select("o_custkey", "idx", *split_text(F.col("v")))


@query("s14_json_array", """
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, CAST(i AS BIGINT) AS i, CASE WHEN i % 11 = 0 THEN 'Infinity' END AS word,
       CASE WHEN i % 10 = 0 OR i % 11 = 0 THEN NULL ELSE round(CAST(x AS DOUBLE), 10) END AS number FROM e""")
def s14(t: Tables):
    holed = F.transform("embedding", lambda x, i: F.when((i + 1) % 10 == 0, F.lit(float("nan"))).when((i + 1) % 11 == 0, N.INFINITY).otherwise(x.cast("double")))
    e = t.embeddings.select("vec_id", F.posexplode(N.clean_array(holed)).alias("p", "v"))
    return e.select("vec_id", (F.col("p") + 1).cast("long").alias("i"), *split_text(F.col("v")))


@query("s15_json_scalar", """
SELECT p_brand, CAST(round(avg(p_retailprice), 6) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS word FROM part GROUP BY p_brand
UNION ALL SELECT 'undefined', NULL, NULL UNION ALL SELECT 'overflow', NULL, 'Infinity' """)
def s15(t: Tables):
    p = t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    top = t.part.agg(F.max("p_retailprice").alias("m"))
    extra = top.select(F.lit("undefined").alias("p_brand"), (F.col("m") * F.lit(float("nan"))).alias("v")).unionByName(
        top.select(F.lit("overflow").alias("p_brand"), (F.col("m") * N.INFINITY).alias("v")))
    return p.unionByName(extra).select("p_brand", *split_text(N.clean_double(F.col("v"))))


@query("f21_special_numbers", f"""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {word_and_number('l_orderkey', 'l_extendedprice')} FROM lineitem""")
def f21(t: Tables):
    v = N.clean_double(F.expr(spoiled("l_orderkey", "l_extendedprice")))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), *split_text(v))
