"""Relational categories that Spark provides: one query each, on the given tables. Also the registered helper functions."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window as W, functions as F

from tallyloom.functions import helpers as HP, numbers as N
from tallyloom.operators import ordered as O, payloads as P, registry as R, sketches as K
from tallyloom.plans.base import Tables, query
from tallyloom.session import dealt_to_join, stash


@query("d1_joins", """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment""")
def d1(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    joined = t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.sum("n").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query("d1_outer_joins", """
SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
UNION ALL SELECT s_suppkey, o_orderkey FROM supplier RIGHT JOIN orders ON s_suppkey = o_custkey""")
def d1_outer(t: Tables):
    on = F.col("c_custkey") == F.col("o_custkey")
    pick = lambda df: df.select("c_custkey", "o_orderkey")
    full, left = t.customer.join(t.orders, on, "full"), t.customer.join(t.orders, on, "left")
    right = t.supplier.select(F.col("s_suppkey").alias("c_custkey")).join(t.orders, on, "right")
    return pick(full).unionByName(pick(left)).unionByName(pick(right))


@query("d2_semi_anti_range", """
SELECT 'semi' AS form, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
UNION ALL SELECT 'anti', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def d2(t: Tables):
    later = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.expr("o_orderdate + INTERVAL '60' DAY"))
    lines = dealt_to_join(t.lineitem, "l_orderkey")
    semi = t.orders.join(lines, later, "left_semi")
    anti = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return semi.select(F.lit("semi").alias("form"), "o_orderkey").unionByName(anti.select(F.lit("anti").alias("form"), "o_orderkey"))


@query("d3_asof_join", """
SELECT p.event_id, p.user_id, (SELECT max(c.event_id) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND (c.ts, c.event_id) <= (p.ts, p.event_id)
       AND c.ts = (SELECT max(ts) FROM events d WHERE d.user_id = p.user_id AND d.event_type = 'click' AND (d.ts, d.event_id) <= (p.ts, p.event_id))) AS click_id
FROM events p WHERE p.event_type = 'purchase'""")
def d3(t: Tables):
    e = t.events.where(F.col("event_type").isin("purchase", "click")).select("event_id", "user_id", "ts", "event_type")
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    laid = O.carry_forward(e, ["user_id"], ["ts", "event_id"], click, "click_id")
    return laid.where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query("d4_rollup_cube", """
SELECT 'rollup' AS form, l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT 'cube', l_returnflag, l_linestatus, CAST(count(*) AS BIGINT), round(sum(l_quantity), 2) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT 'sets', l_returnflag, NULL, CAST(count(*) AS BIGINT), round(sum(l_quantity), 2) FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def d4(t: Tables):
    """A cube has the groups of the rollup and of the sets too, so one pass makes all three."""
    cube = t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.grouping_id().alias("level"))
    forms = lambda *names: F.array(*[F.lit(x) for x in names])
    form = F.when(F.col("level") == 0, forms("rollup", "cube")).when(F.col("level") == 2, forms("cube")).otherwise(forms("rollup", "cube", "sets"))
    return cube.select(F.explode(form).alias("form"), "l_returnflag", "l_linestatus", "n", "qty")


@query("d4_distinct_pivot", """
SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS "F",
       CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS "O", CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS "P" FROM orders GROUP BY o_orderpriority""")
def d4_pivot(t: Tables):
    pivoted = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers")).join(pivoted, "o_orderpriority")


@query("d4_approx_distinct", """SELECT l_returnflag, TRUE AS within_bound FROM lineitem GROUP BY l_returnflag""")
def d4_approx(t: Tables):
    """HyperLogLog++ with 2% relative error must lie within 10% of the exact count."""
    a = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.countDistinct("l_partkey").alias("exact"))
    return a.select("l_returnflag", (F.abs(F.col("approx") - F.col("exact")) <= F.col("exact") * 0.1).alias("within_bound"))


@query("d4_stored_sketches", """
WITH e AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, value FROM events WHERE ts IS NOT NULL)
SELECT event_type, week, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(value) AS BIGINT) AS n, TRUE AS users_within, TRUE AS median_within
FROM e GROUP BY GROUPING SETS ((event_type, week), (event_type))""")
def d4_sketches(t: Tables):
    """Sketches per day, stored, then merged per week and over all days. Distinct users must lie within 8 % (five standard errors)
    and one of the exact count, the rank of the median within 3 %."""
    days = stash(K.daily(t.events, ["event_type"], "ts", "user_id", "value"), "sketches")
    week = F.date_trunc("week", "day").cast("date").alias("week")
    both = K.merged(days, ["event_type", week]).unionByName(K.merged(days, ["event_type"]).withColumn("week", F.lit(None).cast("date")))
    found = K.estimates(both, 0.5).withColumn("median", F.col("quantiles")[0]).select(F.col("event_type").alias("kind"), F.col("week").alias("of"), "rows", "n", "distinct", "median")
    every = t.events.where("ts is not null").select("event_type", F.explode(F.array(F.date_trunc("week", "ts").cast("date"), F.lit(None).cast("date"))).alias("week"), "user_id", "value")
    joined = every.join(found, F.col("event_type").eqNullSafe(F.col("kind")) & F.col("week").eqNullSafe(F.col("of")))
    exact = joined.groupBy("event_type", "week", "rows", "n", "distinct").agg(
        F.countDistinct("user_id").alias("users"), F.avg((F.col("value") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("upto"))
    return exact.select("event_type", "week", F.col("rows").alias("n_rows"), "n", (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") * 0.08 + 1).alias("users_within"),
                        ((F.col("below") <= 0.53) & (F.col("upto") >= 0.47)).alias("median_within"))


@query("d5_ranking", """
SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rk <= 3""")
def d5(t: Tables):
    """rank <= 3 is cut per task before the shuffle, so a hot customer sends only a few rows."""
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = t.orders.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rk", F.rank().over(w)).where("rk <= 3")
    return top.withColumn("dr", F.dense_rank().over(w)).select("o_custkey", "o_orderkey", F.col("rk").cast("long").alias("rk"), F.col("dr").cast("long").alias("dr"))


@query("d5_frames", """
SELECT event_id, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS running,
       lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def d5_frames(t: Tables):
    """Running sum and previous row per user, cut into slices for hot users."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    e = t.events.select("event_id", "user_id", "ts", k.alias("k"))
    out = O.frames(e, ["user_id"], ["ts", "event_id"], running=O.total(F.col("k")), previous=O.before(F.col("event_id")))
    return out.select("event_id", "running", "previous")


SKEWED = "SELECT event_id, user_id % 2 AS side, CASE WHEN event_id % 7 <> 0 THEN ts END AS pos, CASE WHEN event_id % 5 <> 0 THEN event_id END AS v FROM events"


@query("d5_skewed_frames", f"""
SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS running, CAST(row_number() OVER w AS BIGINT) AS n, lag(v) OVER w AS previous,
       last_value(v IGNORE NULLS) OVER w AS carried FROM ({SKEWED})
WINDOW w AS (PARTITION BY side ORDER BY pos NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def d5_skewed(t: Tables):
    """Two keys for all events, null positions and null values."""
    e = t.events.selectExpr("event_id", "user_id % 2 AS side", "CASE WHEN event_id % 7 <> 0 THEN ts END AS pos", "CASE WHEN event_id % 5 <> 0 THEN event_id END AS v")
    v = F.col("v")
    out = O.frames(e, ["side"], ["pos", "event_id"], running=O.total(v), n=O.number(), previous=O.before(v), carried=O.carried(v))
    return out.select("event_id", "running", "n", "previous", "carried")


@query("d5_range_frame", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near FROM lineitem""")
def d5_range(t: Tables):
    """The lines of one order: seven line numbers at most."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 1)
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("near"))


@query("d6_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def d6(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("d7_set_operations", """
SELECT 'union' AS form, n FROM (SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', n FROM (SELECT c_custkey AS n FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', n FROM (SELECT c_custkey AS n FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'except all', n FROM (SELECT o_custkey AS n FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def d7(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("n"))
    o = t.orders.select(F.col("o_custkey").alias("n"))
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("n"))
    nations = t.customer.select(F.col("c_nationkey").cast("long").alias("n")).union(t.supplier.select(F.col("s_nationkey").cast("long"))).distinct()
    tag = lambda df, form: df.select(F.lit(form).alias("form"), "n")
    return tag(nations, "union").unionByName(tag(c.intersect(o), "intersect")).unionByName(tag(c.subtract(done), "except")).unionByName(tag(o.exceptAll(c), "except all"))


@query("d8_functions", """
SELECT doc_id, upper(lang) AS lang, CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT) AS words, md5(replace(text, ' ', '_')) AS joined,
       round(sqrt(n_chars), 6) AS root, CAST(instr(text, 'e') AS BIGINT) AS first_e FROM documents""")
def d8(t: Tables):
    return t.documents.select(
        "doc_id", F.upper("lang").alias("lang"), F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("words"),
        F.md5(F.replace("text", F.lit(" "), F.lit("_")).cast("binary")).alias("joined"), F.round(F.sqrt("n_chars"), 6).alias("root"),
        F.instr("text", "e").cast("long").alias("first_e"))


@query("d9_reshape", """
SELECT p_partkey AS id, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
UNION ALL SELECT user_id, 'events', CAST(count(*) AS DOUBLE) FROM events GROUP BY user_id
UNION ALL SELECT event_id, 'filled', CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END FROM events""")
def d9(t: Tables):
    """Melt, concatenate, drop duplicates and fill nulls."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    melted = p.unpivot("id", ["size", "price"], "variable", "value")
    users = t.events.select("user_id").dropDuplicates().join(t.events.groupBy("user_id").agg(F.count("*").cast("double").alias("value")), "user_id")
    filled = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")).na.fill(0.0)
    return melted.unionByName(users.select(F.col("user_id").alias("id"), F.lit("events").alias("variable"), "value")).unionByName(
        filled.select("id", F.lit("filled").alias("variable"), "value"))


@query("d9_sample", "SELECT event_id, user_id FROM events WHERE substr(md5(CAST(event_id AS VARCHAR)), 1, 2) < '1a'")
def d9_sample(t: Tables):
    """About a tenth of the rows, the same ones in every run: by a hash of the key."""
    return t.events.where(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 2) < "1a").select("event_id", "user_id")


@query("x1_helper_functions", """
SELECT p_partkey, CASE WHEN regexp_matches(n, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$') THEN regexp_replace(lower(n), '[-_.]+', '-', 'g') END AS name,
       round(p_partkey * 1000 / 1048576.0, 2) AS mb FROM (SELECT *, concat(p_name, '_', p_partkey) AS n FROM part)""")
def x1(t: Tables):
    HP.register(t.spark)
    return t.part.selectExpr("p_partkey", "tl_package_name(concat(p_name, '_', p_partkey)) AS name", "tl_megabytes(p_partkey * 1000) AS mb")


@query("x1_scalar_helpers", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'Infinity' WHEN event_id % 5 = 2 THEN '-Infinity'
         ELSE concat(event_id % 1000, '.5') END AS number,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, FALSE AS is_table, event_id % 2 = 0 AS list_is_table, floor(epoch(ts))::BIGINT AS seconds FROM events
UNION ALL SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(text[1:500], '...') ELSE coalesce(text, '') END, NULL, NULL, NULL,
       CAST(length(string_split(text, chr(10))[1]) AS BIGINT) FROM documents""")
def x1_scalar_helpers(t: Tables):
    """The other helper functions, over all events and all documents."""
    HP.register(t.spark)
    number = "CASE event_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') WHEN 2 THEN double('-Infinity') ELSE event_id % 1000 + 0.5D END"
    events = t.events.selectExpr(
        "event_id", f"tl_clean_number({number}) AS number", "CAST(tl_json_text(props, 'k') AS BIGINT) AS k", "tl_is_table(props) AS is_table",
        "tl_is_table(CASE WHEN event_id % 2 = 0 THEN concat('[', props, ']') ELSE 'no json' END) AS list_is_table", "tl_epoch(ts) AS seconds")
    texts = t.documents.selectExpr("doc_id AS event_id", "tl_preview(text) AS number", "CAST(NULL AS BIGINT) AS k", "CAST(NULL AS BOOLEAN) AS is_table",
                                   "CAST(NULL AS BOOLEAN) AS list_is_table", "CAST(length(tl_first_line(text)) AS BIGINT) AS seconds")
    return events.unionByName(texts)


PROPS_SCHEMA = '{"properties": {"note": {"type": "string"}, "k": {"type": "integer"}}, "required": ["k"]}'


@query("x2_schema_to_columns", "SELECT event_id AS payload_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS note FROM events")
def x2(t: Tables):
    return P.object_row(t.events.select(F.col("event_id").alias("payload_id"), F.col("props").alias("payload")), HP.schema_struct(PROPS_SCHEMA))


@query("x3_user_code", "SELECT event_id, value * 2 + 1 AS scaled FROM events")
def x3(t: Tables):
    def user_code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "scaled": b["value"] * 2 + 1})

    return t.events.select("event_id", "value").mapInPandas(user_code, "event_id bigint, scaled double")
