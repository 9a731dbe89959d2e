"""Named results, file round trips and map overlays."""

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions import maps as M, numbers as N
from tallyloom.operators import named as D
from tallyloom.plans.base import Tables, query
from tallyloom.session import work_folder
from tallyloom.sources import files as S

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
          "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("s1_csv_scan", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s1(t: Tables):
    folder = work_folder(t.spark, "csv")
    S.write_csv(t.customer, folder)
    df = S.read_csv(t.spark, folder)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal", "c_mktsegment")


@query("s11_csv_export", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def s11(t: Tables):
    folder = work_folder(t.spark, "export")
    S.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), folder)
    return S.read_csv(t.spark, folder, schema="o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string")


@query("s8_named_result", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")
def s8(t: Tables):
    D.save(t.customer, "tl_customers", "load")
    D.save(t.spark.table("tl_customers").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "tl_customers_by_segment", "group")
    return t.spark.table("tl_customers_by_segment")


def three_views(t: Tables):
    big = t.orders.select("o_orderkey", "o_custkey")
    return {"big_orders": big, "active_users": t.events.groupBy("user_id").agg(F.count("*").alias("n")),
            "brands": t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "_private": t.region}


RESTORED = """SELECT 'big_orders' AS name, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
UNION ALL SELECT 'active_users', count(DISTINCT user_id), CAST(count(*) AS BIGINT) FROM events UNION ALL SELECT 'brands', count(DISTINCT p_brand), CAST(count(*) AS BIGINT) FROM part"""


def restored(t: Tables, folder: str):
    tables, _ = D.restore(t.spark.newSession(), folder)
    key = {"big_orders": "o_orderkey", "active_users": "n", "brands": "n"}
    rows = [df.agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum(key[n]).alias("key_sum")) for n, df in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("s9_workspace_snapshot", "SELECT unnest(['active_users', 'big_orders', 'brands']) AS name, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS big_rows")
def s9(t: Tables):
    folder = work_folder(t.spark, "snapshot")
    D.snapshot(three_views(t), folder)
    listed = t.spark.read.parquet(f"{folder}/_manifest/v=1").select("name", "path")
    big = t.spark.read.parquet(listed.where("name = 'big_orders'").first().path).agg(F.count("*").alias("big_rows"))
    return listed.select("name").crossJoin(F.broadcast(big))  # one row


@query("s10_workspace_restore", RESTORED)
def s10(t: Tables):
    folder = work_folder(t.spark, "snapshot")
    D.snapshot(three_views(t), folder)
    return restored(t, folder)


@query("s17_interchange", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value * 2), 2) AS doubled FROM events GROUP BY event_type")
def s17(t: Tables):
    """Rows pass through Arrow in batches inside the tasks; nothing is collected."""

    def double(batches):
        for b in batches:
            value = pa.compute.multiply(b.column("value"), 2.0)
            yield pa.RecordBatch.from_arrays([b.column("event_type"), value], names=["event_type", "value"])

    df = t.events.select("event_type", "value").mapInArrow(double, "event_type string, value double")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("doubled"))


@query("a8_table_inventory", " UNION ALL ".join(
    f"SELECT '{n}' AS name, 'spark' AS type, CAST(count(*) AS BIGINT) AS rows, CAST({WIDTHS[n]} AS BIGINT) AS columns FROM {n}" for n in NAMES))
def a8(t: Tables):
    return D.inventory({n: getattr(t, n) for n in NAMES}).drop("memory_mb")


@query("l1_sort_by_name", " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS rows FROM {n}" for n in NAMES))
def l1(t: Tables):
    rows = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in NAMES]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("name")


@query("a14_result_profile", """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders) AS rows, 'o_orderkey,o_custkey,o_orderpriority' AS columns,
       (SELECT string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5)) AS sample_keys, CAST(NULL AS VARCHAR) AS error""")
def a14(t: Tables):
    s = D.result_summary(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"])
    keys = F.transform("sample", lambda r: F.get_json_object(r, "$.o_orderkey"))
    return s.select("rows", F.array_join("columns", ",").alias("columns"), F.array_join(keys, ",").alias("sample_keys"), "error")


@query("l7_describe", """
SELECT 'count' AS summary, CAST(count(p_retailprice) AS VARCHAR) AS shown FROM part
UNION ALL SELECT 'min', CAST(min(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'max', CAST(max(p_size) AS VARCHAR) FROM part""")
def l7(t: Tables):
    df = t.part.summary("count", "min", "max")
    return df.select("summary", F.when(F.col("summary") == "count", F.col("p_retailprice")).otherwise(F.col("p_size")).alias("shown"))


@query("k11_workspace_query", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, 'ok' AS state FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'AnalysisException', NULL, 'failed' UNION ALL SELECT 'failed while running', NULL, 'failed' """)
def k11(t: Tables):
    t.orders.createOrReplaceTempView("tl_orders")
    _, records = D.run_sql(t.spark, "SELECT o_orderpriority, count(*) AS n FROM tl_orders GROUP BY o_orderpriority", "tl_priorities")
    failed, _ = D.run_sql(t.spark, "SELECT no_such_column FROM tl_orders")
    get = lambda k: F.get_json_object("record", f"$.{k}")
    good = records.select(get("o_orderpriority").alias("o_orderpriority"), get("n").cast("long").alias("n"), F.lit("ok").alias("state"))
    late, _ = D.run_sql(t.spark, "SELECT raise_error(o_orderpriority) AS n FROM tl_orders")
    late = late.select(F.lit("failed while running").alias("o_orderpriority"), F.lit(None).cast("long").alias("n"),
                       F.when(F.col("success"), "ok").otherwise("failed").alias("state"))
    return good.unionByName(late).unionByName(failed.select(F.col("error_type").alias("o_orderpriority"), F.lit(None).cast("long").alias("n"),
                                          F.when(F.col("success"), "ok").otherwise("failed").alias("state")))


@query("u9_map_overlay", """
SELECT p_partkey, unnest(['a', 'b', 'c', 'd']) AS key, unnest([p_name, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'base' END, p_type, 'extra']) AS value FROM part""")
def u9(t: Tables):
    lit = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])
    base = lit(a=F.lit("base"), b=F.lit("base"), c=F.lit("base"))
    middle = F.when(F.col("p_size") % 2 == 0, lit(b=F.col("p_brand"), c=F.lit("middle"))).otherwise(lit(c=F.lit("middle")))
    top = lit(a=F.col("p_name"), c=F.col("p_type"), d=F.lit("extra"))
    return t.part.select("p_partkey", F.explode(M.overlay(base, middle, top)).alias("key", "value"))
