"""Session registry and ordered-per-key queries over events, orders, customer and conversations."""

from pyspark.sql import Window as W, functions as F

from tallyloom.operators import history as H, registry as R
from tallyloom.plans.base import Tables, query
from tallyloom.plans.payloads import broken_props

NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query("w3_request_ordinal", f"SELECT event_id, user_id, CAST(n AS BIGINT) AS n FROM {NUMBERED}")
def w3(t: Tables):
    return R.numbered_requests(t.events.select("event_id", "user_id", "ts")).select("event_id", "user_id", "n")


@query("w4_checkpoint_every_n", f"SELECT event_id, user_id, CAST(n AS BIGINT) AS n FROM {NUMBERED} WHERE n % 10 = 0")
def w4(t: Tables):
    return R.checkpoints(R.numbered_requests(t.events.select("event_id", "user_id", "ts"))).select("event_id", "user_id", "n")


@query("w5_conditional_reset", f"""
WITH RECURSIVE e AS {NUMBERED},
  r AS (SELECT user_id, n, 0 AS since, FALSE AS hit FROM (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n FROM events)
        UNION ALL
        SELECT e.user_id, e.n, CASE WHEN r.since + 1 >= 20 AND event_type = 'purchase' THEN 0 ELSE r.since + 1 END,
               r.since + 1 >= 20 AND event_type = 'purchase' FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, CAST(n AS BIGINT) AS n FROM r WHERE hit""")
def w5(t: Tables):
    numbered = R.numbered_requests(t.events.select("event_id", "user_id", "ts", "event_type"))
    return R.conditional_resets(numbered, F.col("event_type") == "purchase", after=20)


@query("w6_keep_first_k", f"SELECT event_id, user_id FROM {NUMBERED} WHERE n <= 3")
def w6(t: Tables):
    rank = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))  # limited per task before the shuffle
    return t.events.select("event_id", "user_id", "ts").withColumn("n", rank).where(F.col("n") <= R.KEPT_ON_RESET).select("event_id", "user_id")


def spaced_sql(gap_test: str, columns: str) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM d),
  r AS (SELECT user_id, rn, us, us AS last, TRUE AS kept FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.rn, e.us, CASE WHEN e.us - r.last {gap_test} THEN e.us ELSE r.last END, e.us - r.last {gap_test}
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT {columns} FROM r"""


@query("w8_heartbeat_thin", spaced_sql("> 3600000000", "user_id, CAST(us AS BIGINT) AS position, kept"))
def w8(t: Tables):
    return R.heartbeats(t.events.select("user_id", "ts"), "user_id", seconds=3600)


@query("w11_ttl_first", spaced_sql(">= 21600000000", "user_id, CAST(us AS BIGINT) AS position, NOT kept AS hit"))
def w11(t: Tables):
    return R.cache_lookups(t.events.select("user_id", "ts"), "user_id", seconds=21600)


@query("w7_line_offsets", """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
     l AS (SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no, unnest(a) AS line FROM p)
SELECT doc_id, line_no, CAST(strlen(line) AS BIGINT) AS bytes,
       CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l""")
def w7(t: Tables):
    """A document is one value, so its lines are a bounded group."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    l = l.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.octet_length("line").cast("long").alias("bytes"))
    before = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    return l.withColumn("byte_offset", F.coalesce(F.sum(F.col("bytes") + 1).over(before), F.lit(0)))


RANGES = {
    "6": (0, 6, 6), "1-3": (0, 1, 3), ":3": (0, 1, 2), "~2/1-2": (2, 1, 2), "~1": (1, 1, 10**9), "2-": (0, 2, 10**9),
}


def history_sql() -> str:
    base = """WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no,
        dense_rank() OVER (ORDER BY conv_id DESC) - 1 AS back, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations) """
    parts = [f"SELECT '{k}' AS span, conv_id, CAST(line_no AS BIGINT) AS line_no, role FROM c WHERE back = {b} AND line_no BETWEEN {lo} AND {hi}"
             for k, (b, lo, hi) in RANGES.items()]
    parts.append("SELECT '', conv_id, CAST(line_no AS BIGINT), role FROM c WHERE back = 0 AND turn < last_turn")
    return base + " UNION ALL ".join(parts)


@query("w9_history_slice", history_sql())
def w9(t: Tables):
    lines = t.conversations.select("conv_id", "turn", "role")
    return H.history(lines, "conv_id", "turn", [*RANGES, ""]).select("span", "conv_id", "line_no", "role")


@query("l2_active_order", "SELECT user_id, max(ts) AS last_active FROM events GROUP BY user_id")
def l2(t: Tables):
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_active")).orderBy(F.desc("last_active"), "user_id")


@query("l3_head_sample", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def l3(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(5)


@query("l5_evict_oldest", """
WITH s AS (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id)
SELECT user_id, created_at, row_number() OVER (ORDER BY user_id = 1 DESC, created_at DESC, user_id DESC) <= 4 AS live FROM s""")
def l5(t: Tables):
    """User 1 has the default session, which stays."""
    return R.live_after_eviction(t.events.groupBy("user_id").agg(F.min("ts").alias("created_at")), exempt=F.col("user_id") == 1)


@query("a11_session_rollup", "SELECT user_id, min(ts) AS created_at, max(ts) AS last_active, CAST(count(*) AS BIGINT) AS requests FROM events GROUP BY user_id")
def a11(t: Tables):
    return R.session_rollup(t.events)


@query("u4_upsert_last_write", f"""
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def u4(t: Tables):
    return R.latest_by_key(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], F.col("event_id"))


@query("u5_delete_key", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def u5(t: Tables):
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.drop_deleted(t.customer.select("c_custkey", "c_name"), gone, "c_custkey")


@query("u8_metadata_restore", """
SELECT event_id AS payload_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRUE AS restored FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, NULL, FALSE FROM events WHERE event_id % 7 = 0""")
def u8(t: Tables):
    good, bad = R.restore_metadata(broken_props(t), "payload")
    return good.select("payload_id", F.try_variant_get("metadata", "$.k", "bigint").alias("k"), F.lit(True).alias("restored")).unionByName(
        bad.select("payload_id", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("restored")))


@query("j5_restore_or_fresh", """
WITH s AS (SELECT o_custkey, concat('saved-', CAST(max(o_orderkey) AS VARCHAR)) AS state FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, coalesce(state, 'fresh') AS state FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def j5(t: Tables):
    s = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.concat(F.lit("saved-"), F.max("o_orderkey").cast("string")).alias("state"))
    return R.restored(t.customer.select("c_custkey"), s, "c_custkey")


@query("j6_live_semi", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def j6(t: Tables):
    live = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("user_id"))
    return t.events.select("event_id", "user_id").join(live, "user_id", "left_semi")


@query("t1_dirty_sets", f"""
SELECT strftime(time_bucket(INTERVAL 15 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS tick, user_id FROM {NUMBERED}
GROUP BY time_bucket(INTERVAL 15 SECOND, ts), user_id HAVING max(n) % 10 <> 0""")
def t1(t: Tables):
    d = R.dirty_sets(R.numbered_requests(t.events.select("event_id", "user_id", "ts")))
    return d.select(F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"), "user_id")
