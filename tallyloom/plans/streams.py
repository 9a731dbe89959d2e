"""Streaming queries: tables arrive as files, the stream runs to the end, and what it wrote is the result."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyloom.operators import joblog as J, registry as R
from tallyloom.plans.base import ORACLES, Tables, query
from tallyloom.plans.jobs import updates
from tallyloom.plans.sessions import NUMBERED
from tallyloom.session import work_folder
from tallyloom.streaming import common as S, joblog as SJ, lateness as L, sessions as SS

# Arrival in four parts of the month the events cover.
DAYS = [datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22)]


def event_stream(t: Tables, *columns: str):
    events = t.events.select(*columns)
    folder = S.arriving(events, "ts", DAYS, "events")
    return S.read_stream(t.spark, folder, events.schema, files=2)


#: Seconds that rows may come late, and which events come one part too late.
DELAY, STRAGGLERS = 60, "event_id % 40 = 0"
PART = "CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1 WHEN ts < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END"
ARRIVAL = f"least({PART} + CASE WHEN {STRAGGLERS} THEN 1 ELSE 0 END, 3)"


def gated_sql(window: int) -> str:
    """The rows of events with arrival, whether they are late, and the watermark in the end."""
    ended = f"time_bucket(INTERVAL {window} SECOND, ts) + INTERVAL {window} SECOND"
    return f"""a AS (SELECT *, {ARRIVAL} AS arrival FROM events),
  marks AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {DELAY} SECOND AS mark FROM a GROUP BY arrival),
  g AS (SELECT a.*, coalesce({ended} <= mark, FALSE) AS late, {ended} <= (SELECT max(ts) FROM a) - INTERVAL {DELAY} SECOND AS closed FROM a JOIN marks USING (arrival))"""


def gated(t: Tables, label: str, columns: list[str], build, window: int):
    arrivals = t.events.selectExpr(*columns, f"{ARRIVAL} AS arrival")
    return L.run_gated(arrivals, "arrival", [1, 2, 3], label, build, DELAY, window)


@query("t1_dirty_sets_stream", f"""WITH {gated_sql(15)},
  n AS (SELECT user_id, time_bucket(INTERVAL 15 SECOND, ts) AS tick, closed, count(*) AS requests FROM g WHERE NOT late GROUP BY ALL),
  r AS (SELECT *, sum(requests) OVER (PARTITION BY user_id ORDER BY tick) AS n FROM n)
SELECT strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick, user_id FROM r WHERE closed AND n % 10 <> 0""")
def t1(t: Tables):
    out, _ = gated(t, "ticks", ["event_id", "user_id", "ts"], SS.dirty_stream, R.TICK_SECONDS)
    rows = S.written(t.spark, out, "tick timestamp, user_id bigint, n bigint")
    return rows.select(F.date_format("tick", "yyyy-MM-dd HH:mm:ss").alias("tick"), "user_id")


@query("t1_late_rows", f"WITH {gated_sql(15)} SELECT CAST(arrival AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(ts) AS first FROM g WHERE late GROUP BY arrival")
def t1_late(t: Tables):
    """What came behind the watermark, by batch."""
    _, gate = gated(t, "late", ["event_id", "user_id", "ts"], None, R.TICK_SECONDS)
    rows = gate.late_rows(t.events.select("event_id", "user_id", "ts").schema)
    return rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("t2_request_counter", f"SELECT user_id, CAST(n AS BIGINT) AS n FROM {NUMBERED} WHERE n % 10 = 0")
def t2(t: Tables):
    out = S.run_to_end(SS.request_checkpoints(event_stream(t, "event_id", "user_id", "ts")), "append", "counter", lambda b: b)
    return S.written(t.spark, out, "user_id bigint, n bigint").select("user_id", "n")


@query("t3_registry_stream", ORACLES["u4_upsert_last_write"])
def t3(t: Tables):
    table = SS.registry_table(t.spark, work_folder(t.spark, "registry"))
    SS.registry_stream(event_stream(t, "user_id", "event_id", "event_type", "value", "ts"), table, work_folder(t.spark, "registry-checkpoint"))
    return table.read()


@query("u4_state_table", ORACLES["u4_upsert_last_write"])
def u4_table(t: Tables):
    """Batches out of order, with a batch that arrives twice and rows older than those in the table."""
    table = SS.registry_table(t.spark, work_folder(t.spark, "registry"))
    rows = t.events.select(*table.schema.names)
    for number, part in enumerate((3, 1, 0, 2, 4, 1)):
        batch = rows.where(F.col("event_id") % 5 == part)
        table.apply(batch, number, "upserts")
        table.apply(batch, number, "upserts")
    return table.read()


@query("t4_line_stream", ORACLES["t4_line_assembly"])
def t4(t: Tables):
    """Chunks come in three parts, half an hour after each other."""
    chunks = J.cut_chunks(t.documents.select(F.col("doc_id").alias("job_id"), "text"), size=4096)
    part = F.when(F.col("chunk_no") < 1, 0).when(F.col("chunk_no") < 3, 1).otherwise(2)
    chunks = chunks.withColumn("at", F.timestamp_seconds(F.unix_seconds(F.lit(DAYS[0]).cast("timestamp")) + part * 1800))
    folder = S.arriving(chunks, "chunk_no", [1, 3], "chunks")
    out = S.run_to_end(SJ.line_stream(S.read_stream(t.spark, folder, chunks.schema, files=4)), "append", "lines", lambda b: b)
    return S.written(t.spark, out, SJ.LINES).drop("batch", "gap")


@query("t5_state_stream", ORACLES["u6_field_merge"])
def t5(t: Tables):
    u = updates(t)
    folder = S.arriving(u.withColumn("ts", F.col("seq")), "ts", [3000, 6000], "updates")
    stream = S.read_stream(t.spark, folder, u.withColumn("ts", F.col("seq")).schema, files=2)
    table = SJ.state_table(t.spark, work_folder(t.spark, "state"))
    SJ.state_stream(stream, table, work_folder(t.spark, "state-checkpoint"))
    return table.read().drop("seq")


@query("t6_ttl_stream", f"""WITH RECURSIVE {gated_sql(60)},
  d AS (SELECT DISTINCT user_id, epoch_us(ts) AS us, closed FROM g WHERE NOT late),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS rn FROM d),
  r AS (SELECT user_id, rn, us, closed, us AS last, FALSE AS hit FROM e WHERE rn = 1
        UNION ALL
        SELECT e.user_id, e.rn, e.us, e.closed, CASE WHEN e.us - r.last >= 21600000000 THEN e.us ELSE r.last END, e.us - r.last < 21600000000
        FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, CAST(us AS BIGINT) AS position, hit FROM r WHERE closed""")
def t6(t: Tables):
    out, _ = gated(t, "cache", ["user_id", "ts"], lambda stream: SS.cache_stream(stream, seconds=21600), SS.WINDOW)
    return S.written(t.spark, out, "user_id bigint, position bigint, hit boolean").drop("batch")


@query("s5_log_stream_source", """
SELECT doc_id AS job_id, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) AS chunks, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def s5(t: Tables):
    chunks = J.cut_chunks(t.documents.select(F.col("doc_id").alias("job_id"), "text"), size=4096)
    folder = S.arriving(chunks, "chunk_no", [2], "log")
    stream = S.read_stream(t.spark, folder, chunks.schema, files=4).select("job_id", F.octet_length("bytes").alias("size"))
    out = S.run_to_end(stream, "append", "log-sizes", lambda b: b.groupBy("job_id").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    rows = S.written(t.spark, out, "job_id bigint, n bigint, size bigint")
    return rows.groupBy("job_id").agg(F.sum("n").alias("chunks"), F.sum("size").alias("bytes"))
