"""Build-job queries: artifact listings from part, job updates from events, logs from documents."""

from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import joblog as J
from tallyloom.operators.logindex import LogIndex
from tallyloom.plans.base import Tables, query

K = "CAST(p_partkey AS STRING)"
LISTING_COLUMNS = [
    "CAST(floor(p_partkey / 6) AS BIGINT) % 50 AS job_id", "p_partkey AS pos", "CAST(p_size * 1000 AS BIGINT) AS length",
    f"""concat('/work/j/', CASE p_partkey % 6 WHEN 0 THEN concat('app-', {K}, '.apk') WHEN 1 THEN concat('app-', {K}, '.aab')
    WHEN 2 THEN concat('m', {K}, '/mapping.txt') WHEN 3 THEN concat('m', CAST(p_partkey % 4 AS STRING), '/build/reports/tests/', {K}, '/index.html')
    WHEN 4 THEN 'readme.md' ELSE concat('app-', CAST(p_partkey - 5 AS STRING), '.apk') END) AS path""",
]
LISTING_SQL = f"""l AS (SELECT {", ".join(LISTING_COLUMNS)} FROM part),
  f AS (SELECT job_id, path, min(pos) AS pos, max(length) AS length FROM l GROUP BY job_id, path),
  a0 AS (SELECT job_id, pos, length, CASE WHEN ends_with(path, '.apk') THEN 'apk' WHEN ends_with(path, '.aab') THEN 'aab'
      WHEN ends_with(path, '/mapping.txt') THEN 'mapping' WHEN contains(path, '/build/reports/tests/') THEN 'test-report' END AS kind,
      CASE WHEN contains(path, '/build/reports/tests/') THEN concat(string_split(path, '/build/reports/tests/')[1], '/build/reports/tests') ELSE path END AS path FROM f),
  a AS (SELECT job_id, kind, path, min(pos) AS pos, CAST(sum(length) AS BIGINT) AS size FROM a0 WHERE kind IS NOT NULL GROUP BY ALL)"""


def listing(t: Tables):
    return t.part.selectExpr(*LISTING_COLUMNS)


@query("s3_artifact_scan", f"WITH {LISTING_SQL} SELECT job_id, kind, path, pos FROM a")
def s3(t: Tables):
    return J.artifacts(listing(t)).select("job_id", "kind", "path", "pos")


@query("a9_artifact_groups", f"WITH {LISTING_SQL} SELECT job_id, kind, path, CAST(row_number() OVER (PARTITION BY job_id, kind ORDER BY pos, path) AS BIGINT) AS n FROM a")
def a9(t: Tables):
    return J.artifact_order(J.artifacts(listing(t))).select("job_id", "kind", "path", "n")


A10_SQL = """k AS (SELECT DISTINCT job_id FROM l), ks AS (SELECT job_id, unnest(['apk', 'aab', 'mapping', 'test-report']) AS kind FROM k),
  top AS (SELECT job_id, kind, arg_min(path, pos) AS path, arg_min(size, pos) AS size FROM a GROUP BY job_id, kind)"""


@query("a10_artifact_size", f"""WITH {LISTING_SQL}, {A10_SQL}
SELECT job_id, kind, coalesce(path, '') AS path, coalesce(size, 0) AS size FROM ks LEFT JOIN top USING (job_id, kind)""")
def a10(t: Tables):
    l = listing(t)
    return J.first_artifacts(J.artifacts(l), l.select("job_id").distinct())


@query("l6_first_per_kind", f"WITH {LISTING_SQL} SELECT job_id, kind, arg_min(path, pos) AS path FROM a GROUP BY job_id, kind")
def l6(t: Tables):
    return J.artifacts(listing(t)).groupBy("job_id", "kind").agg(F.min_by("path", "pos").alias("path"))


@query("w10_first_seen", f"WITH {LISTING_SQL} SELECT job_id, path, min(pos) AS pos FROM l GROUP BY job_id, path")
def w10(t: Tables):
    return listing(t).groupBy("job_id", "path").agg(F.min("pos").alias("pos"))


ROOT_PATH = f"concat(CASE p_partkey % 4 WHEN 0 THEN '/work' WHEN 1 THEN '/workspace/' WHEN 2 THEN '/work/' ELSE '/tmp/work/' END, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {K} END)"


@query("p18_root_prefix", f"SELECT p_partkey, path FROM (SELECT p_partkey, {ROOT_PATH} AS path FROM part) WHERE path = '/work' OR starts_with(path, '/work/')")
def p18(t: Tables):
    p = t.part.select("p_partkey", F.expr(ROOT_PATH).alias("path"))
    return p.where((F.col("path") == "/work") | F.col("path").startswith("/work/"))


# Job updates: one field per event; every 9th value is no JSON.
FIELD = "CASE event_type WHEN 'purchase' THEN 'status' WHEN 'error' THEN 'code' WHEN 'signup' THEN 'startedAt' WHEN 'click' THEN 'lastOffset' ELSE 'finishedAt' END"
VALUE = """CASE WHEN event_id % 9 = 0 THEN concat('raw ', CAST(event_id AS STRING)) WHEN event_type = 'purchase' THEN concat('"st', CAST(event_id % 4 AS STRING), '"')
    ELSE CAST(event_id AS STRING) END"""
FIELDS = ["status", "code", "startedAt", "finishedAt", "lastOffset"]
UPDATES_SQL = f"u AS (SELECT user_id AS job_id, event_id AS seq, {FIELD} AS field, {VALUE} AS value FROM events), m AS (SELECT job_id, field, arg_max(value, seq) AS value FROM u GROUP BY job_id, field)"


def updates(t: Tables):
    return t.events.selectExpr("user_id AS job_id", "event_id AS seq", f"{FIELD} AS field", f"{VALUE} AS value")


@query("u6_field_merge", f"WITH {UPDATES_SQL} SELECT job_id, field, value FROM m")
def u6(t: Tables):
    return J.merge_fields(updates(t))


DECODED = "CASE WHEN starts_with(value, '\"') THEN replace(value, '\"', '') ELSE value END"


@query("u7_state_decode", f"""WITH {UPDATES_SQL}
SELECT job_id, field, {DECODED} AS decoded, CASE WHEN starts_with(value, '"') OR starts_with(value, 'raw') THEN 'STRING' ELSE 'BIGINT' END AS type FROM m""")
def u7(t: Tables):
    d = J.merge_fields(updates(t)).withColumn("v", J.decode_field(F.col("value")))
    return d.select("job_id", "field", F.try_variant_get("v", "$", "string").alias("decoded"), F.schema_of_variant("v").alias("type"))


@query("j3_status_precedence", f"""
WITH {UPDATES_SQL}, s AS (SELECT job_id, {', '.join(f"max(CASE WHEN field = '{f}' THEN {DECODED} END) AS {f}" for f in FIELDS)} FROM m GROUP BY job_id),
  o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders),
  q AS (SELECT o_custkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN 'queued' ELSE o_orderstatus END AS status, CAST(o_orderkey % 3 AS VARCHAR) AS code FROM o WHERE r = 1),
  r AS (SELECT c_custkey * 2 AS job_id FROM customer)
SELECT r.job_id, coalesce(s.status, q.status, 'not_found') AS status, CASE WHEN s.status IS NOT NULL THEN s.code ELSE q.code END AS code,
  CASE WHEN s.status IS NOT NULL THEN s.startedAt END AS startedAt, CASE WHEN s.status IS NOT NULL THEN s.finishedAt END AS finishedAt
FROM r LEFT JOIN s ON s.job_id = r.job_id LEFT JOIN q ON q.job_id = r.job_id""")
def j3(t: Tables):
    state = J.state_records(J.merge_fields(updates(t)), FIELDS)
    last = t.orders.groupBy(F.col("o_custkey").alias("job_id")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("o"))
    none = F.lit(None).cast("string")
    meta = last.select("job_id", F.when(F.col("o.o_orderkey") % 5 != 0, F.col("o.o_orderstatus")).alias("status"),
                       (F.col("o.o_orderkey") % 3).cast("string").alias("code"), none.alias("startedAt"), none.alias("finishedAt"))
    return J.job_status(t.customer.select((F.col("c_custkey") * 2).alias("job_id")), state, meta)


# Job steps: sign-ups start, purchases exit with a code, errors are exceptions, clicks of every 4th id cancel.
STEP = """CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'exit' WHEN 'error' THEN 'exception'
    WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'cancel' ELSE 'output' END ELSE 'output' END"""
CODE = "CASE WHEN event_type = 'purchase' THEN event_id % 3 WHEN event_type = 'error' AND event_id % 2 = 0 THEN 7 ELSE NULL END"
A12_SQL = f"""st AS (SELECT user_id AS job_id, event_id AS seq, epoch_us(ts) // 1000000 AS at_s, {STEP} AS step, CAST({CODE} AS BIGINT) AS code FROM events),
  st2 AS (SELECT *, CASE step WHEN 'start' THEN 'running' WHEN 'exit' THEN CASE WHEN code = 0 THEN 'completed' ELSE 'failed' END
      WHEN 'exception' THEN 'failed' WHEN 'cancel' THEN 'cancelled' END AS status,
      CASE step WHEN 'exit' THEN code WHEN 'exception' THEN coalesce(code, -1) END AS final_code FROM st),
  roll AS (SELECT job_id, CAST(min(at_s) FILTER (WHERE step = 'start') AS BIGINT) AS "startedAt", CAST(max(at_s) FILTER (WHERE step IN ('exit', 'exception')) AS BIGINT) AS "finishedAt",
      arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(final_code, seq) FILTER (WHERE final_code IS NOT NULL) AS code FROM st2 GROUP BY job_id)"""


def steps(t: Tables):
    return t.events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"),
                           F.expr(STEP).alias("step"), F.expr(CODE).cast("long").alias("code"))


@query("a12_status_rollup", f"WITH {A12_SQL} SELECT * FROM roll")
def a12(t: Tables):
    return J.status_rollup(steps(t))


@query("s4_log_page", """
WITH r AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000000 ELSE 0 END AS job_id, doc_id % 300 AS lo,
                  CASE WHEN doc_id % 7 = 0 THEN -5 ELSE 1000 END AS n FROM documents),
     d AS (SELECT r.*, text, greatest(n, 0) AS size FROM r LEFT JOIN documents ON doc_id = job_id),
     c AS (SELECT *, [k FOR k IN range(lo // 4, lo + 1) IF strlen(left(text, k)) >= lo][1] AS a,
                  [k FOR k IN range(lo // 4, lo + size + 1) IF strlen(left(text, k)) <= lo + size][-1] AS b FROM d)
SELECT job_id, CASE WHEN text IS NULL OR size = 0 OR strlen(text) <= lo THEN '' ELSE substr(text, a + 1, b - a) END AS text,
       CAST(lo + CASE WHEN text IS NULL THEN 0 ELSE greatest(least(strlen(text) - lo, size), 0) END AS BIGINT) AS "nextOffset" FROM c""")
def s4(t: Tables):
    d = F.col("doc_id")
    requests = t.documents.select((d + F.when(d % 10 == 0, 1_000_000_000).otherwise(0)).alias("job_id"), (d % 300).alias("from_byte"),
                                  F.when(d % 7 == 0, -5).otherwise(1000).alias("max_bytes"))
    chunks = J.cut_chunks(t.documents.select(d.alias("job_id"), "text"), size=4096)
    return LogIndex.build(chunks, page=8192).pages(requests)


LINES_SQL = """p AS (SELECT doc_id AS job_id, string_split(text, chr(10)) AS a FROM documents),
     ln AS (SELECT job_id, CAST(generate_subscripts(a[:-2], 1) AS BIGINT) AS line_no, unnest(a[:-2]) AS line FROM p)"""


@query("t4_line_assembly", f"WITH {LINES_SQL} SELECT job_id, line_no, line FROM ln")
def t4(t: Tables):
    return J.assemble_lines(J.cut_chunks(t.documents.select(F.col("doc_id").alias("job_id"), "text")))


@query("k9_output_lines", """
WITH o AS (SELECT doc_id, 'stdout' AS src, text AS s, 0 AS pos FROM documents UNION ALL
           SELECT doc_id, 'stderr', concat('warning: ', lang, chr(10), source), 1 FROM documents),
     p AS (SELECT doc_id, src, string_split_regex(s, concat(chr(13), chr(10), '|', chr(13), '|', chr(10))) AS a FROM o WHERE s <> ''),
     q AS (SELECT doc_id, src, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM p)
SELECT doc_id, src, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no, unnest(a) AS line FROM q""")
def k9(t: Tables):
    """Captured outputs -> line table: stdout lines, then stderr lines."""
    outputs = t.documents.select("doc_id", F.explode(F.array(
        F.struct(F.lit("stdout").alias("src"), F.col("text").alias("s")),
        F.struct(F.lit("stderr").alias("src"), F.concat(F.lit("warning: "), "lang", F.lit("\n"), "source").alias("s")))).alias("o"))
    lines = outputs.select("doc_id", "o.src", F.posexplode(X.lines(F.col("o.s"))).alias("p", "line"))
    return lines.select("doc_id", "src", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("k10_job_report", f"""
WITH {A12_SQL}, {LISTING_SQL}, {LINES_SQL}, an AS (SELECT job_id, count(*) AS n, sum(size) AS size FROM a GROUP BY job_id),
  lc AS (SELECT job_id, count(*) AS n FROM ln GROUP BY job_id), {UPDATES_SQL}, fm AS (SELECT job_id, count(*) AS n FROM m GROUP BY job_id)
SELECT roll.*, CAST(coalesce(an.n, 0) AS BIGINT) AS artifacts, CAST(coalesce(an.size, 0) AS BIGINT) AS artifact_bytes,
       CAST(coalesce(lc.n, 0) AS BIGINT) AS log_lines, CAST(coalesce(fm.n, 0) AS BIGINT) AS fields
FROM roll LEFT JOIN an USING (job_id) LEFT JOIN lc USING (job_id) LEFT JOIN fm USING (job_id)""")
def k10(t: Tables):
    found = J.artifacts(listing(t)).groupBy("job_id").agg(F.count("*").alias("artifacts"), F.sum("size").alias("artifact_bytes"))
    chunks = J.cut_chunks(t.documents.select(F.col("doc_id").alias("job_id"), "text"))
    ends = F.size(F.split(F.decode("bytes", "ISO-8859-1"), "\n", -1)) - 1  # complete lines are counted by their ends
    counts = chunks.groupBy("job_id").agg(F.sum(ends).alias("log_lines"))
    fields = J.merge_fields(updates(t)).groupBy("job_id").agg(F.count("*").alias("fields"))
    report = J.status_rollup(steps(t))
    for part in (found, counts, fields):
        report = report.join(part, "job_id", "left")
    return report.na.fill(0, ["artifacts", "artifact_bytes", "log_lines", "fields"])
