"""Text, classification and predicate queries over documents, events, part and pages."""

from pyspark.sql import functions as F

from tallyloom.functions import numbers as N, text as X
from tallyloom.plans.base import Tables, query

# Derived text cases: expressions that both engines read alike.
ERROR_TEXT = """CASE event_id % 5
    WHEN 0 THEN concat('Traceback (most recent call last):', chr(10), '  File "a.py", line ', CAST(user_id AS STRING), chr(10), 'ValueError: bad ', event_type, ': ', CAST(event_id AS STRING))
    WHEN 1 THEN concat('KeyboardInterrupt', CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '' END)
    WHEN 2 THEN concat('  ', chr(10), '  ')
    WHEN 3 THEN concat('KeyError : ', event_type, '   ')
    ELSE concat('x', chr(10), 'TypeError:') END"""
MESSAGE = """CASE event_id % 7 WHEN 0 THEN 'Unexpected EOF while parsing' WHEN 1 THEN 'EOL while scanning string literal'
    WHEN 2 THEN 'invalid syntax' WHEN 3 THEN 'unexpected indentation' WHEN 4 THEN 'unmatched )'
    WHEN 5 THEN concat('invalid syntax after unmatched ', event_type) ELSE event_type END"""
STATUS = """CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 429 WHEN 4 THEN 500
    WHEN 5 THEN 503 WHEN 6 THEN 301 ELSE 200 END"""
RETRY = "CASE event_id % 8 WHEN 2 THEN CAST(user_id AS STRING) ELSE NULL END"
SPEC = """CASE p_partkey % 5
    WHEN 0 THEN concat(replace(p_name, ' ', '-'), '==1.', CAST(p_size AS STRING))
    WHEN 1 THEN concat('lib', CAST(p_partkey AS STRING), '>=1  other<2 third')
    WHEN 2 THEN concat('git+https://h/u/r', CAST(p_partkey AS STRING), '.git@main')
    WHEN 3 THEN concat('git+https://h/u/r', CAST(p_partkey AS STRING))
    ELSE concat('a<=', CAST(p_size AS STRING), ' b>3 c@4') END"""
RAW_NAME = """CASE p_partkey % 6
    WHEN 0 THEN concat(replace(p_name, ' ', '_'), '.', CAST(p_partkey AS STRING))
    WHEN 1 THEN upper(replace(p_name, ' ', '-._'))
    WHEN 2 THEN p_name WHEN 3 THEN concat('-', replace(p_name, ' ', ''))
    WHEN 4 THEN '  ' ELSE concat('P', CAST(p_partkey AS STRING), '..x') END"""
COMMAND = """CASE event_id % 7 WHEN 0 THEN concat('tool --HELP ', event_type) WHEN 1 THEN 'git-hub x'
    WHEN 2 THEN concat('a', chr(10), 'b') WHEN 3 THEN 'cat <<E' WHEN 4 THEN 'x=$(ls)' WHEN 5 THEN event_type
    ELSE concat('ls ', CAST(user_id AS STRING)) END"""
VAR_NAME = """CASE event_id % 9 WHEN 0 THEN 'In' WHEN 1 THEN concat('_x', CAST(user_id AS STRING)) WHEN 2 THEN '_i3'
    WHEN 3 THEN '_' WHEN 4 THEN '__' WHEN 5 THEN '_ih' WHEN 6 THEN concat('df_', CAST(user_id AS STRING))
    WHEN 7 THEN event_type ELSE 'get_ipython' END"""
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


@query("f4_truncate_output", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(left(text, 500), chr(10), '... (output truncated)') ELSE text END AS shown,
       CAST(length(text) AS BIGINT) AS n FROM documents""")
def f4(t: Tables):
    d = t.documents
    return d.select("doc_id", X.truncate_marked(d.text, 500).alias("shown"), F.length("text").cast("long").alias("n"))


@query("f5_preview", """
SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(left(text, 500), '...') ELSE coalesce(text, '') END AS preview FROM documents""")
def f5(t: Tables):
    d = t.documents
    return d.select("doc_id", X.preview(d.text).alias("preview"))


@query("f6_traceback_limit", "SELECT doc_id, left(text, 8192) AS head, CAST(length(left(text, 8192)) AS BIGINT) AS n FROM documents")
def f6(t: Tables):
    h = X.head_chars(F.col("text"))
    return t.documents.select("doc_id", h.alias("head"), F.length(h).cast("long").alias("n"))


@query("f7_right_trim", f"""
SELECT page_id, nullif(rtrim(concat(html, CASE WHEN page_id % 2 = 0 THEN {WS} ELSE '' END), {WS}), '') AS out,
       nullif(rtrim({WS}, {WS}), '') AS blank FROM pages""")
def f7(t: Tables):
    tail = F.when(F.col("page_id") % 2 == 0, X.WHITESPACE).otherwise("")
    return t.pages.select("page_id", X.output_or_null(F.concat("html", tail)).alias("out"),
                          X.output_or_null(F.lit(X.WHITESPACE)).alias("blank"))


@query("f8_text_lines", """
WITH p AS (SELECT doc_id, string_split_regex(text, concat(chr(13), chr(10), '|', chr(13), '|', chr(10))) AS a FROM documents WHERE text <> ''),
     q AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM p)
SELECT doc_id, CAST(generate_subscripts(a, 1) AS BIGINT) AS line_no, unnest(a) AS line FROM q""")
def f8(t: Tables):
    d = t.documents.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return d.select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


@query("f9_text_measures", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, left(text, 20) AS head,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count FROM documents""")
def f9(t: Tables):
    return t.documents.select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.substring("text", 1, 20).alias("head"),
        F.size(F.split("text", "\n")).cast("long").alias("line_count"))


@query("f10_last_exception", f"""
WITH e AS (SELECT event_id, trim({ERROR_TEXT}, {WS}) AS s FROM events),
     l AS (SELECT event_id, s, string_split(s, chr(10))[-1] AS last FROM e)
SELECT event_id, s <> '' AS has_exception,
       CASE WHEN s = '' THEN NULL ELSE trim(string_split(last, ':')[1], {WS}) END AS exception_type,
       CASE WHEN s = '' THEN NULL WHEN strpos(last, ':') = 0 THEN ''
            ELSE trim(substr(last, strpos(last, ':') + 1), {WS}) END AS exception_message FROM l""")
def f10(t: Tables):
    s = F.col("s")
    return t.events.select("event_id", F.expr(ERROR_TEXT).alias("s")).select(
        "event_id", (X.trim(s) != "").alias("has_exception"), X.exception_type(s).alias("exception_type"),
        X.exception_message(s).alias("exception_message"))


@query("f11_docstring_summary", f"""
SELECT doc_id, string_split(text, chr(10))[1] AS summary, trim(text, {WS}) <> '' AS has_docstring FROM documents""")
def f11(t: Tables):
    d = t.documents
    return d.select("doc_id", X.first_line(d.text).alias("summary"), (X.trim(d.text) != "").alias("has_docstring"))


@query("f12_requirement_names", f"""
WITH s AS (SELECT p_partkey, unnest(string_split_regex({SPEC}, '[ ]+')) AS w FROM part),
     b AS (SELECT p_partkey, string_split(string_split(string_split(string_split(string_split(string_split(
             w, '==')[1], '>=')[1], '<=')[1], '>')[1], '<')[1], '@')[1] AS b FROM s WHERE w <> ''),
     n AS (SELECT p_partkey, CASE WHEN NOT starts_with(b, 'git+') THEN b
             WHEN contains(b, '.git') THEN replace(string_split(b, '/')[-1], '.git', '') END AS name FROM b)
SELECT p_partkey, name FROM n WHERE name IS NOT NULL""")
def f12(t: Tables):
    return t.part.select("p_partkey", F.explode(X.requirement_names(F.expr(SPEC))).alias("name"))


@query("f13_package_name", rf"""
WITH n AS (SELECT p_partkey, {RAW_NAME} AS raw FROM part)
SELECT p_partkey, raw, regexp_matches(raw, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$') AS valid,
       CASE WHEN regexp_matches(raw, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$')
            THEN regexp_replace(lower(raw), '[-_.]+', '-', 'g') END AS name,
       CASE WHEN NOT regexp_matches(raw, '^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$')
            THEN concat('Invalid package name: ''', raw, '''') END AS error FROM n""")
def f13(t: Tables):
    raw = F.col("raw")
    return t.part.select("p_partkey", F.expr(RAW_NAME).alias("raw")).select(
        "p_partkey", "raw", X.package_name_valid(raw).alias("valid"), X.normal_package_name(raw).alias("name"),
        F.when(~X.package_name_valid(raw), F.format_string("Invalid package name: '%s'", raw)).alias("error"))


@query("f14_name_from_url", "SELECT page_id, string_split(url, '/')[-2] AS name FROM pages")
def f14(t: Tables):
    return t.pages.select("page_id", X.name_from_url(F.col("url")).alias("name"))


@query("f15_http_outcome", f"""
WITH s AS (SELECT event_id, {STATUS} AS status, {RETRY} AS retry FROM events)
SELECT event_id, CASE WHEN status = 200 THEN 'ok' WHEN status = 404 THEN 'not found' WHEN status = 429 THEN 'rate limit'
       WHEN status >= 500 THEN 'server error' ELSE 'unexpected' END AS outcome,
       CASE WHEN status = 429 THEN CAST(retry AS BIGINT) END AS retry_after FROM s""")
def f15(t: Tables):
    s = t.events.select("event_id", F.expr(STATUS).alias("status"), F.expr(RETRY).alias("retry"))
    return s.select("event_id", X.http_outcome(s.status).alias("outcome"), X.retry_seconds(s.status, s.retry).alias("retry_after"))


@query("f16_syntax_advice", f"""
WITH m AS (SELECT event_id, lower({MESSAGE}) AS m FROM events)
SELECT event_id, CASE WHEN contains(m, 'unexpected eof') OR contains(m, 'eol while scanning') THEN 'Check for unclosed quotes, parentheses, or brackets'
    WHEN contains(m, 'invalid syntax') THEN 'Check for typos in keywords or operators'
    WHEN contains(m, 'indentation') THEN 'Check indentation consistency (spaces vs tabs)'
    WHEN contains(m, 'unmatched') THEN 'Check for unmatched parentheses or brackets' END AS advice FROM m""")
def f16(t: Tables):
    return t.events.select("event_id", X.syntax_advice(F.expr(MESSAGE)).alias("advice"))


@query("f17_tool_names", """
SELECT p_partkey, concat('external_', lower(p_type), '_', replace(p_name, ' ', '_')) AS full_name,
       concat('external_', lower(p_type), '_', replace(p_name, ' ', '_'), '_result') AS save_as,
       concat(lower(p_type), '_', replace(p_name, ' ', '_')) AS listed_name FROM part""")
def f17(t: Tables):
    server, tool = F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("_"))
    full = X.tool_name(server, tool)
    return t.part.select("p_partkey", full.alias("full_name"), F.concat(full, F.lit("_result")).alias("save_as"),
                         F.concat_ws("_", server, tool).alias("listed_name"))


@query("f19_clamp", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(least(greatest(l_linenumber - 2, 0), 2) AS BIGINT) AS level,
       CAST(greatest(l_linenumber - 3, 0) AS BIGINT) AS limited FROM lineitem""")
def f19(t: Tables):
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                             N.clamp(n - 2, 0, 2).cast("long").alias("level"), N.floor_at(n - 3).cast("long").alias("limited"))


@query("f20_megabytes", "SELECT doc_id, round(n_chars * 1000 / 1048576.0, 2) AS mb FROM documents")
def f20(t: Tables):
    return t.documents.select("doc_id", N.megabytes(F.col("n_chars") * 1000).alias("mb"))


@query("f22_time_text", """
SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0')) AS iso,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds FROM events""")
def f22(t: Tables):
    return t.events.select("event_id", N.iso_text(F.col("ts")).alias("iso"),
                           F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


@query("f23_freshness", """
SELECT o_orderkey, event_id, epoch_us(ts) - epoch_us(o_orderdate + INTERVAL 28 YEAR) < 300000000 AS fresh
FROM events JOIN orders ON o_orderkey = event_id""")
def f23(t: Tables):
    e, o = t.events, t.orders
    fetched = F.expr("o_orderdate + INTERVAL '28' YEAR")
    return e.join(o, e.event_id == o.o_orderkey).select("o_orderkey", "event_id", N.is_fresh(fetched, F.col("ts")).alias("fresh"))


@query("f24_json_get", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing,
       json_keys(props)[1] AS first_key, CAST(len(json_keys(props)) AS BIGINT) AS n_keys FROM events""")
def f24(t: Tables):
    v = F.try_parse_json("props")
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"),
                           F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("none")).alias("missing"),
                           F.try_element_at(keys, F.lit(1)).alias("first_key"), F.size(keys).cast("long").alias("n_keys"))


# Whole texts with a stray byte in front, one within and a cut character at the end: decoding drops just these.
@query("f25_decode_ignore", "SELECT doc_id, text AS part FROM documents")
def f25(t: Tables):
    utf8 = lambda c: F.encode(c, "UTF-8")
    broken = F.concat(F.lit(b"\xff"), utf8(F.substring("text", 1, 50)), F.lit(b"\x80"), utf8(F.substring("text", 51, 1 << 30)), F.lit(b"\xe2\x82"))
    return t.documents.select("doc_id", X.decode_utf8_ignore(broken).alias("part"))


@query("f26_repository_name", """
SELECT page_id, replace(string_split(concat(rtrim(url, '/'), '.git'), '/')[-1], '.git', '') AS repo FROM pages""")
def f26(t: Tables):
    return t.pages.select("page_id", X.repository_name(F.concat(F.rtrim("url", F.lit("/")), F.lit(".git"))).alias("repo"))


@query("f27_defaults", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 'none' ELSE l_linestatus END AS status,
       CASE WHEN l_linenumber % 3 = 0 THEN 'empty' ELSE l_returnflag END AS flags FROM lineitem""")
def f27(t: Tables):
    status = F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).otherwise("")
    flags = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("l_returnflag"))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.default_text(status, "none").alias("status"),
                             F.array_join(X.default_array(flags, F.array(F.lit("empty"))), ",").alias("flags"))


@query("p8_contains", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'wid.et|bolt')")
def p8(t: Tables):
    return t.part.where(F.col("p_name").rlike("wid.et|bolt")).select("p_partkey", "p_name")


@query("p9_ends_with", "SELECT p_partkey, p_type FROM part WHERE ends_with(p_type, 'Y')")
def p9(t: Tables):
    return t.part.where(F.col("p_type").endswith("Y")).select("p_partkey", "p_type")


@query("p10_line_prefix", """
SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE starts_with(line, 'The')""")
def p10(t: Tables):
    lines = t.documents.select("doc_id", F.explode(X.lines(F.col("text"))).alias("line"))
    return lines.where(F.col("line").startswith("The"))


@query("p11_positional_row", "SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey) LIMIT 1 OFFSET 100")
def p11(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(1)


@query("p12_glob", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^.*w.dget$') AND NOT starts_with(p_name, '_')")
def p12(t: Tables):
    return t.part.where(X.glob_match(F.col("p_name"), "*W?dget")).select("p_partkey", "p_name")


@query("p13_visible_names", f"""
SELECT DISTINCT n AS name FROM (SELECT {VAR_NAME} AS n FROM events)
WHERE n NOT IN ('In','Out','exit','quit','get_ipython','_ih','_oh','_dh','_sh','_ip')
  AND NOT (starts_with(n, '_') AND n NOT IN ('_','__','___') AND NOT starts_with(n, '_i'))""")
def p13(t: Tables):
    names = t.events.select(F.expr(VAR_NAME).alias("name"))
    return names.where(X.user_name_visible(F.col("name"))).distinct().orderBy("name")


@query("p14_help_predicate", f"""
SELECT event_id, c AS command FROM (SELECT event_id, {COMMAND} AS c FROM events)
WHERE contains(lower(c), '--help') OR contains(lower(c), '-h') OR contains(lower(c), 'help')""")
def p14(t: Tables):
    c = t.events.select("event_id", F.expr(COMMAND).alias("command"))
    return c.where(X.asks_for_help(c.command))


@query("p15_multiline_predicate", f"""
SELECT event_id, c AS command FROM (SELECT event_id, {COMMAND} AS c FROM events)
WHERE contains(c, chr(10)) OR contains(c, '<<') OR contains(c, '$(')""")
def p15(t: Tables):
    c = t.events.select("event_id", F.expr(COMMAND).alias("command"))
    return c.where(X.spans_lines(c.command))


REQUEST_LANGUAGE = """CASE o_orderkey % 5 WHEN 0 THEN ' Java ' WHEN 1 THEN 'rust' WHEN 2 THEN 'KOTLIN'
    WHEN 3 THEN CASE WHEN o_custkey % 3 = 0 THEN 'cobol' ELSE 'cpp' END ELSE CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'python' END END"""


@query("p17_language_request", f"""
WITH r AS (SELECT o_custkey AS request_id, lower(trim({REQUEST_LANGUAGE})) AS l FROM orders),
     g AS (SELECT request_id, l, l IN ('java','kotlin','python','typescript','javascript','cpp','rust') AS ok FROM r)
SELECT request_id, coalesce(string_agg(DISTINCT l, ',' ORDER BY l) FILTER (WHERE ok), '') AS valid,
       coalesce(string_agg(DISTINCT l, ',' ORDER BY l) FILTER (WHERE NOT ok), '') AS invalid,
       bool_and(ok) AS accepted FROM g GROUP BY request_id""")
def p17(t: Tables):
    r = t.orders.select(F.col("o_custkey").alias("request_id"), F.lower(F.trim(F.expr(REQUEST_LANGUAGE))).alias("l"))
    ok = F.col("l").isin(X.SYMBOL_LANGUAGES)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # at most one entry per distinct language asked for
    return r.groupBy("request_id").agg(joined(F.when(ok, F.col("l"))).alias("valid"),
                                       joined(F.when(~ok, F.col("l"))).alias("invalid"), F.bool_and(ok).alias("accepted"))


@query("u1_distinct_sorted", f"SELECT DISTINCT {VAR_NAME} AS name FROM events")
def u1(t: Tables):
    return t.events.select(F.expr(VAR_NAME).alias("name")).distinct().orderBy("name")
