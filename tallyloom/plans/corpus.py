"""Code corpus queries. One source file per row of part; what each file declares is known from how it is built."""

from pyspark.sql import functions as F

from tallyloom.functions import helpers, text as X
from tallyloom.operators import codesearch as C, symbols as S
from tallyloom.plans.base import Tables, query
from tallyloom.session import dealt, stash, work_folder
from tallyloom.sources import codefiles as CF, walk

ROOT = "/repo"
K, SZ, NL, G = "CAST(p_partkey AS STRING)", "CAST(p_size AS STRING)", "chr(10)", "p_partkey % 8"
PATH = f"""concat('/repo/', CASE WHEN p_partkey % 11 = 0 THEN 'node_modules/' WHEN p_partkey % 13 = 0 THEN 'build/' ELSE 'src/' END, 'P', {K},
  CASE {G} WHEN 0 THEN '.java' WHEN 1 THEN '.kt' WHEN 2 THEN '.PY' WHEN 3 THEN '.js' WHEN 4 THEN '.ts' WHEN 5 THEN '.cpp' WHEN 6 THEN '.rs'
    ELSE CASE WHEN p_partkey % 3 = 0 THEN '.go' ELSE '.txt' END END)"""
#: One source per value of p_partkey % 8, with <k> for the key and <s> for the size of the part, and what it declares:
#: (node, name, classes around it from the outermost on, doc comment, source).
SOURCES: dict[int, tuple[str, list[tuple[str, str, str, str, str]]]] = {
    0: ("""class C<k> {
  /* doc <s> */
  int m<s>() { return 1; }
  C<k>(int a) { run(new Task() { public void n<s>() { } }); }
  // no doc
  /* first */
  /* second <s> */
  @Tags(value = { @Tag(ref = {1, <s>}) })
  int m<s>(@In({"a", "}"}) int a) { return a; }
  static class D<k> { void low() { } }
}
""", [("class", "C<k>", "", "", ""), ("method", "m<s>", "C<k>", "/* doc <s> */", "int m<s>() { return 1; }"),
      ("constructor", "C<k>", "C<k>", "", "C<k>(int a) { run(new Task() { public void n<s>() { } }); }"), ("method", "n<s>", "C<k>", "", "public void n<s>() { }"),
      ("method", "m<s>", "C<k>", "/* first */|/* second <s> */", """@Tags(value = { @Tag(ref = {1, <s>}) })
  int m<s>(@In({"a", "}"}) int a) { return a; }"""),
      ("class", "D<k>", "C<k>", "", "static class D<k> { void low() { } }"), ("method", "low", "C<k>,D<k>", "", "void low() { }")]),
    1: ("""class C<k> {
  /* doc <s> */
  fun m<s>(): Int { return 1 }
  /* a /* nested fun no() { } */ <s> */
  fun m<s>(f: () -> Unit = { }) = run("${ if (a) "{" else "}" }")
  object D<k> { fun low() = 1 }
}
fun free<k>() { }
""", [("class", "C<k>", "", "", ""), ("method", "m<s>", "C<k>", "/* doc <s> */", "fun m<s>(): Int { return 1 }"),
      ("method", "m<s>", "C<k>", "/* a /* nested fun no() { } */ <s> */", """fun m<s>(f: () -> Unit = { }) = run("${ if (a) "{" else "}" }")"""),
      ("object", "D<k>", "C<k>", "", "object D<k> { fun low() = 1 }"), ("method", "low", "C<k>,D<k>", "", "fun low() = 1"), ("function", "free<k>", "", "", "fun free<k>() { }")]),
    2: ("""class C<k>:
    def m<s>(self):
        return 1
    class D<k>:
        def low(self):
            return {<s>: (1, 2)}
def free<k>(): pass
""", [("class", "C<k>", "", "", ""), ("method", "m<s>", "C<k>", "", """def m<s>(self):
        return 1"""), ("class", "D<k>", "C<k>", "", """class D<k>:
        def low(self):
            return {<s>: (1, 2)}"""), ("method", "low", "C<k>,D<k>", "", """def low(self):
            return {<s>: (1, 2)}"""), ("function", "free<k>", "", "", "def free<k>(): pass")]),
    3: ("""class C<k> {
  // doc <s>
  m<s>() { return 1; }
  // one
  /* two */
  m<s>({ a, b: { c } }, d = {}) { return `x ${ `${ { n: <s> } }` + "}" } {`; }
}
function free<k>() { return 6 / <s> / 2 }
""", [("class", "C<k>", "", "", ""), ("method", "m<s>", "C<k>", "// doc <s>", "m<s>() { return 1; }"),
      ("method", "m<s>", "C<k>", "// one|/* two */", """m<s>({ a, b: { c } }, d = {}) { return `x ${ `${ { n: <s> } }` + "}" } {`; }"""),
      ("function", "free<k>", "", "", "function free<k>() { return 6 / <s> / 2 }")]),
    4: ("""class C<k> {
  // doc <s>
  m<s>(): number { return 1; }
  constructor(o: { a: number; b: { c: <s> } }) { }
  give(): { a: number } { return { a: <s> }; }
}
interface D<k> { low(o: { p: number }): { q: string }; }
""", [("class", "C<k>", "", "", ""), ("method", "m<s>", "C<k>", "// doc <s>", "m<s>(): number { return 1; }"),
      ("constructor", "constructor", "C<k>", "", "constructor(o: { a: number; b: { c: <s> } }) { }"),
      ("method", "give", "C<k>", "", "give(): { a: number } { return { a: <s> }; }"), ("interface", "D<k>", "", "", "interface D<k> { low(o: { p: number }): { q: string }; }"),
      ("method", "low", "D<k>", "", "low(o: { p: number }): { q: string }")]),
    5: ("""class C<k> {};
int m<s>() { return 1; }
struct D<k> { D<k>() : a{1}, b{{<s>}} { } struct E<k> { int e; }; };
template <typename T> T m<s>(T a, Opt b = {}) { return a; }
""", [("class", "C<k>", "", "", "class C<k> {}"), ("function", "m<s>", "", "", "int m<s>() { return 1; }"),
      ("struct", "D<k>", "", "", "struct D<k> { D<k>() : a{1}, b{{<s>}} { } struct E<k> { int e; }; }"), ("constructor", "D<k>", "D<k>", "", "D<k>() : a{1}, b{{<s>}} { }"),
      ("struct", "E<k>", "D<k>", "", "struct E<k> { int e; }"), ("function", "m<s>", "", "", "template <typename T> T m<s>(T a, Opt b = {}) { return a; }")]),
    6: ("""struct C<k>;
fn m<s>() -> i32 { 1 }
/* a /* b */ fn hidden() { } */
impl T<k> for C<k> {
    /// one
    // two <s>
    fn low(&self) { let s = r#"}"#; }
}
enum D<k> { A, B }
""", [("struct", "C<k>", "", "", "struct C<k>;"), ("function", "m<s>", "", "", "fn m<s>() -> i32 { 1 }"), ("impl", "T<k>", "", "", """impl T<k> for C<k> {
    /// one
    // two <s>
    fn low(&self) { let s = r#"}"#; }
}"""), ("method", "low", "T<k>", "/// one|// two <s>", """fn low(&self) { let s = r#"}"#; }"""), ("enum", "D<k>", "", "", "enum D<k> { A, B }")]),
    7: ("not code <k>\n", []),
}


def text_sql(text: str, k: str = "k", s: str = "s") -> str:
    """SQL for a text with its places filled, the same in both engines."""
    lines = f", {NL}, ".join(f"'{line}'" for line in text.split("\n"))
    return f"replace(replace(concat({lines}), '<k>', {k}), '<s>', {s})"


CONTENT = f"CASE {G} " + " ".join(f"WHEN {g} THEN {text_sql(text, K, SZ)}" for g, (text, _) in SOURCES.items()) + " END"


def expected_rows() -> str:
    """A row per declaration of each source. A class without a source of its own spans its block from the first line on."""
    rows = []
    for g, (text, declared) in SOURCES.items():
        for place, (node, name, around, doc, source) in enumerate(declared):
            source = source or text[: {2: text.find("\ndef free")}.get(g, text.find("\n}\n") + 2)]
            line = text[: text.index(source)].count("\n") + 1
            kind = "method" if node in ("method", "constructor", "function") else "class"
            owner = name if kind == "class" else around.split(",")[0]
            fields = [str(g), str(place), f"'{kind}'", f"'{node}'", text_sql(name, "'<k>'", "'<s>'"), f"'{owner}'", f"'{around}'", text_sql(doc.replace("|", "\n"), "'<k>'", "'<s>'"),
                      text_sql(source, "'<k>'", "'<s>'"), str(line), str(line + source.count("\n"))]
            rows.append("(" + ", ".join(fields) + ")")
    return ",\n    ".join(rows)


LANGUAGE = f"""CASE {G} WHEN 0 THEN 'java' WHEN 1 THEN 'kotlin' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' WHEN 4 THEN 'typescript'
  WHEN 5 THEN 'cpp' WHEN 6 THEN 'rust' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'go' ELSE 'unknown' END END"""
KEPT = f"p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND NOT ({G} = 7 AND p_partkey % 3 <> 0)"
fill = lambda c: f"replace(replace({c}, '<k>', k), '<s>', s)"
CTE = f"""f AS (SELECT p_partkey AS pk, {G} AS g, {K} AS k, {SZ} AS s, {PATH} AS path, {CONTENT} AS content, {LANGUAGE} AS language FROM part WHERE {KEPT}),
  e(g, place, kind, node, name, owner, around, doc, source, line_start, line_end) AS (VALUES {expected_rows()}),
  y AS (SELECT path, language, {fill("name")} AS name, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, {fill("doc")} AS doc_comment,
      {fill("owner")} AS class_name, kind, {fill("source")} AS source, node, {fill("around")} AS around, place FROM f JOIN e USING (g)),
  c AS (SELECT * FROM y WHERE kind = 'class'), m AS (SELECT * FROM y WHERE kind = 'method')"""


def files(t: Tables):
    """The corpus. Parts are dealt into tasks before their paths and texts are made, so that all tasks choose and parse files.
    Paths are given out by a generator: a condition on them would otherwise move to the few tasks that read the table."""
    parts = dealt(t.part.select("p_partkey", "p_size"), "p_partkey")
    paths = parts.select("*", F.inline(F.array(F.struct(F.expr(PATH).alias("path")))))
    return CF.code_files(paths, ROOT).select("path", "language", F.expr(CONTENT).alias("content"))


def symbols(t: Tables):
    return S.with_owner(S.extract(files(t))[0])


def declaring(t: Tables, name: str):
    """Symbols of the files that hold ``name``, and these files."""
    found = C.naming(files(t), name)
    return S.with_owner(S.extract(found)[0]), found


def all_paths(t: Tables):
    return t.part.select(F.expr(PATH).alias("path"))


@query("s2_code_file_scan", f"WITH {CTE} SELECT path, language, md5(content) AS digest FROM f")
def s2(t: Tables):
    """All files of the corpus are written; the scan goes into the folders that count and opens the files that count."""
    root = work_folder(t.spark, "code")
    parts = dealt(t.part.select("p_partkey", "p_size"), "p_partkey")
    walk.write_files(parts.select(F.expr(PATH).alias("path"), F.encode(F.expr(CONTENT), "UTF-8").alias("content")), root)
    found = CF.scan_code_files(t.spark, f"{root}{ROOT}")
    return found.select(F.concat(F.lit(f"{ROOT}/"), CF.below(F.col("path"), f"{root}{ROOT}")).alias("path"), "language", F.md5("content").alias("digest"))


@query("p5_path_prune", f"SELECT path FROM (SELECT {PATH} AS path FROM part) WHERE NOT contains(path, '/node_modules/') AND NOT contains(path, '/build/')")
def p5(t: Tables):
    return all_paths(t).where(CF.entered(F.col("path"), ROOT))


@query("f1_suffix", f"SELECT path, concat('.', lower(string_split(path, '.')[-1])) AS suffix FROM (SELECT {PATH} AS path FROM part)")
def f1(t: Tables):
    return all_paths(t).select("path", X.suffix(F.col("path")).alias("suffix"))


@query("f2_language", f"SELECT {PATH} AS path, {LANGUAGE} AS language FROM part")
def f2(t: Tables):
    return all_paths(t).select("path", X.language_of(F.col("path")).alias("language"))


@query("f3_parser_language", f"SELECT path, CASE WHEN language NOT IN ('go', 'unknown') THEN language END AS parser FROM (SELECT {PATH} AS path, {LANGUAGE} AS language FROM part)")
def f3(t: Tables):
    return all_paths(t).select("path", X.parser_language(X.language_of(F.col("path"))).alias("parser"))


@query("f18_join_list", f"WITH {CTE} SELECT language, string_agg(DISTINCT string_split(path, '/')[3], ', ' ORDER BY string_split(path, '/')[3]) AS folders FROM f GROUP BY language")
def f18(t: Tables):
    folder = F.get(F.split("path", "/"), F.lit(2))  # a handful of folder names, so the set stays small
    return files(t).groupBy("language").agg(F.array_join(F.array_sort(F.collect_set(folder)), ", ").alias("folders"))


@query("p1_exact_name", f"WITH {CTE} SELECT path, name, line_start FROM y WHERE name = 'm24'")
def p1(t: Tables):
    return declaring(t, "m24")[0].where(F.col("name") == "m24").select("path", "name", "line_start")


@query("p2_optional_filter", f"""WITH {CTE}, w AS (SELECT concat('m', p_size) AS name FROM part WHERE p_partkey = 17)
SELECT 'any' AS form, path, class_name FROM m SEMI JOIN w USING (name) UNION ALL SELECT 'one', path, class_name FROM m SEMI JOIN w USING (name) WHERE class_name = 'C17'""")
def p2(t: Tables):
    """The method of class C17: in any class, and in that class only."""
    name = f"m{t.part.where('p_partkey = 17').first().p_size}"
    pick = lambda df, form: df.select(F.lit(form).alias("form"), F.col("file_path").alias("path"), "class_name")
    found = declaring(t, name)
    return pick(C.find_methods(*found, name), "any").unionByName(pick(C.find_methods(*found, name, "C17"), "one"))


@query("p3_ci_membership", f"WITH {CTE} SELECT path, upper(language) AS shouted FROM f WHERE language IN ('java', 'rust')")
def p3(t: Tables):
    return files(t).select("path", F.upper("language").alias("shouted")).where(F.lower("shouted").isin("java", "rust"))


@query("p4_language_filter", f"WITH {CTE} SELECT path FROM f WHERE language = 'kotlin'")
def p4(t: Tables):
    return files(t).where("language = 'kotlin'").select("path")


@query("p6_column_subset", f"WITH {CTE} SELECT name, path FROM y")
def p6(t: Tables):
    return symbols(t).select("name", "path")


@query("p7_equality_mask", f"WITH {CTE} SELECT name, path FROM y WHERE kind = 'class' AND language = 'rust'")
def p7(t: Tables):
    """Only files of the language are parsed."""
    return S.extract(C.in_languages(files(t), ["Rust"]))[0].where("kind = 'class'").select("name", "path")


@query("a1_count_by_language", f"WITH {CTE} SELECT language, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY language")
def a1(t: Tables):
    return CF.code_files(all_paths(t), ROOT).groupBy("language").agg(F.count("*").alias("n"))


@query("a2_codebase_stats", f"""WITH {CTE} SELECT language, CAST(count(*) AS BIGINT) AS file_count, '/repo' AS codebase_path,
  'java, kotlin, python, typescript, javascript, cpp, rust' AS supported_languages FROM f GROUP BY language""")
def a2(t: Tables):
    return C.codebase_stats(CF.code_files(all_paths(t), ROOT), ROOT)


@query("a3_value_counts", f"WITH {CTE} SELECT name, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY name ORDER BY n DESC, name LIMIT 20")
def a3(t: Tables):
    return C.value_counts(symbols(t).where("kind = 'method'"), "name")


@query("a4_group_count", f"WITH {CTE} SELECT language, CAST(count(nullif(class_name, '')) AS BIGINT) AS with_class, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY language")
def a4(t: Tables):
    s = symbols(t).where("kind = 'method'")
    return s.groupBy("language").agg(F.count(F.nullif("class_name", F.lit(""))).alias("with_class"), F.count("*").alias("n"))


@query("a5_unique", f"WITH {CTE} SELECT DISTINCT name FROM m")
def a5(t: Tables):
    return symbols(t).where("kind = 'method'").select("name").distinct()


@query("a13_symbol_type_split", f"""WITH {CTE} SELECT language, CAST(count(*) FILTER (WHERE kind = 'method') AS BIGINT) AS methods,
  CAST(count(*) FILTER (WHERE kind = 'class') AS BIGINT) AS classes, CAST(0 AS BIGINT) AS other, CAST(count(*) AS BIGINT) AS total FROM y GROUP BY language""")
def a13(t: Tables):
    is_m, is_c = F.col("kind") == "method", F.col("kind") == "class"
    return symbols(t).groupBy("language").agg(F.count_if(is_m).alias("methods"), F.count_if(is_c).alias("classes"),
                                              F.count_if(~is_m & ~is_c).alias("other"), F.count("*").alias("total"))


@query("j1_containment_join", f"WITH {CTE} SELECT path, name, class_name FROM m")
def j1(t: Tables):
    return symbols(t).where("kind = 'method'").select("path", "name", "class_name")


@query("j2_class_members", f"""WITH {CTE} SELECT c.path, c.name AS class_name, coalesce(string_agg(m.name, ',' ORDER BY m.place), '') AS methods
FROM c LEFT JOIN m ON m.path = c.path AND list_contains(string_split(m.around, ','), c.name) GROUP BY c.path, c.name""")
def j2(t: Tables):
    return S.class_members(S.extract(files(t))[0]).select("path", "class_name", F.array_join("methods", ",").alias("methods"))


@query("w1_outermost_first", f"WITH {CTE} SELECT path, name, class_name FROM m WHERE class_name <> ''")
def w1(t: Tables):
    """The other plan for owners: all classes around a method, the first one kept."""
    return S.outermost_owners(S.extract(files(t))[0]).select("path", "name", "class_name")


@query("w2_preceding_comments", f"WITH {CTE} SELECT path, name, doc_comment FROM m WHERE doc_comment <> ''")
def w2(t: Tables):
    return symbols(t).where("kind = 'method' AND doc_comment <> ''").select("path", "name", "doc_comment")


@query("u2_union_symbols", f"WITH {CTE} SELECT kind, node, language, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY kind, node, language")
def u2(t: Tables):
    return S.extract(files(t))[0].groupBy("kind", "node", "language").agg(F.count("*").alias("n"))


@query("u3_union_files", f"WITH {CTE} SELECT 'code' AS origin, path FROM f UNION ALL SELECT 'page', url FROM pages")
def u3(t: Tables):
    code = files(t).select(F.lit("code").alias("origin"), "path")
    return code.unionByName(t.pages.select(F.lit("page").alias("origin"), F.col("url").alias("path")))


@query("k1_extract_symbols", f"WITH {CTE} SELECT path, language, kind, name, line_start, line_end, doc_comment, class_name, source FROM y")
def k1(t: Tables):
    s = S.with_source(symbols(t), files(t))
    return s.select("path", "language", "kind", "name", "line_start", "line_end", "doc_comment", "class_name", "source")


SEARCH = "name, source AS implementation, path AS file_path, line_start, line_end, doc_comment, class_name, kind AS result_type"


@query("k2_find_method", f"WITH {CTE} SELECT {SEARCH} FROM m WHERE name = 'm10'")
def k2(t: Tables):
    return C.find_methods(*declaring(t, "m10"), "m10")


@query("k3_find_class", f"WITH {CTE} SELECT {SEARCH} FROM c WHERE name = 'C17'")
def k3(t: Tables):
    return C.find_classes(*declaring(t, "C17"), "C17")


@query("k4_list_methods", f"WITH {CTE} SELECT name AS method_name, class_name, path AS file_path FROM m")
def k4(t: Tables):
    return C.list_methods(symbols(t))


@query("k5_list_classes", f"WITH {CTE} SELECT name AS class_name, path AS file_path FROM c")
def k5(t: Tables):
    return C.list_classes(symbols(t))


CELL = f"""CASE p_partkey % 5 WHEN 0 THEN concat('x = ', {K}) WHEN 1 THEN concat('def f', {K}, '(:', chr(10))
  WHEN 2 THEN concat('a = 1', chr(10), 'b = = ', {SZ}) WHEN 3 THEN concat('if x:', chr(10), '    y', chr(10), '  z = ', {SZ}) ELSE concat('f(', {SZ}, '))') END"""


@query("k8_syntax_check", """
SELECT p_partkey AS cell_id, p_partkey % 5 = 0 AS valid, CASE WHEN p_partkey % 5 <> 0 THEN 'SyntaxError' END AS error_type,
  CAST(CASE p_partkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 1 END AS BIGINT) AS line,
  CASE p_partkey % 5 WHEN 1 THEN 'Check for typos in keywords or operators' WHEN 2 THEN 'Check for typos in keywords or operators'
    WHEN 3 THEN 'Check indentation consistency (spaces vs tabs)' WHEN 4 THEN 'Check for unmatched parentheses or brackets' END AS advice FROM part""")
def k8(t: Tables):
    cells = t.part.select(F.col("p_partkey").alias("cell_id"), F.expr(CELL).alias("code"))
    return C.check_syntax(cells).select("cell_id", "valid", "error_type", "line", "advice")


@query("x1_table_functions", f"""WITH {CTE}
SELECT 'of' AS call, p_partkey, {SEARCH} FROM part JOIN m ON m.name = concat('m', p_size) AND m.class_name = concat('C', p_partkey)
UNION ALL SELECT 'class', p_partkey, {SEARCH} FROM part JOIN c ON c.name = concat('D', p_partkey)
UNION ALL SELECT 'any', 0, {SEARCH} FROM m WHERE name = 'm10'
UNION ALL SELECT 'methods', 0, name, NULL, path, NULL, NULL, NULL, class_name, NULL FROM m
UNION ALL SELECT 'classes', 0, NULL, NULL, path, NULL, NULL, NULL, name, NULL FROM c
UNION ALL SELECT 'stats', CAST(count(*) AS BIGINT), language, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f GROUP BY language""")
def x1_table_functions(t: Tables):
    """Every table function over a stored index: for each part its method and its inner class by LATERAL, one name, all lists."""
    stored = stash(files(t), "files")
    helpers.register_code(stash(S.with_owner(S.extract(stored)[0]), "symbols"), stored)
    t.part.createOrReplaceTempView("tl_parts")
    none = "CAST(NULL AS STRING)"
    return t.spark.sql(f"""
        SELECT 'of' AS call, p_partkey, r.* FROM tl_parts, LATERAL tl_find_methods_of(concat('m', p_size), concat('C', p_partkey)) r
        UNION ALL SELECT 'class', p_partkey, r.* FROM tl_parts, LATERAL tl_find_classes(concat('D', p_partkey)) r
        UNION ALL SELECT 'any', 0, * FROM tl_find_methods('m10')
        UNION ALL SELECT 'methods', 0, method_name, {none}, file_path, NULL, NULL, {none}, class_name, {none} FROM tl_methods()
        UNION ALL SELECT 'classes', 0, {none}, {none}, file_path, NULL, NULL, {none}, class_name, {none} FROM tl_classes()
        UNION ALL SELECT 'stats', file_count, language, {none}, {none}, NULL, NULL, {none}, {none}, {none} FROM tl_code_stats()""")
