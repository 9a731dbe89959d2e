"""Classes and methods of source files.

For languages with braces a file is cut into declaration heads in one pass (``scanner``), which also finds where the block a
head opens ends and what is around it. What a head declares is then a matter of patterns over its text, and owners come from
windows partitioned by path: the text of files is never moved. A file is one value, so a path is a bounded group. Python files
go through the standard library's own parser in Arrow batches.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.operators import scanner
from tallyloom.session import stash

BRACE_LANGUAGES = ["java", "kotlin", "javascript", "typescript", "cpp", "rust"]
LINE_ENDED = ["kotlin", "javascript", "typescript"]  # a line end may end a declaration
COLUMNS = "path string, language string, kind string, name string, start_byte bigint, end_byte bigint, line_start bigint, line_end bigint, doc_comment string, is_extension boolean, node string"

OUTSIDE = {  # what stands before a declaration without being part of it
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?",
}
OUTSIDE_CLASS = r"^\s*(?:template\s*<[^{};]*>\s*)?(?:(?:typedef|static|extern|friend|inline)\s+)*(?=(?:class|struct)\b)"

HEADS = ("path string, language string, head int, text string, opening string, around string, level int, docs array<string>, start bigint, row bigint, "
         "end bigint, end_row bigint, stop string, stop_end bigint, stop_row bigint, close bigint, close_row bigint")


#: Heads of a batch that leaves a task.
TOGETHER = 5000


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}.get(kind, pa.list_(pa.string())))
                       for name, kind in (c.split() for c in HEADS.split(", "))])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    for files in batches:
        rows = []
        for path, language, content in zip(*(files.column(c).to_pylist() for c in ("path", "language", "content"))):
            rows += [(path, language, n, h.text, h.opening.decode("utf-8", "replace"), h.around, h.level, h.docs, h.first, h.first_row, h.end, h.end_row,
                      h.stop, h.stop_end, h.stop_row, h.close, h.close_row) for n, h in enumerate(scanner.heads((content or "").encode(), language))]
            if len(rows) >= TOGETHER:  # small files share a batch, heads of a large one are cut into several
                for at in range(0, len(rows), TOGETHER):
                    yield out(rows[at : at + TOGETHER])
                rows = []
        if rows:
            yield out(rows)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


NOT_NAMES = ["if", "for", "while", "switch", "catch", "with", "function", "return", "new", "throw", "else", "do", "sizeof", "typeof", "synchronized", "using", "super", "this"]


def _declared(language: str, text: Column, around: Column, stop: Column) -> tuple[Column, Column, Column]:
    """(class name, method name, method is beyond the reference set) of a head; empty text when it declares none."""

    def find(pattern: str, source: Column = text) -> Column:
        return F.regexp_extract(source, pattern, 1)

    none, no = F.lit(""), F.lit(False)
    balanced = F.length(F.regexp_replace(text, r"[^(]", "")) == F.length(F.regexp_replace(text, r"[^)]", ""))
    opens = stop == "{"
    if language == "java":
        bare = F.trim(F.regexp_replace(text, r"@(?!interface\b)[\w.]+(?:\s*\([^()]*\))?", ""))
        in_type = around.rlike(r"(?:^|\s)(?:class|interface|enum|record)\s|\bnew\s+[\w.<>,?\[\] ]+\([^{}]*\)\s*$|^[\s,]*[A-Z][A-Z0-9_]*\s*(?:\([^{}]*\))?\s*$")
        cls = F.when(opens, find(r"(?:^|\s)class\s+(\w+)", bare)).otherwise(none)
        typed = find(r"^(?!\s*,)[^=()]*[\s>\]]([A-Za-z_$][\w$]*)\s*\([^=]*\)\s*(?:\[\s*\]\s*)*(?:throws\s[^={}()]+)?$", bare)
        made = find(r"^(?:(?:public|private|protected)\s+|<[^()]*>\s*)*([A-Za-z_$][\w$]*)\s*\([^=]*\)\s*(?:throws\s[^={}()]+)?$", bare)
        owner = find(r"(?:^|\s)(?:class|enum|record)\s+(\w+)", around)
        name = F.when(opens & (made != "") & (made == owner), made).when((made == "") & (opens | (stop == ";")), typed).otherwise(none)
        return cls, F.when(in_type & balanced & (cls == "") & ~name.isin(NOT_NAMES), name).otherwise(none), no
    if language == "kotlin":
        cls = find(r"(?:^|\s)(?:class|interface|(?<!companion\s{1,64})object)\s+([A-Za-z_]\w*)")
        fun = find(r"(?:^|\s)fun\s+(?:<[^()]*?>\s*)?(?:[\w.<>?, ]+\.)?(\w+)\s*\(")
        return F.when(fun == "", cls).otherwise(none), fun, no
    if language == "rust":
        item = find(r"^(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:unsafe|auto)\s+)*(?:struct|enum|trait)\s+(\w+)")
        impl = find(r"^(?:unsafe\s+)?impl(?:\s*<[^{}]*?>)?\s+(\w+)\s+for\s")
        fn = F.when(opens, find(r"(?:^|\s)fn\s+(\w+)")).otherwise(none)
        return F.when(item != "", item).otherwise(F.when(opens, impl).otherwise(none)), fn, no
    if language == "cpp":
        bare = F.trim(F.regexp_replace(text, r"template\s*<[^<>]*(?:<[^<>]*>[^<>]*)*>", ""))
        body = F.when(~bare.rlike(r"(?:^|\s)enum\s|[()=]"), find(r"(?:^|\s)(?:class|struct)\s+(?:\w+\s+)*?(\w+)\s*(?:final\s*)?(?::[^:].*)?$", bare)).otherwise(none)
        cls = F.when(opens, body).when(stop == ";", find(r"^(?:class|struct)\s+(\w+)$", bare)).otherwise(none)
        word = r"(?:operator\s*(?:\(\s*\)|\[\s*\]|[-+*/%^&|~!=<>,]{1,3}|[A-Za-z_][\w:]*(?:\s*[*&])?)|~?[A-Za-z_]\w*)"
        fn = find(r"^[^=()]*[\s*&>]((?:\w+::)*" + word + r")\s*\([^{}]*\)\s*(?:(?:const|noexcept|override|final)\s*)*(?:->[^{}]*|:[^:{}][^{}]*)?$", bare)
        placed = around.isNull() | around.rlike(r"(?:^|\s)(?:namespace|extern|class|struct)(?:\s|$)")
        bad = bare.rlike(r"^(?:return|typedef|using|else|new|delete|throw|goto)\b") | fn.isin(NOT_NAMES)
        made = find(r"^(?:(?:explicit|inline|constexpr)\s+)*(\w+)\s*\([^{}]*\)\s*(?:noexcept\s*)?(?::[^:{}][^{}]*|=\s*(?:default|delete))?$", bare)
        makes = (made != "") & (made == find(r"(?:^|\s)(?:class|struct)\s+(?:\w+\s+)*?(\w+)\s*(?:final\s*)?(?::[^:].*)?$", F.coalesce(around, none)))
        name = F.when(makes, made).otherwise(fn)
        named = F.when(placed & balanced & (cls == "") & (opens | (stop == ";")) & (makes | ~bad), name).otherwise(none)
        beyond = named.contains("::") | (~makes & F.coalesce(around.rlike(r"(?:^|\s)(?:class|struct)\s"), no))
        return cls, F.substring_index(named, "::", -1), beyond
    bare = F.regexp_replace(text, r"^(?:@[\w.]+(?:\([^()]*\))?\s*)+", "")
    lead = r"^(?:export\s+)?(?:default\s+)?"
    fn = F.when(opens, find(lead + r"(?:async\s+)?function\s+([\w$]+)\s*[(<]", bare)).otherwise(none)
    if language == "javascript":
        cls = F.when(opens, find(lead + r"class\s+([\w$]+)", bare)).otherwise(none)
        method = F.when(opens & balanced, find(r"(?:^|,\s*)(?:(?:static|async|get|set)\s+)*(?:\*\s*)?([\w$]+)\s*\([^{}]*\)$", bare)).otherwise(none)
        return cls, F.when(fn != "", fn).when((cls == "") & ~method.isin(NOT_NAMES), method).otherwise(none), no
    cls = F.when(opens, find(lead + r"(?:declare\s+)?(?:class|interface)\s+([\w$]+)", bare)).otherwise(none)
    words = r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?:\*\s*)?"
    method = find(r"^" + words + r"([\w$]+)\??\s*(?:<[^()]*>\s*)?\([^{}]*\)\s*(?::[^{}]*)?$", bare)
    in_type = F.coalesce(around.rlike(r"(?:^|\s)(?:class|interface)\s"), no)
    ok = balanced & (opens | in_type) & (cls == "") & ~method.isin(NOT_NAMES)
    return cls, F.when(fn != "", fn).when(ok, method).otherwise(none), no


def brace_symbols(files: DataFrame) -> DataFrame:
    df = files.where(F.col("language").isin(BRACE_LANGUAGES)).select("path", "language", "content").mapInArrow(_scan, HEADS)
    names, methods, beyond = F, F, F
    for language in BRACE_LANGUAGES:
        is_it = F.col("language") == language
        c, m, x = _declared(language, F.col("text"), F.col("around"), F.col("stop"))
        names, methods, beyond = names.when(is_it, c), methods.when(is_it, m), beyond.when(is_it, x)
    # given out by a generator, so that the patterns are repeated neither for every use of a name nor for a condition
    declared = F.array(F.struct(names.alias("class_name"), methods.alias("method_name"), beyond.alias("is_extension")))
    df = df.select("*", F.inline(F.filter(declared, lambda d: (d["class_name"] != "") | (d["method_name"] != ""))))
    is_class = F.col("class_name") != ""
    makes = (F.col("method_name") == "constructor") | F.regexp_extract("around", r"(?:^|\s)(?:class|struct|enum|record)\s+(?:\w+\s+)*?(\w+)", 1).eqNullSafe(F.col("method_name"))
    inside = F.col("around").rlike(r"(?:^|\s)(?:class|interface|object|struct|enum|record|trait|impl)\s|\bnew\s")
    node = F.when(is_class, F.regexp_extract("text", r"(?:^|\s)(class|interface|object|struct|enum|trait|impl)\s", 1)).when(
        F.col("language").isin("java", "cpp", "javascript", "typescript") & makes, "constructor").when(inside, "method").otherwise("function")
    prefix = F.when(is_class & (F.col("language") == "cpp"), F.regexp_extract("opening", OUTSIDE_CLASS, 0))
    for language, pattern in OUTSIDE.items():
        prefix = prefix.when(F.col("language") == language, F.regexp_extract("opening", pattern, 0))
    df = df.withColumn("lead", F.coalesce(prefix, F.lit("")))
    with_mark = (F.col("stop") == ";") & ~F.col("language").isin(LINE_ENDED) & ~(is_class & (F.col("language") == "cpp"))
    end = F.when(F.col("stop") == "{", F.col("close")).when(with_mark, F.col("stop_end"))
    end_row = F.when(F.col("stop") == "{", F.col("close_row")).when(with_mark, F.col("stop_row"))
    wanted = F.filter("docs", lambda c: F.when(F.col("language").isin("java", "kotlin"), c.startswith("/*"))
                      .when(F.col("language") == "rust", c.startswith("//")).otherwise(True))
    return df.select(
        "path", "language", F.when(is_class, "class").otherwise("method").alias("kind"),
        F.when(is_class, F.col("class_name")).otherwise(F.col("method_name")).alias("name"),
        (F.col("start") + F.octet_length("lead")).alias("start_byte"),
        # a block that is never closed reaches to the end of its head
        F.coalesce(end, F.col("end")).alias("end_byte"),
        (F.col("row") + _newlines(F.col("lead"))).alias("line_start"), F.coalesce(end_row, F.col("end_row")).alias("line_end"),
        F.when(is_class, "").otherwise(F.array_join(wanted, "\n")).alias("doc_comment"), (~is_class & F.col("is_extension")).alias("is_extension"), node.alias("node"))


def _python_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["error"]
    for files in batches:
        rows = []
        for path, content in zip(files["path"], files["content"]):
            try:
                tree = ast.parse(content)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                rows.append((path, "python", None, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                continue
            starts = [0]
            for line in content.encode("utf-8").splitlines(keepends=True):
                starts.append(starts[-1] + len(line))
            methods = {id(f) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for f in c.body}
            for node in ast.walk(tree):
                if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                    is_class = isinstance(node, ast.ClassDef)
                    doc = "" if is_class else ast.get_docstring(node, clean=False) or ""
                    rows.append((path, "python", "class" if is_class else "method", node.name, starts[node.lineno - 1] + node.col_offset,
                                 starts[node.end_lineno - 1] + node.end_col_offset, node.lineno, node.end_lineno, doc.strip(), False,
                                 "class" if is_class else "method" if id(node) in methods else "function", None))
        out = pd.DataFrame(rows, columns=names)
        for c in ("start_byte", "end_byte", "line_start", "line_end"):
            out[c] = out[c].astype("Int64")
        yield out


def python_symbols(files: DataFrame) -> DataFrame:
    """Symbols of Python files, and one row with ``error`` for a file that does not parse."""
    chosen = files.where("language = 'python'").select("path", "content")
    return chosen.mapInPandas(_python_batch, COLUMNS + ", error string")


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, parse errors) of files (path, language, content text)."""
    python = python_symbols(files)
    errors = python.where("error IS NOT NULL").select("path", "error")
    found = brace_symbols(files).unionByName(python.where("error IS NULL").drop("error"))
    return found, errors


def with_source(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``source``, the symbol's own text. Filter symbols first: only files that still have any are read on.

    Both are merged by path and neither is broadcast: a plan estimates their size by the bytes of a scan, not by what texts and
    parsing make of them.
    """
    texts = files.select("path", F.encode("content", "UTF-8").alias("content"))
    cut = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    return symbols.join(texts.hint("merge"), "path").withColumn("source", cut.cast("string")).drop("content")


def with_owner(symbols: DataFrame) -> DataFrame:
    """Adds ``class_name``: for a method the outermost class that encloses it, for a class its own name.

    Spans nest, so along the start offsets the outermost classes follow one another: the latest one begun is the only one
    that can enclose a method. No pairs of methods and classes are formed.
    """
    # of a class and a method that start together the wider comes first
    up = W.partitionBy("path").orderBy("start_byte", F.desc("end_byte"), "kind").rowsBetween(W.unboundedPreceding, -1)
    is_class = F.col("kind") == "class"
    reach = F.max(F.when(is_class, F.col("end_byte"))).over(up)
    df = symbols.withColumn("_reach", reach)
    top = is_class & (F.col("_reach").isNull() | (F.col("start_byte") >= F.col("_reach")))
    df = df.withColumn("_top", F.last(F.when(top, F.struct("name", "end_byte")), ignorenulls=True).over(up))
    inside = F.col("_top.end_byte") >= F.col("end_byte")
    owner = F.when(is_class, F.col("name")).otherwise(F.coalesce(F.when(inside, F.col("_top.name")), F.lit("")))
    return df.withColumn("class_name", owner).drop("_reach", "_top")


def outermost_owners(symbols: DataFrame) -> DataFrame:
    """Methods inside classes with ``class_name``: of all classes around a method the first one. Gives what ``with_owner``
    gives; every method looks at all classes of its file, so it suits files of ordinary size."""
    span = F.struct(F.col("start_byte").alias("from"), (-F.col("end_byte")).alias("wide"), F.col("end_byte").alias("to"), "name")
    listed = F.collect_list(F.when(F.col("kind") == "class", span)).over(W.partitionBy("path"))
    around = F.filter("_classes", lambda c: (c["from"] <= F.col("start_byte")) & (c["to"] >= F.col("end_byte")))
    met = symbols.withColumn("_classes", listed).where("kind = 'method'").withColumn("class_name", F.array_min(around)["name"])
    return met.where("class_name IS NOT NULL").drop("_classes")


def class_members(symbols: DataFrame) -> DataFrame:
    """(path, class, its start, ordered method names): every class with all methods inside it, nested ones too.

    Methods in start order are numbered; a class covers one contiguous range of numbers.
    """
    edge = F.when(F.col("kind") == "class", F.array(
        F.struct(F.col("start_byte").alias("at"), F.lit(0).alias("side")), F.struct(F.col("end_byte").alias("at"), F.lit(2).alias("side")))
    ).otherwise(F.array(F.struct(F.col("start_byte").alias("at"), F.lit(1).alias("side"))))
    df = symbols.select("path", "kind", "name", "start_byte", "end_byte", F.explode(edge).alias("e"))
    seen = F.sum(F.when(F.col("kind") == "method", 1).otherwise(0)).over(
        W.partitionBy("path").orderBy("e.at", "e.side").rowsBetween(W.unboundedPreceding, W.currentRow))
    df = stash(df.withColumn("seen", seen), "members")  # read by both sides, so that files are parsed once
    methods = df.where("kind = 'method'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seen", "name"))).alias("all"))
    classes = df.where("kind = 'class'").groupBy("path", "name", "start_byte", "end_byte").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    part = F.slice(F.coalesce("all", F.array().cast("array<struct<seen:bigint,name:string>>")), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    return classes.join(methods.hint("merge"), "path", "left").select("path", F.col("name").alias("class_name"), "start_byte", F.transform(part, lambda x: x["name"]).alias("methods"))
