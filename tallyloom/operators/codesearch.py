"""Search, list and count over the symbols table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import text as X
from tallyloom.operators.symbols import with_source

# Fixed column order of search results.
RESULT = ["name", "implementation", "file_path", "line_start", "line_end", "doc_comment", "class_name", "result_type"]


def _result(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return with_source(symbols, files).select(
        "name", F.col("source").alias("implementation"), F.col("path").alias("file_path"), "line_start", "line_end",
        "doc_comment", "class_name", F.col("kind").alias("result_type"))


def in_languages(symbols: DataFrame, languages: list[str] | None) -> DataFrame:
    wanted = [x.strip().lower() for x in languages or X.SYMBOL_LANGUAGES]
    return symbols.where(F.lower("language").isin(wanted))


def naming(files: DataFrame, name: str) -> DataFrame:
    """Files whose text holds ``name``: the only ones that can declare it, so that a search parses no others."""
    return files.where(F.contains("content", F.lit(name)))


def find_methods(symbols: DataFrame, files: DataFrame, name: str, class_name: str = "", languages: list[str] | None = None) -> DataFrame:
    """Exact, case-sensitive name; an empty class name means any class."""
    found = in_languages(symbols, languages).where((F.col("kind") == "method") & (F.col("name") == name))
    return _result(found.where(F.col("class_name") == class_name) if class_name else found, files)


def find_classes(symbols: DataFrame, files: DataFrame, name: str, languages: list[str] | None = None) -> DataFrame:
    return _result(in_languages(symbols, languages).where((F.col("kind") == "class") & (F.col("name") == name)), files)


def list_methods(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'method'").select(F.col("name").alias("method_name"), "class_name", F.col("path").alias("file_path"))


def list_classes(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'class'").select(F.col("name").alias("class_name"), F.col("path").alias("file_path"))


def codebase_stats(files: DataFrame, root: str, languages: list[str] | None = None) -> DataFrame:
    """Files per language, all known languages included, with the languages symbols are taken from."""
    shown = F.array_join(F.array(*[F.lit(x) for x in languages or X.SYMBOL_LANGUAGES]), ", ")
    return files.groupBy("language").agg(F.count("*").alias("file_count")).select(
        "language", "file_count", F.lit(root).alias("codebase_path"), shown.alias("supported_languages"))


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Most frequent values first, nulls left out; ties in value order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top)


CHECKED = "cell_id bigint, valid boolean, error string, error_type string, line bigint, offset bigint, text string, filename string"


def _compile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CHECKED.split(", ")]
    for cells in batches:
        rows = []
        for cell, code in zip(cells["cell_id"], cells["code"]):
            try:
                compile(code, "<string>", "exec")
                rows.append((cell, True, None, None, None, None, None, None))
            except SyntaxError as e:
                rows.append((cell, False, str(e), "SyntaxError", e.lineno, e.offset, (e.text or "").strip(), e.filename or "<string>"))
            except Exception as e:
                rows.append((cell, False, str(e), type(e).__name__, None, None, None, None))
        out = pd.DataFrame(rows, columns=names)
        out["line"], out["offset"] = out["line"].astype("Int64"), out["offset"].astype("Int64")
        yield out


def check_syntax(cells: DataFrame) -> DataFrame:
    """(cell_id, code) -> validity, position and advice. Code is only compiled, never run."""
    return cells.select("cell_id", "code").mapInPandas(_compile, CHECKED).withColumn("advice", X.syntax_advice(F.col("error")))
