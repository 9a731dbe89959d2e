"""Code files below a root: which count, and how to read them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import text as X
from tallyloom.sources import walk

# Folder names that are never entered (exact case).
SKIPPED_FOLDERS = [
    ".git", ".svn", ".hg", "node_modules", "venv", ".venv", "__pycache__", ".idea", ".vscode", ".eclipse",
    "build", "dist", "target", "out", ".gradle", ".maven", "logs", "tmp", "temp",
]


STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/+"


def below(path: Column, root: str) -> Column:
    """The part of ``path`` below ``root``. Either may name its store (``scheme://authority``) or not."""
    plain = re.sub(STORE, "/", root).rstrip("/")
    return F.substring(F.regexp_replace(path, STORE, "/"), len(plain) + 2, 1 << 30)


def entered(path: Column, root: str) -> Column:
    """True when no folder between root and file is a skipped one; the root's own name does not count."""
    parts = F.split(below(path, root), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))


def code_files(paths: DataFrame, root: str) -> DataFrame:
    """Adds ``language`` and keeps known suffixes outside skipped folders; works on any table with a ``path``."""
    kept = paths.where(entered(F.col("path"), root))
    return kept.withColumn("language", X.language_of(F.col("path"))).where("language <> 'unknown'")


def enters(folder: Column) -> Column:
    return ~folder.isin(SKIPPED_FOLDERS)


def is_code(name: Column) -> Column:
    return X.language_of(name) != "unknown"


def scan_code_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content) of the code files below root, listed and read in parallel. Skipped folders are not listed, and
    only files that count are opened. A root that does not exist is an error."""
    found = walk.contents(walk.walk(spark, root, enters, is_code))
    plain = found.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))
    return plain.select("path", X.language_of(F.col("path")).alias("language"), "content")


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, language, content as text) and the files that are no valid UTF-8."""
    text = F.col("content").cast("string")
    good = files.where(F.is_valid_utf8(text)).withColumn("content", text)
    bad = files.where(~F.is_valid_utf8(text)).select("path", F.lit("not UTF-8").alias("error"))
    return good, bad
