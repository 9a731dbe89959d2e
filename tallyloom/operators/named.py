"""Named results: save, list, profile, snapshot, restore, and run a query under a name.

A workspace is a session of its own (``spark.newSession()``), so its views do not meet those of other workspaces.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import numbers as N, text as X
from tallyloom.session import stash

UNREADABLE = (PySparkException, Py4JJavaError)  # a damaged file surfaces as the JVM's own error
HIDDEN = {"In", "Out", "exit", "quit", "get_ipython"}  # fixed names that are never saved
SAVE_STATUS = "success boolean, message string, command string, saved_as string"


def save(df: DataFrame, name: str, command: str = "") -> DataFrame:
    """Result under a name, replacing what had it; gives back the status row."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.createDataFrame([(True, f"saved as {name}", command, name)], SAVE_STATUS)


def save_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row: name, type, rows, columns, and size in MB of the rows as JSON text (an estimate)."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    row = df.agg(F.count("*").alias("rows"), N.megabytes(F.coalesce(size, F.lit(0)).cast("double")).alias("memory_mb"))
    return row.select(F.lit(name).alias("name"), F.lit("spark").alias("type"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "memory_mb")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Profiles of all named tables but private ones, sorted by name."""
    rows = [profile(df, name) for name, df in tables.items() if not name.startswith("_")]
    if not rows:
        return SparkSession.active().createDataFrame([], "name string, type string, rows bigint, columns bigint, memory_mb double")
    return reduce(lambda a, b: a.unionByName(b), rows).orderBy("name")


def result_summary(df: DataFrame, order: list[str], sample: int = 5) -> DataFrame:
    """Row count, column names and the first rows as JSON; an error text when there is nothing."""
    head = N.json_records(df.orderBy(*order).limit(sample), order)
    shown = head.agg(F.array_sort(F.collect_list(F.struct(*order, "record"))).alias("s"))  # ``sample`` rows
    shown = shown.select(F.transform("s", lambda r: r["record"]).alias("sample"))
    count = df.agg(F.count("*").alias("rows"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return count.crossJoin(shown).select(  # one row each
        "rows", names.alias("columns"), "sample", F.when(F.col("rows") == 0, "result is empty").alias("error"))


def worth_saving(name: str) -> bool:
    return not name.startswith("_") and name not in HIDDEN


def content_name(df: DataFrame) -> str:
    """A name for what a table holds: its schema, its number of rows and two sums of row hashes, so that the order of rows does
    not count. Rows are hashed as JSON with nulls written out and times in microseconds."""
    times = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    text = F.to_json(F.struct(*df.columns), times) if df.columns else F.lit("")
    sums = [F.coalesce(F.sum(F.xxhash64(text, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (0, 1)]
    n, first, second = df.agg(F.count("*"), *sums).first()
    return hashlib.sha256(f"{df.schema.json()} {n} {first} {second}".encode()).hexdigest()[:32]


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _readable(spark: SparkSession, path: str) -> bool:
    """Whether the footers of all files can be read."""
    try:
        return spark.read.parquet(path).count() >= 0
    except UNREADABLE:
        return False


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the whole snapshots below the folder, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    return sorted(int(f[2:]) for f in found if f.startswith("v=") and _complete(spark, f"{folder}/_manifest/{f}"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Adds a version: every named result worth saving, then the list of names, which makes the version whole.

    Files are kept by ``content_name``: what an earlier version holds already is referenced, not written again, and no file of
    another version is touched, so a table restored from the folder can be saved there. Files that cannot be read are written
    anew. One writer at a time."""
    kept = sorted(n for n in tables if worth_saving(n))
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    listed = []
    for name in kept:
        path = f"{folder}/data/{content_name(tables[name])}"
        if not _complete(spark, path) or not _readable(spark, path):
            tables[name].write.mode("overwrite").parquet(path)
        listed.append((name, path))
    number = max(versions(spark, folder), default=0) + 1
    spark.createDataFrame(listed, "name string, path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_manifest/v={number}")
    return kept


def restore(spark: SparkSession, folder: str, version: int | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, names that could not be read) of the newest whole version that can be read, or of ``version``. Without one the
    workspace starts fresh."""
    for number in reversed(versions(spark, folder)) if version is None else [version]:
        try:
            manifest = spark.read.parquet(f"{folder}/_manifest/v={number}").select("name", "path").collect()  # one row per named table
            break
        except UNREADABLE:
            continue
    else:
        return {}, []
    tables, lost = {}, []
    for row in manifest:
        try:
            df = spark.read.parquet(row.path)
            df.createOrReplaceTempView(row.name)
            tables[row.name] = df
        except UNREADABLE:
            lost.append(row.name)
    return tables, lost


def run_sql(spark: SparkSession, sql: str, save_as: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(status row, cleaned JSON records) of a query. The result is written before the status is made, so that a query that
    fails while it runs reports success = false too. Records are whole, whatever their length."""
    status = "success boolean, saved_as string, error_type string, error string"
    try:
        df = stash(spark.sql(sql), "result")
        if save_as:
            df.createOrReplaceTempView(save_as)
        records = N.json_records(df).select("record")
        return spark.createDataFrame([(True, save_as, None, None)], status), records
    except UNREADABLE as e:
        text = str(e)
        error = text[: X.TRACEBACK_LIMIT]
        return spark.createDataFrame([(False, None, type(e).__name__, error)], status), spark.createDataFrame([], "record string")
