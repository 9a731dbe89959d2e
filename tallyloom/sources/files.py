"""Plain file sources and sinks."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV with a header row. Types are inferred only when no schema is given, since inference reads the data twice."""
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, content): one row per ``<job>/build.log``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "build.log").load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), "content")


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of every file below folder; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length")


def log_chunks(spark: SparkSession, folder: str, schema: str = "job_id bigint, chunk_no bigint, bytes binary") -> DataFrame:
    """Append-only stream of chunk files."""
    return spark.readStream.schema(schema).parquet(folder)


def from_local(spark: SparkSession, data) -> DataFrame:
    """Small local table (pandas, Arrow, list of dicts) -> DataFrame; anything else is refused."""
    if isinstance(data, pa.Table):
        return spark.createDataFrame(data)
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data)
    if isinstance(data, list) and data and all(isinstance(x, dict) for x in data):
        return spark.createDataFrame(pa.Table.from_pylist(data))
    raise ValueError(f"Cannot convert {type(data)} to a DataFrame")
