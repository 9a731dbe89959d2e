"""Running a stream to the end of its input, and keeping batch outputs exactly once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, GroupedData, SparkSession, functions as F

from tallyloom.session import work_folder

#: Buckets of keys, whatever the number of keys.
BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory goes to local disk with change logs in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def in_buckets(rows: DataFrame, key: str, buckets: int = BUCKETS) -> GroupedData:
    """Rows grouped by bucket of their key, so that a batch calls Python once a bucket and not once a key. Rows without a key
    have a bucket of their own."""
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))
    return rows.withColumn("bucket", bucket.cast("int")).withColumn(key, F.coalesce(key, F.lit(0)).cast("long")).groupBy("bucket")


def out_of_buckets(rows: DataFrame, key: str) -> DataFrame:
    """The way back from ``in_buckets``."""
    return rows.withColumn(key, F.when(F.col("bucket") >= 0, F.col(key))).drop("bucket")


def run_to_end(stream: DataFrame, mode: str, label: str, keep, folders: tuple[str, str] | None = None) -> str:
    """Runs a stream over all input there is. ``keep(batch)`` shapes each batch; its rows land in ``batch=<id>`` below the
    returned folder. A batch that is run again after a failure overwrites its own folder, so no row counts twice.
    Given the ``folders`` (output, checkpoint) of an earlier run, it goes on from where that run ended."""
    spark = stream.sparkSession
    out, state = folders or new_folders(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        keep(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_batches(stream, mode, write, state)
    return out


def run_batches(stream: DataFrame, mode: str, take, checkpoint: str) -> None:
    """``take(batch, number)`` for every batch until the input ends."""
    query = stream.writeStream.outputMode(mode).foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_folders(spark: SparkSession, label: str) -> tuple[str, str]:
    return work_folder(spark, label), work_folder(spark, f"{label}-checkpoint")


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", batch bigint").parquet(folder)


def pieces(df: DataFrame, by: str, bounds: list) -> Iterator[DataFrame]:
    """df cut at the bounds of a column, in order."""
    for low, high in zip([None, *bounds], [*bounds, None]):
        piece = df if low is None else df.where(F.col(by) >= F.lit(low))
        yield piece if high is None else piece.where(F.col(by) < F.lit(high))


def arriving(df: DataFrame, by: str, bounds: list, label: str) -> str:
    """Writes df as files, piece after piece. Returns the folder."""
    folder = work_folder(df.sparkSession, label)
    for piece in pieces(df, by, bounds):
        piece.write.mode("append").parquet(folder)
    return folder


def read_stream(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def run_arrivals(df: DataFrame, by: str, bounds: list, label: str, build, mode: str, keep) -> str:
    """Like run_to_end, but every piece is taken in before the next one arrives: for streams whose order of arrival counts."""
    spark = df.sparkSession
    folder, folders = work_folder(spark, f"{label}-input"), new_folders(spark, label)
    for piece in pieces(df, by, bounds):
        piece.write.mode("append").parquet(folder)
        out = run_to_end(build(read_stream(spark, folder, df.schema)), mode, label, keep, folders)
    return out
