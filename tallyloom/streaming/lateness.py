"""Late rows apart: what comes behind the watermark goes to a side folder and is counted, instead of being dropped unseen."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import IntegerType

from tallyloom.functions import numbers as N
from tallyloom.session import work_folder
from tallyloom.streaming.common import new_folders, pieces, read_stream, run_batches, run_to_end
from tallyloom.streaming.statetable import Folder


class Gate:
    """Splits the batches of a stream into rows in time and late rows, each below its own folder of ``path``.

    The watermark of a batch is the greatest time seen in earlier batches, less ``delay`` seconds. A row is late when its
    window of ``window`` seconds ended at or before the watermark, which is when a windowed aggregate would drop it; rows
    without a time are late. A batch that runs again finds the same watermark and overwrites what it wrote before.
    """

    def __init__(self, spark: SparkSession, path: str, delay: int, window: int, time: str = "ts"):
        self.spark, self.path, self.delay, self.window, self.time = spark, path, delay, window, time
        self.marks = Folder(spark, f"{path}/marks")

    def watermark(self, number: int) -> int | None:
        """Microseconds; None before anything was seen."""
        earlier = sorted(n for n in self.marks.names() if n.startswith("b") and int(n[1:]) < number)
        seen = json.loads(self.marks.read(earlier[-1])) if earlier else None
        return None if seen is None else seen - self.delay * 1_000_000

    def late(self, watermark: int | None) -> Column:
        at, size = N.epoch_micros(F.col(self.time).cast("timestamp")), self.window * 1_000_000
        ended = at - F.pmod(at, F.lit(size)) + size
        return at.isNull() | (F.lit(False) if watermark is None else ended <= watermark)

    def take(self, batch: DataFrame, number: int) -> None:
        watermark, seen = self.watermark(number), Observation()
        late = F.coalesce(self.late(watermark), F.lit(True))
        watched = batch.observe(seen, F.max(N.epoch_micros(F.col(self.time).cast("timestamp"))).alias("last"), F.count_if(late).alias("late"))
        watched.where(~late).write.mode("overwrite").parquet(f"{self.path}/in-time/batch={number}")
        counts = seen.get
        if counts["late"]:
            batch.where(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
        before = None if watermark is None else watermark + self.delay * 1_000_000
        name = f"b{number:012d}"
        if name not in self.marks.names():
            self.marks.put(name, json.dumps(max((x for x in (before, counts["last"]) if x is not None), default=None)))

    def late_rows(self, schema) -> DataFrame:
        """Late rows with the number of their ``batch``."""
        if "late" not in Folder(self.spark, self.path).names():
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("int"))
        kept = self.spark.createDataFrame([], schema).schema
        return self.spark.read.schema(kept.add("batch", IntegerType())).parquet(f"{self.path}/late")


def run_gated(arrivals: DataFrame, by: str, bounds: list, label: str, build, delay: int, window: int) -> tuple[str, Gate]:
    """Lets ``arrivals`` come piece by piece through a gate into the stream that ``build`` makes (append mode; none: only the gate);
    the folder of its output, and the gate."""
    spark = arrivals.sparkSession
    source, folders = work_folder(spark, f"{label}-input"), new_folders(spark, label)
    gate, state = Gate(spark, work_folder(spark, f"{label}-gate"), delay, window), work_folder(spark, f"{label}-gate-checkpoint")
    for piece in pieces(arrivals, by, bounds):
        piece.drop(by).write.mode("append").parquet(source)
        schema = arrivals.drop(by).schema
        run_batches(read_stream(spark, source, schema), "append", gate.take, state)
        if build:
            run_to_end(build(read_stream(spark, f"{gate.path}/in-time", schema)), "append", label, lambda b: b, folders)
    return folders[0], gate
