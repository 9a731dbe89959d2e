"""Pages of long logs through an index by offset, so that a page moves its own bytes and no others.

Chunks get their byte offset once, from a running sum over their sizes alone, and are cut at multiples of the page size. The
index is a table bucketed by (job, page): requests are dealt into the same buckets and meet the pieces where they lie. What is
shuffled grows with the pages asked for; the log stays in place. A long log is spread over all buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text as X
from tallyloom.operators import ordered
from tallyloom.operators.joblog import PAGE_BYTES
from tallyloom.session import stash, work_folder

BUCKETS = 32


class LogIndex:
    """Pieces (job_id, page, at, bytes) of logs, bucketed by job and page, and where each log ends."""

    def __init__(self, spark: SparkSession, table: str, ends: DataFrame, page: int):
        self.spark, self.table, self.ends, self.page = spark, table, ends, page

    @classmethod
    def build(cls, chunks: DataFrame, page: int = PAGE_BYTES, buckets: int = BUCKETS, folder: str | None = None, table: str | None = None) -> LogIndex:
        """From byte chunks (job_id, chunk_no, bytes); null bytes are empty. The files go to ``folder``, the catalog knows them as
        ``table``."""
        spark = chunks.sparkSession
        sizes = chunks.select("job_id", "chunk_no", F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long").alias("size"))
        placed = ordered.running_total(sizes, ["job_id"], ["chunk_no"], F.col("size"), "at", inclusive=False)
        located = chunks.select("job_id", "chunk_no", "bytes").join(placed, ["job_id", "chunk_no"]).where("size > 0")
        first, last = F.floor(F.col("at") / page), F.floor((F.col("at") + F.col("size") - 1) / page)
        starts = F.transform(F.sequence(first, last), lambda p: F.greatest(p * page, F.col("at")))
        cut = F.transform(starts, lambda s: F.struct(
            s.alias("at"), F.floor(s / page).alias("page"),
            F.substring(F.col("bytes"), (s - F.col("at") + 1).cast("int"), (F.least((F.floor(s / page) + 1) * page, F.col("at") + F.col("size")) - s).cast("int")).alias("bytes")))
        pieces = located.select("job_id", F.explode(cut).alias("p")).select("job_id", "p.page", "p.at", "p.bytes")
        table = table or f"log_index_{uuid.uuid4().hex[:12]}"
        writer = pieces.repartition(buckets, "job_id", "page").write.bucketBy(buckets, "job_id", "page").sortBy("job_id", "page", "at")
        writer.option("path", folder or work_folder(spark, "log-index")).format("parquet").saveAsTable(table)
        ends = stash(placed.groupBy("job_id").agg(F.max(F.col("at") + F.col("size")).alias("ends")), "log-ends")
        return cls(spark, table, ends, page)

    def pages(self, requests: DataFrame) -> DataFrame:
        """Requests (job_id, from_byte, max_bytes) -> job_id, text and nextOffset of each, repeated requests each.

        A negative start is the start of the log; a start at or beyond its end, a job without a log and a size of nothing give
        an empty page.
        """
        most = F.lit((1 << 31) - 2)
        asked = requests.select(
            F.monotonically_increasing_id().alias("request"), "job_id", F.greatest(F.col("from_byte"), F.lit(0)).cast("long").alias("start"),
            F.least(F.greatest(F.coalesce("max_bytes", F.lit(0)), F.lit(0)), most).cast("long").alias("size"))
        asked = stash(asked, "requests")
        end = F.least(F.col("start") + F.col("size"), F.col("ends"))
        within = asked.where("size > 0").join(self.ends, "job_id").where(F.col("start") < F.col("ends")).withColumn("end", end)
        reach = within.select(
            "request", "job_id", "start", "end",
            F.explode(F.sequence(F.floor(F.col("start") / self.page), F.floor((F.col("end") - 1) / self.page))).alias("page"))
        met = reach.join(self.spark.table(self.table), ["job_id", "page"])
        low, high = F.greatest("start", "at"), F.least(F.col("end"), F.col("at") + F.octet_length("bytes"))
        parts = met.where(low < high).select(
            "request", low.alias("at"), F.substring(F.col("bytes"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("bytes"))
        whole = parts.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts"))  # max_bytes at most
        page = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["bytes"]))
        found = asked.join(whole.select("request", page.alias("page")), "request", "left").withColumn("page", F.coalesce("page", F.lit(b"")))
        return found.select("job_id", X.decode_utf8_ignore(F.col("page")).alias("text"), (F.col("start") + F.octet_length("page")).alias("nextOffset"))
