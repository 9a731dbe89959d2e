"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets: each source gets its weight's share of the budget; sources above their cap (a number of epochs of their size) are
clamped, and what they leave is dealt to the others by weight, until none is above. Sampling: a target of 2.4 epochs takes
every document twice and 0.4 of the words once more, namely the documents with the smallest seeded hashes. Where that hash
must end is found from sums per hash bucket and then within one bucket, so no source is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, stash

EPOCHS = 3.0
#: Bits of the hash that make a bucket: a bucket holds so small a part of its source.
BUCKET_BITS = 12
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def word_count(text: Column) -> Column:
    """Number of words, 0 for null: each word becomes one letter and white space nothing."""
    words = F.regexp_replace(F.regexp_replace(text, WORD, "w"), "[^w]+", "")
    return F.coalesce(F.length(words).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, budget: float, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (size, weight, any other columns) and a double ``target``.

    Each round is one aggregate over the sources; only sums reach the driver. The level of the free sources rises from round
    to round, so clamped ones stay clamped. Sources of no size, or with a null or no positive weight, get 0.
    """
    cap = F.col("size") * epochs
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)
    level = 0.0
    while True:
        full = cap <= weight * F.lit(level)
        rest = sources.agg(F.sum(F.when(full & (weight > 0), cap)).alias("clamped"), F.sum(F.when(~full, weight)).alias("free")).first()
        risen = max(budget - (rest["clamped"] or 0.0), 0.0) / rest["free"] if rest["free"] else level
        if risen <= level * (1 + 1e-12):
            return sources.withColumn("target", F.least(cap, weight * F.lit(level)))
        level = risen


def by_order(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its size and, sources being in order of code points and null last,
    the next weight in turn. The position is counted per range of sources, so no task sees all of them."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    order = (F.col("source").isNull(), F.col("source"))
    parts = stash(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = parts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return parts.join(before, "part").select("source", "size", F.get(turn, (place % len(weights)).cast("int")).alias("weight"))


def draw(seed: int, *key: str) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def cutoffs(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` (source, size, target, ...) with ``whole`` repeats of each row and ``cutoff``: rows whose hash is at most
    this are taken once more. ``rows`` has source, size and hash. The words taken are within one document of the target."""
    plan = sources.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("extra", F.greatest(F.col("target") - F.col("whole") * F.col("size"), F.lit(0.0)))
    bucket = F.shiftright("hash", 64 - BUCKET_BITS)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    wanted = plan.select(F.col("source").alias("of"), "extra")
    ordered = W.partitionBy("source").orderBy("bucket")  # at most 2**BUCKET_BITS rows per source
    sums = sums.withColumn("upto", F.sum("words").over(ordered)).join(wanted, same(F.col("source"), F.col("of")))
    edge = sums.where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") <= F.col("extra"))).select(
        "of", F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("words")).alias("open"))
    inner = W.partitionBy("source").orderBy("hash")  # rows of one bucket of the source
    close = (
        rows.where(F.col("size") > 0).join(edge, same(F.col("source"), F.col("of")) & (bucket == F.col("edge")))
        .groupBy("source", "hash", "open").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(inner))
        .where(F.col("upto") - F.col("open") <= F.col("open") - (F.col("upto") - F.col("words")))
        .groupBy("source").agg(F.max("hash").alias("last")).select(F.col("source").alias("in"), "last")
    )
    edge = edge.join(close, same(F.col("of"), F.col("in")), "left").select("of", F.coalesce(
        "last", F.when(F.col("edge") == -(1 << BUCKET_BITS - 1), F.lit(None)).otherwise(
            F.shiftleft(F.col("edge").cast("long"), 64 - BUCKET_BITS) - 1)).alias("cutoff"))
    return plan.drop("extra").join(edge, same(F.col("source"), F.col("of")), "left").drop("of")


def repeats(hash_: Column, size: Column) -> Column:
    """How often a row is taken, from its source's ``whole`` and ``cutoff``; rows without words are not taken."""
    more = F.coalesce((hash_ <= F.col("cutoff")).cast("int"), F.lit(0))
    return F.when(size > 0, F.col("whole") + more).otherwise(0)


def mix_plan(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (1, 2, 3), epochs: float = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows, plan) of ``docs`` (doc_id, text, source): doc_id, source, size and hash of each row, written; and per source
    its size, weight, target, whole and cutoff, written. The budget is the size of all sources."""
    rows = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed, "doc_id", "text").alias("hash")), "sizes")
    sources = by_order(rows, weights)
    budget = rows.agg(F.sum("size")).first()[0] or 0
    filled = stash(water_fill(stash(sources, "weights"), float(budget), epochs), "targets")
    return rows, stash(cutoffs(rows, filled), "plan")


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats and taken of each row. Null texts have size 0; a null source is a
    source; equal rows are taken alike; an empty table gives no rows."""
    rows, plan = mix_plan(docs, seed)
    plan = plan.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", "whole", "cutoff")
    times = repeats(F.col("hash"), F.col("size"))
    return rows.join(plan, same(F.col("source"), F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("repeats"), (times * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    _, plan = mix_plan(docs, seed)
    names = [F.col(f"doc.{c}").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*docs.columns).alias("doc"), draw(seed, "doc_id", "text").alias("hash"), word_count(F.col("text")).alias("words"))
    plan = plan.select(F.col("source").alias("of"), "whole", "cutoff")
    taken = packed.join(plan, same(F.col("doc.source"), F.col("of"))).withColumn("times", repeats(F.col("hash"), F.col("words")))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*names)
