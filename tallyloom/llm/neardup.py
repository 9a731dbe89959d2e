"""Near-duplicate texts: MinHash by SetSketch registers, banded, estimated by likelihood and verified on full shingle sets.

1. Texts with equal sets collapse to one class, whatever their number.
2. Classes that agree in a band of registers are candidates. Each points at the smallest class of its band, which cuts the
   candidates into blocks: no two classes of different blocks share a band.
3. Blocks are compared within units of bounded size: pairs that share a band, aren't connected yet and are estimated near
   enough are verified on their full sets. Larger blocks are dealt into units at random, twice; what is then outside a
   block's largest component is compared with all of the block, part by part. So every candidate pair of different
   components has been verified or estimated as far away, and no pairs are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import sketches
from tallyloom.llm.common import mix, stash
from tallyloom.llm.components import components
from tallyloom.llm.shingles import Shingler

#: Links have 100 * intersection >= percent * union; this is the percentage where none is given.
PERCENT = 85
#: Share of the pairs at the threshold that may share no band.
MISSED = 4e-5
#: Pairs estimated this far below the threshold, six standard deviations at 0.8, are not verified.
MARGIN = 0.15
#: Classes and shingles that one task compares at a time.
UNIT, UNIT_SHINGLES = 1000, 2_000_000
SETS = "row long, fp binary, n_shingles int, registers binary, bands array<long>"


def band_width(percent: int) -> int:
    """Registers in a band: the most with which at most ``MISSED`` of the pairs at the threshold share no band. 32 bands of 8
    miss 4 in 100,000 at 0.85, 42 bands of 6 miss 3 in 1,000,000 at 0.8."""
    missed = lambda width: (1 - (percent / 100) ** width) ** (sketches.M // width)
    return max(w for w in range(1, sketches.M + 1) if w == 1 or missed(w) <= MISSED)


def bands(registers: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A hash of each band of each row of registers; registers beyond the last whole band are in none."""
    width = band_width(percent)
    count = sketches.M // width
    parts = registers[:, : count * width].astype(np.uint64).reshape(len(registers), count, width)
    total = np.full(parts.shape[:2], 1, np.uint64) * np.arange(1, count + 1, dtype=np.uint64)
    for k in range(width):
        total = mix(total ^ parts[:, :, k])
    return total.view(np.int64)


def sketch(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, fp (hash of the whole set), n_shingles, registers and bands of each row of ``docs``; null fp without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), ("n_shingles", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingler.of(t) for t in part.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                out: list[list] = [part.column(0), [None] * len(sets), [len(s) for s in sets], [None] * len(sets), [None] * len(sets)]
                if full:
                    found = sketches.registers(np.concatenate([sets[k] for k in full]), np.cumsum([0, *[len(sets[k]) for k in full]][:-1]))
                    for k, r, b in zip(full, found, bands(found, percent)):
                        out[1][k], out[3][k], out[4][k] = xxhash.xxh3_128_digest(sets[k].tobytes()), r.tobytes(), b
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    ddl = "doc_id long, fp binary, n_shingles long, registers binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


class Pool:
    """Classes of one unit with what is needed to compare them, and their components so far."""

    def __init__(self, frame: pd.DataFrame, percent: int):
        self.percent = percent
        self.ids = frame["id"].to_numpy()
        self.registers = np.stack([np.frombuffer(r, np.uint16) for r in frame["registers"]])
        self.bands = bands(self.registers, percent)
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        self.distinct, self.elements = np.unique(np.concatenate(sets), return_inverse=True)
        self.labels = frame["component"].to_numpy().copy()

    def set_of(self, k: int) -> np.ndarray:
        return self.elements[self.ends[k] - self.sizes[k] : self.ends[k]]

    def link(self, k: int, others: np.ndarray) -> None:
        """Connects class k with those of ``others`` that it links with and isn't connected to."""
        others = others[self.labels[others] != self.labels[k]]
        others = others[(self.bands[others] == self.bands[k]).any(1)]
        if not len(others):
            return
        near = sketches.similarity(np.broadcast_to(self.registers[k], (len(others), sketches.M)), self.registers[others],
                                   np.full(len(others), self.sizes[k]), self.sizes[others])
        has = np.zeros(len(self.distinct), bool)
        has[self.set_of(k)] = True
        for o in others[np.argsort(-near, kind="stable")][: int((near >= self.percent / 100 - MARGIN).sum())]:
            if self.labels[o] != self.labels[k]:
                both = int(has[self.set_of(o)].sum())
                if 100 * both >= self.percent * (self.sizes[k] + self.sizes[o] - both):
                    low, high = sorted((self.labels[k], self.labels[o]))
                    self.labels[self.labels == high] = low

    def found(self, before: np.ndarray) -> pd.DataFrame:
        """Links between what was apart: from each old component to the one it is in now."""
        moved = before != self.labels
        return pd.DataFrame({"a": before[moved], "b": self.labels[moved]}).drop_duplicates()


def compare_within(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links among the classes of each block of one unit."""
    out = []
    for _, block in frame.groupby("block", sort=False):
        pool = Pool(block.sort_values("id"), percent)
        before = pool.labels.copy()
        for k in range(len(pool.ids) - 1):
            pool.link(k, np.arange(k + 1, len(pool.ids)))
        out.append(pool.found(before))
    return pd.concat(out).astype("int64")


def compare_across(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the loose classes of one unit with all of its classes."""
    pool = Pool(frame.sort_values(["id", "loose"]).reset_index(drop=True), percent)
    before, loose = pool.labels.copy(), np.flatnonzero(frame.sort_values(["id", "loose"])["loose"].to_numpy())
    for k in loose:
        pool.link(k, np.arange(len(pool.ids)))
    return pool.found(before).astype("int64")


def with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (id, fp, ...) and ``shingles``, the full set of the text, made again from ``docs`` for these alone."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The set of each text that is the wanted one: rows that share a doc_id may differ. One step makes and compares it; a
        condition on what a Python column gives would have every set made twice, by two workers in each task."""
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                ids, wants, texts = (c.to_pylist() for c in batch.slice(at, 200).columns)
                sets = [shingler.of(t).tobytes() for t in texts]
                kept = [row for row in zip(ids, wants, sets) if xxhash.xxh3_128_digest(row[2]) == row[1]]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = members.select("id", "fp")
    found = texts.join(wanted, F.col("doc_id") == F.col("id")).select("id", "fp", "text")
    sets = found.mapInArrow(run, "id long, fp binary, shingles binary")
    return members.join(sets.dropDuplicates(["id", "fp"]), ["id", "fp"])


def links_in_blocks(docs: DataFrame, classes: DataFrame, unit: int = UNIT, unit_shingles: int = UNIT_SHINGLES, percent: int = PERCENT) -> DataFrame:
    """a, b: links that connect what is connected among ``classes`` (id, fp, n_shingles, registers, bands), the bands made
    for the same percentage."""
    within, across = lambda frame: compare_within(frame, percent), lambda frame: compare_across(frame, percent)
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("band", "first")
    pointed = banded.join(shared, "band").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    blocks = components(pointed)
    blocks = blocks.union(blocks.select(F.col("component_id"), F.col("component_id")).distinct()).toDF("id", "block")
    members = stash(with_sets(docs, classes.drop("bands").join(blocks, "id")), "members")

    size = members.groupBy("block").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"))
    parts = F.greatest(F.ceil(F.col("n") / unit), F.ceil(F.col("words") / unit_shingles)).cast("int")
    size = stash(size.select("block", "n", "words", parts.alias("parts")), "blocks")
    small, large = size.where("parts = 1"), size.where("parts > 1")
    total = small.agg(F.sum("n"), F.sum("words")).first()
    units = max(1, -(-(total[0] or 0) // unit), -(-(total[1] or 0) // unit_shingles))
    alone = members.join(small.select("block"), "block").withColumn("component", F.col("id"))
    out = "a long, b long"
    links = alone.groupBy(F.pmod(F.xxhash64("block"), F.lit(units)).alias("unit")).applyInPandas(within, out)
    if large.isEmpty():
        return links

    crowd = members.join(large.select("block", "parts"), "block").withColumn("component", F.col("id"))
    for turn in range(2):
        part = F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts"))
        links = links.union(crowd.groupBy("block", part.alias("part")).applyInPandas(within, out))
    links = stash(links, "found")
    known = components(links).toDF("id", "now")
    crowd = crowd.drop("component").join(known, "id", "left").withColumn("component", F.coalesce("now", "id"))
    counts = crowd.groupBy("block", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("block").agg(F.max_by("component", "n").alias("main"))
    crowd = stash(crowd.join(main, "block").withColumn("loose", F.col("component") != F.col("main")), "crowd")
    chunks = crowd.where("loose").groupBy("block").agg(
        F.greatest(F.ceil(F.count("*") / unit), F.ceil(F.sum("n_shingles") / unit_shingles)).cast("int").alias("chunks"))
    crowd = crowd.join(chunks, "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keep = ["id", "registers", "shingles", "component", "block"]
    part, chunk = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")), F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks"))
    everyone = crowd.select(*keep, part.alias("part"), every(F.col("chunks")).alias("chunk"), F.lit(False).alias("loose"))
    seeking = crowd.where("loose").select(*keep, every(F.col("parts")).alias("part"), chunk.alias("chunk"), F.lit(True).alias("loose"))
    return links.union(everyone.union(seeking).groupBy("block", "part", "chunk").applyInPandas(across, out))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (doc_id, text, any other columns), where texts link
    from ``percent`` hundredths of similarity on.

    Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one document, whatever their
    texts. Rows without a doc_id link with nothing: component_id is null, and they are kept. An empty table gives no rows."""
    rows = stash(sketch(docs, percent), "sketches")
    classes = stash(rows.where("fp is not null and doc_id is not null").groupBy("fp").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bands").alias("bands")), "classes")
    links = links_in_blocks(docs, classes, percent=percent)
    equal = rows.select("doc_id", "fp").join(classes.select("fp", "id"), "fp").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = components(links.select("a", "b").union(equal))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` per group of near duplicates, the one with the smallest doc_id, with all its columns. Where rows
    share that doc_id, the smallest of them stays; rows without a doc_id all stay."""
    found = stash(near_duplicates(docs, percent).select("doc_id", "kept").where("doc_id is not null"), "kept")
    dropped = found.where("not kept").select("doc_id").distinct()
    repeated = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    once = docs.join(dropped.union(repeated), "doc_id", "left_anti").select(*docs.columns)
    one = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("doc"))
    return once.union(one.select("doc.*"))
