"""Order-dependent operators per key that stay parallel when one key holds a large share of all rows.

A window partitioned by key puts a whole key into one task. Here rows are dealt into ranges of (key, order) of about equal
size, whatever the keys are; the part of a key in one range is a slice. Work inside slices runs in parallel and is written
once. Ranges follow each other along the order, so each border between two of them cuts at most one key: the keys with more
than one slice, and what has to be carried from slice to slice, are bounded by the number of ranges. There is one plan for
all sizes. Null keys, positions and values are rows like others; nulls come first in the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.session import stash

SLICE = "_slice"


@dataclass(frozen=True)
class Frame:
    """What a column of ``frames`` holds: ``kind`` is total, carried or before, of ``value``."""

    kind: str
    value: Column
    inclusive: bool = True


def total(value: Column, inclusive: bool = True) -> Frame:
    """Running sum. Null values add nothing; the sum is null while nothing came before. Not ``inclusive``: the sum of the rows
    before, 0 where there is none."""
    return Frame("total", value, inclusive)


def number() -> Frame:
    """1-based row number."""
    return Frame("total", F.lit(1).cast("long"))


def carried(value: Column) -> Frame:
    """Last non-null value at or before the row: an as-of lookup once two tables are laid over each other."""
    return Frame("carried", value)


def before(value: Column) -> Frame:
    """Value of the row before, null for the first one."""
    return Frame("before", value)


def dealt(df: DataFrame, keys: list[str], order: list[str], slices: int | None) -> DataFrame:
    """``df`` in ranges of (keys, order) with the number of the range, which grows along the order. ``slices`` is how many there
    are; by default as many as shuffles have partitions."""
    names = [*keys, *order]
    ranged = df.repartitionByRange(slices, *names) if slices else df.repartitionByRange(*names)
    return ranged.withColumn(SLICE, F.spark_partition_id().cast("long"))


def same_key(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of the keys with columns of the same names after ``prefix``."""
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"`{prefix}{k}`"))
    return match


def split_keys(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (as ``_o_<key>``) that a border between two ranges cuts: at most one for each border."""
    key = F.struct(*keys)
    ends = parts.groupBy(SLICE).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    follows = F.lead("low").over(W.orderBy(SLICE))  # a row per range
    cut = ends.withColumn("follows", follows).where(F.col("follows").isNotNull() & F.col("high").eqNullSafe(F.col("follows")))
    return cut.select(*[F.col(f"high.`{k}`").alias(f"_o_{k}") for k in keys]).distinct()


def frames(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None, **wanted: Frame) -> DataFrame:
    """``df`` with one column for each of ``wanted`` (``name=total(...)``), per key along ``order``: one slicing for all of them."""
    made = list(wanted.items())
    here = W.partitionBy(*keys, SLICE).orderBy(*order)
    upto, earlier = here.rowsBetween(W.unboundedPreceding, W.currentRow), here.rowsBetween(W.unboundedPreceding, -1)
    rows = dealt(df.select("*", *[f.value.alias(f"_v{i}") for i, (_, f) in enumerate(made)]), keys, order, slices)
    local = []
    for i, (_, f) in enumerate(made):
        value = F.col(f"_v{i}")
        if f.kind == "total":
            local.append(F.sum(value).over(upto if f.inclusive else earlier).alias(f"_l{i}"))
        elif f.kind == "carried":
            local.append(F.last(value, ignorenulls=True).over(upto).alias(f"_l{i}"))
        else:
            local.append(F.struct(F.lag(value).over(here).alias("value"), (F.row_number().over(here) == 1).alias("first")).alias(f"_l{i}"))
    parts = stash(rows.select("*", *local), "slices")

    cut = split_keys(parts.select(*keys, SLICE), keys)
    mine = parts.join(F.broadcast(cut), same_key(keys, "_o_"), "left_semi")  # fewer keys than ranges
    at, ends = F.struct(*order), []
    for i, (_, f) in enumerate(made):
        value = F.col(f"_v{i}")
        ends.append((F.sum(value) if f.kind == "total" else F.max_by(value, F.when(value.isNotNull(), at) if f.kind == "carried" else at)).alias(f"_e{i}"))
    per_slice = mine.groupBy(*keys, SLICE).agg(*ends)
    past = W.partitionBy(*keys).orderBy(SLICE)
    before_it = past.rowsBetween(W.unboundedPreceding, -1)
    passed = [
        (F.sum(f"_e{i}").over(before_it) if f.kind == "total" else F.last(f"_e{i}", ignorenulls=True).over(before_it) if f.kind == "carried"
         else F.lag(f"_e{i}").over(past)).alias(f"_b{i}") for i, (_, f) in enumerate(made)]
    brought = per_slice.select(*[F.col(f"`{k}`").alias(f"_o_{k}") for k in keys], F.col(SLICE).alias("_o_slice"), *passed)
    joined = parts.join(F.broadcast(brought), same_key(keys, "_o_") & (F.col(SLICE) == F.col("_o_slice")), "left")  # two rows a border
    out = []
    for i, (name, f) in enumerate(made):
        mine_, brought_ = F.col(f"_l{i}"), F.col(f"_b{i}")
        if f.kind == "total":
            summed = F.coalesce(mine_ + brought_, mine_, brought_)
            out.append((summed if f.inclusive else F.coalesce(summed, F.lit(0))).alias(name))
        elif f.kind == "carried":
            out.append(F.coalesce(mine_, brought_).alias(name))
        else:
            out.append(F.when(mine_["first"], brought_).otherwise(mine_["value"]).alias(name))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in wanted], *out)


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, inclusive: bool = True, slices: int | None = None,
) -> DataFrame:
    return frames(df, keys, order, slices, **{out: total(value, inclusive)})


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str, slices: int | None = None) -> DataFrame:
    return frames(df, keys, order, slices, **{out: number()})


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, slices: int | None = None) -> DataFrame:
    return frames(df, keys, order, slices, **{out: carried(value)})


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, slices: int | None = None) -> DataFrame:
    return frames(df, keys, order, slices, **{out: before(value)})


# --- spaced selection -------------------------------------------------------------------------------------------------
# Walk the positions of a key upwards and keep one whenever it lies at least ``gap`` beyond the last one kept. What a slice
# keeps depends on the past only through one threshold, the last kept position + gap. So a slice is a map from thresholds to
# the position it keeps last: a step function, written as the highest threshold of each step (``upto``) and that position
# (``last``). A threshold above all steps passes unchanged: nothing of the slice reaches it. Maps of neighbouring slices are
# composed pairwise, round by round, and thresholds are handed down again the same way.

#: Positions of a segment, the part of a slice that is one row.
SEGMENT = 1_000_000
LOWEST = -(1 << 63)


def _segments(key_type: pa.DataType, size: int):
    """Sorted (key, slice, position) -> rows of at most ``size`` distinct positions of one key. ``edge`` marks those that may
    have a neighbour: the first and the last of a slice, and the parts of a key that was cut."""
    names = pa.schema([("_key", key_type), (SLICE, pa.int64()), ("_part", pa.int64()), ("_edge", pa.bool_()), ("_at", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = number = None
        part, first = 0, True

        def row(at, edge):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, number, part, edge, at), names.types)], schema=names)

        for batch in batches:
            keys, slices, at = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            if not len(at):
                continue
            coded = keys.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(at)]])
            done: tuple[list, ...] = ([], [], [], [], [])
            for low, high in zip(starts[:-1], starts[1:]):
                here = keys[int(low)].as_py()
                if number is None or here != key:
                    if number is not None:
                        for column, x in zip(done, (key, number, part, first or part > 0, np.unique(np.concatenate(held)))):
                            column.append(x)
                        first = False
                    key, number, part, held = here, slices[int(low)].as_py(), 0, []
                held.append(at[low:high])
                while sum(map(len, held)) > size:
                    distinct = np.unique(np.concatenate(held))
                    held = [distinct]
                    if len(distinct) <= size:
                        break
                    for column, x in zip(done, (key, number, part, True, distinct[:size])):
                        column.append(x)
                    part, held = part + 1, [distinct[size:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, names.types)], schema=names)
        if number is not None:
            yield row(np.unique(np.concatenate(held)), True)

    return run


def chosen(at: np.ndarray, gap: int, threshold: int) -> np.ndarray:
    """Which of the sorted positions are kept when the first must not lie below ``threshold``."""
    kept = np.zeros(len(at), bool)
    following = np.searchsorted(at, at + gap).tolist()
    i = int(np.searchsorted(at, threshold))
    while i < len(at):
        kept[i] = True
        i = following[i]
    return kept


def threshold_map(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, last) of sorted positions, for thresholds up to ``gap`` beyond the first."""
    n = len(at)
    index = np.arange(n)
    following = np.searchsorted(at, at + gap)
    last = np.where(following < n, following, index)
    while not np.array_equal(further := last[last], last):
        last = further
    entries = min(n, int(np.searchsorted(at, at[0] + gap)) + 1)
    return steps(at[:entries], at[last[:entries]])


def steps(upto: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps to the same position become one."""
    ends = np.append(last[1:] != last[:-1], True)
    return upto[ends], last[ends]


def composed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of two neighbouring slices, ``a`` first."""
    into = np.searchsorted(b[0], a[1] + gap)
    last = np.where(into < len(b[0]), b[1][np.minimum(into, len(b[0]) - 1)], a[1])
    beyond = b[0] > a[0][-1]
    return steps(np.append(a[0], b[0][beyond]), np.append(last, b[1][beyond]))


def _maps(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [threshold_map(np.asarray(at), gap) for at in batch.column("_at").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_i"), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
                names=["_key", "_i", "upto", "last"])

    return run


def _pairs(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda name: [None if x is None else np.asarray(x) for x in batch.column(name).to_numpy(zero_copy_only=False)]
            made = [(u, l) if ru is None else composed((u, l), (ru, rl), gap) for u, l, ru, rl in zip(*map(read, ("upto", "last", "r_upto", "r_last")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_i"), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
                names=["_key", "_i", "upto", "last"])

    return run


def _thresholds(segments: DataFrame, key_type: str, gap: int, start: int) -> DataFrame:
    """_key, slice, part and threshold of every segment whose key has several: composed maps upwards, thresholds downwards. A
    task takes the maps of two neighbours at a time."""
    along = W.partitionBy("_key").orderBy(SLICE, "_part")  # segments at the edges of ranges: a few for each range
    edges = segments.where("_edge").withColumn("_i", F.row_number().over(along) - 1).withColumn("_n", F.count("*").over(W.partitionBy("_key")))
    edges = stash(edges.where("_n > 1").withColumn("_i", F.col("_i").cast("long")), "edges")
    most = edges.agg(F.max("_n")).first()[0] or 1
    kind = f"_key {key_type}, _i bigint, upto array<bigint>, last array<bigint>"
    levels = [stash(edges.select("_key", "_i", "_at").mapInArrow(_maps(gap), kind), "maps")]
    while 2 ** len(levels) < most:
        level = levels[-1].withColumn("_side", F.col("_i") % 2).withColumn("_i", F.shiftright("_i", 1))
        side = lambda s, c: F.max(F.when(F.col("_side") == s, F.col(c)))
        both = level.groupBy("_key", "_i").agg(side(0, "upto").alias("upto"), side(0, "last").alias("last"), side(1, "upto").alias("r_upto"), side(1, "last").alias("r_last"))
        levels.append(stash(both.mapInArrow(_pairs(gap), kind), "maps"))
    known = edges.select("_key").distinct().select("_key", F.lit(0).cast("long").alias("_i"), F.lit(start).alias("_from"))
    for level in reversed(levels):
        left = level.where("_i % 2 = 0").select(F.col("_key").alias("_k"), F.shiftright("_i", 1).alias("_b"), "upto", "last")
        met = known.join(left, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_i") == F.col("_b")))
        step = F.filter(F.arrays_zip("upto", "last"), lambda s: s["upto"] >= F.col("_from"))
        passed = F.coalesce(F.get(step, F.lit(0))["last"] + gap, F.col("_from"))
        both = F.array(F.struct((F.col("_i") * 2).alias("i"), F.col("_from").alias("t")), F.struct((F.col("_i") * 2 + 1).alias("i"), passed.alias("t")))
        known = met.select("_key", F.explode(both).alias("e")).select("_key", "e.i", "e.t").toDF("_key", "_i", "_from")
    known = known.toDF("_k", "_j", "_from")
    return edges.join(known, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_i") == F.col("_j"))).select(
        F.col("_key").alias("_o__key"), F.col(SLICE).alias("_o_slice"), F.col("_part").alias("_o_part"), "_from")


def _mark(gap: int, start: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at")
            limits = [start if t is None else t for t in batch.column("_from").to_pylist()]
            kept = [chosen(np.asarray(p), gap, t) for p, t in zip(at.to_numpy(zero_copy_only=False), limits)]
            which = pa.array(np.repeat(np.arange(len(kept)), [len(k) for k in kept]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(which), at.flatten(), pa.array(np.concatenate(kept) if kept else [], pa.bool_())], names=["_key", "_pos", "_kept"])

    return run


def keep_spaced(
    df: DataFrame, key: str, position: Column, gap: int, first_at: int | None = None, slices: int | None = None, segment: int = SEGMENT,
) -> DataFrame:
    """Distinct (key, position) with ``kept``: greedy selection of positions at least ``gap`` apart per key.

    ``position`` is a long; null positions are left out. ``first_at`` is the smallest position that may be kept first (any when
    None). Rows are moved once, into ranges; afterwards a row holds up to ``segment`` positions of one key.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    points = df.select(F.col(key).alias("_key"), position.cast("long").alias("_pos")).where("_pos IS NOT NULL")
    kind = points.schema["_key"].dataType
    name, start = kind.simpleString(), LOWEST if first_at is None else first_at
    ranged = dealt(points, ["_key"], ["_pos"], slices).sortWithinPartitions("_key", "_pos").select("_key", SLICE, "_pos")
    cut = ranged.mapInArrow(_segments(to_arrow_type(kind), segment), f"_key {name}, {SLICE} bigint, _part bigint, _edge boolean, _at array<bigint>")
    segments = stash(cut, "segments")
    limits = _thresholds(segments, name, gap, start)
    own = same_key(["_key"], "_o_") & (F.col(SLICE) == F.col("_o_slice")) & (F.col("_part") == F.col("_o_part"))
    ready = segments.join(F.broadcast(limits), own, "left").select("_key", "_at", "_from")  # a few rows for each range or segment
    marked = ready.mapInArrow(_mark(gap, start), f"_key {name}, _pos bigint, _kept boolean")
    return marked.select(F.col("_key").alias(key), F.col("_pos").alias("position"), F.col("_kept").alias("kept"))
