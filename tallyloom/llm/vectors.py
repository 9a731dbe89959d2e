"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learned that makes the signs of the rotated vectors a good code. Each code is cut into parts; every choice of
``chosen`` parts is a table, in which vectors of a label and length with equal parts meet. With 8 parts and one chosen, all pairs at
most 7 bits apart meet. Where they meet, cosines of the original vectors decide, block by block; a pair that meets in several
tables counts in the first only, so no pairs are listed or made distinct.

Vectors are not centred: around their mean, two vectors of small angle may lie on opposite sides, and few vectors mostly do. The
share of bits in which a pair differs then follows its angle whatever the table looks like, and recall with it.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import stash
from tallyloom.llm.components import components

THRESHOLD = 0.93
#: Vectors that a rotation is learned from, chosen by a hash of the id, and lengths that one is learned for: the most frequent.
SAMPLE, LENGTHS = 20_000, 16
BITS, PARTS, TURNS = 64, 8, 40
#: Vectors compared at a time, and rows of one task.
BLOCK, UNIT = 1000, 2000


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@lru_cache(64)
def planes(length: int, bits: int = BITS) -> np.ndarray:
    """``bits`` directions at random, the same in every run: orthogonal ones, and more such sets for short vectors."""
    rng, width = np.random.default_rng(length), min(length, bits)
    return np.hstack([np.linalg.qr(rng.normal(size=(length, width)))[0] for _ in range(-(-bits // width))])[:, :bits]


def learn(sample: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Directions of the code bits: principal directions of the unit vectors under a rotation that alternates between the
    signs of the rotated sample and the rotation that comes closest to them. Vectors shorter than the code have one learned
    bit per component, and ``planes`` for the others."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, directions = np.linalg.eigh(unit.T @ unit)
    directions = directions[:, ::-1][:, :bits]
    low = unit @ directions
    rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(low.shape[1],) * 2))[0]
    for _ in range(TURNS):
        u, _, v = np.linalg.svd(np.where(low @ rotation >= 0, 1.0, -1.0).T @ low)
        rotation = (u @ v).T
    return np.hstack([directions @ rotation, planes(sample.shape[1], bits)])[:, :bits]


def learned(classes: DataFrame, sample: int = SAMPLE, lengths: int = LENGTHS) -> dict[int, np.ndarray]:
    """``learn`` for the most frequent lengths of ``classes`` (first, label, vector), one length to a task with at most
    ``sample`` vectors; only the directions come to the driver."""
    length = F.size("vector")
    often = classes.groupBy(length.alias("length")).count().orderBy(F.desc("count"), "length").limit(lengths)
    spread = F.xxhash64("first", F.lit("sample"))
    drawn = classes.withColumn("length", length).join(F.broadcast(often), "length").where(
        F.pmod(spread, "count") < 2 * sample).withColumn(  # about twice as many as are needed reach the window
        "rank", F.row_number().over(W.partitionBy("length").orderBy(spread, "first", "label", "vector"))).where(F.col("rank") <= sample)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        found = learn(np.stack(frame.sort_values("rank")["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"length": [found.shape[0]], "directions": [found.ravel().tolist()]})

    models = drawn.select("length", "rank", "vector").groupBy("length").applyInPandas(fit, "length int, directions array<double>").collect()
    return {m["length"]: np.array(m["directions"]).reshape(m["length"], -1) for m in models}


def coder(models: dict[int, np.ndarray], parts: int = PARTS):
    """A pandas UDF: vector -> its code as ``parts`` numbers, by the directions of its length, ``planes`` where none were
    learned."""

    @F.pandas_udf("array<int>")
    def code(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        lengths = vectors.map(len)
        for length in set(lengths):
            fit = np.flatnonzero(lengths == length)
            x = np.stack([vectors.iloc[k] for k in fit]).astype(np.float64)
            bits = x @ (models[length] if length in models else planes(length)) >= 0
            pieces = [np.packbits(b, axis=1).astype(np.int64) for b in np.array_split(bits, parts, axis=1)]
            numbers = np.stack([p @ (256 ** np.arange(p.shape[1])) for p in pieces], axis=1)
            for k, row in zip(fit, numbers):
                out.iloc[k] = row.tolist()
        return out

    return code


def components_within(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable within the block, given which pairs are near."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def compare(frame: pd.DataFrame, tables: list[tuple[int, ...]], threshold: float) -> pd.DataFrame:
    """id, links and root of each vector that links in one bucket, or in one pair of parts of a large one: how many vectors
    it links with that it meets in no earlier table, and the smallest id it is then connected to."""
    frame = frame.sort_values("id")
    ids, copies, side = (frame[c].to_numpy() for c in ("id", "copies", "side"))
    x = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    if (side != side[0]).any():  # two different parts: only pairs between them
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return pd.DataFrame({"id": [], "links": [], "root": []}, dtype="int64")
    code = np.stack(frame["code"].to_numpy())
    earlier = np.zeros(len(a), bool)
    for table in tables[: int(frame["table"].iloc[0])]:
        earlier |= (code[a][:, table] == code[b][:, table]).all(1)
    a, b = a[~earlier], b[~earlier]
    links = np.bincount(a, copies[b], len(ids)).astype(np.int64)
    near[:] = False
    near[a, b] = True
    found = links > 0
    return pd.DataFrame({"id": ids[found], "links": links[found], "root": components_within(near, ids)[found]})


def meetings(classes: DataFrame, threshold: float, parts: int, chosen: int, block: int, unit: int) -> DataFrame:
    """``compare`` over all buckets of all tables of ``classes`` (id, label, vector, code, copies)."""
    tables = list(itertools.combinations(range(parts), chosen))
    keys = F.array(*[F.struct(F.lit(k).alias("table"), F.xxhash64(F.lit(k), "label", F.size("vector"), *[F.get("code", F.lit(p)) for p in t]).alias("bucket")) for k, t in enumerate(tables)])
    met = classes.select("id", F.explode(keys).alias("key")).select("id", "key.table", "key.bucket")
    size = met.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    size = stash(size.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("cuts"), "n"), "buckets")
    rows = size.where("cuts = 1").agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("cuts")).cast("int")
    low = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct(F.least(k, part).alias("low"), F.greatest(k, part).alias("high")))
    shared = met.join(size, "bucket").join(classes, "id").select(
        "id", "copies", "vector", "code", "table", "bucket", part.alias("side"), "cuts", F.explode(low).alias("pair"))
    task = F.when(F.col("cuts") == 1, F.pmod("bucket", F.lit(max(1, -(-rows // unit))))).otherwise(F.xxhash64("bucket", "pair.low", "pair.high"))
    shared = shared.select("id", "copies", "vector", "code", "table", "bucket", "side", "pair.low", "pair.high", task.alias("task"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(g, tables, threshold) for _, g in frame.groupby(["bucket", "low", "high"], sort=False)]).astype("int64")

    return shared.groupBy("task").applyInPandas(run, "id long, links long, root long")


def near_vectors(rows: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD, parts: int = PARTS, chosen: int = 1,
                 sample: int = SAMPLE, block: int = BLOCK, unit: int = UNIT) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``rows`` (vec_id, label, vector, any other columns).

    Rows with a null label, a null, zero or non-finite vector, or no vec_id link with nothing; without a vec_id, component_id is null.
    Vectors of a label link with those of their own length. Equal vectors of a label are compared once and count as many as they
    are, repeated rows too. Rows that share a vec_id but not the vector are one to components, and each has the largest number
    of links among them. More parts chosen make smaller buckets for larger tables, at some loss of distant pairs."""
    rows = rows.select("vec_id", "label", F.col(vector).cast("array<double>").alias("vector"))
    good = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))
    none = F.lit(0).cast("long")
    equal = good.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stash(equal.withColumn("id", F.monotonically_increasing_id()), "vectors")  # a vec_id may be first of several
    if classes.isEmpty():
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    models = learned(classes, sample)
    coded = stash(classes.withColumn("code", coder(models, parts)("vector")), "codes")
    met = stash(meetings(coded, threshold, parts, chosen, block, unit), "meetings")
    counted = met.groupBy("id").agg(F.sum("links").alias("links"))
    member = good.join(classes.select("label", "vector", F.col("id").alias("class"), "first", "copies"), ["label", "vector"]).select("vec_id", "class", "first", "copies")
    same = member.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    one, other = classes.select("id", F.col("first").alias("a")), classes.select(F.col("id").alias("root"), F.col("first").alias("b"))
    found = components(met.select("id", "root").join(one, "id").join(other, "root").select("a", "b").union(same))
    links = member.join(counted, F.col("class") == F.col("id"), "left").groupBy("vec_id").agg(
        F.max(F.col("copies") - 1 + F.coalesce("links", none)).alias("n_links"))
    out = rows.select("vec_id").join(links, "vec_id", "left").join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", none).alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
