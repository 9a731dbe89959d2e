"""Sliced operators against plain loops, with few and with many slices."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered as O


def greedy(points, gap, first_at):
    kept, limit = {}, first_at
    for p in sorted(set(points)):
        hit = limit is None or p >= limit
        if hit:
            limit = p + gap
        kept[p] = hit
    return kept


@pytest.mark.parametrize("seed", range(8))
def test_keep_spaced(spark, seed):
    rnd = random.Random(seed)
    gap = rnd.choice([3, 5, 50, 700])
    first = rnd.choice([None, gap])
    spread = rnd.choice([300, 5000, 60000])
    rows = [(k, rnd.randrange(0, spread)) for k, n in ((1, 2500), (2, 150), (3, 9)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k long, p long")
    got = O.keep_spaced(df, "k", F.col("p"), gap, first_at=first, slices=rnd.choice([None, 1, 7, 60]))
    found = {(r.k, r.position): r.kept for r in got.collect()}
    want = {(k, p): kept for k in (1, 2, 3) for p, kept in greedy([p for kk, p in rows if kk == k], gap, first).items()}
    assert found == want


@pytest.mark.parametrize("slices, segment", [(4, 1000), (400, 1000), (8, 7)])
@pytest.mark.parametrize("gap", [1, 40, 2500, 10**7])
def test_keep_spaced_hot_key(spark, gap, slices, segment):
    """One key in all ranges: composed maps give the same rows at any number of slices and any length of a row."""
    rnd = random.Random(gap)
    rows = [("hot" if i % 9 else None, rnd.randrange(0, 20_000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, p long")
    got = {(r.k, r.position): r.kept for r in O.keep_spaced(df, "k", F.col("p"), gap, slices=slices, segment=segment).collect()}
    assert got == {(k, p): kept for k in ("hot", None) for p, kept in greedy([p for kk, p in rows if kk == k], gap, None).items()}


def test_composed_maps():
    """The map of two neighbours is the one of their positions together, for every threshold either can meet."""
    rnd = random.Random(5)
    for _ in range(300):
        gap = rnd.choice([1, 2, 7, 30, 200])
        at = np.unique([rnd.randrange(0, 150) for _ in range(rnd.randrange(2, 60))])
        cut = rnd.randrange(1, len(at)) if len(at) > 1 else None
        if not cut:
            continue
        upto, last = O.composed(O.threshold_map(at[:cut], gap), O.threshold_map(at[cut:], gap), gap)
        for t in range(int(at[0]) - 2, int(at[0]) + gap + 1):
            kept = at[O.chosen(at, gap, t)]
            k = int(np.searchsorted(upto, t))
            assert (last[k] if k < len(last) else None) == (kept[-1] if len(kept) else None)


def test_frames_together(spark, ordered_rows):
    df, _ = ordered_rows
    by = (["k"], ["p", "i"])
    one = O.frames(df, *by, 9, t=O.total(F.col("v")), n=O.number(), c=O.carried(F.col("v")), b=O.before(F.col("v")), e=O.total(F.col("v"), inclusive=False))
    assert one.columns == ["k", "p", "i", "v", "t", "n", "c", "b", "e"]
    for name, other in (("t", O.running_total(df, *by, F.col("v"), "t")), ("n", O.ordinal(df, *by, "n")), ("c", O.carry_forward(df, *by, F.col("v"), "c")),
                        ("b", O.previous(df, *by, F.col("v"), "b")), ("e", O.running_total(df, *by, F.col("v"), "e", inclusive=False))):
        assert as_map(one, name) == as_map(other, name)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k long, p long, v long")
    assert O.frames(df, ["k"], ["p"], n=O.number()).count() == 0
    assert O.keep_spaced(df, "k", F.col("p"), 5).count() == 0


def test_keep_spaced_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 9), (4, 1)], "k long, p long")
    got = sorted((r.k or -1, r.position, r.kept) for r in O.keep_spaced(df, "k", F.col("p"), 5, slices=3).collect())
    assert got == [(-1, 1, True), (-1, 2, False), (-1, 9, True), (4, 1, True)]


@pytest.fixture(scope="module")
def ordered_rows(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([None, *range(1, 3000, 3)]) if i % 9 else None, i, rnd.choice([None, 1, 2, 3])) for k, n in ((1, 1500), (2, 40), (None, 300)) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["k", "p", "i", "v"]).astype({"k": "Int64", "p": "Int64", "v": "Int64"})
    df = spark.createDataFrame(rows, "k long, p long, i long, v long")
    return df, pdf.sort_values(["k", "p", "i"], na_position="first")


def as_map(df, column):
    return {(r.k, r.i): r[column] for r in df.collect()}


@pytest.mark.parametrize("slices", [None, 1, 40])
def test_running_total_and_ordinal(ordered_rows, slices):
    df, pdf = ordered_rows
    got = as_map(O.running_total(df, ["k"], ["p", "i"], F.col("v"), "t", slices=slices), "t")
    number = as_map(O.ordinal(df, ["k"], ["p", "i"], "n", slices=slices), "n")
    groups = pdf.groupby("k", dropna=False)
    summed = pdf.v.fillna(0).groupby(pdf.k, dropna=False).cumsum()
    some = pdf.v.notna().groupby(pdf.k, dropna=False).cumsum() > 0
    want, count = [int(x) if y else None for x, y in zip(summed, some)], groups.cumcount() + 1
    key = [(None if pd.isna(k) else k, i) for k, i in zip(pdf.k, pdf.i)]
    assert got == dict(zip(key, want))
    assert number == dict(zip(key, count))


@pytest.mark.parametrize("slices", [None, 1, 40])
def test_carry_forward_and_previous(ordered_rows, slices):
    df, pdf = ordered_rows
    carried = as_map(O.carry_forward(df, ["k"], ["p", "i"], F.col("v"), "c", slices), "c")
    before = as_map(O.previous(df, ["k"], ["p", "i"], F.col("v"), "b", slices), "b")
    groups = pdf.groupby("k", dropna=False).v
    none = lambda s: [None if pd.isna(x) else int(x) for x in s]
    key = [(None if pd.isna(k) else k, i) for k, i in zip(pdf.k, pdf.i)]
    assert carried == dict(zip(key, none(groups.ffill())))
    assert before == dict(zip(key, none(groups.shift(1))))
