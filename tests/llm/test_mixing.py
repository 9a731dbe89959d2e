import re

import pytest

from tallyloom.llm.mixing import by_order, mix, mix_report, water_fill


def filled(sizes, weights, budget, epochs=3.0):
    """Clamping in plain Python, by weight order of the caps."""
    target, open_ = {}, set(k for k in sizes if weights[k] > 0)
    left = budget
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if epochs * sizes[k] <= level * weights[k]}
        if not full:
            return target | {k: level * weights[k] for k in open_} | {k: 0 for k in sizes if weights[k] <= 0}
        for k in full:
            target[k] = epochs * sizes[k]
            left -= target[k]
        open_ -= full
    return target | {k: 0 for k in sizes if weights[k] <= 0}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 2, 300, 4, 5000], [0, 7, 7], [1, 1000, 1, 1000, 1, 1], [5]])
def test_water_fill(spark, sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    rows = spark.createDataFrame([(k, s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))], "k int, size long, weight double")
    got = {r.k: r.target for r in water_fill(rows, float(sum(sizes))).collect()}
    want = filled(dict(enumerate(sizes)), dict(enumerate(weights)), sum(sizes))
    assert got == pytest.approx(want)


def test_sources_take_turns(spark):
    rows = spark.createDataFrame([(s, 1) for s in ["b", "a", None, "é", "Z", "z"]], "source string, size long")
    assert {r.source: r.weight for r in by_order(rows).collect()} == {"Z": 1, "a": 2, "b": 3, "z": 1, "é": 2, None: 3}


def test_report(spark, odd, empty):
    rows = mix_report(odd).collect()
    assert len(rows) == odd.count() and mix_report(empty).count() == 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.taken == r.repeats * r.size and r.taken <= 3 * r.size
    assert sorted(map(str, rows)) == sorted(map(str, mix_report(odd).collect()))
    assert mix(odd).count() == sum(r.repeats for r in rows) and mix(odd).columns == odd.columns


def test_near_target(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "if(id % 3 = 0, 'x', 's' || id % 7) as source")
    by = {}
    for r in mix_report(docs).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - taken) <= 50 for t, taken in by.values())
