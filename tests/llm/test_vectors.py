import numpy as np

from tallyloom.llm import vectors

SCHEMA = "vec_id long, label int, embedding array<float>, id long"


def brute(rows):
    good = {}
    for k, (v, label, x, _) in enumerate(rows):
        if v is not None and label is not None and x is not None and len(x) == 16 and None not in x and np.isfinite(x).all() and np.any(x):
            good[k] = np.array(x, np.float32).astype(np.float64) / np.linalg.norm(np.array(x, np.float32).astype(np.float64))
    near = {k: [j for j in good if j != k and rows[j][1] == rows[k][1] and good[j] @ good[k] >= 0.93] for k in good}
    low = {r[0]: r[0] for r in rows if r[0] is not None}
    changed = True
    while changed:
        changed = False
        for k, js in near.items():
            for j in js:
                if low[rows[j][0]] < low[rows[k][0]]:
                    low[rows[k][0]], changed = low[rows[j][0]], True
    return near, low


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(n):
        x = centres[k % 12] + rng.normal(size=16) * (0.02 if k % 3 else 3)
        rows.append((k * 7 % 1009, int(k % 4), x.astype(np.float32).tolist(), 1))
    rows += [(2000 + k, 1, rows[1][2], 1) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    rows += [(3000, 1, None, 1), (3001, 1, [0.0] * 16, 1), (3002, None, rows[1][2], 1), (3003, 1, [nan] * 16, 1), (3004, 1, [inf] + [1.0] * 15, 1),
             (3005, 1, [1.0] * 3, 1), (3006, 1, [None] + [1.0] * 15, 1), (3007, 1, [], 1), (None, 1, rows[1][2], 1)]
    return rows


def compare(spark, rows, **options):
    near, low = brute(rows)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert len(got) == len(rows)
    want = {rows[k][0]: len(js) for k, js in near.items()}
    assert all(got[v].n_links <= want.get(v, 0) for v in got)
    assert sum(got[v].n_links for v in got) >= 0.95 * sum(want.values())
    assert {v: got[v].component_id for v in low} == low and all(got[v].kept == (low[v] == v) for v in low)
    assert got[None].component_id is None and got[None].n_links == 0


def test_against_brute_force(spark):
    compare(spark, made(1))


def test_split_buckets(spark):
    compare(spark, made(2), block=20, unit=100, parts=4)


def test_two_parts_chosen(spark):
    compare(spark, made(3), parts=8, chosen=2)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, 1, None, 1), (2, 1, [0.0], 1)], SCHEMA)).collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_length_is_compared(spark):
    """Every length goes through codes, learned or not, few vectors or many. Equal numbers padded to another length
    don't link, and a pair alone in its length does."""
    rng = np.random.default_rng(6)
    rows = []
    for length, n in ((8, 300), (16, 60), (5, 40)):
        centres = rng.normal(size=(10, length))
        rows += [(len(rows) + k, k % 2, (centres[k % 10] + rng.normal(size=length) * 0.02).tolist(), 1) for k in range(n)]
    rows += [(500, 1, [1.0, 0.0], 1), (501, 1, [1.0, 0.1], 1), (502, 1, [1.0, 0.0, 0.0], 1), (503, 1, [1.0, 0.0, 0.0], 1), (504, 0, [1.0, 0.0], 1)]
    unit = [np.array(r[2]) / np.linalg.norm(r[2]) for r in rows]
    near = [[j for j in range(len(rows)) if j != k and rows[j][1] == rows[k][1] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.93] for k in range(len(rows))]
    low = [r[0] for r in rows]
    for _ in rows:
        low = [min([low[k], *(low[j] for j in near[k])]) for k in range(len(rows))]
    models = vectors.learned(spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "first long, label int, vector array<double>"), lengths=2)
    assert set(models) == {8, 16} and models[8].shape == (8, 64)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    assert [(got[r[0]].n_links, got[r[0]].component_id) for r in rows] == [(len(js), c) for js, c in zip(near, low)]
    assert got[501].component_id == 500 and got[503].component_id == 502 and got[504].n_links == 0


def planted(seed, pairs=500, alone=1000, length=64):
    """Pairs of cosines between 0.93 and 0.95, no links beside them but for chance, over three labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(pairs):
        x, y = rng.normal(size=(2, length))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        cosine = rng.uniform(0.9301, 0.95)
        z = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)
        rows += [(2 * k, k % 3, (x * 3).tolist(), 1), (2 * k + 1, k % 3, z.tolist(), 1)]
    return rows + [(10_000 + k, k % 3, rng.normal(size=length).tolist(), 1) for k in range(alone)]


def test_recall_near_the_threshold(spark):
    """Through learned codes and tables at the length of the registered query: recall over 0.9, components as the found
    pairs say, nothing below the threshold."""
    rows = planted(7)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    found = [k for k in range(500) if got[2 * k].n_links]
    print("recall near the threshold", len(found) / 500)
    assert len(found) >= 460
    for k in range(500):
        linked = k in set(found)
        assert (got[2 * k].n_links, got[2 * k + 1].n_links) == (linked, linked)
        assert (got[2 * k].component_id, got[2 * k + 1].component_id) == (2 * k, 2 * k if linked else 2 * k + 1)
    assert all(r.n_links == 0 and r.component_id == v for v, r in got.items() if v >= 10_000)


def test_two_vectors_of_a_length_and_repeated_ids(spark):
    rows = [(1, 1, [1.0, 0.0, 0.0], 1), (2, 1, [1.0, 0.1, 0.0], 1), (3, 1, [0.0, 0.0, 1.0, 0.0], 1), (3, 1, [1.0, 0.05, 0.0], 1), (4, 1, [2.0], 1), (5, 1, [3.0], 1), (6, 1, [-1.0], 1)]
    got = [tuple(r) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).orderBy("vec_id").collect()]
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]
