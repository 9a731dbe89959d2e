"""The current-state table: batches, replays, failures at every step, compaction."""

import random

import pytest

from tallyloom.streaming.statetable import MOST_DELTAS, Folder, StateTable

SCHEMA = "k string, seq long, v long"


def batches(seed, count=9, keys=40):
    rnd = random.Random(seed)
    return [[(rnd.choice([None, *map(str, range(keys))]), rnd.randrange(10_000) * 10 + n, n) for _ in range(rnd.choice([0, 5, 60]))] for n in range(count)]


def last(rows):
    best = {}
    for k, seq, v in rows:
        if k not in best or best[k][0] < seq:
            best[k] = (seq, v)
    return {(k, *x) for k, x in best.items()}


def table(spark, tmp_path, **options):
    return StateTable(spark, str(tmp_path / "state"), SCHEMA, ["k"], "seq", **options)


def test_batches_in_any_order_and_twice(spark, tmp_path):
    t, seen = table(spark, tmp_path, buckets=4), []
    assert t.read().count() == 0
    for number, rows in enumerate(batches(1)):
        df = spark.createDataFrame(rows, SCHEMA)
        assert t.apply(df, number) and not t.apply(df, number)
        assert t.apply(df, number, writer="other")  # numbers count per writer
        seen += rows
        assert {tuple(r) for r in t.read().collect()} == last(seen)
        parts = t.manifest()["buckets"].values()
        assert all(len(p) <= MOST_DELTAS + 1 for p in parts)
    assert set(t.vacuum(keep=1)) and {tuple(r) for r in t.read().collect()} == last(seen)


@pytest.mark.parametrize("step", ["_write", "_compact", "put"])
def test_killed_between_steps(spark, tmp_path, monkeypatch, step):
    """A batch that fails anywhere leaves no trace and counts once when it comes again."""
    t, seen = table(spark, tmp_path, buckets=2), []
    made = batches(2, count=8)
    for number, rows in enumerate(made):
        df = spark.createDataFrame(rows, SCHEMA)
        before = {tuple(r) for r in t.read().collect()}
        owner, name = (Folder, "put") if step == "put" else (StateTable, step)
        real = getattr(owner, name)

        def broken(self, *args):
            if step == "_write":
                real(self, *args)  # its files stay behind
            raise OSError("killed")

        with monkeypatch.context() as m:
            m.setattr(owner, name, broken)
            with pytest.raises(OSError):
                t.apply(df, number)
        assert {tuple(r) for r in t.read().collect()} == before
        assert t.apply(df, number)
        seen += rows
    assert {tuple(r) for r in t.read().collect()} == last(seen)
    assert (len(t.vacuum()) > 0) and {tuple(r) for r in t.read().collect()} == last(seen)


def test_compaction_touches_only_grown_buckets(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    t.apply(spark.createDataFrame([(str(k), 0, 0) for k in range(400)], SCHEMA), 0)
    base = {b: p[0]["folder"] for b, p in t.manifest()["buckets"].items()}
    for number in range(1, 8):
        t.apply(spark.createDataFrame([("7", number, number)], SCHEMA), number)
    changed = [b for b, p in t.manifest()["buckets"].items() if p[0]["folder"] != base[b]]
    assert len(changed) == 1 and {r.k: r.v for r in t.read().collect()}["7"] == 7


def test_second_writer_does_not_overwrite(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    stale = two.manifest()
    one.apply(spark.createDataFrame([("a", 1, 1)], SCHEMA), 0, "one")
    two.manifest = lambda: stale  # read before the other one wrote
    with pytest.raises(FileExistsError):
        two.apply(spark.createDataFrame([("a", 2, 2)], SCHEMA), 0, "two")
    assert [r.v for r in one.read().collect()] == [1]
