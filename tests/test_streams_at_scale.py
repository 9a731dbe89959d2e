"""Stream state of many keys: users and jobs share buckets, and results stay those of each key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import common as C, joblog as SJ, sessions as SS

START = datetime(2024, 1, 1)
#: (user, minute, part): users beyond what a double holds, one of them null, over three parts; the last rows close all before.
ROWS = [(None if u == 0 else u * 10**15 + 7, (n * 37 + u) % 200 + 300 * part, part) for part in range(3) for u in range(40) for n in range(5 + u % 4)] + [(1, 3000, 3)]


def outcome(spark, build, schema):
    """What a stream writes of ROWS, part by part, and the folder of its state."""
    df = spark.createDataFrame([(u, START + timedelta(minutes=m), part) for u, m, part in ROWS], "user_id long, ts timestamp, part int")
    source, folders = C.work_folder(spark, "users"), C.new_folders(spark, "users")
    for n in range(4):
        df.where(F.col("part") == n).drop("part").write.mode("append").parquet(source)
        C.run_to_end(build(C.read_stream(spark, source, df.drop("part").schema)), "append", "users", lambda b: b, folders)
    return C.written(spark, folders[0], schema).drop("batch"), folders[1]


def kept(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(folder)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(C.in_buckets, "__defaults__", (4,))


def by_user():
    users = {}
    for u, m, _ in ROWS[:-1]:
        users.setdefault(u, []).append(m)
    return {u: sorted(times) for u, times in users.items()}


def test_request_counters_share_buckets(spark):
    rows, state = outcome(spark, lambda s: SS.request_checkpoints(s), "user_id bigint, n bigint")
    want = sorted((str(u), n) for u, times in by_user().items() for n in range(10, len(times) + 1, 10))
    assert want and sorted((str(r.user_id), r.n) for r in rows.collect()) == want
    assert kept(spark, state, "seen").count() <= 5


def test_tick_numbers_share_buckets(spark):
    rows, state = outcome(spark, lambda s: SS.dirty_stream(s), "tick timestamp, user_id bigint, n bigint")
    want = []
    for u, times in by_user().items():
        for m in sorted(set(times)):
            n = sum(t <= m for t in times)
            if n % 10:
                want.append((str(u), START + timedelta(minutes=m), n))
    assert sorted((str(r.user_id), r.tick, r.n) for r in rows.collect()) == sorted(want)
    assert kept(spark, state, "seen").count() <= 5


def test_lookups_share_buckets_and_expire(spark):
    rows, state = outcome(spark, lambda s: SS.cache_stream(s, seconds=3600), "user_id bigint, position bigint, hit boolean")
    want = []
    for u, times in by_user().items():
        last = None
        for m in sorted(set(times)):
            hit = last is not None and m - last < 60
            last = last if hit else m
            want.append((str(u), m, hit))
    epoch = datetime(1970, 1, 1)
    minute = lambda us: (epoch + timedelta(microseconds=us) - START) // timedelta(minutes=1)
    assert sorted((str(r.user_id), minute(r.position), r.hit) for r in rows.collect()) == sorted(want)
    assert kept(spark, state, "fetched").count() == 0  # the watermark is past all that was fetched


def test_jobs_share_buckets_and_end(spark):
    """Calls into Python are for buckets; jobs with gaps, chunks sent twice and a null job keep apart; ended jobs leave nothing."""
    at = lambda minute: START + timedelta(minutes=minute)
    rows, want = [], []
    for job in [None, *(10**15 * k + 7 for k in range(1, 20))]:
        rows += [(job, 0, b"a\nb", at(0), 0), (job, 2, b"c\nd\n", at(1), 0), (job, 2, b"c\nd\n", at(1), 1), (job, 3, b"e\n", at(2), 1)]
        if job and job % 2:
            rows += [(job, 1, b"!\n", at(2), 1)]
            want += [(job, n, x, False) for n, x in enumerate(("a", "b!", "c", "d", "e"), 1)]
        else:
            want += [(job, 1, "a", False), (job, 2, "b", True), (job, 3, "c", False), (job, 4, "d", False), (job, 5, "e", False)]
    rows += [(10**15, n, b"clock\n", at(m), n + 2) for n, m in enumerate((7, 100, 300))]
    df = spark.createDataFrame(rows, "job_id long, chunk_no long, bytes binary, at timestamp, part int")
    source, folders = C.work_folder(spark, "jobs"), C.new_folders(spark, "jobs")
    for n in range(5):
        df.where(F.col("part") == n).drop("part").write.mode("append").parquet(source)
        C.run_to_end(SJ.line_stream(C.read_stream(spark, source, df.drop("part").schema)), "append", "jobs", lambda b: b, folders)
    got = C.written(spark, folders[0], SJ.LINES).drop("batch").where("job_id IS NULL OR job_id <> 1000000000000000").collect()
    order = lambda r: (r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert kept(spark, folders[1], "progress").count() == 1
    assert kept(spark, folders[1], "early").count() == 0
    assert kept(spark, folders[1], "progress").select("key.bucket").distinct().count() == 1
