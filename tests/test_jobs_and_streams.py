import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import history as H, joblog as J, logindex as LI, named as D, registry as R
from tallyloom.sources import codefiles as CF, files as S, walk
from tallyloom.streaming import common as C, joblog as SJ, lateness as L, sessions as SS


def expected_lines(jobs):
    return sorted((j, i + 1, l.decode("utf-8", errors="ignore")) for j, data in jobs.items() for i, l in enumerate(data.split(b"\n")[:-1]))


def random_chunks(seed):
    rnd = random.Random(seed)
    jobs, rows = {}, []
    for job in range(4):
        data = b"".join(rnd.choice([b"a", "é".encode(), b"\n", b"\xff", b"long text "]) for _ in range(rnd.choice([0, 5, 200])))
        jobs[job], at, n = data, 0, 0
        while at < len(data):
            size = rnd.choice([1, 2, 7, 60])
            rows.append((job, n, data[at:at + size]))
            at, n = at + size, n + 1
    return jobs, rows


@pytest.mark.parametrize("seed", range(4))
def test_any_chunking_gives_the_same_lines(spark, seed):
    jobs, rows = random_chunks(seed)
    df = spark.createDataFrame(rows, "job_id long, chunk_no long, bytes binary")
    got = sorted(tuple(r) for r in J.assemble_lines(df).collect())
    assert got == expected_lines(jobs)


CHUNKS = "job_id long, chunk_no long, bytes binary, at timestamp, part long"


def lines_of(spark, rows, parts, **options):
    """Lines of a stream whose rows come part by part, and the folder of its state."""
    df = spark.createDataFrame(rows, CHUNKS)
    source, folders = C.work_folder(spark, "t4"), C.new_folders(spark, "t4")
    for n in range(parts):
        df.where(F.col("part") == n).drop("part").write.mode("append").parquet(source)
        C.run_to_end(SJ.line_stream(C.read_stream(spark, source, df.drop("part").schema), **options), "append", "t4", lambda b: b, folders)
    found = C.written(spark, folders[0], SJ.LINES).drop("batch").collect()
    return sorted((r.job_id, r.line_no, r.line, r.gap) for r in found), folders[1]


def state_rows(spark, folder, name, **options):
    reader = spark.read.format("statestore").option("stateVarName", name)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(folder).count()


def test_line_stream_takes_chunks_in_any_order(spark):
    jobs, rows = random_chunks(9)
    random.Random(0).shuffle(rows)
    rows = [(*r, datetime(2024, 1, 1), 2 * i // len(rows)) for i, r in enumerate(rows)]
    got, _ = lines_of(spark, rows, 2)
    assert got == [(*x, False) for x in expected_lines(jobs)]


def test_line_stream_gives_up_gaps_and_ended_jobs(spark):
    at = lambda minute: datetime(2024, 1, 1, 10 + minute // 60, minute % 60)
    rows = [(1, 0, b"a\nb", at(0), 0), (1, 2, b"c\nd\n", at(1), 0), (1, 3, b"e\n", at(2), 0),  # chunk 1 never comes
            (2, 0, b"x\ny\n", at(0), 0), (2, 2, b"z\n", at(1), 0), (2, 1, b"late ", at(3), 1),  # chunk 1 comes in time
            (3, 0, b"p\nunended", at(2), 0), (9, 0, b"clock\n", at(7), 1), (9, 1, b"clock\n", at(100), 2), (9, 2, b"clock\n", at(300), 3)]
    got, state = lines_of(spark, rows, 4, gap_seconds=300, idle_seconds=3600)
    assert [r for r in got if r[0] == 1] == [(1, 1, "a", False), (1, 2, "b", True), (1, 3, "c", False), (1, 4, "d", False), (1, 5, "e", False)]
    assert [r for r in got if r[0] == 2] == [(2, 1, "x", False), (2, 2, "y", False), (2, 3, "late z", False)]
    assert [r for r in got if r[0] == 3] == [(3, 1, "p", False)]
    # the watermark is past the end of jobs 1, 2 and 3: only the clock job is left, and nothing waits
    assert state_rows(spark, state, "progress") == 1 and state_rows(spark, state, "early", flattenCollectionTypes="true") == 0


def test_late_rows_are_dropped_by_the_watermark(spark):
    t = lambda s: f"timestamp_ntz'2024-01-01 {s}'"
    early = spark.sql(f"SELECT 1L AS user_id, {t('10:00:00')} AS ts, 0 AS part UNION ALL SELECT 1L, {t('12:00:00')}, 0")
    late = spark.sql(f"SELECT 1L AS user_id, {t('10:00:01')} AS ts, 1 AS part UNION ALL SELECT 1L, {t('12:00:01')}, 1")
    out = C.run_arrivals(early.unionByName(late), "part", [1], "late", SS.tick_counts, "update", lambda b: b)
    rows = C.written(spark, out, "tick timestamp, user_id bigint, requests bigint").groupBy("tick").agg(F.max("requests").alias("n")).orderBy("tick").collect()
    assert [r.n for r in rows] == [1, 2]


def test_gate_keeps_late_rows_apart(spark, tmp_path):
    """Late rows are kept and counted; a batch that runs again changes nothing; a row without a time is late."""
    t = lambda s: None if s is None else datetime(2024, 1, 1, *map(int, s.split(":")))
    batch = lambda *rows: spark.createDataFrame([(i, t(s)) for i, s in rows], "i long, ts timestamp")
    gate = L.Gate(spark, str(tmp_path / "gate"), delay=60, window=15)
    assert gate.late_rows("i long, ts timestamp").count() == 0
    first, second = batch((1, "10:00:00"), (2, "09:00:00")), batch((3, "09:58:59"), (4, "09:58:44"), (5, None), (6, "11:00:00"), (7, "09:59:05"))
    gate.take(first, 0)
    for _ in range(2):
        gate.take(second, 1)
    gate.take(batch(), 2)
    gate.take(batch((8, "10:59:00"), (9, "10:58:30")), 3)
    assert sorted((r.batch, r.i) for r in gate.late_rows("i long, ts timestamp").collect()) == [(1, 3), (1, 4), (1, 5), (3, 9)]
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "gate" / "in-time")).collect()) == [1, 2, 6, 7, 8]


def test_status_rollup(spark):
    steps = spark.createDataFrame([
        (1, 1, 10, "start", None), (1, 2, 20, "exit", 0), (2, 1, 10, "start", None), (2, 2, 30, "exception", None), (3, 1, 5, "start", None),
        (3, 2, 6, "cancel", None), (4, 1, 1, "start", None), (5, 1, 1, "exit", 3)], "job_id long, seq long, at long, step string, code long")
    got = {r.job_id: (r.startedAt, r.finishedAt, r.status, r.code) for r in J.status_rollup(steps).collect()}
    assert got == {1: (10, 20, "completed", 0), 2: (10, 30, "failed", -1), 3: (5, None, "cancelled", None), 4: (1, None, "running", None), 5: (None, 1, "failed", 3)}


def test_artifacts_report_folder_and_missing_kinds(spark):
    rows = [(1, 3, "/p/build/reports/tests/a/x.html", 5), (1, 2, "/p/build/reports/tests/y.css", 7), (1, 1, "/p/a.apk", 9), (1, 4, "/p/a.apk", 9), (1, 5, "/p/mapping.txt.bak", 1)]
    found = J.artifacts(spark.createDataFrame(rows, "job_id long, pos long, path string, length long"))
    got = {r.kind: (r.path, r.size) for r in J.first_artifacts(found, spark.createDataFrame([(1,)], "job_id long")).collect()}
    assert got == {"apk": ("/p/a.apk", 9), "aab": ("", 0), "mapping": ("", 0), "test-report": ("/p/build/reports/tests", 12)}


def test_log_page_edges(spark):
    logs = spark.createDataFrame([(1, "aé漢z".encode())], "job_id long, content binary")
    ask = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 100, 5), (1, 0, -1), (2, 7, 5)], "job_id long, from_byte long, max_bytes long")
    got = sorted((r.job_id, r.text, r.nextOffset) for r in J.log_page(ask, logs).collect())
    assert got == [(1, "", 0), (1, "", 100), (1, "a", 2), (1, "漢", 6), (2, "", 7)]


@pytest.mark.parametrize("page", [3, 64, 100_000])
def test_log_index_gives_the_same_pages(spark, page):
    """Any chunks, any pages: the same as cutting the whole log; repeated requests, jobs without a log, odd starts and sizes."""
    jobs, rows = random_chunks(7)
    jobs[2] = jobs[2] + "漢字\n".encode() * 40
    rows = [r for r in rows if r[0] != 2] + [(2, n, jobs[2][7 * n : 7 * n + 7]) for n in range(-(-len(jobs[2]) // 7))] + [(2, 999, None)]
    index = LI.LogIndex.build(spark.createDataFrame(rows, "job_id long, chunk_no long, bytes binary"), page=page, buckets=4)
    rnd = random.Random(page)
    asked = [(rnd.choice([0, 1, 2, 3, 77]), rnd.randrange(-5, 400), rnd.choice([0, -1, 1, 5, 64, 300, 10**9, None])) for _ in range(80)]
    asked += asked[:5]
    ask = spark.createDataFrame(asked, "job_id long, from_byte long, max_bytes long")
    logs = spark.createDataFrame(list(jobs.items()), "job_id long, content binary")
    rows_of = lambda df: sorted((r.job_id, r.text, r.nextOffset) for r in df.collect())
    assert rows_of(index.pages(ask)) == rows_of(J.log_page(ask.na.fill(0), logs))


def test_log_index_does_not_move_the_log(spark):
    rows = [(job, n, b"x" * 5000) for job in range(3) for n in range(40)]
    index = LI.LogIndex.build(spark.createDataFrame(rows, "job_id long, chunk_no long, bytes binary"), page=8192, buckets=8)
    ask = spark.createDataFrame([(1, 50, 10)], "job_id long, from_byte long, max_bytes long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.pages(ask)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the scan of the index up to its join the log is filtered and sorted, never exchanged
    side = plan[: plan.index("Bucketed: true")].splitlines()
    scan = len(side[-1]) - len(side[-1].lstrip(" :+-"))
    above = []
    for line in reversed(side[:-1]):
        if (at := len(line) - len(line.lstrip(" :+-"))) < scan:
            scan = at
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)


@pytest.mark.parametrize("text,want", [("6", (0, 6, 6, False)), ("1-5", (0, 1, 5, False)), (":5", (0, 1, 4, False)), ("~2/1-5", (2, 1, 5, False)), ("~10:", (10, 1, None, False)), ("", (0, 1, None, True))])
def test_history_ranges(text, want):
    assert H.parse_range(text) == want


def test_history_rejects_other_text():
    with pytest.raises(ValueError):
        H.parse_range("a-b")


def test_eviction_and_reset(spark):
    sessions = spark.createDataFrame([(u, u * 10) for u in range(7)], "user_id long, created_at long")
    assert sorted(r.user_id for r in R.live_after_eviction(sessions).where("live").collect()) == [3, 4, 5, 6]
    rows = [(1, n, n % 3 == 0) for n in range(1, 40)]
    got = R.conditional_resets(spark.createDataFrame(rows, "user_id long, n long, flag boolean"), F.col("flag"), after=10)
    assert sorted(r.n for r in got.collect()) == [12, 24, 36]


def test_scan_code_files(spark, tmp_path):
    root = tmp_path / "build"  # the root's own name does not count
    for name, data in {"src/A.JAVA": b"class A {}", "src/b.txt": b"", "node_modules/c.js": b"", "src/Build/d.py": b"x = 1", "src/.venv/e.py": b"", "bad.rs": b"\xff"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files = CF.scan_code_files(spark, str(root))
    assert sorted((os.path.relpath(r.path, root), r.language) for r in files.collect()) == [("bad.rs", "rust"), ("src/A.JAVA", "java"), ("src/Build/d.py", "python")]
    good, bad = CF.readable(files)
    assert good.count() == 2 and [os.path.basename(r.path) for r in bad.collect()] == ["bad.rs"]


def test_scan_never_opens_what_is_skipped(spark, tmp_path):
    """A pipe would block whoever opens it; a link back to the root would never end."""
    deep = tmp_path / "src" / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (deep / "x.rs").write_bytes(b"fn x() {}")
    (tmp_path / "node_modules" / "p").mkdir(parents=True)
    os.mkfifo(tmp_path / "node_modules" / "p" / "poison.js")
    os.mkfifo(tmp_path / "src" / "pipe.js")  # no regular file
    (tmp_path / "src" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "src" / "link.py").symlink_to(deep / "x.rs")
    seen = walk.walk(spark, f"file://{tmp_path}", CF.enters, CF.is_code)
    assert sorted(r.path.removeprefix(f"file://{tmp_path}/") for r in seen.collect()) == ["src/a/b/c/x.rs", "src/link.py"]
    assert sorted(bytes(r.content) for r in CF.scan_code_files(spark, str(tmp_path)).collect()) == [b"fn x() {}"] * 2
    with pytest.raises(FileNotFoundError):
        CF.scan_code_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        CF.scan_code_files(spark, "ftp://host/code")
    (tmp_path / "empty").mkdir()
    assert CF.scan_code_files(spark, str(tmp_path / "empty")).count() == 0


def test_read_logs_and_listing(spark, tmp_path):
    (tmp_path / "j1").mkdir()
    (tmp_path / "j1" / "build.log").write_bytes(b"hello")
    (tmp_path / "j1" / "app.apk").write_bytes(b"12345678")
    assert [(r.job_id, bytes(r.content)) for r in S.read_logs(spark, str(tmp_path)).collect()] == [("j1", b"hello")]
    assert sorted((os.path.basename(r.path), r.length) for r in S.read_listing(spark, str(tmp_path)).collect()) == [("app.apk", 8), ("build.log", 5)]


def test_snapshot_restore_skips_what_is_broken(spark, tmp_path):
    folder = str(tmp_path / "ws")
    kept = D.snapshot({"a": spark.range(3), "_b": spark.range(1), "exit": spark.range(1), "c": spark.range(5)}, folder)
    assert kept == ["a", "c"]
    for f in (tmp_path / "ws" / "data" / D.content_name(spark.range(5))).glob("*.parquet"):
        f.write_bytes(b"broken")
    tables, lost = D.restore(spark.newSession(), folder)
    assert list(tables) == ["a"] and tables["a"].count() == 3 and lost == ["c"]
    assert D.restore(spark, str(tmp_path / "none")) == ({}, [])


def test_snapshots_write_only_what_changed(spark, tmp_path):
    folder, own = str(tmp_path / "ws"), spark.newSession()
    written = lambda: sorted(p.name for p in (tmp_path / "ws" / "data").iterdir())
    rows = own.createDataFrame([(None, 1), (2, None), (2, None)], "x int, y int")
    D.snapshot({"a": own.range(3), "b": rows, "same": rows.orderBy("x")}, folder)
    first = written()
    assert len(first) == 2  # equal tables share their files
    tables, _ = D.restore(own, folder)
    D.snapshot({**tables, "a": own.range(4)}, folder)
    assert len(written()) == 3 and set(first) < set(written()) and D.versions(own, folder) == [1, 2]
    assert D.restore(own, folder)[0]["a"].count() == 4 and D.restore(own, folder, 1)[0]["a"].count() == 3
    swapped = own.createDataFrame([(1, None), (2, None), (2, None)], "x int, y int")
    assert D.content_name(swapped) != D.content_name(rows) == D.content_name(rows.repartition(3))
    torn = tmp_path / "ws" / "_manifest" / "v=3"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert D.restore(own, folder)[0]["a"].count() == 4
    D.snapshot({"a": own.range(5)}, folder)
    assert D.restore(own, folder)[0]["a"].count() == 5


def test_workspaces_do_not_share_views(spark):
    one, two = spark.newSession(), spark.newSession()
    D.save(one.range(2), "mine")
    assert not two.catalog.tableExists("mine")


def test_local_tables(spark):
    assert S.from_local(spark, [{"a": 1}, {"a": 2}]).count() == 2
    with pytest.raises(ValueError):
        S.from_local(spark, 5)
