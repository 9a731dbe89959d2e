"""Chunks that lie side by side move as one."""

import pyarrow as pa

from tallyloom.operators import joblog as J


def test_chunks_side_by_side_become_one():
    job = pa.array([1, 1, 1, 2, 2, None, None, 2, 2, 1])
    batch = pa.RecordBatch.from_arrays([job, pa.array([0, 1, 3, 4, 5, 6, 7, 6, 6, 7]), pa.array([b"a\n", b"", b"b", b"c", None, b"d", b"e", b"f", b"g", b"h"])], names=["job_id", "chunk_no", "bytes"])
    want = [(1, 0, b"a\n"), (1, 3, b"b"), (2, 4, b"c"), (None, 6, b"d"), (None, 7, b"e"), (2, 6, b"f"), (2, 6, b"g"), (1, 7, b"h")]
    rows = lambda batches: [tuple(r.values()) for b in batches for r in b.to_pylist()]
    assert rows(J._side_by_side(iter([batch]))) == want
    assert rows(J._side_by_side(iter([batch.slice(1, 6), batch.slice(0, 0)]))) == [(1, 1, b""), *want[1:5]]


def test_few_rows_move(spark, monkeypatch):
    """A log cut into many small chunks is joined and grouped as few rows; its lines stay the same, for keys of text too."""
    kept = []
    monkeypatch.setattr(J, "stash", lambda df, label: kept.append(J_STASH(df, label)) or kept[-1])
    logs = [(f"j{k}", "".join(f"line {n} of {k} ü\n" for n in range(300)) + "unended") for k in range(20)]
    chunks = J.cut_chunks(spark.createDataFrame(logs, "job_id string, text string"), size=7)
    lines = J.assemble_lines(chunks)
    got = sorted((r.job_id, r.line_no, r.line) for r in lines.collect())
    assert got == sorted((j, n, x) for j, text in logs for n, x in enumerate(text.split("\n")[:-1], 1))
    assert kept[0].count() * 100 < chunks.count()


J_STASH = J.stash
