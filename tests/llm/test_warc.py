import gzip
import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import warc

BIG = "<html>" + "x" * 1200
PAGES = [
    (1, "https://www.A.example.com/b?q=1#top", BIG), (2, "http://a.example.com/", BIG), (9, None, BIG), (3, "http://b.org", "small"), (4, "http://b.org", "small"),
    (5, "http://c.org/x\r\ny", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" + "é🙂" * 300), (6, "http://c.org", None), (7, "", ""), (8, "http://d.org", "\r\n\r\n"),
    (None, "http://e.org", BIG), (6, "http://c.org", None),
]
SCHEMA = "page_id long, url string, html string, run string"


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], SCHEMA)
    rows = warc.archive_pages(pages).collect()
    assert len(rows) == len(PAGES)
    html = {}
    for page, _, text in PAGES:
        html[page] = (text or "").encode()
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        revisit = r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
        assert r.stored_bytes == (0 if revisit else r.payload_bytes)
    order = sorted(rows, key=lambda r: r.position)
    keys = [(r.url_key, r.captured_at) for r in order]
    assert [r.position for r in order] == list(range(len(PAGES)))
    assert keys == sorted(keys) and ("com,example,a)/b?q=1", 1577836860) in keys


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_archives(spark):
    """Many archives, runs, blocks and ranges, one URL with most captures: the order is global, nothing is lost."""
    pages = spark.range(500).selectExpr("id as page_id", "if(id % 4 > 0, 'http://hot.org', 'http://h' || id % 3 || '.org/' || id % 7) as url",
                                        "repeat('p', cast(id % 50 as int)) as html")
    runs = warc.read_runs(spark, warc.write_archives(pages, per_file=20), run=30, block=4)
    assert runs.select("run").distinct().count() > 16 and runs.selectExpr("max(size(entries))").first()[0] == 4
    rows = sorted(warc.histories(runs, per_range=40).collect(), key=lambda r: r.position)
    keys = [(r.url_key, r.captured_at, r.page_id) for r in rows]
    assert keys == sorted(keys) and sorted(k[2] for k in keys) == list(range(500)) and [r.position for r in rows] == list(range(500))
    assert len({r.range for r in rows}) > 5 and len({r.range for r in rows if r.url_key == "org,hot)/"}) > 3


def test_dates_come_from_the_archive(spark):
    pages = spark.createDataFrame([(1, "http://a.org", "x", 5000), (2, "http://a.org", "y", 70), (3, "http://a.org", "z", None), (2**62, "http://a.org", "", 1)],
                                  "page_id long, url string, html string, taken long")
    rows = sorted(warc.archive_pages(pages, F.col("taken")).collect(), key=lambda r: r.position)
    assert [(r.page_id, r.captured_at) for r in rows] == [(2**62, 1), (2, 70), (1, 5000), (3, 1577836980)]
    assert warc.archive_pages(pages).count() == 4


def stored(payload, page=1):
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Date: 2021-03-04T05:06:07Z\r\nWARC-URL-Key: org,a)/\r\n"
            f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}\r\nContent-Length:{len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def test_a_member_per_record(spark, tmp_path):
    """Every member of an archive is read, and payloads need not be UTF-8."""
    payloads = [b"\xff\xfe\r\n", b"", b"\r\n\r\n\r\n", b"a\r\n\r\nWARC/1.1\r\n\r\nb\r\n", b"\r", b"\n\r\n", b"end\r\n"]
    (tmp_path / "in.warc.gz").write_bytes(b"".join(gzip.compress(stored(p, k)) for k, p in enumerate(payloads)))
    rows = warc.histories(warc.read_runs(spark, str(tmp_path))).orderBy("position").collect()
    assert [(r.page_id, r.payload_bytes, r.captured_at) for r in rows] == [(k, len(p), 1614834367) for k, p in enumerate(payloads)]


def test_very_long_page(spark):
    long = "0123456789é\r\n\r\n" * 3_200_000  # 51 MB
    rows = warc.archive_pages(spark.createDataFrame([(1, "http://a.org", long), (2, "http://a.org", "short")], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_digest) for r in rows} == {(1, hashlib.sha1(long.encode()).hexdigest()), (2, hashlib.sha1(b"short").hexdigest())}


@given(st.lists(st.lists(st.sampled_from([b"\r\n", b"\r", b"\n", b"x", b"\xff"])), max_size=6))
def test_pieces(payloads):
    payloads = [b"".join(p) for p in payloads]
    pieces = b"".join(map(stored, payloads)).split(b"\r\n\r\n")
    assert [(size, digest) for _, size, digest in warc.parse(pieces)] == [(len(p), hashlib.sha1(p).hexdigest()) for p in payloads]


@pytest.mark.parametrize("broken", [stored(b"abc")[:-6] + b"\r\n\r\n", stored(b"abc").replace(b"abc", b"abcd"), b"WARX/1.1\r\n\r\n"])
def test_broken_archives_fail(broken):
    with pytest.raises(ValueError):
        list(warc.parse(broken.split(b"\r\n\r\n")))


@given(st.lists(st.lists(st.integers(0, 30)), max_size=9), st.integers(1, 4))
def test_loser_tree(runs, block):
    """Blocks of several runs in the order of their first entries; no more than a block a run and equal ones are open."""
    entries = [sorted((f"u{x // 4:02}", x % 4, None if x % 5 == 0 else x) for x in r) for r in runs]
    entries = [sorted(r, key=warc.place) for r in entries]
    blocks = sorted((r[k : k + block] for r in entries for k in range(0, len(r), block)), key=lambda b: warc.place(b[0]))
    assert list(map(warc.place, warc.merge(blocks))) == sorted(warc.place(e) for r in entries for e in r)
