"""Web archives: writing pages as WARC records, reading them back, and capture histories by an external index merge.

Records are UTF-8 text, so Spark's own text writer writes the archives, compressed, and its commit protocol covers lost
executors. Spark's text reader gives them back as a stream of pieces between blank lines, which are put together again by
Content-Length: payloads may hold anything, archives may be of any size and may have a compressed member per record.

A task sorts the index entries that it reads by URL key and time, a bounded number at a time; each of these runs is written to
the shared folder in blocks. Blocks are cut where ranges of keys end, and each range is merged by a loser tree over the runs
that have a block open. Spark brings the blocks in the order of their first keys, so a block is opened when the merge has come
to its first key, and what is held is the open blocks alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import stash
from tallyloom.session import work_folder

#: Payloads from this size on are written once.
LEAST_BYTES = 1000
#: Records per archive.
PER_FILE = 2000
#: Entries that a task sorts at a time, entries of a block, and entries that a range should have.
RUN, BLOCK, PER_RANGE = 50_000, 250, 100_000
#: Most ranges, so that their borders, one key each, are few enough for every task.
MOST_RANGES = 20_000
END = "\r\n\r\n"
EPOCH = 1_577_836_800  # 2020-01-01, the time of page 0; each page is a minute later
#: Index entry of a record.
ENTRY = ("url_key string, captured_at long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "stored_bytes long")
FIELDS = [f.split() for f in ENTRY.split(", ")]
ARROW = pa.struct([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in FIELDS])
#: Key of an entry, or of the first entry of a block.
KEY = "url_key string, captured_at long, no_page boolean, page_id long"
BLOCKS = f"run long, {KEY}, entries array<struct<{', '.join(f'{n}: {k}' for n, k in FIELDS)}>>"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, then path and query, in lower case; '' for null."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(plain, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(plain, r"^[^/?#]*", ""), r"#.*$", "")
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ",")
    return F.concat(labels, F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def with_decisions(pages: DataFrame, least: int = LEAST_BYTES, at: Column | None = None) -> DataFrame:
    """page_id, url, html (null: empty), captured_at (``at``, or ``usual_time``), payload_bytes, payload_digest and refers_to: the largest page_id with an equal
    payload of at least ``least`` bytes, null for that page itself and for smaller payloads. Pages without an id are
    responses. Only digests move for the grouping; copies are counted before the shuffle."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                        F.coalesce(*([] if at is None else [at]), usual_time(F.col("page_id"))).cast("long").alias("captured_at"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    large = F.col("payload_bytes") >= least
    copies = (
        rows.where(large).groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).where("n > 1")
        .select(F.col("payload_digest").alias("digest"), "keeper")
    )
    same = large & (F.col("payload_digest") == F.col("digest"))
    return rows.join(copies, same, "left").withColumn(
        "refers_to", F.when(F.col("page_id") != F.col("keeper"), F.col("keeper"))).drop("digest", "keeper")


def usual_time(page_id: Column) -> Column:
    """Seconds since 1970 at which a page without a time counts as captured: a minute after the page before it, the first
    of 2020 for page 0 and for pages without an id. Ids beyond a thousand million start over, so years have four digits."""
    return F.lit(EPOCH) + F.coalesce(F.pmod(page_id, F.lit(1_000_000_000)), F.lit(0)) * 60


def record(row: DataFrame) -> DataFrame:
    """Column ``value``: the WARC record of each row of ``with_decisions`` with captured_at, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")  # a header is one line
    return row.select(F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", target),
        line("WARC-URL-Key", url_key(target)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", uri(F.col("refers_to"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    ).alias("value"))


def write_archives(pages: DataFrame, per_file: int = PER_FILE, at: Column | None = None) -> str:
    """Writes a record per page and returns the folder of the archives, below the shared checkpoint folder."""
    folder = work_folder(pages.sparkSession, "warc")
    decided = with_decisions(pages, at=at)
    record(decided).write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)
    return folder


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], int, str]]:
    """Headers, stored length and SHA-1 of the payload of each record of one archive, given as what is between its blank
    lines. What doesn't follow the format fails loudly. Of a payload only one piece is held."""
    headers, end = None, END.encode()
    for piece in pieces:
        data = piece + end
        while data:
            if headers is None:
                if data == end:  # nothing but blank lines, as after the last record
                    break
                first, *lines = data[:-4].split(b"\r\n")
                if not first.startswith(b"WARC/"):
                    raise ValueError(f"no record begins with {first[:40]!r}")
                headers = {name: value.strip() for name, _, value in (x.partition(b":") for x in lines)}
                size = left = int(headers[b"Content-Length"])
                digest, after, data = hashlib.sha1(), b"", b""
                continue
            body = data[:left] if left < len(data) else data
            digest.update(body)
            data, left = data[len(body) :], left - len(body)
            if not left and data:
                need = 4 - len(after)  # a payload that ends with a line end shifts where the pieces are cut
                after, data = after + data[:need], data[need:]
                if not end.startswith(after):
                    raise ValueError(f"record {headers.get(b'WARC-Record-ID')!r} is longer than it says")
                if len(after) == 4:
                    yield headers, size, digest.hexdigest()
                    headers = None
    if headers is not None:
        raise ValueError(f"record {headers.get(b'WARC-Record-ID')!r} is cut off")


NUMBER = re.compile(rb"<urn:page:(-?\d+)>")


def number(uri: bytes | None) -> int | None:
    found = NUMBER.match(uri or b"")
    return int(found[1]) if found else None


def entry(headers: dict[bytes, bytes], size: int, digest: str) -> tuple:
    """Index entry of a record. Digest and size of a response are taken from the payload that was read and must agree with
    its headers; a revisit states those of the payload that it refers to."""
    kind = headers[b"WARC-Type"].decode()
    stated = headers[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if kind == "response" and digest != stated:
        raise ValueError(f"digest of {headers[b'WARC-Record-ID']!r} is wrong")
    return (headers[b"WARC-URL-Key"].decode(), int(datetime.fromisoformat(headers[b"WARC-Date"].decode()).timestamp()),
            number(headers[b"WARC-Record-ID"]), kind, number(headers.get(b"WARC-Refers-To")),
            size if kind == "response" else int(headers[b"WARC-Refers-To-Length"]), stated, size)


def place(e: tuple) -> tuple:
    """What entries are ordered by: URL key, time, page; entries without a page come last."""
    return e[0], e[1], e[2] is None, e[2] or 0


def block_batch(blocks: list[list[tuple]], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """Blocks as rows: their first keys and their entries, after the columns ``extra``."""
    ends = [0]
    for b in blocks:
        ends.append(ends[-1] + len(b))
    columns = list(zip(*chain.from_iterable(blocks)))
    entries = pa.StructArray.from_arrays([pa.array(c, ARROW.field(k).type) for k, c in enumerate(columns)], fields=list(ARROW))
    heads = [b[0] for b in blocks]
    return pa.RecordBatch.from_pydict(extra | {
        "url_key": pa.array([h[0] for h in heads], pa.string()), "captured_at": pa.array([h[1] for h in heads], pa.int64()),
        "no_page": pa.array([h[2] is None for h in heads], pa.bool_()), "page_id": pa.array([h[2] for h in heads], pa.int64()),
        "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)})


def blocks_of(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Entries of each block of a batch."""
    for lists in batch.column("entries"):
        yield list(zip(*(lists.values.field(k).to_pylist() for k in range(len(FIELDS)))))


def read_runs(spark: SparkSession, folder: str, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The index of all archives below ``folder``, written as sorted runs: blocks of at most ``block`` entries with the
    number of their run and their first key. A task sorts ``run`` entries at a time."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((p, v.as_py()) for b in batches for p, v in zip(b.column(0).to_pylist(), b.column(1)))
        held, name, made = [], "", 0

        def sorted_run() -> pa.RecordBatch:
            held.sort(key=place)
            number = int.from_bytes(hashlib.sha1(f"{name} {made}".encode()).digest()[:8], "big", signed=True)
            cut = [held[k : k + block] for k in range(0, len(held), block)]
            return block_batch(cut, {"run": pa.array([number] * len(cut), pa.int64())})

        for name, archive in groupby(pieces, key=lambda x: x[0]):
            for found in parse(v for _, v in archive):
                held.append(entry(*found))
                if len(held) == run:
                    yield sorted_run()
                    held, made = [], made + 1
        if held:
            yield sorted_run()

    lines = spark.read.option("lineSep", END).text(folder)
    pieces = lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    return stash(pieces.mapInArrow(runs, BLOCKS), "runs")


class LoserTree:
    """Open blocks in a tournament: an inner node keeps the block that lost there, so the next entry costs one comparison
    per level. Opening blocks builds the tree anew."""

    def __init__(self):
        self.heads, self.losers, self.best = [], [], 0

    def open(self, blocks: Iterable[Iterable[tuple]]) -> None:
        """Adds blocks, each in order; those that have ended leave."""
        fresh = [iter(b) for b in blocks]
        self.heads = [h for h in self.heads if h[0] is not None] + [[(e := next(i, None)), e and place(e), i] for i in fresh]
        k = len(self.heads)
        winners = [0] * k + list(range(k))
        self.losers = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._before(b, a) else (a, b)
        self.best = winners[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x[0] is not None and (y[0] is None or x[1] < y[1])

    def upto(self, limit: tuple | None) -> Iterator[tuple]:
        """Entries in order, those before the key ``limit`` or all."""
        while self.heads:
            head = self.heads[self.best]
            if head[0] is None or (limit is not None and head[1] >= limit):
                return
            yield head[0]
            head[0] = e = next(head[2], None)
            head[1] = e and place(e)
            best, node = self.best, (self.best + len(self.heads)) // 2
            while node:
                if self._before(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node //= 2
            self.best = best


def merge(blocks: Iterable[list[tuple]]) -> Iterator[tuple]:
    """All entries in order, from blocks that are sorted within and come by their first entries."""
    tree = LoserTree()
    for _, together in groupby(blocks, key=lambda b: place(b[0])):
        together = list(together)
        yield from tree.upto(place(together[0][0]))
        tree.open(together)
    yield from tree.upto(None)


def histories(runs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """The entries of ``runs`` with ``range`` and ``position``, their place from 0 in the global order of URL key, time and page.

    Ranges are about equal in size and also split a URL with many captures. Their borders are found among the first keys of
    blocks; tasks get at most ``MOST_RANGES`` of them, and their choice changes no position. Only index entries move."""
    keys = [name.split()[0] for name in KEY.split(", ")]
    total = runs.agg(F.sum(F.size("entries"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // per_range)))
    firsts = runs.select(*keys).repartitionByRange(ranges, *keys).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys)).alias("key"))
    borders = sorted((k[0], k[1], k[2], k[3] or 0) for k, in firsts.select("key").collect())[1:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(number, list(part)) for block in blocks_of(batch) for number, part in groupby(block, key=lambda e: bisect_right(borders, place(e)))]
            if parts:
                yield block_batch([p for _, p in parts], {"range": pa.array([n for n, _ in parts], pa.int32())})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (x for b in batches for x in zip(b.column("range").to_pylist(), blocks_of(b)))
        for number, inside in groupby(blocks, key=lambda x: x[0]):
            entries, at = merge(b for _, b in inside), 0
            while rows := [e for _, e in zip(range(5000), entries)]:
                columns = [pa.array(c, ARROW.field(k).type) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(rows), pa.int32()), pa.array(range(at, at + len(rows)), pa.int64())],
                                                 names=[*ARROW.names, "range", "position"])
                at += len(rows)

    parts = runs.mapInArrow(cut, BLOCKS.replace("run long", "range int"))
    ordered = parts.repartition("range").sortWithinPartitions("range", "url_key", "captured_at", "no_page", "page_id")
    found = stash(ordered.mapInArrow(merged, f"{ENTRY}, range int, position long"), "histories")
    sizes = sorted(tuple(r) for r in found.groupBy("range").count().collect())
    starts = [(number, sum(n for _, n in sizes[:k])) for k, (number, _) in enumerate(sizes)]
    start = F.broadcast(runs.sparkSession.createDataFrame(starts, "range int, start long"))
    return found.join(start, "range").select(*ARROW.names, "range", (F.col("start") + F.col("position")).alias("position"))


def archive_pages(pages: DataFrame, at: Column | None = None) -> DataFrame:
    """Capture histories of ``pages`` (page_id, url, html) after a round trip through archives; a row per row of ``pages``.
    ``at`` gives seconds since 1970 of the capture, ``usual_time`` where it is null or not given. Null html is an empty payload,
    a null url an empty one; repeated rows are records of their own, other columns are ignored."""
    return histories(read_runs(pages.sparkSession, write_archives(pages, at=at)))
