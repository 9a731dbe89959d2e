"""Packing documents into sequences by harmonic classes, every worker on its own rows, without a shuffle.

A document of up to ``capacity`` ids belongs to class k if it has more than capacity/(k+1) and at most capacity/k ids; any k
documents of the class fit into one sequence, so a sequence of class k is done when it holds k of them. Documents of at most
capacity/CLASSES ids share one class, filled until the next does not fit. What a finished sequence leaves open is filled
with parts of documents kept in reserve for being cut, so that sequences end full. The reserve of a worker always holds at
least as many ids as are open; what it has left in the end is cut into full sequences, and the very last ids into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import IDS, byte_encoder

CAPACITY = 2048
#: Classes of a worker; the last one takes all shorter documents.
CLASSES = 32
#: Ids that wait to be filled in before documents are cut, and that are kept in reserve at most before another document is
#: placed whole, both in sequences. They bound a worker's memory, beside its longest document.
WAITING, RESERVE = 16, 64
END_ID = 1
SCHEMA = "row_id long, doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Sequences of one worker. ``put(row, ids, start, sequence, offset)`` takes each placed part."""

    def __init__(self, put: Callable, capacity: int = CAPACITY):
        self.put, self.capacity, self.made = put, capacity, 0
        self.open: dict[int, list[tuple]] = {}  # documents of the sequence that each class is filling
        self.filled: dict[int, int] = {}
        self.gaps: list[tuple[int, int, int]] = []  # ids missing, sequence, offset
        self.reserve: list[tuple] = []  # documents to be cut: (row, ids, start)
        self.missing = self.spare = 0

    def add(self, row, ids: np.ndarray) -> None:
        size, enough = len(ids), self.missing + self.capacity
        if self.spare < (max(enough, RESERVE * self.capacity) if size > self.capacity else enough):
            self.reserve.append((row, ids, 0))
            self.spare += size
        else:
            whole = size - size % self.capacity
            for at in range(0, whole, self.capacity):
                self.close([(row, ids[at : at + self.capacity], at)])
            if whole < size:
                self.place(row, ids[whole:], whole)
        if self.missing >= WAITING * self.capacity:
            self.pour()

    def place(self, row, ids: np.ndarray, start: int) -> None:
        kind = min(self.capacity // len(ids), CLASSES)
        if kind == CLASSES and self.filled.get(kind, 0) + len(ids) > self.capacity:
            self.close(self.open.pop(kind))
            self.filled[kind] = 0
        self.open.setdefault(kind, []).append((row, ids, start))
        self.filled[kind] = self.filled.get(kind, 0) + len(ids)
        if kind < CLASSES and len(self.open[kind]) == kind:
            self.close(self.open.pop(kind))
            self.filled[kind] = 0

    def close(self, parts: list[tuple]) -> None:
        """A new sequence of ``parts``; what it lacks waits as a gap, unless its length is a power of two."""
        at = 0
        for row, ids, start in parts:
            self.put(row, ids, start, self.made, at)
            at += len(ids)
        if at < self.capacity and at & (at - 1):
            self.gaps.append((self.capacity - at, self.made, at))
            self.missing += self.capacity - at
        self.made += 1

    def pour(self) -> None:
        """Fills all gaps from the reserve, the longest gaps from the longest documents."""
        self.reserve.sort(key=lambda d: len(d[1]))
        for size, sequence, at in sorted(self.gaps, reverse=True):
            for row, ids, start in self.cut(size):
                self.put(row, ids, start, sequence, at)
                at += len(ids)
        self.gaps, self.missing = [], 0

    def cut(self, size: int) -> list[tuple]:
        """The next ``size`` ids of the reserve."""
        parts = []
        while size:
            row, ids, start = self.reserve.pop()
            if len(ids) > size:
                self.reserve.append((row, ids[size:], start + size))
                ids = ids[:size]
            parts.append((row, ids, start))
            size -= len(ids)
            self.spare -= len(ids)
        return parts

    def finish(self) -> None:
        self.pour()
        for parts in self.open.values():
            self.reserve += parts
            self.spare += sum(len(ids) for _, ids, _ in parts)
        self.open = {}
        self.reserve.sort(key=lambda d: len(d[1]))
        while self.spare:
            self.close(self.cut(min(self.capacity, 1 << (self.spare.bit_length() - 1))))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text, any other columns) and their places: row_id, doc_id, start, length, ids
    (bytes, unsigned 32 bit), doc_tokens, sequence_id, offset.

    A null text is empty; every row ends with ``end_id``, so it has at least one piece. Each id lies in exactly one piece;
    ``start`` counts the ids of the row before it. Repeated rows and rows without an id are documents of their own: row_id
    tells them apart. Sequences hold at most ``capacity`` ids, offsets have no gaps, and each sequence is full or as long as a
    power of two, where ``capacity`` is one. An empty table has no pieces. A partition of ``docs`` is packed by itself: a lost
    one is packed again from the same rows; where ``docs`` comes out of a shuffle, whose rows may arrive in another order,
    write it first.
    """
    if capacity < CLASSES or capacity & (capacity - 1):
        raise ValueError(f"capacity must be a power of two of at least {CLASSES}")
    names = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                       ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = byte_encoder(path), []
        end, base = np.array([end_id], IDS), TaskContext.get().partitionId() << 40

        def put(row, ids, start, sequence, offset):
            row_id, doc_id, total = row
            rows.append((row_id, doc_id, start, len(ids), ids.tobytes(), total, base + sequence, offset))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.types)], schema=names)

        packer = Packer(put, capacity)
        for batch in batches:
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.concatenate([encode(text or ""), end])
                packer.add((row_id, doc_id, len(ids)), ids)
                if len(rows) >= 2000:
                    yield batch_of(rows)
                    rows.clear()
        packer.finish()
        for at in range(0, len(rows), 2000):
            yield batch_of(rows[at : at + 2000])

    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each whole sequence; a sequence has a bounded number of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
