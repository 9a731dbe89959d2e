"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

``tokenize`` cuts documents into pieces of token ids, ``place`` gives each piece a sequence and an offset, ``sequences``
joins the ids again. Only lengths move between tasks for the placement, never text or ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import IDS, word_encoder, word_ranks
from tallyloom.llm.common import stash

LIMIT = 4096
#: Pieces that one task packs together. Each group leaves at most a few sequences part full, so more of them cost nothing.
GROUP = 50_000
END_ID = 1


def tokenize(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text): row_id, doc_id, piece, start, length, ids (bytes, unsigned 32 bit).

    A null text is empty; every row ends with ``end_id``, so it has at least one piece. Rows with more than ``limit`` ids
    are cut every ``limit`` ids. Repeated rows are documents of their own: row_id tells them apart.
    """
    schema = "row_id long, doc_id long, piece int, start long, length long, ids binary"
    names = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                       ("length", pa.int64()), ("ids", pa.binary())])

    by_id = word_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, by_id)
        end, width = np.asarray([end_id], IDS).tobytes(), IDS.itemsize
        for batch in batches:
            rows: list[tuple] = []
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(text or "").tobytes() + end
                for k, at in enumerate(range(0, len(ids), limit * width)):
                    part = ids[at : at + limit * width]
                    rows.append((row_id, doc_id, k, at // width, len(part) // width, part))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.types)], schema=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), names.types)], schema=names)

    return docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.

    Each bin takes the longest piece that fits, again and again; then its shortest piece gives way to two unpacked pieces
    that fill the gap, widened by it, more tightly. Works on counts per length: equal pieces are interchangeable.
    """
    count = np.bincount(lengths, minlength=limit + 1)
    sizes = np.arange(limit + 1)
    patterns: list[tuple[list[int], int]] = []  # lengths of a bin, and how many bins look the same

    def longest() -> np.ndarray:
        """For each room: the longest unpacked length that fits, 0 where none does."""
        return np.maximum.accumulate(np.where(count > 0, sizes, 0))

    left = len(lengths)
    below = longest()
    while left:
        room, taken = limit, []
        while room and (size := int(below[room])):
            taken.append(size)
            count[size] -= 1
            room -= size
            if not count[size]:
                below = longest()
        if room and len(taken) > 1:
            gap = room + taken[-1]
            first = np.flatnonzero(count[: gap // 2 + 1])
            first = first[first > 0]
            if len(first):
                second = below[gap - first]
                second = np.where((second == first) & (count[first] < 2), 0, second)
                second = np.where(second > 0, second, -gap)
                best = int(np.argmax(first + second))
                a, b = int(first[best]), int(second[best])
                if b > 0 and a + b > taken[-1]:
                    count[taken.pop()] += 1
                    taken += [b, a]
                    count[b] -= 1
                    count[a] -= 1
                    below = longest()
        need = np.bincount(taken, minlength=limit + 1)
        used = np.flatnonzero(need)
        more = int((count[used] // need[used]).min())  # the same choice would be made again while these lengths last
        more = more if room == 0 else 0
        if more:
            count -= more * need
            below = longest()
        left -= (1 + more) * len(taken)
        patterns.append((taken, 1 + more))
    lists = [(np.tile(taken, n), np.repeat(np.arange(n), len(taken)), np.tile(np.cumsum([0, *taken[:-1]]), n)) for taken, n in patterns]
    base = np.repeat(np.cumsum([0, *[n for _, n in patterns]][:-1]), [n * len(t) for t, n in patterns])
    size = np.concatenate([x[0] for x in lists] or [np.zeros(0, int)])
    bins = np.concatenate([x[1] for x in lists] or [np.zeros(0, int)]) + base
    offset = np.concatenate([x[2] for x in lists] or [np.zeros(0, int)])
    slots, pieces = np.argsort(size, kind="stable"), np.argsort(lengths, kind="stable")
    out_bin, out_offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    out_bin[pieces], out_offset[pieces] = bins[slots], offset[slots]
    return out_bin, out_offset


def place(pieces: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """row_id, piece, sequence_id and offset of each piece (row_id, piece, length of at most ``limit``).

    Pieces are dealt into groups of about ``group`` by a hash, so that no task grows with the input and every group holds
    the same mix of lengths. Within a sequence, offsets have no gaps.
    """
    groups = max(1, -(-pieces.count() // group))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_id", "piece"])
        bins, offsets = best_two_fit(frame["length"].to_numpy(), limit)
        return pd.DataFrame({"row_id": frame["row_id"], "piece": frame["piece"],
                             "sequence_id": frame["part"].to_numpy() * (1 << 32) + bins, "offset": offsets})

    return (
        pieces.select("row_id", "piece", "length", F.pmod(F.xxhash64("row_id", "piece"), F.lit(groups)).alias("part"))
        .groupBy("part").applyInPandas(pack, "row_id long, piece int, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, group: int = GROUP, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces, places) of ``docs`` (doc_id, text, any other columns), both written: ``tokenize`` with the ids, and where
    ``place`` puts each piece. They join on row_id and piece; both are empty for an empty table."""
    pieces = stash(tokenize(docs, path, limit, end_id), "pieces")
    return pieces, stash(place(pieces, limit, group), "places")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each whole sequence; a sequence has at most ``limit`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    packed = pieces.join(places, ["row_id", "piece"])
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
