"""Collocations: phrases whose words meet far more often than their parts would by chance.

Texts become blocks of word numbers, written once. Phrases are counted length by length: one of n words can only be frequent
where both phrases of n - 1 words in it are, so each pass counts the positions that a filter of the frequent shorter phrases
lets through. The filter is a bit map of bounded size; what it lets through wrongly costs a row and changes no count. A task
adds up what it counts in runs of bounded length and deals each run into buckets of compressed phrases and counts; where all
runs of a bucket are together, their counts are added up. How many buckets there are follows the number of words.

The counts then are a stream of (phrase, count) that is laid out twice. In prefix order (word by word) the first k words of a
phrase are the last stream entry of length k before it, in suffix order (from the last word on) so are its last k words. One
walk along each order therefore carries the counts of all left and of all right parts along, however the stream is cut over
tasks; nothing is looked up. One-word extensions hand their count to the two phrases inside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import mix, stash
from tallyloom.operators import ordered as O

LONGEST, LEAST, TOP = 5, 100, 2000
#: A longer phrase swallows one inside it when it has this many hundredths of its count.
SWALLOWS = 100
UNKNOWN = "und"
#: Words of a block.
BLOCK = 400_000
#: Buckets over which the phrases of one first word are spread at most.
SPREAD = 8
#: Phrases of a run, and words of the corpus per bucket.
RUN, PER_BUCKET = 250_000, 2_000_000
BATCH = 20_000
#: Bits of the filter per phrase, and the most bits there are.
BITS, MOST_BITS = 16, 1 << 28
SEGMENT_BITS = 1 << 19
#: A byte no UTF-8 text has: the end of a piece.
END = b"\xff"
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)


class Numbers(dict):
    """Words numbered as they come; the end of a piece is -1."""

    def __init__(self):
        super().__init__({END: -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    seed = xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def extended(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    with np.errstate(over="ignore"):
        return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + following)


def blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """lang, words (each once, in byte order), ids (numbers of the words as they come, the number of words between pieces), both
    compressed, and n, how many words there are. A block ends between texts, so it holds ``size`` words or one text."""
    names = pa.schema([("lang", pa.string()), ("words", pa.binary()), ("ids", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        count = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, ids) in held.items():
                words = list(numbers)[1:]
                order = sorted(range(len(words)), key=words.__getitem__)
                number = np.full(len(words) + 1, len(words), np.uint32)  # the last one is for -1
                number[order] = np.arange(len(words))
                numbered = number[np.concatenate(ids)]
                narrow = numbered.astype("<u2" if len(words) < 1 << 16 else "<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang]), pa.array([packed(b"\n".join(words[k] for k in order))]), pa.array([packed(narrow.tobytes())]),
                    pa.array([int((numbered < len(words)).sum())])], schema=names)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                words = text.translate(FOLDED).replace(END, b" " + END + b" ").split()
                numbers, ids = held.setdefault(lang, (Numbers(), []))
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(np.array([-1], np.int32))
                count += len(words)
                if count >= size:
                    yield from out()
                    count = 0
        yield from out()

    ready = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "lang string, words binary, ids binary, n long")


def packed(data: bytes) -> bytes:
    """Compressed, with the length before it."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def block_of(words: bytes, ids: bytes) -> tuple[list[bytes], np.ndarray]:
    """(words, their numbers in order with -1 between pieces) of a block."""
    text = unpacked(words)
    listed = text.split(b"\n") if text else []
    numbers = np.frombuffer(unpacked(ids), "<u2" if len(listed) < 1 << 16 else "<u4").astype(np.int32)
    numbers[numbers == len(listed)] = -1
    return listed, numbers


class Filter:
    """A set of hashes that may hold more than was put in: two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> np.ndarray:
        return np.stack([hashes & np.uint64(size - 1), (hashes >> np.uint64(32)) & np.uint64(size - 1)])

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, 8 * len(self.bits)):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def filter_of(frequent: DataFrame, count: int) -> np.ndarray:
    """The bit map of the phrases (lang, phrase). It is put together from segments; the driver gets at most MOST_BITS bits."""
    size = 1 << 16
    while size < min(BITS * count, MOST_BITS):
        size *= 2
    segment = min(size, SEGMENT_BITS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            hashes = np.zeros(batch.num_rows, np.uint64)
            for k, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())):
                word = word_hashes(phrase.split(b" "), lang)
                value = word[:1]
                for i in range(1, len(word)):
                    value = extended(value, word[i : i + 1])
                hashes[k] = value[0]
            for at in Filter.places(hashes, size):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        for number, bytes_ in enumerate(bits.reshape(-1, segment // 8)):
            if bytes_.any():
                yield pa.RecordBatch.from_pydict({"segment": [number], "bits": [bytes_.tobytes()]})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}  # at most the whole bit map
        for batch in batches:
            for number, bytes_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = found.setdefault(number, np.zeros(segment // 8, np.uint8))
                bits |= np.frombuffer(bytes_, np.uint8)
        for number, bits in found.items():
            yield pa.RecordBatch.from_pydict({"segment": [number], "bits": [bits.tobytes()]})

    parts = frequent.select("lang", "phrase").mapInArrow(part, "segment long, bits binary")
    bits = np.zeros(size // 8, np.uint8).reshape(-1, segment // 8)
    for row in parts.repartition("segment").mapInArrow(together, "segment long, bits binary").toLocalIterator():
        bits[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def phrases_in(ids: np.ndarray, hashes: np.ndarray, length: int, known: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of each distinct phrase of ``length`` words, how often it is there). Phrases are told apart by their word
    numbers; hashes only ask the filter, which knows the frequent phrases of one word less."""
    places = len(ids) - length + 1
    if places <= 0:
        return np.zeros((0, length), np.int64), np.zeros(0, np.int64)
    inside = ids >= 0
    whole = inside[:places].copy()
    for i in range(1, length):
        whole &= inside[i : i + places]
    if known is not None:
        word = np.append(hashes, np.uint64(0))[ids]  # -1 takes the last
        shorter = word[: len(ids) - length + 2]
        for i in range(1, length - 1):
            shorter = extended(shorter, word[i : i + len(shorter)])
        hit = np.zeros(len(shorter), bool)
        asked = np.append(whole, False) | np.append(False, whole)
        hit[asked] = known.has(shorter[asked])
        whole &= hit[:-1] & hit[1:]
    at = np.flatnonzero(whole)
    code = ids[at].astype(np.int64)
    for i in range(1, length):  # each prefix gets a number of its own, so that codes stay small
        _, code = np.unique(code, return_inverse=True)
        code = code * np.int64(len(hashes)) + ids[at + i]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return ids[at[first][:, None] + np.arange(length)], counts


class Runs:
    """Counts of one language in a task, added up and given out in runs, each in prefix order within its buckets."""

    def __init__(self, lang: str, buckets: int):
        self.lang, self.buckets, self.parts, self.size = lang, buckets, [], 0

    def add(self, phrases: pa.Array, buckets: np.ndarray, counts: np.ndarray) -> None:
        if len(counts):
            self.parts.append(pa.table({"phrase": phrases, "bucket": buckets, "f": counts}))
            self.size += len(counts)

    def out(self) -> Iterator[pa.RecordBatch]:
        """Rows lang, bucket, size, phrases, counts: what was held, once each."""
        if not self.parts:
            return
        summed = pa.concat_tables(self.parts).combine_chunks().group_by("phrase", use_threads=False).aggregate([("f", "sum"), ("bucket", "min")])
        self.parts, self.size = [], 0
        ordered = summed.take(pc.sort_indices(summed, [("bucket_min", "ascending"), ("phrase", "ascending")]))
        bucket, phrases, counts = ordered["bucket_min"].to_numpy(), ordered["phrase"].combine_chunks(), ordered["f_sum"].to_numpy()
        starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
        rows = []
        for low, high in zip(starts, [*starts[1:], len(bucket)]):
            text = "\n".join(phrases[low:high].to_pylist()).encode()  # no phrase holds a line end
            rows.append((self.lang, int(bucket[low]), packed(text), packed(counts[low:high].astype("<i8").tobytes())))
        for low in range(0, len(rows), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[low : low + 200])], names=["lang", "bucket", "phrases", "counts"])


def counted(made: DataFrame, length: int, known: np.ndarray | None, least: int, buckets: int) -> DataFrame:
    """lang, phrase (words joined by blanks) and f of all phrases of ``length`` words that are there ``least`` times."""
    shared = made.sparkSession.sparkContext.broadcast(known) if known is not None else None  # at most MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if shared is None else Filter(shared.value)
        held: dict[str, Runs] = {}
        for batch in batches:
            for lang, words, ids in zip(*(c.to_pylist() for c in batch.columns)):
                listed, numbers = block_of(words, ids)
                word = word_hashes(listed, lang)
                found, counts = phrases_in(numbers, word, length, asked)
                # phrases with one first word lie together, in as many buckets as SPREAD at most
                bucket = word[found[:, 0]] + word[found[:, -1]] % np.uint64(SPREAD) * np.uint64(0x9E3779B97F4A7C15) if len(found) else word[:0]
                texts = pa.array(listed, pa.binary()).cast(pa.string())
                parts = [texts.take(pa.array(found[:, i])) for i in range(length)]
                mine = held.setdefault(lang, Runs(lang, buckets))
                mine.add(pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0], ((bucket >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), counts)
                if sum(r.size for r in held.values()) >= RUN:
                    for runs in held.values():
                        yield from runs.out()
                    held.clear()
        for runs in held.values():
            yield from runs.out()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).combine_chunks().group_by("phrase", use_threads=False).aggregate([("f", "sum")])
            kept = summed.filter(pc.greater_equal(summed["f_sum"], least))
            for batch in kept.to_batches(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * batch.num_rows, pa.string()), batch["phrase"], batch["f_sum"]], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, bucket, text, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (lang, bucket) and held:
                    yield from out()
                    held = []
                key = (lang, bucket)
                phrases = pa.array(unpacked(text).split(b"\n"), pa.binary()).cast(pa.string())
                held.append(pa.table({"phrase": phrases, "f": np.frombuffer(unpacked(numbers), "<i8")}))
        if held:
            yield from out()

    kind = "lang string, bucket long, phrases binary, counts binary"
    runs = made.select("lang", "words", "ids").mapInArrow(run, kind)
    return runs.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(together, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of up to ``longest`` words found at least ``least`` times, (lang, n) all words)."""
    made = stash(blocks(docs, block), "blocks")
    totals = made.groupBy("lang").agg(F.sum("n").alias("n"))
    buckets = 1 << ((made.agg(F.sum("n")).first()[0] or 0) // PER_BUCKET).bit_length()
    levels = [stash(counted(made, 1, None, least, buckets), "phrases-1")]
    for length in range(2, longest + 1):
        count = levels[-1].count()
        if not count:
            break
        levels.append(stash(counted(made, length, filter_of(levels[-1], count), least, buckets), f"phrases-{length}"))
    out = None
    for size, level in enumerate(levels, 1):
        level = level.select("lang", "phrase", F.lit(size).alias("size"), "f")
        out = level if out is None else out.unionByName(level)
    return out, totals


def with_part_counts(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``phrases`` (lang, phrase, size, f) with l1, l2, ...: the count of the first one, two, ... words, and r1, r2, ...: of the
    last ones. Every part of a phrase must be in the stream; longer parts than the phrase hold nothing of meaning."""
    forward = phrases.withColumn("_order", F.split("phrase", " "))
    of_size = lambda k: O.carried(F.when(F.col("size") == k, F.col("f")))
    left = O.frames(forward, ["lang"], ["_order"], **{f"l{k}": of_size(k) for k in range(1, longest)})
    backward = left.withColumn("_order", F.reverse("_order"))
    return O.frames(backward, ["lang"], ["_order"], **{f"r{k}": of_size(k) for k in range(1, longest)}).drop("_order")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, swallows: int = SWALLOWS, block: int = BLOCK,
) -> DataFrame:
    """The best collocations of each language of ``docs`` (text, lang, any other columns).

    Texts lose the case of A-Z and are cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs. Phrases
    of 2 to ``longest`` words within pieces that occur ``least`` times or more are candidates; score = floor(1000 a n / (l r)) for
    their worst cut, the first of equal ones. One that lies inside a longer candidate with at least ``swallows`` hundredths of its
    count is dropped. Null texts are empty, a null lang is ``und``, repeated rows count each time; a table without candidates has
    no rows. Result: lang, rank (by score, a, then phrase), phrase, a, l, r, n, score of the first ``top`` of each lang.
    """
    phrases, totals = frequent_phrases(docs, longest, least, block)
    parted = stash(with_part_counts(phrases, longest).where("size > 1"), "parts")
    words = F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    inner = F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))
    longer = parted.where("size > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    rest = parted.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * swallows, F.lit(True)))
    scored = rest.join(totals, "lang")
    cuts = []
    for k in range(1, longest):
        r = F.lit(None).cast("long")
        for size in range(k + 1, longest + 1):
            r = F.when(F.col("size") == size, F.col(f"r{size - k}")).otherwise(r)
        scored = scored.withColumn(f"right{k}", F.when(F.col("size") > k, r)).withColumn(f"left{k}", F.when(F.col("size") > k, F.col(f"l{k}")))
        wide = lambda *factors: " * ".join(f"CAST({x} AS DECIMAL(19,0))" for x in factors)  # products may pass 64 bits
        floor = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * ({wide('f', 'n')})) div ({wide(f'left{k}', f'right{k}')})")
        cuts.append(F.when(F.col("size") > k, F.struct(floor.alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("r"))))
    worst = scored.withColumn("cut", F.array_min(F.array_compact(F.array(*cuts))))
    chosen = worst.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # each task keeps its first ``top`` before the shuffle
    ranked = chosen.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
