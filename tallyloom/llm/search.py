"""Exact top-k search by BM25 over an inverted index, with block-max pruning.

``build`` makes inverted lists of runs of documents without moving text, a row for all lists of a run. Runs are dealt to
shards; each shard's lists are shipped once, and all queries stream through its task, some hundreds at a time. A shard deals its
documents into groups of alike ones. There, a query's scarce lists are summed. What the common lists of a group, most of all
postings, can still add to a document is bounded by their maxima per block of documents. They are added tile by tile, first where
the bound is highest, for all queries that need a tile by one product of matrices, and skipped where the bounds leave so few
documents open that scoring those in full costs less. Open documents are scored by falling bounds until a bound stays below the
k-th score. All shards use the same statistics of the whole corpus, so their results merge exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.common import mix, stash

K1, B = 1.2, 0.75
#: Words of a run, words of a shard, documents of a block whose maxima are kept.
RUN_WORDS, SHARD_WORDS, BLOCK = 1_000_000, 16_000_000, 64
#: Terms in more than this share of a group's documents are bounded by block maxima.
COMMON = 0.02
#: Shards of a small corpus. Queries are copied once a shard, so copies grow only where shards are full.
SHARDS = 12
#: 64-bit words of the filter of asked terms: 8 MB, whatever the number of terms. A fuller filter keeps more lists than are
#: needed; it never drops one that is.
FILTER = 1 << 20
#: Terms whose counts a task holds before it hands them on.
TERMS = 1_000_000
#: Common lists that are kept as a weight for each document: so many at most, of so many cells in all. Others count as scarce.
LISTS_DENSE, CELLS = 1000, 32_000_000
#: Bounds are sums of 32-bit weights, of at most LISTS_DENSE of them by 32-bit additions: they are off by less than this share.
SLACK = 1e-4
#: What a posting costs that is read by document, against one cell of a list.
COST = 100
#: Groups of alike documents in a shard, documents of a group at least on average, and most frequent terms by which alike is told.
GROUPS, GROUP_DOCS, MARKS = 8, 2000, 128
#: Postings that are worked on at a time where more would take much memory.
PIECE = 1 << 20
#: Bytes beyond which a word is hashed by itself.
LONG = 64
#: Blocks of a group that are added up together.
TILE = 16
#: Cells of sums, a query by a document, that are held at a time.
ASKED = 12_000_000
NEVER = np.iinfo(np.int64).max
HEAD, LISTS, SEEN = 0, 1, 2


class Words:
    """Text -> a hash per word; words are what blanks and ASCII controls 9 to 13 separate, A-Z count as a-z. Many texts are
    hashed together, all words by steps of eight bytes; the few long words one by one."""

    SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    MORE = np.uint64(0x9E3779B97F4A7C15)

    def of(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: list[str | None], most: int = 1 << 20) -> Iterator[np.ndarray]:
        """The hashes of each text; texts of about ``most`` bytes are hashed at a time."""
        held, size = [], 0
        for text in texts:
            held.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= most:
                yield from self._hashed(held)
                held, size = [], 0
        yield from self._hashed(held)

    def _hashed(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = b" ".join([b"", *texts, b"      "]).lower()  # eight bytes can be read from each
        space = self.SPACES[np.frombuffer(data, np.uint8)]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, size = edges[::2], edges[1::2] - edges[::2]
        eights, out = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), size.astype(np.uint64)
        with np.errstate(over="ignore"):
            own = np.arange(len(starts))
            for k in range(0, LONG, 8):
                own = own[size[own] > k]
                out[own] = mix(out[own] * self.MORE ^ eights[starts[own] + k] & self.MASKS[np.minimum(size[own] - k, 8)])
        for w in np.flatnonzero(size > LONG):
            out[w] = xxhash.xxh3_64_intdigest(data[starts[w] : starts[w] + size[w]])
        first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        out = out.view(np.int64)
        return (out[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist()))


def _short(values: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type that holds them; ``_read`` tells the type from the length."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _read(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1")


def _steps(values: np.ndarray) -> bytes:
    """Unsigned numbers as differences modulo the size of the narrowest type that holds them, first the lowest byte of all, then
    the next one: of ascending stretches the upper bytes are nearly all zero, and compression takes them."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    steps = np.diff(values, prepend=values.dtype.type(0))
    return steps.view(np.uint8).reshape(len(steps), values.itemsize).T.tobytes()


def _read_steps(data: bytes, n: int) -> np.ndarray:
    width = len(data) // n if n else 1
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(f"<u{width}")[:, 0]
    return np.cumsum(steps, dtype=steps.dtype)


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    size = stop - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _order(values: np.ndarray) -> np.ndarray:
    """Places of the values, none negative, by value and place: a stable ``argsort``, made by the much faster sort of numbers."""
    key = np.arange(len(values))
    for k in range(0, len(values), PIECE):
        key[k : k + PIECE] += values[k : k + PIECE].astype(np.int64) * len(values)
    key.sort()
    key %= max(1, len(values))
    return key


def term_filter(terms: DataFrame) -> np.ndarray:
    """A bit for each hashed ``term``, combined per word on the executors."""
    place = F.pmod("term", F.lit(FILTER))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(term, 58) as int))")
    words = terms.groupBy(place.alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER, np.int64)
    out[words["place"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


class Seen:
    """In how many documents a task's terms are, summed over its runs; handed on where they become too many."""

    def __init__(self):
        self.terms, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, terms: np.ndarray, n: np.ndarray) -> None:
        self.terms, at = np.unique(np.concatenate([self.terms, terms]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), len(self.terms)).astype(np.int64)


def build(docs: DataFrame, asked: np.ndarray | None = None, run_words: int = RUN_WORDS) -> DataFrame:
    """Inverted lists of ``docs`` (doc_id, text). Rows by ``kind``: of each run a head (n documents, words, in ``terms`` the
    doc_ids, in ``sizes`` the lengths in words) and its lists (n postings; the terms, sizes, places in the run and counts of
    all lists, packed, terms and places as ``_steps``); of each task ``seen``, its terms and in how many of its documents they are. With ``asked``, a
    ``term_filter``, lists of other terms are left out."""
    entry = pa.struct([("term", pa.int64()), ("df", pa.int64())])
    schema = pa.schema([("kind", pa.int32()), ("run", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), *((c, pa.binary()) for c in ("terms", "sizes", "places", "counts")),
                        ("seen", pa.list_(entry))])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def told(seen: Seen) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(seen.terms), 50_000):
            pairs = pa.StructArray.from_arrays([pa.array(seen.terms[k : k + 50_000]), pa.array(seen.n[k : k + 50_000])], fields=list(entry))
            column = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip([SEEN, *[None] * 7], schema)), column.cast(schema.field("seen").type)], schema=schema)

    def flush(run: int, ids: list[int], hashes: list[np.ndarray], seen: Seen) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(h) for h in hashes], np.int64)
        yield row(HEAD, run, len(ids), int(lengths.sum()), np.array(ids, np.int64).tobytes(), _short(lengths), None, None, None)
        term, place = np.concatenate(hashes), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        if asked is not None:
            wanted = asked[term % FILTER] >> (term.view(np.uint64) >> np.uint64(58)).astype(np.int64) & 1 == 1
            term, place = term[wanted], place[wanted]
        if not len(term):
            return
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] != place[:-1])])
        counts, term, place = np.diff(np.append(first, len(term))), term[first], place[first]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        sizes = np.diff(np.append(starts, len(term)))
        seen.add(term[starts], sizes)
        yield row(LISTS, run, len(term), len(starts), _steps(term[starts].view(np.uint64)), _short(sizes), _steps(place), _short(counts), None)
        if len(seen.terms) > TERMS:
            yield from told(seen)
            seen.__init__()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, ids, hashes, total = Words(), Seen(), [], [], 0
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), words.each(batch.column(1).to_pylist())):
                ids.append(doc_id)
                hashes.append(own)
                total += len(hashes[-1]) + 1
                if total >= run_words:
                    yield from flush(run, ids, hashes, seen)
                    run, ids, hashes, total = run + 1, [], [], 0
        if ids:
            yield from flush(run, ids, hashes, seen)
        yield from told(seen)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "kind int, run long, n long, words long, terms binary, sizes binary, places binary, counts binary, seen array<struct<term: long, df: long>>")


def groups(marks: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Deals rows into at most ``many`` groups of alike rows: k-means of their directions from seeded starts far apart."""
    rows = marks / np.maximum(np.sqrt((marks * marks).sum(1, keepdims=True)), 1)
    rng, near = np.random.default_rng(0), np.zeros(len(rows), np.float32)
    centres = np.zeros((0, rows.shape[1]), np.float32)
    while len(centres) < many:
        chance = np.cumsum(np.maximum(0, 1 - near, dtype=np.float64) ** 2 * rows.any(1))
        if not len(chance) or chance[-1] < 1e-6:
            break
        centres = np.concatenate([centres, rows[np.searchsorted(chance, rng.random() * chance[-1], "right")][None]])
        near = np.maximum(near, rows @ centres[-1])
    group = np.zeros(len(rows), np.int64)
    for _ in range(rounds if len(centres) > 1 else 0):
        group = (rows @ centres.T).argmax(1)
        for g in range(len(centres)):
            if (own := group == g).any():
                centres[g] = rows[own].mean(0)
                centres[g] /= max(1e-9, float(np.sqrt((centres[g] ** 2).sum())))
    return group


class Shard:
    """The lists of one shard, ready for queries. ``read`` and ``asked`` count the postings that queries read and those that
    their lists have. Rows are (run, n, words, terms, sizes, places, counts) as ``build`` makes them; ``lists`` is used up.

    Documents lie by group and length, each group from a new block on. Lists are common group by group: what is common in one
    group only is a scarce list in the others."""

    def __init__(self, heads: list[tuple], lists: list[tuple], average: float, group_docs: int = GROUP_DOCS):
        heads = sorted(heads, key=lambda h: h[0])
        before = dict(zip((h[0] for h in heads), np.cumsum([0, *(h[1] for h in heads)])))
        ids = np.concatenate([np.frombuffer(h[3], np.int64) for h in heads])
        lengths = np.concatenate([_read(h[4], h[1]).astype(np.int64) for h in heads])
        self.terms, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(_read_steps(x[3], x[2]).astype(np.uint64).view(np.int64) for x in lists)]), return_inverse=True)
        n, postings = len(ids), sum(x[1] for x in lists)
        place, term = np.empty(postings, np.int32), np.empty(postings, np.int32)
        counts = np.empty(postings, f"<u{max((len(x[6]) // x[1] for x in lists), default=1)}")
        done = lists_done = 0
        lists.reverse()
        while lists:  # what was read is let go of, so that it is not held beside what is sorted
            run, postings, size, _, sizes, places, own = lists.pop()
            term[done : done + postings] = np.repeat(at[lists_done : lists_done + size], _read(sizes, size))
            place[done : done + postings] = _read_steps(places, postings).astype(np.int64) + before[run]
            counts[done : done + postings] = _read(own, postings)
            done, lists_done = done + postings, lists_done + size
        del at
        # alike documents together make tight bounds
        sizes = np.bincount(term, minlength=len(self.terms))
        many = max(1, min(GROUPS, n // group_docs))
        marked = np.argsort(-sizes, kind="stable")[: min(MARKS, int((sizes > COMMON * n).sum()), CELLS // max(1, 8 * n))] if many > 1 else np.zeros(0, np.int64)
        mark = np.full(len(self.terms), -1, np.int32)
        mark[marked] = np.arange(len(marked))
        marks, own = np.zeros((n, len(marked)), np.float32), mark[term]
        marks[place[own >= 0], own[own >= 0]] = 1
        group = groups(marks, many) if len(marked) else np.zeros(n, np.int64)
        order = np.lexsort((ids, lengths, group))
        size = np.bincount(group)
        size = size[size > 0]
        self.edges = np.concatenate([[0], np.cumsum(-(-size // BLOCK) * BLOCK)])  # of the groups
        slots = np.repeat(self.edges[:-1] - (np.cumsum(size) - size), size) + np.arange(n)
        rank = np.empty(n, np.int32)
        rank[order] = slots
        self.n, self.blocks = int(self.edges[-1]), int(self.edges[-1]) // BLOCK
        self.ids, self.norm = np.zeros(self.n, np.int64), np.ones(self.n)
        self.ids[slots] = ids[order]
        if average:
            self.norm[slots] = K1 * (1 - B + B * lengths[order] / average)
        del marks, own, mark
        # by document, for final scores: its terms, ascending as in its run, and how often they are in it
        place = rank[place]
        order = _order(place)
        place = place[order]  # one after the other, so that few are held twice
        self.term = term = term[order]
        self.counts = counts = counts[order]
        del order
        self.docs = np.searchsorted(place, np.arange(self.n + 1))
        self.sizes = np.diff(self.docs)
        self.lightest = np.full(self.n, np.iinfo(np.int64).max)  # how many terms the documents of a block have at least
        self.lightest[slots] = self.sizes[slots]
        self.lightest = self.lightest.reshape(-1, BLOCK).min(1)
        # by term, for sums of whole lists: a posting's place and weight lie side by side, so that both are met at once
        order = _order(term)
        self.starts = np.append(0, np.cumsum(sizes))
        self.lists = order.view(np.int32).reshape(-1, 2)  # where the order was, which is used up
        for k in range(0, len(order), PIECE):
            at = order[k : k + PIECE].copy()
            own, often = place[at], counts[at]
            self.lists[k : k + PIECE, 0] = own
            self.lists.view(np.float32)[k : k + PIECE, 1] = often * (K1 + 1) / (often + self.norm[own])
        del place, order
        # the lists that are common in each group, and where the groups' parts of them begin
        common = []
        for first, stop, size_own in zip(self.edges[:-1], self.edges[1:], size):
            held = np.bincount(self.term[self.docs[first] : self.docs[stop]], minlength=len(self.terms))
            own = np.flatnonzero(held > max(COMMON * size_own, BLOCK))
            common.append(own[np.argsort(-held[own], kind="stable")][: min(LISTS_DENSE, CELLS // max(1, self.n))])
        every = np.unique(np.concatenate(common))
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[every] = np.arange(len(every))
        self.cuts = np.array([self.starts[t] + np.searchsorted(self.lists[self.starts[t] : self.starts[t + 1], 0], self.edges) for t in every], np.int64).reshape(len(every), len(self.edges))
        # by group: those lists as a weight for each document, and their maxima for each block
        self.rows, self.dense, self.maxima = [self.row[own] for own in common], [], []
        loose = np.ones((len(every), len(common) + 2), bool)
        loose[:, [0, -1]] = False
        for g, (own, first, stop) in enumerate(zip(self.rows, self.edges[:-1], self.edges[1:])):
            loose[own, g + 1] = False
            begins, ends = self.cuts[own, g], self.cuts[own, g + 1]
            at, dense = _ranges(begins, ends), np.zeros((len(own), stop - first), np.float32)
            dense[np.repeat(np.arange(len(own)), ends - begins), self.lists[at, 0] - first] = self.lists.view(np.float32)[at, 1]
            self.dense.append(dense)
            self.maxima.append(dense.reshape(len(own), (stop - first) // BLOCK, BLOCK).max(2))
        self.begins, self.ends = loose[:, 1:-1] & ~loose[:, :-2], loose[:, 1:-1] & ~loose[:, 2:]  # of stretches of other groups
        # tiles: blocks of a group that are added up together
        tiles = [(g, b) for g, (first, stop) in enumerate(zip(self.edges[:-1] // BLOCK, self.edges[1:] // BLOCK)) for b in range(first, stop, TILE)]
        self.group, self.tiles = np.array(tiles, np.int64).reshape(-1, 2).T
        self.tiles = np.append(self.tiles, self.blocks)
        held = [(self.dense[g][:, first * BLOCK - self.edges[g] : stop * BLOCK - self.edges[g]] > 0).sum(1) for g, first, stop in zip(self.group, self.tiles[:-1], self.tiles[1:])]
        self.held = held  # postings of a tile's lists
        self.weight, self.met, self.read, self.asked = np.zeros(len(self.terms)), np.zeros(1 << 16, bool), 0, 0

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores, summed in the order of the terms, so that equal documents get equal sums."""
        first, stop = self.docs[docs], self.docs[docs + 1]
        parts = list(zip(first.tolist(), stop.tolist()))
        terms, ends = np.concatenate([self.term[a:b] for a, b in parts]), np.cumsum(stop - first)
        self.read += len(terms)
        met = np.flatnonzero(self.met[terms.astype(np.uint16)])  # a small table, which stays near; what it lets through may weigh 0
        own = np.searchsorted(ends, met, "right")
        counts = self.counts[met + (stop - ends)[own]]
        return np.bincount(own, counts * (K1 + 1) / (counts + self.norm[docs][own]) * self.weight[terms[met]], len(docs))

    def _sums(self, first: np.ndarray, stop: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Weights of lists, or of parts of them, added up for each document."""
        rows = self.lists.view(np.int64)[_ranges(first, stop), 0].view(np.int32).reshape(-1, 2)
        self.read += len(rows)
        return np.bincount(rows[:, 0], rows.view(np.float32)[:, 1] * np.repeat(idf.astype(np.float32), stop - first), self.n)

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k documents; ``terms`` ascending. Documents without any of them are no result."""
        return next(self.search_all([(terms, idf)], k))

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``search`` for many queries, so many at a time that their sums take ASKED cells; those that need the common lists of a
        group are added up by one product of matrices."""
        step = max(1, ASKED // max(1, self.n))
        for j in range(0, len(queries), step):
            yield from self._together(queries[j : j + step], k)

    def _together(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        known = self._known(queries)
        sums = np.zeros((len(queries), self.blocks, BLOCK), np.float32)
        weight = np.zeros((len(queries), len(self.cuts)), np.float32)
        for q, (at, idf) in enumerate(known):
            row = self.row[at]
            usual, scarce = row[row >= 0], at[row < 0]
            weight[q, usual] = idf[row >= 0]
            begins, cuts = self.begins[usual], self.cuts[usual]
            first, stop = np.concatenate([self.starts[scarce], cuts[:, :-1][begins]]), np.concatenate([self.starts[scarce + 1], cuts[:, 1:][self.ends[usual]]])
            self.asked += int((self.starts[at + 1] - self.starts[at]).sum())
            if len(first):
                sums[q].reshape(-1)[:] = self._sums(first, stop, np.concatenate([idf[row < 0], np.repeat(idf[row >= 0], begins.sum(1))]))
        # what common lists that are not added yet can add to a document of a block, and what they cost
        more = np.zeros(sums.shape[:2], np.float32)
        own = [weight[:, r] for r in self.rows]
        for g, (first, stop) in enumerate(zip(self.edges[:-1] // BLOCK, self.edges[1:] // BLOCK)):
            more[:, first:stop] = own[g] @ self.maxima[g]
        cells = np.stack([(w > 0).sum(1) for w in own], 1)[:, self.group] * (np.diff(self.tiles) * BLOCK)
        cells[cells == 0] = NEVER  # nothing to add
        tops, lowest = self._tops(sums), np.zeros(len(queries))
        out, first = [(self.ids[:0], np.zeros(0))] * len(queries), True
        live = np.array([q for q, (at, _) in enumerate(known) if len(at)], np.int64)
        while len(live):
            lowest[live] = np.maximum(lowest[live], self._least(sums, tops[live], live, k) * (1 - SLACK))
            bound = tops[live] + more[live]
            open_ = (bound >= lowest[live, None] * (1 - SLACK)) & (bound > 0)
            needs = COST * np.add.reduceat(open_ * self.lightest, self.tiles[:-1], axis=1) > cells[live]  # a document of each open block is open
            if first:  # the tile of the highest bound makes the limit that others must reach
                highest = np.where(needs, np.maximum.reduceat(bound, self.tiles[:-1], axis=1), -1)
                needs &= np.arange(len(self.group)) == highest.argmax(1)[:, None]
                first = False
            for j in np.flatnonzero(~needs.any(1)):
                q = live[j]
                docs, high = self._open(sums[q], np.flatnonzero(open_[j]), more[q], lowest[q] * (1 - SLACK))
                cost = np.diff(np.concatenate([[0], np.cumsum(self.sizes[docs])])[np.searchsorted(docs, self.tiles * BLOCK)])
                needs[j] = COST * cost > cells[q]
                if not needs[j].any():
                    out[q] = self._best(docs, high, *known[q], lowest[q], k)
            for t in np.flatnonzero(needs.any(0)):
                asking, g, part = live[needs[:, t]], self.group[t], slice(self.tiles[t], self.tiles[t + 1])
                weights = own[g][asking]
                added = sums[asking, part] + (weights @ self.dense[g][:, part.start * BLOCK - self.edges[g] : part.stop * BLOCK - self.edges[g]]).reshape(len(asking), -1, BLOCK)
                sums[asking, part], tops[asking, part] = added, self._tops(added)
                more[asking, part], cells[asking, t] = 0, NEVER
                self.read += int((weights > 0).sum(0) @ self.held[t])
            live = live[needs.any(1)]
        return out

    def _known(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Those of each query's terms that the shard has, as numbers, and their weights; looked up once for all queries."""
        terms, back = np.unique(np.concatenate([t for t, _ in queries]), return_inverse=True)
        at = np.searchsorted(self.terms, terms)
        at[(self.terms[np.minimum(at, len(self.terms) - 1)] != terms) if len(self.terms) else at >= 0] = -1
        back = np.split(at[back], np.cumsum([len(t) for t, _ in queries])[:-1])
        return [(own[own >= 0], idf[own >= 0]) for own, (_, idf) in zip(back, queries)]

    @staticmethod
    def _tops(sums: np.ndarray) -> np.ndarray:
        """The highest of each block."""
        rows = sums.reshape(len(sums), -1)
        return np.maximum.reduceat(rows, np.arange(0, rows.shape[1], BLOCK), axis=1) if rows.size else np.zeros(sums.shape[:2], np.float32)

    @staticmethod
    def _open(sums: np.ndarray, open_: np.ndarray, more: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents of open blocks whose bound reaches the limit, ascending, and their bounds."""
        bound = (sums[open_] + more[open_, None]).reshape(-1)
        reach = np.flatnonzero((bound >= limit) & (bound > 0))
        return open_[reach // BLOCK] * BLOCK + reach % BLOCK, bound[reach]

    def _best(self, open_: np.ndarray, bound: np.ndarray, at: np.ndarray, idf: np.ndarray, lowest: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the open documents: scored by falling bounds, and each wave may raise the limit."""
        self.weight[at], self.met[at.astype(np.uint16)] = idf, True
        order = np.argsort(-bound, kind="stable")
        open_, bound = open_[order], bound[order]
        docs, score, done, wave = open_[:0], np.zeros(0), 0, 2 * k
        while done < len(open_) and bound[done] >= lowest * (1 - SLACK):
            own = open_[done : done + wave]
            docs, score = np.concatenate([docs, own]), np.concatenate([score, self._scores(own)])
            lowest, done, wave = max(lowest, self._kth(score, k)), done + wave, 2 * wave
        self.weight[at], self.met[at.astype(np.uint16)] = 0, False
        good = np.flatnonzero((score >= lowest * (1 - SLACK)) & (score > 0))
        ids, score = self.ids[docs[good]], score[good]
        take = np.lexsort((ids, -score))[:k]
        return ids[take], score[take]

    @staticmethod
    def _least(sums: np.ndarray, tops: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
        """The k-th of the sums of each query asked; the best k are in the k blocks of the highest ``tops``."""
        if tops.shape[1] > k:
            best = np.argpartition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k :]
            values = sums[asked[:, None], best].reshape(len(asked), -1)
        else:
            values = sums[asked].reshape(len(asked), -1)
        return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.zeros(len(asked))

    @staticmethod
    def _kth(values: np.ndarray, k: int) -> float:
        return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and term, each distinct word of each query (doc_id, text) once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            terms = [np.unique(own) for own in words.each(batch.column(1).to_pylist())]
            ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(terms))], names=["query_id", "term"])

    rows = queries.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").dropDuplicates(["doc_id"])
    return rows.mapInArrow(work, "query_id long, term long")


def _packed(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """A row per query in the columns of index rows: its terms, ascending, and in how many documents each is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pairs = batch.columns
            sizes = pairs.value_lengths().to_numpy()
            term, df = (c.to_numpy(zero_copy_only=False) for c in pairs.flatten().flatten())
            cuts = np.cumsum(sizes)[:-1]
            terms = [x.tobytes() for x in np.split(term, cuts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array([_short(x) for x in np.split(df, cuts)], pa.binary())],
                                             names=["run", "n", "terms", "sizes"])

    pairs = asked.join(seen, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("terms"))
    return pairs.mapInArrow(work, "run long, n long, terms binary, sizes binary")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, shards: int = SHARDS, shard_words: int = SHARD_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the best ``k`` documents of each query, equal scores by doc_id.

    Queries and documents are (doc_id, text). A query's words count once each. Null and empty texts count as documents of no
    words, match nothing and ask nothing; rows without a doc_id are left out, and repeated documents are found as often as
    they are there. Of queries with the same doc_id one is asked. There are at least ``shards`` shards, and so many that one
    holds about ``shard_words`` words."""
    asked = stash(query_terms(queries), "asked")
    index = stash(build(docs, term_filter(asked), run_words), "index")
    n_docs, n_words = index.where(F.col("kind") == HEAD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    seen = index.where(F.col("kind") == SEEN).select(F.inline("seen")).groupBy("term").agg(F.sum("df").alias("df"))
    shards, average = max(shards, -(-n_words // shard_words)), n_words / max(1, n_docs)
    own = F.pmod(F.shiftright("run", 32) + F.col("run").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(shards)).cast("int")  # in turn
    left = index.where(F.col("kind") != SEEN).drop("seen").withColumn("shard", own)
    right = _packed(asked, seen).withColumn("kind", F.lit(SEEN)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(shards, "shard").sortWithinPartitions("kind", "run")
    dealt = dealt.select("kind", "run", "n", "words", "terms", "sizes", "places", "counts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = {HEAD: [], LISTS: []}, None
        for batch in batches:
            found = []
            for kind, run, n, *other in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != SEEN:
                    rows[kind].append((run, n, *other))
                    continue
                if shard is None and rows[HEAD]:
                    shard, rows = Shard(rows[HEAD], rows[LISTS], average), {HEAD: [], LISTS: []}
                if shard is not None:
                    df = _read(other[2], n).astype(np.float64)
                    found.append((run, np.frombuffer(other[1], np.int64), np.log(1 + (n_docs - df + 0.5) / (df + 0.5))))
            if found:
                found = [(f[0], *best) for f, best in zip(found, shard.search_all([f[1:] for f in found], k))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]), pa.int64()),
                                                  pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "doc_id", "score"])

    results = dealt.mapInArrow(work, "query_id long, doc_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))  # at most k rows per shard
    return results.select("query_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
