import math
import random
import time

import numpy as np
import pyarrow as pa

from tallyloom.llm import search


def brute(docs, queries, k):
    words = [(d, (t or "").encode().lower().split()) for d, t in docs if d is not None]
    n, average = len(words), sum(len(w) for _, w in words) / max(1, len(words))
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, text in queries:
        scores = []
        for d, w in words:
            s = 0.0
            for x in set((text or "").encode().lower().split()):
                tf = w.count(x)
                if tf:
                    s += math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))
            if s:
                scores.append((-round(s, 9), d))
        out[q] = sorted(scores)[:k]
    return out


def compare(spark, docs, queries, k=5, **options):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in search.search(frame(docs), frame(queries), k, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, -round(r.score, 9), r.doc_id))
    want = brute(docs, queries, k)
    for q, rows in want.items():
        found = [(s, d) for _, s, d in sorted(got.get(q, []))]
        assert [d for _, d in found] == [d for _, d in rows]
        assert all(abs(a - b) < 1e-6 for (a, _), (b, _) in zip(found, rows))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(5000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for k in range(n)]
    return docs + [(n + k, docs[3][1]) for k in range(12)]


def test_against_brute_force(spark):
    docs = corpus(1, 900)
    compare(spark, docs, docs[::100] + [docs[3]])


def test_many_runs_and_shards(spark):
    docs = corpus(2, 400)
    compare(spark, docs, docs[::40], run_words=300, shards=3, shard_words=1500)
    compare(spark, docs, docs[::40], run_words=10**6, shards=1)


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 8]
    compare(spark, docs, [(1, docs[0][1]), (3, None), (4, ""), (9, "short SHORT nothing")])
    assert search.search(empty, odd).count() == 0 and search.search(odd, empty).count() == 0
    assert search.search(odd, odd.where("doc_id = 8")).first().doc_id == 8


def test_skipped_postings(spark):
    """One shard, asked directly: the best of every query are those of all postings, and not all postings are read."""
    rng = random.Random(5)
    usual, scarce = [f"u{k}" for k in range(20)], [f"s{k}" for k in range(3000)]
    docs = [(k, " ".join(rng.choices(usual, k=rng.randrange(30, 60)) + rng.choices(scarce, k=6))) for k in range(4000)]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    rows = lambda kind: [tuple(r)[1:8] for r in index if r.kind == kind]
    heads, lists = rows(search.HEAD), rows(search.LISTS)
    df = {s.term: s.df for r in index if r.kind == search.SEEN for s in r.seen}
    shard = search.Shard(heads, lists, sum(h[2] for h in heads) / len(docs))
    words = search.Words()
    few = "s5 " + " ".join(usual)  # the lists of the usual words are skipped; in texts of many scarce words reading them costs less
    for text in [docs[7][1], docs[1234][1], "s5 s17 u0 u1", "u3", "nothing", few]:
        shard.read = shard.asked = 0
        terms = np.array(sorted(set(words.of(text).tolist()) & set(df)), np.int64)
        idf = np.array([math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
        ids, scores = shard.search(terms, idf, 5)
        want = brute(docs, [(0, text)], 5)[0]
        assert ids.tolist() == [d for _, d in want] and all(abs(a + b) < 1e-6 for a, (b, _) in zip(scores.tolist(), want))
    assert 0 < shard.read < 0.1 * shard.asked


def test_long_text_and_other_columns(spark):
    docs = [(k, f"w{k % 7} w{k % 11} common") for k in range(50)] + [(50, " ".join(f"v{k}" for k in range(200_000)) + " w3 common")]
    compare(spark, docs, [docs[3]], run_words=1000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert search.search(frame, frame.where("doc_id = 50"), 1, run_words=1000).first().doc_id == 50
    odd = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, term int, shard int")
    assert search.search(odd, odd.where("doc_id = 3"), 3).columns == ["query_id", "rank", "doc_id", "score"]


def test_steps_are_read_back_and_compress():
    rng = np.random.default_rng(5)
    stretches = np.concatenate([np.sort(rng.choice(5000, 400, replace=False)) for _ in range(500)]).astype(np.int32)
    hashes = np.sort(rng.integers(-(1 << 63), 1 << 63, 1000))
    odd = [stretches, np.zeros(0, np.int32), np.zeros(3, np.int32), np.array([70_000, 0, 255, 1 << 20]), np.array([0, (1 << 32) + 5, 7])]
    for values in odd:
        assert search._read_steps(search._steps(values), len(values)).tolist() == values.tolist()
    assert (search._read_steps(search._steps(hashes.view(np.uint64)), 1000).astype(np.uint64).view(np.int64) == hashes).all()
    size = lambda data: pa.compress(data, "lz4", asbytes=True).__len__()
    assert size(search._steps(stretches)) < 0.65 * size(search._short(stretches))


def test_shard_lets_go_of_what_it_has_read():
    ids = np.arange(3, dtype=np.int64)
    heads = [(run, 3, 6, (ids + 3 * run).tobytes(), search._short(np.full(3, 2)), None, None) for run in range(2)]
    own = (3, 1, search._steps(np.array([7], np.uint64)), search._short(np.array([3])), search._steps(np.arange(3)), search._short(np.ones(3, np.int64)))
    lists = [(run, *own) for run in range(2)]
    shard = search.Shard(heads, lists, 2.0)
    assert lists == [] and sorted(shard.search(np.array([7]), np.ones(1), 9)[0].tolist()) == [0, 1, 2, 3, 4, 5]


def test_queries_asked_together():
    """A shard of groups of alike documents: many queries are answered in much less time than one after the other, each as by brute
    force, and what lies in groups that cannot reach a query's limit is not read."""
    rng = random.Random(9)
    texts = []
    for k in range(4000):
        tongue = "abcd"[k % 4]
        usual, scarce = [f"{tongue}{j}" for j in range(90)], [f"s{rng.randrange(4000)}" for _ in range(4)]
        texts.append(" ".join(rng.choices(usual, k=rng.randrange(40, 120)) + scarce + ["a1", "both"][: k % 3]))
    docs = [*enumerate(texts), (4000, ""), (4001, texts[8]), (4002, texts[8])]
    words = search.Words()
    hashes = [words.of(t) for _, t in docs]
    lengths = np.array([len(h) for h in hashes])
    pairs = sorted({(t, p) for p, h in enumerate(hashes) for t in h.tolist()})
    terms, sizes = np.unique([t for t, _ in pairs], return_counts=True)
    counts = np.array([np.count_nonzero(hashes[p] == t) for t, p in pairs])
    head = (0, len(docs), int(lengths.sum()), np.arange(len(docs)).tobytes(), search._short(lengths), None, None)
    own = (0, len(pairs), len(terms), search._steps(terms.view(np.uint64)), search._short(sizes), search._steps(np.array([p for _, p in pairs])), search._short(counts))
    make = lambda size: search.Shard([head], [own], lengths.sum() / len(docs), size)
    shard, alone = make(500), make(10**6)
    asked = [*range(0, 4000, 10), 4000]
    queries = [np.unique(hashes[q]) for q in asked]
    queries = [(t, np.log(1 + (len(docs) - (df := sizes[np.searchsorted(terms, t)]) + 0.5) / (df + 0.5))) for t in queries]
    best = list(shard.search_all(queries, 5))
    for q in [0, 1, 2, 3, 77, 400]:
        want = brute(docs, [(0, docs[asked[q]][1])], 5)[0]
        assert best[q][0].tolist() == [d for _, d in want] and all(abs(a + b) < 1e-6 for a, (b, _) in zip(best[q][1].tolist(), want))
    start = time.process_time()
    together = list(shard.search_all(queries, 5))
    spent = time.process_time() - start
    start = time.process_time()
    single = [shard.search(*q, 5) for q in queries]
    assert spent < 0.6 * (time.process_time() - start)
    for other in (together, single, list(alone.search_all(queries, 5))):
        assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(best, other))
    assert len(shard.dense) == 8 and len(alone.dense) == 1
    assert sum(d.size for d in shard.dense) < 0.5 * alone.dense[0].size
    shard.read = 0
    shard.search(*queries[1], 5)
    native = sum(int(sizes[np.searchsorted(terms, t)]) for t in queries[1][0])
    assert shard.read < 1.2 * native


def test_hashes_of_words():
    texts = [None, "", " \t\n ", "a", "A b\x0bC", "x" * 64, "x" * 65, "y" * 500 + " z", "  lead trail  ", "é b \x1c c", "12345678 123456789 1234567 a\0 a", " "]
    words, seen = search.Words(), {}
    hashes = list(words.each(texts, most=20))
    assert len(hashes) == len(texts) and list(words.each([])) == []
    for text, own in zip(texts, hashes):
        split = (text or "").encode().lower().split()
        assert own.tolist() == words.of(text).tolist() and len(own) == len(split)
        for word, value in zip(split, own.tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen) == 15
    rng = np.random.default_rng(3)
    many = " ".join(f"{a}x{b}" for a, b in rng.integers(0, 10**9, (50_000, 2)).tolist())
    assert len(np.unique(words.of(many))) == len(set(many.split()))


def test_order_is_a_stable_sort():
    values = np.random.default_rng(1).integers(0, 50, 3000).astype(np.int32)
    assert (search._order(values) == np.argsort(values, kind="stable")).all() and len(search._order(values[:0])) == 0
