"""The pipeline on sf0.001 against plain Python: near duplicates by all pairs, the mix by filling targets step by step, pieces
by the tokenizers library. Language and pseudonyms, a learned model and a keyed permutation, are taken from their stages here
and have tests of their own."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """doc_ids of the smallest of each group linked at 0.8, by all pairs."""
    sets, low = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {d for d in low if low[d] == d}


def targets(sizes):
    """Plain filling: free sources share what is left by weight; each that would pass three times its size is clamped."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        for s in over or free:
            target[s] = min(share[s], 3.0 * sizes[s])
        if not over:
            break
        free -= set(over)
        rest -= sum(target[s] for s in over)
    return target


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    return out, corpus_pipeline.run(spark, FOLDER).collect()


def test_near_duplicates(stages):
    steps, packed = stages
    assert len({r.doc_id for r in steps["language"]}) == len(steps["language"])
    want = survivors(steps["language"])
    assert len(want) < len(steps["language"])
    assert {r.doc_id for r in steps["near_duplicates"]} == want
    assert {r.doc_id for r in packed} <= want


def test_mix(stages):
    steps, packed = stages
    source = {r.doc_id: r.source for r in steps["pseudonyms"]}
    size = {r.doc_id: len(words(r.text)) for r in steps["pseudonyms"]}
    repeats = Counter(r.doc_id for r in packed if r.piece == 0)
    by_source = defaultdict(list)
    for d in source:
        by_source[source[d]].append(d)
    target = targets({s: sum(size[d] for d in ds) for s, ds in by_source.items()})
    for s, ds in by_source.items():
        taken, largest = sum(repeats[d] * size[d] for d in ds), max(size[d] for d in ds)
        assert abs(taken - target[s]) <= largest, (s, taken, target[s])
        held = {repeats[d] for d in ds if size[d]}
        assert max(held) <= 3 and max(held) - min(held) <= 1


def test_pieces(stages):
    steps, packed = stages
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation(), library.no_padding()
    repeats, want = Counter(r.doc_id for r in packed if r.piece == 0), Counter()
    for r in steps["pseudonyms"]:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())] += repeats[r.doc_id]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == +want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= 1.1 * -(-sum(r.length for r in packed) // 4096) + 1
