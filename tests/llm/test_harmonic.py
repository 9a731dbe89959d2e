import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, harmonic

PATH = public_tokenizers.path("byte_bpe_50k.json")


def packed(lengths, capacity):
    """Pieces by sequence and by document, with made-up ids."""
    pieces = []
    packer = harmonic.Packer(lambda row, ids, start, sequence, at: pieces.append((row, ids, start, sequence, at)), capacity)
    docs = [np.arange(n) + 1000 * k for k, n in enumerate(lengths)]
    for k, ids in enumerate(docs):
        packer.add(k, ids)
        assert packer.spare >= packer.missing  # gaps can always be filled
    packer.finish()
    by_doc, by_sequence = {}, {}
    for row, ids, start, sequence, at in pieces:
        by_doc.setdefault(row, []).append((start, ids.tolist()))
        by_sequence.setdefault(sequence, []).append((at, len(ids)))
    for row, ids in enumerate(docs):
        assert sum((part for _, part in sorted(by_doc[row])), []) == ids.tolist()
        assert [s for s, _ in sorted(by_doc[row])] == list(np.cumsum([0, *[len(p) for _, p in sorted(by_doc[row])]])[:-1])
    return by_sequence


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 8), st.integers(1, 300)), max_size=400))
def test_packer(lengths):
    by_sequence = packed(lengths, 64)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        sizes.append(at)
    assert all(n == 64 or n < 64 and n & (n - 1) == 0 for n in sizes)
    assert sum(sizes) == sum(lengths)


def test_classes_hold_fixed_counts():
    """Once the reserve is full, k documents of class k share a sequence uncut."""
    rng = np.random.default_rng(1)
    lengths = [64 * harmonic.RESERVE, *rng.integers(22, 33, 2000).tolist()]  # class 2 of 64
    pieces = []
    packer = harmonic.Packer(lambda row, ids, start, sequence, at: pieces.append((row, len(ids), start, sequence, at)), 64)
    for k, n in enumerate(lengths):
        packer.add(k, np.zeros(n))
    packer.finish()
    whole = {}
    for row, n, start, sequence, at in pieces:
        if row and start == 0 and n == lengths[row]:
            whole.setdefault(sequence, []).append(n)
    pairs = sum(len(w) == 2 for w in whole.values())
    assert pairs > 600 and len(pieces) < 1.8 * len(lengths)


@pytest.mark.parametrize("text", [
    "", "it's we'LL don't!!!'s 12a3", "İstanbul ΑΣ", "a <|endoftext|> b<|endoftext|><|endof", "a\x1cb \x85c  d", "日本語 🙂 x​y 　 q",
    "  lead and trail \n\n ", "\t\t x\r\n\r\n", "é ́a \x00", "A" * 20000, " " * 300_000 + "x", "'" * 3000, "ab" * 50000])
def test_ids(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert bpe.byte_encoder(PATH)(text).tolist() == want


def test_proof_refuses_other_merges():
    vocab = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    model = {"vocab": vocab, "merges": [("a", "b"), ("b", "c"), ("ab", "c")]}
    assert bpe.ranks(model, str.encode)[b"abc"] == 5
    with pytest.raises(ValueError):
        bpe.ranks(model | {"merges": [("a", "b"), ("b", "c"), ("a", "bc")]}, str.encode)


def test_round_trip(spark, odd, empty):
    tokenizer = Tokenizer.from_file(PATH)
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars")
    docs = odd.union(odd.where("doc_id = 8")).union(given)
    docs = docs.selectExpr("*", "1 AS ids", "'x' AS row_id", "0 AS offset")  # names of results
    pieces = harmonic.pack(docs, PATH)
    rows = pieces.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, pieces.collect()), key=repr)
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault((r.row_id, r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_row) == docs.count()
    texts = {}
    for d in docs.collect():
        texts.setdefault(d.doc_id, set()).add(d.text or "")
    for (_, doc_id), parts in by_row.items():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0, *[r.length for r in parts]])[:-1])
        ids = np.frombuffer(b"".join(r.ids for r in parts), bpe.IDS).tolist()
        assert ids in [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts[doc_id]]
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    whole = {r.sequence_id: r for r in harmonic.sequences(pieces).collect()}
    some = next(iter(by_sequence.values()))
    assert zlib.crc32(whole[some[0].sequence_id].ids) == zlib.crc32(b"".join(r.ids for r in sorted(some, key=lambda r: r.offset)))
    assert harmonic.pack(empty, PATH).count() == 0
