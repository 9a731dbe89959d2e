import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import collocations as C


def brute(rows, longest=5, least=100, top=2000, swallows=100):
    """By the definition, with a table of all phrases."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(inside(q) and 100 * b >= swallows * a for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(text, lang, "x", 1) for text, lang in rows], "text string, lang string, phrase string, n long")
    out = C.collocations(df, **options)
    assert out.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("seed, longest, swallows", [(1, 5, 100), (2, 3, 60)])
def test_random(spark, seed, longest, swallows):
    rnd = random.Random(seed)
    words = ["a", "B", "the", "Ünï", "x-y", "\x00", "東京", "of", "q"]
    rows = [(rnd.choice(["", " ", "\t"]) + rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "!", "\n"]) for _ in range(rnd.randrange(0, 40))),
             rnd.choice(["en", "de", None, "und"])) for _ in range(400)]
    rows += [("new york city hall", "en")] * 30 + [("a a a a a a", "de")] * 9 + [(None, "en"), ("", "fr"), (" . ", None)]
    options = {"longest": longest, "least": 7, "top": 60, "swallows": swallows}
    want = brute(rows, **options)
    assert len(want) > 100
    assert found(spark, rows, block=50, **options) == want


def test_ties_and_hot_rows(spark):
    """One phrase holds most rows; equal scores go by count, then by phrase in byte order."""
    rows = [("hot phrase here", "en")] * 500 + [(f"{a} {b}", "en") for a, b in (("z", "é"), ("z", "a"), ("Z", "b")) for _ in range(5)] + [("lone", None)] * 3
    assert found(spark, rows, least=5) == brute(rows, least=5)


def test_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, C.collocations(odd, least=2, top=50).collect()))
    assert got == brute([(r.text, r.lang) for r in odd.collect()], least=2, top=50)
    assert C.collocations(empty).count() == 0
    assert C.collocations(odd.withColumn("rank", odd["doc_id"]), least=10**6).count() == 0


def test_blocks_without_words(spark):
    rows = [(".,;", "xx"), (" \t ", "yy"), ("a b", "zz"), ("a b", "zz")]
    assert found(spark, rows, least=2, block=1) == brute(rows, least=2) == [("zz", 1, "a b", 2, 2, 2, 4, 2000)]


def test_wide_products(spark):
    """Scores of counts whose products pass 64 bits."""
    phrases = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 1, 7 * 10**11), ("en", "a b", 2, 5 * 10**11)], "lang string, phrase string, size int, f long")
    parts = {r.phrase: r for r in C.with_part_counts(phrases).collect()}
    assert (parts["a b"].l1, parts["a b"].r1) == (3 * 10**12, 7 * 10**11)


def test_filter_drops_nothing():
    rng = np.random.default_rng(0)
    some = rng.integers(0, 1 << 63, 5000, np.uint64)
    bits = np.zeros((1 << 16) // 8, np.uint8)
    for at in C.Filter.places(some, 1 << 16):
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    asked = C.Filter(bits)
    assert asked.has(some).all()
    assert asked.has(rng.integers(0, 1 << 63, 5000, np.uint64)).mean() < 0.1
