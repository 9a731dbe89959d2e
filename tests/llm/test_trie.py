import hashlib
import random
import re
import zlib

import pytest

from tallyloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, owner string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, every=20, heads=4):
    """The trie by its definition, with whole prefixes as keys."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(prefix))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children(prefix)),
                    sum(not children(p) for p in below), sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    out = trie.prefix_trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in out.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in out.collect()), key=repr)


ODD = [
    (20, 0, "user", "hello  there", 9, "x"), (20, 1, "assistant", "hi\tyou", 9, "x"), (20, 2, "user", "more", 9, None), (21, 0, "user", "hello  there", 0, "x"),
    (21, 1, "assistant", "hi\tyou", 1, "x"), (21, 1, "assistant", "hi\tyou", 1, "x"), (22, None, None, None, 1, "x"), (22, 5, None, None, 1, "x"),
    (23, 3, "user", "", 1, "x"), (23, 3, "a", "tie", 1, "x"), (23, 3, "a", "tie two", 1, "x"), (None, 0, "user", "no conversation", 1, "x"), (45, 0, "u", "alone", 1, "x"),
    (47, 0, "u", "alone", 1, "x"), (-3, 0, "user", "hello  there", 1, "x"), (-25, 0, "user", "minus", 1, "x"), (24, 0, "user", "long " * 50_000, 1, "x"),
    (25, 0, "ab", "c", 1, "x"), (26, 0, "a", "bc", 1, "x")]


def test_odd_rows(spark):
    assert made(spark, ODD) == brute(ODD)
    assert made(spark, []) == []


def test_turnless(spark):
    """A conversation that lends nothing and has no turns of its own left is only in the root, which may then be a leaf."""
    lone = [(c, 0, "u", "x", 1, "x") for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1]
    assert len(lone) > 50
    got = made(spark, lone)
    assert got == brute(lone) and len(got) == 1 and got[0][5] == 1


@pytest.mark.parametrize("parts, joined", [(4096, 8192), (7, 3)])
def test_random(spark, monkeypatch, parts, joined):
    """Few texts, so that prefixes meet; a third of all turns in one conversation, many copies of another."""
    monkeypatch.setattr(trie, "PARTS", parts)  # 7: most keys are joined by a shuffle, only the hottest are broadcast
    monkeypatch.setattr(trie.joined_ids, "__defaults__", (joined,))
    rnd = random.Random(parts)
    rows = []
    for c in range(120):
        copy = c % 3 == 0
        for turn in range(5 if copy else rnd.randrange(1, 6)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"same {turn} " * 2 if copy else rnd.choice(["a", "b c", "d  e f"]), 0, "x"))
    rows += [(60, t, "user", rnd.choice(["a", "b c"]), 0, "x") for t in range(5, 60)]
    rnd.shuffle(rows)
    assert made(spark, rows) == brute(rows)


def test_other_heads(spark):
    rows = [(c, t, "u", f"{(c * t) % 3} w", 0, "x") for c in range(40) for t in range(6)]
    assert made(spark, rows, every=5, heads=7) == brute(rows, 5, 7)


def test_power(spark):
    exponents = [0, 1, 255, 256, 70_000, 2**24 + 3, 2**32 - 1]
    df = spark.createDataFrame([(e,) for e in exponents], "e long")
    for base, prime in zip(trie.BASES, trie.PRIMES):
        assert [r[0] for r in df.select(trie.power(df["e"], base, prime)).collect()] == [pow(base, e, prime) for e in exponents]


def test_mixed_prefixes_are_found(spark, monkeypatch):
    """Fingerprints that say nothing: the check of turn references stops the run."""
    monkeypatch.setattr(trie, "PRIMES", (2, 2, 2))
    rows = [(c, t, "u", f"{c} {t}", 0, "x") for c in range(40) for t in range(6)]
    with pytest.raises(ValueError):
        trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
