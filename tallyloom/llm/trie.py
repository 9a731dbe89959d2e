"""Prefix trie of conversations that share heads, from fingerprints alone: rebuilt texts are never put together.

A conversation is rebuilt from the first turns of its base and its own later turns. The fingerprint of a row of turns is an
element (length, hash) of a monoid: (m, x) * (n, y) = (m + n, x + y * B**m), taken modulo three primes at once. So the head
of a base and the running products of a conversation's own turns are fingerprinted where they are stored, each once, and
every prefix of a rebuilt conversation is one product of two such elements. A prefix is then a row of numbers: a node of the
trie is what one fingerprint and depth hold together, and it is checked that all its members refer to the same stored turn
(by 120 bits of the SHA-256 of role and text) below the same parent.

Subtrees need no walk over the trie. The smallest member of a node owns it. A conversation owns its nodes from some depth on,
so it meets the nodes of others only down to its depth ``shared``; what a subtree adds up is a sum over the node's members of
what each of them has below. Conversations and nodes may be hot: a key that holds at least 1/PARTS of all rows is looked up in
a broadcast table of at most PARTS rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, stash
from tallyloom.operators import ordered as O

#: Conversations whose number is a multiple of EVERY lend their first turns; HEADS bounds how many (exclusive).
EVERY, HEADS = 20, 4
#: Moduli below 2**31 (products fit 64 bits) and the bases of the powers.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587)
BASES = (1_103_515_245, 1_566_083_941, 1_812_433_253)
PARTS = 4096
#: Numbers of one row of joined ids.
JOINED = 8192
KEY = [f"k{i}" for i in range(len(PRIMES))]
ABOVE = [f"p{i}" for i in range(len(PRIMES))]


def power(exponent: Column, base: int, prime: int) -> Column:
    """base ** exponent modulo prime, for exponents below 2**32: one table of 256 powers for each byte."""
    out = None
    for byte in range(4):
        table, step = [1], pow(base, 256**byte, prime)
        for _ in range(255):
            table.append(table[-1] * step % prime)
        part = F.get(F.expr(f"array({','.join(f'{x}L' for x in table)})"), F.shiftright(exponent, 8 * byte).bitwiseAND(F.lit(255)).cast("int"))
        out = part if out is None else out * part % prime
    return out


def word_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), "[^w]+", "")).cast("long")


def stored_turns(conversations: DataFrame) -> DataFrame:
    """conv, n (1-based place), the turn's letters in the monoid (t0...), its content address (c0, c1) and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), word_count(text).alias("words"))
    hexed = lambda at, n: F.conv(F.substring("digest", at, n), 16, 10).cast("long")
    letters = [(hexed(1 + 8 * i, 8) % p).alias(f"t{i}") for i, p in enumerate(PRIMES)]
    placed = O.ordinal(turns, ["conv"], ["turn", "role", "digest"], "n")
    return placed.select("conv", "n", "words", *letters, hexed(25, 15).alias("c0"), hexed(40, 15).alias("c1"))


def meet(rows: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with a table of one row per key, whose ``rows_of_key`` says how many of the ``total`` rows have the key."""
    hot = F.col("rows_of_key") * PARTS >= total
    often = F.broadcast(one.where(hot))  # at most PARTS keys
    rest = rows.join(F.broadcast(one.where(hot).select(*keys)), keys, "left_anti").join(one.where(~hot), keys)
    return rows.join(often, keys).unionByName(rest).drop("rows_of_key")


def prefixes(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv, depth, fingerprint (k0...), that of the prefix before it
    (p0...), content address of its last turn, ``words`` of it, words ``upto`` there, and whether the conversation ends there."""
    turns = stash(stored_turns(conversations), "turns")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    later = F.col("n") > taken
    primes = list(enumerate(zip(PRIMES, BASES)))
    own = turns.withColumn("h", taken)
    for i, (p, b) in primes:
        own = own.withColumn(f"m{i}", F.when(later, F.col(f"t{i}") * power(F.col("n") - 1 - F.col("h"), b, p) % p).otherwise(F.lit(0).cast("long")))
    own = O.frames(own, ["conv"], ["n"], upto=O.total(F.when(later, F.col("words")).otherwise(0)), **{f"s{i}": O.total(F.col(f"m{i}")) for i, _ in primes})

    # at most heads - 1 turns of a conversation
    head = turns.where((F.col("n") < heads) & (F.col("conv") % every == 0)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("n", "words", *[f"t{i}" for i, _ in primes], "c0", "c1"))).alias("head"))
    counts = turns.groupBy("conv").agg(F.max("n").alias("rows_of_key")).withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % every)
    none = F.array().cast(head.schema["head"].dataType)
    convs = counts.join(head, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("h").cast("int")))
    lent = F.size("head").cast("long")
    convs = convs.withColumn("lent", lent).withColumn("ends", lent + F.greatest(F.col("rows_of_key") - F.col("h"), F.lit(0)))
    for i, (p, b) in primes:  # the head's own product, and what it multiplies the rest with
        product = lambda upto: F.aggregate(
            F.slice("head", F.lit(1), upto), F.lit(0).cast("long"), lambda x, t: (x + t[f"t{i}"] * F.element_at(F.array(*[F.lit(pow(b, k, p)) for k in range(heads)]), t["n"].cast("int"))) % p)
        convs = convs.withColumn(f"h{i}", product(F.size("head"))).withColumn(f"w{i}", F.get(F.array(*[F.lit(pow(b, k, p)) for k in range(heads)]), F.size("head")).cast("long"))
        convs = convs.withColumn(f"x{i}", F.transform(F.sequence(F.lit(0), F.size("head")), product))
    convs = stash(convs.withColumn("lent_words", F.aggregate("head", F.lit(0).cast("long"), lambda x, t: x + t["words"])), "rebuilt")
    total = turns.count()

    short = lambda names: [F.col(n).cast("int").alias(n) for n in names]
    seen = convs.select("conv", "ends", "head", *[f"x{i}" for i, _ in primes], F.explode(F.sequence(F.lit(0), F.size("head"))).alias("d"))
    last = F.get("head", F.col("d") - 1)
    first = seen.select(
        "conv", F.col("d").cast("long").alias("depth"), *[F.get(f"x{i}", F.col("d")).alias(KEY[i]) for i, _ in primes],
        *[F.coalesce(F.get(f"x{i}", F.col("d") - 1), F.lit(0)).alias(ABOVE[i]) for i, _ in primes],
        *[F.coalesce(last[c], F.lit(0)).alias(c) for c in ("c0", "c1", "words")],
        F.aggregate(F.slice("head", F.lit(1), F.col("d")), F.lit(0).cast("long"), lambda x, t: x + t["words"]).alias("upto"), (F.col("d") == F.col("ends")).alias("last"))
    small = convs.select("conv", "lent", "ends", "lent_words", "rows_of_key", *[f"h{i}" for i, _ in primes], *[f"w{i}" for i, _ in primes])
    joined = meet(own.where(later), small, ["conv"], total)
    depth = F.col("lent") + F.col("n") - F.col("h")
    element = lambda i, p, s: (F.col(f"h{i}") + F.col(f"w{i}") * (s % p)) % p
    rest = joined.select(
        "conv", depth.alias("depth"), *[element(i, p, F.col(f"s{i}")).alias(KEY[i]) for i, (p, _) in primes],
        *[element(i, p, F.col(f"s{i}") - F.col(f"m{i}")).alias(ABOVE[i]) for i, (p, _) in primes],
        "c0", "c1", "words", (F.col("lent_words") + F.col("upto")).alias("upto"), (depth == F.col("ends")).alias("last"))
    both = first.unionByName(rest)
    return both.select("conv", "depth", *short(KEY), *short(ABOVE), "c0", "c1", "words", "upto", "last")


def joined_ids(ends: DataFrame, keys: list[str], size: int = JOINED) -> DataFrame:
    """keys and ``ends_sha256``: SHA-256 of the ascending numbers ``conv`` of each key, joined by commas. Numbers are joined in
    rows of at most ``size`` where they are sorted; one task then streams the rows of a key through the hash."""
    kept = [*keys, O.SLICE]
    ranged = O.dealt(ends.select(*keys, "conv"), keys, ["conv"], None).sortWithinPartitions(*keys, "conv").select(*kept, "conv")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in columns[:-1]:
                change |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            starts = np.unique(np.concatenate([starts, np.arange(0, batch.num_rows, size)]))
            texts = list(map(str, columns[-1].tolist()))
            ends_at = np.append(starts[1:], batch.num_rows)
            lines = [",".join(texts[a:b]) for a, b in zip(starts.tolist(), ends_at.tolist())]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in columns[:-1]], pa.array(np.arange(part, part + len(starts))), pa.array(lines)],
                                             names=[*kept, "part", "line"])
            part += len(starts)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done: list[tuple] = []
            *columns, lines = [c.to_pylist() for c in batch.columns]
            for here, line in zip(zip(*columns[: len(keys)]), lines):
                if here == key:
                    sha.update(b"," + line.encode())
                    continue
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = here, hashlib.sha256(line.encode())
            yield out(done)
        if key is not None:
            yield out([(*key, sha.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())], names=[*keys, "ends_sha256"])

    kinds = ", ".join(f"{k} long" for k in kept)
    lines = ranged.mapInArrow(join, f"{kinds}, part long, line string")
    sorted_lines = lines.repartition(*keys).sortWithinPartitions(*kept, "part")
    return sorted_lines.select(*kept, "part", "line").mapInArrow(digest, ", ".join(f"{k} long" for k in keys) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """Nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text, any other columns).

    Conversation c is rebuilt from the first h turns of conversation c - c % ``every`` (h = crc32 of its decimal number modulo
    ``heads``; all if there are fewer, none if there is none) and its own turns after its first h. Turns are ordered by turn
    with null first; equal ones by role, then by the SHA-256 of role and text; repeated rows are turns of their own. A null
    role or text is empty; rows without a conv_id belong to no conversation and are left out. Result, all long but the last:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table
    has no node, not even the root.
    """
    rows = stash(prefixes(conversations, every, heads), "prefixes")
    node = ["depth", *KEY]
    checked = [*ABOVE, "c0", "c1"]
    nodes = stash(rows.groupBy(*node).agg(
        F.min("conv").alias("owner"), F.count("*").alias("rows_of_key"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.greatest(*[(F.min(c) != F.max(c)).cast("int") for c in checked]).alias("mixed")), "nodes")
    facts = nodes.agg(F.max("mixed").alias("mixed"), F.sum("rows_of_key").alias("total")).first()
    if facts["mixed"]:
        raise ValueError("prefixes of different turns have one fingerprint: choose other BASES")
    total = facts["total"] or 0
    one = nodes.withColumn("childless", F.col("n_ends") == F.col("rows_of_key")).drop("mixed", "n_ends")
    placed = stash(meet(rows.select("conv", *node, "words", "upto", "last"), one, node, total).drop(*KEY), "placed")

    mine = F.col("owner") == F.col("conv")
    alien = F.struct("depth", "upto", "owner")
    members = stash(placed.groupBy("conv").agg(
        F.max(F.when(~mine, alien)).alias("shared"), F.max(mine & F.col("childless") & F.col("last")).cast("long").alias("leaf"),
        F.max("depth").alias("ends"), F.count("*").alias("rows_of_key")), "members")
    met = meet(placed, members, ["conv"], total)
    shared = F.coalesce("shared.depth", F.lit(-1))
    above = F.when(F.col("depth") - 1 > shared, F.col("conv")).when(F.col("depth") > 0, F.col("shared.owner"))
    summed = met.groupBy("owner", "depth").agg(
        F.max(F.when(mine, above)).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum(((F.col("depth") >= shared) & (F.col("depth") < F.col("ends"))).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") <= shared, F.col("shared.upto") - F.col("upto") + F.col("words")).otherwise(0)).cast("long").alias("saved_tokens"))
    ends = joined_ids(placed.where("last"), ["owner", "depth"])
    return summed.join(ends, ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
