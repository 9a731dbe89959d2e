"""Registered queries of this folder: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import collocations, harmonic, language, mixing, neardup, packing, pii, search, tokencount, toxicity, trie, vectors, warc
from tallyloom.llm.common import HELD_OUT, fold
from tallyloom.plans.base import Tables

#: The key of the registered query; who uses the operator passes one that is kept secret.
KEY = "public example key"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_mix_sources")
def op1(t: Tables) -> DataFrame:
    return mixing.mix_report(t.documents)


@query("op2_near_duplicates", """
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    f AS (
        SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct([array_to_string(words[i:i+4], ' ') for i in range(1, len(words) - 3)]) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
    s AS (SELECT doc_id, hash(shingle) AS shingle FROM f QUALIFY count(*) OVER (PARTITION BY hash(shingle)) > 1),
    p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (
        SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
    r(doc_id, reach) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach),
    c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""")
def op2(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents, 85)


@query("op3_toxicity")
def op3(t: Tables) -> DataFrame:
    model = toxicity.train(*toxicity.sample(t.documents, t.labels))
    return toxicity.with_toxicity(t.documents.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op4_pseudonyms")
def op4(t: Tables) -> DataFrame:
    return pii.protect(t.documents.select("doc_id", "text"), KEY)


@query("op5_search", """
    WITH w AS (
        SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word FROM documents),
    tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2),
    dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
    c AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl) / count(*) AS average FROM documents),
    idf AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, c GROUP BY word, n),
    s AS (
        SELECT q.doc_id AS query_id, d.doc_id, sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / average))) AS score
        FROM tf q JOIN tf d ON q.word = d.word JOIN idf ON idf.word = q.word JOIN dl ON dl.doc_id = d.doc_id, c
        WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def op5(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return search.search(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


@query("op6_token_counts")
def op6(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    counted = tokencount.with_token_count(docs, F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op7_language")
def op7(t: Tables) -> DataFrame:
    model = language.train(language.sample(t.documents))
    return language.identify(t.documents.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "language.lang_pred", "language.score", "language.ambiguous")


@query("op8_warc", r"""
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
               1577836800 + 60 * coalesce(page_id % 1000000000, 0) AS captured_at,
               lower(regexp_replace(regexp_replace(coalesce(url, ''), '[\r\n]+', '%0A', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://', '')) AS plain FROM pages),
    h AS (
        SELECT *, regexp_replace(regexp_extract(plain, '^(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS host,
               regexp_replace(regexp_replace(plain, '^[^/?#]*', ''), '#.*$', '') AS rest FROM p),
    u AS (
        SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM h),
    k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to, url_key, captured_at,
           row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS LAST) - 1 AS position
    FROM u LEFT JOIN k USING (payload_digest)""")
def op8(t: Tables) -> DataFrame:
    return warc.archive_pages(t.pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "position")


@query("op9_pack")
def op9(t: Tables) -> DataFrame:
    pieces, places = packing.pack_documents(t.documents, public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(places, ["row_id", "piece"]).drop("row_id")


@query("op10_near_vectors", """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v),
    e AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
    r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.reach),
    c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
    n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""")
def op10(t: Tables) -> DataFrame:
    return vectors.near_vectors(t.embeddings)


@query("op11_collocations", r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
    g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS words
        FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k),
    f AS MATERIALIZED (SELECT lang, k, array_to_string(words, ' ') AS phrase, count(*) AS a FROM g GROUP BY 1, 2, 3),
    t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY 1),
    c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 100),
    inside AS (
        SELECT DISTINCT c.lang, c.phrase FROM c JOIN c d ON d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
            AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
    cut AS (
        SELECT c.lang, c.phrase, c.a, u.pos, l.a AS l, r.a AS r, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
        FROM c ANTI JOIN inside USING (lang, phrase) JOIN t ON t.lang = c.lang JOIN (SELECT unnest(range(1, 5)) AS pos) u ON u.pos < c.k
        JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:u.pos], ' ')
        JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[u.pos + 1:], ' ')),
    s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) AS first FROM cut),
    k AS (SELECT s.*, n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s JOIN t USING (lang) WHERE first = 1)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM k WHERE rank <= 2000""")
def op11(t: Tables) -> DataFrame:
    return collocations.collocations(t.documents)


@query("op12_harmonic_pack")
def op12(t: Tables) -> DataFrame:
    pieces = harmonic.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: CRC-32 of a decimal number, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


@query("op13_prefix_trie", rf"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest FROM conversations WHERE conv_id IS NOT NULL),
    o AS (
        SELECT conv_id, list(concat(strlen(role), ':', role, text) ORDER BY turn NULLS FIRST, role, digest) AS turns,
               list(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ORDER BY turn NULLS FIRST, role, digest) AS words
        FROM t GROUP BY 1),
    h AS (SELECT *, {CRC} % 4 AS h FROM o),
    b AS (
        SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h], h.turns[h + 1:]) AS turns, list_concat(coalesce(b.words, [])[1:h], h.words[h + 1:]) AS words
        FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns, words FROM b),
    r AS (
        SELECT conv_id, depth, turns[1:depth] AS prefix, turns[1:depth - 1] AS above, coalesce(words[depth], 0) AS words, len(turns) = depth AS ends FROM p),
    n AS (
        SELECT depth, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM r GROUP BY 1, 2),
    c AS (SELECT n.*, (SELECT count(*) FROM n d WHERE d.depth = n.depth + 1 AND d.above = n.prefix) AS n_children FROM n),
    s AS (
        SELECT a.depth, a.prefix, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved
        FROM c a JOIN c v ON v.depth >= a.depth AND v.prefix[1:a.depth] = a.prefix GROUP BY 1, 2)
    SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
    FROM c JOIN s USING (depth, prefix) LEFT JOIN c u ON u.depth = c.depth - 1 AND u.prefix = c.above""")
def op13(t: Tables) -> DataFrame:
    return trie.prefix_trie(t.conversations)
