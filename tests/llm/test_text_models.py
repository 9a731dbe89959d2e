"""Language, toxicity and token counts."""

import zlib

import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from tallyloom.llm import language, tokencount, toxicity

FOLDER = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.sample(docs)
    assert not {t for t, _ in rows} & {r.text for r in docs.collect() if held_out(r.doc_id)} - {r.text for r in docs.collect() if not held_out(r.doc_id)}
    got = language.identify(docs, language.train(rows)).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    right, flagged, n = got.agg(F.avg((F.col("language.lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("language.ambiguous").cast("int")), F.count("*")).first()
    assert right > 0.98 and flagged < 0.02 and n > 200


def test_code_words():
    for n in (1, 2, 3, 4, 5, 6, 20):
        codes = language.code_words(n)
        assert len({tuple(c) for c in codes}) == n
    codes = language.code_words(20)
    assert min((a != b).sum() for k, a in enumerate(codes) for b in codes[:k]) >= 7


def test_language_odd_rows(spark, odd, empty):
    model = language.train([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")])
    rows = {r.doc_id: r.language for r in language.identify(odd, model).collect()}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 and rows[d].ambiguous for d in (3, 4, 5, 6, 7))
    assert rows[1].lang_pred == "en" and 0 < rows[1].score <= 1
    assert language.identify(empty, model).count() == 0
    assert {r.language.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.sample(empty) == [] and language.train([]) is None


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows, share = toxicity.sample(docs, labels)
    got = toxicity.with_toxicity(docs.join(labels, "doc_id"), toxicity.train(rows, share)).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    rows = [(r.score, r.toxic) for r in got.select("score", "toxic").collect()]
    bad = [s for s, y in rows if y == 1]
    good = [s for s, y in rows if y == 0]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    found = sum(s >= toxicity.THRESHOLD for s in bad)
    wrong = sum(s >= toxicity.THRESHOLD for s in good)
    assert wins > 0.93 and found > 0.65 * len(bad) and found > 4 * wrong


def test_toxicity_learns_spellings(spark):
    rows = [(f"plain words about topic {k} and other things", 0) for k in range(60)] + [(f"you stupid idiot number {k} go away", 1) for k in range(40)]
    score = toxicity.scorer(toxicity.train(rows)).func
    clean, seen, unseen = next(score(iter([pd.Series(["plain topic and things", "what a stupid idiot", "what a stuupid idiott"])])))
    assert clean < 0.2 < 0.6 < seen and unseen > clean


def test_toxicity_odd_rows(spark, odd, empty):
    for rows in ([], [("a b", 0)], [("nice day", 0), ("stupid day", 1)] * 5):
        model = toxicity.train(rows)
        assert all(0 <= r.score <= 1 for r in toxicity.with_toxicity(odd.drop("score"), model).collect())
        assert toxicity.with_toxicity(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    rows, share = toxicity.sample(odd, labels)
    assert all(y in (0, 1) for _, y in rows) and 0 <= share <= 1


def test_token_counts(spark, odd, empty):
    model = tokencount.load(PIECES)
    extra = ["", " ", "  two  blanks  ", "▁mark", "a\nb\n\nc\t d", "<s>hi</s> <unk>", "emoji 🙂🙂 ​ x", "é" * 500, "\0x y", "Hello, world! I'm here."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(extra)], "doc_id long, text string").union(odd.select("doc_id", "text"))
    docs = docs.union(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"))
    rows = tokencount.with_token_count(docs, F.col("text"), PIECES).collect()
    assert [r.n_tokens for r in rows] == [len(model.encode(r.text or "")) for r in rows]
    assert tokencount.with_token_count(empty, F.col("text"), PIECES).count() == 0


def test_whole_units_are_proved():
    model = tokencount.load(PIECES)
    whole = tokencount.whole_units(model)
    assert len(whole) > 10_000 and all(len(model.encode(u[1:])) == 1 for u in list(whole)[:500])
