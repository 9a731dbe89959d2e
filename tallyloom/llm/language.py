"""Language identification with error-correcting output codes.

Each language has a code word; one binary n-gram classifier per bit predicts whether a text's language has that bit set.
A text gets the language whose code word has the smallest loss, each bit weighted by how well its classifier separates; the
text is flagged as ambiguous where the predicted bits are further from the code word than the code can correct.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import HELD_OUT, WordRows, fold, letters, subwords

#: Texts learned from, over all languages, and the longest of them. Sampled by a hash of the id, evenly by language.
SAMPLE, LONGEST = 6000, 20_000
SIZES, BITS = (1, 2, 3), 15
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # n-gram buckets x bits
    scale: np.ndarray  # per bit: what a mean n-gram weight is multiplied with
    trust: np.ndarray  # per bit: weight of its loss
    corrects: int  # wrong bits that the code can correct


def code_words(languages: int) -> np.ndarray:
    """Code words of +1 and -1: every split of the languages while there are few, else the best of seeded random codes."""
    if languages <= 5:
        splits = [(1, *s) for s in itertools.product((1, -1), repeat=languages - 1)][1:]
        return np.array(splits or [(1,) * languages], float).T
    bits, rng = 6 * int(np.ceil(np.log2(languages))), np.random.default_rng(7)

    def nearest(code: np.ndarray) -> int:
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        return int(apart.min())

    tries = (np.array([rng.permutation(np.resize((1, -1), languages)) for _ in range(bits)]).T for _ in range(60))
    return max(tries, key=nearest).astype(float)


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) of at most about ``size`` rows, evenly by language as far as there are rows."""
    known = docs.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & (F.length("text") <= LONGEST))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = {lang: min(1.0, size / len(counts) / n) for lang, n in counts.items()}
    rate = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / F.lit(1 << 20)
    return [tuple(r) for r in known.where(draw < rate).select("text", "lang").limit(2 * size).collect()]


def train(rows: list[tuple[str, str]]) -> Model | None:
    """Model of (text, lang) rows; None where there are none, and then every text is unknown."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    codes = code_words(len(languages))
    counts = np.zeros((len(languages), 1 << BITS))
    means, labels = [], []
    for lang, text in ((languages.index(lang), text) for text, lang in rows):
        buckets, _ = subwords([w for x in text.lower().split() if (w := letters(x))], SIZES, BITS)
        seen, n = np.unique(buckets, return_counts=True)
        counts[lang, seen] += n
        means.append((seen, n / max(1, n.sum())))
        labels.append(lang)
    shares = (counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * counts.shape[1])
    weights = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
    for bit, code in enumerate(codes.T):  # log odds of an n-gram where the bit is set, languages counting alike
        yes, no = shares[code > 0], shares[code < 0]
        if len(yes) and len(no):
            weights[:, bit] = np.log(yes.mean(0)) - np.log(no.mean(0))
    margins = np.array([n @ weights[seen] for seen, n in means]) * codes[labels]
    scale = 4 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
    trust = np.maximum((margins > 0).mean(0) - 0.5, 0.01)
    apart = (codes.shape[1] - codes @ codes.T) / 2 + 1e9 * np.eye(len(languages))
    return Model(languages, codes, weights, scale, trust / trust.sum(), int((min(apart.min(), codes.shape[1]) - 1) // 2))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and ambiguity of each row of bit margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.codes[None]) @ model.trust
    best = loss.argmin(1)
    fit = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    wrong = (np.sign(margins) != model.codes[best]).sum(1)
    return best, fit.max(1) / fit.sum(1), wrong > model.corrects


def predictor(model: Model | None):
    """A pandas UDF: text -> (lang_pred, score, ambiguous)."""

    def word_sums(words: list[str]) -> np.ndarray:
        """Summed weights and number of the n-grams of each word; zeros where it has no letter."""
        plain = [letters(w) for w in words]
        buckets, owners = subwords(plain, SIZES, BITS)
        columns = [np.bincount(owners, model.weights[buckets, b], len(words)) for b in range(model.weights.shape[1])]
        sums = np.stack([*columns, np.bincount(owners, minlength=len(words))], axis=1)
        return np.where(np.array([[w != ""] for w in plain]), sums, 0)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = model and WordRows(word_sums, model.weights.shape[1] + 1)
        for texts in batches:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "ambiguous": True}, index=range(len(texts)))
            if model and len(texts):
                sums = np.array([table.of((t or "").lower().split()).sum(0, dtype=np.float64) for t in texts])
                known = sums[:, -1] > 0
                best, score, ambiguous = decode(model, sums[known, :-1] / sums[known, -1:] * model.scale)
                out.loc[known, "lang_pred"] = [model.languages[k] for k in best]
                out.loc[known, "score"], out.loc[known, "ambiguous"] = score, ambiguous
            yield out

    return predict


def identify(docs: DataFrame, model: Model | None, text: Column | None = None) -> DataFrame:
    """``docs`` and a struct ``language`` of lang_pred, score (0 to 1) and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0 and ambiguous; so is every text where nothing could be
    learned. Repeated rows get the same answer. Whole texts are read, whatever their length.
    """
    return docs.withColumn("language", predictor(model)(F.coalesce(F.col("text") if text is None else text, F.lit(""))))
