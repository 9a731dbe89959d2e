"""Toxicity of whole texts: subword embeddings, averaged, under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, so unseen spellings share vectors with known ones. A
window of words is the mean of its words, and a text is as toxic as its most toxic window: one insult in a long text counts.
Embeddings and softmax are trained jointly by gradient steps on the windows that the current model finds most toxic. The
model is linear in the vectors, so scoring needs one number per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import HELD_OUT, WordRows, fold, letters, subwords

#: Labelled texts learned from, of each label, and the longest of them; chosen by a hash of the id.
SAMPLE, LONGEST = 2500, 20_000
SIZES, BITS, DIM = (3, 4, 5, 6), 17, 8
WINDOW, STEP = 8, 4
ROUNDS, BATCH, RATE, DECAY = 16, 256, 0.5, 0.0005
#: An n-gram is learned if so many texts have it, and starts from its odds if they differ by so many standard errors.
SEEN, SIGNIFICANT = 3, 4.0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per n-gram bucket: difference of its logits
    bias: float
    slope: float
    shift: float


def words_of(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := letters(x))]


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows of a text of n words; the last window ends with the text."""
    return np.append(np.arange(0, max(n - WINDOW, 0), STEP), max(n - WINDOW, 0))


def window_means(values: np.ndarray) -> np.ndarray:
    """Mean of each window of one text's word values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    starts = window_starts(len(values))
    stops = np.minimum(starts + WINDOW, len(values))
    return (total[stops] - total[starts]) / np.maximum(stops - starts, 1)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list[tuple[str, int]], float]:
    """(text, toxic) of at most ``size`` rows per label, and the share of toxic rows among all. The ids are chosen first, from the labels alone; then one pass
    over the texts keeps those rows, with a broadcast of at most twice ``size`` ids."""
    usable = labels.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = usable.where("toxic = 1").orderBy(order).limit(size).union(usable.where("toxic = 0").orderBy(order).limit(size))
    texts = docs.select("doc_id", "text").where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(chosen.select("doc_id", "toxic").distinct()), "doc_id").limit(4 * size)
    share = usable.agg(F.avg("toxic")).first()[0] or 0.0
    return [(r["text"], int(r["toxic"])) for r in rows.collect()], float(share)


def train(rows: list[tuple[str, int]], prevalence: float | None = None) -> Model:
    """Model of (text, toxic) rows; with one label only, a constant. ``prevalence`` is the share of toxic texts where
    the model is to be used, if it isn't that of the rows."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 3.0 if labels.any() else -3.0)
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t, _ in rows]
    buckets, owners = subwords(list(vocabulary), SIZES, BITS)
    order = np.argsort(owners, kind="stable")
    buckets, counts = buckets[order], np.bincount(owners, minlength=len(vocabulary))
    first = np.concatenate([[0], np.cumsum(counts)])
    rng = np.random.default_rng(11)
    lean, known = warm_start(texts, labels, buckets, first)
    table = rng.normal(0, 0.02, (1 << BITS, DIM)) * known[:, None]
    soft, bias = rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    table[:, 0], soft[0] = lean, (-0.5, 0.5)
    squares = np.ones(1 << BITS)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def tops(spread: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Most toxic window of each text under the current model, with noise that fades, and its logit."""
        gap = table @ (soft[:, 1] - soft[:, 0])
        word = np.add.reduceat(np.append(gap[buckets], 0), first[:-1]) / np.maximum(counts, 1) if len(vocabulary) else gap[:0]
        found, logits = [], []
        for ids in texts:
            means, starts = window_means(word[ids]), window_starts(len(ids))
            k = int(np.argmax(means + spread * rng.gumbel(size=len(means))))
            found.append(ids[starts[k] : starts[k] + WINDOW])
            logits.append(means.max())
        return found, np.array(logits) + bias[1] - bias[0]

    for turn in range(ROUNDS):
        windows, _ = tops(1.0 / (turn + 1) ** 2)
        for batch in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // BATCH)):
            used = [windows[k] for k in batch]
            sizes = np.array([len(u) for u in used])
            ids = np.concatenate(used)
            row = np.repeat(np.arange(len(used)), sizes)
            grams = counts[ids]
            at = np.repeat(first[ids] - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams) + np.arange(grams.sum())
            bucket, row = buckets[at], np.repeat(row, grams)
            share = np.repeat(1 / np.maximum(grams, 1), grams) / np.maximum(sizes, 1)[row]
            bag = np.stack([np.bincount(row, table[bucket, d] * share, len(used)) for d in range(DIM)], axis=1)
            logit = bag @ soft + bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(used)), labels[batch]] -= 1
            error = prob * weight[batch, None] * (len(used) / weight[batch].sum())
            back = error @ soft.T
            soft -= RATE * bag.T @ error / len(used)
            bias -= RATE * error.mean(0)
            touched, slot = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(slot, back[row, d] * share, len(touched)) for d in range(DIM)], axis=1)
            squares[touched] += (step**2).sum(1)
            moved = table[touched] * (1 - DECAY) - 4 * RATE * step / np.sqrt(squares[touched])[:, None]
            table[touched] = moved * known[touched, None]
    logits = tops(0.0)[1]
    slope, shift = calibrate(logits, labels)
    if prevalence:
        shift += odds(min(prevalence, 0.99)) - odds(labels.mean())
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), slope, shift)


def odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def warm_start(texts: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where training begins: for each n-gram the log odds of being in a toxic text, 0 unless significant; and which n-grams
    occur in enough texts to be learned at all."""
    size, toxic = 1 << BITS, labels == 1
    seen = np.zeros((2, size))
    for ids, y in zip(texts, labels):
        words = np.unique(ids)
        grams = np.unique(np.concatenate([buckets[first[w] : first[w + 1]] for w in words] or [buckets[:0]]))
        seen[int(y), grams] += 1
    n = np.array([(~toxic).sum(), toxic.sum()])
    share = (seen + 0.5) / (n + 1)[:, None]
    mean = (seen.sum(0) + 1) / (n.sum() + 2)
    z = (share[1] - share[0]) / np.sqrt(mean * (1 - mean) * (1 / n).sum())
    lean = np.log(share[1] / (1 - share[1])) - np.log(share[0] / (1 - share[0]))
    return np.where(np.abs(z) > SIGNIFICANT, lean, 0), seen.sum(0) >= SEEN


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (logit, label), by a few damped Newton steps."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2) * len(labels) / 100
        beta += 0.7 * np.linalg.solve(hessian, x.T @ (labels - p) - 0.05 * beta * len(labels) / 100)
    return float(beta[0]), float(beta[1])


def scorer(model: Model):
    """A pandas UDF: text -> score from 0 to 1."""

    def word_logits(words: list[str]) -> np.ndarray:
        """Mean logit of each word's n-grams, not a number where it has no letter."""
        plain = [letters(w) for w in words]
        buckets, owners = subwords(plain, SIZES, BITS)
        n = np.bincount(owners, minlength=len(words))
        mean = np.bincount(owners, model.weights[buckets], len(words)) / np.maximum(n, 1)
        return np.where(np.array([w != "" for w in plain], bool), mean, np.nan)[:, None]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = WordRows(word_logits, 1)

        def one(text: str) -> float:
            values = table.of(text.lower().split())[:, 0]
            logit = window_means(values[~np.isnan(values)]).max() + model.bias
            return 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -30, 30)))

        for texts in batches:
            yield texts.map(one).astype("float64")

    return score


def with_toxicity(docs: DataFrame, model: Model, text: Column | None = None, name: str = "score") -> DataFrame:
    """``docs`` and a double ``name`` from 0 to 1. Null and empty texts, and texts without a letter, get the score of a
    window without words. Repeated rows score alike; texts of any length are read whole."""
    return docs.withColumn(name, scorer(model)(F.coalesce(F.col("text") if text is None else text, F.lit(""))))
