"""Token counts of whole texts under a piece vocabulary.

No piece of the vocabulary has a blank after another character, so merges never pass the start of a run of blanks: a text
is a row of units (blanks and what follows them), and its count is the sum over its units. ``whole_units`` proves which
vocabulary strings come out as one token when encoded alone; units among them are counted without the library, all others
are encoded once per task and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Memo

#: The mark that stands for a blank in vocabulary strings.
MARK = "▁"


def load(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def whole_units(model) -> set[str]:
    """Vocabulary strings that start with one blank and encode alone to exactly one token, written with a real blank."""
    strings = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    split = [s for s in strings if MARK in s.lstrip(MARK)]
    if split:
        raise ValueError(f"vocabulary strings have a blank inside, units are no longer independent: {split[:3]}")
    units = [s[1:] for s in strings if s[:1] == MARK and s[1:2] not in ("", MARK)]
    return {f" {u}" for u, ids in zip(units, model.encode(units)) if len(ids) == 1}


def token_counter(path: str):
    """A pandas UDF: text -> number of tokens the library gives, without begin, end or other special tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(path)
        whole = whole_units(model)
        blank = len(model.encode("a ")) - len(model.encode("a"))  # a last blank; the library gives nothing for an empty text

        def lengths(units: list[str]) -> list[int]:
            rest = [u for u in units if u not in whole]
            known = dict(zip(rest, map(len, model.encode([u[1:] for u in rest], num_threads=1)))) | {" ": blank}
            return [known.get(u, 1) for u in units]

        memo, runs = Memo(lengths), re.compile(" +[^ ]*")

        def tokens(text: str | None) -> int:
            if not text:
                return 0
            if MARK in text or "\0" in text:  # the text itself holds the mark: units cannot be told apart
                return len(model.encode(text))
            return sum(memo.of(runs.findall(f" {text}")))

        for texts in batches:
            yield texts.map(tokens).astype("int64")

    return count


def with_token_count(docs: DataFrame, text: Column, path: str, name: str = "n_tokens") -> DataFrame:
    """``docs`` and a long column ``name``. Null and empty texts have 0 tokens; any text length works, a text at a time."""
    return docs.withColumn(name, token_counter(path)(F.coalesce(text, F.lit(""))))
