"""Line ranges over ordered sessions: ``6``, ``1-5`` (end included), ``:5`` (end excluded), ``~2/1-5`` (two sessions back)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.operators import ordered


def parse_range(text: str) -> tuple[int, int, int | None, bool]:
    """(sessions back, first line, last line or None, drop the final line)."""
    if not text.strip():
        return 0, 1, None, True
    m = re.fullmatch(r"(?:~(\d+)(?:/|(?=:)|$))?(\d+)?(?:([-:])(\d+)?)?", text.strip())
    if not m:
        raise ValueError(f"no line range: {text!r}")
    back, first, sep, last = m.groups()
    lo = int(first or 1)
    if sep is None:
        hi = int(first) if first else None
    elif last is None:
        hi = None
    else:
        hi = int(last) if sep == "-" else int(last) - 1
    return int(back or 0), lo, hi, False


def history(lines: DataFrame, session: str, order: str, ranges: list[str]) -> DataFrame:
    """Lines of every range, labelled ``span``. Only the sessions the ranges reach are read on and numbered."""
    parsed = {text: parse_range(text) for text in ranges}
    deepest = max(back for back, *_ in parsed.values())
    newest = lines.select(session).distinct().orderBy(F.desc(session)).limit(deepest + 1)
    back = F.row_number().over(W.orderBy(F.desc(session))) - 1  # over deepest + 1 rows only
    mine = lines.join(F.broadcast(newest.select(session, back.alias("back"))), session)
    numbered = ordered.ordinal(mine, [session], [order], "line_no")
    ends = mine.groupBy(session).agg(F.max(order).alias("_end"))
    numbered = numbered.join(F.broadcast(ends), session)  # deepest + 1 rows
    wanted = F.array(*[
        F.when(
            (F.col("back") == b) & (F.col("line_no") >= lo) & (F.lit(hi is None) | (F.col("line_no") <= F.lit(hi)))
            & (F.lit(not drop_last) | (F.col(order) < F.col("_end"))), F.lit(text))
        for text, (b, lo, hi, drop_last) in parsed.items()
    ])
    return numbered.select("*", F.explode(F.array_compact(wanted)).alias("span")).drop("back", "_end")
