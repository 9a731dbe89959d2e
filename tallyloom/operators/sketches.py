"""Stored sketches: distinct counts and quantiles per key and day, merged over any range of days without the rows.

A day's sketches are bounded in size whatever its rows, so a question about a year reads some hundred rows per key. Days can be
added or written again one at a time; merging is by aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Base-2 logarithm of the HLL buckets (standard error 1.04 / 2**6, or 1.6 %) and size of the quantile sketch (rank error about 0.7 %).
BUCKETS, SIZE = 12, 400


def daily(rows: DataFrame, keys: Sequence[str], time: str, member: str, value: str) -> DataFrame:
    """``keys``, day, rows, members and values: the count of rows and sketches of ``member`` and ``value`` per day.

    Rows without a time have no day and are left out; null members and values, and values that are no numbers, count as rows only."""
    number = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return rows.where(F.col(time).isNotNull()).groupBy(*keys, F.to_date(time).alias("day")).agg(
        F.count("*").alias("rows"), F.hll_sketch_agg(member, BUCKETS).alias("members"), F.kll_sketch_agg_double(number, SIZE).alias("values"))


def merged(days: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Sketches of ``daily`` put together per ``keys``, which may be any expressions over its columns."""
    return days.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("values").alias("values"))


def estimates(sketches: DataFrame, *shares: float) -> DataFrame:
    """The sketch columns replaced by ``distinct``, ``n`` (values) and ``quantiles``, one for each share; null without values."""
    n = F.coalesce(F.kll_sketch_get_n_double("values"), F.lit(0))
    at = F.array(*[F.when(n > 0, F.kll_sketch_get_quantile_double("values", F.lit(s))) for s in shares])
    return sketches.select("*", F.hll_sketch_estimate("members").alias("distinct"), n.alias("n"), at.alias("quantiles")).drop("members", "values")
