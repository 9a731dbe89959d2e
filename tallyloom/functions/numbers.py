"""Numeric, time and JSON-egress expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

INFINITY = float("inf")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def floor_at(value: Column, low: int = 0) -> Column:
    return F.greatest(value, F.lit(low))


def megabytes(size: Column) -> Column:
    return F.round(size / F.lit(1048576.0), 2)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def is_fresh(at: Column, now: Column, ttl_seconds: int = 300) -> Column:
    return epoch_micros(now) - epoch_micros(at) < ttl_seconds * 1_000_000


def clean_double(value: Column) -> Column:
    """Text form of a double for JSON: NaN -> null, infinities -> words, the number itself otherwise."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
        .when(value == INFINITY, "Infinity")
        .when(value == -INFINITY, "-Infinity")
        .otherwise(F.round(value, 10).cast("string"))
    )


def clean_variant(value: Column) -> Column:
    """Like clean_double, as a VARIANT so that numbers stay numbers and infinities become strings."""
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("variant"))
        .when(value == INFINITY, F.lit("Infinity").cast("variant"))
        .when(value == -INFINITY, F.lit("-Infinity").cast("variant"))
        .otherwise(F.round(value, 10).cast("variant"))
    )


def clean_array(values: Column) -> Column:
    return F.transform(values, lambda x: clean_double(x.cast("double")))


def clean_columns(df: DataFrame, finite: bool = False) -> list[Column]:
    """Every column in the form it takes in a JSON record. ``finite``: no double is infinite, so doubles stay doubles."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = c.cast("double")
            c = F.round(F.when(~F.isnan(c), c), 10) if finite else clean_variant(c)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c)
        out.append(c.alias(field.name))
    return out


def json_records(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON object text per row in column ``record``, nulls kept; ``keep`` columns stay beside it.

    Only rows with an infinity go through VARIANT values; all others are written from their own types.
    """
    kept = [F.col(k) for k in keep or []]
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    text = lambda finite: F.to_json(F.struct(*clean_columns(df, finite)), {"ignoreNullFields": "false"})
    record = text(True)
    if doubles:
        infinite = F.lit(False)
        for name in doubles:
            infinite = infinite | F.coalesce(F.abs(F.col(f"`{name}`")) == INFINITY, F.lit(False))
        record = F.when(infinite, text(False)).otherwise(record)
    return df.select(*kept, record.alias("record"))
