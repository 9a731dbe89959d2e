"""Map expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def overlay(*maps: Column) -> Column:
    """Maps laid over one another: the value of the last map that has a key counts."""

    def two(under: Column, over: Column) -> Column:
        rest = F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k))
        return F.map_concat(rest, over)

    return reduce(two, maps)
