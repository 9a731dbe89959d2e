"""Connected components of links between ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import stash


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Points each node's larger (or other) neighbours at the smallest node around it. Minima are combined before the
    shuffle, so a node with many links costs no more than its links."""
    if large:
        both = links.union(links.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
        kept = both.where("b > a").join(low, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = ordered.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), "low")
        near = ordered.join(low, F.col("a") == F.col("of"))
        kept = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("of"), F.col("low")))
    return kept.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component_id, the smallest id reachable, of each id of ``links`` (a, b: long) but the smallest of each
    component. Every step is written to the shared folder; it ends when a step changes nothing."""
    links = stash(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") == F.col("b"))).first()
        if state == mark or not state[0]:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        mark = state
        links = stash(_star(_star(links, large=True), large=False), "links")
