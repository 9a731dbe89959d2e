"""Session registry: keyed upserts, request counting, eviction, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import numbers as N
from tallyloom.operators import ordered

# Fixed values.
MAX_LIVE = 4
CHECKPOINT_EVERY = 10
TICK_SECONDS = 15
RESET_AFTER = 200
KEPT_ON_RESET = 3
CACHE_SECONDS = 300
HEARTBEAT_SECONDS = 2


def latest_by_key(rows: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Last write wins: the whole row with the highest ``seq`` per key. Partial aggregation runs before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return top.select(*keys, *[F.col(f"r.`{c}`").alias(c) for c in rest])


def drop_deleted(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones, key, "left_anti")


def numbered_requests(events: DataFrame) -> DataFrame:
    """Adds ``n``: the running request number of each user."""
    return ordered.ordinal(events, ["user_id"], ["ts", "event_id"], "n")


def checkpoints(numbered: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    return numbered.where(F.col("n") % every == 0)


def session_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_active"), F.count("*").alias("requests"))


def dirty_sets(numbered: DataFrame, seconds: int = TICK_SECONDS, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Sessions touched in a tick whose last request of the tick did not already save them."""
    tick = F.window("ts", f"{seconds} seconds")
    last = numbered.groupBy(tick.alias("w"), "user_id").agg(F.max("n").alias("n"))
    return last.where(F.col("n") % every != 0).select(F.col("w.start").alias("tick"), "user_id")


def conditional_resets(numbered: DataFrame, flag: Column, after: int = RESET_AFTER) -> DataFrame:
    """Request numbers at which a reset happens: at least ``after`` requests since the last one, and ``flag`` holds."""
    flagged = numbered.where(flag)
    spaced = ordered.keep_spaced(flagged, "user_id", F.col("n"), after, first_at=after)
    return spaced.where("kept").select("user_id", F.col("position").alias("n"))


def heartbeats(events: DataFrame, key: str, seconds: float = HEARTBEAT_SECONDS) -> DataFrame:
    """Times kept when each must be more than ``seconds`` after the last one kept."""
    gap = int(seconds * 1_000_000) + 1
    return ordered.keep_spaced(events, key, N.epoch_micros(F.col("ts")), gap)


def cache_lookups(events: DataFrame, key: str, seconds: float = CACHE_SECONDS) -> DataFrame:
    """Each distinct request time, and whether the value fetched before is still fresh (age below ``seconds``)."""
    gap = int(seconds * 1_000_000)
    spaced = ordered.keep_spaced(events, key, N.epoch_micros(F.col("ts")), gap)
    return spaced.select(key, "position", (~F.col("kept")).alias("hit"))


def live_after_eviction(sessions: DataFrame, limit: int = MAX_LIVE, exempt: Column | None = None) -> DataFrame:
    """Sessions arrive in the order they were created and the oldest leaves whenever the limit is passed. ``exempt`` sessions
    (the default one) never leave, and count in the limit."""
    stays = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    newest = sessions.orderBy(F.desc(stays), F.desc("created_at"), F.desc("user_id")).limit(limit).select("user_id", F.lit(True).alias("_live"))
    joined = sessions.join(F.broadcast(newest), "user_id", "left")  # newest has at most ``limit`` rows
    return joined.select(*sessions.columns, (F.coalesce("_live", F.lit(False)) | stays).alias("live"))


def restored(sessions: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Active sessions with their snapshot state; those without one start fresh."""
    return sessions.join(snapshots, key, "left").withColumn("state", F.coalesce("state", F.lit("fresh")))


def restore_metadata(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(readable rows with VARIANT ``metadata``, rejected rows). Rows without text or with bad JSON are rejected."""
    parsed = rows.withColumn("metadata", F.try_parse_json(text))
    return parsed.where("metadata IS NOT NULL"), parsed.where("metadata IS NULL").drop("metadata")
