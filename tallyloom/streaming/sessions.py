"""Session streams: ticks, request counters, registry upserts and cache lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyloom.functions import numbers as N
from tallyloom.operators import ordered, registry as R
from tallyloom.streaming import common as S
from tallyloom.streaming.statetable import StateTable, follow

DELAY = "1 minute"
#: Seconds of a window in which lookups wait.
WINDOW = 60


def tick_counts(events: DataFrame, seconds: int = R.TICK_SECONDS, delay: str = DELAY) -> DataFrame:
    """Requests of each session in each tick. Rows older than the watermark are dropped and counted by Spark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = timed.groupBy(F.window("ts", f"{seconds} seconds"), "user_id").agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("tick"), "user_id", "requests")


def dirty_from_counts(counts: DataFrame, every: int = R.CHECKPOINT_EVERY) -> DataFrame:
    """Tick counts -> sessions to save at each tick: those whose running request number is no multiple of ``every``."""
    n = ordered.running_total(counts, ["user_id"], ["tick"], F.col("requests"), "n")
    return n.where(F.col("n") % every != 0).select("tick", "user_id")


class Users:
    """A number for each user of a bucket, kept as one value of the state, of 16 bytes a user."""

    SCHEMA = StructType([StructField("users", BinaryType()), StructField("numbers", BinaryType())])

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getValueState(name, self.SCHEMA)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        """Users, ascending, and their numbers."""
        users, numbers = self.state.get() or (b"", b"")
        return np.frombuffer(bytes(users), np.int64), np.frombuffer(bytes(numbers), np.int64)

    def write(self, users: np.ndarray, numbers: np.ndarray) -> None:
        self.state.update((users.astype(np.int64).tobytes(), numbers.astype(np.int64).tobytes()))

    def add(self, users: np.ndarray, more: np.ndarray) -> np.ndarray:
        """Raises the numbers of ``users`` (ascending, each once) by ``more``; what they were before, 0 for a new user."""
        known, numbers = self.read()
        merged = np.union1d(known, users)
        before = np.zeros(len(merged), np.int64)
        before[np.searchsorted(merged, known)] = numbers
        at = np.searchsorted(merged, users)
        old = before[at]
        before[at] += more
        self.write(merged, before)
        return old

    def clear(self) -> None:
        self.state.clear()


class TickNumbers(StatefulProcessor):
    """Closed ticks of a bucket's users -> for each user, in order, the running number of the last request in each tick."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Users(handle, "seen")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values(["user_id", "tick"])
        users, first, sizes = np.unique(ticks["user_id"].to_numpy(np.int64), return_index=True, return_counts=True)
        total = np.r_[0, ticks["requests"].to_numpy(np.int64).cumsum()]
        before = self.seen.add(users, total[first + sizes] - total[first])
        yield pd.DataFrame({"bucket": key[0], "tick": ticks["tick"], "user_id": ticks["user_id"], "n": total[1:] + np.repeat(before - total[first], sizes)})

    def close(self) -> None:
        pass


def dirty_stream(events: DataFrame, every: int = R.CHECKPOINT_EVERY, seconds: int = R.TICK_SECONDS, delay: str = DELAY) -> DataFrame:
    """Sessions to save at each tick, in one stream: a tick is counted, closes when the watermark passes it, and its count then
    raises the running number of its session. Ticks close in order, so the number needs no earlier rows."""
    S.use_rocksdb(events.sparkSession)
    counts = tick_counts(events, seconds, delay)
    numbered = S.in_buckets(counts, "user_id").transformWithStateInPandas(TickNumbers(), "bucket int, tick timestamp, user_id bigint, n bigint", "append", "None")
    return S.out_of_buckets(numbered, "user_id").where(F.col("n") % every != 0)


class RequestCounter(StatefulProcessor):
    """Counts requests of a bucket's users and emits every count that is a multiple of ``every``. Arrival order does not matter."""

    def __init__(self, every: int = R.CHECKPOINT_EVERY):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Users(handle, "seen")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        users, more = np.unique(np.concatenate([part["user_id"].to_numpy(np.int64) for part in rows]), return_counts=True)
        before = self.seen.add(users, more)
        hits = (before + more) // self.every - before // self.every
        nth = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        n = (np.repeat(before // self.every, hits) + nth + 1) * self.every
        yield pd.DataFrame({"bucket": key[0], "user_id": np.repeat(users, hits), "n": n})

    def close(self) -> None:
        pass


def request_checkpoints(events: DataFrame) -> DataFrame:
    S.use_rocksdb(events.sparkSession)
    counted = S.in_buckets(events.select("user_id"), "user_id").transformWithStateInPandas(RequestCounter(), "bucket int, user_id bigint, n bigint", "append", "None")
    return S.out_of_buckets(counted, "user_id")


class CacheLookups(StatefulProcessor):
    """Labels each distinct request time of a bucket's users as hit or miss; a miss fetches anew. What was fetched expires."""

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fetched = Users(handle, "fetched")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).drop_duplicates(["user_id", "position"]).sort_values(["user_id", "position"])
        fetched = dict(zip(*(part.tolist() for part in self.fetched.read())))
        hits, user, last = [], None, None
        for asker, at in zip(asked["user_id"].tolist(), asked["position"].tolist()):
            if asker != user:
                user, last = asker, fetched.get(asker)
            hits.append(last is not None and at - last < self.ttl)
            if not hits[-1]:
                fetched[user] = last = at
        self.keep(fetched, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"bucket": key[0], "user_id": asked["user_id"], "position": asked["position"], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.keep(dict(zip(*(part.tolist() for part in self.fetched.read()))), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"bucket": [], "user_id": [], "position": [], "hit": []}).astype({"bucket": "int32", "user_id": "int64", "position": "int64", "hit": "bool"})

    def expires(self, at: int) -> int:
        return (at + self.ttl) // 1000 + 1

    def keep(self, fetched: dict[int, int], now: int) -> None:
        """Drops what the watermark has passed. A timer ends the bucket where nobody comes any more."""
        live = {user: at for user, at in sorted(fetched.items()) if self.expires(at) > now}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live:
            self.fetched.write(np.array(list(live), np.int64), np.array(list(live.values()), np.int64))
            self.handle.registerTimer(self.expires(max(live.values())))
        else:
            self.fetched.clear()

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, seconds: int = R.CACHE_SECONDS, delay: str = DELAY) -> DataFrame:
    """Lookups on a stream whose rows come in any order within ``delay``. Times wait in windows of a minute, each time once, until
    the watermark has passed them; closed windows are looked up in order."""
    S.use_rocksdb(events.sparkSession)
    timed = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    closed = timed.groupBy(F.window("ts", f"{WINDOW} seconds"), "user_id").agg(F.collect_set(N.epoch_micros(F.col("ts"))).alias("times"))
    asked = S.in_buckets(closed.select("user_id", F.explode("times").alias("position")), "user_id")
    found = asked.transformWithStateInPandas(CacheLookups(seconds * 1_000_000), "bucket int, user_id bigint, position bigint, hit boolean", "append", "eventtime")
    return S.out_of_buckets(found, "user_id")


REGISTRY = "user_id bigint, event_id bigint, event_type string, value double"


def registry_table(spark: SparkSession, path: str) -> StateTable:
    """The registry: the last event of each session."""
    return StateTable(spark, path, REGISTRY, ["user_id"], "event_id")


def registry_stream(events: DataFrame, table: StateTable, checkpoint: str) -> None:
    """Continuous upsert into ``table``."""
    follow(events.select(*table.schema.names), table, "registry", checkpoint)
