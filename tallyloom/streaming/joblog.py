"""Job streams: line assembly and state merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallyloom.streaming import common as S
from tallyloom.streaming.statetable import StateTable, follow


#: Seconds of event time that a missing chunk is waited for, and after which a silent job has ended.
GAP_SECONDS, IDLE_SECONDS = 300, 3600
LINES = "job_id bigint, line_no bigint, line string, gap boolean"


class LineAssembly(StatefulProcessor):
    """Chunks of a bucket's jobs -> complete lines. The unended tail is carried; chunks that come early wait for those before them.

    A job is due on event time: while chunks wait, at the end of the wait, after which what is missing is given up and marked by
    a line with ``gap``, the part of a line before it; else at the end of the job, which leaves no state. Jobs are listed under
    the whole second when they are due, with a timer for each such second; who has moved on by then is listed again later.
    """

    def __init__(self, gap_seconds: int, idle_seconds: int):
        self.gap, self.idle = gap_seconds * 1000, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long, data = (lambda name: StructField(name, LongType())), (lambda name: StructField(name, BinaryType()))
        # waiting: how many chunks are early; heard: last chunk's time; since: when the wait began
        self.progress = handle.getMapState("progress", StructType([long("job_id")]), StructType(
            [long("chunk"), long("lines"), data("tail"), long("waiting"), long("heard"), long("since")]))
        self.early = handle.getMapState("early", StructType([long("job_id"), long("chunk_no")]), StructType([data("bytes")]))
        self.due = handle.getMapState("due", StructType([long("at")]), StructType([data("jobs")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, last, out, due = {}, {}, [], {}
        for part in rows:
            for job, number, data, at in zip(part["job_id"].tolist(), part["chunk_no"].tolist(), part["bytes"], part["at"].tolist()):
                fresh.setdefault(job, {})[number] = data
                last[job] = max(last.get(job, 0), at)
        for job, own in fresh.items():
            chunk, lines, tail, waiting, heard, since = self.progress.getValue((job,)) or (0, 0, b"", 0, 0, 0)
            moved, heard = chunk, max(heard, last[job])
            chunk, lines, tail, waiting = self.advance(job, chunk, lines, bytes(tail), waiting, own, out)
            for number, data in own.items():
                if number > chunk:
                    waiting += not (waiting and self.early.containsKey((job, number)))
                    self.early.updateValue((job, number), (bytes(data),))
            self.keep(job, chunk, lines, tail, waiting, heard, heard if chunk > moved or not since else since, due)
        self.set_timers(due)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, due, first = expiredTimerInfo.getExpiryTimeInMs(), [], {}, None
        listed = self.due.getValue((now,)) or (b"",)
        self.due.removeKey((now,))
        for job in np.unique(np.frombuffer(bytes(listed[0]), np.int64)).tolist():
            chunk, lines, tail, waiting, heard, since = self.progress.getValue((job,)) or (0, 0, b"", 0, now, now)
            if self.when(waiting, heard, since) > now:
                continue
            if not waiting:
                self.progress.removeKey((job,))
                continue
            if first is None:
                first = {}
                for own, number in self.early.keys():
                    first[own] = min(number, first.get(own, number))
            out.append((job, lines + 1, bytes(tail).decode("utf-8", errors="ignore"), True))
            chunk, lines, tail, waiting = self.advance(job, first[job], lines + 1, b"", waiting, {}, out)
            self.keep(job, chunk, lines, tail, waiting, heard, heard, due)
        self.set_timers(due)
        yield self.frame(key, out)

    def advance(self, job: int, chunk: int, lines: int, tail: bytes, waiting: int, fresh: dict, out: list[tuple]) -> tuple[int, int, bytes, int]:
        """Takes the chunks of a job from ``chunk`` on as far as they follow each other."""
        while True:
            data = fresh.pop(chunk, None)
            if waiting and (kept := self.early.getValue((job, chunk))):
                self.early.removeKey((job, chunk))
                data, waiting = kept[0] if data is None else data, waiting - 1
            if data is None:
                return chunk, lines, tail, waiting
            *done, tail = (tail + bytes(data)).split(b"\n")
            for line in done:
                lines += 1
                out.append((job, lines, line.decode("utf-8", errors="ignore"), False))
            chunk += 1

    def when(self, waiting: int, heard: int, since: int) -> int:
        """The whole second when a job is due, in milliseconds."""
        return -(-(since + self.gap if waiting else heard + self.idle) // 1000) * 1000

    def keep(self, job: int, chunk: int, lines: int, tail: bytes, waiting: int, heard: int, since: int, due: dict[int, list[int]]) -> None:
        since = since if waiting else 0
        self.progress.updateValue((job,), (chunk, lines, tail, waiting, heard, since))
        due.setdefault(self.when(waiting, heard, since), []).append(job)

    def set_timers(self, due: dict[int, list[int]]) -> None:
        for at, jobs in due.items():
            listed = self.due.getValue((at,)) or (b"",)
            known = np.frombuffer(bytes(listed[0]), np.int64)
            self.due.updateValue((at,), (np.union1d(known, np.array(jobs, np.int64)).tobytes(),))
            self.handle.registerTimer(at)

    @staticmethod
    def frame(key, out: list[tuple]) -> pd.DataFrame:
        jobs, numbers, texts, gaps = zip(*out) if out else ((), (), (), ())
        made = pd.DataFrame({"bucket": [key[0]] * len(out), "job_id": jobs, "line_no": numbers, "line": texts, "gap": gaps})
        return made.astype({"bucket": "int32", "job_id": "int64", "line_no": "int64", "line": "object", "gap": "bool"})

    def close(self) -> None:
        pass


def line_stream(chunks: DataFrame, gap_seconds: int = GAP_SECONDS, idle_seconds: int = IDLE_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Chunks (job_id, chunk_no, bytes, at) in any order -> lines. Chunks later than ``delay`` behind the watermark are dropped
    and counted by Spark."""
    S.use_rocksdb(chunks.sparkSession)
    timed = chunks.select("job_id", "chunk_no", "bytes", F.col("at").cast("timestamp").alias("time")).withWatermark("time", delay)
    grouped = S.in_buckets(timed.withColumn("at", F.unix_millis("time")), "job_id")
    lines = grouped.transformWithStateInPandas(LineAssembly(gap_seconds, idle_seconds), f"bucket int, {LINES}", "append", "eventTime")
    return S.out_of_buckets(lines, "job_id")


STATE = "job_id bigint, field string, value string, seq bigint"


def state_table(spark: SparkSession, path: str) -> StateTable:
    """The state of jobs: the last value written to each field."""
    return StateTable(spark, path, STATE, ["job_id", "field"], "seq")


def state_stream(updates: DataFrame, table: StateTable, checkpoint: str) -> None:
    """Continuous merge of field updates into ``table``."""
    follow(updates.select(*table.schema.names), table, "state", checkpoint)
