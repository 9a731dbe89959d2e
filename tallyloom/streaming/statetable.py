"""A table of current state, kept up by batches: one row per key, bucketed by a hash of the key.

A bucket is a base and a few deltas, each a folder of files; a manifest says which. A batch writes its last row per key as
a delta of the buckets that it touches, merges the buckets whose deltas have grown, and only then puts the next manifest in place
with one rename. Until that rename nothing of the batch can be seen; after it, the batch is known by its number and is not
taken again. A bucket's deltas hold at most MOST_DELTAS batches, so a read costs the number of keys, not of batches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from tallyloom.operators.registry import latest_by_key

BUCKETS = 16
#: Deltas of a bucket before it is merged; and the part of the base's rows they may have together.
MOST_DELTAS, GROWN = 4, 0.5
BUCKET = "_bucket"


class Folder:
    """Files below a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.path = self.hadoop.Path(path)
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.path.getFileSystem(self.conf)

    def child(self, name: str):
        return self.hadoop.Path(self.path, name)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.path)] if self.files.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.child(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file that is there as a whole or not at all; fails where the name is taken."""
        draft = self.child(f".{name}-{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.files.exists(self.child(name)) or not self.files.rename(draft, self.child(name)):
            self.files.delete(draft, False)
            raise FileExistsError(f"{name} is there already: another writer was faster")

    def remove(self, name: str) -> None:
        self.files.delete(self.child(name), True)


class StateTable:
    """Last row (by ``order``) of each key. ``schema`` has the keys, the order column and any others."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.manifests = Folder(spark, f"{self.path}/manifest")

    # --- reading

    def manifest(self) -> dict:
        found = sorted(n for n in self.manifests.names() if n.startswith("v"))
        return json.loads(self.manifests.read(found[-1])) if found else {"version": 0, "taken": {}, "buckets": {}}

    def _paths(self, manifest: dict, buckets: list[str]) -> list[str]:
        return [f"{self.path}/data/{part['folder']}/{BUCKET}={b}" for b in buckets for part in manifest["buckets"][b]]

    def _merged(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return latest_by_key(self.spark.read.schema(self.schema).parquet(*paths), self.keys, F.col(self.order))

    def read(self) -> DataFrame:
        """The current rows. Files that a manifest names stay until ``vacuum``, so a reader may go on while batches arrive."""
        manifest = self.manifest()
        return self._merged(self._paths(manifest, list(manifest["buckets"]))).select(*self.schema.names)

    # --- writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, label: str) -> tuple[str, dict[str, int]]:
        """Writes ``rows`` by bucket; the name of the folder and how many rows each bucket got."""
        folder = f"{label}-{uuid.uuid4().hex[:12]}"
        dealt = rows.withColumn(BUCKET, self.bucket()).repartition(self.buckets, BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        if not any(n.startswith(BUCKET) for n in Folder(self.spark, f"{self.path}/data/{folder}").names()):
            return folder, {}
        counted = self.spark.read.parquet(f"{self.path}/data/{folder}").groupBy(BUCKET).count().collect()  # a row per bucket
        return folder, {str(r[BUCKET]): r["count"] for r in counted}

    def apply(self, batch: DataFrame, number: int, writer: str = "") -> bool:
        """Takes the batch ``number`` of a ``writer``; False if it was taken before. Numbers of a writer grow."""
        manifest = self.manifest()
        if number <= manifest["taken"].get(writer, -1):
            return False
        fresh = latest_by_key(batch.select(*self.schema.names), self.keys, F.col(self.order))
        folder, counts = self._write(fresh, f"delta-{number}")
        buckets = {b: list(parts) for b, parts in manifest["buckets"].items()}
        for b, rows in counts.items():
            buckets.setdefault(b, []).append({"folder": folder, "rows": rows})
        after = {"version": manifest["version"] + 1, "taken": manifest["taken"] | {writer: number}, "buckets": buckets}
        self._compact(after, [b for b in counts if self._grown(buckets[b])])
        self.manifests.put(f"v{after['version']:012d}", json.dumps(after))
        return True

    @staticmethod
    def _grown(parts: list[dict]) -> bool:
        rest = sum(p["rows"] for p in parts[1:])
        return len(parts) > MOST_DELTAS + 1 or len(parts) > 2 and rest > GROWN * parts[0]["rows"]

    def _compact(self, manifest: dict, buckets: list[str]) -> None:
        """Merges these buckets into new bases, in ``manifest`` only."""
        if buckets:
            folder, counts = self._write(self._merged(self._paths(manifest, buckets)), "base")
            for b in buckets:
                manifest["buckets"][b] = [{"folder": folder, "rows": counts[b]}]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests before the last ``keep`` and the data folders that no manifest left names, such as those of batches
        that failed. No batch may be under way, and readers of older manifests must be done."""
        found = sorted(n for n in self.manifests.names() if n.startswith("v"))
        kept = [json.loads(self.manifests.read(n)) for n in found[-keep:]]
        for name in found[:-keep]:
            self.manifests.remove(name)
        named = {part["folder"] for m in kept for parts in m["buckets"].values() for part in parts}
        data = Folder(self.spark, f"{self.path}/data")
        gone = [n for n in data.names() if n not in named]
        for name in gone:
            data.remove(name)
        return gone


def follow(stream: DataFrame, table: StateTable, label: str, checkpoint: str) -> None:
    """Runs ``stream`` over all input there is into the table. A batch that Spark runs again is taken once."""
    from tallyloom.streaming.common import run_batches

    run_batches(stream, "append", lambda batch, number: table.apply(batch, number, label), checkpoint)
