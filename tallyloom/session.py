"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
OWN_FOLDERS: set[str] = set()


def build_session(app: str = "tallyloom", cpus: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session that spark-submit gives."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on. Nothing here changes how the cluster sizes or schedules work."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # long texts: rows alone don't bound a batch
    ship_package()
    return spark


def ship_package() -> None:
    """Sends functions of this package to Python workers by value, so that workers need not be able to import it: also the
    worker that sets up stream state, which does not see files added to the session."""
    cloudpickle.register_pickle_by_value(sys.modules["tallyloom"])


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; a local one only in local mode without such a folder."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if not base:
        base = os.path.join(tempfile.gettempdir(), f"tallyloom-{os.getpid()}")
        if base not in OWN_FOLDERS:
            OWN_FOLDERS.add(base)
            atexit.register(shutil.rmtree, base, ignore_errors=True)  # a folder of this process alone
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` below the working folder and reads it again: cuts the lineage, fixes what depends on how rows were dealt
    out, and survives lost executors."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task at least, and at most where there are more than every core gets.
FEW_ROWS, MANY_ROWS = 500, 8_000


def dealt(df: DataFrame, *keys: str, most: int = MANY_ROWS) -> DataFrame:
    """Deals small rows out to tasks by their keys, for work per row that is long beside the row: a table of short rows is one
    small file, and by its bytes alone one task. There are more tasks for more rows, of at most about ``most`` each."""
    count = df.count()
    tasks = max(min(df.sparkSession.sparkContext.defaultParallelism, count // FEW_ROWS), -(-count // most), 1)
    return df.repartition(tasks, *keys)


#: Rows of the larger side that one task joins.
JOINED_ROWS = 1_000_000


def dealt_to_join(df: DataFrame, key: str) -> DataFrame:
    """The larger side of a join, dealt by its key into as many tasks as its rows need, so that what one task sorts does not
    grow with the table. The other side follows. Where the session's own number of partitions does, nothing is changed."""
    tasks = -(-df.count() // JOINED_ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
