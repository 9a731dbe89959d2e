"""Walking folders level by level: folders are rows, each round lists one level in parallel, and what is not to be entered is
dropped before anything below it is listed. Files are read where their rows are; the driver sees only how many there are."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.session import stash

#: Stores that Python tasks can open.
STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
ENTRY = "path string, name string, is_folder boolean, length bigint"
#: Folders or files of a task at least, and bytes of file content that leave a task together.
LEAST, TOGETHER = 16, 8 << 20


def scheme_of(path: str) -> str:
    head, mark, _ = path.partition(":/")
    return head if mark and head.isalnum() else "file"


def local_path(path: str) -> str:
    return "/" + path.partition(":")[2].lstrip("/") if path.startswith("file:") else path


def opened(path: str):
    """(file system, path in it) of a store beside local disks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def entries(folder: str) -> list[tuple[str, str, bool, int]]:
    """What is in a folder. Links to folders are not followed, so a walk ends; a folder that cannot be listed is empty."""
    found = []
    try:
        if scheme_of(folder) == "file":
            with os.scandir(local_path(folder)) as listed:
                for e in listed:
                    is_folder = e.is_dir(follow_symlinks=False)
                    if is_folder or e.is_file():
                        found.append((f"{folder.rstrip('/')}/{e.name}", e.name, is_folder, 0 if is_folder else e.stat().st_size))
        else:
            from pyarrow import fs

            system, inner = opened(folder)
            for e in system.get_file_info(fs.FileSelector(inner)):
                found.append((f"{folder.rstrip('/')}/{e.base_name}", e.base_name, e.type == fs.FileType.Directory, e.size or 0))
    except OSError:
        pass
    return found


def _in_tasks(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` dealt into tasks of at least LEAST rows."""
    most = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(most, count // LEAST)))


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = entries(folder)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["path", "name", "is_folder", "length"])


def walk(spark: SparkSession, root: str, enter: Callable[[Column], Column], keep: Callable[[Column], Column]) -> DataFrame:
    """(path, name, length) of the files below ``root`` whose name ``keep`` takes, not going into folders whose name ``enter``
    refuses. A root that does not exist, or is no folder, is an error."""
    if scheme_of(root) not in STORES:
        raise ValueError(f"tasks cannot list {root}: its store must be one of {', '.join(STORES)}")
    exists = os.path.isdir(local_path(root)) if scheme_of(root) == "file" else opened(root)[0].get_file_info(opened(root)[1]).type.name == "Directory"
    if not exists:
        raise FileNotFoundError(root)
    folders, count, levels = spark.createDataFrame([(root.rstrip("/"),)], "path string"), 1, []
    while count:
        level = stash(_in_tasks(folders, count).mapInArrow(_list, ENTRY).where(F.when(F.col("is_folder"), enter(F.col("name"))).otherwise(keep(F.col("name")))), "level")
        levels.append(level.where("NOT is_folder").drop("is_folder"))
        folders = level.where("is_folder").select("path")
        count = folders.count()
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        paths, contents = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    for batch in batches:
        rows, size = [], 0
        for path in batch.column(0).to_pylist():
            if scheme_of(path) == "file":
                with open(local_path(path), "rb") as file:
                    content = file.read()
            else:
                system, inner = opened(path)
                with system.open_input_stream(inner) as file:
                    content = file.read()
            rows.append((path, content))
            size += len(content)
            if size >= TOGETHER:
                yield out(rows)
                rows, size = [], 0
        yield out(rows)


def contents(files: DataFrame) -> DataFrame:
    """(path, content) of files (path)."""
    listed = stash(files.select("path"), "listed")
    return _in_tasks(listed, listed.count()).mapInArrow(_read, "path string, content binary")


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for path, content in zip(paths, batch.column(1).to_pylist()):
                target = f"{root.rstrip('/')}/{path.lstrip('/')}"
                if scheme_of(target) == "file":
                    plain = local_path(target)
                    os.makedirs(os.path.dirname(plain), exist_ok=True)
                    draft = f"{plain}.{os.getpid()}.part"  # a task that runs twice leaves one whole file
                    with open(draft, "wb") as file:
                        file.write(content)
                    os.replace(draft, plain)
                else:
                    system, inner = opened(target)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(inner) as file:
                        file.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return run


def write_files(files: DataFrame, root: str) -> int:
    """Writes each row (path below ``root``, content as bytes) to a file of its own; how many were written."""
    return files.select("path", "content").mapInArrow(_write(root), "path string").count()
