"""Build jobs: artifacts, state merging, status, log paging and line assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions import text as X
from tallyloom.operators import ordered
from tallyloom.session import stash

# Artifact kinds and the page size of a log.
KINDS = ["apk", "aab", "mapping", "test-report"]
PAGE_BYTES = 65_536
REPORT_DIR = r"^(.*/build/reports/tests)(/.*)?$"


def artifact_kind(path: Column) -> Column:
    return (
        F.when(path.rlike(r"\.apk$"), "apk")
        .when(path.rlike(r"\.aab$"), "aab")
        .when(X.base_name(path) == "mapping.txt", "mapping")
        .when(path.rlike(REPORT_DIR), "test-report")
    )


def artifact_root(path: Column) -> Column:
    """The artifact a listed file belongs to: its report folder, or the file itself."""
    folder = F.regexp_extract(path, REPORT_DIR, 1)
    return F.when(artifact_kind(path) == "test-report", folder).otherwise(path)


def artifacts(listing: DataFrame) -> DataFrame:
    """Listing (job_id, pos, path, length) -> one row per job, kind and artifact: first position and total size.

    A path listed twice counts once.
    """
    path = F.col("path")
    files = listing.groupBy("job_id", "path").agg(F.min("pos").alias("pos"), F.max("length").alias("length"))
    files = files.select("job_id", "pos", "length", artifact_kind(path).alias("kind"), artifact_root(path).alias("path"))
    return files.where("kind IS NOT NULL").groupBy("job_id", "kind", "path").agg(F.min("pos").alias("pos"), F.sum("length").alias("size"))


def artifact_order(found: DataFrame) -> DataFrame:
    """Artifacts of each job and kind, numbered as first seen."""
    return ordered.ordinal(found, ["job_id", "kind"], ["pos", "path"], "n")


def first_artifacts(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """First artifact of every kind for every job; kinds a job lacks have empty path and size 0."""
    top = found.groupBy("job_id", "kind").agg(F.min_by(F.struct("path", "size"), "pos").alias("a"))
    asked = jobs.select("job_id", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    joined = asked.join(top, ["job_id", "kind"], "left")
    return joined.select("job_id", "kind", F.coalesce("a.path", F.lit("")).alias("path"), F.coalesce("a.size", F.lit(0)).cast("long").alias("size"))


def merge_fields(updates: DataFrame) -> DataFrame:
    """(job_id, field, value, seq) -> last value written to each field of each job."""
    return updates.groupBy("job_id", "field").agg(F.max_by("value", "seq").alias("value"))


def decode_field(value: Column) -> Column:
    """JSON where it parses, else the raw text, as VARIANT."""
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def state_records(merged: DataFrame, fields: list[str]) -> DataFrame:
    """One row per job with one text column per field."""
    cells = [F.max(F.when(F.col("field") == f, F.try_variant_get(decode_field(F.col("value")), "$", "string"))).alias(f) for f in fields]
    return merged.groupBy("job_id").agg(*cells)


def job_status(requested: DataFrame, state: DataFrame, meta: DataFrame) -> DataFrame:
    """Live state when it has a status, else stored record, else ``not_found``. The whole record comes from one side."""
    fields = ["status", "code", "startedAt", "finishedAt"]
    live = state.where("status IS NOT NULL").select("job_id", F.struct(*fields).alias("live"))
    saved = meta.select("job_id", F.struct(F.coalesce("status", F.lit("queued")).alias("status"), *fields[1:]).alias("saved"))
    joined = requested.join(live, "job_id", "left").join(saved, "job_id", "left")
    record = F.coalesce("live", "saved")
    return joined.select(
        "job_id", F.coalesce(record["status"], F.lit("not_found")).alias("status"), *[record[f].alias(f) for f in fields[1:]])


def status_rollup(steps: DataFrame) -> DataFrame:
    """Job steps (job_id, seq, at, step, code) -> start, finish, final status and exit code of each job.

    step is one of start, exit, exception, cancel; the last step with a status decides.
    """
    step, code = F.col("step"), F.col("code")
    status = (
        F.when(step == "start", "running")
        .when(step == "exit", F.when(code == 0, "completed").otherwise("failed"))
        .when(step == "exception", "failed")
        .when(step == "cancel", "cancelled")
    )
    final_code = F.when(step == "exit", code).when(step == "exception", F.coalesce(code, F.lit(-1)))
    done = step.isin("exit", "exception")
    return steps.groupBy("job_id").agg(
        F.min(F.when(step == "start", F.col("at"))).alias("startedAt"),
        F.max(F.when(done, F.col("at"))).alias("finishedAt"),
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
        F.max_by(final_code, F.when(done, F.col("seq"))).alias("code"),
    )


def log_page(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Requests (job_id, from_byte, max_bytes) against logs (job_id, content): text of the page and where the next starts.
    A negative start is the start of the log; a start at or beyond its end, however far, gives an empty page."""
    most = F.lit((1 << 31) - 2)
    size = F.least(F.greatest(F.col("max_bytes"), F.lit(0)), most).cast("int")
    joined = requests.join(logs, "job_id", "left").withColumn("_at", F.greatest(F.col("from_byte"), F.lit(0)))
    within = F.col("_at") < F.octet_length("content")
    page = F.when(within, F.substring(F.col("content"), (F.least("_at", most) + 1).cast("int"), size))
    paged = joined.select("job_id", F.col("_at").alias("from_byte"), F.coalesce(page, F.lit(b"")).alias("page"))
    return paged.select("job_id", X.decode_utf8_ignore(F.col("page")).alias("text"), (F.col("from_byte") + F.octet_length("page")).alias("nextOffset"))


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (job, number, bytes) of a batch that follow each other become one under the number of the first. The bytes of a
    column are one buffer, so only the places where chunks end are dropped."""
    for batch in batches:
        n, (job, number, data) = batch.num_rows, batch.columns
        if not n:
            continue
        same = pc.equal(job.slice(1), job.slice(0, n - 1)).fill_null(False)
        after = pc.equal(pc.subtract(number.slice(1), number.slice(0, n - 1)), 1).fill_null(False)
        first = np.flatnonzero(np.r_[True, ~pc.and_(same, after).to_numpy(zero_copy_only=False)])
        _, ends, content = data.buffers()
        ends = np.frombuffer(ends, np.int32)[data.offset : data.offset + n + 1][np.r_[first, n]]
        runs = pa.Array.from_buffers(data.type, len(first), [None, pa.py_buffer(np.ascontiguousarray(ends)), content])
        yield pa.RecordBatch.from_arrays([job.take(pa.array(first)), number.take(pa.array(first)), runs], names=batch.schema.names)


def assemble_lines(chunks: DataFrame) -> DataFrame:
    """Byte chunks (job_id, chunk_no, bytes) -> complete lines (job_id, line_no, line); an unended last line is left out.

    Chunks that lie side by side become one where they are, before anything moves. The number of line ends before a chunk
    gives the number of its first line. Lines inside one chunk go straight out; only pieces at chunk borders are grouped, by
    job and line, so no job is gathered in one place.
    Bytes are handled as Latin-1 characters, one per byte, so that text functions can cut them.
    """
    chunks = chunks.select("job_id", "chunk_no", "bytes")
    chunks = stash(chunks.mapInArrow(_side_by_side, chunks.schema), "chunks")  # which ones met must not change below
    counted = chunks.select("job_id", "chunk_no", line_ends(F.col("bytes")).alias("breaks"))
    numbered = ordered.running_total(counted, ["job_id"], ["chunk_no"], F.col("breaks"), "base", inclusive=False)  # no bytes are moved
    totals = counted.groupBy("job_id").agg(F.sum("breaks").alias("ended"))
    pieces = F.split(F.decode("bytes", "ISO-8859-1"), "\n", -1)
    cut = chunks.select("job_id", "chunk_no", pieces.alias("pieces")).join(numbered.select("job_id", "chunk_no", "base", "breaks"), ["job_id", "chunk_no"])
    inner = F.slice("pieces", F.lit(2), F.greatest(F.size("pieces") - 2, F.lit(0)))
    whole = cut.select("job_id", "base", F.posexplode(inner).alias("pos", "piece")).select("job_id", (F.col("base") + F.col("pos") + 2).alias("line_no"), "piece")
    first = F.struct((F.col("base") + 1).alias("line_no"), F.lit(0).alias("side"), F.get("pieces", F.lit(0)).alias("piece"))
    last = F.struct((F.col("base") + F.col("breaks") + 1).alias("line_no"), F.lit(1).alias("side"), F.element_at("pieces", -1).alias("piece"))
    ends = cut.select("job_id", "chunk_no", F.explode(F.when(F.col("breaks") > 0, F.array(first, last)).otherwise(F.array(first))).alias("e")).select("job_id", "chunk_no", "e.*")
    joined = ends.groupBy("job_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "side", "piece"))).alias("p"))
    joined = joined.join(totals, "job_id").where(F.col("line_no") <= F.col("ended"))
    joined = joined.select("job_id", "line_no", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("piece"))
    line = X.decode_utf8_ignore(F.encode("piece", "ISO-8859-1"))
    return whole.unionByName(joined).select("job_id", "line_no", line.alias("line"))


def line_ends(data: Column) -> Column:
    """How many line ends a byte string holds."""
    return (F.octet_length(data) - F.length(F.translate(F.decode(data, "ISO-8859-1"), "\n", ""))).cast("long")


def cut_chunks(texts: DataFrame, size: int = 64) -> DataFrame:
    """(job_id, text) -> byte chunks of ``size``, as a process would hand out its output."""
    raw = texts.select("job_id", F.encode("text", "UTF-8").alias("raw"))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("raw") - 1, F.lit(0)), F.lit(size))
    parts = F.transform(starts, lambda start: F.substring(F.col("raw"), start + 1, F.lit(size)))  # rows carry their part, not the text
    return raw.select("job_id", F.posexplode(parts).alias("n", "bytes")).select("job_id", F.col("n").cast("long").alias("chunk_no"), "bytes")
