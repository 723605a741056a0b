"""B2: incremental ingest of new CSV files with Structured Streaming.

Each new file in the source folder is read once (the file source keeps the
list of processed files in the checkpoint), projected and filtered like the
batch job, and written by ``foreachBatch`` to
``{out}/stream={name}/batch_id={N}/``.  Overwriting the folder of the batch id
makes a replayed batch (after a failure between the write
and the checkpoint commit) replace its own folder instead of duplicating rows.

Batch ids restart at 0 with a new checkpoint, so a new checkpoint needs a new
stream name.  A file changed in place is not read again and a deleted file
removes nothing: a table that follows those is :mod:`tidewater.plans.filesync`.

Every batch has a ledger row, ``{out}/_batches/stream={name}/batch_id={N}/``: rows read, kept
and counted back, and the status a run would have.  It is written after the rows, and a
replayed batch writes it again in the same place, so a batch has one row however often it was
tried.  :func:`read_verified` shows the batches whose row is VERIFIED; one that was interrupted
has none yet.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..config import DEFAULT_COLUMNS
from ..operators.metrics import STATUS_VERIFIED, RunMetrics, require_non_empty
from ..operators.transforms import drop_all_null, project
from ..sources.csv import CORRUPT_COLUMN, csv_reader
from ..sources.parquet import _missing_path

BATCH_ID = "batch_id"
STREAM = "stream"


def stream_path(out_base: str, name: str) -> str:
    """Output folder of one named stream."""
    return f"{out_base.rstrip('/')}/{STREAM}={name}"


class CheckpointMismatchError(ValueError):
    """A stream name is being reused with a different checkpoint."""


def _guard_checkpoint(spark: SparkSession, target: str, checkpoint: str) -> None:
    """Batch ids restart at 0 with a new checkpoint, so a new checkpoint under
    an old stream name would overwrite that stream's first batches.  The
    checkpoint location is kept in ``{target}/_checkpoint`` (hidden from
    readers) and must match on every start."""
    marker = f"{target}/_checkpoint"
    # An empty sentinel makes the glob below match even on the first start, so
    # no read of a missing path is ever attempted.
    spark.createDataFrame([("",)], "value STRING").coalesce(1) \
        .write.mode("overwrite").text(f"{marker}_sentinel")
    # bounded: the marker files hold one line each
    seen = {r["value"] for r in spark.read.text(f"{marker}*").collect()} - {""}
    if seen and seen != {checkpoint}:
        raise CheckpointMismatchError(
            f"stream at {target} was started with checkpoint {sorted(seen)[0]}, not "
            f"{checkpoint}; use a new stream name for a new checkpoint")
    if not seen:
        spark.createDataFrame([(checkpoint,)], "value STRING").coalesce(1) \
            .write.mode("overwrite").text(marker)


def stream_quarantine_path(out_base: str, name: str) -> str:
    """Folder of the rows of one named stream that did not parse (hidden from readers)."""
    return f"{out_base.rstrip('/')}/_quarantine/{STREAM}={name}"


LEDGER_DDL = ("status STRING, input_rows BIGINT, output_rows BIGINT, written_rows BIGINT, bad_rows BIGINT, "
              "started TIMESTAMP, finished TIMESTAMP")


def ledger_path(out_base: str, name: str) -> str:
    """Folder of the batch ledger of one named stream (hidden from readers of the rows)."""
    return f"{out_base.rstrip('/')}/_batches/{STREAM}={name}"


def _batch_writer(target: str, bad_rows: str | None = None, ledger: str | None = None,
                  cols: Sequence[str] | None = None, fail_on_empty: bool = False):
    """Writer of a batch's rows and, with ``bad_rows`` and ``ledger``, of those that did not
    parse and of its ledger row."""
    def count_back(spark: SparkSession, schema: StructType, path: str) -> int:
        try:
            return spark.read.schema(schema).parquet(path).count()  # footers only
        except AnalysisException as exc:
            if not _missing_path(exc):
                raise
            return 0

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, datetime.now()
        if ledger is None:
            batch.write.mode("overwrite").parquet(f"{target}/{BATCH_ID}={batch_id}")
            return
        seen, kept = Observation(f"ingest-in-{batch_id}"), Observation(f"ingest-out-{batch_id}")
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"),
                                F.count_if(F.col(CORRUPT_COLUMN).isNotNull()).alias("bad"))
        rows = drop_all_null(counted.drop(CORRUPT_COLUMN), cols).observe(kept, F.count(F.lit(1)).alias("rows"))
        path = f"{target}/{BATCH_ID}={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        got = seen.get
        if got["bad"]:  # a second read of the batch's files, only when there are any
            (batch.filter(F.col(CORRUPT_COLUMN).isNotNull())
                  .write.mode("overwrite").parquet(f"{bad_rows}/{BATCH_ID}={batch_id}"))
        metrics = RunMetrics(got["rows"], kept.get["rows"], count_back(spark, rows.schema, path), got["bad"])
        row = (metrics.status, metrics.input_rows, metrics.output_rows, metrics.written_rows, metrics.bad_rows,
               started, datetime.now())
        (spark.createDataFrame([row], LEDGER_DDL).coalesce(1)
              .write.mode("overwrite").parquet(f"{ledger}/{BATCH_ID}={batch_id}"))
        if fail_on_empty:
            require_non_empty(metrics, f"batch {batch_id}")

    return write_batch


def ingest_stream(
    spark: SparkSession,
    source: str,
    out_base: str,
    checkpoint: str,
    schema,
    *,
    columns: Sequence[str] = DEFAULT_COLUMNS,
    name: str = "default",
    strict: bool = False,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    clean_source: str | None = None,
    archive_dir: str | None = None,
    options=None,
    wait: bool = True,
    fail_on_empty: bool = False,
) -> StreamingQuery:
    """Start the ingest.  ``available_now`` consumes what is there and stops
    (``wait`` blocks until then); otherwise it polls every ``processing_time``
    (default ``10 seconds``, the interval of the original file mirror loop).

    The file source lists the whole source folder on every trigger.  For a
    folder that keeps growing, ``clean_source="archive"`` (with
    ``archive_dir``) or ``"delete"`` moves processed files out of it; it is off
    by default, so the input is never touched unless asked.

    Rows of which a kept column did not parse are also written, with their raw
    text, below :func:`stream_quarantine_path`, by batch id like the output.

    ``fail_on_empty`` ends the stream with an error at a batch that kept no rows or
    wrote another number than it produced, as an empty run fails; its ledger row says which.
    """
    reader = csv_reader(spark, schema=schema, strict=strict, streaming=True, options=options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if clean_source:
        if clean_source not in ("archive", "delete"):
            raise ValueError("clean_source is 'archive' or 'delete'")
        if clean_source == "archive" and not archive_dir:
            raise ValueError("clean_source='archive' needs archive_dir")
        reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
    cols = list(columns)
    rows = project(reader.csv(source), [*cols, CORRUPT_COLUMN])
    target = stream_path(out_base, name)
    _guard_checkpoint(spark, target, checkpoint)
    writer = (rows.writeStream
                  .foreachBatch(_batch_writer(target, stream_quarantine_path(out_base, name),
                                              ledger_path(out_base, name), cols, fail_on_empty))
                  .option("checkpointLocation", checkpoint)
                  .queryName(f"ingest_{name}"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=processing_time or "10 seconds")
    query = writer.start()
    if available_now and wait:
        query.awaitTermination()
    return query


def read_ingested(spark: SparkSession, out_base: str, name: str, schema) -> DataFrame:
    """Every row ingested by stream ``name`` with its ``batch_id``."""
    data = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    fields = [f for f in data.fields if f.name != BATCH_ID]
    full = StructType(fields + [StructField(BATCH_ID, LongType(), True)])
    return spark.read.schema(full).parquet(stream_path(out_base, name))


def batch_status(spark: SparkSession, out_base: str, name: str) -> DataFrame:
    """The ledger of stream ``name``: ``batch_id, status, input_rows, output_rows, written_rows,
    bad_rows, started, finished``, one row per batch; empty before the first one."""
    schema = StructType([*StructType.fromDDL(LEDGER_DDL).fields, StructField(BATCH_ID, LongType())])
    try:
        held = spark.read.schema(schema).parquet(ledger_path(out_base, name))
        held.schema
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        held = spark.createDataFrame([], schema)
    return held.select(BATCH_ID, *[c for c in held.columns if c != BATCH_ID])


def read_verified(spark: SparkSession, out_base: str, name: str, schema) -> DataFrame:
    """Rows of the batches whose ledger row is VERIFIED, with their ``batch_id``.  The ledger has
    one row per batch; its batch ids prune the folders that are read."""
    ok = batch_status(spark, out_base, name).filter(F.col("status") == STATUS_VERIFIED).select(BATCH_ID)
    try:
        rows = read_ingested(spark, out_base, name, schema)
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        data = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        rows = spark.createDataFrame([], data.add(BATCH_ID, LongType()))
    return rows.join(ok, BATCH_ID, "left_semi")
