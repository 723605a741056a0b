"""A7 Parquet sink per run, A8 read-back, A11 read of all runs.

Two layouts:

* **attempts** (default): ``{base}/run_date=D/attempt=A/``.  Every run writes a
  new attempt and never replaces data in place; the audit table decides which
  attempt is published (see :mod:`tidewater.plans.runs`).  A failed, empty or
  half-written attempt is therefore never visible to readers.
* **overwrite** (parity): ``{base}/D/`` replaced in place, exactly as the
  original job did - including that an empty run destroys the previous output.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RUN_DATE = "run_date"
ATTEMPT = "attempt"
PARTITION_FIELDS = [StructField(RUN_DATE, StringType(), True),
                    StructField(ATTEMPT, StringType(), True)]


def new_attempt_id(now: datetime | None = None) -> str:
    """Attempt ids sort by start time; the random suffix keeps them unique."""
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def attempt_path(base: str, run_date: str, attempt: str) -> str:
    """Folder of one attempt: ``{base}/run_date=D/attempt=A``."""
    return f"{base.rstrip('/')}/{RUN_DATE}={run_date}/{ATTEMPT}={attempt}"


def _writer(df: DataFrame, max_records_per_file: int | None):
    w = df.write.mode("overwrite")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    return w


def write_attempt(df: DataFrame, base: str, run_date: str, attempt: str,
                  max_records_per_file: int | None = None) -> str:
    """Write ``df`` as one attempt of one date.

    The attempt directory is private to this write, so the committer's
    temporary files never meet those of a concurrent run of another date or
    attempt; a rerun of the same attempt id replaces only that directory.
    ``max_records_per_file`` caps file size without a shuffle.
    """
    path = attempt_path(base, run_date, attempt)
    _writer(df, max_records_per_file).parquet(path)
    return path


def write_attempt_by_date(df: DataFrame, base: str, attempt: str, date_col: str = RUN_DATE,
                          max_records_per_file: int | None = None) -> None:
    """Write one attempt covering many dates in a single job.

    ``df`` carries the date in ``date_col``.  Dynamic partition overwrite
    stages files in a job-private folder and only touches the
    ``run_date=D/attempt=A`` folders this job produced; since ``attempt`` is
    new, nothing published is replaced.  No shuffle is added: each task writes
    the dates it holds, sorted locally by the writer.
    """
    out = df
    if date_col != RUN_DATE:
        out = out.withColumnRenamed(date_col, RUN_DATE)
    (_writer(out.withColumn(ATTEMPT, F.lit(attempt)), max_records_per_file)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN_DATE, ATTEMPT)
        .parquet(base))


def write_overwrite(df: DataFrame, base: str, run_date: str,
                    max_records_per_file: int | None = None) -> str:
    """Parity layout: replace ``{base}/{run_date}/``."""
    path = f"{base.rstrip('/')}/{run_date}/"
    _writer(df, max_records_per_file).parquet(path)
    return path


def write_run(df: DataFrame, base: str, run_date: str, attempt: str | None = None,
              layout: str = "attempts") -> str:
    """A7: write one run.  ``attempts``: a new attempt folder (id generated
    when not given); ``overwrite``: replace ``{base}/{run_date}/`` in place."""
    if layout == "overwrite":
        return write_overwrite(df, base, run_date)
    return write_attempt(df, base, run_date, attempt or new_attempt_id())


def _missing_path(exc: AnalysisException) -> bool:
    cond = getattr(exc, "getCondition", None) or getattr(exc, "getErrorClass", None)
    name = cond() if cond else None
    return name == "PATH_NOT_FOUND" or "PATH_NOT_FOUND" in str(exc)


def read_attempt(spark: SparkSession, base: str, run_date: str, attempt: str,
                 schema: StructType | None = None) -> DataFrame:
    """Rows of one attempt plus its ``run_date``/``attempt`` columns (as text).

    Only the attempt's own folder is listed.
    """
    path = attempt_path(base, run_date, attempt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.withColumn(RUN_DATE, F.lit(run_date)).withColumn(ATTEMPT, F.lit(attempt))


def count_attempt(spark: SparkSession, base: str, run_date: str, attempt: str,
                  schema: StructType | None = None) -> int:
    """Rows in an attempt folder, 0 when the folder does not exist.  Parquet
    counts come from the file footers; no column is decoded."""
    try:
        return read_attempt(spark, base, run_date, attempt, schema).count()
    except AnalysisException as exc:
        if _missing_path(exc):
            return 0
        raise


def count_attempt_by_date(spark: SparkSession, base: str, attempt: str,
                          data_schema: StructType, dates: list[str] | None = None) -> DataFrame:
    """(run_date, written_rows) of one multi-date attempt.

    With ``dates`` (the dates the write produced) exactly those folders are
    read: Spark checks explicit paths in parallel and lists many of them with
    a distributed job.  Without, a ``run_date=*/attempt=A`` glob finds them,
    which lists every date folder of the table.  The count per date
    aggregates map-side, so a date holding a third of all rows is still one
    row per task in the shuffle.
    """
    empty = spark.createDataFrame([], f"{RUN_DATE} STRING, written_rows BIGINT")
    if dates is not None:
        if not dates:
            return empty
        paths = [attempt_path(base, d, attempt) for d in dates]
    else:
        paths = [f"{base.rstrip('/')}/{RUN_DATE}=*/{ATTEMPT}={attempt}"]
    try:
        runs = (spark.read.schema(runs_schema(data_schema))
                .option("basePath", base.rstrip("/")).parquet(*paths))
        runs.schema
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        return empty
    return runs.groupBy(RUN_DATE).agg(F.count(F.lit(1)).alias("written_rows"))


def runs_schema(data_schema: StructType) -> StructType:
    """Data columns plus ``run_date`` and ``attempt`` as text."""
    fields = [f for f in data_schema.fields if f.name not in (RUN_DATE, ATTEMPT)]
    return StructType(fields + PARTITION_FIELDS)


def read_runs(spark: SparkSession, base: str, schema: StructType | None = None) -> DataFrame:
    """A11: one DataFrame over every run in the attempts layout.

    ``run_date`` and ``attempt`` come from the folder names and are read as
    text (inference would turn ``20240101`` into an integer).  Filters on them
    prune folders.  Without ``schema`` the data schema is taken from the files.
    """
    if schema is None:
        schema = spark.read.parquet(base).schema
    return spark.read.schema(runs_schema(schema)).parquet(base)


def read_overwrite_runs(spark: SparkSession, base: str) -> DataFrame:
    """Parity layout: every ``{base}/D/`` folder; the date comes from the path.  All folders
    have one schema here; :func:`tidewater.plans.audit.read_overwritten` takes different ones."""
    df = spark.read.option("recursiveFileLookup", True).parquet(base)
    return _dated_by_path(df)


def _dated_by_path(df: DataFrame) -> DataFrame:
    return df.withColumn(
        RUN_DATE, F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{8})/[^/]*$", 1)
    )
