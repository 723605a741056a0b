"""B4: run audit table and the published (latest verified) view of the runs.

The audit table holds one row per (run_date, attempt).  Every attempt writes
its rows (one per date it covers) as one file in its own folder
``{audit}/{attempt}/``: concurrent runs never meet in a shared temporary
directory, no row is ever rewritten, and a backfill over many dates is still
one small write.  Readers list the folders recursively; the table is small
(one file per attempt).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from pyspark.sql import Observation

from ..operators.metrics import (
    STATUS_EMPTY,
    STATUS_MISMATCH,
    STATUS_RUNNING,
    STATUS_TIMED_OUT,
    STATUS_VERIFIED,
)
from ..sources.parquet import (
    ATTEMPT,
    RUN_DATE,
    _dated_by_path,
    _missing_path,
    attempt_path,
    read_attempt,
    read_runs,
    runs_schema,
)
from .leases import read_leases
from ..sources.schemas import ERROR, schema_from_text, schema_text, unify, union_scans

AUDIT_COLUMNS = [
    "run_date", "attempt", "status", "input_rows", "output_rows", "written_rows",
    "started", "finished", "error", "schema", "replaces", "as_of",
]
AUDIT_DDL = (
    "run_date STRING, attempt STRING, status STRING, input_rows BIGINT, output_rows BIGINT, "
    "written_rows BIGINT, started TIMESTAMP, finished TIMESTAMP, error STRING, schema STRING, "
    "replaces STRING, as_of TIMESTAMP"
)
_AUDIT_SCHEMA = StructType([
    StructField("run_date", StringType()), StructField("attempt", StringType()),
    StructField("status", StringType()), StructField("input_rows", LongType()),
    StructField("output_rows", LongType()), StructField("written_rows", LongType()),
    StructField("started", TimestampType()), StructField("finished", TimestampType()),
    StructField("error", StringType()), StructField("schema", StringType()),
    StructField("replaces", StringType()), StructField("as_of", TimestampType()),
])


def audit_schema() -> StructType:
    return _AUDIT_SCHEMA


def write_audit(df: DataFrame, audit_path: str, attempt: str) -> None:
    """Write the audit rows of one attempt (columns :data:`AUDIT_COLUMNS`; those it lacks null)."""
    have = set(df.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in _AUDIT_SCHEMA.fields]
    df.select(*cols).write.mode("overwrite").parquet(f"{audit_path.rstrip('/')}/{attempt}")


def record_run(spark: SparkSession, audit_path: str, rows: Iterable[tuple]) -> None:
    """Append audit rows given as tuples in :data:`AUDIT_COLUMNS` order
    (one per run date of an attempt: a handful, built on the driver)."""
    rows = list(rows)
    if not rows:
        return
    attempts = {r[1] for r in rows}
    if len(attempts) != 1:
        raise ValueError("record_run takes the rows of one attempt")
    write_audit(spark.createDataFrame(rows, _AUDIT_SCHEMA), audit_path, attempts.pop())


def verify_and_record(spark: SparkSession, audit_path: str, runs_path: str, schema: StructType,
                      run_date: str, attempt: str, input_rows: int | None,
                      output_rows: int | None, started: datetime, *,
                      replaces: tuple[str, int] | None = None,
                      expires: int | None = None) -> tuple[int, str]:
    """Count the attempt back and append its audit row in one Spark job.

    The audit row is computed from the read-back count (footers only) and
    written by the same job; an observed metric on that write brings the
    count to the driver.  Returns ``(written_rows, status)``.  If the job
    fails, no audit row exists and the attempt stays invisible.

    ``replaces``: the attempt this one rewrites and the time (microseconds) that one
    stands for; see :func:`latest_verified`.  ``expires``: end of the attempt's lease
    in microseconds; the row is TIMED_OUT, and so never published, after it.
    """
    written = (spark.read.schema(schema).parquet(attempt_path(runs_path, run_date, attempt))
               .agg(F.count(F.lit(1)).alias("written_rows")))
    n = F.col("written_rows")
    late = F.lit(False) if expires is None else F.unix_micros(F.current_timestamp()) > F.lit(expires)
    status = F.when(late, F.lit(STATUS_TIMED_OUT))
    status = status.when(F.lit(output_rows).isNotNull() & (n != F.lit(output_rows)),
                         F.lit(STATUS_MISMATCH))
    status = status.when(n == 0, F.lit(STATUS_EMPTY)).otherwise(F.lit(STATUS_VERIFIED))
    row = written.select(
        F.lit(run_date).alias(RUN_DATE), F.lit(attempt).alias(ATTEMPT), status.alias("status"),
        F.lit(input_rows).cast("bigint").alias("input_rows"),
        F.lit(output_rows).cast("bigint").alias("output_rows"),
        n.cast("bigint").alias("written_rows"),
        F.lit(started).cast("timestamp").alias("started"),
        F.current_timestamp().alias("finished"),
        F.lit(None).cast("string").alias("error"),
        F.lit(schema_text(schema)).alias("schema"),
        F.lit(replaces and replaces[0]).cast("string").alias("replaces"),
        F.timestamp_micros(F.lit(replaces and replaces[1]).cast("bigint")).alias("as_of"))
    obs = Observation(f"verify-{attempt}")
    row = row.observe(obs, F.max("written_rows").alias("written"), F.max("status").alias("status"))
    write_audit(row, audit_path, attempt)
    got = obs.get
    return int(got["written"]), got["status"]


def read_audit(spark: SparkSession, audit_path: str) -> DataFrame:
    """All audit rows; an audit table that does not exist yet is empty."""
    try:
        df = (spark.read.schema(_AUDIT_SCHEMA).option("recursiveFileLookup", True)
              .parquet(audit_path))
        df.schema  # resolve now so a missing folder surfaces here
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        df = spark.createDataFrame([], AUDIT_DDL)
    return df.select(*AUDIT_COLUMNS)


def read_attempt_audit(spark: SparkSession, audit_path: str, attempt: str) -> DataFrame:
    """Audit rows of one attempt; only its folder is listed."""
    return (spark.read.schema(_AUDIT_SCHEMA).parquet(f"{audit_path.rstrip('/')}/{attempt}")
            .select(*AUDIT_COLUMNS))


def attempt_is_audited(spark: SparkSession, audit_path: str, attempt: str) -> bool:
    """Whether the audit holds rows of ``attempt``; only its folder is listed."""
    try:
        return not read_attempt_audit(spark, audit_path, attempt).isEmpty()
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        return False


def _latest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Latest attempt per run_date, with ``columns``: by ``finished``, then
    attempt id (ids sort by start time).  An attempt that ``replaces`` another stands
    where that one stood, just above it.  ``max_by`` aggregates map-side, so a
    date with many attempts is no burden; only the named columns are read."""
    order = F.struct(F.coalesce("as_of", "finished"), F.coalesce("replaces", ATTEMPT), F.col("finished"), F.col(ATTEMPT))
    payload = F.struct(*[F.col(c) for c in columns if c != RUN_DATE])
    return (df.groupBy(RUN_DATE)
              .agg(F.max_by(payload, order).alias("_last"))
              .select(RUN_DATE, "_last.*"))


def run_status(spark: SparkSession, audit_path: str, leases_path: str | None = None) -> DataFrame:
    """Status of the latest attempt of every run date.  With ``leases_path`` also attempts
    that started and have no audit row: RUNNING while their lease lasts, then TIMED_OUT."""
    rows = read_audit(spark, audit_path)
    if leases_path is not None:
        rows = rows.unionByName(open_attempts(spark, audit_path, leases_path))
    return _latest(rows, AUDIT_COLUMNS).select(*AUDIT_COLUMNS)


def open_attempts(spark: SparkSession, audit_path: str, leases_path: str) -> DataFrame:
    """Audit-like rows of the attempts that hold a lease and have no audit row.  A running one
    stands for the present time, an expired one for the end of its lease."""
    held = read_leases(spark, leases_path).join(
        read_audit(spark, audit_path).select(RUN_DATE, ATTEMPT), [RUN_DATE, ATTEMPT], "left_anti")
    now = F.current_timestamp()
    over = F.col("expires") < now
    have = {
        RUN_DATE: F.col(RUN_DATE), ATTEMPT: F.col(ATTEMPT), "started": F.col("started"),
        "status": F.when(over, F.lit(STATUS_TIMED_OUT)).otherwise(F.lit(STATUS_RUNNING)),
        "finished": F.when(over, F.col("expires")), "as_of": F.when(over, F.col("expires")).otherwise(now),
    }
    return held.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _AUDIT_SCHEMA.fields])


def latest_verified(spark: SparkSession, audit_path: str, *, schemas: bool = False) -> DataFrame:
    """(run_date, attempt) of the latest VERIFIED attempt of every run date, with ``schemas``
    also the text of its schema (null for attempts recorded without one).

    A compaction counts only while the attempt it rewrote is the latest: a run that lands
    between its read and its audit row stays published."""
    verified = read_audit(spark, audit_path).filter(F.col("status") == STATUS_VERIFIED)
    columns = [ATTEMPT, "schema"] if schemas else [ATTEMPT]
    return _latest(verified, columns).select(RUN_DATE, *columns)


def published_attempt(spark: SparkSession, audit_path: str, run_date: str) -> tuple[str, str, int]:
    """Published attempt of a date, the attempt whose rows it holds (itself, or what it
    replaces, from compaction to compaction) and the time in microseconds that one stands for."""
    verified = read_audit(spark, audit_path).filter(
        (F.col("status") == STATUS_VERIFIED) & (F.col(RUN_DATE) == run_date))
    verified = verified.withColumns({"origin": F.coalesce("replaces", ATTEMPT),
                                     "stands": F.unix_micros(F.coalesce("as_of", "finished"))})
    row = _latest(verified, [ATTEMPT, "origin", "stands"]).first()
    if row is None:
        raise LookupError(f"no verified run for {run_date}")
    return row[ATTEMPT], row["origin"], row["stands"]


def read_attempts(spark: SparkSession, runs_path: str, attempts: Sequence[tuple[str, str, str | None]],
                  schema: StructType | None = None, on_conflict: str = ERROR) -> DataFrame:
    """Rows of the given (run_date, attempt, schema text), as one DataFrame.

    Attempts are grouped by schema; each group is one scan of its folders with its own schema,
    cast to ``schema`` or, without one, to the widest types of all (see
    :func:`tidewater.sources.schemas.unify`; columns by name, missing ones null).  An attempt
    recorded without a schema is read with ``schema``; without that, its footer tells."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for run_date, attempt, text in sorted(attempts, key=lambda a: a[:2]):
        if text is None:
            own = schema or spark.read.parquet(attempt_path(runs_path, run_date, attempt)).schema
            text = schema_text(own)
        groups.setdefault(text, []).append((run_date, attempt))
    if not groups:
        if schema is None:
            return spark.createDataFrame([], f"{RUN_DATE} STRING, {ATTEMPT} STRING")
        return spark.createDataFrame([], runs_schema(schema))
    types = [(schema_from_text(text), [d for d, _ in pairs]) for text, pairs in groups.items()]
    scans = [(spark.read.schema(runs_schema(own)).option("basePath", runs_path.rstrip("/"))
              .parquet(*[attempt_path(runs_path, d, a) for d, a in pairs]))
             for (own, _), pairs in zip(types, groups.values())]
    target = schema or unify(types, on_conflict, scans)
    target = StructType([f for f in target.fields if f.name not in (RUN_DATE, ATTEMPT)])
    return union_scans(scans, target, [RUN_DATE, ATTEMPT])


def read_published(spark: SparkSession, runs_path: str, audit_path: str,
                   schema: StructType | None = None, *, exact_paths: bool = True,
                   on_conflict: str = ERROR) -> DataFrame:
    """Rows of the latest verified attempt of every date: what readers see.

    ``exact_paths`` (default): the (run_date, attempt, schema) rows - one per date,
    so their number is bounded by the dates, not by the data - are fetched
    first and only those folders are listed and read, with one scan per distinct
    schema (:func:`read_attempts`); superseded and failed attempts are never even
    listed.  Otherwise a lazy left-semi join on (run_date, attempt), where the
    measured size of the audit side decides the kind of join; it lets dynamic
    partition pruning skip the other attempt folders (but the whole table is
    listed once).  One lazy scan has one schema: where the recorded ones differ,
    the folders are read exactly.
    """
    published = latest_verified(spark, audit_path, schemas=True)
    if not exact_paths and published.select("schema").distinct().limit(2).count() < 2:
        runs = read_runs(spark, runs_path, schema)
        return runs.join(published.drop("schema"), [RUN_DATE, ATTEMPT], "left_semi")
    rows = [tuple(r) for r in published.collect()]  # bounded: one per date
    return read_attempts(spark, runs_path, rows, schema, on_conflict)


def read_all_attempts(spark: SparkSession, runs_path: str, audit_path: str,
                      schema: StructType | None = None, *, on_conflict: str = ERROR) -> DataFrame:
    """A11: rows of every recorded attempt that wrote any, superseded ones included."""
    held = read_audit(spark, audit_path).filter(F.col("written_rows") > 0).select(RUN_DATE, ATTEMPT, "schema")
    rows = [tuple(r) for r in held.collect()]  # bounded: one per attempt and date
    return read_attempts(spark, runs_path, rows, schema, on_conflict)


def read_overwritten(spark: SparkSession, base: str, audit_path: str,
                     on_conflict: str = ERROR) -> DataFrame:
    """A11 in the parity layout: every ``{base}/D/`` folder with the schema that its last
    successful write recorded, one scan per distinct schema."""
    wrote = read_audit(spark, audit_path).filter(F.col("written_rows").isNotNull() & F.col("schema").isNotNull())
    groups: dict[str, list[str]] = {}
    for run_date, text in _latest(wrote, ["schema"]).collect():  # bounded: one per date
        groups.setdefault(text, []).append(run_date)
    types = [(schema_from_text(text), dates) for text, dates in sorted(groups.items(), key=lambda g: min(g[1]))]
    scans = [_dated_by_path(spark.read.schema(own).parquet(*[f"{base.rstrip('/')}/{d}/" for d in sorted(dates)]))
             for own, dates in types]
    if not scans:
        return spark.createDataFrame([], f"{RUN_DATE} STRING")
    return union_scans(scans, unify(types, on_conflict, scans), [RUN_DATE])


def schema_history(spark: SparkSession, audit_path: str) -> DataFrame:
    """Types of each column over the verified attempts: ``column, type, n_attempts, first_date,
    last_date``.  A nested type is its JSON text."""
    shape = "fields array<struct<name string, type string>>"
    held = read_audit(spark, audit_path).filter((F.col("status") == STATUS_VERIFIED) & F.col("schema").isNotNull())
    each = held.select(RUN_DATE, F.explode(F.from_json("schema", shape)["fields"]).alias("f"))
    return each.groupBy(F.lower("f.name").alias("column"), F.col("f.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min(RUN_DATE).alias("first_date"), F.max(RUN_DATE).alias("last_date"))


def read_run(spark: SparkSession, runs_path: str, audit_path: str, run_date: str,
             attempt: str | None = None, schema: StructType | None = None) -> DataFrame:
    """A8: rows of one run date - the given attempt, or the published
    (latest verified) one.  Only that attempt's folder is listed."""
    if attempt is None:
        pairs = (latest_verified(spark, audit_path)
                 .filter(F.col(RUN_DATE) == run_date).select(ATTEMPT).collect())  # bounded: 1 row
        if not pairs:
            raise LookupError(f"no verified run for {run_date}")
        attempt = pairs[0][ATTEMPT]
    return read_attempt(spark, runs_path, run_date, attempt, schema)


def run_metrics(spark: SparkSession, audit_path: str, attempt: str) -> DataFrame:
    """A4: (run_date, input_rows, output_rows, written_rows, status) of one attempt."""
    return (read_attempt_audit(spark, audit_path, attempt)
            .select(RUN_DATE, "input_rows", "output_rows", "written_rows", "status"))


def audit_row(run_date: str, attempt: str, status: str, input_rows: int | None,
              output_rows: int | None, written_rows: int | None, started: datetime,
              finished: datetime, error: str | None = None, schema: str | None = None) -> tuple:
    return (run_date, attempt, status, input_rows, output_rows, written_rows, started,
            finished, error, schema, None, None)
