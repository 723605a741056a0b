"""The CSV-to-Parquet job: scan, keep the named columns, drop empty rows,
publish per run date, verify.

One pass over the input: the input and output counts are observed by the write
itself (``Observation``); the verification count comes from the Parquet
footers of the attempt just written, and the audit row is computed from it and
written in the same Spark job.  With a declared schema there is no inference
pass either.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LAYOUT_OVERWRITE, JobConfig
from ..functions.logformat import format_input_count, format_output_count, format_verification
from ..operators.metrics import (
    STATUS_FAILED,
    STATUS_TIMED_OUT,
    RunMetrics,
    RunTimeoutError,
    observe_rows,
    require_non_empty,
)
from ..operators.transforms import drop_all_null, preview_text, project, schema_lines
from ..sources.csv import CORRUPT_COLUMN, scan_csv
from ..sources.parquet import (
    ATTEMPT,
    RUN_DATE,
    attempt_path,
    count_attempt,
    new_attempt_id,
    write_attempt,
    write_overwrite,
)
from ..sources.schemas import schema_text
from .audit import attempt_is_audited, audit_row, latest_verified, record_run, verify_and_record
from .leases import Lease


@dataclass
class RunResult:
    """Outcome of one attempt: status, counts, where it was written, timing, log lines."""

    run_date: str
    attempt: str
    status: str
    input_rows: int | None
    output_rows: int | None
    written_rows: int | None
    bad_rows: int | None
    path: str | None
    started: datetime
    finished: datetime
    error: str | None = None
    log_lines: list[str] = field(default_factory=list)
    schema: str | None = None

    def audit(self) -> tuple:
        return audit_row(self.run_date, self.attempt, self.status, self.input_rows,
                         self.output_rows, self.written_rows, self.started, self.finished,
                         self.error, self.schema)


def _now() -> datetime:
    return datetime.now()


def build_output(raw: DataFrame, columns, name: str, carry=(), rebalance=None,
                 observe_values: str | None = None, input_metrics=(), keep=None):
    """Projection + empty-row filter with observed counts.

    Returns ``(output, input_observation, output_observation)``.  ``carry``
    columns (e.g. the run date) are kept but do not count as values.  The input
    count is observed after the projection (a projection keeps every row) so
    that the scan still reads only the kept columns.

    ``rebalance`` (None: off; a list of columns, possibly empty) adds an AQE
    rebalance right after the projection, *before* the counts: the observed
    metrics then sit in the final (writing) stage, where Spark applies each
    task's metrics once even when tasks are retried or speculated.  Metrics in
    a shuffle-map stage could be applied twice if that stage is re-run after
    an executor is lost.

    ``input_metrics`` are further aggregate columns observed on the input.
    ``keep`` is a condition for rows to go on behind the input counts.
    ``observe_values`` names a column whose distinct values are also observed
    on the output (``collect_set``) - only for columns with few values, such
    as the run date of a backfill, whose values are bounded by the request.
    """
    columns = list(columns)
    has_corrupt = CORRUPT_COLUMN in raw.columns
    cols = columns + list(carry) + ([CORRUPT_COLUMN] if has_corrupt else [])
    selected = project(raw, cols)
    if rebalance is not None:
        selected = selected.hint("rebalance", *rebalance)
    extra = list(input_metrics)
    if has_corrupt:
        extra.append(F.count_if(F.col(CORRUPT_COLUMN).isNotNull()).alias("bad"))
    selected, in_obs = observe_rows(selected, f"in-{name}", *extra)
    if has_corrupt:
        selected = selected.drop(CORRUPT_COLUMN)
    if keep is not None:
        selected = selected.filter(keep)
    out = drop_all_null(selected, columns)
    values = [F.collect_set(observe_values).alias("values")] if observe_values else []
    out, out_obs = observe_rows(out, f"out-{name}", *values)
    return out, in_obs, out_obs


class SchemaDriftError(RuntimeError):
    """The kept columns' types differ from those of the published runs."""


def check_schema_drift(spark: SparkSession, cfg: JobConfig, schema) -> None:
    """Compare ``schema`` with the latest published attempt of any date (one
    footer read); raise :class:`SchemaDriftError` on a difference."""
    latest = (latest_verified(spark, cfg.audit_path)
              .orderBy(F.col(ATTEMPT).desc()).limit(1).collect())
    if not latest:
        return
    path = attempt_path(cfg.output_base, latest[0][RUN_DATE], latest[0][ATTEMPT])
    before = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema.fields}
    now = {f.name: f.dataType.simpleString() for f in schema.fields}
    changed = {k: (before.get(k), v) for k, v in now.items() if before.get(k) != v}
    if changed:
        raise SchemaDriftError(f"column types changed since {latest[0][RUN_DATE]}: {changed}")


def quarantine(raw: DataFrame, cfg: JobConfig, attempt: str) -> str:
    """Write the bad rows, with their raw text, to ``{quarantine}/run_date=D/attempt=A/``.
    A row is bad when one of the kept columns did not parse under the declared schema:
    the scan is pruned to those columns exactly as the counted one.  A second scan, run
    only when the observed count of such rows is not zero."""
    path = attempt_path(cfg.quarantine_path, cfg.run_date, attempt)
    bad = project(raw, [*cfg.columns, CORRUPT_COLUMN]).filter(F.col(CORRUPT_COLUMN).isNotNull())
    fields = [f for f in raw.schema.fields if f.name != CORRUPT_COLUMN]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    whole = F.from_csv(CORRUPT_COLUMN, ddl, dict(cfg.csv_options or {}))  # columns not kept, from the text
    (bad.withColumn("_whole", whole)
        .select(*[F.col(f.name) if f.name in cfg.columns else F.col("_whole")[f.name].alias(f.name) for f in fields],
                CORRUPT_COLUMN)
        .write.mode("overwrite").parquet(path))
    return path


def require_new_attempt(spark: SparkSession, cfg: JobConfig, attempt: str | None) -> None:
    """Raise ValueError for a given attempt id that the audit already holds: writing it
    again would replace rows that readers may see."""
    if attempt is not None and attempt_is_audited(spark, cfg.audit_path, attempt):
        raise ValueError(f"attempt {attempt!r} is in the audit already; use a new id")


def require_catalog(spark: SparkSession, cfg: JobConfig) -> None:
    """Raise ValueError before anything is written when ``cfg.catalog_table`` is missing."""
    for name in (cfg.catalog_table, f"{cfg.catalog_table}_audit"):
        if not spark.catalog.tableExists(name):
            raise ValueError(f"no catalog table {name!r}; create it with register_catalog")


def _refresh(spark: SparkSession, cfg: JobConfig, dates: list[str], log) -> None:
    """Move the session's views to what was published; they can be refreshed again, so a
    failure does not undo a publication."""
    from .catalog import refresh_views
    try:
        refresh_views(spark, cfg, dates)
    except Exception as exc:
        if log is not None:
            log(f"Views not refreshed: {type(exc).__name__}: {exc}")


def _lease(spark: SparkSession, cfg: JobConfig, attempt: str, dates: list[str]) -> Lease:
    return Lease(spark, cfg.leases_path, attempt, dates, cfg.time_limit, cfg.renew_lease_every,
                 cfg.own_session)


def write_job_log(spark: SparkSession, cfg: JobConfig, run_date: str, attempt: str,
                  lines: list[str]) -> str:
    """Keep the job's log lines next to the data (one small text file per attempt)."""
    path = f"{cfg.logs_path}/run_date={run_date}/attempt={attempt}"
    (spark.createDataFrame([(line,) for line in lines], "value STRING")
          .coalesce(1).write.mode("overwrite").text(path))
    return path


def run_job(
    spark: SparkSession,
    cfg: JobConfig,
    *,
    attempt: str | None = None,
    log: Callable[[str], None] | None = print,
    record: bool = True,
    keep_log: bool = False,
    raise_on_failure: bool = True,
) -> RunResult:
    """Run the job for ``cfg.run_date``.

    Attempts layout: the output goes to a new attempt folder, is counted back
    and an audit row is appended; readers see it only if it is VERIFIED.
    Overwrite layout: the run's folder is replaced, as in the original job.
    The log lines go to ``log`` (stdout by default, like the original job);
    ``keep_log`` also stores them as text under ``cfg.logs_path`` for
    :func:`tidewater.sources.logs.read_run_logs`.
    An EMPTY, MISMATCH or FAILED run raises (after its audit row is written)
    unless ``raise_on_failure`` is False.
    """
    started = _now()
    if cfg.layout != LAYOUT_OVERWRITE:
        require_new_attempt(spark, cfg, attempt)
    attempt = attempt or new_attempt_id()
    lines: list[str] = []

    def emit(line: str) -> None:
        lines.append(line)
        if log is not None:
            log(line)

    emit(f"Job run_date={cfg.run_date} attempt={attempt}")
    emit(f"Source folder: {cfg.input_path}")
    target = cfg.output_path if cfg.layout == LAYOUT_OVERWRITE else cfg.attempt_path(attempt)
    emit(f"Target folder: {target}")
    input_rows = output_rows = written = bad = None
    path = kept = None
    error = None
    recorded = False
    recorded_status = None
    failure: BaseException | None = None
    guard = ExitStack()
    lease = None
    try:
        if cfg.time_limit and record:
            lease = _lease(spark, cfg, attempt, [cfg.run_date])
            guard.enter_context(lease)
        if cfg.catalog_table and cfg.layout != LAYOUT_OVERWRITE:
            require_catalog(spark, cfg)
        raw = scan_csv(spark, cfg.input_path, schema=cfg.schema, strict=cfg.strict,
                       recursive=cfg.recursive, options=cfg.csv_options, by_header=cfg.by_header)
        emit("Columns and types of the source:")
        for line in schema_lines(raw):
            emit(line)
        if cfg.preview_input:
            for line in preview_text(raw, cfg.preview_input):
                emit(line)
        out, in_obs, out_obs = build_output(raw, cfg.columns, attempt,
                                            rebalance=[] if cfg.rebalance else None)
        kept = schema_text(out.schema)
        if cfg.check_drift and cfg.layout != LAYOUT_OVERWRITE:
            check_schema_drift(spark, cfg, out.schema)
        if cfg.layout == LAYOUT_OVERWRITE:
            path = write_overwrite(out, cfg.output_base, cfg.run_date, cfg.max_records_per_file)
        else:
            path = write_attempt(out, cfg.output_base, cfg.run_date, attempt,
                                 cfg.max_records_per_file)
        in_metrics = in_obs.get
        input_rows = in_metrics["rows"]
        bad = in_metrics.get("bad")
        output_rows = out_obs.get["rows"]
        emit(format_input_count(input_rows))
        emit(format_output_count(output_rows))
        if bad:
            qpath = quarantine(raw, cfg, attempt)
            emit(f"Quarantined rows : {bad} written to {qpath}")
        # the schema is known: no footer job to infer it again
        recorded = False
        if cfg.layout == LAYOUT_OVERWRITE:
            written = spark.read.schema(out.schema).parquet(path).count()
        elif record:
            written, recorded_status = verify_and_record(spark, cfg.audit_path, cfg.output_base, out.schema,
                                                cfg.run_date, attempt, input_rows, output_rows,
                                                started, expires=lease and lease.expires)
            recorded = True
        else:
            written = count_attempt(spark, cfg.output_base, cfg.run_date, attempt, out.schema)
        emit(format_verification(written, path))
        status = RunMetrics(input_rows, output_rows, written, bad).status
        if recorded and recorded_status == STATUS_TIMED_OUT:
            raise RunTimeoutError(f"the run took longer than {cfg.time_limit:g} s")
    except Exception as exc:  # recorded, then re-raised below
        late = lease is not None and lease.expired()
        if late and not isinstance(exc, RunTimeoutError):
            exc = RunTimeoutError(f"the run took longer than {cfg.time_limit:g} s ({type(exc).__name__}: {exc})")
        status, error, failure = STATUS_TIMED_OUT if late else STATUS_FAILED, f"{type(exc).__name__}: {exc}", exc
    finally:
        guard.close()
    finished = _now()
    if cfg.preview_output and failure is None:
        try:  # the run is decided: a preview that fails is only logged
            for line in preview_text(spark.read.parquet(path), cfg.preview_output):
                emit(line)
        except Exception as exc:
            emit(f"No preview of the output: {type(exc).__name__}: {exc}")
    emit(f"Status: {status}")
    result = RunResult(cfg.run_date, attempt, status, input_rows, output_rows, written, bad,
                       path, started, finished, error, lines, kept)
    if record and not recorded:
        record_run(spark, cfg.audit_path, [result.audit()])
    if keep_log:
        write_job_log(spark, cfg, cfg.run_date, attempt, lines)
    if record and cfg.layout != LAYOUT_OVERWRITE:
        _refresh(spark, cfg, [cfg.run_date], log)
    if cfg.catalog_table and written and cfg.layout != LAYOUT_OVERWRITE:
        from .catalog import add_attempt
        try:  # readers go by the audit; register_catalog adds what a failure here left out
            add_attempt(spark, cfg, cfg.run_date, attempt)
        except Exception as exc:
            if log is not None:
                log(f"Catalog not updated: {type(exc).__name__}: {exc}")
    if raise_on_failure:
        if failure is not None:
            raise failure
        require_non_empty(RunMetrics(input_rows, output_rows, written or 0, bad),
                          where=cfg.input_path)
    return result


def plan_job(spark: SparkSession, cfg: JobConfig, date_col: str | None = None,
             dates: list[str] | None = None) -> DataFrame:
    """The DataFrame a run (or, with ``date_col`` and ``dates``, a sliced
    backfill) would write, for ``explain()``; nothing is executed beyond what
    resolving the schema needs (the inference pass when no schema is declared)."""
    raw = scan_csv(spark, cfg.input_path, schema=cfg.schema, strict=cfg.strict,
                   recursive=cfg.recursive, options=cfg.csv_options, by_header=cfg.by_header)
    if date_col is None:
        out, _, _ = build_output(raw, cfg.columns, "plan",
                                 rebalance=[] if cfg.rebalance else None)
        return out
    from .runs import dated_rows
    out, _, _ = build_output(dated_rows(raw, date_col, dates), cfg.columns, "plan", carry=[RUN_DATE],
                             rebalance=[RUN_DATE] if cfg.rebalance else None,
                             observe_values=RUN_DATE, keep=F.col(RUN_DATE).isNotNull())
    return out


def run_with_retries(spark: SparkSession, cfg: JobConfig, *, retries: int = 2,
                     delay: float = 10.0, log: Callable[[str], None] | None = print,
                     **kwargs) -> RunResult:
    """Run the job, retrying a failed, empty or mismatched run up to
    ``retries`` times after ``delay`` seconds (the original deployment retried
    twice, 10 s apart).  Every try is its own attempt in the audit table; the
    last error is raised when no try is VERIFIED."""
    import time

    for i in range(retries + 1):
        try:
            return run_job(spark, cfg, log=log, **kwargs)
        except Exception as exc:  # the attempt is already in the audit table
            if i == retries:
                raise
            if log is not None:
                log(f"Attempt {i + 1} failed ({type(exc).__name__}); retrying in {delay:g} s")
            time.sleep(delay)
    raise AssertionError("unreachable")


def publish_frame(
    spark: SparkSession,
    df: DataFrame,
    cfg: JobConfig,
    *,
    attempt: str | None = None,
    log: Callable[[str], None] | None = print,
    raise_on_failure: bool = True,
    replaces: tuple[str, int] | None = None,
) -> RunResult:
    """Publish any DataFrame as a new attempt of ``cfg.run_date``: observed
    count, write, read-back count, audit row - the same guarantees as
    :func:`run_job` (e.g. for the result of a mirror).  ``replaces`` makes it stand for
    another attempt (see :func:`compact_run`)."""
    started = _now()
    require_new_attempt(spark, cfg, attempt)
    attempt = attempt or new_attempt_id()
    output_rows = written = None
    path = error = None
    recorded = False
    failure: BaseException | None = None
    try:
        # rebalance before the count, so that the count sits in the final stage
        out, obs = observe_rows(df.hint("rebalance") if cfg.rebalance else df, f"pub-{attempt}")
        path = write_attempt(out, cfg.output_base, cfg.run_date, attempt, cfg.max_records_per_file)
        output_rows = obs.get["rows"]
        written, status = verify_and_record(spark, cfg.audit_path, cfg.output_base, out.schema,
                                            cfg.run_date, attempt, None, output_rows, started,
                                            replaces=replaces)
        recorded = True
    except Exception as exc:
        status, error, failure = STATUS_FAILED, f"{type(exc).__name__}: {exc}", exc
    finished = _now()
    lines = [format_output_count(output_rows)] if output_rows is not None else []
    if written is not None:
        lines.append(format_verification(written, path))
    lines.append(f"Status: {status}")
    for line in lines:
        if log is not None:
            log(line)
    result = RunResult(cfg.run_date, attempt, status, None, output_rows, written, None, path,
                       started, finished, error, lines)
    if not recorded:
        record_run(spark, cfg.audit_path, [result.audit()])
    _refresh(spark, cfg, [cfg.run_date], log)
    if raise_on_failure:
        if failure is not None:
            raise failure
        require_non_empty(RunMetrics(None, output_rows, written or 0), where=path or "")
    return result


def compact_run(spark: SparkSession, cfg: JobConfig, run_date: str | None = None,
                log: Callable[[str], None] | None = print) -> RunResult:
    """Rewrite the published attempt of a date as a new, rebalanced attempt
    (files of the advisory size instead of one per input split).  It is
    verified and audited like any run, as a replacement of the attempt it read:
    readers move to it only while that one is the latest, so a run that lands in
    between stays published.  The old folder stays until removed with filesystem tools."""
    from dataclasses import replace

    from .audit import published_attempt, read_run

    run_date = run_date or cfg.run_date
    held, origin, stands = published_attempt(spark, cfg.audit_path, run_date)
    current = read_run(spark, cfg.output_base, cfg.audit_path, run_date, held).drop(RUN_DATE, ATTEMPT)
    return publish_frame(spark, current, replace(cfg, run_date=run_date, rebalance=True), log=log,
                         replaces=(origin, stands))
