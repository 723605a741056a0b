"""B1 daily runs and backfills, B6 SQL over the published runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import LAYOUT_OVERWRITE, JobConfig, validate_run_date
from ..functions.columns import yyyymmdd
from ..functions.logformat import format_input_count, format_output_count
from ..operators.metrics import (
    STATUS_EMPTY,
    STATUS_FAILED,
    STATUS_MISMATCH,
    STATUS_TIMED_OUT,
    STATUS_VERIFIED,
    RunTimeoutError,
)
from ..sources.csv import CORRUPT_COLUMN, scan_csv
from ..sources.parquet import (
    ATTEMPT,
    RUN_DATE,
    count_attempt_by_date,
    new_attempt_id,
    write_attempt_by_date,
)
from ..sources.schemas import schema_text
from .audit import (
    read_attempt_audit,
    run_status,
    write_audit,
)
from .job import _lease, _now, _refresh, build_output, require_catalog, require_new_attempt, run_job


def _dates(dates: Sequence[str]) -> list[str]:
    out = sorted({validate_run_date(d) for d in dates})
    if not out:
        raise ValueError("no run dates given")
    return out


def run_range(
    spark: SparkSession,
    cfg: JobConfig,
    dates: Sequence[str],
    date_col: str | None = None,
    *,
    attempt: str | None = None,
    log: Callable[[str], None] | None = print,
) -> DataFrame:
    """Run the job for every date in ``dates``; return one status row per date.

    * ``date_col`` given (sliced mode): one job for all dates.  Each input row
      goes to the date of its ``date_col``; rows outside ``dates`` are not
      read further.  Rows whose ``date_col`` is null or did not parse belong to
      no date: they count as input, are logged as undated and written to the
      quarantine.  One write creates every ``run_date=D/attempt=A`` folder, one
      aggregated read-back counts them, and the counts are joined to the list
      of dates so that a date without rows is EMPTY.  Other dates are not
      touched; the result equals running the dates one at a time.
    * ``date_col`` None (parity mode): the original job has no date in its
      input, so each date gets the whole input: one job reads it once and writes every
      row to every date's folder.  In the overwrite layout, one job per date.

    Re-running a date adds a new attempt; the latest verified one is published.
    Dates without rows are EMPTY (no error); an exception is recorded as
    FAILED for every date of the attempt and then raised (in parity mode it only shows
    in the status, as when the dates run one by one).  In sliced mode the
    audit rows are per date: ``written_rows`` is the date's read-back count,
    ``output_rows`` equals it when the attempt's produced and written totals
    agree (null on MISMATCH), and ``input_rows`` is null unless
    ``cfg.per_date_input_counts`` asks for it (one ``count_if`` per requested
    date, observed in the same pass).  The attempt's totals are in its log
    lines.
    """
    dates = _dates(dates)
    whole = date_col is None
    if cfg.layout == LAYOUT_OVERWRITE:
        if not whole:
            raise ValueError("sliced runs use the attempts layout")
        for d in dates:
            run_job(spark, cfg.with_date(d), log=log, raise_on_failure=False)
        return run_status(spark, cfg.audit_path).filter(F.col(RUN_DATE).isin(dates))
    copies = len(dates) if whole else 1  # times that a row of the input goes through the job

    started = _now()
    require_new_attempt(spark, cfg, attempt)
    attempt = attempt or new_attempt_id()
    undated = 0
    kept = None
    failure: BaseException | None = None
    dates_df = spark.createDataFrame([(d,) for d in dates], f"{RUN_DATE} STRING")
    guard, lease = ExitStack(), None
    try:
        if cfg.time_limit:
            lease = guard.enter_context(_lease(spark, cfg, attempt, dates))
        raw = scan_csv(spark, cfg.input_path, schema=cfg.schema, strict=cfg.strict,
                       recursive=cfg.recursive, options=cfg.csv_options, by_header=cfg.by_header)
        if cfg.catalog_table:
            require_catalog(spark, cfg)
        dated = (raw.withColumn(RUN_DATE, F.explode(F.array(*[F.lit(d) for d in dates]))) if whole
                 else dated_rows(raw, date_col, dates))
        no_date = F.count_if(F.col(RUN_DATE).isNull()).alias("undated")
        per_date_in = ([F.count_if(F.col(RUN_DATE) == F.lit(d)).alias(f"in_{i}")
                        for i, d in enumerate(dates)] if cfg.per_date_input_counts and not whole else [])
        out, in_obs, out_obs = build_output(dated, cfg.columns, attempt, carry=[RUN_DATE],
                                            rebalance=[RUN_DATE] if cfg.rebalance else None,
                                            observe_values=RUN_DATE, input_metrics=[no_date, *per_date_in],
                                            keep=F.col(RUN_DATE).isNotNull())
        kept = schema_text(out.drop(RUN_DATE).schema)
        write_attempt_by_date(out, cfg.output_base, attempt,
                              max_records_per_file=cfg.max_records_per_file)
        in_metrics, out_metrics = in_obs.get, out_obs.get
        input_rows, output_rows = in_metrics["rows"], out_metrics["rows"]
        # dates that received rows (at most the requested ones)
        written_dates = sorted(out_metrics["values"] or [])
        undated = in_metrics["undated"]
        if in_metrics.get("bad") or undated:
            # rows of which a kept column or the date did not parse (with their raw
            # text), or without a date; a second scan, run only when there are any
            faulty = F.col(RUN_DATE).isNull()
            cols = [*dict.fromkeys([*cfg.columns, *([] if whole else [date_col])]), RUN_DATE]
            if CORRUPT_COLUMN in dated.columns:
                cols.append(CORRUPT_COLUMN)
                faulty = faulty | F.col(CORRUPT_COLUMN).isNotNull()
            (dated.select(*cols).filter(faulty)
                  .write.mode("overwrite")
                  .parquet(f"{cfg.quarantine_path}/{ATTEMPT}={attempt}"))
        data_schema = out.drop(RUN_DATE).schema
        written = count_attempt_by_date(spark, cfg.output_base, attempt, data_schema,
                                        dates=written_dates)
        # counted here, where a failure is audited
        # bounded: at most one row per requested date (the attempt holds nothing else)
        written = spark.createDataFrame([tuple(r) for r in written.collect()], written.schema)
        total = written.agg(F.coalesce(F.sum("written_rows"), F.lit(0)).alias("_total"))  # one row
        per_date = dates_df.join(written, RUN_DATE, "left").fillna(0, ["written_rows"]).crossJoin(total)
        matched = F.col("_total") == F.lit(output_rows)
        status = (F.when(~matched, F.lit(STATUS_MISMATCH))
                   .when(F.col("written_rows") == 0, F.lit(STATUS_EMPTY))
                   .otherwise(F.lit(STATUS_VERIFIED)))
        # per date: what was produced equals what was written when the totals
        # agree; unknown otherwise
        produced = F.when(matched, F.col("written_rows"))
        if whole:
            consumed = F.lit(input_rows // copies)
        elif cfg.per_date_input_counts:
            # one literal per requested date: bounded by the request
            pairs = [x for i, d in enumerate(dates)
                     for x in (F.lit(d), F.lit(in_metrics[f"in_{i}"]))]
            consumed = F.element_at(F.create_map(*pairs), F.col(RUN_DATE))
        else:
            consumed = F.lit(None)
        error = F.lit(None).cast("string")
        if lease is not None and lease.expired():
            raise RunTimeoutError(f"the run took longer than {cfg.time_limit:g} s")
    except Exception as exc:
        late = lease is not None and lease.expired()
        if late and not isinstance(exc, RunTimeoutError):
            exc = RunTimeoutError(f"the run took longer than {cfg.time_limit:g} s ({type(exc).__name__}: {exc})")
        input_rows = output_rows = None
        per_date = dates_df.withColumn("written_rows", F.lit(None).cast("bigint"))
        status = F.lit(STATUS_TIMED_OUT if late else STATUS_FAILED)
        produced = consumed = F.lit(None)
        error = F.lit(f"{type(exc).__name__}: {exc}")
        failure = exc
        if log:
            log(f"Status: {STATUS_TIMED_OUT if late else STATUS_FAILED} {exc}")
    finally:
        guard.close()
    finished = _now()
    if lease is not None:  # once more when the row is written
        status = F.when(F.unix_micros(F.current_timestamp()) > F.lit(lease.expires),
                        F.lit(STATUS_TIMED_OUT)).otherwise(status)
    audit = per_date.select(
        RUN_DATE,
        F.lit(attempt).alias(ATTEMPT),
        status.alias("status"),
        consumed.cast("bigint").alias("input_rows"),
        produced.cast("bigint").alias("output_rows"),
        F.col("written_rows").cast("bigint").alias("written_rows"),
        F.lit(started).cast("timestamp").alias("started"),
        F.lit(finished).cast("timestamp").alias("finished"),
        error.alias("error"),
        F.lit(kept).cast("string").alias("schema"),
    )
    write_audit(audit, cfg.audit_path, attempt)
    if failure is not None and not whole:
        raise failure
    if log and input_rows is not None:
        log(f"Dates: {len(dates)} requested, {len(written_dates)} with rows")
        log(format_input_count(input_rows // copies))
        if undated:
            log(f"Undated rows : {undated} in {cfg.quarantine_path}/{ATTEMPT}={attempt}")
        log(format_output_count(output_rows))
    result = read_attempt_audit(spark, cfg.audit_path, attempt)
    _refresh(spark, cfg, dates, log)
    if cfg.catalog_table:
        from .catalog import add_attempts
        # the read-back is the authority for which folders hold rows
        written_dates = [r[RUN_DATE] for r in result.filter(F.col("written_rows") > 0)
                         .select(RUN_DATE).collect()]  # bounded: one row per requested date
        try:  # readers go by the audit; register_catalog adds what a failure here left out
            add_attempts(spark, cfg, written_dates, attempt)
        except Exception as exc:
            if log:
                log(f"Catalog not updated: {type(exc).__name__}: {exc}")
    return result


def dated_rows(raw: DataFrame, date_col: str, dates: list[str]) -> DataFrame:
    """Rows of the requested dates with their ``run_date``, and rows without a usable date
    with a null one.  The range on the raw column reaches the scan."""
    near = raw.filter(_date_bounds(raw, date_col, dates) | F.col(date_col).isNull())
    at = F.col(date_col)
    if isinstance(raw.schema[date_col].dataType, StringType):
        at = at.try_cast("timestamp")  # text that is no date has none
    dated = near.withColumn(RUN_DATE, yyyymmdd(at))
    return dated.filter(F.col(RUN_DATE).isin(dates) | F.col(RUN_DATE).isNull())


def _date_bounds(df: DataFrame, date_col: str, dates: list[str]):
    """Range predicate on the raw date column (pushable to the scan) around
    the requested dates; the exact per-date filter follows it."""
    dtype = df.schema[date_col].dataType.typeName()
    if dtype not in ("date", "timestamp", "timestamp_ntz"):
        return F.lit(True)
    lo = F.to_date(F.lit(dates[0]), "yyyyMMdd")
    hi = F.date_add(F.to_date(F.lit(dates[-1]), "yyyyMMdd"), 1)
    col = F.col(date_col)
    if dtype != "date":
        lo, hi = lo.cast(dtype), hi.cast(dtype)
    return (col >= lo) & (col < hi)


def register_runs(spark: SparkSession, cfg: JobConfig, name: str = "runs",
                  schema=None) -> dict[str, str]:
    """B6: temp views for SQL: ``runs`` (published rows), ``run_audit`` (every
    attempt) and ``run_status`` (latest attempt per date).  They see what this session
    publishes afterwards (see :func:`tidewater.plans.catalog.register_views`)."""
    from .catalog import register_views

    return register_views(spark, cfg, name, schema)
