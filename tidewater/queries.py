"""Registered queries (one per operator of the build; SQL oracles in
:mod:`tidewater.oracles`).

Each query takes ``(spark, sf_dir)``, derives the job's input from the test
tables with Spark (whole tables), runs the operator and returns a DataFrame.
Runs write below the session's shared folder (``spark.checkpoint.dir``), a
fresh folder per call.  The oracle SQL computes the same result directly from
the tables (DuckDB dialect, tables registered as views).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import JobConfig, date_range
from .operators.digests import mirror_diff_by_digest
from .operators.mirror import change_counts, mirror_apply, mirror_diff
from .operators.transforms import drop_all_null, preview, project, schema_report
from .plans import inputs
from .plans.audit import (
    read_all_attempts,
    read_audit,
    read_overwritten,
    read_published,
    run_status,
    schema_history,
)
from .plans.catalog import register_catalog
from .plans.filesync import compact_synced, read_synced, sync_files
from .plans.job import compact_run, publish_frame, run_job
from .plans.retention import retention_plan
from .plans.runs import register_runs, run_range
from .session import scratch_path
from .sources.csv import scan_csv
from .sources.headers import scan_by_header
from .sources.logs import read_run_logs
from .sources.parquet import RUN_DATE, read_attempt, read_overwrite_runs, read_runs
from .streaming.ingest import batch_status, ingest_stream, read_ingested, read_verified

COLS = ["price", "seller", "status"]
LINEITEM_CSV_DDL = (
    "order_key INT, line_number INT, quantity DOUBLE, price DOUBLE, seller INT, "
    "status STRING, return_flag STRING"
)
EVENT_COLS = ["user_id", "event_type", "value"]


def workspace(spark: SparkSession, name: str, input_uri: str | None = None, **kw) -> JobConfig:
    """A job configuration rooted in a fresh folder under the shared folder."""
    return JobConfig(base_uri=scratch_path(spark, "runs", name), input_uri=input_uri,
                     run_date=kw.pop("run_date", "20240101"), **kw)


def _quiet(_line: str) -> None:
    pass


# -- A1 / A2 / A3 / A5 ---------------------------------------------------------

def q_csv_scan_infer(spark, sf_dir):
    return scan_csv(spark, inputs.lineitem_csv(spark, sf_dir))


def q_project_three(spark, sf_dir):
    return project(scan_csv(spark, inputs.lineitem_csv(spark, sf_dir)), COLS)


def q_drop_all_null_nan(spark, sf_dir):
    raw = scan_csv(spark, inputs.lineitem_csv(spark, sf_dir, nan_prices=True))
    return drop_all_null(project(raw, COLS), COLS)


def q_schema_report(spark, sf_dir):
    return schema_report(spark, scan_csv(spark, inputs.lineitem_csv(spark, sf_dir)))


# -- flagship: A1-A3, A7-A9 ----------------------------------------------------

def _published_run(spark, sf_dir, name, keep_log=False):
    cfg = workspace(spark, name, inputs.lineitem_csv(spark, sf_dir))
    result = run_job(spark, cfg, log=_quiet, keep_log=keep_log)
    return cfg, result


def q_csv_to_parquet_run(spark, sf_dir):
    cfg, _ = _published_run(spark, sf_dir, "flagship")
    return read_published(spark, cfg.output_base, cfg.audit_path).select(*COLS)


def q_published_semi_join(spark, sf_dir):
    """A8/B4 through the lazy reader: a left-semi join with the size-checked,
    broadcast audit side and dynamic partition pruning."""
    cfg = _two_dates(spark, sf_dir, "semi")
    return (read_published(spark, cfg.output_base, cfg.audit_path, exact_paths=False)
            .filter(F.col(RUN_DATE) == "20240102").select(RUN_DATE, *COLS))


def q_published_schema(spark, sf_dir):
    """A5 on the output: the published Parquet keeps the inferred types."""
    cfg, _ = _published_run(spark, sf_dir, "schema")
    return schema_report(spark, read_published(spark, cfg.output_base, cfg.audit_path)
                         .select(*COLS))


def q_run_metrics(spark, sf_dir):
    cfg, result = _published_run(spark, sf_dir, "metrics")
    return (read_audit(spark, cfg.audit_path)
            .filter(F.col("attempt") == result.attempt)
            .select("input_rows", "output_rows", "written_rows", "status"))


def q_preview_rows(spark, sf_dir):
    cfg, result = _published_run(spark, sf_dir, "preview")
    out = read_attempt(spark, cfg.output_base, cfg.run_date, result.attempt).select(*COLS)
    order = [F.col(c).asc_nulls_first() for c in COLS]
    return preview(out, 10, order_by=order)


# -- A11, B4, B6 ---------------------------------------------------------------

def _two_dates(spark, sf_dir, name):
    cfg = workspace(spark, name, inputs.lineitem_csv(spark, sf_dir))
    for d in ("20240101", "20240102"):
        run_job(spark, cfg.with_date(d), log=_quiet)
    return cfg


def q_runs_union(spark, sf_dir):
    cfg = _two_dates(spark, sf_dir, "union")
    return (read_runs(spark, cfg.output_base)
            .groupBy(RUN_DATE)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count("price").alias("n_price"),
                 F.count("seller").alias("n_seller"),
                 F.count("status").alias("n_status")))


def q_runs_catalog_sql(spark, sf_dir):
    """B6 with catalog tables: SQL over the published view."""
    cfg = replace(_two_dates(spark, sf_dir, "catalog"),
                  catalog_table=f"runs_{uuid.uuid4().hex[:8]}")
    schema = scan_csv(spark, cfg.input_path).select(*COLS).schema
    names = register_catalog(spark, cfg, schema)
    return spark.sql(f"""
        SELECT run_date, count(*) AS n_rows, count(price) AS n_price,
               count(seller) AS n_seller, count(status) AS n_status
        FROM {names['published']} GROUP BY run_date""")


def q_runs_sql(spark, sf_dir):
    cfg = _two_dates(spark, sf_dir, "sql")
    views = register_runs(spark, cfg, name="published_runs")
    return spark.sql(f"""
        SELECT run_date,
               count(*) AS n_rows,
               count(price) AS n_price,
               count(DISTINCT seller) AS n_sellers,
               min(price) AS min_price,
               max(price) AS max_price,
               count(CASE WHEN status = 'F' THEN 1 END) AS n_status_f
        FROM {views['runs']}
        GROUP BY run_date""")


def _attempt_history(spark, sf_dir, name):
    """20240101: NaN input (VERIFIED), base input (VERIFIED), blanked input
    (EMPTY), in that order; 20240102: base input (VERIFIED)."""
    base = workspace(spark, name)
    plan = [
        ("20240101", inputs.lineitem_csv(spark, sf_dir, nan_prices=True)),
        ("20240101", inputs.lineitem_csv(spark, sf_dir)),
        ("20240101", inputs.blank_lineitem_csv(spark, sf_dir)),
        ("20240102", inputs.lineitem_csv(spark, sf_dir)),
    ]
    for run_date, path in plan:
        run_job(spark, replace(base, run_date=run_date, input_uri=path), log=_quiet,
                raise_on_failure=False)
    return base


def q_runs_all_attempts(spark, sf_dir):
    """A11 over an attempt history: every attempt's rows, superseded ones
    included, counted per date, with the number of attempts that hold rows
    (the EMPTY attempt holds none)."""
    cfg = _attempt_history(spark, sf_dir, "all-attempts")
    return (read_runs(spark, cfg.output_base)
            .groupBy(RUN_DATE)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.countDistinct("attempt").alias("n_attempts_with_rows")))


def q_latest_verified(spark, sf_dir):
    cfg = _attempt_history(spark, sf_dir, "latest")
    return (read_published(spark, cfg.output_base, cfg.audit_path)
            .filter(F.col(RUN_DATE) == "20240101")
            .select(RUN_DATE, *COLS))


def q_run_status(spark, sf_dir):
    cfg = _attempt_history(spark, sf_dir, "status")
    return run_status(spark, cfg.audit_path).select(
        RUN_DATE, "status", "input_rows", "output_rows", "written_rows")


def q_retention_plan(spark, sf_dir):
    """A7/B4: folders that may go once the attempt history is over and one date compacted."""
    cfg = _attempt_history(spark, sf_dir, "retention")
    compact_run(spark, cfg, "20240102", log=_quiet)
    plan = retention_plan(spark, cfg, horizon=0.0)
    held = read_audit(spark, cfg.audit_path).select(RUN_DATE, "attempt", "written_rows")
    return plan.filter(F.col("reason") == "SUPERSEDED").join(held, [RUN_DATE, "attempt"]).select(
        RUN_DATE, "reason", "written_rows")


# -- B1 --------------------------------------------------------------------------

def event_dates(spark, sf_dir, pad: int = 0) -> list[str]:
    """Every date from the first to the last event, widened by ``pad`` days on
    each side (one aggregate row)."""
    bounds = inputs.table(spark, sf_dir, "events").agg(
        F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi")).first()
    return date_range(bounds["lo"] - timedelta(days=pad), bounds["hi"] + timedelta(days=pad))


def q_daily_backfill(spark, sf_dir):
    """Dates from the day before the first event to the day after the last:
    the two outer dates have no rows and come back EMPTY."""
    csv = inputs.events_csv(spark, sf_dir)
    cfg = workspace(spark, "backfill", csv, columns=tuple(EVENT_COLS))
    status = run_range(spark, cfg, event_dates(spark, sf_dir, pad=1), date_col="ts", log=_quiet)
    return status.select(RUN_DATE, "status", "written_rows")


# -- B3 --------------------------------------------------------------------------

def mirror_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Target: ``customer`` with ``c_name`` null when c_custkey % 17 = 0.
    Source: the target with changes - rows with c_custkey % 10 = 3 removed,
    c_acctbal + 100 when % 7 = 0, c_mktsegment null when % 11 = 0, and a new
    row with key -(c_custkey + 1) for every c_custkey % 13 = 0."""
    cust = inputs.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    tgt = cust.withColumn("c_name", F.when(key % 17 == 0, F.lit(None)).otherwise(F.col("c_name")))
    kept = (tgt.filter(key % 10 != 3)
               .withColumn("c_acctbal", F.when(key % 7 == 0, F.col("c_acctbal") + 100)
                           .otherwise(F.col("c_acctbal")))
               .withColumn("c_mktsegment", F.when(key % 11 == 0, F.lit(None))
                           .otherwise(F.col("c_mktsegment"))))
    new = tgt.filter(key % 13 == 0).withColumn("c_custkey", -(key + 1))
    return kept.unionByName(new), tgt


def q_mirror_diff(spark, sf_dir):
    src, tgt = mirror_sides(spark, sf_dir)
    return mirror_diff(src, tgt, ["c_custkey"])


def q_mirror_apply(spark, sf_dir):
    src, tgt = mirror_sides(spark, sf_dir)
    return mirror_apply(src, tgt, ["c_custkey"], delete=True)


# -- B2 --------------------------------------------------------------------------

def q_ingest_stream(spark, sf_dir):
    csv = inputs.lineitem_csv(spark, sf_dir)
    work = scratch_path(spark, "ingest")
    ingest_stream(spark, csv, f"{work}/out", f"{work}/checkpoint", LINEITEM_CSV_DDL,
                  columns=COLS, name="lineitem", max_files_per_trigger=1)
    return read_ingested(spark, f"{work}/out", "lineitem",
                         "price DOUBLE, seller INT, status STRING").select(*COLS)


def q_ingest_batches(spark, sf_dir):
    """B2/B4: the batch ledger, summed over the batches (their number depends on the files)."""
    csv = inputs.unparsable_price_csv(spark, sf_dir)
    work = scratch_path(spark, "ingest-ledger")
    ingest_stream(spark, csv, f"{work}/out", f"{work}/checkpoint", LINEITEM_CSV_DDL, columns=COLS, name="ledger",
                  max_files_per_trigger=1)
    return batch_status(spark, f"{work}/out", "ledger").groupBy("status").agg(
        F.sum("input_rows").alias("input_rows"), F.sum("output_rows").alias("output_rows"),
        F.sum("written_rows").alias("written_rows"), F.sum("bad_rows").alias("bad_rows"))


def q_ingest_verified(spark, sf_dir):
    """B2: rows of verified batches; the second folder holds no value and its batches are EMPTY."""
    work = scratch_path(spark, "ingest-verified")
    rows = inputs.lineitem_job_rows(spark, sf_dir)
    inputs.write_csv_input(rows, f"{work}/raw/a")
    inputs.write_csv_input(rows.withColumns({c: F.lit(None).cast("string") for c in COLS}), f"{work}/raw/b")
    ingest_stream(spark, f"{work}/raw/*", f"{work}/out", f"{work}/checkpoint", LINEITEM_CSV_DDL, columns=COLS,
                  name="verified", max_files_per_trigger=1)
    return read_verified(spark, f"{work}/out", "verified", "price DOUBLE, seller INT, status STRING").select(*COLS)


# -- B5 --------------------------------------------------------------------------

def q_job_log_metrics(spark, sf_dir):
    cfg, _ = _published_run(spark, sf_dir, "logs", keep_log=True)
    return read_run_logs(spark, cfg.logs_path).select(RUN_DATE, "metric", "value")


# -- further modes of the same operators -----------------------------------------

def q_strict_scan(spark, sf_dir):
    """A1 strict mode: every file's header is checked against the schema."""
    return scan_csv(spark, inputs.lineitem_csv(spark, sf_dir), schema=LINEITEM_CSV_DDL,
                    strict=True, quarantine=False)


def q_csv_scan_declared(spark, sf_dir):
    """A1 with a declared schema: no inference pass, bad rows quarantined."""
    return scan_csv(spark, inputs.lineitem_csv(spark, sf_dir), schema=LINEITEM_CSV_DDL)


def q_overwrite_layout_run(spark, sf_dir):
    """A7/A8 parity layout: the run's folder replaced in place, read back."""
    cfg = workspace(spark, "overwrite", inputs.lineitem_csv(spark, sf_dir), layout="overwrite")
    run_job(spark, cfg, log=_quiet)
    return read_overwrite_runs(spark, cfg.output_base).select(RUN_DATE, *COLS)


def q_run_audit(spark, sf_dir):
    """B4: every attempt of the history, oldest first."""
    cfg = _attempt_history(spark, sf_dir, "audit")
    return read_audit(spark, cfg.audit_path).select(
        RUN_DATE, "status", "input_rows", "output_rows", "written_rows")


def q_backfill_published(spark, sf_dir):
    """B1 + A8: the rows a reader sees after a sliced backfill of ``events``."""
    csv = inputs.events_csv(spark, sf_dir)
    cfg = workspace(spark, "backfill-rows", csv, columns=tuple(EVENT_COLS))
    run_range(spark, cfg, event_dates(spark, sf_dir), date_col="ts", log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path).select(RUN_DATE, *EVENT_COLS)


def q_backfill_rebalanced(spark, sf_dir):
    """B1 with ``rebalance=True``: the same published rows, written through an
    AQE rebalance by run date."""
    csv = inputs.events_csv(spark, sf_dir)
    cfg = workspace(spark, "backfill-rebalanced", csv, columns=tuple(EVENT_COLS), rebalance=True)
    run_range(spark, cfg, event_dates(spark, sf_dir), date_col="ts", log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path).select(RUN_DATE, *EVENT_COLS)


def q_backfill_input_counts(spark, sf_dir):
    """B1 with ``per_date_input_counts``: exact per-date input counts observed
    in the same pass as the write."""
    csv = inputs.events_csv(spark, sf_dir)
    cfg = workspace(spark, "backfill-counts", csv, columns=tuple(EVENT_COLS),
                    per_date_input_counts=True)
    status = run_range(spark, cfg, event_dates(spark, sf_dir, pad=1), date_col="ts", log=_quiet)
    return status.select(RUN_DATE, "status", "input_rows", "output_rows", "written_rows")


def q_backfill_parity(spark, sf_dir):
    """B1 parity mode: every date gets the whole input, one job per date."""
    cfg = workspace(spark, "parity", inputs.lineitem_csv(spark, sf_dir))
    return run_range(spark, cfg, ["20240101", "20240102"], log=_quiet).select(
        RUN_DATE, "status", "input_rows", "output_rows", "written_rows")


def q_quarantined_rows(spark, sf_dir):
    """A1 quarantine: rows that do not parse under the declared schema are
    kept by the run (price null) and also written with their raw text."""
    cfg = workspace(spark, "quarantine", inputs.unparsable_price_csv(spark, sf_dir),
                    schema=LINEITEM_CSV_DDL)
    result = run_job(spark, cfg, log=_quiet)
    path = f"{cfg.quarantine_path}/{RUN_DATE}={cfg.run_date}/attempt={result.attempt}"
    return spark.read.parquet(path).select("order_key", "line_number")


def q_mirror_copy(spark, sf_dir):
    """B3 without delete: target-only rows are kept."""
    src, tgt = mirror_sides(spark, sf_dir)
    return mirror_apply(src, tgt, ["c_custkey"], delete=False)


def q_views_stay_current(spark, sf_dir):
    """B6: views registered before the second date is published and the first one compacted."""
    cfg = workspace(spark, "live-views", inputs.lineitem_csv(spark, sf_dir))
    run_job(spark, cfg.with_date("20240101"), log=_quiet)
    views = register_runs(spark, cfg, name=f"live_{uuid.uuid4().hex[:8]}")
    run_job(spark, replace(cfg, input_uri=inputs.whole_price_csv(spark, sf_dir)).with_date("20240102"), log=_quiet)
    compact_run(spark, cfg, "20240101", log=_quiet)
    return spark.sql(f"""
        SELECT r.run_date, count(*) AS n_rows, count(DISTINCT r.attempt) AS n_attempts,
               CAST(sum(CAST(r.price AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
               max(a.n) AS n_recorded, max(s.written_rows) AS written_rows
        FROM {views['runs']} r
        JOIN (SELECT run_date, count(*) AS n FROM {views['audit']} GROUP BY run_date) a ON a.run_date = r.run_date
        JOIN {views['status']} s ON s.run_date = r.run_date
        GROUP BY r.run_date""")


def q_compacted_run(spark, sf_dir):
    """A7 compaction: the published attempt rewritten as a new one."""
    cfg, _ = _published_run(spark, sf_dir, "compact")
    compact_run(spark, cfg, log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path).select(*COLS)


def q_mirror_changes(spark, sf_dir):
    """B3 summary: rows per kind of change."""
    src, tgt = mirror_sides(spark, sf_dir)
    return change_counts(mirror_diff(src, tgt, ["c_custkey"]))


def q_mirror_publish(spark, sf_dir):
    """B3 + publication: the mirrored table written as a verified attempt."""
    src, tgt = mirror_sides(spark, sf_dir)
    cfg = workspace(spark, "mirror")
    publish_frame(spark, mirror_apply(src, tgt, ["c_custkey"]), cfg, log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path).drop(RUN_DATE, "attempt")


# -- A1 by header ------------------------------------------------------------------------

def q_scan_by_header(spark, sf_dir):
    """A1 over files of three headers, types inferred: all columns by name."""
    return scan_by_header(spark, inputs.mixed_header_csv(spark, sf_dir), recursive=True)


def q_scan_by_header_declared(spark, sf_dir):
    """A1 over files of three headers with declared types: the named columns alone."""
    ddl = "price DOUBLE, seller INT, status STRING, line_number INT"
    return scan_by_header(spark, inputs.mixed_header_csv(spark, sf_dir), ddl, recursive=True, quarantine=False)


def q_run_by_header(spark, sf_dir):
    """A1-A9: the job over files of three headers."""
    cfg = workspace(spark, "by-header", inputs.mixed_header_csv(spark, sf_dir), recursive=True, by_header=True)
    run_job(spark, cfg, log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path).select(*COLS)


# -- B3 by digests --------------------------------------------------------------------------

def q_mirror_diff_digest(spark, sf_dir):
    """B3: the diff through digests of hashed buckets; equals ``mirror_diff``."""
    src, tgt = mirror_sides(spark, sf_dir)
    return mirror_diff_by_digest(src, tgt, ["c_custkey"])


def q_mirror_few_changes(spark, sf_dir):
    """B3: changes in a narrow range of order keys (one row in a hundred, at most), found
    through digests of key ranges; the changed rows alone."""
    tgt = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    hi = tgt.agg(F.max("o_orderkey")).first()[0]
    key = F.col("o_orderkey")
    near = key.between(hi // 2, hi // 2 + hi // 100)
    src = (tgt.filter(~(near & (key % 5 == 0)))
              .withColumn("o_totalprice", F.when(near & (key % 5 == 1), F.col("o_totalprice") + 1)
                          .otherwise(F.col("o_totalprice"))))
    return mirror_diff_by_digest(src, tgt, "o_orderkey", by="range", changes_only=True)


# -- B2 / B3 over changed and removed files ----------------------------------------------

def _followed_folder(spark, sf_dir, name):
    """``lineitem`` by order_key % 4 in folders 0, 1, 2 and a sync; then folder 1 with prices
    higher by 1, folder 2 without rows, folder 3 new, and a second sync."""
    rows = inputs.lineitem_job_rows(spark, sf_dir)
    part = F.col("order_key") % 4
    work = scratch_path(spark, name)
    for i in (0, 1, 2):
        inputs.write_csv_input(rows.filter(part == i), f"{work}/raw/{i}")
    sync_files(spark, f"{work}/raw", f"{work}/table", LINEITEM_CSV_DDL, recursive=True, glob="*.csv")
    inputs.write_csv_input(rows.filter(part == 1).withColumn("price", F.col("price") + 1), f"{work}/raw/1")
    inputs.write_csv_input(rows.limit(0), f"{work}/raw/2")
    inputs.write_csv_input(rows.filter(part == 3), f"{work}/raw/3")
    result = sync_files(spark, f"{work}/raw", f"{work}/table", LINEITEM_CSV_DDL, recursive=True, glob="*.csv")
    return f"{work}/table", result


def q_file_sync(spark, sf_dir):
    """B2/B3: the table after files changed, vanished and came."""
    base, _ = _followed_folder(spark, sf_dir, "filesync")
    return read_synced(spark, base).select(*COLS)


def q_file_sync_compacted(spark, sf_dir):
    """B2/B3: the same after a compaction, with what the last sync wrote and retracted."""
    base, result = _followed_folder(spark, sf_dir, "filesync-compacted")
    compact_synced(spark, base)
    return read_synced(spark, base).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("price").alias("n_price"),
        F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("sum_price"),
        F.lit(result.rows_written).cast("bigint").alias("rows_written"),
        F.lit(result.rows_retracted).cast("bigint").alias("rows_retracted"))


# -- A8 / A11 over changing schemas ---------------------------------------------------

def _drifting_runs(spark, sf_dir, name, **kw):
    """20240101: whole prices; 20240102: broken prices; 20240103: no ``status`` column."""
    base = workspace(spark, name, inputs.lineitem_csv(spark, sf_dir), **kw)
    run_job(spark, replace(base, input_uri=inputs.whole_price_csv(spark, sf_dir)).with_date("20240101"), log=_quiet)
    run_job(spark, base.with_date("20240102"), log=_quiet)
    run_job(spark, replace(base, columns=("price", "seller")).with_date("20240103"), log=_quiet)
    return base


def q_runs_changing_types(spark, sf_dir):
    """A8: the published rows of dates whose types and columns differ."""
    cfg = _drifting_runs(spark, sf_dir, "drift")
    return read_published(spark, cfg.output_base, cfg.audit_path).select(RUN_DATE, *COLS)


def q_attempts_changing_types(spark, sf_dir):
    """A11: all attempts, those of 20240102 superseded by a run over whole prices."""
    cfg = _drifting_runs(spark, sf_dir, "drift-all")
    run_job(spark, replace(cfg, input_uri=inputs.whole_price_csv(spark, sf_dir)).with_date("20240102"), log=_quiet)
    return (read_all_attempts(spark, cfg.output_base, cfg.audit_path).groupBy(RUN_DATE)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("attempt").alias("n_attempts"),
                 F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("sum_price"),
                 F.count("status").alias("n_status")))


def q_overwritten_changing_types(spark, sf_dir):
    """A11 in the parity layout over the same three dates."""
    cfg = _drifting_runs(spark, sf_dir, "drift-overwrite", layout="overwrite")
    return read_overwritten(spark, cfg.output_base, cfg.audit_path).select(RUN_DATE, *COLS)


def q_runs_conflicting_types(spark, sf_dir):
    """A8 where prices are numbers on one date and text on another: read as text on demand."""
    cfg = workspace(spark, "conflict", inputs.lineitem_csv(spark, sf_dir))
    run_job(spark, cfg.with_date("20240101"), log=_quiet)
    run_job(spark, replace(cfg, input_uri=inputs.unparsable_price_csv(spark, sf_dir)).with_date("20240102"), log=_quiet)
    return read_published(spark, cfg.output_base, cfg.audit_path, on_conflict="string").select(RUN_DATE, *COLS)


def q_schema_history(spark, sf_dir):
    """A5 over time: the types of each column, with the dates that have them."""
    cfg = _drifting_runs(spark, sf_dir, "drift-history")
    return schema_history(spark, cfg.audit_path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv_scan_infer": q_csv_scan_infer,
    "project_three": q_project_three,
    "csv_to_parquet_run": q_csv_to_parquet_run,
    "drop_all_null_nan": q_drop_all_null_nan,
    "run_metrics": q_run_metrics,
    "schema_report": q_schema_report,
    "published_schema": q_published_schema,
    "preview_rows": q_preview_rows,
    "runs_union": q_runs_union,
    "latest_verified": q_latest_verified,
    "runs_all_attempts": q_runs_all_attempts,
    "daily_backfill": q_daily_backfill,
    "run_status": q_run_status,
    "mirror_diff": q_mirror_diff,
    "mirror_apply": q_mirror_apply,
    "ingest_stream": q_ingest_stream,
    "job_log_metrics": q_job_log_metrics,
    "runs_sql": q_runs_sql,
    "runs_catalog_sql": q_runs_catalog_sql,
    "published_semi_join": q_published_semi_join,
    "strict_scan": q_strict_scan,
    "csv_scan_declared": q_csv_scan_declared,
    "overwrite_layout_run": q_overwrite_layout_run,
    "run_audit": q_run_audit,
    "backfill_published": q_backfill_published,
    "backfill_parity": q_backfill_parity,
    "backfill_rebalanced": q_backfill_rebalanced,
    "backfill_input_counts": q_backfill_input_counts,
    "quarantined_rows": q_quarantined_rows,
    "mirror_changes": q_mirror_changes,
    "mirror_copy": q_mirror_copy,
    "compacted_run": q_compacted_run,
    "mirror_publish": q_mirror_publish,
    "scan_by_header": q_scan_by_header,
    "scan_by_header_declared": q_scan_by_header_declared,
    "run_by_header": q_run_by_header,
    "mirror_diff_digest": q_mirror_diff_digest,
    "mirror_few_changes": q_mirror_few_changes,
    "ingest_batches": q_ingest_batches,
    "ingest_verified": q_ingest_verified,
    "views_stay_current": q_views_stay_current,
    "retention_plan": q_retention_plan,
    "file_sync": q_file_sync,
    "file_sync_compacted": q_file_sync_compacted,
    "runs_changing_types": q_runs_changing_types,
    "attempts_changing_types": q_attempts_changing_types,
    "overwritten_changing_types": q_overwritten_changing_types,
    "runs_conflicting_types": q_runs_conflicting_types,
    "schema_history": q_schema_history,
}
