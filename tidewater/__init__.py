"""tidewater: dependable CSV-to-Parquet runs on Spark.

Scan a directory of CSV files, keep the named columns, drop rows without a
value, publish Parquet per run date with verified counts; daily runs and
backfills, incremental ingest, a null-safe mirror, a run audit, job-log
metrics and SQL over the published runs.  DataFrame API only (works over
Spark Connect).
"""

from .config import BATCH_CONF, INTERACTIVE_CONF, JobConfig, date_range, redact, s3a_conf
from .operators.metrics import RunMetrics, require_non_empty
from .operators.mirror import check_keys, mirror_apply, mirror_diff
from .operators.transforms import drop_all_null, preview, project, schema_report
from .plans.audit import (
    latest_verified,
    read_audit,
    read_published,
    read_run,
    record_run,
    run_metrics,
    run_status,
)
from .plans.job import (
    RunResult,
    compact_run,
    publish_frame,
    run_job,
    run_with_retries,
)
from .plans.runs import register_runs, run_range
from .session import get_session, scratch_path, shared_root
from .sources.csv import scan_csv
from .sources.logs import parse_job_logs, read_run_logs
from .sources.parquet import read_attempt, read_runs, write_attempt, write_run
from .streaming.ingest import ingest_stream, read_ingested

__all__ = [
    "BATCH_CONF", "INTERACTIVE_CONF", "compact_run", "JobConfig", "RunMetrics", "RunResult", "check_keys",
    "date_range", "drop_all_null", "get_session", "ingest_stream", "latest_verified",
    "mirror_apply", "mirror_diff", "parse_job_logs", "preview", "project", "read_attempt",
    "read_audit", "read_ingested", "read_published", "read_run_logs", "read_runs",
    "publish_frame", "record_run", "redact", "register_runs", "require_non_empty", "run_job",
    "run_range", "run_with_retries", "run_status", "s3a_conf", "scan_csv",
    "schema_report",
    "scratch_path", "shared_root", "write_attempt", "write_run", "read_run", "run_metrics",
]
