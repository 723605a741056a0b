"""Run parameters (A10), object-store settings (A13) and runtime profiles (A14).

Everything here is plain configuration: it produces paths and ``spark.*``
settings, it never touches a session.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, datetime

# ---------------------------------------------------------------------------
# Environment variable names and defaults that a job launched by
# the existing scheduler sets, and the columns the job keeps.  They must stay as
# they are so that an existing deployment can switch to this library.
#   MINIO_ENDPOINT  (default: none)        object-store endpoint
#   MINIO_BUCKET    (default: data-pro)    bucket holding input and output
#   INPUT_PREFIX    (default: raw)         input directory in the bucket
#   OUTPUT_PREFIX   (default: processed)   output directory in the bucket
#   RUN_DATE        (default: 19700101)    run date, yyyymmdd
#   SPARK_CONNECT_URL                      remote session URL
#   kept columns: price, seller, status
# ---------------------------------------------------------------------------
ENV_ENDPOINT = "MINIO_ENDPOINT"
ENV_BUCKET = "MINIO_BUCKET"
ENV_INPUT_PREFIX = "INPUT_PREFIX"
ENV_OUTPUT_PREFIX = "OUTPUT_PREFIX"
ENV_RUN_DATE = "RUN_DATE"
ENV_CONNECT_URL = "SPARK_CONNECT_URL"
DEFAULT_BUCKET = "data-pro"
DEFAULT_INPUT_PREFIX = "raw"
DEFAULT_OUTPUT_PREFIX = "processed"
DEFAULT_RUN_DATE = "19700101"
DEFAULT_COLUMNS = ("price", "seller", "status")

# Our own additions (not in the original job): where the audit table and the
# job logs live, and the environment variable that overrides the storage root
# (any Hadoop URI, e.g. ``file:///data`` or ``hdfs://nn/warehouse``).
ENV_BASE_URI = "TIDEWATER_BASE_URI"
DEFAULT_AUDIT_PREFIX = "audit"
DEFAULT_LOGS_PREFIX = "logs"
DEFAULT_QUARANTINE_PREFIX = "quarantine"

_RUN_DATE_RE = re.compile(r"^\d{8}$")

LAYOUT_ATTEMPTS = "attempts"  # runs/run_date=D/attempt=A, published via the audit table
LAYOUT_OVERWRITE = "overwrite"  # processed/D/, replaced in place (parity with the original job)


def validate_run_date(value: str) -> str:
    """Return ``value`` if it is a real calendar date written ``yyyymmdd``."""
    text = str(value)
    if not _RUN_DATE_RE.match(text):
        raise ValueError(f"run_date must be yyyymmdd, got {value!r}")
    datetime.strptime(text, "%Y%m%d")  # raises on 20240230 and the like
    return text


def date_range(start: str | date, end: str | date) -> list[str]:
    """Inclusive list of ``yyyymmdd`` strings from ``start`` to ``end``."""
    from datetime import timedelta

    def as_date(d):
        if isinstance(d, date):
            return d
        return datetime.strptime(validate_run_date(d), "%Y%m%d").date()

    first, last = as_date(start), as_date(end)
    if last < first:
        raise ValueError(f"empty date range {start}..{end}")
    return [(first + timedelta(days=i)).strftime("%Y%m%d") for i in range((last - first).days + 1)]


@dataclass(frozen=True)
class JobConfig:
    """Parameters of one run of the CSV-to-Parquet job.

    ``root`` is the storage root; by default ``s3a://{bucket}``.  The input is
    every CSV file in ``{root}/{input_prefix}/`` (or ``input_uri``).  Output
    goes below ``{root}/{output_prefix}``: ``run_date=D/attempt=A/`` in the
    attempts layout, ``D/`` in the overwrite layout.  The audit table, kept
    logs and quarantined rows live beside it under their own prefixes.
    """

    bucket: str = DEFAULT_BUCKET
    input_prefix: str = DEFAULT_INPUT_PREFIX
    output_prefix: str = DEFAULT_OUTPUT_PREFIX
    run_date: str = DEFAULT_RUN_DATE
    endpoint: str | None = None
    base_uri: str | None = None
    # Input folder given directly (any Hadoop URI); overrides root/input_prefix.
    input_uri: str | None = None
    audit_prefix: str = DEFAULT_AUDIT_PREFIX
    logs_prefix: str = DEFAULT_LOGS_PREFIX
    quarantine_prefix: str = DEFAULT_QUARANTINE_PREFIX
    columns: tuple[str, ...] = DEFAULT_COLUMNS
    # Declared input schema (DDL string or StructType).  None: infer per run.
    schema: object | None = None
    # Fail when a file's header does not match the schema instead of mapping
    # columns by position.
    strict: bool = False
    recursive: bool = False
    # Map each file's columns by its own header; files may order them differently,
    # lack some (null) or have more.  One more pass over the lines of the input.
    by_header: bool = False
    # Catalog table over the runs (see plans/catalog.py); new attempts are
    # added as partitions when set.
    catalog_table: str | None = None
    # Fail a run whose kept columns' types differ from the latest published
    # attempt (inferred types can drift from day to day).
    check_drift: bool = False
    # Further CSV reader options, e.g. {"sep": ";", "encoding": "latin1"}.
    csv_options: Mapping[str, str] = field(default_factory=dict)
    layout: str = LAYOUT_ATTEMPTS
    # Shuffle the (projected) output into files of the advisory size before
    # writing (AQE rebalance; by run date in backfills, hot dates split).
    # Off: one file per input split, no shuffle.
    rebalance: bool = False
    # Sliced backfills: count input rows per requested date in the same pass
    # (one count_if per date on every row - worth it for short ranges).
    per_date_input_counts: bool = False
    # Seconds an attempt may take (see plans/leases.py); None: no limit, no lease.
    time_limit: float | None = None
    # Renew the lease every so many seconds while the driver lives: then only a
    # killed driver times out, not a slow run.
    renew_lease_every: float | None = None
    # The session runs nothing else: at the end of the lease all of it may be interrupted.
    own_session: bool = False
    # Cap on rows per output file (no shuffle); None: no cap.
    max_records_per_file: int | None = None
    # Rows to print from the input and the output, like ``show(n)``; 0 = none.
    preview_input: int = 0
    preview_output: int = 0

    def __post_init__(self):
        validate_run_date(self.run_date)
        if self.layout not in (LAYOUT_ATTEMPTS, LAYOUT_OVERWRITE):
            raise ValueError(f"unknown layout {self.layout!r}")
        if not self.columns:
            raise ValueError("columns must not be empty")
        object.__setattr__(self, "columns", tuple(self.columns))

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **overrides) -> "JobConfig":
        """Parameters from the environment variables above; ``overrides`` win."""
        env = os.environ if env is None else env
        values = dict(
            bucket=env.get(ENV_BUCKET, DEFAULT_BUCKET),
            input_prefix=env.get(ENV_INPUT_PREFIX, DEFAULT_INPUT_PREFIX),
            output_prefix=env.get(ENV_OUTPUT_PREFIX, DEFAULT_OUTPUT_PREFIX),
            run_date=env.get(ENV_RUN_DATE, DEFAULT_RUN_DATE),
            endpoint=env.get(ENV_ENDPOINT) or None,
            base_uri=env.get(ENV_BASE_URI) or None,
        )
        values.update(overrides)
        return cls(**values)

    def with_date(self, run_date: str) -> "JobConfig":
        """The same configuration for another run date."""
        return replace(self, run_date=validate_run_date(run_date))

    # -- paths ------------------------------------------------------------
    @property
    def root(self) -> str:
        return (self.base_uri or f"s3a://{self.bucket}").rstrip("/")

    @property
    def input_path(self) -> str:
        if self.input_uri:
            return self.input_uri.rstrip("/") + "/"
        return f"{self.root}/{self.input_prefix.strip('/')}/"

    @property
    def output_base(self) -> str:
        return f"{self.root}/{self.output_prefix.strip('/')}"

    @property
    def output_path(self) -> str:
        """Directory of this run in the in-place (overwrite) layout."""
        return f"{self.output_base}/{self.run_date}/"

    @property
    def audit_path(self) -> str:
        return f"{self.root}/{self.audit_prefix.strip('/')}"

    @property
    def leases_path(self) -> str:
        return f"{self.audit_path}-leases"

    @property
    def quarantine_path(self) -> str:
        return f"{self.root}/{self.quarantine_prefix.strip('/')}"

    @property
    def logs_path(self) -> str:
        return f"{self.root}/{self.logs_prefix.strip('/')}"

    def attempt_path(self, attempt: str, run_date: str | None = None) -> str:
        """Directory of one attempt in the attempts layout."""
        return f"{self.output_base}/run_date={run_date or self.run_date}/attempt={attempt}"


# ---------------------------------------------------------------------------
# A13 object-store access
# ---------------------------------------------------------------------------
S3A_PREFIX = "spark.hadoop.fs.s3a."
ENV_ACCESS_KEY = "AWS_ACCESS_KEY_ID"
ENV_SECRET_KEY = "AWS_SECRET_ACCESS_KEY"
_SECRET_HINTS = ("secret", "access.key", "session.token", "password")


def s3a_conf(
    endpoint: str | None,
    *,
    path_style: bool = True,
    ssl: bool | None = None,
    env: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Settings for an S3-compatible store reached through the S3A connector.

    Keys are taken from the environment only (``AWS_ACCESS_KEY_ID`` /
    ``AWS_SECRET_ACCESS_KEY``); when they are absent the connector's default
    credential chain is used.  Use :func:`redact` before logging the result.
    """
    env = os.environ if env is None else env
    conf = {
        S3A_PREFIX + "impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
        S3A_PREFIX + "path.style.access": str(path_style).lower(),
    }
    if endpoint:
        conf[S3A_PREFIX + "endpoint"] = endpoint
        if ssl is None:
            ssl = not endpoint.lower().startswith("http://")
    if ssl is not None:
        conf[S3A_PREFIX + "connection.ssl.enabled"] = str(ssl).lower()
    access, secret = env.get(ENV_ACCESS_KEY), env.get(ENV_SECRET_KEY)
    if access and secret:
        conf[S3A_PREFIX + "aws.credentials.provider"] = (
            "org.apache.hadoop.fs.s3a.SimpleAWSCredentialsProvider"
        )
        conf[S3A_PREFIX + "access.key"] = access
        conf[S3A_PREFIX + "secret.key"] = secret
    return conf


def redact(conf: Mapping[str, str]) -> dict[str, str]:
    """Copy of ``conf`` with every credential value replaced by ``***``."""
    return {
        k: ("***" if any(h in k.lower() for h in _SECRET_HINTS) else v) for k, v in conf.items()
    }


# ---------------------------------------------------------------------------
# A14 runtime profiles
# ---------------------------------------------------------------------------
# Batch: adaptive execution decides the shuffle width at run time (coalescing
# small partitions, splitting skewed ones), so the initial width is generous
# rather than the tiny fixed value of the original deployment.
BATCH_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.eventLog.enabled": "false",
}

# Interactive (remote) sessions: Kryo, a large result limit for notebooks and
# 32 MiB Parquet row groups.
INTERACTIVE_CONF: dict[str, str] = {
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.driver.maxResultSize": "4g",
    "spark.hadoop.parquet.block.size": str(32 * 1024 * 1024),
    "spark.sql.adaptive.enabled": "true",
}
