"""B6 (optional part): catalog tables over the runs and the audit.

With a metastore these tables outlive the session; with the default
in-session catalog they behave the same for the session's lifetime.

* ``{name}``: external Parquet table over the runs, partitioned by
  ``run_date, attempt`` (every attempt);
* ``{name}_audit``: external table over the audit folders;
* ``{name}_published``: a view with the latest verified attempt per date
  (a left-semi join on the partition columns, so readers get partition
  pruning).

:func:`register_views` makes session views that stay current: their table has one
partition per date whose location is the published attempt's folder, and
publication moves that pointer.

New attempts are added with ``ADD PARTITION`` - one catalog call, no listing
of the table - by :func:`add_attempt`; ``run_job`` and ``run_range`` do it
when ``JobConfig.catalog_table`` is set.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StructType,
    TimestampNTZType,
)

from ..config import JobConfig
from ..sources.parquet import ATTEMPT, RUN_DATE, attempt_path
from ..sources.schemas import schema_from_text, schema_text, unify
from .audit import AUDIT_COLUMNS, AUDIT_DDL, latest_verified, read_published


#: Order of a date's attempts, as in :func:`tidewater.plans.audit.latest_verified`.
_ORDER = f"struct(coalesce(as_of, finished), coalesce(replaces, {ATTEMPT}), finished, {ATTEMPT})"


def _add_audit_columns(spark: SparkSession, table: str) -> None:
    """Columns that an audit table created by an earlier version lacks."""
    have = {c.lower() for c in spark.table(table).columns}
    new = [c for c in AUDIT_DDL.split(", ") if c.split(" ")[0] not in have]
    if new:
        spark.sql(f"ALTER TABLE {_ident(table)} ADD COLUMNS ({', '.join(new)})")


def _ident(name: str) -> str:
    parts = name.split(".")
    if not all(p and p.replace("_", "").isalnum() for p in parts):
        raise ValueError(f"bad table name {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _columns(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields
                     if f.name not in (RUN_DATE, ATTEMPT))


def register_catalog(spark: SparkSession, cfg: JobConfig, schema: StructType,
                     name: str | None = None) -> dict[str, str]:
    """Create (if missing) the runs and audit tables and the published view.

    ``schema`` is the data schema of the runs (the kept columns).  Existing
    attempt folders are registered once with ``RECOVER PARTITIONS``.
    """
    name = name or cfg.catalog_table or "runs"
    runs, audit, published = _ident(name), _ident(f"{name}_audit"), _ident(f"{name}_published")
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {runs} ({_columns(schema)},
                  {RUN_DATE} STRING, {ATTEMPT} STRING) USING parquet
                  PARTITIONED BY ({RUN_DATE}, {ATTEMPT}) LOCATION {_literal(cfg.output_base)}""")
    try:
        spark.sql(f"ALTER TABLE {runs} RECOVER PARTITIONS")
    except Exception as exc:  # no run written yet: nothing to recover
        if "does not exist" not in str(exc) and "PATH_NOT_FOUND" not in str(exc):
            raise
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {audit} ({AUDIT_DDL}) USING parquet
                  OPTIONS (recursiveFileLookup 'true') LOCATION {_literal(cfg.audit_path)}""")
    _add_audit_columns(spark, f"{name}_audit")
    spark.sql(f"REFRESH TABLE {audit}")
    spark.sql(f"""CREATE OR REPLACE VIEW {published} AS
                  SELECT r.* FROM {runs} r LEFT SEMI JOIN (
                      SELECT {RUN_DATE}, max_by({ATTEMPT}, {_ORDER}) AS {ATTEMPT}
                      FROM {audit} WHERE status = 'VERIFIED' GROUP BY {RUN_DATE}) v
                  ON r.{RUN_DATE} = v.{RUN_DATE} AND r.{ATTEMPT} = v.{ATTEMPT}""")
    return {"runs": name, "audit": f"{name}_audit", "published": f"{name}_published"}


def add_attempt(spark: SparkSession, cfg: JobConfig, run_date: str, attempt: str,
                name: str | None = None) -> None:
    """Register one attempt folder as a partition and refresh the audit table."""
    add_attempts(spark, cfg, [run_date], attempt, name)


def add_attempts(spark: SparkSession, cfg: JobConfig, run_dates: list[str], attempt: str,
                 name: str | None = None) -> None:
    """Register the folders of one attempt (one per date) in a single
    ``ADD PARTITION`` statement and refresh the audit table."""
    name = name or cfg.catalog_table
    runs, audit = _ident(name), _ident(f"{name}_audit")
    if run_dates:
        specs = " ".join(
            f"PARTITION ({RUN_DATE} = {_literal(d)}, {ATTEMPT} = {_literal(attempt)}) "
            f"LOCATION {_literal(attempt_path(cfg.output_base, d, attempt))}"
            for d in run_dates)
        spark.sql(f"ALTER TABLE {runs} ADD IF NOT EXISTS {specs}")
    spark.sql(f"REFRESH TABLE {audit}")


# -- session views that stay current -------------------------------------------------------

def _registry(cfg: JobConfig) -> str:
    """Session setting that lists the views over a run table."""
    return "tidewater.views." + hashlib.md5(cfg.audit_path.encode()).hexdigest()


def _pointers(name: str) -> str:
    return f"{name}_pointers"


def _log(name: str) -> str:
    return f"{name}_log"


def register_views(spark: SparkSession, cfg: JobConfig, name: str = "runs",
                   schema: StructType | None = None) -> dict[str, str]:
    """Temp views ``{name}`` (published rows with ``run_date`` and ``attempt``), ``{name}_audit``
    (every attempt) and ``{name}_status`` (latest attempt per date).

    The views name two external tables, resolved anew by each query: ``{name}_pointers`` with
    one partition per date at the published attempt's folder, and ``{name}_log`` over the audit.
    ``run_job``, ``run_range``, ``publish_frame`` and ``compact_run`` of this session move the
    pointers of the dates they publish (:func:`refresh_views` does it for what other sessions
    published).  A query lists the folders of the dates it asks for, nothing else.

    Where published types differ in ways that one Parquet scan cannot read, ``{name}`` is a view
    over :func:`tidewater.plans.audit.read_published` instead, made anew by each publication."""
    names = {"runs": name, "audit": f"{name}_audit", "status": f"{name}_status"}
    for n in names.values():
        _ident(n)
    log = _ident(_log(name))
    spark.sql(f"DROP TABLE IF EXISTS {log}")
    spark.sql(f"""CREATE TABLE {log} ({AUDIT_DDL}) USING parquet
                  OPTIONS (recursiveFileLookup 'true') LOCATION {_literal(cfg.audit_path)}""")
    columns = ", ".join(AUDIT_COLUMNS)
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {_ident(names['audit'])} AS SELECT {columns} FROM {log}")
    spark.sql(f"""CREATE OR REPLACE TEMP VIEW {_ident(names['status'])} AS
                  SELECT last.* FROM (SELECT max_by(struct({columns}), {_ORDER}) AS last FROM {log} GROUP BY {RUN_DATE})""")
    spark.sql(f"DROP TABLE IF EXISTS {_ident(_pointers(name))}")
    held = [n for n in (spark.conf.get(_registry(cfg), "") or "").split(",") if n and n != name]
    spark.conf.set(_registry(cfg), ",".join([*held, name]))
    spark.conf.set(f"{_registry(cfg)}.{name}", schema_text(schema) if schema is not None else "")
    _point(spark, cfg, name, None)
    return names


def refresh_views(spark: SparkSession, cfg: JobConfig, dates: list[str] | None = None) -> None:
    """Bring the session's views over these runs up to date, for ``dates`` or for all."""
    for name in filter(None, (spark.conf.get(_registry(cfg), "") or "").split(",")):
        spark.sql(f"REFRESH TABLE {_ident(_log(name))}")
        _point(spark, cfg, name, dates)


def _one_scan(have: StructType, want: StructType) -> bool:
    """Whether the Parquet reader gives ``want`` for files of ``have``."""
    types = {f.name.lower(): f.dataType for f in want.fields}
    return all(f.dataType == types[f.name.lower()] or _widens(f.dataType, types[f.name.lower()]) for f in have.fields)


def _widens(a, b) -> bool:
    """Widenings that Spark's Parquet reader does itself."""
    digits = {ByteType: 10, ShortType: 10, IntegerType: 10, LongType: 20}.get(type(a))
    if digits and isinstance(b, DecimalType):
        return b.precision - b.scale >= digits
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        return b.scale >= a.scale and b.precision - b.scale >= a.precision - a.scale
    wider = {ByteType: (ShortType, IntegerType, LongType, DoubleType), ShortType: (IntegerType, LongType, DoubleType),
             IntegerType: (LongType, DoubleType), FloatType: (DoubleType,), DateType: (TimestampNTZType,)}
    return isinstance(b, wider.get(type(a), ()))


def _point(spark: SparkSession, cfg: JobConfig, name: str, dates: list[str] | None) -> None:
    """Move the pointers of ``dates`` (None: all) to the published attempts."""
    given = spark.conf.get(f"{_registry(cfg)}.{name}", "")
    schema = schema_from_text(given) if given else None
    published = latest_verified(spark, cfg.audit_path, schemas=True)
    kinds = published.filter(F.col("schema").isNotNull()).select("schema").distinct().collect()  # bounded: schemas
    old = published.filter(F.col("schema").isNull())
    table, own = _ident(_pointers(name)), [schema_from_text(r["schema"]) for r in kinds]
    exists = spark.catalog.tableExists(_pointers(name))
    if schema is None and own:
        schema = _data_schema(spark, name) if exists else None
        wanted = unify([(s, ["a run"]) for s in own]) if _joins(own) else None
        if wanted is not None and (schema is None or schema.simpleString() != wanted.simpleString()):
            schema, dates, exists = wanted, None, False
    if schema is None or not all(_covered(s, schema) and _one_scan(s, schema) for s in own) or (not own and not old.isEmpty()):
        read_published(spark, cfg.output_base, cfg.audit_path, schema).createOrReplaceTempView(name)
        return
    if not exists:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"""CREATE TABLE {table} ({_columns(schema)}, {RUN_DATE} STRING) USING parquet
                      PARTITIONED BY ({RUN_DATE}) LOCATION {_literal(cfg.output_base)}""")
    if dates is not None:
        published = published.filter(F.col(RUN_DATE).isin(dates))
    rows = [(r[RUN_DATE], r[ATTEMPT]) for r in published.collect()]  # bounded: one per date
    have = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()} if exists else set()
    at = {d: _literal(attempt_path(cfg.output_base, d, a)) for d, a in rows}
    new = [f"PARTITION ({RUN_DATE} = {_literal(d)}) LOCATION {path}" for d, path in at.items() if d not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(new)}")
    for d in at.keys() & have:
        spark.sql(f"ALTER TABLE {table} PARTITION ({RUN_DATE} = {_literal(d)}) SET LOCATION {at[d]}")
    spark.sql(f"REFRESH TABLE {table}")
    spark.sql(f"""CREATE OR REPLACE TEMP VIEW {_ident(name)} AS
                  SELECT *, regexp_extract(_metadata.file_path, '/{ATTEMPT}=([^/]+)/', 1) AS {ATTEMPT} FROM {table}""")


def _joins(schemas: list[StructType]) -> bool:
    try:
        unify([(s, ["a run"]) for s in schemas])
        return True
    except ValueError:
        return False


def _covered(have: StructType, want: StructType) -> bool:
    return {f.name.lower() for f in have.fields} <= {f.name.lower() for f in want.fields}


def _data_schema(spark: SparkSession, name: str) -> StructType:
    return StructType([f for f in spark.table(_pointers(name)).schema.fields if f.name != RUN_DATE])
