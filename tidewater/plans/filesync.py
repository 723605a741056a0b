"""B2/B3: a table kept equal to the files of a folder - new, changed and removed ones.

The stream (:mod:`tidewater.streaming.ingest`) reads each file once and never again.  Here a
ledger says which version of which file the table holds::

    {base}/ledger/sync=S/   path, state, length, modified, rows, sync, schema, replaces
    {base}/rows/sync=S/     the kept columns and ``_file``

A sync lists the folder (names, lengths and times alone), compares the list with the ledger,
reads the new and the changed files, writes their rows below its own id, counts them back per
file, and writes the ledger rows.  That write is the commit: rows without ledger rows are not
seen.  Rows of changed and removed files are retracted by their key (file, sync), not
rewritten; :func:`compact_synced` drops them for good.

A file is changed when its length or its time differs.  One that changes between listing and
reading differs from the list the next time and is read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import DEFAULT_COLUMNS
from ..operators.transforms import drop_all_null, project
from ..sources.csv import scan_csv
from ..sources.headers import file_path, literal_path, scan_by_header
from ..sources.parquet import _missing_path, new_attempt_id
from ..sources.schemas import ERROR, schema_from_text, schema_text, unify, union_scans

FILE, SYNC, PATH = "_file", "sync", "path"
NEW, CHANGED, REMOVED, SAME, KEPT = "new", "changed", "removed", "same", "kept"
LEDGER_DDL = (f"{PATH} STRING, state STRING, length BIGINT, modified BIGINT, rows BIGINT, {SYNC} STRING, "
              "schema STRING, replaces STRING")


@dataclass(frozen=True)
class SyncResult:
    """Files by what happened to them, rows written and rows retracted; ``sync`` is None when
    nothing differed and so nothing was written."""

    sync: str | None
    new: int = 0
    changed: int = 0
    removed: int = 0
    same: int = 0
    rows_written: int = 0
    rows_retracted: int = 0


def _ledger_path(base: str) -> str:
    return f"{base.rstrip('/')}/ledger"


def _rows_path(base: str, sync: str) -> str:
    return f"{base.rstrip('/')}/rows/{SYNC}={sync}"


def list_files(spark: SparkSession, source: str, *, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """``path, length, modified`` (microseconds) of the files in ``source``; no file is opened."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(source)
    return listed.select(PATH, "length", F.unix_micros("modificationTime").alias("modified"))


def read_ledger(spark: SparkSession, base: str) -> DataFrame:
    """Every ledger row; a ledger that does not exist yet is empty."""
    try:
        held = spark.read.schema(LEDGER_DDL).option("recursiveFileLookup", True).parquet(_ledger_path(base))
        held.schema  # a missing folder surfaces here
        return held
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        return spark.createDataFrame([], LEDGER_DDL)


def current_files(spark: SparkSession, base: str) -> DataFrame:
    """The last ledger row of each path that is not removed.  Sync ids sort by time, and the
    latest row per path is a map-side combined maximum.  A compaction's row stands for the sync
    that it replaces: it wins over that one, but never over a sync it has not seen."""
    held = read_ledger(spark, base)
    rest = F.struct(*[F.col(c) for c in held.columns if c != PATH])
    order = F.struct(F.coalesce("replaces", SYNC), F.col(SYNC))
    last = held.groupBy(PATH).agg(F.max_by(rest, order).alias("_last")).select(PATH, "_last.*")
    return last.filter(F.col("state") != REMOVED)


def diff_files(listing: DataFrame, current: DataFrame) -> DataFrame:
    """``path, length, modified, state, old_rows``: one row per file of the folder or the ledger."""
    old = current.select(F.col(PATH).alias("_p"), F.col("length").alias("_l"), F.col("modified").alias("_m"),
                         F.col("rows").alias("old_rows"))
    both = listing.join(old, F.col(PATH) == F.col("_p"), "full")
    differs = (F.col("length") != F.col("_l")) | (F.col("modified") != F.col("_m"))
    state = (F.when(F.col("_p").isNull(), F.lit(NEW)).when(F.col(PATH).isNull(), F.lit(REMOVED))
             .when(differs, F.lit(CHANGED)).otherwise(F.lit(SAME)))
    return both.select(F.coalesce(PATH, "_p").alias(PATH), "length", "modified", state.alias("state"), "old_rows")


def sync_files(
    spark: SparkSession,
    source: str,
    base: str,
    schema=None,
    *,
    columns: Sequence[str] = DEFAULT_COLUMNS,
    by_header: bool = False,
    recursive: bool = False,
    glob: str | None = None,
    options=None,
) -> SyncResult:
    """Bring the table at ``base`` to the present files of ``source``.

    Only new and changed files are read.  Without a declared ``schema`` the types are those of
    the files read in this sync; :func:`read_synced` unites them over all syncs.  Rows in which
    every kept column is null are dropped, as in the job.  An empty folder removes all rows, a
    missing one is an error.  Two syncs at the same time may both read a file; readers take
    the version of the later id."""
    diff = diff_files(list_files(spark, source, recursive=recursive, glob=glob), current_files(spark, base))
    # bounded: the paths that differ; Spark's scan of them lists the same ones on the driver
    todo = diff.filter(F.col("state") != SAME).collect()
    same = diff.filter(F.col("state") == SAME).count()
    if not todo:
        return SyncResult(None, same=same)
    sync = new_attempt_id()
    read = [r for r in todo if r["state"] != REMOVED]
    counts, text = spark.createDataFrame([], "_f STRING, n BIGINT"), None
    if read:
        paths = [literal_path(r[PATH]) for r in read]
        rows = _scan(spark, paths, schema, columns, by_header, options)
        rows.write.mode("errorifexists").parquet(_rows_path(base, sync))
        text = schema_text(rows.drop(FILE).schema)
        counts = (spark.read.schema(rows.schema).parquet(_rows_path(base, sync))
                  .groupBy(F.col(FILE).alias("_f")).agg(F.count(F.lit(1)).alias("n")))
    entries = spark.createDataFrame([(r[PATH], r["state"], r["length"], r["modified"]) for r in todo],
                                    "path STRING, state STRING, length BIGINT, modified BIGINT")
    ledger = entries.join(counts, F.col(PATH) == F.col("_f"), "left").select(
        PATH, "state", "length", "modified", F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"),
        F.lit(sync).alias(SYNC), F.lit(text).cast("string").alias("schema"),
        F.lit(None).cast("string").alias("replaces"))
    ledger.write.mode("errorifexists").parquet(f"{_ledger_path(base)}/{SYNC}={sync}")
    wrote = (spark.read.schema(LEDGER_DDL).parquet(f"{_ledger_path(base)}/{SYNC}={sync}")
             .agg(F.sum("rows").alias("n")).first()["n"])
    state = [r["state"] for r in todo]
    return SyncResult(sync, state.count(NEW), state.count(CHANGED), state.count(REMOVED), same, wrote,
                      sum(r["old_rows"] or 0 for r in todo))


def _scan(spark: SparkSession, paths: list[str], schema, columns: Sequence[str], by_header: bool, options) -> DataFrame:
    """Kept columns and ``_file`` of the given files."""
    if by_header:
        raw = scan_by_header(spark, paths, schema, quarantine=False, options=options, file_col=FILE)
    else:
        raw = scan_csv(spark, paths, schema=schema, quarantine=False, options=options)
        raw = raw.select("*", file_path().alias(FILE))
    # the ledger has the listing's spelling of a path: without an empty authority
    plain = F.regexp_replace(FILE, r"^([A-Za-z][A-Za-z0-9+.-]*:)/{3}", "$1/")
    return drop_all_null(project(raw, [*columns, FILE]).withColumn(FILE, plain), columns)


def sync_summary(spark: SparkSession, base: str) -> DataFrame:
    """``sync, new, changed, removed, rows_written`` of every sync."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return read_ledger(spark, base).groupBy(SYNC).agg(
        count(NEW), count(CHANGED), count(REMOVED),
        F.sum(F.when(F.col("state") != KEPT, F.col("rows")).otherwise(0)).alias("rows_written"))


def read_synced(spark: SparkSession, base: str, schema: StructType | None = None, *, on_conflict: str = ERROR,
                file_col: str | None = None) -> DataFrame:
    """Rows of the present version of every file.

    Syncs are grouped by schema (one scan each, united by name to the widest types).  A sync of which every
    file is still present is read as it is; in the others, rows of retracted (file, sync) keys
    are left out by an anti join on the ledger, which is small beside the rows."""
    held = read_ledger(spark, base).filter((F.col("state") != REMOVED) & F.col("schema").isNotNull())
    live = current_files(spark, base).select(PATH, SYNC, F.lit(True).alias("live"))
    marked = held.join(live, [PATH, SYNC], "left").select(PATH, SYNC, "schema", "rows", "live")
    per_sync = marked.filter("rows > 0").groupBy(SYNC, "schema").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("live").alias("n_live"))
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in per_sync.filter("n_live > 0").orderBy(SYNC).collect():  # bounded: one row per sync
        groups.setdefault((row["schema"], row["n_live"] == row["n_files"]), []).append(row[SYNC])
    carry = [FILE] if file_col else []
    if not groups:
        target = schema or StructType([])
        empty = spark.createDataFrame([], StructType([*target.fields, *[StructField(c, StringType()) for c in carry]]))
        return empty.withColumnRenamed(FILE, file_col) if file_col else empty
    gone = marked.filter("live is null").select(F.col(PATH).alias("_gone"), F.col(SYNC).alias("_gone_sync"))
    scans = []
    for (text, whole), syncs in groups.items():
        own = schema_from_text(text)
        shape = StructType([*own.fields, StructField(FILE, StringType()), StructField(SYNC, StringType())])
        rows = (spark.read.schema(shape).option("basePath", f"{base.rstrip('/')}/rows")
                .parquet(*[_rows_path(base, s) for s in syncs]))
        if not whole:
            rows = rows.join(gone, (F.col(FILE) == F.col("_gone")) & (F.col(SYNC) == F.col("_gone_sync")), "left_anti")
        scans.append(rows)
    target = schema or unify([(schema_from_text(t), syncs) for (t, _), syncs in groups.items()], on_conflict, scans)
    out = union_scans(scans, target, carry)
    return out.withColumnRenamed(FILE, file_col) if file_col else out


def compact_synced(spark: SparkSession, base: str, schema: StructType | None = None) -> str | None:
    """Rewrite the present rows as one sync without the retracted ones; its id, or None if there
    are no files.  The files keep their lengths and times, so the next sync reads nothing.  What
    a sync wrote that lands in between stays (see :func:`current_files`)."""
    current = current_files(spark, base)
    if current.isEmpty():
        return None
    sync = new_attempt_id()
    rows = read_synced(spark, base, schema, file_col=FILE)
    rows.hint("rebalance").write.mode("errorifexists").parquet(_rows_path(base, sync))
    text = schema_text(rows.drop(FILE).schema)
    (current.withColumns({"state": F.lit(KEPT), SYNC: F.lit(sync), "schema": F.lit(text),
                          "replaces": F.coalesce("replaces", SYNC)})
            .select(*[f.split(" ")[0] for f in LEDGER_DDL.split(", ")])
            .write.mode("errorifexists").parquet(f"{_ledger_path(base)}/{SYNC}={sync}"))
    return sync
