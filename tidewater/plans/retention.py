"""A7/B4: folders that no reader can reach any more.

Attempts are never deleted by the library; this plans what file-system tools may delete.  An
attempt's folder is needed while readers can be sent to it (it is among the last ``keep``
verified attempts of its date), while it may still be written (it has a live lease, or no
audit row and files younger than the horizon), and for a while after it was superseded, since
a reader that started earlier may still be in it: the horizon, which must be longer than the
longest read and the longest run.  A compaction stands where the attempt it rewrote stood
(:func:`tidewater.plans.audit.latest_verified`), just above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import JobConfig
from ..operators.metrics import STATUS_VERIFIED
from ..sources.parquet import ATTEMPT, RUN_DATE
from .audit import read_audit
from .leases import read_leases

PLAN_COLUMNS = [RUN_DATE, ATTEMPT, "reason", "since"]


def unreachable(audit: DataFrame, leases: DataFrame, folders: DataFrame, before: Column, keep: int = 1) -> DataFrame:
    """``run_date, attempt, reason, since`` of the ``folders`` (run_date, attempt, modified) that
    nobody reads or writes at ``before`` + horizon.

    ``reason``: SUPERSEDED (verified, but ``keep`` later ones are there), the status of an attempt
    that was not verified, or ORPHAN (no audit row: its driver died without a lease, or the
    lease ended).  ``since`` is the time from which the folder was of no use; it lies before
    ``before``.  All joins are on (date, attempt); the ranking is per date."""
    if keep < 1:
        raise ValueError("at least the published attempt is kept")
    order = [F.coalesce("as_of", "finished").desc(), F.coalesce("replaces", ATTEMPT).desc(), F.col("finished").desc(),
             F.col(ATTEMPT).desc()]
    verified = audit.filter(F.col("status") == STATUS_VERIFIED)
    per_date = Window.partitionBy(RUN_DATE).orderBy(*order)
    # The attempt ``keep`` places above superseded this one, when it was published.
    ranked = verified.select(RUN_DATE, ATTEMPT, F.row_number().over(per_date).alias("_rank"),
                             F.lag("finished", keep).over(per_date).alias("_over"), F.col("finished").alias("_end"))
    superseded = ranked.filter(F.col("_rank") > keep).select(
        RUN_DATE, ATTEMPT, F.lit("SUPERSEDED").alias("reason"), F.greatest("_over", "_end").alias("since"))
    failed = audit.filter(F.col("status") != STATUS_VERIFIED).select(
        RUN_DATE, ATTEMPT, F.col("status").alias("reason"), F.col("finished").alias("since"))
    known = audit.select(RUN_DATE, ATTEMPT)
    held = leases.select(RUN_DATE, ATTEMPT, "expires")
    orphans = (folders.join(known, [RUN_DATE, ATTEMPT], "left_anti").join(held, [RUN_DATE, ATTEMPT], "left")
               .select(RUN_DATE, ATTEMPT, F.lit("ORPHAN").alias("reason"),
                       F.greatest("modified", "expires").alias("since")))
    useless = superseded.unionByName(failed).join(folders.select(RUN_DATE, ATTEMPT), [RUN_DATE, ATTEMPT], "left_semi")
    return useless.unionByName(orphans).filter(F.col("since") < before).select(*PLAN_COLUMNS)


def attempt_folders(spark: SparkSession, runs_path: str) -> DataFrame:
    """``run_date, attempt, modified, bytes`` of every attempt folder that holds data files; names,
    sizes and times alone are read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.parquet").load(runs_path))
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    named = listed.select(part(RUN_DATE).alias(RUN_DATE), part(ATTEMPT).alias(ATTEMPT), "modificationTime", "length")
    return named.filter((F.col(RUN_DATE) != "") & (F.col(ATTEMPT) != "")).groupBy(RUN_DATE, ATTEMPT).agg(
        F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"))


def retention_plan(spark: SparkSession, cfg: JobConfig, horizon: float = 7 * 86400.0, keep: int = 1) -> DataFrame:
    """``run_date, attempt, path, reason, since, bytes``: folders that may be deleted, none of
    which a reader can reach, ``horizon`` seconds after they fell out of use."""
    if horizon < 0:
        raise ValueError("the horizon is not negative")
    folders = attempt_folders(spark, cfg.output_base)
    before = F.timestamp_micros(F.unix_micros(F.current_timestamp()) - F.lit(int(horizon * 1e6)))
    plan = unreachable(read_audit(spark, cfg.audit_path), read_leases(spark, cfg.leases_path), folders, before, keep)
    path = F.concat(F.lit(f"{cfg.output_base}/{RUN_DATE}="), F.col(RUN_DATE), F.lit(f"/{ATTEMPT}="), F.col(ATTEMPT))
    return plan.join(folders.drop("modified"), [RUN_DATE, ATTEMPT]).select(
        RUN_DATE, ATTEMPT, path.alias("path"), "reason", "since", "bytes")
