"""B5: metrics from job logs.

Reads log files as text (distributed over files and splits), keeps the lines
in the job's count formats and returns ``file, metric, value``.  Unknown
lines are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logformat import LOG_PATTERN, METRIC_NAMES


def _metric(label: Column) -> Column:
    branches = [(label == k, F.lit(v)) for k, v in METRIC_NAMES.items()]
    first, *rest = branches
    expr = F.when(*first)
    return reduce(lambda e, b: e.when(*b), rest, expr)


def parse_log_lines(lines: DataFrame, text_col: str = "value", anchored: bool = True) -> DataFrame:
    """Recognised count lines of a text DataFrame (other columns are kept)."""
    pattern = LOG_PATTERN if anchored else LOG_PATTERN.lstrip("^")
    label = F.regexp_extract(F.col(text_col), pattern, 1)
    number = F.regexp_extract(F.col(text_col), pattern, 2)
    keep = [c for c in lines.columns if c != text_col]
    return (lines.select(*keep, label.alias("_label"), number.alias("_number"))
                 .filter(F.col("_label") != "")
                 .select(*keep, _metric(F.col("_label")).alias("metric"),
                         F.col("_number").cast("bigint").alias("value")))


def parse_job_logs(spark: SparkSession, path: str | list[str], *, recursive: bool = True,
                   anchored: bool = True) -> DataFrame:
    """``file, metric, value`` for every recognised line below ``path``."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    text = reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_log_lines(text, anchored=anchored)


def read_run_logs(spark: SparkSession, logs_path: str) -> DataFrame:
    """Logs kept by the job (``{logs}/run_date=D/attempt=A/``):
    ``run_date, attempt, file, metric, value``."""
    text = (spark.read.schema("value STRING, run_date STRING, attempt STRING").text(logs_path)
                 .select("run_date", "attempt", F.col("_metadata.file_path").alias("file"),
                         "value"))
    return parse_log_lines(text)
