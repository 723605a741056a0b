"""A2 projection, A3 all-null filter, A5 schema report, A6 preview."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

SCHEMA_REPORT_DDL = "position INT, name STRING, type STRING, nullable BOOLEAN"


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep ``cols`` in that order.  A name that does not resolve fails at
    analysis; a duplicated header (renamed ``price0, price1``) fails the same way."""
    return df.select(*cols)


def drop_all_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows in which every column of ``subset`` is null or NaN.

    ``dropna`` treats NaN in float/double columns as missing, which a
    ``coalesce(...) IS NOT NULL`` rewrite would not.
    """
    return df.dropna(how="all", subset=list(subset) if subset else None)


def schema_report(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The schema of ``df`` as rows (position, name, type, nullable).

    Built on the driver from the schema alone: its size is the column count.
    """
    rows = [
        (i, f.name, f.dataType.simpleString(), bool(f.nullable))
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, SCHEMA_REPORT_DDL)


def _printed(call: Callable[[], None]) -> list[str]:
    """What ``call`` prints, as lines."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        call()
    return out.getvalue().rstrip("\n").split("\n")


def schema_lines(df: DataFrame) -> list[str]:
    """The text that ``printSchema`` prints; no action."""
    return _printed(df.printSchema)


def preview(df: DataFrame, n: int, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows.  Unordered (any ``n`` rows) unless ``order_by`` is given;
    with an order Spark keeps a top-``n`` per partition and merges those, so the
    driver never sees more than ``n`` rows per task."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def preview_text(df: DataFrame, n: int) -> list[str]:
    """The text that ``show(n, truncate=False)`` prints (a bounded ``take``)."""
    return _printed(lambda: df.show(n, truncate=False))
