"""Small column builders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType


def has_value(name: str, dtype: DataType | None = None) -> Column:
    """True when the column holds a value: not null and, for floating types, not NaN.

    This is the rule ``dropna`` applies; a plain ``IS NOT NULL`` keeps NaN.
    """
    col = F.col(name)
    if isinstance(dtype, (DoubleType, FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def any_differs(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """True when any pair differs; null equals null (``<=>``)."""
    if len(left) != len(right):
        raise ValueError("column lists differ in length")
    if not left:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [~l.eqNullSafe(r) for l, r in zip(left, right)])


def any_key_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def yyyymmdd(col: Column | str) -> Column:
    """Calendar date of a date/timestamp column as ``yyyymmdd`` text."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyyMMdd")
