"""B3: null-safe table mirror (insert / update / delete / same).

``mirror_diff`` compares a source snapshot with the target table on key
columns: one full outer join on the keys (both sides hash-partitioned on the
keys), values compared with ``<=>`` so that null equals null.
``mirror_apply`` produces the new target without a full join (see there).

Keys must be unique and non-null on both sides: a duplicated key would pair
rows arbitrarily and a null key never matches.  :func:`check_keys` rejects both
with one aggregation over the key columns of the two sides; it aggregates
map-side, so even a key repeated in a third of all rows is one row per task
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_differs, any_key_null

CHANGE = "change"
INSERT, UPDATE, DELETE, SAME = "insert", "update", "delete", "same"

_SRC, _TGT = "__src_present", "__tgt_present"
_SIDE, _ROWS = "__side", "__rows"


class MirrorKeyError(ValueError):
    """A key column is null or repeated on one side of a mirror."""


def _keys(df: DataFrame, keys: Sequence[str] | str) -> list[str]:
    """Key names as ``df`` spells them, found the way the session resolves names."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("at least one key column is required")
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return keys
    spelled = {c.lower(): c for c in df.columns}
    return [spelled.get(k.lower(), k) for k in keys]


def _same_shape(src: DataFrame, tgt: DataFrame) -> None:
    """Both sides need the same column names and types: a silent cast would call
    ``01`` and ``1`` equal, or fail while the join runs."""
    missing = set(src.columns) ^ set(tgt.columns)
    if missing:
        raise ValueError(f"source and target columns differ: {sorted(missing)}")
    s, t = dict(src.dtypes), dict(tgt.dtypes)
    other = {c: (s[c], t[c]) for c in s if s[c] != t[c]}
    if other:
        raise ValueError(f"source and target types differ: {other}")


def check_keys(src: DataFrame, tgt: DataFrame, keys: Sequence[str] | str) -> None:
    """Raise :class:`MirrorKeyError` if a key is null or repeated on either side."""
    keys = _keys(src, keys)
    both = (src.select(*keys, F.lit("source").alias(_SIDE))
               .unionByName(tgt.select(*keys, F.lit("target").alias(_SIDE))))
    bad = (both.groupBy(_SIDE, *keys)
               .agg(F.count(F.lit(1)).alias(_ROWS))
               .filter((F.col(_ROWS) > 1) | any_key_null(keys))
               .limit(1)
               .collect())
    if bad:
        row = bad[0].asDict()
        null_key = any(row[k] is None for k in keys)
        problem = "null key" if null_key else f"key repeated {row[_ROWS]} times"
        raise MirrorKeyError(f"{row[_SIDE]}: {problem}: {[row[k] for k in keys]}")


def mirror_diff(src: DataFrame, tgt: DataFrame, keys: Sequence[str] | str, *,
                check: bool = True, changes_only: bool = False,
                change_col: str = CHANGE) -> DataFrame:
    """One row per key of either side: the key, the row's values (source
    values, or target values for a delete) and ``change_col``.  A table that has
    a column of that name needs another ``change_col``."""
    keys = _keys(src, keys)
    values = [c for c in src.columns if c not in keys]
    _same_shape(src, tgt)
    if change_col.lower() in {c.lower() for c in src.columns}:
        raise ValueError(f"the tables have a column {change_col!r}; give another change_col")
    if check:
        check_keys(src, tgt, keys)
    s = src.select(*keys, *[F.col(c).alias(f"s__{c}") for c in values], F.lit(True).alias(_SRC))
    t = tgt.select(*keys, *[F.col(c).alias(f"t__{c}") for c in values], F.lit(True).alias(_TGT))
    joined = s.join(t, on=keys, how="full")
    s_cols = [F.col(f"s__{c}") for c in values]
    t_cols = [F.col(f"t__{c}") for c in values]
    change = (F.when(F.col(_TGT).isNull(), F.lit(INSERT))
               .when(F.col(_SRC).isNull(), F.lit(DELETE))
               .when(any_differs(s_cols, t_cols), F.lit(UPDATE))
               .otherwise(F.lit(SAME)))
    out = joined.select(
        *keys,
        *[F.when(F.col(_SRC).isNull(), tc).otherwise(sc).alias(c)
          for c, sc, tc in zip(values, s_cols, t_cols)],
        change.alias(change_col),
    )
    if changes_only:
        out = out.filter(F.col(change_col) != SAME)
    return out


def mirror_apply(src: DataFrame, tgt: DataFrame, keys: Sequence[str] | str, *,
                 delete: bool = True, check: bool = True) -> DataFrame:
    """The target after mirroring the source: inserts and updates applied;
    target-only rows removed when ``delete`` (sync), kept otherwise (copy
    without delete).  Columns in source order.  Write the result as a new
    attempt (:func:`tidewater.plans.job.publish_frame`); this is not an
    in-place update.

    No full join is needed for either mode.  With ``delete`` the result *is*
    the source (once its keys are checked).  Without, it is the source plus
    the target rows whose key the source lacks: a left-anti join, which
    shuffles the source's key columns and, unless those are small enough to
    broadcast, the target's rows.
    """
    keys = _keys(src, keys)
    _same_shape(src, tgt)
    if check:
        check_keys(src, tgt, keys)
    out = src.select(*src.columns)
    if delete:
        return out
    target_only = tgt.join(src.select(*keys), on=keys, how="left_anti")
    return out.unionByName(target_only.select(*src.columns))


def change_counts(diff: DataFrame, change_col: str = CHANGE) -> DataFrame:
    """(change, rows) summary of a diff."""
    return diff.groupBy(change_col).agg(F.count(F.lit(1)).alias("rows"))
