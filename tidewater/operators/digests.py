"""B3 by digests: find the rows that differ without shuffling the rows that do not.

Rows are put in buckets of their key.  A bucket's digest is its number of rows and sums of two
64-bit hashes of each row, so the order of rows does not matter, equal buckets have equal
digests, and partial sums combine before the shuffle.  The digests of both sides are compared
from coarse buckets to fine ones: each level looks only into buckets that differed one level
above, until little is left.  Rows of the buckets that still differ are joined in full; all
others are the same on both sides.

Coarse levels shuffle a few thousand sums per task.  Changes that are scattered over all coarse
buckets need fine ones, whose sums are about as many as the rows, though never wider than six
numbers: worth it for wide rows.  Changes near each other in a whole-number key stay together
with ``by="range"``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StructType

from ..session import scratch_path
from .mirror import CHANGE, SAME, _keys, _same_shape, mirror_diff

BUCKET = "__bucket"
_SUMS = ["__n", "__a", "__b", "__c", "__d"]
#: Bits of the coarsest buckets, bits added per level, and the finest.
FIRST_BITS, STEP_BITS, MOST_BITS = 12, 8, 44
#: A list of buckets up to this long (8 bytes each) is broadcast; a longer one is left to the planner.
BROADCAST_BUCKETS = 1_000_000


@dataclass(frozen=True)
class DigestPlan:
    """What the comparison found: buckets of ``bits`` bits that differ (None: none do), rows of
    both sides in them, and rows of both sides in all.  ``bucket`` gives a row's bucket."""

    buckets: DataFrame | None
    bucket: Column
    bits: int
    n_buckets: int
    rows_differing: int
    rows_total: int


def row_hash(columns: Sequence[tuple[str, object]], seed: int) -> Column:
    """64-bit hash of a row's values.  The hash skips nulls, so each column adds whether it is one;
    nested values enter as JSON, where their nulls show."""
    parts = [F.lit(seed)]
    for name, kind in columns:
        col = F.col(f"`{name}`")
        nested = isinstance(kind, (ArrayType, MapType, StructType))
        parts += [F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}) if nested else col, col.isNull()]
    return F.xxhash64(*parts)


def _bucket(src: DataFrame, tgt: DataFrame, keys: list[str], by: str):
    """Bucket of a row by the number of bits; fine buckets lie within coarse ones."""
    if by == "hash":
        hashed = row_hash([(k, src.schema[k].dataType) for k in keys], 0)
        return lambda bits: hashed.bitwiseAND(F.lit((1 << bits) - 1))
    if by != "range":
        raise ValueError("by is 'hash' or 'range'")
    if len(keys) != 1 or not isinstance(src.schema[keys[0]].dataType, IntegralType):
        raise ValueError("by='range' needs one whole-number key")
    key = F.col(f"`{keys[0]}`").cast("decimal(20,0)")
    ends = src.select(key.alias("k")).union(tgt.select(key.alias("k"))).agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    lo, span = (int(ends["lo"]), int(ends["hi"]) - int(ends["lo"]) + 1) if ends["lo"] is not None else (0, 1)
    wide = span.bit_length()

    def bucket(bits: int) -> Column:
        offset = (key - F.lit(lo).cast("decimal(20,0)")).cast("decimal(21,0)")
        return F.coalesce(F.floor(offset / F.lit(1 << max(0, wide - bits)).cast("decimal(20,0)")).cast("long"), F.lit(-1))

    return bucket


def bucket_digests(df: DataFrame, bucket: Column) -> DataFrame:
    """``__bucket``, the number of its rows and four sums over them.  The halves of the hashes
    are summed apart, so a bucket of up to 2**31 rows cannot overflow; sums, unlike exclusive
    ors, tell repeated rows apart."""
    cols = [(f.name, f.dataType) for f in df.schema.fields]
    hashed = df.select(bucket.alias(BUCKET), row_hash(cols, 1).alias("h1"), row_hash(cols, 2).alias("h2"))
    low = F.lit((1 << 32) - 1)
    sums = [F.sum(part) for h in ("h1", "h2") for part in
            (F.col(h).bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    return hashed.groupBy(BUCKET).agg(F.count(F.lit(1)).alias(_SUMS[0]),
                                      *[s.alias(n) for s, n in zip(sums, _SUMS[1:])])


def _within(df: DataFrame, bucket: Column, buckets: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose bucket is listed.  The list is broadcast where its counted size allows."""
    listed = buckets.select(F.col(BUCKET).alias("__listed"))
    listed = F.broadcast(listed) if n <= BROADCAST_BUCKETS else listed
    return df.withColumn(BUCKET, bucket).join(listed, F.col(BUCKET) == F.col("__listed"), "left_semi").drop(BUCKET)


def plan_digests(src: DataFrame, tgt: DataFrame, keys: Sequence[str] | str, *, by: str = "hash",
                 first_bits: int = FIRST_BITS, target: float = 0.02, finest: float = 4.0) -> DigestPlan:
    """Compare digests level by level until the rows in buckets that differ are at most the
    share ``target`` of all, or ``finest`` a bucket on average (both sides together)."""
    keys = _keys(src, keys)
    _same_shape(src, tgt)
    tgt = tgt.select(*[f"`{c}`" for c in src.columns])
    at = _bucket(src, tgt, keys, by)
    spark, bits, total, buckets, n = src.sparkSession, first_bits, None, None, 0
    while True:
        bucket = at(bits)
        sides = [src, tgt] if buckets is None else [_within(d, at(bits - STEP_BITS), buckets, n) for d in (src, tgt)]
        s, t = (bucket_digests(d, bucket).select(F.col(BUCKET).alias(f"{x}{BUCKET}"), *[
            F.col(c).alias(f"{x}{c}") for c in _SUMS]) for x, d in zip("st", sides))
        both = s.join(t, F.col(f"s{BUCKET}") == F.col(f"t{BUCKET}"), "full")
        same = [F.col(f"s{c}").eqNullSafe(F.col(f"t{c}")) for c in _SUMS]
        differs = ~(same[0] & same[1] & same[2] & same[3] & same[4])
        rows = F.coalesce(F.col(f"s{_SUMS[0]}"), F.lit(0)) + F.coalesce(F.col(f"t{_SUMS[0]}"), F.lit(0))
        path = scratch_path(spark, "digests")
        both.select(F.coalesce(f"s{BUCKET}", f"t{BUCKET}").alias(BUCKET), rows.alias("rows"),
                    differs.alias("differs")).write.parquet(path)
        found = spark.read.parquet(path)
        got = found.agg(F.sum("rows").alias("all"), F.count_if("differs").alias("n"),
                        F.sum(F.when(F.col("differs"), F.col("rows"))).alias("rows")).first()
        total = total if total is not None else got["all"] or 0
        n, left = got["n"], got["rows"] or 0
        buckets = found.filter("differs").select(BUCKET)
        if not n:
            return DigestPlan(None, bucket, bits, 0, 0, total)
        if left <= target * total or left <= finest * n or bits + STEP_BITS > MOST_BITS:
            return DigestPlan(buckets, bucket, bits, n, left, total)
        bits += STEP_BITS


def mirror_diff_by_digest(src: DataFrame, tgt: DataFrame, keys: Sequence[str] | str, *, by: str = "hash",
                          check: bool = True, changes_only: bool = False, change_col: str = CHANGE,
                          plan: DigestPlan | None = None) -> DataFrame:
    """Like :func:`tidewater.operators.mirror.mirror_diff`, joining only buckets that differ.

    ``check`` looks for null and repeated keys in those buckets; in the others both sides hold
    the same rows, whatever their keys.  Unless ``changes_only``, their rows are appended from
    the source as they are, without a shuffle."""
    plan = plan or plan_digests(src, tgt, keys, by=by)
    tgt = tgt.select(*[f"`{c}`" for c in src.columns])
    if plan.buckets is None:
        part_s, part_t, rest = src.limit(0), tgt.limit(0), src
    else:
        part_s, part_t = (_within(d, plan.bucket, plan.buckets, plan.n_buckets) for d in (src, tgt))
        listed = plan.buckets.select(F.col(BUCKET).alias("__listed"))
        listed = F.broadcast(listed) if plan.n_buckets <= BROADCAST_BUCKETS else listed  # counted before
        rest = src.withColumn(BUCKET, plan.bucket).join(
            listed, F.col(BUCKET) == F.col("__listed"), "left_anti").drop(BUCKET)
    diff = mirror_diff(part_s, part_t, keys, check=check and plan.buckets is not None, changes_only=changes_only,
                       change_col=change_col)
    if changes_only:
        return diff
    return diff.unionByName(rest.withColumn(change_col, F.lit(SAME)))
