"""B3 by digests: equal to the full diff, with few rows joined."""

import random

import pytest
from pyspark.sql import functions as F

from support import SF001
from tidewater.operators import digests
from tidewater.operators.digests import bucket_digests, mirror_diff_by_digest, plan_digests, row_hash
from tidewater.operators.mirror import MirrorKeyError, mirror_diff
from tidewater.queries import mirror_sides


def rows(df):
    return sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())  # NaN equals NaN


def table(spark, n, seed=0):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7 + seed).alias("v"),
                                 F.concat(F.lit("row "), "id").alias("s"))


@pytest.mark.parametrize("by", ["hash", "range"])
def test_equals_the_full_diff(spark, by):
    src, tgt = mirror_sides(spark, SF001)
    for only in (False, True):
        got = mirror_diff_by_digest(src, tgt, "c_custkey", by=by, changes_only=only)
        assert rows(got) == rows(mirror_diff(src, tgt, "c_custkey", changes_only=only))


def test_one_percent_near_each_other(spark):
    """1 % changed rows: under 5 % of the rows are joined, and only they reach the shuffle."""
    tgt = table(spark, 50_000)
    near = F.col("k").between(20_000, 20_499)
    src = tgt.withColumn("v", F.when(near, F.col("v") + 1).otherwise(F.col("v")))
    plan = plan_digests(src, tgt, "k", by="range")
    assert plan.bits == digests.FIRST_BITS and 1000 <= plan.rows_differing < 0.05 * plan.rows_total == 5000
    diff = mirror_diff_by_digest(src, tgt, "k", plan=plan, changes_only=True, check=False)
    assert diff.count() == 500 and {r["change"] for r in diff.collect()} == {"update"}


def test_one_percent_scattered(spark):
    tgt = table(spark, 50_000)
    src = tgt.withColumn("v", F.when(F.col("k") % 100 == 7, F.col("v") + 1).otherwise(F.col("v")))
    plan = plan_digests(src, tgt, "k", target=0.04)
    assert plan.bits == digests.FIRST_BITS + digests.STEP_BITS and plan.rows_differing < 0.05 * plan.rows_total
    got = mirror_diff_by_digest(src, tgt, "k", plan=plan, changes_only=True)
    assert sorted(r["k"] for r in got.collect()) == list(range(7, 50_000, 100))


def test_few_changes_need_no_fine_level(spark):
    tgt = table(spark, 20_000)
    src = tgt.filter("k not in (5, 900)").union(table(spark, 20_003, 0).filter("k >= 20001"))
    plan = plan_digests(src, tgt, "k")
    assert plan.bits == digests.FIRST_BITS and plan.n_buckets <= 4
    got = {(r["k"], r["change"]) for r in mirror_diff_by_digest(src, tgt, "k", plan=plan, changes_only=True).collect()}
    assert got == {(5, "delete"), (900, "delete"), (20_001, "insert"), (20_002, "insert")}


def test_nothing_differs(spark):
    tgt = table(spark, 500)
    plan = plan_digests(tgt.repartition(7), tgt, "k")
    assert plan.buckets is None and plan.rows_total == 1000
    same = mirror_diff_by_digest(tgt, tgt, "k")
    assert same.count() == 500 and {r["change"] for r in same.collect()} == {"same"}
    assert mirror_diff_by_digest(tgt, tgt, "k", changes_only=True).collect() == []


@pytest.mark.parametrize("by", ["hash", "range"])
def test_empty_sides(spark, by):
    tgt = table(spark, 30)
    none = tgt.limit(0)
    assert {r["change"] for r in mirror_diff_by_digest(tgt, none, "k", by=by).collect()} == {"insert"}
    assert {r["change"] for r in mirror_diff_by_digest(none, tgt, "k", by=by).collect()} == {"delete"}
    assert mirror_diff_by_digest(none, none, "k", by=by).collect() == []


def test_nulls_and_order_of_columns_show(spark):
    ddl = "k int, a string, b string, c array<int>, d double"
    one = [(1, None, "x", [1, None], 0.0), (2, "x", None, [], None), (3, "", None, None, float("nan"))]
    two = [(1, "x", None, [1, None], 0.0), (2, "x", None, None, None), (3, None, "", None, float("nan"))]
    a, b = spark.createDataFrame(one, ddl), spark.createDataFrame(two, ddl).select("d", "c", "b", "a", "k")
    got = {r["k"]: r["change"] for r in mirror_diff_by_digest(a, b, "k").collect()}
    assert got == {1: "update", 2: "update", 3: "update"}
    assert rows(mirror_diff_by_digest(a, b, "k")) == rows(mirror_diff(a, b, "k"))
    assert plan_digests(a, a.select("d", "c", "b", "a", "k"), "k").buckets is None


def test_random_tables(spark):
    r = random.Random(1)
    for by in ("hash", "range"):
        keys = r.sample(range(-10**12, 10**12), 300)
        one = {k: (r.choice([None, 1, 2]), r.choice("ab")) for k in keys}
        two = {k: (v if r.random() > 0.1 else (3, "c")) for k, v in one.items() if r.random() > 0.1}
        two.update({r.randrange(10**12): (1, "n") for _ in range(20)})
        a, b = (spark.createDataFrame([(k, *v) for k, v in t.items()], "k long, x int, y string") for t in (one, two))
        assert rows(mirror_diff_by_digest(a, b, "k", by=by)) == rows(mirror_diff(a, b, "k"))


def test_repeated_keys(spark):
    """Repeated rows are no exclusive or: two of one and two of another differ."""
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "y")], "k int, v string")
    with pytest.raises(MirrorKeyError):
        mirror_diff_by_digest(a, b, "k")
    assert plan_digests(a, a, "k").buckets is None


def test_arguments(spark):
    t = table(spark, 3)
    with pytest.raises(ValueError, match="whole-number"):
        plan_digests(t, t, "s", by="range")
    with pytest.raises(ValueError, match="hash"):
        plan_digests(t, t, "k", by="day")
    with pytest.raises(ValueError, match="differ"):
        plan_digests(t, t.drop("v"), "k")


def test_digests_combine_before_the_shuffle(spark):
    df = table(spark, 10_000).repartition(4)
    plan = bucket_digests(df, F.col("k") % 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 2 and "partial_sum" in plan
    both = df.select(row_hash([("k", df.schema["k"].dataType)], 1).alias("a"), row_hash([("k", df.schema["k"].dataType)], 2).alias("b"))
    assert both.filter("a = b").count() == 0 and both.select("a").distinct().count() == 10_000
