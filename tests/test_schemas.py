"""A8, A11: the type lattice and reads over runs of different schemas."""

import os
from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from support import write_files
from tidewater.config import JobConfig
from tidewater.plans.audit import (
    read_all_attempts,
    read_audit,
    read_overwritten,
    read_published,
    record_run,
    schema_history,
)
from tidewater.plans.job import run_job
from tidewater.plans.runs import run_range
from tidewater.sources.schemas import (
    IncompatibleSchemasError,
    conform,
    schema_from_text,
    schema_text,
    unify,
    widest,
)

SIMPLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(),
          T.DecimalType(10, 2), T.DecimalType(38, 0), T.DecimalType(38, 30), T.StringType(), T.BooleanType(),
          T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.NullType(), T.BinaryType()]
types = st.recursive(st.sampled_from(SIMPLE), lambda inner: st.one_of(
    inner.map(T.ArrayType), st.tuples(inner, inner).map(lambda p: T.StructType().add("a", p[0]).add("b", p[1]))),
    max_leaves=4)


def test_lattice_of_simple_types():
    want = {("tinyint", "bigint"): "bigint", ("int", "double"): "double", ("int", "float"): "double",
            ("smallint", "float"): "float", ("bigint", "decimal(10,2)"): "decimal(22,2)",
            ("decimal(10,2)", "double"): "double", ("date", "timestamp"): "timestamp",
            ("date", "timestamp_ntz"): "timestamp_ntz", ("void", "boolean"): "boolean",
            ("decimal(38,0)", "decimal(38,30)"): None, ("timestamp", "timestamp_ntz"): None,
            ("int", "string"): None, ("boolean", "int"): None, ("date", "int"): None}
    by_name = {t.simpleString(): t for t in SIMPLE}
    for (a, b), w in want.items():
        got = widest(by_name[a], by_name[b])
        assert (got and got.simpleString()) == w
        text = widest(by_name[a], by_name[b], "string")
        assert text.simpleString() == (w or "string")


@given(types, types)
def test_widest_is_symmetric_and_idempotent(a, b):
    assert widest(a, a) == a
    for rule in ("error", "string"):
        up, back = widest(a, b, rule), widest(b, a, rule)
        assert (up is None) == (back is None)
        if up is not None:
            assert up.simpleString() == back.simpleString()
            assert widest(up, a, rule) == up and widest(up, b, rule) == up


@given(st.permutations(SIMPLE[:6]))
def test_order_of_runs_does_not_matter_for_numbers(order):
    schemas = [(T.StructType().add("x", t), [str(i)]) for i, t in enumerate(order)]
    assert unify(schemas)["x"].dataType == T.DoubleType()


def test_unify_names_columns_and_dates():
    a = T.StructType().add("Price", "integer").add("day", "date")
    b = T.StructType().add("price", "double").add("day", "integer").add("extra", "string")
    with pytest.raises(IncompatibleSchemasError) as err:
        unify([(a, ["20240101"]), (b, [f"202402{d:02d}" for d in range(1, 9)])])
    text = str(err.value)
    assert "day: date on 20240101, int on 20240201 to 20240208 (8 dates)" in text and "price" not in text.lower()
    ok = unify([(a, ["1"]), (b.add("z", "integer"), ["2"])], "string")
    assert ok.simpleString() == "struct<Price:double,day:string,extra:string,z:int>"
    with pytest.raises(ValueError):
        unify([], "drop")


def test_text_of_a_schema_is_canonical():
    a = T.StructType([T.StructField("x", T.IntegerType(), False, {"k": 1})])
    b = T.StructType([T.StructField("x", T.IntegerType(), True)])
    assert schema_text(a) == schema_text(b) and schema_from_text(schema_text(a)) == b


def test_conform_nested(spark):
    df = spark.createDataFrame([(1, (1, "a"), [(1, 2)], {"k": 1}), (2, None, None, None)],
                               "a.b int, s struct<x:int,y:string>, l array<struct<p:int,q:int>>, m map<string,int>"
                               .replace("a.b", "`a.b`"))
    want = T.StructType.fromDDL("`a.b` bigint, s struct<y:string,z:double,x:double>, l array<struct<q:bigint,p:int>>, "
                                "m map<string,double>, gone date")
    out = conform(df, want)
    assert out.schema.simpleString() == want.simpleString()
    rows = [r.asDict(True) for r in out.collect()]
    assert rows[0] == {"a.b": 1, "s": {"y": "a", "z": None, "x": 1.0}, "l": [{"q": 2, "p": 1}], "m": {"k": 1.0},
                       "gone": None}
    assert rows[1] == {"a.b": 2, "s": None, "l": None, "m": None, "gone": None}


def days(tmp_dir, spark, bodies, **kw):
    cfg = JobConfig(base_uri=tmp_dir, input_uri="", **kw)
    for date, body in bodies.items():
        src = write_files(os.path.join(tmp_dir, "raw", date, str(len(os.listdir(tmp_dir)))), {"a.csv": body})
        cols = tuple(c for c in ("price", "seller", "status") if c in body.split("\n")[0])
        run_job(spark, replace(cfg, input_uri=src, columns=cols).with_date(date), log=None)
    return cfg


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


DRIFT = {"20240101": "price,seller,status\n1,a,ok\n2,,\n", "20240102": "price,seller,status\n1.5,7,ok\n",
         "20240103": "price,status\n3,ok\n", "20240104": "price,seller,status\n4,x,ok\n"}


def test_int_double_and_missing_column(spark, tmp_dir):
    bodies = DRIFT | {"20240102": "price,seller,status\n1.5,b,ok\n"}
    cfg = days(tmp_dir, spark, bodies)
    df = read_published(spark, cfg.output_base, cfg.audit_path)
    assert dict(df.dtypes) == {"price": "double", "seller": "string", "status": "string", "run_date": "string",
                               "attempt": "string"}
    assert rows_of(df.select("run_date", "price", "seller", "status")) == sorted([
        ("20240101", 1.0, "a", "ok"), ("20240101", 2.0, None, None), ("20240102", 1.5, "b", "ok"),
        ("20240103", 3.0, None, "ok"), ("20240104", 4.0, "x", "ok")], key=repr)
    assert scans(df) == 3  # 20240101 and 20240104 share one
    pruned = df.filter(F.col("run_date") == "20240101").select("price").filter("price > 1")
    assert [r.price for r in pruned.collect()] == [2.0]
    assert df.count() == 5


def plan_of(df):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def scans(df):
    return len([line for line in plan_of(df).split("\n\n\n")[0].splitlines() if "Scan parquet" in line])


def test_filters_reach_scans_that_need_no_cast(spark, tmp_dir):
    cfg = days(tmp_dir, spark, {"20240101": "price,seller,status\n1,a,ok\n", "20240102": "price,seller,status\n1.5,b,ok\n"})
    df = read_published(spark, cfg.output_base, cfg.audit_path).filter("price > 1.2 and status = 'ok'").select("price")
    plan = plan_of(df)
    assert plan.count("EqualTo(status,ok)") == 2 and "GreaterThan(price,1.2)" in plan
    assert "seller" not in plan.replace("seller#", "")


def test_incompatible_pair_names_the_dates(spark, tmp_dir):
    cfg = days(tmp_dir, spark, DRIFT)
    with pytest.raises(IncompatibleSchemasError, match="seller: string on 20240101, 20240104, int on 20240102"):
        read_published(spark, cfg.output_base, cfg.audit_path)
    text = read_published(spark, cfg.output_base, cfg.audit_path, on_conflict="string")
    assert ("20240102", 1.5, "7") in rows_of(text.select("run_date", "price", "seller"))
    given_ = read_published(spark, cfg.output_base, cfg.audit_path, T.StructType.fromDDL("price double, status string"))
    assert given_.columns == ["price", "status", "run_date", "attempt"] and given_.count() == 5
    history = {(r["column"], r["type"], r["n_attempts"], r["first_date"], r["last_date"])
               for r in schema_history(spark, cfg.audit_path).collect()}
    assert ("seller", "string", 2, "20240101", "20240104") in history and ("seller", "integer", 1, "20240102", "20240102") in history


def test_columns_without_a_value_are_no_conflict(spark, tmp_dir):
    """Inference calls an empty column text."""
    cfg = days(tmp_dir, spark, {"20240101": "price,seller,status\n1,a,ok\n", "20240102": "price,seller,status\n,b,ok\n"})
    for rule in ("error", "string"):
        df = read_published(spark, cfg.output_base, cfg.audit_path, on_conflict=rule)
        assert dict(df.dtypes)["price"] == "int"
        assert rows_of(df.select("run_date", "price", "seller")) == [("20240101", 1, "a"), ("20240102", None, "b")]


def test_lazy_reader_falls_back_on_different_schemas(spark, tmp_dir):
    cfg = days(tmp_dir, spark, {k: v for k, v in DRIFT.items() if k != "20240102"})
    lazy = read_published(spark, cfg.output_base, cfg.audit_path, exact_paths=False)
    assert lazy.count() == 4 and scans(lazy) == 2


def test_all_attempts_and_overwritten(spark, tmp_dir):
    one = {"20240101": "price,seller,status\n1,a,ok\n", "20240102": "price,seller,status\n1.5,b,ok\n"}
    cfg = days(tmp_dir, spark, one)
    again = write_files(os.path.join(tmp_dir, "more"), {"a.csv": "price,seller,status\n9,a,ok\n"})
    run_job(spark, replace(cfg, input_uri=again).with_date("20240102"), log=None)
    both = read_all_attempts(spark, cfg.output_base, cfg.audit_path)
    assert sorted(r.price for r in both.collect()) == [1.0, 1.5, 9.0]
    assert sorted(r.price for r in read_published(spark, cfg.output_base, cfg.audit_path).collect()) == [1, 9]
    over = os.path.join(tmp_dir, "over")
    os.makedirs(over)
    cfg = days(over, spark, one, layout="overwrite")
    got = read_overwritten(spark, cfg.output_base, cfg.audit_path)
    assert rows_of(got.select("run_date", "price")) == [("20240101", 1.0), ("20240102", 1.5)]


def test_attempts_recorded_without_schema(spark, tmp_dir):
    cfg = days(tmp_dir, spark, {"20240101": "price,seller,status\n1,a,ok\n", "20240102": "price,seller,status\n1.5,b,ok\n"})
    rows = [r.asDict() | {"schema": None} for r in read_audit(spark, cfg.audit_path).collect()]
    old = os.path.join(tmp_dir, "old-audit")
    for r in rows:
        record_run(spark, old, [tuple(r.values())])
    assert sorted(r.price for r in read_published(spark, cfg.output_base, old).collect()) == [1.0, 1.5]


def test_backfill_records_its_schema(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "ts,price\n2024-01-01 00:00:00,1\n2024-01-02 00:00:00,2\n"})
    cfg = JobConfig(base_uri=tmp_dir, input_uri=src, columns=("price",))
    run_range(spark, cfg, ["20240101", "20240102"], date_col="ts", log=None)
    other = write_files(os.path.join(tmp_dir, "raw2"), {"a.csv": "ts,price\n2024-01-02 00:00:00,2.5\n"})
    run_range(spark, replace(cfg, input_uri=other), ["20240102"], date_col="ts", log=None)
    got = read_published(spark, cfg.output_base, cfg.audit_path)
    assert rows_of(got.select("run_date", "price")) == [("20240101", 1.0), ("20240102", 2.5)]


def test_nothing_published(spark, tmp_dir):
    assert read_published(spark, f"{tmp_dir}/runs", f"{tmp_dir}/audit").collect() == []
    assert read_overwritten(spark, f"{tmp_dir}/runs", f"{tmp_dir}/audit").collect() == []
