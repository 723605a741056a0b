"""A4, A7-A9, A11, B1, B4, B6: the job, its audit and the published view."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from support import SF001, write_files
from tidewater.config import JobConfig, date_range
from tidewater.operators.metrics import EmptyRunError
from tidewater.plans import inputs
from tidewater.plans.audit import latest_verified, read_audit, read_published, run_status
from tidewater.plans.job import run_job
from tidewater.plans.runs import register_runs, run_range
from tidewater.sources.parquet import read_overwrite_runs, read_runs

COLS = ["price", "seller", "status"]


def cfg_for(tmp_dir, input_uri, **kw):
    return JobConfig(base_uri=tmp_dir, input_uri=input_uri, **kw)


def values(df, cols=COLS):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_job_single_pass_counts(spark, tmp_dir):
    csv = inputs.lineitem_csv(spark, SF001)
    lines = []
    res = run_job(spark, cfg_for(tmp_dir, csv, run_date="20240101"), log=lines.append)
    expected = inputs.lineitem_job_rows(spark, SF001).dropna(how="all", subset=COLS).count()
    assert res.status == "VERIFIED"
    assert res.input_rows == inputs.table(spark, SF001, "lineitem").count()
    assert res.output_rows == res.written_rows == expected
    assert any(l.startswith("Input row count : ") for l in lines)
    assert any(l.startswith("Verification: ") for l in lines)


def test_max_records_per_file(spark, tmp_dir):
    import glob
    body = "".join(f"{i}.0,s{i},ok\n" for i in range(100))
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,seller,status\n" + body})
    res = run_job(spark, cfg_for(tmp_dir, src, max_records_per_file=30), log=None)
    assert res.written_rows == 100
    assert len(glob.glob(os.path.join(res.path, "*.parquet"))) >= 4


def test_declared_schema_counts_bad_rows(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"),
                      {"a.csv": "price,seller,status\nabc,x,ok\n1.0,y,ok\n,,\n"})
    res = run_job(spark, cfg_for(tmp_dir, src, schema="price DOUBLE, seller STRING, status STRING"),
                  log=None)
    assert (res.input_rows, res.bad_rows, res.output_rows, res.written_rows) == (3, 1, 2, 2)
    q = spark.read.parquet(os.path.join(tmp_dir, "quarantine", "run_date=19700101",
                                        f"attempt={res.attempt}")).collect()
    assert [(r["seller"], r["_corrupt_record"]) for r in q] == [("x", "abc,x,ok")]


def test_empty_run_fails_but_keeps_published(spark, tmp_dir):
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    empty = write_files(os.path.join(tmp_dir, "empty"), {"a.csv": "price,seller,status\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240105")
    run_job(spark, cfg, log=None)
    with pytest.raises(EmptyRunError):
        run_job(spark, replace(cfg, input_uri=empty), log=None)
    st = run_status(spark, cfg.audit_path).collect()
    assert [(r["run_date"], r["status"]) for r in st] == [("20240105", "EMPTY")]
    pub = read_published(spark, cfg.output_base, cfg.audit_path)
    assert values(pub) == [(1.0, "a", "ok")]


def test_failed_run_is_audited(spark, tmp_dir):
    bad = write_files(os.path.join(tmp_dir, "bad"), {"a.csv": "price,seller\n1.0,a\n"})
    cfg = cfg_for(tmp_dir, bad, run_date="20240106")
    with pytest.raises(Exception):
        run_job(spark, cfg, log=None)
    row = read_audit(spark, cfg.audit_path).collect()[0]
    assert row["status"] == "FAILED" and "status" in row["error"]


def test_rerun_is_idempotent_for_readers(spark, tmp_dir):
    csv = inputs.lineitem_csv(spark, SF001)
    cfg = cfg_for(tmp_dir, csv, run_date="20240101")
    run_job(spark, cfg, log=None)
    first = values(read_published(spark, cfg.output_base, cfg.audit_path))
    run_job(spark, cfg, log=None)
    assert values(read_published(spark, cfg.output_base, cfg.audit_path)) == first
    assert read_runs(spark, cfg.output_base).select("attempt").distinct().count() == 2
    # the semi-join reader gives the same rows
    semi = read_published(spark, cfg.output_base, cfg.audit_path, exact_paths=False)
    assert values(semi) == first


def test_write_and_read_run(spark, tmp_dir):
    from tidewater.plans.audit import read_run, run_metrics
    from tidewater.sources.parquet import write_run
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240113")
    res = run_job(spark, cfg, log=None)
    assert values(read_run(spark, cfg.output_base, cfg.audit_path, "20240113")) == [(1.0, "a", "ok")]
    m = run_metrics(spark, cfg.audit_path, res.attempt).collect()[0]
    assert (m["input_rows"], m["output_rows"], m["written_rows"], m["status"]) == (1, 1, 1, "VERIFIED")
    with pytest.raises(LookupError):
        read_run(spark, cfg.output_base, cfg.audit_path, "20240114")
    df = spark.createDataFrame([(2.0, "b", "ok")], "price DOUBLE, seller STRING, status STRING")
    path = write_run(df, cfg.output_base, "20240114", attempt="x1")
    assert path.endswith("run_date=20240114/attempt=x1")
    assert spark.read.parquet(path).count() == 1


def test_latest_verified_prefers_latest(spark, tmp_dir):
    a = write_files(os.path.join(tmp_dir, "a"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    b = write_files(os.path.join(tmp_dir, "b"), {"a.csv": "price,seller,status\n2.0,b,ok\n"})
    cfg = cfg_for(tmp_dir, a, run_date="20240107")
    r1 = run_job(spark, cfg, log=None)
    r2 = run_job(spark, replace(cfg, input_uri=b), log=None)
    lv = latest_verified(spark, cfg.audit_path).collect()
    assert [(r["run_date"], r["attempt"]) for r in lv] == [("20240107", r2.attempt)]
    assert r1.attempt < r2.attempt


def test_overwrite_layout_parity(spark, tmp_dir):
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240108", layout="overwrite")
    run_job(spark, cfg, log=None)
    run_job(spark, cfg, log=None)
    df = read_overwrite_runs(spark, cfg.output_base)
    assert values(df, COLS + ["run_date"]) == [(1.0, "a", "ok", "20240108")]
    # the plain read of the folder, as documented for the original layout, fails
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException, match="UNABLE_TO_INFER_SCHEMA"):
        spark.read.parquet(cfg.output_base).schema


def test_backfill_sliced_equals_daily_runs(spark, tmp_dir):
    csv = inputs.events_csv(spark, SF001)
    cols = ("user_id", "event_type", "value")
    cfg = cfg_for(tmp_dir, csv, columns=cols)
    dates = date_range("20240103", "20240106")
    st = {r["run_date"]: r for r in run_range(spark, cfg, dates, date_col="ts", log=None).collect()}
    assert set(st) == set(dates)
    ev = inputs.table(spark, SF001, "events")
    by_day = {r["d"]: r["n"] for r in
              ev.groupBy(F.date_format("ts", "yyyyMMdd").alias("d")).count()
                .withColumnRenamed("count", "n").collect()}
    for d in dates:
        assert st[d]["written_rows"] == by_day.get(d, 0)
        assert st[d]["status"] == ("VERIFIED" if by_day.get(d, 0) else "EMPTY")
    # only the requested dates were written
    runs = read_runs(spark, cfg.output_base)
    assert {r["run_date"] for r in runs.select("run_date").distinct().collect()} <= set(dates)
    # a rerun of a subset leaves the other dates' published rows as they were
    before = values(read_published(spark, cfg.output_base, cfg.audit_path), list(cols) + ["run_date"])
    run_range(spark, cfg, ["20240104"], date_col="ts", log=None)
    after = values(read_published(spark, cfg.output_base, cfg.audit_path), list(cols) + ["run_date"])
    assert before == after


def test_rebalanced_backfill_same_rows(spark, tmp_dir):
    csv = inputs.events_csv(spark, SF001)
    cols = ("user_id", "event_type", "value")
    dates = date_range("20240101", "20240110")
    plain = cfg_for(os.path.join(tmp_dir, "p"), csv, columns=cols)
    reb = replace(cfg_for(os.path.join(tmp_dir, "r"), csv, columns=cols), rebalance=True)
    st_plain = sorted(tuple(r) for r in run_range(spark, plain, dates, "ts", log=None)
                      .select("run_date", "status", "written_rows").collect())
    st_reb = sorted(tuple(r) for r in run_range(spark, reb, dates, "ts", log=None)
                    .select("run_date", "status", "written_rows").collect())
    assert st_plain == st_reb
    a = read_published(spark, plain.output_base, plain.audit_path).drop("attempt")
    b = read_published(spark, reb.output_base, reb.audit_path).drop("attempt")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    res = run_job(spark, replace(reb, run_date="20240101"), log=None)
    assert res.status == "VERIFIED"


def test_backfill_parity_mode(spark, tmp_dir):
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, good)
    st = run_range(spark, cfg, ["20240110", "20240111"], log=None).collect()
    assert sorted((r["run_date"], r["status"]) for r in st) == [
        ("20240110", "VERIFIED"), ("20240111", "VERIFIED")]


def test_register_runs_sql(spark, tmp_dir):
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n2.0,b,\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240112")
    run_job(spark, cfg, log=None)
    views = register_runs(spark, cfg, name="t_runs")
    got = spark.sql(f"SELECT run_date, count(*) AS n FROM {views['runs']} GROUP BY run_date").collect()
    assert [(r["run_date"], r["n"]) for r in got] == [("20240112", 2)]
    st = spark.sql(f"SELECT status FROM {views['status']}").collect()
    assert [r["status"] for r in st] == ["VERIFIED"]


def test_bad_run_date_rejected():
    with pytest.raises(ValueError):
        JobConfig(run_date="2024-01-01")
    with pytest.raises(ValueError):
        JobConfig(run_date="20240230")


def test_overwrite_layout_empty_run_destroys_output(spark, tmp_dir):
    """Parity layout keeps the original behaviour: the overwrite happens before
    the emptiness check, so an empty run replaces good output and then fails."""
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    empty = write_files(os.path.join(tmp_dir, "empty"), {"a.csv": "price,seller,status\n,,\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240115", layout="overwrite")
    run_job(spark, cfg, log=None)
    assert spark.read.parquet(cfg.output_path).count() == 1
    with pytest.raises(EmptyRunError):
        run_job(spark, replace(cfg, input_uri=empty), log=None)
    assert spark.read.parquet(cfg.output_path).count() == 0


def test_run_date_read_as_text(spark, tmp_dir):
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, good, run_date="20240116")
    run_job(spark, cfg, log=None)
    types = dict(read_runs(spark, cfg.output_base).dtypes)
    assert types["run_date"] == "string" and types["attempt"] == "string"


def test_rebalance_splits_hot_date(spark, tmp_dir):
    """One date holding most rows is written by several tasks, not one."""
    import glob
    header = "price,seller,status,day\n"
    files = {f"hot{j}.csv": header + "".join(f"{i}.5,s{i},ok,2024-01-01\n" for i in range(750))
             for j in range(4)}
    files["cold.csv"] = header + "".join(f"{i}.5,s{i},ok,2024-01-02\n" for i in range(30))
    src = write_files(os.path.join(tmp_dir, "raw"), files)
    cfg = replace(cfg_for(tmp_dir, src), rebalance=True)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        st = {r["run_date"]: r["written_rows"]
              for r in run_range(spark, cfg, ["20240101", "20240102"], "day", log=None).collect()}
    finally:
        spark.conf.set(key, old)
    assert st == {"20240101": 3000, "20240102": 30}
    hot = glob.glob(os.path.join(cfg.output_base, "run_date=20240101", "attempt=*", "*.parquet"))
    assert len(hot) > 1


def test_backfill_failure_recorded_and_raised(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,seller,day\n1.0,a,2024-01-01\n"})
    cfg = cfg_for(tmp_dir, src)
    with pytest.raises(Exception):
        run_range(spark, cfg, ["20240101", "20240102"], "day", log=None)
    st = sorted((r["run_date"], r["status"]) for r in read_audit(spark, cfg.audit_path).collect())
    assert st == [("20240101", "FAILED"), ("20240102", "FAILED")]


def test_schema_drift_check(spark, tmp_dir):
    from tidewater.plans.job import SchemaDriftError
    day1 = write_files(os.path.join(tmp_dir, "d1"), {"a.csv": "price,seller,status\n1,a,ok\n"})
    day2 = write_files(os.path.join(tmp_dir, "d2"), {"a.csv": "price,seller,status\n1.5,b,ok\n"})
    cfg = cfg_for(tmp_dir, day1, run_date="20240101", check_drift=True)
    run_job(spark, cfg, log=None)                      # price inferred as int
    with pytest.raises(SchemaDriftError, match="price"):
        run_job(spark, replace(cfg, input_uri=day2, run_date="20240102"), log=None)
    st = {r["run_date"]: r["status"] for r in run_status(spark, cfg.audit_path).collect()}
    assert st == {"20240101": "VERIFIED", "20240102": "FAILED"}
    # without the check the run goes through (and the table now mixes types)
    run_job(spark, replace(cfg, input_uri=day2, run_date="20240102", check_drift=False), log=None)


def test_catalog_tables_and_published_view(spark, tmp_dir):
    from tidewater.plans.catalog import register_catalog
    a = write_files(os.path.join(tmp_dir, "a"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    b = write_files(os.path.join(tmp_dir, "b"), {"a.csv": "price,seller,status\n2.0,b,ok\n"})
    cfg = cfg_for(tmp_dir, a, run_date="20240101", catalog_table="tw_runs")
    run_job(spark, replace(cfg, catalog_table=None), log=None)       # before the table exists
    schema = spark.read.parquet(cfg.output_base).drop("run_date", "attempt").schema
    names = register_catalog(spark, cfg, schema)
    run_job(spark, replace(cfg, input_uri=b), log=None)               # added as a partition
    run_job(spark, replace(cfg, input_uri=b, run_date="20240102"), log=None)
    assert spark.sql(f"SELECT count(*) AS n FROM {names['runs']}").first()["n"] == 3
    # a backfill registers each date it wrote
    ev = write_files(os.path.join(tmp_dir, "ev"), {
        "a.csv": "price,seller,status,day\n3.0,c,ok,2024-01-03\n4.0,d,ok,2024-01-04\n"})
    run_range(spark, replace(cfg, input_uri=ev), ["20240103", "20240104", "20240105"], "day",
              log=None)
    assert spark.sql(f"SELECT count(*) AS n FROM {names['runs']}").first()["n"] == 5
    got = sorted(tuple(r) for r in spark.sql(
        f"SELECT run_date, price, seller FROM {names['published']}").collect())
    assert got == [("20240101", 2.0, "b"), ("20240102", 2.0, "b"),
                   ("20240103", 3.0, "c"), ("20240104", 4.0, "d")]
    for t in (names["published"],):
        spark.sql(f"DROP VIEW IF EXISTS {t}")
    for t in (names["runs"], names["audit"]):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_run_with_retries(spark, tmp_dir):
    from tidewater.plans.job import run_with_retries
    empty = write_files(os.path.join(tmp_dir, "empty"), {"a.csv": "price,seller,status\n,,\n"})
    cfg = cfg_for(tmp_dir, empty, run_date="20240120")
    with pytest.raises(EmptyRunError):
        run_with_retries(spark, cfg, retries=1, delay=0, log=None)
    st = [r["status"] for r in read_audit(spark, cfg.audit_path).collect()]
    assert st == ["EMPTY", "EMPTY"]
    good = write_files(os.path.join(tmp_dir, "good"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    res = run_with_retries(spark, replace(cfg, input_uri=good), retries=2, delay=0, log=None)
    assert res.status == "VERIFIED"


def test_backfill_quarantines_bad_rows(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller,status,day\n1.0,a,ok,2024-01-01\nabc,b,ok,2024-01-02\n"})
    cfg = cfg_for(tmp_dir, src, schema="price DOUBLE, seller STRING, status STRING, day DATE")
    st = {r["run_date"]: r["written_rows"] for r in
          run_range(spark, cfg, ["20240101", "20240102"], "day", log=None).collect()}
    assert st == {"20240101": 1, "20240102": 1}        # PERMISSIVE keeps the row, price null
    q = spark.read.parquet(os.path.join(tmp_dir, "quarantine")).collect()
    assert [(r["seller"], r["_corrupt_record"], r["run_date"]) for r in q] == [
        ("b", "abc,b,ok,2024-01-02", "20240102")]


def test_readers_before_any_run(spark, tmp_dir):
    from tidewater.plans.audit import latest_verified
    cfg = cfg_for(tmp_dir, os.path.join(tmp_dir, "raw"))
    assert run_status(spark, cfg.audit_path).count() == 0
    assert latest_verified(spark, cfg.audit_path).count() == 0
    assert read_published(spark, cfg.output_base, cfg.audit_path).count() == 0


def test_backfill_all_dates_empty(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"),
                      {"a.csv": "price,seller,status,day\n1.0,a,ok,2024-03-01\n"})
    st = sorted((r["run_date"], r["status"], r["written_rows"]) for r in
                run_range(spark, cfg_for(tmp_dir, src), ["20240101", "20240102"], "day",
                          log=None).collect())
    assert st == [("20240101", "EMPTY", 0), ("20240102", "EMPTY", 0)]


def test_concurrent_runs_do_not_interfere(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, src)
    dates = ["20240201", "20240202", "20240203"]
    with ThreadPoolExecutor(3) as pool:
        results = list(pool.map(lambda d: run_job(spark, cfg.with_date(d), log=None), dates))
    assert [r.status for r in results] == ["VERIFIED"] * 3
    st = sorted((r["run_date"], r["status"], r["written_rows"])
                for r in run_status(spark, cfg.audit_path).collect())
    assert st == [(d, "VERIFIED", 1) for d in dates]
    assert read_published(spark, cfg.output_base, cfg.audit_path).count() == 3


def test_compact_run(spark, tmp_dir):
    import glob
    from tidewater.plans.job import compact_run
    files = {f"p{i}.csv": "price,seller,status\n" + "".join(f"{i}.{j},s{j},ok\n" for j in range(5))
             for i in range(6)}
    src = write_files(os.path.join(tmp_dir, "raw"), files)
    cfg = cfg_for(tmp_dir, src, run_date="20240125")
    first = run_job(spark, cfg, log=None)
    before = values(read_published(spark, cfg.output_base, cfg.audit_path))
    res = compact_run(spark, cfg, log=None)
    assert res.status == "VERIFIED" and res.written_rows == first.written_rows == 30
    assert values(read_published(spark, cfg.output_base, cfg.audit_path)) == before
    n_old = len(glob.glob(os.path.join(first.path, "*.parquet")))
    n_new = len(glob.glob(os.path.join(res.path, "*.parquet")))
    assert n_new <= n_old


def test_catalog_registered_before_any_run(spark, tmp_dir):
    from pyspark.sql.types import StructType
    from tidewater.plans.catalog import register_catalog
    schema = StructType.fromDDL("price DOUBLE, seller STRING, status STRING")
    a = write_files(os.path.join(tmp_dir, "a"), {"a.csv": "price,seller,status\n1.0,a,ok\n"})
    cfg = cfg_for(tmp_dir, a, run_date="20240101", catalog_table="tw_early", schema=schema)
    names = register_catalog(spark, cfg, schema)
    assert spark.sql(f"SELECT count(*) AS n FROM {names['published']}").first()["n"] == 0
    run_job(spark, cfg, log=None)
    got = [tuple(r) for r in spark.sql(
        f"SELECT run_date, price, seller, status FROM {names['published']}").collect()]
    assert got == [("20240101", 1.0, "a", "ok")]
    spark.sql(f"DROP VIEW IF EXISTS {names['published']}")
    for t in (names["runs"], names["audit"]):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_backfill_per_date_input_counts(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": (
        "price,seller,status,day\n1.0,a,ok,2024-01-01\n,,,2024-01-01\n2.0,b,,2024-01-02\n"
        "3.0,c,ok,2024-02-01\n")})
    plain = {r["run_date"]: (r["input_rows"], r["output_rows"], r["written_rows"]) for r in
             run_range(spark, cfg_for(os.path.join(tmp_dir, "p"), src),
                       ["20240101", "20240102", "20240103"], "day", log=None).collect()}
    assert plain == {"20240101": (None, 1, 1), "20240102": (None, 1, 1), "20240103": (None, 0, 0)}
    cfg = replace(cfg_for(os.path.join(tmp_dir, "c"), src), per_date_input_counts=True)
    counted = {r["run_date"]: (r["input_rows"], r["output_rows"], r["written_rows"]) for r in
               run_range(spark, cfg, ["20240101", "20240102", "20240103"], "day",
                         log=None).collect()}
    assert counted == {"20240101": (2, 1, 1), "20240102": (1, 1, 1), "20240103": (0, 0, 0)}


def test_whole_input_backfill_is_one_job(spark, tmp_dir):
    """Every date gets the whole input, as when the dates run one by one."""
    src = write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller,status\n1.0,a,ok\n,,\nx,b,\n", "b.csv": "price,seller,status\n2.0,c,ok\n"})
    dates = ["20240101", "20240102", "20240103"]
    cfg = cfg_for(os.path.join(tmp_dir, "one"), src, schema="price DOUBLE, seller STRING, status STRING")
    lines = []
    st = run_range(spark, cfg, dates, log=lines.append).collect()
    assert len({r["attempt"] for r in st}) == 1 and "Input row count : 4" in lines
    each = replace(cfg, base_uri=os.path.join(tmp_dir, "each"))
    for d in dates:
        run_job(spark, each.with_date(d), log=None)
    cols = ["run_date", "status", "input_rows", "output_rows", "written_rows"]
    assert values(run_status(spark, cfg.audit_path), cols) == values(run_status(spark, each.audit_path), cols)
    rows = [values(read_published(spark, c.output_base, c.audit_path), ["run_date", *COLS]) for c in (cfg, each)]
    assert rows[0] == rows[1] and len(rows[0]) == 9
    bad = spark.read.parquet(os.path.join(cfg.quarantine_path, f"attempt={st[0]['attempt']}")).collect()
    assert sorted((r["run_date"], r["_corrupt_record"]) for r in bad) == [(d, "x,b,") for d in dates]


def test_whole_input_backfill_empty_and_failed(spark, tmp_dir):
    none = write_files(os.path.join(tmp_dir, "none"), {"a.csv": "price,seller,status\n,,\n"})
    cfg = cfg_for(tmp_dir, none)
    assert [r["status"] for r in run_range(spark, cfg, ["20240101", "20240102"], log=None).collect()] == ["EMPTY"] * 2
    gone = replace(cfg, input_uri=os.path.join(tmp_dir, "nowhere"))
    st = run_range(spark, gone, ["20240103"], log=None).collect()
    assert [(r["run_date"], r["status"]) for r in st] == [("20240103", "FAILED")] and "PATH_NOT_FOUND" in st[0]["error"]
    over = replace(cfg_for(os.path.join(tmp_dir, "over"), none), layout="overwrite")
    assert len(run_range(spark, over, ["20240101", "20240102"], log=None).collect()) == 2
