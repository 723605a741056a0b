"""A7 compaction as compare-and-publish, B4 leases, B6 current views, B2/B4 batch ledger."""

import os
import shutil
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from support import write_files
from tidewater.config import JobConfig
from tidewater.operators.metrics import EmptyRunError, RunTimeoutError
from tidewater.plans import job as job_module
from tidewater.plans.audit import (
    latest_verified,
    published_attempt,
    read_audit,
    read_published,
    run_status,
)
from tidewater.plans.catalog import register_catalog
from tidewater.plans.job import compact_run, run_job
from tidewater.plans.leases import Lease, read_leases
from tidewater.plans.runs import register_runs, run_range
from tidewater.streaming.ingest import (
    batch_status,
    ingest_stream,
    ledger_path,
    read_ingested,
    read_verified,
)

HEAD = "price,seller,status\n"
DDL = "price DOUBLE, seller STRING, status STRING"


def folder(tmp_dir, name, *lines):
    return write_files(os.path.join(tmp_dir, name), {"a.csv": HEAD + "".join(f"{x}\n" for x in lines)})


def job(tmp_dir, *lines, **kw):
    return JobConfig(base_uri=tmp_dir, input_uri=folder(tmp_dir, "raw", *lines), run_date="20240101", **kw)


def prices(df):
    return sorted(r["price"] for r in df.collect())


def published(spark, cfg):
    return prices(read_published(spark, cfg.output_base, cfg.audit_path))


# -- compaction ------------------------------------------------------------------------------

def test_run_that_lands_during_a_compaction_stays(spark, tmp_dir, monkeypatch):
    cfg = job(tmp_dir, "1.5,a,ok", "2.5,b,ok")
    run_job(spark, cfg, log=None)
    real = job_module.publish_frame

    def late(*args, **kw):
        monkeypatch.setattr(job_module, "publish_frame", real)
        run_job(spark, replace(cfg, input_uri=folder(tmp_dir, "raw2", "9.5,z,ok")), log=None)
        return real(*args, **kw)
    monkeypatch.setattr(job_module, "publish_frame", late)
    res = compact_run(spark, cfg, log=None)
    assert res.status == "VERIFIED" and res.written_rows == 2
    assert published(spark, cfg) == [9.5]
    assert run_status(spark, cfg.audit_path).first()["written_rows"] == 1
    again = compact_run(spark, cfg, log=None)
    assert published(spark, cfg) == [9.5]
    assert latest_verified(spark, cfg.audit_path).first()["attempt"] == again.attempt


def test_chain_of_compactions(spark, tmp_dir):
    cfg = job(tmp_dir, "1.5,a,ok", "2.5,b,ok")
    first = run_job(spark, cfg, log=None)
    for _ in range(3):
        last = compact_run(spark, cfg, log=None)
        assert latest_verified(spark, cfg.audit_path).first()["attempt"] == last.attempt
        attempt, origin, stands = published_attempt(spark, cfg.audit_path, "20240101")
        assert (attempt, origin) == (last.attempt, first.attempt)
    rows = read_audit(spark, cfg.audit_path).select("attempt", "replaces", F.unix_micros("as_of").alias("m")).collect()
    assert {(r["replaces"], r["m"]) for r in rows} == {(None, None), (first.attempt, stands)}
    assert published(spark, cfg) == [1.5, 2.5]
    with pytest.raises(LookupError):
        compact_run(spark, cfg, "20240105", log=None)


def test_two_compactions_at_once_and_an_empty_run(spark, tmp_dir, monkeypatch):
    cfg = job(tmp_dir, "1.5,a,ok")
    run_job(spark, cfg, log=None)
    real = job_module.publish_frame

    def twice(*args, **kw):
        monkeypatch.setattr(job_module, "publish_frame", real)
        compact_run(spark, cfg, log=None)
        return real(*args, **kw)
    monkeypatch.setattr(job_module, "publish_frame", twice)
    compact_run(spark, cfg, log=None)
    assert published(spark, cfg) == [1.5]
    run_job(spark, replace(cfg, input_uri=folder(tmp_dir, "none")), log=None, raise_on_failure=False)
    compact_run(spark, cfg, log=None)
    assert run_status(spark, cfg.audit_path).first()["status"] == "EMPTY"  # the later run, not the compaction
    assert published(spark, cfg) == [1.5]


def test_catalog_view_knows_compactions(spark, tmp_dir):
    cfg = replace(job(tmp_dir, "1.5,a,ok"), catalog_table="tw_compacted")
    names = register_catalog(spark, cfg, spark.createDataFrame([], DDL).schema)
    run_job(spark, cfg, log=None)
    late = replace(cfg, input_uri=folder(tmp_dir, "raw2", "9.5,z,ok"))
    held = published_attempt(spark, cfg.audit_path, "20240101")
    run_job(spark, late, log=None)
    job_module.publish_frame(spark, spark.createDataFrame([(1.5, "a", "ok")], DDL), cfg, log=None, replaces=held[1:])
    spark.sql(f"REFRESH TABLE {names['audit']}")
    assert [r["price"] for r in spark.sql(f"SELECT price FROM {names['published']}").collect()] == [9.5]


def test_old_audit_table_gets_its_columns(spark, tmp_dir):
    cfg = replace(job(tmp_dir, "1.5,a,ok"), catalog_table="tw_old_audit")
    spark.sql(f"CREATE TABLE tw_old_audit_audit (run_date STRING, attempt STRING, status STRING, finished TIMESTAMP) "
              f"USING parquet OPTIONS (recursiveFileLookup 'true') LOCATION '{cfg.audit_path}'")
    register_catalog(spark, cfg, spark.createDataFrame([], DDL).schema)
    assert {"schema", "replaces", "as_of", "error"} <= set(spark.table("tw_old_audit_audit").columns)


# -- leases ------------------------------------------------------------------------------------

def test_killed_run_shows_as_timed_out(spark, tmp_dir):
    cfg = job(tmp_dir, "1.5,a,ok")
    run_job(spark, cfg, log=None)
    Lease(spark, cfg.leases_path, "99990101T0-dead", ["20240101", "20240102"], 12.0)  # its driver dies here
    status = lambda: {r["run_date"]: r["status"] for r in run_status(spark, cfg.audit_path, cfg.leases_path).collect()}
    assert status() == {"20240101": "RUNNING", "20240102": "RUNNING"}
    assert run_status(spark, cfg.audit_path).first()["status"] == "VERIFIED"
    time.sleep(12.5)
    assert status() == {"20240101": "TIMED_OUT", "20240102": "TIMED_OUT"}
    assert published(spark, cfg) == [1.5]
    run_job(spark, cfg, log=None)
    assert status()["20240101"] == "VERIFIED"


def test_run_within_its_limit(spark, tmp_dir):
    cfg = job(tmp_dir, "1.5,a,ok", time_limit=600.0, renew_lease_every=0.2)
    res = run_job(spark, cfg, log=None)
    assert res.status == "VERIFIED" and published(spark, cfg) == [1.5]
    lease = read_leases(spark, cfg.leases_path).first()
    assert lease["attempt"] == res.attempt and (lease["expires"] - lease["started"]).total_seconds() >= 600
    assert len(os.listdir(f"{cfg.leases_path}/{res.attempt}")) > 1  # renewed meanwhile
    rows = run_status(spark, cfg.audit_path, cfg.leases_path).collect()
    assert [r["status"] for r in rows] == ["VERIFIED"]


def test_late_writer_cannot_publish(spark, tmp_dir, monkeypatch):
    cfg = job(tmp_dir, "1.5,a,ok")
    run_job(spark, cfg, log=None)
    real = job_module.write_attempt

    def slow(*args, **kw):
        path = real(*args, **kw)
        time.sleep(4.0)
        return path
    monkeypatch.setattr(job_module, "write_attempt", slow)
    late = replace(cfg, input_uri=folder(tmp_dir, "raw2", "9.5,z,ok"), time_limit=3.0)
    with pytest.raises(RunTimeoutError):
        run_job(spark, late, log=None)
    monkeypatch.undo()
    assert run_status(spark, cfg.audit_path, cfg.leases_path).first()["status"] == "TIMED_OUT"
    assert published(spark, cfg) == [1.5]


def test_hung_job_is_interrupted(spark, tmp_dir, monkeypatch):
    """A Spark job that would take minutes ends with the lease."""
    cfg = job(tmp_dir, "1.5,a,ok", time_limit=8.0, own_session=True)

    def hang(out, *args, **kw):
        spark.range(1, numPartitions=1).select(F.java_method(F.lit("java.lang.Thread"), F.lit("sleep"), F.lit(90_000).cast("bigint"))).collect()
    monkeypatch.setattr(job_module, "write_attempt", hang)
    started = time.time()
    with pytest.raises(RunTimeoutError):
        run_job(spark, cfg, log=None)
    assert time.time() - started < 60
    assert run_status(spark, cfg.audit_path).first()["status"] == "TIMED_OUT"
    monkeypatch.undo()
    assert spark.range(3).count() == 3 and run_job(spark, replace(cfg, time_limit=600.0), log=None).status == "VERIFIED"


def test_lease_rules(spark, tmp_dir):
    with pytest.raises(ValueError):
        Lease(spark, tmp_dir, "a", ["20240101"], 0)
    lease = Lease(spark, f"{tmp_dir}/leases", "a", ["20240101"], 0.05)
    time.sleep(0.1)
    before = lease.expires
    lease.renew()
    assert lease.expired() and lease.expires == before  # an expired lease stays so
    assert read_leases(spark, f"{tmp_dir}/none").collect() == []


def test_backfill_with_a_limit(spark, tmp_dir, monkeypatch):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "ts,price\n2024-01-01 00:00:00,1\n2024-01-02 00:00:00,2\n"})
    cfg = JobConfig(base_uri=tmp_dir, input_uri=src, columns=("price",), time_limit=600.0)
    got = run_range(spark, cfg, ["20240101", "20240102"], date_col="ts", log=None)
    assert {r["status"] for r in got.collect()} == {"VERIFIED"}
    from tidewater.plans import runs
    real = runs.write_attempt_by_date
    monkeypatch.setattr(runs, "write_attempt_by_date", lambda *a, **k: (real(*a, **k), time.sleep(5))[0])
    with pytest.raises(RunTimeoutError):
        run_range(spark, replace(cfg, time_limit=4.0), ["20240101", "20240102"], date_col="ts", log=None)
    status = run_status(spark, cfg.audit_path, cfg.leases_path).collect()
    assert {r["status"] for r in status} == {"TIMED_OUT"} and len(published(spark, cfg)) == 2


# -- views ---------------------------------------------------------------------------------------

def test_views_see_later_runs(spark, tmp_dir):
    cfg = job(tmp_dir, "1.5,a,ok")
    names = register_runs(spark, cfg, "live_runs")
    assert spark.table("live_runs").collect() == [] and spark.table(names["audit"]).collect() == []
    run_job(spark, cfg, log=None)
    sql = "SELECT run_date, price FROM live_runs ORDER BY 1, 2"
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("20240101", 1.5)]
    late = run_job(spark, replace(cfg, input_uri=folder(tmp_dir, "raw2", "9.5,z,ok"), run_date="20240102"), log=None)
    run_job(spark, replace(cfg, input_uri=folder(tmp_dir, "raw3", "7.5,z,ok")), log=None)
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("20240101", 7.5), ("20240102", 9.5)]
    one = spark.sql("SELECT price, attempt FROM live_runs WHERE run_date = '20240102'")
    assert [tuple(r) for r in one.collect()] == [(9.5, late.attempt)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan  # only its folder is listed
    assert spark.table(names["audit"]).count() == 3
    assert {r["run_date"]: r["status"] for r in spark.table(names["status"]).collect()} == {
        "20240101": "VERIFIED", "20240102": "VERIFIED"}
    last = compact_run(spark, cfg, log=None)
    assert {r["attempt"] for r in spark.sql("SELECT attempt FROM live_runs").collect()} == {late.attempt, last.attempt}
    run_job(spark, replace(cfg, input_uri=folder(tmp_dir, "none")), log=None, raise_on_failure=False)
    assert len(spark.sql(sql).collect()) == 2


def test_views_over_changing_types(spark, tmp_dir):
    cfg = job(tmp_dir, "1,a,ok")
    run_job(spark, cfg, log=None)
    register_runs(spark, cfg, "drift_runs")
    sql = "SELECT run_date, price, seller FROM drift_runs ORDER BY 1"
    assert spark.sql(sql).schema["price"].dataType.simpleString() == "int"
    day = lambda d, *lines, **kw: run_job(spark, replace(cfg, input_uri=folder(tmp_dir, d, *lines), run_date=d, **kw), log=None)
    day("20240102", "2.5,b,ok")  # one scan reads both
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("20240101", 1.0, "a"), ("20240102", 2.5, "b")]
    day("20240103", "3.5,c,ok", columns=("price",))
    assert [tuple(r) for r in spark.sql(sql).collect()][-1] == ("20240103", 3.5, None)
    day("20240104", f"{2**40},c,ok")  # a bigint file is no double column: several scans
    got = [tuple(r) for r in spark.sql(sql).collect()]
    assert len(got) == 4 and got[-1] == ("20240104", float(2**40), "c")
    day("20240105", "5.5,e,ok")
    assert len(spark.sql(sql).collect()) == 5


def test_view_names_are_checked(spark, tmp_dir):
    with pytest.raises(ValueError):
        register_runs(spark, job(tmp_dir, "1,a,ok"), "x; DROP TABLE y")


def test_view_with_a_given_schema(spark, tmp_dir):
    cfg = job(tmp_dir, "1,a,ok")
    schema = spark.createDataFrame([], "price DOUBLE, seller STRING, status STRING").schema
    register_runs(spark, cfg, "typed_runs", schema)
    run_job(spark, cfg, log=None)
    assert spark.table("typed_runs").schema["price"].dataType.simpleString() == "double"
    assert spark.sql("SELECT price FROM typed_runs").first()[0] == 1.0


# -- batch ledger ----------------------------------------------------------------------------------

def ingest(spark, tmp_dir, src, **kw):
    return ingest_stream(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ck", DDL, name="s", max_files_per_trigger=1, **kw)


def test_ledger_of_batches(spark, tmp_dir):
    src = os.path.join(tmp_dir, "raw")
    for i, body in enumerate(["1.5,a,ok\n,,\n", ",,\n", "x,b,ok\n2.5,c,ok\n"]):
        write_files(src, {f"{i}.csv": HEAD + body})
        os.utime(os.path.join(src, f"{i}.csv"), (1000 + i, 1000 + i))
    assert batch_status(spark, f"{tmp_dir}/out", "s").collect() == []
    assert read_verified(spark, f"{tmp_dir}/out", "s", DDL).collect() == []
    ingest(spark, tmp_dir, src)
    rows = [tuple(r)[:6] for r in batch_status(spark, f"{tmp_dir}/out", "s").orderBy("batch_id").collect()]
    assert rows == [(0, "VERIFIED", 2, 1, 1, 0), (1, "EMPTY", 1, 0, 0, 0), (2, "VERIFIED", 2, 2, 2, 1)]
    got = read_verified(spark, f"{tmp_dir}/out", "s", DDL)
    assert sorted((r["batch_id"], r["price"], r["seller"]) for r in got.collect() if r["price"]) == [(0, 1.5, "a"), (2, 2.5, "c")]


def test_replayed_batch_has_one_row(spark, tmp_dir):
    """Rows written, ledger and commit lost: the batch is not seen, and runs again."""
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": HEAD + "1.5,a,ok\n"})
    ingest(spark, tmp_dir, src)
    shutil.rmtree(ledger_path(f"{tmp_dir}/out", "s"))
    os.remove(f"{tmp_dir}/ck/commits/0")
    crc = f"{tmp_dir}/ck/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert read_verified(spark, f"{tmp_dir}/out", "s", DDL).collect() == []
    assert read_ingested(spark, f"{tmp_dir}/out", "s", DDL).count() == 1
    for _ in range(2):
        ingest(spark, tmp_dir, src)
        assert [tuple(r)[:5] for r in batch_status(spark, f"{tmp_dir}/out", "s").collect()] == [(0, "VERIFIED", 1, 1, 1)]
        assert prices(read_verified(spark, f"{tmp_dir}/out", "s", DDL)) == [1.5]


def test_batch_that_wrote_another_number(spark, tmp_dir, monkeypatch):
    from tidewater.streaming import ingest as module
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": HEAD + "1.5,a,ok\n"})

    class Metrics(module.RunMetrics):
        def __init__(self, input_rows, output_rows, written_rows, bad_rows=None):
            super().__init__(input_rows, output_rows, written_rows + 1, bad_rows)
    monkeypatch.setattr(module, "RunMetrics", Metrics)
    ingest(spark, tmp_dir, src)
    assert batch_status(spark, f"{tmp_dir}/out", "s").first()["status"] == "MISMATCH"
    assert read_verified(spark, f"{tmp_dir}/out", "s", DDL).collect() == []


def test_fail_on_empty(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": HEAD + ",,\n"})
    with pytest.raises(Exception, match="EmptyRunError"):
        ingest(spark, tmp_dir, src, fail_on_empty=True)
    assert batch_status(spark, f"{tmp_dir}/out", "s").first()["status"] == "EMPTY"
    assert issubclass(EmptyRunError, RuntimeError)
