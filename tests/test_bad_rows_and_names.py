"""Rows that do not parse, rows without a date, awkward mirror names, reused attempt ids."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewater import JobConfig, run_job
from tidewater.operators.mirror import change_counts, mirror_apply, mirror_diff
from tidewater.plans.audit import read_attempt_audit, read_published
from tidewater.plans.runs import run_range
from tidewater.streaming.ingest import ingest_stream, stream_quarantine_path

DDL = "price DOUBLE, seller INT, status STRING, ts TIMESTAMP, qty INT"
LINES = """price,seller,status,ts,qty
1.5,1,a,2024-01-01 10:00:00,1
2.5,2,b,BADTS,2
x,3,c,2024-01-01 11:00:00,3
4.5,4,d,2024-01-02 10:00:00,bad
5.5,5,e,,5
6.5,6,f,2024-03-01 10:00:00,6
"""


@pytest.fixture
def cfg(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(LINES)
    base = JobConfig.from_env({})
    return replace(base, schema=DDL, **paths(base, tmp_path))


def paths(base, tmp_path):
    return {"base_uri": str(tmp_path), "input_prefix": "in", "output_prefix": "out"}


def test_quarantine_holds_what_the_count_says(spark, cfg):
    got = run_job(spark, cfg, log=None)
    bad = spark.read.parquet(cfg.quarantine_path)
    # a bad value in a column that is not kept makes no bad row
    assert got.bad_rows == 1 == bad.count()
    assert bad.first()["_corrupt_record"].startswith("x,3,c")


def test_undated_rows_are_counted_and_kept(spark, cfg):
    lines = []
    out = run_range(spark, cfg, ["20240101", "20240102"], "ts", attempt="A", log=lines.append)
    assert {r["run_date"]: r["written_rows"] for r in out.collect()} == {"20240101": 2, "20240102": 1}
    assert "Undated rows : 2" in "\n".join(lines)
    kept = spark.read.parquet(f"{cfg.quarantine_path}/attempt=A")
    assert sorted(r["seller"] for r in kept.collect()) == [2, 3, 5]


def test_undated_rows_of_an_inferred_input(spark, cfg):
    lines = []
    run_range(spark, replace(cfg, schema=None), ["20240101"], "ts", log=lines.append)
    assert any(x.startswith("Undated rows : 2") for x in lines)


def test_stream_keeps_bad_rows(spark, cfg, tmp_path):
    ingest_stream(spark, cfg.input_path, str(tmp_path / "st"), str(tmp_path / "cp"), DDL,
                  columns=cfg.columns, name="s")
    bad = spark.read.parquet(stream_quarantine_path(str(tmp_path / "st"), "s")).collect()
    assert [r["_corrupt_record"][:5] for r in bad] == ["x,3,c"]


def test_attempt_ids_are_used_once(spark, cfg):
    run_job(spark, cfg, attempt="X", log=None)
    with pytest.raises(ValueError):
        run_job(spark, cfg, attempt="X", log=None)
    assert read_published(spark, cfg.output_base, cfg.audit_path).count() == 6


def test_missing_catalog_table_fails_before_the_write(spark, cfg):
    with pytest.raises(ValueError):
        run_job(spark, replace(cfg, catalog_table="no_such_table"), attempt="Y", log=None)
    assert [r["status"] for r in read_attempt_audit(spark, cfg.audit_path, "Y").collect()] == ["FAILED"]


def test_failing_read_back_is_audited(spark, cfg, monkeypatch):
    from tidewater.plans import runs

    def broken(*a, **k):
        return spark.range(1).select(F.lit("20240101").alias("run_date"),
                                     F.raise_error(F.lit("lost")).cast("long").alias("written_rows"))

    monkeypatch.setattr(runs, "count_attempt_by_date", broken)
    with pytest.raises(Exception):
        run_range(spark, cfg, ["20240101", "20240102"], "ts", attempt="Z", log=None)
    assert [r["status"] for r in read_attempt_audit(spark, cfg.audit_path, "Z").collect()] == ["FAILED"] * 2


def test_mirror_with_awkward_names_and_types(spark):
    src = spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "side INT, n INT, change STRING")
    tgt = spark.createDataFrame([(1, 1, "x"), (3, 1, "z")], "side INT, n INT, change STRING")
    diff = mirror_diff(src, tgt, ["Side", "n"], change_col="what")
    assert diff.columns == ["side", "n", "change", "what"]
    assert {r["what"]: r["rows"] for r in change_counts(diff, "what").collect()} == \
        {"same": 1, "insert": 1, "delete": 1}
    assert mirror_apply(src, tgt, ["side", "n"], delete=False).count() == 3
    with pytest.raises(ValueError):
        mirror_diff(src, tgt, ["side", "n"])
    with pytest.raises(ValueError):
        mirror_apply(src, tgt.withColumn("change", F.lit(1)), ["side", "n"])
