"""B2 stream ingest, B3 mirror, B5 job-log metrics."""

import os
import time

import pytest

from support import SF001, write_files
from tidewater.config import JobConfig
from tidewater.operators.mirror import MirrorKeyError, change_counts, mirror_apply, mirror_diff
from tidewater.plans import inputs
from tidewater.plans.job import run_job
from tidewater.sources.logs import parse_job_logs, read_run_logs
from tidewater.streaming.ingest import ingest_stream, read_ingested

SCHEMA = "price DOUBLE, seller STRING, status STRING"


def test_mirror_fixture(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b2"), (4, None)], "k INT, v STRING")
    tgt = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "k INT, v STRING")
    diff = {r["k"]: (r["v"], r["change"]) for r in mirror_diff(src, tgt, "k").collect()}
    assert diff == {1: ("a", "same"), 2: ("b2", "update"), 3: ("c", "delete"), 4: (None, "same")}
    synced = sorted(tuple(r) for r in mirror_apply(src, tgt, "k").collect())
    assert synced == sorted(tuple(r) for r in src.collect())
    kept = sorted(tuple(r) for r in mirror_apply(src, tgt, "k", delete=False).collect())
    assert kept == [(1, "a"), (2, "b2"), (3, "c"), (4, None)]


def test_mirror_applied_equals_source_on_table(spark):
    from tidewater.queries import mirror_sides
    src, tgt = mirror_sides(spark, SF001)
    applied = mirror_apply(src, tgt, ["c_custkey"])
    assert applied.exceptAll(src).count() == 0 and src.exceptAll(applied).count() == 0
    counts = {r["change"]: r["rows"] for r in change_counts(mirror_diff(src, tgt, "c_custkey")).collect()}
    assert counts["insert"] > 0 and counts["delete"] > 0 and counts["update"] > 0


def test_mirror_rejects_bad_keys(spark):
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k INT, v STRING")
    ok = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    nul = spark.createDataFrame([(None, "a")], "k INT, v STRING")
    with pytest.raises(MirrorKeyError, match="repeated"):
        mirror_diff(dup, ok, "k")
    with pytest.raises(MirrorKeyError, match="null key"):
        mirror_diff(ok, nul, "k")


def test_stream_fixture_and_replay(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    write_files(raw, {"a.csv": "price,seller,status\n1,a,ok\n,,\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="t")
    assert read_ingested(spark, out, "t", SCHEMA).count() == 1
    write_files(raw, {"b.csv": "price,seller,status\n2,b,ok\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="t")
    assert read_ingested(spark, out, "t", SCHEMA).count() == 2
    # a file replaced in place is not read again; a run without new files adds nothing
    time.sleep(1.1)
    write_files(raw, {"a.csv": "price,seller,status\n9,z,ok\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="t")
    assert read_ingested(spark, out, "t", SCHEMA).count() == 2


def test_stream_equals_batch(spark, tmp_dir):
    from tidewater.queries import LINEITEM_CSV_DDL
    csv = inputs.lineitem_csv(spark, SF001)
    cols = ["price", "seller", "status"]
    ingest_stream(spark, csv, f"{tmp_dir}/o", f"{tmp_dir}/c", LINEITEM_CSV_DDL, columns=cols,
                  name="li")
    streamed = read_ingested(spark, f"{tmp_dir}/o", "li", "price DOUBLE, seller INT, status STRING")
    batch = inputs.lineitem_job_rows(spark, SF001).select(*cols).dropna(how="all", subset=cols)
    s = streamed.select(*cols)
    b = batch.select(batch.price, batch.seller.cast("int"), batch.status)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_log_metrics(spark, tmp_dir):
    logs = write_files(os.path.join(tmp_dir, "logs"), {
        "a/driver.log": "Job start\nInput row count : 12\nOutput row count : 10\n"
                        "Verification: 10 rows written to s3a://b/p/20240101/\nnoise 5\n",
        "b/driver.log": "Input row count: 7\n  Output row count : 3\n"})
    got = sorted((os.path.basename(os.path.dirname(r["file"])), r["metric"], r["value"])
                 for r in parse_job_logs(spark, logs).collect())
    assert got == [("a", "input_rows", 12), ("a", "output_rows", 10), ("a", "written_rows", 10),
                   ("b", "input_rows", 7)]


def test_job_keeps_its_log(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,seller,status\n1,a,ok\n,,\n"})
    cfg = JobConfig(base_uri=tmp_dir, input_uri=src, run_date="20240101")
    res = run_job(spark, cfg, log=None, keep_log=True)
    got = sorted((r["run_date"], r["attempt"], r["metric"], r["value"])
                 for r in read_run_logs(spark, cfg.logs_path).collect())
    assert got == sorted([("20240101", res.attempt, "input_rows", 2),
                          ("20240101", res.attempt, "output_rows", 1),
                          ("20240101", res.attempt, "written_rows", 1)])


def test_stream_processing_time_mode(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    write_files(raw, {"a.csv": "price,seller,status\n1,a,ok\n"})
    q = ingest_stream(spark, raw, out, ckpt, SCHEMA, name="live", available_now=False,
                      processing_time="1 second")
    try:
        q.processAllAvailable()
        write_files(raw, {"b.csv": "price,seller,status\n2,b,ok\n,,\n"})
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["price"], r["seller"]) for r in read_ingested(spark, out, "live", SCHEMA).collect())
    assert got == [(1.0, "a"), (2.0, "b")]


def test_mirror_published_as_attempt(spark, tmp_dir):
    from tidewater.plans.audit import read_published
    from tidewater.plans.job import publish_frame
    from tidewater.queries import mirror_sides
    src, tgt = mirror_sides(spark, SF001)
    cfg = JobConfig(base_uri=tmp_dir, run_date="20240201")
    res = publish_frame(spark, mirror_apply(src, tgt, "c_custkey"), cfg, log=None)
    assert res.status == "VERIFIED" and res.written_rows == src.count()
    pub = read_published(spark, cfg.output_base, cfg.audit_path).drop("run_date", "attempt")
    assert pub.exceptAll(src).count() == 0 and src.exceptAll(pub).count() == 0


def test_stream_archives_processed_files(spark, tmp_dir):
    import glob
    raw = os.path.join(tmp_dir, "raw", "in")
    archive = os.path.join(tmp_dir, "archive")
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    write_files(raw, {"a.csv": "price,seller,status\n1,a,ok\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="arch", clean_source="archive",
                  archive_dir=archive)
    write_files(raw, {"b.csv": "price,seller,status\n2,b,ok\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="arch", clean_source="archive",
                  archive_dir=archive)
    assert read_ingested(spark, out, "arch", SCHEMA).count() == 2
    # files of completed batches are moved out of the source folder
    assert glob.glob(os.path.join(archive, "**", "a.csv"), recursive=True)
    with pytest.raises(ValueError):
        ingest_stream(spark, raw, out, ckpt, SCHEMA, name="arch", clean_source="archive")


def test_stream_name_bound_to_checkpoint(spark, tmp_dir):
    from tidewater.streaming.ingest import CheckpointMismatchError
    raw = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,seller,status\n1,a,ok\n"})
    out = os.path.join(tmp_dir, "out")
    ingest_stream(spark, raw, out, os.path.join(tmp_dir, "c1"), SCHEMA, name="s")
    with pytest.raises(CheckpointMismatchError):
        ingest_stream(spark, raw, out, os.path.join(tmp_dir, "c2"), SCHEMA, name="s")
    ingest_stream(spark, raw, out, os.path.join(tmp_dir, "c2"), SCHEMA, name="s2")
    assert read_ingested(spark, out, "s", SCHEMA).count() == 1


def test_log_metrics_unanchored(spark, tmp_dir):
    logs = write_files(os.path.join(tmp_dir, "logs"), {
        "t.log": "[2024-01-01 00:00:01] {pod.py:1} INFO - Input row count : 12\n"
                 "[2024-01-01 00:00:02] {pod.py:1} INFO - Verification: 10 rows written to x\n"})
    anchored = parse_job_logs(spark, logs).count()
    got = sorted((r["metric"], r["value"]) for r in parse_job_logs(spark, logs, anchored=False)
                 .collect())
    assert anchored == 0
    assert got == [("input_rows", 12), ("written_rows", 10)]


def test_replayed_batch_replaces_itself(spark, tmp_dir):
    """A batch written again after a crash (same batch id) is not duplicated."""
    from tidewater.streaming.ingest import _batch_writer
    target = os.path.join(tmp_dir, "stream=t")
    batch = spark.createDataFrame([(1.0, "a", "ok"), (2.0, "b", None)], SCHEMA)
    write = _batch_writer(target)
    write(batch, 0)
    write(spark.createDataFrame([(3.0, "c", "ok")], SCHEMA), 1)
    write(batch, 0)                                   # replay of batch 0
    got = sorted((r["batch_id"], r["price"]) for r in read_ingested(spark, tmp_dir, "t", SCHEMA)
                 .collect())
    assert got == [(0, 1.0), (0, 2.0), (1, 3.0)]


def test_mirror_composite_keys(spark):
    src = spark.createDataFrame([(1, "x", 10), (1, "y", 20), (2, "x", None)], "a INT, b STRING, v INT")
    tgt = spark.createDataFrame([(1, "x", 10), (1, "y", 21), (3, "z", 5)], "a INT, b STRING, v INT")
    got = {(r["a"], r["b"]): r["change"] for r in mirror_diff(src, tgt, ["a", "b"]).collect()}
    assert got == {(1, "x"): "same", (1, "y"): "update", (2, "x"): "insert", (3, "z"): "delete"}
    dup = spark.createDataFrame([(1, "x", 1), (1, "x", 2)], "a INT, b STRING, v INT")
    with pytest.raises(MirrorKeyError):
        mirror_diff(dup, tgt, ["a", "b"])


def test_stream_with_no_files_yet(spark, tmp_dir):
    raw = os.path.join(tmp_dir, "raw")
    os.makedirs(raw)
    out, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="empty")
    assert read_ingested(spark, out, "empty", SCHEMA).count() == 0
    write_files(raw, {"a.csv": "price,seller,status\n1,a,ok\n"})
    ingest_stream(spark, raw, out, ckpt, SCHEMA, name="empty")
    assert read_ingested(spark, out, "empty", SCHEMA).count() == 1
