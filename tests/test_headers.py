"""A1 by header: files whose headers differ."""

import os
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from support import write_files
from tidewater.__main__ import _parser
from tidewater.config import JobConfig
from tidewater.plans.audit import read_published
from tidewater.plans.job import run_job
from tidewater.sources import headers
from tidewater.sources.csv import scan_csv
from tidewater.sources.headers import HeaderError, header_groups, literal_path, scan_by_header
from tidewater.sources.schemas import IncompatibleSchemasError

DDL = "price DOUBLE, seller STRING, status STRING"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


@pytest.fixture
def two(tmp_dir):
    return write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller,status\n1.5,x,ok\n2.5,y,no\n", "b.csv": "seller,price,status\nz,3.5,ok\n"})


def test_columns_go_by_name(spark, two):
    want = [(1.5, "x", "ok"), (2.5, "y", "no"), (3.5, "z", "ok")]
    assert rows(scan_by_header(spark, two), "price", "seller", "status") == want
    assert rows(scan_by_header(spark, two, DDL, quarantine=False)) == want
    assert rows(scan_csv(spark, two, DDL, quarantine=False, by_header=True)) == want
    assert rows(scan_csv(spark, two, DDL, quarantine=False)) != want  # by position


def test_one_scan_per_header(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {
        f"{i}.csv": ("price,seller\n%d,a\n" if i % 2 else '"seller",price\nb,%d\n' if i % 4 else "seller,price\nb,%d\n") % i
        for i in range(12)})
    groups = header_groups(spark, src)
    assert [g[0] for g in groups] == [("seller", "price"), ("price", "seller")]  # quoting is no difference
    assert sorted(len(g[1]) for g in groups) == [6, 6]
    df = scan_by_header(spark, src, "price INT, seller STRING", quarantine=False)
    assert df.filter("price is not null").count() == 12
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2


def test_missing_and_extra_columns(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller\n1,x\n", "b.csv": "status,PRICE,note\nok,2,n\n", "c.csv": "other\nq\n"})
    df = scan_by_header(spark, src, DDL, quarantine=False)
    assert rows(df) == sorted([(1.0, "x", None), (2.0, None, "ok"), (None, None, None)], key=repr)
    more = scan_by_header(spark, src, DDL, quarantine=False, keep_extra=True)
    assert more.columns == ["price", "seller", "status", "note", "other"]
    assert rows(more, "price", "note", "other") == sorted([(1.0, None, None), (2.0, "n", None), (None, None, "q")], key=repr)
    free = scan_by_header(spark, src)
    assert dict(free.dtypes) == {"price": "int", "seller": "string", "status": "string", "note": "string", "other": "string"}
    write_files(src, {"c.csv": "price\n7\n"})
    assert scan_by_header(spark, src, keep_extra=False).columns == ["price"]
    with pytest.raises(HeaderError, match="no column 'status' in .*a.csv"):
        scan_by_header(spark, src, DDL, missing="error")
    with pytest.raises(HeaderError, match="no column"):
        scan_csv(spark, src, DDL, strict=True, by_header=True)
    with pytest.raises(ValueError):
        scan_by_header(spark, src, DDL, missing="skip")


def test_types_widen_or_conflict(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "p,q\n1,1\n", "b.csv": "q,p\nx,1.5\n"})
    with pytest.raises(IncompatibleSchemasError, match="q: int on a.csv, string on b.csv"):
        scan_by_header(spark, src)
    df = scan_by_header(spark, src, on_conflict="string")
    assert dict(df.dtypes) == {"p": "double", "q": "string"} and rows(df) == [(1.0, "1"), (1.5, "x")]


def test_bad_rows_keep_their_text(spark, two):
    write_files(two, {"c.csv": "status,price\nok,abc\nno,4.5\n"})
    got = rows(scan_by_header(spark, two, DDL), "price", "status", "_corrupt_record")
    assert (None, "ok", "ok,abc") in got and (4.5, "no", None) in got and len(got) == 5


def test_header_named_twice(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": "price,price,seller\n1,2,x\n"})
    with pytest.raises(HeaderError, match="'price' is named twice"):
        scan_by_header(spark, src, DDL)


def test_odd_files(spark, tmp_dir):
    """Blank first lines, comments, a byte order mark, carriage returns, empty files, a header
    alone, another separator and names with characters that patterns and URLs use."""
    src = write_files(os.path.join(tmp_dir, "raw"), {
        "blank.csv": "\n  \nseller;price\na;1\n", "comment.csv": "#seller;x\nprice;seller\n2;b\n",
        "bom.csv": "\uFEFFprice;seller\r\n3;c\r\n", "empty.csv": "", "header.csv": "seller;price\n",
        "a b+c%20,[d]{e}*?.csv": "seller;price\ne;5\n"})
    opts = {"sep": ";", "comment": "#"}
    df = scan_by_header(spark, src, "price INT, seller STRING", quarantine=False, options=opts, file_col="file")
    got = rows(df, "price", "seller")
    assert got == [(1, "a"), (2, "b"), (3, "c"), (5, "e")]
    assert any(r.file.endswith("/a b+c%20,[d]{e}*?.csv") for r in df.collect())
    assert rows(scan_by_header(spark, src, options=opts), "price", "seller") == got
    assert literal_path("a[1]") == "a\\[1\\]"


def test_no_header_at_all(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"empty.csv": ""})
    assert scan_by_header(spark, src, DDL).collect() == []
    with pytest.raises(HeaderError):
        scan_by_header(spark, src)


def test_too_many_headers(spark, two, monkeypatch):
    monkeypatch.setattr(headers, "MAX_HEADERS", 1)
    with pytest.raises(HeaderError, match="2 different"):
        scan_by_header(spark, two)


def test_job_by_header(spark, two, tmp_dir):
    write_files(two, {"sub/c.csv": "status,price\n,\n", "sub/d.csv": "seller\nlast\n"})
    cfg = JobConfig(base_uri=tmp_dir, input_uri=two, by_header=True, recursive=True)
    res = run_job(spark, cfg, log=None)
    assert (res.input_rows, res.output_rows) == (5, 4)
    assert rows(read_published(spark, cfg.output_base, cfg.audit_path).select("price", "seller", "status")) == sorted(
        [(1.5, "x", "ok"), (2.5, "y", "no"), (3.5, "z", "ok"), (None, "last", None)], key=repr)
    assert _parser().parse_args(["run", "--by-header"]).by_header


def test_scans_read_the_wanted_columns_only(spark, two):
    df = scan_by_header(spark, two, DDL, quarantine=False).select("price").filter(F.col("price") > 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "seller" not in plan and plan.count("GreaterThan(price,2.0)") == 2


def test_header_pass_hashes_by_file(spark, tmp_dir, capsys):
    """No task sorts its lines to find the first of each file, and more files than are hashed come out right."""
    from tidewater.sources.headers import header_lines
    for i in range(150):
        with open(f"{tmp_dir}/{i:03d} +%.csv", "w") as fh:
            fh.write("\n \n# x\n" + ("a,b\n" if i % 3 else "b,a\n") + "1,2\n0,0\n" * (i % 4))
    with spark_conf(spark, "spark.sql.files.openCostInBytes", "0"):
        found = header_lines(spark, tmp_dir, options={"comment": "#"})
        found.explain()
        plan = capsys.readouterr().out
        assert "SortAggregate" not in plan and "Sort [" not in plan and "ObjectHashAggregate(keys=[file" in plan
        got = {r["header"]: [f.rsplit("/", 1)[1] for f in r["files"]] for r in found.collect()}
    assert got == {h: [f"{i:03d} +%.csv" for i in range(150) if bool(i % 3) == (h == "a,b")] for h in ("a,b", "b,a")}


@contextmanager
def spark_conf(spark, key, value):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)
