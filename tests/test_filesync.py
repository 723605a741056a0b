"""B2/B3: a table that follows the new, changed and removed files of a folder."""

import os
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from support import write_files
from tidewater.plans import filesync
from tidewater.plans.filesync import (
    compact_synced,
    current_files,
    diff_files,
    list_files,
    read_ledger,
    read_synced,
    sync_files,
    sync_summary,
)
from tidewater.sources.schemas import IncompatibleSchemasError

DDL = "price DOUBLE, seller STRING, status STRING"
HEAD = "price,seller,status\n"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def reload(spark, src, base):
    sync_files(spark, src, base, DDL)
    return rows(read_synced(spark, base))


@pytest.fixture
def src(tmp_dir):
    return write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": HEAD + "1,a,ok\n,,\n", "b.csv": HEAD + "2,b,ok\n3,b,no\n", "c.csv": HEAD + "4,c,ok\n"})


def test_changed_removed_and_new_in_one_sync(spark, src, tmp_dir):
    base = f"{tmp_dir}/table"
    first = sync_files(spark, src, base, DDL)
    assert (first.new, first.changed, first.removed, first.same, first.rows_written, first.rows_retracted) == (3, 0, 0, 0, 4, 0)
    write_files(src, {"b.csv": HEAD + "20,b,ok\n", "d.csv": HEAD + "5,d,ok\n6,d,ok\n"})
    os.remove(os.path.join(src, "c.csv"))
    r = sync_files(spark, src, base, DDL)
    assert (r.new, r.changed, r.removed, r.same, r.rows_written, r.rows_retracted) == (1, 1, 1, 1, 3, 3)
    got = rows(read_synced(spark, base))
    assert got == reload(spark, src, f"{tmp_dir}/full") == [
        (1.0, "a", "ok"), (20.0, "b", "ok"), (5.0, "d", "ok"), (6.0, "d", "ok")]
    summary = {r["sync"]: tuple(r)[1:] for r in sync_summary(spark, base).collect()}
    assert summary == {first.sync: (3, 0, 0, 4), r.sync: (1, 1, 1, 3)}


def test_only_what_differs_is_read(spark, src, tmp_dir, monkeypatch):
    base, seen = f"{tmp_dir}/table", []
    real = filesync._scan
    monkeypatch.setattr(filesync, "_scan", lambda spark, paths, *a: seen.extend(paths) or real(spark, paths, *a))
    sync_files(spark, src, base, DDL)
    assert len(seen) == 3
    seen.clear()
    same = sync_files(spark, src, base, DDL)
    assert same.sync is None and same.same == 3 and not seen
    write_files(src, {"b.csv": HEAD + "7,b,ok\n8,b,no\n9,,\n"})
    sync_files(spark, src, base, DDL)
    assert [p.rsplit("/", 1)[-1] for p in seen] == ["b.csv"]


def test_same_length_other_time(spark, src, tmp_dir):
    base = f"{tmp_dir}/table"
    sync_files(spark, src, base, DDL)
    write_files(src, {"c.csv": HEAD + "9,c,ok\n"})
    os.utime(os.path.join(src, "c.csv"), (1, 1))
    assert sync_files(spark, src, base, DDL).changed == 1
    assert (9.0, "c", "ok") in rows(read_synced(spark, base)) and (4.0, "c", "ok") not in rows(read_synced(spark, base))


def test_a_file_comes_back(spark, src, tmp_dir):
    base, path = f"{tmp_dir}/table", os.path.join(src, "c.csv")
    sync_files(spark, src, base, DDL)
    shutil.copy2(path, f"{tmp_dir}/c")
    os.remove(path)
    sync_files(spark, src, base, DDL)
    assert len(rows(read_synced(spark, base))) == 3
    shutil.copy2(f"{tmp_dir}/c", path)
    assert sync_files(spark, src, base, DDL).new == 1
    assert rows(read_synced(spark, base)) == reload(spark, src, f"{tmp_dir}/full")


def test_all_files_removed_and_folder_missing(spark, src, tmp_dir):
    base = f"{tmp_dir}/table"
    sync_files(spark, src, base, DDL)
    for name in "abc":
        os.remove(os.path.join(src, f"{name}.csv"))
    r = sync_files(spark, src, base, DDL)
    assert (r.removed, r.rows_retracted) == (3, 4)
    schema = read_synced(spark, f"{tmp_dir}/none", None).schema
    assert rows(read_synced(spark, base)) == [] and len(schema) == 0
    os.rmdir(src)
    with pytest.raises(AnalysisException):
        sync_files(spark, src, base, DDL)


def test_half_written_sync_is_not_seen(spark, src, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/table"
    sync_files(spark, src, base, DDL)
    before = rows(read_synced(spark, base))
    write_files(src, {"a.csv": HEAD + "100,a,ok\n1,,\n"})

    def fail(schema):
        raise RuntimeError("driver lost")
    monkeypatch.setattr(filesync, "schema_text", fail)
    with pytest.raises(RuntimeError):
        sync_files(spark, src, base, DDL)
    monkeypatch.undo()
    assert len(os.listdir(f"{base}/rows")) == 2 and rows(read_synced(spark, base)) == before
    assert sync_files(spark, src, base, DDL).changed == 1
    assert rows(read_synced(spark, base)) == reload(spark, src, f"{tmp_dir}/full")


def test_types_and_headers_may_change(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw"), {"a.csv": HEAD + "1,7,ok\n"})
    base = f"{tmp_dir}/table"
    sync_files(spark, src, base, by_header=True)
    write_files(src, {"b.csv": "status,price,seller\nok,2.5,8\n"})
    sync_files(spark, src, base, by_header=True)
    got = read_synced(spark, base, file_col="file")
    assert dict(got.dtypes)["price"] == "double"
    assert sorted((r["price"], r["seller"], r["file"].rsplit("/", 1)[-1]) for r in got.collect()) == [
        (1.0, 7, "a.csv"), (2.5, 8, "b.csv")]
    write_files(src, {"c.csv": HEAD + "3,x,ok\n"})
    sync_files(spark, src, base, by_header=True)
    with pytest.raises(IncompatibleSchemasError):
        read_synced(spark, base)
    assert read_synced(spark, base, on_conflict="string").count() == 3


def test_compaction(spark, src, tmp_dir):
    base = f"{tmp_dir}/table"
    assert compact_synced(spark, base) is None
    sync_files(spark, src, base, DDL)
    write_files(src, {"b.csv": HEAD + "20,b,ok\n"})
    sync_files(spark, src, base, DDL)
    before = rows(read_synced(spark, base))
    sync = compact_synced(spark, base)
    assert rows(read_synced(spark, base)) == before
    assert {r["sync"] for r in current_files(spark, base).collect()} == {sync}
    assert "left_anti" not in read_synced(spark, base)._jdf.queryExecution().toString().lower().replace("leftanti", "left_anti")
    assert sync_files(spark, src, base, DDL).sync is None
    write_files(src, {"b.csv": HEAD + "21,b,ok\n1,b,ok\n"})
    sync_files(spark, src, base, DDL)
    assert rows(read_synced(spark, base)) == reload(spark, src, f"{tmp_dir}/full")
    compact_synced(spark, base)
    assert rows(read_synced(spark, base)) == reload(spark, src, f"{tmp_dir}/full2")


def test_sync_that_lands_during_a_compaction_stays(spark, src, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/table"
    sync_files(spark, src, base, DDL)
    real = filesync.read_synced

    def late(*args, **kw):
        df = real(*args, **kw)
        monkeypatch.setattr(filesync, "read_synced", real)
        write_files(src, {"b.csv": HEAD + "99,b,ok\n"})
        os.remove(os.path.join(src, "c.csv"))
        sync_files(spark, src, base, DDL)  # its id is later than the compaction's, then earlier
        return df
    for early in (False, True):
        monkeypatch.setattr(filesync, "read_synced", late)
        if early:
            ids = iter(["99990101T000000000000-late", "99980101T000000000000-sync"])
            monkeypatch.setattr(filesync, "new_attempt_id", lambda: next(ids))
            write_files(src, {"c.csv": HEAD + "4,c,ok\n", "b.csv": HEAD + "1,b,ok\n2,b,ok\n"})
        compact_synced(spark, base)
        monkeypatch.undo()
        assert rows(read_synced(spark, base)) == reload(spark, src, f"{tmp_dir}/full{early}")


def test_diff_and_listing(spark, src, tmp_dir):
    write_files(src, {"sub/z.csv": HEAD, "note.txt": "x"})
    assert list_files(spark, src).count() == 4 and list_files(spark, src, recursive=True, glob="*.csv").count() == 4
    plan = list_files(spark, src)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    listing = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("n", 1, 1)], "path string, length bigint, modified bigint")
    held = spark.createDataFrame([("a", 1, 1, 5), ("b", 2, 1, 6), ("r", 1, 1, 7)],
                                 "path string, length bigint, modified bigint, rows bigint")
    got = {r["path"]: (r["state"], r["old_rows"]) for r in diff_files(listing, held).collect()}
    assert got == {"a": ("same", 5), "b": ("changed", 6), "n": ("new", None), "r": ("removed", 7)}
    assert read_ledger(spark, f"{tmp_dir}/none").collect() == []


def test_names_that_patterns_and_urls_use(spark, tmp_dir):
    src = write_files(os.path.join(tmp_dir, "raw x"), {"a b+c%20,[d].csv": HEAD + "1,a,ok\n", "é*.csv": HEAD + "2,b,ok\n"})
    base = f"{tmp_dir}/table"
    assert sync_files(spark, src, base, DDL).rows_written == 2
    assert sync_files(spark, src, base, DDL).same == 2
    assert read_synced(spark, base).filter(F.col("price") > 1).count() == 1
