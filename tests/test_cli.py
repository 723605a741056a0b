"""The command line replaces the original job script and the daily schedule."""

import os

from support import write_files
from tidewater.__main__ import main


def test_cli_run_backfill_status(spark, tmp_dir, monkeypatch, capsys):
    write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller,status,day\n1.0,a,ok,2024-01-01\n,,,2024-01-01\n2.0,b,,2024-01-02\n"})
    monkeypatch.setenv("TIDEWATER_BASE_URI", tmp_dir)
    monkeypatch.setenv("RUN_DATE", "20240101")
    monkeypatch.delenv("MINIO_ENDPOINT", raising=False)
    assert main(["run", "--preview-input", "5", "--preview-output", "10"]) == 0
    out = capsys.readouterr().out
    table = [l.replace(" ", "") for l in out.splitlines() if l.startswith("|")]
    assert "|price|seller|status|day|" in table          # input preview header
    assert "|price|seller|status|" in table              # output preview header
    assert "|1.0|a|ok|" in table and "|2.0|b|NULL|" in table  # as show prints it
    assert "Input row count : 3" in out and "Output row count : 2" in out
    assert "Verification: 2 rows written to" in out
    # 20240103 has no rows -> EMPTY -> non-zero exit
    assert main(["backfill", "20240101", "20240103", "--date-col", "day",
                 "--per-date-input-counts"]) == 1
    out = capsys.readouterr().out
    assert "20240101 VERIFIED written=1" in out
    assert "20240102 VERIFIED written=1" in out
    assert "20240103 EMPTY written=0" in out
    assert main(["status"]) == 1


def test_cli_explain(spark, tmp_dir, monkeypatch, capsys):
    write_files(os.path.join(tmp_dir, "raw"), {
        "a.csv": "price,seller,status,day,other\n1.0,a,ok,2024-01-01,x\n"})
    monkeypatch.setenv("TIDEWATER_BASE_URI", tmp_dir)
    monkeypatch.setenv("RUN_DATE", "20240101")
    assert main(["run", "--explain", "--schema",
                 "price DOUBLE, seller STRING, status STRING, day DATE, other STRING"]) == 0
    out = capsys.readouterr().out
    assert "ReadSchema: struct<price:double,seller:string,status:string,_corrupt_record:string>" in out
    assert main(["backfill", "20240101", "20240102", "--date-col", "day", "--explain"]) == 0
    out = capsys.readouterr().out
    assert "PushedFilters" in out and "GreaterThanOrEqual(day,2024-01-01)" in out
    assert not os.path.exists(os.path.join(tmp_dir, "processed"))
