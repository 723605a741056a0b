"""Command line: a drop-in replacement for the original job script.

    python -m tidewater run                     # one run for $RUN_DATE (env as before)
    python -m tidewater backfill START END [--date-col ts]
    python -m tidewater status                  # latest status per date

Parameters come from the same environment variables as before (see
:mod:`tidewater.config`); ``--schema`` declares the input types, ``--strict``
checks every file's header, ``--layout overwrite`` keeps the old in-place
layout.  The exit status is non-zero unless every run is VERIFIED, so the
scheduler's retry policy keeps working.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from .config import ENV_CONNECT_URL, JobConfig, date_range, s3a_conf
from .operators.metrics import STATUS_VERIFIED
from .plans.audit import run_status
from .plans.job import plan_job, run_with_retries
from .plans.runs import run_range
from .session import get_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewater")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "backfill", "status"):
        s = sub.add_parser(name)
        s.add_argument("--schema", help="declared input schema (DDL)")
        s.add_argument("--strict", action="store_true", help="fail on header mismatch")
        s.add_argument("--by-header", action="store_true",
                       help="map columns by each file's own header, not by position")
        s.add_argument("--check-drift", action="store_true",
                       help="fail if inferred types differ from the published runs")
        s.add_argument("--layout", choices=["attempts", "overwrite"], default="attempts")
        s.add_argument("--time-limit", type=float, default=None,
                       help="seconds an attempt may take before it is TIMED_OUT")
        s.add_argument("--rebalance", action="store_true",
                       help="shuffle the output into files of the advisory size")
        s.add_argument("--max-records-per-file", type=int, default=None)
        s.add_argument("--catalog-table", help="register new attempts in this catalog table")
        if name != "status":
            s.add_argument("--explain", action="store_true",
                           help="print the physical plan of the write and stop")
        s.add_argument("--remote", help=f"Spark Connect URL ('env' reads {ENV_CONNECT_URL})")
        s.add_argument("--preview-input", type=int, default=0,
                       help="input rows to print, like show(n) (the original job printed 5)")
        s.add_argument("--preview-output", type=int, default=0,
                       help="output rows to print (the original job printed 10)")
        if name == "run":
            s.add_argument("--retries", type=int, default=0, help="retries of a failed run")
            s.add_argument("--retry-delay", type=float, default=10.0, help="seconds between tries")
        if name == "backfill":
            s.add_argument("start")
            s.add_argument("end")
            s.add_argument("--date-col", help="date/timestamp column that slices the input")
            s.add_argument("--per-date-input-counts", action="store_true",
                           help="count input rows per date in the same pass")
    return p


def main(argv: list[str] | None = None) -> int:
    """Run the command line; the return value is the exit status."""
    args = _parser().parse_args(argv)
    cfg = JobConfig.from_env(schema=args.schema, strict=args.strict, layout=args.layout,
                             by_header=args.by_header, time_limit=args.time_limit,
                             own_session=not args.remote,
                             check_drift=args.check_drift, rebalance=args.rebalance,
                             max_records_per_file=args.max_records_per_file,
                             catalog_table=args.catalog_table,
                             per_date_input_counts=getattr(args, "per_date_input_counts", False),
                             preview_input=args.preview_input,
                             preview_output=args.preview_output)
    conf = s3a_conf(cfg.endpoint) if cfg.endpoint else {}
    spark = get_session(args.remote, app_name=f"publish-{cfg.run_date}", conf=conf)
    if getattr(args, "explain", False):
        dates = date_range(args.start, args.end) if args.cmd == "backfill" else None
        date_col = args.date_col if args.cmd == "backfill" else None
        plan_job(spark, cfg, date_col, dates).explain("formatted")
        return 0
    if args.cmd == "run":
        run_with_retries(spark, cfg, retries=args.retries, delay=args.retry_delay)
        return 0
    if args.cmd == "backfill":
        rows = run_range(spark, replace(cfg), date_range(args.start, args.end),
                         date_col=args.date_col).collect()  # bounded: one row per date
    else:
        # bounded: one row per run date
        rows = run_status(spark, cfg.audit_path, cfg.leases_path).orderBy("run_date").collect()
    for r in rows:
        print(f"{r['run_date']} {r['status']} written={r['written_rows']}")
    return 0 if all(r["status"] == STATUS_VERIFIED for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main())
