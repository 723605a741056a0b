"""Formats of the count lines the job prints, and the pattern that reads them back."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# The job's log lines.  Existing log readers depend on them.
#   "Input row count : {n}"
#   "Output row count : {n}"
#   "Verification: {n} rows written to {path}"
# Pattern that recognises them (label in group 1, count in group 2):
#   ^(Input row count|Output row count|Verification)\s*:\s*(\d+)
# ---------------------------------------------------------------------------
LOG_PATTERN = r"^(Input row count|Output row count|Verification)\s*:\s*(\d+)"

# Label in the log -> metric name in the parsed table.
METRIC_NAMES = {
    "Input row count": "input_rows",
    "Output row count": "output_rows",
    "Verification": "written_rows",
}


def format_input_count(n: int) -> str:
    return f"Input row count : {n}"


def format_output_count(n: int) -> str:
    return f"Output row count : {n}"


def format_verification(n: int, path: str) -> str:
    return f"Verification: {n} rows written to {path}"


def metric_name(label: str) -> str:
    return METRIC_NAMES[label]
