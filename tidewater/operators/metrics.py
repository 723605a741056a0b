"""A4 run metrics via observed aggregates, A9 non-empty gate."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

STATUS_VERIFIED = "VERIFIED"
STATUS_EMPTY = "EMPTY"
STATUS_MISMATCH = "MISMATCH"
STATUS_FAILED = "FAILED"
STATUS_RUNNING = "RUNNING"
STATUS_TIMED_OUT = "TIMED_OUT"
STATUSES = (STATUS_VERIFIED, STATUS_EMPTY, STATUS_MISMATCH, STATUS_FAILED, STATUS_RUNNING, STATUS_TIMED_OUT)


class EmptyRunError(RuntimeError):
    """The run wrote no rows (the job must fail so that it is retried)."""


class RunCheckError(RuntimeError):
    """The run wrote a different number of rows than it produced."""


class RunTimeoutError(RuntimeError):
    """The run outlived its lease; what it wrote is not published."""


def observe_rows(df: DataFrame, name: str, *extra) -> tuple[DataFrame, Observation]:
    """Attach a row counter to ``df``.

    The count is computed by whatever action runs on ``df`` (the write), so it
    costs no extra pass; read it with ``obs.get["rows"]`` after the action.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows"), *extra), obs


@dataclass
class RunMetrics:
    """Counts of one run; ``status`` classifies them (see :func:`classify`)."""

    input_rows: int | None
    output_rows: int | None
    written_rows: int
    bad_rows: int | None = None

    @property
    def status(self) -> str:
        return classify(self.output_rows, self.written_rows)

    def as_dict(self) -> dict:
        return {**asdict(self), "status": self.status}


def classify(output_rows: int | None, written_rows: int) -> str:
    """VERIFIED: rows written and as many as produced; EMPTY: none written;
    MISMATCH: written differs from produced.  The read-back count is the
    authority, the observed count is the check against it."""
    if output_rows is not None and output_rows != written_rows:
        return STATUS_MISMATCH
    if written_rows == 0:
        return STATUS_EMPTY
    return STATUS_VERIFIED


def require_non_empty(metrics: RunMetrics, where: str = "") -> RunMetrics:
    """Raise unless the run is VERIFIED (an empty run fails)."""
    status = metrics.status
    if status == STATUS_EMPTY:
        place = f" at {where}" if where else ""
        raise EmptyRunError(f"the run wrote no rows{place}")
    if status == STATUS_MISMATCH:
        raise RunCheckError(
            f"produced {metrics.output_rows} rows but {metrics.written_rows} were written"
        )
    return metrics
