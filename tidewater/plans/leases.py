"""B4: leases of running attempts.

An attempt with a time limit writes a start record before it does anything else::

    {leases}/{attempt}/{n}/   run_date, attempt, started, expires

Renewals are further records (``n`` = 1, 2, ...) with a later end; the latest end counts.  An
attempt without an audit row is RUNNING until its lease ends and TIMED_OUT after that, so one
that hangs or whose driver was killed shows up without anybody watching it.  A writer that
comes back late finds its lease over and records TIMED_OUT, which readers never see.

Inside the run a timer interrupts the attempt's Spark jobs when the lease ends.  Over Spark
Connect those are told apart by a tag.  A classic session knows tags within a thread only, so
there the timer interrupts the whole session, and only if it was told that the session runs
nothing else (``own_session``); otherwise a hung job keeps hanging, but is TIMED_OUT.  Clocks:
start, end and the check before publication are by the driver that runs the attempt.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parquet import ATTEMPT, RUN_DATE, _missing_path

LEASE_DDL = f"{RUN_DATE} STRING, {ATTEMPT} STRING, started TIMESTAMP, expires TIMESTAMP"


def _micros() -> int:
    return time.time_ns() // 1000


class Lease:
    """The lease of one attempt over its run dates.  As a context manager it interrupts the
    Spark jobs started inside when it ends, and renews itself every ``renew_every`` seconds if given."""

    def __init__(self, spark: SparkSession, leases_path: str, attempt: str, run_dates: Iterable[str], seconds: float,
                 renew_every: float | None = None, own_session: bool = False):
        if seconds <= 0:
            raise ValueError("a lease lasts more than 0 seconds")
        self.spark, self.path, self.attempt = spark, f"{leases_path.rstrip('/')}/{attempt}", attempt
        self.dates, self.seconds, self.renew_every = list(run_dates), seconds, renew_every
        self.own_session = own_session
        self.started, self.renewals = _micros(), 0
        self.expires = self.started + int(seconds * 1e6)
        self._timers: list[threading.Timer] = []
        self._over = False
        self._record()

    def _record(self) -> None:
        rows = self.spark.createDataFrame([(d,) for d in self.dates], f"{RUN_DATE} STRING")
        (rows.select(RUN_DATE, F.lit(self.attempt).alias(ATTEMPT),
                     F.timestamp_micros(F.lit(self.started)).alias("started"),
                     F.timestamp_micros(F.lit(self.expires)).alias("expires"))
             .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.renewals}"))

    def expired(self) -> bool:
        return _micros() > self.expires

    def renew(self) -> None:
        """Move the end to ``seconds`` from now.  An expired lease stays expired: others may
        have acted on it."""
        if self.expired():
            return
        self.renewals += 1
        self.expires = _micros() + int(self.seconds * 1e6)
        self._record()

    def _later(self, seconds: float, what) -> None:
        timer = threading.Timer(max(0.0, seconds), what)
        timer.daemon = True
        self._timers = [t for t in self._timers if t.is_alive()] + [timer]
        timer.start()

    def _watch(self) -> None:
        if self._over:
            return
        left = (self.expires - _micros()) / 1e6
        if left > 0:
            self._later(left + 0.001, self._watch)
        else:
            if not self.spark.interruptTag(self.attempt) and self.own_session:
                self.spark.interruptAll()

    def _beat(self) -> None:
        if not self._over and not self.expired():
            self.renew()
            self._later(self.renew_every, self._beat)

    def __enter__(self) -> "Lease":
        self.spark.addTag(self.attempt)
        self._watch()
        if self.renew_every:
            self._later(self.renew_every, self._beat)
        return self

    def __exit__(self, *exc) -> None:
        self._over = True
        for timer in self._timers:
            timer.cancel()
        self.spark.removeTag(self.attempt)


def read_leases(spark: SparkSession, leases_path: str) -> DataFrame:
    """``run_date, attempt, started, expires`` (the latest end) of every attempt with a lease."""
    try:
        held = spark.read.schema(LEASE_DDL).option("recursiveFileLookup", True).parquet(leases_path)
        held.schema  # a missing folder surfaces here
    except AnalysisException as exc:
        if not _missing_path(exc):
            raise
        held = spark.createDataFrame([], LEASE_DDL)
    return held.groupBy(RUN_DATE, ATTEMPT).agg(F.min("started").alias("started"), F.max("expires").alias("expires"))
