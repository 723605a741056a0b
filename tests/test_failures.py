"""A task that fails and is retried does not change the observed counts.

Runs in a separate process, because task retries need a ``local[N,F]``
master.  The failure is injected with a test-only UDF (the library has none).
"""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent("""
    import sys
    sys.path.insert(0, {repo!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())

    @F.udf("long")
    def flaky(x):
        ctx = TaskContext.get()
        if ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
            raise RuntimeError("injected task failure")
        return x

    from tidewater.config import JobConfig
    from tidewater.plans.job import publish_frame
    from tidewater.session import scratch_path
    df = spark.range(0, 10000, numPartitions=4).select(
        flaky("id").alias("id"), (F.col("id") % 7).cast("string").alias("v"))
    for rebalance in (False, True):
        cfg = JobConfig(base_uri=scratch_path(spark, "failures"), run_date="20240101",
                        rebalance=rebalance)
        res = publish_frame(spark, df, cfg, log=None)
        print("RESULT", rebalance, res.status, res.output_rows, res.written_rows)
""")


def test_task_retry_keeps_counts_exact():
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], capture_output=True,
                         text=True, timeout=600)
    lines = [l for l in out.stdout.splitlines() if l.startswith("RESULT")]
    assert lines == ["RESULT False VERIFIED 10000 10000", "RESULT True VERIFIED 10000 10000"], \
        out.stdout[-2000:] + out.stderr[-2000:]
    assert "injected task failure" in out.stderr
