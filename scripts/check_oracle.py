"""Compare every registered query with its SQL oracle (DuckDB) on one scale.

    python scripts/check_oracle.py [sf_dir] [query ...]

Prints one line per query: rows on both sides, whether column names and the
order-insensitive values agree.  Exit status 1 if any query differs.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tidewater.oracles import ORACLE_SQL  # noqa: E402
from tidewater.queries import QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(round(v, 9)))
    if isinstance(v, bool):
        return (1, str(v))
    return (1, str(v))


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT",
                 "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def rows_of(records, cols):
    return sorted(tuple(norm(r[c]) for c in cols) for r in records)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", os.environ.get("CHECK_TZ", "UTC"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = [r.asDict() for r in df.collect()]
            gcols = df.columns
            sec = time.time() - t0
            if name not in ORACLE_SQL:
                print(f"{name:22s} rows={len(got):7d} (no oracle) {sec:6.1f}s")
                continue
            rel = con.execute(ORACLE_SQL[name])
            ocols = [d[0] for d in rel.description]
            otypes = {d[0]: str(d[1]) for d in rel.description}
            stypes = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
            type_diff = {c: (stypes[c], otypes.get(c)) for c in stypes if stypes[c] != otypes.get(c)}
            exp = [dict(zip(ocols, r)) for r in rel.fetchall()]
            same_cols = sorted(gcols) == sorted(ocols)
            cols = sorted(gcols)
            same_vals = same_cols and rows_of(got, cols) == rows_of(exp, cols)
            ok = same_cols and same_vals and len(got) == len(exp) and not type_diff
            bad += not ok
            print(f"{name:22s} rows={len(got):7d}/{len(exp):7d} cols={'ok' if same_cols else 'DIFF'} "
                  f"values={'ok' if same_vals else 'DIFF'} "
                  f"types={'ok' if not type_diff else type_diff} {sec:6.1f}s")
            if not same_cols:
                print("   spark:", gcols, "\n   sql:  ", ocols)
            elif not same_vals:
                g, e = rows_of(got, cols), rows_of(exp, cols)
                print("   first spark-only:", [r for r in g if r not in set(e)][:3])
                print("   first sql-only:  ", [r for r in e if r not in set(g)][:3])
        except Exception as exc:  # report and go on
            bad += 1
            print(f"{name:22s} ERROR {type(exc).__name__}: {str(exc)[:400]}")
    spark.stop()
    print(f"{len(names) - bad}/{len(names)} queries match their oracle on {sf_dir}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
