"""Queries of this subpackage against their DuckDB SQL, whole tables."""

import os

import duckdb
import pytest

from tidewater.llm.oracles import ORACLE_SQL
from tidewater.llm.queries import QUERIES

SF_DIR = os.environ.get("TIDEWATER_ORACLE_SF_DIR", "/root/testdata/sf0.001")
NAMES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE"}


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    rel = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    exp = [dict(zip(cols, r)) for r in rel.fetchall()]
    df = QUERIES[name](spark, SF_DIR)
    got = [r.asDict() for r in df.collect()]
    assert {c: NAMES.get(t, t) for c, t in df.dtypes} == kinds
    key = sorted(cols)
    assert sorted(tuple(_norm(r[c]) for c in key) for r in got) == \
        sorted(tuple(_norm(r[c]) for c in key) for r in exp)
