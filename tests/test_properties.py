"""Property-based checks against plain-Python models (small random frames)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewater.operators.mirror import mirror_apply, mirror_diff
from tidewater.operators.transforms import drop_all_null

SCHEMA = "price DOUBLE, seller INT, status STRING"
prices = st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6, allow_nan=False))
sellers = st.one_of(st.none(), st.integers(-5, 5))
statuses = st.one_of(st.none(), st.sampled_from(["", " ", "ok", "F"]))
rows = st.lists(st.tuples(prices, sellers, statuses), max_size=25)
FAST = settings(max_examples=15, deadline=None, derandomize=True, database=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


def has_value(v):
    return v is not None and not (isinstance(v, float) and math.isnan(v))


def key(r):
    return tuple(("nan" if isinstance(v, float) and math.isnan(v) else repr(v)) for v in r)


@FAST
@given(data=rows)
def test_drop_all_null_model(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted(key(tuple(r)) for r in drop_all_null(df, ["price", "seller", "status"]).collect())
    want = sorted(key(r) for r in data if any(has_value(v) for v in r))
    assert got == want


def unique_by_key(pairs):
    seen = {}
    for k, v in pairs:
        seen.setdefault(k, v)
    return sorted(seen.items())


side = st.lists(st.tuples(st.integers(0, 12), st.one_of(st.none(), st.sampled_from("abc"))),
                max_size=12).map(unique_by_key)


@FAST
@given(src=side, tgt=side, delete=st.booleans())
def test_mirror_model(spark, src, tgt, delete):
    s = spark.createDataFrame(src, "k INT, v STRING")
    t = spark.createDataFrame(tgt, "k INT, v STRING")
    sd, td = dict(src), dict(tgt)
    want_diff = {}
    for k in sd.keys() | td.keys():
        if k not in td:
            want_diff[k] = (sd[k], "insert")
        elif k not in sd:
            want_diff[k] = (td[k], "delete")
        else:
            want_diff[k] = (sd[k], "same" if sd[k] == td[k] else "update")
    got = {r["k"]: (r["v"], r["change"]) for r in mirror_diff(s, t, "k").collect()}
    assert got == want_diff
    applied = sorted(tuple(r) for r in mirror_apply(s, t, "k", delete=delete).collect())
    want = dict(sd)
    if not delete:
        for k, v in td.items():
            want.setdefault(k, v)
    assert applied == sorted(want.items())
