"""Whitening against numpy's eigenvectors and plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.queries import QUERIES, whitened_rows
from tidewater.llm.whitening import eigenvalues_below, leading_eigenpairs

COLUMNS = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
           "explained": "double", "identity_error": "double"}


def matrices():
    r = np.random.default_rng(3)
    a = r.standard_normal((60, 24))
    q = np.linalg.qr(r.standard_normal((24, 24)))[0]
    yield "plain", a.T @ a
    yield "ties", (q * np.repeat([9.0, 9.0, 4.0, 1.0], 6)) @ q.T
    yield "near ties", (q * (5 + 1e-9 * np.arange(24))) @ q.T
    yield "rank 3", (q[:, :3] * [7.0, 2.0, 1e-3]) @ q[:, :3].T
    yield "one", np.array([[2.5]])
    yield "scales", (q * np.logspace(8, -8, 24)) @ q.T
    yield "zero diagonal", np.array([[0.0, 2.0], [2.0, 0.0]])
    yield "diagonal", np.diag([3.0, 3.0, 2.0, 0.0])


@pytest.mark.parametrize("name,m", list(matrices()))
def test_eigenpairs(name, m):
    m = (m + m.T) / 2
    want = np.linalg.eigvalsh(m)[::-1]
    norm = np.abs(want).max()
    values, vectors = leading_eigenpairs(m, 16)
    k = len(values)
    assert k == min(16, int((want > len(m) * 2.3e-16 * np.abs(m).sum(axis=1).max()).sum()))
    assert np.allclose(values, want[:k], atol=1e-13 * norm, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-12 * norm
    for x in (*((want[:-1] + want[1:]) / 2), want[0] + 1, want[-1] - 1):
        if np.abs(want - x).min() > 1e-12 * norm:
            assert eigenvalues_below(m, float(x)) == int((want < x).sum())


def plain(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(map(len, (v for _, v in good)), key=lambda k: (sum(len(v) == k for _, v in good), k), default=0)
    good = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in good if len(v) == dims]
    fit = sorted({x for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[float(a) - t / n for a, t in zip(x, s)] for x in fit])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    keep = e > dims * 2.3e-16 * np.abs(v).sum(axis=1).max()
    e, q = e[keep], q[:, keep]
    out = {}
    for i, x in good:
        w = np.array([a - t / n for a, t in zip(x, s)]) @ q / np.sqrt(e)
        for k in range(len(e)):
            out.setdefault((i, k + 1), []).append(
                (n, sum((n * a - t) ** 2 for a, t in zip(x, s)), w[k], e[k] / np.trace(v)))
    return out


def same(df, want):
    assert dict(df.dtypes) == COLUMNS
    got = df.collect()
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        rows = want[(r["vec_id"], r["component"])]
        n, dev, w, part = min(rows, key=lambda t: abs(t[1] - r["deviation"]))
        s = sign.setdefault(r["component"], 1.0 if r["whitened"] * w > 0 else -1.0)
        assert (r["n"], r["deviation"]) == (n, dev)
        assert abs(r["whitened"] - s * w) < 1e-6 and abs(r["explained"] - part) < 1e-9
        assert 0 <= r["identity_error"] < 1e-9


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    same(QUERIES["op12_embedding_whitening"](spark, sf), plain([tuple(r) for r in rows]))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", F.lit(1).alias("Embedding"), F.lit(2).alias("vec"), F.lit(3).alias("a.b"))


def test_awkward_rows(spark):
    r = np.random.default_rng(8)
    v = [[float(np.float32(c)) for c in row] for row in r.standard_normal((50, 5)) * [8, 4, 2, 1, 0.5]]
    rows = [(i if i % 7 else None, x) for i, x in enumerate(v)] + [(100 + i, v[i % 3]) for i in range(30)]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5),
             (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (1, v[1]), (1, v[1])]
    same(whitened_rows(frame(spark, rows)), plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = whitened_rows(frame(spark, rows))
    assert dict(df.dtypes) == COLUMNS and df.collect() == []


def test_more_dimensions_than_variance(spark):
    rows = [(i, [float(i), float(-i), 2.0 * i, 1.0]) for i in range(20)]
    same(whitened_rows(frame(spark, rows)), plain(rows))


@pytest.mark.parametrize("seed", range(12))
def test_clusters_within_rounding(seed):
    """Eigenvalues that rounding cannot part: any orthonormal vectors of their space."""
    r = np.random.default_rng(seed)
    d = int(r.choice([2, 5, 16, 33, 64]))
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    e = 1 + 1e-13 * r.standard_normal(d) if seed % 2 else np.where(r.random(d) < .5, 1.0, 1 + 10.0 ** r.uniform(-15, -6, d))
    m = (q * e) @ q.T
    m = (m + m.T) / 2
    values, vectors = leading_eigenpairs(m, 16)
    assert len(values) == min(16, d) and (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:16], atol=1e-11, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-11
