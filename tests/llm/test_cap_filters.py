"""Near vectors against brute force over all pairs of a label."""

import random

import numpy as np
import pytest

from tidewater.llm.cap_filters import Caps, Code, near_vectors


def brute(rows):
    def good(v):
        return v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)

    x = [(np.array(v, float) if good(v) else None, l) for _, v, l in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            (a, la), (b, lb) = x[i], x[j]
            if i != j and a is not None and b is not None and la is not None and la == lb and len(a) == len(b):
                link[i][j] = float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if link[i][j]:
                root[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], sum(link[i]), comp, rows[i][0] == comp))
    return sorted(out, key=repr)


def fixture(dim):
    r = np.random.default_rng(dim)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            v = r.normal(size=dim)
            for k in range(r.integers(1, 6)):
                u = v + r.normal(size=dim) * np.linalg.norm(v) / np.sqrt(dim) * r.choice([0.0, .02, .13, .15, .25])
                rows.append((n, [float(z) for z in np.float32(u)], label))
                n += 1
    hub = r.normal(size=dim)
    for _ in range(90):  # a dense group, larger than a block
        rows.append((n, [float(z) for z in hub + r.normal(size=dim) * .1], 0))
        n += 1
    rows += [(900 + i, rows[0][1], 0) for i in range(40)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [float("nan")] * dim, 0),
             (2004, [None] * dim, 0), (2005, rows[0][1], None), (2006, [float("inf")] + [1.0] * (dim - 1), 0),
             (2007, [-z for z in rows[0][1]], 0), (2008, [z * 3 for z in rows[0][1]], 0), (None, rows[5][1], 0),
             (2009, [1.0, 2.0], 0), (2010, [2.0, 4.0], 0), (7, rows[7][1], rows[7][2])]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [fixture(64), fixture(20), [], [(1, None, None)]],
                         ids=["64", "20", "empty", "null"])
def test_against_brute_force(spark, rows):
    df = spark.createDataFrame([(i, v, l, True) for i, v, l in rows],
                               "vec_id long, embedding array<float>, label int, kept boolean")
    rows = [(i, None if v is None else [None if z is None else float(np.float32(z)) for z in v], l) for i, v, l in rows]
    got = near_vectors(df, Caps(block=32)).collect()
    assert sorted([tuple(x) for x in got], key=repr) == brute(rows)


@pytest.mark.parametrize("vectors", [500, 100_000, 5_000_000])
def test_every_vector_is_listed_and_near_ones_meet(vectors):
    p, r = Caps(), np.random.default_rng(11)
    x = r.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = r.normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = .9801 * x + np.sqrt(1 - .9801 ** 2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    missed = np.ones(len(x), dtype=bool)
    for k in range(p.codes):
        code = Code(p, 64, vectors, k)
        a, b = code.decode(x), code.decode(y)
        assert min(map(len, a + b)) >= p.fewest and all((np.diff(z) > 0).all() for z in a)
        missed &= [not np.isin(i, j).any() for i, j in zip(a, b)]
    assert not missed.any()
