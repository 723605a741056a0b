"""Near-duplicates against brute force over all pairs of full shingle sets."""

import random
import re

import pytest

from tidewater.llm.near_dup import NearDup, near_duplicates

SCHEMA = "doc_id long, text string, Text string, shard string"


def shingles(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        comp = min(ids) if ids else None
        out.append((i, len(s), comp, i == comp))
    return sorted(out, key=repr)


def fixture_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    base = [word() for _ in range(120)]
    for i in range(230):  # a dense group: more members than a node may have
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(120)] = word()
        rows.append((1000 + i, " ".join(t)))
    for i in range(40):
        t = [word() for _ in range(r.randint(1, 60))]
        rows.append((i, " ".join(t)))
        rows.append((100 + i, "\t".join(t).upper()))
        rows.append((200 + i, " ".join(t[:-1] + [word()])))
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "ONE  two"),
             (303, "one two"), (None, "one two"), (None, "lone row here"), (305, "é" * 50000),
             (306, " ".join(word() for _ in range(30000)))]
    return rows


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    p = NearDup(**kw)
    return sorted([tuple(x) for x in near_duplicates(df, p).collect()], key=repr)


def test_against_brute_force(spark):
    rows = fixture_rows()
    assert got(spark, rows, words=4, node_docs=32) == brute(rows, 4)


def test_five_words(spark):
    rows = fixture_rows()[200:330]
    assert got(spark, rows) == brute(rows, 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)]])
def test_empty(spark, rows):
    assert got(spark, rows) == brute(rows, 5)


def test_alike_equals_pairwise_comparison():
    import numpy as np

    from tidewater.llm.near_dup import SHARED, _alike, similar

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 2 * SHARED).astype(np.uint64))

    def near(n):
        for _ in range(n):
            own = rng.integers(0, 2**63, rng.integers(0, 900)).astype(np.uint64)
            yield np.unique(np.r_[base[rng.random(len(base)) < rng.uniform(0.8, 1)], own])

    a, b = [*near(12), base, base[:3]], [*near(9), base, base[-1:]]
    linked = _alike(a, b, 80)
    assert linked.any() and not linked.all()
    assert linked.tolist() == [[similar(x, y, 80) for y in b] for x in a]
