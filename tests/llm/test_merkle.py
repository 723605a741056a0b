"""Merkle manifest against a plain recursion, over small blocks too."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle
from tidewater.llm.queries import QUERIES, merkle_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def leaf_of(r, add=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append(("<" if j < i else ">", level[j]) if j < len(level) else ("=", ""))
        i >>= 1
    return out


def fold(x, steps):
    for side, s in steps:
        x = h(s + x) if side == "<" else h(x + s)
    return x


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    of = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (
        r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for g in langs}
    trees = {g: levels([leaf_of(r) for r in of[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(of[g]):
            steps = siblings(trees[g], i) + siblings(top, k)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = fold(leaf_of(r, 1 if hit else 0), steps)
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], h("".join(s for _, s in steps)), folded,
                        folded == top[-1][0]))
    return out


def same(got, want):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [*range(1, 18), 31, 32, 33, 100])
def test_log_is_postorder(n):
    tree = levels([h(str(i)) for i in range(n)])
    log = merkle.append_log(tree[0], merkle.height(n))
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        at = merkle.positions(level, np.arange(len(nodes)), n)
        assert [log[p] for p in at] == nodes
    seen = set()
    for digest in log:  # children stand before their parent
        if digest not in tree[0]:
            child = next((a, i) for a, lev in enumerate(tree) for i, d in enumerate(lev) if d == digest)
            assert set(tree[child[0] - 1][2 * child[1]:2 * child[1] + 2]) <= seen
        seen.add(digest)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    same(QUERIES["op11_merkle_manifest"](spark, sf).collect(), plain(rows))


@pytest.mark.parametrize("k", [1, 2, 12])
def test_awkward_rows_and_tiers(spark, k):
    """Null fields, ids and groups, repeated rows, a long text, clashing names; with small
    blocks the groups take several tiers."""
    rows = [(i % 60 if i % 9 else None, [None, "", "a \u00fc\n", "x" * 100_000][i // 40] if i % 40 == 0 else f"t{i % 30}",
             ["de", None, "", "zz", "de", "de"][i % 6], None if i % 8 == 0 else "s", None if i % 5 == 0 else i % 30)
            for i in range(90)]
    docs = spark.createDataFrame(rows + rows[:20], SCHEMA)
    clash = docs.select("*", F.lit(1).alias("Text"), F.lit(2).alias("place"), F.lit(3).alias("a.b"), F.lit(4).alias("grp"))
    same(merkle_rows(clash, k=k).collect(), plain([r.asDict() for r in docs.collect()]))


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle_rows(empty).collect() == []
    one = spark.createDataFrame([(7, "t", "en", "s", 1)], SCHEMA)
    (r,) = merkle_rows(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")


def test_paths_fold_to_the_root(spark):
    m = merkle.build_manifest(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for r in merkle.proofs(m).collect():
        assert merkle.fold(r["leaf"], r["path"].split(" ") if r["path"] else []) == r["root"]
