"""Merkle manifest of a dataset, kept as postorder append logs (operator 11).

Leaves are ordered by (group, id) with one range partitioning; the counts of the ranges, one
row per range and group, give every leaf its place in its group, so no group is ever gathered.
Places are cut into aligned blocks of ``2**K`` leaves.  A builder appends a block's leaves to
its log and writes each node the moment its last leaf is in, so the log is the block's tree in
postorder.  The roots of a group's blocks are the leaves of the next tier, built alike, until
a group has one node, its subroot; the subroots, ordered by group, grow one more such tree.

A node's place in a log needs no pointers.  ``2e - popcount(e)`` nodes are complete once ``e``
leaves are in, so the node of level ``l`` that ends with leaf ``e`` stands ``l`` behind the
``2(e-1) - popcount(e-1)`` nodes complete before; the nodes of a ragged right edge follow at
the end, level by level.  Siblings are read at those places, tier by tier from the root down.

Digests are lowercase hex of sha256; a node hashes the hex text of its children, a last node
without a partner is hashed alone, and a lone leaf is its group's subroot.

Special cases.  A null field enters its leaf as ``-``; a null group comes first.  Null ids
come first in their group; rows that share an id are ordered by leaf, and equal rows get
neighbouring places in any order, each with its own proof.  A row of any length is one leaf.
An empty table: no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, pick, staged, width
from .tasks import task

#: A block holds ``2**K`` leaves.
K = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value ``-`` if null, else its UTF-8 byte count, ``:``, itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    return max(0, n - 1).bit_length()


def append_log(leaves: list[str], top: int) -> list[str]:
    """All nodes of the tree over ``leaves`` up to level ``top``, in order of completion."""
    log: list[str] = []
    whole: list[str] = []  # complete nodes that wait for a right neighbour
    for m, node in enumerate(leaves, 1):
        log.append(node)
        while m & 1 == 0:
            node = _h(whole.pop() + node)
            log.append(node)
            m >>= 1
        whole.append(node)
    edge = None
    if len(leaves) < 1 << top:
        for level in range(top):
            if len(leaves) >> level & 1:
                edge = _h(whole.pop() + (edge or ""))
            elif edge is not None:
                edge = _h(edge)
            else:
                continue
            log.append(edge)
    return log


def positions(level: int, index: np.ndarray, leaves: int) -> np.ndarray:
    """Places in the log of a tree over ``leaves`` of the nodes ``index`` of ``level``."""
    last = (index + 1 << level) - 1  # leaves before a full node's last one
    full = 2 * last - np.bitwise_count(last).astype(np.int64) + level
    lowest = (leaves & -leaves).bit_length()  # level of the lowest node of the ragged edge
    ragged = 2 * leaves - leaves.bit_count() + level - lowest
    return np.where(last < leaves, full, ragged)


@dataclass(frozen=True)
class Forest:
    """Logs of each tier: ``grp, total, block, log``, the lowest with ``entries, claims``; and
    ``roots``: ``grp, root``.  A block holds ``2**k`` nodes."""

    k: int
    tiers: list[DataFrame]
    roots: DataFrame


@dataclass(frozen=True)
class Manifest:
    """``docs`` holds the trees of the groups, ``tops`` the tree over their subroots."""

    docs: Forest
    tops: Forest


def _indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, gapless from 0 within ``group`` in ``order``, and ``total`` of the group."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # parts equal rows
    keys = [group, *order, "_row"]
    dealt = rows.repartitionByRange(width(rows.sparkSession), *keys).sortWithinPartitions(*keys).drop("_row")
    dealt = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    # One row per range and group: as many as ranges and groups together, at most.
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    mine = Window.partitionBy(group)
    counts = staged(counts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first",
        (F.sum("_n").over(mine.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(mine).alias("total")), "counts")
    joined = dealt.join(counts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_g", "_p", "_first", "_before")


def _build(bottom: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "run"):
            total = t["total"][0].as_py()
            log = append_log(t["node"].to_pylist(), min(k, height(total)))
            out = {"grp": t["grp"].slice(0, 1).combine_chunks(), "total": pa.array([total], pa.int64()),
                   "block": pa.array([t["place"][0].as_py() >> k], pa.int64()),
                   "log": pa.array([bytes.fromhex("".join(log))], pa.binary())}
            if bottom:
                entries = t["entry"].combine_chunks()
                out["entries"] = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
                out["claims"] = pa.array([bytes.fromhex("".join(t["claim"].to_pylist()))], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def _grow(nodes: DataFrame, k: int) -> Forest:
    """Trees over ``grp, total, place, node, entry, claim``."""
    tiers, roots = [], None
    kind = nodes.schema["entry"].dataType.simpleString()
    while True:
        bottom = not tiers
        block = F.shiftright("place", k)
        dealt = nodes.withColumn("run", F.concat_ws("/", block.cast("string"), "grp")).repartition(
            width(nodes.sparkSession), "run").sortWithinPartitions("run", "place")
        shape = "grp string, total long, block long, log binary" + (
            f", entries array<{kind}>, claims binary" if bottom else "")
        log = staged(dealt.mapInArrow(task(_build, bottom, k), shape), "merkle-log")
        tiers.append(log)
        last = F.lower(F.hex(F.substring("log", -32, 32)))
        done = log.filter(F.col("total") <= 1 << k).select("grp", last.alias("root"))
        roots = done if roots is None else roots.union(done)
        rest = log.filter(F.col("total") > 1 << k)
        if rest.isEmpty():
            return Forest(k, tiers, roots)
        nodes = rest.select("grp", F.ceil(F.col("total") / (1 << k)).cast("long").alias("total"),
                            F.col("block").alias("place"), last.alias("node"))


def build_manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "lang",
                   key: str = "doc_id", claim=None, k: int = K) -> Manifest:
    """Logs over the rows of ``docs``, written below the shared folder.

    ``claim(columns)``, given the fields as a dict of columns, is the digest that somebody
    holds of a row, for ``check_claims``; without it the row's own leaf.  A block holds ``2**k`` leaves."""
    rows = pick(docs, **{f"f{i}": name for i, name in enumerate(fields)}, grp=group, entry=key)
    columns = {name: F.col(f"f{i}") for i, name in enumerate(fields)}
    leaf = leaf_digest(*columns.values())
    # "-" sorts before "=", so a null group comes first and no name is taken for it.
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit("-")).alias("grp"), "entry",
        leaf.alias("node"), (claim(columns) if claim else leaf).alias("claim"))
    trees = _grow(_indexed(leaves, "grp", ["entry", "node"]), k)
    tops = trees.roots.select(F.lit("").alias("grp"), F.col("grp").alias("entry"), F.col("root").alias("node"),
                              F.col("root").alias("claim"))
    return Manifest(trees, _grow(_indexed(tops, "grp", ["entry"]), k))


def fold(digest: str, steps: list[str]) -> str:
    """Root that a proof gives for ``digest``: a step is ``<`` or ``>`` with the digest of the
    sibling on that side, or ``=`` where the node has none."""
    for s in steps:
        if s[0] == ">":
            digest = _h(digest + s[1:])
        elif s[0] == "<":
            digest = _h(s[1:] + digest)
        else:
            digest = _h(digest)
    return digest


def _extract(bottom: bool, check: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]  # noqa: E731, B023
                total, block = get("total").as_py(), get("block").as_py()
                raw, n = get("log").as_py().hex(), min(1 << k, total - (block << k))
                above = get("path").as_py()
                steps: list[list[str]] = [above.split(" ") if above else []]
                for level in range(min(k, height(total)) - 1, -1, -1):
                    count = -(-n // (1 << level))
                    beside = np.arange(count) ^ 1
                    at = (positions(level, beside, n) * 64).tolist()
                    own = [("=" if b >= count else "<" if b < i else ">") + ("" if b >= count else raw[p:p + 64])
                           for i, (b, p) in enumerate(zip(beside.tolist(), at))]
                    steps = [[s, *steps[i >> 1]] for i, s in enumerate(own)]
                same = {c: pa.array([get(c).as_py()] * n, pa.string()) for c in ("subroot", "root")}
                place = pa.array(np.arange(n) + (block << k), pa.int64())
                if not bottom:
                    yield pa.RecordBatch.from_pydict({
                        "grp": pa.array([get("grp").as_py()] * n, pa.string()), "block": place,
                        "path": pa.array([" ".join(s) for s in steps], pa.string()), **same})
                    continue
                leaf = [raw[p:p + 64] for p in (positions(0, np.arange(n), n) * 64).tolist()]
                held = get("claims").as_py().hex()
                claim = [held[64 * i:64 * i + 64] for i in range(n)]
                out = {"entry": get("entries").values, "place": place, "leaf": pa.array(leaf, pa.string()),
                       "claim": pa.array(claim, pa.string()), **same}
                if check:
                    out["proof_sha256"] = pa.array([_h("".join([x[1:] for x in s])) for s in steps], pa.string())
                    out["folded_root"] = pa.array([fold(c, s) for c, s in zip(claim, steps)], pa.string())
                else:
                    out["path"] = pa.array([" ".join(s) for s in steps], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return run


def _proofs(forest: Forest, upper: DataFrame, check: bool) -> DataFrame:
    """Walks the tiers down; ``upper`` has ``grp, path, subroot, root`` of the groups' roots."""
    heads = upper.select("grp", F.lit(0).cast("long").alias("block"), F.lit(True).alias("head"), "path", "subroot",
                         "root")
    found = heads
    for tier in range(len(forest.tiers) - 1, -1, -1):
        bottom, log = tier == 0, forest.tiers[tier]
        above = found.select(*[F.col(c).alias(f"u_{c}") if c in ("grp", "block", "head") else F.col(c)
                               for c in found.columns])
        log = log.withColumn("head", F.col("total") <= 1 << forest.k)
        joined = log.join(above, (F.col("grp") == F.col("u_grp")) & (F.col("block") == F.col("u_block")) &
                          (F.col("head") == F.col("u_head"))).drop("u_grp", "u_block", "u_head", "head")
        if bottom:
            kind = log.schema["entries"].dataType.elementType.simpleString()
            tail = "proof_sha256 string, folded_root string" if check else "path string"
            return joined.mapInArrow(task(_extract, True, check, forest.k), f"entry {kind}, place long, leaf string, "
                                     f"claim string, subroot string, root string, {tail}")
        below = joined.mapInArrow(task(_extract, False, check, forest.k),
                                  "grp string, block long, path string, subroot string, root string")
        found = staged(heads.unionByName(below.withColumn("head", F.lit(False))), "merkle-paths")
    raise ValueError("a forest has one tier at least")


def _heads(manifest: Manifest) -> DataFrame:
    """``grp, path, subroot, root`` of each group: the way from its subroot to the root."""
    root = manifest.tops.roots.select("grp", F.lit("").alias("path"), F.lit("").alias("subroot"), "root")
    tops = _proofs(manifest.tops, root, False)
    return staged(tops.select(F.col("entry").alias("grp"), "path", F.col("leaf").alias("subroot"), "root"),
                  "merkle-heads")


def proofs(manifest: Manifest) -> DataFrame:
    """Per row ``entry`` (its id), ``place`` in its group, ``leaf, claim, subroot, root`` and
    ``path``, the steps of its proof from the leaf up, separated by blanks (see ``fold``)."""
    return _proofs(manifest.docs, _heads(manifest), False)


def check_claims(manifest: Manifest) -> DataFrame:
    """Like ``proofs``, with ``proof_sha256`` (of the siblings' digests, joined) and
    ``folded_root`` (what the proof makes of the claim) in place of the path."""
    return _proofs(manifest.docs, _heads(manifest), True)
