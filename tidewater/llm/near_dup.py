"""Near-duplicate documents by a chosen-path set similarity join (operator 10).

A document is the set of its distinct ``words``-word shingles.  Several independent trees
branch the documents by minwise tokens: at its root a tree chooses ``branch`` minwise
functions, and a document goes to the child named by its token under each of them, so two
sets of similarity s part in a tree with probability (1 - s) ** branch only; a child that
is too large branches again by the token under one further function.  Nodes are settled as
soon as they are small:

* a node of at most ``node_docs`` documents and ``node_shingles`` shingles is compared
  exhaustively on full sets (nodes with equal members are compared once);
* a node that is still large after ``levels`` levels is a dense group: every member is
  compared with ``pivots`` pivots, in blocks.  Members outside the component that then
  holds most of the node are compared with all members of other components, in large
  blocks whose shared shingles are counted by matrix products.  Members of one component
  need no further pair.  Nothing is capped.

Equal sets are one class and enter the trees once.  A comparison group emits at most one
edge per member (a spanning star), components are found by label rounds on Spark.

Special cases.  Null, empty or blank text: empty set, linked with nothing.  Fewer words
than a shingle: the whole sequence is the one shingle.  Repeated rows: equal results.  A
null id: its row is returned and takes part, but never names a component that has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, groups, mix, pick, shingle_sets, slices, staged, words_of
from .tasks import task


@dataclass(frozen=True)
class NearDup:
    """Parameters: link sets with ``percent`` % Jaccard similarity or more."""

    words: int = 5
    percent: int = 80
    lower: bool = True
    trees: int = 5
    branch: int = 2
    levels: int = 3
    pivots: int = 6
    node_docs: int = 96
    node_shingles: int = 1 << 20
    block_docs: int = 1024
    seed: int = 7

    def functions(self) -> np.ndarray:
        """Odd multipliers of the minwise functions, by level and path."""
        n = self.levels * self.trees * self.branch
        return np.random.default_rng(self.seed).integers(0, 2**64, size=n, dtype=U64) | U64(1)


def _set_key(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit name of each set; equal sets have equal names."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 2), dtype=U64)
    if size.sum():
        flat, full = np.concatenate(sets), np.flatnonzero(size)
        at = (np.cumsum(size) - size)[full]
        for j, salt in enumerate((0x1B873593A5A5A5A5, 0xCC9E2D5117171717)):
            out[full, j] = mix(np.add.reduceat(mix(flat ^ U64(salt)), at) + size[full].astype(U64))
    return [row.tobytes() for row in out]


def _signatures(p: NearDup):
    mult = p.functions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "body"):
            w = words_of(s.column("body"), p.lower)
            sets = shingle_sets(w.hashes(), w.first, p.words)
            size = np.array([len(x) for x in sets])
            mins = np.zeros((len(sets), len(mult)), dtype=np.int64)
            full = np.flatnonzero(size)
            if len(full):
                flat, at = np.concatenate(sets), (np.cumsum(size) - size)[full]
                for j, m in enumerate(mult):
                    low = np.minimum.reduceat((flat ^ (m >> U64(7))) * m, at)
                    mins[full, j] = low.view(np.int64)
            at = np.arange(0, mins.size + 1, mins.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc"), s.column("th"), pa.array(_set_key(sets), pa.binary()),
                 pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(mins.ravel()))],
                names=["doc", "th", "key", "n", "mins"])

    return run


def _with_sets(p: NearDup):
    """(body, key, places) -> one row (grp, role, key, root, shingles) per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "body"):
            w = words_of(s.column("body"), p.lower)
            sets = shingle_sets(w.hashes(), w.first, p.words)
            rows = []
            for key, places, x in zip(s.column("key").to_pylist(), s.column("places").to_pylist(), sets):
                raw = x.tobytes()
                for g in places:
                    rows.append((g["grp"], g["role"], key, g["root"], raw))
                    if len(rows) >= 512:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
         pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())],
        names=["grp", "role", "key", "root", "shingles"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _exhaustive(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that span the components of a small node: a set is compared with the sets of
    every component so far until one links."""
    found: list[list[int]] = []
    edges = []
    for i, x in enumerate(sets):
        joined = []
        for c in found:
            j = next((j for j in c if similar(x, sets[j], percent)), None)
            if j is not None:
                edges.append((j, i))
                joined.append(c)
        merged = [m for c in joined for m in c] + [i]
        found = [c for c in found if c not in joined] + [merged]
    return edges


#: Shingles whose counts one matrix product adds up.
SHARED = 4096


def _alike(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets ``a`` (rows) and ``b`` (columns) are similar.  Shingles of both
    sides are columns of 0/1 matrices, whose products count what two sets share."""
    one, other = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(one, other)
    size = [np.array([len(x) for x in side]) for side in (a, b)]
    both = np.zeros((len(a), len(b)), dtype=np.int64)
    at = []
    for flat, n in zip((one, other), size):
        row = np.repeat(np.arange(len(n)), n)
        held = np.isin(flat, shared)
        row, col = row[held], np.searchsorted(shared, flat[held])
        order = np.argsort(col, kind="stable")
        at.append((row[order], col[order]))
    for k in range(0, len(shared), SHARED):
        parts = []
        for (row, col), n in zip(at, size):
            i, j = np.searchsorted(col, (k, k + SHARED))
            m = np.zeros((len(n), min(SHARED, len(shared) - k)), dtype=np.float32)
            m[row[i:j], col[i:j] - k] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)


#: Roles of a row in a comparison group.
SMALL, STAR, PIVOT, REST, ALL = range(5)


def _compare(p: NearDup):
    """Rows sorted by ``grp`` -> edges (a, b).  A group emits edges that span what it has
    found, so at most one per row, or one per row and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in groups(batches, "grp"):
            seen, rows = set(), []
            for k, r, root, raw in zip(*(t.column(c).to_pylist() for c in ("key", "role", "root", "shingles"))):
                if (k, r) not in seen:
                    seen.add((k, r))
                    rows.append((k, r, root, np.frombuffer(raw, dtype=U64)))
            role = rows[0][1]
            if role == SMALL:
                out += [(rows[i][0], rows[j][0])
                        for i, j in _exhaustive([x for *_, x in rows], p.percent)]
            elif role in (STAR, PIVOT):
                hubs = [x for x in rows if x[1] == PIVOT]
                for k, r, _, x in rows:
                    if r == STAR:
                        out += [(k, h[0]) for h in hubs if h[0] != k and similar(x, h[3], p.percent)]
            else:
                up = {x[2]: x[2] for x in rows}

                def find(x):
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    return x

                left, right = ([x for x in rows if x[1] == r] for r in (REST, ALL))
                if left and right:
                    linked = _alike([x[3] for x in left], [x[3] for x in right], p.percent)
                    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
                        one, other = find(left[i][2]), find(right[j][2])
                        if one != other:
                            out.append((left[i][0], right[j][0]))
                            up[one] = other
            if len(out) >= 4096:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    return run


def _edges(rows) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["a", "b"])


def _nodes(members: DataFrame) -> DataFrame:
    return members.groupBy("node").agg(
        F.count("*").alias("c"), F.sum("n").alias("w"),
        F.bit_xor(F.xxhash64("key")).alias("f1"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("f2")).filter("c > 1")


def _settle(p: NearDup, docs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Bring the full sets of the classes to their groups and compare there."""
    per = places.groupBy("key", "doc", "th").agg(
        F.collect_list(F.struct("grp", "role", "root")).alias("places"))
    per = per.withColumnsRenamed({"doc": "d2", "th": "t2"})
    joined = docs.join(per, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    rows = joined.select("body", "key", "places").mapInArrow(
        task(_with_sets, p), "grp long, role int, key binary, root binary, shingles binary")
    return staged(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(
        task(_compare, p), "a binary, b binary"), name)


def near_duplicates(docs: DataFrame, params: NearDup = NearDup(), *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id reachable by
    links, itself included) and ``kept`` (``doc_id = component_id``)."""
    p = params
    body = pick(docs, doc=id_col, body=text_col).withColumn(
        "body", F.coalesce(F.col("body").cast("string"), F.lit(""))).withColumn("th", F.xxhash64("body"))
    id_type = body.schema["doc"].dataType.simpleString()
    sig = staged(body.mapInArrow(task(_signatures, p),
                                 f"doc {id_type}, th long, key binary, n long, mins array<long>"), "sig")

    classes = sig.filter("n > 0").groupBy("key").agg(
        F.min(F.struct("doc", "th")).alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    # A null id sorts before all others, but must not name a class that has an id.
    named = sig.filter("n > 0").groupBy("key").agg(F.min("doc").alias("least"))
    classes = staged(classes.select("key", F.col("rep.doc").alias("doc"), F.col("rep.th").alias("th"),
                                    "n", "mins"), "classes")

    paths = p.trees * p.branch
    members = classes.select("key", "n", F.posexplode(F.slice("mins", 1, paths)).alias("path", "token")).select(
        F.xxhash64("path", "token").alias("node"), "path", "key", "n")
    no_root = F.lit(None).cast("binary").alias("root")
    places, dense = None, None
    for level in range(1, p.levels + 1):
        members = staged(members, f"members{level}")
        is_small = (F.col("c") <= 2) | ((F.col("c") <= p.node_docs) & (F.col("w") <= p.node_shingles))
        size = staged(_nodes(members).withColumn("small", is_small), f"nodes{level}")
        once = size.filter("small").groupBy("f1", "f2", "c").agg(F.min("node").alias("id"))
        small = members.join(once.select("id"), members.node == F.col("id")).select(
            "key", F.col("node").alias("grp"), F.lit(SMALL).alias("role"), no_root)
        places = small if places is None else places.unionByName(small)
        large = size.filter("not small")
        if level == p.levels:
            once = large.groupBy("f1", "f2", "c").agg(F.min("node").alias("id"), F.first("w").alias("w"))
            blocks = F.greatest(F.ceil(2 * F.col("c") / p.node_docs), F.ceil(2 * F.col("w") / p.node_shingles))
            dense = staged(members.join(once.select("id", blocks.cast("long").alias("blocks")),
                                        members.node == F.col("id")).select("key", "node", "n", "blocks"), "dense")
        else:
            big = members.join(large.select(F.col("node").alias("id")), F.col("node") == F.col("id"))
            tokens = classes.select(F.col("key").alias("k2"), "mins")
            token = F.element_at("mins", (F.lit(level * paths + 1) + F.col("path")).cast("int"))
            members = big.join(tokens, F.col("key") == F.col("k2")).select(
                F.xxhash64("node", token).alias("node"), "path", "key", "n")

    def spread(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")))

    block = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks"))
    star = dense.select("key", F.xxhash64("node", F.lit("star"), block).alias("grp"),
                        F.lit(STAR).alias("role"), no_root)
    pivots = dense.groupBy("node", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(p.pivots))).agg(
        F.min("key").alias("key"), F.first("blocks").alias("blocks"))
    hubs = pivots.select("key", "node", spread(F.col("blocks")).alias("b")).select(
        "key", F.xxhash64("node", F.lit("star"), "b").alias("grp"), F.lit(PIVOT).alias("role"), no_root)
    rep = classes.select(F.col("key").alias("k2"), "doc", "th")
    whole = lambda x: x.join(rep, F.col("key") == F.col("k2")).drop("k2")
    edges = _settle(p, body, whole(places.unionByName(star).unionByName(hubs)), "links")
    comp = components(edges)

    # Members of a dense node that are not in its main component so far, against all members.
    # Nodes with one main component are taken together: the trees repeat much of them.
    known = comp.withColumnsRenamed({"node": "k3", "root": "root3"})
    placed = dense.join(known, F.col("key") == F.col("k3"), "left").select(
        "key", "node", "n", F.coalesce("root3", "key").alias("root"))
    shares = placed.groupBy("node", "root").agg(F.count("*").alias("share"))
    main = shares.groupBy("node").agg(
        F.max_by("root", F.struct("share", "root")).alias("main"),
        (F.sum("share") - F.max("share")).alias("rest")).filter("rest > 0").select(
        F.col("node").alias("n2"), "main")
    pool = staged(placed.join(main, F.col("node") == F.col("n2")).groupBy("main", "key").agg(
        F.first("root").alias("root"), F.first("n").alias("n")), "pool")
    if not pool.isEmpty():
        def parts_of(n, w):
            return F.greatest(F.ceil(2 * n / p.block_docs), F.ceil(2 * w / p.node_shingles)).cast("long")

        far = F.col("root") != F.col("main")
        sizes = pool.groupBy("main").agg(
            parts_of(F.count("*"), F.sum("n")).alias("blocks"),
            parts_of(F.count_if(far), F.sum(F.when(far, F.col("n")))).alias("parts"))
        pool = pool.join(sizes.withColumnRenamed("main", "m2"), F.col("main") == F.col("m2"))
        part = F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))
        grp = lambda i, j: F.xxhash64("main", F.lit("rest"), i, j).alias("grp")
        left = pool.filter("root != main").select("key", "main", "root", part.alias("i"), spread(
            F.col("blocks")).alias("j")).select("key", grp("i", "j"), F.lit(REST).alias("role"), "root")
        right = pool.select("key", "main", "root", block.alias("j"), spread(
            F.col("parts")).alias("i")).select("key", grp("i", "j"), F.lit(ALL).alias("role"), "root")
        more = _settle(p, body, whole(left.unionByName(right)), "rest")
        if not more.isEmpty():
            comp = components(edges.unionByName(more))
    home = named.join(comp, F.col("key") == F.col("node"), "left").select(
        "key", F.coalesce("root", "key").alias("root"), "least")
    least = home.groupBy("root").agg(F.min("least").alias("component"))
    home = staged(home.select("key", "root").join(least, "root").select(
        F.col("key").alias("k2"), "component"), "home")
    out = sig.select("doc", "n", "key").join(home, F.col("key") == F.col("k2"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                      component.alias("component_id"),
                      F.col("doc").eqNullSafe(component).alias("kept"))
