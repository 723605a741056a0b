"""Near-duplicate embeddings by spherical-cap filters (operator 2).

Filter directions are a structured product code: a random rotation, then blocks of
coordinates with a random codebook each; a direction is one codeword per block.  A vector
is listed with every direction whose inner product with it exceeds a threshold.  The list is
decoded block by block, dropping partial sums that the best of the remaining blocks cannot
lift over the threshold.  Vectors of one label that share a direction are compared exactly,
in double precision.

``codes`` such codes are independent.  A code grows with the largest label's number of distinct
vectors, so that a direction lists about ``per_filter`` of them, while a vector is listed with
about ``per_vector`` directions of each code, and with its best ``fewest`` where fewer exceed
the threshold: every vector is listed in every code.  A pair is missed if it shares no direction
of any code; the README gives the recall at cosine 0.98 by label size, 0.9999 and more.

Equal vectors of one label are one class; it enters once with its count.  A direction with
many classes is compared in pairs of blocks of ``block`` classes.  A pair is counted at the
first direction its two classes share, and a comparison emits counts and spanning edges,
never pairs.

Special cases.  Null, empty or zero vectors, null or non-finite components and null labels:
linked with nothing.  Vectors of different dimension never link.  Repeated rows count as
vectors of their own.  A null id is returned; it names no component that has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, pick, staged
from .tasks import task


@dataclass(frozen=True)
class Caps:
    cosine: float = 0.98
    codes: int = 4
    per_vector: int = 10
    fewest: int = 6       # directions of a code that every vector is listed with
    per_filter: int = 6
    block: int = 128
    seed: int = 5


class Code:
    """The product code of one dimension."""

    def __init__(self, p: Caps, dim: int, vectors: int, number: int):
        self.offset = number << 48
        r = np.random.default_rng([p.seed, dim, number])
        total = p.per_vector * max(64.0, vectors / p.per_filter)
        if dim < 16:  # few directions tell vectors of few dimensions apart
            total = min(total, p.per_vector * 2.0 ** dim)
        self.blocks = min(dim, 2 if total < 4e6 else 3)
        self.fewest = p.fewest
        self.words = max(2, int(np.ceil(total ** (1 / self.blocks))))
        self.turn = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        self.cut = np.array_split(np.arange(dim), self.blocks)
        self.books = []
        for c in self.cut:
            w = r.normal(size=(self.words, len(c)))
            self.books.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        # The threshold that lists random directions per_vector times on average.
        x = r.normal(size=(256, dim))
        s = self._products(x / np.linalg.norm(x, axis=1, keepdims=True))
        some = [b[:, r.integers(self.words, size=65536)] for b in s]
        share = min(1.0, p.per_vector / self.words ** self.blocks)
        scores = np.sort(sum(some).ravel())
        self.least = scores[max(0, len(scores) - max(1, round(share * len(scores))))] - 1e-12

    def _products(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.turn
        return [y[:, c] @ b.T for c, b in zip(self.cut, self.books)]

    def _best(self, s: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ``fewest`` best directions of each vector: (vector, direction)."""
        part, name = np.zeros((len(s[0]), 1)), np.zeros((len(s[0]), 1), dtype=np.int64)
        for b in s:
            k = min(self.fewest, self.words)
            top = np.argpartition(-b, k - 1, axis=1)[:, :k]
            part = (part[:, :, None] + np.take_along_axis(b, top, 1)[:, None, :]).reshape(len(b), -1)
            name = (name[:, :, None] * self.words + top[:, None, :]).reshape(len(b), -1)
            k = min(self.fewest, part.shape[1])
            top = np.argpartition(-part, k - 1, axis=1)[:, :k]
            part, name = np.take_along_axis(part, top, 1), np.take_along_axis(name, top, 1)
        return np.repeat(np.arange(len(name)), name.shape[1]), name.ravel()

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Directions of each unit vector, ascending."""
        s = self._products(x)
        best = [b.max(axis=1) for b in s]
        who, part, name = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), dtype=np.int64)
        for i, b in enumerate(s):
            rest = sum(best[i + 1:], np.zeros(len(x)))
            new = []
            for a in range(0, len(who), 8192):
                w = who[a:a + 8192]
                sums = part[a:a + 8192, None] + b[w]
                row, col = np.nonzero(sums + rest[w, None] >= self.least)
                new.append((w[row], sums[row, col], name[a:a + 8192][row] * self.words + col))
            if not new:
                break
            who, part, name = (np.concatenate(z) for z in zip(*new))
        lone = np.flatnonzero(np.bincount(who, minlength=len(x)) < self.fewest)
        if len(lone):  # the best directions: sums of the best codewords of each block
            rest = ~np.isin(who, lone)
            own, of = self._best([b[lone] for b in s])
            who, name = np.concatenate([who[rest], lone[own]]), np.concatenate([name[rest], of])
        order = np.lexsort((name, who))
        cuts = np.searchsorted(who[order], np.arange(len(x) + 1))
        name = name[order] + self.offset
        return [name[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _classes():
    """(vid, emb, label) -> (vid, cls, label, dim, vec); ``cls`` is null where nothing links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, dim, vec = [], [], []
            for x, label in zip(batch.column("emb").to_pylist(), batch.column("label").to_pylist()):
                v = np.array([], float) if x is None or None in x else np.array(x, dtype=np.float64)
                good = label is not None and len(v) and np.isfinite(v).all() and v.any() \
                    and 0 < np.linalg.norm(v) < np.inf
                v = v + 0.0  # one zero
                raw = v.tobytes() if good else None
                dim.append(len(v))
                short = v.astype(np.float32) if good else v
                vec.append(None if not good else b"f" + short.tobytes() if (short == v).all() else b"d" + raw)
                cls.append(hashlib.md5(f"{label}\0{len(v)}\0".encode() + raw).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vid"), pa.array(cls, pa.binary()), batch.column("label"),
                 pa.array(dim, pa.int32()), pa.array(vec, pa.binary())],
                names=["vid", "cls", "label", "dim", "vec"])

    return run


def _vector(raw: bytes) -> np.ndarray:
    """Kept in four bytes a component where that is exact."""
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64)


def _list(p: Caps, vectors: int):
    """(cls, label, dim, vec) -> the same with ``filters``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {}
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            raws = batch.column("vec").to_pylist()
            out = [None] * len(raws)
            for d in np.unique(dims).tolist():
                if d not in codes:
                    codes[d] = [Code(p, d, vectors, k) for k in range(p.codes)]
                at = np.flatnonzero(dims == d)
                x = np.stack([_vector(raws[i]) for i in at])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for a in range(0, len(at), 1024):
                    lists = zip(*(c.decode(x[a:a + 1024]) for c in codes[d]))
                    for i, f in zip(at[a:a + 1024], lists):
                        out[i] = np.concatenate(f)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "filters"])

    return run


def _compare(p: Caps):
    """Rows of a comparison -> (a, b, links): an edge a-b, or ``links`` vectors linked to a."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for t in groups(batches, "grp"):
            own = t.column("own").to_numpy()
            cls, count = t.column("cls").to_pylist(), t.column("m").to_numpy()
            x = np.stack([_vector(raw) for raw in t.column("vec").to_pylist()])
            norm = np.sqrt((x * x).sum(axis=1))
            # Filters before this one: a pair that shares one of them is counted there.
            before = [set(f) for f in t.column("before").to_pylist()]
            links = np.zeros(len(cls), dtype=np.int64)
            up = list(range(len(cls)))

            def find(i):
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            one_block = len(np.unique(own)) == 1
            both_sides = t.column("pair")[0].as_py()
            if one_block and both_sides:
                continue  # the other block of the pair holds no class here
            cos = (x @ x.T) / (norm[:, None] * norm[None, :])
            linked = np.triu(cos >= p.cosine - 1e-9, 1)
            if both_sides:
                linked &= own[:, None] != own[None, :]
            for i, j in zip(*np.nonzero(linked)):
                if float(np.dot(x[i], x[j])) / (norm[i] * norm[j]) < p.cosine or before[i] & before[j]:
                    continue
                links[i] += count[j]
                links[j] += count[i]
                if find(i) != find(j):
                    out.append((cls[i], cls[j], 0))
                    up[find(i)] = find(j)
            out += [(cls[i], None, int(links[i])) for i in np.flatnonzero(links)]
            if len(out) > 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows):
    a, b, n = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])


def near_vectors(vectors: DataFrame, p: Caps = Caps(), *, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = pick(vectors, vid=id_col, emb=vector_col, label=label_col)
    rows = rows.select("vid", F.col("emb").cast("array<double>").alias("emb"), F.col("label").cast("string").alias("label"))
    kind = rows.schema["vid"].dataType.simpleString()
    rows = staged(rows.mapInArrow(
        task(_classes), f"vid {kind}, cls binary, label string, dim int, vec binary"), "vectors")
    classes = staged(rows.filter("cls is not null").groupBy("cls").agg(
        F.count("*").alias("m"), F.min("vid").alias("least"), F.first("label").alias("label"),
        F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).collect()[0][0] or 0  # bounded: one row
    listed = staged(classes.select("cls", "m", "label", "dim", "vec").mapInArrow(
        task(_list, p, int(largest)),
        "cls binary, m long, label string, dim int, vec binary, filters array<long>"), "listed")
    members = listed.select("cls", "label", "dim", F.posexplode("filters").alias("nth", "filter"))
    sizes = members.groupBy("label", "dim", "filter").agg(F.ceil(F.count("*") / p.block).cast("long").alias("blocks"),
                                                          F.count("*").alias("c")).filter("c > 1").drop("c")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    placed = members.join(sizes, ["label", "dim", "filter"]).select(
        "cls", "label", "dim", "filter", "nth", own.alias("own"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("other"))
    placed = placed.select("cls", "nth", "own", (F.col("own") != F.col("other")).alias("pair"), F.xxhash64(
        "label", "dim", "filter", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    vec = listed.select(F.col("cls").alias("c2"), "m", "vec", "filters")
    found = staged(placed.join(vec, F.col("cls") == F.col("c2")).select(
        "grp", "cls", "own", "pair", "m", "vec", F.slice("filters", F.lit(1), F.col("nth")).alias("before")).repartition("grp").sortWithinPartitions(
        "grp").mapInArrow(task(_compare, p), "a binary, b binary, links long"), "caps")
    comp = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("b is null").groupBy(F.col("a").alias("c3")).agg(F.sum("links").alias("links"))
    home = classes.select("cls", "m", "least").join(comp, F.col("cls") == F.col("node"), "left").select(
        "cls", "m", "least", F.coalesce("root", "cls").alias("root"))
    least = home.groupBy(F.col("root").alias("r2")).agg(F.min("least").alias("component"))
    home = staged(home.join(least, F.col("root") == F.col("r2")).join(links, F.col("cls") == F.col("c3"), "left").select(
        F.col("cls").alias("c4"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "home")
    component = F.when(F.col("cls").isNull(), F.col("vid")).otherwise(F.col("component"))
    return rows.select("vid", "cls").join(home, F.col("cls") == F.col("c4"), "left").select(
        F.col("vid").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vid").eqNullSafe(component).alias("kept"))
