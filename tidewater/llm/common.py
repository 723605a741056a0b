"""Helpers shared by the operators of this subpackage.

Text is handled in bulk: an Arrow string column is seen as one byte array, and words,
word hashes and shingle hashes of a whole slice of documents are computed with numpy.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D (UTF-8 never uses these
bytes inside a character).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Text bytes handled by one numpy pass; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64
_TAB = np.random.default_rng(20240101).integers(0, 2**64, size=64 * 256, dtype=U64)
_ODD = np.random.default_rng(20240102).integers(0, 2**64, size=64, dtype=U64) | U64(1)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under private names: ``pick(docs, doc="doc_id", body="text")``.

    A column is found by exact name first, then ignoring case, so further columns with
    names that clash ("Text", "a.b", a second "shard") never make a reference ambiguous.
    """
    names = df.columns
    flat = df.toDF(*[f"_in{i}" for i in range(len(names))])
    out = []
    for alias, name in columns.items():
        found = [i for i, n in enumerate(names) if n == name] or \
            [i for i, n in enumerate(names) if n.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name!r} among {names}")
        out.append(F.col(f"_in{found[0]}").alias(alias))
    return flat.select(*out)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut there, and a
    lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``staged``, in buckets of ``key``: a join on it then moves only the other side.
    The table is external, in the shared folder, under a name of its own."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    n, table = width(spark), f"tidewater_{name}_{path.rsplit('/', 1)[-1]}"
    df.repartition(n, key).write.option("compression", "uncompressed").bucketBy(n, key).option(
        "path", path).saveAsTable(table)
    return spark.read.table(table)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartitioning: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + n + 1] \
        if offs is not None and n else np.zeros(n + 1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else \
        np.zeros(0, dtype=np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def slices(batches: Iterable[pa.RecordBatch], column: str,
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a slice has at most ``max_bytes`` of text (or one row)."""
    for batch in batches:
        _, off = text_bytes(batch.column(column))
        a, n = 0, batch.num_rows
        while a < n:
            b = int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1
            b = min(max(b, a + 1), n)
            yield batch.slice(a, b - a)
            a = b


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``first`` (n_docs + 1 positions in
    the word arrays) and, on demand, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool):
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        gap = np.ones(n + 1, dtype=bool)
        gap[:n] = _SPACE[buf]
        inside = ~gap
        begins = inside.copy()
        begins[1:] &= gap[:-1]
        cuts = off[1:-1]
        begins[cuts[cuts < n]] |= inside[cuts[cuts < n]]
        ends = gap.copy()
        ends[cuts] = True
        ends[0] = False
        ends[1:] &= inside[:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)
        self.first[-1] = len(self.start)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
        byte = self.buf[place + np.repeat(self.start, size)]
        v = _TAB[((place & 63) << 8) + byte]
        far = np.flatnonzero(place >= 64) if size.max() > 64 else ()
        if len(far):
            v[far] = mix(v[far] + (place[far] >> 6).astype(U64) * U64(0x9E3779B97F4A7C15))
        return mix(np.add.reduceat(v, at) + size.astype(U64))


def words_of(column: pa.Array, lower: bool) -> Words:
    return Words(*text_bytes(column), lower)


def windows(h: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each place on, and whether they lie in one document."""
    n = len(h)
    out = np.zeros(n, dtype=U64)
    ok = np.zeros(n, dtype=bool)
    if n >= k:
        c = mix(np.arange(1, k + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(salt)) | U64(1)
        acc = np.zeros(n - k + 1, dtype=U64)
        for j in range(k):
            acc += h[j:n - k + 1 + j] * c[j]
        out[:n - k + 1] = mix(acc)
        end = np.repeat(first[1:], np.diff(first))
        ok = np.arange(n) + k <= end
    return out, ok


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``k``-word shingles; with fewer words
    the whole sequence is one shingle; without words the set is empty."""
    win, _ = windows(h, first, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(win[a:b - k + 1]))
        elif b > a:
            whole = (h[a:b] * _ODD[:b - a]).sum(dtype=U64) + U64(b - a)
            out.append(mix(np.array([whole], dtype=U64) ^ U64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in batches sorted by it, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(key)
        codes = col.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            value = col[a].as_py()
            if held and value != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value
    if held:
        yield pa.Table.from_batches(held)


def byte_letters() -> dict[str, int]:
    """Characters that byte-level vocabulary files write for bytes: those that print stand for
    themselves, the others for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def crc32_of(column) -> F.Column:
    """Unsigned crc32 of the value as text (null: null)."""
    return F.crc32(column.cast("string").cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, root) per node that has an
    edge; ``root`` is the smallest node of the component.

    Each round every node takes the smallest label among its own label's label and its
    neighbours' labels, so labels travel along edges and double their reach by pointer
    jumping; a round is one join per kind and one map-side combined minimum, written to
    the shared folder.  A hub is split by the skew join, since the label side is unique.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b")
                  .distinct(), "edges")
    label = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root"))
    label = staged(label, "labels")
    while True:
        near = both.join(label, both.a == label.node).select(
            F.col("b").alias("node"), "root", F.lit(None).cast(label.schema["root"].dataType).alias("old"))
        up = label.select(F.col("node").alias("parent"), F.col("root").alias("top"))
        jump = label.join(up, label.root == up.parent).select(
            "node", F.col("top").alias("root"), F.col("root").alias("old"))
        label = staged(near.unionByName(jump).groupBy("node").agg(
            F.min("root").alias("root"), F.max("old").alias("old")), "labels")
        if label.filter("root < old").isEmpty():
            return label.select("node", "root")
