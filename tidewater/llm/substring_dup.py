"""Removal of long repeated passages by recompression (operator 6).

A window is ``window`` consecutive words of one document; every word covered by a window
whose word sequence also starts anywhere else goes.

Words are compressed in rounds.  A round names each maximal run of one symbol, then each
pair of a left symbol followed by a right one; which symbols are left or right, and every
name, is a hash of the symbols alone, so all tasks name alike and equal passages get equal
symbols inside.  With each symbol goes its support, the words that settle how it was
formed: if a window holds the support, every equal window holds the same symbol.

1. The symbols of all documents are counted; names meet in the task of their hash range.
2. A window that holds the support of a symbol counted once cannot repeat.  The remaining
   windows are verified: 128-bit names of their words are counted in the same way.
3. Words covered by a repeated window are removed.

A task sends the distinct names of a block of documents in one row per hash range, so a
passage that a third of all documents share costs one entry a block, and the answer is
joined back by block; the blocks lie in buckets, so that join moves the answers alone.

Special cases.  Null, empty or blank text: no words, empty result.  Fewer words than a
window: nothing goes.  Repeated rows remove each other's windows, as all equal windows do.
A document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, bucketed, mix, slices, staged, text_bytes, width, windows
from .tasks import task

WINDOW = 35
ROUNDS = 4
BLOCK_BYTES = 2 << 20


# -- blocks of rows -------------------------------------------------------------------------

def _pack():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        press = zstandard.ZstdCompressor(level=3)

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())],
                names=["block", "payload"])

        held, size = [], 0
        for s in slices(batches, "body", BLOCK_BYTES // 4):
            held.append(s)
            size += len(text_bytes(s.column("body"))[0])
            if size >= BLOCK_BYTES * 3 // 4:
                yield close()
                held, size, number = [], 0, number + 1
        if held:
            yield close()

    return run


def _rows(payload: bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    t = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return t.to_batches()[0]


# -- recompression --------------------------------------------------------------------------

def compress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Symbols after ``rounds`` rounds with their supports ``[lo, hi)`` in word positions.  A
    support that would need words beyond its document reaches over the border."""
    n = len(h)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    sym, lo, hi = h, np.arange(n), np.arange(1, n + 1)
    for k in range(rounds):
        if not len(sym):
            break
        # runs
        new = np.ones(len(sym), dtype=bool)
        new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(sym))
        left, right = _neighbours(lo, hi, doc, at, stop, first)
        long = stop - at
        sym, doc = sym[at], doc[at]
        sym = np.where(long > 1, mix(sym * U64(0x2545F4914F6CDD1D) + long.astype(U64)), sym)
        lo, hi = left, right
        # pairs of a left and a right symbol
        is_right = (mix(sym ^ U64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & U64(1)).astype(bool)
        m = len(sym)
        joins = np.zeros(m, dtype=bool)
        joins[:-1] = ~is_right[:-1] & is_right[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(m, dtype=bool)
        second[1:] = joins[:-1]
        at = np.flatnonzero(~second)
        stop = at + 1 + joins[at]
        left, right = _neighbours(lo, hi, doc, at, stop, first)
        alone = ~joins[at]
        # A left symbol joins nothing before it, a right one nothing after it.
        left = np.where(alone & is_right[at], left, lo[at])
        right = np.where(alone & ~is_right[at], right, hi[stop - 1])
        pair = mix(sym[at] * U64(0xDA942042E4DD58B5) + sym[stop - 1] * U64(0xA0761D6478BD642F) + U64(k))
        sym, doc = np.where(alone, sym[at], pair), doc[at]
        lo, hi = left, right
    return sym, lo, hi, doc


def _neighbours(lo, hi, doc, at, stop, first):
    """Support from the symbol before ``at`` to the one after; beyond a document's border."""
    left = np.where((at > 0) & (doc[at - 1] == doc[at]), lo[at - 1], first[doc[at]] - 1)
    last = np.minimum(stop, len(doc) - 1)
    right = np.where((stop < len(doc)) & (doc[last] == doc[at]), hi[last], first[doc[at] + 1] + 1)
    return left, right


def _window_names(h, first, size):
    a, ok = windows(h, first, size, 1)
    b, _ = windows(h, first, size, 2)
    return a, b, ok


# -- counting names over all blocks -----------------------------------------------------------

def _range_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of a name; ascending names have ascending ranges."""
    return ((names >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def _slices_of(block: int, a: np.ndarray, b: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """Distinct names of a block, one row per hash range, with a mark where a name occurs more
    than once in the block."""
    if b is None:
        a, n = np.unique(a, return_counts=True)
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        n = np.diff(np.append(np.flatnonzero(new), len(a)))
        a, b = a[new], b[new]
    cut = np.searchsorted(_range_of(a, parts), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cut))
    more = (n > 1)

    def raw(x):
        return pa.array([x[cut[p]:cut[p + 1]].tobytes() for p in full], pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), block), pa.int64()), pa.array(full, pa.int32()), raw(a),
         raw(b) if b is not None else pa.nulls(len(full), pa.binary()), raw(more)],
        names=["block", "part", "a", "b", "more"])


SLICE_SCHEMA = "block long, part int, a binary, b binary, more binary"


def _symbol_slices(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                w = Words(*text_bytes(_rows(payload.as_py()).column("body")), lower=False)
                yield _slices_of(block, compress(w.hashes(), w.first)[0], None, parts)

    return run


def _count(names_back: bool):
    """All slices of some hash ranges -> per block and range the marks of the names that occur
    more than once, or (``names_back``) those names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import groups
        for t in groups(batches, "part"):
            raws = t.column("a").to_pylist()
            size = np.array([len(x) // 8 for x in raws])
            a = np.frombuffer(b"".join(raws), dtype=U64)
            more = np.frombuffer(b"".join(t.column("more").to_pylist()), dtype=bool)
            if names_back:
                b = np.frombuffer(b"".join(t.column("b").to_pylist()), dtype=U64)
                order = np.lexsort((b, a))
            else:
                b, order = None, np.argsort(a, kind="stable")
            x = a[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[1:] != x[:-1]
            if b is not None:
                y = b[order]
                new[1:] |= y[1:] != y[:-1]
            at = np.flatnonzero(new)
            often = (np.diff(np.append(at, len(x))) > 1) | np.logical_or.reduceat(more[order], at)
            flag = np.zeros(len(x), dtype=bool)
            flag[order] = np.repeat(often, np.diff(np.append(at, len(x))))
            stop = np.cumsum(size)
            if names_back:
                out = [a[i:j][flag[i:j]].tobytes() for i, j in zip((stop - size).tolist(), stop.tolist())]
            else:
                out = [np.packbits(flag[i:j]).tobytes() for i, j in zip((stop - size).tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [t.column("block").combine_chunks(), t.column("part").combine_chunks(),
                 pa.array(size, pa.int32()), pa.array(out, pa.binary())],
                names=["block", "part", "n", "marks"])

    return run


def _counted(slices_: DataFrame, names_back: bool, name: str) -> DataFrame:
    found = slices_.repartition(width(slices_.sparkSession), "part").sortWithinPartitions("part").mapInArrow(
        task(_count, names_back), "block long, part int, n int, marks binary")
    return staged(found, name)


def _with_marks(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    per = marks.filter("octet_length(marks) > 0").groupBy(F.col("block").alias("b2")).agg(
        F.sort_array(F.collect_list(F.struct("part", "n", "marks"))).alias("marks"))
    return blocks.join(per, F.col("block") == F.col("b2"), "left").select("block", "payload", "marks")


# -- windows ----------------------------------------------------------------------------------

def _window_slices(parts: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, marks in zip(batch.column("block").to_pylist(), batch.column("payload"),
                                             batch.column("marks").to_pylist()):
                w = Words(*text_bytes(_rows(payload.as_py()).column("body")), lower=False)
                h = w.hashes()
                sym, lo, hi, doc = compress(h, w.first)
                distinct, back = np.unique(sym, return_inverse=True)
                often = np.concatenate([np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=m["n"])
                                        for m in marks or []] or [np.zeros(0, np.uint8)]).astype(bool)
                if len(often) != len(distinct):
                    raise ValueError("marks do not fit the block")
                once = ~often[back] & (hi - lo <= size)
                # Windows that hold the support of a symbol that occurs once start in [hi - size, lo].
                begin, end = np.maximum(hi[once] - size, w.first[doc[once]]), lo[once] + 1
                good = begin < end
                delta = np.bincount(begin[good], minlength=len(h) + 1)[:len(h) + 1] - \
                    np.bincount(end[good], minlength=len(h) + 1)[:len(h) + 1]
                a, b, ok = _window_names(h, w.first, size)
                ok &= np.cumsum(delta)[:len(h)] == 0
                if ok.any():
                    yield _slices_of(block, a[ok], b[ok], parts)

    return run


def _remove(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, marks in zip(batch.column("payload"), batch.column("marks").to_pylist()):
                rows = _rows(payload.as_py())
                w = Words(*text_bytes(rows.column("body")), lower=False)
                often = np.concatenate([np.frombuffer(m["marks"], dtype=U64) for m in marks or []] or
                                       [np.zeros(0, U64)])
                n = len(w.start)
                gone = np.zeros(n, dtype=bool)
                if len(often):
                    a, ok = windows(w.hashes(), w.first, size, 1)
                    at = np.minimum(np.searchsorted(often, a), len(often) - 1)
                    begin = np.flatnonzero(ok & (often[at] == a))
                    delta = np.zeros(n + 1, dtype=np.int64)
                    delta[begin] += 1
                    delta[begin + size] -= 1
                    gone = np.cumsum(delta)[:n] > 0
                removed = np.concatenate(([0], np.cumsum(gone)))[w.first]
                kept = _joined(w, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in names), pa.array(np.diff(w.first), pa.int64()),
                     pa.array(np.diff(removed), pa.int64()), kept],
                    names=[*names, "n_words", "n_removed", "kept"])

    return run


def _joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Kept words of each document joined by one blank."""
    first = np.concatenate(([0], np.cumsum(keep)))[w.first]
    start, size = w.start[keep], (w.end - w.start)[keep] + 1
    stop = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(stop[-1]), 0x20, dtype=np.uint8)
    place = np.arange(len(out))
    word = np.repeat(np.arange(len(size)), size)
    inside = place - stop[word] < size[word] - 1
    out[inside] = w.buf[(place - stop[word] + start[word])[inside]]
    begin, end = stop[first[:-1]], stop[first[1:]]
    raw = out.tobytes()
    return pa.array([raw[i:max(i, j - 1)] for i, j in zip(begin.tolist(), end.tolist())],
                    pa.binary()).cast(pa.string())


def remove_repeats(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows of ``docs`` with all their columns, under the names ``c0, c1, ...`` in order,
    and ``n_words, n_removed, kept``: the kept words joined by one blank."""
    parts = 4 * width(docs.sparkSession)
    at = [i for i, c in enumerate(docs.columns) if c == text_col] or \
        [i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower()]
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    schema = flat.schema
    flat = flat.withColumn("body", F.coalesce(F.col(names[at[0]]).cast("string"), F.lit("")))
    blocks = bucketed(flat.mapInArrow(task(_pack), "block long, payload binary"), "block", "blocks")
    symbols = blocks.mapInArrow(task(_symbol_slices, parts), SLICE_SCHEMA)
    marked = _with_marks(blocks, _counted(symbols, False, "symbols"))
    repeats = _counted(marked.mapInArrow(task(_window_slices, parts, window), SLICE_SCHEMA), True, "repeats")
    out = T.StructType([*schema.fields, T.StructField("n_words", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return _with_marks(blocks, repeats).mapInArrow(task(_remove, window, names), out)
