"""Benchmark passages in documents (operator 4).

For every benchmark item, windows of the item's length in words slide over the documents.
A window and an item are alike when the weighted Jaccard similarity of their ``shingle``-word
shingles, each weighted by how often it occurs (sum of minima over sum of maxima), reaches
``percent`` %.

1. Windows are fingerprinted by SimHash: each shingle votes on 128 bits.  Only windows that
   hold a shingle of an item of their length are made; any other has similarity 0.
2. Multi-index: the bits are cut into 18 blocks.  Two fingerprints within ``RADIUS`` = 36 + 17
   bits differ by at most 2 bits in one of them, so the table of block values within 2 bits
   of an item's finds every fingerprint within the radius.  The radius is twice and more the
   distance expected at the least similarity (about 20 bits).
3. Candidates are verified by exact weighted similarity of their shingle hashes.

The index of the benchmark goes to the tasks.  It is built from at most ``ITEMS`` items of
together ``ITEM_BYTES`` bytes at a time; a larger benchmark takes several passes over the
documents, each with a part chosen by hash.  Documents are never moved.

Special cases.  Null, empty or blank texts and items match nothing.  An item with fewer
words than a shingle is one shingle.  A document shorter than an item is
one window, its whole text, if it has shingles enough for ``percent`` %.  Items of equal text
are reported each; repeated rows give repeated reports.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, pick, slices, windows, words_of
from .tasks import task

SHINGLE, PERCENT = 5, 80
BLOCKS, NEAR = 18, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
ITEMS, ITEM_BYTES = 4096, 8 << 20
_EDGES = np.linspace(0, 128, BLOCKS + 1).astype(int)


@dataclass
class Index:
    """Items of one length."""

    length: int
    ids: list[list]           # item ids by distinct text
    sets: list[tuple]         # distinct shingle hashes and how often each occurs
    prints: np.ndarray        # [items, 128] bits
    near: list[np.ndarray]    # per block [values, items]: item within NEAR bits of the value


def simhash(names: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (128 bits as booleans) of the ``n`` shingles from each place on."""
    votes = np.zeros((len(at), 128), dtype=np.int32)
    for k in range(n):
        x = names[at + k]
        bits = np.unpackbits(np.stack([mix(x), mix(x ^ U64(0xA24BAED4963EE407))], axis=1).view(np.uint8), axis=1)
        votes += bits
    return 2 * votes > n


def _block_values(prints: np.ndarray) -> list[np.ndarray]:
    return [prints[:, a:b] @ (1 << np.arange(b - a)) for a, b in zip(_EDGES[:-1], _EDGES[1:])]


def build_index(ids: list, texts: list[str]) -> list[Index]:
    w = words_of(pa.array(texts, pa.string()), lower=True)
    h, by_length = w.hashes(), {}
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if b > a:
            by_length.setdefault(b - a, {}).setdefault(h[a:b].tobytes(), []).append(ids[i])
    out = []
    for length, items in sorted(by_length.items()):
        k = min(SHINGLE, length)
        flat = np.concatenate([np.frombuffer(x, dtype=U64) for x in items])
        first = np.arange(0, len(flat) + 1, length)
        names = windows(flat, first, k)[0]
        prints = simhash(names, first[:-1], length - k + 1)
        near = []
        for (a, b), values in zip(zip(_EDGES[:-1], _EDGES[1:]), _block_values(prints)):
            apart = np.arange(1 << (b - a))[:, None] ^ values[None, :]
            near.append(np.bitwise_count(apart) <= NEAR)
        sets = [np.unique(names[i:i + length - k + 1], return_counts=True) for i in first[:-1].tolist()]
        out.append(Index(length, list(items.values()), sets, prints, near))
    return out


def _alike(a: tuple, b: tuple) -> tuple[int, int]:
    """Sum of minima and of maxima of two weighted sets."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    least = int(np.minimum(a[1][both], b[1][at][both]).sum())
    return least, int(a[1].sum() + b[1].sum()) - least


def _scan(index: list[Index], percent: int):
    known = {}
    for k in {min(SHINGLE, x.length) for x in index}:
        of = [(np.unique(np.concatenate([s[0] for s in x.sets])), x) for x in index if min(SHINGLE, x.length) == k]
        known[k] = (np.unique(np.concatenate([n for n, _ in of])), of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "body"):
            w = words_of(s.column("body"), lower=True)
            h, rows = w.hashes(), []
            doc = np.repeat(np.arange(s.num_rows), np.diff(w.first))
            for k, (every, of) in known.items():
                names, ok = windows(h, w.first, k)
                at = np.minimum(np.searchsorted(every, names), len(every) - 1)
                hits = np.flatnonzero(ok & (every[at] == names))
                for own, x in of:
                    mine = hits[np.isin(names[hits], own)]
                    if len(mine):
                        rows += _windows_of(x, mine, names, doc, w.first, k, percent)
            if rows:
                best = {}
                for d, item, least, most, start in rows:
                    key = (d, item)
                    if key not in best or (least * best[key][1], -start) > (best[key][0] * most, -best[key][2]):
                        best[key] = (least, most, start, 0)
                docs = s.column("doc").take(pa.array([d for d, _ in best]))
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array([i for _, i in best]), pa.array([v[0] / v[1] for v in best.values()]),
                     pa.array([int(v[2] - w.first[d]) for (d, _), v in best.items()], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def _windows_of(x: Index, hits, names, doc, first, k, percent):
    """(document, item, minima, maxima, start) of the windows that are alike."""
    n = x.length - k + 1
    lo = np.maximum(hits - n + 1, first[doc[hits]])
    hi = np.minimum(hits, first[doc[hits] + 1] - x.length)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    out = _short(x, hits, names, doc, first, k, percent)
    if not len(lo):
        return out
    delta = np.bincount(lo, minlength=len(names) + 1) - np.bincount(hi + 1, minlength=len(names) + 1)
    return out + _checked(x, np.flatnonzero(np.cumsum(delta) > 0), n, names, doc, percent)


def _short(x: Index, hits, names, doc, first, k, percent):
    """Documents shorter than the items, with enough shingles still: the whole text is the window."""
    size = np.diff(first)
    d = np.unique(doc[hits])
    d = d[(size[d] >= k) & (size[d] < x.length) & (100 * (size[d] - k + 1) >= percent * (x.length - k + 1))]
    return [r for m in np.unique(size[d]).tolist()
            for r in _checked(x, first[d[size[d] == m]], m - k + 1, names, doc, percent)]


def _checked(x: Index, starts, n, names, doc, percent):
    """Those of the windows of ``n`` shingles that are alike."""
    out = []
    for a in range(0, len(starts), 4096):
        at = starts[a:a + 4096]
        prints = simhash(names, at, n)
        candidate = np.zeros((len(at), len(x.ids)), dtype=bool)
        for table, values in zip(x.near, _block_values(prints)):
            candidate |= table[values]
        win, item = np.nonzero(candidate)
        close = (prints[win] != x.prints[item]).sum(axis=1) <= RADIUS
        last, own = -1, None
        for i, j in zip(win[close].tolist(), item[close].tolist()):
            if i != last:
                last, own = i, np.unique(names[at[i]:at[i] + n], return_counts=True)
            least, most = _alike(own, x.sets[j])
            if 100 * least >= percent * most:
                out += [(int(doc[at[i]]), one, least, most, int(at[i])) for one in x.ids[j]]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: for each document and item with a window
    that is alike the largest similarity, and the first word (from 0) of its first window."""
    items = pick(benchmark, item=item_col, body=item_text).filter("body is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("b"))
    n, b = size.collect()[0]  # bounded: one row
    passes = max(1, -(-2 * n // ITEMS), -(-2 * b // ITEM_BYTES))
    rows = pick(docs, doc=id_col, body=text_col).withColumn("body", F.col("body").cast("string"))
    schema = f"doc_id {rows.schema['doc'].dataType.simpleString()}, " \
             f"item_id {items.schema['item'].dataType.simpleString()}, similarity double, first_word long"
    found = None
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("body"), F.lit(passes)) == i).collect()  # bounded: about ITEMS / 2 rows
        index = build_index([r["item"] for r in part], [r["body"] for r in part])
        one = rows.mapInArrow(task(_scan, index, percent), schema)
        found = one if found is None else found.unionByName(one)
    return found
