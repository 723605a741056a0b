"""Byte-level BPE encoding and decoding by merge replay (operator 8).

The corpus of one replay is what a task has gathered: the distinct pattern matches of its
documents that it has not met before.  Their bytes lie in one array with left and right
neighbour links.  An inverted index holds, for each merge, the positions where its pair
stands; the merges are replayed in rank order, each on all its positions at once, and only
the pairs that touch a merged position are looked up again and filed under their new rank.
Documents are then joined from the encoded matches, so the work grows with the distinct
matches of a task and no row crosses the network.

Special cases.  Null and empty text: no ids, empty bytes.  Repeated rows: equal results.
Very long texts are one row; a match of any length is replayed whole.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices
from .tasks import task

_NONE = np.int32(2**31 - 1)
#: Matches remembered by a Python worker; beyond this the memory is started anew.
REMEMBERED = 100_000
#: Text gathered for one replay.
REPLAY_BYTES = 2 << 20
#: A blank next to another white space, or at the end: the text must be split by pattern.
_RAGGED = re.compile(r"  |[^\S ] | [^\S ]| \Z")
_BETWEEN = regex.compile(r"(?<=\S) (?=\S)")


class Ranks:
    """A rank file: token bytes by id, and the merge that joins two ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as fh:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in fh if x.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where no merge joins it."""
        want = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.merged[at], _NONE)


@functools.lru_cache(maxsize=2)
def load_ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def replay(matches: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids (little-endian unsigned 32 bit) of each match, by replaying all merges at once."""
    size = np.array([len(m) for m in matches], dtype=np.int64)
    if not size.sum():
        return [b""] * len(matches)
    tok = ranks.byte_id[np.frombuffer(b"".join(matches), dtype=np.uint8)]
    n = len(tok)
    end = np.cumsum(size)
    nxt = np.arange(1, n + 1, dtype=np.int64)
    nxt[end[size > 0] - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int64)
    prv[(end - size)[size > 0]] = -1
    pair = np.full(n, _NONE, dtype=np.int32)
    has = np.flatnonzero(nxt >= 0)
    pair[has] = ranks.rank(tok[has], tok[has + 1])
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    todo: list[int] = []

    def file(at: np.ndarray) -> None:
        at = at[pair[at] != _NONE]
        if not len(at):
            return
        r = pair[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for value, part in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
            if value in index:
                index[value].append(part)
            else:
                index[value] = [part]
                heapq.heappush(todo, value)

    file(has)
    while todo:
        rank = heapq.heappop(todo)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[pair[at] == rank]
        if len(at) > 1:  # in "aaa" the left pair goes first: every other one of a chain
            chained = np.concatenate(([False], nxt[at[:-1]] == at[1:]))
            if chained.any():
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - head) % 2 == 0]
        if not len(at):
            continue
        right = nxt[at]
        after = nxt[right]
        tok[at] = rank
        alive[right] = False
        pair[right] = _NONE
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        touched = np.concatenate((at, before[before >= 0]))
        if len(touched) > 1:
            touched = np.unique(touched)
        to = nxt[touched]
        new = np.full(len(touched), _NONE, dtype=np.int32)
        ok = to >= 0
        new[ok] = ranks.rank(tok[touched[ok]], tok[to[ok]])
        pair[touched] = new
        file(touched)
    kept = tok[alive].astype("<u4")
    upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], end))]
    raw = kept.tobytes()
    return [raw[4 * a:4 * b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]


class Encoder:
    """Encodes texts, remembering the pieces met so far.

    A piece is the text between two single blanks that stand between other characters,
    with its leading blank: no match of the pattern crosses such a border."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        return _BETWEEN.split(text) if _RAGGED.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.head) + len(self.tail) > REMEMBERED:
            self.head.clear()
            self.tail.clear()
        cut = [self._pieces(t) if t else [] for t in texts]
        head = {p[0] for p in cut if p}.difference(self.head)
        tail = set().union(*(p[1:] for p in cut)).difference(self.tail)
        self._learn(list(head), self.head, "")
        self._learn(list(tail), self.tail, " ")
        get = self.tail.__getitem__
        return [self.head[p[0]] + b"".join(map(get, p[1:])) if p else b"" for p in cut]

    def _learn(self, pieces: list[str], memory: dict[str, bytes], before: str) -> None:
        found = [self.ranks.pattern.findall(before + p) for p in pieces]
        distinct = {m: i for i, m in enumerate(set().union(*found))}
        ids = replay([m.encode() for m in distinct], self.ranks)
        for piece, matches in zip(pieces, found):
            memory[piece] = b"".join([ids[distinct[m]] for m in matches])


@functools.lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    return Encoder(load_ranks(path, pattern))


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for s in slices(batches, "body", REPLAY_BYTES):
            ids = encoder.encode(s.column("body").to_pylist())
            for a in range(0, len(ids), 2048):
                part = pa.array(ids[a:a + 2048], pa.binary())
                yield pa.RecordBatch.from_arrays([s.column("doc").slice(a, len(part)), part],
                                                 names=["doc_id", "ids"])

    return run


def _bytes_of(ids: list[bytes], ranks: Ranks) -> pa.Array:
    get = ranks.bytes_of.__getitem__
    return pa.array([b"".join(map(get, np.frombuffer(x, dtype="<u4").tolist())) if x else b"" for x in ids], pa.binary())


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _bytes_of(batch.column("ids").to_pylist(), load_ranks(path, pattern))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return run


def _round_trip(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoded in _encode(path, pattern)(batches):
            yield from _decode(path, pattern)(iter([encoded]))

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids as little-endian unsigned 32-bit integers."""
    body = pick(docs, doc=id_col, body=text_col)
    body = body.withColumn("body", F.coalesce(F.col("body").cast("string"), F.lit("")))
    return body.mapInArrow(task(_encode, path, pattern),
                           f"doc_id {body.schema['doc'].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids, to ``doc_id, ids``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(
        task(_decode, path, pattern), f"doc_id {kind}, ids binary, decoded binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: encoding and decoding in one pass, so a task has one Python
    worker with one copy of the ranks and the ids do not travel in between."""
    body = pick(docs, doc=id_col, body=text_col)
    body = body.withColumn("body", F.coalesce(F.col("body").cast("string"), F.lit("")))
    kind = body.schema["doc"].dataType.simpleString()
    return body.mapInArrow(task(_round_trip, path, pattern), f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
