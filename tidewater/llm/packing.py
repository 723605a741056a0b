"""Packing of documents into sequences by minimum bin slack (operator 13).

Tasks encode the texts and cut them into pieces of at most ``capacity`` ids.  How pieces share
sequences depends on their lengths alone, so the plan is made from the count of each length:
at most ``capacity`` rows, whatever the corpus.  A sequence starts with the longest length
left; a subset-sum program over the lengths left, a bitset in which bit ``s`` says that ``s``
places can be filled, finds the fullest combination beside it, and all its pieces are removed.
The same combination is the fullest again until a length runs short, so it is taken that
many times at once: the plan is a list of combinations with a number of repetitions, at most
about ``capacity * (1 + ln capacity)`` of them.

Back on Spark each piece gets its rank among the pieces of its length, from the counts per
task, so a length that a third of the pieces have is no burden; the rank names the repetition
and the place in the combination, so sequence and offset are computed row by row.

Special cases.  Null and empty text: the end id alone.  A document longer than a sequence is
cut into full pieces, of which only the first may be shorter.  Repeated rows and ids, null
ids: pieces each.  Special tokens written out in a text get their ids, as in the tokenizers
library.  An empty table: no rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_letters, pick, slices, staged
from .tasks import task

CAPACITY = 2048


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, each with its number, that fill most of ``room``; long ones first, so that
    short pieces are left for later sequences."""
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted((v for v, n in counts.items() if n and v <= room), reverse=True):
        most = min(counts[length], room // length)
        steps.append((length, most, reach))
        span = 1  # sums of up to ``most`` pieces, by doubling
        while most:
            take = min(span, most)
            reach |= reach << length * take & mask
            most -= take
            span *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, []
    for length, most, before in reversed(steps):
        n = next(k for k in range(most + 1) if at >= k * length and before >> at - k * length & 1)
        if n:
            used.append((length, n))
            at -= n * length
    return used[::-1]


@dataclass(frozen=True)
class Plan:
    """One entry per length in a combination, sorted by (length, first): pieces of ``length``
    from rank ``first`` on go there, ``each`` to a sequence, from sequence ``base`` and offset ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Combinations for ``counts`` pieces of each length."""
    left = {v: n for v, n in counts.items() if n}
    if any(not 0 < v <= capacity for v in left):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    taken: Counter = Counter()
    entries, base = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        parts = Counter({longest: 1})
        parts.update(dict(fullest(left, capacity - longest)))
        left[longest] += 1
        times = min(left[v] // n for v, n in parts.items())
        offset = 0
        for v in sorted(parts, reverse=True):
            n = parts[v]
            entries.append((v, taken[v], n, base, offset))
            offset += n * v
            taken[v] += n * times
            left[v] -= n * times
            if not left[v]:
                del left[v]
        base += times
    columns = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, base)


class Vocabulary:
    """Ids of whole texts by a vocabulary file of the tokenizers library.

    A byte-level BPE whose merges stand in the order of their results' ids is run by tiktoken
    on the same bytes and ids, which gives equal ids in a quarter of the time; any other file by the
    library itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            made = json.load(fh)
        ranks = _byte_ranks(made)
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        if ranks is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(path)
            self.encode = lambda texts: [np.array(e.ids, "<u4") for e in library.encode_batch_fast(
                texts, add_special_tokens=False)]
        else:
            import tiktoken
            coder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
            named = set(special)
            self.encode = lambda texts: [np.array(coder.encode(t, allowed_special=named), "<u4") for t in texts]


# The pattern of a byte-level pre-tokenizer with use_regex.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_ranks(made: dict) -> dict[bytes, int] | None:
    """Token bytes to ids where tiktoken's rule (join the pair of lowest id) is the file's."""
    model, before = made["model"], made.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                       "ignore_merges") if model.get(k)]
    bare = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["special"]
               for t in made["added_tokens"])
    if made.get("normalizer") or not plain or model.get("type") != "BPE" or odd or not bare:
        return None
    letter = byte_letters()
    vocab, special = model["vocab"], {t["content"] for t in made["added_tokens"]}
    joined = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in joined]
    known = {a + b for a, b in joined} | set(letter)
    if ids != sorted(set(ids)) or any(t not in known and t not in special for t in vocab):
        return None
    return {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in special}


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        coder = _vocabulary(path)
        for s in slices(batches, "body"):
            row, piece, start, length, rank, ids, crc = [], [], [], [], [], [], []
            for i, found in enumerate(coder.encode(s.column("body").to_pylist())):
                raw = np.append(found, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    rank.append(int(seen[b - a]))
                    seen[b - a] += 1
                    ids.append(raw[4 * a:4 * b])
                    crc.append(zlib.crc32(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [s.column("doc").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int64()), pa.array(rank, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "local"])

    return run


def cut_documents(docs: DataFrame, vocabulary: str, *, end_id: int = 0, capacity: int = CAPACITY,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, written below the shared folder: ``doc_id, piece, start,
    length, ids`` (little-endian unsigned 32 bit), ``ids_crc32``, and ``part, local``: the task
    that made the piece and its rank there among the pieces of its length."""
    body = pick(docs, doc=id_col, body=text_col)
    body = body.withColumn("body", F.coalesce(F.col("body").cast("string"), F.lit("")))
    kind = body.schema["doc"].dataType.simpleString()
    return staged(body.mapInArrow(task(_cut, vocabulary, end_id, capacity),
                                  f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, "
                                  "part long, local long"), "pieces")


def place(length: np.ndarray, rank: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given their ranks among those of equal length."""
    low, high = np.searchsorted(plan.length, length), np.searchsorted(plan.length, length, side="right")
    while True:  # bisection inside the entries of each length
        open_ = high - low > 1
        if not open_.any():
            break
        mid = (low + high) // 2
        right = open_ & (plan.first[np.minimum(mid, len(plan.first) - 1)] <= rank)
        low, high = np.where(right, mid, low), np.where(open_ & ~right, mid, high)
    times, nth = np.divmod(rank - plan.first[low], plan.each[low])
    return plan.base[low] + times, plan.offset[low] + nth * length


def _place(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sequence, offset = place(get("length"), get("rank"), plan)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != "rank"], pa.array(sequence), pa.array(offset)],
                names=[*[c for c in batch.schema.names if c != "rank"], "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Adds ``sequence_id`` (gapless from 0) and ``offset`` to the pieces of ``cut_documents``."""
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # bounded: up to ``capacity`` rows
    plan = plan_sequences({r["length"]: r["n"] for r in lengths}, capacity)
    # One row per task and length; the pieces of a length in the tasks before.
    made = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("part")
    before = made.select(F.col("length").alias("l2"), F.col("part").alias("p2"),
                         (F.sum("n").over(upto) - F.col("n")).alias("before"))
    before = staged(before, "pieces-before")
    columns = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    ranked = pieces.join(before, (F.col("length") == F.col("l2")) & (F.col("part") == F.col("p2"))).select(
        *columns, (F.col("before") + F.col("local")).alias("rank"))
    shape = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(task(_place, plan), f"{shape}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids`` and ``doc_ids`` in order: one row per packed sequence, whose pieces
    hold ``capacity`` ids at most together."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", F.floor(F.octet_length(joined) / 4).cast("long").alias("length"),
                        joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
