"""Language-model scores of texts (operator 5).

Two scores, both log10 probabilities of a whole text as its lower-cased words and an end:

* ``base_score``: add-half unigram over all training words of the corpus.  Every task sends
  its distinct words with the documents they stand in and how often, by hash range, to the task that
  counts that range over the corpus; the counts come back as partial sums a document.
* ``score``: a causal self-attention model reads subword ids and gives p(class | context) of
  the next subword; a softmax over classes of subwords, each of which has its own p(id | class),
  is a probability of ids at a hundredth of the work.  It learns from every training document (long
  ones are cut in pieces, not left out): neighbour counts for the classes are summed over all pieces, and
  the weights are trained in Spark tasks, each on a shard of the pieces, and averaged over the shards after
  each of a few rounds; every subword but the first of a run of about 200,000 is a target.  The word among
  those of its class sequence s comes from the whole training corpus,
  p(word | s) = (c(word) + prior * q(word | s)) / (c(s) + prior), where q is the product of
  the subwords' p(id | class), smoothed counts of the whole training corpus.  Class sequences are counted
  like words, in the same shuffle.  A text is cut in windows of ``window`` subwords that overlap by ``context``; a window
  scores only the subwords that the one before did not, so each is scored once and sees at
  least the ``context`` before it or all there is; the context only serves as keys.  Windows
  go through the masked attention in batches.

Special cases.  Null, empty or blank text: the end alone.  A null id counts as held out.
Without training documents all words are unknown and every class is equally likely.
Repeated rows: scored each.  Very long texts are more windows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, crc32_of, groups, mix, pick, slices, staged, text_bytes, width
from .tasks import task

END_WORD = U64(0x0DDB1A5E5BAD5EED)
BATCH_BYTES = 3 << 20
WINDOWS = 128
LOTS = 1 << 30
REMEMBERED = 500_000  # words
OFTEN = 800          # ids that are counted as neighbours
BLOCK = 1024         # ids of a block of sums
CELLS = 4_000_000    # neighbour counts that a task holds, about
#: Block of ids (-1: the weights that all ids share), places in it, and a row of values a place.
Sums = tuple[int, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Training:
    share: float = 1.0            # of the training pieces: all; of a smaller one
    least: int = 8 << 20          # at least about so many bytes
    max_bytes: int = 16384        # bytes of a piece
    classes: int = 64
    dim: int = 16
    window: int = 48
    context: int = 24
    steps: int = 400              # at least; more as the pieces grow
    shard: int = 1 << 21          # ids that one task trains on in a round, about
    rounds: int = 4               # at most
    batch: int = 64
    rate: float = 0.02
    seed: int = 3
    prior: float = 16.0           # weight of the subwords' own counts against the corpus counts


@dataclass
class Model:
    ranks: str
    pattern: str
    window: int
    context: int
    class_of: np.ndarray   # by id; the last id is the end
    inside: np.ndarray     # log10 p(id | class)
    weights: dict
    prior: float


@functools.lru_cache(maxsize=2)
def subwords(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in fh if x.strip())}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={"\n": len(ranks) + 1}), len(ranks)


def word_ids(enc, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, each with a leading blank, and where each word's begin.  The
    words are encoded in one call: no word holds a newline, and as a special token it
    parts the text before the pattern is applied, so each word is encoded by itself."""
    if not words:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    ids = enc.encode_to_numpy((b" " + b"\n ".join(words)).decode(), allowed_special={"\n"})
    cut = np.flatnonzero(ids == enc.max_token_value)
    return np.delete(ids, cut), np.append(0, cut - np.arange(len(cut)))


_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)
_OF_SIZE = mix(np.arange(65, dtype=U64) * U64(0xD1342543DE82EF95))


def _names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of words, from 8 bytes at a time; of longer words than 64 bytes, their hashes."""
    left = end - start
    name, here, at = _OF_SIZE.take(np.minimum(left, 64)), np.arange(len(start)), start
    eights = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(8, dtype=np.uint8)), 8)
    for _ in range(8):
        name[here] = mix(name[here] ^ (eights[at].view("<u8")[:, 0] & _FIRST_BYTES.take(np.minimum(left, 8))))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return name
        here, at, left = here[more], at[more] + 8, left[more] - 8
    far = Words.__new__(Words)
    far.buf, far.start, far.end = buf, start[here], end[here]
    name[here] = far.hashes()
    return name


class Grown:
    """An array ``all[:n]`` that grows into room kept behind it."""

    def __init__(self, x, kind):
        self.all, self.n = np.array([x], dtype=kind), 1

    def add(self, x: np.ndarray) -> None:
        n = self.n + len(x)
        if n > len(self.all):
            self.all = np.resize(self.all, 2 * n)
        self.all[self.n:n] = x
        self.n = n


class Lexicon:
    """Ids of the words that were met, found by the words' names.  Place 0 is the end."""

    def __init__(self, enc, end: int):
        self.enc, self.end = enc, end
        self.forget()

    def forget(self) -> None:
        self.name, self.ids = Grown(END_WORD, U64), Grown(self.end, np.int32)
        self.first, self.n = Grown(0, np.int64), Grown(1, np.int64)  # by place: of its ids
        self.found = [(self.name.all, self.first.all)]               # names in order with their places

    def read(self, buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: their lower-cased words, all words' places, all ids, each text's between two
        ends, and where the ids of each word or end end."""
        w = Words(buf, off, lower=True)
        name = _names(w.buf, w.start, w.end)
        order = np.argsort(name)
        own = name[order]
        new = np.append(True, own[1:] != own[:-1])[:len(own)]
        one, own = order[new], own[new]
        place, unmet = np.zeros(len(own), dtype=np.int64), np.arange(len(own))
        for names, their in self.found:
            at = np.searchsorted(names, own[unmet])
            at[at == len(names)] = 0
            met = names[at] == own[unmet]
            place[unmet[met]] = their[at[met]]
            unmet = unmet[~met]
        if len(unmet):
            place[unmet] = np.arange(self.n.n, self.n.n + len(unmet))
            self._learn(w, one[unmet], own[unmet], place[unmet])
        places = np.empty(len(name), dtype=np.int64)
        places[order] = place[np.cumsum(new) - 1]
        words = np.diff(w.first)
        stop = np.cumsum(words + 2)
        ended = np.zeros(len(places) + 2 * len(words), dtype=np.int64)
        inner = np.ones(len(ended), dtype=bool)
        inner[stop - 1] = inner[stop - words - 2] = False
        ended[inner] = places
        n = self.n.all.take(ended)
        after = np.cumsum(n)
        at = np.repeat(self.first.all.take(ended) - after + n, n) + np.arange(after[-1])
        return w, places, self.ids.all.take(at), after

    def _learn(self, w: Words, at: np.ndarray, name: np.ndarray, place: np.ndarray) -> None:
        raw = w.buf.tobytes()
        ids, first = word_ids(self.enc, [raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
        self.first.add(first + self.ids.n)
        self.n.add(np.diff(np.append(first, len(ids))))
        self.ids.add(ids)
        self.name.add(name)
        self.found.append((name, place))
        while len(self.found) > 1 and len(self.found[-2][0]) < 2 * len(self.found[-1][0]):
            name, place = (np.concatenate(x) for x in zip(self.found.pop(), self.found.pop()))
            order = np.argsort(name, kind="stable")
            self.found.append((name[order], place[order]))


@functools.lru_cache(maxsize=1)
def _lexicon(ranks: str, pattern: str) -> Lexicon:
    """One per Python worker, which serves many tasks."""
    return Lexicon(*subwords(ranks, pattern))


# -- attention ----------------------------------------------------------------------------------

class Room:
    """Arrays that batch after batch is computed in: fresh ones cost more than what is done in them."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, like: np.ndarray, *shape: int) -> np.ndarray:
        n, x = math.prod(shape), self.held.get(name)
        if x is None or x.size < n or x.dtype != like.dtype:
            x = self.held[name] = np.empty(n, dtype=like.dtype)
        return x[:n].reshape(shape)

    def dot(self, name: str, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """``x @ m`` for all places of all windows as one product."""
        out = self(name, x, *x.shape[:-1], m.shape[1])
        np.matmul(x.reshape(-1, x.shape[-1]), m, out=out.reshape(-1, m.shape[1]))
        return out

    def total(self, name: str, x: np.ndarray) -> np.ndarray:
        """Sums over the last axis, kept, which a product makes faster than ``sum`` over few items."""
        return self.dot(name, x, np.ones((x.shape[-1], 1), dtype=x.dtype))

    def turned(self, name: str, x: np.ndarray) -> np.ndarray:
        """``x`` with its last axes exchanged, in the order that products read fastest."""
        out = self(name, x, x.shape[0], x.shape[2], x.shape[1])
        out[...] = x.transpose(0, 2, 1)
        return out

    def placed(self, w: dict, x: np.ndarray) -> np.ndarray:
        """Embeddings of the ids ``x[n, t]`` at their places."""
        h = w["e"].take(x, axis=0, out=self("h", w["e"], *x.shape, w["e"].shape[1]), mode="clip")
        h += w["p"][:x.shape[1]]
        return h


def _across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` in blocks of rows, which the product takes faster than many rows at once."""
    n = len(x) // 128
    out = x[128 * n:].T @ y[128 * n:]
    if n:
        blocks = (z[:128 * n].reshape(n, 128, -1) for z in (x, y))
        out += np.matmul(next(blocks).transpose(0, 2, 1), next(blocks)).sum(axis=0)
    return out


def _exp(x: np.ndarray, sure: int):
    """Makes ``x`` its ``exp`` up to a factor a row; returns the logs of the factors.  Rows are lowered by
    their maxima, which take longer than ``exp``, only if values are so far from 0 that ``exp`` or
    its sums might leave the range of floats; item ``sure`` of a row is one that is not masked."""
    top = 0.0
    if not (x.size and x.max() < 50 and x[..., sure].min() > -50):
        top = x.max(axis=-1, keepdims=True)
        x -= top
    np.exp(x, out=x)
    return top


@functools.lru_cache(maxsize=64)
def _mask(a: int, t: int) -> np.ndarray:
    """Added to scores of the places from ``a`` on: no place sees one behind it."""
    return np.triu(np.full((t - a, t), -1e9, dtype=np.float32), 1 + a)


def _logits(w: dict, x: np.ndarray, room: Room | None = None) -> tuple:
    """Logits of the class after each place of the windows of ids ``x[n, t]``.  The attention is kept as
    its exponentials ``a`` and the inverse ``r`` of their sums; ``qkv`` has queries of scaled scores."""
    room = room or Room()
    (n, t), d = x.shape, w["e"].shape[1]
    h = room.placed(w, x)
    m_qkv = np.hstack([w["q"] / np.float32(np.sqrt(d)), w["k"], w["v"]])
    qkv = room.dot("qkv", h, m_qkv)
    a = np.matmul(qkv[..., :d], room.turned("keys", qkv[..., d:2 * d]), out=room("a", h, n, t, t))
    a += _mask(0, t)
    _exp(a, 0)
    r = room.total("r", a)
    np.divide(1, r, out=r)
    m = np.matmul(a, qkv[..., 2 * d:], out=room("m", h, n, t, d))
    m *= r
    z = room.dot("z", m, w["o"])
    z += h
    out = room.dot("out", z, w["u"])
    out += w["b"]
    return out, (h, m_qkv, qkv, a, r, m, z)


def _logits_from(w: dict, x: np.ndarray, a: int, room: Room) -> np.ndarray:
    """Class logits, but for the classes' own ``b``, after the places from ``a`` on, all places being
    seen: ``_logits`` without the work for places that only serve as context."""
    (n, t), d = x.shape, w["e"].shape[1]
    h = room.placed(w, x)
    own = h[:, a:]
    q = room.dot("q", own, w["q"] @ w["k"].T / np.float32(np.sqrt(d)))
    s = np.matmul(q, room.turned("keys", h), out=room("s", h, n, t - a, t))
    s[..., a:] += _mask(a, t)[:, a:]
    _exp(s, 0)
    m = np.matmul(s, h, out=room("m", h, n, t - a, d))
    r = room.total("r", s)
    np.divide(1, r, out=r)
    m *= r
    z = room.dot("z", m, w["v"] @ w["o"])
    z += own
    return room.dot("out", z, w["u"])


def _gradients(w: dict, x: np.ndarray, y: np.ndarray, room: Room | None = None, loss: bool = True) -> tuple[float | None, dict]:
    """The loss, unless it is not asked for, and its gradients."""
    room = room or Room()
    n, t = x.shape
    c, d = len(w["b"]), w["e"].shape[1]
    p, (h, m_qkv, qkv, a, r, m, z) = _logits(w, x, room)
    flat = lambda z: z.reshape(-1, z.shape[-1])
    at = np.arange(0, n * t * c, c) + y.ravel()
    said = p.reshape(-1).take(at) if loss else 0
    top = _exp(p, int(w["b"].argmax()))
    total = room.total("total", p)
    lost = (np.log(total) + top).mean() - said.mean() if loss else None
    p.reshape(-1)[at] -= total.ravel()
    total *= n * t
    np.divide(1, total, out=total)  # the gradient by logits is this times p
    g = {"b": (total.reshape(1, -1) @ flat(p))[0]}
    dz = room.dot("dz", p, w["u"].T)
    dz *= total
    z *= total
    g["u"] = _across(flat(z), flat(p))
    g["o"] = _across(flat(m), flat(dz))
    dm = room.dot("dm", dz, w["o"].T)
    m *= dm
    own = room.total("own", m)  # the sum of a * da over the keys
    own *= r
    dm *= r
    d_qkv = room("d_qkv", h, n, t, 3 * d)
    np.matmul(a.transpose(0, 2, 1), dm, out=d_qkv[..., 2 * d:])
    da = np.matmul(dm, room.turned("keys", qkv[..., 2 * d:]), out=room("da", h, n, t, t))
    da -= own
    da *= a
    np.matmul(da, qkv[..., d:2 * d], out=d_qkv[..., :d])
    np.matmul(da.transpose(0, 2, 1), qkv[..., :d], out=d_qkv[..., d:2 * d])
    dh = room.dot("dh", d_qkv, m_qkv.T)
    dh += dz
    g["q"], g["k"], g["v"] = np.hsplit(_across(flat(h), flat(d_qkv)), 3)
    g["q"] = g["q"] / np.float32(np.sqrt(d))
    g["p"] = np.zeros_like(w["p"])
    g["p"][:t] = dh.sum(axis=0)
    ids = x.astype(np.min_scalar_type(len(w["e"]) - 1)).ravel()
    order = np.argsort(ids, kind="stable")  # of the embeddings only the ids that occur
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["e"] = ids[first], np.add.reduceat(flat(dh).take(order, axis=0), first)
    return lost, g


def _places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids seen 3 times and more; by id its row among those and its place among the most frequent
    ids, -1 without one."""
    often, seen = np.argsort(-count, kind="stable")[:OFTEN], np.flatnonzero(count >= 3)
    row, place = np.full(len(count), -1), np.full(len(count), -1)
    row[seen], place[often] = np.arange(len(seen)), np.arange(len(often))
    return seen, row, place


def _neighbours(pieces, row: np.ndarray, place: np.ndarray) -> Iterator[Sums]:
    """How often each of the most frequent ids stands to the left and right of ids in the pieces:
    sums for cells of ``2 * OFTEN`` a row."""
    held, size = [], 0
    for ids, inner in _chunks(pieces, 1 << 20):
        pair, n = np.unique((ids[:-1] * len(row) + ids[1:])[inner], return_counts=True)
        left, right = np.divmod(pair, len(row))
        a, b = (row[left] >= 0) & (place[right] >= 0), (row[right] >= 0) & (place[left] >= 0)
        code = np.concatenate([row[left[a]] * 2 * OFTEN + place[right[a]],
                               row[right[b]] * 2 * OFTEN + OFTEN + place[left[b]]])
        held.append((code, np.concatenate([n[a], n[b]])))
        size += len(code)
        if size > CELLS:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > CELLS // 2:
                yield from _blocks(*held[0], BLOCK * 2 * OFTEN)
                held, size = [], 0
    if held:
        yield from _blocks(*_merged(held), BLOCK * 2 * OFTEN)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells in ascending order with the sums of their counts."""
    code, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[:len(code)]
    return code[first], np.add.reduceat(n[order], first) if len(code) else n


def _blocks(at: np.ndarray, value: np.ndarray, cells: int) -> Iterator[Sums]:
    """Rows of ``value`` at ascending places ``at``, cut in blocks of ``cells`` places."""
    cut = np.searchsorted(at, np.arange(0, int(at[-1]) + 1 + cells, cells)) if len(at) else ()
    for block, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            yield block, at[a:b] - block * cells, value[a:b].astype(np.float64).reshape(b - a, -1)


def _cluster(seen: np.ndarray, x: np.ndarray, count: np.ndarray, classes: int, r) -> np.ndarray:
    """Class of each id: k-means over the reduced neighbour counts ``x`` of the ids ``seen``, both sides."""
    class_of = np.full(len(count), max(0, classes - 2), dtype=np.uint8)  # rare ids: the last but one
    class_of[-1] = classes - 1                                          # the end: the last class
    own_classes = max(1, classes - 2)
    x, seen = x[seen < len(count) - 1], seen[seen < len(count) - 1]
    if len(seen) <= classes:
        class_of[seen] = np.arange(len(seen)) % own_classes
        return class_of
    np.sqrt(x, out=x)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 1e-9
    y = x @ r.normal(size=(x.shape[1], 48)).astype(np.float32)
    y = x @ np.linalg.qr(x.T @ np.linalg.qr(y)[0])[0]  # one power step towards the main directions
    y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-9
    weight = count[seen].astype(np.float64)
    centre = y[r.choice(len(y), own_classes, replace=False, p=weight / weight.sum())]
    weight = np.sqrt(weight).astype(np.float32)
    for _ in range(15):
        own = (y @ centre.T).argmax(axis=1)
        for c in range(own_classes):
            mine = own == c
            if mine.any():
                m = (y[mine] * weight[mine, None]).sum(axis=0)
                centre[c] = m / (np.linalg.norm(m) + 1e-9)
    class_of[seen] = own
    return class_of


class Reader:
    """Counts all subwords of training texts and cuts pieces of them out as ids."""

    def __init__(self, ranks: str, pattern: str, p: Training):
        self.p, self.lexicon, self.end = p, _lexicon(ranks, pattern), subwords(ranks, pattern)[1]
        self.kind = _kind(self.end)
        self.count = np.zeros(self.end + 1, dtype=np.int64)  # how often each id was read so far

    def read(self, buf: np.ndarray, off: np.ndarray, lots: list[int], limit: int = LOTS) -> Iterator[tuple[int, int, bytes]]:
        """(lot, key, ids) of the pieces whose lot, dealt from the text's, is under ``limit``."""
        if self.lexicon.n.n > REMEMBERED:
            self.lexicon.forget()
        w, _, ids, after = self.lexicon.read(buf, off)
        self.count += np.bincount(ids, minlength=len(self.count))
        self.count[self.end] -= len(lots)  # of the ends one a text counts
        ids = ids.astype(self.kind)
        for text, (lot, a, b, size) in enumerate(zip(lots, w.first.tolist(), w.first[1:].tolist(), np.diff(off).tolist())):
            runs = _pieces(w.end[a:b] - w.start[a:b] + 1, self.p.max_bytes) if size > self.p.max_bytes else [(0, b - a)]
            begin = a + 2 * text  # of words and ends
            for i, (a, b) in enumerate(runs):
                raw = ids[after[begin + a] - (i == 0):after[begin + b + (i == len(runs) - 1)]].tobytes()
                own = (lot + i * 0x9E3779B1) % LOTS
                if own < limit:
                    yield own, int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), raw


def _kind(end: int) -> np.dtype:
    """Type of ids in pieces."""
    return np.dtype("<u2" if end < 1 << 16 else "<i4")


def _pieces(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Words of these sizes in runs of about ``most`` bytes."""
    cut = (np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1).tolist()
    return list(itertools.pairwise([0, *cut, len(size)]))


def _chunks(pieces, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of ids of pieces joined to about ``most`` ids, and which of their neighbouring ids
    stand in one piece."""
    def joined():
        ids, inner = np.concatenate(held).astype(np.int64), np.ones(n - 1, dtype=bool)
        inner[np.cumsum([len(x) for x in held])[:-1] - 1] = False
        return ids, inner

    held, n = [], 0
    for ids in pieces:
        if len(ids):
            held.append(ids)
            n += len(ids)
        if n >= most:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


# -- training -------------------------------------------------------------------------------------

@dataclass
class State:
    """Weights with the optimiser's sums, and steps done."""
    w: dict
    m1: dict
    m2: dict
    i: int

    def dense(self) -> list[np.ndarray]:
        return [x[k] for k in sorted(self.m1) for x in (self.w, self.m1, self.m2)]

    def copy(self) -> State:
        return State(*({k: v.copy() for k, v in x.items()} for x in (self.w, self.m1, self.m2)), self.i)


@dataclass(frozen=True)
class Turn:
    """One round of the training."""
    nth: int
    rounds: int
    shards: int
    passes: int
    ids: float    # of a shard, about


def _windows(ids: np.ndarray, p: Training, nth: int, r) -> Iterator[np.ndarray]:
    """Batches of windows of ids, each with the next id: every id but the first is a target."""
    t = min(p.window, len(ids) - 1)
    if t < 1:
        return
    start = np.arange(0, len(ids) - 1, t) + (r.integers(t) if nth else 0)
    start = np.append(0, np.minimum(start, len(ids) - 1 - t)) if nth else np.minimum(start, len(ids) - 1 - t)
    r.shuffle(start)
    for a in range(0, len(start), p.batch):
        yield ids[start[a:a + p.batch, None] + np.arange(t + 1)]


def _descend(pieces, start: State, class_of: np.ndarray, p: Training, turn: Turn, shard: int) -> Iterator[Sums]:
    """Steps over all of a shard's pieces, from ``start``: what the shard adds to the averages.
    An embedding is averaged by how many steps moved it, the other weights by all steps."""
    s, read, times = start.copy(), 0, np.zeros(len(class_of))
    names, f = list(s.m1), np.float32
    w, m1, m2 = (_joined(x, names) for x in (s.w, s.m1, s.m2))
    e, e2, room = s.w["e"], s.m2["e"], Room()
    r = np.random.default_rng((p.seed, turn.nth, shard))
    for ids, _ in _chunks(pieces):
        for nth in range(turn.passes):
            done = (turn.nth + min(1.0, (read + len(ids) * nth / turn.passes) / turn.ids)) / turn.rounds
            for x in _windows(ids, p, nth, r):
                s.i += 1
                _, g = _gradients(s.w, x[:, :-1], class_of[x[:, 1:]], room, False)
                rate = p.rate * min(1.0, s.i / 20) * max(0.01, 1 - done)
                rows, step = g["e"]
                times[rows] += 1
                e2[rows] = squares = e2[rows] + step ** 2
                e[rows] -= (rate * step / (np.sqrt(squares) + 1e-8)).astype(f)
                step = np.concatenate([g[k].ravel() for k in names])
                m1 *= f(.9)
                m1 += f(.1) * step
                m2 *= f(.99)
                m2 += f(.01) * step ** 2
                w -= (rate * (m1 / (1 - .9 ** s.i)) / (np.sqrt(m2 / (1 - .99 ** s.i)) + 1e-8)).astype(f)
        read += len(ids)
    if s.i > start.i:
        steps = float(s.i - start.i)
        dense = steps * np.concatenate([[steps, 1.0], *(x.ravel() for x in s.dense())])
        yield -1, np.arange(len(dense)), dense[:, None]
        rows = np.flatnonzero(times)
        yield from _blocks(rows, times[rows, None] * np.hstack([e[rows], e2[rows], np.ones((len(rows), 1))]), BLOCK)


def _joined(x: dict, names: list[str]) -> np.ndarray:
    """The arrays of ``x`` under ``names`` as one, of which they become parts."""
    joined = np.concatenate([x[k].ravel() for k in names])
    for k, part in zip(names, np.split(joined, np.cumsum([x[k].size for k in names])[:-1])):
        x[k] = part.reshape(x[k].shape)
    return joined


def _averaged(start: State, sums: Iterable[Sums]) -> State:
    """``start`` with the averages over the shards."""
    s, d = start.copy(), start.w["e"].shape[1]
    dense, e = 0.0, np.zeros((len(s.w["e"]), 2 * d + 1))
    for block, at, value in sums:
        if block < 0:
            dense = dense + value[:, 0]
        else:
            e[block * BLOCK + at] += value
    if np.ndim(dense):
        steps, *values = np.split(dense / dense[1], np.cumsum([2, *(x.size for x in s.dense())])[:-1])
        s.i += round(steps[0])
        for x, v in zip(s.dense(), values):
            x[...] = v.reshape(x.shape)
    rows = np.flatnonzero(e[:, -1])
    e = e[rows] / e[rows, -1:]
    s.w["e"][rows], s.m2["e"][rows] = e[:, :d], e[:, d:2 * d]
    return s


class Held:
    """Pieces in memory."""

    def __init__(self, found: list[tuple[int, int, bytes]], kind: np.dtype):
        self.found, self.kind = sorted(found, key=lambda x: x[1:]), kind

    def neighbours(self, row: np.ndarray, place: np.ndarray) -> Iterator[Sums]:
        return _neighbours((np.frombuffer(raw, self.kind) for _, _, raw in self.found), row, place)

    def descend(self, start: State, class_of: np.ndarray, p: Training, turn: Turn) -> Iterator[Sums]:
        for shard in range(turn.shards):
            own = turn.nth * turn.shards + shard
            yield from _descend((np.frombuffer(raw, self.kind) for lot, _, raw in self.found
                                 if lot * turn.rounds * turn.shards // LOTS == own), start, class_of, p, turn, shard)


def fit(texts: list[str], ranks: str, pattern: str, p: Training = Training()) -> Model:
    """The model of a few texts, all of their pieces being read."""
    reader = Reader(ranks, pattern, p)
    found = list(reader.read(*text_bytes(pa.array(texts, pa.string())), [i * 0x9E3779B1 % LOTS for i in range(len(texts))]))
    n = sum(len(raw) for _, _, raw in found) // reader.kind.itemsize
    return train(Held(found, reader.kind), n, reader.count, ranks, pattern, p)


def train(pieces, n_ids: int, count: np.ndarray, ranks: str, pattern: str, p: Training) -> Model:
    """The model of ``pieces`` (:class:`Held` or :class:`Staged`) of together ``n_ids`` ids, and of how
    often each id stands in all training documents."""
    r = np.random.default_rng(p.seed)
    seen, row, place = _places(count)
    x = np.zeros((len(seen), 2 * OFTEN), dtype=np.float32)
    for block, at, n in pieces.neighbours(row, place):
        x[block * BLOCK + at // (2 * OFTEN), at % (2 * OFTEN)] += n[:, 0].astype(np.float32)
    class_of = _cluster(seen, x, count, p.classes, r)
    del x
    total = np.bincount(class_of, count + 0.01, p.classes)
    inside = np.log10((count + 0.01) / total[class_of])
    c, d, f = p.classes, p.dim, np.float32
    w = {"e": (r.normal(size=(c, d)) * .3)[class_of], "p": r.normal(size=(p.window, d)) * .02, "q": r.normal(size=(d, d)) * .25,
         "k": r.normal(size=(d, d)) * .25, "v": r.normal(size=(d, d)) * .25, "o": r.normal(size=(d, d)) * .25,
         "u": r.normal(size=(d, c)) * .1, "b": np.log(np.bincount(class_of, count, c) + .5)}
    w = {k: v.astype(f) for k, v in w.items()}
    state = State(w, {k: np.zeros_like(v) for k, v in w.items() if k != "e"}, {k: np.zeros_like(v) for k, v in w.items()}, 0)
    rounds = min(p.rounds, max(1, n_ids // p.shard))
    shards = max(1, -(-n_ids // (rounds * p.shard)))
    ids = max(1.0, n_ids / (rounds * shards))
    passes = -(-p.steps // (rounds * -(-int(ids) // (p.window * p.batch))))
    for nth in range(rounds):
        turn = Turn(nth, rounds, shards, passes, ids)
        state = _averaged(state, pieces.descend(state, class_of, p, turn))
    w = state.w
    w["b"][np.bincount(class_of, minlength=c) == 0] = -1e4  # no id is in such a class
    return Model(ranks, pattern, p.window, p.context, class_of, inside, w, p.prior)


def _sequences(classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of class sequences, which are not those of words."""
    return mix(_names(classes, start, end) ^ U64(0x632BE59BD9B4E019))


class Scorer:
    """Scores texts, and remembers by place of a word its class sequence's name and log10 q(word | sequence)."""

    def __init__(self, m: Model):
        self.m, (self.enc, self.end) = m, subwords(m.ranks, m.pattern)
        self.end_q = float(m.inside[self.end])
        self.end_s = int(_sequences(m.class_of[[self.end]], np.array([0]), np.array([1]))[0])
        self.lexicon, self.room, self.known = _lexicon(m.ranks, m.pattern), Room(), None

    def _learn(self) -> None:
        """Of the words that the lexicon met since."""
        if self.known is not self.lexicon.name:  # a new memory
            self.known, self.s, self.q = self.lexicon.name, Grown(self.end_s, U64), Grown(self.end_q, np.float32)
        known, first, ids = self.s.n, self.lexicon.first, self.lexicon.ids
        if first.n > known:
            begin = first.all[known]
            ids, first = ids.all[begin:ids.n], first.all[known:first.n] - begin
            self.s.add(_sequences(self.m.class_of[ids], first, np.append(first[1:], len(ids))))
            self.q.add(np.add.reduceat(self.m.inside[ids], first))

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text's classes, and for all words in order the name of
        the class sequence and log10 q(word | sequence)."""
        raw = [b" ".join(words) for words in texts]
        total, _, places = self.classes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
        return total, self.s.all[places], self.q.all[places]

    def classes(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text's classes, how many words it has, and all words' places."""
        m, c = self.m, len(self.m.weights["b"])
        w, places, flat, after = self.lexicon.read(buf, off)
        self._learn()
        words = np.diff(w.first)
        size = np.diff(after[np.cumsum(words + 2) - 1], prepend=0)
        flat = np.append(flat, np.zeros(m.window + 1, dtype=flat.dtype))  # room for a whole window
        said_class = m.class_of.take(flat).astype(np.int64)
        begin = np.cumsum(size) - size
        total = np.zeros(len(size))
        # Windows: the first scores all its places, later ones those behind the context.
        new = m.window - m.context
        extra = np.maximum(0, -(-(size - 1 - m.window) // new))
        doc = np.repeat(np.arange(len(size)), extra + 1)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        start = begin[doc] + nth * new
        skip = np.where(nth > 0, m.context, 0)
        stop = np.minimum(m.window, begin[doc] + size[doc] - 1 - start)
        place = np.arange(m.window)
        sure, room = int(m.weights["b"].argmax()), self.room
        b = m.weights["b"] - m.weights["b"][sure]
        weight = np.exp(b)[:, None]
        for behind in sorted({0, m.context}):
            mine = np.flatnonzero(skip == behind)
            for a in range(0, len(mine), WINDOWS):
                own = mine[a:a + WINDOWS]
                at = start[own, None] + place
                out = _logits_from(m.weights, flat.take(at), behind, room)
                shape = out.shape[:2]
                y = said_class.take(at[:, behind:] + 1)
                said = b.take(y)
                y += np.arange(0, out.size, c).reshape(shape)
                said += out.reshape(-1).take(y)
                top = _exp(out, sure)
                said -= (np.log(room.dot("total", out, weight)) + top).reshape(shape)
                said *= place[behind:] < stop[own, None]
                part = said.astype(np.float64) @ np.ones(shape[1]) / np.log(10)
                total += np.bincount(doc[own], part, minlength=len(total))
        return total, words, places


# -- training documents ---------------------------------------------------------------------------

def _read(ranks: str, pattern: str, p: Training, limit: int):
    """(body, lot) of training documents -> their pieces (lot, key, ids), and once a task
    how often each id stands in all its documents (id, times)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(ranks, pattern, p)
        for s in slices(batches, "body", BATCH_BYTES):
            buf, off = text_bytes(s.column("body"))
            lots = s.column("lot").to_pylist()
            found = [x for a, b in _portions(off) for x in reader.read(
                buf[off[a]:off[b]], off[a:b + 1] - off[a], lots[a:b], limit)]
            if found:
                none = [None] * len(found)
                yield _piece(*zip(*found), none, none)
        ids = np.flatnonzero(reader.count)
        yield _piece([None], [None], [None], [ids.tolist()], [reader.count[ids].tolist()])

    return run


def _piece(*x) -> pa.RecordBatch:
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(x, kinds)], names=["lot", "key", "ids", "id", "times"])


SUMS = "block int, at binary, value binary"


def _sums(found: Iterable[Sums]) -> Iterator[pa.RecordBatch]:
    for block, at, value in found:
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([at.astype(np.int64).tobytes()], pa.binary()),
             pa.array([np.ascontiguousarray(value).tobytes()], pa.binary())], names=["block", "at", "value"])


def _arrays(at: bytes, value: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(at, np.int64)
    return at, np.frombuffer(value).reshape(len(at), -1)


def _add(cells: int):
    """Rows sorted by block -> a row per block with the sums by place, of blocks of ``cells`` places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = total = None

        def told():
            at = np.flatnonzero(total.any(axis=1)) if last >= 0 else np.arange(len(total))
            return _sums([(last, at, total[at])])

        for batch in batches:
            for block, at, value in zip(*(batch.column(c) for c in ("block", "at", "value"))):
                at, value = _arrays(at.as_py(), value.as_py())
                if block.as_py() != last:
                    if last is not None:
                        yield from told()
                    last = block.as_py()
                    total = np.zeros((cells if last >= 0 else len(at), value.shape[1]))
                total[at] += value
        if last is not None:
            yield from told()

    return run


def _count_neighbours(kind: np.dtype, row: np.ndarray, place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (np.frombuffer(x.as_buffer(), kind) for batch in batches for x in batch.column("ids"))
        yield from _sums(_neighbours(pieces, row, place))

    return run


def _train_shards(kind: np.dtype, *args):
    """Rows sorted by shard -> what the shards add to the averages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "shard"):
            pieces = (np.frombuffer(x.as_buffer(), kind) for x in t.column("ids"))
            yield from _sums(_descend(pieces, *args, t.column("shard")[0].as_py()))

    return run


class Staged:
    """Pieces (``lot, key, ids``) in a table; sums over them are made by Spark's tasks."""

    def __init__(self, found: DataFrame, kind: np.dtype, limit: int):
        self.found, self.kind, self.limit = found, kind, limit

    def _summed(self, sums: DataFrame, cells: int) -> Iterator[Sums]:
        """The sums of all tasks; they grow with the vocabulary, not with the corpus."""
        added = sums.repartition(width(sums.sparkSession), "block").sortWithinPartitions("block").mapInArrow(
            task(_add, cells), SUMS)
        for r in staged(added, "sums").toLocalIterator():
            yield r["block"], *_arrays(r["at"], r["value"])

    def neighbours(self, row: np.ndarray, place: np.ndarray) -> Iterator[Sums]:
        sums = self.found.select("ids").mapInArrow(task(_count_neighbours, self.kind, row, place), SUMS)
        return self._summed(sums, BLOCK * 2 * OFTEN)

    def descend(self, start: State, class_of: np.ndarray, p: Training, turn: Turn) -> Iterator[Sums]:
        dealt = F.floor(F.col("lot") * (turn.rounds * turn.shards) / self.limit).cast("int")
        own = self.found.select((dealt - turn.nth * turn.shards).alias("shard"), "key", "ids").filter(
            F.col("shard").between(0, turn.shards - 1))
        sums = own.repartitionById(turn.shards, "shard").sortWithinPartitions("shard", "key").mapInArrow(
            task(_train_shards, self.kind, start, class_of, p, turn), SUMS)
        return self._summed(sums, BLOCK)


def model_of(rows: DataFrame, ranks: str, pattern: str, p: Training) -> Model:
    """The model of the training documents (``doc, body, held``): of all their pieces, unless
    ``p.share`` is less than 1."""
    learn = rows.filter(~F.col("held"))
    limit = LOTS
    if p.share < 1:
        size = learn.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).collect()[0][0]  # bounded: one row
        limit = int(np.ceil(LOTS * min(1.0, max(p.share, p.least / max(1, size)))))
    lot = F.pmod(F.xxhash64("doc", F.lit(p.seed)), F.lit(LOTS))
    found = staged(learn.select("body", lot.alias("lot")).mapInArrow(
        task(_read, ranks, pattern, p, limit), "lot long, key long, ids binary, id array<int>, times array<long>"), "pieces")
    times = found.filter("key is null").select(F.explode(F.arrays_zip("id", "times")).alias("x")).groupBy(
        F.col("x.id").alias("id")).agg(F.sum("x.times").alias("times")).collect()  # bounded: one row per subword
    end = subwords(ranks, pattern)[1]
    count = np.zeros(end + 1, dtype=np.int64)
    for r in times:
        count[r["id"]] = r["times"]
    chosen, kind = found.filter("key is not null").select("lot", "key", "ids"), _kind(end)
    n = int(count.sum() + count[end])  # of all pieces: every text has two ends, of which one is counted
    if limit < LOTS:
        n = chosen.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).collect()[0][0] // kind.itemsize  # bounded: one row
    return train(Staged(chosen, kind, limit), n, count, ranks, pattern, p)


# -- corpus counts --------------------------------------------------------------------------------

SENT = "batch long, part int, names binary, n binary, q binary, docs binary, times binary, train binary, head binary"


def _send(m: Model, parts: int):
    """Per batch a row for each hash range (names, in how many documents, log10 q or NaN for a
    class sequence, these documents and how often) and, under negative ranges, the documents
    with the scores of their classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, scorer = TaskContext.get().partitionId() << 33, Scorer(m)
        for big in slices(batches, "body", BATCH_BYTES):
            for a in range(0, big.num_rows, 60000):
                s = big.slice(a, 60000)
                buf, off = text_bytes(s.column("body"))
                if scorer.lexicon.n.n > REMEMBERED:
                    scorer.lexicon.forget()
                got = [scorer.classes(buf[off[b]:off[e]], off[b:e + 1] - off[b]) for b, e in _portions(off)]
                scores, size, places = (np.concatenate(x) for x in zip(*got))
                k = s.num_rows
                # Words and ends by document, in order of their names: the distinct ones are few.
                places = np.concatenate([places, np.zeros(k, dtype=np.int64)])
                doc = np.concatenate([np.repeat(np.arange(k), size), np.arange(k)])
                used = np.flatnonzero(np.bincount(places, minlength=scorer.s.n))
                names, first, back = np.unique(np.concatenate([scorer.lexicon.name.all[used], scorer.s.all[used]]), return_index=True,
                                               return_inverse=True)
                q = np.concatenate([scorer.q.all[used], np.full(len(used), np.nan, dtype=np.float32)])[first]
                rank = np.zeros((2, scorer.s.n), dtype=np.int64)
                rank[:, used] = back.reshape(2, -1) << 16
                code = np.concatenate([rank[0].take(places) + doc, rank[1].take(places) + doc])
                code.sort()
                pair = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                times = np.diff(np.append(pair, len(code))).astype(np.uint32)
                code = code[pair]
                doc = (code & 0xFFFF).astype(np.uint16)
                n = np.bincount(code >> 16, minlength=len(names)).astype(np.uint32)
                edge = np.append(0, np.cumsum(n, dtype=np.int64))
                cut = np.searchsorted(((names >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(cut))
                train = np.packbits(~s.column("held").to_numpy(zero_copy_only=False)).tobytes()
                head = pa.BufferOutputStream()
                t = pa.table({"doc_id": s.column("doc"), "held_out": s.column("held"),
                              "n_tokens": pa.array(size + 1, pa.int64()), "score": pa.array(scores)})
                with pa.ipc.new_stream(head, t.schema) as out:
                    out.write_table(t)
                k = len(full) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, number), pa.int64()), pa.array([*full.tolist(), -1 - number % parts], pa.int32()),
                    pa.array([*(names[cut[p]:cut[p + 1]].tobytes() for p in full), None], pa.binary()),
                    pa.array([*(n[cut[p]:cut[p + 1]].tobytes() for p in full), None], pa.binary()),
                    pa.array([*(q[cut[p]:cut[p + 1]].tobytes() for p in full), None], pa.binary()),
                    pa.array([*(doc[edge[cut[p]]:edge[cut[p + 1]]].tobytes() for p in full), None], pa.binary()),
                    pa.array([*(times[edge[cut[p]]:edge[cut[p + 1]]].tobytes() for p in full), None], pa.binary()),
                    pa.array([train] * (k - 1) + [None], pa.binary()),
                    pa.array([None] * (k - 1) + [head.getvalue().to_pybytes()], pa.binary())],
                    names=["batch", "part", "names", "n", "q", "docs", "times", "train", "head"])
                number += 1

    return run


def _portions(off: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1))
        out.append((a, b))
        a = b
    return out


def _count(prior: float):
    """Rows sorted by range -> per batch its documents' partial sums, and the range's totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "part"):
            batch = t.column("batch").to_pylist()
            if t.column("part")[0].as_py() < 0:
                for b, head in zip(batch, t.column("head").to_pylist()):
                    yield _row(b, None, None, None, head, 0, 0)
                continue
            names, n, q, docs, times, train = (
                [np.frombuffer(x, dtype=kind) for x in t.column(name).to_pylist()]
                for name, kind in (("names", U64), ("n", np.uint32), ("q", np.float32), ("docs", np.uint16),
                                   ("times", np.uint32), ("train", np.uint8)))
            train = [np.unpackbits(x) for x in train]
            n = [x.astype(np.int64) for x in n]
            seen = [np.add.reduceat(f[d] * i.astype(np.int64), np.cumsum(k) - k)
                    for f, d, i, k in zip(train, docs, times, n)]
            distinct, first, back = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
            count = np.bincount(back, np.concatenate(seen), len(distinct))
            inner = np.concatenate(q)[first].astype(np.float64)
            word = ~np.isnan(inner)
            value = np.where(word, np.log10(count + 0.5), 0)
            known_word = word & (count > 0)
            inner = np.where(word, inner, 0)
            own = np.where(count > 0, np.log10(np.maximum(count, 1) + prior * 10 ** inner), np.log10(prior) + inner)
            member = np.where(word, own, -np.log10(count + prior))
            total, vocabulary, a = int(count[word].sum()), int(known_word.sum()), 0
            for b, k, d, i, f in zip(batch, n, docs, times, train):
                mine = np.repeat(back[a:a + len(k)], k)
                a += len(k)
                sums, members = np.bincount(d, value[mine] * i), np.bincount(d, member[mine] * i)
                known = np.bincount(d, known_word[mine] * i).astype(np.int64)
                yield _row(b, sums.tobytes(), members.tobytes(), known.tobytes(), None, total, vocabulary)
                total = vocabulary = 0  # told once a range

    return run


def _row(*x):
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in x[1:5]),
         pa.array([x[5]], pa.int64()), pa.array([x[6]], pa.int64())],
        names=["batch", "sums", "members", "known", "head", "total", "vocabulary"])


def _join(total: int, vocabulary: int):
    """Rows sorted by batch -> documents."""
    norm = np.log10(total + 0.5 * (vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "batch"):
            head = next(x for x in t.column("head").to_pylist() if x is not None)
            rows = pa.ipc.open_stream(head).read_all().combine_chunks()
            n = rows.num_rows
            base, member, known = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
            for s, m, k in zip(*(t.column(c).to_pylist() for c in ("sums", "members", "known"))):
                if s is not None:
                    s, m, k = np.frombuffer(s), np.frombuffer(m), np.frombuffer(k, dtype=np.int64)
                    base[:len(s)] += s
                    member[:len(m)] += m
                    known[:len(k)] += k
            tokens = rows.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks(),
                 rows.column("n_tokens").combine_chunks(), pa.array(known),
                 pa.array(np.full(n, total), pa.int64()), pa.array(base - tokens * norm),
                 pa.array(member + rows.column("score").to_numpy())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, ranks: str, pattern: str, p: Training = Training(), *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    rows = pick(docs, doc=id_col, body=text_col)
    held = F.coalesce(F.pmod(crc32_of(F.col("doc")), F.lit(5)) == 1, F.lit(True))
    rows = rows.select("doc", F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"), held.alias("held"))
    model = model_of(rows, ranks, pattern, p)
    parts = width(spark)
    sent = rows.mapInArrow(task(_send, model, parts), SENT)
    counted = staged(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(
        task(_count, p.prior), "batch long, sums binary, members binary, known binary, head binary, total long, "
        "vocabulary long"), "counts")
    total, vocabulary = counted.agg(F.coalesce(F.sum("total"), F.lit(0)),
                                    F.coalesce(F.sum("vocabulary"), F.lit(0))).collect()[0]  # bounded: one row
    kind = rows.schema["doc"].dataType.simpleString()
    return counted.select("batch", "sums", "members", "known", "head").repartition("batch").sortWithinPartitions(
        "batch").mapInArrow(task(_join, int(total), int(vocabulary)),
                            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                            "base_score double, score double")
