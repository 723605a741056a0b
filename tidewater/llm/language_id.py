"""Language of a text by a linear-chain conditional random field over its words (operator 9).

Every word of a text gets a probability for each language: its features are the word's
byte bigrams and trigrams, its first and last bytes (affixes) and whether a lexicon, the
words that the training texts of one language use nearly alone, holds it; learned
transitions tie neighbouring words, so short foreign words in a passage follow their
neighbours while code-switched passages can change language.  Probabilities come from
forward-backward over the whole text.  The text's language has the largest mean
probability, which is the score.

The model is trained in numpy on a bounded sample of labelled rows: about
``rows_per_language`` pieces of text a language, chosen by a hash of id and piece; texts of
more than ``max_bytes`` bytes are cut into shorter pieces.  Spans of texts in different languages are glued into training
sequences, since transitions can only be learned where the language changes.

Special cases.  Null text or no letter: ``und``, score 0.  No labelled training row: every
text is ``und``.  A null id counts as held out.  Ties take the first language by name.
Repeated rows get equal predictions and are learned from once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, crc32_of, pick, slices, text_bytes, words_of
from .tasks import task

_LETTER = regex.compile(r"\p{L}")
_BUCKETS = 1 << 16
UND = "und"


@dataclass(frozen=True)
class Training:
    rows_per_language: int = 250
    max_bytes: int = 16384
    span_words: tuple[int, int] = (6, 40)
    sequence_words: int = 64
    steps: int = 30
    rate: float = 0.35
    penalty: float = 1e-4
    seed: int = 11


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray      # [3 * buckets, labels]: bigrams, trigrams, affixes
    lexicon: np.ndarray    # sorted word hashes
    lexicon_of: np.ndarray  # label of each
    lexicon_weight: np.ndarray  # [labels, labels]
    trans: np.ndarray      # [labels, labels] log weights


def _features(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the words ``at`` and where each word's begin."""
    size = (w.end - w.start)[at]
    stop = np.cumsum(size + 2)
    flat = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.int64)  # a blank on both sides
    begin = stop - size - 2
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[place + np.repeat(begin + 1, size)] = w.buf[place + np.repeat(w.start[at], size)]
    n = len(flat)
    word = np.repeat(np.arange(len(at)), size + 2)
    two = flat[:-1] * 256 + flat[1:] if n > 1 else flat[:0]
    three = ((flat[:-2] * 65536 + flat[1:-1] * 256 + flat[2:]) * 0x9E3779B1 >> 12) % _BUCKETS if n > 2 else flat[:0]
    same2 = np.flatnonzero(word[:-1] == word[1:])
    same3 = np.flatnonzero(word[:-2] == word[2:])
    head, tail = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for k in range(4):
        inside = k < size
        head = head * 257 + np.where(inside, flat[np.minimum(begin + 1 + k, n - 1)], 256) if n else head
        tail = tail * 257 + np.where(inside, flat[np.maximum(stop - 2 - k, 0)], 256) if n else tail
    affix = np.concatenate([(head * 0x85EBCA77 >> 13) % _BUCKETS, (tail * 0xC2B2AE3D >> 13) % _BUCKETS])
    ids = np.concatenate([two[same2], _BUCKETS + three[same3], 2 * _BUCKETS + affix])
    owner = np.concatenate([word[same2], word[same3], np.arange(len(at)), np.arange(len(at))])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(at)))


def _lexicon_rows(m: Model, h: np.ndarray) -> np.ndarray:
    if not len(m.lexicon):
        return np.zeros((len(h), len(m.labels)))
    at = np.minimum(np.searchsorted(m.lexicon, h), len(m.lexicon) - 1)
    return np.where((m.lexicon[at] == h)[:, None], m.lexicon_weight[m.lexicon_of[at]], 0.0)


def _emissions(m: Model, w: Words, h: np.ndarray) -> np.ndarray:
    """Log weight of each language for each word, computed once per distinct word."""
    distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
    ids, first = _features(w, at)
    e = np.add.reduceat(m.grams[ids], first, axis=0, dtype=np.float64) + _lexicon_rows(m, distinct)
    return e[back]


def _forward_backward(e: np.ndarray, t: np.ndarray, into: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Marginals of sequences: weights ``e[n, length, labels]``, messages from both sides."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = into
    for i in range(length):
        a = (a @ t) * e[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = out
    for i in range(length - 1, -1, -1):
        beta[:, i] = b
        b = (e[:, i] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=2, keepdims=True)


def marginals(m: Model, e: np.ndarray, first: np.ndarray, piece: int = 64) -> np.ndarray:
    """Exact marginals for every word of every text.

    Texts are cut into pieces of equal length; the product of a piece's transfer matrices
    carries the messages over it, so the sequential part is one step per piece."""
    n, k = e.shape
    t = np.exp(m.trans - m.trans.max())
    count = np.diff(first)
    pieces = -(-count // piece)
    at = np.concatenate(([0], np.cumsum(pieces)))
    p = np.ones((int(at[-1]), piece, k))
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.arange(n) - first[doc]
    row, col = at[doc] + inside // piece, inside % piece
    p[row, col] = np.exp(e - e.max(axis=1, keepdims=True))
    used = np.zeros((len(p), piece), dtype=bool)
    used[row, col] = True
    over = np.broadcast_to(np.eye(k), (len(p), k, k)).copy()
    for i in range(piece):
        step = (over @ t) * p[:, i][:, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        over = np.where(used[:, i][:, None, None], step, over)
    into, out = np.full((len(p), k), 1.0 / k), np.ones((len(p), k))
    live = np.flatnonzero(pieces > 1)
    j = 1
    while len(live):
        x = (into[at[live] + j - 1][:, None, :] @ over[at[live] + j - 1])[:, 0]
        into[at[live] + j] = x / x.sum(axis=1, keepdims=True)
        back = at[live + 1] - 1 - j
        y = (over[back + 1] @ out[back + 1][:, :, None])[:, :, 0]
        out[back] = y / y.sum(axis=1, keepdims=True)
        j += 1
        live = live[pieces[live] > j]
    # Places behind a text's end carry weight one and must not move the message from its end.
    alpha, beta = np.empty_like(p), np.empty_like(p)
    a = into
    for i in range(piece):
        x = (a @ t) * p[:, i]
        a = x / x.sum(axis=1, keepdims=True)
        alpha[:, i] = a
    b = out
    for i in range(piece - 1, -1, -1):
        beta[:, i] = b
        x = (p[:, i] * b) @ t.T
        b = np.where(used[:, i][:, None], x / x.sum(axis=1, keepdims=True), b)
    g = (alpha * beta)[row, col]
    return g / g.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], p: Training = Training()) -> Model | None:
    """Train on labelled texts by full-batch Adagrad on the conditional likelihood."""
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    labels = sorted(set(langs))
    w = words_of(pa.array(texts, pa.string()), lower=True)
    if not labels or not len(w.start):
        return None
    k, h = len(labels), w.hashes()
    label = np.array([labels.index(x) for x in langs])
    of_word = np.repeat(label, np.diff(w.first))
    distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
    share = np.zeros((len(distinct), k))
    np.add.at(share, (back, of_word), 1)
    rate = share / np.maximum(np.bincount(of_word, minlength=k), 1)
    own = rate.argmax(axis=1)
    known = (share.sum(axis=1) >= 3) & (rate.max(axis=1) >= 0.8 * rate.sum(axis=1))
    m = Model(labels, np.zeros((3 * _BUCKETS, k), dtype=np.float32), distinct[known], own[known],
              np.zeros((k, k)), np.zeros((k, k)))
    # Training sequences: spans of random texts, glued and cut to one length.
    r = np.random.default_rng(p.seed)
    spans, total = [], 0
    while total < len(h):
        d = int(r.integers(len(texts)))
        n = int(r.integers(*p.span_words))
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b > a:
            s = a + int(r.integers(max(1, b - a - n + 1)))
            spans.append(np.arange(s, min(b, s + n)))
            total += len(spans[-1])
        else:
            total += 1
    flat = np.concatenate(spans) if spans else np.arange(len(h))
    length = min(p.sequence_words, len(flat))
    flat = flat[:len(flat) // length * length].reshape(-1, length)
    truth, word = of_word[flat], back[flat]
    ids, first = _features(w, at)
    owner = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(ids))))
    lex = np.full(len(distinct), -1)
    lex[known] = own[known]
    params = [m.grams.astype(np.float64), m.lexicon_weight, m.trans]
    past = [np.full_like(x, 1e-8) for x in params]
    one, n = np.ones((len(flat), k)), flat.size
    uniform = one / k
    for _ in range(p.steps):
        grams, lexw, trans = params
        e = np.add.reduceat(grams[ids], first, axis=0)
        e[lex >= 0] += lexw[lex[lex >= 0]]
        x = np.exp(e - e.max(axis=1, keepdims=True))[word]
        t = np.exp(trans - trans.max())
        alpha, beta = np.empty_like(x), np.empty_like(x)
        a = uniform
        for i in range(length):
            a = (a @ t) * x[:, i]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, i] = a
        b = one
        for i in range(length - 1, -1, -1):
            beta[:, i] = b
            b = (x[:, i] * b) @ t.T
            b /= b.sum(axis=1, keepdims=True)
        g = alpha * beta
        g /= g.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * t * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        d_trans = pair.sum(axis=(0, 1))
        np.subtract.at(d_trans, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
        g[np.arange(len(flat))[:, None], np.arange(length), truth] -= 1
        d_word = np.stack([np.bincount(word.ravel(), g[:, :, j].ravel(), len(distinct)) for j in range(k)], axis=1)
        d_grams = np.stack([np.bincount(ids, d_word[owner, j], 3 * _BUCKETS) for j in range(k)], axis=1)
        d_lex = np.zeros((k, k))
        np.add.at(d_lex, lex[lex >= 0], d_word[lex >= 0])
        for value, grad, seen in zip(params, (d_grams, d_lex, d_trans), past):
            grad = grad / n + p.penalty * value / 100
            seen += grad * grad
            value -= p.rate * grad / np.sqrt(seen)
    m.grams, m.lexicon_weight, m.trans = params[0].astype(np.float32), params[1], params[2]
    return m


def _predict(m: Model | None, names: tuple = ("doc_id", "held_out")):
    """The columns ``names`` of each row, ``lang_pred`` and ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "body"):
            col = s.column("body")
            lang, score = [UND] * s.num_rows, np.zeros(s.num_rows)
            if m is not None:
                w = Words(*text_bytes(col), lower=True)
                mean = np.zeros((s.num_rows, len(m.labels)))
                count = np.diff(w.first)
                if len(w.start):
                    g = marginals(m, _emissions(m, w, w.hashes()), w.first)
                    full = np.flatnonzero(count)
                    mean[full] = np.add.reduceat(g, w.first[full], axis=0) / count[full, None]
                best = mean.argmax(axis=1)
                for i, text in enumerate(col.to_pylist()):
                    if text and _LETTER.search(text):
                        lang[i] = m.labels[best[i]]
                        score[i] = min(1.0, float(mean[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [*(s.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)],
                names=[*names, "lang_pred", "score"])

    return run


def training_sample(docs: DataFrame, p: Training = Training(), *, id_col="doc_id", text_col="text",
                    lang_col="lang") -> list:
    """About ``rows_per_language`` labelled pieces a language, of ids that are not held out.

    A text of up to ``max_bytes`` bytes is one piece, a longer one is cut into pieces that
    are shorter, so every language is learned however long its texts are.  Equal pieces of one
    id count once, both for the share that is taken and in what is taken."""
    rows = pick(docs, doc=id_col, body=text_col, lang=lang_col)
    rows = rows.filter((F.pmod(crc32_of(F.col("doc")), F.lit(3)) != 1) & F.col("lang").isNotNull() &
                       F.col("body").isNotNull())
    wide = max(1, p.max_bytes // 4)  # characters: four bytes each at most
    cut = F.when(F.octet_length("body") <= p.max_bytes, F.array(F.col("body"))).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.char_length("body") - 1) / wide).cast("int")),
        lambda i: F.substring("body", i * wide + 1, F.lit(wide))))
    pieces = rows.select("doc", F.col("lang").cast("string").alias("lang"), F.explode(cut).alias("body"))
    pieces = pieces.withColumn("h", F.xxhash64("doc", "body"))
    # bounded: one row per language
    counts = pieces.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")).collect()
    lot = F.pmod(F.xxhash64("h", F.lit(p.seed)), F.lit(1 << 30))
    limit = F.lit(0)
    for r in counts:
        limit = F.when(F.col("lang") == r["lang"], F.lit(
            -(-(1 << 30) * p.rows_per_language // max(r["count"], p.rows_per_language)))).otherwise(limit)
    # bounded: about rows_per_language different pieces of max_bytes bytes for each language
    return pieces.filter(lot < limit).dropDuplicates(["lang", "h"]).select("body", "lang").collect()


def _trained(docs: DataFrame, p: Training, **columns: str) -> Model | None:
    sample = training_sample(docs, p, **columns)
    return fit([r["body"] for r in sample], [r["lang"] for r in sample], p)


def identify_language(docs: DataFrame, p: Training = Training(), *, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    model = _trained(docs, p, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = pick(docs, doc=id_col, body=text_col)
    held = F.coalesce(F.pmod(crc32_of(F.col("doc")), F.lit(3)) == 1, F.lit(True))
    rows = rows.select(F.col("doc").alias("doc_id"), F.col("body").cast("string").alias("body"), held.alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task(_predict, model),
                           f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def languages_beside(docs: DataFrame, p: Training = Training(), *, id_col: str = "doc_id",
                     text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All rows of ``docs`` with all their columns, under the names ``c0, c1, ...`` in order,
    and ``lang_pred, score``."""
    model = _trained(docs, p, id_col=id_col, text_col=text_col, lang_col=lang_col)
    at = [i for i, c in enumerate(docs.columns) if c == text_col] or \
        [i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower()]
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    out = T.StructType([*flat.schema.fields, T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return flat.withColumn("body", F.col(names[at[0]]).cast("string")).mapInArrow(
        task(_predict, model, tuple(names)), out)
