"""LM scores against a plain count of the corpus: base, known words, class members."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm import lm_score
from tidewater.llm.lm_score import Scorer, Training, _logits, fit, score_texts

ROWS = [(1, "The cat sat on the mat"), (2, "a dog sat"), (3, None), (4, ""), (None, "the cat"), (5, "x" * 3000),
        (6, "the The THE\tcat\x0bmat  end"), (6, "the The THE\tcat\x0bmat  end"), (7, "unseen words here"),
        (8, " \n "), (9, "été 猫 the"), *[(i, "the cat sat on a mat again and again") for i in range(10, 60)]]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = Training(classes=8, dim=4, window=8, context=2, steps=20, batch=8)


def words(text):
    return [w.decode() for w in bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame([(*r, "s", "T") for r in ROWS], "doc_id long, text string, shard string, Text string")
    return score_texts(rows, RANKS, public_tokenizers.PATTERN, SMALL).collect()


def test_scores_against_counts(scored):
    train = [words(t) for i, t in ROWS if not held(i)]
    m = fit([t or "" for i, t in ROWS if not held(i) and len((t or "").encode()) <= SMALL.max_bytes], RANKS,
            public_tokenizers.PATTERN, SMALL)
    s = Scorer(m)
    c = Counter(w for t in train for w in [*t, None])  # None: the end
    n, v = sum(c.values()), len(c)
    every = sorted({w for _, t in ROWS for w in words(t)})
    _, seq, q = s.score([[w.encode() for w in every]])
    seq, q = {**dict(zip(every, seq.tolist())), None: s.end_s}, {**dict(zip(every, q.tolist())), None: s.end_q}
    by_seq = Counter()
    for w, k in c.items():
        by_seq[seq[w]] += k
    want = []
    for i, t in ROWS:
        tokens = [*words(t), None]
        base = sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in tokens)
        classes = float(s.score([[w.encode() for w in words(t)]])[0][0])
        inner = sum((math.log10(c[w] + m.prior * 10 ** q[w]) if c[w] else math.log10(m.prior) + q[w])
                    - math.log10(by_seq[seq[w]] + m.prior) for w in tokens)
        want.append((str(i), held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, base, classes + inner))
    got = [(str(r["doc_id"]), *r[1:]) for r in scored]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-4, atol=1e-3)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(rows, RANKS, public_tokenizers.PATTERN, SMALL).count() == 0


def test_every_later_subword_sees_half_a_window():
    """Scores of long texts against one plain pass a subword, with the context of its window."""
    p = Training(steps=20)
    assert p.window >= 48 and p.context >= p.window // 2
    m = fit(["the cat sat on the mat again and again"] * 50, RANKS, public_tokenizers.PATTERN, p)
    s = Scorer(m)
    for n in (0, 1, 23, 24, 46, 47, 48, 49, 72, 200):
        words_ = [(b"cat", b"mat", b"again")[i * i % 3] for i in range(n)]
        got = float(s.score([words_])[0][0])
        ids = [s.end, *[i for w in words_ for i in s.enc.encode_ordinary(" " + w.decode())], s.end]
        flat, want, new = m.class_of[ids], 0.0, p.window - p.context
        for y in range(1, len(flat)):
            a = 0 if y <= p.window else -(-(y - p.window) // new) * new
            assert a == 0 or y - a > p.context
            out = _logits(m.weights, np.array(ids)[None, a:y])[0][0, -1].astype(float)
            want += (out[flat[y]] - np.log(np.exp(out - out.max()).sum()) - out.max()) / np.log(10)
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_the_sample_grows_and_long_documents_are_read(spark):
    """Id counts come from all training documents, and long ones are cut, not left out."""
    p = Training(classes=8, dim=4, window=8, context=4, steps=1, batch=8, least=1, share=.25, max_bytes=64)
    seen, sampled = [], []
    for n in (8, 32):
        rows = spark.createDataFrame([(i, f"{i} the cat sat on a mat " * 400, False) for i in range(n)],
                                     "doc long, body string, held boolean")
        whole = fit([r["body"] for r in rows.collect()], RANKS, public_tokenizers.PATTERN, p)
        got = {}
        real = lm_score.train
        lm_score.train = lambda pieces, n_ids, count, *a: got.update(n=n_ids, count=count) or real(pieces, n_ids, count, *a)
        try:
            m = lm_score.model_of(rows, RANKS, public_tokenizers.PATTERN, p)
        finally:
            lm_score.train = real
        enc, _ = lm_score.subwords(RANKS, public_tokenizers.PATTERN)
        want = Counter(i for r in rows.collect() for w in r["body"].split() for i in enc.encode_ordinary(" " + w))
        assert {i: k for i, k in enumerate(got["count"].tolist()[:-1]) if k} == dict(want)
        assert got["count"][-1] == n and m.class_of.shape == whole.class_of.shape
        seen.append(sum(want.values()))
        sampled.append(got["n"])
    assert .15 < sampled[0] / seen[0] < .35 and .15 < sampled[1] / seen[1] < .35


def test_scores_are_normalised_probabilities():
    """Over all next ids, p(class | ids before) * p(id | class) sums to 1."""
    m = fit(["the cat sat on the mat again and again"] * 50, RANKS, public_tokenizers.PATTERN, Training(steps=20))
    s = Scorer(m)
    ids = np.array([[s.end, *s.enc.encode_ordinary(" the cat sat")]])
    out = _logits(m.weights, ids)[0][0].astype(float)
    p = np.exp(out - out.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    assert np.allclose((p[:, m.class_of] * 10 ** m.inside).sum(axis=1), 1, atol=1e-6)


def test_attention_reads_ids():
    """Two ids of one class give different predictions, and gradients are those of the loss."""
    from tidewater.llm.lm_score import _gradients
    p = Training(classes=4, dim=4, window=8, context=4, steps=60, batch=8)
    m = fit(["a b c d a b c d", "x y z x y z"] * 40, RANKS, public_tokenizers.PATTERN, p)
    s = Scorer(m)
    ids = [s.enc.encode_ordinary(" " + c)[0] for c in "abcdxyz"]
    pairs = [(i, j) for i in ids for j in ids if i < j and m.class_of[i] == m.class_of[j]]
    assert pairs and all(not np.allclose(m.weights["e"][i], m.weights["e"][j]) for i, j in pairs)
    w = {k: v.astype(np.float64) for k, v in m.weights.items()}
    x, y = np.array([ids[:5], ids[2:]]), m.class_of[np.array([ids[1:6], ids[:5]])]
    loss, g = _gradients(w, x, y)
    rows, grad = g["e"]
    for row, d in ((0, 0), (len(rows) - 1, 3)):
        moved = {k: v.copy() for k, v in w.items()}
        moved["e"][rows[row], d] += 1e-5
        assert (_gradients(moved, x, y)[0] - loss) / 1e-5 == pytest.approx(grad[row, d], rel=1e-3, abs=1e-6)


def test_words_are_encoded_each_by_itself():
    enc, end = lm_score.subwords(RANKS, public_tokenizers.PATTERN)
    r = np.random.default_rng(4)
    some = ["a", "x\u3000", "\u3000", "\x85b", "'s", "don't", "1", "...", "\u200b", "caf\u00e9", "\x1f", "<|endoftext|>", "\U0001f600"]
    got_words = ["".join(r.choice(some, size=r.integers(1, 4))) for _ in range(2000)]
    ids, first = lm_score.word_ids(enc, [w.encode() for w in got_words])
    cut = [*first.tolist(), len(ids)]
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [enc.encode_ordinary(" " + w) for w in got_words]
    assert lm_score.word_ids(enc, [])[0].tolist() == []


def test_the_model_learns_from_every_training_document(spark):
    """Counts, neighbours and steps cover all pieces, whatever the size; sums over shards made by
    Spark are those made in memory."""
    p = Training(classes=8, dim=4, window=8, context=4, steps=1, batch=8, max_bytes=64, shard=2000, rounds=2, least=1)
    assert Training().share == 1
    docs = [(i, f"{i} the cat{i % 7} sat on a mat " * (1 + i % 40), i % 5 == 1) for i in range(400)]
    rows = spark.createDataFrame(docs, "doc long, body string, held boolean").repartition(3)
    enc, end = lm_score.subwords(RANKS, public_tokenizers.PATTERN)
    pairs, n = Counter(), 0
    for _, body, held_out in docs:
        if not held_out:
            ids = [end, *[i for w in body.split() for i in enc.encode_ordinary(" " + w)], end]
            n += len(ids)
            pairs.update(ids)
    got = []
    real = lm_score.train

    def train(pieces, n_ids, count, *a):
        seen, row, place = lm_score._places(count)
        cells = Counter()
        for block, at, value in pieces.neighbours(row, place):
            for c, v in zip(at.tolist(), value[:, 0].tolist()):
                cells[block * lm_score.BLOCK * 2 * lm_score.OFTEN + c] += v
        kept = pieces.found.collect()
        held_ = lm_score.Held([(r["lot"] * lm_score.LOTS // pieces.limit, r["key"], bytes(r["ids"])) for r in kept], pieces.kind)
        same = Counter()
        for block, at, value in held_.neighbours(row, place):
            for c, v in zip(at.tolist(), value[:, 0].tolist()):
                same[block * lm_score.BLOCK * 2 * lm_score.OFTEN + c] += v
        assert cells == same and cells
        got.append((n_ids, Counter(i for r in kept for i in np.frombuffer(r["ids"], pieces.kind).tolist())))
        return [real(x, n_ids, count, *a) for x in (pieces, held_)]

    lm_score.train = train
    try:
        spark_side, memory = lm_score.model_of(rows, RANKS, public_tokenizers.PATTERN, p)
    finally:
        lm_score.train = real
    assert got == [(n, pairs)] and n > 2 * p.shard
    assert (spark_side.class_of == memory.class_of).all()
    for k, v in memory.weights.items():
        assert np.allclose(spark_side.weights[k], v, rtol=1e-4, atol=1e-5), k


def test_every_id_of_a_piece_is_a_target():
    p = Training(window=8, batch=4)
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 8, 9, 10, 50, 1000):
        for nth in (0, 1):
            seen = {int(i) for x in lm_score._windows(np.arange(n), p, nth, r) for i in x[:, 1:].ravel()}
            assert seen == set(range(1, n)) or nth and seen <= set(range(1, n))


def test_lexicon_finds_the_ids_of_every_word(spark):
    """Words of all sizes, met in one call or in several, or after all were forgotten."""
    enc, end = lm_score.subwords(RANKS, public_tokenizers.PATTERN)
    r = np.random.default_rng(5)
    some = ["a", "B", "\x00", "é", "猫", "don't", "x" * 7, "y" * 8, "z" * 9, "q" * 63, "w" * 64, "v" * 65, "u" * 200]
    texts = ["", " \t ", *(" ".join("".join(r.choice(some, size=r.integers(1, 5))) for _ in range(r.integers(1, 40)))
                           for _ in range(300)), "tail\n"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    lexicon, got = lm_score.Lexicon(enc, end), []
    for a, b in ((0, 100), (100, 303), (0, 303)):
        w, places, ids, after = lexicon.read(np.frombuffer(b"".join(raw[a:b]), np.uint8), off[a:b + 1] - off[a])
        want = [i for t in texts[a:b] for i in [end, *(i for x in words(t) for i in enc.encode_ordinary(" " + x)), end]]
        assert ids.tolist() == want and after[-1] == len(want)
        assert np.diff(w.first).tolist() == [len(words(t)) for t in texts[a:b]]
        got.append([lexicon.name.all[p] for p in places])
    assert got[0] + got[1] == got[2]
    names = lexicon.name.all[:lexicon.name.n].tolist()
    assert len(names) == 1 + len({x for t in texts for x in words(t)}) == len(set(names))
    lexicon.forget()
    assert lexicon.read(np.frombuffer(raw[5], np.uint8), np.array([0, len(raw[5])]))[2].tolist() == [
        end, *(i for x in words(texts[5]) for i in enc.encode_ordinary(" " + x)), end]


def test_training_pieces_are_cut_at_their_bytes():
    """Pieces against a plain cut; ids are counted with one end a text."""
    p = Training(max_bytes=64)
    texts = ["", "one two", "x" * 200 + " y", *(" ".join(f"w{i * j % 97}" for j in range(i)) for i in range(60))]
    raw = [t.encode() for t in texts]
    reader = lm_score.Reader(RANKS, public_tokenizers.PATTERN, p)
    got = list(reader.read(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), list(range(len(raw)))))
    enc, end = lm_score.subwords(RANKS, public_tokenizers.PATTERN)
    want, count = [], Counter()
    for lot, t in enumerate(texts):
        at, runs = 0, {}
        for x in words(t):
            runs.setdefault(at // 64, []).append(x)
            at += len(x.encode()) + 1
        runs = list(runs.values()) or [[]]
        for i, run in enumerate(runs):
            ids = [i for x in run for i in enc.encode_ordinary(" " + x)]
            count.update(ids)
            want.append(((lot + i * 0x9E3779B1) % lm_score.LOTS, [end] * (i == 0) + ids + [end] * (i == len(runs) - 1)))
        count[end] += 1
    assert [(lot, np.frombuffer(ids, reader.kind).tolist()) for lot, _, ids in got] == want
    assert {i: n for i, n in enumerate(reader.count.tolist()) if n} == dict(count)


def test_scores_far_from_0_are_lowered_first():
    """Exponentials are taken as they are, but rows that would leave the range of floats by their maxima."""
    for x in ([[1., 2, -1e9], [3, -4, 5]], [[900, 1, 2], [1, 2, 3]], [[-900, -901, -1e9], [1, 2, 3]], [[-1e4, 60, 2]]):
        x = np.array(x, dtype=np.float32)
        y = x.copy()
        top = lm_score._exp(y, 0)
        want = np.exp(x.astype(float) - x.max(axis=1, keepdims=True).astype(float))
        assert np.allclose(y / y.sum(axis=1, keepdims=True), want / want.sum(axis=1, keepdims=True), rtol=1e-5)
        assert np.allclose(np.log(y.sum(axis=1, keepdims=True)) + top,
                           np.log(want.sum(axis=1, keepdims=True)) + x.max(axis=1, keepdims=True), rtol=1e-5)
    r = np.random.default_rng(1)
    p = Training(classes=6, dim=4, window=8)
    for scale in (1., 40.):  # the larger ones leave the range
        w = {"e": r.normal(size=(50, 4)), "p": r.normal(size=(p.window, 4)), "u": r.normal(size=(4, 6)), "b": r.normal(size=6),
             **{k: r.normal(size=(4, 4)) for k in "qkvo"}}
        w = {k: (v * (scale if k in "qku" else 1)).astype(np.float32) for k, v in w.items()}
        x = r.integers(50, size=(3, 8))
        h = w["e"][x].astype(float) + w["p"]
        s = (h @ w["q"]) @ (h @ w["k"]).transpose(0, 2, 1) / 2 + np.triu(np.full((8, 8), -np.inf), 1)
        s = np.exp(s - s.max(axis=2, keepdims=True))
        want = (h + s / s.sum(axis=2, keepdims=True) @ (h @ w["v"]) @ w["o"]) @ w["u"] + w["b"]
        assert np.allclose(_logits(w, x)[0], want, rtol=1e-3, atol=1e-3 * np.abs(want).max())
        for a in (0, 4):
            assert np.allclose(lm_score._logits_from(w, x, a, lm_score.Room()) + w["b"], want[:, a:], rtol=1e-3, atol=1e-3 * np.abs(want).max())


def test_scores_outlive_a_forgotten_lexicon():
    m = fit(["the cat sat on the mat again and again"] * 50, RANKS, public_tokenizers.PATTERN, SMALL)
    texts = [[b"the", b"cat"], [], [b"mat", b"unseen", b"the"]]
    s = Scorer(m)
    want = s.score(texts)
    for _ in range(2):
        s.lexicon.forget()
        s.lexicon.read(np.frombuffer(b"other words", np.uint8), np.array([0, 11]))
        for a, b in zip(s.score(texts), want):
            assert np.allclose(a, b) and a.shape == b.shape
