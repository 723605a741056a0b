"""Packing: ids against the tokenizers library, plans against exhaustive search, whole tables."""

import itertools
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm.packing import (Vocabulary, _byte_ranks, cut_documents, fullest, pack_pieces, place, plan_sequences,
                                   sequences)
from tidewater.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(FILE)


def test_vocabulary_equals_library(library):
    r = random.Random(5)
    chars = "aAb 1\n\t\r 　'sLléß中́한\U0001f600!?.,-_<|>​ \x00\x1f١"
    texts = ["", " ", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", "x" * 30_000, " " * 3000 + "y"]
    texts += ["".join(r.choice(chars) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}a {chr(c)}1{chr(c)} \n{chr(c)}" for c in points[a:a + 256])
              for a in range(0, len(points), 256)]
    got = Vocabulary(FILE).encode(texts)
    for t, a, b in zip(texts, got, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert a.tolist() == b.ids, t


def test_other_vocabularies_go_to_the_library():
    with open(FILE, encoding="utf-8") as fh:
        made = json.load(fh)
    assert _byte_ranks(made) is not None
    assert _byte_ranks(made | {"normalizer": {"type": "Lowercase"}}) is None
    assert _byte_ranks(made | {"pre_tokenizer": made["pre_tokenizer"] | {"add_prefix_space": True}}) is None
    merges = made["model"]["merges"]
    swapped = made["model"] | {"merges": [merges[1], merges[0], *merges[2:]]}
    assert _byte_ranks(made | {"model": swapped}) is None
    other = public_tokenizers.path("word_bpe_49k.json")
    tokenizers = pytest.importorskip("tokenizers")
    want = tokenizers.Tokenizer.from_file(other).encode("Hello  World", add_special_tokens=False).ids
    assert Vocabulary(other).encode(["Hello  World"])[0].tolist() == want


def test_fullest_is_fullest():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randrange(1, 30): r.randrange(0, 4) for _ in range(6)}
        room = r.randrange(0, 60)
        used = dict(fullest(counts, room))
        assert all(0 < n <= counts[v] for v, n in used.items())
        best = max(s for combo in itertools.product(*[range(n + 1) for n in counts.values()])
                   if (s := sum(k * v for k, v in zip(combo, counts))) <= room)
        assert sum(n * v for v, n in used.items()) == best


def placed(counts, capacity):
    plan = plan_sequences(counts, capacity)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in counts.values()]).astype(np.int64) if counts else length
    return plan, length, *place(length, rank, plan)


def gapless(rows, capacity):
    """(sequence, offset, length) rows fill sequences from 0 on without gaps."""
    upto = Counter()
    for s, at, n in sorted(rows):
        assert at == upto[s]
        upto[s] += n
    assert max(upto.values(), default=0) <= capacity and sorted(upto) == list(range(len(upto)))
    return len(upto)


def test_plans():
    r = random.Random(9)
    for capacity in (1, 7, 50, 2048):
        for _ in range(20):
            counts = {r.randrange(1, capacity + 1): r.choice([1, 2, 3, 50, 1000]) for _ in range(r.randrange(1, 40))}
            plan, length, s, at = placed(counts, capacity)
            n = gapless(list(zip(s.tolist(), at.tolist(), length.tolist())), capacity)
            assert n == plan.sequences >= -(-sum(k * v for k, v in counts.items()) // capacity)
    with pytest.raises(ValueError):
        plan_sequences({9: 1}, 8)
    assert plan_sequences({}).sequences == 0


def optimum(items, capacity):
    """Fewest bins by exhaustive search."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_near_the_optimum():
    r = random.Random(4)
    extra = 0
    for _ in range(150):
        items = sorted((r.randrange(1, 21) for _ in range(9)), reverse=True)
        extra += plan_sequences(Counter(items), 20).sequences - optimum(items, 20)
    assert 0 <= extra <= 4


def least(counts, capacity=2048):
    """Sequences that no packing can do without: pieces over ``capacity - k`` stand alone, those
    over half of it apart, and what room they leave is filled by pieces of ``k`` and more."""
    size = np.array(sorted(counts))
    n = np.array([counts[v] for v in size.tolist()])
    best = 0
    for k in range(capacity // 2 + 1):
        alone, apart = size > capacity - k, (size <= capacity - k) & (size > capacity / 2)
        rest = (size >= k) & (size <= capacity / 2)
        room = capacity * n[apart].sum() - (n * size)[apart].sum()
        best = max(best, n[alone].sum() + n[apart].sum() + max(0, -(-((n * size)[rest].sum() - room) // capacity)))
    return int(best)


def test_plan_does_not_grow_with_the_corpus():
    r = random.Random(6)
    counts = {v: r.randrange(1, 50) for v in range(1, 2049)}
    small, large = plan_sequences(counts), plan_sequences({v: n * 1_000_000 for v, n in counts.items()})
    assert small.sequences <= 1.004 * least(counts) + 1
    assert large.sequences <= 1.004e6 * least(counts)
    assert len(large.length) < 200_000


def check(rows, docs, library, capacity=2048):
    ids = {}
    for doc, text in docs:
        ids.setdefault((doc, text), [*library.encode(text or "", add_special_tokens=False).ids, 0])
    want = Counter()
    for doc, text in docs:
        x = ids[doc, text]
        first = (len(x) - 1) % capacity + 1
        for k, b in enumerate(range(first, len(x) + 1, capacity)):
            a = 0 if k == 0 else b - capacity
            want[doc, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_best_fit_packing"](spark, sf).collect()
    n = check(rows, docs, library)
    assert n <= least(Counter(r["length"] for r in rows)) + 1


def test_awkward_rows(spark, library):
    docs = [(1, None), (2, ""), (None, "a"), (None, "b c"), (3, "x" * 9000), (4, "word " * 5000), (1, "other")]
    docs += [(5, "the same row")] * 40 + [(i, "n " * i) for i in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.select("*", F.lit(1).alias("Text"), F.lit(2).alias("length"), F.lit(3).alias("part"))
    packed = pack_pieces(cut_documents(df, FILE, capacity=100), 100)
    rows = packed.collect()
    n = check(rows, docs, library, 100)
    whole = {r["sequence_id"]: r for r in sequences(packed).collect()}
    assert len(whole) == n
    for r in rows:
        s = whole[r["sequence_id"]]
        assert bytes(s["ids"])[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
        assert len(s["ids"]) == 4 * s["length"] <= 400


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_pieces(cut_documents(df, FILE)).collect() == []
