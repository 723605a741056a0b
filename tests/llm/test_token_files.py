"""Token files: encoder against the library, packing of any width, awkward rows."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm import token_files
from tidewater.llm.token_files import (PieceEncoder, TokenFile, bits_for, file_bytes, pack, read_token_files,
                                       shared_token_folder, unpack, word_ranks, write_token_files)

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(WORDS)


def test_encoder_equals_library(library):
    r = random.Random(7)
    chars = "aAbZ 1\n\t\r　'sLlÉé中한́\U0001f600!?.,-_<|>​ \x00\x1f١Σİß"
    texts = ["", " ", "<|endoftext|>", "A <|startoftext|>B", "x" * 20_000, "ΟΣ", "don't DON'T 'S", "a1b22"]
    texts += ["".join(r.choice(chars) for _ in range(r.randrange(1, 50))) for _ in range(4000)]
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(f"a{chr(c)}B {chr(c)}1{chr(c)} \n{chr(c)}" for c in points[a:a + 64]) for a in range(0, len(points), 64)]
    with open("/root/testdata/sf0.001/documents.parquet", "rb") as fh:
        import pyarrow.parquet as pq
        texts += [t or "" for t in pq.read_table(fh, columns=["text"]).column(0).to_pylist()]
    encoder = PieceEncoder(WORDS, True)
    assert encoder.by_piece
    got = encoder.encode(texts)
    for t, a, b in zip(texts, got, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(a, "<u4").tolist() == b.ids, t


def test_memory_started_anew(library, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    encoder = PieceEncoder(WORDS, True)
    for i in range(20):
        texts = [f"word{i} again{j} x" for j in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
            library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_encoded_whole():
    with open(WORDS, encoding="utf-8") as fh:
        made = json.load(fh)
    assert word_ranks(made) is not None
    model, parts = made["model"], made["normalizer"]["normalizers"]
    for other in ({"normalizer": None}, {"normalizer": {"type": "Sequence", "normalizers": parts[:2]}},
                  {"pre_tokenizer": {"type": "Whitespace"}}, {"model": model | {"unk_token": "<u>"}},
                  {"model": model | {"merges": [model["merges"][1], model["merges"][0], *model["merges"][2:]]}},
                  {"model": model | {"end_of_word_suffix": None}}):
        assert word_ranks(made | other) is None
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = PieceEncoder(path, True)
    assert not plain.by_piece
    assert np.frombuffer(plain.encode(["Hello  World"])[0], "<u4").tolist() == plain.tokenizer.encode(
        "Hello  World", add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packing_of_any_width(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000, token_files.BLOCK_IDS):
        ids = r.integers(0, 2 ** bits, size=n, dtype=np.uint64).astype(np.uint32)
        raw = pack(ids, bits)
        assert len(raw) == -(-n * bits // 8) and unpack(raw, bits, n).tolist() == ids.tolist()
    assert bits_for(2 ** bits) == bits and (bits == 1 or bits_for(2 ** (bits - 1) + 1) == bits)


def test_random_access_over_blocks():
    r = np.random.default_rng(1)
    n = 3 * token_files.BLOCK_IDS + 77
    ids = r.integers(0, 100_000, size=n, dtype=np.uint32)
    counts = [0, 5, token_files.BLOCK_IDS + 9, n - token_files.BLOCK_IDS - 14]
    f = TokenFile(file_bytes(ids, [3, None, -5, 9], counts, 17))
    assert f.docs == [3, None, -5, 9] and f.counts.tolist() == counts
    for a, b in [(0, n), (0, 0), (5, 6), (16383, 16385), (n - 1, n), (40_000, 50_000), (1, 2)]:
        assert f.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        TokenFile(b"XXXX" + bytes(40))


def round_trip(spark, docs, path=WORDS, end=1, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.select("*", F.lit(1).alias("Text"), F.lit(2).alias("start"), F.lit(3).alias("a.b"))
    folder = shared_token_folder(df)
    return read_token_files(write_token_files(df, path, folder, end_id=end, **kw), folder).collect()


def check(rows, docs, library, end=1):
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    want = Counter()
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        want[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_awkward_rows(spark, library):
    docs = [(1, None), (2, ""), (None, "a"), (None, "b C"), (1, "other"), (3, "word " * 40_000), (-7, "x" * 9000)]
    docs += [(5, "the same row")] * 40 + [(i, f"n {i}") for i in range(10, 40)]
    check(round_trip(spark, docs), docs, library)


def test_ids_of_17_bits(spark, library):
    """An end id beyond the vocabulary takes one bit more than the 16 of its ids."""
    docs = [(i, f"text {i} " * (i % 7)) for i in range(200)]
    check(round_trip(spark, docs, end=70_000), docs, library, end=70_000)


def test_whole_texts_by_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizers = pytest.importorskip("tokenizers")
    docs = [(1, "  Two  blanks "), (2, None), (3, "Café Σ")]
    check(round_trip(spark, docs, path), docs, tokenizers.Tokenizer.from_file(path))


def test_empty_table(spark):
    assert round_trip(spark, []) == []
