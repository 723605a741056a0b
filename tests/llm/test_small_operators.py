"""Sharding, token files, byte-level BPE, language ID and LM scores on awkward rows."""

import base64
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from tidewater.llm.byte_bpe import Encoder, load_ranks
from tidewater.llm.language_id import identify_language
from tidewater.llm.sharding import shard_documents
from tidewater.llm.token_files import TokenFile, bits_for, file_bytes, pack, unpack

ROWS = [(1, None, "en"), (2, "", "fr"), (None, "the end", None), (3, "x" * 70000, "en"), (4, "a b", "en"),
        (4, "a b", "en"), (5, "12 34", "de")]
SCHEMA = "doc_id long, text string, lang string, shard string, Text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "T") for r in rows], SCHEMA)


def test_shards(spark):
    got = shard_documents(frame(spark, ROWS), 3).collect()
    assert len(got) == len(ROWS) and sum(r["size"] for r in got) == sum(len(t or "") + 1 for _, t, _ in ROWS)
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    assert shard_documents(frame(spark, []), 3).count() == 0


def test_packing_round_trip():
    r = np.random.default_rng(1)
    for bits in (1, 7, 15, 16, 17, 32):
        ids = r.integers(0, 2**bits, size=1001).astype(np.uint32)
        assert (unpack(pack(ids, bits), bits, 1001) == ids).all()
    ids = r.integers(0, 40000, size=50000).astype(np.uint32)
    f = TokenFile(file_bytes(ids, [None, 7], [20000, 30000], bits_for(40000)))
    assert f.docs == [None, 7] and (f.ids(16000, 33000) == ids[16000:33000]).all()


def test_bpe_like_tiktoken():
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "  a  b\n\n c ", " x y　", "a" * 999, "don't 'll \t\n", "é éé", "<|endoftext|> hi", "a \n b"]
    got = Encoder(load_ranks(path, pattern)).encode(texts)
    assert got == [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]


def test_language(spark):
    out = {r["doc_id"]: r for r in identify_language(frame(spark, ROWS)).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[5]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert out[4]["held_out"] == (zlib.crc32(b"4") % 3 == 1)
    assert identify_language(frame(spark, [])).count() == 0
