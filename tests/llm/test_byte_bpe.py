"""Byte-level BPE: the query, the round trip and awkward rows against tiktoken."""

import base64
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewater.llm.byte_bpe import Encoder, bpe_decode, bpe_encode, bpe_round_trip, digests, load_ranks
from tidewater.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(plain, doc, text):
    ids = plain.encode_ordinary(text or "")
    return (doc, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest())


def test_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op8_byte_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digest(plain, *r) for r in docs)


def test_awkward_rows(spark, plain):
    docs = [(1, None), (2, ""), (None, "a"), (None, " "), (1, "other"), (3, "x" * 50_000), (4, "ab " * 60_000),
            (5, "  \n\n a\t é中\U0001f600 <|endoftext|> 's")] + [(6, "the same row")] * 30
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.select("*", F.lit(1).alias("Text"), F.lit(2).alias("ids"), F.lit(3).alias("a.b"))
    want = Counter(digest(plain, *d) for d in docs)
    assert Counter(map(tuple, digests(bpe_round_trip(df, PATH, PATTERN)).collect())) == want
    two = digests(bpe_decode(bpe_encode(df, PATH, PATTERN), PATH, PATTERN))
    assert Counter(map(tuple, two.collect())) == want
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_round_trip(empty, PATH, PATTERN).collect() == []


def test_memory_started_anew_gives_equal_ids(plain, monkeypatch):
    from tidewater.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    encoder, r = Encoder(load_ranks(PATH, PATTERN)), random.Random(3)
    for _ in range(30):
        texts = ["".join(r.choice("ab c\n é1'") for _ in range(r.randrange(40))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
