"""The op1 and op3 queries over a whole table against plain Python."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    return sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, crc(r["text"])))


def test_op1(spark, rows):
    sizes = [len((r["text"] or "").encode()) + 1 for r in rows]
    total, before, want, slots = sum(sizes), 0, [], [0] * 8
    for r, n in zip(rows, sizes):
        k = min(7, (2 * before + n) * 8 // (2 * total))
        want.append((r["doc_id"], n, zlib.crc32((r["text"] or "").encode()), "bytes", k, slots[k], None))
        slots[k] += 1
        before += n
    assert sorted(map(repr, map(tuple, QUERIES["op1_sharding"](spark, SF_DIR).collect()))) == sorted(map(repr, want))


def test_op3(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    enc = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op3_token_files"](spark, SF_DIR).collect()
    end = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert end[0][0] == 0 and all(a[1] == b[0] for a, b in zip(end, end[1:]))
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    assert len(got) == len(rows) == len(texts)
    ends = set()
    for r in got:
        ids = enc.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) + 1
        ends |= {i for i in range(enc.get_vocab_size() + 1)
                 if not ends and zlib.crc32(np.array([*ids, i], "<u4").tobytes()) == r["ids_crc32"]}
        assert len(ends) == 1 and zlib.crc32(np.array([*ids, *ends], "<u4").tobytes()) == r["ids_crc32"]
