"""Token ids in fixed-width bit-packed files (operator 3).

Documents are dealt into ranges of ascending id, one range a task.  A task encodes its
texts and packs every id into the minimum number of bits for the vocabulary; ids are
grouped in blocks of ``BLOCK_IDS``, and the file's index holds the byte offset of each
block, so any block is unpacked alone with vectorised numpy.

File layout (little-endian): magic ``TWID``, version, bits per id, ids per block, number of
ids, documents and blocks; block offsets (uint64, one more than blocks); the blocks, each
padded to whole bytes; then per document its id (int64), a flag for a null id (uint8) and
its number of ids (int64).

Files are written under the shared folder through pyarrow's file systems, under a name no
other attempt uses, and count only once Spark has committed the task's manifest row; a lost
executor leaves a file that no manifest names.  They are read back by Spark's binary reader.

Special cases.  Null and empty text: the end id alone.  Null document ids come first.
Repeated rows: one entry each.  A document is never split over files, whatever its length.
An empty table: no file.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import byte_letters, pick, slices, width
from .tasks import task

MAGIC = b"TWID"
HEAD = struct.Struct("<4sIIIQQQ")
BLOCK_IDS = 1 << 14
#: A file is closed once it holds so many ids.
FILE_IDS = 1 << 23
#: Pieces remembered by a Python worker; beyond this the memory is started anew.
REMEMBERED = 200_000


def bits_for(vocabulary: int) -> int:
    """Minimum bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian packing of one block."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The ``n`` ids of a packed block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * bits, bitorder="little")
    weight = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return (flat.reshape(n, bits) * weight).sum(axis=1, dtype=np.uint32)


def file_bytes(ids: np.ndarray, docs: list[int | None], counts: list[int], bits: int) -> bytes:
    blocks = [pack(ids[a:a + BLOCK_IDS], bits) for a in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    offsets += np.uint64(HEAD.size + offsets.nbytes)
    return b"".join([
        HEAD.pack(MAGIC, 1, bits, BLOCK_IDS, len(ids), len(docs), len(blocks)), offsets.tobytes(), *blocks,
        np.array([0 if d is None else d for d in docs], dtype="<i8").tobytes(),
        np.array([d is None for d in docs], dtype=np.uint8).tobytes(),
        np.array(counts, dtype="<i8").tobytes()])


class TokenFile:
    """A file's content: ``ids(a, b)`` unpacks only the blocks that hold ids a to b."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, self.block, self.n, n_docs, n_blocks = HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        self.raw, self._held = raw, (-1, None)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, HEAD.size).astype(np.int64)
        at = int(self.offsets[-1])
        doc = np.frombuffer(raw, "<i8", n_docs, at)
        null = np.frombuffer(raw, np.uint8, n_docs, at + 8 * n_docs)
        self.docs = [None if z else d for d, z in zip(doc.tolist(), null.tolist())]
        self.counts = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def _block(self, k: int) -> np.ndarray:
        """Block ``k``; the last one is kept, since documents are read in order."""
        if self._held[0] != k:
            self._held = (k, unpack(self.raw[self.offsets[k]:self.offsets[k + 1]], self.bits,
                                    min(self.block, self.n - k * self.block)))
        return self._held[1]

    def ids(self, a: int, b: int) -> np.ndarray:
        if b <= a:
            return np.zeros(0, dtype=np.uint32)
        first = a // self.block
        parts = [self._block(k) for k in range(first, (b - 1) // self.block + 1)]
        joined = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return joined[a - first * self.block:b - first * self.block]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


#: Stands for the end of a word in ``word_ranks``; pieces that hold it go to the library.
WORD_END = "\x01"


def word_ranks(made: dict) -> tuple[str, dict[bytes, int]] | None:
    """Pattern, and ids by bytes, of a vocabulary file whose ids of a text are those of its
    lowered pattern matches in order: it composes, drops white space, lowers, splits by one
    pattern, ends words by a suffix, and its merges stand in the order of their results' ids.
    None for any other file."""
    model = made["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
           if model.get(k)]
    suffix = model.get("end_of_word_suffix")
    try:
        split, level = made["pre_tokenizer"]["pretokenizers"]
        compose, space, lower = made["normalizer"]["normalizers"]
        plain = ((split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
                 and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
                 and (compose["type"], lower["type"]) == ("NFC", "Lowercase")
                 and (space["pattern"], space["content"]) == ({"Regex": r"\s+"}, " "))
        pattern = split["pattern"]["Regex"]
    except (KeyError, TypeError, ValueError):
        return None
    bare = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
               for t in made["added_tokens"])
    if not plain or not bare or odd or not suffix or model.get("type") != "BPE":
        return None
    letter, vocab = byte_letters(), model["vocab"]
    joined = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in joined]
    single = {*letter, *(c + suffix for c in letter)}
    if ids != sorted(set(ids)) or set(vocab) != single | {a + b for a, b in joined}:
        return None
    if max(vocab[c + suffix] for c in letter) > min(ids, default=len(vocab)):
        return None

    def raw(token: str) -> bytes:
        ended = token.endswith(suffix)
        return bytes(letter[c] for c in (token[:-len(suffix)] if ended else token)) + (WORD_END.encode() if ended else b"")

    return pattern, {raw(t): i for t, i in vocab.items()}


class PieceEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    With ``by_piece``, and a vocabulary that ``word_ranks`` accepts, a text's ids are those of its
    pattern matches in order, and no match crosses white space.  Texts are cut at blanks and
    newlines; the pieces that are not remembered are lowered and split together, one to a
    line, and tiktoken merges the bytes of every match, with the word's end as one more
    byte whose merges come first.  A piece with a special token, a capital sigma or a character that the
    library puts in another class (its tables are of another Unicode version) goes to the library
    whole.  For any other vocabulary, or without ``by_piece``, whole texts go to the library."""

    def __init__(self, path: str, by_piece: bool):
        self.tokenizer = _tokenizer(path)
        with open(path, encoding="utf-8") as fh:
            made = json.load(fh)
        found = word_ranks(made) if by_piece else None
        self.by_piece = found is not None
        self.pieces: dict[str, bytes] = {}
        if found:
            import tiktoken
            pattern, ranks = found
            self.merge = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks,
                                           special_tokens={}).encode_to_numpy
            self.line = ranks[f"\n{WORD_END}".encode()]
            self.pattern = regex.compile(f"{pattern}|\n")
            self.odd = regex.compile("|".join(
                [regex.escape(t["content"]) for t in made["added_tokens"]] + ["\u03a3", WORD_END]))
            self.letter = {b: c for c, b in byte_letters().items()}
            self.alike = set(map(chr, range(128)))
            self.unlike: set[str] = set()

    def _matches(self, text: str) -> list[str]:
        return self.pattern.findall(unicodedata.normalize("NFC", text).lower())

    def _read_alike(self, chars: set[str]) -> bool:
        """Whether the library splits around all ``chars`` as the pattern does here; each
        character is tried once, beside a letter, a number and a sign."""
        for c in chars.difference(self.alike, self.unlike):
            text = f"a{c}a 1{c}1 !{c}! {c}"
            own = ["".join(map(self.letter.__getitem__, m.encode())) for m in self._matches(text)]
            t = self.tokenizer
            theirs = [m for m, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
            (self.alike if own == theirs else self.unlike).add(c)
        return self.unlike.isdisjoint(chars)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        lines = "\n".join(pieces)
        if not self._read_alike(set(lines)) or self.odd.search(lines):
            whole = [p for p in pieces if self.odd.search(p) or not self.unlike.isdisjoint(p)]
            self.pieces.update(zip(whole, self._encode(whole)))
            pieces = list(set(pieces).difference(whole))
            lines = "\n".join(pieces)
        if not pieces:
            return
        ids = self.merge(WORD_END.join(self._matches(lines)) + WORD_END) if lines else np.zeros(0, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.line), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        raw = ids.astype("<u4", copy=False).tobytes()
        self.pieces.update(zip(pieces, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._encode(texts)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn(list(set().union(*cut).difference(self.pieces)))
        get = self.pieces.__getitem__
        return [b"".join(map(get, c)) for c in cut]


@functools.lru_cache(maxsize=1)
def _encoder(path: str, by_piece: bool) -> PieceEncoder:
    """One per Python worker, which serves many tasks."""
    return PieceEncoder(path, by_piece)


def _write(path: str, folder: str, end_id: int, by_piece: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        encoder = _encoder(path, by_piece)
        bits = bits_for(max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1))
        end = np.array([end_id], dtype="<u4").tobytes()
        raw, docs, counts, held, number = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex[:12]}.twid"
            ids = np.frombuffer(b"".join(raw), dtype="<u4")
            with where.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(ids, docs, counts, bits))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "number": pa.array([number], pa.int64()),
                "file": [name], "n_ids": pa.array([len(ids)], pa.int64())})

        for s in slices(batches, "body"):
            for doc, ids in zip(s.column("doc").to_pylist(), encoder.encode(s.column("body").to_pylist())):
                raw.append(ids + end)
                docs.append(doc)
                counts.append(len(ids) // 4 + 1)
                held += counts[-1]
                if held >= FILE_IDS:
                    yield close()
                    raw, docs, counts, held, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int = 1,
                      by_piece: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below ``folder`` (a shared folder; created) and return the manifest
    ``file, start, n_ids`` in ascending order: ``start`` ids lie in the files before."""
    spark = docs.sparkSession
    body = pick(docs, doc=id_col, body=text_col).select(
        F.col("doc").cast("long").alias("doc"), F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"))
    # The last key parts documents that share an id, so one id never fills one task alone.
    body = body.withColumn("tie", F.xxhash64("body")).withColumn("row", F.monotonically_increasing_id())
    dealt = body.repartitionByRange(width(spark), "doc", "tie", "row").sortWithinPartitions("doc", "tie", "row")
    spark.createDataFrame([], "file string").write.mode("append").parquet(f"{folder}/manifest")  # makes the folder
    manifest = dealt.select("doc", "body").mapInArrow(
        task(_write, vocabulary, folder, end_id, by_piece), "part long, number long, file string, n_ids long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    listed = spark.read.schema("part long, number long, file string, n_ids long").parquet(f"{folder}/manifest")
    # One row per range: the totals of the ranges before, then of the files before in the range.
    from pyspark.sql import Window
    totals = listed.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = totals.select(F.col("part").alias("p2"), (F.sum("total").over(Window.orderBy("part")) -
                                                       F.col("total")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    return listed.withColumn("inside", inside).join(before, F.col("part") == F.col("p2")).select(
        "file", (F.col("before") + F.col("inside")).alias("start"), "n_ids")


def _read():
    return _read_files


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw, start in zip(batch.column("content"), batch.column("start").to_pylist()):
            f = TokenFile(raw.as_py())
            stop = np.cumsum(f.counts)
            crc = []
            for a, b in zip((stop - f.counts).tolist(), stop.tolist()):
                crc.append(zlib.crc32(f.ids(a, b).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.docs, pa.int64()), pa.array(stop - f.counts + start, pa.int64()),
                 pa.array(f.counts, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.twid").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = files.join(F.broadcast(manifest), F.col("name") == F.col("file"))  # one row per file of 2**23 ids
    return named.select("content", "start").mapInArrow(
        task(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def shared_token_folder(docs: DataFrame) -> str:
    return scratch_path(docs.sparkSession, "llm", "tokens")
