"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents`` and the number of each row.  They
decide on rows by that number, since ids may repeat or be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.byte_bpe import bpe_round_trip, digests
from tidewater.llm.common import staged
from tidewater.llm.decontaminate import find_contamination
from tidewater.llm.language_id import UND, languages_beside
from tidewater.llm.near_dup import NearDup, near_duplicates
from tidewater.llm.substring_dup import remove_repeats


#: Number of a row, unlike in all rows: ids may repeat or be null.  ``language`` writes it first.
ROW = "row_number_"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with their row numbers; written before use, so that they stay."""
    if ROW in docs.columns:
        return docs
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose number is not among ``rows``."""
    return docs.join(rows.select(F.col(ROW).alias("_row")).distinct(), F.col(ROW) == F.col("_row"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with no letter, or with no language that most words have, go; the others get numbers."""
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != ROW]
    good = languages_beside(docs).filter((F.col("lang_pred") != UND) & (F.col("score") >= 0.4))
    return good.select(*names, F.monotonically_increasing_id().alias(ROW))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id (null last), of equal
    ids the smallest text hash and number: five-word shingles, 80 % and more."""
    docs = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                   F.xxhash64("text").alias("text_hash"), F.col(ROW).alias(ROW))
    found = near_duplicates(docs.select(key.alias("row_key"), "text"), NearDup(words=5), id_col="row_key")
    return _without(docs, found.filter("not kept").select(f"doc_id.{ROW}"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words and more go; a text without any stays as it is, and a
    document of which nothing is left goes."""
    done = remove_repeats(docs)
    names = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(names["text"])
    n_chars = F.when(cut, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(names["n_chars"])
    out = names | {"text": text, "n_chars": n_chars}
    return done.filter("n_removed = 0 or n_removed < n_words").select(*[v.alias(c) for c, v in out.items()])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = _numbered(docs)
    leaks = staged(find_contamination(docs, benchmark, id_col=ROW), "leaks")
    return _without(docs, leaks.select(F.col("doc_id").alias(ROW)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, decoded again, as digests."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(bpe_round_trip(docs, ranks, pattern))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", encode),
]

#: Language ID and near-dedup cannot be told in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
