"""Registered queries of the operators in this subpackage: whole tables, production
parameters, full results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_round_trip, digests
from .cap_filters import near_vectors
from .common import crc32_of
from .decontaminate import find_contamination
from .language_id import identify_language
from .lm_score import score_texts
from .merkle import build_manifest, check_claims, leaf_digest
from .near_dup import NearDup, near_duplicates
from .packing import cut_documents, pack_pieces
from .sharding import LAW, shard_documents
from .substring_dup import remove_repeats
from .token_files import read_token_files, shared_token_folder, write_token_files
from .url_lists import apply_lists, split_url
from .whitening import fit_whitening, usable, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = shard_documents(table(spark, sf_dir, "documents"), 8)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_token_folder(docs)
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(manifest, folder)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return score_texts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: by the host's md5, four of sixteen hosts are
    blocked on a day and freed 90 days later, half of those blocked again; and every host's
    first path segment is allowed for a while in two of sixteen cases."""
    host, path = split_url(F.col("url"))
    hosts = pages.select(host.alias("host"), F.regexp_extract(path, "^/([^/]+)", 1).alias("step"))
    hosts = hosts.filter("host is not null").distinct()
    lot = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    base = hosts.withColumn("lot", lot).withColumn("at", F.col("lot") % 200)
    start = F.to_date(F.lit("2024-01-01"))

    def entry(where, name, pattern, action, after):
        return base.filter(where).select(
            F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"),
            F.date_add(start, F.col("at") + F.lit(after)).alias("day"))

    h, deep = F.col("host"), F.concat("host", F.lit("/"), "step")
    return (entry("lot % 16 < 4", "block", h, "add", 0).union(entry("lot % 16 < 4", "block", h, "remove", 90))
            .union(entry("lot % 16 < 2", "block", h, "add", 120))
            .union(entry("lot % 16 in (0, 2) and step <> ''", "allow", deep, "add", 30))
            .union(entry("lot % 16 in (0, 2) and step <> ''", "allow", deep, "remove", 60)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 366).cast("int"))
    return apply_lists(pages.withColumn("day", day), dated_entries(pages))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(words=4))


def tampered_leaf(columns: dict) -> F.Column:
    """Leaf of a row with 1 added to ``n_chars`` where 7 divides the crc32 of its id, else its
    own; a null id is left alone, a null ``n_chars`` stays null."""
    more = columns["n_chars"].cast("decimal(38,0)") + F.lit(1)
    hit = crc32_of(columns["doc_id"]) % 7 == 0
    return F.when(hit, leaf_digest(*(columns | {"n_chars": more}).values())).otherwise(leaf_digest(*columns.values()))


def merkle_rows(docs: DataFrame, **kw) -> DataFrame:
    checked = check_claims(build_manifest(docs, claim=tampered_leaf, **kw))
    return checked.select(F.col("entry").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                          (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_rows(table(spark, sf_dir, "documents"))


def whitened_rows(embeddings: DataFrame) -> DataFrame:
    rows = usable(embeddings)
    model = fit_whitening(rows)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, "
                                                 "whitened double, explained double, identity_error double")
    parts = F.array(*[F.lit(v) for v in model.explained])
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.grid.n).cast("long").alias("n"),
                       "deviation", "whitened", F.get(parts, F.col("at")).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack_pieces(pieces, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_cap_filters": op2_cap_filters,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_best_fit_packing": op13_best_fit_packing,
}
