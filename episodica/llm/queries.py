"""The operators on the driver's tables, each with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import (
    decontaminate,
    heavy_dedup,
    language_crf,
    line_dedup,
    minhash,
    packing,
    pii,
    polytope,
    ring,
    spelling,
    substring_dedup,
    token_planes,
    whitening,
)
from episodica.llm.base import table

SHARDS = 24


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: with a load factor of 1 the bounds of any two shards are at most one row apart."""
    placed = ring.assign(ring.digest(table(spark, sf_dir, "documents")), "doc_id", SHARDS, load_factor=1.0)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_planes.round_trip(table(spark, sf_dir, "documents"), word_bpe(), end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_crf.predict(docs.select("doc_id", "text"), language_crf.train(docs), carried=["doc_id"])
    return found.select("doc_id", language_crf.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.verdicts(table(spark, sf_dir, "documents")).drop("spans")


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents")).drop("key")


def op9_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe(), end_id=2, keep_ids=False)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op11_pivotal_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_heavy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_dedup.mark(table(spark, sf_dir, "documents"))


def op13_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_ring_shards,
        op3_token_planes,
        op4_language_crf,
        op5_substring_dedup,
        op6_cross_polytope,
        op7_weak_pii,
        op8_minhash,
        op9_power_packing,
        op10_decontaminate,
        op11_pivotal_spelling,
        op12_heavy_dedup,
        op13_incremental_whitening,
    )
}
