"""The registered queries of the operators, at production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkspark.llm.oracle import ORACLE as ORACLE  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.personal import find_personal

    found = find_personal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.conversations import damaged, repair

    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), every=rows)


def op12_changes() -> dict[str, Column]:
    """The audit's tampering: a character too many where 7 divides the CRC of the decimal id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"), found=op12_changes())


def op13_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rinkspark.llm.outliers import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_repeats": op2_repeats,
    "op3_near_vectors": op3_near_vectors,
    "op4_top_k": op4_top_k,
    "op5_simhash": op5_simhash,
    "op6_personal": op6_personal,
    "op7_packing": op7_packing,
    "op8_scoring": op8_scoring,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_conversations": op11_conversations,
    "op12_manifest": op12_manifest,
    "op13_outliers": op13_outliers,
}
