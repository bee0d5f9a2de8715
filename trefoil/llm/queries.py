"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trefoil.llm import decontamination, divergence, hard_negatives, language_id, line_dedup, packing, pii, preference, pseudo_likelihood, quality, simhash, toxicity, warc
from trefoil.llm import sql
from trefoil.llm.words import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.detect(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), quality.POLICIES["v1"])
    return quality.apply_policy(found, quality.POLICIES["base"], "base_passed").withColumn("base_failed", ~F.col("base_passed")).drop("base_passed")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("uri")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(_table(spark, sf_dir, "conversations"))


def preference_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired, masked completions of operator 7."""
    return preference.examples(preference.format_pairs(_table(spark, sf_dir, "conversations")))


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_ledger": op2_quality_ledger,
    "op3_toxicity": op3_toxicity,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_pii_spans": op6_pii_spans,
    "op7_preference_formatting": op7_preference_formatting,
    "preference_examples": preference_examples,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_masked_pseudo_likelihood": op10_masked_pseudo_likelihood,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
