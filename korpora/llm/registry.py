"""The subpackage's queries, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from korpora.llm import conversation_repair, decontamination, jaccard_join, language_id, lm_scoring, packing, piece_codec, quality_rules, source_audit, substring_dedup, token_counts, toxicity, url_filters
from korpora.llm.common import remainder


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.predicted(_table(spark, d, "documents"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.predicted(_table(spark, d, "documents"), _table(spark, d, "labels"))


def op5_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.deduplicated(_table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, contaminated, items: all items that every document holds."""
    return decontamination.matches(_table(spark, d, "documents"), _table(spark, d, "benchmark")).select("doc_id", "contaminated", "items")


def op8_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.scored(_table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"), remainder(5) == 1)


def op9_url_filters(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    return url_filters.judged(pages, url_filters.mined(pages, _table(spark, d, "labels")))


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = quality_rules.judge(_table(spark, d, "documents"))
    return rows.select("doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept", "fail_bits")


def op11_source_audit(spark: SparkSession, d: str) -> DataFrame:
    return source_audit.audited(_table(spark, d, "documents"))


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return conversation_repair.figures(conversation_repair.repaired(conversation_repair.damaged(_table(spark, d, "conversations"))))


def op13_piece_codec(spark: SparkSession, d: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encoded(_table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard_join.SQL, "op6_substring_dedup": substring_dedup.SQL, "op9_url_filters": url_filters.SQL, "op10_quality_rules": quality_rules.SQL, "op11_source_audit": source_audit.SQL}
