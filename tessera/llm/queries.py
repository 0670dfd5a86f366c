"""The operators' queries over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, kneser_ney, mixing, oracles, packing, quality, simhash, suffix_repeats, token_counts, url_rules, vector_dups
from .common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), url_rules.rules_frame(spark, url_rules.RULES))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(read_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_repeats.kept_bytes(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.judge(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_simhash_near_dedup, op3_lm_scoring, op4_source_mixing, op5_embedding_near_dedup, op6_suffix_array_dedup, op7_packing, op8_html_extraction, op9_quality_rules, op10_token_counts)}
ORACLES = {
    "op1_url_filters": url_rules.oracle(url_rules.RULES),
    "op5_embedding_near_dedup": oracles.embeddings(),
    "op6_suffix_array_dedup": oracles.repeats(),
    "op9_quality_rules": oracles.quality_rules(),
}
