"""Registered queries of this subpackage: each applies one operator to its whole
table and derives the contract's digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from convlake.llm import (bpe_codec, byte_cnn, collocations, decontaminate, html_text, importance, jaccard_join, licenses, mixing,
                          quality_rules, suffix_dedup, token_counts, url_rules)
from convlake.sources.tables import load_table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(load_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(load_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(load_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_counts(load_table(spark, sf_dir, "documents"), model_path)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.similar_groups(load_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality_scores(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the document it shows, whose label it takes."""
    labels = load_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    out = url_rules.verdicts(load_table(spark, sf_dir, "pages"), labels)
    return out.select("page_id", "host", "path", "rule", "verdict", "n_mined")


def op11_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe_codec.codec_digests(load_table(spark, sf_dir, "documents"), tokenizer_path)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_mix_sources, op3_licenses, op4_quality_rules, op5_decontaminate, op6_suffix_dedup,
                            op7_token_counts, op8_jaccard_join, op9_quality_classifier, op10_url_rules, op11_bpe_codec,
                            op12_importance_resampling, op13_collocations)
}

ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.oracle(), "op12_importance_resampling": importance.oracle(),
                              "op13_collocations": collocations.oracle()}
