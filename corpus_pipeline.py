"""Corpus pipeline: documents -> training mix.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns the
documents that the mix takes, with their number of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.llm import decontaminate, jaccard_join, mixing, quality_rules, suffix_dedup
from convlake.llm.frames import stored
from convlake.sources.tables import load_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.passing(docs, load_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest id. Similar
    are five-word shingle sets of Jaccard 0.8 or more (op8's own contract has four
    words and 0.85)."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; documents left empty go."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.uncontaminated(docs, load_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("suffix_dedup", repeated_passages),
          ("decontaminate", decontamination), ("mix_sources", mixture)]

#: Certified cutoffs, hashes of passages and carried rounding errors are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
