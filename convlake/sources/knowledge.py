"""Knowledge packs: markdown files read whole and cut into heading sections (SRC-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(doc, section_no, heading, text): one row per ``#``..``######`` section;
    text before the first heading is section 0 with a null heading."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), "value")
    parts = raw.select("doc", F.posexplode(F.split("value", r"(?m)^(?=#{1,6} )")).alias("section_no", "text"))
    parts = parts.filter(F.length("text") > 0)
    heading = F.regexp_extract("text", r"^#{1,6} +([^\n]*)", 1)
    return parts.select("doc", "section_no", F.nullif(heading, F.lit("")).alias("heading"), "text")
