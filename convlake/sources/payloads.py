"""Uploaded files as payload rows: their sizes, never their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """FLT-9: (path, length, modificationTime) of every file under ``path``. The
    content column is pruned, so no file is opened; feed it to ``gate_payloads``."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))
