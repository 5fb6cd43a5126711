"""SNK-3 / JOIN-5: a session table in key buckets. An upsert rewrites only the
buckets that its rows touch, a point lookup reads only its keys' buckets.

``root/data/v=<version>/b=<bucket>/`` holds the buckets that a version wrote,
``root/manifest/v=<version>/`` one row per bucket with the version that holds it
now. The manifest is written last: a version counts once its manifest is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.sources.logs import _complete_versions, merge_sessions

COLUMNS = "session_id string, title string, history string, updated_at timestamp_ntz"
MANIFEST = "b int, version string, buckets int"


def bucket_of(session: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, below: str | None = None) -> dict[int, tuple[str, int]]:
    """bucket -> (version, number of buckets) of the newest complete version (older
    than ``below``); at most one row per bucket comes to the driver."""
    done = [v for v in _complete_versions(spark, f"{root}/manifest") if below is None or v < below]
    if not done:
        return {}
    return {r.b: (r.version, r.buckets) for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{max(done)}").collect()}


def _read(spark: SparkSession, root: str, places: dict[int, tuple[str, int]]) -> DataFrame:
    paths = [f"{root}/data/{version}/b={b}" for b, (version, _) in sorted(places.items())]
    return spark.read.schema(COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], COLUMNS)


def upsert_buckets(batch: DataFrame, root: str, version: int, buckets: int) -> list[int]:
    """Merge ``batch`` (session_id, title, history, updated_at, seq) into the newest
    version below ``version`` and write it as that version; returns the buckets it
    rewrote. The same call again writes the same version again. Sessions without an
    id share the bucket of the null key. An empty batch writes nothing; a table
    keeps the number of buckets it was made with (ValueError otherwise).
    """
    spark = batch.sparkSession
    name = f"v={version:08d}"
    places = _manifest(spark, root, below=name)
    if any(n != buckets for _, n in places.values()):
        raise ValueError(f"{root} has {next(iter(places.values()))[1]} buckets, not {buckets}")
    key = bucket_of(F.col("session_id"), buckets)
    touched = sorted(r.b for r in batch.select(key.alias("b")).distinct().collect())
    if not touched:
        return []
    base = _read(spark, root, {b: places[b] for b in touched if b in places})
    merged = merge_sessions(base, batch).select("session_id", "title", "history", "updated_at")
    (merged.withColumn("b", key).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(f"{root}/data/{name}"))
    now = places | {b: (name, buckets) for b in touched}
    (spark.createDataFrame([(b, v, n) for b, (v, n) in now.items()], MANIFEST).coalesce(1)
     .write.mode("overwrite").parquet(f"{root}/manifest/{name}"))
    return touched


def upsert_buckets_stream(updates: DataFrame, root: str, checkpoint: str, buckets: int = 256):
    """SNK-3 streaming: each micro-batch is one version (its batch id), so a replayed
    batch rewrites its own version and nothing else."""
    return (updates.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, i: upsert_buckets(batch, root, i + 1, buckets) and None)
            .trigger(availableNow=True).start())


def read_buckets(spark: SparkSession, root: str, session_ids: list[str] | None = None) -> DataFrame:
    """The newest version of the table, or the rows of ``session_ids`` from their
    buckets alone. A table never written is empty."""
    places = _manifest(spark, root)
    if session_ids is None or not places:
        return _read(spark, root, places)
    n = next(iter(places.values()))[1]
    keys = spark.createDataFrame([(i,) for i in session_ids], "session_id string")
    wanted = {r.b for r in keys.select(bucket_of(F.col("session_id"), n).alias("b")).distinct().collect()}
    return _read(spark, root, {b: p for b, p in places.items() if b in wanted}).filter(F.col("session_id").isin(session_ids))
