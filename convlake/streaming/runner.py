"""Start / drain helpers for streaming jobs (checkpoints in the shared folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake.session import checkpoint_dir


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ensure_state_store(spark: SparkSession) -> None:
    """transformWithStateInPandas needs the RocksDB state store (several column
    families per operator); select it for new queries when the session has not."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_source(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None):
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_available(df: DataFrame, name: str | None = None, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available now (availableNow
    trigger) into a memory table and return that table. The checkpoint goes to
    the session's shared checkpoint folder, so a restart resumes exactly."""
    spark = df.sparkSession
    ensure_state_store(spark)
    name = name or f"s_{uuid.uuid4().hex[:12]}"
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (df.writeStream.format("memory").queryName(name).outputMode(output_mode)
           .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.table(name)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", output_mode: str = "append",
                 **trigger):
    """Production sink: files (or any format) with a checkpoint in shared storage."""
    ensure_state_store(df.sparkSession)
    w = df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start(path)


def file_table_stream(spark: SparkSession, sf_dir: str, table: str, schema):
    """A driver table file as a file stream (the directory is the base path and
    a one-file glob selects the table)."""
    return (spark.readStream.schema(schema).option("basePath", sf_dir.rstrip("/"))
                 .parquet(f"{sf_dir.rstrip('/')}/{table}.parque[t]"))


def run_to_files(df: DataFrame, name: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now into parquet files
    in the shared checkpoint folder; return those files as a batch DataFrame."""
    spark = df.sparkSession
    ensure_state_store(spark)
    name = name or f"s_{uuid.uuid4().hex[:12]}"
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    q = (df.writeStream.format("parquet").option("checkpointLocation", f"{root}/_ckpt")
           .trigger(availableNow=True).start(f"{root}/out"))
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def run_slices(df: DataFrame, time_col: str, build, slices: int = 3, sentinel: dict | None = None,
               progress: list | None = None) -> DataFrame:
    """Feed ``df`` to the streaming job ``build`` in time order, in ``slices`` parts
    of equal time span, each a run of its own that resumes from the checkpoint of
    the one before; returns everything the job emitted.

    ``sentinel`` (column -> value) is one last row far ahead in time, which moves the
    watermark past all others. Each run's last progress is appended to ``progress``.
    Source, checkpoint and output are in the session's shared checkpoint folder.
    """
    spark = df.sparkSession
    ensure_state_store(spark)
    root = f"{checkpoint_dir(spark).rstrip('/')}/streams/s_{uuid.uuid4().hex[:12]}"
    source = f"{root}/in"
    out = build(spark.readStream.schema(df.schema).parquet(source)) if _make(spark, source) else None
    low, high = df.agg(F.min(time_col), F.max(time_col)).first()
    edges = [low + (high - low) * k / slices for k in range(1, slices)] if low is not None else []
    t = F.col(time_col)
    parts = [df.filter((t >= F.lit(a) if a is not None else t.isNotNull()) & (t < F.lit(b) if b is not None else F.lit(True)))
             for a, b in zip([None, *edges], [*edges, None])]
    if sentinel is not None:
        row = [F.lit(sentinel.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
        parts.append(spark.range(1).select(*row))
    for part in parts:
        part.write.mode("append").parquet(source)
        q = (out.writeStream.format("parquet").option("checkpointLocation", f"{root}/_ckpt")
             .trigger(availableNow=True).start(f"{root}/out"))
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        if progress is not None and q.lastProgress:
            progress.append(q.lastProgress)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _make(spark: SparkSession, path: str) -> bool:
    """Make an empty folder, by Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
