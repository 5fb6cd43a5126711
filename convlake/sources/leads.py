"""Lead tables: read the three stored shapes as one schema; append validated leads."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import schemas as S
from convlake.operators.leads import valid_leads

UNIFIED = ["id", "company_name", "contact_name", "email", "phone", "status", "source", "brand", "notes",
           "metadata", "created_at", "updated_at"]


def read_leads(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """SRC-3: 'local' (table rows), 'csv' (header, ISO timestamps) or 'remote'
    (JSON rows of the remote shape) -> the unified lead schema. Local and CSV rows
    were never updated, so both times are theirs; CSV rows have no id."""
    if fmt == "csv":
        d = spark.read.schema(S.LEAD_CSV).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        d = d.withColumn("timestamp", F.to_timestamp_ntz("timestamp")).withColumn("id", F.lit(None).cast("bigint"))
        return _from_local(d)
    if fmt == "local":
        return _from_local(spark.read.schema(S.LEAD_LOCAL).parquet(path))
    if fmt == "remote":
        return spark.read.schema(S.LEAD_REMOTE).json(path).select(*UNIFIED)
    raise ValueError(fmt)


def _from_local(d: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("ip_address", "service", "best_time"))
    return d.select("id", F.lit(None).cast("string").alias("company_name"), F.col("name").alias("contact_name"),
                    "email", "phone", F.lit(None).cast("string").alias("status"),
                    F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("brand"),
                    F.col("details").alias("notes"), meta.alias("metadata"), F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at"))


def stamped(leads: DataFrame, now: Column | None = None) -> DataFrame:
    """New rows of the remote shape: created_at and updated_at are the time of the
    insert (UTC, without a zone); ``now`` gives another one."""
    at = now if now is not None else F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")
    return leads.withColumn("created_at", at).withColumn("updated_at", at)


def append_leads(leads: DataFrame, path: str, fmt: str = "parquet", name: str = "contact_name",
                 email: str = "email", rejected_path: str | None = None, jdbc: dict | None = None) -> None:
    """SNK-2: validated append. Rows failing FLT-3 go to ``rejected_path`` (when
    given) instead of vanishing; the writer fails loudly instead of reporting
    success after a failed write. ``jdbc`` (url, dbtable, user, ...) sends the
    valid rows to a database table through the same writer instead of files. With
    two outputs the input is computed once."""
    v = valid_leads(leads, name, email)
    if rejected_path:
        v = v.persist(StorageLevel.DISK_ONLY)
    try:
        _append(v, path, fmt, rejected_path, jdbc)
    finally:
        if rejected_path:
            v.unpersist()


def _append(v: DataFrame, path: str, fmt: str, rejected_path: str | None, jdbc: dict | None) -> None:
    ok = v.filter("is_valid").drop("is_valid").write.mode("append")
    if jdbc:
        ok.format("jdbc").options(**jdbc).save()
    else:
        _dialect(ok.format(fmt), fmt).save(path)
    if rejected_path:
        _dialect(v.filter(~F.col("is_valid")).drop("is_valid").write.mode("append").format(fmt), fmt).save(rejected_path)


def _dialect(writer, fmt: str):
    """CSV files carry a header each, quotes inside a field are doubled and its outer
    blanks kept."""
    if fmt != "csv":
        return writer
    return (writer.option("header", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def append_leads_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """SNK-2 streaming writer: each micro-batch writes its valid rows to its own
    ``batch=<id>`` directory, so a replayed batch replaces itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        ok = valid_leads(df, "contact_name", "email").filter("is_valid").drop("is_valid")
        _dialect(ok.write.mode("overwrite").format(fmt), fmt).save(f"{path}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
