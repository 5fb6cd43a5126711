"""Conversation logs and session tables: build, write, read, merge, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convlake import schemas as S
from convlake.functions.text import redact


def log_records(msgs: DataFrame, session: str, turn: str, role: str, content: str, saved_at: str,
                tools: DataFrame | None = None, location: DataFrame | None = None) -> DataFrame:
    """SNK-1 record: one redacted log per session (user/assistant/tool messages in
    turn order, role and content only), its location and tools used. The file
    stamp is the save time; one array per session is the record's own shape."""
    kept = msgs.filter(F.col(role).isin("user", "assistant", "tool"))
    m = F.struct(F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
                 redact(F.col(content)).alias("content"))
    logs = kept.groupBy(session).agg(F.array_sort(F.collect_list(m)).alias("_m")).select(
        F.col(session).cast("string").alias("session_id"),
        F.lit(saved_at).alias("timestamp"),
        F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    loc = F.lit(None).cast(S.LOCATION)
    if location is not None:
        logs = logs.join(location.withColumnRenamed(location.columns[0], "session_id"), "session_id", "left")
        loc = F.when(F.col("city").isNotNull() | F.col("region").isNotNull() | F.col("state").isNotNull(),
                     F.struct("city", "region", "state"))
    tl = F.array().cast("array<string>")
    if tools is not None:
        logs = logs.join(tools.withColumnRenamed(tools.columns[0], "session_id"), "session_id", "left")
        tl = F.coalesce(F.col("tools_used"), tl)
    return logs.select("session_id", "timestamp", "messages", loc.alias("location"), tl.alias("tools_used"))


def write_logs(logs: DataFrame, path: str, mode: str = "append", enabled: bool = True) -> None:
    """SNK-1: JSON logs partitioned by save date; the file stamp format of the
    single-file logger survives as the ``stamp`` column. ``enabled`` is the
    logging switch (off: nothing is written)."""
    if not enabled:
        return
    ts = F.to_timestamp(F.regexp_replace("timestamp", "Z$", ""))
    (logs.withColumn("date", F.date_format(ts, "yyyy-MM-dd"))
         .withColumn("stamp", F.concat(F.col("session_id"), F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss")))
         .write.mode(mode).partitionBy("date").json(path))


#: Paths of indented files named one by one; more are found by a join on the file path.
NAMED_FILES = 10_000


def read_logs(spark: SparkSession, path: str, quarantine_path: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """SRC-1: read every JSON log under ``path`` with a fixed schema.

    Files may hold one object per line or one indented object each. By default
    both are read: a file with a corrupt line and no log in any line is read again
    as a whole. ``multi_line`` False or True reads all files in the one shape, in
    one pass. With ``quarantine_path`` the corrupt records are written there, with
    the path of their file.
    """
    schema = S.CONVERSATION_LOG + ", stamp STRING, _corrupt STRING"

    def read(whole: bool, *paths: str) -> DataFrame:
        r = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        r = r.option("multiLine", "true") if whole else r
        r = r.option("basePath", path) if paths else r
        return r.json(list(paths) or path).withColumn("_file", F.col("_metadata.file_path"))

    # the second test is always true; it keeps a data column in the scan, as the corrupt column alone cannot be read
    is_row = F.coalesce(F.length("session_id"), F.lit(0)) >= 0
    good = F.col("_corrupt").isNull() & is_row
    raw = read(bool(multi_line))
    if multi_line is None:
        whole = (raw.groupBy("_file").agg(F.bool_or(~good).alias("broken"), F.bool_or(good & F.col("session_id").isNotNull()).alias("logs"))
                 .filter("broken and not logs").select("_file"))
        named = [r["_file"] for r in whole.limit(NAMED_FILES + 1).collect()]
        if len(named) > NAMED_FILES:
            raw = raw.join(whole, "_file", "left_anti").unionByName(read(True).join(whole, "_file", "left_semi"))
        elif named:
            raw = raw.filter(~F.col("_file").isin(named)).unionByName(read(True, *named))
    if quarantine_path:
        (raw.filter(~good).select("_corrupt", "session_id", F.col("_file").alias("file"))
         .write.mode("append").json(quarantine_path))
    return raw.filter(good).drop("_corrupt", "_file")


def list_logs(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """TOP-2: newest first, logs without a timestamp last."""
    out = logs.orderBy(F.col("timestamp").desc_nulls_last(), F.col("session_id"))
    return out.limit(limit) if limit else out


def latest_logs(logs: DataFrame, session: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """AGG-10: the latest snapshot per session. ``max_by`` over the row struct
    merges partially (a session with many snapshots costs one row per task).
    Snapshots without a time come last; equal times go by the record itself."""
    cols = [c for c in logs.columns if c != session]
    return (logs.groupBy(session).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts).isNotNull(), F.col(ts), F.to_json(F.struct(*cols)))).alias("_r"))
                .select(session, *[F.col("_r")[c].alias(c) for c in cols]))


def export_manifest(logs: DataFrame, exported_at: str) -> DataFrame:
    """SNK-4/AGG-8: one-row manifest (exported_at, total_conversations). The
    logs themselves are written partitioned, never gathered into one object."""
    return logs.agg(F.count(F.lit(1)).alias("total_conversations")).select(
        F.lit(exported_at).cast("timestamp_ntz").alias("exported_at"), "total_conversations")


def export_bundle(logs: DataFrame, path: str, exported_at: str) -> DataFrame:
    """SNK-4: write the logs partitioned plus the manifest; no-op on empty input
    (the manifest then says 0 and no log files are written)."""
    manifest = export_manifest(logs, exported_at)
    if logs.limit(1).count() == 0:
        return manifest
    logs.write.mode("overwrite").json(f"{path}/conversations")
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def sessions_from_turns(turns: DataFrame, session: str, turn: str, role: str, content: str,
                        updated_at, title=None) -> DataFrame:
    """The sessions table shape: one row per session with the history JSON."""
    m = F.struct(F.col(turn).alias("_t"), F.col(role).alias("role"), F.col(content).alias("content"))
    g = turns.groupBy(session).agg(F.array_sort(F.collect_list(m)).alias("_h"))
    hist = F.to_json(F.transform("_h", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    return g.select(F.col(session).cast("string").alias("session_id"),
                    (title if title is not None else F.lit(None).cast("string")).alias("title"),
                    hist.alias("history"), updated_at.alias("updated_at"))


def explode_history(sessions: DataFrame) -> DataFrame:
    """SRC-2: decode the history JSON to one row per message (pos, role, content,
    name, tool_call_id, tool_calls); null or invalid JSON -> no messages."""
    h = F.from_json(F.col("history"), S.HISTORY, {"mode": "PERMISSIVE"})
    return (sessions.select("session_id", F.posexplode(F.coalesce(h, F.array().cast(S.HISTORY))).alias("pos", "m"))
                    .select("session_id", "pos", "m.*"))


def merge_sessions(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """SNK-3: upsert. Per session the newest history wins (by updated_at, then
    the update sequence); the title is the newest non-empty one ('' and null
    leave it unchanged). Partial ``max_by`` aggregation, no per-key sort."""
    b = base.withColumn(seq, F.lit(-1).cast("bigint"))
    u = b.unionByName(updates, allowMissingColumns=True)
    order = F.struct(F.col("updated_at"), F.col(seq))
    has_title = F.coalesce(F.length("title"), F.lit(0)) > 0
    return u.groupBy("session_id").agg(
        F.max_by(F.col("history"), order).alias("history"),
        F.max_by(F.col("title"), F.when(has_title, order)).alias("title"),
        F.max("updated_at").alias("updated_at"))


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write a new version directory and a completion marker; readers take the
    newest complete version (no table format needed)."""
    path = f"{root}/v={version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def merge_sessions_stream(updates: DataFrame, root: str, checkpoint: str):
    """SNK-3 streaming: every micro-batch of session updates is merged into the
    newest complete version and written as the next version (the batch id
    orders versions, so a replayed batch rewrites the same version)."""
    spark = updates.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        base = _version_below(spark, root, batch_id + 1)
        if base is None:
            base = spark.createDataFrame([], batch.select("session_id", "history", "title", "updated_at").schema)
        merged = merge_sessions(base, batch)
        write_version(merged.select("session_id", "history", "title", "updated_at"), root, batch_id + 1)

    return (updates.writeStream.option("checkpointLocation", checkpoint)
                   .foreachBatch(upsert).trigger(availableNow=True).start())


def _version_below(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """Newest complete version older than ``version``; None if there is none. Any
    other failure is raised."""
    done = [v for v in _complete_versions(spark, root) if int(v.removeprefix("v=")) < version]
    return spark.read.parquet(f"{root}/{max(done)}") if done else None


def read_latest_version(spark: SparkSession, root: str) -> DataFrame:
    done = _complete_versions(spark, root)
    if not done:
        raise FileNotFoundError(f"no complete version under {root}")
    return spark.read.parquet(f"{root}/{max(done)}")


def _complete_versions(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)
            if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]


def tools_used(msgs: DataFrame, session: str, role: str, calls: str | None = None, name: str | None = None) -> DataFrame:
    """AGG-2: distinct tools per session: function names of assistant tool calls
    (missing name -> 'unknown') plus the name of tool-role messages; sorted
    (the original set order is undefined)."""
    parts = []
    if calls:
        a = msgs.filter((F.col(role) == "assistant") & F.col(calls).isNotNull())
        parts.append(a.select(session, F.explode(calls).alias("_c"))
                      .select(session, F.coalesce(F.col("_c.function.name"), F.lit("unknown")).alias("tool")))
    if name:
        parts.append(msgs.filter((F.col(role) == "tool") & (F.coalesce(F.length(name), F.lit(0)) > 0))
                         .select(session, F.col(name).alias("tool")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct().groupBy(session).agg(F.array_sort(F.collect_list("tool")).alias("tools_used"))
