"""Queries that go through a sink or a stream and read the result back.

Scratch output lives in the session's shared checkpoint folder
(``spark.checkpoint.dir``), never in a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.operators import leads as L
from convlake.plans import duck as K
from convlake.plans.q_logs import SAVED_AT
from convlake.plans.q_text import DETECTED_AT
from convlake.plans.registry import REGISTRY, register
from convlake.plans.views import duckdb_with, view
from convlake.session import checkpoint_dir
from convlake.sources import leads as LS
from convlake.sources import logs as LG
from convlake.sources import sse as SSE
from convlake.streaming import jobs as J
from convlake.streaming.runner import file_table_stream, run_to_files

W = duckdb_with


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{what}-{uuid.uuid4().hex[:12]}"


@register("str1_stream_leads", ("STR-1", "LEAD-1", "FLT-4", "LEAD-2", "REDACT-1"),
          oracle=REGISTRY["lead1_contact_leads_documents"].oracle)
def str1_stream_leads(spark, sf):
    """Lead auto-capture as a file stream over the documents table (availableNow)."""
    schema = view(spark, sf, "documents").schema
    src = file_table_stream(spark, sf, "documents", schema).select("doc_id", "text")
    return run_to_files(J.stream_leads(src, "doc_id", detected_at=DETECTED_AT))


@register("str5_assemble_stream", ("STR-5", "SRC-4", "AGG-6"), oracle=W("v_turn") + """SELECT conv_id, turn,
 COALESCE(text, '') AS assembled, 'done' AS ended_by, COALESCE(text, '') AS response FROM v_turn""")
def str5_assemble_stream(spark, sf):
    t = view(spark, sf, "v_turn").select("conv_id", "turn", "text")
    keys = ["conv_id", "turn"]
    lines = SSE.render_sse(SSE.tokenize(t, "text", keys), keys,
                           full=t.select(*keys, F.coalesce("text", F.lit("")).alias("response")))
    path = _scratch(spark, "sse")
    lines.write.parquet(path)
    src = spark.readStream.schema(lines.schema).parquet(path)
    return run_to_files(J.assemble_stream(src).select("conv_id", "turn", "assembled", "ended_by", "response"))


@register("src1_read_logs", ("SRC-1", "SNK-1"), oracle=REGISTRY["snk1_log_records"].oracle)
def src1_read_logs(spark, sf):
    t = view(spark, sf, "v_turn")
    path = _scratch(spark, "logs")
    LG.write_logs(LG.log_records(t, "conv_id", "turn", "role", "text", SAVED_AT), path)
    back = LG.read_logs(spark, path, quarantine_path=path + "_quarantine")
    return back.select("session_id", "timestamp", F.posexplode("messages").alias("pos", "m")).select(
        "session_id", "timestamp", "pos", "m.role", "m.content")


@register("src3_read_leads", "SRC-3", oracle=W("v_lead") + """SELECT NULLIF(name, '') AS contact_name, email,
 CONCAT('lead ', CAST(lead_id AS VARCHAR)) AS notes,
 CONCAT('{"ip_address":"', ip_address, '","service":"chat"}') AS metadata,
 TIMESTAMP '2024-01-01 10:00:00' AS created_at FROM v_lead""")
def src3_read_leads(spark, sf):
    v = view(spark, sf, "v_lead")
    csv = v.select(F.lit("2024-01-01T10:00:00").alias("timestamp"), F.nullif("name", F.lit("")).alias("name"),
                   F.lit(None).cast("string").alias("phone"), "email", F.lit("chat").alias("service"),
                   F.lit(None).cast("string").alias("best_time"),
                   F.concat(F.lit("lead "), F.col("lead_id").cast("string")).alias("details"), "ip_address")
    path = _scratch(spark, "leads-csv")
    csv.write.option("header", True).csv(path)
    return LS.read_leads(spark, path, "csv").select("contact_name", "email", "notes", "metadata", "created_at")


@register("snk2_append_leads", ("SNK-2", "FLT-3"), oracle=W("v_lead") + f"""SELECT name AS contact_name, email,
 COALESCE(NULLIF(source, ''), '{D.LEAD_SOURCE}') AS source FROM v_lead
WHERE COALESCE(length(name), 0) > 0 AND COALESCE(length(email), 0) > 0""")
def snk2_append_leads(spark, sf):
    v = L.with_lead_defaults(view(spark, sf, "v_lead"))
    leads = v.select(F.col("name").alias("contact_name"), "email", "source")
    path = _scratch(spark, "leads")
    LS.append_leads(leads, path, rejected_path=path + "_rejected")
    return spark.read.parquet(path)


@register("src3_read_quoted_csv", ("SRC-3", "SNK-2"), oracle=duckdb_with("v_chat") + """SELECT CAST(msg_id AS VARCHAR) AS contact_name,
 NULLIF(text, '') AS notes, TIMESTAMP '2024-01-01 10:00:00' AS created_at, TIMESTAMP '2024-01-01 10:00:00' AS updated_at FROM v_chat""")
def src3_read_quoted_csv(spark, sf):
    """Fields with commas, quotes, line ends and outer blanks through the CSV sink and back."""
    v = view(spark, sf, "v_chat")
    none = F.lit(None).cast("string")
    csv = v.select(F.lit("2024-01-01T10:00:00").alias("timestamp"), F.col("msg_id").cast("string").alias("name"), none.alias("phone"),
                   F.lit("a@example.com").alias("email"), F.lit("chat, \"voice\"").alias("service"), none.alias("best_time"),
                   F.col("text").alias("details"), F.lit("10.0.0.1").alias("ip_address"))
    path = _scratch(spark, "leads-quoted")
    LS.append_leads(csv, path, fmt="csv", name="name")
    return LS.read_leads(spark, path, "csv").select("contact_name", F.nullif("notes", F.lit("")).alias("notes"), "created_at", "updated_at")


@register("snk2_append_stamped", ("SNK-2", "FLT-3"), oracle=W("v_lead") + f"""SELECT name AS contact_name, email,
 CAST({K.q(DETECTED_AT[:19])} AS TIMESTAMP) AS created_at, CAST({K.q(DETECTED_AT[:19])} AS TIMESTAMP) AS updated_at FROM v_lead
WHERE COALESCE(length(name), 0) > 0 AND COALESCE(length(email), 0) > 0""")
def snk2_append_stamped(spark, sf):
    """New rows of the remote shape with the times of their insert, as JSON and back."""
    v = view(spark, sf, "v_lead")
    now = F.lit(DETECTED_AT[:19]).cast("timestamp_ntz")
    path = _scratch(spark, "leads-remote")
    LS.append_leads(LS.stamped(v.select(F.col("name").alias("contact_name"), "email"), now), path, fmt="json", rejected_path=path + "_rejected")
    return LS.read_leads(spark, path, "remote").select("contact_name", "email", "created_at", "updated_at")


#: A pack is read as one string, so its size must not grow with the table.
PACK_BYTES = 32 << 20


@register("src5_read_knowledge", "SRC-5", oracle=W("v_turn") + """SELECT CONCAT('conv ', CAST(conv_id AS VARCHAR)) AS heading,
 CAST(length(CONCAT('# conv ', CAST(conv_id AS VARCHAR))) + 1 + SUM(length(text) + 1) AS BIGINT) AS n_chars
FROM v_turn GROUP BY conv_id""")
def src5_read_knowledge(spark, sf):
    """Knowledge packs derived from the conversations: one markdown heading per
    conversation followed by its turns; written as text files of whole
    conversations, as many as the data needs for about ``PACK_BYTES`` each (a
    longer conversation is one section and stays whole), read back whole and cut
    into sections."""
    from convlake.sources.knowledge import read_knowledge
    t = view(spark, sf, "v_turn")
    head = t.groupBy("conv_id").agg(F.lit(-1).cast("bigint").alias("turn")).withColumn(
        "value", F.concat(F.lit("# conv "), F.col("conv_id").cast("string")))
    lines = head.unionByName(t.select("conv_id", "turn", F.col("text").alias("value")))
    path = _scratch(spark, "knowledge")
    n_bytes = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    (lines.repartition(max(8, -(-n_bytes // PACK_BYTES)), "conv_id").sortWithinPartitions("conv_id", "turn").select("value")
          .write.text(path))
    k = read_knowledge(spark, path)
    return k.filter(F.col("heading").isNotNull()).select("heading", F.length("text").cast("bigint").alias("n_chars"))
