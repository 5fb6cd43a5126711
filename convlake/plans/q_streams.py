"""Streaming jobs as queries: the tables' rows arrive in time order over several
runs of one checkpointed stream, and what it emits equals the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions.chunking import register_chunk_function
from convlake.operators.sequence import epoch_us
from convlake.plans.q_sequential import HOUR_POLICY, H, _admit_oracle, _cache_oracle
from convlake.plans.registry import REGISTRY, register
from convlake.plans.views import duckdb_with, view
from convlake.sources import sse as SSE
from convlake.streaming import jobs as J
from convlake.streaming.runner import run_slices

FAR = "2100-01-01 00:00:00"


@register("str2_admit_stream", ("STR-2", "UDF-3"), oracle=_admit_oracle(HOUR_POLICY))
def str2_admit_stream(spark, sf):
    return run_slices(view(spark, sf, "v_req"), "ts", lambda s: J.admit_stream(s, HOUR_POLICY))


@register("str3_suppress_stream", ("STR-3", "UDF-3"), oracle=_cache_oracle(24 * H))
def str3_suppress_stream(spark, sf):
    return run_slices(view(spark, sf, "v_req"), "ts", lambda s: J.suppress_stream(s, 24 * H))


@register("str4_expire_idle_stream", ("STR-4", "WIN-5"), oracle=REGISTRY["str4_expire_idle"].oracle)
def str4_expire_idle_stream(spark, sf):
    req = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    out = run_slices(req, "ts", lambda s: J.expire_idle(s, H), sentinel={"session_id": "", "ts": FAR})
    return out.select("session_id", epoch_us(F.col("session_start")).alias("session_start_us"),
                      epoch_us(F.col("session_end")).alias("session_end_us"), "n_requests")


@register("str7_abandoned_captures_stream", "STR-7", oracle=f"""SELECT session_id, abandoned_at_us
FROM ({REGISTRY["str7_abandoned_captures"].oracle}) x""")
def str7_abandoned_captures_stream(spark, sf):
    req = view(spark, sf, "v_req").select("req_id", "session_id", "ts", (F.col("message") == "q3").alias("capture_start"))
    out = run_slices(req, "ts", lambda s: J.abandoned_captures(s, 6 * H), sentinel={"session_id": "", "ts": FAR, "capture_start": False})
    return out.select("session_id", epoch_us(F.col("abandoned_at")).alias("abandoned_at_us"))


@register("str6_probe_timeline_stream", ("STR-6", "FLT-10"), oracle=REGISTRY["str6_probe_timeline"].oracle)
def str6_probe_timeline_stream(spark, sf):
    probes = view(spark, sf, "v_attempt").select("attempt_id", "ts", F.col("error").isNull().alias("ok"))
    return run_slices(probes, "ts", J.probe_timeline_stream, sentinel={"attempt_id": -1, "ts": FAR, "ok": True})


#: How a reply of the fixture ends, by its number: done with the text; never; a response event and a bare done; images; error.
KINDS = 5
TIMEOUT_S = 300


def reply_lines(turns):
    """SSE lines with event times: one second apart in a reply, replies half a
    minute apart, a token after the end of every reply that ends."""
    keys = ["conv_id", "turn"]
    lines = SSE.render_sse(SSE.tokenize(turns, "text", keys), keys)
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(KINDS))
    text = F.coalesce("text", F.lit(""))

    def event(when, line_no, type_, **fields):
        body = F.to_json(F.struct(F.lit(type_).alias("type"), *(v.alias(k) for k, v in fields.items())))
        return turns.filter(when).select(*keys, F.lit(line_no).cast("bigint").alias("line_no"),
                                         F.concat(F.lit(SSE.DATA_PREFIX), body).alias("value"))

    last = 1 << 40
    parts = [lines,
             event(kind == 2, last - 3, "response", content=text),
             event(kind == 3, last - 3, "image", image_url=F.concat(F.lit("img/"), F.col("seq").cast("string"))),
             event(kind == 3, last - 2, "image", image_url=F.lit("img/last")),
             event((kind == 0) | (kind == 3), last, "done", response=text),
             event(kind == 2, last, "done"),
             event(kind == 4, last, "error", content=F.lit("broken")),
             event(kind != 1, last + 9, "token", content=F.lit(" too late"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    at = F.col("conv_id") * 60 + F.col("turn") * 30 + F.when(F.col("line_no") > last, 100).when(F.col("line_no") >= last - 3, 50).otherwise(
        F.least(F.col("line_no"), F.lit(40)))
    return out.withColumn("ts", F.timestamp_add("SECOND", at.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))


@register("str5_assemble_timeouts", ("STR-5", "SRC-4", "AGG-6"), oracle=duckdb_with("v_turn") + f"""SELECT conv_id, turn,
 COALESCE(text, '') AS assembled,
 CASE (conv_id + turn) % {KINDS} WHEN 1 THEN 'timeout' WHEN 4 THEN 'error' ELSE 'done' END AS ended_by,
 CASE WHEN (conv_id + turn) % {KINDS} IN (0, 2, 3) THEN COALESCE(text, '') END AS response,
 CASE WHEN (conv_id + turn) % {KINDS} = 4 THEN 'broken' END AS error,
 CASE WHEN (conv_id + turn) % {KINDS} = 3 THEN CONCAT('img/', CAST(seq AS VARCHAR), ' img/last') ELSE '' END AS images
FROM v_turn""")
def str5_assemble_timeouts(spark, sf):
    """Replies with every kind of end, over several runs; open ones end by timeout."""
    lines = reply_lines(view(spark, sf, "v_turn").select("conv_id", "turn", "text", "seq"))
    out = run_slices(lines, "ts", lambda s: J.assemble_stream(s, TIMEOUT_S),
                     sentinel={"conv_id": -1, "turn": -1, "line_no": 0, "value": 'data: {"type": "token"}', "ts": FAR})
    return out.withColumn("images", F.concat_ws(" ", "images"))


@register("udf2_chunk_sentences", ("UDF-2", "SCL-3"), oracle=REGISTRY["scl3_chunk_sentences"].oracle)
def udf2_chunk_sentences(spark, sf):
    register_chunk_function(spark)
    return spark.sql("SELECT doc_id, chunk_no, chunk FROM {docs}, LATERAL chunk_sentences(text)", docs=view(spark, sf, "documents"))
