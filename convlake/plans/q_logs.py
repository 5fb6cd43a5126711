"""Log, session, SSE, lead-union and lookup queries (v_turn, v_msg, v_lead)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions import toolcalls as TC
from convlake.operators import geo as G
from convlake.operators import leads as L
from convlake.operators import lookup as LK
from convlake.operators import routing as R
from convlake.plans import duck as K
from convlake.plans.q_history import TAG_SQL
from convlake.plans.q_rules import PACKS
from convlake.plans.q_text import DETECTED_AT, _lead_sql
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view
from convlake.session import checkpoint_dir
from convlake.sources import buckets as BK
from convlake.sources import logs as LG
from convlake.sources import sse as SSE

W = duckdb_with
SAVED_AT = "2024-02-01T00:00:00Z"


@register("snk1_log_records", ("SNK-1", "FLT-1", "REDACT-1"), oracle=W("v_turn") + f"""SELECT
 CAST(conv_id AS VARCHAR) AS session_id, '{SAVED_AT}' AS timestamp,
 CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, {K.redact('text')} AS content
FROM v_turn WHERE role IN ('user', 'assistant', 'tool')""")
def snk1_log_records(spark, sf):
    t = view(spark, sf, "v_turn")
    logs = LG.log_records(t, "conv_id", "turn", "role", "text", SAVED_AT)
    return logs.select("session_id", "timestamp", F.posexplode("messages").alias("pos", "m")).select(
        "session_id", "timestamp", "pos", "m.role", "m.content")


@register("src2_explode_history", "SRC-2", oracle=W("v_turn") + """SELECT CAST(conv_id AS VARCHAR) AS session_id,
 CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, role, text AS content FROM v_turn""")
def src2_explode_history(spark, sf):
    t = view(spark, sf, "v_turn")
    s = LG.sessions_from_turns(t, "conv_id", "turn", "role", "text", F.lit("2024-01-01").cast("timestamp_ntz"))
    return LG.explode_history(s).select("session_id", "pos", "role", "content")


@register("src4_sse_roundtrip", ("SRC-4", "AGG-6"), oracle=W("v_turn") + """SELECT conv_id, turn,
 COALESCE(text, '') AS assembled, COALESCE(text, '') AS response, true AS matches FROM v_turn""")
def src4_sse_roundtrip(spark, sf):
    t = view(spark, sf, "v_turn").select("conv_id", "turn", "text")
    keys = ["conv_id", "turn"]
    toks = SSE.tokenize(t, "text", keys)
    lines = SSE.render_sse(toks, keys, full=t.select(*keys, F.coalesce("text", F.lit("")).alias("response")))
    a = SSE.assemble(SSE.parse_sse(lines), keys)
    return a.select(*keys, "assembled", "response", (F.col("assembled") == F.col("response")).alias("matches"))


SNAP = """snap AS (SELECT CAST(conv_id AS VARCHAR) AS session_id,
 CASE WHEN turn % 5 = 4 THEN NULL ELSE CONCAT('2024-01-01T', LPAD(CAST(turn AS VARCHAR), 6, '0'), 'Z') END AS timestamp,
 CAST(turn + 1 AS BIGINT) AS n_messages FROM v_turn)"""


def _snapshots(spark, sf):
    t = view(spark, sf, "v_turn")
    ts = F.when(F.col("turn") % 5 == 4, F.lit(None)).otherwise(
        F.concat(F.lit("2024-01-01T"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("Z")))
    return t.select(F.col("conv_id").cast("string").alias("session_id"), ts.alias("timestamp"),
                    (F.col("turn") + 1).cast("bigint").alias("n_messages"))


@register("agg10_latest_logs", "AGG-10", oracle=W("v_turn").rstrip() + ",\n" + SNAP + """
SELECT session_id, arg_max(timestamp, timestamp) AS timestamp, arg_max(n_messages, timestamp) AS n_messages
FROM snap GROUP BY session_id""")
def agg10_latest_logs(spark, sf):
    return LG.latest_logs(_snapshots(spark, sf))


@register("top2_list_logs", "TOP-2", oracle=W("v_turn").rstrip() + ",\n" + SNAP + """
SELECT session_id, timestamp, n_messages FROM snap ORDER BY timestamp DESC NULLS LAST, session_id""")
def top2_list_logs(spark, sf):
    return LG.list_logs(_snapshots(spark, sf))


@register("snk4_export_manifest", ("SNK-4", "AGG-8", "AGG-10"), oracle=W("v_turn").rstrip() + ",\n" + SNAP + """
SELECT TIMESTAMP '2024-02-01 00:00:00' AS exported_at, CAST(COUNT(DISTINCT session_id) AS BIGINT) AS total_conversations
FROM snap""")
def snk4_export_manifest(spark, sf):
    return LG.export_manifest(LG.latest_logs(_snapshots(spark, sf)), "2024-02-01 00:00:00")


MERGE_SQL = """WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
base AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CONCAT('t', CAST(conv_id AS VARCHAR)) AS title,
  json_array_length(to_json(list({'role': role, 'content': text} ORDER BY turn) FILTER (WHERE turn <= 1))) AS n,
  TIMESTAMP '2024-01-01 00:00:00' AS updated_at, -1 AS seq FROM t GROUP BY conv_id),
upd AS (SELECT CAST(conv_id AS VARCHAR) AS session_id,
  CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CONCAT('new', CAST(conv_id AS VARCHAR)) END AS title,
  CAST(COUNT(*) AS BIGINT) AS n, TIMESTAMP '2024-01-02 00:00:00' AS updated_at, 0 AS seq FROM t GROUP BY conv_id),
u AS (SELECT * FROM base UNION ALL SELECT * FROM upd)
SELECT session_id, CAST(arg_max(n, struct_pack(a := updated_at, s := seq)) AS BIGINT) AS n_messages,
 arg_max(title, struct_pack(a := updated_at, s := seq)) FILTER (WHERE COALESCE(length(title), 0) > 0) AS title,
 max(updated_at) AS updated_at FROM u GROUP BY session_id"""


def _session_updates(spark, sf):
    """The first two turns of every session, then an update of each with all turns."""
    t = view(spark, sf, "conversations")
    base = LG.sessions_from_turns(t.filter(F.col("turn") <= 1), "conv_id", "turn", "role", "text",
                                  F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
                                  title=F.concat(F.lit("t"), F.col("conv_id").cast("string")))
    title = (F.when(F.col("conv_id") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 3 == 1, F.lit(""))
              .otherwise(F.concat(F.lit("new"), F.col("conv_id").cast("string"))))
    upd = LG.sessions_from_turns(t, "conv_id", "turn", "role", "text",
                                 F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), title=title)
    return base, upd.withColumn("seq", F.lit(0).cast("bigint"))


def _merged(m):
    return m.select("session_id", F.size(F.from_json("history", "array<string>")).cast("bigint").alias("n_messages"),
                    "title", "updated_at")


@register("snk3_merge_sessions", "SNK-3", oracle=MERGE_SQL)
def snk3_merge_sessions(spark, sf):
    return _merged(LG.merge_sessions(*_session_updates(spark, sf)))


@register("snk3_upsert_buckets_stream", "SNK-3", oracle=MERGE_SQL)
def snk3_upsert_buckets_stream(spark, sf):
    """Both parts arrive as files of one stream that upserts into key buckets."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/sessions/{uuid.uuid4().hex}"
    base, upd = _session_updates(spark, sf)
    for part in (base.withColumn("seq", F.lit(0).cast("bigint")), upd):
        part.write.mode("append").parquet(f"{root}/in")
        q = BK.upsert_buckets_stream(spark.readStream.schema(upd.schema).parquet(f"{root}/in"), f"{root}/table", f"{root}/ck", buckets=16)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return _merged(BK.read_buckets(spark, f"{root}/table"))


_RAW = f"NULLIF(regexp_extract(COALESCE(text, ''), {K.q(K.re2(TC.TOOL_CALL_RX))}, 1), '')"


@register("agg2_tools_used", ("AGG-2", "SCL-7"), oracle=W("v_msg") + f"""SELECT s.session_id, COALESCE(x.tools, '') AS tools
FROM (SELECT DISTINCT session_id FROM v_msg) s LEFT JOIN (SELECT session_id, 'generate_image' AS tools FROM v_msg
 WHERE role = 'assistant' AND {_RAW} IS NOT NULL AND json_valid({_RAW}) GROUP BY session_id) x USING (session_id)""")
def agg2_tools_used(spark, sf):
    m = view(spark, sf, "v_msg")
    args = TC.recovered_call(F.col("text"))
    call = F.struct(F.lit("call_fallback").alias("id"),
                    F.struct(F.lit("generate_image").alias("name"), F.to_json(args).alias("arguments")).alias("function"))
    msgs = m.select("session_id", "role", F.when(args.isNotNull(), F.array(call)).alias("tool_calls"),
                    F.lit(None).cast("string").alias("name"))
    used = LG.tools_used(msgs, "session_id", "role", calls="tool_calls", name="name")
    return (m.select("session_id").distinct().join(used, "session_id", "left")
             .select("session_id", F.coalesce(F.array_join("tools_used", ","), F.lit("")).alias("tools")))


@register("join2_lookups", "JOIN-2", oracle=W("v_msg") + """SELECT msg_id,
 COALESCE(CASE brand WHEN 'a' THEN 'profile A' WHEN 'b' THEN 'profile B' END, 'profile default') AS profile,
 CASE WHEN length(COALESCE(CASE lower(role) WHEN 'user' THEN 'voice-user-01' WHEN 'assistant' THEN 'abc' END, role)) < 5
  THEN 'voice-default' ELSE COALESCE(CASE lower(role) WHEN 'user' THEN 'voice-user-01' WHEN 'assistant' THEN 'abc' END, role) END AS voice_id,
 COALESCE(CASE COALESCE(NULLIF(lower(regexp_extract(fname, '(\\.[^./]*)$', 1)), ''), '.webm')
   WHEN '.webm' THEN 'audio/webm' WHEN '.mp3' THEN 'audio/mpeg' WHEN '.wav' THEN 'audio/wav' END,
   COALESCE(NULLIF(ctype, ''), 'audio/webm')) AS mime
FROM (SELECT *, CONCAT('rec', CASE msg_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.WAV' WHEN 2 THEN '.xyz' ELSE '' END) AS fname,
 CASE WHEN msg_id % 3 = 0 THEN '' ELSE 'audio/ogg' END AS ctype FROM v_msg) m""")
def join2_lookups(spark, sf):
    m = view(spark, sf, "v_msg")
    m = m.withColumn("fname", F.concat(F.lit("rec"), F.when(F.col("msg_id") % 4 == 0, ".mp3")
                                       .when(F.col("msg_id") % 4 == 1, ".WAV").when(F.col("msg_id") % 4 == 2, ".xyz")
                                       .otherwise(""))) \
         .withColumn("ctype", F.when(F.col("msg_id") % 3 == 0, "").otherwise("audio/ogg"))
    brands = spark.createDataFrame([("a", "profile A"), ("b", "profile B")], "brand string, profile string")
    voices = spark.createDataFrame([("user", "voice-user-01"), ("assistant", "abc")], "name string, voice_id string")
    mimes = spark.createDataFrame([(".webm", "audio/webm"), (".mp3", "audio/mpeg"), (".wav", "audio/wav")],
                                  "suffix string, mime string")
    out = LK.lookup(m, brands.withColumnRenamed("brand", "_b"), "brand", "_b", "profile", "profile default")
    out = LK.voice_id(out, voices, "role", "voice-default")
    out = LK.mime_for(out, mimes, "fname", "ctype")
    return out.select("msg_id", "profile", "voice_id", "mime")


@register("join6_leads_with_session", "JOIN-6", oracle=W("v_msg") + """, l AS (""" + _lead_sql(
    "v_msg", "msg_id", "text", "session_id", "'unknown'", "brand") + """),
s AS (SELECT DISTINCT session_id, CONCAT('Chat ', session_id) AS title FROM v_msg)
SELECT l.msg_id, json_extract_string(l.metadata, '$.session_id') AS session_id, s.title
FROM l LEFT JOIN s ON json_extract_string(l.metadata, '$.session_id') = s.session_id""")
def join6_leads_with_session(spark, sf):
    m = view(spark, sf, "v_msg")
    leads = L.lead_rows(L.contact_leads(L.extract_leads(m)), session="session_id", brand="brand",
                        detected_at=F.lit(DETECTED_AT), keep=("msg_id",))
    sessions = m.select("session_id").distinct().withColumn("title", F.concat(F.lit("Chat "), F.col("session_id")))
    return LK.leads_with_session(leads, sessions).select("msg_id", "session_id", "title")


def _tool_calls(spark, sf):
    v = view(spark, sf, "v_lead")
    return v.select("lead_id", "session_id", "brand",
                    F.when(F.col("email").isNotNull(), F.col("email")).otherwise(F.col("name")).alias("user_info"),
                    F.concat(F.lit("quote for "), F.col("session_id")).alias("interest_detail"))


TOOL_SQL = f"""SELECT lead_id, COALESCE(NULLIF(ui, ''), {K.q(D.TOOL_LEAD_NAME)}) AS company_name,
 COALESCE(NULLIF(ui, ''), {K.q(D.TOOL_LEAD_NAME)}) AS contact_name, CASE WHEN contains(ui, '@') THEN ui END AS email,
 CONCAT({K.q(D.TOOL_LEAD_NOTES_PREFIX)}, 'quote for ', session_id) AS notes,
 CAST(to_json({{'session_id': session_id, 'brand': brand}}) AS VARCHAR) AS metadata
FROM (SELECT *, CASE WHEN email IS NOT NULL THEN email ELSE name END AS ui FROM v_lead) x"""


@register("lead3_tool_leads", "LEAD-3", oracle=W("v_lead") + TOOL_SQL)
def lead3_tool_leads(spark, sf):
    return L.tool_leads(_tool_calls(spark, sf)).select("lead_id", "company_name", "contact_name", "email", "notes",
                                                       "metadata")


@register("set1_union_leads", ("SET-1", "FLT-11", "LEAD-2", "LEAD-3"), oracle=W("v_lead") + f""", auto AS ("""
          + _lead_sql("v_msg", "msg_id", "text", "session_id", "'unknown'", "brand") + f"""),
tool AS ({TOOL_SQL})
SELECT 'form' AS capture_path, name AS contact_name, email, COALESCE(NULLIF(source, ''), '{D.LEAD_SOURCE}') AS source,
 COALESCE(NULLIF(brand, ''), '{D.DEFAULT_BRAND}') AS brand FROM v_lead
UNION ALL SELECT 'auto', contact_name, email, source, brand FROM auto
UNION ALL SELECT 'tool', contact_name, email, '{D.LEAD_SOURCE}', NULL FROM tool""")
def set1_union_leads(spark, sf):
    form = L.with_lead_defaults(view(spark, sf, "v_lead")).select(
        F.col("name").alias("contact_name"), "email", "source", "brand")
    m = view(spark, sf, "v_msg")
    auto = L.lead_rows(L.contact_leads(L.extract_leads(m)), session="session_id", brand="brand",
                       detected_at=F.lit(DETECTED_AT)).select("contact_name", "email", "source", "brand")
    tool = L.tool_leads(_tool_calls(spark, sf)).select("contact_name", "email", "source")
    return LK.union_leads(form, auto, tool).select("capture_path", "contact_name", "email", "source", "brand")


def _prompt_sql() -> str:
    route = (f"CASE WHEN regexp_matches(lower(text), {K.q(D.MATH_PREFIX)}) THEN NULL WHEN brand = 'b' THEN p.pack "
             f"WHEN {K.contains_any('lower(text)', D.PRIMARY_TERMS)} THEN p.pack "
             f"WHEN {K.contains_any('lower(text)', D.SERVICE_TERMS + D.GENERAL_TERMS)} THEN p.pack END")
    loc = ("CASE WHEN city_now IS NOT NULL THEN CONCAT('The user is located in ', city_now, ', ', COALESCE(region_now, 'None'), "
           "'. Tailor your advice for businesses in the ', city_now, '/', COALESCE(region_now, 'None'), ' area.') "
           "WHEN region_now IS NOT NULL THEN CONCAT('The user is in ', region_now, "
           "'. Provide locally relevant advice for businesses in ', region_now, '.') "
           "WHEN state_now IS NOT NULL THEN CONCAT('The user is in ', state_now, '. Adjust your recommendations for that market.') "
           "ELSE 'When discussing local business strategies, you may reference Global as the home region for our company.' END")
    return (W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL + f""",
rl AS (SELECT msg_id, last_value(loc_city IGNORE NULLS) OVER w AS city_now, last_value(loc_region IGNORE NULLS) OVER w AS region_now,
 last_value(loc_state IGNORE NULLS) OVER w AS state_now FROM tg
 WINDOW w AS (PARTITION BY session_id ORDER BY turn, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kb AS (SELECT msg_id, {route} AS knowledge FROM v_msg LEFT JOIN (VALUES ('a', 'pack_a'), ('b', 'pack_b')) p(brand_p, pack)
 ON brand = p.brand_p)
SELECT msg_id, CASE WHEN COALESCE(length(knowledge), 0) > 0
 THEN CONCAT({K.q(D.DEFAULT_INSTRUCTION + chr(10) + chr(10))}, {loc}, {K.q(chr(10) + chr(10) + LK.KNOWLEDGE_HEADER)}, knowledge)
 ELSE CONCAT({K.q(D.DEFAULT_INSTRUCTION + chr(10) + chr(10))}, {loc}) END AS system_prompt
FROM rl JOIN kb USING (msg_id)""")


@register("scl12_build_prompts", ("SCL-12", "WIN-4", "JOIN-1", "FLT-6"), oracle=_prompt_sql())
def scl12_build_prompts(spark, sf):
    m = view(spark, sf, "v_msg").select("msg_id", "session_id", "turn", "brand", "text")
    loc = G.running_location(G.tag_location(m, view(spark, sf, "v_gaz")), bucket=1000)
    packs = spark.createDataFrame(PACKS, "brand string, pack string")
    kb = R.route_knowledge(loc, packs, always_brands=("b",))
    return LK.build_prompts(kb).select("msg_id", "system_prompt")
