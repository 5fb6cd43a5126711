"""Rule-driven column jobs: cleanup, classifiers, tool calls, filters, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import classify as C
from convlake.functions import cleanup as CL
from convlake.functions import dictionaries as D
from convlake.functions import toolcalls as TC
from convlake.functions.text import truncate
from convlake.operators import leads as L
from convlake.operators import routing as R
from convlake.plans import duck as K
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view

W = duckdb_with


def _duck_clean(expr: str, variant: str) -> str:
    if variant == "voice":
        t = K.ustrip(K.apply_rules(expr, CL.VOICE_RULES))
        return (f"CASE WHEN length({t}) > {CL.VOICE_CAP} THEN CONCAT(SUBSTRING({t}, 1, {CL.VOICE_CAP}), "
                f"{K.q(CL.VOICE_CAP_SUFFIX)}) ELSE {t} END")
    t = K.ustrip(K.apply_rules(expr, CL.WEB_RULES))
    return f"CASE WHEN length({t}) > {CL.WEB_CAP} THEN {K.ustrip(f'SUBSTRING({t}, 1, {CL.WEB_CAP})')} ELSE {t} END"


@register("scl1_clean_voice_msg", "SCL-1",
          oracle=W("v_msg") + f"SELECT msg_id, {_duck_clean('text', 'voice')} AS speech FROM v_msg")
def scl1_clean_voice_msg(spark, sf):
    return view(spark, sf, "v_msg").select("msg_id", CL.clean_markdown(F.col("text"), "voice").alias("speech"))


@register("scl1_clean_web_msg", "SCL-1",
          oracle=W("v_msg") + f"SELECT msg_id, {_duck_clean('text', 'web')} AS speech FROM v_msg")
def scl1_clean_web_msg(spark, sf):
    return view(spark, sf, "v_msg").select("msg_id", CL.clean_markdown(F.col("text"), "web").alias("speech"))


@register("scl1_clean_voice_documents", "SCL-1",
          oracle=f"SELECT doc_id, {_duck_clean('text', 'voice')} AS speech FROM documents")
def scl1_clean_voice_documents(spark, sf):
    return view(spark, sf, "documents").select("doc_id", CL.clean_markdown(F.col("text"), "voice").alias("speech"))


@register("scl2_clean_transcript_documents", "SCL-2")
def scl2_clean_transcript_documents(spark, sf):
    """No oracle: RE2 has no back-references; pytest checks it against Python re."""
    return view(spark, sf, "documents").select("doc_id", CL.clean_transcript(F.col("text")).alias("transcript"))


@register("scl4_truncate_documents", "SCL-4", oracle=f"""SELECT doc_id,
 CASE WHEN length(text) > 1000 THEN CONCAT(SUBSTRING(text, 1, 200), {K.q(D.TRUNCATION_MARKER)}) ELSE text END AS tool_result,
 CASE WHEN length(text) > 60 THEN CONCAT(SUBSTRING(text, 1, 60), '..') ELSE text END AS short_desc FROM documents""")
def scl4_truncate_documents(spark, sf):
    t = F.col("text")
    return view(spark, sf, "documents").select(
        "doc_id", truncate(t, 1000, 200, D.TRUNCATION_MARKER).alias("tool_result"),
        truncate(t, 60, 60, "..").alias("short_desc"))


@register("scl5_classify_errors", "SCL-5", oracle=W("v_attempt") + f"""SELECT attempt_id,
 {K.classify('error', D.ERROR_RULES, D.ERROR_DEFAULT)} AS category,
 {K.classify('error', D.IMAGE_ERROR_RULES, D.IMAGE_ERROR_DEFAULT)} AS image_category FROM v_attempt""")
def scl5_classify_errors(spark, sf):
    e = F.col("error")
    return view(spark, sf, "v_attempt").select(
        "attempt_id", C.classify_error(e).alias("category"),
        C.classify_error(e, D.IMAGE_ERROR_RULES, D.IMAGE_ERROR_DEFAULT).alias("image_category"))


JITTER = 0.25


@register("scl6_retry_plan", "SCL-6", oracle=W("v_attempt") + f"""SELECT attempt_id,
 (contains(error, '429') OR contains(lower(error), 'quota') OR contains(lower(error), 'limit')) AS is_quota,
 CAST(COALESCE(NULLIF(regexp_extract(error, {K.q(K.re2(C.RETRY_RX[0]))}, 1), ''),
               NULLIF(regexp_extract(error, {K.q(K.re2(C.RETRY_RX[1]))}, 1), '')) AS BIGINT) AS retry_delay_s,
 LEAST(2.0 * pow(2.0, CAST(attempt_no AS DOUBLE)) + {JITTER}, 60.0) AS planned_wait
FROM v_attempt WHERE error IS NOT NULL""")
def scl6_retry_plan(spark, sf):
    e = F.col("error")
    return (view(spark, sf, "v_attempt").filter(e.isNotNull())
            .select("attempt_id", C.is_quota_error(e).alias("is_quota"), C.retry_hint(e).alias("retry_delay_s"),
                    C.planned_wait(F.col("attempt_no"), JITTER).alias("planned_wait")))


_RAW = f"NULLIF(regexp_extract(COALESCE(text, ''), {K.q(K.re2(TC.TOOL_CALL_RX))}, 1), '')"


@register("scl7_recover_tool_calls", "SCL-7", oracle=W("v_msg") + f"""SELECT msg_id,
 json_extract_string(raw, '$.prompt') AS prompt, CAST(json_array_length(json_keys(raw)) AS INTEGER) AS n_args
FROM (SELECT msg_id, {_RAW} AS raw FROM v_msg) t WHERE raw IS NOT NULL AND json_valid(raw)""")
def scl7_recover_tool_calls(spark, sf):
    m = view(spark, sf, "v_msg").select("msg_id", TC.recovered_call(F.col("text")).alias("args"))
    return m.filter(F.col("args").isNotNull()).select(
        "msg_id", F.col("args")["prompt"].alias("prompt"), F.size("args").alias("n_args"))


@register("scl8_tool_args", "SCL-8", oracle=W("v_msg") + f"""SELECT msg_id, k AS arg_key,
 json_extract_string(raw, CONCAT('$."', k, '"')) AS arg_value
FROM (SELECT msg_id, raw, UNNEST(CASE WHEN json_valid(raw) THEN json_keys(raw) ELSE [NULL] END) AS k
      FROM (SELECT msg_id, {_RAW} AS raw FROM v_msg) a WHERE raw IS NOT NULL) t""")
def scl8_tool_args(spark, sf):
    raw = F.nullif(F.regexp_extract(F.coalesce(F.col("text"), F.lit("")), TC.TOOL_CALL_RX, 1), F.lit(""))
    m = view(spark, sf, "v_msg").select("msg_id", raw.alias("raw")).filter(F.col("raw").isNotNull())
    return m.select("msg_id", F.explode_outer(TC.tool_args(F.col("raw"))).alias("arg_key", "arg_value"))


BRAND_RULES = [("brand_b", ["green", "landscap"]), ("brand_a", ["ai"])]


@register("scl9_resolve_brand", "SCL-9", oracle=W("v_msg") + f"""SELECT msg_id,
 CASE WHEN text IS NOT NULL AND length(text) > 0 THEN
   CASE WHEN {K.contains_any('lower(trim(text))', BRAND_RULES[0][1])} THEN 'brand_b'
        WHEN {K.contains_any('lower(trim(text))', BRAND_RULES[1][1])} THEN 'brand_a' ELSE 'brand_a' END
 ELSE 'brand_a' END AS resolved FROM v_msg""")
def scl9_resolve_brand(spark, sf):
    return view(spark, sf, "v_msg").select("msg_id", C.resolve_brand(F.col("text"), BRAND_RULES, "brand_a").alias("resolved"))


@register("scl10_session_key", "SCL-10", oracle=W("v_msg") + """SELECT msg_id,
 CASE WHEN starts_with(session_id, CONCAT(brand, '_')) THEN session_id ELSE CONCAT(brand, '_', session_id) END AS skey,
 COALESCE(NULLIF(CASE WHEN msg_id % 2 = 0 THEN role END, ''), CONCAT('Chat ', SUBSTRING(session_id, 1, 8))) AS title
FROM v_msg""")
def scl10_session_key(spark, sf):
    m = view(spark, sf, "v_msg")
    title = F.when(F.col("msg_id") % 2 == 0, F.col("role"))
    return m.select("msg_id", C.session_key(F.col("brand"), F.col("session_id")).alias("skey"),
                    C.session_title(title, F.col("session_id")).alias("title"))


AS_OF = "2024-01-30 00:00:00"


@register("scl11_content_key", "SCL-11", oracle=W("v_req") + f"""SELECT req_id,
 SUBSTRING(sha256(CONCAT(message, '|', '1:1')), 1, 16) AS ckey,
 (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) BETWEEN 0 AND 86400000000) AS valid FROM v_req""")
def scl11_content_key(spark, sf):
    r = view(spark, sf, "v_req")
    age = F.expr(f"timestampdiff(MICROSECOND, ts, TIMESTAMP_NTZ'{AS_OF}')")
    return r.select("req_id", C.content_key(F.col("message"), F.lit("1:1")).alias("ckey"),
                    age.between(0, 86_400_000_000).alias("valid"))


@register("flt1_log_messages", "FLT-1", oracle=W("v_msg") + """SELECT msg_id, COALESCE(role, 'unknown') AS role,
 COALESCE(text, '') AS text FROM v_msg WHERE role IN ('user', 'assistant', 'tool')""")
def flt1_log_messages(spark, sf):
    return R.log_messages(view(spark, sf, "v_msg").select("msg_id", "role", "text"), content="text")


@register("flt2_plain_text_turns", "FLT-2", oracle=W("v_turn") + """SELECT conv_id, turn, role FROM v_turn
 WHERE role IN ('system', 'user', 'assistant') AND regexp_matches(text, '\\S')""")
def flt2_plain_text_turns(spark, sf):
    return R.plain_text_messages(view(spark, sf, "v_turn"), content="text").select("conv_id", "turn", "role")


@register("flt3_valid_leads", "FLT-3", oracle=W("v_lead") + """SELECT lead_id,
 (COALESCE(length(name), 0) > 0 AND COALESCE(length(email), 0) > 0) AS is_valid FROM v_lead""")
def flt3_valid_leads(spark, sf):
    return L.valid_leads(view(spark, sf, "v_lead")).select("lead_id", "is_valid")


@register("flt5_quote_intent", "FLT-5", oracle=W("v_msg") + f"""SELECT msg_id,
 {K.contains_any('lower(text)', D.QUOTE_TERMS)} AS quote_intent FROM v_msg""")
def flt5_quote_intent(spark, sf):
    return R.tag_intent(view(spark, sf, "v_msg")).select("msg_id", "quote_intent")


PACKS = [("a", "pack_a"), ("b", "pack_b")]


@register("flt6_route_knowledge", ("FLT-6", "UDF-1"), oracle=W("v_msg") + f"""SELECT msg_id,
 CASE WHEN regexp_matches(lower(text), {K.q(D.MATH_PREFIX)}) THEN NULL
      WHEN brand = 'b' THEN p.pack
      WHEN {K.contains_any('lower(text)', D.PRIMARY_TERMS)} THEN p.pack
      WHEN {K.contains_any('lower(text)', D.SERVICE_TERMS + D.GENERAL_TERMS)} THEN p.pack END AS knowledge
FROM v_msg LEFT JOIN (VALUES ('a', 'pack_a'), ('b', 'pack_b')) p(brand_p, pack) ON brand = p.brand_p""")
def flt6_route_knowledge(spark, sf):
    packs = spark.createDataFrame(PACKS, "brand string, pack string")
    m = view(spark, sf, "v_msg").select("msg_id", "brand", "text")
    return R.route_knowledge(m, packs, always_brands=("b",)).select("msg_id", "knowledge")


@register("flt7_route_tools", ("FLT-7", "UDF-1"), oracle=W("v_msg") + f"""SELECT msg_id, concat_ws(',',
 CASE WHEN {K.contains_any('lower(text)', D.TOOL_RULES[0][1])} THEN '{D.TOOL_RULES[0][0]}' END,
 CASE WHEN {K.contains_any('lower(text)', D.TOOL_RULES[1][1])} THEN '{D.TOOL_RULES[1][0]}' END) AS tools FROM v_msg""")
def flt7_route_tools(spark, sf):
    m = R.route_tools(view(spark, sf, "v_msg").select("msg_id", "text"))
    return m.select("msg_id", F.array_join("tools", ",").alias("tools"))


PURGE_TERMS = ["design", "supply"]


@register("flt8_purge_sessions", "FLT-8", oracle=W("v_msg") + f"""SELECT msg_id, session_id, brand FROM v_msg m
 WHERE NOT EXISTS (SELECT 1 FROM v_msg f WHERE f.brand = 'a' AND f.brand = m.brand AND f.session_id = m.session_id
                   AND {K.contains_any('lower(COALESCE(f.text, \'\'))', PURGE_TERMS)})""")
def flt8_purge_sessions(spark, sf):
    m = view(spark, sf, "v_msg").select("msg_id", "session_id", "brand", "text")
    return R.purge_sessions(m, PURGE_TERMS, "a").select("msg_id", "session_id", "brand")


@register("flt9_gate_payloads", "FLT-9", oracle=f"""SELECT doc_id, CASE WHEN n_chars > {D.PAYLOAD_MAX_BYTES} THEN 'too_large'
 WHEN n_chars < {D.PAYLOAD_MIN_BYTES} THEN 'no_audio' ELSE 'ok' END AS verdict FROM documents""")
def flt9_gate_payloads(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return R.gate_payloads(d).select("doc_id", "verdict")


@register("flt10_probe_verdict", "FLT-10", oracle=f"""SELECT doc_id,
 (regexp_matches(COALESCE(text, ''), '\\S') AND NOT contains(COALESCE(text, ''), {K.q(D.HIGH_DEMAND_PHRASE)})) AS ok
FROM documents""")
def flt10_probe_verdict(spark, sf):
    return R.probe_verdict(view(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ok")


@register("flt11_with_defaults", "FLT-11", oracle=W("v_lead") + f"""SELECT lead_id,
 COALESCE(NULLIF(source, ''), '{D.LEAD_SOURCE}') AS source, COALESCE(NULLIF(brand, ''), '{D.DEFAULT_BRAND}') AS brand
FROM v_lead""")
def flt11_with_defaults(spark, sf):
    return L.with_lead_defaults(view(spark, sf, "v_lead")).select("lead_id", "source", "brand")
