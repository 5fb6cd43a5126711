"""Queries on v_chat, whose rows make each rule fire: system, tool, unknown and
missing roles, null, empty and blank texts, the provider's apology, and tool calls
that are fenced, nested, repeated or no JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions import toolcalls as TC
from convlake.operators import history as H
from convlake.operators import routing as R
from convlake.plans import duck as K
from convlake.plans.q_logs import MERGE_SQL, _merged, _session_updates
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view
from convlake.session import checkpoint_dir
from convlake.sources import buckets as BK
from convlake.sources import logs as LG

W = duckdb_with("v_chat")
FENCE = "```"


@register("flt1_chat_log_messages", "FLT-1", oracle=W + """SELECT msg_id, role, CASE WHEN text IS NULL THEN '' ELSE text END AS text
FROM v_chat WHERE role = 'user' OR role = 'assistant' OR role = 'tool'""")
def flt1_chat_log_messages(spark, sf):
    return R.log_messages(view(spark, sf, "v_chat").select("msg_id", "role", "text"), content="text")


@register("flt2_chat_plain_text", "FLT-2", oracle=W + """SELECT msg_id, role, text FROM v_chat
WHERE role NOT IN ('tool', 'function') AND length(replace(replace(replace(text, ' ', ''), chr(9), ''), chr(10), '')) > 0""")
def flt2_chat_plain_text(spark, sf):
    return R.plain_text_messages(view(spark, sf, "v_chat").select("msg_id", "role", "text"), content="text")


@register("flt10_chat_probe_verdict", "FLT-10", oracle=W + """SELECT msg_id, CASE WHEN text IS NULL THEN false
 WHEN length(replace(replace(replace(text, ' ', ''), chr(9), ''), chr(10), '')) = 0 THEN false
 ELSE text NOT LIKE '%high demand%' END AS ok FROM v_chat""")
def flt10_chat_probe_verdict(spark, sf):
    return R.probe_verdict(view(spark, sf, "v_chat").select("msg_id", "text")).select("msg_id", "ok")


_RAW = f"NULLIF(regexp_extract(COALESCE(text, ''), {K.q(K.re2(TC.TOOL_CALL_RX))}, 1), '')"
CALL_SQL = f"""calls AS (SELECT msg_id, session_id, role, name, CASE WHEN contains(raw, '{FENCE}json')
  THEN trim(split_part(split_part(raw, '{FENCE}json', 2), '{FENCE}', 1))
  WHEN contains(raw, '{FENCE}') THEN trim(split_part(raw, '{FENCE}', 2)) ELSE raw END AS args
 FROM (SELECT *, {_RAW} AS raw FROM v_chat) t)"""


@register("scl7_chat_tool_calls", "SCL-7", oracle=W.rstrip() + ",\n" + CALL_SQL + """
SELECT msg_id, json_extract_string(args, '$.prompt') AS prompt, CAST(len(json_keys(args)) AS INTEGER) AS n_args
FROM calls WHERE json_valid(args)""")
def scl7_chat_tool_calls(spark, sf):
    m = view(spark, sf, "v_chat").select("msg_id", TC.recovered_call(F.col("text")).alias("args"))
    return m.filter(F.col("args").isNotNull()).select("msg_id", F.col("args")["prompt"].alias("prompt"), F.size("args").alias("n_args"))


@register("agg2_chat_tools_used", ("AGG-2", "SCL-7"), oracle=W.rstrip() + ",\n" + CALL_SQL + """
SELECT session_id, string_agg(tool, ',' ORDER BY tool) AS tools FROM (
 SELECT session_id, CASE WHEN msg_id % 5 = 0 THEN 'unknown' ELSE 'generate_image' END AS tool FROM calls
 WHERE role = 'assistant' AND json_valid(args)
 UNION SELECT session_id, name FROM calls WHERE role = 'tool' AND name <> '') u GROUP BY session_id""")
def agg2_chat_tools_used(spark, sf):
    """Every fifth call carries no function name."""
    m = view(spark, sf, "v_chat")
    args = TC.recovered_call(F.col("text"))
    call = F.struct(F.struct(F.when(F.col("msg_id") % 5 != 0, "generate_image").alias("name"), F.to_json(args).alias("arguments")).alias("function"))
    msgs = m.select("session_id", "role", "name", F.when(args.isNotNull(), F.array(call)).alias("tool_calls"))
    return LG.tools_used(msgs, "session_id", "role", calls="tool_calls", name="name").select(
        "session_id", F.array_join("tools_used", ",").alias("tools"))


@register("agg7_chat_consolidate_system", "AGG-7", oracle=W + """SELECT session_id, msg_id, role, text FROM (
 SELECT *, count(*) FILTER (WHERE role = 'system') OVER (PARTITION BY session_id) AS n FROM v_chat) t
WHERE role IS DISTINCT FROM 'system' OR n = 1
UNION ALL SELECT session_id, -1, 'system', COALESCE(string_agg(text, chr(10) ORDER BY msg_id), '') FROM v_chat
WHERE role = 'system' GROUP BY session_id HAVING count(*) > 1""")
def agg7_chat_consolidate_system(spark, sf):
    return H.consolidate_system(view(spark, sf, "v_chat").select("session_id", "msg_id", "role", "text"), "session_id", "msg_id")


@register("win3_chat_model_context", ("WIN-3", "AGG-9"), oracle=W.rstrip() + f""",
r AS (SELECT *, count(*) OVER (PARTITION BY session_id ORDER BY turn DESC, msg_id DESC ROWS UNBOUNDED PRECEDING) AS age FROM v_chat),
old AS (SELECT session_id, string_agg(COALESCE(role, 'unknown') || ': ' || SUBSTRING(text, 1, 40) || '...', ' ' ORDER BY turn, msg_id) AS j
 FROM r WHERE age > 10 AND text <> '' GROUP BY session_id),
sys AS (SELECT session_id, text FROM (SELECT *, count(*) OVER (PARTITION BY session_id ORDER BY turn, msg_id ROWS UNBOUNDED PRECEDING) AS i
 FROM r WHERE age <= 10 AND role = 'system') s WHERE i = 1)
SELECT n.session_id, CASE WHEN old.j IS NOT NULL THEN {K.q(D.MEMORY_PREFIX)} || '[History: ' || right(old.j, 300) || ']'
 WHEN sys.text <> '' THEN sys.text ELSE {K.q(D.DEFAULT_INSTRUCTION)} END AS system_content, n.n_context
FROM (SELECT session_id, count(*) FILTER (WHERE role IS DISTINCT FROM 'system') AS n_context FROM r WHERE age <= 10 GROUP BY session_id) n
LEFT JOIN old USING (session_id) LEFT JOIN sys USING (session_id)""")
def win3_chat_model_context(spark, sf):
    return H.model_context(view(spark, sf, "v_chat").select("msg_id", "session_id", "turn", "role", F.col("text").alias("content")))


#: Sessions looked up: the feature is a lookup of given keys.
LOOKUP = ["7", "3", "9", "no such session"]


@register("join5_lookup_buckets", ("JOIN-5", "SNK-3"), oracle=f"SELECT * FROM ({MERGE_SQL}) m WHERE session_id IN ('7', '3', '9')")
def join5_lookup_buckets(spark, sf):
    """Point lookup in the bucketed session table: reads only the buckets of the keys."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/sessions/{uuid.uuid4().hex}"
    base, upd = _session_updates(spark, sf)
    BK.upsert_buckets(base.withColumn("seq", F.lit(0).cast("bigint")), root, 1, 16)
    BK.upsert_buckets(upd, root, 2, 16)
    return _merged(BK.read_buckets(spark, root, LOOKUP))
