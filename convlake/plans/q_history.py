"""History and location queries on v_msg / v_turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.operators import geo as G
from convlake.operators import history as H
from convlake.plans import duck as K
from convlake.plans.registry import REGISTRY, register
from convlake.plans.views import duckdb_with, view

W = duckdb_with


def _msgs(spark, sf):
    return view(spark, sf, "v_msg").select("msg_id", "session_id", "turn", "brand", "role",
                                           F.col("text").alias("content"))


@register("win2_trim_history", "WIN-2", oracle=W("v_msg") + """SELECT msg_id, session_id FROM (
 SELECT msg_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, msg_id) AS rn_a,
  row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, msg_id DESC) AS rn_d FROM v_msg) t
WHERE rn_a = 1 OR rn_d <= 10""")
def win2_trim_history(spark, sf):
    return H.trim_history(_msgs(spark, sf)).select("msg_id", "session_id")


DIGEST_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, msg_id DESC) AS rn FROM v_msg),
p AS (SELECT session_id, string_agg(CONCAT(COALESCE(role, 'unknown'), ': ', SUBSTRING(text, 1, 40), '...'), ' '
        ORDER BY turn, msg_id) AS j FROM r WHERE rn > 10 AND COALESCE(length(text), 0) > 0 GROUP BY session_id),
d AS (SELECT s.session_id, CASE WHEN p.j IS NULL THEN '' ELSE '[History: ' || right(p.j, 300) || ']' END AS digest
      FROM (SELECT DISTINCT session_id FROM v_msg) s LEFT JOIN p USING (session_id))"""


@register("agg9_digest", "AGG-9", oracle=W("v_msg").rstrip() + ",\n" + DIGEST_SQL[5:] + "\nSELECT * FROM d")
def agg9_digest(spark, sf):
    return H.digest(_msgs(spark, sf))


@register("win3_model_context", ("WIN-3", "AGG-9"), oracle=W("v_msg").rstrip() + ",\n" + DIGEST_SQL[5:] + f""",
l AS (SELECT * FROM r WHERE rn <= 10),
c AS (SELECT session_id, arg_min(text, struct_pack(t := turn, i := msg_id)) FILTER (WHERE role = 'system') AS sys,
      CAST(SUM(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) AS BIGINT) AS n_context FROM l GROUP BY session_id)
SELECT c.session_id, COALESCE(CASE WHEN d.digest <> '' THEN CONCAT({K.q(D.MEMORY_PREFIX)}, d.digest) END, c.sys,
 {K.q(D.DEFAULT_INSTRUCTION)}) AS system_content, c.n_context FROM c LEFT JOIN d USING (session_id)""")
def win3_model_context(spark, sf):
    return H.model_context(_msgs(spark, sf))


@register("agg7_consolidate_system", "AGG-7", oracle=W("v_turn") + """, ns AS (SELECT conv_id,
 SUM(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS n FROM v_turn GROUP BY conv_id)
SELECT t.conv_id, t.turn, t.role, t.text FROM v_turn t JOIN ns USING (conv_id) WHERE NOT (t.role = 'system' AND ns.n > 1)
UNION ALL
SELECT conv_id, CAST(-1 AS BIGINT), 'system', string_agg(text, chr(10) ORDER BY turn) FROM v_turn
WHERE role = 'system' AND conv_id IN (SELECT conv_id FROM ns WHERE n > 1) GROUP BY conv_id""")
def agg7_consolidate_system(spark, sf):
    return H.consolidate_system(view(spark, sf, "v_turn").select("conv_id", "turn", "role", "text"))


def _phrase_sql(low: str) -> list[str]:
    out = []
    for rx in D.LOCATION_PHRASES:
        n = rx.count("(") - rx.count("(?")
        groups = ", ".join(f"NULLIF(regexp_extract({low}, {K.q(rx)}, {g}), '')" for g in range(n, 0, -1))
        out.append(f"CASE WHEN regexp_matches({low}, {K.q(rx)}) THEN COALESCE({groups}) END")
    return out


_SLOTS = " UNION ALL ".join(
    [f"SELECT msg_id, {i} AS slot, {e} AS s FROM m" for i, e in enumerate(_phrase_sql("low"))]
    + [f"SELECT msg_id, {len(D.LOCATION_PHRASES)} AS slot, low AS s FROM m"])
TAG_SQL = f"""m AS (SELECT msg_id, session_id, turn, lower(text) AS low FROM v_msg),
s AS ({_SLOTS}),
h AS (SELECT s.msg_id, arg_min(struct_pack(kind := g.kind, city := g.city, region := g.region, state := g.state),
        s.slot * 100000000 + g.priority) AS hit
      FROM s JOIN v_gaz g ON contains(s.s, g.term) AND (s.slot = {len(D.LOCATION_PHRASES)} OR g.kind = 'city')
      WHERE s.s IS NOT NULL GROUP BY s.msg_id),
tg AS (SELECT m.msg_id, m.session_id, m.turn, h.hit.kind AS loc_kind, h.hit.city AS loc_city,
        h.hit.region AS loc_region, h.hit.state AS loc_state FROM m LEFT JOIN h USING (msg_id))"""


@register("join1_tag_location", "JOIN-1", oracle=W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL
          + "\nSELECT msg_id, loc_kind, loc_city, loc_region, loc_state FROM tg")
def join1_tag_location(spark, sf):
    m = view(spark, sf, "v_msg").select("msg_id", "text")
    return G.tag_location(m, view(spark, sf, "v_gaz")).drop("text")


@register("join1_tag_location_broadcast", "JOIN-1", oracle=W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL
          + "\nSELECT msg_id, loc_kind, loc_city, loc_region, loc_state FROM tg")
def join1_tag_location_broadcast(spark, sf):
    """Same answer through the anchor equi-join with broadcast terms (dictionary above the literal size)."""
    m = view(spark, sf, "v_msg").select("msg_id", "text")
    return G._tag_join(m, view(spark, sf, "v_gaz"), "text", D.LOCATION_PHRASES, broadcast=True).drop("text")


@register("join1_tag_location_automaton", "JOIN-1", oracle=W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL
          + "\nSELECT msg_id, loc_kind, loc_city, loc_region, loc_state FROM tg")
def join1_tag_location_automaton(spark, sf):
    """Same answer through one automaton of all terms (dictionary above the literal size)."""
    m = view(spark, sf, "v_msg").select("msg_id", "text")
    return G._tag_automaton(m, view(spark, sf, "v_gaz"), "text", D.LOCATION_PHRASES).drop("text")


@register("join1_tag_location_grams", "JOIN-1", oracle=W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL
          + "\nSELECT msg_id, loc_kind, loc_city, loc_region, loc_state FROM tg")
def join1_tag_location_grams(spark, sf):
    """Same answer through the shuffled anchor equi-join (dictionary above the broadcast size)."""
    m = view(spark, sf, "v_msg").select("msg_id", "text")
    return G._tag_join(m, view(spark, sf, "v_gaz"), "text", D.LOCATION_PHRASES, broadcast=False).drop("text")


@register("win4_running_location", ("WIN-4", "JOIN-1"), oracle=W("v_msg", "v_gaz").rstrip() + ",\n" + TAG_SQL + """
SELECT msg_id,
 last_value(loc_city IGNORE NULLS) OVER w AS city_now, last_value(loc_region IGNORE NULLS) OVER w AS region_now,
 last_value(loc_state IGNORE NULLS) OVER w AS state_now
FROM tg WINDOW w AS (PARTITION BY session_id ORDER BY turn, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win4_running_location(spark, sf):
    m = view(spark, sf, "v_msg").select("msg_id", "session_id", "turn", "text")
    tagged = G.tag_location(m, view(spark, sf, "v_gaz"))
    return G.running_location(tagged, bucket=1000).select("msg_id", "city_now", "region_now", "state_now")


@register("win4_running_location_sorted", ("WIN-4", "JOIN-1"), oracle=REGISTRY["win4_running_location"].oracle)
def win4_running_location_sorted(spark, sf):
    """Same answer through the range-partitioned carry used for huge sessions."""
    m = view(spark, sf, "v_msg").select("msg_id", "session_id", "turn", "text")
    tagged = G.tag_location(m, view(spark, sf, "v_gaz"))
    return G.running_location(tagged, plan="sorted").select("msg_id", "city_now", "region_now", "state_now")
