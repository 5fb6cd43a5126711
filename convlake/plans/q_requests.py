"""Request-log queries on v_req (hour-scale policies: the test gaps are long)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.operators import limits as LM
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view

W = duckdb_with
H = 3600
AS_OF = "2024-01-31 00:00:00"


def _range_count(key: str, secs: int) -> str:
    return (f"(COUNT(*) OVER (PARTITION BY {key} ORDER BY epoch_us(ts) RANGE BETWEEN {secs * 1_000_000 - 1} "
            f"PRECEDING AND CURRENT ROW) - 1)")


@register("win1_offered_load", "WIN-1", oracle=W("v_req") + f"""SELECT req_id, ip,
 {_range_count('ip', H)} AS n_1h, {_range_count('ip', 6 * H)} AS n_6h FROM v_req""")
def win1_offered_load(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "ip", "ts")
    return LM.offered_load(r, {"n_1h": H, "n_6h": 6 * H}).select("req_id", "ip", "n_1h", "n_6h")


@register("win1_offered_load_dense", "WIN-1", oracle=W("v_req") + f"""SELECT req_id, ip,
 {_range_count('ip', H)} AS n_1h, {_range_count('ip', 6 * H)} AS n_6h FROM v_req""")
def win1_offered_load_dense(spark, sf):
    """Same answer as win1_offered_load through the density-independent sorted plan."""
    r = view(spark, sf, "v_req").select("req_id", "ip", "ts")
    return LM.offered_load_dense(r, {"n_1h": H, "n_6h": 6 * H}).select("req_id", "ip", "n_1h", "n_6h")


@register("win6_hourly_quota", "WIN-6", oracle=W("v_req") + f"""SELECT req_id,
 {_range_count('session_id', 24 * H)} AS n_window, ({_range_count('session_id', 24 * H)} <= 3) AS admitted FROM v_req""")
def win6_hourly_quota(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.hourly_quota(r, limit=3, window_s=24 * H).select("req_id", "n_window", "admitted")


@register("win7_cooldown", "WIN-7", oracle=W("v_req") + f"""SELECT req_id,
 CASE WHEN g <= {H * 1_000_000} THEN g END AS gap_us, COALESCE(g < {H * 1_000_000}, false) AS cooldown_hit
FROM (SELECT req_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, req_id) AS g FROM v_req) t""")
def win7_cooldown(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.cooldown(r, secs=H).select("req_id", "gap_us", "cooldown_hit")


SESS_SQL = f"""g AS (SELECT *, epoch_us(ts) AS us,
   epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, req_id) AS gap FROM v_req),
s AS (SELECT *, (gap IS NULL OR gap > {H * 1_000_000}) AS is_start FROM g),
ss AS (SELECT *, max(CASE WHEN is_start THEN us END) OVER (PARTITION BY session_id ORDER BY ts, req_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start_us FROM s)"""


@register("win5_sessionize", "WIN-5", oracle=W("v_req").rstrip() + ",\n" + SESS_SQL
          + "\nSELECT req_id, is_start, session_start_us FROM ss")
def win5_sessionize(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.sessionize(r, gap_s=H).select("req_id", "is_start", "session_start_us")


@register("win5_sessionize_sorted", "WIN-5", oracle=W("v_req").rstrip() + ",\n" + SESS_SQL
          + "\nSELECT req_id, is_start, session_start_us FROM ss")
def win5_sessionize_sorted(spark, sf):
    """Same answer as win5_sessionize through the density-independent sorted plan."""
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.sessionize(r, gap_s=H, plan="sorted").select("req_id", "is_start", "session_start_us")


@register("agg3_session_totals", ("AGG-3", "WIN-5"), oracle=W("v_req").rstrip() + ",\n" + SESS_SQL + """
SELECT req_id, session_start_us, seq_in_session, seq_in_session <= 5 AS within_cap FROM (
 SELECT req_id, session_start_us, row_number() OVER (PARTITION BY session_id, session_start_us ORDER BY ts, req_id)
  AS seq_in_session FROM ss) t""")
def agg3_session_totals(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.session_totals(r, cap=5, idle_s=H).select("req_id", "session_start_us", "seq_in_session", "within_cap")


@register("join3_mark_cached_lag", "JOIN-3", oracle=W("v_req") + f"""SELECT req_id,
 COALESCE(g < {24 * H * 1_000_000}, false) AS cached FROM (SELECT req_id, epoch_us(ts) - lag(epoch_us(ts))
 OVER (PARTITION BY brand, session_id, message ORDER BY ts, req_id) AS g FROM v_req WHERE is_stream = 0) t""")
def join3_mark_cached_lag(spark, sf):
    return LM.mark_cached(view(spark, sf, "v_req"), ttl_s=24 * H).select("req_id", "cached")


_BRANDS = "CASE req_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'default' ELSE brand END"


@register("join3_default_brand_lag", "JOIN-3", oracle=W("v_req") + f"""SELECT req_id,
 COALESCE(g < {24 * H * 1_000_000}, false) AS cached FROM (SELECT req_id, epoch_us(ts) - lag(epoch_us(ts))
 OVER (PARTITION BY CASE WHEN req_id % 4 < 3 THEN 'default' ELSE brand END, session_id, message ORDER BY ts, req_id) AS g
 FROM v_req WHERE is_stream = 0) t""")
def join3_default_brand_lag(spark, sf):
    """A null brand, an empty one and the default brand are one cache key."""
    r = view(spark, sf, "v_req").withColumn("brand", F.expr(_BRANDS))
    return LM.mark_cached(r, ttl_s=24 * H).select("req_id", "cached")


@register("agg1_leads_per_ip", "AGG-1", oracle=W("v_req") + f"""SELECT ip AS ip_address, CAST(COUNT(*) AS BIGINT) AS n_leads
FROM v_req WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR GROUP BY ip""")
def agg1_leads_per_ip(spark, sf):
    leads = view(spark, sf, "v_req").select(F.col("ip").alias("ip_address"), "ts")
    return LM.leads_per_ip(leads, AS_OF, 72)


@register("top4_retain_recent", "TOP-4", oracle=W("v_req") + f"""SELECT session_id, last_seen FROM (
 SELECT session_id, max(ts) AS last_seen FROM v_req GROUP BY session_id) a
WHERE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen) <= {2 * 24 * H * 1_000_000}
ORDER BY last_seen DESC, session_id LIMIT 50""")
def top4_retain_recent(spark, sf):
    act = LM.last_seen(view(spark, sf, "v_req").select("session_id", "ts"))
    return LM.retain_recent(act, AS_OF, 2 * 24 * H, 50)


@register("top1_list_sessions", "TOP-1", oracle=W("v_req") + """SELECT session_id,
 CONCAT('Chat ', SUBSTRING(session_id, 1, 8)) AS title, max(ts) AS updated_at FROM v_req GROUP BY session_id""")
def top1_list_sessions(spark, sf):
    act = LM.last_seen(view(spark, sf, "v_req").select("session_id", "ts")).withColumnRenamed("last_seen", "updated_at")
    return LM.list_sessions(act, title=None)


@register("join5_sessions_for", "JOIN-5", oracle=W("v_req", "v_msg") + """SELECT req_id, brand, session_id FROM v_req r
WHERE EXISTS (SELECT 1 FROM v_msg m WHERE m.brand = r.brand AND m.session_id = r.session_id)""")
def join5_sessions_for(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "brand", "session_id")
    return LM.sessions_for(r, view(spark, sf, "v_msg"))


@register("str4_expire_idle", ("STR-4", "WIN-5"), oracle=W("v_req").rstrip() + ",\n" + SESS_SQL + f"""
SELECT session_id, session_start_us, max(us) + {H * 1_000_000} AS session_end_us, CAST(COUNT(*) AS BIGINT) AS n_requests
FROM ss GROUP BY session_id, session_start_us""")
def str4_expire_idle(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts")
    return LM.expire_idle(r, H)


CAP_SQL = f"""g AS (SELECT *, epoch_us(ts) AS us, message = 'q3' AS capture_start,
   epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, req_id) AS gap FROM v_req),
s AS (SELECT *, (gap IS NULL OR gap > {6 * H * 1_000_000}) AS is_start FROM g),
ss AS (SELECT *, max(CASE WHEN is_start THEN us END) OVER (PARTITION BY session_id ORDER BY ts, req_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start_us FROM s)"""


@register("str7_abandoned_captures", "STR-7", oracle=W("v_req").rstrip() + ",\n" + CAP_SQL + f"""
SELECT session_id, session_start_us, max(us) + {6 * H * 1_000_000} AS abandoned_at_us FROM ss
GROUP BY session_id, session_start_us HAVING bool_or(capture_start)""")
def str7_abandoned_captures(spark, sf):
    r = view(spark, sf, "v_req").select("req_id", "session_id", "ts", (F.col("message") == "q3").alias("capture_start"))
    return LM.abandoned_captures(r, 6 * H)
