"""Sequential / stateful queries: rows-only checks by the driver, exactness by
pytest against plain-Python replays."""

from __future__ import annotations

from convlake.functions.chunking import chunk_sentences
from convlake.functions.dictionaries import RequestPolicy
from convlake.operators import sequential as SQ
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view

H = 3600
# Hour-scale policy: the test requests are sparse (0 gaps under 3 s).
HOUR_POLICY = RequestPolicy(ip_short_window=H, ip_short_limit=3, ip_long_window=6 * H, ip_long_limit=8,
                            session_cooldown=600, session_total=5, session_idle=6 * H, cache_ttl=24 * H)


def _admit_oracle(p: RequestPolicy, req_sql: str | None = None) -> str:
    """Exact admission replay in SQL: a recursive CTE steps through each
    client's requests in (time, id) order carrying the accepted times, the
    per-session state and the cache entries as lists."""
    us = 1_000_000
    sess_t = "STRUCT(sid VARCHAR, recent BIGINT, total BIGINT, last BIGINT)"
    return duckdb_with("v_req").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
r AS (SELECT req_id, ip, session_id, CONCAT(brand, '|', session_id, '|', message) AS ck, is_stream = 1 AS stream,
   epoch_us(ts) AS us, row_number() OVER (PARTITION BY ip ORDER BY epoch_us(ts), req_id) AS pos
   FROM ({req_sql or "SELECT * FROM v_req"}) q),
st AS (
 SELECT ip, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS req_id, CAST(NULL AS VARCHAR) AS session_id,
   CAST(NULL AS VARCHAR) AS verdict, CAST([] AS BIGINT[]) AS acc, CAST([] AS {sess_t}[]) AS sess,
   CAST([] AS STRUCT(k VARCHAR, t BIGINT)[]) AS cache
 FROM (SELECT DISTINCT ip FROM r) i
 UNION ALL
 SELECT ip, pos, req_id, session_id, verdict,
   CASE WHEN verdict = 'accepted' THEN list_append(acc1, now) ELSE acc1 END,
   list_append(list_filter(sess, lambda x: x.sid <> session_id), struct_pack(sid := session_id,
     recent := CASE WHEN verdict = 'accepted' THEN now ELSE e.recent END,
     total := CASE WHEN verdict = 'accepted' THEN total0 + 1 ELSE total0 END,
     last := CASE WHEN verdict = 'accepted' THEN now ELSE last0 END)),
   CASE WHEN verdict = 'accepted' AND NOT stream
        THEN list_append(list_filter(cache, lambda x: x.k <> ck), struct_pack(k := ck, t := now)) ELSE cache END
 FROM (
  SELECT *, CASE
     WHEN len(list_filter(acc1, lambda t: now - t < {p.ip_short_window * us})) >= {p.ip_short_limit} THEN 'ip_1min'
     WHEN len(acc1) >= {p.ip_long_limit} THEN 'ip_10min'
     WHEN e.recent IS NOT NULL AND now - e.recent < {p.session_cooldown * us} THEN 'session_cooldown'
     WHEN total0 >= {p.session_total} THEN 'session_total'
     WHEN NOT stream AND hit IS NOT NULL AND now - hit < {p.cache_ttl * us} THEN 'cached'
     ELSE 'accepted' END AS verdict
  FROM (
   SELECT *, CASE WHEN e.last IS NOT NULL AND now - e.last > {p.session_idle * us} THEN 0
                  ELSE COALESCE(e.total, 0) END AS total0,
          CASE WHEN e.last IS NOT NULL AND now - e.last > {p.session_idle * us} THEN NULL ELSE e.last END AS last0
   FROM (
    SELECT st.ip, r.pos, r.req_id, r.session_id, r.ck, r.stream, r.us AS now, st.sess, st.cache,
      list_filter(st.acc, lambda t: r.us - t < {p.ip_long_window * us}) AS acc1,
      list_filter(st.sess, lambda x: x.sid = r.session_id)[1] AS e,
      list_filter(st.cache, lambda x: x.k = r.ck)[1].t AS hit
    FROM st JOIN r ON r.ip = st.ip AND r.pos = st.pos + 1) a) b) c)
SELECT req_id, ip, session_id, verdict FROM st WHERE pos > 0"""


@register("str2_admit", ("STR-2", "UDF-3"), oracle=_admit_oracle(HOUR_POLICY))
def str2_admit(spark, sf):
    return SQ.admit(view(spark, sf, "v_req"), HOUR_POLICY)


def _cache_oracle(ttl_s: int) -> str:
    """Exact replay in SQL: each miss points to the first request at least a
    TTL later; the misses are the recursive chain from the first request."""
    return duckdb_with("v_req").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
r AS (SELECT req_id, CONCAT(brand, '|', session_id, '|', message) AS k, epoch_us(ts) AS us,
   row_number() OVER (PARTITION BY brand, session_id, message ORDER BY ts, req_id) AS pos FROM v_req WHERE is_stream = 0),
n AS (SELECT a.k, a.pos, (SELECT min(b.pos) FROM r b WHERE b.k = a.k AND b.us >= a.us + {ttl_s * 1_000_000}) AS nxt FROM r a),
m AS (SELECT k, pos, nxt FROM n WHERE pos = 1
      UNION ALL SELECT n.k, n.pos, n.nxt FROM m JOIN n ON n.k = m.k AND n.pos = m.nxt)
SELECT r.req_id, m.pos IS NULL AS cached FROM r LEFT JOIN m ON r.k = m.k AND r.pos = m.pos"""


QUOTA_REQ = "SELECT req_id, ts, session_id AS ip, session_id, '-' AS brand, '-' AS message, 1 AS is_stream FROM v_req"


@register("win6_hourly_quota_exact", ("WIN-6", "STR-2"), oracle=f"""SELECT req_id, ip AS session_id,
 verdict = 'accepted' AS admitted FROM ({_admit_oracle(SQ.quota_policy(3, 24 * H), QUOTA_REQ)}) x""")
def win6_hourly_quota_exact(spark, sf):
    """Accepted-only quota (3 per 24 h here; the service used 15 per hour):
    rejections do not count against the user."""
    return SQ.hourly_quota_exact(view(spark, sf, "v_req"), limit=3, window_s=24 * H)


@register("join3_mark_cached_exact", ("JOIN-3", "STR-3"), oracle=_cache_oracle(24 * H))
def join3_mark_cached_exact(spark, sf):
    return SQ.replay_cache(view(spark, sf, "v_req"), ttl_s=24 * H)


@register("join3_mark_cached_doubling", ("JOIN-3", "STR-3"), oracle=_cache_oracle(24 * H))
def join3_mark_cached_doubling(spark, sf):
    """The same answer with every key sent through the pointer-doubling plan
    (the plan used for keys too large for one ordered stream)."""
    return SQ.replay_cache(view(spark, sf, "v_req"), ttl_s=24 * H, serial_max=0)


def _chunk_oracle() -> str:
    """The chunk cursor as a recursive CTE: the remaining buffer is the state;
    each step cuts at the first boundary at or after the minimum length (20
    before the first kept chunk, 60 after) and keeps the cleaned chunk when it
    has at least two characters; the rest of the buffer is the last chunk."""
    from convlake.functions.chunking import FIRST_MIN, MIN_SPOKEN, NEXT_MIN
    from convlake.functions.cleanup import WEB_CAP, WEB_RULES
    from convlake.plans import duck as K

    def speech(x: str) -> str:
        t = K.ustrip(K.apply_rules(x, WEB_RULES))
        return f"CASE WHEN length({t}) > {WEB_CAP} THEN {K.ustrip(f'SUBSTRING({t}, 1, {WEB_CAP})')} ELSE {t} END"

    cut_rx = K.q("(?s)^(.*?)(([.!?][\"')\\]]*)\\s|\n)")
    return f"""WITH RECURSIVE st AS (
 SELECT doc_id, text AS b, 0 AS enq, CAST(NULL AS VARCHAR) AS chunk, 0 AS step, false AS done
 FROM documents WHERE text IS NOT NULL AND text <> ''
 UNION ALL
 SELECT doc_id, rest, enq + CASE WHEN keep THEN 1 ELSE 0 END, CASE WHEN keep THEN spoken END, step + 1, fin
 FROM (SELECT *, COALESCE(length(spoken), 0) >= {MIN_SPOKEN} AND NOT skip AS keep FROM (
  SELECT *, {speech('raw')} AS spoken FROM (
   SELECT doc_id, enq, step, fin, skip,
     CASE WHEN fin THEN b ELSE SUBSTRING(b, 1, cut) END AS raw,
     CASE WHEN fin THEN '' ELSE SUBSTRING(b, cut + 1) END AS rest
   FROM (
    SELECT *, NOT (length(b) > ml AND regexp_matches(tail, {cut_rx})) AS fin,
      (NOT (length(b) > ml AND regexp_matches(tail, {cut_rx}))) AND {K.ustrip('b')} = '' AS skip,
      ml + length(regexp_extract(tail, {cut_rx}, 1)) + length(regexp_extract(tail, {cut_rx}, 2)) AS cut
    FROM (SELECT *, CASE WHEN enq = 0 THEN {FIRST_MIN} ELSE {NEXT_MIN} END AS ml,
            SUBSTRING(b, CASE WHEN enq = 0 THEN {FIRST_MIN} ELSE {NEXT_MIN} END + 1) AS tail
          FROM st WHERE NOT done) a) b) c) d) e)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS chunk_no, chunk
FROM st WHERE chunk IS NOT NULL"""


@register("scl3_chunk_sentences", ("SCL-3", "UDF-2"), oracle=_chunk_oracle())
def scl3_chunk_sentences(spark, sf):
    return chunk_sentences(view(spark, sf, "documents"), "doc_id", "text")
