"""Provider-attempt queries on v_attempt (and part for the ranking job)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.operators import provider as P
from convlake.plans import duck as K
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view

W = duckdb_with
H = 3600
CAT = K.classify("error", D.ERROR_RULES, D.ERROR_DEFAULT)


@register("agg4_provider_status", "AGG-4", oracle=W("v_attempt") + f"""SELECT model,
 max(epoch_us(ts)) FILTER (WHERE error IS NOT NULL) AS last_fail_us,
 arg_max({CAT}, struct_pack(u := epoch_us(ts), i := attempt_id)) FILTER (WHERE error IS NOT NULL) AS last_fail_category,
 max(epoch_us(ts)) FILTER (WHERE error IS NULL) AS last_ok_us FROM v_attempt GROUP BY model""")
def agg4_provider_status(spark, sf):
    return P.provider_status(view(spark, sf, "v_attempt"))


@register("agg4_last_ok_model", "AGG-4", oracle=W("v_attempt") + """SELECT
 arg_max(model, struct_pack(u := epoch_us(ts), i := attempt_id)) AS last_ok_model FROM v_attempt WHERE error IS NULL""")
def agg4_last_ok_model(spark, sf):
    return P.last_ok_model(view(spark, sf, "v_attempt"))


@register("agg5_error_report", ("AGG-5", "SCL-5"), oracle=W("v_attempt") + f"""SELECT model, {CAT} AS category,
 CAST(COUNT(*) AS BIGINT) AS n FROM v_attempt WHERE error IS NOT NULL GROUP BY ALL""")
def agg5_error_report(spark, sf):
    return P.error_report(view(spark, sf, "v_attempt"))


JOIN4_SQL = W("v_attempt") + f"""SELECT attempt_id,
 (d IS NULL OR epoch_us(ts) - d > {6 * H * 1_000_000}) AS available FROM (
 SELECT attempt_id, ts, max(CASE WHEN {CAT} = 'model_unavailable' THEN epoch_us(ts) END) OVER (PARTITION BY model
  ORDER BY epoch_us(ts), attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM v_attempt) t"""


@register("join4_available_models", "JOIN-4", oracle=JOIN4_SQL)
def join4_available_models(spark, sf):
    return P.available_models(view(spark, sf, "v_attempt")).select("attempt_id", "available")


@register("join4_available_models_sorted", "JOIN-4", oracle=JOIN4_SQL)
def join4_available_models_sorted(spark, sf):
    """Same answer through the range-partitioned scan used for hot models."""
    return P.available_models(view(spark, sf, "v_attempt"), plan="sorted").select("attempt_id", "available")


@register("win8_first_success", "WIN-8", oracle=W("v_attempt") + """, f AS (SELECT request_id,
 arg_min(model, struct_pack(n := attempt_no, i := attempt_id)) AS first_ok_model,
 arg_min(attempt_no, struct_pack(n := attempt_no, i := attempt_id)) AS first_ok_attempt,
 min(struct_pack(n := attempt_no, i := attempt_id)) AS k FROM v_attempt WHERE error IS NULL GROUP BY request_id)
SELECT a.request_id, f.first_ok_model, f.first_ok_attempt,
 CAST(COUNT(*) FILTER (WHERE f.k IS NULL OR struct_pack(n := a.attempt_no, i := a.attempt_id) < f.k) AS BIGINT)
  AS n_failed_before
FROM v_attempt a LEFT JOIN f USING (request_id) GROUP BY a.request_id, f.first_ok_model, f.first_ok_attempt""")
def win8_first_success(spark, sf):
    return P.first_success(view(spark, sf, "v_attempt"))


PREFS = ["promo", "standard", "economy", "small"]
EXCLUDES = ["large"]


@register("top3_preferred_parts", "TOP-3", oracle="SELECT p_brand, p_partkey, pref_rank, pos FROM (SELECT p_brand, p_partkey, "
          "pref_rank, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY pref_rank, p_partkey) AS INTEGER) AS pos FROM ("
          "SELECT p_brand, p_partkey, CAST(CASE " + " ".join(
              f"WHEN contains(lower(p_type), {K.q(p)}) THEN {i}" for i, p in enumerate(PREFS)) + " END AS INTEGER) AS pref_rank "
          "FROM part WHERE NOT " + K.contains_any("lower(p_type)", EXCLUDES) + ") a WHERE pref_rank IS NOT NULL) b WHERE pos <= 3")
def top3_preferred_parts(spark, sf):
    p = view(spark, sf, "part").select("p_brand", "p_partkey", "p_type")
    return P.preferred(p, "p_type", PREFS, EXCLUDES, 3, "p_brand", "p_partkey").select(
        "p_brand", "p_partkey", "pref_rank", "pos")


@register("set2_distinct_first", "SET-2", oracle=W("v_req") + """SELECT session_id, message,
 arg_min(req_id, struct_pack(t := ts, i := req_id)) AS req_id, arg_min(ts, struct_pack(t := ts, i := req_id)) AS ts
FROM v_req GROUP BY session_id, message""")
def set2_distinct_first(spark, sf):
    r = view(spark, sf, "v_req").select("session_id", "message", "req_id", "ts")
    return P.distinct_first(r, ["session_id", "message"], ["ts", "req_id"])


AS_OF = "2024-01-30 12:00:00"


@register("set3_chain_minus_dead", ("SET-3", "JOIN-4"), oracle=W("v_attempt") + f"""SELECT DISTINCT model FROM v_attempt
EXCEPT SELECT model FROM v_attempt WHERE {CAT} = 'model_unavailable'
 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) BETWEEN 0 AND {6 * H * 1_000_000}""")
def set3_chain_minus_dead(spark, sf):
    a = view(spark, sf, "v_attempt")
    return P.chain_minus_dead(a.select("model").distinct(), a, AS_OF)


@register("str6_probe_timeline", ("STR-6", "FLT-10"), oracle=W("v_attempt") + """SELECT
 CAST(floor(epoch_us(ts) / 240000000) * 240000000 AS BIGINT) AS window_start_us,
 arg_max(error IS NULL, struct_pack(u := epoch_us(ts), i := attempt_id)) AS latest_ok, CAST(COUNT(*) AS BIGINT) AS n_probes
FROM v_attempt GROUP BY 1""")
def str6_probe_timeline(spark, sf):
    a = view(spark, sf, "v_attempt").withColumn("ok", F.col("error").isNull())
    return P.probe_timeline(a)
