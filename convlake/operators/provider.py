"""Provider-attempt analytics: status, error report, dead-model exclusion,
first success, preference ranking, de-dup and chain difference.

Attempts are rows (attempt_id, request_id, attempt_no, model, ts, error);
error null = success. Models are few and hot, so per-model ordered work uses
(model, time bucket) partitions and everything else partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions.classify import classify_error
from convlake.operators.sequence import (DENSE_ROWS, bucket_width, carry_last_sorted, densest_bucket, epoch_us,
                                         time_buckets, top_k)

US = 1_000_000


def with_category(attempts: DataFrame, error: str = "error", out: str = "category") -> DataFrame:
    return attempts.withColumn(out, classify_error(F.col(error)))


def provider_status(attempts: DataFrame, model: str = "model", ts: str = "ts", error: str = "error") -> DataFrame:
    """AGG-4: per model the latest failure (time, category) and latest success.
    ``max_by`` aggregates merge partially, so a hot model is one row per task."""
    a = with_category(attempts, error)
    us = epoch_us(F.col(ts))
    failed = F.col(error).isNotNull()
    return a.groupBy(model).agg(
        F.max(F.when(failed, us)).alias("last_fail_us"),
        F.max_by(F.col("category"), F.when(failed, F.struct(us, F.col("attempt_id")))).alias("last_fail_category"),
        F.max(F.when(~failed, us)).alias("last_ok_us"))


def last_ok_model(attempts: DataFrame, model: str = "model", ts: str = "ts", error: str = "error") -> DataFrame:
    """AGG-4: the model of the latest successful attempt overall (one row)."""
    ok = attempts.filter(F.col(error).isNull())
    return ok.agg(F.max_by(F.col(model), F.struct(epoch_us(F.col(ts)), F.col("attempt_id"))).alias("last_ok_model"))


def error_report(attempts: DataFrame, model: str = "model", error: str = "error") -> DataFrame:
    """AGG-5: failures per model and category."""
    a = with_category(attempts.filter(F.col(error).isNotNull()), error)
    return a.groupBy(model, "category").agg(F.count(F.lit(1)).alias("n"))


def available_models(attempts: DataFrame, ttl_s: int = 6 * 3600, model: str = "model", ts: str = "ts",
                     tiebreak: str = "attempt_id", plan: str = "auto") -> DataFrame:
    """JOIN-4: an attempt's model is available unless an earlier attempt of the
    same model failed as model_unavailable at most ``ttl_s`` before (a model is
    kept only once the age exceeds the TTL).

    The interval anti-join is a per-model running max of unavailable times,
    computed in (model, time bucket) partitions with a TTL-wide halo.
    """
    ttl = ttl_s * US
    a = with_category(attempts).withColumn("_us", epoch_us(F.col(ts)))
    if plan == "auto":
        plan = "sorted" if densest_bucket(a, [model], "_us", bucket_width(ttl)) > DENSE_ROWS else "buckets"
    if plan == "sorted":
        # Models are few, so each is a hot key: a range-partitioned scan carries
        # the last unavailable time (strictly earlier attempts only).
        a = a.withColumn("_dead_at", F.when(F.col("category") == "model_unavailable", F.col("_us")))
        d = carry_last_sorted(a, model, "_us", tiebreak, ["_dead_at"], suffix="_before", inclusive=False)
        avail = F.col("_dead_at_before").isNull() | (F.col("_us") - F.col("_dead_at_before") > ttl)
        return d.withColumn("available", avail).drop("_dead_at", "_dead_at_before", "_us")
    t = time_buckets(a, "_us", bucket_width(ttl), ttl)
    w = Window.partitionBy(model, "_b").orderBy("_us", tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    last_dead = F.max(F.when(F.col("category") == "model_unavailable", F.col("_us"))).over(w)
    t = t.withColumn("_dead", last_dead).filter("_own")
    avail = F.col("_dead").isNull() | (F.col("_us") - F.col("_dead") > ttl)
    return t.withColumn("available", avail).drop("_b", "_own", "_dead", "_us")


def first_success(attempts: DataFrame, request: str = "request_id", attempt_no: str = "attempt_no",
                  model: str = "model", error: str = "error") -> DataFrame:
    """WIN-8: per request the first successful attempt along the chain and how
    many attempts came before it (all of them failed, by definition).

    No per-request array is built: the first success is a lexicographic
    ``min(struct(attempt_no, attempt_id, model))`` (partial aggregation), and
    the attempts before it are counted after an equi-join on the request (AQE
    splits a hot request); null request ids form one ordinary group.
    """
    key = F.struct(F.col(attempt_no).alias("n"), F.col("attempt_id").alias("i"))
    firsts = (attempts.filter(F.col(error).isNull())
                      .groupBy(request).agg(F.min(F.struct(key.alias("k"), F.col(model).alias("m"))).alias("_f")))
    j = attempts.select(request, key.alias("_k")).join(
        firsts.withColumnRenamed(request, "_r"), F.col(request).eqNullSafe(F.col("_r")), "left")
    before = F.when(F.col("_f").isNull() | (F.col("_k") < F.col("_f.k")), 1).otherwise(0)
    return (j.groupBy(request)
             .agg(F.first("_f", ignorenulls=True).alias("_f"), F.sum(before).cast("bigint").alias("n_failed_before"))
             .select(request, F.col("_f.m").alias("first_ok_model"), F.col("_f.k.n").alias("first_ok_attempt"),
                     "n_failed_before"))


def preferred(df: DataFrame, id_col: str, prefs: list[str], excludes: list[str], k: int, by: str,
              ordinal: str, active: str | None = None) -> DataFrame:
    """TOP-3: drop ids containing an excluded term (or inactive ones), rank by the
    first preference pattern the id contains, drop unranked, keep the best ``k``
    per ``by`` (ties in input order, given by ``ordinal``)."""
    low = F.lower(F.col(id_col))
    hit = F.array_position(F.transform(F.array(*[F.lit(p) for p in prefs]), lambda p: F.contains(low, p)), True)
    d = df.filter(~F.exists(F.array(*[F.lit(x) for x in excludes]), lambda x: F.contains(low, x)))
    if active:
        d = d.filter(F.col(active))
    d = d.withColumn("pref_rank", (hit - 1).cast("int")).filter(F.col("pref_rank") >= 0)
    return top_k(d, [by], [F.col("pref_rank"), F.col(ordinal)], k, "pos", salt_of=[ordinal])


def distinct_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SET-2: order-preserving de-dup, the first occurrence wins. ``min_by`` over a
    struct of the row merges partially, so a hot key never gathers in one task."""
    cols = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in cols])


def chain_minus_dead(chain: DataFrame, attempts: DataFrame, as_of: str, ttl_s: int = 6 * 3600,
                     model: str = "model", ts: str = "ts") -> DataFrame:
    """SET-3: models of the chain minus those seen unavailable within the TTL
    before ``as_of`` (left-anti join; the dead set is tiny and broadcast by AQE)."""
    age = F.timestamp_diff("MICROSECOND", F.col(ts).cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    dead = (with_category(attempts).filter((F.col("category") == "model_unavailable") & age.between(0, ttl_s * US))
                                   .select(model).distinct())
    return chain.join(dead, model, "left_anti")


def probe_timeline(probes: DataFrame, minutes: int = 4, ts: str = "ts", ok: str = "ok") -> DataFrame:
    """STR-6: per tumbling window of ``minutes``, the verdict of the latest probe
    and how many probes fell in it (a tumbling grid instead of a lazy refresh)."""
    us = epoch_us(F.col(ts))
    w = F.floor(us / F.lit(minutes * 60 * US)) * F.lit(minutes * 60 * US)
    return (probes.withColumn("window_start_us", w.cast("bigint"))
                  .groupBy("window_start_us")
                  .agg(F.max_by(F.col(ok), F.struct(us, F.col("attempt_id"))).alias("latest_ok"),
                       F.count(F.lit(1)).alias("n_probes")))
