"""Request-log analytics: sliding limits, sessions, caps, cache hits, retention.

Requests are rows (req_id, ts, ip, session_id, brand, message, is_stream).
Per-key windows are partitioned by (key, time bucket) with a halo of the
window width (``sequence.time_buckets``), so a client sending a third of all
requests is spread over many tasks; when a client is dense even within one
bucket, the ``auto`` plan switches to the range-partitioned sorted scans
(``sequence.sliding_counts_sorted`` / ``sessionize_sorted``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions.classify import brand_or_default
from convlake.operators.sequence import (DENSE_ROWS, bucket_width, carry_last, densest_bucket, epoch_us,
                                         prefix_count, prev_gap, sessionize_sorted, sliding_counts,
                                         sliding_counts_sorted)

US = 1_000_000


def with_us(reqs: DataFrame, ts: str = "ts", out: str = "_us") -> DataFrame:
    return reqs.withColumn(out, epoch_us(F.col(ts)))


def offered_load(reqs: DataFrame, windows: dict[str, int], key: str = "ip", ts: str = "ts",
                 plan: str = "auto", id_col: str = "req_id") -> DataFrame:
    """WIN-1: for each request, the earlier requests of the key younger than each
    window (age strictly below the window; same-timestamp peers count).

    ``plan``: 'buckets' (time-bucketed windows), 'sorted' (range-partitioned
    global sort, any density) or 'auto' (sorted only when some (key, bucket)
    holds more than ``DENSE_ROWS`` rows)."""
    if plan == "auto":
        bw = bucket_width(max(windows.values()) * US)
        plan = "sorted" if densest_bucket(with_us(reqs, ts), [key], "_us", bw) > DENSE_ROWS else "buckets"
    if plan == "sorted":
        return offered_load_dense(reqs, windows, key, ts, id_col)
    d = with_us(reqs, ts)
    d = sliding_counts(d, [key], "_us", {k: v * US for k, v in windows.items()})
    for k in windows:
        d = d.withColumn(k, (F.col(k) - 1).cast("bigint"))
    return d.drop("_us")


def offered_load_dense(reqs: DataFrame, windows: dict[str, int], key: str = "ip", ts: str = "ts",
                       id_col: str = "req_id") -> DataFrame:
    """WIN-1 for keys that are dense within a window: same counts as
    ``offered_load`` through a range-partitioned global sort, so a client with
    any number of requests per window is split over many tasks."""
    d = sliding_counts_sorted(with_us(reqs, ts), key, "_us", id_col, {k: v * US for k, v in windows.items()})
    for k in windows:
        d = d.withColumn(k, (F.col(k) - 1).cast("bigint"))
    return d.drop("_us")


def hourly_quota(reqs: DataFrame, limit: int = 15, window_s: int = 3600, key: str = "session_id",
                 ts: str = "ts") -> DataFrame:
    """WIN-6: admitted when at most ``limit`` earlier requests fall in the
    trailing window (the test is '> limit', so limit+1 per window pass)."""
    d = offered_load(reqs, {"n_window": window_s}, key, ts)
    return d.withColumn("admitted", F.col("n_window") <= limit)


def cooldown(reqs: DataFrame, secs: int = 3, key: str = "session_id", ts: str = "ts",
             tiebreak: str = "req_id", plan: str = "auto") -> DataFrame:
    """WIN-7: a request arriving less than ``secs`` after the previous request of
    the same session is a cooldown hit (``plan`` as in ``offered_load``)."""
    if plan == "auto":
        dense = densest_bucket(with_us(reqs, ts), [key], "_us", bucket_width(secs * US)) > DENSE_ROWS
        plan = "sorted" if dense else "buckets"
    if plan == "sorted":
        d = sessionize_sorted(with_us(reqs, ts), key, "_us", tiebreak, secs * US)
        d = d.withColumn("gap_us", F.when(F.col("gap_us") <= secs * US, F.col("gap_us")))
        return (d.withColumn("cooldown_hit", F.coalesce(F.col("gap_us") < secs * US, F.lit(False)))
                 .drop("_us", "is_start", "session_start_us", "seq_in_session"))
    d = prev_gap(with_us(reqs, ts), [key], "_us", tiebreak, secs * US, "gap_us")
    return d.withColumn("cooldown_hit", F.coalesce(F.col("gap_us") < secs * US, F.lit(False))).drop("_us")


def sessionize(reqs: DataFrame, gap_s: int = 3600, key: str = "session_id", ts: str = "ts",
               tiebreak: str = "req_id", plan: str = "auto") -> DataFrame:
    """WIN-5: a new session starts after more than ``gap_s`` seconds of silence
    (a gap of exactly ``gap_s`` stays in the session). Adds ``is_start`` and
    ``session_start_us`` (epoch microseconds of the session's first request).

    ``plan='buckets'`` uses (key, time bucket) windows; ``plan='sorted'`` a
    range-partitioned global sort, for keys dense even within one bucket;
    ``'auto'`` picks sorted only when some (key, bucket) exceeds ``DENSE_ROWS``."""
    gap = gap_s * US
    if plan == "auto":
        dense = densest_bucket(with_us(reqs, ts), [key], "_us", bucket_width(gap)) > DENSE_ROWS
        plan = "sorted" if dense else "buckets"
    if plan == "sorted":
        return sessionize_sorted(with_us(reqs, ts), key, "_us", tiebreak, gap).drop("_us", "gap_us", "seq_in_session")
    d = prev_gap(with_us(reqs, ts), [key], "_us", tiebreak, gap, "_gap", keep_bucket="_gb")
    d = d.withColumn("is_start", F.col("_gap").isNull()).withColumn(
        "_start", F.when(F.col("is_start"), F.col("_us")))
    d = carry_last(d, [key], "_us", tiebreak, ["_start"], bucket_width(gap), suffix="_now", bucket_col="_gb")
    return d.withColumnRenamed("_start_now", "session_start_us").drop("_start", "_gap", "_us")


def session_totals(reqs: DataFrame, cap: int = 50, idle_s: int = 3600, key: str = "session_id",
                   ts: str = "ts", tiebreak: str = "req_id") -> DataFrame:
    """AGG-3: position of each request in its (idle-split) session and whether
    it is within the per-session cap."""
    gap = idle_s * US
    dense = densest_bucket(with_us(reqs, ts), [key], "_us", bucket_width(gap)) > DENSE_ROWS
    if dense:
        s = sessionize_sorted(with_us(reqs, ts), key, "_us", tiebreak, gap).drop("_us", "gap_us")
    else:
        s = with_us(sessionize(reqs, idle_s, key, ts, tiebreak, plan="buckets"), ts)
        s = prefix_count(s, [key, "session_start_us"], "_us", tiebreak, bucket_width(gap), "seq_in_session")
        s = s.withColumn("seq_in_session", F.when(F.col("_us").isNull(), F.lit(1)).otherwise(F.col("seq_in_session")).cast("bigint")).drop("_us")
    return s.withColumn("within_cap", F.col("seq_in_session") <= cap)


def mark_cached(reqs: DataFrame, ttl_s: int = 600, keys=("brand", "session_id", "message"),
                ts: str = "ts", tiebreak: str = "req_id", stream_col: str = "is_stream") -> DataFrame:
    """JOIN-3 (simple mode): a non-stream request is served from cache when the
    previous non-stream request with the same key is younger than ``ttl_s``.
    A null stream flag means no stream, a missing brand the default brand. The exact mode (a hit does not refresh the entry) is ``sequential.replay_cache``."""
    ns = with_us(reqs.filter(~F.coalesce(F.col(stream_col).cast("boolean"), F.lit(False))), ts)
    if "brand" in keys:
        ns = ns.withColumn("_brand", brand_or_default(F.col("brand")))
        keys = ["_brand" if k == "brand" else k for k in keys]
    ttl = ttl_s * US
    if densest_bucket(ns, list(keys), "_us", bucket_width(ttl)) > DENSE_ROWS:
        k = ns.withColumn("_ck", F.to_json(F.array(*[F.col(c).cast("string") for c in keys])))
        d = sessionize_sorted(k, "_ck", "_us", tiebreak, ttl).withColumnRenamed("gap_us", "_gap") \
            .drop("_ck", "is_start", "session_start_us", "seq_in_session")
    else:
        d = prev_gap(ns, list(keys), "_us", tiebreak, ttl, "_gap")
    return d.withColumn("cached", F.coalesce(F.col("_gap") < ttl, F.lit(False))).drop("_gap", "_us", "_brand")


def leads_per_ip(leads: DataFrame, as_of: str, hours: int, ip: str = "ip_address", ts: str = "ts") -> DataFrame:
    """AGG-1: leads per IP with ``ts > as_of - hours`` (strict), ``as_of`` a parameter.
    Plain partial/final hash aggregation; the filter is pushed to the scan."""
    lo = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return (leads.filter((F.col(ts).cast("timestamp_ntz") > lo))
                 .groupBy(ip).agg(F.count(F.lit(1)).alias("n_leads")))


def last_seen(reqs: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """Activity map: last use per key (partial aggregation, skew-proof)."""
    return reqs.groupBy(key).agg(F.max(ts).alias("last_seen"))


def retain_recent(activity: DataFrame, as_of: str, ttl_s: int, n: int, key: str = "session_id",
                  ts: str = "last_seen") -> DataFrame:
    """TOP-4: drop entries idle longer than ``ttl_s``, keep the ``n`` most recent.
    orderBy + limit plans as TakeOrderedAndProject (per-partition top n, no full sort)."""
    age = F.timestamp_diff("MICROSECOND", F.col(ts).cast("timestamp_ntz"), F.lit(as_of).cast("timestamp_ntz"))
    return (activity.filter(age <= ttl_s * US)
                    .orderBy(F.col(ts).desc(), F.col(key)).limit(n))


def list_sessions(sessions: DataFrame, key: str = "session_id", ts: str = "updated_at",
                  title: str | None = "title", limit: int | None = None) -> DataFrame:
    """TOP-1: sessions newest first (column-pruned: no history column), title
    defaulting to 'Chat ' + the first 8 characters of the id."""
    t = F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit("Chat "), F.substring(key, 1, 8))) \
        if title else F.concat(F.lit("Chat "), F.substring(key, 1, 8))
    out = sessions.select(key, t.alias("title"), ts).orderBy(F.col(ts).desc(), F.col(key))
    return out.limit(limit) if limit else out


def sessions_for(reqs: DataFrame, keys: DataFrame, on=("brand", "session_id")) -> DataFrame:
    """JOIN-5: requests of many sessions at once: a left-semi join on the key pair
    (AQE broadcasts the key set when it is small)."""
    return reqs.join(keys.select(*on).distinct(), list(on), "left_semi")


def expire_idle(reqs: DataFrame, gap_s: int = 3600, key: str = "session_id", ts: str = "ts",
                tiebreak: str = "req_id") -> DataFrame:
    """STR-4 batch twin: closed sessions (start, end = last activity + gap, size).
    Aggregation after ``sessionize`` is partial, so a hot session is cheap."""
    s = sessionize(reqs, gap_s, key, ts, tiebreak).withColumn("_us", epoch_us(F.col(ts)))
    return (s.groupBy(key, "session_start_us")
             .agg(F.count(F.lit(1)).alias("n_requests"), F.max("_us").alias("_last"))
             .select(key, "session_start_us", (F.col("_last") + gap_s * US).alias("session_end_us"), "n_requests"))


def abandoned_captures(events: DataFrame, idle_s: int = 300, flag: str = "capture_start", key: str = "session_id",
                       ts: str = "ts", tiebreak: str = "req_id") -> DataFrame:
    """STR-7 batch twin: a capture is abandoned when its session goes idle for
    more than ``idle_s``; reported at the idle expiry."""
    s = sessionize(events, idle_s, key, ts, tiebreak).withColumn("_us", epoch_us(F.col(ts)))
    g = s.groupBy(key, "session_start_us").agg(F.max(F.col(flag).cast("int")).alias("_cap"), F.max("_us").alias("_last"))
    return g.filter("_cap = 1").select(key, "session_start_us", (F.col("_last") + idle_s * US).alias("abandoned_at_us"))
