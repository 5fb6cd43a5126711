"""Sequential state machines: exact admission control and exact cache replay.

A verdict here depends on earlier verdicts (only *accepted* requests enter the
counters; a cache hit does not refresh the entry), which no window function
expresses. Plan: hash-partition by the state key, sort within partitions by
(key, time, id) and replay with ``mapInPandas`` over the ordered batch stream.
A group is never materialised: the replay keeps only the live state of the
current key (at most the last hour of activity), so memory does not grow with
the group. The replay of one key is serial; see README "Open items".

Batch twins of the streaming processors in ``convlake.streaming``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions.classify import brand_or_default
from convlake.functions.dictionaries import RequestPolicy
from convlake.operators.sequence import epoch_us

US = 1_000_000
VERDICTS = ("ip_1min", "ip_10min", "session_cooldown", "session_total", "cached", "accepted")


class Admission:
    """Admission state of one client (ip) and its sessions; first failing rule wins.

    Rules: ip short window, ip long window, session cooldown, session total
    (reset after more than ``session_idle`` s without an accepted request),
    cached (non-stream repeat of (brand, session, message) younger than the
    cache TTL since the last miss), else accepted. Rejections and cache hits
    do not enter the counters.
    """

    def __init__(self, p: RequestPolicy):
        self.p = p
        self.ip_acc: deque[int] = deque()
        self.sess_recent: dict[str, int] = {}
        self.sess_total: dict[str, int] = {}
        self.sess_last: dict[str, int] = {}
        self.cache: dict[tuple, int] = {}
        self.most = 4096  # entries held before the next sweep

    def restore(self, session: str, recent: int, total: int, last: int) -> None:
        """A session's entry as ``session`` gave it."""
        self.sess_recent[session], self.sess_total[session], self.sess_last[session] = recent, total, last

    def session(self, session: str) -> tuple[int, int, int] | None:
        """(last accepted, accepted so far, idle since) of a session, if any."""
        if session not in self.sess_recent:
            return None
        recent = self.sess_recent[session]
        return recent, self.sess_total.get(session, 0), self.sess_last.get(session, recent)

    def _forget(self, now: int) -> None:
        """Drop sessions and cache entries that no later request can meet; called
        each time their number has doubled, so a step costs the same on average."""
        p = self.p
        for s in [s for s, t in self.sess_recent.items()
                  if now - t > p.session_idle * US and now - t >= p.session_cooldown * US]:
            for d in (self.sess_recent, self.sess_total, self.sess_last):
                d.pop(s, None)
        self.cache = {k: t for k, t in self.cache.items() if now - t < p.cache_ttl * US}
        self.most = max(4096, 2 * max(len(self.sess_recent), len(self.cache)))

    def step(self, now: int, session: str, brand: str, message: str, is_stream: bool) -> str:
        p = self.p
        while self.ip_acc and now - self.ip_acc[0] >= p.ip_long_window * US:
            self.ip_acc.popleft()
        last = self.sess_last.get(session)
        if last is not None and now - last > p.session_idle * US:
            self.sess_total.pop(session, None)
            self.sess_last.pop(session, None)
        if sum(1 for t in self.ip_acc if now - t < p.ip_short_window * US) >= p.ip_short_limit:
            return "ip_1min"
        if len(self.ip_acc) >= p.ip_long_limit:
            return "ip_10min"
        recent = self.sess_recent.get(session)
        if recent is not None and now - recent < p.session_cooldown * US:
            return "session_cooldown"
        if self.sess_total.get(session, 0) >= p.session_total:
            return "session_total"
        key = (brand, session, message)
        if not is_stream:
            hit = self.cache.get(key)
            if hit is not None and now - hit < p.cache_ttl * US:
                return "cached"
        self.ip_acc.append(now)
        self.sess_recent[session] = now
        self.sess_total[session] = self.sess_total.get(session, 0) + 1
        self.sess_last[session] = now
        if not is_stream:
            self.cache[key] = now
        if max(len(self.cache), len(self.sess_recent)) > self.most:
            self._forget(now)
        return "accepted"


def _admit_batches(policy: RequestPolicy):
    def run(batches):
        cur, state = None, None
        for pdf in batches:
            out = []
            for ip, seg, us, sess, brand, msg, stream in zip(
                    pdf["ip"], pdf["_seg"], pdf["_us"], pdf["session_id"], pdf["brand"], pdf["message"],
                    pdf["is_stream"]):
                if (ip, seg) != cur:
                    cur, state = (ip, seg), Admission(policy)
                out.append(state.step(int(us), sess, brand, msg, bool(stream)))
            yield pd.DataFrame({"req_id": pdf["req_id"], "ip": pdf["ip"], "session_id": pdf["session_id"],
                                "verdict": out})
    return run


def state_horizon(p: RequestPolicy) -> int:
    """Seconds after which every part of a client's admission state has expired."""
    return max(p.ip_short_window, p.ip_long_window, p.session_cooldown, p.cache_ttl, p.session_idle)


def admit(requests: DataFrame, policy: RequestPolicy = RequestPolicy(), partitions: int | None = None) -> DataFrame:
    """STR-2 batch twin: verdict per request.

    Each client's stream is cut where it was quiet for longer than the state
    horizon: after such a gap every counter, cooldown, cache entry and session
    total has expired, so the segments are independent and replay in parallel
    (the cut itself is the bucketed, skew-safe ``sessionize``). Inside a
    segment the replay is one ordered stream with bounded state. Keyed by ip; a
    session seen under several ips keeps one state per ip (see
    ``cross_ip_sessions``).
    """
    from convlake.operators.limits import sessionize
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = requests.select("req_id", "ts", "ip", "session_id", brand_or_default(F.col("brand")).alias("brand"), "message",
                           F.col("is_stream").cast("boolean").alias("is_stream"))
    seg = sessionize(base, state_horizon(policy), key="ip").withColumnRenamed("session_start_us", "_seg")
    d = (seg.withColumn("_us", epoch_us(F.col("ts")))
            .repartition(n, "ip", "_seg").sortWithinPartitions("ip", "_seg", "_us", "req_id"))
    return d.mapInPandas(_admit_batches(policy), "req_id long, ip string, session_id string, verdict string")


def quota_policy(limit: int = 15, window_s: int = 3600) -> RequestPolicy:
    """Admission policy reduced to one accepted-only sliding window: more than
    ``limit`` accepted in the window rejects (so limit+1 are admitted)."""
    big = 1 << 40
    return RequestPolicy(ip_short_window=1, ip_short_limit=big, ip_long_window=window_s, ip_long_limit=limit + 1,
                         session_cooldown=0, session_total=big, session_idle=window_s, cache_ttl=0)


def hourly_quota_exact(requests: DataFrame, limit: int = 15, window_s: int = 3600, key: str = "session_id",
                       partitions: int | None = None) -> DataFrame:
    """WIN-6 exact: per user, a request is admitted unless more than ``limit``
    *admitted* requests fall in the trailing window; rejections are not
    recorded. The admission replay with every other rule switched off."""
    r = requests.select("req_id", "ts", F.col(key).alias("ip"), F.col(key).alias("session_id"),
                        F.lit("-").alias("brand"), F.lit("-").alias("message"), F.lit(1).alias("is_stream"))
    v = admit(r, quota_policy(limit, window_s), partitions)
    return v.select("req_id", F.col("ip").alias(key), (F.col("verdict") == "accepted").alias("admitted"))


def cross_ip_sessions(requests: DataFrame) -> DataFrame:
    """Sessions that appear under more than one ip (partial aggregation)."""
    return (requests.groupBy("session_id").agg(F.countDistinct("ip").alias("n_ips"))
                    .filter("n_ips > 1"))


def _cache_batches(ttl_us: int):
    def run(batches):
        cur, last_miss = None, None
        for pdf in batches:
            hits = []
            for k, us in zip(pdf["_k"], pdf["_us"]):
                us = int(us)
                if k != cur:
                    cur, last_miss = k, None
                if last_miss is not None and us - last_miss < ttl_us:
                    hits.append(True)
                else:
                    hits.append(False)
                    last_miss = us
            yield pd.DataFrame({"req_id": pdf["req_id"], "cached": hits})
    return run


def cache_key(keys) -> Column:
    """The key columns as one string; a missing brand is the default brand."""
    return F.to_json(F.array(*[brand_or_default(F.col(k)) if k == "brand" else F.col(k).cast("string") for k in keys]))


def replay_cache(requests: DataFrame, ttl_s: int = 600, keys=("brand", "session_id", "message"),
                 stream_col: str = "is_stream", partitions: int | None = None,
                 serial_max: int = 1_000_000) -> DataFrame:
    """JOIN-3 exact / STR-3 batch twin: a non-stream request is a hit when the
    last *miss* with the same key is younger than the TTL; hits never refresh.

    Keys with at most ``serial_max`` requests are replayed serially (one
    ordered stream per key, bounded state); larger keys go through
    ``replay_cache_doubling``, which is exact and splits a hot key over the
    whole cluster.
    """
    n = partitions or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = (requests.filter(~F.coalesce(F.col(stream_col).cast("boolean"), F.lit(False)))   # null: no stream
                 .select("req_id", cache_key(keys).alias("_k"),
                         epoch_us(F.col("ts")).alias("_us")))
    sizes = d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > serial_max).select("_k")
    if serial_max > 0 and hot.limit(1).count() == 0:
        cold, hot_rows = d, None
    else:
        cold = d.join(hot, "_k", "left_anti")
        hot_rows = d.join(hot, "_k", "left_semi")
    out = (cold.repartition(n, "_k").sortWithinPartitions("_k", "_us", "req_id")
               .mapInPandas(_cache_batches(ttl_s * US), "req_id long, cached boolean"))
    if hot_rows is not None:
        out = out.unionByName(replay_cache_doubling(hot_rows, ttl_s * US))
    return out


def replay_cache_doubling(d: DataFrame, ttl_us: int) -> DataFrame:
    """Exact cache replay by pointer doubling (rows: req_id, _k, _us).

    Within a key ordered by (time, id), the miss after a miss at row r is the
    first row at least ``ttl`` later: its position is ``p0 + A`` where p0 is
    the first position sharing r's time and A counts the rows in
    [t_r, t_r + ttl). Misses are the chain of these pointers from position 1.
    Jump tables J_k (2^k steps) are built by self-joins on (key, position) and
    the chain is expanded from the head by descending powers: O(log n) joins,
    none of which puts a key in one task. Each round is checkpointed into the
    shared checkpoint folder to cut the lineage.
    """
    from convlake.operators.sequence import sessionize_sorted, sliding_counts_sorted
    from convlake.session import cut_lineage

    # These keys are the hot ones, so positions and forward counts come from
    # range-partitioned sorts (bounded tasks whatever the density).
    d = sessionize_sorted(d, "_k", "_us", "req_id", 1 << 62).withColumnRenamed("seq_in_session", "pos") \
        .drop("gap_us", "is_start", "session_start_us")
    d = d.withColumn("_neg", -F.col("_us"))
    d = sliding_counts_sorted(d, "_k", "_neg", "req_id", {"_a": ttl_us})   # rows with t in [t_r, t_r + ttl)
    p0 = d.groupBy("_k", "_us").agg(F.min("pos").alias("_p0"))
    n_by_k = d.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    d = cut_lineage(d.join(p0, ["_k", "_us"]).join(n_by_k, "_k")
                     .select("req_id", "_k", "pos", "_n", (F.col("_p0") + F.col("_a")).alias("nxt")))
    max_n = d.agg(F.max("_n")).collect()[0][0] or 0
    levels = [d.select("_k", "pos", "_n", "nxt")]
    while (1 << len(levels)) <= max_n:
        j = levels[-1]
        b = j.select(F.col("_k").alias("_bk"), F.col("pos").alias("_bp"), F.col("nxt").alias("_bn"))
        nxt = (j.join(b, (F.col("_k") == F.col("_bk")) & (F.col("nxt") == F.col("_bp")), "left")
                .select("_k", "pos", "_n", F.coalesce("_bn", F.col("_n") + 1).alias("nxt")))
        levels.append(cut_lineage(nxt))
    chain = d.filter(F.col("pos") == 1).select("_k", "pos")
    for j in reversed(levels):
        step = (chain.join(j, ["_k", "pos"]).filter(F.col("nxt") <= F.col("_n"))
                     .select("_k", F.col("nxt").alias("pos")))
        chain = cut_lineage(chain.unionByName(step).distinct())
    miss = chain.withColumn("_miss", F.lit(True))
    return (d.join(miss, ["_k", "pos"], "left")
             .select("req_id", F.col("_miss").isNull().alias("cached")))
