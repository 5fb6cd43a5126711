"""Exact sequential jobs vs plain-Python replays written from the rules."""

import random
from datetime import datetime, timedelta

from convlake.functions.dictionaries import RequestPolicy
from convlake.operators import sequential as SQ

SCHEMA = "req_id long, ts timestamp_ntz, ip string, session_id string, brand string, message string, is_stream long"
T0 = datetime(2024, 1, 1)


def reference_admit(reqs, p: RequestPolicy):
    """Straight list-based replay of the rules, all clients in one loop."""
    ip_times, sess_times, total, last_seen, cache = {}, {}, {}, {}, {}
    out = {}
    for r in sorted(reqs, key=lambda r: (r[1], r[0])):
        rid, ts, ip, sess, brand, msg, stream = r
        now = (ts - datetime(1970, 1, 1)).total_seconds()
        if sess in last_seen and now - last_seen[sess] > p.session_idle:
            total.pop(sess, None); last_seen.pop(sess, None)
        ip_times[ip] = [t for t in ip_times.get(ip, []) if now - t < p.ip_long_window]
        sess_times[sess] = [t for t in sess_times.get(sess, []) if now - t < p.session_cooldown]
        if len([t for t in ip_times[ip] if now - t < p.ip_short_window]) >= p.ip_short_limit:
            out[rid] = "ip_1min"; continue
        if len(ip_times[ip]) >= p.ip_long_limit:
            out[rid] = "ip_10min"; continue
        if len(sess_times[sess]) >= 1:
            out[rid] = "session_cooldown"; continue
        if total.get(sess, 0) >= p.session_total:
            out[rid] = "session_total"; continue
        key = (brand, sess, msg)
        if not stream and key in cache and now - cache[key] < p.cache_ttl:
            out[rid] = "cached"; continue
        ip_times[ip].append(now); sess_times[sess].append(now)
        total[sess] = total.get(sess, 0) + 1; last_seen[sess] = now
        if not stream:
            cache[key] = now
        out[rid] = "accepted"
    return out


def make_requests(n, seed, ips=3, sessions_per_ip=2, max_gap=8.0):
    rnd = random.Random(seed)
    t = T0
    out = []
    for i in range(n):
        t = t + timedelta(seconds=rnd.choice([0, 0.5, 1, 2, 3, rnd.uniform(0, max_gap)]))
        ip = f"ip{rnd.randrange(ips)}"
        sess = f"{ip}-s{rnd.randrange(sessions_per_ip)}"
        out.append((i, t, ip, sess, rnd.choice(["a", "b"]), rnd.choice(["hi", "price?", "ok"]), rnd.randrange(2)))
    return out


def test_admit_matches_reference(spark):
    p = RequestPolicy(ip_short_window=60, ip_short_limit=12, ip_long_window=600, ip_long_limit=40,
                      session_cooldown=3, session_total=50, session_idle=3600, cache_ttl=600)
    reqs = make_requests(3000, 7)
    got = {r.req_id: r.verdict for r in SQ.admit(spark.createDataFrame(reqs, SCHEMA), p).collect()}
    exp = reference_admit(reqs, p)
    assert got == exp
    assert len(set(exp.values())) >= 4  # several rules actually fire


def test_admit_small_limits_and_idle_reset(spark):
    p = RequestPolicy(ip_short_window=10, ip_short_limit=3, ip_long_window=30, ip_long_limit=5,
                      session_cooldown=2, session_total=4, session_idle=20, cache_ttl=15)
    reqs = make_requests(2000, 11, ips=2, sessions_per_ip=3, max_gap=40)
    got = {r.req_id: r.verdict for r in SQ.admit(spark.createDataFrame(reqs, SCHEMA), p).collect()}
    assert got == reference_admit(reqs, p)


def test_cooldown_boundary_exactly_3s(spark):
    p = RequestPolicy()
    reqs = [(0, T0, "i", "s", "a", "m1", 1), (1, T0 + timedelta(seconds=2.999), "i", "s", "a", "m2", 1),
            (2, T0 + timedelta(seconds=3), "i", "s", "a", "m3", 1)]
    got = {r.req_id: r.verdict for r in SQ.admit(spark.createDataFrame(reqs, SCHEMA), p).collect()}
    assert got == {0: "accepted", 1: "session_cooldown", 2: "accepted"}


def reference_cache(reqs, ttl):
    last, out = {}, {}
    for r in sorted((r for r in reqs if r[6] == 0), key=lambda r: (r[1], r[0])):
        key = (r[4], r[3], r[5])
        now = (r[1] - T0).total_seconds()
        if key in last and now - last[key] < ttl:
            out[r[0]] = True
        else:
            out[r[0]] = False
            last[key] = now
    return out


def test_replay_cache_hits_do_not_refresh(spark):
    reqs = [(0, T0, "i", "s", "a", "m", 0), (1, T0 + timedelta(seconds=599), "i", "s", "a", "m", 0),
            (2, T0 + timedelta(seconds=600), "i", "s", "a", "m", 0),
            (3, T0 + timedelta(seconds=1199), "i", "s", "a", "m", 0),
            (4, T0 + timedelta(seconds=1200), "i", "s", "a", "m", 0)]
    got = {r.req_id: r.cached for r in SQ.replay_cache(spark.createDataFrame(reqs, SCHEMA), 600).collect()}
    # 599 s after the miss is a hit; 600 s is a miss; the hit at 599 did not extend the entry.
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_replay_cache_random(spark):
    reqs = make_requests(2000, 5, max_gap=30)
    got = {r.req_id: r.cached for r in SQ.replay_cache(spark.createDataFrame(reqs, SCHEMA), 20).collect()}
    assert got == reference_cache(reqs, 20)


def test_replay_cache_doubling_equals_serial(spark):
    reqs = make_requests(1500, 9, ips=1, sessions_per_ip=1, max_gap=12)
    df = spark.createDataFrame(reqs, SCHEMA)
    serial = {r.req_id: r.cached for r in SQ.replay_cache(df, 20).collect()}
    doubled = {r.req_id: r.cached for r in SQ.replay_cache(df, 20, serial_max=0).collect()}
    assert serial == doubled == reference_cache(reqs, 20)
    ties = [(i, T0 + timedelta(seconds=(i // 3) * 7), "i", "s", "a", "m", 0) for i in range(60)]
    tdf = spark.createDataFrame(ties, SCHEMA)
    assert {r.req_id: r.cached for r in SQ.replay_cache(tdf, 20, serial_max=0).collect()} == reference_cache(ties, 20)


def test_missing_brand_is_the_default_brand(spark):
    from convlake.functions.dictionaries import DEFAULT_BRAND
    from convlake.operators import limits as LM
    reqs = [(i, T0 + timedelta(seconds=30 * i), f"ip{i}", "s", b, "m", None) for i, b in enumerate([None, "", DEFAULT_BRAND, "b", None, "b"])]
    df = spark.createDataFrame(reqs, SCHEMA)
    want = {0: False, 1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r.req_id: r.cached for r in LM.mark_cached(df).collect()} == want
    assert {r.req_id: r.brand for r in LM.mark_cached(df).collect()} == {r[0]: r[4] for r in reqs}
    assert {r.req_id: r.cached for r in SQ.replay_cache(df).collect()} == want
    one = df.selectExpr("req_id", "ts", "'ip' as ip", "session_id", "brand", "message", "is_stream")
    got = {r.req_id: r.verdict for r in SQ.admit(one, RequestPolicy(session_cooldown=0)).collect()}
    assert got == {i: "cached" if c else "accepted" for i, c in want.items()}
