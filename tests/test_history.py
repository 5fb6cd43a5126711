import random

from pyspark.sql import functions as F

from convlake.operators import history as H
from convlake.operators.sequence import top_k
from tests import pyref

SCHEMA = "msg_id long, session_id string, turn long, role string, content string"


def _session(sid, n, base=0, roles=("user", "assistant"), blank_every=0):
    out = []
    for i in range(n):
        c = "" if blank_every and i % blank_every == 0 else f"message {sid} number {i} " + "x" * (i % 50)
        out.append((base + i, sid, i, roles[i % len(roles)], c))
    return out


def test_trim_10_11_12(spark):
    data = _session("a", 10) + _session("b", 11, 100) + _session("c", 12, 200)
    kept = H.trim_history(spark.createDataFrame(data, SCHEMA)).groupBy("session_id").agg(
        F.collect_set("turn").alias("t")).collect()
    got = {r.session_id: sorted(r.t) for r in kept}
    assert got["a"] == list(range(10)) and got["b"] == list(range(11))
    assert got["c"] == [0] + list(range(2, 12))


def test_digest_and_context_match_python(spark):
    rnd = random.Random(3)
    data = []
    for s in range(12):
        data += _session(f"s{s}", rnd.randrange(1, 40), base=s * 1000, blank_every=rnd.choice([0, 3]))
    # one hot session with many messages: the salted top-k must stay exact
    data += _session("hot", 3000, base=10 ** 6, blank_every=7)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.session_id: r.digest for r in H.digest(df).collect()}
    by = {}
    for m in sorted(data, key=lambda r: r[2]):
        by.setdefault(m[1], []).append((m[3], m[4]))
    assert got == {s: pyref.digest(v) for s, v in by.items()}
    ctx = {r.session_id: r for r in H.model_context(df).collect()}
    for s, v in by.items():
        d = pyref.digest(v)
        assert ctx[s].system_content == ("Memory of previous talk: " + d if d else "You are a helpful assistant.")
        assert ctx[s].n_context == min(10, len(v))


def test_digest_null_role_and_short(spark):
    data = [(i, "s", i, None if i == 0 else "user", "hello" if i else "first") for i in range(11)]
    got = H.digest(spark.createDataFrame(data, SCHEMA)).collect()[0].digest
    assert got == "[History: unknown: first...]"
    assert H.digest(spark.createDataFrame(data[:10], SCHEMA)).collect()[0].digest == ""


def test_two_system_messages_consolidated(spark):
    data = [(0, "c", 0, "system", "A"), (1, "c", 1, "user", "hi"), (2, "c", 2, "system", "B"),
            (3, "d", 0, "system", "only"), (4, "d", 1, "user", "x")]
    df = spark.createDataFrame(data, SCHEMA).select(F.col("session_id").alias("conv_id"), "turn", "role",
                                                    F.col("content").alias("text"))
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in H.consolidate_system(df).collect())
    assert got == [("c", -1, "system", "A\nB"), ("c", 1, "user", "hi"), ("d", 0, "system", "only"), ("d", 1, "user", "x")]


def test_top_k_exact_with_hot_group(spark):
    rnd = random.Random(1)
    data = [(i, "hot" if i % 3 else f"g{i % 7}", rnd.randrange(100000)) for i in range(20000)]
    df = spark.createDataFrame(data, "id long, g string, v long")
    got = {(r.g, r.id, r._rk) for r in top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 5, salt=16).collect()}
    exp = set()
    by = {}
    for i, g, v in data:
        by.setdefault(g, []).append((-v, i))
    for g, lst in by.items():
        for rk, (_, i) in enumerate(sorted(lst)[:5], 1):
            exp.add((g, i, rk))
    assert got == exp
