import hashlib

from pyspark.sql import functions as F

from convlake.functions import classify as C
from convlake.functions import toolcalls as TC
from convlake.operators import routing as R
from convlake.sources import logs as LG
from convlake.sources import sse as SSE
from tests import pyref


def _col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r.r for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_error_taxonomy_edges(spark):
    assert _col(spark, [e for e, _ in pyref.ERROR_CLASSES], C.classify_error) == [c for _, c in pyref.ERROR_CLASSES]


def test_retry_hint(spark):
    errs = ['x "retryDelay": "17s" y', "retryDelay: 5s", "nothing", None]
    assert _col(spark, errs, C.retry_hint) == [17, 5, None, None]


def test_tool_call_recovery(spark):
    texts = ['generate_image({"prompt": "cat"})', 'generate_image ```json {"prompt": "dog"}``` ',
             'generate_image({"prompt": "x", "style": {"a": 1}})', "generate_image({not json})",
             'generate_image({"prompt": "a"}) generate_image({"prompt": "b"})', None]
    got = _col(spark, texts, lambda c: TC.recovered_call(c)["prompt"])
    assert got == ["cat", None, None, None, "a", None]
    assert _col(spark, ['{"a": "1"}', "{bad"], TC.tool_args) == [{"a": "1"}, {}]


def test_brand_and_keys(spark):
    rules = [("b", ["green", "landscap"]), ("a", ["ai"])]
    got = _col(spark, ["Green Co", "my AI", "other", "", None], lambda c: C.resolve_brand(c, rules, "a"))
    assert got == ["b", "a", "a", "a", "a"]
    df = spark.createDataFrame([("b", "b_x"), ("b", "x")], "brand string, sid string")
    assert [r.k for r in df.select(C.session_key(F.col("brand"), F.col("sid")).alias("k")).collect()] == ["b_x", "b_x"]
    ck = spark.createDataFrame([("a cat", "16:9")], "p string, r string").select(
        C.content_key(F.col("p"), F.col("r")).alias("k")).collect()[0].k
    assert ck == hashlib.sha256("a cat|16:9".encode()).hexdigest()[:16]


def test_routing_edges(spark):
    df = spark.createDataFrame([(0, "calculate 2+2 quote", "a"), (1, "What is 5 times", "a"), (2, "need design help", "a"),
                                (3, "hello", "b"), (4, "hello", "a")], "msg_id long, text string, brand string")
    packs = spark.createDataFrame([("a", "KA"), ("b", "KB")], "brand string, pack string")
    got = {r.msg_id: r.knowledge for r in R.route_knowledge(df, packs, always_brands=("b",)).collect()}
    assert got == {0: None, 1: None, 2: "KA", 3: "KB", 4: None}
    tools = {r.msg_id: r.tools for r in R.route_tools(df).collect()}
    assert tools[2] == ["generate_image"] and tools[4] == []


def test_sse_edge_cases(spark):
    lines = [("k", 0, 'data: {"type": "token", "content": "Hel"}'), ("k", 1, ": heartbeat"),
             ("k", 2, "data: {broken"), ("k", 3, 'data: {"type": "token", "content": "lo"}'),
             ("k", 4, 'data: {"type": "error", "content": "boom"}'), ("k", 5, 'data: {"type": "done", "response": "Hello"}')]
    df = spark.createDataFrame(lines, "key string, line_no long, value string")
    ev = SSE.parse_sse(df)
    assert ev.count() == 4  # heartbeat and broken JSON are ignored
    a = SSE.assemble(ev, ["key"]).collect()[0]
    assert (a.assembled, a.response, a.error) == ("Hello", "Hello", "boom")


def test_merge_sessions_titles_and_ties(spark):
    base = spark.createDataFrame([("s", "Old", "[1]", "2024-01-01 00:00:00")], "session_id string, title string, history string, updated_at string") \
                .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    upd = spark.createDataFrame([("s", None, "[1,2]", "2024-01-02 00:00:00", 0), ("s", "", "[1,2,3]", "2024-01-03 00:00:00", 1),
                                 ("s", "New", "[9]", "2024-01-03 00:00:00", 2)],
                                "session_id string, title string, history string, updated_at string, seq long") \
               .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    r = LG.merge_sessions(base, upd).collect()[0]
    assert (r.title, r.history) == ("New", "[9]")  # same updated_at: the later update wins
    r2 = LG.merge_sessions(base, upd.filter("seq < 2")).collect()[0]
    assert (r2.title, r2.history) == ("Old", "[1,2,3]")  # null and '' leave the title unchanged


def test_brand_web_variant(spark):
    got = _col(spark, ["Green Co", "my AI", "other", ""], lambda c: C.resolve_brand_web(c, ["green", "landscap"], "b", "a"))
    assert got == ["b", "a", "a", "a"]
