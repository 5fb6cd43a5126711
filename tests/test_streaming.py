"""Streaming twins equal their batch jobs (availableNow file-stream runs)."""

import tempfile

from pyspark.sql import functions as F

from convlake.functions.dictionaries import RequestPolicy
from convlake.operators import leads as L
from convlake.operators import limits as LM
from convlake.operators import sequential as SQ
from convlake.plans.views import view
from convlake.sources import sse as SSE
from convlake.streaming import jobs as J
from convlake.streaming.runner import run_available, run_slices, stream_source
from tests.conftest import SF_SMALL, rows


def _as_stream(spark, df, parts=3):
    d = tempfile.mkdtemp(prefix="convlake-src-")
    df.repartition(parts).write.mode("overwrite").parquet(d)
    return stream_source(spark, d, df.schema, max_files=1)


def test_stream_leads_equals_batch(spark):
    docs = view(spark, SF_SMALL, "documents").select("doc_id", "text")
    batch = L.contact_lead_report(docs, "doc_id", "text")
    got = run_available(J.stream_leads(_as_stream(spark, docs), "doc_id"))
    assert rows(got) == rows(batch)
    assert got.count() > 0


def test_admit_stream_equals_batch(spark):
    p = RequestPolicy(ip_short_window=3600, ip_short_limit=3, ip_long_window=6 * 3600, ip_long_limit=8,
                      session_cooldown=600, session_total=20, session_idle=6 * 3600, cache_ttl=24 * 3600)
    req = view(spark, SF_SMALL, "v_req")
    # One file per micro-batch, files in time order: state carries across batches.
    d = tempfile.mkdtemp(prefix="convlake-req-") + "/data"
    req.withColumn("_d", F.to_date("ts")).write.partitionBy("_d").parquet(d)
    src = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = run_available(J.admit_stream(src, p))
    assert rows(got, "req_id", "verdict") == rows(SQ.admit(req, p), "req_id", "verdict")


def test_suppress_stream_equals_batch(spark):
    req = view(spark, SF_SMALL, "v_req")
    d = tempfile.mkdtemp(prefix="convlake-req-") + "/data"
    req.withColumn("_d", F.to_date("ts")).write.partitionBy("_d").parquet(d)
    src = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", 1).parquet(d)
    got = run_available(J.suppress_stream(src, 24 * 3600))
    assert rows(got) == rows(SQ.replay_cache(req, 24 * 3600))


def test_expire_idle_equals_batch_sessions(spark):
    req = view(spark, SF_SMALL, "v_req").select("req_id", "session_id", "ts")
    # A late sentinel row far in the future moves the watermark past every real session.
    sentinel = spark.createDataFrame([(-1, "zz-sentinel", "2030-01-01 00:00:00")], "req_id long, session_id string, ts string") \
                    .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    src = _as_stream(spark, req.unionByName(sentinel), parts=1)
    got = run_available(J.expire_idle(src, 3600))
    b = LM.sessionize(req, 3600).groupBy("session_id", "session_start_us").agg(F.count(F.lit(1)).alias("n"))
    exp = sorted((r.session_id, r.n) for r in b.collect())
    assert sorted((r.session_id, r.n_requests) for r in got.collect()) == exp


def test_assemble_stream_equals_batch(spark):
    t = view(spark, SF_SMALL, "v_turn").select("conv_id", "turn", "text")
    keys = ["conv_id", "turn"]
    tokens = SSE.render_sse(SSE.tokenize(t, "text", keys), keys)
    done = SSE.render_sse(SSE.tokenize(t.limit(0), "text", keys), keys,
                          full=t.select(*keys, F.coalesce("text", F.lit("")).alias("response")))
    # Token lines arrive (in two files) before the files holding the done events.
    d = tempfile.mkdtemp(prefix="convlake-sse-") + "/data"
    tokens.repartition(2).write.parquet(d)
    done.repartition(1).write.mode("append").parquet(d)
    src = stream_source(spark, d, tokens.schema, max_files=1)
    got = run_available(J.assemble_stream(src))
    exp = {(r.conv_id, r.turn): r.text or "" for r in t.collect()}
    assert {(r.conv_id, r.turn): r.assembled for r in got.collect()} == exp
    assert all(r.ended_by == "done" for r in got.collect())


def test_probe_timeline_stream_equals_batch(spark):
    from convlake.operators import provider as P
    a = view(spark, SF_SMALL, "v_attempt").withColumn("ok", F.col("error").isNull()) \
        .select("attempt_id", "ts", "ok")
    sentinel = spark.createDataFrame([(-1, "2030-01-01 00:00:00", True)], "attempt_id long, ts string, ok boolean") \
                    .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = run_available(J.probe_timeline_stream(_as_stream(spark, a.unionByName(sentinel), parts=1)))
    assert rows(got) == rows(P.probe_timeline(a))


def test_abandoned_captures_stream_equals_batch(spark):
    r = view(spark, SF_SMALL, "v_req").select("req_id", "session_id", "ts",
                                               (F.col("message") == "q3").alias("capture_start"))
    sentinel = spark.createDataFrame([(-1, "zz", "2030-01-01 00:00:00", False)],
                                     "req_id long, session_id string, ts string, capture_start boolean") \
                    .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = run_available(J.abandoned_captures(_as_stream(spark, r.unionByName(sentinel), parts=1), 6 * 3600,
                                             watermark="1 hour"))
    exp = LM.abandoned_captures(r, 6 * 3600)
    assert sorted((x.session_id, x.abandoned_at.replace(tzinfo=None)) for x in got.collect()) == sorted(
        (x.session_id, __import__("datetime").datetime(1970, 1, 1) + __import__("datetime").timedelta(
            microseconds=x.abandoned_at_us)) for x in exp.collect())


def test_assemble_stream_error_and_late_token(spark):
    schema = "conv_id long, turn long, line_no long, value string"
    first = spark.createDataFrame([
        (1, 0, 0, 'data: {"type": "token", "content": "Hel"}'), (1, 0, 1, ": heartbeat"),
        (1, 0, 2, 'data: {"type": "token", "content": "lo"}'), (1, 0, 3, 'data: {"type": "done", "response": "Hello"}'),
        (2, 0, 0, 'data: {"type": "token", "content": "par"}'), (2, 0, 1, 'data: {broken'),
        (2, 0, 2, 'data: {"type": "error", "content": "boom"}'), (2, 0, 3, 'data: {"type": "done", "response": "x"}'),
        (3, 0, 0, 'data: {"type": "token", "content": "early "}')], schema)
    later = spark.createDataFrame([
        (1, 0, 4, 'data: {"type": "token", "content": "late"}'),
        (3, 0, 1, 'data: {"type": "token", "content": "bird"}'), (3, 0, 2, 'data: {"type": "done", "response": "early bird"}')],
        schema)
    d = tempfile.mkdtemp(prefix="convlake-sse-") + "/data"
    first.coalesce(1).write.parquet(d)
    later.coalesce(1).write.mode("append").parquet(d)
    got = {(r.conv_id, r.assembled, r.ended_by, r.response) for r in
           run_available(J.assemble_stream(stream_source(spark, d, first.schema, max_files=1))).collect()}
    # a token after done is ignored; error before done ends the reply; tokens carry across batches
    assert got == {(1, "Hello", "done", "Hello"), (2, "par", "error", None), (3, "early bird", "done", "early bird")}


def test_stream_leads_dedupe_option(spark):
    rows = [(1, "write to a@b.co", "2024-01-01 00:00:00"), (2, "write to a@b.co", "2024-01-01 00:01:00"),
            (3, "call 305-555-0100", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "msg_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    plain = run_available(J.stream_leads(_as_stream(spark, df, parts=1), "msg_id"))
    dedup = run_available(J.stream_leads(_as_stream(spark, df, parts=1), "msg_id", dedupe_on=["text"], ts="ts"))
    assert plain.count() == 3 and dedup.count() == 2


def _requests(spark, rows_):
    return spark.createDataFrame([(i, t, ip, s, "a", m, 0) for i, (t, ip, s, m) in enumerate(rows_)],
                                 "req_id long, ts string, ip string, session_id string, brand string, message string, is_stream int") \
                .withColumn("ts", F.col("ts").cast("timestamp_ntz"))


POLICY = RequestPolicy(ip_short_window=60, ip_short_limit=50, ip_long_window=600, ip_long_limit=500,
                       session_cooldown=3, session_total=50, session_idle=600, cache_ttl=300)


def test_admission_state_of_sessions_that_do_not_return_goes_away(spark):
    # one client, busy all day, with a new session each minute
    busy = _requests(spark, [(f"2024-01-01 {h:02d}:{m:02d}:00", "ip", f"s{h}-{m}", "q") for h in range(8) for m in range(60)])
    progress = []
    got = run_slices(busy, "ts", lambda s: J.admit_stream(s, POLICY), slices=6, progress=progress)
    assert rows(got, "req_id", "verdict") == rows(SQ.admit(busy, POLICY), "req_id", "verdict")
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]
    assert held[-1] <= held[0] * 1.5 + 10, held  # 480 sessions and cache entries passed by


def test_admission_state_is_empty_after_the_last_horizon(spark):
    some = _requests(spark, [(f"2024-01-01 00:{m:02d}:{s:02d}", f"ip{m % 3}", f"s{m}", f"q{s % 2}") for m in range(30) for s in (0, 1, 20)])
    progress = []
    far = {"req_id": -1, "ts": "2100-01-01 00:00:00", "ip": "far", "session_id": "far", "brand": "a", "message": "", "is_stream": 1}
    got = run_slices(some, "ts", lambda s: J.admit_stream(s, POLICY), slices=2, sentinel=far, progress=progress)
    assert rows(got.filter("req_id >= 0"), "req_id", "verdict") == rows(SQ.admit(some, POLICY), "req_id", "verdict")
    assert {r.verdict for r in got.collect()} > {"accepted", "session_cooldown"}
    # accepted time and session of the sentinel, and its timer
    assert sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) <= 4


def test_a_late_batch_does_not_move_the_expiry_back(spark):
    ttl = 600
    early = _requests(spark, [("2024-01-01 00:20:00", "i", "s", "q")])
    late = _requests(spark, [("2024-01-01 00:12:00", "i", "s2", "q")]).withColumn("session_id", F.lit("s"))
    mark = _requests(spark, [("2024-01-01 00:33:30", "i", "other", "q")])  # watermark 00:23:30: past 00:22, before 00:30
    again = _requests(spark, [("2024-01-01 00:29:00", "i", "s", "q")])
    parts = [d.withColumn("req_id", F.lit(i).cast("long")) for i, d in enumerate((early, late, mark, again))]
    d = tempfile.mkdtemp(prefix="convlake-late-")
    src = spark.readStream.schema(parts[0].schema).parquet(d)
    out, ck = tempfile.mkdtemp(prefix="convlake-late-"), tempfile.mkdtemp(prefix="convlake-late-")
    for part in parts:
        part.write.mode("append").parquet(d)
        q = (J.suppress_stream(src, ttl, watermark="10 minutes").writeStream.option("checkpointLocation", ck)
             .trigger(availableNow=True).start(out + "/o"))
        q.awaitTermination()
    got = {r.req_id: r.cached for r in spark.read.parquet(out + "/o").collect()}
    assert got[0] is False and got[3] is True  # nine minutes after the miss of 00:20: the entry is still there


def test_reply_timeouts_and_empty_state(spark):
    def line(conv, n, ts, **ev):
        return (conv, 0, n, "data: " + __import__("json").dumps(ev), ts)
    day = "2024-01-01 "
    lines = [line(1, 0, day + "00:00:00", type="token", content="Hel"), line(1, 1, day + "00:00:01", type="image", image_url="u1"),
             line(2, 0, day + "00:00:00", type="token", content="open"), line(2, 1, day + "00:00:02", type="response", content="whole"),
             line(3, 0, day + "00:01:00", type="error", content="boom"), (4, 0, 0, ": heartbeat", day + "00:01:00"),
             line(1, 3, day + "00:02:00", type="done"), line(1, 2, day + "00:02:00", type="token", content="lo"),
             line(1, 9, day + "00:02:30", type="token", content="late"), line(5, 0, day + "00:30:00", type="token", content="x")]
    df = spark.createDataFrame(lines, "conv_id long, turn long, line_no long, value string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    progress = []
    far = {"conv_id": -1, "turn": -1, "line_no": 0, "value": ": heartbeat", "ts": "2100-01-01 00:00:00"}
    out = run_slices(df, "ts", lambda s: J.assemble_stream(s, 300), slices=4, progress=progress,
                     sentinel=far | {"value": 'data: {"type": "token"}'})
    got = {r.conv_id: (r.assembled, r.ended_by, r.response, r.error, r.images) for r in out.collect()}
    assert got == {1: ("Hello", "done", None, None, ["u1"]), 2: ("open", "timeout", "whole", None, []),
                   3: ("", "error", None, "boom", []), 5: ("x", "timeout", None, None, [])}
    assert sum(o["numRowsTotal"] for o in progress[-1]["stateOperators"]) <= 2  # the sentinel's event and timer


def test_chunk_table_function(spark):
    from convlake.functions.chunking import chunk_sentences, register_chunk_function

    docs = view(spark, SF_SMALL, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n ")], "doc_id long, text string"))
    register_chunk_function(spark, "cut_reply")
    got = spark.sql("SELECT doc_id, chunk_no, chunk FROM {docs}, LATERAL cut_reply(text)", docs=docs)
    assert rows(got) == rows(chunk_sentences(docs, "doc_id", "text")) and got.filter("doc_id < 0").count() == 0


def test_cache_entries_of_a_group_of_keys_are_one_state_value(spark):
    # 300 keys come at 00:00 and at 00:05, half of them again at 00:12; a TTL of ten minutes
    r = _requests(spark, [(f"2024-01-01 00:{m:02d}:{k % 60:02d}", "i", f"s{k}", "q") for m in (0, 5, 12) for k in range(300)
                          if m < 12 or k % 2])
    far = {"req_id": -1, "ts": "2100-01-01 00:00:00", "ip": "far", "session_id": "far", "brand": "a", "message": "", "is_stream": 0}
    progress = []
    got = run_slices(r, "ts", lambda s: J.suppress_stream(s, 600, groups=4), slices=3, sentinel=far, progress=progress)
    assert rows(got.filter("req_id >= 0"), "req_id", "cached") == rows(SQ.replay_cache(r, ttl_s=600), "req_id", "cached")
    # a value and a timer for each group, not for each key; at the end the sentinel's
    assert max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) <= 8
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_timer_of_a_group_leaves_entries_that_can_still_hit(spark):
    # one group: s1 has expired when the watermark passes 00:14, s2 has not and hits at 00:24
    r = _requests(spark, [("2024-01-01 00:00:00", "i", "s1", "q"), ("2024-01-01 00:15:00", "i", "s2", "q"),
                          ("2024-01-01 00:23:00", "i", "s1", "q"), ("2024-01-01 00:24:00", "i", "s2", "q")])
    got = run_slices(r, "ts", lambda s: J.suppress_stream(s, 600, watermark="1 minute", groups=1), slices=3)
    assert rows(got, "req_id", "cached") == [(0, False), (1, False), (2, False), (3, True)]
    assert rows(got, "req_id", "cached") == rows(SQ.replay_cache(r, ttl_s=600), "req_id", "cached")


def test_replies_of_one_group_end_and_expire_each_by_itself(spark):
    def line(conv, turn, n, at, **ev):
        return (conv, turn, n, "data: " + __import__("json").dumps(ev), f"2024-01-01 {at}")
    lines = [line(1, 0, 0, "00:00:00", type="token", content="a"), line(2, 0, 0, "00:00:30", type="token", content="b"),
             line(2, 0, 1, "00:04:30", type="token", content="c"), line(2, None, 0, "00:00:40", type="token", content="n"),
             line(2**60 + 1, 0, 0, "00:00:50", type="token", content="big"), line(2**60 + 1, 0, 1, "00:06:00", type="done"),
             line(4, 0, 0, "00:07:00", type="ping"), line(2, 0, 2, "00:08:00", type="done"),
             line(2, 0, 3, "00:12:00", type="token", content="late"), line(5, 0, 0, "00:30:00", type="token", content="x")]
    df = spark.createDataFrame(lines, "conv_id long, turn long, line_no long, value string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    far = {"conv_id": -1, "turn": -1, "line_no": 0, "value": 'data: {"type": "token"}', "ts": "2100-01-01 00:00:00"}
    progress = []
    out = run_slices(df, "ts", lambda s: J.assemble_stream(s, 300, groups=1), slices=5, progress=progress, sentinel=far)
    assert {(r.conv_id, r.turn): (r.assembled, r.ended_by) for r in out.collect()} == {
        (1, 0): ("a", "timeout"), (2, 0): ("bc", "done"), (2, None): ("n", "timeout"), (2**60 + 1, 0): ("big", "done"),
        (5, 0): ("x", "timeout")}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_closed_replies_of_one_group_stay_closed(spark):
    t = spark.range(60).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.concat(F.lit("reply "), F.col("id").cast("string")).alias("text"))
    keys = ["conv_id", "turn"]
    lines = SSE.render_sse(SSE.tokenize(t, "text", keys), keys, full=t.select(*keys, F.col("text").alias("response")))
    d = tempfile.mkdtemp(prefix="convlake-sse-") + "/data"
    half = F.col("conv_id") % 2 == 0
    for part in (lines.filter(half | (F.col("line_no") == 0)), lines):  # the first half a second time, the others from their second line
        part.coalesce(1).write.mode("append").parquet(d)
    got = run_available(J.assemble_stream(stream_source(spark, d, lines.schema, max_files=1), groups=2))
    assert sorted((r.conv_id, r.response) for r in got.collect()) == [(i, f"reply {i}") for i in range(60)]


def test_chunks_are_handed_on_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa
    from convlake.functions import chunking as C

    texts = ["A first sentence that is long enough. " + "And so the next one goes on and on until it is over here. " * k for k in range(120)]
    texts += [None, "", " \n ", "x", "short. " * 3 + "tail without an end " * 400]
    batch = pa.record_batch([list(range(len(texts))), texts], names=["doc_id", "text"])
    taken = {}

    class Frame:  # takes the function that a worker runs
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            taken["run"] = run
            return self
    monkeypatch.setattr(C, "OUT_CHARS", 2000)
    C.chunk_sentences(Frame(), "doc_id", "text")
    out = list(taken["run"](iter([batch])))
    assert max(sum(len(c) for c in b.column(2).to_pylist()) for b in out) < 2000 + C.WEB_CAP and len(out) > 50
    got = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns))]
    assert got == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(C.chunk_reply(t))]
