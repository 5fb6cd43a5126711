import os
import tempfile

from pyspark.sql import functions as F

from convlake.operators import geo as G
from convlake.plans.views import view
from convlake.sources import knowledge as KN
from convlake.sources import leads as LS
from convlake.sources import logs as LG
from tests.conftest import SF_SMALL


def test_logs_round_trip_with_quarantine(spark):
    t = view(spark, SF_SMALL, "v_turn")
    logs = LG.log_records(t, "conv_id", "turn", "role", "text", "2024-02-01T10:20:30Z")
    d = tempfile.mkdtemp(prefix="convlake-logs-") + "/logs"
    LG.write_logs(logs, d)
    with open(os.path.join(d, "date=2024-02-01", "broken.json"), "w") as f:
        f.write("{not json\n")
    q = d + "_quarantine"
    back = LG.read_logs(spark, d, quarantine_path=q)
    assert back.count() == logs.count() and spark.read.json(q).count() == 1
    assert back.filter(F.col("stamp").endswith("_20240201_102030")).count() == logs.count()
    assert back.select(F.explode("messages")).count() == logs.select(F.explode("messages")).count()


def test_knowledge_sections(spark):
    d = tempfile.mkdtemp(prefix="convlake-kb-")
    with open(os.path.join(d, "pack.md"), "w") as f:
        f.write("intro line\n# Services\nWe build things.\n## Pricing\nAsk us.\nnot # a heading\n")
    got = [(r.section_no, r.heading) for r in KN.read_knowledge(spark, d).orderBy("section_no").collect()]
    assert got == [(0, None), (1, "Services"), (2, "Pricing")]


def test_knowledge_packs_follow_the_data(spark, monkeypatch):
    from convlake.plans import q_io
    want = sorted(map(tuple, q_io.src5_read_knowledge(spark, "/root/testdata/sf0.001").collect()))
    sizes = []
    for limit in (1 << 30, 2000):
        monkeypatch.setattr(q_io, "PACK_BYTES", limit)
        monkeypatch.setattr(q_io, "_scratch", lambda spark, what: tempfile.mkdtemp(prefix="convlake-kb-") + "/packs")
        k = q_io.src5_read_knowledge(spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, k.collect())) == want
        sizes.append(len(k.inputFiles()))
    assert sizes[0] <= 8 < sizes[1]


def test_read_and_append_leads(spark):
    d = tempfile.mkdtemp(prefix="convlake-leads-")
    with open(os.path.join(d, "leads.csv"), "w") as f:
        f.write("timestamp,name,phone,email,service,best_time,details,ip_address\n"
                "2024-01-01T10:00:00,Ann,555,a@b.co,web,am,hi,1.2.3.4\n"
                "2024-01-01T11:00:00,,556,,web,pm,x,1.2.3.5\n")
    leads = LS.read_leads(spark, os.path.join(d, "leads.csv"), "csv")
    assert leads.columns == LS.UNIFIED and leads.count() == 2
    out, rej = d + "/ok", d + "/rejected"
    LS.append_leads(leads, out, rejected_path=rej)
    LS.append_leads(leads, out, rejected_path=rej)
    assert spark.read.parquet(out).count() == 2 and spark.read.parquet(rej).count() == 2


def test_versioned_sessions(spark):
    root = tempfile.mkdtemp(prefix="convlake-ver-")
    a = spark.createDataFrame([("s", 1)], "session_id string, v int")
    LG.write_version(a, root, 1)
    LG.write_version(a.withColumn("v", F.lit(2)), root, 2)
    os.makedirs(os.path.join(root, "v=00000003"))  # incomplete version: ignored
    assert LG.read_latest_version(spark, root).collect()[0].v == 2


def test_location_region_keeps_city_and_substring(spark):
    msgs = spark.createDataFrame([(0, "s", 0, "we moved to riverton last year"), (1, "s", 1, "anything in south shore?"),
                                  (2, "s", 2, "hello"), (3, "t", 0, "planning a hillside wedding")],
                                 "msg_id long, session_id string, turn long, text string")
    tagged = G.tag_location(msgs, G.default_gazetteer(spark))
    got = {r.msg_id: (r.city_now, r.region_now) for r in G.running_location(tagged).collect()}
    assert got[0] == ("Riverton", "North Shore")
    assert got[1] == ("Riverton", "South Shore")  # region-only hit keeps the older city
    assert got[2] == ("Riverton", "South Shore")
    assert got[3] == ("Hill", "South Shore")  # substring hit inside a longer word
    # phrase rule: the first phrase captures both names, the gazetteer's order decides
    p = spark.createDataFrame([(9, "i'm in springfield near riverton")], "msg_id long, text string")
    assert G.tag_location(p, G.default_gazetteer(spark)).collect()[0].loc_city == "Springfield"


def test_merge_sessions_stream_versions(spark):
    root = tempfile.mkdtemp(prefix="convlake-sess-") + "/sessions"
    src_dir = tempfile.mkdtemp(prefix="convlake-upd-") + "/updates"
    schema = "session_id string, title string, history string, updated_at timestamp_ntz, seq long"
    b1 = spark.createDataFrame([("s", "T", "[1]", "2024-01-01 00:00:00", 0)],
                               "session_id string, title string, history string, updated_at string, seq long") \
              .withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    b1.write.parquet(src_dir)
    b2 = b1.withColumn("title", F.lit("")).withColumn("history", F.lit("[1,2]")) \
           .withColumn("updated_at", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).withColumn("seq", F.lit(1).cast("long"))
    b2.write.mode("append").parquet(src_dir)
    q = LG.merge_sessions_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src_dir), root,
                                 tempfile.mkdtemp(prefix="convlake-ck-"))
    q.awaitTermination()
    r = LG.read_latest_version(spark, root).collect()
    assert [(x.session_id, x.title, x.history) for x in r] == [("s", "T", "[1,2]")]


def test_image_gate_and_logging_switch(spark):
    from convlake.operators import routing as R
    meta = spark.createDataFrame([(0, 503, "image/png", 5000), (1, 404, "image/png", 5000), (2, 200, "text/html", 5000),
                                  (3, 200, "image/png", 50), (4, 200, "image/png", 5000)],
                                 "i int, status int, content_type string, length long")
    assert [r.verdict for r in R.gate_images(meta).orderBy("i").collect()] == \
        ["server_error", "bad_status", "non_image", "invalid_image", "ok"]
    d = tempfile.mkdtemp(prefix="convlake-off-") + "/logs"
    LG.write_logs(spark.range(1).selectExpr("'s' AS session_id", "'2024-01-01T00:00:00Z' AS timestamp"), d, enabled=False)
    assert not os.path.exists(d)


def test_export_noop_and_remote_leads(spark):
    d = tempfile.mkdtemp(prefix="convlake-exp-")
    empty = spark.createDataFrame([], "session_id string, timestamp string")
    m = LG.export_bundle(empty, d + "/bundle", "2024-02-01 00:00:00").collect()[0]
    assert m.total_conversations == 0 and not os.path.exists(d + "/bundle")
    with open(os.path.join(d, "remote.json"), "w") as f:
        f.write('{"company_name": "Co", "contact_name": "Ann", "email": "a@b.co", "status": "inbound_chat", '
                '"metadata": "{\\"session_id\\": \\"s1\\"}", "created_at": "2024-01-01T00:00:00"}\n')
    r = LS.read_leads(spark, os.path.join(d, "remote.json"), "remote").collect()[0]
    assert (r.company_name, r.email, r.status) == ("Co", "a@b.co", "inbound_chat")


def test_cross_ip_sessions_and_lead_window(spark):
    from datetime import datetime

    from convlake.operators import limits as LM
    from convlake.operators import sequential as SQ
    req = spark.createDataFrame([(0, "s1", "i1"), (1, "s1", "i2"), (2, "s2", "i1")], "req_id long, session_id string, ip string")
    assert [r.session_id for r in SQ.cross_ip_sessions(req).collect()] == ["s1"]
    leads = spark.createDataFrame([("ip", datetime(2024, 1, 1, 0, 0, 0)), ("ip", datetime(2024, 1, 1, 0, 0, 1)),
                                   ("ip", datetime(2024, 1, 2, 0, 0, 0))], "ip_address string, ts timestamp_ntz")
    # strictly later than as_of - 24 h: the lead exactly 24 h old does not count
    assert LM.leads_per_ip(leads, "2024-01-02 00:00:00", 24).collect()[0].n_leads == 2
    s = spark.createDataFrame([("abcdefghij", None, datetime(2024, 1, 1)), ("b", "T", datetime(2024, 1, 2))],
                              "session_id string, title string, updated_at timestamp_ntz")
    top = LM.list_sessions(s, limit=1).collect()
    assert [(r.session_id, r.title) for r in top] == [("b", "T")]
    assert LM.list_sessions(s).collect()[1].title == "Chat abcdefgh"


def test_spread_only_when_fewer_partitions_than_cores(spark):
    from convlake.sources.tables import spread
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(1000).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(1000).repartition(cores * 2)
    assert spread(many) is many  # already parallel: untouched, no extra shuffle
