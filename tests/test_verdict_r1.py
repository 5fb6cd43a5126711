"""Cases outside the happy path: retried batches, null fields, foreign dialects."""

import json

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions import text
from convlake.operators import geo, history
from convlake.sources import leads, logs, sse


def test_mask_emails_keeps_private_use_characters(spark):
    rows = ["secret", "a@b.co", "ab@b.co x abc@b.co", "x..abcd@e.f.org,"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(text.mask_emails(F.col("t"))).collect()]
    assert got == ["secret", "***@b.co", "***@b.co x ab***@b.co", "x.***@e.f.org,"]


def test_consolidate_keeps_messages_that_share_a_turn(spark):
    rows = [(1, 0, "system", "a"), (1, 0, "user", "hello"), (1, 2, "system", "b"), (2, 5, "system", "one"), (2, 6, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in history.consolidate_system(df).select("conv_id", "turn", "role", "text").collect()}
    assert got == {(1, -1, "system", "a\nb"), (1, 0, "user", "hello"), (2, 5, "system", "one"), (2, 6, None, "x")}


def test_digest_honours_tail(spark):
    rows = [(1, i, i, "u", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "session_id long, turn long, msg_id long, role string, content string")
    assert len(history.digest(df, tail=2000).first()["digest"]) >= 2000


def test_indented_logs_count_and_latest(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"session_id": f"s{i}"}, indent=2))
    got = logs.read_logs(spark, str(tmp_path), multi_line=True)
    assert got.count() == 2
    df = spark.createDataFrame([("a", None, "x")], "session_id string, timestamp timestamp, v string")
    assert logs.latest_logs(df).first()["v"] == "x"


def test_lead_stream_replay_and_csv(spark, tmp_path):
    row = 'Jo "Q" Doe', "a@b.co", 'line one\nline "two"'
    df = spark.createDataFrame([row], "contact_name string, email string, notes string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(src)
    for run in ("c1", "c2"):  # a lost checkpoint replays batch 0
        q = leads.append_leads_stream(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / run), "csv")
        q.processAllAvailable()
        q.stop()
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    assert [tuple(r) for r in got.select("contact_name", "email", "notes").collect()] == [row]


def test_session_merge_replay(spark, tmp_path):
    schema = "session_id string, history string, title string, updated_at timestamp, seq long"
    rows = [("a", "1", "t", None, 1), ("a", "2", "", None, 2)]
    src, root = str(tmp_path / "in"), str(tmp_path / "v")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    for run in ("c1", "c2"):
        q = logs.merge_sessions_stream(spark.readStream.schema(schema).parquet(src), root, str(tmp_path / run))
        q.awaitTermination(120)
        assert logs.read_latest_version(spark, root).count() == 1


def test_location_plans_agree_per_row(spark):
    terms = [(0, "city", "ab", "Ab", "R", "S"), (1, "region", "x" * 300, None, "Long", "S"), (2, "city", "q", "Q", "R", "S"),
             (3, "state", "", None, None, "Empty"), (4, "state", None, None, None, "None"), (5, "region", "longer name", None, "L", "S")]
    gaz = spark.createDataFrame(terms, geo.GAZ_SCHEMA)
    texts = ["." * 254 + "longer name", "." * 255 + "Q", "z" + "x" * 300, "i'm in q or longer name", "", None, "x" * 299, "\n\U0001F600ab"]
    msgs = spark.createDataFrame([(None if i % 3 == 0 else 7, t) for i, t in enumerate(texts * 2)], "msg_id long, text string")
    want = sorted(geo.tag_location(msgs, gaz).collect(), key=repr)
    for broadcast in (None, True, False):
        got = geo._tag_join(msgs, gaz, "text", D.LOCATION_PHRASES, broadcast)
        assert sorted(got.collect(), key=repr) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert [r.loc_kind for r in want].count("region") == 4


def test_sse_images_responses_and_tokens_after_the_end(spark):
    events = [{"type": "token", "content": "a "}, {"type": "image", "image_url": "u1"}, {"type": "token", "content": "b"},
              {"type": "image", "image_url": "u2"}, {"type": "response", "content": "a b."}, {"type": "done"},
              {"type": "token", "content": "late"}]
    lines = [(1, i, "data: " + json.dumps(e)) for i, e in enumerate(events)] + [(2, 0, "data: " + json.dumps(events[0]))]
    parsed = sse.parse_sse(spark.createDataFrame(lines, "k long, line_no long, value string"))
    got = {r["k"]: tuple(r)[1:] for r in sse.assemble(parsed, ["k"]).collect()}
    assert got == {1: ("a b", "a b.", None, ["u1", "u2"]), 2: ("a ", None, None, [])}
