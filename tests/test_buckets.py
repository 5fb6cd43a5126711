"""SNK-3 / JOIN-5: the session table in key buckets."""

import os

import pytest
from pyspark.sql import functions as F

from convlake.sources import buckets as B
from convlake.sources.logs import merge_sessions

SCHEMA = "session_id string, title string, history string, updated_at timestamp_ntz, seq long"


def batch(spark, ids, day, title="T"):
    rows = spark.createDataFrame([(i, title, f"[{day}]", day) for i in ids], "session_id string, title string, history string, seq long")
    return rows.withColumn("updated_at", F.expr("make_timestamp_ntz(2024, 1, cast(seq AS int), 0, 0, 0)")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def content(df):
    return sorted((tuple(r) for r in df.select("session_id", "title", "history", "updated_at").collect()), key=repr)


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    root, src = str(tmp_path / "table"), str(tmp_path / "in")
    ids = [f"s{i}" for i in range(200)] + [None]
    parts = [batch(spark, ids, 1), batch(spark, ["s7", "new"], 2, title=""), batch(spark, ["s7"], 3, title="later")]
    want = spark.createDataFrame([], B.COLUMNS)
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(src)
        before = files(f"{root}/data") if k else set()
        q = B.upsert_buckets_stream(spark.readStream.schema(SCHEMA).parquet(src), root, str(tmp_path / "ck"), buckets=16)
        q.awaitTermination()
        assert q.exception() is None
        want = merge_sessions(want, part)
        assert content(B.read_buckets(spark, root)) == content(want)
        if k:
            written = files(f"{root}/data") - before
            assert before <= files(f"{root}/data") and {f.split("/v=")[1][:8] for f in written} == {f"{k + 1:08d}"}
            assert len({os.path.dirname(f) for f in written}) <= part.count()
    # a replayed batch writes its version again and nothing else
    assert B.upsert_buckets(parts[2], root, 3, 16) == B.upsert_buckets(parts[2], root, 3, 16)
    assert content(B.read_buckets(spark, root)) == content(want)


def test_lookup_reads_its_bucket(spark, tmp_path):
    root = str(tmp_path / "table")
    assert B.read_buckets(spark, root).count() == 0 and B.read_buckets(spark, root, ["a"]).count() == 0
    B.upsert_buckets(batch(spark, [f"s{i}" for i in range(200)], 1), root, 1, 16)
    one = B.read_buckets(spark, root, ["s5"])
    assert [r.session_id for r in one.collect()] == ["s5"]
    assert len({os.path.dirname(f) for f in one.inputFiles()}) == 1
    assert B.read_buckets(spark, root, ["absent"]).count() == 0
    assert B.upsert_buckets(batch(spark, [], 2), root, 2, 16) == []
    with pytest.raises(ValueError):
        B.upsert_buckets(batch(spark, ["s1"], 2), root, 2, 8)


def test_half_written_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "table")
    B.upsert_buckets(batch(spark, ["a", "b"], 1), root, 1, 4)
    want = content(B.read_buckets(spark, root))
    B.upsert_buckets(batch(spark, ["a"], 2), root, 2, 4)
    os.remove(f"{root}/manifest/v=00000002/_SUCCESS")
    assert content(B.read_buckets(spark, root)) == want
