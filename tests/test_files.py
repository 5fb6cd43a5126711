"""Sources that are files: logs of both shapes in one folder, and payload sizes."""

import json

from convlake.operators.routing import gate_payloads
from convlake.sources.logs import read_logs
from convlake.sources.payloads import read_payloads


def log(i):
    return {"session_id": f"s{i}", "timestamp": f"2024-01-0{i}T00:00:00Z", "messages": [{"role": "user", "content": f"hi {i}"}],
            "location": None, "tools_used": []}


def test_logs_of_both_shapes(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "lines.json").write_text("\n".join(json.dumps(log(i)) for i in (1, 2)) + "\n")
    (d / "indented.json").write_text(json.dumps(log(3), indent=2))
    # an inner object on a line of its own is no log
    (d / "compact.json").write_text(json.dumps(log(4), indent=2).replace('{\n      "role": "user",\n      "content": "hi 4"\n    }', '{"role": "user", "content": "hi 4"}'))
    (d / "partly.json").write_text(json.dumps(log(5)) + "\n{broken\n" + json.dumps(log(6)) + "\n")
    (d / "bad.json").write_text("not json at all")
    got = read_logs(spark, str(d), quarantine_path=str(tmp_path / "q"))
    assert sorted((r.session_id, r.messages[0].content) for r in got.collect()) == [(f"s{i}", f"hi {i}") for i in range(1, 7)]
    bad = spark.read.json(str(tmp_path / "q")).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r._corrupt) for r in bad) == [("bad.json", "not json at all"), ("partly.json", "{broken")]
    assert sorted(r.session_id for r in read_logs(spark, str(d / "lines.json"), multi_line=False).collect()) == ["s1", "s2"]
    assert [r.session_id for r in read_logs(spark, str(d / "indented.json"), multi_line=True).collect()] == ["s3"]


def test_payload_gate_on_files(spark, tmp_path):
    sizes = {"a": 999, "b": 1000, "c": 25 << 20, "sub/d": (25 << 20) + 1}
    (tmp_path / "sub").mkdir()
    for name, n in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.truncate(n)
    files = read_payloads(spark, str(tmp_path))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()
    got = {r.path.split(str(tmp_path) + "/")[1]: (r.length, r.verdict) for r in gate_payloads(files).collect()}
    assert got == {"a": (999, "no_audio"), "b": (1000, "ok"), "c": (25 << 20, "ok"), "sub/d": ((25 << 20) + 1, "too_large")}
