"""The rows of v_chat make every message rule fire; the results equal plain Python over the same rows."""

import json
import re
from collections import Counter, defaultdict

import pytest

from convlake.functions import dictionaries as D
from convlake.plans.catalog import REGISTRY
from convlake.plans.views import view
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def chat(spark):
    return [r.asDict() for r in view(spark, SF_SMALL, "v_chat").orderBy("turn", "msg_id").collect()]


def run(spark, name):
    return [tuple(r) for r in REGISTRY[name].build(spark, SF_SMALL).collect()]


def arguments(text):
    found = re.search(r"generate_image\s*\(?(\{.*?\})\)?", text or "", re.DOTALL)
    if not found:
        return None
    body = found.group(1)
    for fence in ("```json", "```"):
        if fence in body:
            body = body.split(fence)[1].split("```")[0].strip()
            break
    try:
        return json.loads(body)
    except ValueError:
        return None


def by_session(chat):
    out = defaultdict(list)
    for m in chat:
        out[m["session_id"]].append(m)
    return out


def test_filters(spark, chat):
    logged = {(m["msg_id"], m["role"], m["text"] or "") for m in chat if m["role"] in ("user", "assistant", "tool")}
    plain = {(m["msg_id"], m["role"], m["text"]) for m in chat if m["role"] in ("system", "user", "assistant") and (m["text"] or "").strip()}
    healthy = {(m["msg_id"], bool((m["text"] or "").strip()) and D.HIGH_DEMAND_PHRASE not in m["text"]) for m in chat}
    assert set(run(spark, "flt1_chat_log_messages")) == logged and 0 < len(logged) < len(chat)
    assert set(run(spark, "flt2_chat_plain_text")) == plain and 0 < len(plain) < len(chat)
    assert set(run(spark, "flt10_chat_probe_verdict")) == healthy and {ok for _, ok in healthy} == {True, False}
    assert {"tool", "function", "system", None} <= {m["role"] for m in chat}


def test_tool_calls(spark, chat):
    args = {m["msg_id"]: a for m in chat if (a := arguments(m["text"])) is not None}
    got = run(spark, "scl7_chat_tool_calls")
    assert set(got) == {(i, a.get("prompt"), len(a)) for i, a in args.items()}
    assert {"fenced", "plain fence", "first"} <= {p for _, p, _ in got}
    failed = [m for m in chat if "generate_image" in (m["text"] or "") and m["msg_id"] not in args]
    assert any('{"a": 1}' in m["text"] for m in failed) and any("oops" in m["text"] for m in failed)

    tools = defaultdict(set)
    for m in chat:
        if m["role"] == "assistant" and m["msg_id"] in args:
            tools[m["session_id"]].add("unknown" if m["msg_id"] % 5 == 0 else "generate_image")
        if m["role"] == "tool" and m["name"]:
            tools[m["session_id"]].add(m["name"])
    assert dict(run(spark, "agg2_chat_tools_used")) == {s: ",".join(sorted(t)) for s, t in tools.items()}
    assert any("search" in t or "make_audio" in t for t in tools.values())


def test_system_rows(spark, chat):
    want, merged = [], 0
    for s, rows in by_session(chat).items():
        rows = sorted(rows, key=lambda m: m["msg_id"])
        system = [m for m in rows if m["role"] == "system"]
        many = len(system) > 1
        merged += many
        want += [(s, m["msg_id"], m["role"], m["text"]) for m in rows if not (many and m["role"] == "system")]
        if many:
            want.append((s, -1, "system", "\n".join(m["text"] for m in system if m["text"] is not None)))
    assert merged and Counter(run(spark, "agg7_chat_consolidate_system")) == Counter(want)


def test_model_context(spark, chat):
    want, kinds = {}, Counter()
    for s, rows in by_session(chat).items():
        old, new = rows[:-10], rows[-10:]
        digest = " ".join(f"{m['role'] or 'unknown'}: {m['text'][:40]}..." for m in old if m["text"])
        first = next((m["text"] for m in new if m["role"] == "system"), None)
        content = f"{D.MEMORY_PREFIX}[History: {digest[-300:]}]" if digest else first or D.DEFAULT_INSTRUCTION
        kinds["digest" if digest else "own" if first else "default"] += 1
        want[s] = (content, sum(m["role"] != "system" for m in new))
    assert {s: (c, n) for s, c, n in run(spark, "win3_chat_model_context")} == want
    assert len(want) > 1 and kinds["digest"] and kinds["own"] + kinds["default"]


def test_lookup_reads_the_keys_buckets(spark):
    q = REGISTRY["join5_lookup_buckets"].build(spark, SF_SMALL)
    assert sorted(r.session_id for r in q.collect()) == ["3", "7", "9"]
    assert {f.split("/b=")[1].split("/")[0] for f in q.inputFiles()} and len({f.split("/b=")[1].split("/")[0] for f in q.inputFiles()}) <= 4
