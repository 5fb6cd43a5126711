"""Structured Streaming twins of the batch jobs.

Stateless jobs reuse the batch column expressions unchanged; stateful ones use
``transformWithStateInPandas`` processors whose per-key state is bounded (the
last hour of activity), or native ``session_window`` aggregation with a
watermark. Event time comes from the data; rows later than the watermark are
dropped and counted by the query progress metrics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convlake.functions.classify import brand_or_default
from convlake.functions.dictionaries import RequestPolicy
from convlake.operators import leads as L
from convlake.operators.sequence import epoch_us
from convlake.operators.sequential import Admission, cache_key
from convlake.sources import sse as SSE


def stream_leads(msgs: DataFrame, id_col: str, text: str = "text", detected_at: str = "1970-01-01T00:00:00+00:00",
                 dedupe_on: list[str] | None = None, ts: str | None = None, dedupe_watermark: str = "10 minutes"):
    """STR-1: lead auto-capture on every incoming message. Stateless by default:
    the same text twice gives two leads, as in the batch job. ``dedupe_on``
    (with an event-time column ``ts``) drops repeats of those columns seen
    within the watermark (``dropDuplicatesWithinWatermark``)."""
    if dedupe_on:
        msgs = (msgs.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", dedupe_watermark)
                    .dropDuplicatesWithinWatermark(dedupe_on).drop("_et"))
    return L.contact_lead_report(msgs.select(id_col, text), id_col, text, detected_at)


def expire_idle(requests: DataFrame, gap_s: int = 3600, key: str = "session_id", ts: str = "ts",
                watermark: str = "2 hours") -> DataFrame:
    """STR-4: closed sessions (more than ``gap_s`` idle) with their bounds and
    size; a session is emitted once the watermark passes its end."""
    t = requests.withColumn("_ts", F.col(ts).cast("timestamp"))
    return (t.withWatermark("_ts", watermark)
             .groupBy(key, F.session_window("_ts", f"{gap_s} seconds").alias("w"))
             .agg(F.count(F.lit(1)).alias("n_requests"))
             .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_requests"))


def abandoned_captures(events: DataFrame, idle_s: int = 300, key: str = "session_id", ts: str = "ts",
                       start_flag: str = "capture_start", watermark: str = "1 hour") -> DataFrame:
    """STR-7: a lead capture is abandoned when its session goes idle for more
    than ``idle_s`` after a capture started; reported at idle expiry."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return (t.withWatermark("_ts", watermark)
             .groupBy(key, F.session_window("_ts", f"{idle_s} seconds").alias("w"))
             .agg(F.max(F.col(start_flag).cast("int")).alias("_cap"))
             .filter("_cap = 1")
             .select(key, F.col("w.end").alias("abandoned_at")))


# Column names passed to the processors carry no leading underscore (the
# pandas side would see them renamed).


class AdmissionProcessor(StatefulProcessor):
    """STR-2: keyed by ip. Accepted times are list state (at most the long
    limit), sessions and cache entries map state, of which a micro-batch reads and
    writes only the keys it names. Its rows are replayed in (time, id) order.
    A timer at the first time at which an entry expires evicts what the watermark
    has left behind, so sessions that do not return go away while the client stays
    busy; when nothing is left, the key has no state."""

    def __init__(self, policy: RequestPolicy = RequestPolicy()):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getListState("accepted", "us long")
        self.sessions = handle.getMapState("sessions", "session string", "recent long, total long, last long, wm_us long")
        self.cache = handle.getMapState("cache", "brand string, session string, message string", "us long, wm_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "req_id"])
        st = Admission(self.policy)
        if self.accepted.exists():
            st.ip_acc.extend(r[0] for r in self.accepted.get())
        shift = int(pdf["wm_us"].iloc[0]) - int(pdf["ts_us"].iloc[0])  # of the session's time zone
        sessions, entries = set(pdf["session_id"]), set(zip(pdf["brand"], pdf["session_id"], pdf["message"]))
        for name in sessions:
            if self.sessions.containsKey((name,)):
                recent, total, last, _ = self.sessions.getValue((name,))
                st.restore(name, recent, total, last)
        for entry in entries:
            if self.cache.containsKey(entry):
                st.cache[entry] = self.cache.getValue(entry)[0]
        verdicts = [st.step(int(u), s, b, m, bool(x)) for u, s, b, m, x in
                    zip(pdf["ts_us"], pdf["session_id"], pdf["brand"], pdf["message"], pdf["is_stream"])]
        if st.ip_acc:
            self.accepted.put([(t,) for t in st.ip_acc])
        else:
            self.accepted.clear()
        first = []
        for name in sessions:
            held = st.session(name)
            if held:
                self.sessions.updateValue((name,), (*held, held[0] + shift))
                first.append(held[0] + shift + self._session_us())
            elif self.sessions.containsKey((name,)):
                self.sessions.removeKey((name,))
        for entry in entries & st.cache.keys():
            us = st.cache[entry]
            self.cache.updateValue(entry, (us, us + shift))
            first.append(us + shift + self.policy.cache_ttl * 1_000_000)
        if first and not list(self.handle.listTimers()):
            self.handle.registerTimer(min(first) // 1000 + 1)
        yield pd.DataFrame({"req_id": pdf["req_id"].astype("int64"), "ip": pdf["ip"],
                            "session_id": pdf["session_id"], "verdict": verdicts})

    def _session_us(self) -> int:
        p = self.policy
        return max(p.session_idle, p.session_cooldown, p.ip_short_window, p.ip_long_window) * 1_000_000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        left = []
        for state, age in ((self.sessions, self._session_us()), (self.cache, self.policy.cache_ttl * 1_000_000)):
            held = [(k, v[-1] + age) for k, v in state.iterator()]
            for k, until in held:
                if until < now:
                    state.removeKey(k)
                else:
                    left.append(until)
        if left:
            self.handle.registerTimer(max(min(left), now) // 1000 + 1)
        else:
            # every accepted request has its session's entry, which outlives it
            self.accepted.clear()
        return iter([])

    def close(self) -> None:
        pass


def _with_event_time(d: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Watermark column for the timers: event time as an absolute timestamp and
    its epoch microseconds (both in the same session zone as the watermark)."""
    et = F.col(ts).cast("timestamp")
    return d.withColumn("event_time", et).withColumn("wm_us", F.unix_micros(et)).withWatermark("event_time", watermark)


def admit_stream(requests: DataFrame, policy: RequestPolicy = RequestPolicy(), watermark: str = "10 minutes") -> DataFrame:
    d = _with_event_time(requests, "ts", watermark).select(
        "req_id", "ip", "session_id", brand_or_default(F.col("brand")).alias("brand"), "message", F.col("is_stream").cast("boolean").alias("is_stream"),
        epoch_us(F.col("ts")).alias("ts_us"), "wm_us", "event_time")
    return d.groupBy("ip").transformWithStateInPandas(
        AdmissionProcessor(policy), "req_id long, ip string, session_id string, verdict string", "Append", "EventTime")


#: Groups that a keyed stream is dealt into. A call of a processor costs milliseconds
#: whatever it holds, so it takes the rows of a whole group; the number belongs to the
#: checkpoint, as the shuffle partitions do.
GROUPS = 1024


def _group_of(*cols, groups: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(groups)).alias("group")


def _wake_at(handle: StatefulProcessorHandle, expiry_ms: int) -> None:
    """One timer per group, at the earliest time at which an entry expires. One that
    fires is still listed: what it leaves gets its timer by ``registerTimer``."""
    timers = list(handle.listTimers())
    if timers and min(timers) <= expiry_ms:
        return
    for t in timers:
        handle.deleteTimer(t)
    handle.registerTimer(expiry_ms)


def _due(timerValues, expiredTimerInfo) -> int:
    """Entries that expire up to this time (ms) have expired when a timer fires."""
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)


class CacheProcessor(StatefulProcessor):
    """STR-3: per cache key the time of the last miss; a hit never refreshes it.
    The entries of a group of keys are one value, read and written once in a
    micro-batch. They go by an event-time timer once they can no longer hit."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "cache_key array<string>, us array<long>, until_ms array<long>")

    def _held(self) -> dict[str, tuple[int, int]]:
        """(last miss, kept until) of each key."""
        if not self.entries.exists():
            return {}
        keys, us, until = self.entries.get()
        return dict(zip(keys, zip(us, until)))

    def _hold(self, held: dict[str, tuple[int, int]]) -> int:
        """Keeps these entries; the earliest time at which one expires."""
        us, until = zip(*held.values())
        self.entries.update((list(held), list(us), list(until)))
        return min(until)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values(["ts_us", "req_id"])
        held = self._held()
        hits = []
        for k, us, wm in zip(pdf["cache_key"], pdf["ts_us"], pdf["wm_us"]):
            us, until = int(us), int(wm) // 1000 + self.ttl_us // 1000 + 1
            last, before = held.get(k, (None, until))
            hits.append(last is not None and us - last < self.ttl_us)
            held[k] = (last if hits[-1] else us, max(before, until))
        _wake_at(self.handle, self._hold(held))
        yield pd.DataFrame({"req_id": pdf["req_id"].astype("int64"), "cached": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = _due(timerValues, expiredTimerInfo)
        left = {k: e for k, e in self._held().items() if e[1] > due}
        if left:
            self.handle.registerTimer(self._hold(left))
        else:
            self.entries.clear()
        return iter([])

    def close(self) -> None:
        pass


def suppress_stream(requests: DataFrame, ttl_s: int = 600, keys=("brand", "session_id", "message"),
                    watermark: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    d = (_with_event_time(requests.filter(F.coalesce(F.col("is_stream"), F.lit(0)) == 0), "ts", watermark)
         .select("req_id", cache_key(keys).alias("cache_key"),
                 epoch_us(F.col("ts")).alias("ts_us"), "wm_us", "event_time"))
    return d.withColumn("group", _group_of("cache_key", groups=groups)).groupBy("group").transformWithStateInPandas(
        CacheProcessor(ttl_s * 1_000_000), "req_id long, cached boolean", "Append", "EventTime")


class AssembleProcessor(StatefulProcessor):
    """STR-5: the events of a reply are kept until ``done`` (or ``error``)
    arrives; then the reply is emitted and closed, so that what comes after
    the end is ignored. With ``timeout_ms`` (event time) a reply without an event
    for so long is emitted as it is, ended by ``timeout``, and a closed reply is
    forgotten so long after its last event: the state of a finished stream is empty.
    The replies of a group are map state, of which a micro-batch reads and writes
    only those it names."""

    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.replies = handle.getMapState("replies", "conv_id string, turn string",
                                          "closed boolean, until_ms long, line_no array<long>, kind array<string>, content array<string>")

    def handleInputRows(self, key, rows, timerValues):
        come: dict[tuple, list[tuple]] = {}
        last: dict[tuple, int] = {}
        for pdf in rows:
            for conv, turn, n, kind, content, wm in zip(*(pdf[c] for c in ("conv_id", "turn", "line_no", "kind", "content", "wm_us"))):
                reply = (conv, turn)
                got = come.setdefault(reply, [])
                if kind is not None:
                    got.append((int(n), kind, content))
                if self.timeout_ms:
                    last[reply] = max(last.get(reply, 0), int(wm))
        known = self.replies.exists()
        out = []
        for reply, got in come.items():
            closed, until, *events = (known and self.replies.getValue(reply)) or (False, 0)
            if self.timeout_ms:
                until = max(until, last[reply] // 1000 + self.timeout_ms)
            if not closed:
                got += zip(*events)
                closed = any(kind in ("done", "error") for _, kind, _ in got)
                if closed:
                    out.append(self._reply(reply, got, None))
            if closed:
                got = []
            if got or closed or until:
                self.replies.updateValue(reply, (closed, until, *([e[i] for e in got] for i in range(3))))
            if until:
                last[reply] = until
        if last:
            _wake_at(self.handle, min(last.values()))
        if out:
            yield self._frame(out)

    def _reply(self, reply: tuple, got: list[tuple], ended_by: str | None) -> tuple:
        """The row of a reply with these events."""
        got.sort(key=lambda e: e[0])
        end = next((e for e in got if e[1] in ("done", "error")), None)
        before = [e for e in got if end is None or e[0] < end[0]]

        def of(kind):
            return [c for _, k, c in before if k == kind]

        response = end[2] if end and end[1] == "done" and end[2] is not None else next(reversed(of("response")), None)
        return (*(None if k is None else int(k) for k in reply), "".join(c or "" for c in of("token")), ended_by or end[1], response,
                end[2] if end and end[1] == "error" else None, of("image"))

    def _frame(self, replies: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(replies, columns=["conv_id", "turn", "assembled", "ended_by", "response", "error", "images"], dtype=object)
        return out.astype({"conv_id": "Int64", "turn": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = _due(timerValues, expiredTimerInfo)
        out, gone, left = [], [], []
        for reply, (closed, until, *events) in self.replies.iterator():
            if until > due:
                left.append(until)
                continue
            gone.append(reply)
            if not closed and events[0]:
                out.append(self._reply(tuple(reply), [*zip(*events)], "timeout"))
        if left:
            for reply in gone:
                self.replies.removeKey(reply)
            self.handle.registerTimer(min(left))
        else:
            self.replies.clear()
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


REPLY = "conv_id long, turn long, assembled string, ended_by string, response string, error string, images array<string>"


def assemble_stream(lines: DataFrame, timeout_s: int | None = None, ts: str = "ts", watermark: str = "1 minute",
                    groups: int = GROUPS) -> DataFrame:
    """SSE lines (conv_id, turn, line_no, value) -> one row per finished reply.

    ``timeout_s`` needs the event time ``ts`` of the lines: a reply that never ends
    is emitted once the watermark is so far past its last event, and nothing is kept
    for replies that ended so long ago. Without it replies wait for their end, and
    a flag is kept for each closed one.
    """
    ev = SSE.parse_sse(lines)
    kind = F.when(F.col("type").isin("token", "response", "image", "error", "done"), F.col("type"))
    content = F.when(kind == "image", F.col("image_url")).when(kind == "done", F.col("response")).otherwise(F.col("content"))
    # as strings: a null number would make a whole column of a frame floating point
    fields = [_group_of("conv_id", "turn", groups=groups), *(F.col(k).cast("string").alias(k) for k in ("conv_id", "turn")),
              "line_no", kind.alias("kind"), content.alias("content")]
    if not timeout_s:
        return (ev.select(*fields, F.lit(0).cast("long").alias("wm_us")).groupBy("group")
                .transformWithStateInPandas(AssembleProcessor(), REPLY, "Append", "None"))
    return (_with_event_time(ev, ts, watermark).select(*fields, "wm_us", "event_time").groupBy("group")
            .transformWithStateInPandas(AssembleProcessor(timeout_s * 1000), REPLY, "Append", "EventTime"))


def probe_timeline_stream(probes: DataFrame, minutes: int = 4, ts: str = "ts", ok: str = "ok",
                          watermark: str = "10 minutes") -> DataFrame:
    """STR-6: per tumbling window the latest probe verdict and the probe count;
    a window is emitted once the watermark passes its end."""
    t = probes.withColumn("_ts", F.col(ts).cast("timestamp"))
    return (t.withWatermark("_ts", watermark)
             .groupBy(F.window("_ts", f"{minutes} minutes").alias("w"))
             .agg(F.max_by(F.col(ok), F.struct(F.col("_ts"), F.col("attempt_id"))).alias("latest_ok"),
                  F.count(F.lit(1)).alias("n_probes"))
             .select(F.unix_micros(F.col("w.start")).alias("window_start_us"), "latest_ok", "n_probes"))
