"""Server-sent-event lines: render a token stream, parse it back, assemble it.

Works on batch text and on ``readStream.text`` alike (all stateless column
expressions; assembly is an aggregate keyed by message).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake import schemas as S

DATA_PREFIX = "data: "
HEARTBEAT = ": heartbeat"


def tokenize(msgs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Split each reply into space-terminated tokens (concatenation gives the text back)."""
    return msgs.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "(?<= )")).alias("seq", "tok"))


def render_sse(tokens: DataFrame, keys: list[str], full: DataFrame | None = None,
               heartbeat_every: int = 30) -> DataFrame:
    """Token events, a heartbeat comment after every ``heartbeat_every`` tokens,
    then a ``done`` event carrying the full reply. Output (keys, line_no, value)."""
    ev = F.to_json(F.struct(F.lit("token").alias("type"), F.col("tok").alias("content")))
    lines = tokens.select(*keys, (F.col("seq") * 2).cast("bigint").alias("line_no"),
                          F.concat(F.lit(DATA_PREFIX), ev).alias("value"))
    beats = (tokens.filter(((F.col("seq") + 1) % heartbeat_every) == 0)
                   .select(*keys, (F.col("seq") * 2 + 1).cast("bigint").alias("line_no"), F.lit(HEARTBEAT).alias("value")))
    out = lines.unionByName(beats)
    if full is not None:
        done = F.to_json(F.struct(F.lit("done").alias("type"), F.col("response").alias("response")))
        out = out.unionByName(full.select(*keys, F.lit(1 << 40).cast("bigint").alias("line_no"),
                                          F.concat(F.lit(DATA_PREFIX), done).alias("value")))
    return out


def parse_sse(lines: DataFrame, value: str = "value") -> DataFrame:
    """SRC-4: keep ``data: `` lines, JSON-decode the rest, drop lines that do not
    parse (comments, heartbeats and broken JSON are ignored). ``inline`` has a line
    decoded once, whatever fields are read of it."""
    ev = F.from_json(F.substring(F.col(value), len(DATA_PREFIX) + 1, 1 << 30), S.SSE_EVENT, {"mode": "PERMISSIVE"})
    return (lines.filter(F.startswith(F.col(value), F.lit(DATA_PREFIX)))
                 .select(*[c for c in lines.columns if c != value], F.inline(F.array(ev))).filter(F.col("type").isNotNull()))


def assemble(events: DataFrame, keys: list[str], seq: str = "line_no") -> DataFrame:
    """AGG-6: token contents concatenated in order per message, up to its first
    ``done`` or ``error`` event; the final response (of a ``done`` or ``response``
    event, if any), the error and the image addresses in order alongside. One
    reply's tokens are one group."""
    def of(kind: str, field: str):
        return F.when(F.col("type") == kind, F.struct(F.col(seq).alias("s"), F.col(field).alias("c")))

    got = events.groupBy(*keys).agg(
        F.array_sort(F.collect_list(of("token", "content"))).alias("_tok"),
        F.min(F.when(F.col("type").isin("done", "error"), F.col(seq))).alias("_end"),
        F.max(F.coalesce(F.when(F.col("type") == "done", F.col("response")),
                         F.when(F.col("type") == "response", F.col("content")))).alias("response"),
        F.max(F.when(F.col("type") == "error", F.col("content"))).alias("error"),
        F.array_sort(F.collect_list(of("image", "image_url"))).alias("_img"))
    before = F.filter("_tok", lambda x: F.col("_end").isNull() | (x["s"] < F.col("_end")))
    return got.select(*keys, F.array_join(F.transform(before, lambda x: x["c"]), "").alias("assembled"), "response", "error",
                      F.col("_img.c").alias("images"))
