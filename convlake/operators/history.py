"""Conversation-history jobs: trim, digest, model context, system consolidation.

Messages are rows (session, turn, role, content). All per-session work goes
through ``sequence.top_k`` (salted two-stage ranking) or partial aggregates,
so a session holding a large share of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.operators.sequence import top_k_multi

TAIL = 300


def digest_parts(tail: int) -> int:
    """Newest older parts that always cover ``tail`` characters: a part with its
    separator has at least 6 (an empty role, one character of text)."""
    return tail // 6 + 2


def trim_history(msgs: DataFrame, session: str = "session_id", turn: str = "turn",
                 msg_id: str = "msg_id", max_len: int = 11) -> DataFrame:
    """WIN-2: sessions longer than ``max_len`` keep message 0 and the newest
    ``max_len - 1``; shorter sessions keep everything. One two-stage pass ranks
    both ends (no union, no de-dup shuffle)."""
    r = top_k_multi(msgs, [session], {
        "_first": ([F.col(turn).asc(), F.col(msg_id).asc()], 1),
        "_last": ([F.col(turn).desc(), F.col(msg_id).desc()], max_len - 1)}, salt_of=[msg_id])
    return r.drop("_first", "_last")


def _recent(msgs: DataFrame, session: str, turn: str, msg_id: str, content: str, keep: int,
            tail: int = TAIL) -> DataFrame:
    """Survivors carrying ``_new`` (rank among all messages, newest first, <= keep)
    and ``_ne`` (rank among non-empty messages, <= keep + digest_parts(tail))."""
    order = [F.col(turn).desc(), F.col(msg_id).desc()]
    nonempty = F.coalesce(F.length(content), F.lit(0)) > 0
    return top_k_multi(msgs, [session], {"_new": (order, keep), "_ne": (order, keep + digest_parts(tail), nonempty)},
                       salt_of=[msg_id])


def _digest_of(recent: DataFrame, session: str, turn: str, msg_id: str, role: str, content: str,
               head: int, tail: int) -> DataFrame:
    """Digest per session from the survivors of ``_recent`` (at most
    keep + keep + digest_parts(tail) rows per session, so the window below is bounded)."""
    older = recent.filter(F.col("_new").isNull() & F.col("_ne").isNotNull())
    w = Window.partitionBy(session).orderBy(F.col(turn).desc(), F.col(msg_id).desc())
    older = older.withColumn("_o", F.row_number().over(w)).filter(F.col("_o") <= digest_parts(tail))
    part = F.concat(F.coalesce(F.col(role), F.lit("unknown")), F.lit(": "),
                    F.substring(F.col(content), 1, head), F.lit("..."))
    parts = older.groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(msg_id).alias("i"),
                                             part.alias("p")))).alias("_ps"))
    text = F.array_join(F.transform("_ps", lambda x: x["p"]), " ")
    return parts.select(session, text.alias("_j")).select(
        session, F.concat(F.lit(D.DIGEST_PREFIX), F.expr(f"right(_j, {tail})"), F.lit("]")).alias("digest"))


def digest(msgs: DataFrame, session: str = "session_id", turn: str = "turn", msg_id: str = "msg_id",
           role: str = "role", content: str = "content", keep: int = 10, head: int = 40,
           tail: int = 300) -> DataFrame:
    """AGG-9: per session, a digest of the messages before the newest ``keep``:
    "{role}: {first 40 chars}..." for each non-empty one, joined by spaces, the
    last ``tail`` characters, wrapped "[History: ...]"; '' when nothing is older.
    """
    recent = _recent(msgs, session, turn, msg_id, content, keep, tail)
    parts = _digest_of(recent, session, turn, msg_id, role, content, head, tail)
    sessions = msgs.select(session).distinct()
    return sessions.join(parts, session, "left").select(session, F.coalesce("digest", F.lit("")).alias("digest"))


def model_context(msgs: DataFrame, session: str = "session_id", turn: str = "turn", msg_id: str = "msg_id",
                  role: str = "role", content: str = "content", keep: int = 10,
                  default_instruction: str = D.DEFAULT_INSTRUCTION) -> DataFrame:
    """WIN-3: per session, the system text sent with the newest ``keep`` messages
    and how many non-system messages go with it.

    The system text is the first system message among (memory note, newest
    ``keep``): a digest, when there is one, takes precedence over any system
    message; otherwise the default instruction is used. Newest messages and
    digest come from the same ranking pass.
    """
    recent = _recent(msgs, session, turn, msg_id, content, keep)
    newest = recent.filter(F.col("_new").isNotNull())
    sys_first = F.min_by(F.col(content), F.when(F.col(role) == "system", F.struct(turn, msg_id)))
    ctx = newest.groupBy(session).agg(
        F.nullif(sys_first, F.lit("")).alias("_sys"),
        F.sum(F.when(~F.col(role).eqNullSafe("system"), 1).otherwise(0)).cast("bigint").alias("n_context"))
    dg = _digest_of(recent, session, turn, msg_id, role, content, 40, 300)
    memo = F.concat(F.lit(D.MEMORY_PREFIX), F.col("digest"))
    return (ctx.join(dg, session, "left")
               .select(session, F.coalesce(memo, F.col("_sys"), F.lit(default_instruction)).alias("system_content"),
                       "n_context"))


def consolidate_system(msgs: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role",
                       content: str = "text") -> DataFrame:
    """AGG-7: sessions with more than one system message get them joined by
    newlines into one system message placed first (turn -1); single system
    messages stay where they are."""
    is_sys = F.coalesce(F.col(role) == "system", F.lit(False))
    merged = (msgs.filter(is_sys).groupBy(session)
                  .agg(F.array_sort(F.collect_list(F.struct(turn, content))).alias("_m"))
                  .select(session, F.when(F.size("_m") > 1, F.lit(-1).cast("bigint")).otherwise(F.col("_m")[0][turn]).alias(turn),
                          F.lit("system").alias(role),
                          F.when(F.size("_m") > 1, F.array_join(F.transform("_m", lambda x: x[content]), "\n"))
                           .otherwise(F.col("_m")[0][content]).alias(content)))
    return msgs.filter(~is_sys).select(session, turn, role, content).unionByName(merged)
