"""Message filters and keyword routing (FLT-1..FLT-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions.text import contains_any
from convlake.operators.lookup import checked_broadcast


def log_messages(msgs: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """FLT-1: keep user/assistant/tool messages; missing role -> 'unknown', null content -> ''."""
    return (msgs.filter(F.col(role).isin("user", "assistant", "tool"))
                .withColumn(role, F.coalesce(F.col(role), F.lit("unknown")))
                .withColumn(content, F.coalesce(F.col(content), F.lit(""))))


def plain_text_messages(msgs: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """FLT-2: provider-safe history: system/user/assistant with non-blank text."""
    return msgs.filter(F.col(role).isin("system", "user", "assistant") & F.col(content).rlike(r"(?U)\S"))


def tag_intent(msgs: DataFrame, terms: list[str] = D.QUOTE_TERMS, text: str = "text",
               out: str = "quote_intent") -> DataFrame:
    """FLT-5: substring (not word) match of any term in the lower-cased text."""
    return msgs.withColumn(out, contains_any(F.lower(F.col(text)), terms))


def route_knowledge(msgs: DataFrame, packs: DataFrame, text: str = "text", brand: str = "brand",
                    always_brands: tuple[str, ...] = (), brand_terms: tuple[str, ...] = ()) -> DataFrame:
    """FLT-6: which knowledge pack (if any) goes with each message.

    Order: math-style prefix -> none; brands in ``always_brands`` -> their pack;
    primary terms -> pack; service or general terms -> pack. ``packs`` is a
    small (brand, pack) dimension; a brand without a pack gets none.
    """
    low = F.lower(F.col(text))
    routed = (F.when(low.rlike("(?U)" + D.MATH_PREFIX), F.lit(False))
               .when(F.col(brand).isin(*always_brands) if always_brands else F.lit(False), F.lit(True))
               .when(contains_any(low, D.PRIMARY_TERMS + list(brand_terms)), F.lit(True))
               .when(contains_any(low, D.SERVICE_TERMS + D.GENERAL_TERMS), F.lit(True))
               .otherwise(F.lit(False)))
    p = packs.select(F.col("brand").alias("_pb"), F.col("pack").alias("_pack"))
    # One row per brand: broadcast after a bounded size check (no shuffle of msgs).
    j = msgs.withColumn("_routed", routed).join(checked_broadcast(p), F.col(brand) == F.col("_pb"), "left")
    return (j.withColumn("knowledge", F.when(F.col("_routed") & (F.length(F.col("_pack")) > 0), F.col("_pack")))
             .drop("_routed", "_pb", "_pack"))


def route_tools(msgs: DataFrame, rules=D.TOOL_RULES, text: str = "text", out: str = "tools") -> DataFrame:
    """FLT-7: ordered list of tools whose terms occur in the message."""
    low = F.lower(F.col(text))
    cands = F.array(*[F.when(contains_any(low, terms), F.lit(tool)) for tool, terms in rules])
    return msgs.withColumn(out, F.filter(cands, lambda x: x.isNotNull()))


def purge_sessions(msgs: DataFrame, terms: list[str], brand_value: str, session: str = "session_id",
                   brand: str = "brand", text: str = "text") -> DataFrame:
    """FLT-8: drop every message of a ``brand_value`` session in which any message
    mentions a forbidden term.

    Plan: partial (map-side) boolean aggregation per session, then a left-anti
    join. A hot session costs one row after the partial aggregation; the anti
    join is broadcast by AQE when the flagged-session set is small and split
    by AQE skew handling otherwise.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flagged = (msgs.filter(F.col(brand) == brand_value)
                   .filter(contains_any(low, terms))
                   .select(brand, session).distinct())
    return msgs.join(flagged, [brand, session], "left_anti")


def gate_payloads(meta: DataFrame, length: str = "length", lo: int = D.PAYLOAD_MIN_BYTES,
                  hi: int = D.PAYLOAD_MAX_BYTES, out: str = "verdict") -> DataFrame:
    """FLT-9 (upload gate): too_large is tested before no_audio."""
    n = F.col(length)
    return meta.withColumn(out, F.when(n > hi, "too_large").when(n < lo, "no_audio").otherwise("ok"))


def gate_images(meta: DataFrame, status: str = "status", content_type: str = "content_type",
                length: str = "length", out: str = "verdict") -> DataFrame:
    """FLT-9 (image response gate), first failing test wins."""
    ct = F.coalesce(F.col(content_type), F.lit(""))
    return meta.withColumn(out, F.when(F.col(status) >= 500, "server_error")
                                 .when(F.col(status) != 200, "bad_status")
                                 .when(F.contains(ct, F.lit("text/html")) | F.contains(ct, F.lit("application/json")), "non_image")
                                 .when(F.col(length) < 100, "invalid_image")
                                 .otherwise("ok"))


def probe_verdict(probes: DataFrame, text: str = "text", out: str = "ok") -> DataFrame:
    """FLT-10: a probe reply is healthy if non-blank and not the high-demand apology."""
    t = F.coalesce(F.col(text), F.lit(""))
    return probes.withColumn(out, t.rlike(r"(?U)\S") & ~F.contains(t, F.lit(D.HIGH_DEMAND_PHRASE)))
