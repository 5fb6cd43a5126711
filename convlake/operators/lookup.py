"""Dimension lookups with defaults (JOIN-2), lead/session link (JOIN-6),
lead union (SET-1) and system-prompt assembly (SCL-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake import schemas as S
from convlake.functions import dictionaries as D

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def checked_broadcast(dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only when one bounded read proves the dimension small in
    rows and bytes; otherwise the planner keeps a shuffle join."""
    row_bytes = F.octet_length(F.to_json(F.struct(*dim.columns)))
    size = dim.select(row_bytes.alias("b")).limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(dim) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else dim


def lookup(df: DataFrame, dim: DataFrame, key: Column | str, dim_key: str, value: str, default: Column | str,
           out: str | None = None) -> DataFrame:
    """JOIN-2: left join against a dimension, missing -> default."""
    k = F.col(key) if isinstance(key, str) else key
    d = checked_broadcast(dim.select(F.col(dim_key).alias("_dk"), F.col(value).alias("_dv")))
    dflt = F.col(default) if isinstance(default, str) and default in df.columns else (
        default if isinstance(default, Column) else F.lit(default))
    j = df.join(d, k == F.col("_dk"), "left")
    return j.withColumn(out or value, F.coalesce(F.col("_dv"), dflt)).drop("_dk", "_dv")


def voice_id(df: DataFrame, voices: DataFrame, voice: str, default_voice: str, out: str = "voice_id") -> DataFrame:
    """JOIN-2 (voices): unknown names pass through as ids; ids shorter than five
    characters fall back to the default voice."""
    j = lookup(df, voices, F.lower(F.col(voice)), "name", "voice_id", F.col(voice), out)
    return j.withColumn(out, F.when(F.coalesce(F.length(out), F.lit(0)) < 5, F.lit(default_voice)).otherwise(F.col(out)))


def mime_for(df: DataFrame, mimes: DataFrame, filename: str, content_type: str, fallback: str = "audio/webm",
             out: str = "mime") -> DataFrame:
    """JOIN-2 (mime): suffix (default '.webm') -> mime; unknown suffix -> the
    upload's content type, else ``fallback``."""
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col(filename), r"(\.[^./]*)$", 1)), F.lit("")),
                        F.lit(".webm"))
    dflt = F.coalesce(F.nullif(F.col(content_type), F.lit("")), F.lit(fallback))
    return lookup(df.withColumn("_suffix", suffix), mimes, "_suffix", "suffix", "mime", dflt, out).drop("_suffix")


def leads_with_session(leads: DataFrame, sessions: DataFrame, metadata: str = "metadata") -> DataFrame:
    """JOIN-6: decode the lead metadata and attach the session it came from
    (equi left join; sort-merge at scale, AQE splits a hot session)."""
    sid = F.from_json(F.col(metadata), S.LEAD_METADATA)["session_id"]
    return leads.withColumn("session_id", sid).join(sessions, "session_id", "left")


def union_leads(form: DataFrame, auto: DataFrame, tool: DataFrame) -> DataFrame:
    """SET-1: the three capture paths in one table (UNION ALL, no de-dup),
    tagged with their path; missing columns become null."""
    tag = lambda d, p: d.withColumn("capture_path", F.lit(p))
    return (tag(form, "form").unionByName(tag(auto, "auto"), allowMissingColumns=True)
                             .unionByName(tag(tool, "tool"), allowMissingColumns=True))


# FIXED VALUES: sentence formats of the location context.
LOC_CITY = "The user is located in {city}, {region}. Tailor your advice for businesses in the {city}/{region} area."
LOC_REGION = "The user is in {region}. Provide locally relevant advice for businesses in {region}."
LOC_STATE = "The user is in {state}. Adjust your recommendations for that market."
LOC_DEFAULT = "When discussing local business strategies, you may reference {home} as the home region for {company}."
KNOWLEDGE_HEADER = "CONTEXT FROM BUSINESS KNOWLEDGE PACK:\n"


def _fmt(template: str, **cols: Column) -> Column:
    parts, rest = [], template
    while "{" in rest:
        pre, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        parts += [F.lit(pre), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def location_sentence(city: Column, region: Column, state: Column, home: str, company: str) -> Column:
    detected = city.isNotNull() | region.isNotNull() | state.isNotNull()
    return (F.when(detected & city.isNotNull(), _fmt(LOC_CITY, city=city, region=F.coalesce(region, F.lit("None"))))
             .when(detected & region.isNotNull(), _fmt(LOC_REGION, region=region))
             .when(detected & state.isNotNull(), _fmt(LOC_STATE, state=state))
             .otherwise(F.lit(LOC_DEFAULT.format(home=home, company=company))))


def build_prompts(msgs: DataFrame, instruction: str = D.DEFAULT_INSTRUCTION, home: str = "Global",
                  company: str = "our company", city: str = "city_now", region: str = "region_now",
                  state: str = "state_now", knowledge: str = "knowledge") -> DataFrame:
    """SCL-12: system prompt = instruction + location sentence (+ knowledge pack)."""
    base = F.concat(F.lit(instruction + "\n\n"), location_sentence(F.col(city), F.col(region), F.col(state), home, company))
    kb = F.col(knowledge)
    prompt = F.when(F.coalesce(F.length(kb), F.lit(0)) > 0, F.concat(base, F.lit("\n\n" + KNOWLEDGE_HEADER), kb)).otherwise(base)
    return msgs.withColumn("system_prompt", prompt)
