"""Tool-call recovery and argument parsing (SCL-7, SCL-8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions.cleanup import ustrip

# FIXED VALUE: text-embedded image tool call; non-greedy, so nested objects fail.
TOOL_CALL_RX = r"(?s)generate_image\s*\(?(\{.*?\})\)?"
JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def strip_fence(s: Column) -> Column:
    """Drop a ```json / ``` fence around the JSON text, as a split would."""
    after_json = F.element_at(F.split(s, "```json", 2), 2)
    after_plain = F.element_at(F.split(s, "```", 3), 2)
    inner_json = F.element_at(F.split(after_json, "```", 2), 1)
    return (F.when(F.contains(s, F.lit("```json")), ustrip(inner_json))
             .when(F.contains(s, F.lit("```")), ustrip(after_plain))
             .otherwise(s))


def parse_args(s: Column) -> Column:
    """JSON object text -> MAP<STRING,STRING>; invalid JSON -> null."""
    return F.from_json(s, "map<string,string>", JSON_OPTS)


def recovered_call(text: Column) -> Column:
    """SCL-7: arguments map of the first text-embedded call, null if none/invalid."""
    raw = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), TOOL_CALL_RX, 1), F.lit(""))
    return parse_args(strip_fence(raw))


def tool_args(arguments: Column) -> Column:
    """SCL-8: tool arguments, invalid JSON -> empty map."""
    return F.coalesce(parse_args(arguments), F.create_map().cast("map<string,string>"))
