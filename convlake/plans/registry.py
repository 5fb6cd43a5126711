"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    ids: tuple[str, ...]  # SURVEY section 2 operator ids covered
    variant_of: str | None = None  # same operator through an alternative plan


REGISTRY: dict[str, Query] = {}


VARIANT_SUFFIXES = ("_sorted", "_dense", "_doubling", "_broadcast", "_grams")


def register(name: str, ids: tuple[str, ...] | str, oracle: str | None = None):
    ids = (ids,) if isinstance(ids, str) else tuple(ids)
    variant = next((name[: -len(s)] for s in VARIANT_SUFFIXES if name.endswith(s)), None)
    if variant and variant not in REGISTRY:  # e.g. join3_mark_cached_doubling -> join3_mark_cached_exact
        bases = [n for n in REGISTRY if n.startswith(variant)]
        variant = next((n for n in bases if n.endswith("_exact")), bases[0] if bases else variant)

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, ids, variant)
        return fn

    return deco
