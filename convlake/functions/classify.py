"""Rule-table classifiers and small keyed expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D


def classify_error(err: Column, rules=D.ERROR_RULES, default: str = D.ERROR_DEFAULT) -> Column:
    """SCL-5: first matching rule wins; substring tests on the lower-cased text,
    prefix rules on the raw text. Null error -> null category."""
    low = F.lower(err)
    out = None
    for cat, kind, terms in rules:
        if kind == "contains":
            cond = None
            for t in terms:
                c = F.contains(low, F.lit(t))
                cond = c if cond is None else (cond | c)
        else:
            cond = None
            for t in terms:
                c = F.startswith(err, F.lit(t))
                cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return F.when(err.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(default)))


# FIXED VALUES: retry-hint patterns, tried in this order.
RETRY_RX = [r'(?U)retryDelay"\s*:\s*"(\d+)s"', r"(?U)retryDelay:\s*(\d+)s"]
QUOTA_TERMS = ["429", "quota", "limit"]


def retry_hint(err: Column) -> Column:
    """SCL-6: seconds the provider asked to wait, or null."""
    hits = [F.nullif(F.regexp_extract(err, rx, 1), F.lit("")) for rx in RETRY_RX]
    return F.coalesce(*hits).cast("bigint")


def is_quota_error(err: Column) -> Column:
    low = F.lower(err)
    return F.contains(err, F.lit("429")) | F.contains(low, F.lit("quota")) | F.contains(low, F.lit("limit"))


def planned_wait(retry_no: Column, jitter: float, base: float = 2.0, cap: float = 60.0) -> Column:
    """min(base * 2^n + jitter, cap); jitter is a parameter (not a clock)."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), retry_no.cast("double")) + F.lit(jitter), F.lit(cap))


def resolve_brand(param: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """SCL-9: explicit value matched by ordered substring rules, else the default.
    Blank/null values fall through to the default, like a falsy value."""
    b = F.lower(F.trim(param))
    out = None
    for brand, terms in rules:
        cond = None
        for t in terms:
            c = F.contains(b, F.lit(t))
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(brand)) if out is None else out.when(cond, F.lit(brand))
    given = param.isNotNull() & (F.length(param) > 0)
    return F.when(given, out.otherwise(F.lit(default))).otherwise(F.lit(default))


def resolve_brand_web(param: Column, other_terms: list[str], other: str, default: str) -> Column:
    """SCL-9 (browser variant): any given value that does not name the other
    brand resolves to the default brand (no second rule)."""
    return resolve_brand(param, [(other, other_terms)], default)


def brand_or_default(brand: Column) -> Column:
    """A request without a brand belongs to the default brand."""
    return F.coalesce(F.nullif(brand, F.lit("")), F.lit(D.DEFAULT_BRAND))


def session_key(brand: Column, session_id: Column) -> Column:
    """SCL-10: brand-namespaced key, unless the id already carries the prefix."""
    prefix = F.concat(brand, F.lit("_"))
    return F.when(F.startswith(session_id, prefix), session_id).otherwise(F.concat(prefix, session_id))


def session_title(title: Column, session_id: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Chat "), F.substring(session_id, 1, 8)))


def content_key(prompt: Column, ratio: Column) -> Column:
    """SCL-11: first 16 hex chars of SHA-256('prompt|ratio')."""
    return F.substring(F.sha2(F.concat(prompt, F.lit("|"), ratio), 256), 1, 16)
