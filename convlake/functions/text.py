"""Column expressions for text: redaction, contact extraction, cleanup.

All of these are native Spark expressions (Java regex, codegen'd), so they run
inside whole-stage code generation with no Python in the hot path. Patterns
carry ``(?U)`` where the behaviour reproduced uses Unicode ``\\s \\d \\b``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D

# FIXED VALUES: redaction patterns, applied in this order.
EMAIL_MASK_RX = r"([a-zA-Z0-9._%+-]+)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
PHONE_MASK_RX = [
    r"(?U)\b(\d{3})[-.\s]?(\d{3})[-.\s]?(\d{4})\b",
    r"(?U)\((\d{3})\)\s*(\d{3})[-.\s]?(\d{4})",
    r"(?U)\b(\d{10})\b",
]
KEY_RX = [
    r"(sk-[a-zA-Z0-9]{20,})",
    r"(gsk_[a-zA-Z0-9]{20,})",
    r"(AIza[a-zA-Z0-9_-]{35})",
    r"(?U)(Bearer\s+[a-zA-Z0-9._-]{20,})",
]

# FIXED VALUES: contact extraction patterns (first match each).
EMAIL_RX = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_RX = r"(?U)(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
COMPANY_RX = r"(?iU)(?:company|business|work at|firm|org|representing)[:\s]+([A-Za-z0-9\s&.,'-]{3,40})"
NAME_RX = r"(?iU)(?:my name is|i am|i'm|this is)[:\s]+([A-Za-z\s]{2,30})"


def ustrip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends (Spark's trim only strips spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def mask_emails(c: Column) -> Column:
    # One pass: a name of three characters or more keeps its first two, a
    # shorter one keeps none (its group is then empty).
    return F.regexp_replace(
        c, r"(?:([a-zA-Z0-9._%+-]{2})[a-zA-Z0-9._%+-]+|[a-zA-Z0-9._%+-]{1,2})@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1***@$2")


# Literal every match of each key pattern contains (a cheap gate before the regex).
KEY_GATES = ["sk-", "gsk_", "AIza", "Bearer"]


def redact(c: Column) -> Column:
    """PII redaction: e-mails, then phones, then API keys. Null becomes ''.

    The e-mail and key passes only run on texts containing '@' or the key's
    literal prefix. The gates test the original column: no earlier rewrite can
    create those substrings, so gating changes no result."""
    t = F.coalesce(c, F.lit(""))
    out = F.when(F.contains(t, F.lit("@")), mask_emails(t)).otherwise(t)
    for rx in PHONE_MASK_RX:
        out = F.regexp_replace(out, rx, "$1-***-****")
    keys = out
    for rx in KEY_RX:
        keys = F.regexp_replace(keys, rx, D.REDACTED_KEY.replace("$", "\\$"))
    any_gate = reduce(lambda a, b: a | b, [F.contains(t, F.lit(g)) for g in KEY_GATES])
    return F.when(any_gate, keys).otherwise(out)


def redaction_hits(c: Column) -> dict[str, Column]:
    """Per-rule hit flags (does the rule match the text at all)."""
    t = F.coalesce(c, F.lit(""))
    return {
        "email_hit": t.rlike(EMAIL_MASK_RX),
        "phone_hit": t.rlike(PHONE_MASK_RX[0]) | t.rlike(PHONE_MASK_RX[1]),
        "key_hit": reduce(lambda a, b: a | b, [t.rlike(r) for r in KEY_RX]),
    }


def _first(c: Column, rx: str, group: int) -> Column:
    return F.nullif(ustrip(F.regexp_extract(c, rx, group)), F.lit(""))


def extract_contacts(c: Column) -> dict[str, Column]:
    """First e-mail, phone, company and name in the text; null when absent."""
    return {
        # every e-mail match contains '@': texts without one skip that regex
        "email": F.when(F.contains(c, F.lit("@")), _first(c, EMAIL_RX, 0)),
        "phone": _first(c, PHONE_RX, 0),
        "company_name": _first(c, COMPANY_RX, 1),
        "contact_name": _first(c, NAME_RX, 1),
    }


def has_contact(email: Column, phone: Column, company: Column) -> Column:
    """A message is a lead iff it holds an e-mail, a phone or a company."""
    return F.coalesce(email, phone, company).isNotNull()


def contains_any(text: Column, terms: list[str]) -> Column:
    """Substring test against a literal term array (higher-order, no join)."""
    arr = F.array(*[F.lit(t) for t in terms])
    return F.exists(arr, lambda t: F.contains(text, t))


def truncate(c: Column, n: int, keep: int, marker: str) -> Column:
    """Longer than ``n`` characters -> first ``keep`` characters + marker."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit(marker))).otherwise(c)
