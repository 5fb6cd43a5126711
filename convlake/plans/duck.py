"""DuckDB (RE2) renderings of the column expressions, for oracle SQL.

RE2 has no look-behind, no back-references and no ``(?U)`` Unicode switch
(in RE2 ``(?U)`` means ungreedy), so patterns are rewritten here: the Unicode
switch is dropped and ``\\1``-style replacement references are used.
"""

from __future__ import annotations

from convlake.functions import dictionaries as D
from convlake.functions import text as T

# Private-use characters that confine the oracle's e-mail mask to one match.
MARK_OPEN, MARK_CLOSE = "\uE000", "\uE001"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(rx: str) -> str:
    return rx.replace("(?iU)", "(?i)").replace("(?U)", "")


def rep(repl: str) -> str:
    """Java ``$1`` replacement -> RE2 ``\\1``."""
    import re
    return re.sub(r"\$(\d)", r"\\\1", repl)


def mark(s: str) -> str:
    """Literal containing the marker characters, as a SQL expression."""
    parts = []
    buf = ""
    for ch in s:
        if ch in (MARK_OPEN, MARK_CLOSE):
            if buf:
                parts.append(q(buf)); buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        parts.append(q(buf))
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def rx_replace(expr: str, rx: str, repl: str) -> str:
    return f"regexp_replace({expr}, {mark(re2(rx))}, {mark(rep(repl))}, 'g')"


def redact(expr: str) -> str:
    o, c = MARK_OPEN, MARK_CLOSE
    out = f"COALESCE({expr}, '')"
    out = rx_replace(out, T.EMAIL_MASK_RX, o + "$1" + c + "@$2")
    out = rx_replace(out, o + "([^" + c + "]{2})[^" + c + "]+" + c, "$1***")
    out = rx_replace(out, o + "[^" + c + "]{1,2}" + c, "***")
    for rx in T.PHONE_MASK_RX:
        out = rx_replace(out, rx, "$1-***-****")
    for rx in T.KEY_RX:
        out = rx_replace(out, rx, D.REDACTED_KEY)
    return out


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def first(expr: str, rx: str, group: int) -> str:
    return f"NULLIF({ustrip(f'regexp_extract({expr}, {q(re2(rx))}, {group})')}, '')"


def contacts(expr: str) -> dict[str, str]:
    return {
        "email": first(expr, T.EMAIL_RX, 0),
        "phone": first(expr, T.PHONE_RX, 0),
        "company_name": first(expr, T.COMPANY_RX, 1),
        "contact_name": first(expr, T.NAME_RX, 1),
    }


def contains_any(expr: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(t)})" for t in terms) + ")"


def re2_flags(rx: str) -> str:
    """Java flag groups -> RE2: drop (?U) and (?d); keep (?m)/(?i)/(?s)."""
    for a, b in (("(?U)(?md)", "(?m)"), ("(?iU)", "(?i)"), ("(?md)", "(?m)"), ("(?U)", "")):
        rx = rx.replace(a, b)
    return rx


def apply_rules(expr: str, rules) -> str:
    for rx, r in rules:
        expr = f"regexp_replace({expr}, {q(re2_flags(rx))}, {q(rep(r))}, 'g')"
    return expr


def classify(expr: str, rules, default: str) -> str:
    parts = []
    for cat, kind, terms in rules:
        if kind == "contains":
            cond = " OR ".join(f"contains(lower({expr}), {q(t)})" for t in terms)
        else:
            cond = " OR ".join(f"starts_with({expr}, {q(t)})" for t in terms)
        parts.append(f"WHEN {cond} THEN {q(cat)}")
    return f"CASE WHEN {expr} IS NULL THEN NULL " + " ".join(parts) + f" ELSE {q(default)} END"
