"""Markdown-to-speech and transcript cleanup as chained regex expressions.

``(?U)`` gives Python/JS-like Unicode ``\\s``; ``(?d)`` makes ``^`` in
multi-line mode match only after ``\\n`` as in Python and JS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: cleanup rules, applied in the listed order.
VOICE_RULES = [
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),          # links -> anchor text
    (r"!\[[^\]]*\]\([^)]+\)", ""),             # images (never fires after the link rule)
    (r"```[\s\S]*?```", ""),                   # code fences
    (r"`([^`]+)`", "$1"),                      # inline code
    (r"(?U)(?md)^#+\s*", ""),                  # headings
    (r"(?U)(?md)^\s*[-*+]\s+", ""),            # bullets
    (r"[*_~]{1,3}([^*_~]+)[*_~]{1,3}", "$1"),  # emphasis
    (r"(?U)https?://\S+", ""),                 # raw URLs
    (r"(?U)\((\d{3})\)\s*(\d{3})-(\d{4})", "$1, $2, $3"),
    (r"(?U)(\d{3})-(\d{3})-(\d{4})", "$1, $2, $3"),
    (r"\n{2,}", ". "),
    (r"\n", " "),
    (r"(?U)\s+", " "),
]
VOICE_CAP, VOICE_CAP_SUFFIX = 5000, "..."

WEB_RULES = [
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"(?U)https?://\S+", ""),
    (r"(?U)(?md)^#+\s*", ""),
    (r"(?U)(?md)^\s*[-*+]\s+", ""),
    (r"[*_~]{1,3}([^*_~]+)[*_~]{1,3}", "$1"),
    (r"\(([0-9]{3})\)(?U)\s*([0-9]{3})-([0-9]{4})", "$1, $2, $3"),
    (r"([0-9]{3})-([0-9]{3})-([0-9]{4})", "$1, $2, $3"),
    (r"\n+", " "),
    (r"(?U)\s+", " "),
]
WEB_CAP = 3500

# JS ``\b`` is an ASCII word boundary; it is spelled with look-arounds so it
# does not depend on the JVM's Unicode defaults, reduced to the one side that
# can hold next to the token ([a-zA-Z0-9'] starts and ends every phrase).
# Possessive quantifiers cannot change a match here (the next token never
# matches a word character) and avoid useless backtracking.
_W = "[A-Za-z0-9_]"
_B_START = rf"(?:(?<!{_W})(?=[A-Za-z0-9])|(?<={_W})(?='))"
_B_END = rf"(?:(?<=[A-Za-z0-9])(?!{_W})|(?<=')(?={_W}))"
TRANSCRIPT_RULES = [
    (r"(?U)\s+", " "),
    (r"(?U)^\s+|\s+$", ""),
    (rf"(?i){_B_START}((?:[a-zA-Z0-9']++\s++){{1,5}}[a-zA-Z0-9']++)\s+\1{_B_END}", "$1"),
    (rf"(?i){_B_START}([a-zA-Z0-9']++)\s+\1{_B_END}", "$1"),
    (rf"(?i){_B_START}([a-zA-Z0-9']++)\s+\1{_B_END}", "$1"),
]
# Slip corrections (literal first, so the matcher skips quickly).
SLIP_RULES = [
    (rf"(?i)(?<!{_W})what\s+us\s+the(?!{_W})", "what is the"),
    (rf"(?i)(?<!{_W})what\s+us(?!{_W})", "what is"),
]


def apply_rules(c: Column, rules) -> Column:
    for rx, rep in rules:
        c = F.regexp_replace(c, rx, rep)
    return c


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_markdown(c: Column, variant: str = "voice") -> Column:
    """SCL-1: markdown -> plain speech text. ``variant`` 'voice' (server) or 'web' (browser)."""
    if variant == "voice":
        t = ustrip(apply_rules(c, VOICE_RULES))
        return F.when(F.length(t) > VOICE_CAP,
                      F.concat(F.substring(t, 1, VOICE_CAP), F.lit(VOICE_CAP_SUFFIX))).otherwise(t)
    if variant == "web":
        t = ustrip(apply_rules(c, WEB_RULES))
        return F.when(F.length(t) > WEB_CAP, ustrip(F.substring(t, 1, WEB_CAP))).otherwise(t)
    raise ValueError(variant)


def clean_transcript(c: Column) -> Column:
    """SCL-2: collapse whitespace and stuttered phrases/words, fix two slips."""
    return F.coalesce(apply_rules(c, TRANSCRIPT_RULES + SLIP_RULES), F.lit(""))
