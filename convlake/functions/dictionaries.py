"""Dictionaries and policies shipped as neutral defaults.

Operators take these as small DataFrames or frozen dataclasses, so a user
swaps terms or limits without touching code. Brand names of the original
service are not shipped: brand-specific terms are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES - these must equal the behaviour being reproduced. Kept in their
# natural order; order matters wherever the first hit wins.
# ---------------------------------------------------------------------------

# Quote intent (substring test on the lower-cased message).
QUOTE_TERMS = ["quote", "estimate", "pricing", "price", "how much", "cost", "build me",
               "create me", "make me", "need a", "want a", "get a", "interested in"]

# Knowledge routing: messages that start like a math question get no knowledge.
MATH_PREFIX = r"^(calculate|compute|solve|what is \d|how much is \d)"
# Primary routing terms (brand names removed; pass them as ``brand_terms``).
PRIMARY_TERMS = ["service", "services", "what do you", "what can you", "help with",
                 "phone", "receptionist", "call", "voice", "agent", "agents",
                 "scraper", "scraping", "poster", "posting", "website", "bot", "chatbot",
                 "contact", "email", "pricing", "quote", "cost", "audit", "lead", "leads"]
SERVICE_TERMS = ["service", "services", "what do you", "what can you", "help with", "help me",
                 "landscape", "landscaping", "garden", "maintenance", "mowing", "lawn",
                 "irrigation", "sprinkler", "hardscape", "hardscaping", "paving", "paver",
                 "patios", "patio", "tree care", "palm", "trimming", "pruning", "lighting",
                 "outdoor lighting", "design", "consultation", "quote", "estimate"]
GENERAL_TERMS = ["business", "company", "pricing", "cost", "contact", "support", "who are you",
                 "about you", "tell me about", "hours", "service area", "location"]

# Tool routing rules: (tool, terms) in output order.
TOOL_RULES = [
    ("generate_image", ["image", "picture", "photo", "draw", "logo", "icon", "design"]),
    ("send_lead_email", ["contact", "email", "message", "hire", "project", "quote", "discuss",
                         "call me"]),
]

# Provider error taxonomy, first matching rule wins. (category, kind, terms):
# kind "contains" tests the lower-cased text, kind "prefix" the raw text.
ERROR_RULES = [
    ("model_unavailable", "contains", ["does not exist", "no longer available", "notfound", " 404"]),
    ("rate_limited", "contains", ["429", "quota", "ratelimit"]),
    ("timeout", "contains", ["timeout", "timed out"]),
    ("auth_error", "contains", ["401", "403", "api key", "authentication"]),
    ("empty_response", "prefix", ["empty response"]),
]
ERROR_DEFAULT = "other_error"

# Image-provider variant of the taxonomy.
IMAGE_ERROR_RULES = [
    ("FORCE_FALLBACK", "contains", ["429", "quota", "resource_exhausted", "modality", "modalities"]),
    ("temporary", "contains", ["503", "500", "timeout"]),
]
IMAGE_ERROR_DEFAULT = "other"

# Location phrases tried before the gazetteer scan (lower-cased text).
LOCATION_PHRASES = [
    r"i('m| am) (in|from|located in|based in) ([a-z\s,]+)",
    r"my (business|company|shop|store) is in ([a-z\s,]+)",
    r"here in ([a-z\s,]+)",
    r"(in|around|near) ([a-z]+),?\s*(fl|florida)?",
]

# Sample gazetteer: region key -> (region label, cities); then out-of-area states.
GAZETTEER_REGIONS = [
    ("north shore", "North Shore", ["springfield", "riverton"]),
    ("south shore", "South Shore", ["lakeside", "hill"]),
]
GAZETTEER_STATE = "Homeland"
GAZETTEER_OTHER_STATES = [("westland", "Westland")]

# Payload gate limits (bytes).
PAYLOAD_MIN_BYTES = 1000
PAYLOAD_MAX_BYTES = 25 * 1024 * 1024

# Lead record constants.
LEAD_STATUS = "inbound_chat"
LEAD_SOURCE = "website_chat"
LEAD_NOTES_PREFIX = "User dropped contact details in chat session "
TOOL_LEAD_NAME = "Website Visitor"
TOOL_LEAD_NOTES_PREFIX = "Lead inquiry: "
TRUNCATION_MARKER = "... [TRUNCATED DUE TO SIZE] ..."
HIGH_DEMAND_PHRASE = "high demand"
REDACTED_KEY = "[REDACTED_API_KEY]"
DIGEST_PREFIX = "[History: "
MEMORY_PREFIX = "Memory of previous talk: "

# ---------------------------------------------------------------------------
# Neutral defaults (not fixed by the reproduced behaviour).
# ---------------------------------------------------------------------------
DEFAULT_BRAND = "default"
DEFAULT_INSTRUCTION = "You are a helpful assistant."


@dataclass(frozen=True)
class RequestPolicy:
    """Admission-control limits (seconds / counts)."""
    ip_short_window: int = 60
    ip_short_limit: int = 12
    ip_long_window: int = 600
    ip_long_limit: int = 40
    session_cooldown: int = 3
    session_total: int = 50
    session_idle: int = 3600
    cache_ttl: int = 600


@dataclass(frozen=True)
class RetentionPolicy:
    idle_ttl: int = 3600
    max_sessions: int = 200
    max_cache_entries: int = 500
    dead_model_ttl: int = 6 * 3600
    image_quota_per_hour: int = 15
    image_cache_ttl: int = 24 * 3600
    probe_ttl: int = 240


def gazetteer_rows(regions=GAZETTEER_REGIONS, state=GAZETTEER_STATE,
                   other_states=GAZETTEER_OTHER_STATES):
    """Flatten the default gazetteer to (priority, kind, term, city, region, state).

    Priority follows the scan order: per region its key, its label, then its
    cities; after all regions the out-of-area states.
    """
    rows, p = [], 0
    for key, label, cities in regions:
        for term in (key, label.lower()):
            rows.append((p, "region", term, None, label, state)); p += 1
        for c in cities:
            rows.append((p, "city", c, c.title(), label, state)); p += 1
    for key, name in other_states:
        rows.append((p, "state", key, None, name, name)); p += 1
    return rows
