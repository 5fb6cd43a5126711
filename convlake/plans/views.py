"""Derived fixture views (FIXTURES.md section 3).

The driver tables carry little chat signal (no e-mails in conversations, no
places, long request gaps), so the query registry runs on views derived from
them. Each view is one SQL text (``str.format`` placeholders, so literal braces
are doubled) shared by Spark (``spark.sql`` with DataFrame
arguments) and by the DuckDB oracle (a ``WITH`` clause), so both sides see the
same rows. Every view is a projection or join of the whole base tables, so its
size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convlake.sources.tables import load_table, spread

# Tables whose per-row work is regex-heavy text processing.
CPU_HEAVY = {"documents", "pages"}

VIEW_SQL: dict[str, str] = {
    "v_msg": """
SELECT c_custkey AS msg_id, CONCAT('s', CAST(c_custkey % 100 AS VARCHAR(20))) AS session_id, c_custkey AS turn,
 CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE 'a' END AS brand,
 CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
 CASE c_custkey % 9
  WHEN 0 THEN CONCAT('Hello, my name is ', n_name, '. Please send a quote')
  WHEN 1 THEN CONCAT('write to u', CAST(c_custkey AS VARCHAR(20)), '.x@mail', CAST(c_custkey % 10 AS VARCHAR(20)), '.example.com please')
  WHEN 2 THEN CONCAT('call (305) 555-', LPAD(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0'), ' today')
  WHEN 3 THEN CONCAT('I work at: ', c_mktsegment, ' Supply')
  WHEN 4 THEN CONCAT('we are based in ', LOWER(n_name), ' and need help with design')
  WHEN 5 THEN CONCAT('# Title ', c_name, ' **bold** see [docs](https://x.example.com/a) `code`')
  WHEN 6 THEN CONCAT('calculate ', CAST(c_custkey AS VARCHAR(20)), ' plus 2')
  WHEN 7 THEN CONCAT('generate_image({{"prompt": "', LOWER(c_mktsegment), '"}})')
  ELSE CONCAT('token sk-abcdefghijklmnopqrst', CAST(c_custkey AS VARCHAR(20)), ' end') END AS text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_req": """
SELECT event_id AS req_id, CONCAT('10.0.0.', CAST(user_id % 40 AS VARCHAR(20))) AS ip, CONCAT('s', CAST(user_id AS VARCHAR(20))) AS session_id,
 CASE WHEN user_id % 3 = 0 THEN 'b' ELSE 'a' END AS brand, CONCAT('q', CAST(event_id % 7 AS VARCHAR(20))) AS message, event_id % 2 AS is_stream, ts FROM {events}""",
    "v_attempt": """
SELECT event_id AS attempt_id, CAST(FLOOR(event_id / 4) AS BIGINT) AS request_id, event_id % 4 AS attempt_no, CONCAT('m', CAST(user_id % 5 AS VARCHAR(20))) AS model, ts,
 CASE WHEN event_type <> 'error' THEN NULL ELSE CASE user_id % 6 WHEN 0 THEN 'model does not exist' WHEN 1 THEN 'HTTP 429 "retryDelay": "17s"' WHEN 2 THEN 'Request timed out'
 WHEN 3 THEN '401 bad API key' WHEN 4 THEN 'empty response (no text returned)' ELSE 'boom' END END AS error FROM {events}""",
    "v_lead": """
SELECT msg_id AS lead_id, session_id, brand, CASE WHEN msg_id % 9 = 1 THEN 'website_chat' ELSE NULL END AS source, CONCAT('10.0.1.', CAST(msg_id % 30 AS VARCHAR(20))) AS ip_address,
 CASE WHEN msg_id % 4 = 0 THEN '' ELSE CONCAT('n', CAST(msg_id AS VARCHAR(20))) END AS name, CASE WHEN msg_id % 5 = 0 THEN NULL ELSE CONCAT('u', CAST(msg_id AS VARCHAR(20)), '@example.com') END AS email FROM {v_msg}""",
    "v_turn": """
SELECT conv_id, turn, role, text, CAST(conv_id * 100000 + turn AS BIGINT) AS seq, SUBSTRING(text, 1, 200) AS head FROM {conversations}""",
    # Conversations in which every message rule has something to do.
    "v_chat": """
SELECT CAST(conv_id * 100000 + turn AS BIGINT) AS msg_id, CONCAT('c', CAST(CAST(FLOOR(conv_id / 3) AS BIGINT) AS VARCHAR(20))) AS session_id, turn,
 CASE (conv_id + 3 * turn) % 9 WHEN 1 THEN 'system' WHEN 2 THEN 'tool' WHEN 3 THEN 'function' WHEN 4 THEN NULL WHEN 5 THEN 'assistant' ELSE role END AS role,
 CASE conv_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'make_audio' WHEN 2 THEN '' ELSE NULL END AS name,
 CASE (7 * conv_id + 5 * turn) % 14
  WHEN 0 THEN NULL
  WHEN 1 THEN ''
  WHEN 2 THEN CONCAT(' ', chr(9), chr(10))
  WHEN 3 THEN 'Sorry, we are experiencing high demand, try again'
  WHEN 4 THEN CONCAT('generate_image({{"prompt": "a ', CAST(conv_id AS VARCHAR(20)), '", "size": "1:1"}})')
  WHEN 5 THEN 'generate_image({{"prompt": {{"a": 1}}, "size": "1:1"}})'
  WHEN 6 THEN 'Sure: generate_image({{ ```json {{"prompt": "fenced"}} ``` }})'
  WHEN 7 THEN 'generate_image {{ ``` {{"prompt": "plain fence", "n": 3}} ``` }}'
  WHEN 8 THEN 'generate_image{{"prompt": oops}}'
  WHEN 9 THEN CONCAT('generate_image {{"prompt": "first",', chr(10), ' "tags": [1, 2]}} generate_image{{"prompt": "second"}}')
  WHEN 10 THEN CONCAT('generate_image', chr(10), '({{}})')
  ELSE text END AS text FROM {conversations}""",
    # Gazetteer for location tagging: per region its name, then its nations.
    "v_gaz": """
SELECT CAST(r_regionkey * 1000 AS INT) AS priority, 'region' AS kind, LOWER(r_name) AS term,
 CAST(NULL AS VARCHAR(20)) AS city, r_name AS region, 'EARTH' AS state FROM {region}
UNION ALL
SELECT CAST(n_regionkey * 1000 + 1 + n_nationkey AS INT) AS priority, 'city' AS kind, LOWER(n_name) AS term,
 n_name AS city, r_name AS region, 'EARTH' AS state FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
}

# Inputs of each view: base tables or other views.
VIEW_DEPS: dict[str, tuple[str, ...]] = {
    "v_msg": ("customer", "nation"),
    "v_req": ("events",),
    "v_attempt": ("events",),
    "v_lead": ("v_msg",),
    "v_turn": ("conversations",),
    "v_chat": ("conversations",),
    "v_gaz": ("nation", "region"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view (or base table) as a Spark DataFrame."""
    if name not in VIEW_SQL:
        t = load_table(spark, sf_dir, name)
        return spread(t) if name in CPU_HEAVY else t
    args = {dep: view(spark, sf_dir, dep) for dep in VIEW_DEPS[name]}
    return spark.sql(VIEW_SQL[name], **args)


def duckdb_with(*names: str) -> str:
    """``WITH`` prefix defining the named views for the DuckDB oracle."""
    order: list[str] = []

    def add(n: str) -> None:
        if n not in VIEW_SQL or n in order:
            return
        for dep in VIEW_DEPS[n]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    if not order:
        return ""
    parts = []
    for n in order:
        body = VIEW_SQL[n].format(**{d: d for d in VIEW_DEPS[n]})
        parts.append(f"{n} AS ({body}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
