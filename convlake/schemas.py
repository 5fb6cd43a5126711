"""Record shapes (FIXTURES.md section 1) as Spark DDL strings."""

TOOL_CALL = "STRUCT<id: STRING, function: STRUCT<name: STRING, arguments: STRING>>"
MESSAGE = (f"STRUCT<role: STRING, content: STRING, name: STRING, tool_call_id: STRING, "
           f"tool_calls: ARRAY<{TOOL_CALL}>>")
HISTORY = f"ARRAY<{MESSAGE}>"
LOG_MESSAGE = "STRUCT<role: STRING, content: STRING>"
LOCATION = "STRUCT<city: STRING, region: STRING, state: STRING>"
CONVERSATION_LOG = (f"session_id STRING, timestamp STRING, messages ARRAY<{LOG_MESSAGE}>, "
                    f"location {LOCATION}, tools_used ARRAY<STRING>")
SESSIONS = "session_id STRING, title STRING, history STRING, updated_at TIMESTAMP_NTZ"
LEAD = ("company_name STRING, contact_name STRING, email STRING, phone STRING, status STRING, source STRING, "
        "brand STRING, notes STRING, metadata STRING, created_at TIMESTAMP_NTZ")
LEAD_REMOTE = f"id BIGINT, {LEAD}, updated_at TIMESTAMP_NTZ"
LEAD_LOCAL = ("id BIGINT, name STRING, phone STRING, email STRING, service STRING, best_time STRING, details STRING, "
              "ip_address STRING, timestamp TIMESTAMP_NTZ")
LEAD_CSV = ("timestamp STRING, name STRING, phone STRING, email STRING, service STRING, best_time STRING, "
            "details STRING, ip_address STRING")
LEAD_METADATA = "STRUCT<session_id: STRING, client_ip: STRING, detected_at: STRING, raw_message: STRING>"
SSE_EVENT = "type STRING, content STRING, response STRING, session_id STRING, image_url STRING"
CHAT_REQUEST = ("req_id BIGINT, ts TIMESTAMP_NTZ, ip STRING, session_id STRING, brand STRING, message STRING, "
                "is_stream BIGINT")
