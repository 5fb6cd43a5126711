"""Text jobs on documents and v_msg: redaction, contacts, lead records."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions.text import redact, redaction_hits
from convlake.operators import leads as L
from convlake.plans import duck as K
from convlake.plans.registry import register
from convlake.plans.views import duckdb_with, view

DETECTED_AT = "2024-02-01T00:00:00+00:00"


def _lead_sql(src: str, id_col: str, text: str, session: str, ip: str, brand: str, extra: str = "") -> str:
    c = K.contacts(text)
    return f"""SELECT {id_col}, company_name, contact_name, email, phone, {K.q(D.LEAD_STATUS)} AS status,
 {K.q(D.LEAD_SOURCE)} AS source, COALESCE(NULLIF({brand}, ''), {K.q(D.DEFAULT_BRAND)}) AS brand,
 CONCAT({K.q(D.LEAD_NOTES_PREFIX)}, CAST({session} AS VARCHAR), ': ', SUBSTRING({text}, 1, 200)) AS notes,
 CAST(to_json({{'session_id': CAST({session} AS VARCHAR), 'client_ip': CAST({ip} AS VARCHAR),
   'detected_at': CAST({K.q(DETECTED_AT)} AS VARCHAR), 'raw_message': SUBSTRING({text}, 1, 500)}}) AS VARCHAR) AS metadata{extra}
FROM (SELECT *, {c['email']} AS email, {c['phone']} AS phone, {c['company_name']} AS company_name,
  {c['contact_name']} AS contact_name FROM {src}) x
WHERE COALESCE(email, phone, company_name) IS NOT NULL"""


@register("lead1_contact_leads_documents", ("LEAD-1", "FLT-4", "LEAD-2", "REDACT-1"),
          oracle=duckdb_with() + _lead_sql("documents", "doc_id", "text", "doc_id", "'unknown'", "NULL",
                                           extra=f", {K.redact('text')} AS redacted_text"))
def lead1_contact_leads_documents(spark, sf):
    """Flagship: documents with contact details -> lead record + redacted text."""
    return L.contact_lead_report(view(spark, sf, "documents"), "doc_id", "text", detected_at=DETECTED_AT)


@register("lead2_lead_rows_msg", ("LEAD-1", "FLT-4", "LEAD-2"),
          oracle=duckdb_with("v_msg") + _lead_sql("v_msg", "msg_id", "text", "session_id",
                                                  "'unknown'", "brand"))
def lead2_lead_rows_msg(spark, sf):
    ex = L.contact_leads(L.extract_leads(view(spark, sf, "v_msg"), "text"))
    return L.lead_rows(ex, text="text", session="session_id", brand="brand",
                       detected_at=F.lit(DETECTED_AT), keep=("msg_id",))


@register("lead1_extract_msg", "LEAD-1", oracle=duckdb_with("v_msg") + "SELECT msg_id, " + ", ".join(
    f"{e} AS {k}" for k, e in K.contacts("text").items()) + " FROM v_msg")
def lead1_extract_msg(spark, sf):
    return L.extract_leads(view(spark, sf, "v_msg").select("msg_id", "text")).drop("text")


@register("redact1_documents", "REDACT-1",
          oracle="SELECT doc_id, " + K.redact("text") + " AS redacted FROM documents")
def redact1_documents(spark, sf):
    return view(spark, sf, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


@register("redact1_msg", "REDACT-1",
          oracle=duckdb_with("v_msg") + "SELECT msg_id, " + K.redact("text") + " AS redacted FROM v_msg")
def redact1_msg(spark, sf):
    return view(spark, sf, "v_msg").select("msg_id", redact(F.col("text")).alias("redacted"))


def _report_sql(src: str, text: str) -> str:
    from convlake.functions import text as T
    e = f"regexp_matches(COALESCE({text}, ''), {K.q(K.re2(T.EMAIL_MASK_RX))})"
    p = " OR ".join(f"regexp_matches(COALESCE({text}, ''), {K.q(K.re2(r))})" for r in T.PHONE_MASK_RX[:2])
    k = " OR ".join(f"regexp_matches(COALESCE({text}, ''), {K.q(K.re2(r))})" for r in T.KEY_RX)
    r = K.redact(text)
    return f"""SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
 CAST(SUM(CASE WHEN {e} THEN 1 ELSE 0 END) AS BIGINT) AS n_email,
 CAST(SUM(CASE WHEN {p} THEN 1 ELSE 0 END) AS BIGINT) AS n_phone,
 CAST(SUM(CASE WHEN {k} THEN 1 ELSE 0 END) AS BIGINT) AS n_key,
 CAST(SUM(CASE WHEN {r} <> COALESCE({text}, '') THEN 1 ELSE 0 END) AS BIGINT) AS n_changed
FROM {src}"""


@register("redact1_report_documents", "REDACT-1", oracle=_report_sql("documents", "text"))
def redact1_report_documents(spark, sf):
    """Per-rule hit counts; a global aggregate (partial counts per task, one tiny final merge)."""
    d = view(spark, sf, "documents").select("text")
    h = redaction_hits(F.col("text"))
    as_int = lambda b: F.when(b, 1).otherwise(0)
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(as_int(h["email_hit"])).cast("bigint").alias("n_email"),
        F.sum(as_int(h["phone_hit"])).cast("bigint").alias("n_phone"),
        F.sum(as_int(h["key_hit"])).cast("bigint").alias("n_key"),
        F.sum(as_int(redact(F.col("text")) != F.coalesce(F.col("text"), F.lit("")))).cast("bigint").alias("n_changed"),
    )
