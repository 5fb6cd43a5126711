"""Lead capture jobs: extraction, contact filter, lead records, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.functions import dictionaries as D
from convlake.functions.text import extract_contacts, has_contact, redact


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_leads(df: DataFrame, text: str = "text") -> DataFrame:
    """LEAD-1: add email, phone, company_name, contact_name (first match, stripped)."""
    return df.select("*", *[c.alias(k) for k, c in extract_contacts(F.col(text)).items()])


def contact_leads(extracted: DataFrame) -> DataFrame:
    """FLT-4: keep rows with an e-mail, a phone or a company (a name alone is not a lead)."""
    return extracted.filter(has_contact(F.col("email"), F.col("phone"), F.col("company_name")))


def lead_rows(extracted: DataFrame, text: str = "text", session: Column | str = "session_id",
              client_ip: Column | str | None = None, brand: Column | str | None = None,
              detected_at: Column | str | None = None, keep: tuple[str, ...] = (),
              extra: dict[str, Column] | None = None) -> DataFrame:
    """LEAD-2: the lead record written for each contact-bearing message.

    notes = prefix + session + first 200 characters; metadata = JSON with the
    session, client ip, detection time and the first 500 characters.
    """
    t = F.col(text)
    sess = _c(session).cast("string")
    client_ip = F.lit("unknown") if client_ip is None else client_ip
    brand = F.lit(None).cast("string") if brand is None else brand
    detected_at = F.lit(None).cast("string") if detected_at is None else detected_at
    return extracted.select(
        *keep,
        "company_name", "contact_name", "email", "phone",
        F.lit(D.LEAD_STATUS).alias("status"),
        F.lit(D.LEAD_SOURCE).alias("source"),
        F.coalesce(F.nullif(_c(brand), F.lit("")), F.lit(D.DEFAULT_BRAND)).alias("brand"),
        F.concat(F.lit(D.LEAD_NOTES_PREFIX), sess, F.lit(": "), F.substring(t, 1, 200)).alias("notes"),
        F.to_json(F.struct(sess.alias("session_id"), _c(client_ip).cast("string").alias("client_ip"),
                           _c(detected_at).cast("string").alias("detected_at"),
                           F.substring(t, 1, 500).alias("raw_message"))).alias("metadata"),
        *[c.alias(k) for k, c in (extra or {}).items()],
    )


def contact_lead_report(df: DataFrame, id_col: str, text: str = "text",
                        detected_at: str = "1970-01-01T00:00:00+00:00") -> DataFrame:
    """Flagship: messages with contact details -> lead record + redacted text.

    Narrow plan: regex extraction, the contact filter and the redaction run in
    one whole-stage-codegen span per input split; no shuffle at any scale, and
    only the id and text columns are read from Parquet.
    """
    ex = contact_leads(extract_leads(df.select(id_col, text), text))
    return lead_rows(ex, text=text, session=id_col, detected_at=F.lit(detected_at),
                     keep=(id_col,), extra={"redacted_text": redact(F.col(text))})


def valid_leads(df: DataFrame, name: str = "name", email: str = "email") -> DataFrame:
    """FLT-3: a lead is valid iff name and e-mail are both non-empty (null-safe)."""
    ok = (F.coalesce(F.length(F.col(name)), F.lit(0)) > 0) & (F.coalesce(F.length(F.col(email)), F.lit(0)) > 0)
    return df.withColumn("is_valid", ok)


def with_lead_defaults(df: DataFrame, source: str = "source", brand: str = "brand") -> DataFrame:
    """FLT-11: '' and null both mean "missing" for source and brand."""
    return (df.withColumn(source, F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit(D.LEAD_SOURCE)))
              .withColumn(brand, F.coalesce(F.nullif(F.col(brand), F.lit("")), F.lit(D.DEFAULT_BRAND))))


def tool_leads(calls: DataFrame, user_info: str = "user_info", detail: str = "interest_detail",
               session: str = "session_id", brand: str = "brand") -> DataFrame:
    """LEAD-3: lead from a tool call: name = user_info or a default visitor name;
    e-mail = the whole user_info when it holds '@'; phone is never provided."""
    info = F.col(user_info)
    name = F.coalesce(F.nullif(info, F.lit("")), F.lit(D.TOOL_LEAD_NAME))
    return calls.select(
        "*",
        name.alias("company_name"),
        name.alias("contact_name"),
        F.when(F.contains(info, F.lit("@")), info).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.lit(D.LEAD_STATUS).alias("status"),
        F.lit(D.LEAD_SOURCE).alias("source"),
        F.concat(F.lit(D.TOOL_LEAD_NOTES_PREFIX), F.col(detail)).alias("notes"),
        F.to_json(F.struct(F.col(session).alias("session_id"), F.col(brand).alias("brand"))).alias("metadata"),
    )
