"""Data model: stage vocabulary, export layout, column allow-lists, schemas.

Values marked FIXED must equal the reference's for results to agree.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------
# Stages, in pipeline order; 'skipped' is a terminal side state.
STAGES = ["sourced", "qualified", "email_enriched", "phone_enriched", "skipped"]
# Stages that may be used as an export / query minimum.
MIN_STAGES = ["sourced", "qualified", "email_enriched", "phone_enriched"]
# Stage -> the timestamp column stamped the first time a contact reaches it.
STAGE_TIMESTAMP = {
    "sourced": "sourced_at",
    "qualified": "qualified_at",
    "email_enriched": "email_enriched_at",
    "phone_enriched": "phone_enriched_at",
}
# Export columns, in output order.
EXPORT_COLUMNS = [
    "first_name", "last_name", "full_name", "title", "seniority",
    "company_name", "company_domain", "linkedin_url", "country", "location",
    "email", "phone", "phone_type", "source", "matched_persona",
    "qualification_score",
]
# Fields an advance_stage update may set; anything else is ignored.
ADVANCE_TEXT_COLS = [
    "first_name", "last_name", "full_name", "title", "seniority", "department",
    "company_name", "company_domain", "linkedin_url", "country", "location",
    "source", "db_status", "qualification_status", "matched_persona",
    "company_segment", "qualification_notes", "enrich_recommended",
    "email", "email_source", "email_validation", "email_waterfall_log",
    "phone", "phone_type", "phone_source", "phone_validation", "phone_waterfall_log",
]
ADVANCE_NUM_COLS = ["lead_quality_score", "qualification_score"]
ADVANCE_JSON_COLS = ["provider_ids"]
# ---------------------------------------------------------------------------

# Rank used by the minimum-stage gate (skipped has no rank and never passes).
STAGE_RANK = {s: i for i, s in enumerate(MIN_STAGES)}

ADVANCE_COLS = ADVANCE_TEXT_COLS + ADVANCE_NUM_COLS + ADVANCE_JSON_COLS

CONTACT_SCHEMA = T.StructType([
    T.StructField("list_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("stage", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ADVANCE_TEXT_COLS],
    T.StructField("linkedin_url_normalized", T.StringType()),
    T.StructField("lead_quality_score", T.DecimalType(10, 2)),
    T.StructField("qualification_score", T.IntegerType()),
    T.StructField("provider_ids", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sourced_at", T.TimestampNTZType()),
    T.StructField("qualified_at", T.TimestampNTZType()),
    T.StructField("email_enriched_at", T.TimestampNTZType()),
    T.StructField("phone_enriched_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

COMPANY_SCHEMA = T.StructType([
    T.StructField("list_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("company_domain", T.StringType()),
    T.StructField("company_domain_normalized", T.StringType()),
    T.StructField("linkedin_url", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("discovery_reason", T.StringType()),
    T.StructField("db_status", T.StringType()),
    T.StructField("estimated_employees", T.StringType()),
    T.StructField("intel", T.MapType(T.StringType(), T.StringType())),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("verified", T.BooleanType()),
    T.StructField("enriched", T.BooleanType()),
    T.StructField("enriched_at", T.TimestampNTZType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

MASTER_SCHEMA = T.StructType([
    T.StructField("contact_id", T.LongType()),
    T.StructField("linkedin_url", T.StringType()),
    T.StructField("linkedin_url_normalized", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("company_name", T.StringType()),
    T.StructField("overall_status", T.StringType()),
    T.StructField("total_campaigns", T.IntegerType()),
    T.StructField("has_replied", T.BooleanType()),
    T.StructField("has_bounced", T.BooleanType()),
    T.StructField("has_unsubscribed", T.BooleanType()),
    T.StructField("first_contacted_at", T.TimestampNTZType()),
    T.StructField("last_contacted_at", T.TimestampNTZType()),
])


def conform(df, schema: T.StructType, keep_extra: bool = True):
    """Add missing schema columns as typed NULLs and cast present ones."""
    from pyspark.sql import functions as F

    # One projection: a plan analysed once, however many columns the schema has.
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    cols = [F.col(f"`{c}`").try_cast(want[c]).alias(c) if c in want and want[c] != t else F.col(f"`{c}`")
            for c, t in have.items() if keep_extra or c in want]
    cols += [F.lit(None).cast(t).alias(c) for c, t in want.items() if c not in have]
    return df.select(*cols) if keep_extra else df.select(*cols).select(*want)
