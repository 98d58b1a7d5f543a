"""Registered queries.

Each entry maps a name to ``(build(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
The oracle is DuckDB SQL over the same parquet tables (views named after the
tables); it is written independently of the Spark code and recomputes the
semantics directly (window functions, CTEs), so agreement is a real check.

Sections (in file order):
  shared derivations (contacts, lists) · minimum slice (N1 N4 W1 J1 A5 T1 F1 F3 O1 A1 J9 T4 U1)
  · companies (N2 N3 J2 N20 N21 F2 A12) · sources and sinks (S1 S2 S4 S5 S6)
  · payloads (S3 N15–N19) · scalar vocabularies (N5–N14 N22)
  · joins and filters (A13 J3 F11 J4–J8 J12 F10 J13–J15 F4 F9)
  · enrichment (W3 J11 N23 T2 W4 A10 W5 W6 W9 F5 F6 J10 A6 A7 A14)
  · qualification (Q1–Q5 T3 U2 A9) · pooling and dedup (W7 A8 A2–A4) · activation (F7 F8 A11)
  · text and look-alikes (F12 O3) · SQL surface (V1 V2 V4 F13) · streaming (X1–X5)
  · report breakdowns (A8 A10 N12) · V2 as a SQL table function · W2
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.operators.activate import export, min_stage
from rosterline.operators.report import contacts_detail, list_summary, query_by_stage
from rosterline.operators.upsert import (advance_stage, create_lists, first_per_key, not_found,
                                         upsert_contacts, upsert_counters)
from rosterline.functions.normalize import is_member_id, is_vanity, normalize_linkedin_url
from rosterline.session import materialize, scratch_dir
from rosterline.sources.files import write_bucketed_snapshot
from rosterline.schema import COMPANY_SCHEMA, EXPORT_COLUMNS
from rosterline.sources.bindings import (BATCH_SPLIT, NOW, STAGE_FROM_SCORE, V_HITS, duck, hits)

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Shared derivations
# ---------------------------------------------------------------------------
N1_SQL = r"lower(regexp_replace(regexp_replace(nullif({u}, ''), '\?.*$', ''), '/$', ''))"

HITS_CTE = f"h AS ({duck(V_HITS)})"
CONTACTS_CTE = HITS_CTE + f""",
k AS (SELECT *, {N1_SQL.format(u='linkedin_url')} AS linkedin_url_normalized FROM h),
d AS (SELECT * FROM k QUALIFY linkedin_url_normalized IS NULL
      OR row_number() OVER (PARTITION BY list_id, linkedin_url_normalized ORDER BY ord) = 1),
contacts AS (SELECT *, CAST(row_number() OVER (PARTITION BY list_id ORDER BY ord) AS BIGINT) AS id,
             {STAGE_FROM_SCORE} AS stage FROM d)"""
LISTS_CTE = """lists AS (SELECT list_id, 'list-' || CAST(list_id AS VARCHAR) AS list_name,
  CAST(NULL AS VARCHAR) AS description, 'unknown' AS created_by, 'active' AS status,
  TIMESTAMP '2025-01-01 00:00:00' AS created_at
  FROM (SELECT DISTINCT list_id FROM h UNION SELECT 4))"""


def _contacts_raw(spark: SparkSession, d: str) -> DataFrame:
    """J1 twice: the hits seen before the split, then the rest, into empty lists."""
    h = hits(spark, d)
    # The existing state is a stored snapshot in a real pipeline: write it once.
    first = materialize(upsert_contacts(None, h.where(F.col("seen_at") < F.lit(BATCH_SPLIT).cast("timestamp_ntz")), NOW),
                        "contacts")
    second_batch = h.where(F.col("seen_at") >= F.lit(BATCH_SPLIT).cast("timestamp_ntz"))
    return upsert_contacts(first.drop("_inserted"), second_batch, NOW), second_batch


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts after J1 and one T1 advance to the stage their score earns."""
    raw, _ = _contacts_raw(spark, d)
    raw = materialize(raw.drop("_inserted"), "contacts")
    updates = raw.select("list_id", "id", F.expr(STAGE_FROM_SCORE).alias("stage"))
    return advance_stage(raw, updates, NOW).drop("_updated")


def lists(spark: SparkSession, d: str) -> DataFrame:
    """T4: one list per list id in the hits plus one list that stays empty."""
    h = hits(spark, d)
    new = h.select(F.col("list_id").alias("ord")).union(spark.range(4, 5).select(F.col("id").alias("ord"))).distinct()
    return create_lists(None, new, NOW)


# ---------------------------------------------------------------------------
# Minimum slice: N1, N4, W1, J1, A5, T1, F1, F3, O1, A1, J9, T4, U1
# ---------------------------------------------------------------------------

@register("n1_linkedin_key", f"""WITH {HITS_CTE}
SELECT ord, list_id, linkedin_url, {N1_SQL.format(u='linkedin_url')} AS linkedin_url_normalized,
  coalesce(contains(lower(linkedin_url), '/in/acw'), false) AS is_member_id,
  coalesce(linkedin_url <> '' AND NOT contains(lower(linkedin_url), '/in/acw'), false) AS is_vanity
FROM h""")
def q_n1(spark, d):
    return hits(spark, d).select(
        "ord", "list_id", "linkedin_url",
        normalize_linkedin_url("linkedin_url").alias("linkedin_url_normalized"),
        is_member_id("linkedin_url").alias("is_member_id"), is_vanity("linkedin_url").alias("is_vanity"))


@register("w1_first_per_key", f"""WITH {HITS_CTE},
k AS (SELECT list_id, {N1_SQL.format(u='linkedin_url')} AS linkedin_url_normalized, ord, first_name FROM h)
SELECT * FROM k QUALIFY linkedin_url_normalized IS NULL
  OR row_number() OVER (PARTITION BY list_id, linkedin_url_normalized ORDER BY ord) = 1""")
def q_w1(spark, d):
    k = hits(spark, d).select("list_id", normalize_linkedin_url("linkedin_url").alias("linkedin_url_normalized"),
                              "ord", "first_name")
    return first_per_key(k, ["list_id", "linkedin_url_normalized"], "ord")


@register("j1_upsert_contacts", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, ord, first_name, linkedin_url, linkedin_url_normalized, stage, qualification_score
FROM contacts""")
def q_j1(spark, d):
    return contacts(spark, d).select("list_id", "id", "ord", "first_name", "linkedin_url",
                                     "linkedin_url_normalized", "stage", "qualification_score")


def _stored(df, keys):
    """The frame as a bucketed table (S5), as stored state of an earlier run; its name and files are this run's own."""
    spark = df.sparkSession
    return write_bucketed_snapshot(df, "stored_" + _uuid.uuid4().hex, _scratch(spark, "stored"), keys, 8)


@register("j1_upsert_stored", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, ord, linkedin_url_normalized FROM contacts""")
def q_j1_stored(spark, d):
    h = hits(spark, d)
    split = F.lit(BATCH_SPLIT).cast("timestamp_ntz")
    state = _stored(upsert_contacts(None, h.where(F.col("seen_at") < split), NOW).drop("_inserted"),
                    ["list_id", "linkedin_url_normalized"])
    return upsert_contacts(state, h.where(F.col("seen_at") >= split), NOW, stored=True).select(
        "list_id", "id", "ord", "linkedin_url_normalized")


@register("a5_upsert_counters", f"""WITH {CONTACTS_CTE}
SELECT list_id,
  CAST(count(*) FILTER (WHERE seen_at >= TIMESTAMP '{BATCH_SPLIT}') AS BIGINT) AS inserted,
  CAST((SELECT count(*) FROM h WHERE h.list_id = c.list_id AND seen_at >= TIMESTAMP '{BATCH_SPLIT}')
       - count(*) FILTER (WHERE seen_at >= TIMESTAMP '{BATCH_SPLIT}') AS BIGINT) AS skipped_duplicates,
  CAST(count(*) AS BIGINT) AS total
FROM contacts c GROUP BY list_id""")
def q_a5(spark, d):
    res, batch = _contacts_raw(spark, d)
    return upsert_counters(batch, res)


@register("t1_advance_stored", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, stage FROM contacts""")
def q_t1_stored(spark, d):
    raw, _ = _contacts_raw(spark, d)
    state = _stored(raw.drop("_inserted"), ["list_id", "id"])
    return advance_stage(state, state.select("list_id", "id", F.expr(STAGE_FROM_SCORE).alias("stage")), NOW).select("list_id", "id", "stage")


@register("t1_advance_stage", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, stage,
  TIMESTAMP '{NOW}' AS sourced_at,
  CASE WHEN stage = 'qualified' THEN TIMESTAMP '{NOW}' END AS qualified_at,
  CASE WHEN stage = 'email_enriched' THEN TIMESTAMP '{NOW}' END AS email_enriched_at,
  CASE WHEN stage = 'phone_enriched' THEN TIMESTAMP '{NOW}' END AS phone_enriched_at
FROM contacts""")
def q_t1(spark, d):
    return contacts(spark, d).select("list_id", "id", "stage", "sourced_at", "qualified_at",
                                     "email_enriched_at", "phone_enriched_at")


@register("f1_query_by_stage", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, first_name, stage FROM contacts WHERE stage = 'email_enriched'""")
def q_f1(spark, d):
    return query_by_stage(contacts(spark, d), "email_enriched").select("list_id", "id", "first_name", "stage")


@register("f3_min_stage", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, stage FROM contacts
WHERE stage IN ('qualified', 'email_enriched', 'phone_enriched')""")
def q_f3(spark, d):
    return min_stage(contacts(spark, d), "qualified").select("list_id", "id", "stage")


EXPORT_SQL_COLS = ", ".join(
    f"CAST(NULL AS VARCHAR) AS {c}" if c not in ("first_name", "last_name", "company_name", "company_domain",
                                                  "linkedin_url", "source", "qualification_score") else c
    for c in EXPORT_COLUMNS)


@register("o1_export", f"""WITH {CONTACTS_CTE}
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY qualification_score DESC NULLS LAST,
  coalesce(company_name, '') ASC, id ASC) AS BIGINT) AS export_pos, {EXPORT_SQL_COLS}
FROM contacts WHERE stage <> 'skipped'""")
def q_o1(spark, d):
    return export(contacts(spark, d), "sourced")


@register("a1_list_summary", f"""WITH {CONTACTS_CTE}, {LISTS_CTE}
SELECT l.list_id, l.list_name, l.description, l.created_by, l.status, l.created_at,
  CAST(count(c.id) FILTER (WHERE c.stage = 'sourced') AS BIGINT) AS sourced,
  CAST(count(c.id) FILTER (WHERE c.stage = 'qualified') AS BIGINT) AS qualified,
  CAST(count(c.id) FILTER (WHERE c.stage = 'email_enriched') AS BIGINT) AS email_enriched,
  CAST(count(c.id) FILTER (WHERE c.stage = 'phone_enriched') AS BIGINT) AS phone_enriched,
  CAST(count(c.id) FILTER (WHERE c.stage = 'skipped') AS BIGINT) AS skipped,
  CAST(count(c.id) AS BIGINT) AS total_contacts
FROM lists l LEFT JOIN contacts c ON l.list_id = c.list_id
GROUP BY ALL""")
def q_a1(spark, d):
    return list_summary(lists(spark, d), contacts(spark, d))


@register("t4_create_lists", f"""WITH {HITS_CTE}, {LISTS_CTE}
SELECT list_id, list_name, description, created_by, CAST(NULL AS VARCHAR) AS search_criteria, status,
  created_at, created_at AS updated_at FROM lists""")
def q_t4(spark, d):
    return lists(spark, d)


@register("j9_contacts_detail", f"""WITH {CONTACTS_CTE}, {LISTS_CTE}
SELECT c.list_id, c.id, c.first_name, c.stage, l.list_name, l.description AS list_description
FROM contacts c JOIN lists l ON c.list_id = l.list_id""")
def q_j9(spark, d):
    return contacts_detail(contacts(spark, d), lists(spark, d)).select(
        "list_id", "id", "first_name", "stage", "list_name", "list_description")


@register("u1_not_found", f"""WITH {CONTACTS_CTE}
SELECT DISTINCT list_id, user_id * 25 AS id FROM h
WHERE NOT EXISTS (SELECT 1 FROM contacts c WHERE c.list_id = h.list_id AND c.id = h.user_id * 25)""")
def q_u1(spark, d):
    ids = hits(spark, d).select("list_id", (F.col("user_id") * 25).alias("id"))
    return not_found(ids, contacts(spark, d))


# ---------------------------------------------------------------------------
# Companies: N2, N3, J2, N20, N21, A5, F2, A12
# ---------------------------------------------------------------------------
from rosterline.functions.merge import merge_intel, merge_sources  # noqa: E402
from rosterline.functions.normalize import normalize_company_name, normalize_domain  # noqa: E402
from rosterline.operators.report import intel_report, query_companies  # noqa: E402
from rosterline.operators.upsert import company_counters, upsert_companies  # noqa: E402
from rosterline.sources.bindings import V_COMPANIES, companies_src  # noqa: E402

N2_SQL = (r"nullif(regexp_replace(regexp_replace(split_part(regexp_replace(lower(regexp_replace({u}, "
          r"'^\s+|\s+$', '', 'g')), '^https?://', ''), '/', 1), '^www\.', ''), '\.+$', ''), '')")
N3_SQL = r"lower(trim(regexp_replace(nullif({n}, ''), '\s+', ' ', 'g')))"
INTEL_TYPES = ["view", "click", "purchase", "signup", "error"]


@register("n2_domain_key", f"""SELECT page_id, url, {N2_SQL.format(u='url')} AS domain_key FROM pages""")
def q_n2(spark, d):
    from rosterline.session import read_table
    return read_table(spark, d, "pages").select("page_id", "url", normalize_domain("url").alias("domain_key"))


@register("n2_company_domain_key", f"""WITH v AS ({duck(V_COMPANIES)})
SELECT ord, company_domain, {N2_SQL.format(u='company_domain')} AS domain_key FROM v""")
def q_n2b(spark, d):
    return companies_src(spark, d).select("ord", "company_domain", normalize_domain("company_domain").alias("domain_key"))


@register("n3_company_name_key", f"""WITH {HITS_CTE}
SELECT ord, company_name || '  ' || source || chr(9) || ' Ltd ' AS raw_name,
  {N3_SQL.format(n="company_name || '  ' || source || chr(9) || ' Ltd '")} AS name_key FROM h""")
def q_n3(spark, d):
    raw = F.concat(F.col("company_name"), F.lit("  "), F.col("source"), F.lit("\t Ltd "))
    return hits(spark, d).select("ord", raw.alias("raw_name"), normalize_company_name(raw).alias("name_key"))


def _company_batches(spark, d):
    h = hits(spark, d)
    intel = F.create_map(F.col("source"), F.round(F.col("value") * 100).cast("bigint").cast("string"))
    rows = h.select("list_id", "ord", "seen_at", "company_name", "company_domain", "source",
                    intel.alias("intel"),
                    F.array(F.concat(F.lit("https://evidence.example/"), F.col("source"))).alias("sources"),
                    (F.col("source") == "purchase").alias("verified"),
                    (F.col("value") > 250).alias("enriched"))
    split = F.lit(BATCH_SPLIT).cast("timestamp_ntz")
    return rows.where(F.col("seen_at") < split).drop("seen_at"), rows.where(F.col("seen_at") >= split).drop("seen_at")


def companies(spark, d):
    b1, b2 = _company_batches(spark, d)
    first = materialize(upsert_companies(None, b1, NOW).drop("_status", "_n_new"), "companies")
    return upsert_companies(first, b2, NOW)


COMPANIES_CTE = HITS_CTE + f""",
cr AS (SELECT list_id, ord, seen_at, company_name, company_domain, source,
  CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS ival,
  'https://evidence.example/' || source AS url, source = 'purchase' AS verified, value > 250 AS enriched,
  {N2_SQL.format(u='company_domain')} AS company_domain_normalized FROM h),
cg AS (SELECT list_id, company_domain_normalized, min(ord) AS first_ord,
  arg_max(company_name, ord) FILTER (WHERE company_name IS NOT NULL) AS company_name,
  arg_min(company_domain, ord) FILTER (WHERE company_domain IS NOT NULL) AS company_domain,
  arg_max(source, ord) FILTER (WHERE source IS NOT NULL) AS source,
  bool_or(verified) AS verified, bool_or(enriched) AS enriched,
  {", ".join(f"arg_max(ival, ord) FILTER (WHERE source = '{t}') AS intel_{t}" for t in INTEL_TYPES)},
  count(*) FILTER (WHERE seen_at >= TIMESTAMP '{BATCH_SPLIT}') AS n_new,
  bool_or(seen_at < TIMESTAMP '{BATCH_SPLIT}') AS had_old
  FROM cr WHERE company_domain_normalized IS NOT NULL GROUP BY ALL),
cs AS (SELECT list_id, company_domain_normalized, string_agg(url, ',' ORDER BY fo) AS sources_joined
  FROM (SELECT list_id, company_domain_normalized, url, min(ord) AS fo FROM cr
        WHERE company_domain_normalized IS NOT NULL GROUP BY ALL) GROUP BY ALL),
cn AS (SELECT list_id, company_domain_normalized, ord AS first_ord, company_name, company_domain, source,
  verified, enriched,
  {", ".join(f"CASE WHEN source = '{t}' THEN ival END AS intel_{t}" for t in INTEL_TYPES)},
  url AS sources_joined, CASE WHEN seen_at >= TIMESTAMP '{BATCH_SPLIT}' THEN 1 ELSE 0 END AS n_new,
  seen_at < TIMESTAMP '{BATCH_SPLIT}' AS had_old
  FROM cr WHERE company_domain_normalized IS NULL),
call AS (SELECT cg.*, cs.sources_joined FROM cg JOIN cs USING (list_id, company_domain_normalized)
  UNION ALL BY NAME SELECT * FROM cn),
companies AS (SELECT *, CAST(row_number() OVER (PARTITION BY list_id ORDER BY first_ord) AS BIGINT) AS id FROM call)"""


def _company_view(df):
    return df.select(
        "list_id", "id", "company_domain_normalized", "company_name", "company_domain", "source",
        "verified", "enriched",
        *[F.try_element_at("intel", F.lit(t)).alias(f"intel_{t}") for t in INTEL_TYPES],
        F.array_join("sources", ",").alias("sources_joined"))


@register("j2_upsert_companies", f"""WITH {COMPANIES_CTE}
SELECT list_id, id, company_domain_normalized, company_name, company_domain, source, verified, enriched,
  {", ".join(f"intel_{t}" for t in INTEL_TYPES)}, sources_joined FROM companies""")
def q_j2(spark, d):
    return _company_view(companies(spark, d))


@register("j2_upsert_stored", f"""WITH {COMPANIES_CTE}
SELECT list_id, id, company_domain_normalized, company_name, company_domain, source, verified, enriched,
  {", ".join(f"intel_{t}" for t in INTEL_TYPES)}, sources_joined FROM companies""")
def q_j2_stored(spark, d):
    b1, b2 = _company_batches(spark, d)
    state = _stored(upsert_companies(None, b1, NOW).drop("_status", "_n_new"), ["list_id", "company_domain_normalized"])
    return _company_view(upsert_companies(state, b2, NOW, stored=True))


@register("a5_company_counters", f"""WITH {COMPANIES_CTE}
SELECT list_id, CAST(count(*) FILTER (WHERE NOT had_old) AS BIGINT) AS inserted,
  CAST(sum(n_new) - count(*) FILTER (WHERE NOT had_old) AS BIGINT) AS updated,
  CAST(count(*) AS BIGINT) AS total FROM companies GROUP BY list_id""")
def q_a5c(spark, d):
    return company_counters(companies(spark, d))


@register("f2_query_companies", f"""WITH {COMPANIES_CTE}
SELECT list_id, id, company_domain_normalized, company_name FROM companies WHERE list_id = 2""")
def q_f2(spark, d):
    return query_companies(companies(spark, d).drop("_status", "_n_new"), 2).select(
        "list_id", "id", "company_domain_normalized", "company_name")


@register("a12_intel_report", f"""WITH {COMPANIES_CTE}
SELECT list_id, CAST(count(*) AS BIGINT) AS companies, CAST(count(*) FILTER (WHERE enriched) AS BIGINT) AS enriched,
  CAST(count(*) FILTER (WHERE verified) AS BIGINT) AS verified,
  CAST(count(*) FILTER (WHERE ({" + ".join(f"(intel_{t} IS NOT NULL)::INT" for t in INTEL_TYPES)}) < 3) AS BIGINT) AS thin
FROM companies GROUP BY list_id""")
def q_a12(spark, d):
    return intel_report(companies(spark, d))


@register("n20_merge_intel", f"""WITH {HITS_CTE}
SELECT ord, source AS m_type,
  CASE WHEN value > 200 THEN NULL ELSE CAST(user_id % 7 AS VARCHAR) END AS m_bucket,
  CASE WHEN value > 200 THEN 'yes' END AS m_hot,
  CASE WHEN value > 200 THEN 3 ELSE 2 END AS m_size,
  CASE WHEN value > 200 THEN 'cold' ELSE source END AS m_type2
FROM h""")
def q_n20(spark, d):
    h = hits(spark, d)
    left = F.create_map(F.lit("type"), F.col("source"), F.lit("bucket"), (F.col("user_id") % 7).cast("string"))
    hot = F.create_map(F.lit("bucket"), F.lit(None).cast("string"), F.lit("hot"), F.lit("yes"))
    m = merge_intel(left, F.when(F.col("value") > 200, hot))
    m2 = merge_intel(left, F.when(F.col("value") > 200, F.create_map(F.lit("type"), F.lit("cold"))))
    return h.select("ord", F.try_element_at(m, F.lit("type")).alias("m_type"),
                    F.try_element_at(m, F.lit("bucket")).alias("m_bucket"),
                    F.try_element_at(m, F.lit("hot")).alias("m_hot"), F.size(m).alias("m_size"),
                    F.try_element_at(m2, F.lit("type")).alias("m_type2"))


@register("n21_merge_sources", f"""WITH {HITS_CTE}
SELECT ord, CASE WHEN value > 100 THEN 'https://a.example/' || source || ',https://b.example/' || CAST(user_id AS VARCHAR)
  ELSE 'https://a.example/' || source END AS merged,
  CASE WHEN value > 100 THEN 2 ELSE 1 END AS n
FROM h""")
def q_n21(spark, d):
    h = hits(spark, d)
    a = F.concat(F.lit("https://a.example/"), F.col("source"))
    left = F.when(F.col("value") > 100, F.array(a)).otherwise(F.lit(None).cast("array<string>"))
    right = F.when(F.col("value") > 100, F.array(a, F.concat(F.lit("https://b.example/"), F.col("user_id").cast("string")))
                   ).otherwise(F.array(a, a))
    m = merge_sources(left, right)
    return h.select("ord", F.array_join(m, ",").alias("merged"), F.size(m).alias("n"))


# ---------------------------------------------------------------------------
# Sources and sinks: S1, S2, S4, S5, S6 (round trips through files Spark writes
# from the driver tables into the shared checkpoint folder)
# ---------------------------------------------------------------------------
import os as _os  # noqa: E402
import uuid as _uuid  # noqa: E402

from rosterline.session import scratch_dir  # noqa: E402
from rosterline.sources.files import (read_companies_csv, read_export_csv, read_jsonl, read_snapshot,  # noqa: E402
                                      to_json_rows, write_export_csv, write_snapshot)


def _scratch(spark, tag):
    return _os.path.join(scratch_dir(spark), f"{tag}-{_uuid.uuid4().hex}")


S1_SRC = f"""v AS ({duck(V_COMPANIES)}),
s AS (SELECT ord, CASE WHEN ord % 50 = 0 THEN '' ELSE company_name END AS name_col,
  CASE WHEN ord % 50 = 0 THEN '' ELSE company_domain END AS web_col,
  CASE WHEN ord % 7 = 0 THEN 'https://www.linkedin.com/company/' || lower(replace(company_name, '#', '-')) ELSE '' END AS li_col,
  industry AS segment_col, CASE WHEN ord % 3 = 0 THEN ' ' ELSE region END AS region_col FROM v)"""


@register("s1_companies_csv", f"""WITH {S1_SRC}
SELECT name_col AS company_name, web_col AS company_domain, nullif(li_col, '') AS linkedin_url,
  segment_col AS extras_segment, nullif(trim(region_col), '') AS extras_region,
  CASE WHEN nullif(trim(region_col), '') IS NULL THEN 1 ELSE 2 END AS n_extras
FROM s WHERE name_col <> '' OR web_col <> ''""")
def q_s1(spark, d):
    src = companies_src(spark, d)
    blank = (F.col("ord") % 50) == 0
    csv_rows = src.select(
        F.when(blank, "").otherwise(F.col("company_name")).alias(" Company "),
        F.when(blank, "").otherwise(F.col("company_domain")).alias("Website"),
        F.when(F.col("ord") % 7 == 0, F.concat(F.lit("https://www.linkedin.com/company/"),
                                                F.lower(F.replace("company_name", F.lit("#"), F.lit("-")))))
        .otherwise("").alias("LinkedIn"),
        F.col("industry").alias("Segment"),
        F.when(F.col("ord") % 3 == 0, " ").otherwise(F.col("region")).alias("Region"), F.col("ord").alias("_ord"))
    path = _scratch(spark, "csv")
    # Two kinds of files in one folder: other column order, and a header that stands twice.
    first, second = csv_rows.where(F.col("_ord") % 2 == 0), csv_rows.where(F.col("_ord") % 2 == 1)
    first.drop("_ord").write.option("header", "true").option("escape", '"').csv(path)
    (second.select("Region", F.lit("").alias("LinkedIn "), "Website", "LinkedIn", "Segment", " Company ")
     .write.option("header", "true").option("escape", '"').mode("append").csv(path))
    comp, _ = read_companies_csv(spark, path)
    return comp.select("company_name", "company_domain", "linkedin_url",
                       F.try_element_at("extras", F.lit("segment")).alias("extras_segment"),
                       F.try_element_at("extras", F.lit("region")).alias("extras_region"),
                       F.size("extras").alias("n_extras"))


@register("s1_csv_skipped", f"""WITH {S1_SRC}
SELECT CAST(count(*) FILTER (WHERE name_col = '' AND web_col = '') AS BIGINT) AS skipped FROM s""")
def q_s1b(spark, d):
    src = companies_src(spark, d)
    blank = (F.col("ord") % 50) == 0
    csv_rows = src.select(F.when(blank, "").otherwise(F.col("company_name")).alias("name"),
                          F.when(blank, "").otherwise(F.col("company_domain")).alias("url"),
                          F.col("industry").alias("segment"))
    path = _scratch(spark, "csv")
    csv_rows.write.option("header", "true").option("escape", '"').csv(path)
    _, skipped = read_companies_csv(spark, path)
    return skipped.agg(F.coalesce(F.sum("skipped"), F.lit(0)).cast("bigint").alias("skipped"))


@register("s2_jsonl_roundtrip", f"""WITH {COMPANIES_CTE}
SELECT list_id, id, company_domain_normalized, company_name, verified, intel_view
FROM companies""")
def q_s2(spark, d):
    path = _scratch(spark, "jsonl")
    companies(spark, d).drop("_status", "_n_new").write.json(path)
    back = read_jsonl(spark, path, COMPANY_SCHEMA)
    return back.select("list_id", "id", "company_domain_normalized", "company_name", "verified",
                       F.try_element_at("intel", F.lit("view")).alias("intel_view"))


@register("s4_export_csv", f"""WITH {CONTACTS_CTE}
SELECT CAST(list_id AS VARCHAR) AS list_id, {", ".join(
    f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" if c in ("first_name", "last_name", "company_name",
    "company_domain", "linkedin_url", "source", "qualification_score") else f"'' AS {c}" for c in EXPORT_COLUMNS)}
FROM contacts WHERE stage IN ('qualified', 'email_enriched', 'phone_enriched')""")
def q_s4(spark, d):
    path = _scratch(spark, "export")
    write_export_csv(export(contacts(spark, d), "qualified"), path)
    back = read_export_csv(spark, path)
    return back.select(F.col("list_id").cast("string").alias("list_id"),
                       *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in EXPORT_COLUMNS])


@register("s5_snapshot", f"""WITH {CONTACTS_CTE}
SELECT list_id, CAST(count(*) AS BIGINT) AS n, CAST(max(id) AS BIGINT) AS max_id FROM contacts GROUP BY list_id""")
def q_s5(spark, d):
    path = _scratch(spark, "snapshot")
    c = contacts(spark, d)
    write_snapshot(c, path)
    write_snapshot(c.where(F.col("list_id") == 2), path)   # replaces list 2 only
    back = read_snapshot(spark, path)
    return back.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"))


@register("s6_json_rows", f"""WITH {CONTACTS_CTE}
SELECT '{{"list_id":' || CAST(list_id AS VARCHAR) || ',"id":' || CAST(id AS VARCHAR) || ',"stage":"' || stage || '"}}' AS json
FROM contacts""")
def q_s6(spark, d):
    return to_json_rows(contacts(spark, d).select("list_id", "id", "stage"))


# ---------------------------------------------------------------------------
# Payloads: S3, N15–N19 (payload text is built by Spark from the hits)
# ---------------------------------------------------------------------------
from rosterline.functions.payload import (apply_field_map, contact_phone, explode_response,  # noqa: E402
                                          first_nested_phone, parse_payload, profile_to_contact)


def _match_payloads(spark, d):
    h = hits(spark, d)
    item = lambda tag, status: F.struct(
        F.concat(F.lit(tag), F.col("ord").cast("string"), F.lit("@x.example")).alias("email"),
        status.alias("email_status"),
        F.struct(F.col("linkedin_url").alias("url")).alias("person"),
        F.struct(F.col("company_domain").alias("domain")).alias("org"),
        F.concat(F.lit("ap"), F.col("user_id").cast("string")).alias("id"))
    second = F.when(F.col("source") == "click", "guessed").otherwise("unavailable")
    payload = F.when(F.col("source") != "error",
                     F.to_json(F.struct(F.array(item("a", F.lit("verified")), item("b", second)).alias("matches")))
                     ).otherwise(F.to_json(F.struct(F.lit("none").alias("note"))))
    return h.select("ord", payload.alias("payload"))


S3_EXPECTED = f"""WITH {HITS_CTE},
e AS (SELECT ord, 0 AS pos, 'a' || CAST(ord AS VARCHAR) || '@x.example' AS email, 'verified' AS email_status,
        linkedin_url, company_domain, 'ap' || CAST(user_id AS VARCHAR) AS apollo_id FROM h WHERE source <> 'error'
      UNION ALL
      SELECT ord, 1, 'b' || CAST(ord AS VARCHAR) || '@x.example',
        CASE WHEN source = 'click' THEN 'guessed' ELSE 'unavailable' END, linkedin_url, company_domain,
        'ap' || CAST(user_id AS VARCHAR) FROM h WHERE source <> 'error')"""


@register("s3_explode_response", S3_EXPECTED + "\nSELECT ord, pos, email FROM e")
def q_s3(spark, d):
    ex = explode_response(_match_payloads(spark, d), "payload", "matches")
    return ex.select("ord", "pos", F.try_variant_get("item", "$.email", "string").alias("email"))


@register("n15_field_map", S3_EXPECTED + """
SELECT ord, pos, email, email_status, linkedin_url, nullif(company_domain, '') AS intel_domain, apollo_id,
  'apollo' AS source, CAST(NULL AS VARCHAR) AS title FROM e""")
def q_n15(spark, d):
    ex = explode_response(_match_payloads(spark, d), "payload", "matches")
    mapped = apply_field_map(ex, "item", {"email": "email", "email_status": "email_status",
                                          "person.url": "linkedin_url", "org.domain": "intel.domain",
                                          "id": "provider_ids.apollo"}, "apollo",
                             canonical=["email", "email_status", "linkedin_url", "title"])
    return mapped.select("ord", "pos", "email", "email_status", "linkedin_url",
                         F.nullif(F.try_element_at("intel", F.lit("domain")), F.lit("")).alias("intel_domain"),
                         F.try_element_at("provider_ids", F.lit("apollo")).alias("apollo_id"), "source", "title")


@register("n16_profile_to_contact", f"""WITH {HITS_CTE}
SELECT ord, first_name, CASE WHEN user_id % 3 = 0 THEN NULL ELSE last_name END AS last_name,
  CASE WHEN user_id % 3 = 0 THEN first_name ELSE first_name || ' ' || last_name END AS full_name,
  CASE WHEN user_id % 4 = 0 OR ord % 2 = 0 THEN 'Headline ' || source ELSE 'Title ' || source END AS title,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE company_name END AS company_name,
  linkedin_url, 'City ' || CAST(user_id % 9 AS VARCHAR) AS location, 'apify' AS source
FROM h""")
def q_n16(spark, d):
    h = hits(spark, d)
    pos = F.struct(F.when(F.col("ord") % 2 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("source"))).alias("title"),
                   F.col("company_name").alias("companyName"))
    prof = F.to_json(F.struct(
        F.col("first_name").alias("firstName"),
        F.when(F.col("user_id") % 3 != 0, F.col("last_name")).alias("lastName"),
        F.concat(F.lit("Full "), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("Headline "), F.col("source")).alias("headline"),
        F.col("linkedin_url").alias("linkedinUrl"),
        F.struct(F.concat(F.lit("City "), (F.col("user_id") % 9).cast("string")).alias("linkedinText")).alias("location"),
        F.when(F.col("user_id") % 4 == 0, F.array().cast("array<struct<title:string,companyName:string>>"))
        .otherwise(F.array(pos)).alias("currentPositions")))
    out = profile_to_contact(h.select("ord", prof.alias("p")), "p")
    return out.select("ord", "first_name", "last_name", "full_name", "title", "company_name", "linkedin_url",
                      "location", "source")


@register("n17_nested_phone", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 3 WHEN 0 THEN '+1' || CAST(user_id AS VARCHAR) WHEN 1 THEN '+3' || CAST(user_id AS VARCHAR)
  END AS phone FROM h""")
def q_n17(spark, d):
    h = hits(spark, d)
    u = F.col("user_id").cast("string")
    payload = (F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"data":[[""],["+1 '), u, F.lit('"]]}')))
               .when(F.col("ord") % 3 == 1, F.concat(F.lit('{"data":["+3 '), u, F.lit('"]}')))
               .otherwise(F.lit('{"data":[]}')))
    return h.select("ord", first_nested_phone(F.get_json_object(payload, "$.data")).alias("phone"))


@register("n18_contact_phone", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 3 WHEN 0 THEN '+491' || CAST(user_id AS VARCHAR) WHEN 2 THEN '+447' || CAST(user_id AS VARCHAR)
  END AS phone FROM h""")
def q_n18(spark, d):
    h = hits(spark, d)
    u = F.col("user_id").cast("string")
    ci = (F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"most_probable_phone":{"number":"+49 1 '), u,
                                                  F.lit('","region":"DE"}}')))
          .when(F.col("ord") % 3 == 1, F.lit('{"most_probable_phone":{"number":""},"phones":[{"number":"+1 5"}]}'))
          .otherwise(F.concat(F.lit('{"phones":[{"number":"+44 7 '), u, F.lit('"}]}'))))
    return h.select("ord", contact_phone(ci).alias("phone"))


@register("n19_tolerant_json", f"""WITH {HITS_CTE}
SELECT ord, user_id AS k, 11 AS note_len FROM h""")
def q_n19(spark, d):
    h = hits(spark, d)
    raw = F.concat(F.lit('{"note":"line1\nline2","k":'), F.col("user_id").cast("string"), F.lit("}"))
    p = parse_payload(raw, "note string, k bigint")
    return h.select("ord", p["k"].alias("k"), F.length(p["note"]).alias("note_len"))


# ---------------------------------------------------------------------------
# Scalar vocabularies and helpers: N5–N14, N22
# ---------------------------------------------------------------------------
from rosterline.functions.merge import discovery_reason  # noqa: E402
from rosterline.functions.normalize import (clean_phone, company_slug, email_domain, full_name,  # noqa: E402
                                            slug_candidates, split_name)
from rosterline.functions.vocab import (map_phone_type, map_seniority, normalize_email_status,  # noqa: E402
                                        phone_country)
from rosterline.sources.bindings import V_RESULTS, results_src  # noqa: E402


@register("n5_full_name", f"""WITH {HITS_CTE}
SELECT ord,
  CASE WHEN user_id % 5 = 0 THEN 'Full ' || CAST(user_id AS VARCHAR)
       WHEN user_id % 7 = 0 THEN first_name ELSE first_name || ' ' || last_name END AS full_name,
  CASE WHEN user_id % 7 = 0 THEN first_name ELSE first_name || ' ' || last_name END AS profile_name
FROM h""")
def q_n5(spark, d):
    h = hits(spark, d)
    full = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("  Full "), F.col("user_id").cast("string"), F.lit("\t")))
    last = F.when(F.col("user_id") % 7 == 0, F.lit(" ")).otherwise(F.col("last_name"))
    last2 = F.when(F.col("user_id") % 7 == 0, F.lit("")).otherwise(F.col("last_name"))
    return h.select("ord", full_name("first_name", last, full).alias("full_name"),
                    full_name("first_name", last2, name=F.lit("raw name")).alias("profile_name"))


@register("n6_split_name", f"""WITH {HITS_CTE}
SELECT ord, first_name AS part1, last_name || ' Jr' AS part2 FROM h""")
def q_n6(spark, d):
    h = hits(spark, d)
    a, b = split_name(F.concat(F.lit(" "), F.col("first_name"), F.lit(" "), F.col("last_name"), F.lit(" Jr ")))
    return h.select("ord", a.alias("part1"), b.alias("part2"))


@register("n7_company_slug", f"""WITH {HITS_CTE}
SELECT ord, CASE WHEN ord % 2 = 0 THEN 'c' || CAST(user_id % 40 AS VARCHAR) || '_x' END AS slug FROM h""")
def q_n7(spark, d):
    h = hits(spark, d)
    url = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://www.linkedin.com/company/c"),
                                                  (F.col("user_id") % 40).cast("string"), F.lit("_x/"))
                 ).otherwise(F.col("company_domain"))
    return h.select("ord", company_slug(url).alias("slug"))


@register("n8_slug_candidates", f"""WITH {HITS_CTE},
s AS (SELECT ord, 'company-' || CAST(user_id % 40 AS VARCHAR) AS b, ord % 5 AS v FROM h)
SELECT ord, CASE v WHEN 0 THEN b || '-gmbh|' || b WHEN 1 THEN b || '-ag|' || b WHEN 2 THEN b || '|' || b || '-gmbh'
  WHEN 3 THEN b || '-group|' || b || '|' || b || '-group-gmbh' ELSE 'www' END AS candidates FROM s""")
def q_n8(spark, d):
    h = hits(spark, d)
    v = F.col("ord") % 5
    name = (F.when(v == 0, F.concat(F.col("company_name"), F.lit(" GmbH")))
            .when(v == 1, F.concat(F.col("company_name"), F.lit(" AG")))
            .when(v == 2, F.col("company_name"))
            .when(v == 3, F.concat(F.col("company_name"), F.lit(" Group")))
            .otherwise(F.concat(F.lit("https://www.c"), (F.col("user_id") % 40).cast("string"), F.lit(".example/x"))))
    return h.select("ord", F.array_join(slug_candidates(name), "|").alias("candidates"))


@register("n9_clean_phone", f"""WITH {HITS_CTE}
SELECT ord, CASE WHEN ord % 6 = 0 THEN NULL ELSE '+49' || CAST(user_id AS VARCHAR) || '00' END AS phone FROM h""")
def q_n9(spark, d):
    h = hits(spark, d)
    raw = F.when(F.col("ord") % 6 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit(" +49 "), F.col("user_id").cast("string"), F.lit(" 00 ")))
    return h.select("ord", clean_phone(raw).alias("phone"))


@register("n10_phone_type", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'direct_dial' WHEN 2 THEN 'switchboard' END AS phone_type
FROM h""")
def q_n10(spark, d):
    h = hits(spark, d)
    raw = (F.when(F.col("ord") % 4 == 0, "Mobile").when(F.col("ord") % 4 == 1, "work_direct")
           .when(F.col("ord") % 4 == 2, "work_hq").otherwise("personal"))
    return h.select("ord", map_phone_type(raw).alias("phone_type"))


N11_INPUT = """SELECT ord, CASE rank WHEN 1 THEN 'fullenrich' WHEN 2 THEN 'ai-ark' WHEN 3 THEN 'leadmagic'
  WHEN 4 THEN 'apollo' ELSE 'FullEnrich' END AS prov,
  CASE ord % 6 WHEN 0 THEN 'DELIVERABLE' WHEN 1 THEN 'high_probability' WHEN 2 THEN 'CATCH_ALL'
  WHEN 3 THEN 'valid' WHEN 4 THEN 'invalid' END AS raw,
  CASE WHEN ord % 7 = 0 THEN NULL ELSE email END AS mail, ord % 2 = 0 AS flag FROM {r}"""


@register("n11_email_status", f"""WITH r AS ({duck(V_RESULTS)}), x AS ({N11_INPUT.format(r='r')})
SELECT ord, CASE lower(prov)
  WHEN 'fullenrich' THEN CASE WHEN mail IS NULL THEN 'invalid'
    WHEN upper(coalesce(raw, '')) IN ('DELIVERABLE', 'HIGH_PROBABILITY') THEN 'deliverable'
    WHEN upper(coalesce(raw, '')) = 'CATCH_ALL' THEN 'catch_all' ELSE 'invalid' END
  WHEN 'ai-ark' THEN CASE WHEN upper(coalesce(raw, '')) = 'CATCH_ALL' THEN 'catch_all'
    WHEN mail IS NOT NULL THEN 'deliverable' ELSE 'invalid' END
  WHEN 'leadmagic' THEN CASE WHEN upper(coalesce(raw, '')) = 'VALID' AND flag THEN 'catch_all'
    WHEN upper(coalesce(raw, '')) = 'VALID' THEN 'deliverable' WHEN upper(coalesce(raw, '')) = 'INVALID' THEN 'invalid'
    ELSE 'unknown' END END AS email_status FROM x""")
def q_n11(spark, d):
    r = results_src(spark, d)
    x = spark.sql(N11_INPUT.format(r="{r}"), r=r)
    return x.select("ord", normalize_email_status("prov", "raw", "mail", "flag").alias("email_status"))


@register("n12_seniority", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 3 WHEN 0 THEN '220|300|210' WHEN 1 THEN '310|300|210' ELSE '300|210' END AS levels FROM h""")
def q_n12(spark, d):
    h = hits(spark, d)
    first = (F.when(F.col("ord") % 3 == 0, "Director").when(F.col("ord") % 3 == 1, "C-Level").otherwise("intern"))
    return h.select("ord", F.array_join(map_seniority(F.array(first, F.lit("VP"), F.lit("manager"))), "|").alias("levels"))


@register("n13_email_domain", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 3 WHEN 1 THEN 'c' || CAST(user_id % 40 AS VARCHAR) || '.example' END AS email_domain FROM h""")
def q_n13(spark, d):
    h = hits(spark, d)
    e = (F.when(F.col("ord") % 3 == 0, F.lit("x@Gmail.com"))
         .when(F.col("ord") % 3 == 1, F.concat(F.col("first_name"), F.lit("@C"), (F.col("user_id") % 40).cast("string"),
                                                F.lit(".Example")))
         .otherwise(F.lit("nomail")))
    return h.select("ord", email_domain(e).alias("email_domain"))


# Numbers with every kind of prefix: plain, with 00, zones that several countries share, none assigned.
N14_CASES = [("+49 ", "DE"), ("+44 7", "GB"), ("+352 ", "LU"), ("0049 ", "DE"), ("+999 ", None), ("+1 416 ", "CA"), ("+1 212 ", "US"),
             ("+1 876 ", "JM"), ("+7 701 ", "KZ"), ("+7 495 ", "RU"), ("+44 1534 ", "JE"), ("+599 7", "BQ"), ("+998 ", "UZ"), ("030 ", None)]


@register("n14_phone_country", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % {len(N14_CASES)} {" ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(N14_CASES) if c)}
  ELSE CASE user_id % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'AT' END END AS iso2 FROM h""")
def q_n14(spark, d):
    h = hits(spark, d)
    phone = F.concat(F.element_at(F.array(*[F.lit(p) for p, _ in N14_CASES]), (F.col("ord") % len(N14_CASES) + 1).cast("int")),
                     F.lpad(F.col("user_id").cast("string"), 7, "0"))
    country = (F.when(F.col("user_id") % 3 == 0, "Germany").when(F.col("user_id") % 3 == 1, "Austria")
               .otherwise("Atlantis"))
    return h.select("ord", phone_country(phone, country).alias("iso2"))


@register("n22_discovery_reason", f"""WITH v AS ({duck(V_COMPANIES)})
SELECT ord, 'lookalike of seed' || CAST(nationkey AS VARCHAR) || '.example (similarity '
  || CAST(CAST(round(abs(acctbal) / 10000, 2) AS DECIMAL(4, 2)) AS VARCHAR) || ')' AS discovery_reason FROM v""")
def q_n22(spark, d):
    v = companies_src(spark, d)
    seed = F.concat(F.lit("seed"), F.col("nationkey").cast("string"), F.lit(".example"))
    sim = F.round(F.abs(F.col("acctbal")) / 10000, 2).cast("decimal(4,2)")
    return v.select("ord", discovery_reason(seed, sim).alias("discovery_reason"))


# ---------------------------------------------------------------------------
# Joins, lookups, filters: A13, J3, F11, J4, J5, J6, J7, J8, J12, F10, J13, J14, J15, F4, F9
# ---------------------------------------------------------------------------
from rosterline.functions.vocab import REGIONS  # noqa: E402
from rosterline.operators.match import (apply_exclusions, mark_exclusions, backfill_domain, crm_dedupe,  # noqa: E402
                                        crossref_master, expand_regions, fresh, icp_filter, lookup_linkedin,
                                        match_roles, resolve_companies, reverse_lookup, rollup_master,
                                        suppress_master, valid_track, with_intel)
from rosterline.session import read_table  # noqa: E402

TOUCH_STATUS = ("CASE WHEN value > 450 THEN 'unsubscribed' ELSE CASE source WHEN 'view' THEN 'contacted' "
                "WHEN 'click' THEN 'engaged' WHEN 'purchase' THEN 'interested' WHEN 'signup' THEN 'replied' "
                "WHEN 'error' THEN 'bounced' END END")
MASTER_CTE = HITS_CTE + f""",
t AS (SELECT *, {TOUCH_STATUS} AS status, {N1_SQL.format(u='linkedin_url')} AS k FROM h),
master_all AS (SELECT k AS linkedin_url_normalized, arg_min(linkedin_url, seen_at) AS linkedin_url,
  arg_max(first_name, seen_at) FILTER (WHERE first_name IS NOT NULL) AS first_name,
  arg_max(last_name, seen_at) FILTER (WHERE last_name IS NOT NULL) AS last_name,
  arg_max(company_name, seen_at) FILTER (WHERE company_name IS NOT NULL) AS company_name,
  coalesce(arg_max(status, CASE status WHEN 'contacted' THEN 1 WHEN 'engaged' THEN 2 WHEN 'interested' THEN 3
    WHEN 'replied' THEN 4 END), 'contacted') AS overall_status,
  CAST(count(DISTINCT list_id) AS INTEGER) AS total_campaigns,
  bool_or(status = 'replied') AS has_replied, bool_or(status = 'bounced') AS has_bounced,
  bool_or(status = 'unsubscribed') AS has_unsubscribed,
  min(seen_at) AS first_contacted_at, max(seen_at) AS last_contacted_at
  FROM t WHERE k IS NOT NULL GROUP BY k),
master AS (SELECT k AS linkedin_url_normalized, arg_max(first_name, seen_at) AS first_name,
  arg_max(last_name, seen_at) AS last_name, arg_max(company_name, seen_at) AS company_name,
  coalesce(arg_max(status, CASE status WHEN 'contacted' THEN 1 WHEN 'engaged' THEN 2 WHEN 'interested' THEN 3
    WHEN 'replied' THEN 4 END), 'contacted') AS overall_status,
  bool_or(status = 'replied') AS has_replied, bool_or(status = 'bounced') AS has_bounced,
  bool_or(status = 'unsubscribed') AS has_unsubscribed
  FROM t WHERE k IS NOT NULL AND seen_at < TIMESTAMP '{BATCH_SPLIT}' GROUP BY k),
xr AS (SELECT u.url, m.linkedin_url_normalized IS NOT NULL AS found,
  CASE WHEN m.linkedin_url_normalized IS NULL THEN 'new' WHEN m.has_unsubscribed THEN 'unsubscribed'
    WHEN m.has_bounced AND NOT m.has_replied THEN 'bounced' WHEN m.overall_status = 'interested' THEN 'interested'
    WHEN m.has_replied THEN 'replied' ELSE 'previously_contacted' END AS status,
  m.first_name AS master_first_name, m.last_name AS master_last_name, m.company_name AS master_company_name
  FROM (SELECT DISTINCT linkedin_url AS url FROM h WHERE seen_at >= TIMESTAMP '{BATCH_SPLIT}') u
  LEFT JOIN master m ON {N1_SQL.format(u='u.url')} = m.linkedin_url_normalized)"""


def _touch_rows(h):
    return h.select("linkedin_url", "first_name", "last_name", "company_name", F.expr(TOUCH_STATUS).alias("status"),
                    F.col("seen_at").alias("ts"), F.col("list_id").alias("campaign_id"))


def _touches(spark, d):
    return _touch_rows(hits(spark, d))


def _crossref(spark, d):
    t = _touches(spark, d)
    master = rollup_master(t.where(F.col("ts") < F.lit(BATCH_SPLIT).cast("timestamp_ntz")))
    urls = hits(spark, d).where(F.col("seen_at") >= F.lit(BATCH_SPLIT).cast("timestamp_ntz")) \
        .select(F.col("linkedin_url").alias("url")).distinct()
    return crossref_master(urls, master, "url")


@register("a13_rollup_master", f"WITH {MASTER_CTE} SELECT * FROM master_all")
def q_a13(spark, d):
    return rollup_master(_touches(spark, d)).select(
        "linkedin_url_normalized", "linkedin_url", "first_name", "last_name", "company_name", "overall_status",
        "total_campaigns", "has_replied", "has_bounced", "has_unsubscribed", "first_contacted_at", "last_contacted_at")


@register("j3_crossref_master", f"WITH {MASTER_CTE} SELECT * FROM xr")
def q_j3(spark, d):
    return _crossref(spark, d)


@register("f11_suppress_master", f"""WITH {MASTER_CTE}
SELECT url, status, status IN ('replied', 'interested') AS warm FROM xr WHERE status NOT IN ('bounced', 'unsubscribed')""")
def q_f11(spark, d):
    return suppress_master(_crossref(spark, d)).select("url", "status", "warm")


CRM_CTE = f"""v AS ({duck(V_COMPANIES)}),
crm AS (SELECT 'Customer' || lpad(CAST(s_suppkey * 13 AS VARCHAR), 9, '0') || '.EXAMPLE ' AS key,
   'crm-' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_suppkey AS ord FROM supplier
  UNION ALL SELECT ' customer' || lpad(CAST(s_suppkey * 13 AS VARCHAR), 9, '0') || '.example', 'crm-dup-' || CAST(s_suppkey AS VARCHAR),
   'dup', s_suppkey + 100000 FROM supplier WHERE s_acctbal > 5000),
vals AS (SELECT DISTINCT lower(trim({N2_SQL.format(u='company_domain')})) AS value FROM v),
crm1 AS (SELECT lower(trim(key)) AS value, arg_min(id, ord) AS id, arg_min(name, ord) AS name FROM crm GROUP BY 1),
j4 AS (SELECT vals.value, crm1.value IS NOT NULL AS exists, crm1.id, crm1.name FROM vals LEFT JOIN crm1 USING (value))"""


def _crm(spark, d):
    s = read_table(spark, d, "supplier")
    key = F.concat(F.lit("Customer"), F.lpad((F.col("s_suppkey") * 13).cast("string"), 9, "0"))
    a = s.select(F.concat(key, F.lit(".EXAMPLE ")).alias("key"),
                 F.concat(F.lit("crm-"), F.col("s_suppkey").cast("string")).alias("id"),
                 F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    b = s.where(F.col("s_acctbal") > 5000).select(
        F.concat(F.lit(" "), F.lower(key), F.lit(".example")).alias("key"),
        F.concat(F.lit("crm-dup-"), F.col("s_suppkey").cast("string")).alias("id"),
        F.lit("dup").alias("name"), (F.col("s_suppkey") + 100000).alias("ord"))
    return a.unionByName(b)


def _j4(spark, d):
    vals = companies_src(spark, d).select(normalize_domain("company_domain").alias("value"))
    return crm_dedupe(vals, _crm(spark, d))


@register("j4_crm_dedupe", f"WITH {CRM_CTE} SELECT * FROM j4")
def q_j4(spark, d):
    return _j4(spark, d)


@register("j4_crm_counts", f"""WITH {CRM_CTE}
SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE exists) AS BIGINT) AS found FROM j4""")
def q_j4c(spark, d):
    return _j4(spark, d).agg(F.count(F.lit(1)).alias("checked"), F.count_if("exists").alias("found"))


@register("j5_with_intel", f"""WITH {CONTACTS_CTE}, {COMPANIES_CTE.split(HITS_CTE + ",", 1)[1]}
SELECT c.list_id, c.id, co.id AS account_id, co.intel_view AS account_intel_view
FROM contacts c LEFT JOIN companies co ON c.list_id = co.list_id
  AND {N2_SQL.format(u='c.company_domain')} = co.company_domain_normalized""")
def q_j5(spark, d):
    j = with_intel(contacts(spark, d), companies(spark, d))
    return j.select("list_id", "id", F.col("account_id"),
                    F.try_element_at("account_intel", F.lit("view")).alias("account_intel_view"))


REGIONS_VALUES = ", ".join(f"('{r}', '{c}')" for r, cs in REGIONS.items() for c in cs)
CAP_SQL = "upper(left({x}, 1)) || lower(substr({x}, 2))"


@register("j6_expand_regions", f"""WITH rg(region, country) AS (VALUES {REGIONS_VALUES}),
g AS (SELECT {CAP_SQL.format(x='r_name')} AS geography FROM region
      UNION ALL SELECT {CAP_SQL.format(x='n_name')} FROM nation)
SELECT DISTINCT coalesce(rg.country, g.geography) AS geography FROM g LEFT JOIN rg ON g.geography = rg.region""")
def q_j6(spark, d):
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))
    g = (read_table(spark, d, "region").select(cap(F.col("r_name")).alias("geography"))
         .unionByName(read_table(spark, d, "nation").select(cap(F.col("n_name")).alias("geography"))))
    return expand_regions(g, "geography")


ROLE_TITLES = [("Economic Buyer", "red widget", "persona"), ("Economic Buyer", "Blue  Bolt", "persona"),
               ("Economic Buyer", "hot gear", "expansion"), ("Compliance Champion", "small ring", "persona"),
               ("Compliance Champion", "old bolt", "expansion"), ("Compliance Champion", "red widget", "expansion")]


@register("j7_match_roles", """SELECT p_partkey, p_name AS title,
  CASE WHEN p_name IN ('red widget', 'small ring', 'old bolt') THEN 'Compliance Champion'
       WHEN p_name IN ('blue bolt', 'hot gear') THEN 'Economic Buyer' END AS matched_role,
  regexp_matches(p_name, '(^|[^a-z0-9])gizmo([^a-z0-9]|$)') AS sense_excluded
FROM part""")
def q_j7(spark, d):
    rt = spark.createDataFrame(ROLE_TITLES, "role string, title string, provenance string")
    p = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    return match_roles(p, rt, senses=["gizmo"]).select("p_partkey", "title", "matched_role", "sense_excluded")


J8_INPUT = ("SELECT ord, list_id, company_name, company_domain, user_id, "
            "CASE ord % 3 WHEN 0 THEN 'x@gmail.com' WHEN 1 THEN first_name || '@Mail' || CAST(user_id % 40 AS STRING) "
            "|| '.example' END AS email FROM h")


@register("j8_backfill_domain", f"""WITH {HITS_CTE}, x AS ({J8_INPUT}),
b AS (SELECT DISTINCT company_name, 'brief' || CAST(user_id % 40 AS VARCHAR) || '.example' AS domain FROM h WHERE user_id % 40 < 5),
p AS (SELECT list_id, company_name, arg_min(company_domain, ord) AS peer FROM x WHERE company_domain <> '' GROUP BY ALL)
SELECT x.ord,
  CASE WHEN x.company_domain <> '' THEN x.company_domain WHEN b.domain IS NOT NULL THEN b.domain
       WHEN p.peer IS NOT NULL THEN p.peer WHEN x.ord % 3 = 1 THEN 'mail' || CAST(x.user_id % 40 AS VARCHAR) || '.example' END
    AS company_domain,
  CASE WHEN x.company_domain <> '' THEN 'given' WHEN b.domain IS NOT NULL THEN 'brief'
       WHEN p.peer IS NOT NULL THEN 'batch' WHEN x.ord % 3 = 1 THEN 'email' END AS domain_source
FROM x LEFT JOIN b USING (company_name) LEFT JOIN p USING (list_id, company_name)""")
def q_j8(spark, d):
    h = hits(spark, d)
    x = spark.sql(J8_INPUT.replace("FROM h", "FROM {h}"), h=h)
    brief = (h.where(F.col("user_id") % 40 < 5)
             .select("company_name", F.concat(F.lit("brief"), (F.col("user_id") % 40).cast("string"),
                                              F.lit(".example")).alias("domain")).distinct())
    brief = brief.unionByName(brief.withColumn("domain", F.concat("domain", F.lit(".zz"))))   # the smallest wins
    return backfill_domain(x, brief).select("ord", "company_domain", "domain_source")


@register("j12_valid_track", """WITH s AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'view'),
r AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'click'),
m AS (SELECT r.id AS request_id, r.ts, (SELECT s.id FROM s WHERE s.user_id = r.user_id AND s.ts <= r.ts
  AND s.ts >= r.ts - INTERVAL 6 HOUR ORDER BY s.ts DESC, s.id DESC LIMIT 1) AS track_id FROM r)
SELECT request_id, ts, track_id,
  coalesce(track_id IS NOT NULL AND row_number() OVER (PARTITION BY track_id ORDER BY ts, request_id) = 1, false) AS valid
FROM m""")
def q_j12(spark, d):
    ev = read_table(spark, d, "events")
    s = ev.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("id"), "ts")
    r = ev.where(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("id"), "ts")
    return valid_track(r, s, 6)


@register("f10_fresh", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 90 DAY""")
def q_f10(spark, d):
    return fresh(read_table(spark, d, "orders"), "o_orderdate", "1998-08-02 00:00:00", "90 DAYS").select(
        "o_orderkey", "o_orderdate")


@register("j13_lookup_linkedin", f"""WITH {HITS_CTE},
k AS (SELECT *, 'Co' || CAST(user_id % 4 AS VARCHAR) AS co, {N1_SQL.format(u='linkedin_url')} AS u FROM h),
p AS (SELECT last_name, co, min(u) AS found_url FROM k WHERE u IS NOT NULL GROUP BY ALL HAVING count(DISTINCT u) = 1)
SELECT k.ord, p.found_url FROM k LEFT JOIN p USING (last_name, co) WHERE k.linkedin_url IS NULL""")
def q_j13(spark, d):
    k = hits(spark, d).withColumn("co", F.concat(F.lit("Co"), (F.col("user_id") % 4).cast("string")))
    return lookup_linkedin(k.where(F.col("linkedin_url").isNull()).select("ord", "last_name", "co"),
                           k.select("last_name", "co", "linkedin_url"), ["last_name", "co"]).select("ord", "found_url")


@register("j14_reverse_lookup", """WITH keys AS (SELECT CASE WHEN o_orderkey % 2 = 0
    THEN 'u' || CAST(o_custkey AS VARCHAR) || '@people.example' ELSE '+1555' || CAST(o_custkey AS VARCHAR) END AS key FROM orders),
ppl AS (SELECT c_custkey, c_name, 'u' || CAST(c_custkey AS VARCHAR) || '@people.example' AS email,
  '+1555' || CAST(c_custkey AS VARCHAR) AS phone FROM customer)
SELECT key, 'email' AS kind, c_custkey, c_name FROM keys JOIN ppl ON key = email
UNION ALL SELECT key, 'phone', c_custkey, c_name FROM keys JOIN ppl ON key = phone""")
def q_j14(spark, d):
    o = read_table(spark, d, "orders")
    keys = o.select(F.when(F.col("o_orderkey") % 2 == 0,
                           F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@people.example")))
                    .otherwise(F.concat(F.lit("+1555"), F.col("o_custkey").cast("string"))).alias("key"))
    c = read_table(spark, d, "customer")
    ppl = c.select("c_custkey", "c_name",
                   F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@people.example")).alias("email"),
                   F.concat(F.lit("+1555"), F.col("c_custkey").cast("string")).alias("phone"))
    return reverse_lookup(keys, ppl).select("key", "kind", "c_custkey", "c_name")


@register("j15_resolve_companies", r"""WITH c AS (SELECT c_custkey, c_name,
  regexp_replace(lower(replace(c_name, ' ', '-')), '[^a-z0-9-]', '', 'g') AS direct FROM customer)
SELECT CASE c_custkey % 5 WHEN 1 THEN 'https://www.LinkedIn.com/company/' || direct || '/?x=1' WHEN 2 THEN 'https://' || direct || '.example.com/about'
    ELSE c_name END AS company,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://www.linkedin.com/company/' || direct
    WHEN c_custkey % 3 = 1 AND c_custkey % 5 NOT IN (1, 2) THEN 'https://www.linkedin.com/company/' || direct || '-gmbh' END AS url,
  CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 5 WHEN 1 THEN 'url' WHEN 2 THEN 'domain-direct:' || direct || '.example.com'
      ELSE 'slug:' || direct END
    WHEN c_custkey % 3 = 1 AND c_custkey % 5 NOT IN (1, 2) THEN 'slug:' || direct || '-gmbh' END AS method,
  CASE WHEN c_custkey % 3 = 2 OR (c_custkey % 3 = 1 AND c_custkey % 5 IN (1, 2)) THEN CASE c_custkey % 5
      WHEN 1 THEN 'url slug ' || chr(39) || direct || chr(39) || ' not found' WHEN 2 THEN 'no LinkedIn page for domain ' || direct || '.example.com'
      ELSE 'could not resolve ' || c_name END END AS reason
FROM c WHERE c_custkey % 5 <> 4""")
def q_j15(spark, d):
    c = read_table(spark, d, "customer")
    direct = F.regexp_replace(F.lower(F.replace("c_name", F.lit(" "), F.lit("-"))), "[^a-z0-9-]", "")
    pages = c.select(F.when(F.col("c_custkey") % 3 == 1, F.concat(direct, F.lit("-gmbh"))).otherwise(direct).alias("slug"),
                     F.when(F.col("c_custkey") % 3 == 0, "valid").when(F.col("c_custkey") % 3 == 1, "uncertain")
                     .otherwise("invalid").alias("status"))
    kind = F.col("c_custkey") % 5
    given = (F.when(kind == 1, F.concat(F.lit("https://www.LinkedIn.com/company/"), direct, F.lit("/?x=1")))
             .when(kind == 2, F.concat(F.lit("https://"), direct, F.lit(".example.com/about")))
             .when(kind == 4, " ").otherwise(F.col("c_name")))
    return resolve_companies(c.select(given.alias("company")), pages, "company")


F4_TITLES = ["gizmo", "old bolt", "Ring"]
F4_TYPES = ["promo"]


@register("f4_exclusions", """WITH x AS (SELECT p_partkey, p_name, p_type || ' ' || p_brand AS ctype,
  'b' || substr(p_brand, 7) || '.example' AS dom FROM part),
ex AS (SELECT 'b' || CAST(s_suppkey AS VARCHAR) || '.example' AS d FROM supplier WHERE s_acctbal < 1000)
SELECT p_partkey, CASE WHEN dom IN (SELECT d FROM ex) THEN 'excluded_domain'
  WHEN regexp_matches(lower(ctype), '(^|[^a-z0-9])promo([^a-z0-9]|$)') THEN 'excluded_company_type'
  WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])(gizmo|old bolt|ring)([^a-z0-9]|$)') THEN 'excluded_title' END
  AS exclusion_reason FROM x""")
def q_f4(spark, d):
    p = read_table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("title"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("company_type"),
        F.concat(F.lit("b"), F.expr("substring(p_brand, 7)"), F.lit(".example")).alias("company_domain"))
    dom = read_table(spark, d, "supplier").where(F.col("s_acctbal") < 1000).select(
        F.concat(F.lit("b"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"))
    kept, skipped = apply_exclusions(p, F4_TITLES, F4_TYPES, dom)
    return kept.unionByName(skipped).select("p_partkey", "exclusion_reason")


@register("f9_icp_filter", f"""WITH v AS ({duck(V_COMPANIES)})
SELECT ord, company_name FROM v WHERE employees BETWEEN 200 AND 2000 AND country <> 'GERMANY'
  AND industry IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""")
def q_f9(spark, d):
    return icp_filter(companies_src(spark, d), 200, 2000, countries_out=["GERMANY"],
                      industries=["BUILDING", "MACHINERY", "AUTOMOBILE"]).select("ord", "company_name")


# ---------------------------------------------------------------------------
# Enrichment: W3, J11, N23, T2, W4, A10, W5, W6, W9, F5, F6, J10, A6, A7, A14
# ---------------------------------------------------------------------------
from rosterline.operators.activate import assign_batches, assign_senders  # noqa: E402
from rosterline.operators.waterfall import (align_results, best_contact, choose_match_key,  # noqa: E402
                                            classify_answers, coverage_report, email_waterfall, estimate_cost,
                                            gate, phone_waterfall, reverify, split_submittable, waterfall_report)

RES_CTE = f"""r AS (SELECT * REPLACE (CASE WHEN ord % 13 = 0 THEN '' ELSE email END AS email) FROM ({duck(V_RESULTS)})),
val AS (SELECT email, CASE WHEN count(*) FILTER (WHERE st = 'valid') > 0 THEN 'valid'
    WHEN count(*) FILTER (WHERE st = 'catch_all') > 0 THEN 'catch_all' ELSE 'invalid' END AS status
  FROM (SELECT email, CASE CAST(floor(totalprice) AS BIGINT) % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid'
  ELSE 'catch_all' END AS st FROM r WHERE raw_status = 'guessed') GROUP BY email),
cl AS (SELECT r.*, CASE r.raw_status WHEN 'verified' THEN 'accept' WHEN 'guessed' THEN CASE val.status
    WHEN 'valid' THEN 'reverified' WHEN 'catch_all' THEN 'flag' ELSE 'miss' END ELSE 'miss' END AS verdict,
  rank * 1000000000000 + ord AS rk FROM r LEFT JOIN val USING (email)),
win AS (SELECT contact_id, min(rk) AS wrk FROM cl WHERE verdict IN ('accept', 'flag', 'reverified') AND email <> '' GROUP BY 1),
w2 AS (SELECT cl.contact_id, cl.email, cl.provider, cl.verdict FROM cl JOIN win ON cl.contact_id = win.contact_id AND cl.rk = win.wrk),
lg AS (SELECT cl.contact_id, string_agg(cl.provider || ':' || cl.raw_status, '→' ORDER BY cl.rk) AS log
  FROM cl LEFT JOIN win USING (contact_id) WHERE win.wrk IS NULL OR cl.rk <= win.wrk GROUP BY 1),
ew AS (SELECT c.c_custkey AS contact_id, w2.email, coalesce(w2.provider, 'not_found') AS email_source,
  CASE w2.verdict WHEN 'accept' THEN 'accepted' WHEN 'flag' THEN 'accepted_catch_all' WHEN 'reverified' THEN 'reverified'
    ELSE 'not_found' END AS email_validation,
  CASE WHEN lg.log IS NULL THEN '' ELSE lg.log || '→' END
    || CASE WHEN w2.email IS NULL THEN 'not_found' ELSE 'accepted' END AS email_waterfall_log
  FROM customer c LEFT JOIN w2 ON c.c_custkey = w2.contact_id LEFT JOIN lg ON c.c_custkey = lg.contact_id)"""


def _answers(spark, d):
    # Some answers have a status but no address.
    r = results_src(spark, d).withColumn("email", F.when(F.col("ord") % 13 == 0, "").otherwise(F.col("email")))
    sem = (r.select("provider").distinct()
           .select("provider", F.explode(F.array(
               *[F.struct(F.lit(a).alias("raw_status"), F.lit(b).alias("verdict"))
                 for a, b in (("verified", "accept"), ("guessed", "reverify"), ("unavailable", "miss"))])).alias("_s"))
           .select("provider", "_s.raw_status", "_s.verdict"))
    fl = F.floor("totalprice").cast("bigint") % 3
    val = r.where(F.col("raw_status") == "guessed").select(
        "email", F.when(fl == 0, "invalid").when(fl == 1, "valid").otherwise("catch_all").alias("status"))
    val = val.unionByName(val).unionByName(val.withColumn("status", F.lit("invalid")))   # checked several times
    return reverify(classify_answers(r, sem), val)


def _email_wf(spark, d):
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("contact_id"))
    return email_waterfall(cust, _answers(spark, d))


@register("w3_email_waterfall", f"WITH {RES_CTE} SELECT * FROM ew")
def q_w3(spark, d):
    return _email_wf(spark, d)


@register("j11_reverify", f"WITH {RES_CTE} SELECT ord, contact_id, verdict FROM cl")
def q_j11(spark, d):
    return _answers(spark, d).select("ord", "contact_id", "verdict")


@register("t2_advance_not_found", f"""WITH {RES_CTE}
SELECT contact_id AS id, 'email_enriched' AS stage, email, email_source,
  TIMESTAMP '{NOW}' AS email_enriched_at FROM ew""")
def q_t2(spark, d):
    cust = read_table(spark, d, "customer").select(
        F.lit(1).cast("bigint").alias("list_id"), F.col("c_custkey").alias("id"), F.lit("qualified").alias("stage"),
        F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("email_source"),
        F.lit(None).cast("timestamp_ntz").alias("email_enriched_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    upd = _email_wf(spark, d).select(F.lit(1).cast("bigint").alias("list_id"), F.col("contact_id").alias("id"),
                                     F.lit("email_enriched").alias("stage"), "email", "email_source")
    return advance_stage(cust, upd, NOW).select("id", "stage", "email", "email_source", "email_enriched_at")


@register("a10_waterfall_report", f"""WITH {RES_CTE},
a AS (SELECT provider, count(*) FILTER (WHERE email IS NOT NULL) AS found, count(*) FILTER (WHERE verdict = 'miss') AS rejected
  FROM cl GROUP BY 1),
w AS (SELECT email_source AS provider, count(*) AS accepted, count(*) FILTER (WHERE email_validation = 'reverified') AS reverified
  FROM ew WHERE email_source <> 'not_found' GROUP BY 1)
SELECT provider, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(coalesce(rejected, 0) AS BIGINT) AS rejected,
  CAST(coalesce(accepted, 0) AS BIGINT) AS accepted, CAST(coalesce(reverified, 0) AS BIGINT) AS reverified
FROM a FULL JOIN w USING (provider)""")
def q_a10(spark, d):
    return waterfall_report(_answers(spark, d), _email_wf(spark, d))


PHONE_CTE = f"""r AS ({duck(V_RESULTS)}),
pa AS (SELECT ord, contact_id, provider, rank,
  '+49' || CAST(contact_id AS VARCHAR) || lpad(CAST(ord % 1000 AS VARCHAR), 3, '0') AS phone,
  CASE ord % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'direct_dial' ELSE 'switchboard' END AS phone_type,
  CASE raw_status WHEN 'verified' THEN 'valid' WHEN 'guessed' THEN 'invalid' END AS validation FROM r),
pk AS (SELECT *, (CASE phone_type WHEN 'mobile' THEN 1 WHEN 'direct_dial' THEN 2 ELSE 3 END) * 1000000000000000
  + rank * 1000000000000 + ord AS k FROM pa WHERE validation = 'valid' OR validation IS NULL),
pw AS (SELECT contact_id, arg_min(phone, k) AS phone, arg_min(phone_type, k) AS phone_type,
  arg_min(provider, k) AS provider, arg_min(coalesce(validation, 'unvalidated'), k) AS validation FROM pk GROUP BY 1)"""


def _phone_answers(spark, d):
    r = results_src(spark, d)
    t = F.col("ord") % 3
    return r.select("ord", "contact_id", "provider", "rank",
                    F.concat(F.lit("+49"), F.col("contact_id").cast("string"),
                             F.lpad((F.col("ord") % 1000).cast("string"), 3, "0")).alias("phone"),
                    F.when(t == 0, "mobile").when(t == 1, "direct_dial").otherwise("switchboard").alias("phone_type"),
                    F.when(F.col("raw_status") == "verified", "valid").when(F.col("raw_status") == "guessed", "invalid")
                    .alias("validation"))


@register("w4_phone_waterfall", f"""WITH {PHONE_CTE}
SELECT c.c_custkey AS contact_id, pw.phone, pw.phone_type, coalesce(pw.provider, 'not_found') AS phone_source,
  coalesce(pw.validation, 'not_found') AS phone_validation,
  coalesce(pw.validation = 'unvalidated' OR pw.phone_type = 'switchboard', false) AS flagged
FROM customer c LEFT JOIN pw ON c.c_custkey = pw.contact_id""")
def q_w4(spark, d):
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("contact_id"))
    return phone_waterfall(cust, _phone_answers(spark, d))


@register("w5_assign_batches", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, CAST((row_number() OVER (PARTITION BY list_id ORDER BY ord) - 1) // 100 AS BIGINT) AS batch_no,
  CAST((row_number() OVER (PARTITION BY list_id ORDER BY ord) - 1) % 100 AS BIGINT) AS batch_pos FROM contacts""")
def q_w5(spark, d):
    return assign_batches(contacts(spark, d), BATCH_SIZES["fullenrich"]).select("list_id", "id", "batch_no", "batch_pos")


@register("w6_assign_senders", f"""WITH {CONTACTS_CTE},
acc AS (SELECT n_name AS account_id, row_number() OVER (ORDER BY n_nationkey) AS slot
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
l AS (SELECT list_id, id, (row_number() OVER (PARTITION BY list_id ORDER BY ord) - 1) % (SELECT count(*) FROM acc) + 1 AS slot
  FROM contacts)
SELECT l.list_id, l.id, acc.account_id FROM l LEFT JOIN acc USING (slot)""")
def q_w6(spark, d):
    n = read_table(spark, d, "nation")
    r = read_table(spark, d, "region").where(F.col("r_name") == "EUROPE")
    acc = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("account_id"),
                                                           F.col("n_nationkey").alias("account_ord"))
    return assign_senders(contacts(spark, d), acc).select("list_id", "id", "account_id")


@register("w9_best_contact", f"""WITH {CONTACTS_CTE}
SELECT list_id, company, id FROM (SELECT *, CASE WHEN ord % 11 <> 0 THEN company_name END AS company,
  CASE WHEN ord % 7 <> 0 THEN qualification_score END AS score FROM contacts)
QUALIFY row_number() OVER (PARTITION BY list_id, company ORDER BY score DESC NULLS LAST, ord) = 1""")
def q_w9(spark, d):
    c = contacts(spark, d).withColumn("company", F.when(F.col("ord") % 11 != 0, F.col("company_name"))).withColumn(
        "score", F.when(F.col("ord") % 7 != 0, F.col("qualification_score")))
    return best_contact(c, "score", ["list_id", "company"]).select("list_id", "company", "id")


@register("f5_split_submittable", f"""WITH {CONTACTS_CTE}
SELECT list_id, id, ord, CASE WHEN company_domain = '' OR company_domain IS NULL THEN 'empty_domain' END AS reason
FROM contacts""")
def q_f5(spark, d):
    sub, exc = split_submittable(contacts(spark, d))
    return sub.withColumn("reason", F.lit(None).cast("string")).unionByName(exc).select("list_id", "id", "ord", "reason")


F6_INPUT = ("SELECT ord, first_name, last_name, linkedin_url, company_domain, user_id, "
            "CASE WHEN ord % 10 <> 5 THEN company_name END AS company_name, "
            "CASE WHEN ord % 2 = 0 THEN 'e' || CAST(ord AS STRING) || '@x.example' END AS email FROM h")


@register("f6_match_key", f"""WITH {HITS_CTE}, x AS ({F6_INPUT}),
y AS (SELECT *, coalesce(linkedin_url <> '' AND NOT contains(lower(linkedin_url), '/in/acw'), false) AS vanity,
  coalesce(company_domain, '') <> '' AS dom FROM x)
SELECT ord,
  CASE WHEN user_id % 6 = 0 THEN 'id' WHEN vanity THEN 'linkedin_url' ELSE 'name+domain' END AS apollo_key,
  CASE WHEN vanity THEN 'linkedin_url' WHEN dom THEN 'domain+full_name' END AS aiark_phone_key,
  CASE WHEN NOT vanity AND NOT dom THEN 'no_phone_key' END AS aiark_excluded,
  CASE WHEN dom THEN 'name+domain' WHEN company_name IS NOT NULL THEN 'full_name+company_name'
       WHEN vanity THEN 'profile_url' END AS lm_email_key,
  CASE WHEN vanity THEN 'profile_url' WHEN email IS NOT NULL THEN 'work_email' END AS lm_phone_key
FROM y""")
def q_f6(spark, d):
    h = hits(spark, d)
    x = spark.sql(F6_INPUT.replace("FROM h", "FROM {h}"), h=h).withColumn(
        "provider_ids", F.when(F.col("user_id") % 6 == 0, F.create_map(F.lit("apollo"),
                                                                       F.concat(F.lit("ap"), F.col("user_id").cast("string")))))
    # One projection: each provider's rule adds its columns to the same rows.
    for prov, cap, kcol, xcol in (("apollo", "email_enrich", "apollo_key", None),
                                  ("ai-ark", "phone_enrich", "aiark_phone_key", "aiark_excluded"),
                                  ("leadmagic", "email_enrich", "lm_email_key", None),
                                  ("leadmagic", "phone_enrich", "lm_phone_key", None)):
        x = choose_match_key(x, prov, cap).withColumnRenamed("match_key", kcol)
        x = x.withColumnRenamed("excluded", xcol) if xcol else x.drop("excluded")
    return x.select("ord", "apollo_key", "aiark_phone_key", "aiark_excluded", "lm_email_key", "lm_phone_key")


@register("j10_align_results", f"""WITH {CONTACTS_CTE},
b AS (SELECT list_id, id, ord, (row_number() OVER (PARTITION BY list_id ORDER BY ord) - 1) // 100 AS batch_no,
  (row_number() OVER (PARTITION BY list_id ORDER BY ord) - 1) % 100 AS batch_pos FROM contacts),
n AS (SELECT *, count(*) OVER (PARTITION BY list_id, batch_no) AS n FROM b)
SELECT list_id, id, CAST(batch_no AS BIGINT) AS batch_no, CAST(batch_pos AS BIGINT) AS batch_pos,
  CASE WHEN batch_pos < n - 3 THEN 'ans' || CAST(ord AS VARCHAR) END AS answer FROM n""")
def q_j10(spark, d):
    from pyspark.sql import Window
    sub = assign_batches(contacts(spark, d), 100).select("list_id", "id", "ord", "batch_no", "batch_pos")
    n = sub.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("list_id", "batch_no")))
    ans = (n.where(F.col("batch_pos") < F.col("_n") - 3)
           .groupBy("list_id", "batch_no")
           .agg(F.array_sort(F.collect_list(F.struct("batch_pos", F.concat(F.lit("ans"), F.col("ord").cast("string")).alias("a"))))
                .alias("_s"))
           .select("list_id", "batch_no", F.to_json(F.transform("_s", lambda x: x["a"])).alias("items")))
    return align_results(sub, ans).select("list_id", "id", "batch_no", "batch_pos", "answer")


COST_SQL = f"""WITH {CONTACTS_CTE},
kk AS (SELECT *, coalesce(company_domain, '') <> '' AS sub,
  coalesce(linkedin_url <> '' AND NOT contains(lower(linkedin_url), '/in/acw'), false) AS vanity FROM contacts),
cost AS (SELECT list_id, count(*) FILTER (WHERE sub) AS fullenrich_submittable,
  count(*) FILTER (WHERE NOT sub) AS fullenrich_excluded_empty_domain,
  CAST(count(*) FILTER (WHERE sub) AS BIGINT) AS fullenrich_email_credits,
  CAST(count(*) FILTER (WHERE sub) * 10 AS BIGINT) AS fullenrich_phone_credits,
  CAST(count(*) AS BIGINT) AS aiark_email_credits,
  CAST(count(*) FILTER (WHERE vanity OR sub) AS BIGINT) AS aiark_phone_credits,
  CAST(count(*) FILTER (WHERE NOT (vanity OR sub)) AS BIGINT) AS aiark_phone_excluded,
  CAST(0.02 + count(*) * 0.004 AS DECIMAL(10, 2)) AS apify_usd FROM kk GROUP BY list_id)"""


@register("a6_estimate_cost", COST_SQL + " SELECT * FROM cost")
def q_a6(spark, d):
    return estimate_cost(contacts(spark, d))


@register("a7_spend_gate", COST_SQL + """
SELECT list_id, CAST(fullenrich_submittable AS BIGINT) AS contacts, fullenrich_phone_credits AS credits,
  CASE WHEN fullenrich_phone_credits > 3000 THEN 'blocked'
       WHEN fullenrich_submittable > 50 OR fullenrich_phone_credits > 500 THEN 'confirm' ELSE 'proceed' END AS decision
FROM cost""")
def q_a7(spark, d):
    c = estimate_cost(contacts(spark, d)).select(
        "list_id", F.col("fullenrich_submittable").cast("bigint").alias("contacts"),
        F.col("fullenrich_phone_credits").alias("credits"))
    return gate(c, 50, 500, 3000)


@register("a14_coverage_report", f"""WITH {CONTACTS_CTE},
kk AS (SELECT *, coalesce(linkedin_url <> '' AND NOT contains(lower(linkedin_url), '/in/acw'), false) AS vanity,
  coalesce(company_domain, '') <> '' AS dom FROM contacts)
SELECT list_id, count(*) AS rows, count(*) FILTER (WHERE vanity) AS with_linkedin,
  count(*) FILTER (WHERE coalesce(contains(lower(linkedin_url), '/in/acw'), false)) AS member_id_urls,
  count(*) FILTER (WHERE NOT vanity AND dom) AS name_domain_only,
  count(*) FILTER (WHERE NOT vanity AND NOT dom) AS no_key FROM kk GROUP BY list_id""")
def q_a14(spark, d):
    return coverage_report(contacts(spark, d))


# ---------------------------------------------------------------------------
# Qualification: Q1–Q5, T3, U2, A9 (titles from part, firmographics from v_companies)
# ---------------------------------------------------------------------------
from rosterline.operators.qualify import (apply_qualification, qualify, qualify_report, score_company,  # noqa: E402
                                          score_completeness, score_novelty, score_persona, union_titles)

PERSONA_SENIORITY = [("Economic Buyer", "ECONOMY", "exact"), ("Economic Buyer", "PROMO", "exact"),
                     ("Economic Buyer", "STANDARD", "adjacent"), ("Compliance Champion", "SMALL", "exact"),
                     ("Compliance Champion", "MEDIUM", "exact"), ("Compliance Champion", "LARGE", "adjacent")]
SEGMENTS = [{"segment": "A", "points": 3, "min_employees": 200, "max_employees": 2000, "region": "EUROPE"},
            {"segment": "B", "points": 2, "min_employees": 50, "max_employees": 199},
            {"segment": "B", "points": 1, "min_employees": 2001, "region": "ASIA"}]
Q_EXCLUDE_TITLES = ["old"]


def _prospects(spark, d):
    h = hits(spark, d)
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("seniority"))
    comp = companies_src(spark, d).select("ord", "employees", "region")
    t = _touches(spark, d)
    master = rollup_master(t.where(F.col("ts") < F.lit(BATCH_SPLIT).cast("timestamp_ntz")))
    # Each hit is a person in some part's role at some company: every company and part is reached.
    n_part, n_comp = part.count(), comp.count()
    part = part.withColumn("_p", F.pmod("p_partkey", F.lit(n_part))).drop("p_partkey")
    comp = comp.withColumn("_c", F.pmod("ord", F.lit(n_comp))).drop("ord")
    x = (h.withColumn("_p", F.pmod("ord", F.lit(n_part))).withColumn("_c", F.pmod(F.col("ord") * 7, F.lit(n_comp)))
         .join(part, "_p", "left").join(comp, "_c", "left").drop("_p", "_c"))
    x = crossref_master(x, master, "linkedin_url").withColumnRenamed("status", "db_status")
    rt = spark.createDataFrame(ROLE_TITLES, "role string, title string, provenance string")
    ps = spark.createDataFrame(PERSONA_SENIORITY, "role string, seniority string, fit string")
    x = score_persona(x, rt, ps, senses=["gizmo"])
    x = score_completeness(score_company(x, rules=SEGMENTS))
    x = score_novelty(x)
    return qualify(mark_exclusions(x, Q_EXCLUDE_TITLES))


PROSPECTS_CTE = MASTER_CTE + f""",
pv AS (SELECT ord AS cord, employees, region FROM ({duck(V_COMPANIES)})),
pr AS (SELECT h.* EXCLUDE (qualification_score), p.p_name AS title, p.p_type AS seniority, pv.employees, pv.region,
  CASE WHEN m.linkedin_url_normalized IS NULL THEN 'new' WHEN m.has_unsubscribed THEN 'unsubscribed'
    WHEN m.has_bounced AND NOT m.has_replied THEN 'bounced' WHEN m.overall_status = 'interested' THEN 'interested'
    WHEN m.has_replied THEN 'replied' ELSE 'previously_contacted' END AS db_status
  FROM h LEFT JOIN part p ON h.ord % (SELECT count(*) FROM part) = p.p_partkey
  LEFT JOIN pv ON (h.ord * 7) % (SELECT count(*) FROM customer) = pv.cord
  LEFT JOIN master m ON {N1_SQL.format(u='h.linkedin_url')} = m.linkedin_url_normalized),
sc AS (SELECT *,
  CASE WHEN regexp_matches(title, '(^|[^a-z0-9])gizmo([^a-z0-9]|$)') THEN 0
       WHEN title IN ('red widget', 'small ring', 'old bolt') AND
            (seniority IN ('SMALL', 'MEDIUM') OR (title = 'red widget' AND seniority IN ('ECONOMY', 'PROMO'))) THEN 4
       WHEN title IN ('blue bolt', 'hot gear') AND seniority IN ('ECONOMY', 'PROMO') THEN 4
       WHEN title IN ('red widget', 'small ring', 'old bolt') AND seniority = 'LARGE' THEN 2
       WHEN title IN ('red widget', 'blue bolt', 'hot gear') AND seniority = 'STANDARD' THEN 2 ELSE 0 END AS persona_points,
  CASE WHEN title IN ('red widget', 'small ring', 'old bolt') AND seniority IN ('SMALL', 'MEDIUM') THEN 'Compliance Champion'
       WHEN title = 'red widget' AND seniority IN ('ECONOMY', 'PROMO') THEN 'Economic Buyer'
       WHEN title IN ('blue bolt', 'hot gear') AND seniority IN ('ECONOMY', 'PROMO') THEN 'Economic Buyer'
       WHEN title IN ('red widget', 'small ring', 'old bolt') AND seniority = 'LARGE' THEN 'Compliance Champion'
       WHEN title IN ('red widget', 'blue bolt', 'hot gear') AND seniority = 'STANDARD' THEN 'Economic Buyer' END AS matched_persona,
  CASE WHEN employees BETWEEN 200 AND 2000 AND region = 'EUROPE' THEN 'A' WHEN employees >= 50 AND employees < 200 THEN 'B'
       WHEN employees > 2000 AND region = 'ASIA' THEN 'B' ELSE 'C' END AS company_segment,
  (coalesce(linkedin_url <> '', false))::INT + (coalesce(company_domain <> '', false))::INT AS completeness_points,
  CASE WHEN db_status = 'new' THEN 1 ELSE 0 END AS novelty_points,
  CASE WHEN regexp_matches(title, '(^|[^a-z0-9])old([^a-z0-9]|$)') THEN 'excluded_title' END AS exclusion_reason
  FROM pr),
q AS (SELECT *, CASE company_segment WHEN 'A' THEN 3 WHEN 'B' THEN CASE WHEN employees > 2000 THEN 1 ELSE 2 END ELSE 0 END
  AS company_points FROM sc),
qs AS (SELECT *, CASE WHEN exclusion_reason IS NULL THEN persona_points + company_points + completeness_points + novelty_points END
    AS qualification_score,
  CASE WHEN exclusion_reason IS NOT NULL THEN 'SKIP'
       WHEN persona_points + company_points + completeness_points + novelty_points >= 7 THEN 'QUALIFY'
       WHEN persona_points + company_points + completeness_points + novelty_points >= 4 THEN 'MAYBE' ELSE 'SKIP' END
    AS qualification_status FROM q),
t3 AS (SELECT *, qualification_status = 'QUALIFY' OR (qualification_status = 'MAYBE' AND qualification_score >= 5) AS ok FROM qs),
t3o AS (SELECT *, CASE WHEN ok THEN 'qualified' ELSE 'skipped' END AS stage, CASE WHEN ok THEN 'yes' ELSE 'no' END AS enrich_recommended,
  CASE WHEN ok THEN NULL WHEN exclusion_reason IS NOT NULL THEN exclusion_reason
       WHEN qualification_status = 'MAYBE' THEN 'maybe_rejected' ELSE 'low_score' END AS qualification_notes FROM t3)"""


@register("q1_score_persona", f"WITH {PROSPECTS_CTE} SELECT ord, persona_points, matched_persona FROM sc")
def q_q1(spark, d):
    return _prospects(spark, d).select("ord", "persona_points", "matched_persona")


@register("q2_score_company", f"WITH {PROSPECTS_CTE} SELECT ord, company_segment, company_points FROM q")
def q_q2(spark, d):
    return _prospects(spark, d).select("ord", "company_segment", "company_points")


@register("q3_score_completeness", f"WITH {PROSPECTS_CTE} SELECT ord, completeness_points FROM sc")
def q_q3(spark, d):
    return _prospects(spark, d).select("ord", "completeness_points")


@register("q4_score_novelty", f"WITH {PROSPECTS_CTE} SELECT ord, db_status, novelty_points FROM sc")
def q_q4(spark, d):
    return _prospects(spark, d).select("ord", "db_status", "novelty_points")


@register("q5_qualify", f"WITH {PROSPECTS_CTE} SELECT ord, qualification_score, qualification_status FROM qs")
def q_q5(spark, d):
    return _prospects(spark, d).select("ord", "qualification_score", "qualification_status")


@register("t3_apply_qualification", f"WITH {PROSPECTS_CTE} SELECT ord, stage, enrich_recommended, qualification_notes FROM t3o")
def q_t3(spark, d):
    p = _prospects(spark, d)
    return apply_qualification(p, F.col("qualification_score") >= 5).select(
        "ord", "stage", "enrich_recommended", "qualification_notes")


@register("a9_qualify_report", f"""WITH {PROSPECTS_CTE}
SELECT 'tier' AS dim, qualification_status AS value, CAST(count(*) AS BIGINT) AS n FROM t3o GROUP BY 2
UNION ALL SELECT 'segment', company_segment, count(*) FROM t3o GROUP BY 2
UNION ALL SELECT 'persona', coalesce(matched_persona, '(none)'), count(*) FROM t3o GROUP BY 2""")
def q_a9(spark, d):
    p = _prospects(spark, d)
    sets, _ = qualify_report(apply_qualification(p, F.col("qualification_score") >= 5))
    return sets


@register("a9_top_skip_reasons", f"""WITH {PROSPECTS_CTE}
SELECT qualification_notes, CAST(count(*) AS BIGINT) AS n FROM t3o WHERE qualification_notes IS NOT NULL
GROUP BY 1 ORDER BY n DESC, qualification_notes LIMIT 3""")
def q_a9b(spark, d):
    p = _prospects(spark, d)
    _, reasons = qualify_report(apply_qualification(p, F.col("qualification_score") >= 5))
    return reasons


@register("u2_union_titles", f"""WITH pt(title) AS (VALUES {", ".join(f"('{t}')" for _, t, _ in ROLE_TITLES)}),
u AS (SELECT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title, 'persona' AS provenance FROM pt
  UNION ALL SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), 'profile' FROM part)
SELECT title, min(provenance) AS provenance FROM u GROUP BY title""")
def q_u2(spark, d):
    rt = spark.createDataFrame(ROLE_TITLES, "role string, title string, provenance string")
    prof = read_table(spark, d, "part").select(F.col("p_name").alias("title"))
    return union_titles(rt, prof)


# ---------------------------------------------------------------------------
# Pooling and dedup: W7, A8, A2, A3, A4
# ---------------------------------------------------------------------------
from rosterline.operators.dedupe import (companies_from_people, dedupe_companies, dedupe_contacts,  # noqa: E402
                                         source_report)
from rosterline.operators.waterfall import union_search  # noqa: E402

SOURCES = ["view", "click", "purchase", "signup", "error"]


def _pooled(spark, d):
    h = hits(spark, d).withColumn("linkedin_url_normalized", normalize_linkedin_url("linkedin_url"))
    frames = [h.where(F.col("source") == s) for s in SOURCES]
    wf = spark.createDataFrame([(s, i + 1) for i, s in enumerate(SOURCES[:-1])], "provider string, rank int")
    return union_search(frames, wf)


POOL_CTE = f"""WITH {HITS_CTE},
k AS (SELECT *, {N1_SQL.format(u='linkedin_url')} AS u,
  CASE source WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS wr FROM h),
f AS (SELECT u, arg_min(ord, wr * 1000000000000 + ord) AS ford FROM k WHERE u IS NOT NULL GROUP BY u),
pool AS (SELECT k.*, (k.u IS NULL OR k.ord = f.ford) AS net_new FROM k LEFT JOIN f USING (u))"""


@register("w7_union_search", POOL_CTE + " SELECT ord, source, net_new FROM pool")
def q_w7(spark, d):
    return _pooled(spark, d).select("ord", "source", "net_new")


@register("a8_source_report", POOL_CTE + """
SELECT source, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE net_new) AS BIGINT) AS net_new
FROM pool GROUP BY source""")
def q_a8(spark, d):
    return source_report(_pooled(spark, d))


A2_FIELDS = ["company_name", "company_domain", "industry", "country"]
A2_INPUT = ("SELECT list_id, ord, CASE WHEN ord % 4 = 0 THEN upper(company_name) ELSE company_name END AS company_name, "
            "company_domain, CASE WHEN ord % 3 = 0 THEN NULL ELSE source END AS industry, "
            "CASE WHEN ord % 7 = 0 THEN 'DE' END AS country FROM h")


@register("a2_dedupe_companies", f"""WITH {HITS_CTE}, x AS ({A2_INPUT}),
y AS (SELECT *, {N2_SQL.format(u='company_domain')} AS dk, {N3_SQL.format(n='company_name')} AS nk,
  (company_name IS NOT NULL AND trim(company_name) <> '')::INT + (company_domain IS NOT NULL AND trim(company_domain) <> '')::INT
  + (industry IS NOT NULL AND trim(industry) <> '')::INT + (country IS NOT NULL AND trim(country) <> '')::INT AS filled FROM x),
p1 AS (SELECT * FROM y WHERE dk IS NOT NULL QUALIFY row_number() OVER (PARTITION BY list_id, dk ORDER BY filled DESC, ord) = 1
  UNION ALL SELECT * FROM y WHERE dk IS NULL)
SELECT list_id, nk AS name_key, ord, company_domain, filled FROM p1
QUALIFY row_number() OVER (PARTITION BY list_id, nk ORDER BY filled DESC, ord) = 1""")
def q_a2(spark, d):
    x = spark.sql(A2_INPUT.replace("FROM h", "FROM {h}"), h=hits(spark, d))
    return dedupe_companies(x, A2_FIELDS, ["list_id"]).select("list_id", "name_key", "ord", "company_domain", "filled")


A3_FIELDS = ["first_name", "last_name", "company_name", "company_domain", "title"]


@register("a3_dedupe_contacts", f"""WITH {HITS_CTE},
n AS (SELECT list_id, ord, source, company_domain, CASE WHEN ord % 19 <> 0 THEN linkedin_url END AS linkedin_url,
  CASE WHEN ord % 19 <> 0 THEN first_name END AS first_name, CASE WHEN ord % 19 <> 0 AND ord % 3 <> 0 THEN last_name END AS last_name,
  CASE WHEN ord % 19 <> 0 AND ord % 5 <> 0 THEN company_name END AS company_name, CASE WHEN ord % 19 <> 0 THEN source END AS title FROM h),
x AS (SELECT *, source AS prov, 'id' || CAST(ord AS VARCHAR) AS pid,
  coalesce({N1_SQL.format(u='linkedin_url')}, CASE WHEN coalesce(first_name, last_name, company_name, title) IS NOT NULL THEN
    'name:' || CAST(to_json([first_name, last_name, company_name, title]) AS VARCHAR) END) AS dedup_key FROM n),
y AS (SELECT *, (first_name IS NOT NULL AND trim(first_name) <> '')::INT + (last_name IS NOT NULL AND trim(last_name) <> '')::INT
  + (company_name IS NOT NULL AND trim(company_name) <> '')::INT + (company_domain IS NOT NULL AND trim(company_domain) <> '')::INT
  + (title IS NOT NULL AND trim(title) <> '')::INT AS filled FROM x),
z AS (SELECT *, coalesce(dedup_key, 'own:' || CAST(ord AS VARCHAR)) AS gk FROM y),
ids AS (SELECT list_id, gk, count(DISTINCT prov) AS n_ids, arg_min(pid, ord) FILTER (WHERE prov = 'view') AS view_id
  FROM z GROUP BY ALL)
SELECT z.list_id, z.dedup_key, z.ord, z.filled, CAST(ids.n_ids AS INTEGER) AS n_ids, ids.view_id FROM z JOIN ids USING (list_id, gk)
QUALIFY row_number() OVER (PARTITION BY z.list_id, z.gk ORDER BY z.filled DESC, z.ord) = 1""")
def q_a3(spark, d):
    h = hits(spark, d)
    known = F.col("ord") % 19 != 0     # the others have no identity at all
    x = h.select("list_id", "ord", F.when(known, F.col("first_name")).alias("first_name"),
                 F.when(known & (F.col("ord") % 3 != 0), F.col("last_name")).alias("last_name"),
                 F.when(known & (F.col("ord") % 5 != 0), F.col("company_name")).alias("company_name"), "company_domain",
                 F.when(known, F.col("source")).alias("title"), F.when(known, F.col("linkedin_url")).alias("linkedin_url"),
                 F.create_map(F.col("source"), F.concat(F.lit("id"), F.col("ord").cast("string"))).alias("provider_ids"))
    out = dedupe_contacts(x, A3_FIELDS, ["list_id"])
    return out.select("list_id", "dedup_key", "ord", "filled", F.size("provider_ids").alias("n_ids"),
                      F.try_element_at("provider_ids", F.lit("view")).alias("view_id"))


@register("a4_companies_from_people", f"""WITH {HITS_CTE},
x AS (SELECT *, coalesce({N2_SQL.format(u='company_domain')}, {N3_SQL.format(n='company_name')}) AS company_key FROM h
  WHERE source IN ('view', 'click', 'purchase') AND company_name IN ('Company 1', 'Company 2'))
SELECT list_id, company_key, CAST(count(*) AS BIGINT) AS people, arg_min(company_name, ord) AS company_name,
  min(ord) AS first_ord FROM x GROUP BY ALL""")
def q_a4(spark, d):
    return companies_from_people(hits(spark, d), ["view", "click", "purchase"], ["company 1", "company 2"],
                                 industry_col="source", group=["list_id"])


# ---------------------------------------------------------------------------
# Activation: F7, F8, A11
# ---------------------------------------------------------------------------
from rosterline.operators.activate import push_report, to_lead, usable_leads  # noqa: E402

LEAD_INPUT = ("SELECT list_id, ord, first_name, last_name, company_name, company_domain, linkedin_url, "
              "CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN '' ELSE first_name || '@x.example' END AS email, "
              "source AS title, CAST(NULL AS STRING) AS phone FROM h")


def _leads(spark, d):
    return spark.sql(LEAD_INPUT.replace("FROM h", "FROM {h}"), h=hits(spark, d))


@register("f7_usable_leads", f"""WITH {HITS_CTE}, x AS ({LEAD_INPUT.replace('STRING', 'VARCHAR')})
SELECT ord, 'email' AS channel FROM x WHERE coalesce(email <> '', false) OR coalesce(linkedin_url <> '', false)
UNION ALL SELECT ord, 'linkedin' FROM x WHERE coalesce(linkedin_url <> '', false)""")
def q_f7(spark, d):
    x = _leads(spark, d)
    return (usable_leads(x, "email").select("ord", F.lit("email").alias("channel"))
            .unionByName(usable_leads(x, "linkedin").select("ord", F.lit("linkedin").alias("channel"))))


def _json_field(name, expr):
    return f"""CASE WHEN coalesce({expr}, '') <> '' THEN '"{name}":' || to_json({expr}) END"""


@register("f8_to_lead", f"""WITH {HITS_CTE}, x AS ({LEAD_INPUT.replace('STRING', 'VARCHAR')})
SELECT ord, '{{' || concat_ws(',', {_json_field('email', 'email')}, {_json_field('firstName', 'first_name')},
  {_json_field('lastName', 'last_name')}, {_json_field('companyName', 'company_name')}, {_json_field('jobTitle', 'title')},
  {_json_field('linkedinUrl', 'linkedin_url')}, {_json_field('phone', 'phone')},
  {_json_field('companyDomain', 'company_domain')}) || '}}' AS lead FROM x""")
def q_f8(spark, d):
    return to_lead(_leads(spark, d), "lemlist").select("ord", "lead")


RESP_INPUT = ("SELECT list_id, ord AS pos, coalesce(linkedin_url, first_name) AS lead_key, "
              "CASE source WHEN 'error' THEN 500 WHEN 'signup' THEN 200 ELSE 201 END AS code, "
              "CASE source WHEN 'error' THEN 'server error ' || CAST(ord AS STRING) WHEN 'signup' THEN "
              "'Lead already in the campaign' ELSE 'ok' END AS body FROM h")


@register("a11_push_report", f"""WITH {HITS_CTE}, x AS ({RESP_INPUT.replace('STRING', 'VARCHAR')})
SELECT list_id, CAST(count(*) FILTER (WHERE code IN (200, 201) AND NOT contains(lower(body), 'already in the campaign')) AS BIGINT) AS imported,
  CAST(count(*) FILTER (WHERE contains(lower(body), 'already in the campaign')) AS BIGINT) AS skipped_existing,
  CAST(count(*) FILTER (WHERE NOT (code IN (200, 201) OR contains(lower(body), 'already in the campaign'))) AS BIGINT) AS failed
FROM x GROUP BY list_id""")
def q_a11(spark, d):
    x = spark.sql(RESP_INPUT.replace("FROM h", "FROM {h}"), h=hits(spark, d))
    counts, _ = push_report(x)
    return counts


@register("a11_push_errors", f"""WITH {HITS_CTE}, x AS ({RESP_INPUT.replace('STRING', 'VARCHAR')})
SELECT list_id, pos, lead_key, code, substr(body, 1, 150) AS body FROM x
WHERE NOT (code IN (200, 201) OR contains(lower(body), 'already in the campaign'))
QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY pos) <= 20""")
def q_a11b(spark, d):
    x = spark.sql(RESP_INPUT.replace("FROM h", "FROM {h}"), h=hits(spark, d))
    _, errors = push_report(x)
    return errors


# ---------------------------------------------------------------------------
# Text scan and look-alikes: F12, O3, N22 (seed reasons)
# ---------------------------------------------------------------------------
from rosterline.operators.similar import lookalikes  # noqa: E402
from rosterline.operators.text import PLACEHOLDER_RE, SCAN_RULES, scan_text  # noqa: E402

F12_DENY = ["lorem", "password"]


# Some texts get a line for every rule, for a placeholder, or for none of them.
F12_LINES = ["gh api repos/x/y/contents/.env", "EVAL \"$(gh api x)\"", "curl -s https://x.example/contents/.env",
             "see /Users/jo.do/work/.env", "-----BEGIN RSA PRIVATE KEY-----", "API_KEY = 'abcdefghijklmnopqrstuvwxyz012345'",
             "SECRET=changeme_changeme_changeme_0", "token: <your_token>", "contents/.env alone"]


def _f12_text(n_col, quote):
    """SQL of a line that is appended to some texts; the same text runs in both engines."""
    cases = " ".join(f"WHEN {i} THEN {quote(x)}" for i, x in enumerate(F12_LINES))
    return f"CASE {n_col} % 23 {cases} ELSE '' END"


def _f12_sql(table, id_col, ident, n_col):
    parts = []
    for name, pat, ci in SCAN_RULES + [("deny_term", t, True) for t in F12_DENY]:
        ci = ci or name == "credential"
        cond = f"regexp_matches(line, '{('(?i)' if ci else '') + pat.replace(chr(39), chr(39) * 2)}')"
        if name == "credential":
            cond += f" AND NOT regexp_matches(line, '(?i){PLACEHOLDER_RE}')"
        parts.append(f"SELECT {id_col}, '{name}' AS rule, line_no, line FROM l WHERE {cond}")
    added = _f12_text(n_col, lambda x: "'" + x.replace("'", "''") + "'")
    return (f"""WITH s AS (SELECT {ident} AS {id_col}, string_split(text || chr(10) || {added}, chr(10)) AS arr FROM {table}),
l AS (SELECT {id_col}, generate_subscripts(arr, 1) AS line_no, unnest(arr) AS line FROM s)
SELECT DISTINCT * FROM (""" + "\nUNION ALL ".join(parts) + ")")


def _f12(df, id_col, n_col):
    line = F.element_at(F.array(*[F.lit(x) for x in F12_LINES]), F.pmod(n_col, F.lit(23)).cast("int") + 1)
    added = F.when(F.pmod(n_col, F.lit(23)) < len(F12_LINES), line).otherwise("")
    return scan_text(df.withColumn("text", F.concat("text", F.lit("\n"), added)), id_col, deny_terms=F12_DENY, ci_credentials=True)


@register("f12_scan_documents", _f12_sql("documents", "doc_id", "doc_id", "doc_id"))
def q_f12(spark, d):
    return _f12(read_table(spark, d, "documents"), "doc_id", F.col("doc_id"))


@register("f12_scan_conversations", _f12_sql("conversations", "conv_id", "conv_id * 1000 + turn", "conv_id"))
def q_f12b(spark, d):
    c = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text")
    out = _f12(c, "id", F.col("conv_id"))
    return out.withColumnRenamed("id", "conv_id")


@register("o3_lookalikes", """WITH seeds AS (SELECT e.vec_id AS seed_id, e.embedding AS sv FROM embeddings e
  JOIN (SELECT min(vec_id) AS vec_id FROM embeddings WHERE label < 5 GROUP BY label) m USING (vec_id)),
p AS (SELECT s.seed_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(s.sv AS DOUBLE[])) AS sim
  FROM embeddings e, seeds s WHERE e.vec_id <> s.seed_id)
SELECT vec_id, seed_id, CAST(rank AS INTEGER) AS rank, round(sim, 4) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY sim DESC, vec_id) AS rank FROM p) WHERE rank <= 10""")
def q_o3(spark, d):
    e = read_table(spark, d, "embeddings")
    seeds = e.join(e.where(F.col("label") < 5).groupBy("label").agg(F.min("vec_id").alias("vec_id")), ["vec_id", "label"])
    return lookalikes(e, seeds, 10).select("vec_id", "seed_id", "rank", "similarity")


# ---------------------------------------------------------------------------
# SQL surface: V1 (inlined SQL functions), V2 (export table function), V4 (views), F13
# ---------------------------------------------------------------------------
from rosterline.functions.normalize import register_sql_functions  # noqa: E402
from rosterline.operators.upsert import by_provider_id  # noqa: E402


@register("v1_sql_functions", f"""SELECT page_id, {N2_SQL.format(u='url')} AS domain_key,
  {N1_SQL.format(u="'https://www.LinkedIn.com/in/P' || CAST(page_id AS VARCHAR) || '/?x=1'")} AS li_key,
  {N3_SQL.format(n="'  Page  ' || CAST(page_id AS VARCHAR)")} AS name_key FROM pages""")
def q_v1(spark, d):
    register_sql_functions(spark)
    return spark.sql("""SELECT page_id, normalize_domain(url) AS domain_key,
        normalize_linkedin_url('https://www.LinkedIn.com/in/P' || CAST(page_id AS STRING) || '/?x=1') AS li_key,
        normalize_company_name('  Page  ' || CAST(page_id AS STRING)) AS name_key FROM {pages}""",
                     pages=read_table(spark, d, "pages"))


@register("v2_pipeline_export", f"""WITH {CONTACTS_CTE}
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY qualification_score DESC NULLS LAST,
  coalesce(company_name, '') ASC, id ASC) AS BIGINT) AS export_pos, {EXPORT_SQL_COLS}
FROM contacts WHERE list_id = 2 AND stage IN ('email_enriched', 'phone_enriched')""")
def q_v2(spark, d):
    return export(contacts(spark, d), "email_enriched", list_id=2)


@register("v4_summary_view", f"""WITH {CONTACTS_CTE}, {LISTS_CTE}
SELECT l.list_id, l.list_name, CAST(count(c.id) AS BIGINT) AS total_contacts,
  CAST(count(c.id) FILTER (WHERE c.stage = 'skipped') AS BIGINT) AS skipped
FROM lists l LEFT JOIN contacts c USING (list_id) GROUP BY ALL""")
def q_v4(spark, d):
    list_summary(lists(spark, d), contacts(spark, d)).createOrReplaceTempView("pipeline_list_summary")
    return spark.sql("SELECT list_id, list_name, total_contacts, skipped FROM pipeline_list_summary")


@register("f13_by_provider_id", f"""WITH {HITS_CTE}
SELECT ord FROM h WHERE user_id % 6 = 0 AND 'ap' || CAST(user_id AS VARCHAR) IN
  (SELECT 'ap' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12)""")
def q_f13(spark, d):
    h = hits(spark, d).withColumn("provider_ids", F.when(
        F.col("user_id") % 6 == 0, F.create_map(F.lit("apollo"), F.concat(F.lit("ap"), F.col("user_id").cast("string")))))
    ids = read_table(spark, d, "customer").where(F.col("c_nationkey") < 12).select(
        F.concat(F.lit("ap"), F.col("c_custkey").cast("string")).alias("provider_id"))
    return by_provider_id(h, "apollo", ids).select("ord")


# ---------------------------------------------------------------------------
# Streaming: X1–X5 (events read as a file stream, availableNow trigger; each
# result must equal the batch oracle on the same input)
# ---------------------------------------------------------------------------
from rosterline.streaming.streams import (file_stream, latest_companies, latest_snapshot, master_of,  # noqa: E402
                                          run_available_now, stream_dedupe, stream_funnel, stream_master, stream_upsert,
                                          stream_upsert_companies, stream_valid_track, to_files)

# Events arrive as five files: four in time order, then one with the last week and some rows that are weeks late.
STREAM_CUTS = ["2024-01-07 00:00:00", "2024-01-13 00:00:00", "2024-01-19 00:00:00", "2024-01-25 00:00:00"]
LATE = "event_id % 97 = 3 AND ts < TIMESTAMP '2024-01-07 00:00:00'"


def _event_stream(spark, d, heartbeat=False):
    """A file stream of the whole events table, one slice of STREAM_CUTS per micro-batch, each written in parallel.

    ``heartbeat``: a last view and a last click of no real user, ten days on, move the watermark past all events.
    """
    ev = read_table(spark, d, "events")
    path = _scratch(spark, "events")
    late = F.expr(LATE.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    when = F.lit(0)
    for i, c in enumerate(STREAM_CUTS):
        when = F.when(F.col("ts") >= F.lit(c).cast("timestamp_ntz"), i + 1).otherwise(when)
    dealt = materialize(ev.withColumn("_slot", F.when(late, len(STREAM_CUTS)).otherwise(when)), "slices")
    files = max(4, ev.count() // 5_000_000)
    for i in range(len(STREAM_CUTS) + 1):   # one write after another: the stream takes files by time
        (dealt.where(F.col("_slot") == i).drop("_slot").repartitionByRange(files, "event_id")
         .write.parquet(_os.path.join(path, f"part={i}")))
    if heartbeat:
        beat = ev.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("_t"))
        fixed = {"ts": F.col("_t"), "event_type": F.col("_e"), "user_id": F.when(F.col("_e") == "view", -1).otherwise(-2)}
        (beat.withColumn("_e", F.explode(F.array(F.lit("view"), F.lit("click")))).coalesce(1)
         .select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ev.schema.fields])
         .write.parquet(_os.path.join(path, "part=last")))
    return (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files)
            .option("recursiveFileLookup", "true").parquet(path))


def _stream_hits(spark, d):
    return spark.sql(V_HITS, events=_event_stream(spark, d))


def _streamed(spark, df):
    """Runs a stream into files and reads them."""
    path = _scratch(spark, "stream")
    run_available_now(to_files(df, path))
    return spark.read.schema(df.schema).parquet(path)


@register("x1_stream_upsert", f"""WITH {HITS_CTE}, k AS (SELECT *, {N1_SQL.format(u='linkedin_url')} AS u,
  CASE WHEN ord % 97 = 3 AND seen_at < TIMESTAMP '{STREAM_CUTS[0]}' THEN 5 WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[3]}' THEN 5
    WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[2]}' THEN 4 WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[1]}' THEN 3
    WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[0]}' THEN 2 ELSE 1 END AS b FROM h),
f AS (SELECT * FROM k QUALIFY u IS NULL OR row_number() OVER (PARTITION BY list_id, u ORDER BY b, ord) = 1)
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY b, ord) AS BIGINT) AS id, ord,
  u AS linkedin_url_normalized, 'sourced' AS stage FROM f""")
def q_x1(spark, d):
    path = _scratch(spark, "stream-upsert")
    run_available_now(stream_upsert(_stream_hits(spark, d), path, NOW, buckets=8))
    return latest_snapshot(spark, path).select("list_id", "id", "ord", "linkedin_url_normalized", "stage")


@register("x1_stream_companies", f"""WITH {HITS_CTE}, k AS (SELECT *, {N2_SQL.format(u='company_domain')} AS dk,
  CASE WHEN ord % 97 = 3 AND seen_at < TIMESTAMP '{STREAM_CUTS[0]}' THEN 5 WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[3]}' THEN 5
    WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[2]}' THEN 4 WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[1]}' THEN 3
    WHEN seen_at >= TIMESTAMP '{STREAM_CUTS[0]}' THEN 2 ELSE 1 END AS b FROM h)
SELECT list_id, dk AS company_domain_normalized, arg_max(company_name, b * 1000000000000 + ord) AS company_name,
  arg_max(source, b * 1000000000000 + ord) AS source FROM k WHERE dk IS NOT NULL GROUP BY ALL
UNION ALL SELECT list_id, NULL, company_name, source FROM k WHERE dk IS NULL""")
def q_x1c(spark, d):
    path = _scratch(spark, "stream-companies")
    h = _stream_hits(spark, d).select("ord", "list_id", "company_name", "company_domain", "source")
    run_available_now(stream_upsert_companies(h, path, NOW, buckets=8))
    return latest_companies(spark, path).select("list_id", "company_domain_normalized", "company_name", "source")


@register("x2_stream_dedupe", f"""WITH {HITS_CTE},
k AS (SELECT list_id, {N1_SQL.format(u='linkedin_url')} AS linkedin_url_normalized, ord FROM h)
SELECT DISTINCT list_id, linkedin_url_normalized, CAST(NULL AS BIGINT) AS null_ord FROM k WHERE linkedin_url_normalized IS NOT NULL
UNION ALL SELECT list_id, NULL, ord FROM k WHERE linkedin_url_normalized IS NULL""")
def q_x2(spark, d):
    out = _streamed(spark, stream_dedupe(_stream_hits(spark, d), "30 days"))
    return out.select("list_id", "linkedin_url_normalized",
                      F.when(F.col("linkedin_url_normalized").isNull(), F.col("ord")).alias("null_ord"))


# Rows that come weeks late are dropped by the watermarks; the others find their partner, and the heartbeat closes all.
@register("x3_stream_valid_track", f"""WITH ev AS (SELECT * FROM events WHERE NOT ({LATE})),
s AS (SELECT event_id AS id, user_id, ts FROM ev WHERE event_type = 'view'),
r AS (SELECT event_id AS id, user_id, ts FROM ev WHERE event_type = 'click'),
p AS (SELECT r.id AS request_id, s.id AS track_id, r.ts AS r_ts FROM r JOIN s
  ON r.user_id = s.user_id AND s.ts <= r.ts AND s.ts >= r.ts - INTERVAL 6 HOUR
  QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY s.ts DESC, s.id DESC) = 1)
SELECT request_id, track_id, r_ts, row_number() OVER (PARTITION BY track_id ORDER BY r_ts, request_id) = 1 AS valid FROM p""")
def q_x3(spark, d):
    ev = _event_stream(spark, d, heartbeat=True)
    s = ev.where(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("id"), "ts")
    r = ev.where(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("id"), "ts")
    return _streamed(spark, stream_valid_track(r, s, 6)).select("request_id", "track_id", "r_ts", "valid")


# Append mode: late rows are dropped, and windows that the last watermark has not passed are still open.
@register("x4_stream_funnel", f"""SELECT date_trunc('hour', ts) AS window_start, event_type AS stage,
  CAST(count(*) AS BIGINT) AS n FROM events WHERE NOT ({LATE}) GROUP BY ALL
HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_x4(spark, d):
    ev = _event_stream(spark, d).withColumnRenamed("event_type", "stage")
    return _streamed(spark, stream_funnel(ev, "ts", "stage"))


@register("x5_stream_master", f"""WITH {MASTER_CTE}
SELECT * FROM master_all""")
def q_x5(spark, d):
    path = _scratch(spark, "stream-master")
    run_available_now(stream_master(_touch_rows(_stream_hits(spark, d)), path, buckets=8))
    return master_of(spark, path)


@register("w2_assign_ids", f"""WITH v AS (SELECT * REPLACE (CASE WHEN ord % 6 <> 0 THEN region END AS region) FROM ({duck(V_COMPANIES)}))
SELECT ord, region, CAST(row_number() OVER (PARTITION BY region ORDER BY employees DESC, ord) AS BIGINT) AS id FROM v""")
def q_w2(spark, d):
    from rosterline.operators.upsert import assign_ids, desc
    v = companies_src(spark, d).select("ord", F.when(F.col("ord") % 6 != 0, F.col("region")).alias("region"), "employees")
    return assign_ids(v, [desc("employees"), F.col("ord")], "region").select("ord", "region", "id")


# ---------------------------------------------------------------------------
# Report breakdowns: A8 (master status, domain backfill), A10 (phones), N12 vocabularies
# ---------------------------------------------------------------------------
from rosterline.operators.report import backfill_report, master_breakdown, phone_report  # noqa: E402


@register("a8_master_breakdown", f"""WITH {MASTER_CTE}
SELECT CASE WHEN status = 'new' THEN 'new' WHEN status IN ('replied', 'interested') THEN 'warm'
  WHEN status IN ('bounced', 'unsubscribed') THEN 'removed' ELSE 'previously_contacted' END AS bucket,
  status, CAST(count(*) AS BIGINT) AS n FROM xr GROUP BY ALL""")
def q_a8m(spark, d):
    return master_breakdown(_crossref(spark, d))


@register("a8_domains_backfilled", f"""WITH {HITS_CTE}, x AS ({J8_INPUT.replace('STRING', 'VARCHAR')}),
b AS (SELECT DISTINCT company_name, 'brief' AS domain FROM h WHERE user_id % 40 < 5),
p AS (SELECT list_id, company_name, arg_min(company_domain, ord) AS peer FROM x WHERE company_domain <> '' GROUP BY ALL)
SELECT CASE WHEN x.company_domain <> '' THEN 'given' WHEN b.domain IS NOT NULL THEN 'brief'
  WHEN p.peer IS NOT NULL THEN 'batch' WHEN x.ord % 3 = 1 THEN 'email' ELSE 'unresolved' END AS domain_source,
  CAST(count(*) AS BIGINT) AS n
FROM x LEFT JOIN b USING (company_name) LEFT JOIN p USING (list_id, company_name) GROUP BY 1""")
def q_a8b(spark, d):
    h = hits(spark, d)
    x = spark.sql(J8_INPUT.replace("FROM h", "FROM {h}"), h=h)
    brief = (h.where(F.col("user_id") % 40 < 5)
             .select("company_name", F.concat(F.lit("brief"), (F.col("user_id") % 40).cast("string"),
                                              F.lit(".example")).alias("domain")).distinct())
    return backfill_report(backfill_domain(x, brief))


@register("a10_phone_report", f"""WITH {PHONE_CTE},
w AS (SELECT pw.phone_type, coalesce(pw.provider, 'not_found') AS phone_source,
  coalesce(pw.validation = 'unvalidated' OR pw.phone_type = 'switchboard', false) AS flagged
  FROM customer c LEFT JOIN pw ON c.c_custkey = pw.contact_id)
SELECT coalesce(phone_type, 'none') AS phone_type, phone_source, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE flagged) AS BIGINT) AS flagged FROM w GROUP BY ALL""")
def q_a10p(spark, d):
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").alias("contact_id"))
    return phone_report(phone_waterfall(cust, _phone_answers(spark, d)))


@register("n12_seniority_vocabularies", f"""WITH {HITS_CTE}
SELECT ord, CASE ord % 3 WHEN 0 THEN 'director|vp|manager' WHEN 1 THEN 'c_suite|vp|manager' ELSE 'vp|manager' END AS apollo,
  CASE ord % 3 WHEN 0 THEN 'Director|VP|Manager' WHEN 1 THEN 'C-Level|VP|Manager' ELSE 'Intern|VP|Manager' END AS dropleads
FROM h""")
def q_n12b(spark, d):
    h = hits(spark, d)
    first = (F.when(F.col("ord") % 3 == 0, "Director").when(F.col("ord") % 3 == 1, "CXO").otherwise("intern"))
    arr = F.array(first, F.lit("VP"), F.lit("manager"))
    return h.select("ord", F.array_join(map_seniority(arr, "apollo"), "|").alias("apollo"),
                    F.array_join(map_seniority(arr, "dropleads"), "|").alias("dropleads"))


# ---------------------------------------------------------------------------
# Prices, ceilings and cost (A6, A7, A8); pages and maps (S6); all sequencers (F8); dropped counts (F7, A11);
# the URL check as SQL (V3); validators
# ---------------------------------------------------------------------------
from rosterline.functions.vocab import BATCH_SIZES, PRICES, RUN_CEILINGS, STATUS_SEMANTICS  # noqa: E402
from rosterline.operators.activate import usable_lead_counts  # noqa: E402
from rosterline.operators.waterfall import priced_estimate  # noqa: E402
from rosterline.sources.files import to_json_map, to_json_pages  # noqa: E402

# Rows per event type stand for billable rows of a provider and capability; one of them has no known price.
BILLED = [("view", "leadmagic", "email_enrich"), ("click", "apollo", "email_enrich"), ("purchase", "ai-ark", "company_search"),
          ("signup", "leadmagic", "email_validate"), ("error", "prospeo", "email_enrich"), ("view", "prospeo", "company_search"),
          ("click", "prospeo", "people_search"), ("signup", "prospeo", "company_enrich"), ("view", "ai-ark", "linkedin_url_lookup"),
          ("error", "leadmagic", "linkedin_url_lookup"), ("click", "leadmagic", "linkedin_url_lookup_by_email"),
          ("purchase", "web_research", "linkedin_url_lookup"), ("signup", "prospeo", "phone_enrich")]
BILLED_CTE = HITS_CTE + f""",
bl AS (SELECT provider, capability, CAST(count(*) AS BIGINT) AS billable FROM h JOIN (VALUES {", ".join(map(str, BILLED))})
  AS v(source, provider, capability) USING (source) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN provider = 'leadmagic' AND capability = 'email_validate' THEN 0.25 WHEN capability = 'linkedin_url_lookup_by_email' THEN 5.0
  WHEN provider = 'web_research' OR (provider = 'prospeo' AND capability = 'people_search') THEN 0.0
  WHEN provider <> 'prospeo' OR capability LIKE 'company%' THEN 1.0 END AS price FROM bl)"""


def _billed(spark, d):
    b = spark.createDataFrame(BILLED, "source string, provider string, capability string")
    counts = hits(spark, d).join(b, "source").groupBy("provider", "capability").agg(F.count(F.lit(1)).alias("billable"))
    prices = spark.createDataFrame(PRICES, "provider string, capability string, unit string, credits double, charged_on string")
    return priced_estimate(counts, prices)


@register("a6_priced_estimate", f"""WITH {BILLED_CTE}
SELECT provider, capability, billable, CAST(billable * price AS DECIMAL(12, 3)) AS credits_estimate, price IS NULL AS unknown_price FROM pr""")
def q_a6p(spark, d):
    return _billed(spark, d).select("provider", "capability", "billable", "credits_estimate", "unknown_price")


@register("a6_scrape_modes", COST_SQL + """
SELECT list_id, mode, CAST(fee + aiark_email_credits * per AS DECIMAL(10, 2)) AS usd FROM cost,
  (VALUES ('short', 0.02, 0.004), ('full', 0.06, 0.008), ('full_email', 0.06, 0.012)) AS m(mode, fee, per)""")
def q_a6s(spark, d):
    c = contacts(spark, d)
    parts = [estimate_cost(c, scrape_mode=m, runs=1 if m == "short" else 3).select(
        "list_id", F.lit(m).alias("mode"), F.col("apify_usd").alias("usd")) for m in ("short", "full", "full_email")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("a7_ceilings", f"""WITH {BILLED_CTE}
SELECT provider, capability, billable AS contacts, CAST(billable * price AS DECIMAL(12, 3)) AS credits,
  CASE WHEN price IS NULL OR billable * price > 2000 OR billable * 0.004 > 50 THEN 'blocked'
       WHEN billable > 50 OR billable * price > 500 THEN 'confirm' ELSE 'proceed' END AS decision FROM pr""")
def q_a7c(spark, d):
    c = _billed(spark, d).select("provider", "capability", F.col("billable").alias("contacts"), F.col("credits_estimate").alias("credits"),
                                 (F.col("billable") * F.lit(0.004).cast("decimal(10,3)")).alias("usd"))
    return gate(c, credit_ceiling=RUN_CEILINGS["apollo_credits"], ceilings={"usd": RUN_CEILINGS["per_run_usd"]}).drop("usd")


@register("a8_source_cost", POOL_CTE + """
SELECT source, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE net_new) AS BIGINT) AS net_new,
  count(*) * CASE source WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 0.25::DOUBLE WHEN 'purchase' THEN 0.0::DOUBLE END AS cost
FROM pool GROUP BY source""")
def q_a8c(spark, d):
    prices = spark.createDataFrame([("view", 1.0), ("click", 0.25), ("purchase", 0.0)], "provider string, credits double")
    return source_report(_pooled(spark, d), prices)


@register("s6_json_pages", f"""WITH {CONTACTS_CTE}
SELECT list_id, CAST(floor((id - 1) / 25) AS BIGINT) AS page, '[' || string_agg('{{"list_id":' || CAST(list_id AS VARCHAR) || ',"id":'
  || CAST(id AS VARCHAR) || ',"stage":"' || stage || '"}}', ',' ORDER BY id) || ']' AS json FROM contacts GROUP BY ALL""")
def q_s6p(spark, d):
    return to_json_pages(contacts(spark, d).select("list_id", "id", "stage"), page_size=25).select("list_id", "page", "json")


@register("s6_url_map", f"""WITH {MASTER_CTE}, u AS (SELECT url, max(status) AS status, row_number() OVER (ORDER BY url) AS pos
  FROM xr WHERE url IS NOT NULL GROUP BY url)
SELECT CAST(floor((pos - 1) / 100) AS BIGINT) AS page, '{{' || string_agg(to_json(url) || ':' || to_json(status), ',' ORDER BY url) || '}}' AS json
FROM u GROUP BY 1""")
def q_s6m(spark, d):
    return to_json_map(_crossref(spark, d).where("url is not null"), "url", "status", page_size=100).select("page", "json")


def _lead_sql(fields):
    return "'{' || concat_ws(',', " + ", ".join(_json_field(t, c) for c, t in fields) + ") || '}'"


@register("f8_other_sequencers", f"""WITH {HITS_CTE}, x AS ({LEAD_INPUT.replace('STRING', 'VARCHAR')})
SELECT ord, {_lead_sql([("email", "email"), ("first_name", "first_name"), ("last_name", "last_name"), ("company_name", "company_name"),
  ("phone", "phone_number"), ("linkedin_url", "linkedin_profile"), ("company_domain", "company_url")])} AS smartlead,
  {_lead_sql([("first_name", "firstName"), ("last_name", "lastName"), ("linkedin_url", "profileUrl"), ("company_name", "companyName"),
  ("title", "position"), ("email", "emailAddress")])} AS heyreach FROM x""")
def q_f8o(spark, d):
    x = to_lead(to_lead(_leads(spark, d), "smartlead", "smartlead"), "heyreach", "heyreach")
    return x.select("ord", "smartlead", "heyreach")


@register("f7_dropped_counts", f"""WITH {HITS_CTE}, x AS ({LEAD_INPUT.replace('STRING', 'VARCHAR')})
SELECT list_id, CAST(count(*) FILTER (WHERE coalesce(linkedin_url, '') <> '') AS BIGINT) AS usable,
  CAST(count(*) FILTER (WHERE coalesce(linkedin_url, '') = '') AS BIGINT) AS skipped_no_identity FROM x GROUP BY list_id""")
def q_f7c(spark, d):
    return usable_lead_counts(_leads(spark, d), "linkedin")


@register("a11_push_report_dropped", f"""WITH {HITS_CTE}, x AS ({RESP_INPUT.replace('STRING', 'VARCHAR')}),
l AS ({LEAD_INPUT.replace('STRING', 'VARCHAR')})
SELECT list_id, CAST(count(*) FILTER (WHERE code IN (200, 201) AND NOT contains(lower(body), 'already in the campaign')) AS BIGINT) AS imported,
  CAST(count(*) FILTER (WHERE contains(lower(body), 'already in the campaign')) AS BIGINT) AS skipped_existing,
  CAST(count(*) FILTER (WHERE NOT (code IN (200, 201) OR contains(lower(body), 'already in the campaign'))) AS BIGINT) AS failed,
  (SELECT count(*) FROM l WHERE l.list_id = x.list_id AND coalesce(email, '') = '' AND coalesce(linkedin_url, '') = '') AS skipped_no_identity
FROM x GROUP BY list_id""")
def q_a11d(spark, d):
    x = spark.sql(RESP_INPUT.replace("FROM h", "FROM {h}"), h=hits(spark, d))
    counts, _ = push_report(x, usable_lead_counts(_leads(spark, d)).select("list_id", "skipped_no_identity"))
    return counts


@register("v3_check_linkedin_urls", f"""WITH {MASTER_CTE}, u AS (SELECT DISTINCT linkedin_url AS url FROM h)
SELECT u.url AS input_url, m.linkedin_url_normalized IS NOT NULL AS found,
  CASE WHEN m.linkedin_url_normalized IS NULL THEN 'new' WHEN m.has_unsubscribed THEN 'unsubscribed'
    WHEN m.has_bounced AND NOT m.has_replied THEN 'bounced' WHEN m.overall_status = 'interested' THEN 'interested'
    WHEN m.has_replied THEN 'replied' ELSE 'previously_contacted' END AS status, m.company_name
FROM u LEFT JOIN master m ON {N1_SQL.format(u='u.url')} = m.linkedin_url_normalized""")
def q_v3(spark, d):
    master = rollup_master(_touches(spark, d).where(F.col("ts") < F.lit(BATCH_SPLIT).cast("timestamp_ntz")))
    register_sql_surface(spark, contacts(spark, d), None, master, prefix="rl_v3")
    hits(spark, d).select(F.col("linkedin_url").alias("url")).distinct().createOrReplaceTempView("rl_v3_urls")
    return spark.sql("SELECT c.input_url, c.found, c.status, c.company_name FROM rl_v3_urls u, LATERAL check_linkedin_urls(array(u.url)) c")


@register("j11_validators", f"""WITH r AS ({duck(V_RESULTS)})
SELECT ord, CASE ord % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'catch_all' WHEN 2 THEN 'invalid' ELSE 'unknown' END AS email_verdict,
  CASE WHEN ord % 4 = 0 THEN 'valid' WHEN ord % 4 = 2 THEN 'invalid' ELSE 'miss' END AS phone_verdict FROM r""")
def q_j11v(spark, d):
    r = results_src(spark, d)
    raw = F.element_at(F.array(*[F.lit(x) for x in ("valid", "valid_catch_all", "invalid", "unknown")]), (F.col("ord") % 4 + 1).cast("int"))
    sem = spark.createDataFrame(STATUS_SEMANTICS, "provider string, capability string, raw_status string, verdict string")
    x = r.select("ord", raw.alias("raw_status"), F.lit("leadmagic").alias("provider"), F.lit("email_validate").alias("capability"))
    e = classify_answers(x, sem).select("ord", F.col("verdict").alias("email_verdict"))
    p = classify_answers(x.withColumn("provider", F.lit("clearoutphone")).withColumn("capability", F.lit("phone_validate")), sem)
    return e.join(p.select("ord", F.col("verdict").alias("phone_verdict")), "ord")


# ---------------------------------------------------------------------------
# V2 as a SQL table function
# ---------------------------------------------------------------------------
from rosterline.plans.sql_surface import register_sql_surface  # noqa: E402


@register("v2_sql_table_function", f"""WITH {CONTACTS_CTE}
SELECT {", ".join(c for c in EXPORT_SQL_COLS.split(", "))}
FROM contacts WHERE list_id = 2 AND stage IN ('email_enriched', 'phone_enriched')""")
def q_v2s(spark, d):
    register_sql_surface(spark, contacts(spark, d), lists(spark, d), prefix="rl_v2")
    return spark.sql("SELECT * FROM pipeline_export(2, 'email_enriched')")
