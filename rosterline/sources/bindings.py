"""Views that give every operator realistic input from the driver's tables.

The SQL text is shared by Spark (``spark.sql`` with DataFrame arguments) and
by the DuckDB oracle (the same text with plain table names), so both engines
start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterline.session import read_table

# v_hits: one provider hit per event; messy URLs, NULL keys, member-IDs, blank domains.
V_HITS = """
SELECT event_id AS ord, ts AS seen_at, event_type AS source, CAST(event_id % 3 + 1 AS BIGINT) AS list_id,
 'F' || CAST(user_id AS STRING) AS first_name, 'L' || CAST(user_id % 50 AS STRING) AS last_name,
 CASE WHEN user_id % 17 = 0 THEN NULL ELSE 'https://www.LinkedIn.com/in/'
   || CASE WHEN user_id % 13 = 0 THEN 'ACw' ELSE 'U' END || CAST(user_id AS STRING)
   || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '?trk=' || CAST(event_id AS STRING) ELSE '/?x=1' END END AS linkedin_url,
 'Company ' || CAST(user_id % 40 AS STRING) AS company_name,
 CASE WHEN event_id % 5 = 0 THEN '' ELSE 'https://www.c' || CAST(user_id % 40 AS STRING) || '.example/' || event_type END AS company_domain,
 CAST(CAST(floor(value) AS INT) % 11 AS INT) AS qualification_score,
 user_id, value, props
FROM {events}
"""

# v_companies: firmographics.
V_COMPANIES = """
SELECT c_custkey AS ord, c_name AS company_name, 'HTTPS://www.' || replace(c_name, '#', '') || '.example./about' AS company_domain,
 n_name AS country, r_name AS region, c_mktsegment AS industry, CAST(floor(abs(c_acctbal) / 4) AS INT) AS employees,
 c_acctbal AS acctbal, c_nationkey AS nationkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# v_results: provider answers; provider = order priority 1..5, status from order status.
V_RESULTS = """
SELECT o_orderkey AS ord, o_custkey AS contact_id, o_orderpriority AS provider, CAST(substring(o_orderpriority, 1, 1) AS INT) AS rank,
 CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'guessed' ELSE 'unavailable' END AS raw_status,
 'u' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING) || '@p' || substring(o_orderpriority, 1, 1) || '.example' AS email,
 o_orderdate AS received_at, o_totalprice AS totalprice
FROM {orders}
"""

# Stage a contact has reached, derived from its score (for stage-based operators).
STAGE_FROM_SCORE = ("CASE WHEN qualification_score >= 9 THEN 'phone_enriched' "
                    "WHEN qualification_score >= 7 THEN 'email_enriched' "
                    "WHEN qualification_score >= 4 THEN 'qualified' "
                    "WHEN qualification_score >= 1 THEN 'sourced' ELSE 'skipped' END")

# Two upsert batches: everything seen before this instant, then the rest.
BATCH_SPLIT = "2024-01-15 00:00:00"
# The clock handed to every state-changing operator, so results repeat.
NOW = "2025-01-01 00:00:00"

TABLES = {"V_HITS": ["events"], "V_COMPANIES": ["customer", "nation", "region"], "V_RESULTS": ["orders"]}


def _bind(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, V_HITS, TABLES["V_HITS"])


def companies_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, V_COMPANIES, TABLES["V_COMPANIES"])


def results_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bind(spark, sf_dir, V_RESULTS, TABLES["V_RESULTS"])


def duck(sql: str) -> str:
    """The same view text for DuckDB: placeholders become the registered view names."""
    return sql.format(events="events", customer="customer", nation="nation", region="region",
                      orders="orders")
