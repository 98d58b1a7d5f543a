"""SQL surface: V1–V4 as Spark SQL objects.

* V1 scalar functions (``register_sql_functions``) are inlined by Catalyst.
* V2 ``pipeline_export(p_list_id, p_min_stage)`` and V3
  ``check_linkedin_urls(urls)`` are SQL table functions over temp views; they
  plan like any query (partition pruning on ``list_id``, global sort).
* V4 ``pipeline_list_summary`` / ``pipeline_contacts_detail`` are temp views.

For inputs too big for an argument array, use the DataFrame forms
(``crossref_master``, ``export``) instead of V3/V2.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from rosterline.functions.normalize import register_sql_functions
from rosterline.operators.match import crossref_master
from rosterline.operators.report import contacts_detail, list_summary
from rosterline.schema import EXPORT_COLUMNS, MIN_STAGES

__all__ = ["register_sql_surface"]

_EXPORT_TYPES = {"qualification_score": "INT"}


def register_sql_surface(spark: SparkSession, contacts: DataFrame, lists: DataFrame | None = None,
                         master: DataFrame | None = None, prefix: str = "rl") -> None:
    """Register V1–V4 against the given tables (as temp views named ``{prefix}_*``)."""
    register_sql_functions(spark)
    contacts.createOrReplaceTempView(f"{prefix}_contacts")
    cols = ", ".join(f"{c} {_EXPORT_TYPES.get(c, 'STRING')}" for c in EXPORT_COLUMNS)
    gate = " ".join(
        f"WHEN '{s}' THEN stage IN ({', '.join(repr(x) for x in MIN_STAGES[i:])})" for i, s in enumerate(MIN_STAGES))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION pipeline_export(p_list_id BIGINT, p_min_stage STRING)
RETURNS TABLE ({cols})
RETURN SELECT {", ".join(EXPORT_COLUMNS)} FROM {prefix}_contacts
WHERE list_id = p_list_id AND stage <> 'skipped'
  AND CASE p_min_stage {gate} ELSE raise_error('unknown min_stage ' || p_min_stage) END
ORDER BY qualification_score DESC NULLS LAST, coalesce(company_name, ''), id""")
    if master is not None:
        # The status rule is that of crossref_master, run once per master row.
        (crossref_master(master.select(F.col("linkedin_url_normalized").alias("key")), master, "key")
         .select("key", "found", "status", F.col("master_first_name").alias("first_name"),
                 F.col("master_last_name").alias("last_name"), F.col("master_company_name").alias("company_name"))
         .createOrReplaceTempView(f"{prefix}_master_status"))
        spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION check_linkedin_urls(urls ARRAY<STRING>)
RETURNS TABLE (input_url STRING, found BOOLEAN, status STRING, first_name STRING, last_name STRING,
               company_name STRING)
RETURN SELECT u.url, coalesce(s.found, false), coalesce(s.status, 'new'), s.first_name, s.last_name, s.company_name
FROM (SELECT explode(urls) AS url) u LEFT JOIN {prefix}_master_status s ON normalize_linkedin_url(u.url) = s.key""")
    if lists is not None:
        list_summary(lists, contacts).createOrReplaceTempView("pipeline_list_summary")
        contacts_detail(contacts, lists).createOrReplaceTempView("pipeline_contacts_detail")
