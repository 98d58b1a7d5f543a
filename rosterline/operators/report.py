"""Queries and reports: F1, F2, J9, A1, O2 (+ the report aggregates A6–A14).

Every report is a single grouped aggregation (partial + final), so a list or
provider holding a third of all rows is reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.schema import STAGES

__all__ = ["query_by_stage", "query_companies", "contacts_detail", "list_summary", "intel_report",
           "master_breakdown", "backfill_report", "phone_report"]


def query_by_stage(contacts: DataFrame, stage: str, list_id=None) -> DataFrame:
    """contacts at exactly ``stage`` (optionally of one list; partition-pruned)."""
    df = contacts.where(F.col("stage") == F.lit(stage))
    return df if list_id is None else df.where(F.col("list_id") == F.lit(list_id))


def query_companies(companies: DataFrame, list_id=None) -> DataFrame:
    """all companies of a list (or of every list)."""
    return companies if list_id is None else companies.where(F.col("list_id") == F.lit(list_id))


def contacts_detail(contacts: DataFrame, lists: DataFrame) -> DataFrame:
    """Contacts with their list's name and description."""
    return contacts.join(lists.select("list_id", "list_name",
                                      F.col("description").alias("list_description")), "list_id")


def list_summary(lists: DataFrame, contacts: DataFrame) -> DataFrame:
    """A1 / V4 / O2: five stage counts and total per list; empty lists give zeros.

    Unknown stages count only in the total.  Sorted newest first, then list id.
    """
    counts = contacts.groupBy("list_id").agg(
        *[F.count_if(F.col("stage") == F.lit(s)).alias(s) for s in STAGES],
        F.count("id").alias("total_contacts"))
    cols = ["list_id", "list_name", "description", "created_by", "status", "created_at"]
    out = lists.select(*cols).join(counts, "list_id", "left")
    out = out.select(*cols, *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in STAGES],
                     F.coalesce("total_contacts", F.lit(0)).cast("bigint").alias("total_contacts"))
    return out.orderBy(F.desc("created_at"), "list_id")


def intel_report(companies: DataFrame, thin_below: int = 3) -> DataFrame:
    """Per list — companies, enriched, verified, thin (fewer than ``thin_below`` intel facts)."""
    n_intel = F.coalesce(F.size(F.map_filter("intel", lambda k, v: v.isNotNull())), F.lit(0))
    return companies.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("companies"),
        F.count_if(F.coalesce("enriched", F.lit(False))).alias("enriched"),
        F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"),
        F.count_if(n_intel < F.lit(thin_below)).alias("thin"))


def master_breakdown(crossref: DataFrame) -> DataFrame:
    """Master status breakdown — new / previously contacted / warm / removed."""
    s = F.col("status")
    bucket = (F.when(s == "new", "new").when(s.isin("replied", "interested"), "warm")
              .when(s.isin("bounced", "unsubscribed"), "removed").otherwise("previously_contacted"))
    return crossref.groupBy(bucket.alias("bucket"), s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def backfill_report(backfilled: DataFrame) -> DataFrame:
    """Domains by how they were resolved (given / brief / batch / email / unresolved)."""
    return (backfilled.groupBy(F.coalesce("domain_source", F.lit("unresolved")).alias("domain_source"))
            .agg(F.count(F.lit(1)).alias("n")))


def phone_report(winners: DataFrame) -> DataFrame:
    """A10: phone type and source distribution of the phone waterfall's winners."""
    return (winners.groupBy(F.coalesce("phone_type", F.lit("none")).alias("phone_type"), "phone_source")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged")))
