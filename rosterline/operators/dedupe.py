"""Cross-source pooling and dedup: A2, A3, A4, A8.

"Richest record" (D25) = most non-blank canonical fields, ties to the earliest
input row.  Every pass is a hash aggregation of the keys and one number, so a hot key
(a free-mail host, a giant employer) is reduced map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.normalize import normalize_company_name, normalize_domain, normalize_linkedin_url

from rosterline.operators.upsert import keep_rows, own_if_null

__all__ = ["richness", "dedupe_companies", "dedupe_contacts", "companies_from_people", "source_report"]


def richness(cols: list[str]) -> Column:
    """Number of non-blank values among ``cols``."""
    return sum((F.coalesce(F.trim(F.col(c).cast("string")) != F.lit(""), F.lit(False))).cast("int") for c in cols)


def _richest(df: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """The row with most filled fields, then the smallest ``ord``, per key; rows with a NULL among
    ``keys`` stay apart.  Filled and ``ord`` are one decimal with room for any bigint, so that a hash
    aggregation finds the winners and the wide rows are only semi-joined."""
    x = (df.withColumn("_own", own_if_null(keys, "ord"))
         .withColumn("_best", F.col("_filled").cast("decimal(10,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)") - F.col("ord").cast("decimal(20,0)")))
    best = x.groupBy(*group, *keys, "_own").agg(F.max("_best").alias("_best"))
    return keep_rows(x, best, [*group, *keys, "_own", "_best"]).drop("_own", "_best")


def dedupe_companies(df: DataFrame, fields: list[str], group: list[str] | None = None) -> DataFrame:
    """A2: dedup on the domain key, then on the name key, keeping the richest row."""
    g = group or []
    x = (df.withColumn("_dk", normalize_domain("company_domain"))
         .withColumn("_nk", normalize_company_name("company_name"))
         .withColumn("_filled", richness(fields)))
    out = _richest(_richest(x, ["_dk"], g), ["_nk"], g)
    return out.withColumnRenamed("_nk", "name_key").withColumnRenamed("_filled", "filled").drop("_dk")


def dedupe_contacts(df: DataFrame, fields: list[str], group: list[str] | None = None,
                    fallback: tuple = ("first_name", "last_name", "company_name", "title")) -> DataFrame:
    """A3: dedup on N1; NULL-URL rows on first+last+company+title; richest kept and
    ``provider_ids`` of every merged row carried over (first id per provider).

    The fallback key is the JSON array of the four values, so NULL differs from blank and no
    two value lists share a key; a row with none of them has a NULL key and is never merged.
    """
    g = group or []
    named = F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in fallback]).isNotNull()
    name_key = F.concat(F.lit("name:"), F.to_json(F.array(*[F.col(c) for c in fallback])))
    x = (df.withColumn("dedup_key", F.coalesce(normalize_linkedin_url("linkedin_url"), F.when(named, name_key)))
         .withColumn("_filled", richness(fields)).withColumn("_own2", own_if_null(["dedup_key"], "ord")))
    ids = (x.select(*g, "dedup_key", "_own2", "ord", F.explode("provider_ids").alias("_p", "_v"))
           .groupBy(*g, "dedup_key", "_own2", "_p").agg(F.min(F.struct("ord", "_v"))["_v"].alias("_v"))
           .groupBy(*g, "dedup_key", "_own2").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_ids")))
    on = [*g, "dedup_key", "_own2"]
    ids = ids.select("_ids", *[F.col(c).alias(f"_i{i}") for i, c in enumerate(on)])
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_i{i}"))
    best = _richest(x.drop("provider_ids"), ["dedup_key"], g)
    return (best.join(ids, cond, "left")
            .withColumn("provider_ids", F.coalesce("_ids", F.create_map().cast("map<string,string>")))
            .drop("_ids", "_own2", *[f"_i{i}" for i in range(len(on))]).withColumnRenamed("_filled", "filled"))


def companies_from_people(df: DataFrame, industries: list[str] | None = None, keywords: list[str] | None = None,
                          industry_col: str = "industry", group: list[str] | None = None) -> DataFrame:
    """A4: unique companies from people rows — industry filter first, then keyword."""
    from rosterline.operators.match import keyword_regex
    g = group or []
    x = df
    if industries:
        x = x.where(F.col(industry_col).isin(*industries))
    if keywords:
        x = x.where(F.col("company_name").rlike(keyword_regex(keywords)))
    key = F.coalesce(normalize_domain("company_domain"), normalize_company_name("company_name"))
    return (x.withColumn("company_key", key).where(F.col("company_key").isNotNull())
            .groupBy(*g, "company_key")
            .agg(F.count(F.lit(1)).alias("people"), F.min(F.struct("ord", "company_name"))["company_name"].alias("company_name"),
                 F.min("ord").alias("first_ord")))


def source_report(pooled: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per source — rows found, net-new rows and, with ``prices``, cost (found × credits; NULL: no price known)."""
    r = pooled.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if("net_new").alias("net_new"))
    if prices is not None:
        r = (r.join(prices.select(F.col("provider").alias("source"), "credits"), "source", "left")
             .withColumn("cost", F.col("found") * F.col("credits")).drop("credits"))
    return r
