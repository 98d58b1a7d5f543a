"""Qualification: Q1–Q5, T3, U2, A9.

Scoring is a handful of column expressions plus broadcast joins against
small persona / segment dimensions; the report is one GROUPING SETS
aggregation plus a per-group top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.operators.match import keyword_regex

__all__ = ["score_persona", "score_company", "score_completeness", "score_novelty", "qualify",
           "apply_qualification", "union_titles", "qualify_report", "THRESHOLDS"]

# Score thresholds: QUALIFY >= 7, MAYBE 4–6, SKIP <= 3.
THRESHOLDS = {"qualify": 7, "maybe": 4}


def _norm_title(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def score_persona(df: DataFrame, persona_titles: DataFrame, persona_seniority: DataFrame,
                  senses: list[str] | None = None, title_col: str = "title",
                  seniority_col: str = "seniority") -> DataFrame:
    """Q1: 4 for title + seniority of a persona, 2 for an adjacent seniority, 0 otherwise (weak);
    an excluded sense scores 0.  Keeps ``matched_persona`` (best points, then name).

    ``persona_seniority`` (role, seniority, optionally fit): rows with fit ``adjacent`` are
    the adjacent seniorities of a role.  Without the column, the title alone is adjacent.
    """
    # The rules reduce to lookups by (title, seniority) and by title; the planner
    # broadcasts them if their measured size allows.
    pt = persona_titles.select("role", _norm_title(F.col("title")).alias("_t")).distinct()
    ruled = "fit" in persona_seniority.columns
    ps = persona_seniority.select("role", F.lower("seniority").alias("_s"),
                                  (F.col("fit") if ruled else F.lit("exact")).alias("_f")).distinct()
    out = df.withColumn("_t", _norm_title(F.col(title_col))).withColumn("_s", F.lower(F.col(seniority_col)))
    by_fit = pt.join(ps, "role").groupBy("_t", "_s").agg(
        F.min(F.when(F.col("_f") != "adjacent", F.col("role"))).alias("_r4"),
        F.min(F.when(F.col("_f") == "adjacent", F.col("role"))).alias("_r2"))
    if ruled:
        out = out.join(by_fit, ["_t", "_s"], "left")
    else:
        out = out.join(by_fit.drop("_r2"), ["_t", "_s"], "left").join(
            pt.groupBy("_t").agg(F.min("role").alias("_r2")), "_t", "left")
    pts = F.when(F.col("_r4").isNotNull(), 4).when(F.col("_r2").isNotNull(), 2).otherwise(0)
    if senses:
        pts = F.when(F.coalesce(F.col(title_col).rlike(keyword_regex(senses)), F.lit(False)), 0).otherwise(pts)
    return (out.withColumn("persona_points", pts.cast("int"))
            .withColumn("matched_persona", F.coalesce("_r4", "_r2"))
            .drop("_t", "_s", "_r4", "_r2"))


#: Rules of the default rubric, best first: segment, points, least and most employees, target region, funding stages.
SEGMENT_RULES = [
    {"segment": "A", "points": 3, "min_employees": 200, "max_employees": 2000},
    {"segment": "B", "points": 2, "min_employees": 50, "max_employees": 199},
]


def score_company(df: DataFrame, employees_col: str = "employees", region_col: str = "region",
                  a_region: str | None = None, b_fit: int = 2, funding_col: str = "funding_stage",
                  a_funding: list[str] | None = None, rules: list[dict] | None = None) -> DataFrame:
    """Q2: the first rule that holds gives segment and points; none: C = 0.

    ``rules``: rows as in ``SEGMENT_RULES``, with optional ``region`` and ``funding`` (list).
    The default is the default rubric, where ``a_region`` / ``a_funding`` narrow
    segment A and ``b_fit`` (1–2, D24) is segment B's points.
    """
    if rules is None:
        top, second = SEGMENT_RULES
        rules = [top | {"region": a_region, "funding": a_funding}, second | {"points": b_fit}]
    emp = F.col(employees_col).try_cast("bigint")
    seg, pts = F.lit("C"), F.lit(0)
    for r in reversed(rules):
        holds = F.lit(True)
        if r.get("min_employees") is not None:
            holds = holds & (emp >= r["min_employees"])
        if r.get("max_employees") is not None:
            holds = holds & (emp <= r["max_employees"])
        if r.get("region") is not None:
            holds = holds & (F.col(region_col) == F.lit(r["region"]))
        if r.get("funding"):
            holds = holds & F.lower(F.col(funding_col)).isin(*[x.lower() for x in r["funding"]])
        seg = F.when(holds, F.lit(r["segment"])).otherwise(seg)
        pts = F.when(holds, F.lit(r["points"])).otherwise(pts)
    return df.withColumn("company_segment", seg).withColumn("company_points", pts.cast("int"))


def score_completeness(df: DataFrame) -> DataFrame:
    """Q3: one point each for a LinkedIn URL and a company domain (0–2)."""
    has = lambda c: F.coalesce(F.col(c) != F.lit(""), F.lit(False)).cast("int")
    return df.withColumn("completeness_points", (has("linkedin_url") + has("company_domain")).cast("int"))


def score_novelty(df: DataFrame, status_col: str = "db_status") -> DataFrame:
    """Q4: 1 when the contact is new (not in the CRM / never contacted)."""
    return df.withColumn("novelty_points",
                         F.when(F.coalesce(F.col(status_col), F.lit("new")) == "new", 1).otherwise(0).cast("int"))


def qualify(df: DataFrame, excluded_col: str = "exclusion_reason", segments: bool = True) -> DataFrame:
    """Q5: exclusions first (SKIP, unscored); else sum 0–10 → QUALIFY / MAYBE / SKIP.

    Without a segments rubric (``segments=False``) every non-excluded contact
    that matches a persona is QUALIFY and the rest SKIP.
    """
    excl = F.col(excluded_col).isNotNull() if excluded_col in df.columns else F.lit(False)
    if not segments:
        in_persona = F.coalesce(F.col("persona_points") > 0, F.lit(False))
        return (df.withColumn("qualification_score", F.lit(None).cast("int"))
                .withColumn("qualification_status", F.when(~excl & in_persona, "QUALIFY").otherwise("SKIP")))
    total = (F.col("persona_points") + F.col("company_points") + F.col("completeness_points")
             + F.col("novelty_points")).cast("int")
    return (df.withColumn("qualification_score", F.when(~excl, total))
            .withColumn("qualification_status",
                        F.when(excl, "SKIP").when(total >= THRESHOLDS["qualify"], "QUALIFY")
                        .when(total >= THRESHOLDS["maybe"], "MAYBE").otherwise("SKIP")))


def apply_qualification(df: DataFrame, accept_maybe: Column) -> DataFrame:
    """QUALIFY and accepted MAYBE → qualified (enrich_recommended = 'yes');
    SKIP and rejected MAYBE → skipped with a reason."""
    st = F.col("qualification_status")
    ok = (st == "QUALIFY") | ((st == "MAYBE") & F.coalesce(accept_maybe, F.lit(False)))
    reason = (F.when(ok, None)
              .when(F.col("exclusion_reason").isNotNull(), F.col("exclusion_reason"))
              .when(st == "MAYBE", "maybe_rejected").otherwise("low_score"))
    return (df.withColumn("stage", F.when(ok, "qualified").otherwise("skipped"))
            .withColumn("enrich_recommended", F.when(ok, "yes").otherwise("no"))
            .withColumn("qualification_notes", reason))


def union_titles(persona_titles: DataFrame, profile_titles: DataFrame | None, expansion: str = "confirm") -> DataFrame:
    """Persona titles always kept; profile titles added unless expansion is off.
    One row per normalized title with its provenance (persona wins)."""
    p = persona_titles.select(_norm_title(F.col("title")).alias("title"), F.lit("persona").alias("provenance"))
    if expansion != "off" and profile_titles is not None:
        p = p.unionByName(profile_titles.select(_norm_title(F.col("title")).alias("title"),
                                                F.lit("profile").alias("provenance")))
    return p.groupBy("title").agg(F.min("provenance").alias("provenance"))


def qualify_report(df: DataFrame, top_k: int = 3):
    """Counts per tier, per segment and per persona (one GROUPING SETS pass),
    and the top ``top_k`` skip reasons."""
    counts = (df.groupBy(F.col("qualification_status"), F.col("company_segment"), F.col("matched_persona"))
              .agg(F.count(F.lit(1)).alias("n")))
    spark = df.sparkSession
    sets = spark.sql(
        "SELECT CASE WHEN grouping(qualification_status) = 0 THEN 'tier' "
        "WHEN grouping(company_segment) = 0 THEN 'segment' ELSE 'persona' END AS dim, "
        "coalesce(qualification_status, company_segment, matched_persona, '(none)') AS value, "
        "CAST(sum(n) AS BIGINT) AS n FROM {c} "
        "GROUP BY GROUPING SETS ((qualification_status), (company_segment), (matched_persona))", c=counts)
    reasons = (df.where(F.col("qualification_notes").isNotNull())
               .groupBy("qualification_notes").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "qualification_notes").limit(top_k))
    return sets, reasons
