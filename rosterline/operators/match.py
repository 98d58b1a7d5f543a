"""Joins, lookups and filters: J3–J8, J12–J15, F4, F9–F11, A13.

Scale notes
-----------
* Every lookup is an equi-join on a normalized key; dimension sides that are
  literal and tiny are broadcast, data-sized sides are left to the planner
  (sort-merge, or AQE's runtime broadcast when the measured side is small).
* Ambiguity checks and "first match" rules are aggregations (partial + final),
  never windows over a whole hot key.
* Rows with a NULL key match nothing in a left join, but would all be sent to one task:
  their key becomes a value of their own before the shuffle (``spread_null``).
* The track-id join (J12) never pairs all rows of a user: within five-minute slots of a
  user a window finds the last search up to each request, and only each slot's last search is
  carried on to later slots.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterline.functions.normalize import (email_domain, normalize_domain, normalize_linkedin_url,
                                            slug_candidates, strip_ws)
from rosterline.functions.vocab import REGIONS
from rosterline.operators.upsert import hashable, spread_null

__all__ = [
    "rollup_master", "crossref_master", "suppress_master", "crm_dedupe", "with_intel",
    "expand_regions", "match_roles", "backfill_domain", "valid_track", "lookup_linkedin",
    "reverse_lookup", "resolve_companies", "resolved_urls", "apply_exclusions", "icp_filter", "fresh",
    "keyword_regex", "mark_exclusions", "MASTER_STATUS_RANK",
]

# Precedence of engagement statuses for the roll-up (bounce/unsubscribe are flags).
MASTER_STATUS_RANK = {"contacted": 1, "engaged": 2, "interested": 3, "replied": 4}


# --- A13 / J3 / F11 ----------------------------------------------------------

def rollup_master(touches: DataFrame) -> DataFrame:
    """One master row per normalized profile URL from touch events.

    ``touches``: linkedin_url, status (contacted / engaged / interested /
    replied / bounced / unsubscribed), ts, campaign_id, and optional names.
    """
    t = touches.withColumn("linkedin_url_normalized", normalize_linkedin_url("linkedin_url")) \
        .where(F.col("linkedin_url_normalized").isNotNull())
    rank = F.try_element_at(F.create_map(*[x for k, v in MASTER_STATUS_RANK.items()
                                           for x in (F.lit(k), F.lit(v))]), F.col("status"))
    names = [c for c in ("first_name", "last_name", "company_name", "email") if c in touches.columns]
    return t.groupBy("linkedin_url_normalized").agg(
        F.min(F.struct("ts", "linkedin_url"))["linkedin_url"].alias("linkedin_url"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(F.col("ts"), F.col(c))))[c].alias(c) for c in names],
        F.coalesce(F.max_by("status", rank), F.lit("contacted")).alias("overall_status"),
        F.count_distinct("campaign_id").cast("int").alias("total_campaigns"),
        F.bool_or(F.col("status") == "replied").alias("has_replied"),
        F.bool_or(F.col("status") == "bounced").alias("has_bounced"),
        F.bool_or(F.col("status") == "unsubscribed").alias("has_unsubscribed"),
        F.min("ts").alias("first_contacted_at"), F.max("ts").alias("last_contacted_at"))


def crossref_master(urls: DataFrame, master: DataFrame, url_col: str = "url") -> DataFrame:
    """Status of each input URL against the master table (left join on N1).

    CASE order: absent → new; unsubscribed; bounced and not replied;
    interested; replied; else previously_contacted.  A NULL flag falls through.
    """
    # Master columns get internal names so inputs that already carry a key or
    # flags (e.g. contacts) never clash with them.
    m = master.select(F.col("linkedin_url_normalized").alias("_mk"), F.col("has_unsubscribed").alias("_unsub"),
                      F.col("has_bounced").alias("_bounced"), F.col("has_replied").alias("_replied"),
                      F.col("overall_status").alias("_overall"), F.col("first_name").alias("_fn"),
                      F.col("last_name").alias("_ln"), F.col("company_name").alias("_cn"),
                      F.lit(True).alias("_found"))
    key = spread_null(normalize_linkedin_url(url_col), *hashable(urls))
    j = urls.withColumn("_key", key).join(m, F.col("_key") == F.col("_mk"), "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    status = (F.when(~found, "new")
              .when(F.col("_unsub"), "unsubscribed")
              .when(F.col("_bounced") & ~F.col("_replied"), "bounced")
              .when(F.col("_overall") == "interested", "interested")
              .when(F.col("_replied"), "replied")
              .otherwise("previously_contacted"))
    return j.select(*[F.col(f"`{c}`") for c in urls.columns], found.alias("found"), status.alias("status"),
                    F.col("_fn").alias("master_first_name"), F.col("_ln").alias("master_last_name"),
                    F.col("_cn").alias("master_company_name"))


def suppress_master(df: DataFrame, status_col: str = "status") -> DataFrame:
    """drop bounced / unsubscribed; flag replied / interested as warm."""
    s = F.col(status_col)
    return (df.where(~F.coalesce(s.isin("bounced", "unsubscribed"), F.lit(False)))
            .withColumn("warm", F.coalesce(s.isin("replied", "interested"), F.lit(False))))


# --- J4 ---------------------------------------------------------------------

def crm_dedupe(values: DataFrame, crm: DataFrame, value_col: str = "value") -> DataFrame:
    """Trimmed, lowercased, distinct inputs matched against CRM keys.

    ``crm`` has (key, id, name, ord); the first CRM record per key (smallest
    ``ord``) supplies ``id`` and ``name``.
    """
    v = values.select(F.lower(strip_ws(F.col(value_col))).alias("value")).where(
        F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    first = (crm.select(F.lower(strip_ws(F.col("key"))).alias("value"), "id", "name", "ord")
             .groupBy("value").agg(F.min(F.struct("ord", "id", "name")).alias("_m")))
    j = v.join(first, "value", "left")
    return j.select("value", F.col("_m").isNotNull().alias("exists"), F.col("_m.id").alias("id"),
                    F.col("_m.name").alias("name"))


# --- J5 ---------------------------------------------------------------------

def with_intel(contacts: DataFrame, companies: DataFrame, prefix: str = "account_") -> DataFrame:
    """Attach the company row (by list and normalized domain) to each contact."""
    comp = companies.select(
        "list_id", F.col("company_domain_normalized").alias("_k"),
        *[F.col(c).alias(prefix + c) for c in companies.columns
          if c not in ("list_id", "company_domain_normalized", "_status", "_n_new")])
    return (contacts.withColumn("_k", spread_null(normalize_domain("company_domain"), *hashable(contacts)))
            .join(comp, ["list_id", "_k"], "left").drop("_k"))


# --- J6 ---------------------------------------------------------------------

def expand_regions(df: DataFrame, col: str = "geography", regions: DataFrame | None = None) -> DataFrame:
    """Region → its countries; other names pass through; distinct.

    The region table is a literal of 6 regions / 32 pairs, so it is a map
    lookup inside the projection — no join at all.
    """
    if regions is None:
        m = F.create_map(*[x for r, cs in REGIONS.items()
                           for x in (F.lit(r), F.array(*[F.lit(c) for c in cs]))])
        countries = F.try_element_at(m, F.col(col))
        return df.select(F.explode(F.coalesce(countries, F.array(F.col(col)))).alias(col)).distinct()
    grouped = regions.groupBy("region").agg(F.collect_list("country").alias("_cs"))
    j = df.select(col).distinct().join(grouped, F.col(col) == F.col("region"), "left")   # distinct first: names are few
    return j.select(F.explode(F.coalesce("_cs", F.array(F.col(col)))).alias(col)).distinct()


# --- J7 ---------------------------------------------------------------------

def _norm_title(c) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def match_roles(df: DataFrame, role_titles: DataFrame, senses: list[str] | None = None,
                title_col: str = "title") -> DataFrame:
    """Title ∈ persona / also-known-as / profile titles → matched role(s).

    ``role_titles`` (role, title, provenance) is a dimension; the planner broadcasts it if its
    measured size allows.  A title
    that hits an excluded sense (whole word) is demoted (``sense_excluded``).
    One output row per input row: the first matching role by name.
    """
    rt = (role_titles.select("role", _norm_title(F.col("title")).alias("_t"))
          .groupBy("_t").agg(F.min("role").alias("matched_role")))
    out = df.withColumn("_t", _norm_title(F.col(title_col))).join(rt, "_t", "left").drop("_t")
    if senses:
        out = out.withColumn("sense_excluded", F.coalesce(F.col(title_col).rlike(keyword_regex(senses)), F.lit(False)))
    return out


# --- J8 ---------------------------------------------------------------------

def backfill_domain(df: DataFrame, brief: DataFrame | None = None, group_col: str = "list_id") -> DataFrame:
    """Fill ``company_domain`` in order: brief → same company in the batch →
    non-freemail email domain; unresolved rows are kept (``domain_source`` NULL)."""
    blank = lambda c: F.nullif(strip_ws(F.col(c)), F.lit(""))
    out = df.withColumn("_own", blank("company_domain"))
    if brief is not None:
        b = brief.select(F.col("company_name").alias("_bn"), F.col("domain").alias("_brief")) \
            .groupBy("_bn").agg(F.min("_brief").alias("_brief"))
        out = out.join(b, spread_null("company_name", *hashable(df)) == F.col("_bn"), "left").drop("_bn")
    else:
        out = out.withColumn("_brief", F.lit(None).cast("string"))
    peer = (out.where(F.col("_own").isNotNull())
            .groupBy(group_col, "company_name").agg(F.min(F.struct("ord", "_own"))["_own"].alias("_peer")))
    peer = peer.withColumnsRenamed({group_col: "_pg", "company_name": "_pn"})
    out = out.join(peer, (F.col(group_col) == F.col("_pg")) & (spread_null("company_name", *hashable(df)) == F.col("_pn")), "left").drop("_pg", "_pn")
    mail = email_domain("email") if "email" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("_mail", mail)
    src = (F.when(F.col("_own").isNotNull(), "given").when(F.col("_brief").isNotNull(), "brief")
           .when(F.col("_peer").isNotNull(), "batch").when(F.col("_mail").isNotNull(), "email"))
    return (out.withColumn("domain_source", src)
            .withColumn("company_domain", F.coalesce("_own", "_brief", "_peer", "_mail"))
            .drop("_own", "_brief", "_peer", "_mail"))


# --- J12 / F10 --------------------------------------------------------------

def valid_track(requests: DataFrame, searches: DataFrame, ttl_hours: int = 6,
                key: str = "user_id", slot_seconds: int = 300) -> DataFrame:
    """Each request gets the latest search of the same key within ``ttl_hours``
    before it; a track id is single-use, so only its first request is valid.

    Inputs: (key, id, ts).  Output: request id, ts, track_id, valid.
    """
    def slot(c: str, seconds: int) -> Column:
        secs = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
        return F.floor(secs / F.lit(seconds)).cast("bigint")

    # Within a short slot: the last search up to each request.  A task sees one key's rows of a few minutes.
    r = requests.select(F.col(key).alias("_k"), F.col("id").alias("request_id"), "ts").withColumn("_slot", slot("ts", slot_seconds))
    s = (searches.select(F.col(key).alias("_k"), F.col("id").alias("_id"), F.col("ts").alias("s_ts"))
         .withColumn("_slot", slot("s_ts", slot_seconds)).withColumn("_s", F.struct("s_ts", F.col("_id").alias("track_id"))))
    u = (r.select("_k", "_slot", "ts", "request_id", F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), F.lit(1).alias("_kind"))
         .unionByName(s.select("_k", "_slot", F.col("s_ts").alias("ts"), F.lit(None).cast(r.schema["request_id"].dataType).alias("request_id"),
                               "_s", F.lit(0).alias("_kind"))))
    w = Window.partitionBy("_k", "_slot").orderBy("ts", "_kind", "_s").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_here", F.last("_s", ignorenulls=True).over(w)).where("_kind = 1").drop("_s", "_kind")
    # Between slots: each slot's last search is carried on; one row per key and slot, however active the key.
    per = max(1, ttl_hours * 3600 // slot_seconds)
    last = s.groupBy("_k", "_slot").agg(F.max("_s").alias("_last"))
    asked = r.select("_k", "_slot").distinct().withColumn("_ask", F.lit(True))
    both = last.join(asked, (last["_k"].eqNullSafe(asked["_k"])) & (last["_slot"] == asked["_slot"]), "full").select(
        F.coalesce(last["_k"], asked["_k"]).alias("_k"), F.coalesce(last["_slot"], asked["_slot"]).alias("_slot"), "_last", "_ask")
    span = F.floor(F.col("_slot") / per)
    both = (both.select("*", F.explode(F.array(span, span + 1, span + 2)).alias("_span"))
            .withColumn("_own", span == F.col("_span")).where(F.col("_own") | F.col("_last").isNotNull()))
    back = Window.partitionBy("_k", "_span").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.withColumn("_before", F.last("_last", ignorenulls=True).over(back))
               .where(F.col("_own") & F.col("_ask")).select(F.col("_k").alias("_ck"), F.col("_slot").alias("_cs"), "_before"))
    u = u.join(carried, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col("_slot") == F.col("_cs")), "left")
    u = u.withColumn("_t", F.coalesce("_here", "_before"))
    ttl = F.expr(f"INTERVAL {ttl_hours} HOURS")
    u = u.withColumn("track_id", F.when(F.col("_t.s_ts") >= F.col("ts") - ttl, F.col("_t.track_id")))
    first_use = (u.where(F.col("track_id").isNotNull()).groupBy("track_id")
                 .agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("_first")))
    out = u.join(first_use, "track_id", "left")
    return out.select("request_id", "ts", "track_id",
                      F.coalesce(F.col("_first") == F.col("request_id"), F.lit(False)).alias("valid"))


def fresh(df: DataFrame, ts_col: str, now, ttl: str) -> DataFrame:
    """rows whose timestamp lies within ``ttl`` (an interval string) of ``now``."""
    now_c = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    return df.where(F.col(ts_col) >= now_c - F.expr(f"INTERVAL {ttl}"))


# --- J13 / J14 / J15 --------------------------------------------------------

def lookup_linkedin(df: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """Profile URL key by name + company, only when exactly one person matches."""
    p = (people.withColumn("_u", normalize_linkedin_url("linkedin_url")).where(F.col("_u").isNotNull())
         .groupBy(*keys).agg(F.count_distinct("_u").alias("_n"), F.min("_u").alias("found_url"))
         .where(F.col("_n") == 1).drop("_n"))
    return df.join(p, keys, "left")


def reverse_lookup(keys: DataFrame, people: DataFrame, key_col: str = "key") -> DataFrame:
    """Email or phone → person record (union of two equi-joins)."""
    by_mail = keys.join(people.withColumnRenamed("email", key_col), key_col).withColumn("kind", F.lit("email"))
    by_phone = keys.join(people.withColumnRenamed("phone", key_col), key_col).withColumn("kind", F.lit("phone"))
    return by_mail.drop("phone").unionByName(by_phone.drop("email"))


def resolve_companies(df: DataFrame, known_pages: DataFrame, input_col: str = "company") -> DataFrame:
    """First slug candidate whose page is valid or uncertain; else unresolved.

    A company-page URL is tried by its own slug (method ``url``), a domain by its first label
    (``domain-direct:``), a name by its slug variants (``slug:``).  Blank inputs are skipped.

    ``known_pages`` (slug, status) stands in for live page checks.
    """
    raw = strip_ws(F.col(input_col))
    page = F.lower(F.regexp_extract(raw, r"(?i)linkedin\.com/company/([^/?#\s]+)", 1))
    kind = (F.when(page != "", "url").when(F.contains(raw, F.lit(".")) & ~F.contains(raw, F.lit(" ")), "domain")
            .otherwise("name"))
    domain = F.regexp_extract(raw, r"^(?:https?://)?([^/]*)", 1)
    x = df.withColumn("_in", raw).withColumn("_page", page)
    x = x.where(F.coalesce(F.col("_in") != "", F.lit(False)))
    x = x.withColumn("_kind", kind).withColumn("_d", domain)
    slugs = (F.when(F.col("_kind") == "url", F.array("_page"))
             .when(F.col("_kind") == "domain", F.array(F.regexp_replace(F.lower(F.regexp_extract("_d", r"^([^.]*)", 1)), "[^a-z0-9-]", "")))
             .otherwise(slug_candidates(F.col("_in"))))
    cand = x.select("_in", F.posexplode(slugs).alias("_pos", "slug")).distinct()
    ok = known_pages.where(F.col("status").isin("valid", "uncertain")).select("slug").distinct()
    best = cand.join(ok, "slug", "left_semi").groupBy("_in").agg(F.min(F.struct("_pos", "slug"))["slug"].alias("_slug"))
    out = x.join(best, "_in", "left")
    found = F.col("_slug").isNotNull()
    return out.select(
        *df.columns,
        F.when(found, F.concat(F.lit("https://www.linkedin.com/company/"), F.col("_slug"))).alias("url"),
        F.when(found, F.when(F.col("_kind") == "url", "url")
               .when(F.col("_kind") == "domain", F.concat(F.lit("domain-direct:"), F.col("_d")))
               .otherwise(F.concat(F.lit("slug:"), F.col("_slug")))).alias("method"),
        F.when(~found, F.when(F.col("_kind") == "url", F.concat(F.lit("url slug '"), F.col("_page"), F.lit("' not found")))
               .when(F.col("_kind") == "domain", F.concat(F.lit("no LinkedIn page for domain "), F.col("_d")))
               .otherwise(F.concat(F.lit("could not resolve "), F.col("_in")))).alias("reason"))


def resolved_urls(resolved: DataFrame) -> DataFrame:
    """The distinct page URLs that were resolved (the list handed to the scraper)."""
    return resolved.where(F.col("url").isNotNull()).select("url").distinct()


# --- F4 / F9 ----------------------------------------------------------------

def keyword_regex(words: list[str]) -> str:
    """Whole-word, case-insensitive, Unicode-aware alternation of literal phrases."""
    alts = "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alts})(?![\p{{L}}\p{{N}}])"


def mark_exclusions(df: DataFrame, titles: list[str] | None = None, company_types: list[str] | None = None,
                    domains: DataFrame | None = None, title_col: str = "title",
                    type_col: str = "company_type", domain_col: str = "company_domain") -> DataFrame:
    """every row with its ``exclusion_reason`` (NULL: kept).

    Keyword rules become one alternation regex each (codegen'd, no join); the
    domain list is a left-anti style join on the normalized domain.
    """
    reason = F.lit(None).cast("string")
    if domains is not None:
        dk = domains.select(normalize_domain(F.col(domains.columns[0])).alias("_xd")).distinct() \
            .withColumn("_xhit", F.lit(True))
        df = df.withColumn("_xd", spread_null(normalize_domain(domain_col), *hashable(df))).join(dk, "_xd", "left")
        reason = F.when(F.col("_xhit"), F.lit("excluded_domain"))
    if company_types and type_col in df.columns:
        reason = F.coalesce(reason, F.when(F.col(type_col).rlike(keyword_regex(company_types)), "excluded_company_type"))
    if titles and title_col in df.columns:
        reason = F.coalesce(reason, F.when(F.col(title_col).rlike(keyword_regex(titles)), "excluded_title"))
    return df.withColumn("exclusion_reason", reason).drop("_xd", "_xhit")


def apply_exclusions(df: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """F4 split into (kept, skipped); ``mark_exclusions`` gives both in one frame and one pass."""
    marked = mark_exclusions(df, *args, **options)
    return marked.where(F.col("exclusion_reason").isNull()), marked.where(F.col("exclusion_reason").isNotNull())


def icp_filter(companies: DataFrame, min_employees=None, max_employees=None, countries_in=None,
               countries_out=None, industries=None, keywords=None, employees_col: str = "employees",
               country_col: str = "country", industry_col: str = "industry",
               text_col: str = "company_name") -> DataFrame:
    """firmographic filter; every clause is a pushed-down-able predicate."""
    cond = F.lit(True)
    emp = F.col(employees_col).try_cast("bigint")
    if min_employees is not None:
        cond = cond & (emp >= F.lit(min_employees))
    if max_employees is not None:
        cond = cond & (emp <= F.lit(max_employees))
    if countries_in:
        cond = cond & F.col(country_col).isin(*countries_in)
    if countries_out:
        cond = cond & ~F.col(country_col).isin(*countries_out)
    if industries:
        cond = cond & F.col(industry_col).isin(*industries)
    if keywords:
        cond = cond & F.col(text_col).rlike(keyword_regex(keywords))
    return companies.where(F.coalesce(cond, F.lit(False)))
