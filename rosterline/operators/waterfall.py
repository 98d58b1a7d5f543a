"""Enrichment waterfalls: W3, W4, W7, W8, W9, F5, F6, J10, J11, T2, A6, A7, A10, A14.

All providers' answers are joined at once and the provider rank picks the
winner with an aggregation (the least of a rank struct): there is no loop
over providers and no window over a whole contact group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.normalize import full_name, is_member_id, is_vanity, strip_ws
from rosterline.operators.upsert import hashable, keep_rows, spread_null
from rosterline.functions.vocab import (APIFY_PER_PROFILE, APIFY_RUN_FEE, PHONE_TYPE_RANK, RUN_CEILINGS,
                                        SPEND_GATE, literal_map)

__all__ = [
    "classify_answers", "reverify", "email_waterfall", "phone_waterfall", "union_search",
    "resolve_waterfall", "best_contact", "split_submittable", "choose_match_key", "align_results",
    "estimate_cost", "priced_estimate", "gate", "waterfall_report", "coverage_report",
]


def _blank(c) -> Column:
    return F.coalesce(strip_ws(F.col(c)) == F.lit(""), F.lit(True))


# --- J11 / classification ----------------------------------------------------

def classify_answers(results: DataFrame, semantics: DataFrame) -> DataFrame:
    """Status semantics → verdict (accept / flag / reverify / miss); unknown → miss.

    ``semantics`` (provider, raw_status, verdict, optionally capability) is a dimension; a
    NULL raw status matches a NULL semantics row (null-safe join).  With a capability on
    both sides it is part of the key.  Several verdicts of one key reduce to the smallest.
    """
    on = ["provider", "raw_status"] + ["capability"] * ("capability" in semantics.columns and "capability" in results.columns)
    sem = (semantics.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)])
           .agg(F.min("verdict").alias("verdict")))
    results = results.drop("verdict")          # re-classification replaces an earlier verdict
    cond = F.col("provider") == F.col("_k0")
    for i, c in list(enumerate(on))[1:]:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    j = results.join(sem, cond, "left").drop(*[f"_k{i}" for i in range(len(on))])
    return j.withColumn("verdict", F.coalesce("verdict", F.lit("miss")))


def reverify(answers: DataFrame, validations: DataFrame) -> DataFrame:
    """Answers marked ``reverify`` are accepted only when the validator says valid
    (``catch_all`` → flag); everything else passes through unchanged.

    Several validations of one address count once, the best one: valid, then catch_all, then
    any other (smallest name).
    """
    rank = F.when(F.col("status") == "valid", 0).when(F.col("status") == "catch_all", 1).otherwise(2)
    v = (validations.groupBy(F.col("email").alias("_ve"))
         .agg(F.min(F.struct(rank.alias("r"), F.col("status").alias("s"))).alias("_s"))
         .select("_ve", F.col("_s.s").alias("validation")))
    answers = answers.drop("validation")
    j = answers.join(v, F.col("email") == F.col("_ve"), "left").drop("_ve")
    return j.withColumn("verdict", F.when(F.col("verdict") != "reverify", F.col("verdict"))
                        .when(F.col("validation") == "valid", "reverified")
                        .when(F.col("validation") == "catch_all", "flag")
                        .otherwise("miss"))


# --- W3 / N23 / T2 ------------------------------------------------------------

_ACCEPTED = ["accept", "flag", "reverified"]
_LABEL = {"accept": "accepted", "flag": "accepted_catch_all", "reverified": "reverified"}


def email_waterfall(contacts: DataFrame, answers: DataFrame, key: str = "contact_id") -> DataFrame:
    """W3 + N23 + T2: first accepted answer per contact in (rank, ord) order.

    ``answers`` carry (key, provider, rank, ord, raw_status, email, verdict)
    after ``classify_answers`` / ``reverify``.  Contacts with no accepted answer
    come out ``not_found``.  The log lists every answer up to the winner.
    """
    # An accepted status without an address does not stop the waterfall.
    a = answers.withColumn("_ok", F.col("verdict").isin(*_ACCEPTED) & ~_blank("email")) \
        .withColumn("_rk", F.struct("rank", "ord"))
    # One aggregation per contact: winner, bonus data (from any answer, winner or not) and the steps,
    # which are the log's own content (a few per provider).
    step = F.concat_ws(":", "provider", F.coalesce("raw_status", F.lit("null")))
    bonus = [c for c in ("resolved_linkedin_url", "resolved_last_name") if c in answers.columns]
    per = a.groupBy(key).agg(
        F.min(F.when(F.col("_ok"), F.struct("_rk", "email", "provider", "verdict"))).alias("_w"),
        F.array_sort(F.collect_list(F.struct("_rk", step.alias("_s")))).alias("_steps"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct("_rk", c)))[c].alias(c) for c in bonus])
    out = contacts.join(per, key, "left")
    upto = F.filter("_steps", lambda x: F.col("_w").isNull() | (x["_rk"] <= F.col("_w._rk")))
    log = F.nullif(F.array_join(F.transform(upto, lambda x: x["_s"]), "→"), F.lit(""))
    label = literal_map(_LABEL)
    found = F.col("_w").isNotNull()
    return out.select(
        *contacts.columns, *bonus,
        F.col("_w.email").alias("email"),
        F.when(found, F.col("_w.provider")).otherwise("not_found").alias("email_source"),
        F.when(found, F.try_element_at(label, F.col("_w.verdict"))).otherwise("not_found").alias("email_validation"),
        F.concat_ws("→", log, F.when(found, F.lit("accepted")).otherwise(F.lit("not_found")))
        .alias("email_waterfall_log"))


# --- W4 -------------------------------------------------------------------------

def phone_waterfall(contacts: DataFrame, answers: DataFrame, key: str = "contact_id") -> DataFrame:
    """Valid numbers only (unvalidated ones accepted but flagged when no
    validator ran); mobile > direct_dial > switchboard, then provider rank.
    A switchboard winner is always flagged, never silently accepted."""
    tr = F.try_element_at(literal_map(PHONE_TYPE_RANK), F.col("phone_type"))
    # NULL validation = no validator ran: accepted, but flagged below.
    ok = (F.col("validation") == "valid") | F.col("validation").isNull()
    a = answers.where(F.col("phone").isNotNull() & ok).withColumn(
        "_rk", F.struct(F.coalesce(tr, F.lit(9)).alias("t"), F.col("rank").alias("r"), F.col("ord").alias("o")))
    win = a.groupBy(key).agg(F.min(F.struct("_rk", "phone", "phone_type", "provider", "validation")).alias("_w"))
    out = contacts.join(win, key, "left")
    found = F.col("_w").isNotNull()
    return out.select(
        *contacts.columns, F.col("_w.phone").alias("phone"), F.col("_w.phone_type").alias("phone_type"),
        F.when(found, F.col("_w.provider")).otherwise("not_found").alias("phone_source"),
        F.when(~found, "not_found").when(F.col("_w.validation").isNull(), "unvalidated")
        .otherwise(F.col("_w.validation")).alias("phone_validation"),
        (found & (F.col("_w.validation").isNull() | (F.col("_w.phone_type") == "switchboard"))).alias("flagged"))


# --- W7 / W8 / W9 ---------------------------------------------------------------

def union_search(frames: list[DataFrame], waterfall: DataFrame, key: str = "linkedin_url_normalized") -> DataFrame:
    """Pool every provider's rows; a row is net-new for the provider that found
    its key first in waterfall order (NULL keys are always net-new).  Providers that the
    waterfall doesn't name come last, in name order."""
    pooled = frames[0]
    for f in frames[1:]:
        pooled = pooled.unionByName(f, allowMissingColumns=True)
    wf = waterfall.groupBy(F.col("provider").alias("source")).agg(F.min("rank").cast("int").alias("_wr"))
    pooled = pooled.join(wf, "source", "left")
    mine = F.struct(F.coalesce("_wr", F.lit(2**31 - 1)).alias("r"), F.coalesce("source", F.lit("")).alias("s"), "ord")
    first = pooled.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(mine).alias("_f"))
    first = first.withColumnRenamed(key, "_fk")
    j = pooled.join(first, spread_null(key, *hashable(pooled)) == F.col("_fk"), "left")
    return j.withColumn("net_new", F.col("_f").isNull() | F.col("_f").eqNullSafe(mine)).drop("_f", "_fk", "_wr")


def resolve_waterfall(waterfalls: DataFrame, providers: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """order = configured ∩ available ∩ enabled; builtin / keyless providers are
    always available.  One row per capability with the ordered list and a flag
    when nothing is available.  Both inputs are small config dimensions."""
    p = providers.select("provider", F.coalesce(F.col("builtin") | F.col("has_key"), F.lit(False)).alias("_av"))
    j = waterfalls.join(p, "provider", "left")
    ok = F.coalesce("_av", F.lit(False))
    if enabled is not None:
        ok = ok & F.col("provider").isin(*enabled)
    j = j.withColumn("_ok", ok)
    return (j.groupBy("capability")
            .agg(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("rank", "provider")))).alias("_s"))
            .select("capability", F.transform("_s", lambda x: x["provider"]).alias("resolved"))
            .withColumn("no_provider", F.size("resolved") == 0))


def best_contact(contacts: DataFrame, score_col: str, group: list[str]) -> DataFrame:
    """One decision-maker per company: highest score, then earliest ``ord``, then smallest id.

    An unscored contact comes after every scored one; a NULL company is a company of its own.
    """
    rk = F.struct(F.col(score_col).isNull().alias("n"), (-F.col(score_col)).alias("s"), F.col("ord").alias("o"), "id")
    best = contacts.groupBy(*group).agg(F.min(rk).alias("_w")).select(*group, F.col("_w.id").alias("id"))
    return keep_rows(contacts, best, group + ["id"])


# --- F5 / F6 / J10 --------------------------------------------------------------

def split_submittable(df: DataFrame, domain_col: str = "company_domain"):
    """blank domain → excluded with reason ``empty_domain`` (never failed)."""
    blank = _blank(domain_col)
    return (df.where(~blank),
            df.where(blank).withColumn("reason", F.lit("empty_domain")))


def choose_match_key(df: DataFrame, provider: str, capability: str = "email_enrich") -> DataFrame:
    """the identity a provider is queried with, by its priority list.

    Adds ``match_key`` (the rule that fired) or ``excluded`` with a reason.
    """
    url = F.col("linkedin_url")
    vanity = is_vanity(url)
    has_dom = ~_blank("company_domain")
    fn = full_name("first_name", "last_name", F.col("full_name") if "full_name" in df.columns else None)
    has_name = fn != F.lit("")
    has_pid = (F.try_element_at("provider_ids", F.lit(provider)).isNotNull()
               if "provider_ids" in df.columns else F.lit(False))
    has_mail = ~_blank("email") if "email" in df.columns else F.lit(False)
    has_company = ~_blank("company_name") if "company_name" in df.columns else F.lit(False)
    if provider in ("apollo", "prospeo"):
        key = F.when(has_pid, "id").when(vanity, "linkedin_url").otherwise("name+domain")
    elif provider == "ai-ark" and capability == "phone_enrich":
        key = F.when(vanity, "linkedin_url").when(has_dom & has_name, "domain+full_name")
    elif provider == "leadmagic" and capability == "email_enrich":
        key = (F.when(has_dom & has_name, "name+domain").when(has_company & has_name, "full_name+company_name")
               .when(F.coalesce(vanity, F.lit(False)), "profile_url"))
    elif provider == "leadmagic" and capability == "phone_enrich":
        key = F.when(vanity, "profile_url").when(has_mail, "work_email")
    else:
        key = F.when(has_dom, "name+domain")
    reason = {("ai-ark", "phone_enrich"): "no_phone_key", ("leadmagic", "email_enrich"): "no_email_key", ("leadmagic", "phone_enrich"): "no_vanity_url_or_email"}
    return df.withColumn("match_key", key).withColumn(
        "excluded", F.when(F.col("match_key").isNull(), F.lit(reason.get((provider, capability), "empty_domain"))))


def align_results(submitted: DataFrame, answers: DataFrame, batch_col: str = "batch_no",
                  pos_col: str = "batch_pos", items_col: str = "items") -> DataFrame:
    """The i-th answer of a batch belongs to its i-th submitted row; short
    answer arrays leave the tail empty.  ``answers`` has (batch, items JSON array)."""
    a = answers.select(*[c for c in answers.columns if c != items_col],
                       F.posexplode(F.from_json(F.col(items_col), "array<string>")).alias(pos_col, "answer"))
    keys = [c for c in answers.columns if c != items_col]
    return submitted.join(a, keys + [pos_col], "left")


# --- A6 / A7 / A10 / A14 --------------------------------------------------------

def estimate_cost(df: DataFrame, group: str = "list_id", scrape_mode: str = "short", runs: int = 1) -> DataFrame:
    """Credits per provider/capability from the contacts about to be enriched.

    FullEnrich 1 (email) / 10 (phone) per submittable row; AI Ark email 1 per
    row (every row, D21), phone 1 per addressable row; profile scraping USD
    per run (``runs``: one per company in one-by-one batches) and per profile by
    ``scrape_mode`` (short, full, full_email), 2 dp.
    """
    sub = ~_blank("company_domain")
    fn = full_name("first_name", "last_name")
    addressable = is_vanity("linkedin_url") | (sub & (fn != F.lit("")))
    return df.groupBy(group).agg(
        F.count_if(sub).alias("fullenrich_submittable"),
        F.count_if(~sub).alias("fullenrich_excluded_empty_domain"),
        (F.count_if(sub) * 1).cast("bigint").alias("fullenrich_email_credits"),
        (F.count_if(sub) * 10).cast("bigint").alias("fullenrich_phone_credits"),
        F.count(F.lit(1)).cast("bigint").alias("aiark_email_credits"),
        F.count_if(addressable).cast("bigint").alias("aiark_phone_credits"),
        F.count_if(~addressable).cast("bigint").alias("aiark_phone_excluded"),
        (F.lit(APIFY_RUN_FEE * runs).cast("decimal(10,3)")
         + F.count(F.lit(1)) * F.lit(APIFY_PER_PROFILE[scrape_mode]).cast("decimal(10,3)"))
        .cast("decimal(10,2)").alias("apify_usd"))


def priced_estimate(counts: DataFrame, prices: DataFrame, count_col: str = "billable") -> DataFrame:
    """A6 (other providers): credits = billable rows × the price table's credits per
    (provider, capability).  ``counts`` has provider, capability and ``count_col``.
    Without a price the estimate is NULL and ``unknown_price`` is set, never 0."""
    p = prices.select("provider", "capability", "credits", "charged_on")
    return (counts.join(p, ["provider", "capability"], "left")
            .withColumn("credits_estimate", (F.col(count_col) * F.col("credits")).cast("decimal(12,3)"))
            .withColumn("unknown_price", F.col("credits").isNull()))


def gate(costs: DataFrame, contacts_over: int = SPEND_GATE["contacts"], credits_over: int = SPEND_GATE["credits"],
         credit_ceiling: int = RUN_CEILINGS["fullenrich_credits"],
         contacts_col: str = "contacts", credits_col: str = "credits",
         ceilings: dict[str, float] | None = None) -> DataFrame:
    """Confirm when contacts OR credits exceed the thresholds; block past a ceiling.

    ``ceilings`` maps further spend columns (USD, other providers' credits) to their ceiling.  A cost
    that is not known (NULL) is blocked: it can't be shown to be within the ceiling.
    """
    over = F.col(credits_col).isNull() | (F.col(credits_col) > credit_ceiling)
    for c, most in (ceilings or {}).items():
        over = over | F.col(c).isNull() | (F.col(c) > F.lit(most))
    return costs.withColumn(
        "decision", F.when(over, "blocked")
        .when((F.col(contacts_col) > contacts_over) | (F.col(credits_col) > credits_over), "confirm")
        .otherwise("proceed"))


def waterfall_report(answers: DataFrame, winners: DataFrame, source_col: str = "email_source") -> DataFrame:
    """A10: per provider — answers found, accepted (won), re-verified, rejected."""
    a = answers.groupBy("provider").agg(
        F.count_if(F.col("email").isNotNull()).alias("found"),
        F.count_if(F.col("verdict") == "miss").alias("rejected"))
    w = winners.where(F.col(source_col) != "not_found").groupBy(F.col(source_col).alias("provider")).agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(F.col("email_validation") == "reverified").alias("reverified"))
    return (a.join(w, "provider", "full")
            .na.fill(0, ["found", "rejected", "accepted", "reverified"]))


def coverage_report(contacts: DataFrame, group: str = "list_id") -> DataFrame:
    """Identity coverage before enrichment — rows, vanity URL, name+domain only, no key."""
    vanity = is_vanity("linkedin_url")
    dom = ~_blank("company_domain")
    name = full_name("first_name", "last_name") != F.lit("")
    return contacts.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(vanity).alias("with_linkedin"),
        F.count_if(is_member_id("linkedin_url")).alias("member_id_urls"),
        F.count_if(~vanity & dom & name).alias("name_domain_only"),
        F.count_if(~vanity & ~(dom & name)).alias("no_key"))
