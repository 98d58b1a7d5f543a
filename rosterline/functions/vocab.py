"""Vocabularies and small dimension tables (N10–N12, N14 and the dimension
tables feeding J6, W3, W4, W8, F6, F8, A6).

Dimensions here are literal and tiny (tens of rows); joining them is always a
broadcast hash join with a fixed, proven size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.dialplan import dial_country

__all__ = [
    "PHONE_TYPE_MAP", "SENIORITY_IDS", "APOLLO_SENIORITIES", "DROPLEADS_SENIORITIES", "REGIONS", "WATERFALLS", "STATUS_SEMANTICS",
    "PRICES", "LEAD_MAPS", "BATCH_SIZES", "SPEND_GATE", "RUN_CEILINGS", "COUNTRY_ISO2", "country_names", "PHONE_TYPE_RANK",
    "map_phone_type", "normalize_email_status", "map_seniority", "phone_country",
    "waterfall_df", "status_semantics_df", "prices_df", "literal_map",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------
# Provider phone type -> canonical phone type.
PHONE_TYPE_MAP = {"mobile": "mobile", "work_direct": "direct_dial", "work_hq": "switchboard"}

# Canonical seniority -> profile-search seniority level id (case-insensitive).
SENIORITY_IDS = {
    "director": "220", "vp": "300", "cxo": "310", "c-level": "310", "c_suite": "310",
    "manager": "210", "senior": "120", "owner": "320", "partner": "320",
}

# Seniority vocabularies accepted by two people-search providers.
APOLLO_SENIORITIES = ["c_suite", "vp", "director", "manager", "senior", "entry"]
DROPLEADS_SENIORITIES = ["C-Level", "VP", "Director", "Manager", "Senior", "Entry", "Intern"]

# Broad region -> countries, in the configured order.
REGIONS = {
    "Europe": ["Austria", "Belgium", "Denmark", "Finland", "France", "Germany", "Ireland",
               "Italy", "Luxembourg", "Netherlands", "Norway", "Poland", "Portugal", "Spain",
               "Sweden", "Switzerland", "United Kingdom"],
    "DACH": ["Germany", "Austria", "Switzerland"],
    "Benelux": ["Belgium", "Netherlands", "Luxembourg"],
    "Nordics": ["Denmark", "Sweden", "Norway", "Finland", "Iceland"],
    "North America": ["United States", "Canada"],
    "UKI": ["United Kingdom", "Ireland"],
}

# Default provider order per capability.
WATERFALLS = {
    "company_search": ["web_research", "ai-ark", "dropleads", "apollo", "leadmagic"],
    "company_enrich": ["web_research", "ai-ark", "firecrawl", "leadmagic"],
    "people_search": ["apify", "apollo", "dropleads", "ai-ark", "leadmagic", "web_research"],
    "email_enrich": ["apollo", "fullenrich", "leadmagic", "ai-ark"],
    "email_validate": ["leadmagic", "fullenrich"],
    "phone_enrich": ["apollo", "fullenrich", "leadmagic", "ai-ark"],
    "phone_validate": ["clearoutphone"],
    "crm_dedupe": ["hubspot"],
}

# (provider, capability, raw status, verdict); NULL raw status is written None.
STATUS_SEMANTICS = [
    ("apollo", "email_enrich", "verified", "accept"),
    ("apollo", "email_enrich", "guessed", "reverify"),
    ("apollo", "email_enrich", "extrapolated", "reverify"),
    ("apollo", "email_enrich", "unavailable", "miss"),
    ("apollo", "email_enrich", None, "miss"),
    ("prospeo", "email_enrich", "VERIFIED", "accept"),
    ("prospeo", "email_enrich", "UNVERIFIED", "reverify"),
    ("prospeo", "email_enrich", None, "miss"),
    ("fullenrich", "email_enrich", "DELIVERABLE", "accept"),
    ("fullenrich", "email_enrich", "HIGH_PROBABILITY", "accept"),
    ("fullenrich", "email_enrich", "CATCH_ALL", "flag"),
    ("fullenrich", "email_enrich", "INVALID", "miss"),
    ("fullenrich", "email_enrich", "INVALID_DOMAIN", "miss"),
    ("fullenrich", "email_enrich", None, "miss"),
    ("ai-ark", "email_enrich", "deliverable", "accept"),
    ("ai-ark", "email_enrich", "catch_all", "flag"),
    ("ai-ark", "email_enrich", "invalid", "miss"),
    ("ai-ark", "email_enrich", None, "miss"),
    ("leadmagic", "email_enrich", "valid", "accept"),
    ("leadmagic", "email_validate", "valid", "valid"),
    ("leadmagic", "email_validate", "valid_catch_all", "catch_all"),
    ("leadmagic", "email_validate", "invalid", "invalid"),
    ("leadmagic", "email_validate", "unknown", "unknown"),
    ("clearoutphone", "phone_validate", "valid", "valid"),
    ("clearoutphone", "phone_validate", "invalid", "invalid"),
    ("leadmagic", "email_enrich", None, "miss"),
]

# (provider, capability, unit, credits, charged_on)
PRICES = [
    ("fullenrich", "email_enrich", "credit", 1.0, "submitted"),
    ("fullenrich", "phone_enrich", "credit", 10.0, "submitted"),
    ("ai-ark", "email_enrich", "credit", 1.0, "found"),
    ("ai-ark", "phone_enrich", "credit", 1.0, "found"),
    ("leadmagic", "email_validate", "credit", 0.25, "definitive"),
    ("leadmagic", "phone_enrich", "credit", 5.0, "found"),
    ("apollo", "email_enrich", "credit", 1.0, "submitted"),
    ("apollo", "phone_enrich", "credit", 1.0, "match"),
    ("apollo", "company_search", "credit", 1.0, "page of 100"),
    ("apollo", "people_search", "credit", 0.0, "free"),
    ("ai-ark", "company_search", "credit", 1.0, "returned"),
    ("ai-ark", "company_enrich", "credit", 0.0, "free"),
    ("ai-ark", "people_search", "credit", 1.0, "returned"),
    ("leadmagic", "company_search", "credit", 1.0, "returned"),
    ("leadmagic", "company_enrich", "credit", 5.0, "match"),
    ("leadmagic", "people_search", "credit", 1.0, "returned"),
    ("leadmagic", "email_enrich", "credit", 1.0, "found"),
    ("clearoutphone", "phone_validate", "validation", 1.0, "submitted"),
    ("dropleads", "people_search", "credit", 0.0, "free"),
    ("hubspot", "crm_dedupe", "credit", 0.0, "free"),
    ("web_research", "company_search", "credit", 0.0, "free"),
    ("web_research", "company_enrich", "credit", 0.0, "free"),
    ("web_research", "people_search", "credit", 0.0, "free"),
    ("prospeo", "company_search", "credit", 1.0, "request with results"),
    ("prospeo", "people_search", "credit", 0.0, "free"),
    ("prospeo", "company_enrich", "credit", 1.0, "match"),
    ("ai-ark", "linkedin_url_lookup", "credit", 1.0, "match"),
    ("leadmagic", "linkedin_url_lookup", "credit", 1.0, "match"),
    ("leadmagic", "linkedin_url_lookup_by_email", "credit", 5.0, "match"),
    ("web_research", "linkedin_url_lookup", "credit", 0.0, "free"),
]
# Profile scraping prices in USD per profile by mode, plus the per-run start fee.
APIFY_PER_PROFILE = {"short": 0.004, "full": 0.008, "full_email": 0.012}
APIFY_RUN_FEE = 0.02

# Request batch sizes (rows per request; titles per search for leadmagic).
BATCH_SIZES = {"apollo_match": 10, "fullenrich": 100, "hubspot": 100, "smartlead": 400, "leadmagic_titles": 12}
# Spend gate and per-run ceilings of the default configuration.
SPEND_GATE = {"contacts": 50, "credits": 500}
RUN_CEILINGS = {"per_run_usd": 50, "apollo_credits": 2000, "fullenrich_credits": 1000}

# Canonical export column -> sequencer lead field.
LEAD_MAPS = {
    "lemlist": {"email": "email", "first_name": "firstName", "last_name": "lastName",
                "company_name": "companyName", "title": "jobTitle", "linkedin_url": "linkedinUrl",
                "phone": "phone", "company_domain": "companyDomain"},
    "smartlead": {"email": "email", "first_name": "first_name", "last_name": "last_name",
                  "company_name": "company_name", "phone": "phone_number",
                  "linkedin_url": "linkedin_profile", "company_domain": "company_url",
                  "location": "location"},
    "heyreach": {"first_name": "firstName", "last_name": "lastName", "linkedin_url": "profileUrl",
                 "company_name": "companyName", "title": "position", "email": "emailAddress",
                 "location": "location"},
}
# ---------------------------------------------------------------------------

# Phone type preference (W4): lower is better.
PHONE_TYPE_RANK = {"mobile": 1, "direct_dial": 2, "switchboard": 3}

# English country names as they stand in contact records, beyond those that the JVM's locale data gives.
COUNTRY_ISO2 = {
    "Austria": "AT", "Belgium": "BE", "Denmark": "DK", "Finland": "FI", "France": "FR",
    "Germany": "DE", "Ireland": "IE", "Italy": "IT", "Luxembourg": "LU", "Netherlands": "NL",
    "Norway": "NO", "Poland": "PL", "Portugal": "PT", "Spain": "ES", "Sweden": "SE",
    "Switzerland": "CH", "United Kingdom": "GB", "Iceland": "IS", "United States": "US",
    "Canada": "CA", "UK": "GB", "Great Britain": "GB", "USA": "US", "United States of America": "US", "Czech Republic": "CZ",
    "Turkey": "TR", "Russian Federation": "RU", "Viet Nam": "VN", "Korea, Republic of": "KR", "The Netherlands": "NL",
    "Hong Kong": "HK", "Macau": "MO", "Ivory Coast": "CI", "Burma": "MM", "Swaziland": "SZ", "Macedonia": "MK",
}


def country_names() -> dict[str, str]:
    """English name to ISO-2 code of every country in the JVM's locale data, and the names above."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return dict(COUNTRY_ISO2)
    locale = spark._jvm.java.util.Locale
    return {locale("", c).getDisplayCountry(locale.ENGLISH): c for c in locale.getISOCountries()} | COUNTRY_ISO2


def literal_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def map_phone_type(c) -> Column:
    """Provider phone type → mobile / direct_dial / switchboard (else NULL)."""
    return F.try_element_at(literal_map(PHONE_TYPE_MAP), F.lower(_c(c)))


def normalize_email_status(provider, raw, email, catch_all_flag=None) -> Column:
    """Per-provider raw email status → deliverable / catch_all / invalid / unknown."""
    p = F.lower(_c(provider))
    r = F.upper(F.coalesce(_c(raw).cast("string"), F.lit("")))
    has_email = F.coalesce(_c(email) != F.lit(""), F.lit(False))
    flag = F.coalesce(_c(catch_all_flag), F.lit(False)) if catch_all_flag is not None else F.lit(False)
    fullenrich = (F.when(~has_email, "invalid")
                  .when(r.isin("DELIVERABLE", "HIGH_PROBABILITY"), "deliverable")
                  .when(r == "CATCH_ALL", "catch_all").otherwise("invalid"))
    aiark = (F.when(r == "CATCH_ALL", "catch_all")
             .when(has_email, "deliverable").otherwise("invalid"))
    validator = (F.when((r == "VALID") & flag, "catch_all").when(r == "VALID", "deliverable")
                 .when(r == "INVALID", "invalid").otherwise("unknown"))
    return (F.when(p == "fullenrich", fullenrich).when(p == "ai-ark", aiark)
            .when(p == "leadmagic", validator))


# Canonical seniority (lower case) -> term of each provider vocabulary (ours).
_CXO = ("cxo", "c-level", "c_suite", "c-suite")
_TO_APOLLO = {**{k: "c_suite" for k in _CXO}, **{v: v for v in APOLLO_SENIORITIES}}
_TO_DROPLEADS = {**{k: "C-Level" for k in _CXO}, **{v.lower(): v for v in DROPLEADS_SENIORITIES}}


def map_seniority(arr, provider: str = "apify") -> Column:
    """Array of canonical seniorities → the provider's vocabulary
    (profile-search level ids by default); unknown values dropped, case-insensitive."""
    table = {"apify": SENIORITY_IDS, "apollo": _TO_APOLLO, "dropleads": _TO_DROPLEADS}[provider]
    m = literal_map(table)
    return F.filter(F.transform(_c(arr), lambda x: F.try_element_at(m, F.lower(x))),
                    lambda x: x.isNotNull())


def phone_country(phone, country=None, names: dict[str, str] | None = None) -> Column:
    """The country of the number's longest dial prefix → ISO-2, else the contact's country.

    The number counts as international if it starts with ``+`` or ``00``.  ``names`` maps country names to codes
    (default ``country_names()``).
    """
    digits = F.regexp_replace(F.regexp_replace(_c(phone), r"[^0-9+]", ""), r"^00", "+")
    body = F.when(digits.startswith("+"), F.regexp_replace(digits, r"\+", ""))
    by_prefix = dial_country(body)
    if country is None:
        return by_prefix
    return F.coalesce(by_prefix, F.try_element_at(literal_map(names or country_names()), _c(country)))


# --- dimension tables -------------------------------------------------------

def waterfall_df(spark: SparkSession, waterfalls: dict | None = None) -> DataFrame:
    wf = waterfalls or WATERFALLS
    rows = [(cap, i + 1, p) for cap, ps in wf.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "capability string, rank int, provider string")


def status_semantics_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATUS_SEMANTICS,
                                 "provider string, capability string, raw_status string, verdict string")


def prices_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, capability string, unit string, "
                                         "credits double, charged_on string")
