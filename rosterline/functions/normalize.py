"""Key normalization and small string helpers (N1–N9, N13) plus V1.

All functions build Catalyst expressions, so they stay inside whole-stage
codegen and filters on their output can still be pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "strip_ws", "blank_to_null", "normalize_linkedin_url", "normalize_domain",
    "normalize_company_name", "is_member_id", "is_vanity", "full_name", "split_name",
    "company_slug", "slug_candidates", "clean_phone", "email_domain",
    "register_sql_functions", "FREEMAIL_DOMAINS", "LEGAL_SUFFIXES",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------
# Legal-form suffixes tried when turning a company name into a page slug.
LEGAL_SUFFIXES = ["-gmbh", "-ag", "-ltd", "-inc", "-llc", "-sa", "-se", "-plc", "-group"]
# A "-gmbh" guess is added unless the slug already ends with one of these.
GMBH_GUESS_UNLESS = ["-gmbh", "-ag", "-ltd", "-inc"]
# Marker of a member-ID (non-vanity) profile URL.
MEMBER_ID_MARKER = "/in/acw"
# Company page URL pattern.
COMPANY_PAGE_RE = r"^https?://(?:www\.)?linkedin\.com/company/([a-zA-Z0-9_-]+)"
# ---------------------------------------------------------------------------

# Free-mail hosts never used as a company domain (the reference names
# gmail/outlook/yahoo and leaves the rest open; this list is ours).
FREEMAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com",
    "yahoo.com", "ymail.com", "icloud.com", "me.com", "aol.com", "gmx.de", "gmx.net",
    "web.de", "proton.me", "protonmail.com", "mail.com",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Remove leading/trailing ASCII whitespace (tabs and newlines too)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def blank_to_null(c) -> Column:
    """'' or whitespace-only → NULL, else the stripped value."""
    return F.nullif(strip_ws(c), F.lit(""))


def normalize_linkedin_url(c) -> Column:
    """NULL/'' → NULL; drop the query string, then one trailing slash; lowercase."""
    u = F.nullif(_c(c), F.lit(""))
    return F.lower(F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), r"/$", ""))


def normalize_domain(c) -> Column:
    """Host key of a domain or URL; port, ?x and #x right after the host survive."""
    s = F.lower(strip_ws(_c(c)))
    s = F.regexp_replace(s, r"^https?://", "")
    s = F.split_part(s, F.lit("/"), F.lit(1))
    s = F.regexp_replace(s, r"^www\.", "")
    s = F.regexp_replace(s, r"\.+$", "")
    return F.nullif(s, F.lit(""))


def normalize_company_name(c) -> Column:
    """N3: '' → NULL; whitespace runs → one space; trim; lowercase."""
    n = F.nullif(_c(c), F.lit(""))
    return F.lower(F.trim(F.regexp_replace(n, r"\s+", " ")))


def is_member_id(c) -> Column:
    """Member-ID profile URL test (a vanity slug starting 'acw' also hits, D20)."""
    return F.coalesce(F.lower(_c(c)).contains(MEMBER_ID_MARKER), F.lit(False))


def is_vanity(c) -> Column:
    u = _c(c)
    return F.coalesce((u != F.lit("")) & ~is_member_id(u), F.lit(False))


def full_name(first, last, full=None, name=None) -> Column:
    """Trimmed full name, else non-blank first + last joined by a space.

    With ``name`` (profile variant) the raw parts are joined and ``name`` is the
    fallback; without it the result is '' when nothing is known.
    """
    if name is not None:
        joined = F.concat_ws(" ", F.nullif(_c(first), F.lit("")), F.nullif(_c(last), F.lit("")))
        return F.coalesce(F.nullif(joined, F.lit("")), _c(name))
    joined = strip_ws(F.concat_ws(" ", blank_to_null(first), blank_to_null(last)))
    if full is None:
        return joined
    return F.coalesce(blank_to_null(full), joined)


def split_name(c) -> tuple[Column, Column]:
    """Split a one-string name at the first space → (first, last)."""
    parts = F.split(F.trim(_c(c)), " ", 2)
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def company_slug(c) -> Column:
    """Slug of a company page URL, else NULL."""
    u = F.regexp_replace(strip_ws(_c(c)), r"/+$", "")
    return F.nullif(F.regexp_extract(u, COMPANY_PAGE_RE, 1), F.lit(""))


def slug_candidates(c) -> Column:
    """Ordered page-slug guesses for a company name, domain or page URL."""
    s = strip_ws(_c(c))
    lowered = F.replace(F.lower(s), F.lit(" "), F.lit("-"))
    direct = F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9-]", ""), r"^-+|-+$", "")
    stripped = F.filter(
        F.array(*[F.when(direct.endswith(F.lit(suf)),
                         F.substring(direct, F.lit(1), F.length(direct) - F.lit(len(suf))))
                  for suf in LEGAL_SUFFIXES]),
        lambda x: x.isNotNull() & (x != F.lit("")))
    ends_legal = None
    for suf in GMBH_GUESS_UNLESS:
        e = direct.endswith(F.lit(suf))
        ends_legal = e if ends_legal is None else (ends_legal | e)
    gmbh = F.when(ends_legal, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(direct, F.lit("-gmbh"))))
    by_name = F.concat(F.array(direct), stripped, gmbh)
    host = F.split_part(F.regexp_replace(s, r"^https?://", ""), F.lit("/"), F.lit(1))
    by_domain = F.array(F.regexp_replace(F.lower(F.split_part(host, F.lit("."), F.lit(1))),
                                         r"[^a-z0-9-]", ""))
    slug = company_slug(s)
    return (F.when(slug.isNotNull(), F.array(slug))
            .when(s.contains(".") & ~s.contains(" "), by_domain)
            .otherwise(by_name))



def clean_phone(c) -> Column:
    """Remove spaces; '' → NULL."""
    return F.nullif(F.replace(strip_ws(_c(c)), F.lit(" "), F.lit("")), F.lit(""))


def email_domain(c, freemail: list[str] | None = None) -> Column:
    """Domain part of an email, NULL for free-mail hosts or no '@'."""
    e = F.lower(strip_ws(_c(c)))
    dom = F.nullif(F.substring_index(e, "@", -1), F.lit(""))
    hosts = freemail if freemail is not None else FREEMAIL_DOMAINS
    return F.when(e.contains("@") & ~dom.isin(*hosts), dom)


_SQL_FUNCS = {
    "normalize_linkedin_url": ("url STRING",
                               r"lower(regexp_replace(regexp_replace(nullif(url, ''), '\\?.*$', ''), '/$', ''))"),
    "normalize_company_name": ("name STRING",
                               r"lower(trim(regexp_replace(nullif(name, ''), '\\s+', ' ')))"),
    "normalize_domain": ("d STRING",
                         r"nullif(regexp_replace(regexp_replace(split_part(regexp_replace(lower("
                         r"regexp_replace(d, '^\\s+|\\s+$', '')), '^https?://', ''), '/', 1), "
                         r"'^www\\.', ''), '\\.+$', ''), '')"),
}


def register_sql_functions(spark: SparkSession) -> None:
    """V1: temporary SQL functions; Catalyst inlines their bodies into plans."""
    for name, (args, body) in _SQL_FUNCS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS STRING RETURN {body}")
