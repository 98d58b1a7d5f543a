"""Merge and text-assembly expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["merge_intel", "merge_sources", "discovery_reason"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def merge_intel(left, right) -> Column:
    """Shallow map merge; the right side wins key by key, a NULL value too.

    Built without a session-wide map-key policy: keys present on the right are
    filtered out of the left before concatenation, so no duplicate can arise.
    """
    l = F.coalesce(_c(left), F.create_map().cast("map<string,string>"))
    r = F.coalesce(_c(right), F.create_map().cast("map<string,string>"))
    rk = F.map_keys(r)
    return F.map_concat(F.map_filter(l, lambda k, v: ~F.array_contains(rk, k)), r)


def merge_sources(left, right) -> Column:
    """Distinct union of evidence URLs, first-seen order."""
    e = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(_c(left), e), F.coalesce(_c(right), e)))


def discovery_reason(seed, similarity) -> Column:
    """N22: 'lookalike of {seed} (similarity {score})'."""
    return F.format_string("lookalike of %s (similarity %s)", _c(seed), _c(similarity).cast("string"))
