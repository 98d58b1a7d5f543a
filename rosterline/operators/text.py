"""line-level text pattern scan (re-aimed from the publish check).

One combined pattern picks the whole texts in which some rule hits; those are split
into lines with ``posexplode`` and each rule is one ``rlike`` on every line.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["SCAN_RULES", "PLACEHOLDER_RE", "scan_text"]

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------
# (rule, pattern, case-insensitive?)
SCAN_RULES = [
    ("secret_fetch", r"gh api .*contents/\.env", True),
    ("secret_fetch", r"eval .*gh api", True),
    ("secret_fetch", r"curl .*contents/\.env", True),
    ("env_path", r"/Users/[A-Za-z0-9._-]+/.*\.env", True),
    ("private_key", r"BEGIN [A-Z ]*PRIVATE KEY", True),
    ("credential", r"(API_KEY|APIKEY|TOKEN|SECRET|PASSWORD|BEARER)[\"' ]*[:=]\s*[\"']?[A-Za-z0-9_+/-]{24,}", False),
]
# Credential hits that look like placeholders are dropped (case-insensitive).
PLACEHOLDER_RE = r"(<[a-z_]+>|your[_-]|example|placeholder|changeme|xxxx|\bnpg_|user:pass)"
# ---------------------------------------------------------------------------


def scan_text(df: DataFrame, id_col: str, text_col: str = "text", deny_terms: list[str] | None = None,
              ci_credentials: bool = False) -> DataFrame:
    """Rows (id, rule, line_no, line) for every line that hits a rule.

    The credential rule is case-sensitive as published; ``ci_credentials``
    also catches lower-case names such as ``token = "…"``.
    """
    rules = list(SCAN_RULES)
    for t in deny_terms or []:
        rules.append(("deny_term", re.escape(t), True))
    rules = [(name, ("(?i)" if ci or (name == "credential" and ci_credentials) else "") + pat) for name, pat, ci in rules]
    # One combined pattern over the whole text: only texts in which some rule hits are split into lines.
    # ``.`` does not match a newline, so a hit in the text is a hit in a line.
    some = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for _, p in rules)
    lines = (df.where(F.col(text_col).rlike(some))
             .select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_pos", "line")))
    # Then each line's rules; a line without a hit explodes to nothing.
    flags = []
    for name, pat in rules:
        cond = F.col("line").rlike(pat)
        if name == "credential":
            cond = cond & ~F.col("line").rlike("(?i)" + PLACEHOLDER_RE)
        flags.append(F.when(cond, F.lit(name)))
    hit_rules = F.array_distinct(F.filter(F.array(*flags), lambda x: x.isNotNull()))
    return lines.select(id_col, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line",
                        F.explode(hit_rules).alias("rule")).select(id_col, "rule", "line_no", "line")
