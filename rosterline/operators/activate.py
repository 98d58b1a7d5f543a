"""Export and activation: O1, F3, F7, F8, W5, W6, A11, V2.

The export order is that of ``assign_ids``: rows move once, to the range they sort
into, and carry their position; no list is ever ranked inside a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.functions.vocab import LEAD_MAPS
from rosterline.operators.upsert import assign_ids, desc
from rosterline.schema import EXPORT_COLUMNS, MIN_STAGES

__all__ = ["min_stage", "export", "usable_leads", "usable_lead_counts", "to_lead", "assign_batches",
           "assign_senders", "push_report", "EXPORT_ORDER"]


def _check_stage(stage: str) -> None:
    if stage not in MIN_STAGES:
        raise ValueError(f"unknown min_stage {stage!r}; expected one of {MIN_STAGES}")


def min_stage(contacts: DataFrame, stage: str) -> DataFrame:
    """rows at ``stage`` or deeper; ``skipped`` never passes; unknown stage raises."""
    _check_stage(stage)
    return contacts.where(F.col("stage").isin(*MIN_STAGES[MIN_STAGES.index(stage):]))


# Score desc (NULLs last), then company name ('' for NULL, D9), then id.
def EXPORT_ORDER() -> list:
    return [desc("qualification_score"), F.coalesce(F.col("company_name"), F.lit("")), F.col("id")]


def export(contacts: DataFrame, stage: str = "sourced", list_id=None,
           with_position: bool = True) -> DataFrame:
    """O1 / V2: 16 export columns in export order, per list.

    The rows come in order; ``export_pos`` (1-based, per list) states it.
    """
    df = min_stage(contacts, stage)
    if list_id is not None:
        df = df.where(F.col("list_id") == F.lit(list_id))
    df = assign_ids(df, EXPORT_ORDER(), "list_id", id_col="export_pos")
    return df.select("list_id", *(["export_pos"] if with_position else []), *EXPORT_COLUMNS)


def _usable(channel: str):
    has_url = F.coalesce(F.col("linkedin_url") != F.lit(""), F.lit(False))
    has_mail = F.coalesce(F.col("email") != F.lit(""), F.lit(False))
    return has_url if channel == "linkedin" else (has_mail | has_url)


def usable_leads(df: DataFrame, channel: str = "email") -> DataFrame:
    """rows with an email or a LinkedIn URL; the LinkedIn channel needs the URL."""
    return df.where(_usable(channel))


def usable_lead_counts(df: DataFrame, channel: str = "email", group: str = "list_id") -> DataFrame:
    """F7 counters: usable rows and ``skipped_no_identity`` per list."""
    u = _usable(channel)
    return df.groupBy(group).agg(F.count_if(u).alias("usable"), F.count_if(~u).alias("skipped_no_identity"))


def to_lead(df: DataFrame, sequencer: str, out_col: str = "lead") -> DataFrame:
    """F8: one JSON lead per row via the sequencer's field map; empty values omitted."""
    m = LEAD_MAPS[sequencer]
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(t) for c, t in m.items() if c in df.columns]
    return df.withColumn(out_col, F.to_json(F.struct(*fields)))


def assign_batches(df: DataFrame, size: int, partition_col: str = "list_id",
                   order: list | None = None) -> DataFrame:
    """Chunk number (0-based) and position in chunk, in order, per list."""
    df = assign_ids(df, order or ["ord"], partition_col, id_col="_pos")
    return (df.withColumn("batch_no", F.floor((F.col("_pos") - 1) / F.lit(size)).cast("bigint"))
            .withColumn("batch_pos", ((F.col("_pos") - 1) % F.lit(size)).cast("bigint"))
            .drop("_pos"))


def assign_senders(leads: DataFrame, accounts: DataFrame, partition_col: str = "list_id",
                   order: list | None = None) -> DataFrame:
    """Round-robin lead → sender account (accounts ranked by ``account_ord``).

    The account count enters as a scalar subquery; the accounts table itself is
    a small dimension joined by slot.
    """
    spark = leads.sparkSession
    ranked = assign_ids(leads, order or ["ord"], partition_col, id_col="_pos")
    acc = assign_ids(accounts, ["account_ord"], None, id_col="_slot")
    out = spark.sql(
        "SELECT l.*, (l._pos - 1) % (SELECT count(*) FROM {acc}) + 1 AS _slot FROM {l} l",
        acc=accounts, l=ranked)
    return (out.join(acc.select("_slot", "account_id"), "_slot", "left")
            .drop("_slot", "_pos"))


def push_report(responses: DataFrame, skipped_no_identity=None, max_errors: int | None = 20, body_chars: int | None = 150):
    """Imported / skipped_existing / failed counts plus the first ``max_errors`` errors
    with ``body_chars`` characters of their body (the shown report's limits; None: all).

    ``responses`` has (list_id, pos, lead_key, code, body).  Returns
    (counts DataFrame per list, errors DataFrame).
    """
    body = F.lower(F.coalesce(F.col("body"), F.lit("")))
    dup = body.contains("already in the campaign")
    ok = F.col("code").isin(200, 201) & ~dup
    r = responses.withColumn("_kind", F.when(ok, "imported").when(dup, "skipped_existing").otherwise("failed"))
    counts = r.groupBy("list_id").agg(
        F.count_if(F.col("_kind") == "imported").alias("imported"),
        F.count_if(F.col("_kind") == "skipped_existing").alias("skipped_existing"),
        F.count_if(F.col("_kind") == "failed").alias("failed"))
    if skipped_no_identity is not None:
        counts = (counts.join(skipped_no_identity, "list_id", "full")
                  .na.fill(0, ["imported", "skipped_existing", "failed", "skipped_no_identity"]))
    # Top-k per list: Spark inserts a partial WindowGroupLimit before the
    # shuffle, so at most ``max_errors`` rows per list leave each map task.
    w = Window.partitionBy("list_id").orderBy("pos")
    errors = (r.where(F.col("_kind") == "failed")
              .select("list_id", "pos", "lead_key", "code",
                      F.substring("body", 1, body_chars).alias("body") if body_chars else "body"))
    if max_errors is not None:
        errors = errors.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_errors).drop("_rn")
    return counts, errors
