"""Storage core: W1, W2, J1, J2, T1, T4, U1, A5, F13.

Scale notes
-----------
* First-per-key (W1) is a hash aggregation of the keys and one bigint, reduced
  map-side, and a semi join of the rows: no window, no sort of wide rows, one
  scan.  Rows with a NULL key are groups of their own.
* Sequential ids (W2) never put a whole list into one task.  Range bounds come from a
  bounded sample of the narrow order keys; a narrow pass counts rows per (range, list);
  the wide rows move once, straight to their range, and are sorted there, so they come
  out in order and their ids are ``offset + place in the range``.  Where the order is the
  input position (J1, J2, T4), blocks of positions take the place of ranges: no
  sampling, no job while the plan is built.
* Upserts decide on narrow rows (keys and positions) what is new and which id it gets;
  the wide rows meet that decision in one join.
* Existing state can be a bucketed table (S5): its side of the join is not shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterline.functions.merge import merge_intel, merge_sources
from rosterline.functions.normalize import normalize_domain, normalize_linkedin_url
from rosterline.session import materialize
from rosterline.schema import (ADVANCE_COLS, CONTACT_SCHEMA, COMPANY_SCHEMA, STAGE_TIMESTAMP,
                               STAGES, conform)

__all__ = [
    "first_per_key", "desc", "assign_ids", "assign_ids_by_position", "keep_rows", "own_if_null", "spread_null", "hashable", "upsert_contacts", "upsert_counters", "upsert_companies",
    "company_counters", "advance_stage", "create_lists", "not_found", "by_provider_id",
]


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def spread_null(key, *by) -> Column:
    """The key of a row for an outer or anti join; a NULL key, which matches nothing, becomes a value of the row's
    own (from the columns ``by``), so that such rows do not meet in one task."""
    k = F.col(key) if isinstance(key, str) else key
    return F.coalesce(k, F.concat(F.lit("\u0000"), F.xxhash64(*by).cast("string")))


def hashable(df: DataFrame) -> list[str]:
    """Columns whose values tell rows apart by a hash (maps and variants have none)."""
    return [f"`{f.name}`" for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]


# --- W1 ---------------------------------------------------------------------

def keep_rows(df: DataFrame, winners: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` are among ``winners``; NULLs match NULLs."""
    w = winners.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(on)])
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return df.join(w, cond, "left_semi")


def own_if_null(keys: list[str], ord_col: str) -> Column:
    """NULL for a row with a whole key; its own ``ord`` otherwise, so that such rows stay apart."""
    return F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.col(ord_col))


def first_per_key(df: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """The first row (smallest ``ord``) per non-NULL key; NULL-key rows pass through.

    ``ord`` is the input position and unique within a key.  One hash aggregation of the
    keys and one bigint finds the winners; the wide rows are only semi-joined.
    """
    x = df.withColumn("_own", own_if_null(keys, ord_col))
    first = x.groupBy(*keys, "_own").agg(F.min(ord_col).alias(ord_col))
    return keep_rows(x, first, [*keys, "_own", ord_col]).drop("_own")


# --- W2 ---------------------------------------------------------------------

class Key(NamedTuple):
    """One part of a sort order."""

    expr: Column
    down: bool = False
    nulls_last: bool = False

    @property
    def sort(self) -> Column:
        return ((self.expr.desc_nulls_last() if self.nulls_last else self.expr.desc_nulls_first()) if self.down
                else (self.expr.asc_nulls_last() if self.nulls_last else self.expr.asc_nulls_first()))

    def before(self, a: Column, b: Column) -> Column:
        """Whether ``a`` sorts strictly before ``b``."""
        less = (a > b) if self.down else (a < b)
        nulls = (a.isNotNull() & b.isNull()) if self.nulls_last else (a.isNull() & b.isNotNull())
        return F.coalesce(less, F.lit(False)) | nulls


def desc(c, nulls_last: bool = True) -> Key:
    """A descending part of an order of ``assign_ids``."""
    return Key(F.col(c) if isinstance(c, str) else c, True, nulls_last)


#: Sampled keys for each range; (range, list) counts up to which the offsets are broadcast (about 40 bytes a row).
SAMPLE, BROADCAST_ROWS = 60, 500_000


def assign_ids(df: DataFrame, order: list, partition_col: str | None = "list_id",
               base: DataFrame | None = None, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """``id = base + 1, base + 2, …`` per ``partition_col`` in ``order``; the rows come out in that order.

    ``order`` holds column names, expressions (ascending, NULLs first) or ``desc(..)``; it should leave no
    ties within a group, whose ids would be arbitrary.  ``base`` is a DataFrame (partition_col, base) of current
    maxima; missing → 0.  Rows with a NULL ``partition_col`` are one group.  ``num_partitions``: default is
    the session's shuffle partitions.  ``df`` is evaluated three times, twice for its keys only.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grp = partition_col or "_grp"
    src = df if partition_col else df.withColumn("_grp", F.lit(0))
    keys = [k if isinstance(k, Key) else Key(F.col(k) if isinstance(k, str) else k) for k in [grp, *order]]
    named = [k._replace(expr=F.col(f"_k{i}")) for i, k in enumerate(keys)]
    narrow = src.select(*[k.expr.alias(f"_k{i}") for i, k in enumerate(keys)])
    # A bounded random sample of the keys, in order; every n-th of them starts a range.
    ordered = narrow.orderBy(F.rand(7)).limit(SAMPLE * n).orderBy(*[k.sort for k in named]).collect()
    starts = [ordered[len(ordered) * i // n] for i in range(1, n)] if len(ordered) > n else ordered[1:]
    pid = _range_of(starts, narrow.schema)
    counts = materialize(narrow.withColumn("_pid", pid(named)).groupBy("_pid", F.col("_k0").alias("_og"))
                         .agg(F.count(F.lit(1)).alias("_n")), "ranges")
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_og").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_pid").orderBy("_og").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offs = counts.select(F.col("_pid").alias("_op"), "_og", (earlier - inside).alias("_k"))
    if base is not None:
        offs = offs.join(base.select(F.col(base.columns[0]).alias("_bg"), F.col(base.columns[1]).alias("_base")),
                         F.col("_og").eqNullSafe(F.col("_bg")), "left").drop("_bg")
    else:
        offs = offs.withColumn("_base", F.lit(0))
    offs = offs.select("_op", "_og", (F.coalesce("_base", F.lit(0)) + F.col("_k") + 1).alias("_k"))

    def in_ranges(x: DataFrame) -> DataFrame:
        return x.repartitionById(n, F.col("_pid")).sortWithinPartitions(*[k.sort for k in keys])

    # The one move of the wide rows.  The lower bits of the running number are a row's place in its range.
    placed = in_ranges(src.withColumn("_pid", pid(keys))).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    small = counts.count() <= BROADCAST_ROWS
    out = placed.join(F.broadcast(offs) if small else offs, (F.col("_pid") == F.col("_op")) & F.col(grp).eqNullSafe(F.col("_og")))
    out = out.withColumn(id_col, (F.col("_k") + F.col("_at")).cast("bigint"))
    if not small:       # very many lists: the join may have dealt the rows anew
        out = in_ranges(out)
    return out.drop("_pid", "_at", "_k", "_op", "_og", *([] if partition_col else ["_grp"]))


def _range_of(starts: list, schema):
    """Number of the range of a row's keys: how many of ``starts`` are not after them; found in two steps of
    about the square root of their number."""
    if not starts:
        return lambda keys: F.lit(0)
    wide = max(1, round(len(starts) ** 0.5))
    fields = schema.fields
    literal = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields)]) for r in starts]
    every, first = F.array(*literal), F.array(*literal[::wide])

    def reached(keys: list[Key]):
        def test(b: Column) -> Column:
            ok = F.lit(True)
            for i, k in reversed(list(enumerate(keys))):
                start = b[f"_k{i}"]
                ok = k.before(start, k.expr) | (start.eqNullSafe(k.expr) & ok)
            return ok
        return test

    def pid(keys: list[Key]) -> Column:
        block = F.size(F.filter(first, reached(keys)))          # blocks whose first start is reached
        rest = F.slice(every, F.greatest(block - 1, F.lit(0)) * wide + 1, F.lit(wide))
        return (F.greatest(block - 1, F.lit(0)) * wide + F.size(F.filter(rest, reached(keys)))).cast("int")

    return pid


def assign_ids_by_position(df: DataFrame, pos: str, partition_col: str | None = "list_id",
                           base: DataFrame | None = None, id_col: str = "id", block: int = 100_000) -> DataFrame:
    """W2 for an order that is one integer position, unique within a group: nothing is sampled or written.

    Positions fall into blocks of ``block``, so a (group, block) has at most that many rows however
    large the group is.  They should be dense, as input positions are: with a sparse one (a timestamp) blocks
    hold few rows each, and a group's blocks are summed up in one task; ``assign_ids`` is for such orders.  A row's id is its rank in its block plus the rows of earlier blocks plus the
    base.  Ids depend on the values alone, so a recomputed task gives the same ones.
    """
    grp = partition_col or "_grp"
    src = (df if partition_col else df.withColumn("_grp", F.lit(0))).withColumn("_blk", F.floor(F.col(pos) / block))
    before = Window.partitionBy("_og").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offs = (src.groupBy(F.col(grp).alias("_og"), F.col("_blk").alias("_ob")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    if base is not None:
        offs = offs.join(base.select(F.col(base.columns[0]).alias("_bg"), F.col(base.columns[1]).alias("_base")),
                         F.col("_og").eqNullSafe(F.col("_bg")), "left")
    else:
        offs = offs.withColumn("_base", F.lit(0))
    offs = offs.select("_og", "_ob", (F.coalesce("_base", F.lit(0)) + F.col("_off")).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(grp, "_blk").orderBy(pos))
    out = (src.withColumn("_r", rank).join(offs, F.col(grp).eqNullSafe(F.col("_og")) & F.col("_blk").eqNullSafe(F.col("_ob")))
           .withColumn(id_col, (F.col("_k") + F.col("_r")).cast("bigint")).drop("_k", "_r", "_og", "_ob", "_blk"))
    return out if partition_col else out.drop("_grp")


# --- J1 / A5 ----------------------------------------------------------------

def _same_list(a: str, b: str, stored: bool) -> Column:
    """Equal lists; a stored table has no NULL list, and plain equality uses its buckets."""
    return F.col(a) == F.col(b) if stored else F.col(a).eqNullSafe(F.col(b))


def upsert_contacts(existing: DataFrame | None, incoming: DataFrame, now, base: DataFrame | None = None,
                    stored: bool = False) -> DataFrame:
    """Insert-if-absent per (list_id, normalized LinkedIn URL).

    ``incoming`` needs ``list_id``, ``ord`` (input position, unique in a list) and ``linkedin_url``.
    First row per key in input order wins; keys already in the list are
    dropped; NULL keys are always inserted.  Returns the new full contacts
    table with an ``_inserted`` flag on the rows added by this call.

    ``existing`` may be the part of the table that ``incoming`` can touch, if ``base`` gives the largest id of
    each list.  ``stored``: it is a table bucketed by (list_id, linkedin_url_normalized) without a NULL list.
    """
    now = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    names = [f.name for f in CONTACT_SCHEMA.fields]
    inc = conform(incoming, CONTACT_SCHEMA).withColumn(
        "linkedin_url_normalized", normalize_linkedin_url("linkedin_url")).select(*names)
    key = ["list_id", "linkedin_url_normalized"]
    own = own_if_null(key, "ord")
    firsts = inc.groupBy(*key, own.alias("_own")).agg(F.min("ord").alias("ord"))
    ex = None
    if existing is not None:
        ex = conform(existing, CONTACT_SCHEMA).select(*names)
        have = existing.select(F.col("list_id").alias("_l"), F.col("linkedin_url_normalized").alias("_u")).where("_u is not null")
        firsts = firsts.join(have, _same_list("list_id", "_l", stored) & (spread_null(key[1], "ord") == F.col("_u")), "left_anti")
        base = ex.groupBy("list_id").agg(F.max("id").alias("base")) if base is None else base
    ids = assign_ids_by_position(firsts, "ord", "list_id", base)
    ids = ids.select(F.col("list_id").alias("_l"), F.col(key[1]).alias("_u"), F.col("ord").alias("_o"), F.col("id").alias("_id"))
    # The wide rows' only move: to the narrow rows that say which of them are new.
    ins = inc.join(ids, (F.col("ord") == F.col("_o")) & F.col("list_id").eqNullSafe(F.col("_l")) & F.col(key[1]).eqNullSafe(F.col("_u")))
    ins = ins.withColumns({"id": F.col("_id"), "stage": F.coalesce("stage", F.lit("sourced")), "sourced_at": F.coalesce("sourced_at", now),
                           "created_at": F.coalesce("created_at", now), "updated_at": now, "_inserted": F.lit(True)})
    ins = ins.select(*names, "_inserted")
    if ex is None:
        return ins
    return ex.withColumn("_inserted", F.lit(False)).unionByName(ins)


def upsert_counters(incoming: DataFrame, result: DataFrame) -> DataFrame:
    """A5: per list — inserted, skipped_duplicates, total."""
    got = incoming.groupBy("list_id").agg(F.count(F.lit(1)).alias("_in"))
    res = result.groupBy("list_id").agg(
        F.count_if(F.col("_inserted")).alias("inserted"), F.count(F.lit(1)).alias("total"))
    return (got.join(res, "list_id", "full")
            .select("list_id",
                    F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted"),
                    (F.coalesce("_in", F.lit(0)) - F.coalesce("inserted", F.lit(0))).cast("bigint")
                    .alias("skipped_duplicates"),
                    F.coalesce("total", F.lit(0)).cast("bigint").alias("total")))


# --- J2 ---------------------------------------------------------------------

_KEEP_FIRST = {"id", "created_at", "company_domain"}
_OR_FLAGS = {"verified", "enriched"}


#: Positions whose evidence URLs one task puts in order, at most.
SOURCES_BLOCK = 10_000


def _fold_companies(inc: DataFrame) -> DataFrame:
    """One row per (list_id, company_domain_normalized) of the incoming rows.

    A hash aggregation of bigints finds, column by column, the position that supplies the value; only the rows
    at those positions, at most one a column, are fetched by a join and meet by key.
    """
    names = [f.name for f in COMPANY_SCHEMA.fields]
    key = ["list_id", "company_domain_normalized"]
    plain = [c for c in names if c not in (*key, "intel", "sources", "ord", "id", *_OR_FLAGS)]
    flags = sorted(_OR_FLAGS)
    won = inc.groupBy(*[F.col(k).alias("_" + k) for k in key]).agg(
        *[(F.min if c in _KEEP_FIRST else F.max)(F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"_at_{c}") for c in plain],
        *[F.max(F.col(c).cast("int")).alias("_" + c) for c in flags],
        F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n_new"))
    places = won.withColumn("_o", F.explode(F.array_distinct(F.array(*[f"_at_{c}" for c in plain])))).where("_o is not null")
    rows = inc.select(*key, F.col("ord").alias("_ord"), *plain).join(
        places, F.col("list_id").eqNullSafe(F.col("_list_id")) & (F.col(key[1]) == F.col("_" + key[1])) & (F.col("_ord") == F.col("_o")))
    values = rows.groupBy(*key).agg(
        *[F.max(F.when(F.col("_ord") == F.col(f"_at_{c}"), F.col(c))).alias(c) for c in plain],
        *[F.max("_" + c).cast("boolean").alias(c) for c in flags], F.min("_first").alias("ord"), F.max("_n_new").alias("_n_new"))
    more = _folded_parts(inc, key).withColumnsRenamed({k: "_" + k for k in key})
    return values.join(more, F.col("list_id").eqNullSafe(F.col("_list_id")) & (F.col(key[1]) == F.col("_" + key[1])), "left").drop(
        *["_" + k for k in key])


def _folded_parts(inc: DataFrame, key: list[str]) -> DataFrame:
    """``intel`` (the last writer of a key wins, NULL included) and ``sources`` (distinct URLs in first-seen order) per key.

    Both are one list of entries, reduced map-side.  URLs are sorted in blocks of positions, then block after
    block, so that a giant company's are not collected and sorted as one group.
    """
    facts = F.transform(F.map_entries("intel"), lambda e: F.struct(
        e["key"].alias("k"), e["value"].alias("v"), F.lit(None).cast("int").alias("p")))
    urls = F.transform("sources", lambda u, i: F.struct(u.alias("k"), F.lit(None).cast("string").alias("v"), i.alias("p")))
    none = F.array().cast("array<struct<k:string,v:string,p:int>>")
    each = inc.select(*key, "ord", F.explode(F.concat(F.coalesce(facts, none), F.coalesce(urls, none))).alias("_e"))
    is_url = F.col("_e.p").isNotNull()
    each = each.groupBy(*key, is_url.alias("_url"), F.col("_e.k").alias("_k")).agg(
        F.max(F.struct("ord", F.col("_e.v").alias("v")))["v"].alias("_v"), F.min(F.struct("ord", F.col("_e.p").alias("p"))).alias("_f"))
    blocks = each.groupBy(*key, F.when(F.col("_url"), F.floor(F.col("_f.ord") / SOURCES_BLOCK)).alias("_b")).agg(
        F.array_sort(F.collect_list(F.when(F.col("_url"), F.struct("_f", F.col("_k").alias("u"))))).alias("_us"),
        F.collect_list(F.when(~F.col("_url"), F.struct("_k", "_v"))).alias("_facts"))
    whole = blocks.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("_b", F.transform("_us", lambda x: x["u"]).alias("us")))).alias("_s"),
        F.flatten(F.collect_list("_facts")).alias("_facts"))
    urls = F.flatten(F.transform("_s", lambda x: x["us"]))
    return whole.select(*key, F.map_from_entries("_facts").alias("intel"), F.when(F.size(urls) > 0, urls).alias("sources"))


def upsert_companies(existing: DataFrame | None, incoming: DataFrame, now, base: DataFrame | None = None,
                     stored: bool = False) -> DataFrame:
    """Merge upsert on (list_id, normalized domain).

    The incoming rows of a key fold into one, in ``ord`` order, which is then merged into the existing row of
    the key, if any: scalars take the last non-NULL value, ``intel`` merges key by
    key (a later NULL wins), ``sources`` is a first-seen distinct union, flags
    are OR-ed, ``id``/``created_at``/``company_domain`` keep the first value.
    NULL-key rows are always inserted.  Adds ``_status`` = existing / updated /
    inserted for the counters and ``_n_new``, the incoming rows of the key.

    ``existing`` holds a key once, as this operator leaves it.  ``base`` and ``stored`` as for
    ``upsert_contacts``, by (list_id, company_domain_normalized).
    """
    now = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    names = [f.name for f in COMPANY_SCHEMA.fields]
    key = "company_domain_normalized"
    none = F.create_map().cast("map<string,string>")
    inc = (conform(incoming, COMPANY_SCHEMA).select(*names)
           .withColumn(key, normalize_domain("company_domain")))
    folded = _fold_companies(inc.where(F.col(key).isNotNull())).withColumns(
        {"intel": F.coalesce("intel", none), "id": F.lit(None).cast("bigint")})
    free = inc.where(F.col(key).isNull()).withColumns(
        {"intel": F.coalesce("intel", none), "_n_new": F.lit(1).cast("bigint"), "id": F.lit(None).cast("bigint")})
    stamp = {"verified": F.coalesce("verified", F.lit(False)), "enriched": F.coalesce("enriched", F.lit(False)),
             "created_at": F.coalesce("created_at", now), "updated_at": now}
    cols = names + ["_status", "_n_new"]
    if existing is None:
        new = folded.withColumns(stamp).select(*names, "_n_new").unionByName(
            free.withColumns({"created_at": stamp["created_at"], "updated_at": now}).select(*names, "_n_new"))
        new = materialize(new, "companies-fold")     # read twice for the ids: the fold runs once
        return assign_ids_by_position(new.drop("id"), "ord", "list_id", base).withColumn("_status", F.lit("inserted")).select(*cols)

    ex = conform(existing, COMPANY_SCHEMA).select(*names)
    base = ex.groupBy("list_id").agg(F.max("id").alias("base")) if base is None else base
    f = folded.select(*[F.col(c).alias("_f_" + c) for c in names], "_n_new")
    own = F.col(key) if stored else spread_null(key, "list_id", "id")
    j = ex.withColumn("_had", F.lit(True)).join(f, _same_list("list_id", "_f_list_id", stored) & (own == F.col("_f_" + key)), "full")
    # Both the kept and the new rows come from this join: compute it once.
    j = materialize(j, "companies-joined")
    both = {c: F.coalesce(c, "_f_" + c) if c in _KEEP_FIRST | {"list_id", key, "ord"} else F.coalesce("_f_" + c, c)
            for c in names if c not in ("intel", "sources")}
    both |= {c: F.coalesce(F.col(c) | F.col("_f_" + c), c, "_f_" + c) for c in _OR_FLAGS}
    both |= {"ord": F.least("ord", "_f_ord"), "intel": merge_intel("intel", "_f_intel"),
             "sources": F.when(F.col("_f_sources").isNull(), F.col("sources")).otherwise(merge_sources("sources", "_f_sources"))}
    hit = F.col("_n_new").isNotNull()
    merged = j.where("_had").select(*[both[c].alias(c) if c != "updated_at" else F.when(hit, now).otherwise(F.col(c)).alias(c) for c in names],
                                    F.when(hit, "updated").otherwise("existing").alias("_status"),
                                    F.coalesce("_n_new", F.lit(0)).cast("bigint").alias("_n_new"))
    merged = merged.withColumns({k: v for k, v in stamp.items() if k != "updated_at"})
    new = (j.where("_had is null").select(*[F.col("_f_" + c).alias(c) for c in names], "_n_new").withColumns(stamp)
           .unionByName(free.withColumns({"created_at": stamp["created_at"], "updated_at": now}).select(*names, "_n_new")))
    new = assign_ids_by_position(new.drop("id"), "ord", "list_id", base).withColumn("_status", F.lit("inserted"))
    return merged.select(*cols).unionByName(new.select(*cols))


def company_counters(result: DataFrame) -> DataFrame:
    """A5 for companies: inserted (new keys + NULL-key rows), updated (other incoming rows), total."""
    return result.groupBy("list_id").agg(
        F.count_if(F.col("_status") == "inserted").cast("bigint").alias("inserted"),
        (F.sum("_n_new") - F.count_if(F.col("_status") == "inserted")).cast("bigint").alias("updated"),
        F.count(F.lit(1)).cast("bigint").alias("total"))


# --- T1 ---------------------------------------------------------------------

def advance_stage(contacts: DataFrame, updates: DataFrame, now, stage_col: str = "stage") -> DataFrame:
    """Move (list_id, id) rows to a stage and set allow-listed fields.

    ``updates`` carries ``list_id``, ``id``, ``stage`` and any allow-listed
    field columns (others are ignored, D4).  The stage timestamp is stamped
    only when empty; ``updated_at`` is bumped; moving backwards is allowed.
    An unknown stage raises (D5).  Adds ``_updated``.  Equal rows of ``updates`` for
    one (list_id, id) count once; differing ones raise, since no order says which holds.

    A changed ``linkedin_url`` recomputes the key (D6); a row whose new key
    would collide with another row of its list keeps its old URL and is
    reported in ``_key_conflict``.
    """
    now = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    fields = [c for c in updates.columns if c in ADVANCE_COLS]
    if "linkedin_url" in fields and "linkedin_url" in contacts.columns:
        contacts = contacts.withColumn("_old_url", F.col("linkedin_url"))
    u = updates.select("list_id", "id", F.col(stage_col).alias("_new_stage"),
                       *[F.col(c).alias("_u_" + c) for c in fields], F.lit(True).alias("_hit"))
    u = u.withColumn("_new_stage", F.when(F.col("_new_stage").isin(*STAGES), F.col("_new_stage"))
                     .otherwise(F.raise_error(F.concat(F.lit("invalid stage: "),
                                                       F.coalesce(F.col("_new_stage"), F.lit("NULL"))))))
    # Equal and differing updates of a contact show in the least and greatest; maps are compared as text.
    flat = F.struct(*[F.to_json(c) if isinstance(u.schema[c].dataType, T.MapType) else F.col(c) for c in u.columns if c not in ("list_id", "id")])
    whole = F.struct(*[c for c in u.columns if c not in ("list_id", "id")])
    u = (u.withColumn("_row", flat).groupBy("list_id", "id").agg(F.min("_row").alias("_a"), F.max("_row").alias("_b"), F.first(whole).alias("_w"))
         .where(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.lit(True)).otherwise(F.raise_error(F.lit("differing updates of one contact")).cast("boolean")))
         .select("list_id", "id", "_w.*"))
    j = contacts.join(u, ["list_id", "id"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    # All changes in two projections: the stage's timestamp may itself be a field of the update.
    new = {"stage": F.when(hit, F.col("_new_stage")).otherwise(F.col("stage")),
           "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    for c in fields:
        target_type = contacts.schema[c].dataType if c in contacts.columns else None
        v = F.col("_u_" + c) if target_type is None else F.col("_u_" + c).try_cast(target_type)
        new[c] = F.when(hit, v).otherwise(F.col(c)) if c in contacts.columns else v
    out = j.withColumns(new)
    out = out.withColumns({ts: F.when(hit & (F.col("stage") == st) & F.col(ts).isNull(), now).otherwise(F.col(ts))
                           for st, ts in STAGE_TIMESTAMP.items() if ts in out.columns})
    if "linkedin_url" in fields:
        out = _rekey(out, hit)
    return out.withColumn("_updated", hit).drop("_new_stage", "_hit", *["_u_" + c for c in fields])


def _rekey(out: DataFrame, hit: Column) -> DataFrame:
    """Recompute the URL key; changed rows whose new key is taken revert."""
    new_key = normalize_linkedin_url("linkedin_url")
    old_key = F.col("linkedin_url_normalized") if "linkedin_url_normalized" in out.columns \
        else normalize_linkedin_url("_old_url")
    out = (out.withColumn("_nk", new_key).withColumn("_ok", old_key)
           .withColumn("_chg", hit & ~F.col("_nk").eqNullSafe(F.col("_ok"))))
    taken = (out.where(F.col("_nk").isNotNull()).groupBy("list_id", "_nk")
             .agg(F.count(F.lit(1)).alias("_cnt")))
    out = out.join(taken, ["list_id", "_nk"], "left")
    conflict = F.col("_chg") & F.col("_nk").isNotNull() & (F.coalesce("_cnt", F.lit(0)) > 1)
    return (out.withColumn("_key_conflict", conflict)
            .withColumn("linkedin_url", F.when(conflict, F.col("_old_url")).otherwise(F.col("linkedin_url")))
            .withColumn("linkedin_url_normalized", F.when(conflict, F.col("_ok")).otherwise(F.col("_nk")))
            .drop("_nk", "_ok", "_chg", "_cnt", "_old_url"))


def not_found(ids: DataFrame, contacts: DataFrame) -> DataFrame:
    """Requested (list_id, id) pairs that do not exist, distinct and sorted."""
    return (ids.select("list_id", "id").distinct()
            .join(contacts.select("list_id", "id"), ["list_id", "id"], "left_anti")
            .orderBy("list_id", "id"))


# --- T4 ---------------------------------------------------------------------

def create_lists(lists: DataFrame | None, new: DataFrame, now) -> DataFrame:
    """T4: append lists with the next ids in ``ord`` order; default name ``list-{id}``."""
    now = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    base = None
    if lists is not None:
        base = lists.agg(F.max("list_id").alias("base")).select(F.lit(0).alias("_g"), "base")
    fresh = assign_ids_by_position(new, "ord", None, base, id_col="list_id")
    for c, t in (("list_name", "string"), ("description", "string"), ("search_criteria", "string"),
                 ("created_by", "string")):
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(t))
    fresh = (fresh.withColumn("list_name", F.coalesce(F.nullif("list_name", F.lit("")),
                                                      F.concat(F.lit("list-"), F.col("list_id").cast("string"))))
             .withColumn("created_by", F.coalesce("created_by", F.lit("unknown")))
             .withColumn("status", F.lit("active"))
             .withColumn("created_at", now).withColumn("updated_at", now))
    cols = ["list_id", "list_name", "description", "created_by", "search_criteria", "status",
            "created_at", "updated_at"]
    fresh = fresh.select(*cols)
    return fresh if lists is None else lists.select(*cols).unionByName(fresh)


# --- F13 --------------------------------------------------------------------

def by_provider_id(contacts: DataFrame, provider: str, ids: DataFrame, id_col: str = "provider_id") -> DataFrame:
    """contacts whose ``provider_ids[provider]`` is among ``ids`` (semi join)."""
    c = contacts.withColumn("_pid", F.try_element_at("provider_ids", F.lit(provider)))
    return (c.join(ids.select(F.col(id_col).cast("string").alias("_pid")).distinct(), "_pid", "left_semi")
            .drop("_pid"))
