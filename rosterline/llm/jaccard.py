"""Operator 1: near duplicates by a Jaccard self-join on word n-grams (chosen path).

Texts become sets of hashed five-word shingles; equal sets are one class from
the start, so copies never meet each other.  Each of ``runs`` runs splits the
classes recursively: at each level a set chooses, by a hash all sets share, the
tokens with hash below ``fanout``/size (``fanout`` expected), and goes into the
node of each.  Sets of similarity t choose a common token with probability
1 - exp(-fanout * t * (chance of the level below)), about 0.89 a run for 0.8;
four runs miss about 2 pairs in 10,000 (``expected_recall``).  A node of at most
``leaf`` classes is compared by brute force.  A larger node is split once more;
what is still large then consists of sets that agree nearly everywhere, or that
share a line which a part of all texts has.  It is compared in block pairs of at
most ``block`` classes a side: exact, spread over many tasks, and without cap.
Blocks hold sets of like sizes (bands), as sizes that differ by more than the
threshold allows can't be similar: a block meets those of its own band and of
the bands beside it.

In a node, pairs are first filtered by their chosen tokens (a fixed-size
sketch), then verified exactly on the full sets, which travel only for classes
that have a candidate.  Common values are counted by a matrix product, or over
lists of the rows that hold a value where those are short: the same counts, but
a group whose members have little in common costs about what it holds.  A pair that meets in several nodes is counted by the
node of the smallest id.  Pairs never become rows: a block gives, per class, its
number of links and a root within the block, and the roots are joined to
connected components.

Classes are keyed by the signature of their set, never by an id, so ids may be
null or shared by different texts: such texts keep their links and their own
classes.  A row is found again by its id and a hash of its text.

Defined cases: a text without words (or null) is alone in its class, named by
its own id; fewer than five words form one shingle; repeated rows share a class;
a null id sorts after all others, and a class whose rows all have null ids has a
null name (its key still tells it apart); an empty table gives no rows; other columns
are ignored, or kept by ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import batch_of, map_arrow, materialize, mix64, raw_of, rising, words_of

__all__ = ["similar_documents", "drop_near_duplicates", "shingles", "expected_recall"]

RUNS, FANOUT, DEPTH, LEAF, BLOCK = 4, 3.0, 2, 64, 4096
#: Least number of commonly chosen tokens of a candidate pair; a pair at 0.8 has 19 on average.
LEAST_COMMON = 5
#: What a listed holder of a value and a row cost, in cells of a matrix product; see ``common``.
LISTED, LISTED_ROW = 100, 1_000_000


def expected_recall(t: float, runs: int = RUNS, fanout: float = FANOUT, depth: int = DEPTH) -> float:
    """Chance that two sets of similarity ``t`` meet in a deepest node of some run and pass the sketch filter there.

    Of ``runs * depth * fanout`` expected choices, the share that lies in both sets is chosen by both.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-fanout * t * p)
    mean = runs * depth * fanout * 2 * t / (1 + t)
    enough = 1 - sum(math.exp(-mean) * mean ** k / math.factorial(k) for k in range(LEAST_COMMON))
    return (1 - (1 - p) ** runs) * enough


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """Distinct hashed shingles of a text, sorted."""
    words = words_of(raw)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    k = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return rising(mix64(out))


def signature(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([mix64(s, 101).sum(), mix64(s, 102).sum()], np.uint64).tobytes()


def chosen(s: np.ndarray, run: int, level: int) -> np.ndarray:
    """Tokens the set chooses at a level of a run, marked with run and level."""
    seed = 1000 + run * DEPTH + level
    h = mix64(s, seed)
    limit = np.uint64(min(1.0, FANOUT / len(s)) * (2.0 ** 64 - 2048))
    return mix64(s[h <= limit], seed + 500).view(np.int64)


def _sets(b: pa.RecordBatch):
    out = {c: [] for c in ("sig", "n", "p1", "p2")}
    for raw in raw_of(b.column("_text")):
        s = shingles(raw)
        out["sig"].append(signature(s) if len(s) else None)
        out["n"].append(len(s))
        for level in range(DEPTH):
            out[f"p{level + 1}"].append([chosen(s, r, level) if len(s) else [] for r in range(RUNS)])
    yield out | {"doc_id": b.column("doc_id"), "h": b.column("h")}


def _full_sets(b: pa.RecordBatch):
    sig, toks = [], []
    for raw in raw_of(b.column("_text")):
        s = shingles(raw)
        if len(s):
            sig.append(signature(s))
            toks.append(s.view(np.int64))
    yield {"sig": sig, "toks": toks}


# --- nodes ---------------------------------------------------------------

def members_of(classes: DataFrame) -> DataFrame:
    """(node, sig, part_a, part_b, size) of all nodes to be compared; large ones as block pairs."""
    level = classes.select("sig", F.posexplode("p1").alias("run", "_n")).select("sig", "run", F.explode("_n").alias("node"))
    sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = level.join(sizes, "node")
    leaves = sized.where(F.col("size") <= LEAF).select("node", "sig", "size")
    big = sized.where(F.col("size") > LEAF).select("node", "sig", "run")
    deeper = materialize(big.join(classes.select("sig", "p2"), "sig")
                         .select("sig", F.col("node").alias("_up"), F.explode(F.element_at("p2", F.col("run") + 1)).alias("_t"))
                         .select("sig", F.xxhash64("_up", "_t").alias("node")), "nodes")
    sizes = deeper.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return leaves.unionByName(deeper.join(sizes, "node").select("node", "sig", "size"))


def in_blocks(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Deals a node of more than ``BLOCK`` classes to pairs of blocks; each class goes to the pairs of its block.

    A band of sizes is as wide as sizes of similar sets may differ (a bit more, for rounding), so a block is paired with
    those of its own band and of the two beside it only.  A part is a block: its band, and its number in the band.
    """
    width = 1.0001 * math.log(1 / min(max(threshold, 1e-6), 0.999))
    large = (members.where(F.col("size") > BLOCK).join(classes.select("sig", "n"), "sig")
             .withColumn("_band", F.floor(F.log("n") / F.lit(width)).cast("int")))
    bands = large.groupBy("node", "_band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("_blocks"))
    bands = bands.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("_band", "_blocks"))).alias("_bands"))

    def part(band, block):
        return F.shiftleft(band.cast("bigint"), 32) + block

    def parts_of(band):
        n = F.coalesce(F.try_element_at("_bands", band), F.lit(0).cast("bigint"))
        return F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), n), lambda i: i < n), lambda i: part(band, i))

    band = F.col("_band")
    own = F.pmod(F.xxhash64("sig"), F.element_at("_bands", band))
    spread = (large.join(bands, "node").withColumn("_own", part(band, own))
              .withColumn("_other", F.explode(F.concat(parts_of(band - 1), parts_of(band), parts_of(band + 1)))))
    zero = F.lit(0).cast("bigint")
    return (members.where(F.col("size") <= BLOCK)
            .select(*members.columns, zero.alias("_own"), zero.alias("part_a"), zero.alias("part_b"))
            .unionByName(spread.select(*members.columns, "_own", F.least("_own", "_other").alias("part_a"),
                                       F.greatest("_own", "_other").alias("part_b"))))


def rows_of(b: pa.RecordBatch) -> list[dict]:
    """Rows with list columns as slices of one numpy array."""
    cols = {}
    for f, c in zip(b.schema, b.columns):
        if pa.types.is_list(f.type):
            flat, at = c.flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])
            cols[f.name] = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
        else:
            cols[f.name] = c.to_pylist()
    return [dict(zip(cols, r)) for r in zip(*cols.values())]


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Row groups of equal (node, part_a, part_b) from sorted batches; a group may span batches."""
    held: list[dict] = []
    key = None
    for b in batches:
        for row in rows_of(b):
            k = row["node"], row["part_a"], row["part_b"]
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(row)
    if held:
        yield held


def common(a: list, b: list, same: bool = False) -> np.ndarray:
    """Number of common values for each pair of one list's arrays with the other's; an array's values are distinct.

    With ``same`` the lists are one, and what an array has in common with itself isn't told.
    """
    lists = a if same else [*a, *b]
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists)
    values, ids = np.unique(flat, return_inverse=True)
    end = len(flat) if same else sizes[:len(a)].sum()
    held = np.bincount(ids[:end], minlength=len(values))
    useful = held > 1 if same else (held > 0) & (np.bincount(ids[end:], minlength=len(values)) > 0)
    rows, cols = np.repeat(np.arange(len(lists)), sizes)[useful[ids]], (np.cumsum(useful) - 1)[ids[useful[ids]]]
    out = np.zeros((len(a), len(b)), np.float32)
    n = int(useful.sum())
    if not n:
        return out
    mine = slice(0, len(rows) if same else np.searchsorted(rows, len(a)))
    theirs = mine if same else slice(mine.stop, len(rows))
    holders = np.bincount(cols[theirs], minlength=n)
    if int(holders[cols[mine]].sum()) * LISTED + len(a) * LISTED_ROW < len(a) * len(b) * n:
        order = np.argsort(cols[theirs], kind="stable")
        listed, start = (rows[theirs] - (0 if same else len(a)))[order], np.cumsum(holders) - holders
        at = np.searchsorted(rows[mine], np.arange(len(a) + 1))
        for i in np.flatnonzero(np.diff(at)):
            c = cols[at[i]:at[i + 1]]
            k = holders[c]
            found = np.repeat(start[c] - np.cumsum(k) + k, k) + np.arange(k.sum())
            out[i] = np.bincount(listed[found], minlength=len(b))
        return out
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    wide = 1024
    for at in range(0, n, wide):
        lo, hi = np.searchsorted(cols, [at, at + wide])
        m = np.zeros((len(lists), min(wide, n - at)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - at] = 1
        out += m @ m.T if same else m[:len(a)] @ m[len(a):].T
    return out


def in_pairs(ok: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows and of the columns with a pair; alike for both where the sides are one."""
    i, j = ok.any(1), ok.any(0)
    return (np.flatnonzero(i | j),) * 2 if same else (np.flatnonzero(i), np.flatnonzero(j))


def candidates(a: list[dict], b: list[dict], same: bool, threshold: float) -> np.ndarray:
    """Pairs of the group to verify: similar sketches and sizes, and no smaller node in common."""
    na, nb = np.array([r["n"] for r in a]), np.array([r["n"] for r in b])
    ok = (na[:, None] >= threshold * nb - 1e-9) & (nb >= (threshold * na - 1e-9)[:, None])
    if same:
        ok = np.triu(ok, 1)
    if ok.any():
        ok &= common([r["picks"] for r in a], [r["picks"] for r in b], same) >= LEAST_COMMON
    i, j = in_pairs(ok, same)
    if len(i):
        node = a[0]["node"]
        less = [[side[k]["nodes"][side[k]["nodes"] < node] for k in at] for side, at in ((a, i), (b, j))]
        ok[np.ix_(i, j)] &= common(*less, same) == 0
    return ok


def sides(group: list[dict]) -> tuple[list[dict], list[dict], bool]:
    if group[0]["part_a"] == group[0]["part_b"]:
        return group, group, True
    a = [r for r in group if r["_own"] == r["part_a"]]
    return a, [r for r in group if r["_own"] == r["part_b"]], False


def _filter(threshold: float, schema: pa.Schema):
    def run(batches):
        kept: list[dict] = []
        for g in groups_of(batches):
            a, b, same = sides(g)
            if not a or not b or len(g) < 2:
                continue
            ok = candidates(a, b, same, threshold)
            hit = {r["sig"] for r, x in zip(a, ok.any(1)) if x} | {r["sig"] for r, x in zip(b, ok.any(0)) if x}
            kept += [r for r in g if r["sig"] in hit]
            if len(kept) > 2000:
                yield batch_of({f.name: [r[f.name] for r in kept] for f in schema}, schema)
                kept = []
        if kept:
            yield batch_of({f.name: [r[f.name] for r in kept] for f in schema}, schema)

    return run


def linked(a: list[dict], b: list[dict], ok: np.ndarray, same: bool) -> list[tuple[bytes, int, bytes]]:
    """(sig, number of links, root) of the classes with a link in the group; roots spread along the links."""
    sigs = np.array([r["sig"] for r in a] + ([] if same else [r["sig"] for r in b]), object)
    rank = np.argsort(np.argsort(sigs, kind="stable"), kind="stable").astype(np.int32)
    if same:
        ok = ok | ok.T
    la, lb = rank[:len(a)].copy(), rank[-len(b):].copy()
    none = np.int32(len(sigs))
    while True:
        na = np.minimum(la, np.where(ok, lb[None, :], none).min(1))
        nb = na if same else np.minimum(lb, np.where(ok, na[:, None], none).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    links = ok.sum(1) if same else np.concatenate([ok.sum(1), ok.sum(0)])
    named = sigs[np.argsort(rank)]
    label = la if same else np.concatenate([la, lb])
    return [(sigs[i], int(links[i]), named[label[i]]) for i in np.flatnonzero(links)]


def _verify(threshold: float, schema: pa.Schema):
    def run(batches):
        out: list[tuple[bytes, int, bytes]] = []
        for g in groups_of(batches):
            a, b, same = sides(g)
            if not a or not b or len(g) < 2:
                continue
            ok = candidates(a, b, same, threshold)
            i, j = in_pairs(ok, same)
            if not len(i):
                continue
            a, b, ok = [a[k] for k in i], [b[k] for k in j], ok[np.ix_(i, j)]
            inter = common([r["toks"] for r in a], [r["toks"] for r in b], same)
            total = np.array([r["n"] for r in a])[:, None] + np.array([r["n"] for r in b])
            ok &= inter * (1 + threshold) >= threshold * total - 1e-6
            out += linked(a, b, ok, same)
            if len(out) > 20_000:
                yield batch_of(dict(zip(("sig", "links", "root"), zip(*out))), schema)
                out = []
        if out:
            yield batch_of(dict(zip(("sig", "links", "root"), map(list, zip(*out)))), schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(sig, label): connected components of (sig, root) by smallest label, with pointer jumping.

    Each round is written to the shared folder; rounds grow with the logarithm of a component's diameter.
    """
    both = materialize(edges.where("sig <> root").select(F.col("sig").alias("x"), F.col("root").alias("y"))
                       .unionByName(edges.where("sig <> root").select(F.col("root").alias("x"), F.col("sig").alias("y")))
                       .distinct(), "edges")
    label = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("_near"))
        step = label.join(near, "x").select("x", "label", F.least("label", "_near").alias("_m"))
        up = label.select(F.col("x").alias("_m"), F.col("label").alias("_up"))
        new = materialize(step.join(up, "_m", "left").select("x", F.col("label").alias("_old"),
                                                             F.least("_m", F.coalesce("_up", "_m")).alias("label")), "labels")
        if not new.where("label <> _old").limit(1).count():
            return new.select(F.col("x").alias("sig"), "label")
        label = new.select("x", "label")


def _classes(docs: DataFrame, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h, sig; classes of equal sets: sig, copy, first, label, n_links).

    ``h`` is a hash of the text.  ``copy`` and ``first`` are structs (no_id, doc_id, h) of the first row of the
    class and of its component; ``label`` names the component.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    nested = "array<array<bigint>>"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("_text"))
    rows = materialize(map_arrow(source, source.columns, _sets,
                                 f"doc_id {id_type}, h bigint, sig binary, n int, p1 {nested}, p2 {nested}"), "sets")
    # The chosen tokens are a function of the set, so any row of a class may give them.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    classes = materialize(rows.where("sig is not null").groupBy("sig").agg(
        F.min(row).alias("copy"), F.first("n").alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2")),
        "classes")
    members = materialize(members_of(classes), "members")
    lists = members.groupBy("sig").agg(F.collect_set("node").alias("nodes"))
    known = (classes.select("sig", "n", F.flatten(F.concat("p1", "p2")).alias("picks")).join(lists, "sig"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["node", "part_a", "part_b"]
    dealt = (in_blocks(members, classes, threshold).join(known, "sig").repartition(parts, *order).sortWithinPartitions(*order)
             .select("node", "part_a", "part_b", "_own", "sig", "n", "picks", "nodes"))
    kept = materialize(dealt.mapInArrow(_filter(threshold, _schema(dealt)), dealt.schema), "candidates")
    needed = kept.select("sig").distinct().join(classes.select("sig", "copy"), "sig").select(
        F.col("copy.doc_id").alias("_id"), F.col("copy.h").alias("_h")).distinct()
    full = map_arrow(source.join(needed, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"),
                     ["doc_id", "_text"], _full_sets, "sig binary, toks array<bigint>")
    full = full.groupBy("sig").agg(F.first("toks").alias("toks"))
    joined = kept.join(full, "sig").repartition(parts, *order).sortWithinPartitions(*order)
    found = joined.mapInArrow(_verify(threshold, _schema_of("sig binary, links bigint, root binary", docs)),
                              "sig binary, links bigint, root binary")
    found = materialize(found, "links")
    label = components(found)
    linked = (found.groupBy("sig").agg(F.sum("links").alias("n_links")).join(label, "sig")
              .join(classes.select("sig", "copy"), "sig"))
    first = linked.groupBy("label").agg(F.min("copy").alias("first"))
    linked = linked.join(first, "label").select("sig", "first", "label", "n_links")
    return rows.select("doc_id", "h", "sig"), classes.select("sig", "copy").join(linked, "sig", "left").select(
        "sig", "copy", F.coalesce("first", "copy").alias("first"), F.coalesce("label", "sig").alias("label"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def similar_documents(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy_of, class_id, n_links, class_key of every document.

    ``copy_of``: smallest id with the same shingles.  ``class_id``: smallest id of
    the connected component of texts linked by a similarity of at least
    ``threshold``.  ``n_links``: number of different texts (shingle sets) linked to this one.
    ``class_key``: hex name of the component, its own even where ids are null or shared; null without words.
    """
    rows, classes = _classes(docs, threshold, doc_id, text)
    # A text without words has no class; its row's own values keep such rows apart in the join.
    found = classes.withColumnRenamed("sig", "_sig")
    own = F.coalesce("sig", F.concat(F.lit("-"), F.xxhash64("doc_id", "h").cast("string")).cast("binary"))
    return rows.join(found, own == F.col("_sig"), "left").select(
        "doc_id", F.when(F.col("_sig").isNull(), F.col("doc_id")).otherwise(F.col("copy.doc_id")).alias("copy_of"),
        F.when(F.col("_sig").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.lower(F.hex("label")).alias("class_key"))


def _schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _schema_of(ddl: str, df: DataFrame) -> pa.Schema:
    return _schema(df.sparkSession.createDataFrame([], ddl))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with all its columns; texts without words stay, all of them.

    The kept row is the one of the smallest id (of the smallest text hash, if several texts share it);
    among repeated rows of that id and text one stays.
    """
    rows, classes = _classes(docs, threshold, doc_id, text)
    first = classes.select("first").distinct().select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    hashed = docs.withColumn("__h", F.xxhash64(F.col(text)))
    same = (F.col("__h") == F.col("_h")) & F.col(doc_id).eqNullSafe(F.col("_id"))
    kept = hashed.join(first, same, "left_semi").dropDuplicates([doc_id, "__h"])
    empty = rows.where("sig is null").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    return kept.unionByName(hashed.join(empty, same, "left_semi")).select(*docs.columns)
