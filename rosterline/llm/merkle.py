"""Operator 13: Merkle manifest of a dataset, checked by a recursive climb.

``build`` hashes every row to a leaf, numbers the leaves of each group by id and
builds the levels above: 16 consecutive nodes become one, until one is left, the
group's subroot.  The subroots, ordered by group, are the leaves of a top tree
that ends in the root.  Every built node is one row of ``nodes``: its place, its
digest, the digests of its children side by side, and the place of its parent and
its slot there, across the step from a group's tree to the top tree as well.

``climb`` is one recursive Spark query.  It starts at every leaf, with the
leaf's digest or a tampered one; each round joins to the parent, emits the
siblings found there as that level's part of the proof, folds every leaf's digest
with them and goes on from the parent.  It ends where a node has no parent.  The
leaves of a run have all siblings above it in common, so they climb as one row
that holds a digest for each of them and the common siblings once.  A round emits
the siblings of one level, so what is written grows with the length of the
proofs, not with its square.

Scale: leaves are numbered by range partitions and offsets, no task sees a
group.  A node high up is the parent of many rows of a round, so a node above
``SPAN`` leaves is stored under several salts, one for each ``SPAN`` of them.  Nothing is broadcast but what the planner measures.

Defined cases: a null in any hashed column is ``-``; a null group is the first;
null ids come first; rows with equal ids are ordered by their leaves, equal rows
are separate leaves; a group of one row has its leaf as subroot, a table of one
group has that subroot as root; a proof without siblings is the hash of nothing;
a row with a null id counts as not chosen by the id's hash; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm.common import materialize
from rosterline.operators.upsert import assign_ids

__all__ = ["leaf_digest", "build", "climb", "verify", "tampered_text", "ORACLE"]

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, SPAN = 16, 4096
#: Rows of a level that a task builds, at least.
ROWS = 50_000
_TOP = "t"


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 over the columns, each its byte count and value, ``-`` if null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tampered_text(text: str = "text") -> Column:
    """The text with A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _hash(digests: Column) -> Column:
    """Digest of digests that lie side by side, taken as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _runs(nodes: DataFrame, of: list[str]) -> DataFrame:
    """(tree, pos, members) of every ``ARITY`` consecutive nodes; small levels are dealt to few partitions."""
    spark = nodes.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // ROWS + 1)
    return (nodes.withColumn("_run", F.floor(F.col("pos") / ARITY)).repartition(parts, "tree", "_run").groupBy("tree", "_run")
            .agg(F.array_sort(F.collect_list(F.struct("pos", *of))).alias("members"))
            .select("tree", F.col("_run").alias("pos"), "members"))


def _rise(nodes: DataFrame, level: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (tree, pos, digest, span), which are at ``level``, and the last node of each
    tree (tree, level, digest, span)."""
    levels, tops = [], None
    while True:
        runs = materialize(_runs(nodes, ["digest", "span"]).select(
            "tree", "pos", F.expr("aggregate(members, 0L, (a, x) -> a + x.span)").alias("span"),
            _joined("digest").alias("kids")), "runs")
        # A tree whose first run holds one node has no other: that node is its last.
        done = (F.col("pos") == 0) & (F.octet_length("kids") == 32)
        top = runs.where(done).select("tree", F.lit(level).alias("level"), F.col("kids").alias("digest"), "span")
        tops = top if tops is None else tops.unionByName(top)
        level += 1
        nodes = runs.where(~done).select("tree", F.lit(level).alias("level"), "pos", _hash(F.col("kids")).alias("digest"), "kids", "span")
        if nodes.isEmpty():
            return levels, tops
        nodes = materialize(nodes, "nodes")
        levels.append(nodes)


def _joined(field: str) -> Column:
    """The members' digests side by side."""
    return F.expr(f"aggregate(members, cast('' as binary), (a, x) -> concat(a, x.{field}))")


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves``: id, group, leaf, start (null: the leaf itself).  Returns (runs, nodes), linked to their parents.

    A row of ``runs`` holds up to ``ARITY`` consecutive leaves of a group (members: pos, id, leaf, start) and, as
    digest, level and pos, the node above them; a group's lone leaf is that node itself (level 0).  ``nodes`` are the
    nodes above those.  Both have up_tree, up_level, up_pos (the parent; no node there for the root), slot and up_salts.
    """
    spark = leaves.sparkSession
    tree = F.coalesce(F.concat(F.lit("s"), F.col("group").cast("string")), F.lit("n"))
    numbered = materialize(leaves.select(tree.alias("tree"), "id", "leaf", "start", F.monotonically_increasing_id().alias("uid")), "leaves")
    placed = assign_ids(numbered, ["id", "leaf", "uid"], "tree", id_col="_nr").withColumn("pos", F.col("_nr") - 1)
    placed = materialize(placed.select("tree", "pos", "id", "leaf", "start"), "placed")
    lone = (F.col("pos") == 0) & (F.size("members") == 1)
    runs = _runs(placed, ["id", "leaf", "start"]).withColumns({
        "level": F.when(lone, 0).otherwise(1), "span": F.size("members").cast("bigint"),
        "digest": F.when(lone, F.col("members")[0]["leaf"]).otherwise(_hash(_joined("leaf"))),
        "uid": F.monotonically_increasing_id()})
    runs = materialize(runs, "runs")
    node = ["tree", "level", "pos", "digest", "span"]
    levels, subroots = _rise(runs.where("level = 1").select(*node), 1)
    subroots = subroots.unionByName(runs.where("level = 0").select(*subroots.columns))
    # Null group before all others, the rest by bytes: as the tree names 'n', 's...' sort.
    tops = materialize(assign_ids(subroots, ["tree"], None, id_col="_nr").withColumn("top", F.col("_nr") - 1).drop("_nr"), "tops")
    above, _ = _rise(tops.select(F.lit(_TOP).alias("tree"), F.col("top").alias("pos"), "digest", "span"), 0)
    nodes = spark.createDataFrame([], "tree string, level int, pos bigint, digest binary, kids binary, span bigint")
    for level in levels + above:
        nodes = nodes.unionByName(level)
    salts = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"),
                         F.ceil(F.col("span") / SPAN).alias("up_salts"))
    tops = tops.select(F.col("tree").alias("_t"), F.col("level").alias("_l"), "top")

    def linked(rows: DataFrame) -> DataFrame:
        j = rows.join(tops, (F.col("tree") == F.col("_t")) & (F.col("level") == F.col("_l")) & (F.col("pos") == 0), "left")
        at = F.coalesce("top", "pos")
        j = j.withColumns({"up_tree": F.when(F.col("top").isNull(), F.col("tree")).otherwise(F.lit(_TOP)),
                           "up_level": F.when(F.col("top").isNull(), F.col("level") + 1).otherwise(F.lit(1)),
                           "up_pos": F.floor(at / ARITY), "slot": F.pmod(at, F.lit(ARITY)).cast("int")})
        return j.drop("_t", "_l", "top").join(salts, ["up_tree", "up_level", "up_pos"], "left")

    return materialize(linked(runs), "linked-runs"), materialize(linked(nodes), "linked-nodes")


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """A recursive query may emit as many rows as there are; the session's own limit comes back afterwards."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: ``folded`` holds the digest of each leaf of a run, folded up to the node at hand.
CLIMB = """WITH RECURSIVE climb AS (
  SELECT uid, 0 AS step, tree, digest, CAST('' AS BINARY) AS siblings, folded, up_tree, up_level, up_pos, slot,
    pmod(uid, up_salts) AS salt FROM {leaves}
  UNION ALL
  SELECT c.uid, c.step + 1, n.tree, n.digest, concat(substring(n.kids, 1, 32 * c.slot), substring(n.kids, 32 * c.slot + 33)),
    transform(c.folded, x -> unhex(sha2(lower(hex(
      concat(substring(n.kids, 1, 32 * c.slot), x, substring(n.kids, 32 * c.slot + 33)))), 256))),
    n.up_tree, n.up_level, n.up_pos, n.slot, pmod(c.uid, n.up_salts)
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos AND c.salt = n.salt)
SELECT uid, step, tree, digest, siblings, folded FROM climb"""


def climb(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """uid, step, tree, digest, siblings, folded: a row for each run of leaves and each of its ancestors.

    The leaves of a run fold on their own; they share all siblings but those within the run, which the
    first fold takes from the run itself.
    """
    spark = runs.sparkSession
    salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("span") / SPAN) - 1)))
    start = "coalesce(x.start, x.leaf)"
    first = F.when(F.col("level") == 0, F.expr(f"transform(members, x -> {start})")).otherwise(F.expr(
        "transform(members, (x, i) -> unhex(sha2(lower(hex(concat(substring(kids, 1, 32 * i), "
        f"{start}, substring(kids, 32 * i + 33)))), 256)))"))
    anchor = runs.withColumn("kids", _joined("leaf")).withColumn("folded", first).drop("kids", "members")
    return spark.sql(CLIMB, leaves=anchor, nodes=salted)


def verify(docs: DataFrame, columns: tuple = COLUMNS, doc_id: str = "doc_id", group: str = "source",
           text: str = "text", every: int = 5, proofs: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, with ``proofs``, proof: the
    siblings as hex text, level by level.

    Rows whose id's crc32 is divisible by ``every`` are tampered with before the climb: their text is lower-cased.
    """
    cols = {c: F.col(c) for c in columns}
    chosen = F.crc32(F.col(doc_id).cast("string").cast("binary")) % every == 0
    start = F.when(chosen, leaf_digest(cols | {text: tampered_text(text)}))
    runs, nodes = build(docs.select(F.col(doc_id).alias("id"), F.col(group).alias("group"), leaf_digest(cols).alias("leaf"),
                                    start.alias("start")))
    path = climb(runs, nodes).groupBy("uid").agg(
        F.max_by("folded", "step").alias("folded"), F.max_by("digest", "step").alias("root"),
        F.max(F.when(F.col("tree") != _TOP, F.struct("step", "digest")))["digest"].alias("subroot"),
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("_s"))
    with _unlimited(docs.sparkSession):
        path = materialize(path.withColumn("above", F.expr("aggregate(_s, cast('' as binary), (a, x) -> concat(a, x.siblings))"))
                           .drop("_s"), "paths")
    whole = runs.select("uid", "members", _joined("leaf").alias("kids")).join(path, "uid")
    each = whole.select("root", "subroot", "above", "kids", "folded", F.posexplode("members").alias("i", "m"))
    proof = F.lower(F.hex(F.expr("concat(substring(kids, 1, 32 * i), substring(kids, 32 * i + 33), above)")))
    hexed = lambda c: F.lower(F.hex(c))
    own = F.element_at("folded", F.col("i") + 1)
    out = each.select(
        F.col("m.id").alias("doc_id"), hexed("m.leaf").alias("leaf"), hexed("subroot").alias("subroot"),
        hexed("root").alias("root"), proof.alias("proof"), hexed(own).alias("folded_root"), (own == F.col("root")).alias("verified"))
    out = out.withColumn("proof_sha256", F.sha2("proof", 256))
    return out if proofs else out.drop("proof")


ORACLE = """WITH RECURSIVE f AS (
  SELECT doc_id, source, coalesce(text, '') AS t, text IS NULL AS gone,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
h AS (SELECT doc_id, source, sha256(head || CASE WHEN gone THEN '-' ELSE strlen(t) || ':' || t END) AS leaf,
  sha256(head || CASE WHEN gone THEN '-' ELSE strlen(t) || ':' ||
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS low FROM f),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc FROM l),
lv AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM lv WHERE n > 1 GROUP BY tree, level, pos // 16),
sub AS (SELECT tree, level AS depth, digest FROM lv WHERE n = 1),
up AS (
  SELECT -1 AS tree, 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16
  FROM up WHERE n > 1 GROUP BY tree, level, pos // 16),
runs AS (SELECT tree, level, pos // 16 AS run, list(digest ORDER BY pos) AS kids
  FROM (SELECT * FROM lv WHERE n > 1 UNION ALL SELECT * FROM up WHERE n > 1) GROUP BY ALL),
climb AS (
  SELECT l.tree AS own, l.pos AS place, CASE WHEN depth = 0 THEN -1 ELSE l.tree END AS tree, 0 AS level,
    CASE WHEN depth = 0 THEN l.tree ELSE l.pos END AS pos, depth, '' AS proof,
    CASE WHEN crc % 5 = 0 THEN low ELSE leaf END AS folded
  FROM c l JOIN sub USING (tree)
  UNION ALL
  SELECT own, place, CASE WHEN c.level + 1 = depth THEN -1 ELSE c.tree END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = depth THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree >= 0 AND c.level + 1 = depth THEN c.tree ELSE c.pos // 16 END, depth,
    proof || array_to_string(kids[:c.pos % 16], '') || array_to_string(kids[c.pos % 16 + 2:], ''),
    sha256(array_to_string(kids[:c.pos % 16], '') || folded || array_to_string(kids[c.pos % 16 + 2:], ''))
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 16),
last AS (SELECT own, place, proof, folded FROM climb QUALIFY row_number() OVER (PARTITION BY own, place ORDER BY tree, level DESC) = 1)
SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM up WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = (SELECT digest FROM up WHERE n = 1) AS verified
FROM l JOIN sub USING (tree) JOIN last ON own = l.tree AND place = l.pos"""
