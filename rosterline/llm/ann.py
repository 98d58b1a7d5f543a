"""Operator 5: nearest neighbours over learned partitions.

A bounded sample (``sample`` rows, a documented parameter) gives a k-nearest-
neighbour graph.  Balanced label propagation with a capacity per part partitions
that graph, and a small softmax classifier learns vector -> part.  Every row is
indexed under its most probable part; a query is routed to its several most
probable parts and reranked there by exact cosine in double precision.  How many
parts is calibrated: a bounded set of queries is searched exactly among all rows,
and the least number that holds the wanted share of their neighbours is taken.

Scale: classifier weights (dim x parts) are the only thing shipped to workers.
A part may hold a third of all rows (copies of one vector), so rows of a part
are dealt to blocks of at most about ``block`` rows and a query meets each block
of its parts; each block keeps its own best ``k``, which are merged per query.
Queries of a part are dealt to blocks likewise.  Pairs of query and row stay inside numpy.

Defined cases: a vector that is null, zero or holds a null or non-finite
component takes no part, nor does a row with a null id; vectors of different
lengths have no cosine, so the rows of each length are searched by themselves (more
than ``DIMENSIONS`` lengths raise); ties go to the smaller id; every row is a
candidate but the query's own, so repeated rows, and other rows with the query's
id, are found like others, and each query row has its own result; fewer candidates
give fewer rows; an empty table gives none; other columns are ignored.
If a query's probed parts hold fewer than ``k`` candidates it is routed to all parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_arrow, materialize

__all__ = ["nearest", "fit_router"]

DIMENSIONS = 64


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def knn_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Neighbour indices (n, k) by cosine, computed in blocks."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), block):
        s = x[i:i + block] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i:i + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 15, slack: float = 1.25) -> np.ndarray:
    """Labels 0..parts-1: label propagation on the graph under a capacity per part.

    Starts from regions grown around spread seeds; each round moves a node to the
    label most common among its neighbours if that part has room.
    """
    n = len(graph)
    cap = int(np.ceil(slack * n / parts))
    rng = np.random.default_rng(7)
    seeds = [int(rng.integers(n))]
    near = x @ x[seeds[0]]
    for _ in range(parts - 1):  # farthest-first seeds
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    want = np.argsort(-(x @ x[seeds].T), axis=1)
    label, size = np.full(n, -1), np.zeros(parts, int)
    for i in rng.permutation(n):
        for p in want[i]:
            if size[p] < cap:
                label[i], size[p] = p, size[p] + 1
                break
    for _ in range(rounds):
        moved = 0
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        for i in np.flatnonzero(gain > 0)[np.argsort(-gain[gain > 0], kind="stable")]:
            if size[best[i]] < cap:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 200:
            break
    return label


def fit_softmax(x: np.ndarray, y: np.ndarray, parts: int, epochs: int = 40, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            z = 8 * x[at] @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            dw, db = 8 * x[at].T @ p / len(at), p.mean(0)
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    return 8 * w, b


def fit_router(sample: np.ndarray, rows: int, per_part: int, neighbours: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classifier over balanced parts of the sample's neighbour graph."""
    x = unit(np.unique(sample, axis=0))
    parts = int(min(max(1, rows // per_part), max(1, len(x) // 20)))    # 20 sampled rows a part, at least
    if parts == 1:
        return np.zeros((x.shape[1], 1)), np.zeros(1)
    label = balanced_parts(knn_graph(x, min(neighbours, len(x) - 1)), x, parts)
    return fit_softmax(x, label, parts)


def usable(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """Rows that take part, as (vec_id, _v array<double>)."""
    v = F.col(vec).cast("array<double>")
    ok = (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
          & F.exists(v, lambda x: x != 0) & F.col(vec_id).isNotNull())
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("_v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def _best(q_uids, q, c_uids, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidate rows of each query: (query row, candidate row, score), exact and with ties by id."""
    qn, cn = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(np.einsum("ij,ij->i", c, c))
    rows, found, scores = [], [], []
    for i in range(0, len(q), 512):
        s = (q[i:i + 512] @ c.T) / qn[i:i + 512, None] / cn
        s[q_uids[i:i + 512, None] == c_uids] = -np.inf
        kk = min(k, len(c_ids))
        floor = np.partition(s, len(c_ids) - kk, axis=1)[:, len(c_ids) - kk]
        for j in range(len(s)):
            near = np.flatnonzero((s[j] >= floor[j] - 1e-9) & (s[j] > -np.inf))
            exact = np.einsum("ij,j->i", c[near], q[i + j]) / (qn[i + j] * cn[near])
            top = np.lexsort((c_ids[near], -exact))[:k]
            rows.append(np.full(len(top), i + j))
            found.append(near[top])
            scores.append(exact[top])
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return cat(rows, np.int64), cat(found, np.int64), cat(scores, np.float64)


def probes_for(index: DataFrame, queries: DataFrame, w: np.ndarray, bias: np.ndarray, dim: int, k: int, recall: float) -> int:
    """Least number of parts that holds the given share of the true neighbours of some queries.

    The queries are few (a bounded sample); their true neighbours are found among all rows, each batch
    of rows giving its own best ``k``.
    """
    got = queries.select("uid", "_v").toArrow()
    q_uids, q = np.asarray(got.column("uid"), np.int64), _matrix(got.column("_v"), dim)

    def best(b: pa.RecordBatch):
        uids, ids = np.asarray(b.column("uid"), np.int64), np.asarray(b.column("vec_id"), np.int64)
        r, at, s = _best(q_uids, q, uids, ids, _matrix(b.column("_v"), dim), k)
        yield {"q": r, "score": s, "vec_id": ids[at], "uid": uids[at], "part": np.asarray(b.column("_part"))[at]}

    found = map_arrow(index, ["uid", "vec_id", "_v", "_part"], best, "q int, score double, vec_id bigint, uid bigint, part int")
    top = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id", "uid", "part")), False), 1, k).alias("t"))
    rank = np.argsort(np.argsort(-(unit(q) @ w + bias), axis=1, kind="stable"), axis=1)
    needed = np.sort([rank[r["q"], x["part"]] for r in top.collect() for x in r["t"]])
    if not len(needed):
        return len(bias)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def nearest(vectors: DataFrame, queries, k: int = 5, sample: int = 8000, per_part: int = 1000, recall: float = 0.95,
            calibrate: int = 400, block: int = 8192, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row for which the column ``queries`` (over ``vec_id``) is true.

    Returns query_id, rank, vec_id, score.  ``sample`` rows fit the router; ``calibrate`` queries, searched
    exactly among all rows, set the number of parts to probe for ``recall``.
    """
    rows = usable(vectors, vec_id, vec)
    sizes = [(r[0], r[1]) for r in rows.groupBy(F.size("_v").alias("dim")).count().orderBy("dim").limit(DIMENSIONS + 1).collect()]
    if len(sizes) > DIMENSIONS:
        raise ValueError(f"vectors of more than {DIMENSIONS} different lengths")
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim, total in sizes:
        out = out.unionByName(_search(rows.where(F.size("_v") == dim), queries, dim, total, k, sample, per_part, recall, calibrate, block))
    return out


def _search(rows: DataFrame, queries, dim: int, total: int, k: int, sample: int, per_part: int, recall: float,
            calibrate: int, block: int) -> DataFrame:
    """``nearest`` among rows of ``dim`` components."""

    def some(df: DataFrame, n: int, seed: int, of: int) -> DataFrame:
        """About ``n`` rows, at most, by a hash of the id: a recomputed task picks the same ones."""
        share = int((1 << 30) * min(1.0, 1.1 * n / max(1, of))) + 1
        return df.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share).limit(n)

    picked = some(rows, sample, 1, total).select("_v").toArrow()
    if picked.num_rows == 0:
        picked = rows.limit(sample).select("_v").toArrow()
    w, bias = fit_router(_matrix(picked.column(0), dim), total, per_part)
    parts = len(bias)

    def route(n_best: int):
        def run(b: pa.RecordBatch):
            x = unit(_matrix(b.column("_v"), dim))
            z = x @ w + bias
            best = np.argsort(-z, axis=1, kind="stable")[:, :n_best].astype(np.int32)
            yield {"uid": b.column("uid"), "vec_id": b.column("vec_id"), "_v": b.column("_v"), "_parts": best.tolist()}
        return run

    def by_part(counts: dict[int, int]):
        return F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, int(n))]).cast("map<int,bigint>")

    def per_part_of(df: DataFrame) -> dict[int, int]:
        return {r[0]: r[1] for r in df.groupBy("_part").count().collect()}  # a row a part

    routed, cols = "uid bigint, vec_id bigint, _v array<double>, _parts array<int>", ["uid", "vec_id", "_v"]
    # A row's number holds from here on: it is written along with the row.
    index = map_arrow(rows.withColumn("uid", F.monotonically_increasing_id()), cols, route(1), routed)
    index = materialize(index.select(*cols, F.element_at("_parts", 1).alias("_part")), "ann-index")
    asked = index.where(queries)
    probes = parts if parts == 1 else min(parts, probes_for(index, some(asked, calibrate, 2, asked.count()), w, bias, dim, k, recall))
    sizes = per_part_of(index)
    q = map_arrow(asked, cols, route(parts), routed)
    # A query whose probed parts can't hold k others goes on to all parts.
    room = F.aggregate(F.slice("_parts", 1, probes), F.lit(0).cast("bigint"),
                       lambda a, p: a + F.coalesce(by_part(sizes)[p], F.lit(0)))
    q = q.withColumn("_parts", F.when(room > k, F.slice("_parts", 1, probes)).otherwise(F.col("_parts")))
    q = q.select(*cols, F.explode("_parts").alias("_part")).where(F.col("_part").isin(list(sizes)))
    q = materialize(q, "ann-queries")
    # Rows and queries of a part are dealt to blocks; each row block meets each query block once.
    row_blocks = by_part({p: -(-n // block) for p, n in sizes.items()})
    query_blocks = by_part({p: -(-n // block) for p, n in per_part_of(q).items()} or {0: 1})

    def dealt(df: DataFrame, own: str, blocks, other: str, others) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("uid", F.lit(3)), blocks[F.col("_part")]).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), (others[F.col("_part")] - 1).cast("int")))))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in ("query", "query_id", "uid", "vec_id", "score")})
        uids, ids = right["uid"].to_numpy(), right["vec_id"].to_numpy()
        r, at, s = _best(left["uid"].to_numpy(), np.stack(left["_v"].to_numpy()), uids, ids, np.stack(right["_v"].to_numpy()), k)
        return pd.DataFrame({"query": left["uid"].to_numpy()[r], "query_id": left["vec_id"].to_numpy()[r], "uid": uids[at],
                             "vec_id": ids[at], "score": s})

    keys = ["_part", "_rows", "_asked"]
    found = (dealt(q, "_asked", query_blocks, "_rows", row_blocks).groupBy(*keys)
             .cogroup(dealt(index.where(query_blocks[F.col("_part")].isNotNull()), "_rows", row_blocks, "_asked", query_blocks)
                      .groupBy(*keys)).applyInPandas(meet, "query bigint, query_id bigint, uid bigint, vec_id bigint, score double"))
    # Each block sends at most k rows a query; the best k are kept.
    top = found.groupBy("query", "query_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("d"), "vec_id", "uid"))).alias("t"))
    return (top.select("query_id", F.posexplode(F.slice("t", 1, k)).alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.d")).alias("score")))
