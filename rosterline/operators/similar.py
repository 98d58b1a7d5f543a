"""O3: look-alike top-k per seed by cosine similarity.

Seeds are capped at 5 by the provider contract, so they are checked, pulled
once (≤ 5 vectors) and inlined as literal arrays: every candidate vector is
scored against them inside one projection — linear in the data, no join —
and the top-k per seed uses a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

__all__ = ["lookalikes", "MAX_SEEDS"]

MAX_SEEDS = 5


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def lookalikes(vectors: DataFrame, seeds: DataFrame, k: int, id_col: str = "vec_id",
               vec_col: str = "embedding", offset: int = 0) -> DataFrame:
    """Top ``k`` (after ``offset``) most similar vectors per seed, seed itself excluded."""
    seed_rows = seeds.select(id_col, F.transform(vec_col, lambda x: x.cast("double")).alias("v")).take(MAX_SEEDS + 1)
    if len(seed_rows) > MAX_SEEDS:
        raise ValueError(f"at most {MAX_SEEDS} seeds are allowed")
    id_type = vectors.schema[id_col].dataType
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    scored = F.array(*[
        F.struct(F.lit(r[id_col]).cast(id_type).alias("seed_id"),
                 (_dot(v, F.array(*[F.lit(float(x)) for x in r["v"]])) /
                  (F.sqrt(_dot(v, v)) * F.lit(sum(float(x) * float(x) for x in r["v"]) ** 0.5))).alias("sim"))
        for r in seed_rows])
    pairs = (vectors.select(F.col(id_col), F.explode(scored).alias("_s"))
             .select(id_col, "_s.seed_id", "_s.sim").where(F.col(id_col) != F.col("seed_id")))
    w = Window.partitionBy("seed_id").orderBy(F.desc("sim"), F.col(id_col))
    return (pairs.withColumn("rank", F.row_number().over(w))
            .where((F.col("rank") > offset) & (F.col("rank") <= offset + k))
            .withColumn("similarity", F.round("sim", 4)).drop("sim"))
