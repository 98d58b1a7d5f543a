"""Nearest neighbours of unusual tables, by brute force over rows."""

import collections

import numpy as np
from pyspark.sql import functions as F

from rosterline.llm import ann


def brute(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = collections.Counter()
    for n, (i, v) in enumerate(good):
        if i % 50:
            continue
        near = sorted((-float(np.dot(w, v) / np.sqrt(np.dot(w, w)) / np.sqrt(np.dot(v, v))), j)
                      for m, (j, w) in enumerate(good) if m != n and len(w) == len(v))[:k]
        out.update((i, r, j, round(-s, 9)) for r, (s, j) in enumerate(near, 1))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id bigint, embedding array<double>, uid string, _part int")
    got = ann.nearest(df.repartition(3), F.pmod("vec_id", F.lit(50)) == 0, **kw).collect()
    return collections.Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got)


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1]), (0, [0.9, 0.2]), (0, [1.0, 0.0]), (7, [0.0, 1.0]), (50, [0.2, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_other_dimensions(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=3).tolist()) for i in range(60)] + [(100 + i, r.normal(size=4).tolist()) for i in range(7)]
    rows += [(200, [1.0]), (300, None), (350, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (None, [1.0, 2.0, 3.0]), (450, [float("nan"), 1.0, 1.0])]
    got = found(spark, rows)
    assert got == brute(rows) and {100, 0, 50} <= {q for q, *_ in got}
    one_longer = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0, 1.0])]
    assert sum(found(spark, one_longer).values()) == 2


def test_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)]
    assert found(spark, rows, block=64) == brute(rows)
