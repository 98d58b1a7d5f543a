"""Small inputs shared by the tests: every edge case that the operators define a result for."""

import random

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "sig string, _text string, rank int, h bigint, length bigint, node bigint")


def words(n, seed, stock=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)) if not stock else " ".join(
        f"{r.choice('bcdfgl')}{r.choice('aeiou')}{r.randrange(stock)}" for _ in range(n))


def edge_rows():
    base = words(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    texts = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, words(30_000, 2)), (6, base), (6, base), (7, base.upper()),
             (8, " ".join(near)), (9, words(50, 9)), (None, "no id here"), (10, "Ünïcode ß \U0001F600  text — здесь"),
             (11, "x" * 5000), (12, "mail a.b@mail.example.com or 10.0.0.1, 4111 1111 1111 1111 call +1 (743) 555-3824")]
    return [(i, t, None if i == 9 else "en", "s", len(t or ""), "clash", "clash", 1, 2, 3, 4) for i, t in texts]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
