"""Spark-vs-DuckDB comparison in the spirit of the driver's correctness gate:
same column names, same row count, same multiset of (normalized) rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)) and getattr(v, "shape", None) == ():
        return _norm(v.item())
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and hasattr(v, "shape")):
        seq = v.tolist() if hasattr(v, "tolist") else v
        if seq and all(isinstance(x, tuple) and len(x) == 2 for x in seq):
            return tuple(sorted((str(k), _norm(x)) for k, x in seq))
        return tuple(_norm(x) for x in seq)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, sorted(rows, key=repr)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows, key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def type_diffs(df, con, sql):
    """Columns whose Spark type does not map to the oracle's DuckDB type."""
    rel = con.sql(sql)
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        want = t.upper() if t.startswith("decimal") else SPARK_TO_DUCK.get(t, t.upper())
        if duck.get(f.name) != want:
            out.append((f.name, t, duck.get(f.name)))
    return out


def compare(df, con, sql):
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    td = type_diffs(df, con, sql)
    if td:
        return False, f"types differ: {td}"
    if len(sr) != len(dr):
        return False, f"row count spark={len(sr)} duck={len(dr)}"
    if sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        return False, f"values differ ({sum(1 for a, b in zip(sr, dr) if a != b)} rows), e.g. {diff}"
    return True, f"{len(sr)} rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from __spark_entry__ import oracle_sql, queries
    from rosterline.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = get_spark("local[8]", 8)
    con = duck_conn(sf)
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in orc:
                ok, msg = compare(df, con, orc[name])
            else:
                ok, msg = True, f"rows-only {df.count()}"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print(f"{len([n for n in qs if not only or n in only]) - bad} ok, {bad} bad")
