"""Every registered query against its DuckDB oracle on sf0.001 (the driver's
check runs the same comparison at sf0.01)."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_harness import compare, duck_conn

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()
# The numbered corpus queries, where there are any, have tests of their own.
NAMES = sorted(n for n in queries() if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF)


def test_entry(spark):
    df = entry(spark)
    assert df.count() >= 0 and "export_pos" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg


# Queries whose rows come in an order that is part of the result.
ORDERED = {"o1_export": "list_id, export_pos", "a1_list_summary": "created_at DESC, list_id", "u1_not_found": "list_id, id"}


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_order_of_rows(spark, con, name):
    keys = [k.split()[0] for k in ORDERED[name].split(", ")]
    got = [tuple(r[k] for k in keys) for r in queries()[name](spark, SF).collect()]
    assert got == con.execute(f"SELECT {', '.join(keys)} FROM ({ORACLES[name]}) ORDER BY {ORDERED[name]}").fetchall()
