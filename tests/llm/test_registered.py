"""Every registered query of the subpackage on the smallest tables, against its SQL where there is any."""

import pytest

from rosterline.llm.queries import QUERIES, SQL
from tests.oracle_harness import compare, duck_conn

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        ok, message = compare(df, duck_conn(SF), SQL[name])
        assert ok, message
    else:
        assert df.count() > 0


def test_numbered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
