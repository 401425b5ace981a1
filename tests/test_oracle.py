from __future__ import annotations

import pytest

from checks import oracles, queries
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries.bound()[name](spark, SF_DIR)
    if name in oracles.SQL:
        assert compare(df, con, oracles.SQL[name]) == "ok"
    else:
        assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracles.SQL) <= set(NAMES)
