"""Every registered query against its DuckDB SQL on the smallest data set
(the driver repeats this at sf0.01)."""

import pytest

from citeline.oracle_check import compare, duck
from citeline.plans.catalog import ORACLE, QUERIES
from paths import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "ok", r
