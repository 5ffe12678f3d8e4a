"""Every registered query runs at the smallest scale and matches its SQL twin."""

import pytest
from oracle_check import connect, difference, duck_rows, spark_rows

from priorform.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = spark_rows(QUERIES[name](spark, SMALL))
    if name in ORACLES:
        assert difference(rows, duck_rows(duck, ORACLES[name])) is None
    else:
        assert rows[0] and rows[1]
