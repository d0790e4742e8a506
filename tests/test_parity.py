"""Every query with SQL gives the rows of that SQL on the same tables."""

import pytest

from tallyforge.plans.catalog import ORACLES, QUERIES
from tests.conftest import FOLDER
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, duck, key):
    assert compare(QUERIES[key](spark, FOLDER), duck, ORACLES[key]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
