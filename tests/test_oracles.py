"""Every registered query of the library against its SQL twin; those without one must give rows."""

from __future__ import annotations

import pytest
from compare import database, difference

from bidsieve import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    result = QUERIES[name](spark, small)
    if name in ORACLES:
        assert difference(result, db, ORACLES[name]) == ""
    else:
        assert result.columns
        result.collect()
