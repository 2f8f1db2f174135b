"""Every registered query of the engine against its SQL."""

import pytest
from compare import connect, differences

from rasterloom.plans import library

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_rows_equal_sql(spark, con, name):
    assert differences(library.QUERIES[name](spark, FOLDER), con, library.SQL[name]) == ""


def test_every_query_has_sql():
    assert set(library.QUERIES) == set(library.SQL)
