"""Every registered query of the library against its SQL, or for its rows, on the smallest tables."""

import pytest

from lodestone.plans import catalog
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog()
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        found = differences(df, con, SQL[name])
        assert found is None, found
    assert name in EMPTY or not df.isEmpty(), "no rows: equal results prove nothing"
