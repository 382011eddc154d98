import os

import pytest
from oracle import connect, same_rows

from cellframe.plans import queries as Q

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    if name in Q.ORACLE:
        assert same_rows(df, con, Q.ORACLE[name]) is None
    else:
        assert df.columns
