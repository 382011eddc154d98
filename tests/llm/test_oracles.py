"""The operators' queries against their SQL in DuckDB."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import connect, same_rows

from cellframe.llm import catalogue

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert same_rows(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLE_SQL[name]) is None
