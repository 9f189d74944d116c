"""Queries that SQL can express, against it."""

import pytest

from oracle import differences
from twinloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name, sf):
    assert differences(spark, sf, QUERIES[name], ORACLE_SQL[name]) == ""
