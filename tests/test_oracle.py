"""Every core query against its SQL."""

import pytest

from scripts.compare import compare
from tracewright import oracle, queries


def test_each_query_has_sql():
    assert set(queries.QUERIES) == set(oracle.ORACLE)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert ": same" in compare(spark, sf, name)
