"""Every query that SQL can express, against that SQL."""

import pytest

from siltstone.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_rows(name, spark):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
