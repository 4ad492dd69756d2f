"""Corpus queries that SQL can express, and the shape of the others."""

import pytest

from siltstone.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.SQL[name])


def test_all_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 11))
