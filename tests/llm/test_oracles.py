"""The subpackage's queries against their SQL, and all of them on small tables."""

from __future__ import annotations

import pytest
from _compare import comparable

from lodestrata.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, data, oracle, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, data).collect()]
    assert got
    assert comparable(got) == comparable(oracle(registry.ORACLES[name]))


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
