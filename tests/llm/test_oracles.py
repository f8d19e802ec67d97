"""Queries that SQL can say the same of."""

import pytest

from lexiquarry.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, same, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def test_all():
    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted(f"op{k}" for k in range(1, 14))
