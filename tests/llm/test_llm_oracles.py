"""Queries of the numbered operators against their SQL."""

import pytest
from compare import compare, connect

from ratelens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    result = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert result.startswith("ok"), result
