"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from compare import compare, connect

from ratelens.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
ORACLES = all_oracles()
# Run by test_sampling on its own fixtures, with fewer rows.
SLOW = {"w14_sample_plan"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - SLOW))
def test_query(spark, duck, name):
    run = all_queries()[name]
    if name in ORACLES:
        result = compare(spark, duck, run, ORACLES[name], SF)
        assert result.startswith("ok"), result
    else:
        assert run(spark, SF).count() > 0


def test_names_are_plain():
    assert all(n[0] in "sxawqjrt" and n[1:3].isdigit() for n in all_queries())
    assert set(ORACLES) <= set(all_queries())
