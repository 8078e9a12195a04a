"""Medians of a few large groups are found without gathering a group's values."""

import pytest

from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["conditional_returns", "information_bound", "vr_profile"])
def test_no_group_is_gathered(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx(" in plan and "percentile(" not in plan


def test_paths_are_drawn_once(spark):
    plan = QUERIES["null_programme"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan  # they are read back
