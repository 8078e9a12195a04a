"""Pairs of all instruments: labels are computed once, and no task makes all pairs."""

from tidewright.operators import joins
from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_labels_are_computed_once_and_pairs_are_spread(spark):
    d = QUERIES["valid_pairs"](spark, SF)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "lineitem" not in plan and "CartesianProduct" not in plan  # of the keys alone
    assert d.rdd.getNumPartitions() >= 4


def test_spread_pairs_are_the_same(spark):
    d = spark.createDataFrame([(k, k * 2.0) for k in range(50)], "k long, v double")
    get = lambda spread: sorted(map(tuple, joins.ordered_pairs(d, "k", ["v"], spread=spread).collect()))
    assert get(True) == get(False) and len(get(True)) == 50 * 49 // 2
