"""Values placed among those of few large groups."""

from tidewright.operators.nulls import placed


def test_by_rank_as_by_array(spark):
    nan = float("nan")
    values = [0.0, -0.5, 1.0, 1.0, -1.0, 2.5, nan, None]
    seen = spark.createDataFrame([(g, k, v) for g in (1, 2) for k, v in enumerate(values)], "q int, k int, z double")
    null = spark.createDataFrame([(1, v) for v in (-2.0, -1.0, -1.0, 0.0, 0.5, 1.0, nan, None)], "q int, z double")
    rows = lambda few: sorted(map(str, placed(seen, null, "z", "q", few=few).select("q", "k", "p_two", "p_greater", "p_less").collect()))
    assert rows(True) == rows(False) and len(rows(True)) == len(values)


def test_no_group_as_an_array(spark):
    from tidewright.plans.registry import QUERIES

    plan = QUERIES["empirical_p"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
