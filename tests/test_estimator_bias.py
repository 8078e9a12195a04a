"""The estimator's bias is measured on the lines, all of them."""

import pytest

from tidewright.plans.registry import QUERIES


def test_reads_lines(spark, tmp_path):
    with pytest.raises(Exception, match="lineitem"):
        QUERIES["estimator_bias"](spark, str(tmp_path)).collect()
    d = QUERIES["estimator_bias"](spark, "/root/testdata/sf0.01")
    got = {(r["n"], r["truth"]): r for r in d.collect()}
    assert sorted(got) == [(n, t) for n in (500, 2000) for t in (0.0, 0.05, 0.2)]
    assert all(abs(r["bias"]) < 0.03 and 0 < r["se"] < 0.06 for r in got.values())
