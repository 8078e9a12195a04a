"""The cascade's power is measured on the lines, all of them."""

import pytest

from tidewright.plans.registry import QUERIES


def test_reads_lines(spark, tmp_path):
    with pytest.raises(Exception, match="lineitem"):
        QUERIES["injection_power"](spark, str(tmp_path)).collect()
    got = {r["phi"]: r for r in QUERIES["injection_power"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == [0.0, 0.3, 0.6] and {r["n"] for r in got.values()} == {200}
    assert got[0.0]["p_det"] < 0.1 and got[0.6]["p_det"] == 1.0
    assert all(r["lo"] <= r["p_det"] <= r["hi"] for r in got.values())
