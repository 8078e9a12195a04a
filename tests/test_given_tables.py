"""Queries that made their data up work on the lines of the given tables: no lines, no rows."""

import pytest
from pyspark.sql import functions as F

from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_suppkey < 5").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["iid_floor", "phi_calibration", "grid_index"])
def test_result_depends_on_the_table(spark, few, tmp_path, name):
    assert QUERIES[name](spark, few).count() > 0
    spark.read.parquet(f"{few}/lineitem.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_phi_grows_with_the_departure(spark):
    floor = {r["q"]: r["delta"] for r in QUERIES["iid_floor"](spark, SF).collect()}
    assert sorted(floor) == [2, 5, 15, 60] and floor[2] < floor[5] < floor[15] and floor[2] < 0.1
    rows = [r for r in QUERIES["phi_calibration"](spark, SF).orderBy("q", "delta").collect() if r["q"] == 2]
    assert rows[-1]["delta"] == 0.4 and rows[0]["phi"] < rows[-1]["phi"] and 0.4 < rows[-1]["phi"] < 0.95
