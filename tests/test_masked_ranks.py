"""Ranks within overlapping masks come from one order of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import measures, order_statistics
from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def table(n):
    rng = np.random.default_rng(n)
    return pd.DataFrame({"x": np.round(rng.normal(size=n), 1), "y": rng.normal(size=n), "a": rng.random(n) < 0.5, "b": rng.random(n) < 0.3})


@pytest.mark.parametrize("size", [40, 10_000])
def test_masked_ranks_equal_those_of_each_mask(spark, size):
    d = table(900)
    d["m"], d["k"] = d["a"].astype(int), d["b"].astype(int)
    got = order_statistics.masked_ranks(spark.createDataFrame(d[["x", "y", "m", "k"]]), "x", {"m": "rm", "k": "rk"}, size).toPandas().sort_values("y", ignore_index=True)
    d = d.sort_values("y", ignore_index=True)
    for m, r in (("m", "rm"), ("k", "rk")):
        on = d[m] == 1
        assert np.allclose(got.loc[on, r], d.loc[on, "x"].rank())


def test_rank_correlation_by_mask(spark):
    d = table(500)
    d.loc[3, "x"] = np.nan
    masks = {"all": F.lit(True), "a": F.col("a"), "both": F.col("a") & F.col("b"), "none": F.col("x") > 99, "few": F.col("y") > d["y"].nlargest(5).min()}
    got = {r["name"]: r for r in measures.spearman_by_mask(spark.createDataFrame(d), "x", "y", masks).collect()}
    good = d[d["x"].notna()]
    for name, part in {"all": good, "a": good[good["a"]], "both": good[good["a"] & good["b"]]}.items():
        assert got[name]["n"] == len(part) and got[name]["ic"] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)
    assert "none" not in got and got["few"]["ic"] is None


def test_values_of_one_rank_have_no_correlation(spark):
    d = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "x double, y double")
    r = measures.spearman_by_mask(d, "x", "y", {"all": F.lit(True)}).first()
    assert r["n"] == 20 and np.isnan(r["ic"])  # as SQL says


def test_edges_below(spark):
    rows = [([], 1.0), (None, 1.0), ([1.0], 1.0), ([1.0], 1.5), *[([float(k) for k in range(13)], v) for v in (-1.0, 0.0, 0.5, 6.0, 6.5, 12.0, 13.0)]]
    d = spark.createDataFrame(rows, "e array<double>, v double").select("e", "v", order_statistics.edges_below("e", "v").alias("k"))
    assert all(r["k"] == sum(e < r["v"] for e in r["e"] or []) for r in d.collect())


def test_a_row_is_written_once_whatever_the_masks(spark, monkeypatch):
    real, rows = measures.materialize, []

    def noted(df, name):
        out = real(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(measures, "materialize", noted)
    QUERIES["ic_by_mask"](spark, SF)
    assert sum(rows) <= spark.read.parquet(f"{SF}/lineitem.parquet").count()
