"""Work on many short groups goes by batches of groups, not by a call for each."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from tidewright.operators import greedy, order_statistics as O, windows as W


def bars(spark, series=80, n=45):
    rng = np.random.default_rng(5)
    x = rng.normal(size=series * n)
    x[rng.random(len(x)) < 0.2] = np.nan
    d = pd.DataFrame({"symbol": np.repeat(np.arange(series), n), "idx": np.tile(np.arange(n), series), "x": x, "v": rng.integers(1, 9, series * n).astype(float)})
    return spark.createDataFrame(d).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))), d


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("make", [
    lambda b: W.ema(b, "x", 9),
    lambda b: W.rolling_quantile(b, "x", 12, {"q": 0.75}, min_rows=1),
    lambda b: O.expanding_quantile(b, "x", 5, {"q": 0.75}),
    lambda b: greedy.greedy_events(b, 20.0, "v"),
    lambda b: W.rolling_moments(b, 12, "v", ("v", "x"), ("z", "beta")),
])
def test_no_call_for_each_group(spark, make):
    assert "FlatMapGroupsInPandas" not in plan(make(bars(spark)[0]))


def test_results(spark):
    b, d = bars(spark)
    g = d.groupby("symbol")["x"]
    order = lambda f: f.toPandas().sort_values(["symbol", "idx"])
    want = g.transform(lambda s: s.rolling(12, min_periods=1).quantile(0.75))
    assert np.allclose(order(W.rolling_quantile(b, "x", 12, {"q": 0.75}, min_rows=1))["q"], want, equal_nan=True)
    want = g.transform(lambda s: s.expanding(5).quantile(0.75))
    for size in (10, 100):  # cut, and in one piece
        assert np.allclose(order(O.expanding_quantile(b, "x", 5, {"q": 0.75}, size))["q"].astype(float), want, equal_nan=True)
    want = g.transform(lambda s: s.dropna().ewm(span=9, adjust=False).mean().reindex(s.index).ffill())
    for chunk in (10, 100):
        assert np.allclose(order(W.ema(b, "x", 9, chunk))["ema"].astype(float), want, equal_nan=True)
    want = d.groupby("symbol")["v"].transform(lambda s: (s - s.rolling(12).mean()) / s.rolling(12).std(ddof=0))
    for size in (20, 100):
        assert np.allclose(order(W.rolling_moments(b, 12, "v", ("v", "v"), ("z", "beta"), size))["z"].astype(float), want, equal_nan=True)
