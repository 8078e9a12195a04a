"""A sweep of terms walks each series where it lies, many short series in a call, and once."""

from tidewright.operators import strategy as T
from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_the_sweep_is_run_once(spark):
    plan = QUERIES["strategy_sweep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "InPandas" not in plan and "MapInArrow" not in plan


def test_points_of_many_series(spark):
    rows = [(s, i, i * 60_000, 100.0 + i, 100.5 + i, float((i + s) % 3 - 1), i % 2 == 0, i % 7 == 0) for s in range(30) for i in range(20 + s)]
    d = spark.createDataFrame(rows, "symbol int, idx long, ts long, open double, close double, signal double, lim boolean, trading_disabled boolean")
    points = [("a", T.Terms()), ("b", T.Terms(slippage=5e-4, fill_chance=0.5, maker_fee=0.0))]
    out = T.run_all(d, "signal", "lim", points)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()  # bars aren't copied to the points
    got = {(r["symbol"], r["point"]): r for r in out.collect()}
    assert len(got) == 60
    for s in (0, 7, 29):
        own = [r for r in rows if r[0] == s]
        for name, terms in points:
            trades, equity = T.run_account(*([r[k] for r in own] for k in (2, 3, 4, 5, 7)), limit=[r[6] for r in own], **terms.settings())
            r = got[s, name]
            assert r["equity"] == equity and r["ts"] == [x[2] for x in own]
            assert [tuple(x) for x in r["trades"]] == [(k, *t) for k, t in enumerate(trades)]
