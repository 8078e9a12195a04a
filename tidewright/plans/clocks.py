"""Queries over clocks: intrinsic bars, thresholds, and whether variance ratios are alike on all clocks and horizons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import two_sided_p_sql
from ..operators import joins, order_statistics as O, rebar, regress, variance_ratio as VR
from ..sources.bars import panel
from ..sources.shared import materialize
from .common import query, rounded
from .features import RECURSIVE

MARGIN = 0.02  # a fixed value
VOLUME, VARIANCE = 60, 1000.0
PARTS = RECURSIVE + ", ip AS MATERIALIZED (SELECT symbol, idx, ts, close, volume, sum(r * r) OVER (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING) AS rv_part FROM r)"


def greedy_sql(name: str, amount: str, threshold: float) -> str:
    """CTEs of the bars of ip that close when amount reaches the threshold."""
    t, grown = threshold * (1 - 1e-12), "CASE WHEN o.closed THEN n.v ELSE o.amount + n.v END"
    return f"""{name}_k AS MATERIALIZED (SELECT symbol, ts, close, {amount} AS v, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS k FROM ip WHERE {amount} > 0),
{name}_r AS (SELECT symbol, k, ts, close, v AS amount, 0::BIGINT AS bar, v >= {t!r} AS closed FROM {name}_k WHERE k = 1
 UNION ALL SELECT n.symbol, n.k, n.ts, n.close, {grown}, o.bar + o.closed::INT, {grown} >= {t!r} FROM {name}_r o JOIN {name}_k n ON n.symbol = o.symbol AND n.k = o.k + 1),
{name} AS (SELECT symbol, bar AS idx, ts, close, amount FROM {name}_r WHERE closed)"""


@query(f"{PARTS}, {greedy_sql('ib', 'rv_part', 20.0)}, o AS (SELECT symbol, amount > 20 AS over, (amount - 20) / 20 * 100 AS pct FROM ib) SELECT symbol, count(*) AS n, round(median(pct) FILTER (over), 5) AS median_pct, round(max(pct) FILTER (over), 5) AS max_pct, round(avg(over::INT), 6) AS share FROM o GROUP BY symbol")
def intrinsic_bars(spark, sf):
    d = rebar.overshoot(rebar.intrinsic_bars(panel(spark, sf), 20.0), 20.0)
    return rounded(rounded(d, "median_pct", "max_pct", digits=5), "share")


_T = (250.0, 500.0, 1000.0)


@query(f"{PARTS}, " + ", ".join(greedy_sql(f"vb{k}", "volume", t) for k, t in enumerate(_T)) + ", u AS (" + " UNION ALL ".join(f"SELECT {t!r}::DOUBLE AS threshold, symbol, idx, ts FROM vb{k}" for k, t in enumerate(_T)) + "), d AS (SELECT *, (lead(ts) OVER (PARTITION BY threshold, symbol ORDER BY ts) - ts) / 60000 AS m FROM u) SELECT symbol, threshold, count(*) AS n, round(median(m), 6) AS median_min FROM d GROUP BY ALL")
def threshold_sweep(spark, sf):
    """How many volume bars each threshold makes of a symbol, and how long they last."""
    return rounded(rebar.threshold_sweep(panel(spark, sf), list(_T)), "median_min")


def _medians_sql(by: str) -> str:
    at = lambda k: f"x[greatest(1, least(n, {k}))::BIGINT]"
    return f"md AS (SELECT {by}, n, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 AS m, {at('floor(n / 2 - 1.959963984540054 * sqrt(n) / 2)')} AS lo, {at('ceil(1 + n / 2 + 1.959963984540054 * sqrt(n) / 2)')} AS hi FROM (SELECT {by}, count(*) AS n, list(abs(vr_dev) ORDER BY abs(vr_dev)) AS x FROM vr GROUP BY ALL))"


def _equivalent_sql(family: str) -> str:
    """From pr (diff, se and keys): z_tost, p, p_holm, equivalent."""
    tail = two_sided_p_sql("coalesce(z_tost, 0)")
    return f"""zt AS (SELECT *, CASE WHEN se > 0 THEN ({MARGIN} - abs(diff)) / se END AS z_tost FROM pr), pp AS (SELECT *, CASE WHEN coalesce(z_tost, 0) > 0 THEN ({tail}) / 2 ELSE 1 - ({tail}) / 2 END AS p FROM zt),
hk AS (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY p) AS k, count(*) OVER (PARTITION BY {family}) AS nt FROM pp), hm AS (SELECT *, least(1, max(p * (nt - k + 1)) OVER (PARTITION BY {family} ORDER BY k)) AS p_holm FROM hk)"""


_SE = "sqrt(((a.hi - a.lo) / (2 * 1.959963984540054)) ** 2 + ((b.hi - b.lo) / (2 * 1.959963984540054)) ** 2)"
_OUT = f"round(diff, 6) AS diff, round(se, 6) AS se, round(p, 6) AS p, round(p_holm, 6) AS p_holm, abs(diff) + 1.6448536269514722 * se < {MARGIN} AND p_holm < 0.05 AS equivalent FROM hm"
GAUGES = f"{PARTS}, {greedy_sql('vo', 'volume', VOLUME)}, {greedy_sql('it', 'rv_part', VARIANCE)}, gs AS (SELECT 'clock:' || symbol AS symbol, idx, ts, close FROM ip UNION ALL SELECT 'volume:' || symbol, idx, ts, close FROM vo UNION ALL SELECT 'intrinsic:' || symbol, idx, ts, close FROM it), {VR.vr_sql(60, (2, 5), 'gs').replace('vr AS (', 'vg AS (')}, vr AS (SELECT split_part(symbol, ':', 1) AS gauge, q, vr_dev FROM vg)"


@query(f"{GAUGES}, {_medians_sql('gauge, q')}, pr AS (SELECT a.q::BIGINT AS q, a.gauge AS gauge_1, b.gauge AS gauge_2, a.m - b.m AS diff, {_SE} AS se FROM md a JOIN md b ON a.q = b.q AND a.gauge < b.gauge), {_equivalent_sql('1')} SELECT q, gauge_1, gauge_2, {_OUT}")
def transport(spark, sf):
    """Equivalence of median |VR - 1| between clocks, with Holm over all comparisons."""
    b = panel(spark, sf)
    clocks = {"clock": b, "volume": rebar.gauge("volume", b, volume=VOLUME), "intrinsic": rebar.gauge("intrinsic", b, variance=VARIANCE)}
    v = reduce(DataFrame.unionByName, (VR.strided(x, 60, (2, 5)).filter("vr_dev IS NOT NULL").select(F.lit(n).alias("gauge"), F.col("q").cast("long").alias("q"), F.abs("vr_dev").alias("a")) for n, x in clocks.items()))
    m = O.median_interval(materialize(v, "departures"), "a", "gauge", "q").withColumnRenamed("median", "m")
    x, y = (m.select("q", *[F.col(c).alias(f"{c}_{k}") for c in ("gauge", "m", "lo", "hi")]) for k in (1, 2))
    t = regress.equivalent_medians(x.join(y, "q").filter("gauge_1 < gauge_2").withColumn("family", F.lit(1)), "family", margin=MARGIN)
    return rounded(t.select("q", "gauge_1", "gauge_2", "diff", "se", "p", "p_holm", "equivalent"), "diff", "se", "p", "p_holm")


@query(f"{RECURSIVE}, {VR.vr_sql(60, (2, 5, 15), 'r').replace('vr AS (', 'vg AS (')}, vr AS (SELECT q, vr_dev FROM vg), {_medians_sql('q')}, pr AS (SELECT a.q::BIGINT AS q_1, b.q::BIGINT AS q_2, a.m - b.m AS diff, {_SE} AS se FROM md a JOIN md b ON a.q < b.q), {_equivalent_sql('1')} SELECT q_1, q_2, {_OUT}")
def equivalence(spark, sf):
    """Equivalence of median |VR - 1| between horizons."""
    v = VR.strided(panel(spark, sf), 60, (2, 5, 15)).filter("vr_dev IS NOT NULL").select(F.col("q").cast("long").alias("q"), F.abs("vr_dev").alias("a"))
    m = O.median_interval(materialize(v, "departures"), "a", "q").withColumnRenamed("median", "m")
    t = regress.equivalent_medians(joins.ordered_pairs(m, "q", ["m", "lo", "hi"]).withColumn("family", F.lit(1)), "family", margin=MARGIN)
    return rounded(t.select("q_1", "q_2", "diff", "se", "p", "p_holm", "equivalent"), "diff", "se", "p", "p_holm")
