"""Studies on series and on tables of results: autocorrelation, survival, performance, grids of cells, repairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numerics import pchip
from ..sources.bars import by_symbol, slot
from .windows import CHUNK, _numbers, average_ranks, drawdowns, over_groups

DAY = 86_400_000


def autocorrelations(df: DataFrame, value: str, lags: int) -> DataFrame:
    """By symbol: n, mean |autocorrelation| over lags 1 to lags (biased), Ljung-Box Q, and its p for an even number of lags."""
    m = df.groupBy("symbol").agg(F.count(value).alias("n"), F.avg(value).alias("__m"), (F.var_pop(value) * F.count(value)).alias("__ss"))
    d = df.filter(F.col(value).isNotNull()).join(m, "symbol").withColumn("__c", F.col(value) - F.col("__m"))
    d = d.withColumns({f"__l{k}": F.col("__c") * F.lag("__c", k).over(by_symbol()) for k in range(1, lags + 1)})
    s = d.groupBy("symbol", "n", "__ss").agg(*[F.sum(f"__l{k}").alias(f"a{k}") for k in range(1, lags + 1)])
    ac = [F.when(F.col("__ss") > 0, F.col(f"a{k}") / F.col("__ss")) for k in range(1, lags + 1)]
    n = F.col("n")
    q = n * (n + 2) * reduce(lambda a, b: a + b, (x * x / (n - k) for k, x in enumerate(ac, 1)))
    out = s.select("symbol", "n", (reduce(lambda a, b: a + b, map(F.abs, ac)) / lags).alias("mean_abs"), q.alias("lb_q"))
    if lags % 2:
        return out
    half = F.col("lb_q") / 2
    return out.withColumn("lb_p", F.exp(-half) * reduce(lambda a, b: a + b, (F.pow(half, F.lit(i)) / math.factorial(i) for i in range(lags // 2))))


def first_passages(bars: DataFrame, w: int, horizon: int | None = None) -> DataFrame:
    """symbol, seg, passage: in each full segment of w bars after its first, which the segment before shares, the bar at
    which the log price relative to the first leaves the side of the first step; horizon + 1 if it never does."""
    k, seg = F.col("idx") % w, F.floor(F.col("idx") / w)
    own = F.struct(seg.alias("seg"), k.alias("k"))
    edge = F.struct((seg - 1).alias("seg"), F.lit(w).cast("long").alias("k"))
    places = F.when((k == 0) & (F.col("idx") > 0), F.array(own, edge)).otherwise(F.array(own))
    b = bars.select("symbol", F.explode(places).alias("p"), "close").select("symbol", "p.seg", "p.k", "close")
    part = Window.partitionBy("symbol", "seg")
    b = b.withColumn("__s", F.signum(F.ln(F.col("close") / F.first("close").over(part.orderBy("k")))))
    b = b.withColumn("__f", F.max(F.when(F.col("k") == 1, F.col("__s"))).over(part)).filter("k > 0")
    g = b.groupBy("symbol", "seg").agg(F.min(F.when((F.col("__s") != F.col("__f")) | (F.col("__s") == 0), F.col("k"))).alias("p"), F.count("*").alias("n"))
    return g.filter(F.col("n") == w).select("symbol", "seg", F.coalesce("p", F.lit((horizon or w) + 1)).cast("long").alias("passage"))


def survival(passages: DataFrame, horizon: int) -> DataFrame:
    """t, s: share of passages above t, for t from 1 to horizon; s0: the arcsine law."""
    counts = passages.groupBy(F.least("passage", F.lit(horizon + 1)).alias("p")).agg(F.count("*").alias("c"))
    grid = passages.sparkSession.range(1, horizon + 1).select(F.col("id").alias("t"))
    s = grid.join(F.broadcast(counts), F.col("p") > F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))  # horizon + 1 counts at most
    total = counts.agg(F.sum("c").alias("n"))
    s0 = F.when(F.col("t") > 1, 2 / F.pi() * F.asin(F.sqrt(1 / F.col("t")))).otherwise(1.0)
    return s.crossJoin(F.broadcast(total)).select("t", (F.col("c") / F.col("n")).alias("s"), s0.alias("s0"))


def survival_fit(curve: DataFrame) -> DataFrame:
    """One row: exponent of the power law by least squares on logarithms, and the largest distance to the arcsine law."""
    keep = F.col("s") > 0
    return curve.agg((-F.regr_slope(F.when(keep, F.ln("s")), F.when(keep, F.ln("t")))).alias("theta"), F.max(F.abs(F.col("s") - F.col("s0"))).alias("ks"))


def break_even(points: DataFrame, *by: str) -> DataFrame:
    """Where total_return crosses 0 first along cost, on the line between its neighbours; null if it doesn't."""
    w = Window.partitionBy(*by).orderBy("cost")
    p = points.withColumns({"__x": F.lead("cost").over(w), "__y": F.lead("total_return").over(w)})
    crosses = (F.col("total_return") > 0) != (F.col("__y") > 0)
    at = F.col("cost") - F.col("total_return") * (F.col("__x") - F.col("cost")) / (F.col("__y") - F.col("total_return"))
    return p.groupBy(*by).agg(F.min_by(F.when(crosses, at), F.when(crosses, F.col("cost"))).alias("break_even"))


def gaussian_information(departure: Column, q: Column | int) -> Column:
    """Nats that a variance-ratio departure allows under a Gaussian law."""
    rho = F.least(F.abs(departure) / (2 * (1 - 1 / (q if isinstance(q, Column) else F.lit(q)))), F.lit(1 - 1e-12))
    return F.greatest(F.lit(0.0), -0.5 * F.ln(1 - rho * rho))


def bound_verdict(gross_bps: Column, taker: tuple[float, float] = (9.0, 10.0)) -> Column:
    """By the cheapest cost (costs and names are fixed values)."""
    return F.when(gross_bps < min(taker), "demon_runs_at_loss").otherwise("bound_exceeds_costs")


def rank_products(df: DataFrame, x: str, y: str, *by: str, least: int = 10) -> DataFrame:
    """df's complete pairs with rank_product, standardised ranks multiplied; its mean is the rank correlation. Groups of
    fewer than least pairs are left out."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    schema = T.StructType([*d.schema.fields, T.StructField("rank_product", T.DoubleType())])
    kept = d.columns

    def make(t, bounds):
        import numpy as np

        n = np.diff(bounds)
        product = np.ones(t.num_rows)
        for c in (x, y):
            r = average_ranks(_numbers(t[c]), bounds) - np.repeat((n + 1) / 2, n)
            sd = np.sqrt(np.add.reduceat(r * r, bounds[:-1]) / n) if len(n) else n
            product *= np.divide(r, np.repeat(sd, n), out=np.full(len(r), np.nan), where=np.repeat(sd > 0, n))
        enough = np.repeat(n >= least, n)
        t = t.filter(enough)
        return {c: t[c] for c in kept} | {"rank_product": product[enough]}

    return over_groups(d, [*by], make, schema, "idx" if "idx" in kept else x)


def day_returns(equity: DataFrame) -> DataFrame:
    """symbol, day, r: last equity of each UTC day against that of the day before; prev is null on the first day."""
    d = equity.groupBy("symbol", slot("ts", DAY).alias("day")).agg(F.max_by("equity", "ts").alias("last"))
    return d.withColumn("prev", F.lag("last").over(by_symbol("day"))).withColumn("r", F.col("last") / F.col("prev") - 1)


def performance(equity: DataFrame, capital: float, years: float, per_year: float = 365.0) -> DataFrame:
    """By symbol: Sharpe and Sortino ratios from day returns with sample deviations, the engine's Sharpe (first day against
    capital, population deviation), total return, drawdown and Calmar ratio; 0 where a ratio has no meaning."""
    d = day_returns(equity).withColumn("e", F.col("last") / F.coalesce("prev", F.lit(capital)) - 1)
    s = d.groupBy("symbol").agg(
        F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"),
        F.avg("e").alias("em"), F.stddev_pop("e").alias("es"), F.max_by("last", "day").alias("end"),
    )
    fall = drawdowns(equity.select("symbol", F.col("ts").alias("idx"), "equity"), "equity", CHUNK * 60_000)
    dd = fall.groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"))
    ratio = lambda m, sd: F.when(F.col(sd) > 0, F.sqrt(F.lit(per_year)) * F.col(m) / F.col(sd)).otherwise(0.0)
    total = F.col("end") / capital - 1
    out = s.join(dd, "symbol").withColumn("total_return", total)
    calmar = F.when(F.col("max_drawdown") > 0, (F.pow(1 + F.col("total_return"), F.lit(1 / years)) - 1) / F.col("max_drawdown")).otherwise(0.0)
    return out.select("symbol", "n", ratio("m", "sd").alias("sharpe"), ratio("m", "down").alias("sortino"), ratio("em", "es").alias("engine_sharpe"), "total_return", "max_drawdown", calmar.alias("calmar"))


def higher_quantile(values: Column, p: float) -> Column:
    """The sample quantile of an array that is itself in the sample, rounded up."""
    s = F.array_sort(values)
    return F.element_at(s, F.ceil(p * (F.size(s) - 1)).cast("int") + 1)


def max_thresholds(paths: DataFrame, alpha: float) -> DataFrame:
    """gate, threshold: the largest statistic of each replicate, then its upper quantile. paths: gate, rep, value."""
    tops = paths.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("gate", "rep").agg(F.max("value").alias("top"))
    return tops.groupBy("gate").agg(higher_quantile(F.collect_list("top"), 1 - alpha).alias("threshold"))  # one value a replicate


def calendar_grid(df: DataFrame, cells, duration: str = "median_min") -> DataFrame:
    """df's rows by W and q of cells, put to bars of the row's median duration in minutes; truncated where a floor acts."""
    grid = F.explode(F.array(*[F.struct(F.lit(w).alias("W_clock"), F.lit(q).alias("q_clock")) for w, q in cells]))
    d = df.withColumn("__g", grid).select(*df.columns, "__g.*").withColumn("scale", 1 / F.col(duration))
    q, w = (F.bround(F.col(c) * F.col("scale")).cast("long") for c in ("q_clock", "W_clock"))
    d = d.withColumns({"q_raw": q, "w_raw": w}).withColumn("q_adj", F.greatest(F.lit(2), "q_raw"))
    return d.withColumns({"W_adj": F.greatest(F.col("q_adj") + 10, "w_raw"), "truncated": (F.col("q_raw") < 2) | (F.col("w_raw") < F.col("q_adj") + 10)}).drop("q_raw", "w_raw")


def recentred(draws: DataFrame, null_delta: float, z_crit: float = 1.6448536269514722) -> DataFrame:
    """By cell and delta: draws, share of raw z above the two-sided critical value, share of z, studentised by the cell's
    null draws of even number, above the one-sided one; null draws of odd number give the size. draws: cell, delta, draw, z."""
    fit = draws.filter((F.col("delta") == null_delta) & (F.col("draw") % 2 == 0)).groupBy("cell").agg(F.avg("z").alias("center"), F.stddev_samp("z").alias("sd"))
    d = draws.join(fit, "cell").withColumn("t", (F.col("z") - F.col("center")) / F.col("sd"))
    out = d.filter((F.col("delta") != null_delta) | (F.col("draw") % 2 == 1))
    share = lambda c: F.avg(c.cast("int"))
    return out.groupBy("cell", "delta", "center", "sd").agg(F.count("*").alias("n"), share(F.col("z") > 1.959963984540054).alias("p_raw"), share(F.col("t") > z_crit).alias("p_det"))


def detectable(repaired: DataFrame, level: float) -> DataFrame:
    """By cell: the smallest delta detected at least at level."""
    return repaired.groupBy("cell").agg(F.min(F.when(F.col("p_det") >= level, F.col("delta"))).alias("delta"))


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return ~((hi_a < lo_b) | (hi_b < lo_a))


def same_sign(x: Column) -> Column:
    """Whether all values are positive or all negative, as an aggregate."""
    return F.bool_and(x > 0) | F.bool_and(x < 0)


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each key of either side and field: both values, absolute and relative difference in percent."""
    j = a.select(key, *[F.col(f).cast("double").alias(f"a_{f}") for f in fields]).join(b.select(key, *[F.col(f).cast("double").alias(f"b_{f}") for f in fields]), key, "full")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields]))
    d = j.select(key, each.alias("x")).select(key, "x.*")
    gap = F.abs(F.col("a") - F.col("b"))
    return d.withColumns({"abs_diff": gap, "rel_pct": F.when(F.col("b") != 0, gap / F.abs("b") * 100)})


def replay_windows(bars: DataFrame, start_ms: int, end_ms: int, window_ms: int, stride_ms: int, matured: int = 0) -> DataFrame:
    """By symbol and decision time: the last bar at or before it, the first bar within the window before it, and the last
    bar whose target of matured bars has come; only windows that hold such a bar."""
    times = bars.select("symbol").distinct().withColumn("decision", F.explode(F.sequence(F.lit(start_ms), F.lit(end_ms), F.lit(stride_ms))))
    # bars and windows meet by the stride they lie in
    spans = times.withColumn("bin", F.explode(F.sequence(F.floor((F.col("decision") - window_ms) / stride_ms), F.floor(F.col("decision") / stride_ms))))
    b = bars.select("symbol", "idx", "ts", F.floor(F.col("ts") / stride_ms).alias("bin"))
    inside = spans.join(b, ["symbol", "bin"]).filter(F.col("ts").between(F.col("decision") - window_ms, F.col("decision")))
    g = inside.groupBy("symbol", "decision").agg(F.min("idx").alias("window_start"), F.max("idx").alias("decision_idx"), F.max("ts").alias("decision_ts"))
    return g.withColumn("matured_end", F.col("decision_idx") - matured).filter((F.col("window_start") <= F.col("matured_end")) & (F.col("matured_end") >= 0))


def delta_star(curves: DataFrame, level: float = 0.9, points: int = 1000) -> DataFrame:
    """By cell: the smallest delta at which a monotone cubic through (delta, p_det) reaches level, on a logarithmic grid; null
    if no point does. A cell's curve is a few points."""
    import math

    kind = curves.schema["cell"].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("delta")
        xs, ys, at = pdf["delta"].tolist(), pdf["p_det"].tolist(), None
        if max(ys) >= level:
            f = pchip(xs, ys) if len(xs) > 1 else lambda x: ys[0]
            a, b = math.log(xs[0]), math.log(xs[-1])
            grid = (math.exp(a + (b - a) * k / (points - 1)) for k in range(points))
            at = next((x for x in grid if f(x) >= level), None)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "delta": pd.Series([at], dtype=float)})

    return curves.filter("delta > 0").groupBy("cell").applyInPandas(run, f"cell {kind}, delta double")
