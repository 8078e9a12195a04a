"""Queries over resampled and simulated paths, fitted detectors, strategies and transport between clocks: no SQL says these."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information as I, injection as J, markov, nulls as N, regress, signals as G, strategy as T, variance_ratio as VR, windows as W
from ..sources.bars import MINUTE, PANEL_SQL, event_bars, panel
from ..sources.shared import materialize
from .common import query, rounded
from .studies import returns

CELLS = [(60, 2), (60, 5)]
SPECS = [("circular-block", 10), ("circular-block", 20), ("moving-block", 20), ("stationary-block", 20), ("wild", None), ("student-t", None), ("rank-sign", None)]


def paths(spark, sf, reps: int = 100, specs=SPECS):
    return N.programme(returns(spark, sf).select("symbol", "idx", "r"), "r", CELLS, specs, reps)


@query()
def null_programme(spark, sf):
    """Observed median z of each symbol against the nulls of every method, with Holm over the cells."""
    return rounded(N.null_report(paths(spark, sf)), "observed", "p_two", "p_greater", "p_less", "p05", "p50", "p95", "size", "p_holm")


@query()
def null_by_block(spark, sf):
    d = N.by_block(N.null_report(paths(spark, sf, specs=[s for s in SPECS if s[1]])))  # the others have no block to tell of
    return d.select("symbol", "method", "W", "q", F.to_json("p_by_block").alias("p_by_block"), F.to_json("holm_by_block").alias("holm_by_block"))


@query()
def iid_floor(spark, sf):
    """Median |VR - 1| that the symbols' returns show without any structure, in a random order and with random signs."""
    return rounded(VR.departure(J.calibrate_on(returns(spark, sf), "r", (0.0,)), "delta").select(F.col("q").cast("int").alias("q"), "delta"), "delta")


def _median(x):
    import numpy as np

    return np.median(x)


def _medians(at, x):
    import numpy as np

    return np.median(x[at], axis=1)


_median.rows = _medians


def _effect(x, label):
    """Effect size of the Kruskal-Wallis test."""
    import numpy as np

    n = len(x)
    _, back, m = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(m) - (m - 1) / 2)[back]
    groups = [rank[label == g] for g in np.unique(label)]
    h = 12 / (n * (n + 1)) * sum(g.sum() ** 2 / len(g) for g in groups) - 3 * (n + 1)
    ties = 1 - (m.astype(float) ** 3 - m).sum() / (float(n) ** 3 - n)
    return h / ties * (n + 1) / (n * n - 1) if ties > 0 else float("nan")


def _effects(at, x, label):
    """_effect of many resamples: values are put in order once, a resample counts them."""
    import numpy as np

    k, n = at.shape
    _, back = np.unique(x, return_inverse=True)
    _, group = np.unique(label, return_inverse=True)
    width, groups = back.max() + 1, group.max() + 1
    base = np.arange(k)[:, None]
    m = np.bincount((back[at] + base * width).ravel(), minlength=k * width).reshape(k, width).astype(float)
    rank = np.take_along_axis(np.cumsum(m, axis=1) - (m - 1) / 2, back[at], axis=1)
    place = (group[at] + base * groups).ravel()
    size = np.bincount(place, minlength=k * groups).reshape(k, groups)
    total = np.bincount(place, rank.ravel(), k * groups).reshape(k, groups)
    h = 12 / (n * (n + 1)) * (total**2 / np.maximum(size, 1)).sum(1) - 3 * (n + 1)
    ties = 1 - (m**3 - m).sum(1) / (float(n) ** 3 - n)
    with np.errstate(all="ignore"):
        return np.where(ties > 0, h / ties * (n + 1) / (n * n - 1), np.nan)


_effect.rows = _effects


def _effect_counts(x, label):
    """_effect of many resamples from how often each takes each row: values are put in order once, a running sum over that order
    holds the ranks, and sums by state are products with the states' marks."""
    import numpy as np

    n, order = len(x), np.argsort(x, kind="stable")
    v = x[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    tied = len(first) < n
    which = np.cumsum(np.append(False, v[1:] != v[:-1])) if tied else None
    names, group = np.unique(label[order], return_inverse=True)
    marks = (group == np.arange(len(names))[:, None]).astype(float)

    def effects(times):
        c = times[order]
        m = np.add.reduceat(c, first, axis=0) if tied else c
        rank = np.cumsum(m, axis=0)
        rank -= (m - 1) / 2
        size, total = marks @ c, marks @ (c * (rank[which] if tied else rank))
        h = 12 / (n * (n + 1)) * (total**2 / np.maximum(size, 1)).sum(0) - 3 * (n + 1)
        ties = 1 - (np.einsum("ij,ij,ij->j", m, m, m) - n) / (float(n) ** 3 - n)
        with np.errstate(all="ignore"):
            return np.where(ties > 0, h / ties * (n + 1) / (n * n - 1), np.nan)

    return effects


_effect.counts = _effect_counts


def _sign_information(a, b):
    import numpy as np

    c = np.zeros((3, 3))
    np.add.at(c, (np.sign(a).astype(int) + 1, np.sign(b).astype(int) + 1), 1)
    p, e = c / c.sum(), np.outer(c.sum(1), c.sum(0)) / c.sum() ** 2
    return float((p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum())


def _sign_informations(at, a, b):
    import numpy as np

    k = len(at)
    cell = 3 * (np.sign(a).astype(int) + 1) + np.sign(b).astype(int) + 1
    c = np.bincount((cell[at] + 9 * np.arange(k)[:, None]).ravel(), minlength=9 * k).reshape(k, 3, 3).astype(float)
    total = c.sum((1, 2), keepdims=True)
    p, e = c / total, c.sum(2, keepdims=True) * c.sum(1, keepdims=True) / total**2
    with np.errstate(all="ignore"):
        return np.where(p > 0, p * np.log(p / e), 0.0).sum((1, 2))


_sign_information.rows = _sign_informations


def _distance(r, w: int = 60):
    """Largest distance of a path's survival of first passages from the arcsine law."""
    import numpy as np

    return float(_distances(np.arange(len(r))[None], r, w)[0])


def _distances(at, r, w: int = 60):
    import numpy as np

    n = len(at)
    close = np.concatenate([np.ones((n, 1)), np.exp(np.cumsum(r[at], axis=1))], axis=1)
    k = (close.shape[1] - 1) // w
    if not k:
        return np.full(n, np.nan)
    seg = np.log(close[:, 1 : k * w + 1].reshape(n, k, w) / close[:, : k * w : w, None])
    left = (np.sign(seg) != np.sign(seg[:, :, :1])) | (seg == 0)
    t = np.where(left.any(2), left.argmax(2) + 1, w + 1)
    ends = np.bincount((t + np.arange(n)[:, None] * (w + 2)).ravel(), minlength=n * (w + 2)).reshape(n, w + 2)
    alive = (k - np.cumsum(ends, axis=1)[:, 1 : w + 1]) / k  # share of passages later than 1 to w
    grid = np.arange(1, w + 1)
    law = np.where(grid > 1, 2 / np.pi * np.arcsin(np.sqrt(1 / grid)), 1.0)
    return np.abs(alive - law).max(1)


_distance.rows = _distances


@query()
def bootstrap_departure(spark, sf):
    """Interval of the median |VR - 1| of a symbol's windows, made to hold the point."""
    v = VR.rolling(panel(spark, sf), 60, (5,)).filter("vr_dev IS NOT NULL").select("symbol", F.col("end_idx").alias("idx"), F.abs("vr_dev").alias("x"))
    return rounded(N.bootstrap(v, ["x"], _median, clamp=True), "point", "lo", "hi")


@query()
def bootstrap_effect(spark, sf):
    """Interval of the effect size of states on volatility, rows drawn jointly."""
    from .features import labels

    d = labels(spark, sf).filter("label >= 0").select("symbol", "idx", F.col("rv").alias("x"), F.col("label").cast("double").alias("label"))
    return rounded(N.bootstrap(d, ["x", "label"], _effect), "point", "lo", "hi")


@query()
def bootstrap_information(spark, sf):
    """Interval of the information in sign pairs, blocks without wrapping."""
    p = I.lag_pairs(returns(spark, sf), "r", 2).select("symbol", "idx", F.col("x").alias("a"), F.col("y").alias("b"))
    return rounded(N.bootstrap(p, ["a", "b"], _sign_information, method="moving-block"), "point", "lo", "hi")


def _slope(y, x1, x2, change):
    """Coefficient of change in the least-squares fit of y on it and the states."""
    import numpy as np

    design = np.stack([np.ones(len(y)), x1, x2, change], 1)
    return float(np.linalg.lstsq(design, y, rcond=None)[0][3])


def _slopes(at, y, x1, x2, change):
    """_slope of many resamples from sums of products, which a resample weighs; where these are near singular without being
    so, one by one."""
    import numpy as np

    k, n = at.shape
    weight = np.bincount((at + n * np.arange(k)[:, None]).ravel(), minlength=k * n).reshape(k, n).astype(float)
    design = np.stack([np.ones(n), x1, x2, change], 1)
    gram = (weight @ (design[:, :, None] * design[:, None, :]).reshape(n, 16)).reshape(k, 4, 4)
    values, vectors = np.linalg.eigh(gram)
    share = values / values[:, -1:]
    inverse = np.where(share > 1e-11, 1 / np.where(share > 1e-11, values, 1.0), 0.0)
    right = weight @ (design * y[:, None])
    out = (vectors[:, 3] * inverse * (vectors.transpose(0, 2, 1) @ right[:, :, None])[:, :, 0]).sum(1)
    for i in np.flatnonzero(((share > 1e-13) & (share < 1e-8)).any(1)):
        out[i] = _slope(y[at[i]], x1[at[i]], x2[at[i]], change[at[i]])
    return out


_slope.rows = _slopes


@query()
def bootstrap_slope(spark, sf):
    """Interval of what a change of state adds to volatility, refitted on every resample of rows."""
    from .features import labels

    d = regress.design(labels(spark, sf), "label", "rv", 20).select("symbol", "idx", "y", "x1", "x2", F.col("x5").alias("change"))
    return rounded(N.bootstrap(d, ["y", "x1", "x2", "change"], _slope, block=4), "point", "lo", "hi")


@query()
def persistence_test(spark, sf):
    """Distance to the arcsine law against its block bootstrap: p is the plain share of replicates at least as far."""
    d = returns(spark, sf).filter("idx > 0").select("symbol", "idx", "r")
    g = N.drawn(d, ["r"], _distance, block=60, reps=500).select("symbol", F.col("point").alias("ks"), F.col("v").alias("boot"))
    p = F.size(F.filter("boot", lambda v: v >= F.col("ks"))) / F.size("boot")
    return rounded(g.select("symbol", "ks", p.alias("p"), F.when(p < 0.05, "persistence_deviation_detected").otherwise("martingale_consistent").alias("verdict")), "ks", "p")


@query()
def markov_states(spark, sf):
    """How long each symbol is in each state of the Markov-switching detector."""
    return markov.states(panel(spark, sf), 20, 3).groupBy("symbol", "label").agg(F.count("*").alias("n"))


@query()
def markov_fits(spark, sf):
    """The best start of the variant with one mean, its spread, and how far the variances are apart."""
    b = W.realized_vol(panel(spark, sf), 20).filter("rv > 0").withColumn("x", F.ln("rv"))
    m = markov.best(markov.restarts(b, "x", 2, switching_mean=False))
    return rounded(m.select("symbol", "llf", "top5_spread", "spread_fraction", "convergence_ok", F.element_at("separation", 1).alias("separation")), "llf", "top5_spread", "spread_fraction", "separation", digits=4)


@query()
def neighbour_information(spark, sf):
    """Information between a return and a later one, by nearest neighbours, with its bootstrap error."""
    return rounded(I.information(I.lag_pairs(returns(spark, sf), "r", 5), "raw"), "mi", "se")


@query()
def sign_information(spark, sf):
    return rounded(I.information(I.lag_pairs(returns(spark, sf), "r", 5, signs=True), "signs"), "mi", "se")


@query()
def estimator_bias(spark, sf):
    """Bias of the nearest-neighbour estimate on pairs of known information, made of all returns' ranks."""
    return rounded(I.estimator_bias_on(returns(spark, sf), "r"), "bias", "se")


@query()
def phi_calibration(spark, sf):
    """phi for each target departure, from 20 phi injected into the symbols' returns, whose structure is taken out."""
    c = VR.departure(J.calibrate_on(returns(spark, sf), "r", [k / 20 for k in range(20)]), "delta", "phi")
    return rounded(J.inverted(c, (0.01, 0.05, 0.2, 0.4)), "phi")


@query()
def injection_cells(spark, sf):
    """Detection share on each symbol's own path by injected phi, negative ones included."""
    return rounded(J.cell_power(returns(spark, sf), "r", (-0.3, 0.0, 0.5), n_mc=20, w=120, negative=True), "p_det", "median_z")


SMALL = {"fast": 20, "slow": 60, "vwap": 60, "low": 0.95, "high": 1.1}
RULES = G.Rules(warm_reversion=60, warm_breakout=60, exit_deviation=0.0, stop=0.2, profit=0.2)


def featured(spark, sf):
    day = F.col("ts") + 13 * 3_600_000  # the series begin at midnight, the session at noon
    return G.features(panel(spark, sf).withColumn("ts", day), **SMALL)


@query()
def raw_signals(spark, sf):
    s = G.raw_signals(featured(spark, sf), RULES)
    return s.groupBy("symbol").agg(*[F.sum((F.col("signal") == k).cast("long")).alias(n) for k, n in ((-1, "short"), (0, "flat"), (1, "long"))])


@query()
def managed_signals(spark, sf):
    s = G.managed_signals(featured(spark, sf), "blueprint", RULES)
    return rounded(s.groupBy("symbol").agg(F.sum(F.abs("signal")).alias("exposure"), F.sum(F.col("limit_order").cast("long")).alias("limit_bars")), "exposure")


@query()
def strategy_sweep(spark, sf):
    """The managed strategy at several costs, with limit orders; where its return crosses zero."""
    from ..operators.studies import break_even

    points = [(f"slip{k}", T.Terms(slippage=k * 1e-4, fee=4e-4, maker_fee=-1e-5, fill_chance=0.8)) for k in (0, 1, 2, 5)]
    s = G.managed_signals(featured(spark, sf), "shipped", RULES)
    r = materialize(T.report(T.run_all(s, "signal", "limit_order", points), points), "sweep")  # read twice
    r = r.join(break_even(r.select("symbol", "cost", "total_return"), "symbol"), "symbol")
    return rounded(r, "cost", "final_equity", "total_return", "max_drawdown", "win_rate", "turnover", "fee_drag", "mean_minutes", "break_even", digits=5)


_EVERY = VR.vr_sql(60, (5,)).split("\n), v1 AS", 1)[1]


@query(f"""WITH {PANEL_SQL}, v0 AS (SELECT symbol, idx AS win, list(close) OVER f AS y, idx AS end_idx, ts AS end_ts FROM panel WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING) QUALIFY count(*) OVER f = 60
), v1 AS{_EVERY}, sc AS (SELECT p.symbol, abs(vr_dev) AS s FROM panel p LEFT JOIN vr ON p.symbol = vr.symbol AND p.idx = vr.end_idx), ed AS (SELECT quantile_cont(s, 0.75) AS lo, quantile_cont(s, 0.95) AS hi FROM sc)
SELECT symbol, CASE WHEN s IS NULL THEN -1 WHEN s <= lo THEN 0 WHEN s <= hi THEN 1 ELSE 2 END AS label, count(*) AS n FROM sc, ed GROUP BY ALL""")
def variance_ratio_detector(spark, sf):
    from ..operators.detectors import detect

    return detect("variance_ratio", panel(spark, sf), w=60, q=5).groupBy("symbol", "label").agg(F.count("*").alias("n"))


@query()
def ic_intervals(spark, sf):
    """Rank correlation of an hourly return with the next, and the block bootstrap interval of its mean rank product."""
    from ..operators.studies import rank_products

    h = event_bars(spark, sf, 60 * MINUTE, F.col("event_type")).withColumn("idx", F.row_number().over(W.by_symbol("ts")) - 1)
    d = rank_products(h.select("symbol", "idx", W.log_return().alias("x"), W.forward_return().alias("y")), "x", "y", "symbol")
    return rounded(N.bootstrap(d.select("symbol", "idx", F.col("rank_product").alias("x")), ["x"], _mean), "point", "lo", "hi")


def _mean(x):
    return x.mean()


def _means(at, x):
    return x[at].mean(1)


_mean.rows = _means


@query()
def delta_star(spark, sf):
    """Detection limits from the shares that injected phi reach on all symbols."""
    from ..operators.studies import delta_star

    d = J.cell_power(returns(spark, sf), "r", (0.05, 0.3, 0.6, 0.9), n_mc=10, w=60, horizons=(2, 5, 15))
    c = d.groupBy((F.col("symbol") % 4).alias("cell"), F.col("phi").alias("delta")).agg(F.avg("p_det").alias("p_det"))
    return rounded(delta_star(c, 0.5), "delta")
