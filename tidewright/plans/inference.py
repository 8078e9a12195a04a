"""Queries over variance ratios, label agreement, joins, tests and certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import two_sided_p, two_sided_p_sql
from ..operators import joins, measures as M, variance_ratio as VR, windows as W
from ..sources.bars import MINUTE, PANEL_SQL, by_symbol, event_bars, event_bars_sql, label_pair, panel
from ..sources.shared import materialize
from .common import query, rounded
from .features import QUANT, RET, labels

HOUR = 60 * MINUTE
VRS = f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5, 15))}"
SIG = VRS + ", s AS (SELECT q, count(*) AS n, median(abs(vr_dev)) AS median_dev, avg(abs(vr_dev)) AS mean_dev, median(z) AS median_z FROM vr GROUP BY q)"


@query(VRS + " SELECT symbol, win, q, round(vr_dev, 6) AS vr_dev, round(z, 6) AS z FROM vr")
def vr_windows(spark, sf):
    return rounded(VR.strided(panel(spark, sf), 60, (2, 5, 15)).select("symbol", "win", F.col("q").cast("long").alias("q"), "vr_dev", "z").filter("vr_dev IS NOT NULL"), "vr_dev", "z")


@query(SIG + " SELECT q, n, round(median_dev, 6) AS median_dev, round(mean_dev, 6) AS mean_dev, round(median_z, 6) AS median_z, median_dev < 0.001 AS closed FROM s")
def vr_significance(spark, sf):
    return rounded(VR.significance(VR.strided(panel(spark, sf), 60, (2, 5, 15))), "median_dev", "mean_dev", "median_z")


@query(VRS + ", y AS (SELECT vr.*, p.year FROM vr JOIN panel p ON vr.symbol = p.symbol AND vr.end_idx = p.idx) SELECT year, q, count(*) AS n, round(median(abs(vr_dev)), 6) AS median_dev, round(avg(abs(vr_dev)), 6) AS mean_dev FROM y GROUP BY ALL")
def vr_by_year(spark, sf):
    b = panel(spark, sf)
    v = VR.strided(b, 60, (2, 5, 15)).join(b.select("symbol", F.col("idx").alias("end_idx"), "year"), ["symbol", "end_idx"])
    return rounded(VR.significance(v, "year").select("year", "q", "n", "median_dev", "mean_dev"), "median_dev", "mean_dev")


@query(f"""WITH {PANEL_SQL}, shifted AS (SELECT symbol * 100 + k AS symbol, idx - k AS idx, ts, close FROM panel, (SELECT unnest(range(0, 60)) AS k) WHERE idx >= k), {VR.vr_sql(60, (2, 5), 'shifted')}
SELECT symbol // 100 AS symbol, q, end_idx + symbol % 100 AS end_idx, round(vr_dev, 6) AS vr_dev, round(z, 6) AS z FROM vr""")
def vr_rolling(spark, sf):
    """The window that ends at every bar of every symbol."""
    v = VR.rolling(panel(spark, sf), 60, (2, 5)).filter("vr_dev IS NOT NULL")
    return rounded(v.select("symbol", F.col("q").cast("long").alias("q"), "end_idx", "vr_dev", "z"), "vr_dev", "z")


@query(VRS + """, m AS (SELECT symbol, q, median(z) AS z FROM vr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(z) DESC, q) AS k FROM m),
o AS (SELECT *, abs(z) > [2.497705474412374, 2.3939797998185104, 2.241402727604947, 1.959963984540054][k] AS ok FROM k), r AS (SELECT *, min(ok::INT) OVER (PARTITION BY symbol ORDER BY k) = 1 AS rejected FROM o)
SELECT symbol, max((rejected AND z > 0)::INT) = 1 AS fired, sum(rejected::INT)::BIGINT AS n_rejected FROM r GROUP BY symbol""")
def vr_cascade(spark, sf):
    return M.cascade(VR.significance(VR.strided(panel(spark, sf), 60, (2, 5, 15)), "symbol"), "symbol")


@query(VRS + """, c3 AS (SELECT *, count(z) OVER (PARTITION BY symbol, win) AS c FROM vr), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY abs(z) DESC, q) AS k FROM c3 WHERE c = 3), o AS (SELECT *, abs(z) > [2.3939797998185104, 2.241402727604947, 1.959963984540054][k] AS ok FROM k),
r AS (SELECT *, min(ok::INT) OVER (PARTITION BY symbol, win ORDER BY k) = 1 AS rej FROM o) SELECT q, count(*) AS n, sum((rej AND z > 0)::INT)::BIGINT AS triggers FROM r GROUP BY q""")
def local_triggers(spark, sf):
    v = VR.strided(panel(spark, sf), 60, (2, 5, 15)).filter("z IS NOT NULL")
    w = Window.partitionBy("symbol", "win")
    v = v.withColumn("n", F.count("z").over(w)).filter("n = 3")  # all horizons finite
    v = v.withColumn("k", F.row_number().over(w.orderBy(F.abs("z").desc(), "q"))).withColumn("ok", (F.abs("z") > F.element_at(F.array(*map(F.lit, M.CRITICAL[1:])), F.col("k"))).cast("int"))
    v = v.withColumn("rej", F.min("ok").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return v.groupBy(F.col("q").cast("long").alias("q")).agg(F.count("*").alias("n"), F.sum((F.col("rej") & (F.col("z") > 0)).cast("long")).alias("triggers"))


@query("SELECT x, y, count(quality) AS n FROM (SELECT unnest([0, 1, 2]) AS x), (SELECT unnest([0, 1, 2]) AS y) LEFT JOIN labels ON quality = x AND toxic = y GROUP BY x, y")
def confusion(spark, sf):
    """Counts of all pairs of three states, 0 where there is none."""
    return M.zero_filled(M.joint(label_pair(spark, sf), "x", "y").select("x", "y", "n"), {"x": 3, "y": 3})


@query("SELECT quality AS state, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS share FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality")
def agreement_by_state(spark, sf):
    return rounded(M.agreement_by_state(label_pair(spark, sf), "x", "y"), "share")


AGREE = """WITH j AS (SELECT quality AS x, toxic AS y, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j),
s AS (SELECT max(t) AS t, sum(CASE WHEN x = y THEN n ELSE 0 END) / max(t) AS po, sum(CASE WHEN x = y THEN nx * ny ELSE 0 END) / max(t) ** 2 AS pe, sum(n / t * ln(n * t / (nx * ny))) AS mi, -sum(n / t * ln(nx / t)) AS hx, -sum(n / t * ln(ny / t)) AS hy,
 sum(n * (n - 1) / 2) AS pij, sum(n * (nx - 1) / 2) AS px, sum(n * (ny - 1) / 2) AS py FROM m)"""


@query(AGREE + " SELECT t::BIGINT AS n, round((po - pe) / (1 - pe), 6) AS kappa, round(greatest(hx + hy - 2 * mi, 0), 6) AS vi, round(2 * mi / (hx + hy), 6) AS nmi, round((pij - px * py / (t * (t - 1) / 2)) / ((px + py) / 2 - px * py / (t * (t - 1) / 2)), 6) AS ari FROM s")
def agreement(spark, sf):
    return rounded(M.agreement(label_pair(spark, sf), "x", "y"), "kappa", "vi", "nmi", "ari")


@query(AGREE + " SELECT round(greatest(mi, 0), 6) AS mi, round(hx, 6) AS h_x, round(hy, 6) AS h_y, t::BIGINT AS n FROM s")
def mutual_information(spark, sf):
    return rounded(M.mutual_information(label_pair(spark, sf), "x", "y"), "mi", "h_x", "h_y")


@query(QUANT + """, f AS (SELECT label, lead(close, 5) OVER w / close - 1 AS fwd, row_number() OVER w AS k FROM (SELECT l.*, p.close FROM l JOIN panel p USING (symbol, idx)) WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT label, count(*) AS n, round(avg(fwd), 6) AS mean, round(median(fwd), 6) AS median, round(stddev_samp(fwd), 6) AS std, round(quantile_cont(fwd, 0.25), 6) AS q25, round(quantile_cont(fwd, 0.75), 6) AS q75 FROM f WHERE label >= 0 AND fwd IS NOT NULL GROUP BY label""")
def conditional_returns(spark, sf):
    d = labels(spark, sf).withColumn("fwd", W.forward_return(5)).filter("label >= 0 AND fwd IS NOT NULL")
    d = materialize(d.select("label", "fwd"), "returns")  # quantiles read it several times
    q = M.exact_quantiles(d, F.col("fwd"), {"median": 0.5, "q25": 0.25, "q75": 0.75}, "label").drop("n")
    m = d.groupBy("label").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.stddev_samp("fwd").alias("std"))
    return rounded(m.join(q, "label").select("label", "n", "mean", "median", "std", "q25", "q75"), "mean", "median", "std", "q25", "q75")


@query(QUANT + """, k AS (SELECT symbol, label, rv, 0 AS g FROM l WHERE label >= 0 AND idx >= 59 AND (idx - 59) % 60 = 0 AND rv IS NOT NULL), rk0 AS (SELECT *, rank() OVER (ORDER BY rv) + (count(*) OVER (PARTITION BY rv) - 1) / 2 AS rk, count(*) OVER () AS n FROM k),
t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM k GROUP BY rv)), g AS (SELECT label, count(*) AS m, sum(rk) AS s, max(n)::DOUBLE AS n FROM rk0 GROUP BY label), h AS (SELECT max(n) AS n, count(*) AS k, (12 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1)) AS h0 FROM g)
SELECT n::BIGINT AS n, k, round(h0 / (1 - t / (n ** 3 - n)), 5) AS h, round(h0 / (1 - t / (n ** 3 - n)) * (n + 1) / (n * n - 1), 6) AS epsilon_sq FROM h, t""")
def kruskal_wallis(spark, sf):
    from ..operators.rebar import non_overlapping

    return rounded(rounded(M.kruskal(non_overlapping(labels(spark, sf), 60, "rv", "label"), "rv", "label"), "h", digits=5), "epsilon_sq")


@query(RET + ", s AS (SELECT symbol, r, lead(close) OVER (PARTITION BY symbol ORDER BY idx) / close - 1 AS f FROM r), k AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY f) + (count(*) OVER (PARTITION BY symbol, f) - 1) / 2 AS b FROM s WHERE f IS NOT NULL) SELECT symbol, count(*) AS n, round(corr(a, b), 6) AS ic FROM k GROUP BY symbol")
def spearman_ic(spark, sf):
    b = panel(spark, sf).select("symbol", W.log_return().alias("r"), W.forward_return().alias("f"))
    return rounded(M.spearman(b, "r", "f", "symbol"), "ic")


@query(f"WITH {PANEL_SQL}, v AS (SELECT symbol, volume / 50 AS v FROM panel) SELECT symbol, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(avg((v >= 0.95)::INT), 6) AS rail, round(avg((v <= 0.001)::INT), 6) AS zero, round(stddev_samp(v) / avg(v), 6) AS cv FROM v GROUP BY symbol")
def degeneracy(spark, sf):
    return rounded(M.degeneracy(panel(spark, sf).withColumn("v", F.col("volume") / 50), "v", "symbol"), "mean", "std", "iqr", "rail", "zero", "cv")


@query(f"WITH {PANEL_SQL}, a AS (SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY idx) AS p FROM panel) SELECT symbol, round(regr_slope(close, p), 6) AS phi, CASE WHEN regr_slope(close, p) BETWEEN 1e-12 AND 1 - 1e-12 THEN round(-ln(2) / ln(regr_slope(close, p)), 6) END AS half_life FROM a WHERE p IS NOT NULL GROUP BY symbol")
def ar1_half_life(spark, sf):
    b = panel(spark, sf).withColumn("p", F.lag("close").over(by_symbol())).filter("p IS NOT NULL").groupBy("symbol").agg(F.regr_slope("close", "p").alias("phi"))
    return rounded(b.withColumn("half_life", F.when(F.col("phi").between(1e-12, 1 - 1e-12), -F.ln(F.lit(2.0)) / F.ln("phi"))), "phi", "half_life")


TWO = event_bars_sql(HOUR, "event_type") + ", a AS (SELECT ts, close AS x FROM bars WHERE symbol = 'view'), b AS (SELECT ts, close AS y FROM bars WHERE symbol = 'click')"


def _two(spark, sf):
    e = event_bars(spark, sf, HOUR, F.col("event_type"))
    return e.filter("symbol = 'view'").select("ts", F.col("close").alias("x")), e.filter("symbol = 'click'").select("ts", F.col("close").alias("y"))


@query(f"WITH {TWO} SELECT ts, round(x, 6) AS x, round(y, 6) AS y FROM a JOIN b USING (ts)")
def join_symbols(spark, sf):
    return rounded(joins.same_time(*_two(spark, sf)), "x", "y")


@query(f"WITH {TWO} SELECT a.ts, round(x, 6) AS x, round(y, 6) AS y FROM a ASOF LEFT JOIN b ON a.ts >= b.ts")
def join_as_of(spark, sf):
    a, b = _two(spark, sf)
    return rounded(joins.as_of(a, b, "ts", "y"), "x", "y")


@query(f"WITH {TWO}, i AS (SELECT k, 1704067200000 + k * 259200000 AS s, 1704067200000 + k * 259200000 + 400000000 AS e FROM (SELECT unnest(range(0, 9)) AS k)) SELECT k, count(*) AS n, round(max(x), 6) AS peak FROM a JOIN i ON a.ts BETWEEN i.s AND i.e GROUP BY k")
def join_intervals(spark, sf):
    i = spark.range(9).select(F.col("id").alias("k"), (1704067200000 + F.col("id") * 259200000).alias("start"), (1704067200000 + F.col("id") * 259200000 + 400000000).alias("end"))
    return rounded(joins.in_intervals(_two(spark, sf)[0], i, "ts").groupBy("k").agg(F.count("*").alias("n"), F.max("x").alias("peak")), "peak")


@query(f"WITH {event_bars_sql(HOUR, 'event_type')}, v AS (SELECT symbol, ts, (floor(close) % 4)::INT - 1 AS label FROM bars) SELECT a.ts, a.label AS click, b.label AS view, c.label AS error FROM v a JOIN v b USING (ts) JOIN v c USING (ts) WHERE a.symbol = 'click' AND b.symbol = 'view' AND c.symbol = 'error' AND a.label >= 0 AND b.label >= 0 AND c.label >= 0")
def join_all_valid(spark, sf):
    v = event_bars(spark, sf, HOUR, F.col("event_type")).select("symbol", "ts", ((F.floor("close") % 4).cast("int") - 1).alias("label"))
    return joins.all_valid({s: v.filter(F.col("symbol") == s) for s in ("click", "view", "error")})


@query(f"WITH {event_bars_sql(HOUR, 'event_type')}, d AS (SELECT symbol AS name, median(close) AS m FROM bars GROUP BY symbol) SELECT x.name AS name_1, y.name AS name_2, round(x.m - y.m, 6) AS diff FROM d x JOIN d y ON x.name < y.name")
def join_pairs(spark, sf):
    d = event_bars(spark, sf, HOUR, F.col("event_type")).groupBy(F.col("symbol").alias("name")).agg(F.percentile("close", F.lit(0.5)).alias("m"))
    return rounded(joins.ordered_pairs(d, "name", ["m"]).select("name_1", "name_2", (F.col("m_1") - F.col("m_2")).alias("diff")), "diff")


@query("WITH g AS (SELECT * FROM (SELECT unnest(['view', 'click', 'error', 'login']) AS t), (SELECT unnest(range(0, 24)) AS h)) SELECT t, h FROM g ANTI JOIN (SELECT DISTINCT event_type AS t, hour(ts) AS h FROM events) e USING (t, h)")
def missing_cells(spark, sf):
    """Planned cells that no event has; one planned type never occurs."""
    g = spark.range(1).select(F.explode(F.array(*map(F.lit, ("view", "click", "error", "login")))).alias("t")).crossJoin(spark.range(24).select(F.col("id").alias("h")))  # a grid of fixed size
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("t"), F.hour(F.col("ts").cast("timestamp")).cast("long").alias("h"))
    return joins.missing(g, e, ["t", "h"])


SYMBOLS = VRS + f", sm AS (SELECT symbol, q, count(*) AS n, median(z) AS mz, median(abs(vr_dev)) AS dev FROM vr GROUP BY ALL), sp AS (SELECT *, {two_sided_p_sql('mz')} AS p FROM sm)"


@query(SYMBOLS + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, q) AS k FROM sp) SELECT symbol, q::BIGINT AS q, round(p, 6) AS p, round(least(1, max(p * (4 - k)) OVER (PARTITION BY symbol ORDER BY k)), 6) AS p_holm FROM k")
def holm(spark, sf):
    """p of each symbol's median z by horizon, after Holm."""
    s = VR.significance(VR.strided(panel(spark, sf), 60, (2, 5, 15)), "symbol")
    s = s.select("symbol", F.col("q").cast("long").alias("q"), two_sided_p(F.col("median_z")).alias("p"))
    return rounded(M.holm(s, "p", "symbol"), "p", "p_holm")


GATES = QUANT + f", {VR.vr_sql(60, (2, 5, 15))}, sm AS (SELECT symbol, q, count(*) AS n, median(z) AS mz, median(abs(vr_dev)) AS dev FROM vr GROUP BY ALL), sp AS (SELECT *, {two_sided_p_sql('mz')} AS p FROM sm)" + """, lb AS (SELECT symbol, count(DISTINCT label) = 3 AS instrument FROM l WHERE label >= 0 GROUP BY symbol),
g AS (SELECT symbol, bool_or(q = 5) AS target, bool_and(p > 0.001) AS size, max(dev) - min(dev) < 0.3 AS transport, min(n) >= 9 AS power, max(CASE WHEN q = 15 AND p < 0.9 THEN p > 0.05 END) AS value FROM sp GROUP BY symbol)"""


@query(GATES + " SELECT g.symbol, CASE WHEN NOT coalesce(instrument, true) THEN 'instrument_failure' WHEN NOT target THEN 'target_failure' WHEN NOT size THEN 'size_failure' WHEN NOT transport THEN 'transport_failure' WHEN NOT power THEN 'power_failure' WHEN NOT value THEN 'value_failure' WHEN instrument IS NULL OR value IS NULL THEN 'incomplete' ELSE 'admissible' END AS disposition FROM g LEFT JOIN lb USING (symbol)")
def certificate(spark, sf):
    """Each symbol's disposition from what its labels and variance ratios show."""
    s = VR.significance(VR.strided(panel(spark, sf), 60, (2, 5, 15)), "symbol").withColumn("p", two_sided_p(F.col("median_z")))
    of = F.when((F.col("q") == 15) & (F.col("p") < 0.9), F.col("p") > 0.05)
    g = s.groupBy("symbol").agg(F.bool_or(F.col("q") == 5).alias("target"), F.bool_and(F.col("p") > 0.001).alias("size"), (F.max("median_dev") - F.min("median_dev") < 0.3).alias("transport"), (F.min("n") >= 9).alias("power"), F.max(of).alias("value"))
    lb = labels(spark, sf).filter("label >= 0").groupBy("symbol").agg((F.count_distinct("label") == 3).alias("instrument"))
    return M.certificate(g.join(lb, "symbol", "left")).select("symbol", "disposition")


@query(RET + """, x AS (SELECT symbol, idx, r, row_number() OVER (PARTITION BY symbol ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r), b AS (SELECT unnest(range(0, 200)) AS rep),
s AS (SELECT DISTINCT symbol, rep, blk, (('0x' || substr(sha256(symbol || '|' || rep || '|' || blk), 1, 15))::BIGINT) % n AS start, n FROM x, b, LATERAL (SELECT unnest(range(0, (n + 19) // 20)) AS blk)),
g AS (SELECT symbol, rep, (start + k) % n AS i FROM s, (SELECT unnest(range(0, 20)) AS k) WHERE blk * 20 + k < n), m AS (SELECT g.symbol, rep, avg(r) AS m FROM g JOIN x USING (symbol, i) GROUP BY ALL)
SELECT symbol, count(*) AS reps, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m GROUP BY symbol""")
def block_bootstrap(spark, sf):
    from ..operators.resample import block_bootstrap_ci

    b = panel(spark, sf).select("symbol", "idx", W.log_return().alias("r"))
    return rounded(block_bootstrap_ci(b, "r").select("symbol", "reps", "lo", "hi"), "lo", "hi")


@query()
def permutation_null(spark, sf):
    from ..operators.resample import permutation_p

    return permutation_p(label_pair(spark, sf), "x", "y")


@query()
def injection_power(spark, sf):
    """Detection share of the cascade by phi, on paths made of the returns of all lines, whose structure is taken out."""
    from ..operators.resample import power_grid_on

    b = panel(spark, sf).withColumn("r", W.log_return()).filter("idx > 0")
    return power_grid_on(b, "r", (0.0, 0.3, 0.6))


@query()
def backtest_trades(spark, sf):
    from ..operators.strategy import backtest

    b = panel(spark, sf).withColumn("close", 100 + F.col("close") / 100).withColumn("open", 100 + F.col("open") / 100).withColumn("signal", 0.1 * F.signum(F.col("close") - W.full(F.avg, F.col("close"), 20)))
    trades, _ = backtest(b.withColumn("signal", F.coalesce("signal", F.lit(0.0))), "signal")
    return trades.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.avg((F.col("pnl") > 0).cast("int")), 6).alias("win_rate"))


@query(f"""WITH {PANEL_SQL}, {VR.vr_sql(60, (5,))}, ok AS (SELECT symbol, win AS idx, z < 0 AS ok, row_number() OVER (PARTITION BY symbol ORDER BY win) AS k FROM vr WHERE z IS NOT NULL),
tw AS (SELECT *, lag(ok) OVER (PARTITION BY symbol ORDER BY k) AS before FROM ok), ad AS (SELECT symbol, min(k) FILTER (ok AND before AND k >= 3) AS admit FROM tw GROUP BY symbol),
rv AS (SELECT symbol, admit, min(k) FILTER (NOT ok AND NOT before AND k >= admit + 2) AS revoke FROM tw JOIN ad USING (symbol) GROUP BY ALL)
SELECT symbol, idx, ok, CASE WHEN k = 1 THEN 'warmup' WHEN admit IS NULL OR k < admit THEN 'non_admitted' WHEN revoke IS NULL OR k < revoke THEN 'admissible' ELSE 'revoked' END AS state FROM ok JOIN rv USING (symbol)""")
def admission_states(spark, sf):
    from ..operators.strategy import admission_path

    v = VR.strided(panel(spark, sf), 60, (5,)).select("symbol", F.col("win").alias("idx"), (F.col("z") < 0).alias("ok"))
    return admission_path(v.filter("ok IS NOT NULL"))
