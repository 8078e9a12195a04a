"""Queries over studies: autocorrelation, survival, information bounds, performance, grids, repairs, replays, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import two_sided_p, two_sided_p_sql
from ..operators import measures as M, rebar, studies as S, variance_ratio as VR, windows as W
from ..sources.bars import MINUTE, PANEL_SQL, by_symbol, epoch_ms, event_bars, event_bars_sql, panel, slot
from ..sources.shared import materialize
from .benchmark import ROLLED
from .clocks import PARTS, greedy_sql
from .common import query, rounded
from .features import EMA, QUANT, RECURSIVE, RET, labels
from .inference import TWO, _two

HOUR = 60 * MINUTE
HOURS = event_bars_sql(HOUR, "event_type")


def hours(spark, sf):
    return event_bars(spark, sf, HOUR, F.col("event_type"))


def returns(spark, sf):
    return panel(spark, sf).withColumn("r", W.log_return())


_AC = " + ".join(f"abs(a{k} / ss)" for k in range(1, 5))
_LB = " + ".join(f"(a{k} / ss) ** 2 / (n - {k})" for k in range(1, 5))


@query(RET + ", c AS (SELECT symbol, idx, r - avg(r) OVER (PARTITION BY symbol) AS c FROM r), g AS (SELECT symbol, c, " + ", ".join(f"c * lag(c, {k}) OVER w AS l{k}" for k in range(1, 5)) + " FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx)), s AS (SELECT symbol, count(*) AS n, sum(c * c) AS ss, " + ", ".join(f"sum(l{k}) AS a{k}" for k in range(1, 5)) + f" FROM g GROUP BY symbol), q AS (SELECT symbol, n, ({_AC}) / 4 AS m, n * (n + 2) * ({_LB}) AS q FROM s) SELECT symbol, n, round(m, 6) AS mean_abs, round(q, 6) AS lb_q, round(exp(-q / 2) * (1 + q / 2), 6) AS lb_p FROM q")
def autocorrelation(spark, sf):
    return rounded(S.autocorrelations(returns(spark, sf), "r", 4), "mean_abs", "lb_q", "lb_p")


PASSAGE = f"""WITH {PANEL_SQL}, sg AS (SELECT symbol, idx // 60 AS seg, idx % 60 AS k, close FROM panel UNION ALL SELECT symbol, idx // 60 - 1, 60, close FROM panel WHERE idx % 60 = 0 AND idx > 0),
sr AS (SELECT symbol, seg, k, sign(ln(close / first_value(close) OVER (PARTITION BY symbol, seg ORDER BY k))) AS s FROM sg), sf AS (SELECT *, max(CASE WHEN k = 1 THEN s END) OVER (PARTITION BY symbol, seg) AS f FROM sr),
fp AS (SELECT symbol, seg, coalesce(min(CASE WHEN s <> f OR s = 0 THEN k END), 61) AS passage FROM sf WHERE k > 0 GROUP BY ALL HAVING count(*) = 60)"""
CURVE = PASSAGE + ", cu AS (SELECT t, (SELECT avg((passage > t)::INT) FROM fp) AS s, CASE WHEN t > 1 THEN 2 / pi() * asin(sqrt(1 / t)) ELSE 1 END AS s0 FROM (SELECT unnest(range(1, 61)) AS t))"


@query(CURVE + " SELECT t, round(s, 6) AS s, round(s0, 6) AS s0 FROM cu")
def survival_curve(spark, sf):
    return rounded(S.survival(S.first_passages(panel(spark, sf), 60), 60), "s", "s0")


@query(CURVE + " SELECT round(-regr_slope(ln(s), ln(t)) FILTER (WHERE s > 0), 6) AS theta, round((SELECT max(abs(s - s0)) FROM cu), 6) AS ks FROM cu WHERE s > 0")
def persistence_fit(spark, sf):
    return rounded(S.survival_fit(S.survival(S.first_passages(panel(spark, sf), 60), 60)), "theta", "ks")


COSTS = [0.0, 1.8, 4.5, 9.0, 10.0, 20.0]


@query(RET + f", g AS (SELECT symbol, avg(abs(r)) * 1e2 AS g FROM r GROUP BY symbol), p AS (SELECT symbol, c AS cost, g - ln(1 + c) AS y FROM g, (SELECT unnest({COSTS}) AS c)), l AS (SELECT *, lead(cost) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY symbol ORDER BY cost)) SELECT symbol, round(min_by(cost - y * (x1 - cost) / (y1 - y), cost) FILTER (WHERE y1 IS NOT NULL AND (y > 0) <> (y1 > 0)), 6) AS break_even FROM l GROUP BY symbol")
def break_even(spark, sf):
    g = returns(spark, sf).groupBy("symbol").agg((F.avg(F.abs("r")) * 1e2).alias("g")).withColumn("cost", F.explode(F.array(*map(F.lit, COSTS))))
    return rounded(S.break_even(g.select("symbol", "cost", (F.col("g") - F.ln(1 + F.col("cost"))).alias("total_return")), "symbol"), "break_even")


@query(ROLLED + ", h AS (SELECT q, median(abs(vr_dev)) AS d FROM vr GROUP BY q), m AS (SELECT *, greatest(-0.5 * ln(1 - least(d / (2 * (1 - 1.0::DOUBLE / q)), 1 - 1e-12) ** 2), 0) AS mi FROM h) SELECT q::BIGINT AS q, round(d, 6) AS departure, round(mi, 6) AS mi, round(1e4 * mi, 3) AS gross_bps, CASE WHEN 1e4 * mi < 9 THEN 'demon_runs_at_loss' ELSE 'bound_exceeds_costs' END AS verdict FROM m")
def information_bound(spark, sf):
    v = VR.departure(VR.rolling(panel(spark, sf), 60, (2, 5)), "departure").drop("n")
    v = v.withColumn("mi", S.gaussian_information(F.col("departure"), F.col("q"))).withColumn("gross_bps", 1e4 * F.col("mi"))
    return rounded(rounded(v.withColumn("verdict", S.bound_verdict(F.col("gross_bps"))), "gross_bps", digits=3), "departure", "mi")


@query(RET + """, s AS (SELECT symbol, idx, r, lead(close) OVER (PARTITION BY symbol ORDER BY idx) / close - 1 AS f FROM r), k AS (SELECT symbol, idx, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY f) + (count(*) OVER (PARTITION BY symbol, f) - 1) / 2 AS b FROM s WHERE f IS NOT NULL)
SELECT symbol, idx, round((a - avg(a) OVER w) / stddev_pop(a) OVER w * (b - avg(b) OVER w) / stddev_pop(b) OVER w, 5) AS rank_product FROM k WINDOW w AS (PARTITION BY symbol)""")
def rank_product(spark, sf):
    b = panel(spark, sf).select("symbol", "idx", W.log_return().alias("r"), W.forward_return().alias("f"))
    return rounded(S.rank_products(b, "r", "f", "symbol").select("symbol", "idx", "rank_product"), "rank_product", digits=5)


def _ic_sql(x, y, source, by="name"):
    return f"rk_ AS (SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2 AS a, rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2 AS b FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) SELECT {by}, count(*) AS n, CASE WHEN count(*) >= 10 THEN round(corr(a, b), 6) END AS ic FROM rk_ GROUP BY {by}"


@query(QUANT + ", x AS (SELECT l.symbol, l.idx, l.label, r.r, lead(r.close, 5) OVER (PARTITION BY l.symbol ORDER BY l.idx) / r.close - 1 AS f FROM l JOIN r USING (symbol, idx)), m AS (SELECT 'all' AS name, r, f FROM x UNION ALL SELECT 'low', r, f FROM x WHERE label = 0 UNION ALL SELECT 'high', r, f FROM x WHERE label = 1 UNION ALL SELECT 'late', r, f FROM x WHERE idx >= 300), " + _ic_sql("r", "f", "m"))
def ic_by_mask(spark, sf):
    x = labels(spark, sf).withColumns({"r": W.log_return(), "f": W.forward_return(5)})
    masks = {"all": F.lit(True), "low": F.col("label") == 0, "high": F.col("label") == 1, "late": F.col("idx") >= 300}
    return rounded(M.spearman_by_mask(x, "r", "f", masks), "ic")


LEAD = f"WITH {TWO}, j AS (SELECT ts, ln(x / lag(x) OVER w) AS rx, ln(y / lag(y) OVER w) AS ry FROM a JOIN b USING (ts) WINDOW w AS (ORDER BY ts)), k AS (SELECT *, lead(rx) OVER w AS nx, lead(ry) OVER w AS ny FROM j WINDOW w AS (ORDER BY ts)), th AS (SELECT quantile_cont(abs(rx), 0.9) AS thr FROM k WHERE rx IS NOT NULL)"


@query(LEAD + ", m AS (SELECT 'x_leads_y' AS name, rx AS s, ny AS f FROM k UNION ALL SELECT 'y_leads_x', ry, nx FROM k UNION ALL SELECT 'x_impulse_leads_y', CASE WHEN abs(rx) >= thr THEN sign(rx) END, ny FROM k, th), " + _ic_sql("s", "f", "m"))
def lead_lag(spark, sf):
    from ..operators.joins import same_time

    w = Window.partitionBy("all").orderBy("ts")  # two series on an hourly grid
    j = same_time(*_two(spark, sf)).withColumn("all", F.lit(0))
    j = j.withColumns({"rx": F.ln(F.col("x") / F.lag("x").over(w)), "ry": F.ln(F.col("y") / F.lag("y").over(w))})
    j = j.withColumns({"nx": F.lead("rx").over(w), "ny": F.lead("ry").over(w)})
    thr = j.agg(F.percentile(F.abs("rx"), F.lit(0.9)).alias("thr"))
    j = j.crossJoin(F.broadcast(thr))  # one row
    impulse = F.when(F.abs("rx") >= F.col("thr"), F.signum("rx"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("s"), F.col(f).alias("f")) for n, s, f in (("x_leads_y", F.col("rx"), "ny"), ("y_leads_x", F.col("ry"), "nx"), ("x_impulse_leads_y", impulse, "ny"))]))
    return rounded(M.spearman(j.select(each.alias("e")).select("e.*"), "s", "f", "name", few=True), "ic")


@query(f"""WITH {TWO}, j AS (SELECT 0 AS symbol, row_number() OVER (ORDER BY ts) - 1 AS idx, ln(x) AS lx, ln(y) AS ly FROM a JOIN b USING (ts)), o AS (SELECT *, count(*) OVER f AS n, avg(lx) OVER f AS mx, avg(ly) OVER f AS my, avg(lx * lx) OVER f - (avg(lx) OVER f) ** 2 AS v, avg(lx * ly) OVER f - avg(lx) OVER f * avg(ly) OVER f AS cv FROM j WINDOW f AS (ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
s AS (SELECT idx, CASE WHEN n = 24 AND v > 1e-18 THEN cv / v END AS beta, CASE WHEN n = 24 AND v > 1e-18 THEN ly - (my - cv / v * mx) - cv / v * lx END AS spread FROM o), z AS (SELECT *, CASE WHEN count(spread) OVER f = 24 THEN (spread - avg(spread) OVER f) / nullif(stddev_pop(spread) OVER f, 0) END AS z, lead(spread) OVER (ORDER BY idx) - spread AS fwd, lag(spread) OVER (ORDER BY idx) AS p FROM s WINDOW f AS (ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
i AS (SELECT rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS a, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2 AS b FROM z WHERE z IS NOT NULL AND fwd IS NOT NULL), c AS (SELECT count(*) AS n, corr(a, b) AS ic FROM i), h AS (SELECT regr_slope(spread, p) AS phi, median(beta) AS beta FROM z)
SELECT n, round(ic, 5) AS ic, round(phi, 5) AS phi, CASE WHEN phi > 0 AND phi < 1 THEN round(-ln(2) / ln(phi), 5) END AS half_life, round(beta, 5) AS beta FROM c, h WHERE n > 0""")
def spread_reversion(spark, sf):
    from ..operators.joins import same_time

    j = same_time(*_two(spark, sf)).withColumn("symbol", F.lit(0))
    j = j.select("symbol", (F.row_number().over(by_symbol("ts")) - 1).alias("idx"), F.ln("x").alias("lx"), F.ln("y").alias("ly"))
    alpha, beta = W.rolling_ols(F.col("ly"), F.col("lx"), 24)
    j = j.withColumns({"beta": beta, "spread": F.col("ly") - alpha - beta * F.col("lx")})
    j = j.withColumns({"z": W.zscore(F.col("spread"), 24), "fwd": F.lead("spread").over(by_symbol()) - F.col("spread"), "p": F.lag("spread").over(by_symbol())})
    ic = M.spearman(j, "z", "fwd", "symbol").select("symbol", "n", "ic")
    fit = j.groupBy("symbol").agg(F.regr_slope("spread", "p").alias("phi"), F.percentile("beta", F.lit(0.5)).alias("beta"))
    out = ic.join(fit, "symbol").withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -F.ln(F.lit(2.0)) / F.ln("phi")))
    return rounded(out.select("n", "ic", "phi", "half_life", "beta"), "ic", "phi", "half_life", "beta", digits=5)


@query(f"""WITH {event_bars_sql(5 * MINUTE)}, f AS (SELECT 5 AS freq UNION ALL SELECT 60 UNION ALL SELECT 240), g AS (SELECT freq AS name, ts // (freq * 60000) * (freq * 60000) AS t, arg_max(close, ts) AS close, sum(volume) AS volume, max(high) AS high, min(low) AS low FROM bars, f GROUP BY ALL),
v AS (SELECT name, t, close, CASE WHEN count(*) OVER w = 6 THEN sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) END AS vwap, lead(close) OVER (PARTITION BY name ORDER BY t) / close - 1 AS fwd FROM g WINDOW w AS (PARTITION BY name ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), x AS (SELECT name, close / vwap - 1 AS s, fwd AS f FROM v WHERE vwap > 0), """ + _ic_sql("s", "f", "x"))
def multi_horizon_ic(spark, sf):
    """Rank correlation of the deviation from the rolling price with the next return, by bar length."""
    parts = None
    for freq in (5, 60, 240):
        b = rebar.resample(event_bars(spark, sf, 5 * MINUTE), freq * MINUTE).withColumn("idx", F.row_number().over(by_symbol("ts")))
        b = b.withColumn("vwap", W.vwap(6)).withColumn("f", W.forward_return()).filter("vwap > 0")
        b = b.select(F.lit(freq).alias("name"), (F.col("close") / F.col("vwap") - 1).alias("s"), "f")
        parts = b if parts is None else parts.unionByName(b)
    return rounded(M.spearman(parts, "s", "f", "name", few=True), "ic")


EQUITY = f"WITH {HOURS}, eq AS (SELECT symbol, ts, close * 1e4 AS equity FROM bars), dl AS (SELECT symbol, ts // 86400000 AS day, arg_max(equity, ts) AS last FROM eq GROUP BY ALL), dr AS (SELECT *, lag(last) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM dl)"


def equity(spark, sf):
    return hours(spark, sf).select("symbol", "ts", (F.col("close") * 1e4).alias("equity"))


@query(EQUITY + " SELECT symbol, day, round(last / prev - 1, 6) AS r FROM dr WHERE prev IS NOT NULL")
def day_returns(spark, sf):
    return rounded(S.day_returns(equity(spark, sf)).filter("r IS NOT NULL").select("symbol", "day", "r"), "r")


@query(EQUITY + """, s AS (SELECT symbol, count(prev) AS n, avg(last / prev - 1) AS m, stddev_samp(last / prev - 1) AS sd, stddev_samp(last / prev - 1) FILTER (WHERE last / prev < 1) AS down, avg(last / coalesce(prev, 1e6) - 1) AS em, stddev_pop(last / coalesce(prev, 1e6) - 1) AS es, arg_max(last, day) / 1e6 - 1 AS tr FROM dr GROUP BY symbol),
dd AS (SELECT symbol, max(d) AS dd FROM (SELECT symbol, (max(equity) OVER w - equity) / max(equity) OVER w AS d FROM eq WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY symbol)
SELECT symbol, n, round(sqrt(365) * m / sd, 6) AS sharpe, round(sqrt(365) * m / down, 6) AS sortino, round(sqrt(365) * em / es, 6) AS engine_sharpe, round(tr, 6) AS total_return, round(dd, 6) AS max_drawdown, round(((1 + tr) ** (1 / (30.0::DOUBLE / 365)) - 1) / dd, 5) AS calmar FROM s JOIN dd USING (symbol)""")
def risk_report(spark, sf):
    p = S.performance(equity(spark, sf), 1e6, 30 / 365)
    return rounded(rounded(p, "calmar", digits=5), "sharpe", "sortino", "engine_sharpe", "total_return", "max_drawdown")


EVAL = f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5))}, pv AS (SELECT symbol, q, {two_sided_p_sql('z')} AS p FROM vr)"


@query(EVAL + " SELECT symbol, round(sum(ln(0.5 * greatest(p, 1e-6) ** -0.5)), 5) AS log_e_product, round(avg(0.5 * greatest(p, 1e-6) ** -0.5), 5) AS e_average FROM pv GROUP BY symbol")
def e_values(spark, sf):
    """e-values of a symbol's windows, multiplied (as a logarithm) and averaged; a p under a millionth counts as that."""
    p = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL").withColumn("p", F.greatest(two_sided_p(F.col("z")), F.lit(1e-6)))
    e = M.e_value(F.col("p"))
    return rounded(p.groupBy("symbol").agg(F.sum(F.ln(e)).alias("log_e_product"), F.avg(e).alias("e_average")), "log_e_product", "e_average", digits=5)


GRID = [(60, 2), (120, 5), (240, 15), (480, 60)]


@query(f"""WITH {HOURS}, d AS (SELECT symbol, (ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) / 60000 AS d FROM bars), m AS (SELECT symbol, count(d) AS n, median(d) / 7 AS m FROM d GROUP BY symbol), g AS (SELECT symbol, m, c[1] AS w, c[2] AS q FROM m, (SELECT unnest({[list(x) for x in GRID]}) AS c)),
r AS (SELECT *, round_even(q * (1 / m), 0)::BIGINT AS qr, round_even(w * (1 / m), 0)::BIGINT AS wr FROM g) SELECT symbol, w AS "W_clock", q AS q_clock, round(1 / m, 6) AS scale, greatest(2, qr) AS q_adj, greatest(greatest(2, qr) + 10, wr) AS "W_adj", qr < 2 OR wr < greatest(2, qr) + 10 AS truncated FROM r""")
def calendar_grid(spark, sf):
    d = rebar.durations(hours(spark, sf)).select("symbol", (F.col("median_min") / 7).alias("median_min"))
    return rounded(S.calendar_grid(d, GRID).drop("median_min"), "scale")


@query("""WITH g AS (SELECT * FROM (SELECT DISTINCT l_discount AS d FROM lineitem), (SELECT DISTINCT l_linenumber AS q FROM lineitem), (SELECT DISTINCT 60 * (year(l_shipdate) - 1990) AS w FROM lineitem))
SELECT d, q, w, 900 + (row_number() OVER (ORDER BY d, q, w) - 1) AS idx, 'd=' || d || ' q=' || q || ' W=' || w AS cell FROM g""")
def grid_index(spark, sf):
    """Numbers of the cells of a grid, and their names; its sides are what the lines have of discounts, numbers and years."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    sides = {"d": F.col("l_discount"), "q": F.col("l_linenumber"), "w": (60 * (F.year("l_shipdate") - 1990)).cast("long")}
    grid, idx = None, F.lit(0).cast("long")
    for name, value in sides.items():  # a few values each
        side = lines.select(value.alias(name)).distinct()
        every = side.agg(F.array_sort(F.collect_list(name)).alias("v"))
        side = every.select(F.size("v").cast("long").alias(f"n_{name}"), F.posexplode("v").alias(f"k_{name}", name))
        grid = side if grid is None else grid.crossJoin(F.broadcast(side))
        idx = idx * F.col(f"n_{name}") + F.col(f"k_{name}")
    cell = F.concat(F.lit("d="), F.col("d").cast("string"), F.lit(" q="), F.col("q").cast("string"), F.lit(" W="), F.col("w").cast("string"))
    return grid.select("d", "q", "w", (900 + idx).alias("idx"), cell.alias("cell"))


@query("SELECT c, split_part(c, ':', 1)::INT AS w, split_part(c, ':', 2)::INT AS q, count(*) AS n FROM (SELECT (60 * (1 + c_custkey % 4)) || ':' || [2, 5, 15][(c_custkey % 3 + 1)::INT] AS c FROM customer) GROUP BY ALL")
def cell_names(spark, sf):
    """Cells parsed from their names W:q."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat((60 * (1 + k % 4)).cast("string"), F.lit(":"), F.element_at(F.array(F.lit("2"), F.lit("5"), F.lit("15")), (k % 3 + 1).cast("int"))).alias("c"))
    p = F.split("c", ":")
    return c.select("c", p[0].cast("int").alias("w"), p[1].cast("int").alias("q")).groupBy("c", "w", "q").agg(F.count("*").alias("n"))


@query(f"WITH {HOURS}, c AS (SELECT symbol, ts // 28800000 > lag(ts) OVER (PARTITION BY symbol ORDER BY ts) // 28800000 AS f FROM bars) SELECT symbol, sum(f::INT)::BIGINT AS fundings FROM c GROUP BY symbol")
def funding_crossings(spark, sf):
    part = slot("ts", 28800000)
    return hours(spark, sf).withColumn("f", part > F.lag(part).over(by_symbol("ts"))).groupBy("symbol").agg(F.sum(F.col("f").cast("long")).alias("fundings"))


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5))}, dr AS (SELECT q AS cell, win AS delta, symbol AS draw, z FROM vr WHERE z IS NOT NULL), fi AS (SELECT cell, avg(z) AS center, stddev_samp(z) AS sd FROM dr WHERE delta = 0 AND draw % 2 = 0 GROUP BY cell)" + " SELECT cell::BIGINT AS cell, delta, round(center, 6) AS center, round(sd, 6) AS sd, count(*) AS n, round(avg((z > 1.959963984540054)::INT), 6) AS p_raw, round(avg(((z - center) / sd > 1.6448536269514722)::INT), 6) AS p_det FROM dr JOIN fi USING (cell) WHERE delta > 0 OR draw % 2 = 1 GROUP BY ALL")
def recentred_repair(spark, sf):
    """Windows as draws: the first window of each symbol is the null, the later ones are injections of growing size."""
    v = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL")
    d = v.select(F.col("q").cast("long").alias("cell"), F.col("win").alias("delta"), F.col("symbol").alias("draw"), "z")
    return rounded(S.recentred(d, 0), "center", "sd", "p_raw", "p_det")


YEARLY = f"WITH {PANEL_SQL}, iy AS (SELECT symbol, year, corr(close, volume) AS ic FROM panel GROUP BY ALL HAVING count(*) >= 10)"


@query(YEARLY + " SELECT symbol, count(*) AS years, bool_and(ic > 0) OR bool_and(ic < 0) AS stable, CASE WHEN bool_and(ic > 0) OR bool_and(ic < 0) THEN 'GO' ELSE 'NO-GO' END AS verdict FROM iy GROUP BY symbol")
def go_no_go(spark, sf):
    y = panel(spark, sf).groupBy("symbol", "year").agg(F.corr("close", "volume").alias("ic"), F.count("*").alias("n")).filter("n >= 10")
    g = y.groupBy("symbol").agg(F.count("*").alias("years"), S.same_sign(F.col("ic")).alias("stable"))
    return g.withColumn("verdict", F.when(F.col("stable"), "GO").otherwise("NO-GO"))


@query(f"WITH {PANEL_SQL}, a AS (SELECT symbol, count(*)::DOUBLE AS n, sum(volume)::DOUBLE AS v FROM panel WHERE year < 1996 GROUP BY symbol), b AS (SELECT symbol, count(*)::DOUBLE AS n, sum(volume)::DOUBLE AS v FROM panel WHERE year >= 1996 AND volume > 10 GROUP BY symbol), j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.n AS an, b.n AS bn, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a.symbol = b.symbol), u AS (SELECT symbol, 'n' AS field, an AS a, bn AS b FROM j UNION ALL SELECT symbol, 'v', av, bv FROM j) SELECT symbol, field, round(a, 4) AS a, round(b, 4) AS b, round(abs(a - b), 4) AS abs_diff, round(abs(a - b) / abs(b) * 100, 6) AS rel_pct, coalesce(abs(a - b) <= 0.15 * abs(b), false) AS close FROM u")
def parity(spark, sf):
    """Field by field, two runs' figures by symbol, and whether they are within 15 percent."""
    p = panel(spark, sf)
    side = lambda d: d.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("v"))
    d = S.field_differences(side(p.filter("year < 1996")), side(p.filter("year >= 1996 AND volume > 10")), "symbol", ["n", "v"])
    d = d.withColumn("close", F.coalesce(F.col("abs_diff") <= 0.15 * F.abs("b"), F.lit(False)))
    return rounded(rounded(d, "a", "b", "abs_diff", digits=4), "rel_pct")


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5, 15))}, ci AS (SELECT q, quantile_cont(abs(vr_dev), 0.25) AS lo, quantile_cont(abs(vr_dev), 0.75) AS hi FROM vr GROUP BY q) SELECT x.q::BIGINT AS q_1, y.q::BIGINT AS q_2, NOT (x.hi < y.lo OR y.hi < x.lo) AS overlap FROM ci x JOIN ci y ON x.q < y.q")
def interval_overlap(spark, sf):
    from ..operators.joins import ordered_pairs

    v = VR.strided(panel(spark, sf), 60, (2, 5, 15)).filter("vr_dev IS NOT NULL")
    ci = v.groupBy(F.col("q").cast("long").alias("q")).agg(F.percentile(F.abs("vr_dev"), F.lit(0.25)).alias("lo"), F.percentile(F.abs("vr_dev"), F.lit(0.75)).alias("hi"))
    p = ordered_pairs(ci, "q", ["lo", "hi"])
    return p.select("q_1", "q_2", S.overlaps(F.col("lo_1"), F.col("hi_1"), F.col("lo_2"), F.col("hi_2")).alias("overlap"))


@query(f"WITH {PANEL_SQL}, a AS (SELECT symbol, median(close) AS m FROM panel WHERE year = 1995 AND close > 1950 GROUP BY symbol), b AS (SELECT symbol, median(close) AS m FROM panel WHERE year = 1996 AND close > 1900 GROUP BY symbol), k AS (SELECT DISTINCT symbol FROM panel) SELECT symbol, round(coalesce(a.m, b.m), 6) AS m, CASE WHEN a.m IS NOT NULL THEN 'primary' WHEN b.m IS NOT NULL THEN 'fallback' ELSE 'none' END AS origin FROM k LEFT JOIN a USING (symbol) LEFT JOIN b USING (symbol)")
def fallback_lookup(spark, sf):
    """A symbol's cell from the primary table, else from the other: medians of dear bars, which not every symbol has."""
    p = panel(spark, sf)
    side = lambda d, n: d.groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias(n))
    j = p.select("symbol").distinct().join(side(p.filter("year = 1995 AND close > 1950"), "a"), "symbol", "left").join(side(p.filter("year = 1996 AND close > 1900"), "b"), "symbol", "left")
    origin = F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "fallback").otherwise("none")
    return rounded(j.select("symbol", F.coalesce("a", "b").alias("m"), origin.alias("origin")), "m")


@query(f"WITH {HOURS}, f AS (SELECT ts, ln(lead(close, 3) OVER (ORDER BY ts) / close) AS fwd FROM bars WHERE symbol = 'view') SELECT c.ts, round(f.fwd, 6) AS fwd FROM bars c LEFT JOIN f ON c.ts = f.ts WHERE c.symbol = 'click'")
def forward_lookup(spark, sf):
    """Forward returns of one series at the times of another, null where it has none."""
    h = hours(spark, sf)
    f = h.filter("symbol = 'view'").withColumn("fwd", F.ln(F.lead("close", 3).over(by_symbol("ts")) / F.col("close"))).select("ts", "fwd")
    return rounded(h.filter("symbol = 'click'").select("ts").join(f, "ts", "left"), "fwd")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_ms(ts) // 60000, event_id) - 1 AS place, event_type FROM events")
def stable_order(spark, sf):
    """Events in order of their minute, equal minutes in the order they came."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", epoch_ms("ts").alias("ts"), "event_type")
    w = Window.partitionBy("event_type").orderBy(slot("ts", MINUTE), "event_id")
    return e.withColumn("place", F.row_number().over(w) - 1).drop("ts")


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5))}, k AS (SELECT symbol, q, win, z, row_number() OVER (PARTITION BY symbol, q ORDER BY z DESC, win) AS k FROM vr) SELECT symbol, q::BIGINT AS q, arg_max(win, (z, -win)) AS best, round(max(z), 6) AS best_z, round(max(z) - min(z), 6) AS spread FROM k WHERE k <= 5 GROUP BY ALL")
def best_restarts(spark, sf):
    """The best of several runs, and how far the best five are apart."""
    v = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL")
    v = v.withColumn("k", F.row_number().over(Window.partitionBy("symbol", "q").orderBy(F.desc("z"), "win"))).filter("k <= 5")
    return rounded(v.groupBy("symbol", F.col("q").cast("long").alias("q")).agg(F.max_by("win", F.struct("z", -F.col("win"))).alias("best"), F.max("z").alias("best_z"), (F.max("z") - F.min("z")).alias("spread")), "best_z", "spread")


@query(f"WITH {PANEL_SQL}, v AS (SELECT symbol, idx % 3 AS state, var_samp(close) AS v FROM panel GROUP BY ALL) SELECT symbol, state, row_number() OVER (PARTITION BY symbol ORDER BY v, state) - 1 AS ordered FROM v")
def relabel_by_variance(spark, sf):
    """States renumbered by rising variance."""
    v = panel(spark, sf).groupBy("symbol", (F.col("idx") % 3).alias("state")).agg(F.var_samp("close").alias("v"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("v", "state")).over(Window.partitionBy("symbol"))), lambda x: x["state"])  # a few states
    return v.select("symbol", "state", (F.array_position(order, F.col("state")) - 1).alias("ordered"))


@query("SELECT source, max(doc_id) AS latest, arg_max(lang, doc_id) AS lang FROM documents WHERE source IS NOT NULL GROUP BY source")
def latest_artifact(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("source IS NOT NULL")
    return d.groupBy("source").agg(F.max("doc_id").alias("latest"), F.max_by("lang", "doc_id").alias("lang"))


@query("SELECT c_nationkey % 5 AS w, c_custkey % 3 AS q FROM customer UNION SELECT s_nationkey % 7, s_suppkey % 2 FROM supplier")
def cell_union(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_nationkey") % 5).alias("w"), (F.col("c_custkey") % 3).alias("q"))
    s = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_nationkey") % 7).alias("w"), (F.col("s_suppkey") % 2).alias("q"))
    return c.union(s).distinct()


@query(f"WITH {PANEL_SQL} SELECT symbol, count(*) FILTER (WHERE year < 1998) AS n_in, count(*) FILTER (WHERE year >= 1998) AS n_held, count(*) FILTER (WHERE year >= 1998) = 0 AS clean, count(*) FILTER (WHERE year >= 1998) > 0 AND count(*) FILTER (WHERE year < 1998) > 0 AS partial FROM panel GROUP BY symbol")
def holdout_guard(spark, sf):
    from ..operators.clean import holdout

    return holdout(panel(spark, sf), 1998)


CRISES = [("early", 1704412800000, 1704844800000), ("late", 1705708800000, 1706313600000)]


@query(f"WITH {HOURS}, q AS (SELECT symbol, quantile_cont(volume, 0.95) AS hi FROM bars GROUP BY symbol), c(name, a, b) AS (VALUES {', '.join(map(str, CRISES))}) SELECT name, symbol, count(*) AS n, sum((volume > hi)::INT)::BIGINT AS extreme, round(max(volume), 6) AS peak, arg_max(ts, (volume, -ts)) AS peak_ts FROM bars JOIN q USING (symbol) JOIN c ON ts BETWEEN a AND b GROUP BY ALL")
def crisis_windows(spark, sf):
    """Named windows: bars, extreme ones, the peak and its time."""
    from ..operators.joins import in_intervals

    b = hours(spark, sf)
    b = b.join(b.groupBy("symbol").agg(F.percentile("volume", F.lit(0.95)).alias("hi")), "symbol")
    d = in_intervals(b, spark.createDataFrame(CRISES, "name string, start long, end long"), "ts")
    return rounded(d.groupBy("name", "symbol").agg(F.count("*").alias("n"), F.sum((F.col("volume") > F.col("hi")).cast("long")).alias("extreme"), F.max("volume").alias("peak"), F.max_by("ts", F.struct("volume", -F.col("ts"))).alias("peak_ts")), "peak")


@query(f"""WITH {HOURS}, d AS (SELECT unnest(range(1704499200000, 1706486400001, 259200000)) AS decision), s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars), g AS (SELECT symbol, decision, min(idx) AS window_start, max(idx) AS decision_idx, max(ts) AS decision_ts FROM s JOIN d ON ts BETWEEN decision - 604800000 AND decision GROUP BY ALL)
SELECT *, decision_idx - 24 AS matured_end FROM g WHERE window_start <= decision_idx - 24 AND decision_idx >= 24""")
def replay_windows(spark, sf):
    b = hours(spark, sf).withColumn("idx", F.row_number().over(by_symbol("ts")) - 1)
    return S.replay_windows(b, 1704499200000, 1706486400000, 604800000, 259200000, 24)


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5))}, m AS (SELECT q AS gate, symbol AS rep, max(z) AS top FROM vr WHERE z IS NOT NULL GROUP BY ALL), l AS (SELECT gate, list(top ORDER BY top) AS s, count(*) AS n FROM m GROUP BY gate) SELECT gate::BIGINT AS gate, round(s[ceil(0.95 * (n - 1))::INT + 1], 6) AS threshold FROM l")
def max_thresholds(spark, sf):
    v = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL").select(F.col("q").cast("long").alias("gate"), F.col("symbol").alias("rep"), F.col("z").alias("value"))
    return rounded(S.max_thresholds(v, 0.05), "threshold")


@query(EVAL + ", g AS (SELECT symbol, max(CASE WHEN q = 2 THEN p END) AS a, max(CASE WHEN q = 5 THEN p END) AS b FROM pv GROUP BY symbol) SELECT symbol, coalesce(a > 0.9, false) AS short, coalesce(b > 0.9, false) AS long FROM g")
def gate_vector(spark, sf):
    """Each gate passes if its statistic is above its threshold; one that is missing doesn't."""
    p = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL").withColumn("p", two_sided_p(F.col("z")))
    g = p.groupBy("symbol").agg(F.max(F.when(F.col("q") == 2, F.col("p"))).alias("a"), F.max(F.when(F.col("q") == 5, F.col("p"))).alias("b"))
    return g.select("symbol", F.coalesce(F.col("a") > 0.9, F.lit(False)).alias("short"), F.coalesce(F.col("b") > 0.9, F.lit(False)).alias("long"))


NULLS = f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5))}, md AS (SELECT symbol, q, median(z) AS z FROM vr WHERE z IS NOT NULL GROUP BY ALL)"


@query(NULLS + f" SELECT q::BIGINT AS q, count(*) AS n, round(quantile_cont(z, 0.05), 6) AS p05, round(quantile_cont(z, 0.5), 6) AS p50, round(quantile_cont(z, 0.95), 6) AS p95, round(avg((abs(z) > 1.959963984540054)::INT), 6) AS size FROM md GROUP BY q")
def null_summary(spark, sf):
    from ..operators.nulls import summary

    m = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL").groupBy("symbol", F.col("q").cast("long").alias("q")).agg(F.percentile("z", F.lit(0.5)).alias("z"))
    return rounded(summary(m, "z", "q"), "p05", "p50", "p95", "size")


@query(NULLS + " SELECT x.symbol, x.q::BIGINT AS q, round((1 + sum((abs(y.z) >= abs(x.z))::INT)) / (1.0::DOUBLE + count(*)), 6) AS p_two, round((1 + sum((y.z >= x.z)::INT)) / (1.0::DOUBLE + count(*)), 6) AS p_greater FROM md x JOIN md y ON x.q = y.q AND y.symbol % 2 = 1 WHERE x.symbol % 2 = 0 GROUP BY ALL")
def empirical_p(spark, sf):
    """Observed medians of even symbols placed among those of odd ones."""
    from ..operators.nulls import placed

    m = VR.strided(panel(spark, sf), 60, (2, 5)).filter("z IS NOT NULL").groupBy("symbol", F.col("q").cast("long").alias("q")).agg(F.percentile("z", F.lit(0.5)).alias("z"))
    m = materialize(m, "medians")  # read several times
    return rounded(placed(m.filter("symbol % 2 = 0"), m.filter("symbol % 2 = 1").select("q", "z"), "z", "q", few=True).select("symbol", "q", "p_two", "p_greater"), "p_two", "p_greater")


@query(QUANT + ", ends AS (SELECT min(rv) AS lo, max(rv) AS hi FROM v WHERE rv IS NOT NULL) SELECT least(199, floor((rv - lo) / (hi - lo) * 200))::BIGINT AS bin, count(*) AS n FROM v, ends WHERE rv IS NOT NULL GROUP BY ALL")
def histogram(spark, sf):
    """The figure's 200 bins between the least and the largest value."""
    v = W.realized_vol(panel(spark, sf), 20).filter("rv IS NOT NULL").select("rv")
    b = v.agg(F.min("rv").alias("lo"), F.max("rv").alias("hi"))
    x = F.floor((F.col("rv") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 200)
    return v.crossJoin(F.broadcast(b)).groupBy(F.least(F.lit(199), x).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 15))}, g AS (SELECT p.year, vr.q, median(abs(vr_dev)) AS m FROM vr JOIN panel p ON vr.symbol = p.symbol AND vr.end_idx = p.idx GROUP BY ALL) SELECT year, round(max(CASE WHEN q = 2 THEN m END), 6) AS short, round(max(CASE WHEN q = 15 THEN m END), 6) AS long, round(max(CASE WHEN q = 2 THEN m END) / max(CASE WHEN q = 15 THEN m END), 6) AS attenuation FROM g GROUP BY year")
def attenuation(spark, sf):
    """Short against long horizon, the figure's pivot."""
    b = panel(spark, sf)
    v = VR.strided(b, 60, (2, 15)).filter("vr_dev IS NOT NULL").join(b.select("symbol", F.col("idx").alias("end_idx"), "year"), ["symbol", "end_idx"])
    g = v.groupBy("year").agg(F.percentile(F.when(F.col("q") == 2, F.abs("vr_dev")), F.lit(0.5)).alias("short"), F.percentile(F.when(F.col("q") == 15, F.abs("vr_dev")), F.lit(0.5)).alias("long"))
    return rounded(g.withColumn("attenuation", F.col("short") / F.col("long")), "short", "long", "attenuation")


DRAWS = "WITH d AS (SELECT o_custkey % 4 AS w, o_custkey % 3 AS q, o_orderkey % 5 AS delta, o_orderkey AS draw, (o_totalprice - 140000) / 80000 AS z FROM orders)"


def _draws(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select((F.col("o_custkey") % 4).alias("w"), (F.col("o_custkey") % 3).alias("q"), (k % 5).alias("delta"), k.alias("draw"), ((F.col("o_totalprice") - 140000) / 80000).alias("z"))


@query(DRAWS + ", c AS (SELECT w, q, delta, avg((z > 1)::INT) AS p FROM d GROUP BY ALL) SELECT w, q, string_agg(delta || '=' || printf('%.4f', p), ',' ORDER BY delta) AS curve FROM c GROUP BY ALL")
def detection_curves(spark, sf):
    """Detection share by cell, in order of the injected size."""
    c = _draws(spark, sf).groupBy("w", "q", "delta").agg(F.avg((F.col("z") > 1).cast("int")).alias("p"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("delta", "p"))), lambda x: F.concat(x["delta"].cast("string"), F.lit("="), F.format_string("%.4f", x["p"])))
    return c.groupBy("w", "q").agg(F.array_join(text, ",").alias("curve"))


@query(DRAWS + " SELECT w, q, delta, round(median(z), 6) AS median_z, round(max(z), 6) AS max_z, round(avg((z > 1)::INT), 6) AS p_det FROM d GROUP BY w, q, delta")
def z_trend(spark, sf):
    """Median and largest z of each cell's draws, read from one nested array a draw."""
    nested = _draws(spark, sf).groupBy("w", "delta", F.col("draw").alias("draw")).agg(F.collect_list(F.struct("q", "z")).alias("ordered"))
    own = nested.select("w", "delta", F.explode("ordered").alias("x")).select("w", "x.q", "delta", "x.z")
    return rounded(own.groupBy("w", "q", "delta").agg(F.percentile("z", F.lit(0.5)).alias("median_z"), F.max("z").alias("max_z"), F.avg((F.col("z") > 1).cast("int")).alias("p_det")), "median_z", "max_z", "p_det")


@query(QUANT + ", t AS (SELECT label, avg(abs(r)) * 1e4 AS gross, count(*) AS n FROM l JOIN r USING (symbol, idx) WHERE label >= 0 GROUP BY label) SELECT label, round(gross, 4) AS gross_bps, round(n / sum(n) OVER (), 6) AS rate, round(gross - 9, 4) AS net_bps, round(gross - 9 * n / sum(n) OVER (), 4) AS net_per_trigger FROM t")
def net_value(spark, sf):
    """Gross value by state less costs, once a bar and once a trigger."""
    d = labels(spark, sf).withColumn("r", W.log_return()).filter("label >= 0").groupBy("label").agg((F.avg(F.abs("r")) * 1e4).alias("gross_bps"), F.count("*").alias("n"))
    d = d.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # three rows
    d = d.withColumns({"net_bps": F.col("gross_bps") - 9.0, "net_per_trigger": F.col("gross_bps") - 9.0 * F.col("rate")}).drop("n")
    return rounded(rounded(d, "gross_bps", "net_bps", "net_per_trigger", digits=4), "rate")


@query(f"WITH {PANEL_SQL} SELECT symbol, idx // 60 AS seg, CASE WHEN (idx // 60) % 2 = 0 THEN 1 ELSE -1 END AS side, round(CASE WHEN arg_min(close, idx) > 0 AND arg_max(close, idx) > 0 THEN (CASE WHEN (idx // 60) % 2 = 0 THEN 1 ELSE -1 END) * (arg_max(close, idx) / arg_min(close, idx) - 1) ELSE 0 END, 6) AS pnl FROM panel GROUP BY symbol, idx // 60")
def trade_returns(spark, sf):
    """Signed return of a position held for a segment, sides by turns; 0 for prices that aren't positive."""
    g = panel(spark, sf).groupBy("symbol", F.floor(F.col("idx") / 60).alias("seg")).agg(F.min_by("close", "idx").alias("a"), F.max_by("close", "idx").alias("b"))
    side = F.when(F.col("seg") % 2 == 0, 1).otherwise(-1)
    return rounded(g.select("symbol", "seg", side.alias("side"), F.when((F.col("a") > 0) & (F.col("b") > 0), side * (F.col("b") / F.col("a") - 1)).otherwise(0.0).alias("pnl")), "pnl")


@query(QUANT + ", ok AS (SELECT symbol FROM (SELECT symbol, count(DISTINCT label) AS k FROM l WHERE label >= 0 GROUP BY symbol) WHERE k = 3) SELECT x.symbol AS symbol_1, y.symbol AS symbol_2 FROM ok x JOIN ok y ON x.symbol < y.symbol")
def valid_pairs(spark, sf):
    """Pairs of instruments, those whose labels have all states."""
    from ..operators.detectors import rolling_states
    from ..operators.joins import ordered_pairs

    bars = panel(spark, sf).select("symbol", "idx", "close")
    ok = rolling_states(bars, 20, 120).filter("label >= 0").groupBy("symbol").agg(F.count_distinct("label").alias("k")).filter("k = 3").select("symbol")
    return ordered_pairs(ok, "symbol", [], spread=True)


@query(f"WITH {PANEL_SQL}, {VR.vr_sql(60, (5,))}, h AS (SELECT vr.* FROM vr JOIN panel p ON vr.symbol = p.symbol AND vr.end_idx = p.idx WHERE p.year >= 1998), s AS (SELECT count(*) AS n, median(abs(vr_dev)) AS m, median(z) AS mz FROM h)" + f" SELECT n, round(m, 6) AS median_dev, round(mz, 6) AS median_z, round({two_sided_p_sql('mz')}, 6) AS p FROM s")
def holdout_cell(spark, sf):
    """The primary horizon on held-out windows alone."""
    b = panel(spark, sf)
    v = VR.strided(b, 60, (5,)).join(b.filter("year >= 1998").select("symbol", F.col("idx").alias("end_idx")), ["symbol", "end_idx"])
    return rounded(VR.significance(v).select("n", "median_dev", "median_z", two_sided_p(F.col("median_z")).alias("p")), "median_dev", "median_z", "p")


@query("WITH a AS (SELECT l_linenumber AS q, l_suppkey % 5 AS delta, avg(l_discount) AS phi FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL), b AS (SELECT l_linenumber AS q, l_suppkey % 5 AS delta, avg(l_tax) AS phi FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL) SELECT q, delta, round(coalesce(a.phi, b.phi), 6) AS phi FROM a FULL JOIN b USING (q, delta)")
def phi_lookup(spark, sf):
    """Entries of the earlier table stand, the later one adds what it lacks."""
    from ..operators.injection import phi_table

    li, k = spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("l_suppkey") % 5
    t = lambda d, c: d.groupBy(F.col("l_linenumber").alias("q"), k.alias("delta")).agg(F.avg(c).alias("phi"))
    return rounded(phi_table(t(li.filter("l_linenumber >= 3"), "l_tax"), t(li.filter("l_linenumber <= 5"), "l_discount")), "phi")


@query(f"WITH {HOURS}, q AS (SELECT symbol, quantile_cont(volume, 0.95) AS hi FROM bars GROUP BY symbol), c(name, a, b) AS (VALUES {', '.join(map(str, CRISES))}) SELECT name, symbol, (ts - a) // 3600000 AS hour, (volume > hi)::INT AS extreme FROM bars JOIN q USING (symbol) JOIN c ON ts BETWEEN a AND b")
def crisis_timeline(spark, sf):
    """The labels along each named window."""
    from ..operators.joins import in_intervals

    b = hours(spark, sf)
    b = b.join(b.groupBy("symbol").agg(F.percentile("volume", F.lit(0.95)).alias("hi")), "symbol")
    d = in_intervals(b, spark.createDataFrame(CRISES, "name string, start long, end long"), "ts")
    return d.select("name", "symbol", F.floor((F.col("ts") - F.col("start")) / HOUR).alias("hour"), (F.col("volume") > F.col("hi")).cast("int").alias("extreme"))


@query(f"WITH {HOURS}, d AS (SELECT unnest(range(1704499200000, 1706486400001, 259200000)) AS decision), r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars) SELECT symbol, decision, count(r) AS n, round(median(abs(r)), 6) AS median_move, round(max(abs(r)), 6) AS most FROM r JOIN d ON ts BETWEEN decision - 604800000 AND decision GROUP BY ALL")
def replay_statistics(spark, sf):
    """Statistics of each replay window: bars and windows meet by the stride they lie in."""
    stride = 259200000
    h = hours(spark, sf)
    b = h.select("symbol", "ts", F.ln(F.col("close") / F.lag("close").over(by_symbol("ts"))).alias("r"), F.floor(F.col("ts") / stride).alias("bin"))
    d = spark.range(1704499200000, 1706486400001, stride).select(F.col("id").alias("decision"))
    d = d.withColumn("bin", F.explode(F.sequence(F.floor((F.col("decision") - 604800000) / stride), F.floor(F.col("decision") / stride))))
    j = b.join(F.broadcast(d), "bin").filter(F.col("ts").between(F.col("decision") - 604800000, F.col("decision")))  # a row a decision and stride
    return rounded(j.groupBy("symbol", "decision").agg(F.count("r").alias("n"), F.percentile(F.abs("r"), F.lit(0.5)).alias("median_move"), F.max(F.abs("r")).alias("most")), "median_move", "most")


@query("SELECT page_id, regexp_extract(html, 'charset=\"?([A-Za-z0-9-]+)', 1) AS charset, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages WHERE html IS NOT NULL")
def page_fields(spark, sf):
    """Fields scraped from pages by pattern."""
    p = spark.read.parquet(f"{sf}/pages.parquet").filter("html IS NOT NULL")
    return p.select("page_id", F.regexp_extract("html", r'charset="?([A-Za-z0-9-]+)', 1).alias("charset"), F.regexp_count("html", F.lit("<a [^>]*href=")).cast("long").alias("links"))


@query(RECURSIVE + f", xs AS MATERIALIZED (SELECT symbol, idx, r * r AS x FROM r), {EMA} SELECT symbol, idx, round(sqrt(y), 6) AS rv FROM e")
def ewma_volatility(spark, sf):
    return rounded(W.realized_vol(panel(spark, sf), 30, ewma=True).select("symbol", "idx", "rv"), "rv")


_STATIC = lambda source, name: f"SELECT '{name}' AS gauge, CASE WHEN n < 60 OR slow = 0 THEN -1 WHEN fast / slow <= 0.95 THEN 0 WHEN fast / slow <= 1.1 THEN 1 ELSE 2 END AS label FROM (SELECT count(*) OVER f AS n, sqrt(avg(r * r) OVER g) AS fast, sqrt(avg(r * r) OVER f) AS slow FROM (SELECT symbol, idx, CASE WHEN lag(close) OVER w IS NULL THEN 0 ELSE ln(close) - ln(lag(close) OVER w) END AS r FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS 59 PRECEDING), g AS (PARTITION BY symbol ORDER BY idx ROWS 19 PRECEDING))"


@query(f"{PARTS}, {greedy_sql('vo', 'volume', 60)}, st AS ({_STATIC('ip', 'clock')} UNION ALL {_STATIC('vo', 'volume')}), c AS (SELECT gauge, label, count(*) AS n FROM st WHERE label >= 0 GROUP BY ALL) SELECT gauge, label, n, round(n / sum(n) OVER (PARTITION BY gauge), 6) AS share FROM c")
def clock_populations(spark, sf):
    """How many bars each state has, by clock."""
    from ..operators.detectors import static

    parts = None
    for name in ("clock", "volume"):
        b = static(rebar.gauge(name, panel(spark, sf), volume=60), 20, 60, 0.95, 1.1).filter("label >= 0").groupBy("label").agg(F.count("*").alias("n")).withColumn("gauge", F.lit(name))
        parts = b if parts is None else parts.unionByName(b)
    return rounded(parts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gauge"))), "share")  # three rows a clock
