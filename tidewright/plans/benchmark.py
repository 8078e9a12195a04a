"""Queries over detectors, label validity, agreement, triggers and the cascade as certified (four horizons, 120 bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import two_sided_p, two_sided_p_sql
from ..operators import benchmark as B, detectors as D, measures as M, order_statistics as O, rebar, variance_ratio as VR, windows as W
from ..sources.bars import PANEL_SQL, panel
from ..sources.shared import materialize
from .common import query, rounded
from .features import QUANT, RET, labels

NAMES = ["quantile", "ratio", "spread"]
LOW, HIGH = 0.95, 1.1
RATIO = f""", fs AS (SELECT symbol, idx, CASE WHEN count(*) OVER g = 20 THEN sqrt(avg(r * r) OVER g) END AS fast, CASE WHEN count(*) OVER f = 60 THEN sqrt(avg(r * r) OVER f) END AS slow FROM r
 WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), g AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ra AS (SELECT symbol, idx, CASE WHEN slow > 0 THEN fast / slow END AS ratio FROM fs),
st AS (SELECT *, CASE WHEN ratio IS NULL THEN -1 WHEN ratio <= {LOW} THEN 0 WHEN ratio <= {HIGH} THEN 1 ELSE 2 END AS label FROM ra)"""
GLOBAL = """, gq AS (SELECT quantile_cont(rv, 0.75) AS lo, quantile_cont(rv, 0.95) AS hi FROM v WHERE rv IS NOT NULL),
gl AS (SELECT symbol, idx, CASE WHEN rv IS NULL THEN -1 WHEN rv <= lo THEN 0 WHEN rv <= hi THEN 1 ELSE 2 END AS label FROM v, gq)"""
THREE = QUANT + RATIO + GLOBAL + ", t3 AS (SELECT symbol, idx, l.label AS quantile, st.label AS ratio, gl.label AS spread FROM l JOIN st USING (symbol, idx) JOIN gl USING (symbol, idx))"


def three(spark, sf):
    """Labels of three detectors side by side, with the close. Each works on what the one before made of the bars."""
    q = labels(spark, sf).select("symbol", "idx", "close", "rv", F.col("label").alias("quantile"))
    r = D.static(q, 20, 60, LOW, HIGH).select("symbol", "idx", "close", "rv", "quantile", F.col("label").alias("ratio"))
    return D.global_states(materialize(r, "labels"), "rv").select("symbol", "idx", "close", "quantile", "ratio", F.col("label").alias("spread"))


@query(RET + RATIO + " SELECT symbol, idx, round(ratio, 6) AS ratio, label FROM st")
def static_detector(spark, sf):
    return rounded(D.detect("static", panel(spark, sf), fast=20, slow=60, low=LOW, high=HIGH).select("symbol", "idx", "ratio", "label"), "ratio")


@query(QUANT + GLOBAL + " SELECT symbol, idx, label, CASE label WHEN 0 THEN 0 WHEN -1 THEN -1 ELSE 1 END AS two FROM gl")
def global_states(spark, sf):
    g = D.global_states(W.realized_vol(panel(spark, sf), 20), "rv")
    return g.select("symbol", "idx", "label", D.two_states(F.col("label")).alias("two"))


@query(f"WITH {PANEL_SQL}, p AS (SELECT symbol, idx, [volume, 25, close / 50] AS p FROM panel) SELECT symbol, idx, list_position(p, list_max(p)) - 1 AS label FROM p")
def soft_labels(spark, sf):
    p = F.array("volume", F.lit(25.0), F.col("close") / 50)
    return panel(spark, sf).select("symbol", "idx", D.most_likely(p).alias("label"))


@query(RET + """, w AS (SELECT symbol, idx, close, CASE WHEN count(*) OVER f = 60 THEN sum((high + low + close) / 3 * volume) OVER f / nullif(sum(volume) OVER f, 0) END AS vwap FROM r WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
d AS (SELECT symbol, idx, CASE WHEN vwap > 0 THEN close / vwap - 1 END AS dev FROM w), z AS (SELECT *, CASE WHEN count(*) OVER f = 60 THEN sqrt(avg(coalesce(dev, 0) ** 2) OVER f) END AS sd FROM d WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT symbol, idx, round(dev, 6) AS deviation, round(dev / greatest(sd, 1e-12), 6) AS z FROM z""")
def vwap_deviation(spark, sf):
    b = panel(spark, sf).withColumn("vwap", W.vwap(60))
    b = b.withColumn("deviation", F.when(F.col("vwap") > 0, F.col("close") / F.col("vwap") - 1))
    sd = W.rms(F.coalesce("deviation", F.lit(0.0)), 60)
    return rounded(b.select("symbol", "idx", "deviation", (F.col("deviation") / F.when(sd.isNotNull(), F.greatest(sd, F.lit(1e-12)))).alias("z")), "deviation", "z")


@query(RET + RATIO + """, s AS (SELECT count(ratio) AS n, avg(ratio) AS mean, stddev_samp(ratio) AS std, max(ratio) AS most, avg((ratio <= 1.5)::INT) AS rank, sum((ratio > 1.5)::INT)::BIGINT AS above, max(CASE WHEN idx BETWEEN 100 AND 199 THEN ratio END) AS most_early, max(CASE WHEN idx BETWEEN 300 AND 399 THEN ratio END) AS most_late FROM ra WHERE ratio IS NOT NULL)
SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(most, 6) AS most, round(rank, 6) AS rank, round((1.5 - mean) / std, 6) AS sigmas, above, round(most_early, 6) AS most_early, round(most_late, 6) AS most_late FROM s""")
def ratio_diagnosis(spark, sf):
    r = D.volatility_ratio(panel(spark, sf), 20, 60).filter("ratio IS NOT NULL")
    x = F.col("ratio")
    span = lambda a, b: F.max(F.when(F.col("idx").between(a, b), x))
    s = r.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.max(x).alias("most"), F.avg((x <= 1.5).cast("int")).alias("rank"), F.sum((x > 1.5).cast("long")).alias("above"), span(100, 199).alias("most_early"), span(300, 399).alias("most_late"))
    return rounded(s.withColumn("sigmas", (1.5 - F.col("mean")) / F.col("std")), "mean", "std", "most", "rank", "sigmas", "most_early", "most_late")


@query(QUANT + """, k AS (SELECT v.symbol, v.idx, v.rv, p.close FROM v JOIN panel p USING (symbol, idx)), pk AS (SELECT symbol, arg_max(idx, (close, -idx)) AS peak, arg_max(rv, (close, -idx)) AS top FROM k WHERE rv IS NOT NULL GROUP BY symbol)
SELECT symbol, peak, round(avg((rv <= top)::INT), 6) AS rank FROM k JOIN pk USING (symbol) WHERE idx BETWEEN peak - 119 AND peak AND rv IS NOT NULL GROUP BY symbol, peak""")
def peak_rank(spark, sf):
    b = W.realized_vol(panel(spark, sf), 20).filter("rv IS NOT NULL").select("symbol", "idx", "close", "rv")
    peak = b.groupBy("symbol").agg(F.max_by(F.struct("idx", "rv"), F.struct("close", -F.col("idx"))).alias("p")).select("symbol", F.col("p.idx").alias("peak"), F.col("p.rv").alias("top"))
    near = b.join(peak, "symbol").filter(F.col("idx").between(F.col("peak") - 119, F.col("peak")))
    return rounded(near.groupBy("symbol", "peak").agg(F.avg((F.col("rv") <= F.col("top")).cast("int")).alias("rank")), "rank")


@query(RET + RATIO + ", v AS (SELECT symbol, idx, ratio FROM ra) SELECT symbol, idx, CASE WHEN count(ratio) OVER g >= 120 THEN round(quantile_cont(ratio, 0.75) OVER g, 6) END AS q75 FROM v WINDOW g AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)")
def expanding_quantile(spark, sf):
    r = D.volatility_ratio(panel(spark, sf), 20, 60).select("symbol", "idx", "ratio")
    return rounded(O.expanding_quantile(r, "ratio", 120, {"q75": 0.75}).select("symbol", "idx", "q75"), "q75")


_NEAREST = lambda p: f"s[round_even({p} * (len(s) - 1), 0)::BIGINT + 1]"


@query(RET.replace("WITH", "WITH RECURSIVE", 1) + RATIO + f""", xs AS MATERIALIZED (SELECT symbol, idx, ratio AS x FROM ra), e AS (SELECT symbol, idx, x AS y FROM xs WHERE idx = 0
 UNION ALL SELECT xs.symbol, xs.idx, CASE WHEN xs.x IS NULL THEN e.y WHEN e.y IS NULL THEN xs.x ELSE e.y + 2 / 21 * (xs.x - e.y) END FROM e JOIN xs ON xs.symbol = e.symbol AND xs.idx = e.idx + 1),
li AS (SELECT symbol, idx, y, list_sort(list(y) FILTER (y IS NOT NULL) OVER (PARTITION BY symbol ORDER BY idx ROWS 119 PRECEDING)) AS s FROM e),
dl AS (SELECT symbol, CASE WHEN y IS NULL THEN -1 WHEN y <= {_NEAREST(0.75)} THEN 0 WHEN y <= {_NEAREST(0.95)} THEN 1 ELSE 2 END AS label FROM li) SELECT symbol, label, count(*) AS n FROM dl GROUP BY ALL""")
def dynamic_detector(spark, sf):
    d = D.detect("dynamic", panel(spark, sf), fast=20, slow=60, smooth=20, w=120)
    return d.groupBy("symbol", "label").agg(F.count("*").alias("n"))


@query(QUANT + """, f AS (SELECT *, min(CASE WHEN label >= 0 THEN idx END) OVER (PARTITION BY symbol) AS first FROM l),
c AS (SELECT symbol, sum((label >= 0)::INT)::BIGINT AS n_valid, sum((label = 0 AND (idx - first) % 20 = 0)::INT) AS n_0, sum((label = 1 AND (idx - first) % 20 = 0)::INT) AS n_1, sum((label = 2 AND (idx - first) % 20 = 0)::INT) AS n_2 FROM f WHERE idx >= first GROUP BY symbol)
SELECT symbol, n_valid, n_0::BIGINT AS n_0, n_1::BIGINT AS n_1, n_2::BIGINT AS n_2, CASE WHEN least(n_0, n_1, n_2) >= 2 THEN 'valid' ELSE 'instrument_failure' END AS status,
 concat_ws(';', CASE WHEN n_0 < 2 THEN 'state_0_nonoverlap_below_2' END, CASE WHEN n_1 < 2 THEN 'state_1_nonoverlap_below_2' END, CASE WHEN n_2 < 2 THEN 'state_2_nonoverlap_below_2' END) AS reasons FROM c""")
def label_validity(spark, sf):
    c = B.state_counts(labels(spark, sf), 3, 20, "symbol")
    return B.validity(c, 3, 2).withColumn("reasons", F.array_join("reasons", ";"))


PAIRS = THREE + """, t AS (SELECT * FROM t3 WHERE quantile >= 0 AND ratio >= 0 AND spread >= 0),
xy AS (SELECT 'quantile__ratio' AS pair, quantile AS x, ratio AS y FROM t UNION ALL SELECT 'quantile__spread', quantile, spread FROM t UNION ALL SELECT 'ratio__spread', ratio, spread FROM t),
j AS (SELECT pair, x, y, count(*)::DOUBLE AS n FROM xy GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY pair, x) AS nx, sum(n) OVER (PARTITION BY pair, y) AS ny, sum(n) OVER (PARTITION BY pair) AS t FROM j),
s AS (SELECT pair, max(t) AS t, sum(CASE WHEN x = y THEN n ELSE 0 END) / max(t) AS po, sum(CASE WHEN x = y THEN nx * ny ELSE 0 END) / max(t) ** 2 AS pe, sum(n / t * ln(n * t / (nx * ny))) AS mi, -sum(n / t * ln(nx / t)) AS hx, -sum(n / t * ln(ny / t)) AS hy,
 sum(n * (n - 1) / 2) AS pij, sum(n * (nx - 1) / 2) AS px, sum(n * (ny - 1) / 2) AS py FROM m GROUP BY pair),
a AS (SELECT pair, t::BIGINT AS n, (po - pe) / (1 - pe) AS kappa, greatest(hx + hy - 2 * mi, 0) AS vi, 2 * mi / (hx + hy) AS nmi, (pij - px * py / (t * (t - 1) / 2)) / ((px + py) / 2 - px * py / (t * (t - 1) / 2)) AS ari FROM s)"""


@query(PAIRS + " SELECT pair, n, round(kappa, 6) AS kappa, round(vi, 6) AS vi, round(nmi, 6) AS nmi, round(ari, 6) AS ari FROM a")
def detector_agreement(spark, sf):
    return rounded(B.agreement_of_pairs(three(spark, sf), NAMES), "kappa", "vi", "nmi", "ari")


@query(PAIRS + " SELECT CASE WHEN min(nmi) >= 0.6 THEN 'harmonized_convergence' WHEN max(nmi) <= 0.2 THEN 'persistent_disagreement' ELSE 'mixed_family_structure' END AS classification, round(min(nmi), 6) AS least, round(max(nmi), 6) AS most FROM a")
def detector_classification(spark, sf):
    t = three(spark, sf)
    status = B.validity(B.state_counts(t.select("symbol", "idx", F.col("ratio").alias("label")), 3, 60), 3, 1).select("status")
    return rounded(B.classification(status, B.agreement_of_pairs(t, NAMES)), "least", "most")


FORWARD = ", fw AS (SELECT symbol, idx, ln(lead(close, 5) OVER w / close) AS fwd FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY idx))"


def _info_sql(source: str, states: int, cost: float) -> str:
    per = ", ".join(f"count(CASE WHEN label = {k} THEN fwd END) AS n_{k}, round(avg(CASE WHEN label = {k} THEN fwd END), 6) AS mean_{k}, round(median(CASE WHEN label = {k} THEN fwd END), 6) AS median_{k}, round(avg(CASE WHEN label = {k} THEN (fwd > 0)::INT END), 6) AS positive_{k}" for k in range(states))
    return f""", ci AS (SELECT label, fwd, sign(fwd) AS s FROM {source} WHERE label >= 0 AND fwd IS NOT NULL), cj AS (SELECT label, s, count(*)::DOUBLE AS n FROM ci GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER (PARTITION BY label) AS nx, sum(n) OVER (PARTITION BY s) AS ny, sum(n) OVER () AS t FROM cj), cmi AS (SELECT greatest(sum(n / t * ln(n * t / (nx * ny))), 0) AS mi, max(t)::BIGINT AS n FROM cm),
cp AS (SELECT {per} FROM ci), info AS (SELECT n, round(mi, 6) AS mi, cp.*, round(1e4 * mi, 4) AS gross_bps, round(1e4 * mi - {cost}, 4) AS net_bps FROM cmi, cp)"""


def _round_info(df, states):
    df = rounded(df, "mi", *(f"{c}_{k}" for k in range(states) for c in ("mean", "median", "positive")))
    return rounded(df, "gross_bps", "net_bps", digits=4)


@query(QUANT + FORWARD + ", x AS (SELECT label, fwd FROM l JOIN fw USING (symbol, idx))" + _info_sql("x", 3, 9.0) + " SELECT * FROM info")
def contingent_information(spark, sf):
    d = labels(spark, sf).withColumn("fwd", W.forward_return(5, True))
    return _round_info(B.contingent_information(d, "label", "fwd", 3, 9.0), 3)


VR120 = f"WITH {PANEL_SQL}, {VR.vr_sql(120, VR.HORIZONS)}"
TRIGGERS = VR120 + """, fin AS (SELECT *, count(z) OVER (PARTITION BY symbol, win) AS c FROM vr), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, win ORDER BY abs(z) DESC, q) AS k FROM fin WHERE c = 4),
o AS (SELECT *, abs(z) > [2.497705474412374, 2.3939797998185104, 2.241402727604947, 1.959963984540054][k] AS ok FROM k), rj AS (SELECT *, min(ok::INT) OVER (PARTITION BY symbol, win ORDER BY k) = 1 AS rej FROM o),
tr AS (SELECT symbol, win, end_idx AS idx, (rej AND z > 0)::INT AS label FROM rj WHERE q = 5)"""


@query(TRIGGERS + " SELECT symbol, win, idx, label FROM tr")
def window_triggers(spark, sf):
    return B.window_triggers(VR.strided(panel(spark, sf), 120), 5, 4)


@query(TRIGGERS + FORWARD + ", x AS (SELECT label, fwd FROM tr JOIN fw USING (symbol, idx))" + _info_sql("x", 2, 9.0) + """, e AS (SELECT count(*) AS n_labels, sum(label)::BIGINT AS n_triggers, avg(label) AS p FROM tr)
SELECT n_labels, n_triggers, round(p, 6) AS rate, round(CASE WHEN p > 0 AND p < 1 THEN -p * ln(p) - (1 - p) * ln(1 - p) ELSE 0 END, 6) AS entropy, info.* FROM e, info""")
def trigger_information(spark, sf):
    t = B.window_triggers(VR.strided(panel(spark, sf), 120), 5, 4)
    fwd = panel(spark, sf).select("symbol", "idx", W.forward_return(5, True).alias("fwd"))
    return _round_info(rounded(B.trigger_report(t, fwd, 9.0), "rate", "entropy"), 2)


CASCADE = QUANT + f", {VR.vr_sql(120, VR.HORIZONS)}" + f""", vl AS (SELECT vr.* FROM vr JOIN l ON vr.symbol = l.symbol AND vr.end_idx = l.idx WHERE l.label >= 0),
ms AS (SELECT symbol, q, count(*) AS n, median(abs(vr_dev)) AS median_dev, avg(abs(vr_dev)) AS mean_dev, median(z) AS mz FROM vl GROUP BY ALL), pp AS (SELECT *, {two_sided_p_sql("mz")} AS p FROM ms),
hk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, q) AS k FROM pp), ha AS (SELECT *, least(1, max(p * (5 - k)) OVER (PARTITION BY symbol ORDER BY k)) AS p_holm FROM hk)"""


@query(CASCADE + " SELECT symbol, q::BIGINT AS q, n, round(median_dev, 6) AS median_dev, round(mean_dev, 6) AS mean_dev, round(mz, 6) AS median_z, round(p, 6) AS p, round(p_holm, 6) AS p_holm, median_dev < 0.001 AS closed, p_holm < 0.05 AND mz > 0 AS fires FROM ha")
def cascade_certified(spark, sf):
    d = B.decision(VR.strided(panel(spark, sf), 120), labels(spark, sf)).withColumn("q", F.col("q").cast("long"))
    return rounded(d.select("symbol", "q", "n", "median_dev", "mean_dev", "median_z", "p", "p_holm", "closed", "fires"), "median_dev", "mean_dev", "median_z", "p", "p_holm")


ROLLED = f"""WITH {PANEL_SQL}, shifted AS (SELECT symbol * 100 + k AS symbol, idx - k AS idx, ts, close FROM panel, (SELECT unnest(range(0, 60)) AS k) WHERE idx >= k), {VR.vr_sql(60, (2, 5), 'shifted')}"""


@query(ROLLED + " SELECT q::BIGINT AS q, count(*) AS n, round(median(abs(vr_dev)), 6) AS median_dev FROM vr GROUP BY q")
def vr_profile(spark, sf):
    """Median |VR - 1| by horizon over the window that ends at every bar."""
    return rounded(VR.departure(VR.rolling(panel(spark, sf), 60, (2, 5)), "median_dev"), "median_dev")


@query(QUANT + f", {VR.vr_sql(60, (2, 5, 15))}" + """, ch AS (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY symbol ORDER BY idx) THEN 1 ELSE 0 END AS c FROM l), ru AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM ch),
pe AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) AS len FROM ru) SELECT q::BIGINT AS q, count(*) AS n, round(median(abs(vr_dev)), 6) AS floor FROM vr JOIN pe ON vr.symbol = pe.symbol AND vr.end_idx = pe.idx WHERE pe.label = 0 AND pe.len >= 20 GROUP BY q""")
def low_noise_floor(spark, sf):
    low = B.persistent(labels(spark, sf), 0, 20).select("symbol", F.col("idx").alias("end_idx"))
    v = VR.strided(panel(spark, sf), 60, (2, 5, 15)).filter("vr_dev IS NOT NULL").join(low, ["symbol", "end_idx"])
    return rounded(v.groupBy(F.col("q").cast("long").alias("q")).agg(F.count("*").alias("n"), F.percentile(F.abs("vr_dev"), F.lit(0.5)).alias("floor")), "floor")


@query(QUANT + f", {VR.vr_sql(60, (2, 5))}" + f""", k0 AS (SELECT q, l.label, abs(vr_dev) AS x FROM vr JOIN l ON vr.symbol = l.symbol AND vr.end_idx = l.idx WHERE l.label >= 0),
rk0 AS (SELECT *, rank() OVER (PARTITION BY q ORDER BY x) + (count(*) OVER (PARTITION BY q, x) - 1) / 2 AS rk, count(*) OVER (PARTITION BY q) AS n FROM k0), ti AS (SELECT q, sum(c ** 3 - c) AS t FROM (SELECT q, count(*)::DOUBLE AS c FROM k0 GROUP BY q, x) GROUP BY q),
g0 AS (SELECT q, label, count(*) AS m, sum(rk) AS s, max(n)::DOUBLE AS n FROM rk0 GROUP BY q, label), h0 AS (SELECT q, max(n) AS n, (12 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1)) AS h0 FROM g0 GROUP BY q),
e0 AS (SELECT q, n, h0 / (1 - t / (n ** 3 - n)) AS h, h0 / (1 - t / (n ** 3 - n)) * (n + 1) / (n * n - 1) AS e FROM h0 JOIN ti USING (q)), d0 AS (SELECT q, stddev_samp(x) AS sd, stddev_samp(x) / avg(x) AS cv, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg((x >= 0.95)::INT) AS rail FROM k0 GROUP BY q)
SELECT q::BIGINT AS q, n::BIGINT AS n, round(h, 5) AS h, round(exp(-h / 2), 6) AS p, round(e, 6) AS epsilon_sq, sd = 0 OR cv < 0.05 OR iqr < 0.001 OR rail > 0.5 AS degenerate, CASE WHEN NOT (sd = 0 OR cv < 0.05 OR iqr < 0.001 OR rail > 0.5) AND e > 0.01 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e0 JOIN d0 USING (q)""")
def gate_verdict(spark, sf):
    """By horizon: Kruskal-Wallis over the labels with p for two degrees of freedom, degeneracy and verdict."""
    v = VR.strided(panel(spark, sf), 60, (2, 5)).filter("vr_dev IS NOT NULL").select("symbol", F.col("end_idx").alias("idx"), "q", F.abs("vr_dev").alias("x"))
    v = v.join(labels(spark, sf).filter("label >= 0").select("symbol", "idx", "label"), ["symbol", "idx"])
    v = materialize(v, "windows")  # read by horizon, and for the quantiles
    d = M.degeneracy(v, "x", "q", few=True)
    bad = (F.col("std") == 0) | (F.col("cv") < 0.05) | (F.col("iqr") < 0.001) | (F.col("rail") > 0.5)
    parts = None
    for q in (2, 5):
        k = M.kruskal(v.filter(F.col("q") == q), "x", "label").withColumn("q", F.lit(q))
        parts = k if parts is None else parts.unionByName(k)
    out = B.gate_verdict(parts.join(d.select("q", bad.alias("degenerate")), "q")).withColumn("p", F.exp(-F.col("h") / 2))
    out = out.select(F.col("q").cast("long").alias("q"), "n", "h", "p", "epsilon_sq", "degenerate", "verdict")
    return rounded(rounded(out, "h", digits=5), "p", "epsilon_sq")


@query(QUANT + ", s AS (SELECT l.symbol, l.idx, l.label, p.close FROM l JOIN panel p USING (symbol, idx)), x AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY close) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM s WHERE label >= 0) SELECT symbol, label, count(*) AS n FROM x GROUP BY ALL")
def population(spark, sf):
    """How many bars each symbol spends in each state."""
    return labels(spark, sf).filter("label >= 0").groupBy("symbol", "label").agg(F.count("*").alias("n"))


@query(VRS60 := f"WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5, 15))}, s AS (SELECT symbol, q, median(z) AS mz, count(*) AS n FROM vr GROUP BY ALL)" + f" SELECT symbol, q::BIGINT AS q, n, round(mz, 6) AS median_z, round({two_sided_p_sql('mz')}, 6) AS p FROM s")
def path_statistic(spark, sf):
    """Median z of a path and its asymptotic p, without labels."""
    s = VR.significance(VR.strided(panel(spark, sf), 60, (2, 5, 15)), "symbol")
    return rounded(s.select("symbol", F.col("q").cast("long").alias("q"), "n", "median_z", two_sided_p(F.col("median_z")).alias("p")), "median_z", "p")


@query(QUANT + ", c AS (SELECT symbol, label, rv FROM l WHERE idx >= 59 AND (idx - 59) % 60 = 0 AND label = 2 AND rv IS NOT NULL) SELECT symbol, count(*) AS n FROM c GROUP BY symbol")
def extreme_counts(spark, sf):
    return rebar.non_overlapping(labels(spark, sf), 60, "rv", "label").filter("label = 2").groupBy("symbol").agg(F.count("*").alias("n"))
