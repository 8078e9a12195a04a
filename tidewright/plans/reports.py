"""Queries over nested reports of detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import two_sided_p_sql
from ..operators import detectors as D, reports as R, variance_ratio as VR, windows as W
from ..sources.bars import PANEL_SQL, panel
from ..sources.shared import materialize
from .benchmark import FORWARD, NAMES, THREE, three
from .common import query, rounded

REPS = 500
_W = " + ".join(f"(u > {c})::INT" for c in R._POISSON)
_MI = lambda n, by: f"greatest(0, sum({n} / t * ln({n} * t / (r * c))))"
_MARGINS = lambda n, by: f"sum({n}) OVER (PARTITION BY {by}, label) AS r, sum({n}) OVER (PARTITION BY {by}, sg) AS c, sum({n}) OVER (PARTITION BY {by}) AS t"
REPORT_SQL = THREE + FORWARD + f""", t0 AS (SELECT symbol, idx, fwd, quantile, ratio, spread FROM t3 JOIN fw USING (symbol, idx) WHERE quantile >= 0 AND ratio >= 0 AND spread >= 0),
lo3 AS (SELECT symbol, idx, fwd, 'quantile' AS detector, quantile AS label FROM t0 UNION ALL SELECT symbol, idx, fwd, 'ratio', ratio FROM t0 UNION ALL SELECT symbol, idx, fwd, 'spread', spread FROM t0),
lg AS (SELECT '3-state' AS task, * FROM lo3 UNION ALL SELECT '2-state', symbol, idx, fwd, detector, least(label, 1) FROM lo3),
n0 AS (SELECT task, detector, count(*) AS n, sum((label = 0)::INT)::BIGINT AS n_0, sum((label = 1)::INT)::BIGINT AS n_1 FROM lg GROUP BY ALL),
ch AS (SELECT *, lag(label) OVER w AS prev, row_number() OVER w AS k FROM lg WINDOW w AS (PARTITION BY task, detector, symbol ORDER BY idx)),
tr AS (SELECT task, detector, sum((prev = 0 AND label = 1)::INT)::BIGINT AS up, sum((prev = label)::INT)::BIGINT AS stays FROM ch GROUP BY ALL),
ru AS (SELECT task, detector, symbol, run, any_value(label) AS label, count(*) AS len FROM (SELECT *, sum((prev IS DISTINCT FROM label)::INT) OVER (PARTITION BY task, detector, symbol ORDER BY idx) AS run FROM ch) GROUP BY ALL),
rs AS (SELECT task, detector, count(*) AS runs, max(len) AS longest FROM ru GROUP BY ALL),
ce AS (SELECT task, detector, symbol, label, sign(fwd)::INT AS sg, count(*) AS n FROM lg WHERE fwd IS NOT NULL GROUP BY ALL),
wh AS (SELECT task, detector, label, sg, sum(n)::DOUBLE AS n FROM ce GROUP BY ALL), pm AS (SELECT *, {_MARGINS('n', 'task, detector')} FROM wh), pt AS (SELECT task, detector, {_MI('n', '')} AS mi FROM pm GROUP BY ALL),
sw AS (SELECT symbol, rep, {_W} AS w FROM (SELECT symbol, rep, ('0x' || substr(sha256(symbol || '|' || rep), 1, 15))::BIGINT::DOUBLE / {float(16**15)!r}::DOUBLE AS u FROM (SELECT DISTINCT symbol FROM ce), (SELECT unnest(range(0, {REPS})) AS rep))),
bt AS (SELECT task, detector, rep, label, sg, sum(n * w)::DOUBLE AS m FROM ce JOIN sw USING (symbol) GROUP BY ALL HAVING sum(n * w) > 0), bm AS (SELECT *, {_MARGINS('m', 'task, detector, rep')} FROM bt),
bi AS (SELECT task, detector, rep, {_MI('m', '')} AS mi FROM bm GROUP BY ALL), iv AS (SELECT task, detector, quantile_cont(mi, 0.025) AS lo, quantile_cont(mi, 0.975) AS hi FROM bi GROUP BY ALL)
SELECT task, detector, n, n_0, n_1, up, stays, runs, longest, round(mi, 7) AS mi, round(least(lo, mi), 7) AS lo, round(greatest(hi, mi), 7) AS hi, round(1e4 * mi - 9, 3) AS net_bps FROM n0 JOIN tr USING (task, detector) JOIN rs USING (task, detector) JOIN pt USING (task, detector) JOIN iv USING (task, detector)"""


def reports_of(spark, sf):
    """The reports of both tasks."""
    t = three(spark, sf).withColumn("fwd", W.forward_return(5, True))
    t = materialize(t.select("symbol", "idx", "fwd", *NAMES), "streams")  # both tasks read it
    two = t.withColumns({n: D.two_states(F.col(n)) for n in NAMES})
    return R.task_report(two, NAMES, "2-state", 2, 60, 1, 9.0, REPS).unionByName(R.task_report(t, NAMES, "3-state", 3, 60, 1, 9.0, REPS))


@query(REPORT_SQL)
def detector_report(spark, sf):
    """Detectors' reports of two tasks, written as JSON, read back and laid flat. (p, drawn by numpy, is tested apart.)"""
    r = R.from_checked_json(R.as_json(reports_of(spark, sf))).select("task", F.explode("detectors").alias("detector", "d"))
    state = lambda k: F.filter("d.occupancy", lambda o: o["state"] == k)[0]["n"]
    sums = lambda c, f: F.aggregate("d.runs", F.lit(0).cast("long"), lambda a, x: f(a, x[c]))
    stays = F.aggregate(F.sequence(F.lit(0), F.size("d.transitions") - 1), F.lit(0).cast("long"), lambda a, k: a + F.get(F.get("d.transitions", k), k))
    flat = r.select("task", "detector", "d.n", state(0).alias("n_0"), state(1).alias("n_1"), F.get(F.get("d.transitions", F.lit(0)), F.lit(1)).alias("up"), stays.alias("stays"), sums("runs", lambda a, x: a + x).alias("runs"), sums("longest", F.greatest).alias("longest"), "d.information.mi", "d.information.lo", "d.information.hi", "d.information.net_bps")
    return rounded(rounded(flat, "mi", "lo", "hi", digits=7), "net_bps", digits=3)


@query(f"""WITH {PANEL_SQL}, {VR.vr_sql(60, (2, 5, 15))}, sp AS (SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n_bars, bool_or(year >= 1998) AS held, bool_or(year < 1998) AS early FROM panel GROUP BY symbol),
md AS (SELECT symbol, q, count(*) AS n, median(abs(vr_dev)) AS m, median(z) AS mz FROM vr GROUP BY ALL), pv AS (SELECT *, {two_sided_p_sql('mz')} AS p FROM md), hk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p, q) AS k FROM pv),
hm AS (SELECT *, least(1, max(p * (4 - k)) OVER (PARTITION BY symbol ORDER BY k)) AS p_holm FROM hk), fi AS (SELECT symbol, bool_or(p_holm < 0.05 AND mz > 0) AS fired FROM hm GROUP BY symbol)
SELECT sp.symbol, strftime(make_timestamp(a * 1000), '%Y-%m-%d') AS start, strftime(make_timestamp(b * 1000), '%Y-%m-%d') AS "end", n_bars, held AND early AS partial_holdout, h.n AS n_windows, round(h.m, 6) AS median_dev, round(h.mz, 6) AS median_z, round(h.p_holm, 6) AS p_holm, coalesce(fired, false) AS fired
FROM sp LEFT JOIN fi USING (symbol) LEFT JOIN hm h ON h.symbol = sp.symbol AND h.q = 5""")
def replication_report(spark, sf):
    """The study on each instrument by itself: span, primary cell and whether the cascade fires."""
    r = R.replication(panel(spark, sf), 60, (2, 5, 15), 5, 1998)
    flat = r.select("symbol", "span.start", "span.end", "span.n_bars", "span.partial_holdout", F.col("primary.n").alias("n_windows"), "primary.median_dev", "primary.median_z", "primary.p_holm", "fired")
    return rounded(flat, "median_dev", "median_z", "p_holm")
