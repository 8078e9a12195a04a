"""Queries over replayed gates: statistics of overlapping windows, thresholds of their maxima, decisions, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as R
from ..operators.variance_ratio import vr_sql
from ..sources.bars import MINUTE, by_symbol, event_bars, event_bars_sql
from .common import query, rounded

DAY = 86_400_000
START, END, WINDOW = 1_704_672_000_000, 1_706_659_200_000, 7 * DAY
#: The share of replays that each gate may pass by chance.
ALPHA = {"size": 0.02, "sensitivity": 0.015, "detector_information": 0.015}
REPS = 1000
_PAIRS = {f"c{a}{b}": f"count(*) FILTER (u = {a} AND u2 = {b} AND ts2 <= t)" for a in (0, 1) for b in (0, 1)}
_MI = " + ".join(f"CASE WHEN c{a}{b} > 0 THEN c{a}{b} / m * ln(c{a}{b} * m / ((c{a}0 + c{a}1) * (c0{b} + c1{b}))) ELSE 0 END" for a in (0, 1) for b in (0, 1))
STATS = f"""WITH {event_bars_sql(60 * MINUTE, 'event_type')}, o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM bars),
{vr_sql(24, (2,), 'o')}, fs AS (SELECT symbol, idx // 24 AS win, min(ts) AS first_ts FROM o GROUP BY ALL),
rr AS (SELECT symbol, idx, ts, CASE WHEN lag(close) OVER w IS NULL THEN 0 ELSE ln(close) - ln(lag(close) OVER w) END AS r FROM o WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
pr AS (SELECT *, (r > 0)::INT AS u, lead((r > 0)::INT, 2) OVER w AS u2, lead(ts, 2) OVER w AS ts2 FROM rr WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
dec AS (SELECT unnest(range({START}, {END} + 1, {DAY})) AS t),
wc AS (SELECT symbol, t, count(*) AS n, max(abs(r)) AS top, {', '.join(f'{v} AS {k}' for k, v in _PAIRS.items())} FROM pr JOIN dec ON ts BETWEEN t - {WINDOW} AND t GROUP BY ALL),
wm AS (SELECT *, c00 + c01 + c10 + c11 AS m FROM wc),
wz AS (SELECT symbol, t, median(z) AS mz, count(*) AS k FROM vr JOIN fs USING (symbol, win) JOIN dec ON first_ts >= t - {WINDOW} AND end_ts <= t WHERE z IS NOT NULL GROUP BY ALL),
st AS (SELECT symbol, t AS decision, n, top AS top_move, coalesce(k, 1) AS n_windows, greatest(0, coalesce(mz, 0)) AS size, greatest(0, coalesce(mz, 0)) * sqrt(coalesce(k, 1)) AS sensitivity,
 CASE WHEN n > 4 AND m > 0 THEN greatest(0, {_MI}) ELSE 0 END * sqrt(greatest(n - 2, 1)) AS detector_information FROM wm LEFT JOIN wz USING (symbol, t))"""
MAXIMA = STATS + f""", lg AS (SELECT symbol, gate, list(v ORDER BY decision) AS x FROM (UNPIVOT (SELECT symbol, decision, size::DOUBLE AS size, sensitivity::DOUBLE AS sensitivity, detector_information::DOUBLE AS detector_information FROM st) ON size, sensitivity, detector_information INTO NAME gate VALUE v) GROUP BY ALL),
bl AS (SELECT *, len(x) AS n, greatest(1, round(sqrt(len(x))))::BIGINT AS b FROM lg), bk AS (SELECT *, (n + b - 1) // b AS nb FROM bl),
rp AS (SELECT symbol, gate, rep, blk, n, x, CASE WHEN blk = nb - 1 THEN n - blk * b ELSE b END AS width, (('0x' || substr(sha256(symbol || '|' || gate || '|' || rep || '|' || blk), 1, 15))::BIGINT) % n AS s
 FROM bk, (SELECT unnest(range(0, {REPS})) AS rep), LATERAL (SELECT unnest(range(0, nb)) AS blk)),
mx AS (SELECT symbol, gate, rep, max(list_max(list_concat(x, x)[s + 1 : s + width])) AS m FROM rp GROUP BY ALL),
th AS (SELECT symbol, gate, list(m ORDER BY m)[ceil(CASE gate {' '.join(f'WHEN {chr(39)}{g}{chr(39)} THEN {1 - a}' for g, a in ALPHA.items())} END * {REPS - 1})::BIGINT + 1] AS threshold FROM mx GROUP BY symbol, gate)"""


def _bars(spark, sf):
    b = event_bars(spark, sf, 60 * MINUTE, F.col("event_type")).select("symbol", "ts", "close")
    return b.withColumn("idx", (F.row_number().over(by_symbol("ts")) - 1).cast("long"))


def _stats(spark, sf):
    return R.gate_statistics(_bars(spark, sf), 24, 2, START, END, WINDOW, DAY)


@query(STATS + " SELECT symbol, decision, n, round(top_move, 6) AS top_move, n_windows, round(size, 6) AS size, round(sensitivity, 6) AS sensitivity, round(detector_information, 6) AS detector_information FROM st")
def replay_gates(spark, sf):
    return rounded(_stats(spark, sf), "top_move", "size", "sensitivity", "detector_information")


@query(MAXIMA + " SELECT symbol, gate, n, round(list_max(x), 6) AS top, round(threshold, 6) AS threshold FROM bl JOIN th USING (symbol, gate)")
def replay_maxima(spark, sf):
    """The largest statistic of each gate over the replay, and what it would have to exceed by chance."""
    return rounded(R.maxima_thresholds(_stats(spark, sf), ALPHA, REPS), "top", "threshold")


@query(MAXIMA + ", tw AS (SELECT symbol, max(threshold) FILTER (gate = 'size') AS a, max(threshold) FILTER (gate = 'sensitivity') AS b, max(threshold) FILTER (gate = 'detector_information') AS c FROM th GROUP BY symbol) SELECT symbol, decision, size > a AND sensitivity > b AND detector_information > c AS ok FROM st JOIN tw USING (symbol)")
def replay_decisions(spark, sf):
    from ..sources.shared import materialize

    stats = materialize(_stats(spark, sf), "gates")  # read twice
    return R.gated(stats, R.maxima_thresholds(stats, ALPHA, REPS)).select("symbol", "decision", "ok")


@query(MAXIMA + f", tw AS (SELECT symbol, max(threshold) FILTER (gate = 'size') AS a, max(threshold) FILTER (gate = 'sensitivity') AS b, max(threshold) FILTER (gate = 'detector_information') AS c FROM th GROUP BY symbol), so AS (SELECT symbol, decision, decision BETWEEN {START + 5 * DAY} AND {START + 12 * DAY} AS signal_on, a, b, c FROM st JOIN tw USING (symbol)) SELECT symbol, decision, signal_on, round(CASE WHEN signal_on THEN a + 1 ELSE 0.25 * a END, 6) AS size, round(CASE WHEN signal_on THEN b + 1 ELSE 0.25 * b END, 6) AS sensitivity, round(CASE WHEN signal_on THEN c + 1 ELSE 0.25 * c END, 6) AS detector_information, signal_on AS ok FROM so")
def controlled_schedule(spark, sf):
    """Statistics made to pass in a week of the replay and to fail elsewhere, and whether the gates see it so."""
    from ..sources.shared import materialize

    stats = materialize(_stats(spark, sf), "gates")  # read twice
    top = materialize(R.maxima_thresholds(stats, ALPHA, REPS), "thresholds")
    made = R.scheduled(stats, top, START + 5 * DAY, START + 12 * DAY, 0.1)
    return rounded(R.gated(made, top), *R.GATES)
