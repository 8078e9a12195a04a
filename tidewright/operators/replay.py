"""Gate statistics of overlapping replay windows, their maxima over resampled replays, and schedules to try gates on.

Time is cut into panes on which all windows begin and end: the moments themselves, and what lies between two of them. Bars are
summed up by pane once; a window is then a difference of two running sums, and a maximum is that of the two panes' tables of
a power of two panes that cover it. No bar is copied to the windows it lies in.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import by_symbol
from .variance_ratio import strided
from .windows import log_return

GATES = ("size", "sensitivity", "detector_information")
_CELLS = [(a, b) for a in (0, 1) for b in (0, 1)]


def information_of_counts(counts: list[Column]) -> Column:
    """Plug-in information, in nats, of a two by two table given as counts of (0, 0), (0, 1), (1, 0) and (1, 1)."""
    n = sum(counts[1:], counts[0])
    rows, columns = [counts[0] + counts[1], counts[2] + counts[3]], [counts[0] + counts[2], counts[1] + counts[3]]
    parts = [F.when(c > 0, c / n * F.ln(c * n / (rows[a] * columns[b]))).otherwise(0.0) for c, (a, b) in zip(counts, _CELLS)]
    return F.when(n > 0, F.greatest(F.lit(0.0), sum(parts[1:], parts[0]))).otherwise(0.0)


def gate_statistics(bars: DataFrame, w: int, q: int, start: int, end: int, window_ms: int, stride_ms: int) -> DataFrame:
    """By symbol and decision time, every stride_ms from start to end: bars n and largest |return| of the window_ms before it
    (both ends included), number of variance-ratio windows in it, and the gates: size (positive part of their median z),
    sensitivity (the same times the root of their number), detector_information (of a return's sign about that of the return
    q bars on, times the root of n - q). Windows without a bar are left out. bars: symbol, idx, ts, close."""
    g = gcd(window_ms, stride_ms)
    step, wide, last = 2 * stride_ms // g, 2 * window_ms // g, (end - start) // stride_ms
    pane = lambda ts: 2 * F.floor((ts - start) / g) + F.when((ts - start) % g == 0, 0).otherwise(1)
    b = bars.select("symbol", "idx", "ts", log_return().alias("r"))
    up = (F.col("r") > 0).cast("int")
    b = b.withColumns({"up": up, "pane": pane(F.col("ts"))})
    b = b.withColumns({"up2": F.lead("up", q).over(by_symbol()), "pane2": F.lead("pane", q).over(by_symbol())})
    pair = lambda x, y: ((F.col("up") == x) & (F.col("up2") == y)).cast("long")
    cells = [f"c{x}{y}" for x, y in _CELLS]
    sums = [F.sum(F.coalesce(pair(x, y), F.lit(0))).alias(c) for c, (x, y) in zip(cells, _CELLS)]
    low, high = -wide - 1, step * last
    panes = b.filter(F.col("pane").between(low + 1, high)).groupBy("symbol", "pane").agg(F.count("*").alias("n"), F.max(F.abs("r")).alias("top"), *sums)
    grid = bars.select("symbol").distinct().withColumn("pane", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    order, upto = by_symbol("pane"), by_symbol("pane").rowsBetween(Window.unboundedPreceding, 0)
    t = grid.join(panes, ["symbol", "pane"], "left").select("symbol", "pane", "top", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("n", *cells)])
    span = 1
    while 2 * span <= wide + 1:  # top of a pane: the largest of span panes from it on
        t = t.withColumn("top", F.greatest("top", F.lead("top", span).over(order)))
        span *= 2
    # pairs that a window's end parts: they begin inside and end outside
    edge = F.filter(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("pane") / step)), F.floor((F.col("pane2") - 1) / step)), lambda j: j <= last)
    parted = b.filter((F.col("pane") > low) & (F.floor((F.col("pane2") - 1) / step) >= F.greatest(F.lit(0), F.ceil(F.col("pane") / step))))
    parted = parted.withColumn("j", F.explode(edge)).groupBy("symbol", "j").agg(*[s.alias(f"x{c}") for s, c in zip(sums, cells)])
    at = lambda place, name: t.select("symbol", place.alias("j"), *[F.col(c).alias(f"{name}_{c}") for c in ("n", *cells)], F.col("top").alias(f"{name}_top"))
    ends = at(F.col("pane") / step, "hi").filter((F.col("j") == F.floor("j")) & (F.col("j") >= 0)).withColumn("j", F.col("j").cast("long"))
    begins = at((F.col("pane") + 1 + wide) / step, "lo").filter((F.col("j") == F.floor("j")) & (F.col("j") <= last)).withColumn("j", F.col("j").cast("long"))
    tops = lambda shift, name: t.select("symbol", ((F.col("pane") + shift) / step).alias("j"), F.col("top").alias(name)).filter((F.col("j") == F.floor("j")) & F.col("j").between(0, last)).withColumn("j", F.col("j").cast("long"))
    d = ends.drop("hi_top").join(begins.drop("lo_top"), ["symbol", "j"]).join(tops(wide, "t1"), ["symbol", "j"]).join(tops(span - 1, "t2"), ["symbol", "j"])
    d = d.join(parted, ["symbol", "j"], "left")
    d = d.withColumns({c: F.col(f"hi_{c}") - F.col(f"lo_{c}") - F.coalesce(f"x{c}", F.lit(0)) for c in cells} | {"n": F.col("hi_n") - F.col("lo_n")})
    # windows of prices that lie inside a replay window; there are few
    starts = bars.groupBy("symbol", F.floor(F.col("idx") / w).alias("win")).agg(F.min("ts").alias("first_ts"))
    z = strided(bars, w, (q,)).filter("z IS NOT NULL").join(starts, ["symbol", "win"])
    j0, j1 = F.greatest(F.lit(0), F.ceil((F.col("end_ts") - start) / stride_ms)), F.least(F.lit(last), F.floor((F.col("first_ts") + window_ms - start) / stride_ms))
    z = z.filter(j0 <= j1).withColumn("j", F.explode(F.sequence(j0, j1))).groupBy("symbol", "j").agg(F.percentile("z", F.lit(0.5)).alias("median_z"), F.count("*").alias("n_windows"))
    d = d.filter("n > 0").join(z, ["symbol", "j"], "left")
    positive = F.greatest(F.lit(0.0), F.coalesce("median_z", F.lit(0.0)))
    windows = F.coalesce("n_windows", F.lit(1).cast("long"))
    mi = F.when(F.col("n") > q + 2, information_of_counts([F.col(c) for c in cells])).otherwise(0.0)
    return d.select(
        "symbol", (F.lit(start) + F.col("j") * stride_ms).alias("decision"), "n", F.greatest("t1", "t2").alias("top_move"), windows.alias("n_windows"),
        positive.alias("size"), (positive * F.sqrt(windows)).alias("sensitivity"), (mi * F.sqrt(F.greatest(F.col("n") - q, F.lit(1)))).alias("detector_information"),
    )


def maxima_thresholds(stats: DataFrame, alpha: dict[str, float], reps: int = 1000) -> DataFrame:
    """symbol, gate, n, top and threshold: the upper quantile, at the gate's alpha, of the largest statistic of a replay
    resampled by circular blocks of root n windows. stats: symbol, decision and a column a gate; a symbol has as many rows as
    replay windows. The maxima of all blocks are made once; a replicate is the largest of as many as it has blocks."""
    gates = list(alpha)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("v"), F.lit(1 - alpha[g]).alias("level")) for g in gates]))
    long = stats.select("symbol", "decision", each.alias("s")).select("symbol", "decision", "s.*")
    a = long.groupBy("symbol", "gate", "level").agg(F.array_sort(F.collect_list(F.struct("decision", "v"))).alias("x")).withColumn("x", F.col("x.v"))
    a = a.withColumns({"n": F.size("x"), "block": F.greatest(F.lit(1), F.round(F.sqrt(F.size("x"))).cast("int"))})
    a = a.withColumn("blocks", F.ceil(F.col("n") / F.col("block")).cast("int")).withColumn("tail", F.col("n") - (F.col("blocks") - 1) * F.col("block")).withColumn("ring", F.concat("x", "x"))
    tops = lambda size: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_max(F.slice("ring", i, F.col(size))))
    a = a.withColumns({"full": tops("block"), "rest": tops("tail"), "top": F.array_max("x")})
    draws = a.select("symbol", "gate", "level", "n", "top", "blocks", "full", "rest", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    start = lambda blk: (F.conv(F.substring(F.sha2(F.concat_ws("|", "symbol", "gate", "rep", blk), 256), 1, 15), 16, 10).cast("long") % F.col("n")).cast("int") + 1
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.when(k == F.col("blocks") - 1, F.element_at("rest", start(k))).otherwise(F.element_at("full", start(k))))
    m = draws.select("symbol", "gate", "level", "n", "top", F.array_max(blocks).alias("m"))
    return m.groupBy("symbol", "gate", "level", "n", "top").agg(F.collect_list("m").alias("m")).select("symbol", "gate", F.col("n").cast("long").alias("n"), "top", _upper("m", F.col("level")).alias("threshold"))


def _upper(values: str, level: Column) -> Column:
    s = F.array_sort(values)
    return F.element_at(s, F.ceil(level * (F.size(values) - 1)).cast("int") + 1)


def gated(stats: DataFrame, thresholds: DataFrame, gates=GATES) -> DataFrame:
    """stats with ok: whether each gate's statistic is above its threshold."""
    wide = thresholds.groupBy("symbol").agg(*[F.max(F.when(F.col("gate") == g, F.col("threshold"))).alias(f"__{g}") for g in gates])
    d, ok = stats.join(wide, "symbol", "left"), F.lit(True)
    for g in gates:
        ok = ok & F.coalesce(F.col(g) > F.col(f"__{g}"), F.lit(False))
    return d.withColumn("ok", ok).drop(*[f"__{g}" for g in gates])


def scheduled(windows: DataFrame, thresholds: DataFrame, on_start: int, on_end: int, delta: float, gates=GATES) -> DataFrame:
    """windows (symbol, decision) with signal_on and statistics made to pass in [on_start, on_end] and to fail outside: a
    margin of max(1, 5 delta) over the threshold, or a quarter of it."""
    wide = thresholds.groupBy("symbol").agg(*[F.max(F.when(F.col("gate") == g, F.col("threshold"))).alias(f"__{g}") for g in gates])
    on = F.col("decision").between(on_start, on_end)
    d = windows.select("symbol", "decision", on.alias("signal_on")).join(wide, "symbol")
    made = {g: F.when(F.col("signal_on"), F.col(f"__{g}") + max(1.0, 5 * delta)).otherwise(F.greatest(F.lit(0.0), 0.25 * F.col(f"__{g}"))) for g in gates}
    return d.withColumns(made).drop(*[f"__{g}" for g in gates])
