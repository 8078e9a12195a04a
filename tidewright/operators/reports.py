"""Nested reports: one row a task, with a map from detector to what was measured of it, as a struct and as checked JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import benchmark as B
from .windows import islands

DETECTOR = """struct<n:bigint, status:string, reasons:array<string>,
 occupancy:array<struct<state:int,n:bigint,share:double>>, transitions:array<array<bigint>>,
 runs:array<struct<state:int,runs:bigint,mean:double,median:double,longest:bigint>>,
 information:struct<mi:double,lo:double,hi:double,p:double,gross_bps:double,net_bps:double>>"""
PAIR = "struct<n:bigint,kappa:double,vi:double,nmi:double,ari:double>"
REPORT = f"struct<task:string,states:int,detectors:map<string,{DETECTOR}>,pairs:map<string,{PAIR}>>".replace("\n", "")
#: Distribution function of the Poisson law of mean 1, as far as 60-bit numbers tell.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217]


def poisson_weight(*parts) -> Column:
    """A weight of mean 1 from the SHA-256 of parts: how often a unit is in a resample."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("double") / float(16**15)
    return reduce(lambda a, b: a + b, [F.when(u > c, 1).otherwise(0) for c in _POISSON])


def table_information(cells: DataFrame, n: str, *by: str) -> DataFrame:
    """by and mi: information in counts n of (label, sign)."""
    w = lambda *c: Window.partitionBy(*by, *c)
    d = cells.filter(F.col(n) > 0).withColumns({"__r": F.sum(n).over(w("label")), "__c": F.sum(n).over(w("sign")), "__t": F.sum(n).over(w())})
    x = F.col(n) / F.col("__t") * F.ln(F.col(n) * F.col("__t") / (F.col("__r") * F.col("__c")))
    return d.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(x)).alias("mi"))


def information_intervals(long: DataFrame, cost_bps: float, reps: int = 500, permutations: int = 1000, alpha: float = 0.05, seed: int = 43) -> DataFrame:
    """detector, mi, lo, hi, p, gross_bps and net_bps: what labels tell about the sign of fwd; the interval by resampling symbols
    with Poisson weights, p by tables with the same margins. long: detector, symbol, label, fwd. Only counts move."""
    good = long.filter(F.col("fwd").isNotNull() & ~F.isnan("fwd"))
    cells = materialize(good.groupBy("detector", "symbol", "label", F.signum("fwd").cast("int").alias("sign")).agg(F.count("*").alias("c")), "cells")
    whole = cells.groupBy("detector", "label", "sign").agg(F.sum("c").alias("c"))
    point = table_information(whole, "c", "detector")
    # a weight is drawn once a symbol and replicate, for all its cells
    units = cells.groupBy("symbol").agg(F.collect_list(F.struct("detector", "label", "sign", "c")).alias("own"))
    units = units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", poisson_weight("symbol", "rep")).filter("w > 0")
    drawn = units.select("rep", "w", F.explode("own").alias("x")).select("x.detector", "rep", "x.label", "x.sign", (F.col("x.c") * F.col("w")).alias("m"))
    boot = table_information(drawn.groupBy("detector", "rep", "label", "sign").agg(F.sum("m").alias("m")), "m", "detector", "rep")
    ends = boot.groupBy("detector").agg(F.percentile("mi", F.lit(alpha / 2)).alias("lo"), F.percentile("mi", F.lit(1 - alpha / 2)).alias("hi"))
    shares = 20
    tables = whole.groupBy("detector").agg(F.array_sort(F.collect_list(F.struct("label", "sign", "c"))).alias("t")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(shares, "detector", "share")

    def draw(batches):
        """Of each detector and share: tables with the margins seen that tell at least as much."""
        import zlib

        import numpy as np
        import pandas as pd

        def mi(t):
            e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
            return float((t[t > 0] / t.sum() * np.log(t[t > 0] / e[t > 0])).sum())

        for b in batches:
            out = []
            for name, cells, share in zip(b["detector"], b["t"], b["share"]):
                rows, cols = sorted({c["label"] for c in cells}), sorted({c["sign"] for c in cells})
                t = np.zeros((len(rows), len(cols)), np.int64)
                for c in cells:
                    t[rows.index(c["label"]), cols.index(c["sign"])] = c["c"]
                seen, hits, tried = mi(t) - 1e-12, 0, range(int(share), permutations, shares)
                for r in tried:
                    rng, left, made = np.random.default_rng([seed, zlib.crc32(name.encode()), r]), t.sum(0), []
                    for m in t.sum(1)[:-1]:
                        made.append(rng.multivariate_hypergeometric(left, m, method="marginals"))
                        left = left - made[-1]
                    hits += mi(np.array([*made, left])) >= seen
                out.append((name, hits, len(tried)))
            yield pd.DataFrame(out, columns=["detector", "hits", "tried"])

    p = tables.mapInPandas(draw, "detector string, hits long, tried long").groupBy("detector").agg(((1 + F.sum("hits")) / (1 + F.sum("tried"))).alias("p"))
    d = point.join(ends, "detector").join(p, "detector")
    return d.withColumns({"lo": F.least("lo", "mi"), "hi": F.greatest("hi", "mi"), "gross_bps": 1e4 * F.col("mi"), "net_bps": 1e4 * F.col("mi") - cost_bps})


def _listed(df: DataFrame, name: str, *fields: str) -> DataFrame:
    return df.groupBy("detector").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def task_report(wide: DataFrame, names: list[str], task: str, states: int, stride: int = 120, least: int = 30, cost_bps: float = 10.0, reps: int = 500, permutations: int = 1000) -> DataFrame:
    """One row: task, states, detectors and pairs, over the bars to which every detector gives a label. wide: symbol, idx, fwd
    and a column of labels for each name."""
    both = materialize(wide.filter(reduce(lambda a, b: a & b, (F.col(n) >= 0 for n in names))).select("symbol", "idx", "fwd", *names), "task")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("detector"), F.col(n).cast("int").alias("label")) for n in names]))
    long = both.select("symbol", "idx", "fwd", each.alias("e")).select("symbol", "idx", "fwd", "e.*")
    counts = B.state_counts(long, states, stride, "detector", "symbol").groupBy("detector").agg(F.sum("n_valid").alias("n"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in range(states)])
    head = B.validity(counts, states, least).select("detector", "n", "status", "reasons")
    every = long.select("detector").distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    seen = long.groupBy("detector", F.col("label").alias("state")).agg(F.count("*").alias("n"))
    total = Window.partitionBy("detector")
    occupied = every.join(seen, ["detector", "state"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("share", F.col("n") / F.sum("n").over(total))
    series = long.withColumn("symbol", F.struct("detector", "symbol"))
    series = materialize(islands(series, "label").select("detector", "symbol", "idx", "label", "run"), "runs")
    steps = series.groupBy("detector", "symbol", "run").agg(F.first("label").alias("state"), F.count("*").alias("len"))
    steps = materialize(steps, "steps")
    spans = steps.groupBy("detector", "state").agg(F.count("*").alias("runs"), F.avg("len").alias("mean"), F.percentile("len", F.lit(0.5)).alias("median"), F.max("len").alias("longest"))
    # a run of n bars stays n - 1 times; the next run of the series says where it goes
    onward = F.lead("state").over(Window.partitionBy("detector", "symbol").orderBy("run"))
    moves = steps.withColumn("to", onward).filter("to IS NOT NULL").groupBy("detector", F.col("state").alias("from"), "to").agg(F.count("*").alias("k"))
    stays = steps.groupBy("detector", F.col("state").alias("from"), F.col("state").alias("to")).agg(F.sum(F.col("len") - 1).alias("k"))
    known = moves.unionByName(stays).groupBy("detector").agg(F.map_from_entries(F.collect_list(F.struct(F.col("from") * states + F.col("to"), "k"))).alias("k"))
    grid = F.array(*[F.array(*[F.coalesce(F.try_element_at("k", F.lit(a * states + b)), F.lit(0).cast("long")) for b in range(states)]) for a in range(states)])
    info = information_intervals(long, cost_bps, reps, permutations).select("detector", F.struct("mi", "lo", "hi", "p", "gross_bps", "net_bps").alias("information"))
    d = head.join(_listed(occupied, "occupancy", "state", "n", "share"), "detector").join(known.select("detector", grid.alias("transitions")), "detector").join(_listed(spans, "runs", "state", "runs", "mean", "median", "longest"), "detector").join(info, "detector", "left")
    fields = ("n", "status", "reasons", "occupancy", "transitions", "runs", "information")
    entry = F.struct("detector", F.struct(*fields).cast(DETECTOR.replace("\n", "")).alias("d"))
    report = d.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("detectors"))  # a few detectors
    pairs = B.agreement_of_pairs(both, names).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", F.struct("n", "kappa", "vi", "nmi", "ari").cast(PAIR))))).alias("pairs"))
    return report.crossJoin(pairs).select(F.lit(task).alias("task"), F.lit(states).alias("states"), "detectors", "pairs")  # one row each


def as_json(reports: DataFrame) -> DataFrame:
    """A column json of reports."""
    return reports.select(F.to_json(F.struct("task", "states", "detectors", "pairs").cast(REPORT), {"ignoreNullFields": "false"}).alias("json"))


def from_checked_json(lines: DataFrame, column: str = "json") -> DataFrame:
    """Reports of a JSON column; text that isn't JSON of the declared types, or lacks the task, its detectors or pairs, is an error."""
    r = F.from_json(F.col(column), REPORT, {"mode": "FAILFAST"})
    d = lines.select(r.alias("r"), F.col(column).alias("text"))
    whole = F.col("r.task").isNotNull() & F.col("r.detectors").isNotNull() & F.col("r.pairs").isNotNull()
    bad = F.raise_error(F.concat(F.lit("not a report: "), F.substring(F.coalesce("text", F.lit("null")), 1, 80))).cast(REPORT)
    return d.select(F.when(whole, F.col("r")).otherwise(bad).alias("r")).select("r.*")


def disposition(reports: DataFrame, high: float = 0.6, low: float = 0.2) -> DataFrame:
    """One verdict on all tasks of a run, as benchmark.classification() gives it."""
    status = reports.select(F.explode(F.map_values("detectors")).alias("d")).select("d.status")
    return B.classification(status, reports.select(F.explode(F.map_values("pairs")).alias("p")).select("p.nmi"), high, low)


SPAN = "struct<start:string,end:string,n_bars:bigint,first_ts:bigint,last_ts:bigint,holdout_loaded:boolean,partial_holdout:boolean>"
CELL = "struct<q:int,n:bigint,median_dev:double,median_z:double,p:double,p_holm:double,fires:boolean>"


def spans(bars: DataFrame, holdout_year: int) -> DataFrame:
    """symbol and span: first and last day, bars, and whether bars of the held-out years are among them, alone or not."""
    day = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    g = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_bars"), F.bool_or(F.col("year") >= holdout_year).alias("held"), F.bool_or(F.col("year") < holdout_year).alias("before"))
    s = F.struct(day("first_ts").alias("start"), day("last_ts").alias("end"), "n_bars", "first_ts", "last_ts", F.col("held").alias("holdout_loaded"), (F.col("held") & F.col("before")).alias("partial_holdout"))
    return g.select("symbol", s.cast(SPAN).alias("span"))


def replication(bars: DataFrame, w: int = 120, horizons=(2, 5, 15, 60), primary: int = 5, holdout_year: int = 2026, alpha: float = 0.05) -> DataFrame:
    """One nested row for each symbol: span, cells by horizon, primary (its cell, or the first that there is), and fired: whether
    a cell whose median z is positive is rejected by Holm's procedure. bars: symbol, idx, ts, close, year."""
    from ..functions.columns import two_sided_p
    from .measures import holm
    from .variance_ratio import significance, strided

    s = significance(strided(bars, w, horizons), "symbol").withColumn("p", two_sided_p(F.col("median_z")))
    s = holm(s, "p", "symbol", family=len(horizons)).withColumn("fires", (F.col("p_holm") < alpha) & (F.col("median_z") > 0))
    cell = F.struct("q", "n", "median_dev", "median_z", "p", "p_holm", "fires").cast(CELL)
    g = s.groupBy("symbol").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    own = F.filter("cells", lambda c: c["q"] == primary)
    chosen = F.coalesce(F.get(own, F.lit(0)), F.get("cells", F.lit(0)))
    fired = F.exists(F.coalesce("cells", F.array().cast(f"array<{CELL}>")), lambda c: c["fires"])
    return spans(bars, holdout_year).join(g, "symbol", "left").select("symbol", "span", "cells", chosen.alias("primary"), fired.alias("fired"))
