"""Comparison of label streams: validity gates, agreement of pairs, what labels tell about returns, classification."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import two_sided_p, zero_filled
from ..sources.shared import materialize
from . import measures as M

#: Fixed values, here and below: the names of statuses, reasons and verdicts.
VALID, FAILED, EXCLUDED = "valid", "instrument_failure", "excluded"


def state_counts(df: DataFrame, states: int, stride: int, *by: str) -> DataFrame:
    """By by: labelled rows, and how many of the rows that lie whole strides after the first labelled one have each state."""
    first = F.min(F.when(F.col("label") >= 0, F.col("idx")))
    # without by, a window would take the whole table to one task
    df = df.withColumn("__first", first.over(Window.partitionBy(*by))) if by else df.crossJoin(F.broadcast(df.agg(first.alias("__first"))))
    on_grid = (F.col("idx") >= F.col("__first")) & ((F.col("idx") - F.col("__first")) % stride == 0)
    d = df.withColumn("__l", F.when(on_grid, F.col("label")))
    return d.groupBy(*by).agg(F.sum((F.col("label") >= 0).cast("long")).alias("n_valid"), *zero_filled(F.col("__l"), states))


def validity(counts: DataFrame, states: int, least: int, eligible: Column | None = None, converged: Column | None = None, deterministic: Column | None = None, separation: Column | None = None, least_separation: float = 0.05) -> DataFrame:
    """counts with status and reasons, which name all gates that fail; what isn't a common state is excluded at once."""
    yes = F.lit(True)
    gates = [(converged if converged is not None else yes, "convergence_failed"), (deterministic if deterministic is not None else yes, "determinism_failed")]
    gates += [(F.col(f"n_{k}") >= least, f"state_{k}_nonoverlap_below_{least}") for k in range(states)]
    if separation is not None:
        gates.append((separation >= least_separation, f"variance_separation_below_{least_separation:.2f}"))
    reasons = F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in gates]), lambda x: x.isNotNull())
    out = eligible if eligible is not None else yes
    reasons = F.when(out, reasons).otherwise(F.array(F.lit("target_not_common_market_state")))
    return counts.withColumn("reasons", reasons).withColumn("status", F.when(~out, EXCLUDED).when(F.size("reasons") > 0, FAILED).otherwise(VALID))


def agreement_of_pairs(streams: DataFrame, names: list[str]) -> DataFrame:
    """Agreement of each pair of label columns over the rows where every column has a label."""
    both = streams.filter(reduce(lambda a, b: a & b, (F.col(n) >= 0 for n in names)))
    counts = materialize(both.groupBy(*names).agg(F.count("*").alias("__c")), "labels")  # rows for sets of labels; every pair reads them
    rows = [M.agreement(counts, a, b, "__c").select(F.lit(f"{a}__{b}").alias("pair"), "*") for a, b in combinations(names, 2)]
    return reduce(DataFrame.unionByName, rows)


def classification(statuses: DataFrame, pairs: DataFrame, high: float = 0.6, low: float = 0.2) -> DataFrame:
    """One verdict on a run: a failed instrument first, then by the least and the largest agreement of the pairs."""
    a = statuses.agg(F.max((F.col("status") == FAILED).cast("int")).alias("failed"))
    b = pairs.agg(F.min("nmi").alias("least"), F.max("nmi").alias("most"))
    verdict = F.when(F.col("failed") == 1, "instrument_failure").when(F.col("least").isNull(), "mixed_family_structure").when(F.col("least") >= high, "harmonized_convergence").when(F.col("most") <= low, "persistent_disagreement").otherwise("mixed_family_structure")
    return a.crossJoin(b).select(verdict.alias("classification"), "least", "most")  # one row each


def contingent_information(df: DataFrame, label: str, forward: str, states: int, cost_bps: float) -> DataFrame:
    """One row: n, information of the label about the sign of the forward return, gross and net bounds in basis points, and
    by state the number, mean, median and positive share of forward returns."""
    f = F.col(forward)
    d = df.filter((F.col(label) >= 0) & (F.col(label) < states) & f.isNotNull() & ~F.isnan(f))
    d = materialize(d.select(label, forward), "forward")  # read several times
    mi = M.mutual_information(d.withColumn("__s", F.signum(f)), label, "__s").select("n", "mi")
    per = d.groupBy(label).agg(F.count("*").alias("n"), F.avg(f).alias("mean"), F.avg((f > 0).cast("double")).alias("positive"))
    per = per.join(M.exact_quantiles(d, f, {"median": 0.5}, label).drop("n"), label)  # a row a state; no task gathers a state's returns
    of = lambda k, c: F.max(F.when(F.col(label) == k, F.col(c)))
    parts = [c for k in range(states) for c in (F.coalesce(of(k, "n"), F.lit(0)).alias(f"n_{k}"), *(of(k, x).alias(f"{x}_{k}") for x in ("mean", "median", "positive")))]
    return mi.crossJoin(per.agg(*parts)).withColumns({"gross_bps": 1e4 * F.col("mi"), "net_bps": 1e4 * F.col("mi") - cost_bps})  # one row each


def window_triggers(vr: DataFrame, target: int, horizons: int, alpha: float = 0.05) -> DataFrame:
    """A row for each window with all z finite: label 1 if the target horizon's z is positive and Holm's procedure over
    the horizons rejects it."""
    w = Window.partitionBy("symbol", "win")
    v = vr.withColumn("__n", F.count("z").over(w)).filter(F.col("__n") == horizons)
    v = M.holm(v.withColumn("p", two_sided_p(F.col("z"))).select("symbol", "win", "end_idx", "q", "z", "p"), "p", "symbol", "win", family=horizons)
    hit = (F.col("p_holm") < alpha) & (F.col("z") > 0)
    return v.filter(F.col("q") == target).select("symbol", "win", F.col("end_idx").alias("idx"), hit.cast("int").alias("label"))


def trigger_report(triggers: DataFrame, forward: DataFrame, cost_bps: float) -> DataFrame:
    """One row: labels, triggers, rate, label entropy, and contingent_information() of the trigger. forward: symbol, idx, fwd."""
    n, t = F.count("*"), F.sum("label")
    r = t / n
    plain = lambda p: F.when((p > 0) & (p < 1), -p * F.ln(p)).otherwise(0.0)
    head = triggers.agg(n.alias("n_labels"), t.cast("long").alias("n_triggers"), r.alias("rate"), (plain(r) + plain(1 - r)).alias("entropy"))
    return head.crossJoin(contingent_information(triggers.join(forward, ["symbol", "idx"]), "label", "fwd", 2, cost_bps))  # one row each


def decision(vr: DataFrame, labels: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The cascade by symbol and horizon: median and mean |VR - 1|, median z and its p over the windows that end at a
    labelled bar, p after Holm for four tests, and whether the horizon fires."""
    kept = vr.join(labels.filter("label >= 0").select("symbol", F.col("idx").alias("end_idx")), ["symbol", "end_idx"]).filter("vr_dev IS NOT NULL")
    s = kept.groupBy("symbol", "q").agg(F.count("*").alias("n"), F.percentile(F.abs("vr_dev"), F.lit(0.5)).alias("median_dev"), F.avg(F.abs("vr_dev")).alias("mean_dev"), F.percentile("z", F.lit(0.5)).alias("median_z"))
    s = M.holm(s.withColumn("p", two_sided_p(F.col("median_z"))), "p", "symbol", family=4)
    return s.withColumns({"closed": F.col("median_dev") < 0.001, "fires": (F.col("p_holm") < alpha) & (F.col("median_z") > 0)})


def persistent(df: DataFrame, state: int, least: int) -> DataFrame:
    """Rows in runs of at least least bars of the state."""
    from .windows import islands

    runs = islands(df, "label")
    return runs.withColumn("__n", F.count("*").over(Window.partitionBy("symbol", "run"))).filter((F.col("label") == state) & (F.col("__n") >= least)).drop("run", "__n")


def gate_verdict(cells: DataFrame, floor: float = 0.01) -> DataFrame:
    """cells (degenerate, epsilon_sq) with verdict: inconclusive without a test statistic, a degenerate series fails, else
    the effect size decides."""
    e = F.col("epsilon_sq")
    return cells.withColumn("verdict", F.when(e.isNull() | F.isnan(e), "INCONCLUSIVE").when(~F.col("degenerate") & (e > floor), "PASS").otherwise("FAIL"))
