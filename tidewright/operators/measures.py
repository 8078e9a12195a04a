"""Statistics of values and label streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .order_statistics import masked_ranks, ranks
from .windows import group_ranks, rank_average, table_ranks


def spearman(df: DataFrame, x: str, y: str, *by: str, least: int = 10, few: bool = False) -> DataFrame:
    """Rank correlation of pairs without nulls, null for fewer than least. few: the groups are few and large, so that none of
    them is put in order in one task; pairs move as counts then."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    if few:
        pairs = materialize(d.groupBy(*by, x, y).agg(F.count("*").alias("__c")), "pairs")
        for v, name in ((x, "__x"), (y, "__y")):
            pairs = pairs.join(ranks(pairs, v, *by, weight="__c").select(*by, v, F.col("rank").alias(name), F.col("n").alias("__n")), [*by, v]).drop(*(["__n"] if name == "__x" else []))
        m = (F.col("__n") + 1) / 2
        part = lambda a, b: F.sum(F.col("__c") * (F.col(a) - m) * (F.col(b) - m))
        ic = part("__x", "__y") / F.sqrt(part("__x", "__x") * part("__y", "__y"))
        out = pairs.groupBy(*by).agg(F.sum("__c").alias("n"), ic.alias("ic"))
    else:
        if by:
            d = group_ranks(d.select(*by, x, y), [*by], (x, y), ("__x", "__y"))
        else:
            d = d.withColumn("__x", rank_average(F.col(x))).withColumn("__y", rank_average(F.col(y)))
        out = d.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("ic"))
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def spearman_by_mask(df: DataFrame, x: str, y: str, masks: dict[str, Column], least: int = 10) -> DataFrame:
    """name, n, ic: spearman() of the rows that each of a few masks lets through. A row moves once for each of its two ranks, whatever the
    number of masks; masks without a pair have no row."""
    keep = {f"__m{k}": F.coalesce(m, F.lit(False)).cast("int") for k, m in enumerate(masks.values())}
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(F.col(x).alias("__x"), F.col(y).alias("__y"), *[m.alias(k) for k, m in keep.items()])
    d = materialize(d.filter(F.greatest(*keep, F.lit(0)) > 0), "masked")
    for v in ("__x", "__y"):
        d = masked_ranks(d, v, {k: v + k for k in keep}).drop(v)
    own = lambda v, k: F.when(F.col(k) == 1, F.col(v + k))
    each = d.agg(*[F.sum(k).alias(f"n{k}") for k in keep], *[F.covar_pop(own("__x", k), own("__y", k)).alias(f"c{k}") for k in keep], *[F.sqrt(F.var_pop(own("__x", k)) * F.var_pop(own("__y", k))).alias(f"s{k}") for k in keep])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"n{k}").alias("n"), F.when(F.col(f"s{k}") > 0, F.col(f"c{k}") / F.col(f"s{k}")).otherwise(F.lit(float("nan"))).alias("ic")) for k, name in zip(keep, masks)]))
    out = each.select(rows.alias("e")).select("e.*").filter("n > 0")
    return out.withColumn("ic", F.when(F.col("n") >= least, F.col("ic")))


def exact_quantiles(df: DataFrame, value: Column, ps: dict[str, float], *by: str, accuracy: int = 10_000) -> DataFrame:
    """By by, groups few and large: n, and the interpolated quantiles ps by name, exactly. A sketch of bounded size brackets
    each quantile; values below a bracket are counted, those inside are put in order, a few in ten thousand."""
    d = df.select(*by, value.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    slack, names = 2 / accuracy, list(ps)
    ends = [min(1.0, max(0.0, p + s)) for p in ps.values() for s in (-slack, slack)]
    sketch = d.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", ends, accuracy).alias("__e"))
    d = d.crossJoin(F.broadcast(sketch)) if not by else d.join(F.broadcast(sketch), [*by])  # a row a group
    v, lo, hi = F.col("__v"), [F.col("__e")[2 * k] for k in range(len(ps))], [F.col("__e")[2 * k + 1] for k in range(len(ps))]
    below = d.groupBy(*by).agg(*[F.sum((v < a).cast("long")).alias(f"__b{k}") for k, a in enumerate(lo)], F.array(*[F.max(F.when(v < a, v)) for a in lo]).alias("__under"), F.array(*[F.min(F.when(v > b, v)) for b in hi]).alias("__over"))
    inside = F.array_compact(F.array(*[F.when((v >= a) & (v <= b), F.lit(k)) for k, (a, b) in enumerate(zip(lo, hi))]))
    near = d.select(*by, "n", "__v", F.explode(inside).alias("__k")).groupBy(*by, "n", "__k", "__v").agg(F.count("*").alias("__c"))
    near = near.crossJoin(F.broadcast(below)) if not by else near.join(F.broadcast(below), [*by])
    upto = F.sum("__c").over(Window.partitionBy(*by, "__k").orderBy("__v")) + F.array(*[F.col(f"__b{k}") for k in range(len(ps))])[F.col("__k")]
    place = F.array(*[F.lit(p) for p in ps.values()])[F.col("__k")] * (F.col("n") - 1)
    near = near.withColumns({"__u": upto, "__p": place})
    at = lambda r: F.max(F.when((r >= F.col("__u") - F.col("__c")) & (r < F.col("__u")), F.col("__v")))
    g = near.groupBy(*by, "n", "__k").agg(at(F.floor("__p")).alias("__x"), at(F.ceil("__p")).alias("__y"), F.max(F.col("__p") - F.floor("__p")).alias("__f"), F.max(F.col("__under")[F.col("__k")]).alias("__under"), F.max(F.col("__over")[F.col("__k")]).alias("__over"))
    # of a few values, the neighbour that a quantile lies next to may be the one outside the bracket
    x, y = F.coalesce("__x", "__under"), F.coalesce("__y", "__over")
    g = g.withColumn("__q", x + F.col("__f") * (y - x))
    return g.groupBy(*by, "n").agg(*[F.max(F.when(F.col("__k") == k, F.col("__q"))).alias(name) for k, name in enumerate(names)])


def joint(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Counts of value pairs with their margins and total; with weight, rows stand for so many."""
    j = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    return j.withColumns({"nx": F.sum("n").over(Window.partitionBy("x")), "ny": F.sum("n").over(Window.partitionBy("y")), "total": F.sum("n").over(all_)})


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Plug-in mutual information and entropies in nats."""
    j = joint(df, x, y)
    p = F.col("n") / F.col("total")
    mi = F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny"))))
    hx = -F.sum(p * F.ln(F.col("nx") / F.col("total")))
    hy = -F.sum(p * F.ln(F.col("ny") / F.col("total")))
    return j.agg(F.greatest(mi, F.lit(0.0)).alias("mi"), hx.alias("h_x"), hy.alias("h_y"), F.max("total").alias("n"))


def agreement(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """Cohen's kappa, variation of information, normalised mutual information, adjusted Rand index of two label streams."""
    j = joint(df, x, y, weight)
    pairs = lambda c: c * (c - 1) / 2
    s = j.agg(
        F.max("total").alias("n"),
        F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"),
        F.sum(F.when(F.col("x") == F.col("y"), F.col("nx") * F.col("ny")).otherwise(0)).alias("chance"),
        F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"),
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("nx") / F.col("total")))).alias("hx"),
        (-F.sum(F.col("n") / F.col("total") * F.ln(F.col("ny") / F.col("total")))).alias("hy"),
        F.sum(pairs(F.col("n"))).alias("pij"),
        F.sum(F.col("n") * (F.col("nx") - 1) / 2).alias("px"),
        F.sum(F.col("n") * (F.col("ny") - 1) / 2).alias("py"),
    )
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    expected = F.col("px") * F.col("py") / (F.col("n") * (F.col("n") - 1) / 2)
    return s.select(
        "n", F.try_divide(po - pe, 1 - pe).alias("kappa"), F.greatest(F.col("hx") + F.col("hy") - 2 * F.col("mi"), F.lit(0.0)).alias("vi"),
        F.coalesce(F.try_divide(2 * F.col("mi"), F.col("hx") + F.col("hy")), F.lit(1.0)).alias("nmi"),
        F.coalesce(F.try_divide(F.col("pij") - expected, (F.col("px") + F.col("py")) / 2 - expected), F.lit(1.0)).alias("ari"),
    )


def agreement_by_state(df: DataFrame, x: str, y: str) -> DataFrame:
    """state, n, share: of the rows to which x gives the state, those to which y does, too."""
    j = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return j.groupBy(F.col(x).alias("state")).agg(F.count("*").alias("n"), F.avg((F.col(x) == F.col(y)).cast("int")).alias("share"))


def zero_filled(counts: DataFrame, keys: dict[str, int], n: str = "n") -> DataFrame:
    """counts with a row for every combination of the keys' values from 0 up, 0 where there was none. A few states."""
    grid = counts.sparkSession.range(1).select()
    for k, m in keys.items():
        grid = grid.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return grid.join(counts, list(keys), "left").withColumn(n, F.coalesce(n, F.lit(0)))


def degeneracy(df: DataFrame, value: str, *by: str, few: bool = False) -> DataFrame:
    """Spread of a value in [0, 1]: std, coefficient of variation, interquartile range, shares at the rails. few: the groups are
    few and large, so that no task gathers the values of one."""
    v = F.col(value)
    iqr = F.lit(None).cast("double") if few else F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))
    d = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), iqr.alias("iqr"), F.avg(F.when(v >= 0.95, 1.0).otherwise(0.0)).alias("rail"), F.avg(F.when(v <= 0.001, 1.0).otherwise(0.0)).alias("zero"))
    if few:
        q = exact_quantiles(df, v, {"__q1": 0.25, "__q3": 0.75}, *by)
        d = d.join(q.drop("n"), [*by], "left").withColumn("iqr", F.col("__q3") - F.col("__q1")).drop("__q1", "__q3")
    return d.withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and its effect size. Rows move as counts of (value, group)."""
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(value, group).agg(F.count("*").alias("__c"))
    d = materialize(d, "counts")  # read three times
    placed = ranks(d, value, weight="__c").select(value, "rank")
    ties = d.groupBy(value).agg(F.sum("__c").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    g = d.join(placed, value).groupBy(group).agg(F.sum("__c").alias("m"), F.sum(F.col("rank") * F.col("__c")).alias("s")).agg(F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"), F.count("*").alias("k"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return g.crossJoin(ties).select("n", "k", h.alias("h"), (h * (n + 1) / (n * n - 1)).alias("epsilon_sq"))  # one row each


def holm(df: DataFrame, p: str, *by: str, family: int | None = None) -> DataFrame:
    """df with p_holm: step-down adjusted p, null as 1; the family may be larger than the list."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.coalesce(p, F.lit(1.0)), *[c for c in df.columns if c not in (p, *by)])
    m = F.lit(family) if family else F.count("*").over(w)
    d = df.withColumn("__k", F.row_number().over(order)).withColumn("__m", m)
    scaled = F.coalesce(p, F.lit(1.0)) * (F.col("__m") - F.col("__k") + 1)
    return d.withColumn("__s", scaled).withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(w.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)))).drop("__k", "__m", "__s")


#: Two-sided critical |z| at 0.05 / 4, / 3, / 2 and / 1.
CRITICAL = (2.497705474412374, 2.3939797998185104, 2.241402727604947, 1.959963984540054)


def cascade(medians: DataFrame, *by: str) -> DataFrame:
    """Whether, among the horizons' median z, one that Holm's procedure rejects at 0.05 is positive: the largest |z| is
    held against the hardest critical value, and so on until one fails."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(F.abs("median_z").desc(), "q"))
    passes = medians.withColumn("k", k).withColumn("ok", F.abs("median_z") > F.element_at(F.array(*map(F.lit, CRITICAL)), F.col("k").cast("int")))
    passes = passes.withColumn("rejected", F.min(F.col("ok").cast("int")).over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return passes.groupBy(*by).agg(F.max(F.col("rejected") & (F.col("median_z") > 0)).alias("fired"), F.sum(F.col("rejected").cast("long")).alias("n_rejected"))


def certificate(gates: DataFrame) -> DataFrame:
    """Disposition of each instrument by the first gate that fails, in order: instrument, target, size, transport, power,
    value. gates: name and one boolean (null: not measured) for each."""
    order = ("instrument", "target", "size", "transport", "power", "value")
    d = F.lit(None).cast("string")
    for g in reversed(order):
        d = F.when(F.col(g) == F.lit(False), F.lit(f"{g}_failure")).otherwise(d)
    missing = F.lit(False)
    for g in order:
        missing = missing | F.col(g).isNull()
    return gates.withColumn("disposition", F.coalesce(d, F.when(missing, "incomplete").otherwise("admissible")))


def e_value(p: Column, kappa: float = 0.5) -> Column:
    """Calibrator kappa * p ** (kappa - 1)."""
    return kappa * F.pow(p, F.lit(kappa - 1))
