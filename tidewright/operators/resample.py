"""Resampling and simulation. Block starts come from SHA-256 of series, replicate and block, so that any engine, task or
retry draws the same; simulated paths come from one numpy generator a task, seeded by cell and draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import by_symbol
from ..sources.shared import materialize
from .measures import CRITICAL, joint
from .variance_ratio import kernel


def seed_of(*parts) -> Column:
    """A seed from the text of parts: the first 16 hexadecimal digits of their SHA-256, as an unsigned number."""
    text = F.concat(*[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def block_bootstrap_ci(df: DataFrame, value: str, block: int = 20, reps: int = 200, alpha: float = 0.05, whole: int = 100_000) -> DataFrame:
    """Circular block bootstrap of a mean, by symbol: n, reps, lo, hi; series shorter than two blocks have no interval. The
    sums of all blocks are made once; a replicate is a sum of as many as it has blocks. Series of up to whole rows draw from their own
    array of sums, so that no drawn block moves; longer ones send their blocks to the sums."""
    d = df.filter(F.col(value).isNotNull()).withColumn("i", (F.row_number().over(by_symbol()) - 1).cast("long")).select("symbol", "i", value)
    d = materialize(d, "series")  # read for short and for long series
    n = d.groupBy("symbol").agg(F.count("*").alias("n"))
    short = n.filter(F.col("n") <= whole)
    m = _short_means(d.join(short, "symbol"), value, block, reps)
    if not n.filter(F.col("n") > whole).isEmpty():
        m = m.unionByName(_long_means(d, n.filter(F.col("n") > whole), value, block, reps))
    m = m.withColumn("m", F.when(F.col("n") >= 2 * block, F.col("m")))
    return m.groupBy("symbol", "n").agg(F.count("*").alias("reps"), F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))


def _start(symbol: Column, rep: Column, blk: Column, n: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", symbol, rep, blk), 256), 1, 15), 16, 10).cast("long") % n


def _short_means(d: DataFrame, value: str, block: int, reps: int) -> DataFrame:
    """symbol, n, rep, m of series (symbol, i, value, n), each an array of running sums over its ring."""
    x = d.groupBy("symbol", "n").agg(F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v")))).alias("c")).select("symbol", "n", F.col("c.v").alias("v"))
    # sums of a block, and of the rest that the last one gives, from each place of the ring
    rest = (F.col("n") - 1) % block + 1
    of = lambda m: F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.aggregate(F.slice("ring", i.cast("int"), m.cast("int")), F.lit(0.0), lambda a, y: a + y))
    x = x.withColumn("ring", F.concat("v", F.slice("v", 1, block))).select("symbol", "n", of(F.lit(block)).alias("full"), of(rest).alias("tail"))
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    last = F.floor((F.col("n") - 1) / block)
    place = lambda k: (_start(F.col("symbol"), F.col("rep"), k, F.col("n")) + 1).cast("int")
    heads = F.when(last > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(last - 1, F.lit(0))), F.lit(0.0), lambda a, k: a + F.element_at("full", place(k)))).otherwise(0.0)
    return x.select("symbol", "n", "rep", ((heads + F.element_at("tail", place(last))) / F.col("n")).alias("m"))


def _long_means(d: DataFrame, n: DataFrame, value: str, block: int, reps: int) -> DataFrame:
    """As _short_means(), blocks joined with the sums."""
    ring = d.select("symbol", "i", F.col(value).alias("v")).join(n, "symbol")
    ring = ring.unionByName(ring.filter(F.col("i") < block).withColumn("i", F.col("i") + F.col("n")))
    ahead = lambda m: F.sum("v").over(by_symbol("i").rowsBetween(0, m - 1))
    rest = (F.col("n") - 1) % block + 1  # rows that the last block gives
    tails = F.array(*[ahead(m) for m in range(1, block + 1)])
    sums = ring.select("symbol", F.col("i").alias("start"), "n", ahead(block).alias("full"), F.element_at(tails, rest.cast("int")).alias("tail")).filter(F.col("start") < F.col("n")).drop("n")
    s = n.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + block - 1) / block) - 1)))
    start = _start(F.col("symbol"), F.col("rep"), F.col("blk"), F.col("n"))
    last = F.col("blk") == F.floor((F.col("n") - 1) / block)
    return s.withColumn("start", start).join(sums, ["symbol", "start"]).groupBy("symbol", "n", "rep").agg((F.sum(F.when(last, F.col("tail")).otherwise(F.col("full"))) / F.first("n")).alias("m"))


def permutation_p(df: DataFrame, x: str, y: str, reps: int = 1000, seed: int = 7) -> DataFrame:
    """Mutual information of two label streams and its permutation p, (1 + hits) / (1 + reps). A permutation of labels only
    changes the table of counts, which is drawn with its margins; the labels themselves don't move."""
    table = joint(df, x, y).select("x", "y", "n", "nx", "ny")
    rows = df.sparkSession.range(reps, numPartitions=8)
    cells = [tuple(r) for r in table.collect()]  # label sets are small
    xs, ys = sorted({(c[0], c[3]) for c in cells}), sorted({(c[1], c[4]) for c in cells})

    def mi(t):
        import numpy as np

        n = t.sum()
        e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
        with np.errstate(all="ignore"):
            return float(np.where(t > 0, t / n * np.log(t * n / e), 0).sum())

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for r in b["id"]:
                rng, left, t = np.random.default_rng([seed, int(r)]), np.array([n for _, n in ys]), []
                for _, n in xs[:-1]:
                    d = rng.multivariate_hypergeometric(left, n)
                    t.append(d)
                    left = left - d
                out.append(mi(np.array([*t, left], float)))
            yield pd.DataFrame({"mi": out})

    import numpy as np

    seen = np.zeros((len(xs), len(ys)))
    for c in cells:
        seen[[v for v, _ in xs].index(c[0]), [v for v, _ in ys].index(c[1])] = c[2]
    point = mi(seen) if cells else 0.0
    null = rows.mapInPandas(run, "mi double")
    return null.agg(F.lit(round(point, 9)).alias("mi"), ((1 + F.sum((F.col("mi") >= point - 1e-12).cast("long"))) / (1 + F.count("*"))).alias("p"), F.round(F.percentile("mi", F.lit(0.95)), 9).alias("null_p95"))


def power_grid(spark: SparkSession, phis, n_mc: int = 200, n_bars: int = 50_000, w: int = 120, sigma: float = 1e-3, horizons=(2, 5, 15, 60), seed: int = 43) -> DataFrame:
    """Detection share of the variance-ratio cascade on simulated paths with AR(1) returns, by phi, with the interval of
    Beta(n + 1, N - n + 1). A task is one draw."""
    cells = spark.createDataFrame([(float(p),) for p in phis], "phi double").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_mc - 1)))).repartition(16, "phi", "draw")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            fired = []
            for phi, draw in zip(b["phi"], b["draw"]):
                e = np.random.default_rng([seed, int(draw), int(phi * 1e6)]).normal(0, sigma, n_bars)
                r = np.empty(n_bars)
                last = 0.0
                for i, x in enumerate(e):
                    last = r[i] = phi * last + x
                close = np.exp(np.cumsum(r))[: n_bars // w * w].reshape(-1, w)
                z = sorted((float(np.nanmedian(kernel(close, q)[1])) for q in horizons), key=lambda v: -abs(v))
                ok = False
                for v, c in zip(z, CRITICAL):
                    if abs(v) <= c:
                        break
                    ok |= v > 0
                fired.append(ok)
            yield pd.DataFrame({"phi": b["phi"], "fired": fired})

    d = cells.mapInPandas(run, "phi double, fired boolean").groupBy("phi").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("fires"))
    from ..functions.numerics import beta_interval

    bounds = {k: beta_interval(k, n_mc) for k in range(n_mc + 1)}
    table = spark.createDataFrame([(k, *v) for k, v in bounds.items()], "fires long, lo double, hi double")
    return d.join(table, "fires").select("phi", "n", "fires", (F.col("fires") / F.col("n")).alias("p_det"), "lo", "hi")


def power_grid_on(df: DataFrame, value: str, phis, n_mc: int = 200, n_bars: int = 50_000, w: int = 120, sigma: float = 1e-3, horizons=(2, 5, 15, 60), seed: int = 43) -> DataFrame:
    """As power_grid(), on the values of series: all rows are dealt by hash to n_mc draws of about n_bars; in a table of more rows the draws are
    more, in one of fewer a row is dealt several times. In the order of hashes and with random signs values have no structure but their sizes,
    which are scaled to a deviation of sigma: they are the innovations of the AR(1) path of each phi. A draw is a group, all phi of which share
    its values."""
    from ..functions.numerics import beta_interval, recurrence
    from .windows import over_groups

    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.xxhash64(F.lit(seed), "symbol", "idx").alias("h"), F.abs(value).alias("v"))
    total = d.count()
    draws = max(n_mc, total // n_bars)
    copies = max(1, -(-draws * n_bars // max(1, total)))
    d = d.withColumn("h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.xxhash64("h", k))))
    steps = [(float(p), recurrence(float(p))) for p in phis]

    def run(t, bounds):
        import numpy as np

        v, draw, out = t["v"].to_numpy(), t["draw"].to_numpy(), []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e = v[a:z] * np.random.default_rng([seed, int(draw[a])]).choice([-1.0, 1.0], z - a)
            if z - a < w or not e.std():
                continue
            e *= sigma / e.std()
            for phi, step in steps:
                close = np.exp(np.cumsum(step(e, e[0])))[: (z - a) // w * w].reshape(-1, w)
                m = sorted((float(np.nanmedian(kernel(close, q)[1])) for q in horizons), key=lambda x: -abs(x))
                ok = False
                for x, c in zip(m, CRITICAL):
                    if abs(x) <= c:
                        break
                    ok |= x > 0
                out.append((phi, ok))
        return {"phi": np.array([o[0] for o in out], float), "fired": np.array([o[1] for o in out], bool)}

    rows = d.select(F.pmod(F.xxhash64("h"), F.lit(draws)).alias("draw"), "h", "v")
    g = over_groups(rows, ["draw"], run, "phi double, fired boolean", "h").groupBy("phi").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("fires"))

    def bounds_of(batches):
        for b in batches:
            lo, hi = zip(*(beta_interval(int(k), int(n)) for k, n in zip(b["fires"], b["n"]))) if len(b) else ((), ())
            yield b.assign(p_det=b["fires"] / b["n"], lo=lo, hi=hi)

    return g.mapInPandas(bounds_of, "phi double, n long, fires long, p_det double, lo double, hi double")
