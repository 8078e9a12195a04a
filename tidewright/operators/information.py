"""Information in lagged returns: plug-in for signs, nearest neighbours for values, with bootstrap errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.neighbours import gaussian_pairs, ksg, ksg_rows
from ..sources.bars import by_symbol
from .windows import over_groups

#: Numbers of resamples that are held at once.
HELD = 1 << 20


def lag_pairs(df: DataFrame, value: str, q: int, forward: bool = True, signs: bool = False) -> DataFrame:
    """symbol, idx, x, y: x before y by q bars if forward, else the other way round."""
    v = F.signum(value) if signs else F.col(value)
    d = df.withColumn("__v", v).withColumn("__n", F.lead("__v", q).over(by_symbol())).filter("__v IS NOT NULL AND __n IS NOT NULL")
    a, b = ("__v", "__n") if forward else ("__n", "__v")
    return d.select("symbol", "idx", F.col(a).alias("x"), F.col(b).alias("y"))


def information(pairs: DataFrame, method: str = "raw", k: int = 5, reps: int = 500, seed: int = 43, chunk: int = 25) -> DataFrame:
    """By symbol: n, mi and its bootstrap standard error. The nearest-neighbour estimate takes all pairs; a task
    holds one symbol's pairs and a share of the replicates."""
    if method not in ("signs", "raw"):
        raise ValueError("method is signs or raw")
    if method == "signs":
        return _sign_information(pairs, reps, seed)
    kind = pairs.schema["symbol"].dataType.simpleString()
    rows = pairs.groupBy("symbol").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "x", "y"))).alias("c")).select("symbol", "n", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-reps // chunk)) - 1))))

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for symbol, n, x, y, share in b.itertuples(index=False):
                x, y = np.asarray(x, float), np.asarray(y, float)
                if len(x) <= k:
                    continue
                if share == 0:
                    out.append((symbol, n, -1, ksg(x, y, k)))
                mine, step = range(share * chunk, min(reps, share * chunk + chunk)), max(1, HELD // len(x))
                for a in range(mine.start, mine.stop, step):
                    some = range(a, min(mine.stop, a + step))
                    at = np.stack([np.random.default_rng([seed, zlib.crc32(str(symbol).encode()), rep]).integers(0, len(x), len(x)) for rep in some])
                    out += [(symbol, n, rep, v) for rep, v in zip(some, ksg_rows(x[at], y[at], k))]
            yield pd.DataFrame(out, columns=["symbol", "n", "rep", "v"])

    d = rows.repartition("symbol", "share").mapInPandas(run, f"symbol {kind}, n long, rep int, v double")
    return d.groupBy("symbol", "n").agg(F.max(F.when(F.col("rep") < 0, F.col("v"))).alias("mi"), F.stddev_samp(F.when(F.col("rep") >= 0, F.col("v"))).alias("se"))


def _sign_information(pairs: DataFrame, reps: int, seed: int) -> DataFrame:
    """From a symbol's table of sign pairs, all pairs counted; a resample of pairs is a multinomial draw of that table."""
    kind = pairs.schema["symbol"].dataType.simpleString()
    sign = lambda c: F.signum(c).cast("int")
    cells = pairs.groupBy("symbol", (3 * sign("x") + sign("y") + 4).alias("cell")).agg(F.count("*").alias("c"))
    rows = cells.groupBy("symbol").agg(F.sum("c").alias("n"), F.collect_list(F.struct("cell", "c")).alias("t"))

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        def plug_in(t):
            """Of a stack of tables."""
            p = t.reshape(-1, 3, 3) / t.sum(-1)[:, None, None]
            e = p.sum(2, keepdims=True) * p.sum(1, keepdims=True)
            with np.errstate(all="ignore"):
                return np.maximum(0.0, np.where(p > 0, p * np.log(p / e), 0.0).sum((1, 2)))

        for b in batches:
            out = []
            for symbol, n, cells in b.itertuples(index=False):
                t = np.zeros(9)
                for c in cells:
                    t[c["cell"]] = c["c"]
                drawn = np.random.default_rng([seed, zlib.crc32(str(symbol).encode())]).multinomial(int(n), t / t.sum(), reps)
                out.append((symbol, n, plug_in(t[None])[0], plug_in(drawn.astype(float)).std(ddof=1) if reps > 1 else None))
            yield pd.DataFrame(out, columns=["symbol", "n", "mi", "se"])

    return rows.mapInPandas(run, f"symbol {kind}, n long, mi double, se double")


def estimator_bias(spark: SparkSession, sizes=(500, 2000), truths=(0.0, 0.05, 0.2), reps: int = 30, k: int = 5) -> DataFrame:
    """n, truth, bias and standard error of the nearest-neighbour estimate on Gaussian pairs; a draw is a row of a task."""
    cells = spark.createDataFrame([(n, float(t)) for n in sizes for t in truths], "n int, truth double")
    rows = cells.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(16, "n", "truth", "draw")

    def run(batches):
        import pandas as pd

        for b in batches:
            v = [ksg(*gaussian_pairs(int(n), t, int(d) * 7919 + int(n) + int(t * 1e6)), k) for n, t, d in b.itertuples(index=False)]
            yield pd.DataFrame({"n": b["n"], "truth": b["truth"], "v": v})

    return rows.mapInPandas(run, "n int, truth double, v double").groupBy("n", "truth").agg((F.avg("v") - F.col("truth")).alias("bias"), F.stddev_samp("v").alias("se"))


def estimator_bias_on(df: DataFrame, value: str, sizes=(500, 2000), truths=(0.0, 0.05, 0.2), k: int = 5, seed: int = 43) -> DataFrame:
    """As estimator_bias(), on the values of series, each of which takes part once a size: rows of any series are dealt by hash to draws of
    about size pairs (a table of fewer rows is one draw), in whose order values have no structure; a half's values give normal scores
    by rank, so that the truth holds, and the halves are mixed to each truth."""
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.xxhash64(F.lit(seed), "symbol", "idx").alias("h"), F.col(value).alias("v"))
    total = d.count()
    deal = F.array(*[F.struct(F.lit(n).alias("n"), F.pmod(F.xxhash64("h"), F.lit(max(1, total // (2 * n)))).alias("draw")) for n in sizes])
    rows = d.select("h", "v", F.explode(deal).alias("d")).select("d.*", "h", "v")

    def run(t, bounds):
        from statistics import NormalDist

        import numpy as np

        n, v, grids, out = t["n"].to_numpy(), t["v"].to_numpy(), {}, []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            m = (z - a) // 2
            if m <= k:
                continue
            if m not in grids:
                grids[m] = np.array([NormalDist().inv_cdf((i + 0.5) / m) for i in range(m)])
            x, y = (grids[m][np.argsort(np.argsort(half, kind="stable"))] for half in (v[a : a + m], v[a + m : a + 2 * m]))
            for truth in truths:
                rho = np.sqrt(1 - np.exp(-2 * truth))
                out.append((int(n[a]), float(truth), ksg(x, rho * x + np.sqrt(1 - rho * rho) * y, k)))
        each = lambda j, kind: np.array([o[j] for o in out], kind)
        return {"n": each(0, np.int32), "truth": each(1, float), "v": each(2, float)}

    g = over_groups(rows, ["n", "draw"], run, "n int, truth double, v double", "h")
    return g.groupBy("n", "truth").agg((F.avg("v") - F.col("truth")).alias("bias"), F.stddev_samp("v").alias("se"))
