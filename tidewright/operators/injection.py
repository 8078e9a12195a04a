"""Injection of autocorrelation into return paths: volatility path, calibration of phi against the departure, inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numerics import pchip, recurrence
from .measures import CRITICAL
from .nulls import medians_z
from .variance_ratio import kernel


def linear_recurrence(x, a: float, first: float):
    """y_0 = first, y_t = a * y_{t-1} + x_t."""
    return recurrence(a)(x, first)


def ewma_sigma(returns, decay: float = 0.94, solve=None):
    """Volatility path of squared returns, each day's from the days before; it starts with the sample variance. solve: recurrence(decay),
    for many calls."""
    import numpy as np

    r = np.asarray(returns, float)
    squares = np.concatenate([[0.0], (1 - decay) * r[:-1] ** 2])
    return np.sqrt((solve or recurrence(decay))(squares, r.var()))


def inject(returns, phi: float, seed, sigma=None, negative: bool = False, solve=None):
    """returns plus sigma times a unit-variance AR(1) path of phi. At phi 0 the noise is still added. solve: recurrence(phi), for many calls."""
    import numpy as np

    if not (-1 < phi < 1 if negative else 0 <= phi < 1):
        raise ValueError("phi is out of range")
    r = np.asarray(returns, float)
    noise = np.random.default_rng(seed).normal(size=len(r))
    path = (solve or recurrence(phi))(np.sqrt(1 - phi * phi) * noise, noise[0])
    return r + (ewma_sigma(r) if sigma is None else sigma) * path


def calibrate(spark: SparkSession, phis, n: int = 500_000, w: int = 120, horizons=(2, 5, 15, 60), sigma: float = 1e-3, seed: int = 43) -> DataFrame:
    """phi, q, delta: median |VR - 1| of a synthetic path with that phi; a phi is a task."""
    cells = spark.createDataFrame([(float(p),) for p in phis], "phi double").repartition(len(list(phis)), "phi")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for phi in b["phi"]:
                base = np.random.default_rng(seed).normal(0, sigma, n)
                close = np.exp(np.cumsum(inject(base, phi, [seed, 1], np.full(n, sigma))))[: n // w * w].reshape(-1, w)
                out += [(phi, q, float(np.nanmedian(np.abs(kernel(close, q)[0])))) for q in horizons]
            yield pd.DataFrame(out, columns=["phi", "q", "delta"])

    return cells.mapInPandas(run, "phi double, q int, delta double")


def calibrate_on(df: DataFrame, value: str, phis, w: int = 120, horizons=(2, 5, 15, 60), sigma: float = 1e-3, seed: int = 43, chunk: int = 16_384) -> DataFrame:
    """As calibrate(), on the values of series: in a random order and with random signs they have no structure but their
    sizes, which are scaled to a deviation of sigma, where phi is injected. symbol, phi, q, vr_dev, a row a window; a task holds a chunk of a
    series, all phi of which share base and noise."""
    kind = df.schema["symbol"].dataType.simpleString()
    rows = df.filter(F.col(value).isNotNull()).groupBy("symbol", F.floor(F.col("idx") / chunk).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("c"))

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in range(b.num_rows):
                symbol, part = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                key = [seed, zlib.crc32(str(symbol).encode()), part]
                rng = np.random.default_rng(key)
                x = rng.permutation(np.abs(b.column(2)[row].values.to_numpy(zero_copy_only=False))) * rng.choice([-1.0, 1.0], len(b.column(2)[row]))
                k, out = len(x) // w, []
                if not k or not x.std():
                    continue
                x *= sigma / x.std()
                for phi in phis:
                    close = np.exp(np.cumsum(inject(x, float(phi), [*key, 1], np.full(len(x), sigma))))[: k * w].reshape(-1, w)
                    out += [(float(phi), q, kernel(close, q)[0]) for q in horizons]
                v = np.concatenate([o[2] for o in out])
                each = lambda i: np.repeat([o[i] for o in out], k)
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(v), b.column(0).type), pa.array(each(0)), pa.array(each(1).astype(np.int32)), pa.array(v, from_pandas=True)], ["symbol", "phi", "q", "vr_dev"])

    return rows.select("symbol", "part", F.col(f"c.{value}").alias("x")).mapInArrow(run, f"symbol {kind}, phi double, q int, vr_dev double")


def invert(delta: float, points: list[tuple[float, float]]) -> float:
    """phi for a departure, from (phi, delta) points: a monotone cubic through those that rise; below the first a line from
    the origin, above the last in proportion, at most 0.99."""
    kept: list[tuple[float, float]] = []
    for phi, d in sorted(points):
        if phi > 0 and (not kept or d > kept[-1][1]):
            kept.append((phi, d))
    if len(kept) < 2:
        return kept[0][0] if kept else 0.0
    (p0, d0), (p1, d1) = kept[0], kept[-1]
    if delta <= 0:
        return 0.0
    if delta < d0:
        return p0 * delta / d0
    if delta > d1:
        return min(0.99, p1 * delta / d1)
    return pchip([d for _, d in kept], [p for p, _ in kept])(delta)


def inverted(calibration: DataFrame, deltas) -> DataFrame:
    """q, delta, phi for each target departure; points by horizon are few."""
    kind = "q int, delta double, phi double"

    def run(pdf):
        import pandas as pd

        points = list(zip(pdf["phi"], pdf["delta"]))
        return pd.DataFrame([(int(pdf["q"].iloc[0]), d, invert(d, points)) for d in deltas], columns=["q", "delta", "phi"])

    return calibration.groupBy("q").applyInPandas(run, kind)


def phi_table(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Lookup of phi by (q, delta): an entry of the earlier table isn't overridden by the later one."""
    j = earlier.select("q", "delta", F.col("phi").alias("a")).join(later.select("q", "delta", F.col("phi").alias("b")), ["q", "delta"], "full")
    return j.select("q", "delta", F.coalesce("a", "b").alias("phi"))


def cell_power(df: DataFrame, value: str, phis, n_mc: int = 200, w: int = 120, horizons=(2, 5, 15, 60), seed: int = 43, negative: bool = False) -> DataFrame:
    """By symbol and phi: draws, fires of the cascade on the series with an injected path (a draw that fails counts as no
    fire), detection share and median z of the second horizon. A draw is a row of a task."""
    kind = df.schema["symbol"].dataType.simpleString()
    rows = df.filter(F.col(value).isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("c")).select("symbol", F.col(f"c.{value}").alias("x"))
    rows = rows.withColumn("phi", F.explode(F.array(*[F.lit(float(p)) for p in phis]))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(-(-n_mc // 20) - 1)))).repartition("symbol", "phi", "share")

    def run(batches):
        import zlib

        import numpy as np
        import pandas as pd

        volatility, solve = recurrence(0.94), {float(p): recurrence(float(p)) for p in phis}
        for b in batches:
            out = []
            for symbol, x, phi, share in b.itertuples(index=False):
                x = np.asarray(x, float)
                sigma, draws = ewma_sigma(x, 0.94, volatility), range(share * 20, min(n_mc, share * 20 + 20))
                key, step = [seed, zlib.crc32(str(symbol).encode()), int(abs(phi) * 1e6)], max(1, (1 << 17) // max(1, len(x)))
                for k in range(draws.start, draws.stop, step):
                    some = range(k, min(draws.stop, k + step))
                    paths = np.stack([inject(x, phi, [*key, draw], sigma, negative, solve[phi]) for draw in some])
                    for z in zip(*(medians_z(paths, w, q).tolist() for q in horizons)):
                        fired = False
                        if np.isfinite(z).all():
                            for v, c in zip(sorted(z, key=lambda v: -abs(v)), CRITICAL[len(CRITICAL) - len(z) :]):
                                if abs(v) <= c:
                                    break
                                fired |= v > 0
                        out.append((symbol, phi, fired, z[1]))
            yield pd.DataFrame(out, columns=["symbol", "phi", "fired", "z"])

    d = rows.mapInPandas(run, f"symbol {kind}, phi double, fired boolean, z double")
    return d.groupBy("symbol", "phi").agg(F.count("*").alias("n"), F.sum(F.col("fired").cast("long")).alias("fires"), F.avg(F.col("fired").cast("int")).alias("p_det"), F.percentile("z", F.lit(0.5)).alias("median_z"))
