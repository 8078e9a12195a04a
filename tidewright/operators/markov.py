"""Markov-switching detector: log volatility as a mixture of normal states with a transition matrix, fitted by expectation
maximisation from seeded starts; labels come from filtered (never smoothed) probabilities, states in order of variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W


def emissions(x, mean, var):
    """Log densities, one column a state."""
    import numpy as np

    return -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)


def products(m):
    """The products m_0 m_1 ... m_t of a row of small matrices for every t, scaled to a largest entry of 1, and the logarithms
    of the scales. Spans double, so the work is a few passes over arrays instead of a walk."""
    import numpy as np

    p = m.copy()
    scale = np.maximum(p.max((1, 2)), 1e-300)
    p /= scale[:, None, None]
    logs, step = np.log(scale), 1
    while step < len(p):
        q = p[:-step] @ p[step:]
        total = logs[:-step] + logs[step:]
        scale = np.maximum(q.max((1, 2)), 1e-300)
        p[step:], logs[step:] = q / scale[:, None, None], total + np.log(scale)
        step *= 2
    return p, logs


def _steps(logp, move):
    """What takes the states from one row to the next; densities are scaled by the largest in a row."""
    import numpy as np

    top = logp.max(1)
    d = np.exp(logp - top[:, None])
    m = move * d[:, None, :]
    m[0] = np.diag(d[0])
    return m, d, top


def forward(logp, start, move):
    """Filtered probabilities and the log likelihood."""
    import numpy as np

    m, _, top = _steps(logp, move)
    p, logs = products(m)
    f = start @ p
    total = np.maximum(f.sum(1, keepdims=True), 1e-300)
    return f / total, float(logs[-1] + np.log(total[-1, 0]) + top.sum())


def smoothed(logp, start, move):
    """Filtered and smoothed probabilities, expected transitions, and the log likelihood."""
    import numpy as np

    filtered, llf = forward(logp, start, move)
    m, d, _ = _steps(logp, move)
    n, k = d.shape
    ahead = np.ones((n, k))  # how well each state explains what comes, up to a scale
    if n > 1:
        ahead[:-1] = products(m[:0:-1].transpose(0, 2, 1))[0][::-1].sum(1)
    both = filtered * ahead
    both /= np.maximum(both.sum(1, keepdims=True), 1e-300)
    joint = filtered[:-1, :, None] * move * (d[1:] * ahead[1:])[:, None, :]
    joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
    return filtered, both, joint.sum(0), llf


def _first(x, states: int, seed: int, switching_mean: bool):
    """Means and variances that a start begins with."""
    import numpy as np

    rng = np.random.default_rng(seed)
    cuts = np.quantile(x, (np.arange(states) + 0.5) / states)
    mean = cuts + rng.normal(0, 0.1 * (x.std() + 1e-9), states)
    var = np.full(states, max(x.var(), 1e-12)) * rng.uniform(0.5, 1.5, states)
    if not switching_mean:
        mean[:] = x.mean()
    return mean, var


def fit(x, states: int = 3, steps: int = 100, seed: int = 42, switching_mean: bool = True, tol: float = 1e-6) -> dict:
    """One start: mean, var, move, log likelihood, whether it converged. states in order of variance."""
    import numpy as np

    n = len(x)
    mean, var = _first(x, states, seed, switching_mean)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9)
    start, last, converged = np.full(states, 1 / states), -np.inf, False
    for _ in range(steps):
        _, g, moves, llf = smoothed(emissions(x, mean, var), start, move)
        if abs(llf - last) < tol * n:
            converged = True
            break
        last = llf
        weight = np.maximum(g.sum(0), 1e-9)
        mean = (g * x[:, None]).sum(0) / weight if switching_mean else np.full(states, ((g / var) * x[:, None]).sum() / (g / var).sum())
        var = np.maximum((g * (x[:, None] - mean) ** 2).sum(0) / weight, 1e-10)
        move = moves / np.maximum(moves.sum(1, keepdims=True), 1e-300)
        start = g[0]
    o = np.argsort(var, kind="stable")
    return {"mean": mean[o], "var": var[o], "move": move[np.ix_(o, o)], "start": start[o], "llf": float(last), "converged": converged}


def _walked(x, n, mean, var, start, move, smooth: bool = True):
    """smoothed() of many paths, the last axis, by one walk over the rows: the smoothed probabilities, expected transitions
    and log likelihoods; without smooth, the filtered probabilities alone. n: the paths' lengths."""
    import numpy as np

    rows, paths = x.shape
    k = len(mean)
    d = x[:, None] - mean
    d *= d
    d /= -2 * var
    d -= 0.5 * np.log(2 * np.pi * var)
    top = d.max(1)
    d -= top[:, None]
    np.exp(d, out=d)
    f, scale, now = np.empty((rows, k, paths)), np.empty((rows, paths)), start * d[0]
    for t in range(rows):
        if t:
            np.einsum("ib,ijb->jb", f[t - 1], move, out=now)
            now *= d[t]
        np.add.reduce(now, 0, out=scale[t])
        np.maximum(scale[t], 1e-300, out=scale[t])
        np.divide(now, scale[t], out=f[t])
    if not smooth:
        return f
    own = np.arange(rows)[:, None] < n
    llf = np.where(own, np.log(scale) + top, 0.0).sum(0)
    # ahead: how well each state explains what comes, up to a scale; d becomes that of the state a row moves to
    ahead, most, least = np.ones((rows, k, paths)), np.empty(paths), n.min() - 1
    for t in range(rows - 2, -1, -1):
        d[t + 1] *= ahead[t + 1]
        np.einsum("ijb,jb->ib", move, d[t + 1], out=ahead[t])
        np.maximum.reduce(ahead[t], 0, out=most)
        np.maximum(most, 1e-300, out=most)
        d[t + 1] /= most
        ahead[t] /= most
        if t >= least:  # some paths end here, or before
            ahead[t][:, t >= n - 1] = 1.0
    ahead *= f
    total = np.maximum(ahead.sum(1), 1e-300)
    f /= total[:, None]
    f[:-1] *= own[1:, None]
    moves = move * np.einsum("tib,tjb->ijb", f[:-1], d[1:])
    ahead /= total[:, None]
    ahead *= own[:, None]
    return ahead, moves, llf


def fit_many(paths, seeds, states: int = 3, steps: int = 100, switching_mean: bool = True, tol: float = 1e-6) -> list[dict]:
    """fit() of many paths at once; those that converge leave the others."""
    import numpy as np

    n = np.array([len(x) for x in paths])
    x = np.zeros((n.max(), len(paths)))
    for j, p in enumerate(paths):
        x[: n[j], j] = p
    mean, var = (np.stack(v, -1) for v in zip(*(_first(p, states, s, switching_mean) for p, s in zip(paths, seeds))))
    move = np.full((states, states, len(paths)), 0.1 / max(states - 1, 1))
    move[np.arange(states), np.arange(states)] = 0.9
    start, last = np.full(mean.shape, 1 / states), np.full(len(paths), -np.inf)
    at, out = np.arange(len(paths)), [None] * len(paths)

    def leave(which, converged):
        for j in which:
            o = np.argsort(var[:, j], kind="stable")
            out[at[j]] = {"mean": mean[o, j], "var": var[o, j], "move": move[:, :, j][np.ix_(o, o)], "start": start[o, j], "llf": float(last[j]), "converged": converged}

    for _ in range(steps):
        g, moves, llf = _walked(x, n, mean, var, start, move)
        done = np.abs(llf - last) < tol * n
        if done.any():
            leave(np.flatnonzero(done), True)
            stay = ~done
            if not stay.any():
                return out
            x, g = x[: n[stay].max(), stay], g[: n[stay].max(), :, stay]
            n, at, mean, var, start, moves, llf = n[stay], at[stay], mean[:, stay], var[:, stay], start[:, stay], moves[:, :, stay], llf[stay]
        last = llf
        weight = np.maximum(g.sum(0), 1e-9)
        if switching_mean:
            mean = (g * x[:, None]).sum(0) / weight
        else:
            mean = np.broadcast_to(((g / var) * x[:, None]).sum((0, 1)) / (g / var).sum((0, 1)), mean.shape).copy()
        var = np.maximum((g * (x[:, None] - mean) ** 2).sum(0) / weight, 1e-10)
        move = moves / np.maximum(moves.sum(1, keepdims=True), 1e-300)
        start = g[0].copy()
    leave(range(len(at)), False)
    return out


#: A walk over rows pays from so many paths on; so many numbers of paths are walked at once.
MANY, HELD = 24, 1 << 18


def _alike(lengths, copies: int = 1):
    """Places of paths in order of length, in lots of at most HELD numbers of copies of each."""
    import numpy as np

    lot: list[int] = []
    for j in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        if lot and (len(lot) + 1) * copies * lengths[lot[0]] > HELD:
            yield lot
            lot = []
        lot.append(j)
    if lot:
        yield lot


def restarts(df: DataFrame, value: str, states: int = 3, starts: int = 10, steps: int = 100, retry: int = 200, seed: int = 42, switching_mean: bool = True) -> DataFrame:
    """symbol, start, llf, converged and the parameters of every start. One that doesn't converge in steps is run again with
    retry. Many short series are fitted together; a long one's starts are rows of their own."""
    kind = df.schema["symbol"].dataType.simpleString()
    rows = df.filter(F.col(value).isNotNull()).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", value))).alias("c"))
    every = F.sequence(F.lit(0), F.lit(starts - 1))
    long = F.size("c") * starts * MANY > HELD
    rows = rows.select("symbol", F.col(f"c.{value}").alias("x"), F.explode(F.when(long, F.transform(every, lambda k: F.array(k))).otherwise(F.array(every))).alias("starts"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        import numpy as np
        import pandas as pd

        def fits(jobs):
            paths, seeds = [x for _, x, _ in jobs], [seed + k for *_, k in jobs]

            def some(which, most):
                p, s = [paths[j] for j in which], [seeds[j] for j in which]
                if len(which) < MANY:
                    return [fit(x, states, most, k, switching_mean) for x, k in zip(p, s)]
                return fit_many(p, s, states, most, switching_mean)

            found = some(range(len(jobs)), steps)
            again = [j for j, m in enumerate(found) if not m["converged"]] if steps < retry else []
            for j, m in zip(again, some(again, retry)):
                found[j] = m
            return [(symbol, k, m["llf"], m["converged"], m["mean"].tolist(), m["var"].tolist(), m["move"].ravel().tolist(), m["start"].tolist()) for (symbol, _, k), m in zip(jobs, found)]

        def done(held):
            out = []
            for lot in _alike([len(x) for _, x, _ in held]):
                out += fits([held[j] for j in lot])
            return pd.DataFrame(out, columns=["symbol", "start", "llf", "converged", "mean", "var", "move", "first"])

        held, size = [], 0
        for b in batches:
            for symbol, x, own in b.itertuples(index=False):
                x = np.asarray(x, float)
                if len(x) < 10 * states:
                    continue
                held += [(symbol, x, int(k)) for k in own]
                size += len(x) * len(own)
                if size > 8 * HELD:
                    yield done(held)
                    held, size = [], 0
        yield done(held)

    return rows.repartition(parts, "symbol", "starts").mapInPandas(run, f"symbol {kind}, start int, llf double, converged boolean, mean array<double>, var array<double>, move array<double>, first array<double>")


def best(fits: DataFrame) -> DataFrame:
    """By symbol the likeliest start, how far the best five are apart, as such and by the mean likelihood, and whether that
    counts as converged: under one percent, and no start failed."""
    every = F.array_sort(F.collect_list("llf"))  # a few starts
    g = fits.groupBy("symbol").agg(F.max_by(F.struct("start", "llf", "mean", "var", "move", "first"), F.struct("llf", -F.col("start"))).alias("b"), every.alias("l"), F.bool_and("converged").alias("all_ok"), F.abs(F.avg("llf")).alias("m"))
    n = F.size("l")
    spread = F.element_at("l", n) - F.element_at("l", F.greatest(F.lit(1), n - 4))
    g = g.withColumn("top5_spread", spread).withColumn("spread_fraction", F.try_divide("top5_spread", "m"))
    sep = F.transform(F.sequence(F.lit(1), F.size("b.var") - 1), lambda k: F.element_at("b.var", k.cast("int") + 1) / F.element_at("b.var", k.cast("int")))
    return g.select("symbol", "b.*", "top5_spread", "spread_fraction", ((F.col("spread_fraction") < 0.01) & F.col("all_ok")).alias("convergence_ok"), F.when(F.size("b.var") > 1, sep).alias("separation"))


def states(bars: DataFrame, vol: int = 60, states: int = 3, starts: int = 10, steps: int = 100, **settings) -> DataFrame:
    """bars with label: -1 before volatility is known, then the likeliest state under the filter. Volatility of 0 counts as
    the smallest above 0."""
    b = W.realized_vol(bars, vol)
    least = F.min(F.when(F.col("rv") > 0, F.col("rv"))).over(W.Window.partitionBy("symbol"))
    b = b.select("symbol", "idx", "ts", "close", "rv", least.alias("__f"))
    b = b.withColumn("log_rv", F.ln(F.when(F.col("rv") > 0, F.col("rv")).when(F.col("rv") == 0, F.coalesce("__f", F.lit(1e-10))))).drop("rv", "__f")
    models = best(restarts(b, "log_rv", states, starts, steps, **settings)).select("symbol", "mean", "var", "move", "first")

    def run(t, bounds):
        import numpy as np

        x = W._numbers(t["log_rv"])
        label, jobs = np.full(len(x), -1, np.int32), []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = a + np.flatnonzero(~np.isnan(x[a:z]))
            if len(at) and (mean := t["mean"][a].as_py()) is not None:
                jobs.append((at, *(np.array(v, float) for v in (mean, t["var"][a].as_py(), t["first"][a].as_py(), t["move"][a].as_py()))))
        for lot in _alike([len(j[0]) for j in jobs]):
            some = [jobs[j] for j in lot]
            if len(some) < MANY:
                for at, mean, var, first, move in some:
                    label[at] = forward(emissions(x[at], mean, var), first, move.reshape(len(mean), -1))[0].argmax(1)
                continue
            n = np.array([len(j[0]) for j in some])
            v = np.zeros((n.max(), len(some)))
            for k, j in enumerate(some):
                v[: n[k], k] = x[j[0]]
            mean, var, first, move = (np.stack([j[k] for j in some], -1) for k in range(1, 5))
            best = _walked(v, n, mean, var, first, move.reshape(len(mean), len(mean), -1), False).argmax(1)
            for k, j in enumerate(some):
                label[j[0]] = best[: n[k], k]
        return {c: t[c] for c in ("symbol", "idx", "ts", "close")} | {"label": label}

    kind = bars.schema["symbol"].dataType.simpleString()
    return W.over_groups(b.join(models, "symbol", "left"), ["symbol"], run, f"symbol {kind}, idx long, ts long, close double, label int")
