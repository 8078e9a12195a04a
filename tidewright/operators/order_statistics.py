"""Exact order statistics of long series and large groups, in tasks of bounded size: expanding quantiles and ranks.

Both cut the range of values at edges from a sketch. Edges only decide how the work is dealt: whatever they are, results are
exact. They are written down once, so that every part of a plan sees the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import materialize
from .windows import CHUNK, over_groups


def value_edges(df: DataFrame, value: str, *by: str, size: int | None = None) -> DataFrame:
    """by, edges: rising values that cut each group into parts of about size rows or fewer, a frequent value being an edge; no
    row for a group that needs no cut. There are at most rows / size edges in all."""
    size = size or CHUNK
    n = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")).filter(F.col("__n") > size)
    most = n.agg(F.max("__n")).first()[0]
    if most is None:
        return df.select(*by).limit(0).withColumn("edges", F.array().cast("array<double>"))
    parts = 2 * -(-most // size)
    ps = [k / parts for k in range(1, parts)]
    kept = df.join(F.broadcast(n), [*by]) if by else df.crossJoin(F.broadcast(n))  # fewer than rows / size groups
    cut = kept.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), ps, 10_000).alias("e"), F.first("__n").alias("__n"))
    every = F.greatest(F.lit(1), F.floor(most / F.col("__n")))  # a smaller group takes fewer of them
    return materialize(cut.select(*by, F.array_distinct(F.filter("e", lambda e, i: i % every == 0)).alias("edges")), "edges")


def edges_below(edges, value):
    """How many of the rising edges, an array column, lie below value: the largest steps first, so that their number hardly
    costs anything; 0 for a null array."""
    edges, value = (F.col(c) if isinstance(c, str) else c for c in (edges, value))
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(edges) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(edges, at + s - 1) < value, at + s).otherwise(at)), F.lit(0))


def _apart(df: DataFrame) -> DataFrame:
    """df with columns of its own, to meet another frame made of the same ones."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _cell(edges, values):
    """The part of each value: 2k + 1 if it is edge k, 2k if it lies before edge k and after the one before."""
    import numpy as np

    at = np.searchsorted(edges, values)
    on = at < len(edges)
    on[on] = edges[at[on]] == values[on]
    return 2 * at + on


def expanding_quantile(bars: DataFrame, column: str, least: int, qs: dict[str, float], size: int | None = None) -> DataFrame:
    """bars with linear quantiles of all rows of the symbol so far, from least rows with a value on. idx is in bar order.

    Chunks of bars count their values by part; counts are summed up over the chunks before. A chunk then walks its bars with
    those counts and knows for each quantile which part holds it, and the how-manieth of the part it is. Parts are answered by
    (symbol, part, chunk): the part's values up to the chunk, in order, grow by the chunk's own as the questions come."""
    size = size or CHUNK
    names = list(qs)
    columns = bars.columns
    every = bars.withColumn("__long", F.max("idx").over(Window.partitionBy("symbol")) >= size)
    schema = T.StructType([*bars.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def short(t, bounds):
        """Series of one chunk, each walked by itself."""
        import numpy as np
        import pandas as pd

        x = np.asarray(t[column].cast("double").to_numpy(), float)
        out = {n: np.full(len(x), np.nan) for n in names}
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e = pd.Series(x[a:z]).expanding(max(least, 1))
            for n, q in qs.items():
                out[n][a:z] = e.quantile(q).to_numpy()
        return {c: t[c] for c in columns} | out

    most = bars.agg(F.max("idx")).first()[0]
    if most is None or most < size:
        return over_groups(bars, ["symbol"], short, schema)
    done = over_groups(every.filter("NOT __long").drop("__long"), ["symbol"], short, schema)
    return done.unionByName(_long_quantile(every.filter("__long").drop("__long"), column, least, qs, size))


def _long_quantile(bars: DataFrame, column: str, least: int, qs: dict[str, float], size: int) -> DataFrame:
    """expanding_quantile of series of more than a chunk."""
    kind = bars.schema["symbol"].dataType.simpleString()
    names = list(qs)
    b = bars.withColumn("__k", F.floor(F.col("idx") / size))
    x = F.col(column).cast("double")
    v = b.select("symbol", "idx", "__k", F.when(~F.isnan(x), x).alias("__x"))
    edges = value_edges(v, "__x", "symbol", size=size)
    few = F.broadcast(edges)  # at most rows / size numbers
    chunks = v.groupBy("symbol", "__k").agg(F.count("__x").alias("__m")).join(few, "symbol", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<double>")))

    def counted(key, left, right):
        import numpy as np
        import pandas as pd

        edges = np.asarray(right["edges"].iloc[0], float)
        x = left["__x"].dropna().to_numpy(float)
        cell, n = np.unique(_cell(edges, x), return_counts=True)
        return pd.DataFrame([(key[0], key[1], c, m) for c, m in zip(cell.tolist(), n.tolist())], columns=["symbol", "__k", "cell", "n"])

    cells = v.groupBy("symbol", "__k").cogroup(_apart(chunks).groupBy("symbol", "__k")).applyInPandas(counted, f"symbol {kind}, __k long, cell int, n long")
    cells = materialize(cells, "cells")  # a row a chunk and part
    upto = Window.partitionBy("symbol", "cell").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    every = cells.select("symbol", "cell").distinct().join(chunks.select("symbol", "__k"), "symbol").join(cells, ["symbol", "__k", "cell"], "left")
    past = every.withColumn("n", F.coalesce(F.sum("n").over(upto), F.lit(0))).groupBy("symbol", "__k").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("past"))
    known = chunks.join(past, ["symbol", "__k"], "left")

    def asked(key, left, right):
        """For each bar and quantile: part and place in it of the order statistics on both sides, and the weight of the upper."""
        import numpy as np
        import pandas as pd

        left = left.sort_values("idx")
        edges, past = np.asarray(right["edges"].iloc[0], float), dict(right["past"].iloc[0] or {})
        x = left["__x"].to_numpy(float)
        good = ~np.isnan(x)
        cell = np.full(len(x), -1)
        cell[good] = _cell(edges, x[good])
        start = np.zeros(2 * len(edges) + 1, np.int64)
        for c, m in past.items():
            start[c] = m
        out = []
        for j, p in enumerate(qs.values()):
            counts, total = start.copy(), int(start.sum())
            at, below = 0, 0  # part that holds the lower order statistic, values in the parts under it
            for i, c in zip(left["idx"].to_numpy(), cell):
                if c >= 0:
                    counts[c] += 1
                    total += 1
                    below += c < at
                if total < max(least, 1):
                    continue
                place = p * (total - 1)
                lower = int(place)
                while lower < below:
                    at -= 1
                    below -= counts[at]
                while lower >= below + counts[at]:
                    below += counts[at]
                    at += 1
                up, over = at, below
                while min(lower + 1, total - 1) >= over + counts[up]:
                    over += counts[up]
                    up += 1
                out.append((key[0], i, j, at, lower - below, up, min(lower + 1, total - 1) - over, place - lower))
        return pd.DataFrame(out, columns=["symbol", "idx", "j", "cell", "nth", "cell2", "nth2", "weight"])

    questions = v.groupBy("symbol", "__k").cogroup(_apart(known).groupBy("symbol", "__k")).applyInPandas(asked, f"symbol {kind}, idx long, j int, cell int, nth long, cell2 int, nth2 long, weight double")
    questions = materialize(questions, "questions")
    side = lambda c, n, up: questions.select("symbol", "idx", "j", F.col(c).alias("cell"), F.col(n).alias("nth"), F.lit(up).alias("up"), F.floor(F.col("idx") / size).alias("__k"))
    both = side("cell", "nth", 0).unionByName(side("cell2", "nth2", 1))
    wanted = both.select("symbol", "cell", "__k").distinct()
    placed = v.filter("__x IS NOT NULL").join(few, "symbol", "left")
    edge = F.coalesce("edges", F.array().cast("array<double>"))
    under = edges_below(edge, "__x")
    placed = placed.select("symbol", "idx", "__x", F.col("__k").alias("own"), (2 * under + F.when(F.array_contains(edge, F.col("__x")), 1).otherwise(0)).cast("int").alias("cell"))
    # an edge's part is one value: no row of it has to come
    values = placed.filter(F.col("cell") % 2 == 0).join(wanted, ["symbol", "cell"]).filter(F.col("own") <= F.col("__k")).drop("own")

    def answer(key, left, right):
        from bisect import insort

        import numpy as np
        import pandas as pd

        right, left = right.sort_values("idx"), left.sort_values(["idx", "j", "up"])
        first = key[2] * size
        old = right["idx"].to_numpy() < first
        held = sorted(right["__x"].to_numpy(float)[old].tolist())
        new = list(zip(right["idx"].to_numpy()[~old].tolist(), right["__x"].to_numpy(float)[~old].tolist()))
        got, at = np.empty(len(left)), 0
        for r, (i, nth) in enumerate(zip(left["idx"].tolist(), left["nth"].tolist())):
            while at < len(new) and new[at][0] <= i:
                insort(held, new[at][1])
                at += 1
            got[r] = held[nth]
        return pd.DataFrame({"symbol": left["symbol"], "idx": left["idx"], "j": left["j"], "up": left["up"], "value": got})

    inner = both.filter(F.col("cell") % 2 == 0).groupBy("symbol", "cell", "__k").cogroup(_apart(values).groupBy("symbol", "cell", "__k")).applyInPandas(answer, f"symbol {kind}, idx long, j int, up int, value double")
    edge_values = both.filter(F.col("cell") % 2 == 1).join(few, "symbol").select("symbol", "idx", "j", "up", F.element_at("edges", (F.floor(F.col("cell") / 2) + 1).cast("int")).alias("value"))
    pair = inner.unionByName(edge_values).groupBy("symbol", "idx", "j").agg(F.max(F.when(F.col("up") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("up") == 1, F.col("value"))).alias("hi"))
    found = pair.join(questions.select("symbol", "idx", "j", "weight"), ["symbol", "idx", "j"]).withColumn("q", F.col("lo") + F.col("weight") * (F.col("hi") - F.col("lo")))
    wide = found.groupBy("symbol", "idx").agg(*[F.max(F.when(F.col("j") == j, F.col("q"))).alias(name) for j, name in enumerate(names)])
    return b.drop("__k").join(wide, ["symbol", "idx"], "left").select(*bars.columns, *names)


def median_interval(df: DataFrame, value: str, *by: str, z: float = 1.959963984540054, size: int | None = None) -> DataFrame:
    """By by: n, median, and lo and hi, the order statistics between which the median of any law lies with the probability that
    z stands for: those (n - z root n) / 2 and 1 + (n + z root n) / 2 from below."""
    r = ranks(df, value, *by, size=size).withColumn("__to", F.col("rank") + (F.col("c") - 1) / 2)
    n = F.col("n")
    at = lambda k: F.min(F.when(F.col("__to") >= k, F.col(value)))
    half = z * F.sqrt(n) / 2
    low, high = F.greatest(F.lit(1.0), F.floor(n / 2 - half)), F.least(n, F.ceil(1 + n / 2 + half))
    g = r.groupBy(*by).agg(F.max("n").alias("n"), ((at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2).alias("median"), at(low).alias("lo"), at(high).alias("hi"))
    return g


def ranks(df: DataFrame, value: str, *by: str, weight: str | None = None, size: int | None = None) -> DataFrame:
    """by, value, rank, n and c: the rank of each value in its group, ties at their mean, rows of the group and of the value.
    A row counts as often as weight says. Values are counted first. Groups of more than size values are cut at edges; the counts of their parts are summed up, and
    only within a part values are put in order."""
    size = size or CHUNK
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    edges = value_edges(counts, value, *by, size=size)
    few = F.broadcast(edges)  # at most rows / size numbers
    c = counts.join(few, [*by], "left") if by else counts.join(few, F.lit(True), "left")
    c = c.withColumn("__b", edges_below("edges", value)).drop("edges")
    all_, group = Window.partitionBy(*(by or [F.lit(0)])), [*by]
    below = c.groupBy(*group, "__b").agg(F.sum("c").alias("__m"))  # a row a group and part
    below = below.withColumns({"__below": F.coalesce(F.sum("__m").over(all_.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("__m").over(all_)}).drop("__m")
    upto = F.sum("c").over(Window.partitionBy(*group, "__b").orderBy(value))
    return c.join(below, [*group, "__b"]).select(*group, value, (F.col("__below") + upto - (F.col("c") - 1) / 2).alias("rank"), "n", "c")


def masked_ranks(df: DataFrame, value: str, masks: dict[str, str], size: int | None = None) -> DataFrame:
    """df, whose value is neither null nor NaN, with the rank of value among the rows of each mask, ties at their mean. masks: names of columns
    of 0 or 1, and of the ranks. All masks share one order of the values, which is cut at edges; within a part rows are put in order."""
    size = size or CHUNK
    edges = value_edges(df, value, size=size).withColumnRenamed("edges", "__edges")
    d = df.join(F.broadcast(edges), F.lit(True), "left").withColumn("__part", edges_below("__edges", value)).drop("__edges")  # a row at most
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    below = _apart(d).groupBy("__part").agg(*[F.sum(m).alias(r) for m, r in masks.items()])  # a row a part
    below = below.select("__part", *[F.coalesce(F.sum(r).over(before), F.lit(0)).alias(f"__below_{r}") for r in masks.values()])
    upto, same = Window.partitionBy("__part").orderBy(value), Window.partitionBy("__part", value)
    d = d.withColumns({f"__upto_{r}": F.sum(m).over(upto) for m, r in masks.items()})
    d = d.withColumns({r: F.col(f"__upto_{r}") - (F.sum(m).over(same) - 1) / 2 for m, r in masks.items()})
    d = d.join(F.broadcast(below), "__part")
    return d.select(*df.columns, *[(F.col(r) + F.col(f"__below_{r}")).alias(r) for r in masks.values()])
