"""Hard negatives by exact inner-product search over one-dimensional distance keys.

Vectors of whole numbers get one more component, sqrt(M - |x|^2) with M the largest squared norm, so that the nearest to an
anchor (whose extra component is 0) are those of the largest inner product: d^2 = |a|^2 + M - 2 <a, x>. Each vector belongs to
its nearest pivot and is stored in the order of (pivot, distance to the pivot), in blocks of rows with their interval of
distances. By the triangle inequality a block bounds the distances, and so the scores, of all its rows from an anchor; an
anchor scans the blocks that may hold a wanted score, nearest first, eight times as many in each round, until what is left
can't reach its k-th best. Positives are the best of the anchor's label; the negatives of a positive lie in an annulus, the
scores between two shares of the positive's, and the search goes outwards from its inner edge.

Anchors meet blocks, not rows: in a round, up to 256 anchors that need a block travel to it together and get at most k rows a
window back. Pivots come from a bounded sample (SAMPLE rows by hash); they change costs, not results. The directory of blocks
is bounded by larger blocks for larger tables (MOST_BLOCKS) and broadcast.

Defined cases: rows with a null label or vector, or with a null, NaN or infinite component, take no part; shorter vectors
count as followed by zeros; a null key takes part, is no anchor and comes last among ties; a repeated row is another row, and
its anchors are answered each; empty tables and tables without anchors give no rows; other columns are not read. Scores that
don't fit a long raise an OverflowError in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize, written

SAMPLE, PIVOTS, GROUP, STEP = 2_048, 32, 256, 8
BLOCK_ROWS, MOST_BLOCKS, PART_ROWS = 2_048, 100_000, 200_000
LAST, FIRST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Centres of the sample: its farthest points one after the other, then means of what is nearest."""
    points = np.unique(sample, axis=0)
    centres = [points.mean(0)]
    near = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < min(PIVOTS, len(points)):
        centres.append(points[int(near.argmax())])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(5):
        nearest = _distances(points, c).argmin(1)
        c = np.array([points[nearest == i].mean(0) if (nearest == i).any() else c[i] for i in range(len(c))])
    return c


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _padded(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], 1)


def _scores(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products, exact: doubles hold them while the largest squared norm does."""
    if most < 2.0**52:
        return a.astype(np.float64) @ x.astype(np.float64).T
    s = a.astype(object) @ x.astype(object).T
    if s.size and max(abs(int(s.max())), abs(int(s.min()))) > LAST:
        raise OverflowError("an inner product doesn't fit a long")
    return s.astype(np.int64)


class Store:
    """Blocks of vectors in the order of (pivot, distance), in the shared folder, with pivots and directory."""

    def __init__(self, df: DataFrame, key: str, label: str, vector: str, anchor: Column):
        spark = df.sparkSession
        code = F.col(label).cast("long") if df.schema[label].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(label)
        rows = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("key"), code.alias("code"), F.col(vector).cast("array<bigint>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        squares = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        count, dim, most = rows.agg(F.count("*"), F.max(F.size("x")), F.max(squares)).first()
        self.most, self.dim, self.count = float(most or 0), int(dim or 0), count
        if not count:
            return
        most, dim = self.most, self.dim
        sample = rows.select("x").orderBy(F.xxhash64("x", "key"), "key").limit(SAMPLE).collect()
        pivots = self.pivots = _pivots(_augmented(_padded([r["x"] for r in sample], dim), most))
        size = max(BLOCK_ROWS, -(-count // MOST_BLOCKS))

        def place(batches: Iterator) -> Iterator:
            for b in batches:
                d = _distances(_augmented(_padded(b["x"], dim), most), pivots)
                yield b.assign(pivot=d.argmin(1), distance=d.min(1))

        def block(batches: Iterator) -> Iterator:
            import pandas as pd
            from pyspark import TaskContext

            done, held = 0, None
            columns = ["block", "pivot", "low", "high", "keys", "codes", "anchors", "vectors"]

            def rows_of(part):
                nonlocal done
                out = []
                for p, g in part.groupby("pivot", sort=True):
                    for i in range(0, len(g), size):
                        h = g.iloc[i : i + size]
                        keys = h["key"].to_numpy(np.int64)
                        order = np.argsort(keys, kind="stable")
                        x = _padded(h["x"].to_numpy()[order], dim)
                        out.append((TaskContext.get().partitionId() << 32 | done, p, h["distance"].min(), h["distance"].max(), keys[order].tobytes(), h["code"].to_numpy(np.int64)[order].tobytes(), h["anchor"].to_numpy(bool)[order].tobytes(), x.tobytes()))
                        done += 1
                return pd.DataFrame(out, columns=columns)

            for b in batches:  # rows come in order, so a pivot's blocks fill up one after the other
                held = b if held is None else pd.concat([held, b])
                last = held["pivot"].iloc[-1] if len(held) else None
                full = (held["pivot"] != last).sum() + (held["pivot"] == last).sum() // size * size if len(held) else 0
                if full:
                    yield rows_of(held.iloc[:full])
                    held = held.iloc[full:]
            if held is not None and len(held):
                yield rows_of(held)

        placed = rows.mapInPandas(place, "key long, code long, x array<long>, anchor boolean, pivot int, distance double").withColumn("row", F.monotonically_increasing_id())
        ordered = placed.repartitionByRange(max(1, -(-count // PART_ROWS)), "pivot", "distance", "key", "row").sortWithinPartitions("pivot", "distance", "key", "row")
        with arrow_rows(spark, 10_000):
            self.blocks = materialize(ordered.drop("row").mapInPandas(block, "block long, pivot int, low double, high double, keys binary, codes binary, anchors binary, vectors binary"), "blocks")
        d = self.blocks.select("block", "pivot", "low", "high").orderBy("block").collect()  # bounded by MOST_BLOCKS
        self.directory = tuple(np.array([r[i] for r in d]) for i in range(4))

    def anchors(self) -> DataFrame:
        """rid, key, code, block, pos and x (bytes) of each anchor."""
        dim = self.dim

        def take(batches: Iterator) -> Iterator:
            import pandas as pd

            for b in batches:
                for r in b.itertuples():
                    at = np.flatnonzero(np.frombuffer(r.anchors, bool))
                    x = np.frombuffer(r.vectors, np.int64).reshape(-1, dim)
                    yield pd.DataFrame({"key": np.frombuffer(r.keys, np.int64)[at], "code": np.frombuffer(r.codes, np.int64)[at], "block": r.block, "pos": at, "x": [x[i].tobytes() for i in at]})

        with arrow_rows(self.blocks.sparkSession, 16):
            return materialize(self.blocks.select("block", "keys", "codes", "anchors", "vectors").mapInPandas(take, "key long, code long, block long, pos int, x binary").withColumn("rid", F.monotonically_increasing_id()), "anchors")

    def search(self, probes: DataFrame, k: int, same: bool) -> DataFrame:
        """rid, win, score, key and place (from 1) of the k best rows of each window of each probe, ties by smaller key. Probes:
        rid, code, block, pos, x, and arrays low and high, a window of scores each; same: rows of the probe's label, else others."""
        spark = probes.sparkSession
        best, at, upto, path = None, 0, STEP, ""
        while at < len(self.directory[0]):
            asked = probes if best is None else self._raised(probes, best, k)
            with arrow_rows(spark, GROUP):
                asks, asks_path = written(self._asks(asked, at, upto), "asks")
            with arrow_rows(spark, STEP):
                joined = asks.join(self.blocks.select("block", "keys", "codes", "vectors"), "block")
                found = self._scan(joined, k, same)
                found = found if best is None else found.unionByName(best.drop("place"))
                w = Window.partitionBy("rid", "win").orderBy(F.desc("score"), "key")
                best, new = written(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k), "best")
            for old in filter(None, (asks_path, path)):
                discard(spark, old)
            at, upto, path = upto, upto * STEP, new
        return best

    @staticmethod
    def _raised(probes: DataFrame, best: DataFrame, k: int) -> DataFrame:
        """probes, the low edge of a window that has k rows being the last one's score."""
        full = best.filter(F.col("place") == k).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("__kth"))
        low = F.transform("low", lambda v, i: F.coalesce(F.element_at("__kth", (i + 1).cast("int")), v))
        return probes.join(full, "rid", "left").withColumn("low", F.when(F.col("__kth").isNull(), F.col("low")).otherwise(low)).drop("__kth")

    def _asks(self, probes: DataFrame, at: int, upto: int) -> DataFrame:
        """A row for each block that some of up to GROUP probes need, with those: blocks at..upto of each probe's order."""
        held = probes.sparkSession.sparkContext.broadcast((self.directory, self.pivots))
        dim, most = self.dim, self.most

        def ask(batches: Iterator) -> Iterator:
            import pandas as pd

            (block, pivot, near, far), pivots = held.value
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.frombuffer(v, np.int64) for v in b["x"]])
                wide = max(map(len, b["low"]))
                low = np.array([[*v, *[LAST] * (wide - len(v))] for v in b["low"]], np.int64).reshape(len(b), wide)
                high = np.array([[*v, *[FIRST] * (wide - len(v))] for v in b["high"]], np.int64).reshape(len(b), wide)
                a = np.concatenate([x.astype(float), np.zeros((len(x), 1))], 1)
                d = _distances(a, pivots)[:, pivot]
                reach = (a * a).sum(1)[:, None] + most
                slack = 1e-9 * reach + 1e-6
                least = np.maximum(0.0, np.maximum(d - far, near - d))
                top = (reach - least**2) / 2 + slack
                bottom = (reach - (d + far) ** 2) / 2 - slack
                order = np.argsort(least, axis=1, kind="stable")[:, at:upto]
                top, bottom = np.take_along_axis(top, order, 1), np.take_along_axis(bottom, order, 1)
                need = np.zeros(order.shape, bool)
                for j in range(wide):
                    need |= (top >= low[:, j, None]) & (bottom <= high[:, j, None]) & (low[:, j] <= high[:, j])[:, None]
                who, where = np.nonzero(need)
                where = order[who, where]
                by = np.argsort(where, kind="stable")
                who, where = who[by], where[by]
                edges = np.flatnonzero(np.diff(where, prepend=-1))
                ids, code, home, pos = (b[c].to_numpy(np.int64) for c in ("rid", "code", "block", "pos"))
                out = [(int(block[where[i]]), wide, ids[w].tobytes(), code[w].tobytes(), home[w].tobytes(), pos[w].tobytes(), x[w].tobytes(), low[w].tobytes(), high[w].tobytes()) for i, w in zip(edges, np.split(who, edges[1:]))] if len(who) else []
                if out:
                    yield pd.DataFrame(out, columns=["block", "wide", "rids", "labels", "homes", "spots", "probes", "lows", "highs"])

        return probes.select("rid", "code", "block", "pos", "x", "low", "high").mapInPandas(ask, "block long, wide int, rids binary, labels binary, homes binary, spots binary, probes binary, lows binary, highs binary")

    def _scan(self, joined: DataFrame, k: int, same: bool) -> DataFrame:
        dim, most = self.dim, self.most

        def scan(batches: Iterator) -> Iterator:
            import pandas as pd

            for b in batches:
                out = [_best_of_block(r, dim, most, k, same) for r in b.itertuples()]
                if out:
                    rid, win, score, key = (np.concatenate(c) for c in zip(*out))
                    yield pd.DataFrame({"rid": rid, "win": win, "score": score, "key": key})

        return joined.mapInPandas(scan, "rid long, win int, score long, key long")


def _best_of_block(r, dim: int, most: float, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """rid, win, score and key of the k best rows of a block for each probe and window."""
    long = lambda v: np.frombuffer(v, np.int64)
    rids, keys = long(r.rids), long(r.keys)
    s = _scores(long(r.probes).reshape(len(rids), dim), long(r.vectors).reshape(len(keys), dim), most)
    take = long(r.labels)[:, None] == long(r.codes)[None, :]
    take = take if same else ~take
    home = np.flatnonzero(long(r.homes) == r.block)
    take[home, long(r.spots)[home]] = False
    lows, highs = long(r.lows).reshape(len(rids), -1), long(r.highs).reshape(len(rids), -1)
    parts = []
    for j in range(r.wide):
        who, where = np.nonzero(take & (s >= lows[:, j, None]) & (s <= highs[:, j, None]))
        score = s[who, where]
        if len(who) > 4 * k * len(rids):  # leave what is under the k-th best of its probe
            v = np.full(s.shape, -np.inf if s.dtype.kind == "f" else FIRST, s.dtype)
            v[who, where] = score
            ok = score >= np.partition(v, len(keys) - k, axis=1)[:, len(keys) - k][who]
            who, where, score = who[ok], where[ok], score[ok]
        order = np.lexsort((keys[where], -score, who))
        who, where, score = who[order], where[order], score[order]
        start = np.flatnonzero(np.diff(who, prepend=-1))
        first = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < k
        parts.append((rids[who[first]], np.full(int(first.sum()), j + 1, np.int32), score[first].astype(np.int64), keys[where[first]]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _share(percent: int, score: Column, up: bool) -> Column:
    """percent of a score in hundredths, rounded down or up to a whole number, exactly."""
    x = F.lit(-percent if up else percent).cast("long") * score
    down = F.expr("0L") + F.when(x >= 0, x).otherwise(x - 99)
    q = F.call_function("div", down, F.lit(100).cast("long"))
    return -q if up else q


def hard_negatives(df: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where anchor holds and each of
    its best rows of the same label, the best rows of other labels with scores from low to high percent of the positive's.
    vector: an array of whole numbers; key: a whole number."""
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    store = Store(df, key, label, vector, anchor & F.col(key).isNotNull())
    if not store.count:
        return spark.createDataFrame([], out)
    anchors = store.anchors()
    probe = anchors.withColumns({"low": F.array(F.lit(int(FIRST))), "high": F.array(F.lit(int(LAST)))})
    best = store.search(probe, positives, True).select("rid", F.col("place").alias("win"), F.col("score").alias("positive_score"), F.col("key").alias("positive_id"))
    edges = best.withColumns({"lo": _share(low, F.col("positive_score"), True), "hi": _share(high, F.col("positive_score"), False)})
    windows = edges.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("win", "lo", "hi"))).alias("w"))
    probe = anchors.join(windows, "rid").withColumns({"low": F.col("w.lo"), "high": F.col("w.hi")}).drop("w")
    worst = store.search(probe, negatives, False).select("rid", "win", F.col("place").alias("rank"), F.col("score").alias("negative_score"), F.col("key").alias("negative_id"))
    named = lambda c: F.nullif(F.col(c), F.lit(int(LAST))).alias(c)
    joined = worst.join(best, ["rid", "win"]).join(anchors.select("rid", F.col("key").alias("anchor_id")), "rid")
    return joined.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: every hundredth vec_id. Components times 256, rounded down; labels of every seventh vec_id move on by one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    e = e.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    e = e.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"))
    return hard_negatives(e, F.col("vec_id") % 100 == 0)


SQL_OP11 = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM e a JOIN e b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor, anchor_id, rid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
