"""Periodic runs of words, from the branching tandem repeats of a suffix tree.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least `least` words and
`least_copies` periods long. Its last two periods are a tandem repeat that no rotation to the right continues: a branching
one, whose two halves hang from different children of the tree's node of depth q. Each node therefore looks only at the
leaves of its children but the largest (the smaller half), asks whether the leaf q words on, or q words before, hangs from
it too, and keeps the pairs whose next words differ. Repeats found are rotated to the left as far as they go and merged into
maximal runs, the least period standing for its multiples.

The tree is that of the words near a repeated window only: a run of length L has x[i] = x[i + q] for L - q words, so each of
its words lies in a window of min(L - q) words that the text has twice. The tree is held as intervals of sorted suffixes;
ranks of all blocks of 2^k words sort them, measure common prefixes and rotate repeats, exactly.

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; a text of any length is worked on in
the task of its row, in memory linear in its repeated part (times the logarithm of its longest repeat); texts never meet,
so repeated rows give repeated results; a null key stays null; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_buffers, give_back, slices, splitmix

SLICE_BYTES = 2 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Codes(dict):
    """Words by number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeated_windows(x: np.ndarray, text: np.ndarray, w: int) -> np.ndarray:
    """Positions whose w words occur again in the same text; a few others may be among them. text: the text of each word."""
    n = len(x) - w + 1
    if n < 2:
        return np.zeros(0, np.int64)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    h, have = splitmix(x.astype(np.uint64) + np.uint64(1)), 1
    while have < w:
        step = min(have, w - have)
        h, have = splitmix(h[: len(h) - step] * multiplier + h[step:]), have + step
    whole = text[:n] == text[w - 1 :]
    key = h ^ splitmix(text[:n].astype(np.uint64) * multiplier)
    bits = max(8, int(n).bit_length() + 2)
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    seen = np.bincount(bucket[whole], minlength=1 << bits)
    at = np.flatnonzero(whole & (seen[bucket] > 1))
    k = key[at]
    order = np.argsort(k, kind="stable")
    k = k[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    again[:-1] |= again[1:]
    return at[np.sort(order[again])]


class SuffixTree:
    """The suffix tree of numbers whose last one occurs nowhere else: sorted suffixes, and nodes as intervals of them."""

    def __init__(self, y: np.ndarray):
        n = len(y)
        self.y, self.ranks = y, [np.unique(y, return_inverse=True)[1].astype(np.int32)]
        while int(self.ranks[-1].max()) < n - 1:
            r, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            key = r.astype(np.int64) * (n + 1)
            key[: n - step] += r[step:].astype(np.int64) + 1
            self.ranks.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        self.rank = self.ranks[-1]
        self.suffix = np.empty(n, np.int64)
        self.suffix[self.rank] = np.arange(n)
        self.common = np.full(n + 1, -1, np.int64)  # common[k]: words that sorted suffixes k - 1 and k share
        self.common[1:n] = self.shared(self.suffix[:-1], self.suffix[1:], 1)
        self._nodes()

    def shared(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from a and b on (way 1), or right before them (way -1); a differs from b."""
        n, a, b = len(self.y), a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.ranks) - 2, -1, -1):
            step, r = 1 << k, self.ranks[k]
            i, j = (a, b) if way > 0 else (a - step, b - step)
            ok = (i >= 0) & (j >= 0) & (i < n) & (j < n)
            ok[ok] = r[i[ok]] == r[j[ok]]
            a[ok] += way * step
            b[ok] += way * step
        return np.abs(a - start)

    def _nodes(self) -> None:
        """left, right and depth of each node below the root; owner[k]: the node whose children common[k] parts, or -1."""
        n, values = len(self.y), self.common.tolist()
        before, after, open_ = [0] * (n + 1), [0] * (n + 1), [0]
        for k in range(1, n + 1):
            v = values[k]
            while values[open_[-1]] > v:
                after[open_.pop()] = k
            before[k] = open_[-1] if values[open_[-1]] < v else before[open_[-1]]
            open_.append(k)
        at = np.flatnonzero(self.common > 0)
        key, owner = np.unique(np.asarray(before)[at] * (n + 1) + np.asarray(after)[at], return_inverse=True)
        self.left, self.right = key // (n + 1), key % (n + 1) - 1
        self.owner = np.full(n + 1, -1, np.int64)
        self.owner[at] = owner
        self.depth = np.zeros(len(key), np.int64)
        self.depth[owner] = self.common[at]

    def smaller_halves(self) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, node) for each node and each leaf below its children but the largest."""
        n = len(self.y)
        left, right = np.concatenate([self.left, np.arange(n)]), np.concatenate([self.right, np.arange(n)])
        parent = self.owner[np.where(self.common[left] >= self.common[right + 1], left, right + 1)]
        below = parent >= 0
        left, right, parent = left[below], right[below], parent[below]
        size = right - left + 1
        order = np.lexsort((size, parent))
        left, size, parent = left[order], size[order], parent[order]
        small = np.zeros(len(parent), bool)
        small[:-1] = parent[1:] == parent[:-1]  # the last of a parent is the largest
        left, size, parent = left[small], size[small], parent[small]
        leaf = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        return self.suffix[leaf], np.repeat(parent, size)

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, half) of the tandem repeats whose two halves are followed by different words."""
        n, starts, halves = len(self.y), [], []
        leaf, node = self.smaller_halves()
        d = self.depth[node]
        for first, second in ((leaf, leaf + d), (leaf - d, leaf)):
            other = second if first is leaf else first
            ok = (first >= 0) & (second + d < n)
            r = self.rank[np.where(ok, other, 0)]
            ok &= (r >= self.left[node]) & (r <= self.right[node])
            i, q = first[ok], d[ok]
            ends = self.y[i + q] != self.y[i + 2 * q]
            starts.append(i[ends])
            halves.append(q[ends])
        return np.concatenate(starts), np.concatenate(halves)

    def runs(self, least: int, least_copies: int) -> np.ndarray:
        """Rows (start, end, period) of the maximal runs that are long enough, in order of start and period."""
        i, q = self.branching_repeats()
        end = i + 2 * q
        start = i - self.shared(i, i + q, -1)
        order = np.lexsort((q, end, start))
        start, end, q = start[order], end[order], q[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        first &= end - start >= np.maximum(least, least_copies * q)
        found = np.stack([start, end, q], 1)[first]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(x: np.ndarray, text: np.ndarray, least: int = 24, least_copies: int = 3) -> np.ndarray:
    """Rows (start, end, period) of the runs of x, numbers of words of one text after the other; text: the text of each."""
    # a run of period q agrees with itself for L - q >= max(least - q, (least_copies - 1) * q) words
    w = max(1, min(max(least - q, (least_copies - 1) * q) for q in range(1, least + 1)))
    at = repeated_windows(x, text, w)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + w, -1)
    near = np.cumsum(edge[:-1]) > 0
    place = np.flatnonzero(near)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (text[place[1:]] != text[place[:-1]])
    stretch = np.cumsum(new) - 1
    length = np.bincount(stretch)
    keep = length[stretch] >= least
    place, stretch = place[keep], stretch[keep]
    if not len(place):
        return np.zeros((0, 3), np.int64)
    stretch = np.unique(stretch, return_inverse=True)[1]
    n, m = len(place) + int(stretch[-1]) + 1, int(x.max()) + 1
    y, back = np.empty(n, np.int64), np.zeros(n, np.int64)
    spot = np.arange(len(place)) + stretch  # a number of its own follows each stretch
    y[:] = int(text[-1] + 1) * m + np.arange(n)
    y[spot] = text[place].astype(np.int64) * m + x[place]
    back[spot] = place
    found = SuffixTree(y).runs(least, least_copies)
    if len(found):
        shift = back[found[:, 0]] - found[:, 0]
        found = np.stack([found[:, 0] + shift, found[:, 1] + shift, found[:, 2]], 1)
    return found


def _slice_runs(texts: list[bytes], least: int, least_copies: int) -> tuple[list[int], list[list[tuple]], list[bytes]]:
    """Of each text: words, runs as (start, length, period), and what is left of it."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    codes = _Codes()
    x = np.fromiter((codes[w] for s in split for w in s), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    runs: list[list[tuple]] = [[] for _ in texts]
    first = np.concatenate([[0], np.cumsum(sizes)])
    drop = np.zeros(len(x) + 1, np.int64)
    for s, e, q in runs_of(x, text, least, least_copies).tolist():
        t = int(text[s])
        runs[t].append((s - int(first[t]), e - s, q))
        drop[s + q] += 1
        drop[e] -= 1
    gone = np.cumsum(drop) > 0
    left = []
    for t, s in enumerate(split):
        if runs[t]:
            s = [s[i] for i in np.flatnonzero(~gone[first[t] : first[t + 1]]).tolist()]
        left.append(b" ".join(s))
    return sizes.tolist(), runs, left


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, least_copies: int = 3) -> DataFrame:
    """key, n_words, runs (start, length and period in words, by start and period) and collapsed (the text's words but those
    that a run repeats, joined by a space) of every row."""
    import pyarrow as pa

    if least < 1 or least_copies < 2:
        raise ValueError("a run needs a word and two periods at least")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            data, offsets = column_buffers(b.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                n, runs, left = _slice_runs([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)], least, least_copies)
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], kind)
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), runs, pa.array(left, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "collapsed"])
            give_back()

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def retiled(text: Column, key: Column) -> Column:
    """The text, or, for one key in ten by crc32, its words with a tail that repeats: from word a on the first p, again and
    again, to the same number of words. Texts without a word and those of a null key stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    copies = (3 + g % 8).cast("int")
    p = 1 + F.floor((n - a) / copies).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), copies))
    tiled = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), tiled).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (start, length, period, exponent_milli), and digests of all runs and of
    the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = periodic_runs(docs.withColumn("text", retiled(F.col("text"), F.col("doc_id"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("x"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
