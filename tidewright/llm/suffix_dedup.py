"""Removal of byte strings that repeat anywhere in the corpus, exactly.

A byte goes if some 200-byte string over it starts at a second place. The work goes in four steps.

1. Cover. Each 200-byte window picks the k-gram of least hash in it (leftmost among equals). Equal windows pick
   the same k-gram at the same place in them, so these samples are a cover of all pairs of equal windows, as a
   difference cover is of all pairs of places. A run of window starts with one sample is a cover entry: the
   sample's hash, and a 64-bit hash of all bytes that the run's windows span.
2. Ranks. Entries go to buckets by the sample's hash, equal entries of one task joined before they move. An
   entry that occurs twice has all its windows repeated: long ties end here, without looking at text. An entry
   without an equal, whose sample occurs elsewhere in other surroundings, is undecided.
3. Buckets. Undecided entries bring their bytes; buckets are suffixes that share a sample. One bucket after the
   other is sorted: each window start is compared on its first bytes, and beyond v bytes by the ranks of a
   difference-cover sample of the bucket's text. Neighbours with 200 bytes in common are repeats. A bucket that
   is too large for a task is split by what stands left (or right) of the sample until its parts are small.
4. Spans are joined with the texts, and cut.

Hashes: a sample is compared by 64 bits and an entry by 64 more of another polynomial, 128 in all.

Defined cases: null texts are empty; texts under 200 bytes lose nothing; repeated rows repeat each other's text
and lose it, all of them; texts of any length are worked on in slices that overlap by 199 bytes; further columns
stay as they are in remove_repeats(); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK64, arrow_rows, column_buffers, give_back, materialize, sized_join, slices, splitmix, text_key

LENGTH, GRAM, SLICE = 200, 40, 1 << 19
#: A bucket of more undecided entries is split before it is sorted.
MOST_ENTRIES = 4_000


# Step 1


class Cover:
    """Cover entries of slices of texts, by numpy."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        import numpy as np

        self.np, self.length, self.gram = np, length, gram
        rng = np.random.default_rng(length * 1000 + gram)
        self.byte = [rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        self.base = [int(b) | 1 for b in rng.integers(1 << 40, 1 << 63, 2, np.uint64)]
        self.power: list = [None, None]
        self.inverse: list = [None, None]

    def _powers(self, n: int) -> None:
        np = self.np
        if self.power[0] is None or len(self.power[0]) < n:
            for i in range(2):
                self.power[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, self.base[i], np.uint64)]))
                self.inverse[i] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(self.base[i], -1, MASK64 + 1), np.uint64)]))

    def sums(self, data, i: int):
        """Running sums from which range hashes follow."""
        np = self.np
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[i][data] * self.power[i][: len(data)], out=out[1:])
        return out

    def windows(self, data, starts):
        """Hashes of the windows at starts."""
        self._powers(len(data))
        s = self.sums(data, 0)
        return splitmix((s[starts + self.length] - s[starts]) * self.inverse[0][starts])

    def entries(self, data, offsets):
        """For the texts data[offsets[k] : offsets[k + 1]]: text number, first and last window start (in data), place
        of the sample, sample hash and span hash of every entry."""
        np, n, k, w = self.np, len(data), self.gram, self.length - self.gram + 1
        empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        if n < self.length:
            return empty
        self._powers(n)
        s0 = self.sums(data, 0)
        grams = splitmix((s0[k:] - s0[:-k]) * self.inverse[0][: n - k + 1])
        key = (grams & np.uint64(~0xFFFFFF & MASK64)) | np.arange(n - k + 1, dtype=np.uint64)
        m = len(key) // w * w + w  # block minima from the left and from the right give every window's minimum
        padded = np.full(m, MASK64, np.uint64)
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        owner = (np.minimum(right[:starts], left[w - 1 : w - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
        valid = np.arange(starts) + self.length <= offsets[1:][text]
        change = np.ones(starts, bool)
        change[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
        first = np.flatnonzero(change & valid)
        if not len(first):
            return empty
        stop = change | ~valid
        stop_at = np.flatnonzero(np.concatenate([stop, [True]]))
        last = stop_at[np.searchsorted(stop_at, first, "right")] - 1
        place = owner[first]
        s1 = self.sums(data, 1)
        span = splitmix((s1[last + self.length] - s1[first]) * self.inverse[1][first]) ^ splitmix(((last - first) * 1024 + place - first).astype(np.uint64))
        return text[first], first, last, place, grams[place], span


def _texts(b) -> Iterator[tuple]:
    """(k1, k2, data, offsets relative to data, start of the slice in its text) of a batch; long texts in overlapping slices."""
    import numpy as np

    k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
    data, offs = column_buffers(b.column(2))
    for x, y in slices(offs, SLICE):
        part, o = data[offs[x] : offs[y]], offs[x : y + 1] - offs[x]
        if y - x == 1 and len(part) > 2 * SLICE:
            for at in range(0, len(part), SLICE):
                piece = part[at : at + SLICE + LENGTH - 1]
                yield k1[x:y], k2[x:y], piece, np.array([0, len(piece)]), at
        else:
            yield k1[x:y], k2[x:y], part, o, 0


ENTRY = [("gram", "<u8"), ("span", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("first", "<i4"), ("last", "<i4"), ("place", "<i4"), ("twice", "?"), ("mixed", "?")]
#: A sample with more surroundings than this in one batch is hot: its entries are dealt out by surroundings.
HOT = 512


def cover(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, entries): packed entries of the texts of docs (k1, k2, data). Of entries that are equal within a
    batch, the first stands for all with twice set, and the others go along under bucket -1: they are repeats."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        c = Cover()
        for b in batches:
            found = []
            for k1, k2, data, offs, at in _texts(b):
                text, first, last, place, gram, span = c.entries(data, offs)
                e = np.zeros(len(text), ENTRY)
                e["gram"], e["span"], e["k1"], e["k2"] = gram, span, k1[text], k2[text]
                base = offs[text] - at
                e["first"], e["last"], e["place"] = first - base, last - base, place - base
                found.append(e)
            if not found:
                continue
            e = np.concatenate(found)
            e = e[np.lexsort((e["span"], e["gram"]))]
            same = (e["gram"][1:] == e["gram"][:-1]) & (e["span"][1:] == e["span"][:-1])
            more = np.concatenate([[False], same])
            e["twice"][:-1] = same & ~more[:-1]
            rest, e = e[more], e[~more]
            rest["twice"] = True
            bucket = (e["gram"] % np.uint64(buckets)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], e["gram"][1:] != e["gram"][:-1]]))
            size = np.diff(np.concatenate([start, [len(e)]]))
            hot = np.repeat(size > HOT, size)
            e["mixed"] = hot
            hot[start] = False  # one entry stays, and tells its bucket that the sample is mixed
            bucket[hot] = (splitmix(e["span"][hot]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = [(int(bucket[i]), e[i:j].tobytes()) for i, j in zip([0, *cuts], [*cuts, len(e)]) if j > i]
            rows += [(-1 - int(rest["gram"][0] % np.uint64(buckets)), rest.tobytes())] if len(rest) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])
        give_back()

    return docs.mapInArrow(run, "bucket int, entries binary")


# Step 2


def rank(covered: DataFrame, buckets: int) -> DataFrame:
    """Rows (k1, k2, gram, first, last, place, decided) of the entries that are repeats, and of those undecided."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        e = np.concatenate([np.frombuffer(x, ENTRY) for x in pdf["entries"]])
        if key[0] < 0:
            keep, decided = np.ones(len(e), bool), np.ones(len(e), bool)
        else:
            e = e[np.lexsort((e["span"], e["gram"]))]
            g = e["gram"][1:] == e["gram"][:-1]
            s = g & (e["span"][1:] == e["span"][:-1])
            near = lambda x: np.concatenate([[False], x]) | np.concatenate([x, [False]])
            decided = near(s) | e["twice"]
            # a sample with several surroundings: repeats stand for theirs once, the others are undecided
            mixed = near(g & ~s) | e["mixed"]
            group = np.cumsum(np.concatenate([[True], ~g]))
            mixed = np.isin(group, group[mixed])
            lead = ~np.concatenate([[False], s])
            keep = decided | mixed
            kind = np.where(decided, np.where(mixed & lead, 2, 1), 0).astype(np.int8)
            e, kind = e[keep], kind[keep]
            return pd.DataFrame({"k1": e["k1"], "k2": e["k2"], "gram": e["gram"].astype(np.int64), "first": e["first"], "last": e["last"], "place": e["place"], "kind": kind})
        return pd.DataFrame({"k1": e["k1"], "k2": e["k2"], "gram": e["gram"].astype(np.int64), "first": e["first"], "last": e["last"], "place": e["place"], "kind": np.ones(len(e), np.int8)})

    return covered.groupBy("bucket").applyInPandas(run, "k1 long, k2 long, gram long, first int, last int, place int, kind byte")


# Step 3


class DifferenceCover:
    """Sorts window starts of a text by their first length bytes, bucket by bucket. Places whose number modulo v is in
    the cover have ranks, made once by doubling; a tie over v bytes is settled by ranks that both places reach by one shift."""

    #: Fixed value: differences of these numbers give every number modulo 13.
    COVER, V = (0, 1, 3, 9), 13

    def __init__(self, text, starts, length: int = LENGTH):
        """text: an array of bytes; starts: the window starts that will be asked for, to which the sample is confined."""
        import numpy as np

        self.np, self.length, v = np, length, self.V
        self.depth = (length - v + 1) // v * v  # what ranks compare: from any shift below v on, it stays in the window
        self.text, n = text, len(text)
        self.words = np.ndarray(max(0, n - 7), ">u8", text, strides=(1,)) if n >= 8 else np.zeros(0, ">u8")
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + (length - v + 1), -1)
        places = np.flatnonzero((np.cumsum(inside[:n]) > 0) & np.isin(np.arange(n) % v, self.COVER))
        self.rank, step = np.full(n + length, -1, np.int64), v
        self.rank[places] = self._first(places)
        while step < self.depth:
            more = min(step, self.depth - step)
            places = places[self.rank[places + more] >= 0]
            longer = self._dense(self.rank[places] << 32 | self.rank[places + more])
            self.rank[:] = -1
            self.rank[places] = longer
            step += more

    def _dense(self, key):
        """Ranks of keys, from 0 on; equal keys share one."""
        return self.np.unique(key, return_inverse=True)[1].astype(self.np.int64)

    def _first(self, places):
        """Ranks of places by their first v bytes: eight, then the five to which byte v is the last."""
        np = self.np
        head = self._dense(self.words[places].astype(np.uint64))
        return self._dense(head << 40 | (self.words[places + self.V - 8] & np.uint64((1 << 40) - 1)).astype(np.int64))

    def repeats(self, places):
        """Which of the places share their first length bytes with another. Ties on the first v and on the bytes from depth
        on are settled, for each shift below v, by the ranks of the places that reach the cover by it: any two places
        reach it together by one of the shifts."""
        np, out = self.np, self.np.zeros(len(places), bool)
        group = self._first(places)
        for at in range(self.depth, self.length, 8):
            group = self._dense(group << 32 | self._dense(self.words[places + min(at, self.length - 8)].astype(np.uint64)))
        tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
        for d in range(self.V):
            use = tied[np.isin((places[tied] + d) % self.V, self.COVER)]
            _, back, m = np.unique(group[use] << 32 | self.rank[places[use] + d], return_inverse=True, return_counts=True)
            out[use[m[back] > 1]] = True
        return out


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries (k1, k2, gram, first, last, place, kind) with the bytes that their windows span. docs: k1, k2, row, data; one
    row of each text is asked."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "first", "last", "place", "kind")).alias("e"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(2):
                v = x.values
                e = np.zeros(len(v), PACKED)
                for name in e.dtype.names:
                    e[name] = v.field(name).to_numpy()
                out.append(e.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["k1", "k2", "packed"])

    lists = materialize(lists.mapInArrow(pack, "k1 long, k2 long, packed binary"), "wanted")
    rows = docs.select("k1", "k2", "row").join(lists.select("k1", "k2").hint("merge"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("row").alias("row"))
    lists = lists.join(rows.hint("merge"), ["k1", "k2"]).select("k1", "k2", F.coalesce("row", F.lit(NO_ROW)).alias("row"), "packed")
    lists = materialize(lists, "wanted-rows")
    asked = docs.withColumn("row", F.coalesce("row", F.lit(NO_ROW)))
    joined = sized_join(asked, lists, ["k1", "k2", "row"], "inner", F.octet_length("packed") + 48).select("k1", "k2", "data", "packed")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                data, e = b.column(2)[k].as_py(), np.frombuffer(b.column(3)[k].as_py(), PACKED)
                n = len(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column(0)[k].as_py())), pa.array(np.full(n, b.column(1)[k].as_py())), *(pa.array(e[c].copy()) for c in ("gram", "first", "last", "place", "kind")), pa.array([data[x : y + LENGTH] for x, y in zip(e["first"].tolist(), e["last"].tolist())], pa.binary())],
                    ["k1", "k2", "gram", "first", "last", "place", "kind", "bytes"],
                )
        give_back()

    return joined.mapInArrow(cut, "k1 long, k2 long, gram long, first int, last int, place int, kind byte, bytes binary")


PACKED = [("gram", "<i8"), ("first", "<i4"), ("last", "<i4"), ("place", "<i4"), ("kind", "<i1")]
NO_ROW = -(1 << 63)
PART = 20


def decide(entries: DataFrame) -> DataFrame:
    """Rows (k1, k2, first, last): runs of window starts of entries (with bytes) that are repeats."""
    large = materialize(entries.groupBy("gram").count().filter(F.col("count") > MOST_ENTRIES).select("gram"), "large")
    small = entries.withColumn("part", F.lit(0)).withColumn("core", F.lit(0).cast("long"))
    if large.isEmpty():
        return _sorted(small)
    rest = entries.join(large.hint("merge"), "gram", "left_semi")
    small = small.join(large.hint("merge"), "gram", "left_anti")
    # split by PART window starts at a time: these windows share a core of bytes, by which they part
    w = LENGTH - GRAM
    a, b = F.floor((F.col("first") - F.col("place") + w) / PART), F.floor((F.col("last") - F.col("place") + w) / PART)
    parts = rest.withColumn("part", F.explode(F.sequence(a, b)))
    low = F.greatest(F.col("first"), F.col("place") - w + F.col("part") * PART).cast("int")
    high = F.least(F.col("last"), F.col("place") - w + (F.col("part") + 1) * PART - 1).cast("int")
    at = F.col("place") - w + (F.col("part") + 1) * PART - 1 - F.col("first")
    core = F.substring(F.col("bytes"), (F.greatest(at, F.lit(0)) + 1).cast("int"), F.lit(LENGTH - PART + 1))
    parts = parts.select("k1", "k2", "gram", low.alias("first"), high.alias("last"), "place", "kind", F.substring(F.col("bytes"), (low - F.col("first") + 1).cast("int"), (high - low + LENGTH).cast("int")).alias("bytes"), F.col("part").cast("int").alias("part"), F.when(F.col("part") * PART + PART - 1 <= w, F.xxhash64(core)).otherwise(F.lit(0)).alias("core"))
    parts = materialize(parts, "parts")
    group = ["gram", "part", "core"]
    still = materialize(parts.groupBy(*group).count().filter(F.col("count") > MOST_ENTRIES).select(*group), "still-large")
    runs = _sorted(small.unionByName(parts.join(still.hint("merge"), group, "left_anti")))
    # what is still large comes down to single windows, which are counted
    one = parts.join(still.hint("merge"), group, "left_semi").withColumn("at", F.explode(F.sequence("first", "last")))
    window = F.substring(F.col("bytes"), F.col("at") - F.col("first") + 1, F.lit(LENGTH))
    one = materialize(one.select("k1", "k2", F.col("at").cast("int").alias("at"), F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2")), "windows")
    often = one.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    return runs.unionByName(one.join(often.hint("merge"), ["h1", "h2"], "left_semi").select("k1", "k2", F.col("at").alias("first"), F.col("at").alias("last")))


#: Bytes of entries in a block, which is sorted at once, and in a task.
BLOCK, TASK = 1 << 20, 8 << 20


def _sorted(entries: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def block(held):
            k1, k2, first, last, kind = (np.concatenate([x[k] for x in held]) for k in range(5))
            text = np.concatenate([x[5] for x in held])
            size = np.concatenate([x[6] for x in held])
            lead, n = np.cumsum(size) - size, last - first + 1
            who = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            at = lead[who] + step
            # a start matters if its window's hash occurs again, with an undecided entry among the holders
            _, group, m = np.unique(cover.windows(text, at), return_inverse=True, return_counts=True)
            use = np.flatnonzero(((m > 1) & (np.bincount(group, kind[who] == 0) > 0))[group])
            found = np.zeros(len(at), bool)
            if len(use):
                found[use] = DifferenceCover(text, at[use]).repeats(at[use])
            starts = np.flatnonzero(found & ~(np.concatenate([[False], found[:-1]]) & (step > 0)))
            ends = np.flatnonzero(found & ~(np.concatenate([found[1:], [False]]) & np.concatenate([step[1:] > 0, [False]])))
            w = who[starts]
            return pa.RecordBatch.from_arrays([pa.array(k1[w]), pa.array(k2[w]), pa.array((first[w] + step[starts]).astype(np.int32)), pa.array((first[w] + step[ends]).astype(np.int32))], ["k1", "k2", "first", "last"])

        cover, held, size, last = Cover(), [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key, *numbers = (b.column(k).to_numpy() for k in range(6))
            data, offs = column_buffers(b.column(6))
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # where a bucket ends in this batch
            if size > BLOCK and key[0] != last:
                yield block(held)
                held, size = [], 0
            x = 0
            while x < len(key):
                over = np.flatnonzero((ends > x) & (offs[ends] - offs[x] + size > BLOCK))
                y = int(ends[over[0]]) if len(over) else len(key)
                held.append((*(v[x:y] for v in numbers), data[offs[x] : offs[y]], np.diff(offs[x : y + 1])))
                size += int(offs[y] - offs[x])
                if y < len(key):
                    yield block(held)
                    held, size = [], 0
                x = y
            last = key[-1]
        if held:
            yield block(held)
        give_back()

    # tasks by bytes: entries are unequal, and equal bytes shrink in a shuffle
    total = entries.agg(F.sum(F.col("last") - F.col("first") + LENGTH).alias("n")).first()["n"] or 0
    key = F.xxhash64("gram", "part", "core")
    rows = entries.select(key.alias("key"), "k1", "k2", "first", "last", "kind", "bytes")
    return rows.repartition(max(12, total // TASK), "key").sortWithinPartitions("key").mapInArrow(run, "k1 long, k2 long, first int, last int")


# Step 4


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (k1, k2, spans) for the texts that lose bytes; spans: packed pairs of int32, sorted and apart. docs: k1, k2,
    row, data."""
    total = docs.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    buckets = max(12, total // (16 << 20))
    rows = docs.select("k1", "k2", "data").filter(F.octet_length("data") >= LENGTH)
    ranked = materialize(rank(cover(rows, buckets), buckets), "ranked")
    runs = decide(materialize(contexts(docs, ranked.filter("kind <> 1")), "contexts"))
    runs = ranked.filter("kind <> 0").select("k1", "k2", "first", "last").unionByName(runs)
    lists = runs.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("e"))

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for x in b.column(2):
                v = x.values
                first, last = v.field("first").to_numpy(), v.field("last").to_numpy() + LENGTH
                order = np.argsort(first)
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.concatenate([[True], first[1:] > last[:-1]])
                end = last[np.concatenate([new[1:], [True]])]
                out.append(np.column_stack([first[new], end]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["k1", "k2", "spans"])

    return materialize(lists.mapInArrow(merge, "k1 long, k2 long, spans binary"), "spans")


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with k1, k2 (the text's key), row and data, the text's bytes."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"k1": text_key(t)[0], "k2": text_key(t)[1], "row": F.xxhash64(key), "data": t.cast("binary")})


def _with_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    keyed = _keyed(df.select(key, text), key, text).select("k1", "k2", "row", "data")
    with arrow_rows(df.sparkSession, 2_500):
        spans = repeated_spans(keyed)
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({"__k1": text_key(t)[0], "__k2": text_key(t)[1]})
    spans = spans.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    return sized_join(out, spans, ["__k1", "__k2"], "left", F.octet_length("__spans") + 40).drop("__k1", "__k2")


def _cut(data: bytes, spans: bytes | None) -> tuple[bytes, int]:
    import numpy as np

    if not spans:
        return data, 0
    pairs = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist()
    at, out = 0, []
    for a, b in pairs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]), len(pairs)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all repeats cut out of text; UTF-8 sequences that a cut leaves incomplete go too. Rows that lose all
    they had go; rows without repeats stay as they are."""
    joined, columns = _with_spans(docs, key, text), docs.columns
    at, schema = columns.index(text), docs.schema
    joined = joined.select(*columns, "__spans")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep, texts = [], []
            for k, (t, s) in enumerate(zip(b.column(at), b.column(len(columns)))):
                value, spans = t.as_py(), s.as_py()
                if spans:
                    value = _cut(value.encode(), spans)[0].decode("utf-8", "ignore")
                    if not value.strip():
                        continue
                keep.append(k)
                texts.append(value)
            out = [c.take(pa.array(keep, pa.int64())) for c in b.columns[: len(columns)]]
            out[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(out, columns)
        give_back()

    return joined.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    joined = _with_spans(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"), "__spans")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            n, removed, spans, sha = [], [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                data = t.as_py()
                kept, k = _cut(data, s.as_py())
                n.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(k)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
