"""Exact Jaccard join of documents' word shingles, as a metric-space join.

1 - Jaccard is a metric. The join looks for all that pairs of sets within r = 1 - threshold of each other connect:

1. Survey. A set can only have a partner if at most n - ceil(threshold * n) of its shingles occur in no other set. Half
   of the shingles (by a bit of their hash) are counted over the whole corpus; sets with more unshared ones than that,
   nearly all, are alone. Shingles that recur in a batch are counted there and travel once a batch.
2. Neighbourhoods. The others order their shingles by a common order (those that few of them hold first, by exact counts)
   and list the first n - ceil(threshold * n) + 1. Sets within r of each other share a listed shingle and differ in size by no
   more than the threshold; sets that are connected so make a neighbourhood. Most documents are at distance 1 from any
   pivot, where triangle windows exclude nothing: neighbourhoods are where the metric tells documents apart.
3. Regions. A neighbourhood is a metric join of its own: pivots, of different components, meet all members; a member
   goes to the region of its nearest pivot and, by the triangle inequality, to each whose pivot is no more than 2r
   farther; members at distance 1 of all pivots, and those by no more than r nearer, are a region too. Regions recurse.
   In a last region a set meets those of other components whose distances to all pivots so far differ by at most r from
   its own. Pairs within a component need no look: they add no component.
4. A neighbourhood of more than CELL_NODES sets or CELL_SHINGLES shingles first splits over tasks in the same way, its
   members dealt out and its pivots sent to each part. One that regions don't halve is dealt in blocks: the
   sets outside its largest component meet all, one pair of blocks a task. So no task holds more than a region's bound
   (a single set larger than that apart), and no link between different components is lost, however rows are dealt.

Rows of pairs are never made: a task gives the links that connect. Sets are identified by 128 bits of commutative
hashes, shingles by 64; the survey takes 32 bits and the bucket's number, where a collision only keeps a set in.

Defined cases: null, empty and blank texts have the empty set, linked with nothing, each its own component; fewer
words than a shingle make one shingle; repeated rows and equal sets share a component; a null doc_id is never a
smallest id unless all ids of a component are null; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MASK64, arrow_rows, column_buffers, discard, give_back, materialize, once_a_worker, sized_join, small_enough, slices, splitmix, text_key, written

WORDS, NUM, DEN = 5, 4, 5  # five words, threshold 4/5
RADIUS, EPS = 1 - NUM / DEN, 1e-9
#: A neighbourhood or region up to both is joined in one task.
CELL_NODES, CELL_SHINGLES = 2_048, 1 << 20
#: Pivots of a region; a region of up to LEAF sets has none.
PIVOTS, LEAF = 8, 32
#: Bytes of text and shingles that a worker has in hand at once.
SLICE, BLOCK = 1 << 19, 1 << 18
#: 64 * log2 of sizes whose ratio is at the threshold differ by no more than this, rounding included.
SIZES_APART = 22


class Shingler:
    """Distinct shingle hashes of many texts at once."""

    def __init__(self):
        import numpy as np

        self.np = np
        rng = np.random.default_rng(505)
        self.byte = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.byte[65:91] = self.byte[97:123]  # A-Z as a-z
        self.white = np.zeros(256, bool)
        self.white[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(rng.integers(1 << 40, 1 << 63)) | 1
        self.mix = [np.uint64(int(x) | 1) for x in rng.integers(1 << 40, 1 << 63, WORDS)]
        self.power = self.inverse = None

    def _powers(self, n: int) -> None:
        np = self.np
        if self.power is None or len(self.power) < n:
            one = np.ones(1, np.uint64)
            self.power = np.multiply.accumulate(np.concatenate([one, np.full(n, self.base, np.uint64)]))
            self.inverse = np.multiply.accumulate(np.concatenate([one, np.full(n, pow(self.base, -1, MASK64 + 1), np.uint64)]))

    def sets(self, data, offs):
        """Text number and hash of each distinct shingle of data[offs[k] : offs[k + 1]], sorted by both."""
        np, n = self.np, len(data)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not n:
            return none
        self._powers(n)
        dark = ~self.white[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        start = np.flatnonzero(dark & (edge[:-1] | np.concatenate([[True], ~dark[:-1]])))
        if not len(start):
            return none
        end = np.flatnonzero(dark & (edge[1:] | np.concatenate([~dark[1:], [True]]))) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[:n], out=sums[1:])
        word = splitmix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        text = np.searchsorted(offs, start, "right") - 1
        count = np.bincount(text, minlength=len(offs) - 1)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        long = count >= WORDS
        head = np.flatnonzero(long[text[: len(text) - WORDS + 1]] & (text[: len(text) - WORDS + 1] == text[WORDS - 1 :])) if len(text) >= WORDS else np.zeros(0, np.int64)
        h = np.zeros(len(head), np.uint64)
        for k in range(WORDS):
            h += word[head + k] * self.mix[k]
        t = text[head]
        few = np.flatnonzero((count > 0) & ~long)
        if len(few):
            g = np.zeros(len(few), np.uint64)
            for k in range(WORDS - 1):
                has = count[few] > k
                g[has] += word[first[few][has] + k] * self.mix[k]
            t, h = np.concatenate([t, few]), np.concatenate([h, g + count[few].astype(np.uint64)])
        h = splitmix(h)
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])])
        return t[new], h[new]


def _shingler() -> Shingler:
    return once_a_worker("shingler", Shingler)


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(key).alias("id"), *text_key(t), t.cast("binary").alias("data"))


# Step 1

#: Entries of the survey: 32 bits of a shingle's hash, and the row in the block that asks whether another set holds it.
#: Two values of row ask nothing: once for a shingle that one set of the block holds, and more for several.
ASK, ONCE, SEVERAL = [("h", "<u4"), ("row", "<u2")], 65534, 65535


def survey(docs: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: a row for each text (ref, id, k1, k2, n, s1, s2, short). short: how many of its shingles, unshared within
    the block, must be found elsewhere; without any, it stays. Kind 1: entries (bucket, block's first ref, packed). Kind 2:
    (block's first ref, packed rows and short of those that ask)."""
    id_kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        s, base = _shingler(), TaskContext.get().partitionId() << 36
        names = ["kind", "bucket", "ref", "id", "k1", "k2", "n", "s1", "s2", "short", "packed"]

        def emit(kind, ref, bucket=None, ids=None, k=(None,) * 6, packed=None):
            m = len(ref)
            full = lambda v, t: pa.nulls(m, t) if v is None else pa.array(v, t)
            return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int8()), full(bucket, pa.int32()), full(ref, pa.int64()), ids if ids is not None else pa.nulls(m, kind_of_id), *(full(v, pa.int64()) for v in k), full(packed, pa.binary())], names)

        def block(part, ts, hs):
            """part: rows of a batch; ts, hs: their shingles."""
            rows = part.num_rows
            t, h = np.concatenate(ts), np.concatenate(hs)
            n = np.bincount(t, minlength=rows)
            at = np.flatnonzero(n)
            s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            if len(at):
                lead = np.concatenate([[0], np.cumsum(n[at])])[:-1]
                s1[at] = splitmix(np.add.reduceat(h, lead) + n[at].astype(np.uint64))
                s2[at] = splitmix(np.add.reduceat(splitmix(h ^ np.uint64(0x5DEECE66D)), lead))
            half = (h & np.uint64(1)) == 0
            t, h = t[half], h[half]
            order = np.argsort(h)
            t, h = t[order], h[order]
            lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            one = np.diff(np.append(lead, len(h))) == 1
            t, h = t[lead], h[lead]
            alone = np.bincount(t[one], minlength=rows)
            short = alone - (n - (NUM * n + DEN - 1) // DEN)
            yield emit(0, base + np.arange(rows), None, part.column(0), (part.column(1), part.column(2), n, s1.view(np.int64), s2.view(np.int64), short))
            asks = np.flatnonzero(short > 0)
            if len(asks):
                e = np.zeros(len(asks), [("row", "<u2"), ("short", "<i4")])
                e["row"], e["short"] = asks, short[asks]
                yield emit(2, [base], packed=[e.tobytes()])
            e = np.zeros(len(h), ASK)
            e["h"] = (h >> np.uint64(32)).astype(np.uint32)
            e["row"] = np.where(one, np.where(short[t] > 0, t, ONCE), SEVERAL)
            bucket = (h & np.uint64(0xFFFFFFFF)) // np.uint64(2) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            e, cuts = e[order], np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            if full:
                yield emit(1, [base] * len(full), full, packed=[e[cuts[k] : cuts[k + 1]].tobytes() for k in full])

        for big in batches:
            kind_of_id = big.schema.field(0).type
            for b in (big.slice(k, 20_000) for k in range(0, big.num_rows, 20_000)):
                data, offs = column_buffers(b.column(3))
                first, ts, hs, held = 0, [], [], 0
                for x, y in slices(offs, SLICE):
                    t, h = s.sets(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
                    ts.append(t + (x - first))
                    hs.append(h)
                    held += len(t)
                    if held > BLOCK or y == b.num_rows:
                        yield from block(b.slice(first, y - first), ts, hs)
                        base += y - first
                        first, ts, hs, held = y, [], [], 0
        give_back()

    return docs.select("id", "k1", "k2", "data").mapInArrow(run, f"kind byte, bucket int, ref long, id {id_kind}, k1 long, k2 long, n long, s1 long, s2 long, short long, packed binary")


def survivors(listed: DataFrame) -> DataFrame:
    """Refs of the sets of survey() that may have a partner."""

    def count(pdf):
        import numpy as np
        import pandas as pd

        e = np.concatenate([np.frombuffer(x, ASK) for x in pdf["packed"]])
        who = np.repeat(np.arange(len(pdf)), [len(x) // 6 for x in pdf["packed"]])
        _, back, m = np.unique(e["h"], return_inverse=True, return_counts=True)
        m = m + np.bincount(back, e["row"] == SEVERAL).astype(np.int64)
        found = np.flatnonzero((m[back] > 1) & (e["row"] < ONCE))
        key, k = np.unique(who[found] << 16 | e["row"][found], return_counts=True)
        out = np.zeros(len(key), [("row", "<u2"), ("found", "<u4")])
        out["row"], out["found"] = key & 0xFFFF, k
        cuts = np.searchsorted(key >> 16, np.arange(len(pdf) + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pd.DataFrame({"ref": pdf["ref"].to_numpy()[full], "kind": np.ones(len(full), np.int8), "packed": [out[cuts[k] : cuts[k + 1]].tobytes() for k in full]})

    def decide(key, pdf):
        import numpy as np
        import pandas as pd

        short = np.zeros(1 << 16, np.int64)
        for kind, x in zip(pdf["kind"], pdf["packed"]):
            if kind == 2:
                e = np.frombuffer(x, [("row", "<u2"), ("short", "<i4")])
                asks = e["row"].astype(np.int64)
                short[e["row"]] += e["short"]
            else:
                e = np.frombuffer(x, [("row", "<u2"), ("found", "<u4")])
                short[e["row"]] -= e["found"]
        return pd.DataFrame({"ref": key[0] + asks[short[asks] <= 0]})

    replies = listed.filter("kind = 1").groupBy("bucket").applyInPandas(count, "ref long, kind byte, packed binary")
    asked = listed.filter("kind = 2").select("ref", "kind", "packed").unionByName(replies).groupBy("ref").applyInPandas(decide, "ref long")
    return listed.filter("kind = 0 AND n > 0 AND short <= 0").select("ref").unionByName(asked)


# Step 2


#: A shingle of a set, by the set's row in the block, and in how many sets it is.
HELD = [("h", "<u8"), ("row", "<u2")]
COUNTED = [*HELD, ("sets", "<u4")]


def counted(texts: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: (ref of a block, packed nodes and sizes of its sets). Kind 1: (bucket, ref, packed HELD), every shingle of every set."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        s, ref = _shingler(), TaskContext.get().partitionId() << 32

        def block(nodes, sizes, shingles):
            own = np.zeros(sum(map(len, nodes)), [("node", "<i8"), ("n", "<u4")])
            own["node"], own["n"] = np.concatenate(nodes), np.concatenate(sizes)
            e = np.zeros(own["n"].sum(), HELD)
            e["h"], e["row"] = np.concatenate(shingles), np.repeat(np.arange(len(own)), own["n"])
            bucket = (e["h"] >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            e, cuts = e[order], np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            packed = [own.tobytes(), *(e[cuts[k] : cuts[k + 1]].tobytes() for k in full)]
            return pa.RecordBatch.from_arrays([pa.array([0] + [1] * len(full), pa.int8()), pa.array([None, *full], pa.int32()), pa.array([ref] * len(packed), pa.int64()), pa.array(packed, pa.binary())], ["kind", "bucket", "ref", "packed"])

        nodes, sizes, shingles, rows, held = [], [], [], 0, 0
        for b in batches:
            node = b.column(0).to_numpy()
            data, offs = column_buffers(b.column(1))
            for x, y in slices(offs, SLICE):
                t, h = s.sets(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
                nodes.append(node[x:y])
                sizes.append(np.bincount(t, minlength=y - x))
                shingles.append(h)
                rows, held = rows + y - x, held + len(h)
                if held > BLOCK or rows > 30_000:
                    yield block(nodes, sizes, shingles)
                    nodes, sizes, shingles, rows, held, ref = [], [], [], 0, 0, ref + 1
        if rows:
            yield block(nodes, sizes, shingles)
        give_back()

    return texts.select("node", "data").mapInArrow(run, "kind byte, bucket int, ref long, packed binary")


#: A listed shingle, a set that lists it, and the least and largest size of the sets that it stands for.
ENTRY = [("h", "<u8"), ("node", "<i8"), ("lo", "<u2"), ("hi", "<u2")]


def _chain(np, e):
    """Entries of a shingle whose sizes allow a link, one after the other, are connected. Returns the entries that stand
    for these runs, and packed pairs of nodes that connect each run."""
    e = e[np.lexsort((e["lo"], e["h"]))]
    new = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])
    group = np.cumsum(new) << 16
    top = np.maximum.accumulate(group | e["hi"]) & 0xFFFF
    new[1:] |= e["lo"][1:].astype(np.int64) > top[:-1] + SIZES_APART
    head = np.flatnonzero(new)
    runs = e[head]
    runs["hi"] = top[np.append(head[1:], len(e)) - 1]
    a, b = e["node"][head][np.cumsum(new) - 1], e["node"]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return runs, pairs.astype("<i8").tobytes()


def neighbourhoods(texts: DataFrame, shingles: int) -> DataFrame:
    """(node, comp) of all sets that have neighbours among texts (node, n, data), comp the neighbourhood. Sets list their rarest
    shingles, by exact counts over texts: by those of a sample, what a growing corpus holds often enough would tie it together."""
    buckets = max(12, shingles // (4 << 20))
    asked, path = written(counted(texts, max(12, shingles >> 20)), "counted")

    def count(pdf):
        import numpy as np
        import pandas as pd

        e = np.concatenate([np.frombuffer(x, HELD) for x in pdf["packed"]])
        who = np.repeat(np.arange(len(pdf)), [len(x) // 10 for x in pdf["packed"]])
        _, back, m = np.unique(e["h"], return_inverse=True, return_counts=True)
        found = np.flatnonzero(m[back] > 1)  # what one set holds is in no intersection
        out = np.zeros(len(found), COUNTED)
        out["h"], out["row"], out["sets"] = e["h"][found], e["row"][found], m[back][found]
        cuts = np.searchsorted(who[found], np.arange(len(pdf) + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pd.DataFrame({"ref": pdf["ref"].to_numpy()[full], "kind": np.ones(len(full), np.int8), "packed": [out[cuts[k] : cuts[k + 1]].tobytes() for k in full]})

    def choose(pdf):
        import numpy as np
        import pandas as pd

        own = np.frombuffer(pdf["packed"][pdf["kind"] == 0].iloc[0], [("node", "<i8"), ("n", "<u4")])
        e = np.concatenate([np.zeros(0, COUNTED), *(np.frombuffer(x, COUNTED) for x in pdf["packed"][pdf["kind"] == 1])])
        e = e[np.lexsort((e["h"], e["sets"], e["row"]))]
        n, shared = own["n"].astype(np.int64), np.bincount(e["row"], minlength=len(own))
        # those that no other set holds are listed first
        most = n - (NUM * n + DEN - 1) // DEN + 1 - (n - shared)
        e = e[np.arange(len(e)) - (np.cumsum(shared) - shared)[e["row"]] < most[e["row"]]]
        if not len(e):
            return pd.DataFrame({"bucket": np.zeros(0, np.int32), "packed": []})
        listed = np.zeros(len(e), ENTRY)
        listed["h"], listed["node"] = e["h"], own["node"][e["row"]]
        listed["lo"] = listed["hi"] = np.floor(64 * np.log2(n[e["row"]])).astype(np.uint16)
        runs, pairs = _chain(np, listed)
        bucket = (runs["h"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        runs, cuts = runs[order], np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
        full = np.flatnonzero(np.diff(cuts)).tolist()
        return pd.DataFrame({"bucket": np.array([*full, -1], np.int32), "packed": [*(runs[cuts[k] : cuts[k + 1]].tobytes() for k in full), pairs]})

    def meet(pdf):
        import numpy as np
        import pandas as pd

        p = np.frombuffer(_chain(np, np.concatenate([np.frombuffer(x, ENTRY) for x in pdf["packed"]]))[1], "<i8").reshape(-1, 2)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1]})

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            p = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in b.column(0)]).reshape(-1, 2) if b.num_rows else np.zeros((0, 2), np.int64)
            p = np.unique(p, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    replies = asked.filter("kind = 1").groupBy("bucket").applyInPandas(count, "ref long, kind byte, packed binary")
    listed = asked.filter("kind = 0").select("ref", "kind", "packed").unionByName(replies).groupBy("ref").applyInPandas(choose, "bucket int, packed binary")
    listed = materialize(listed, "listed")
    discard(texts.sparkSession, path)
    pairs = listed.filter("bucket >= 0").groupBy("bucket").applyInPandas(meet, "a long, b long")
    return materialize(components(pairs.unionByName(listed.filter("bucket < 0").select("packed").mapInArrow(unpack, "a long, b long"))), "neighbourhoods")


# Step 3


class Region:
    """The join of the sets of one region, in memory."""

    def __init__(self, sets: list):
        import numpy as np

        self.np, self.n = np, np.array([len(x) for x in sets])
        who = np.repeat(np.arange(len(sets)), self.n)
        _, back, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held[back] > 1  # what a single set holds is in no intersection
        who, back = who[shared], back[shared]
        _, back, self.held = np.unique(back, return_inverse=True, return_counts=True)
        self.first = np.cumsum(self.held) - self.held
        self.holders = who[np.argsort(back, kind="stable")]
        self.own = np.split(back, np.cumsum(np.bincount(who, minlength=len(sets)))[:-1])
        self.label, self.found = np.arange(len(sets)), []

    def common(self, i: int):
        """Sizes of the intersections of set i with all."""
        np, own = self.np, self.own[i]
        m = self.held[own]
        at = np.arange(m.sum()) + np.repeat(self.first[own] - (np.cumsum(m) - m), m)
        return np.bincount(self.holders[at], minlength=len(self.n))

    def meet(self, i: int, others):
        """Distances of others to i. A link that connects is noted."""
        np = self.np
        common = self.common(i)[others]
        total = self.n[i] + self.n[others] - common
        near = np.flatnonzero((DEN * common >= NUM * total) & (self.label[others] != self.label[i]))
        for label, k in zip(*np.unique(self.label[others[near]], return_index=True)):
            k = near[k]
            self.found.append((i, int(others[k]), int(common[k]), int(total[k])))
            self.label[self.label == label] = self.label[i]
        return 1 - common / total

    def links(self) -> list[tuple[int, int, int, int]]:
        """(i, j, common, total): links that connect all that any link connects."""
        np = self.np
        todo = [(np.arange(len(self.n)), np.zeros((0, len(self.n))))]
        while todo:
            members, seen = todo.pop()
            names, first, k = np.unique(self.label[members], return_index=True, return_counts=True)
            if len(names) < 2:
                continue
            if len(members) <= LEAF:
                self._last(members, seen)
                continue
            pivots = members[first[np.argsort(-k, kind="stable")[:PIVOTS]]]
            d = np.stack([self.meet(p, members) for p in pivots])
            rest = ~np.isin(members, pivots)
            members, d, seen = members[rest], d[:, rest], np.vstack([seen, d])[:, rest]
            parts = regions(np, d)
            if sum(int(p.sum()) ** 2 for p in parts) > len(members) ** 2 / 2:
                self._last(members, seen)
            else:
                todo += [(members[p], seen[:, p]) for p in parts]
        return self.found

    def _last(self, members, seen):
        np = self.np
        names, k = np.unique(self.label[members], return_counts=True)
        main = names[np.argmax(k)] if len(names) else -1
        for i in np.flatnonzero(self.label[members] != main):
            x, n = members[i], self.n[members]
            may = (self.label[members] != self.label[x]) & (DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i]))
            may &= (np.abs(seen - seen[:, i : i + 1]) <= RADIUS + EPS).all(0)
            if may.any():
                self.meet(x, members[may])


def regions(np, d) -> list:
    """Which members (columns) go to each region, by their distances to the pivots (rows). Sets within RADIUS of each other
    share a region."""
    best = d.min(0, initial=1)
    return [*((row <= best + 2 * RADIUS + EPS) & (best < 1) for row in d), best >= 1 - RADIUS - EPS]


def _sets(b, column: int):
    """The shingle sets of a batch's texts."""
    import numpy as np

    data, offs = column_buffers(b.column(column))
    for x, y in slices(offs, SLICE):
        t, h = _shingler().sets(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
        yield from np.split(h, np.searchsorted(t, np.arange(1, y - x)))


LINK = "a long, b long, common long, total long"


def _link_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in rows], pa.int64()) for k in range(4)], ["a", "b", "common", "total"])


def join_regions(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (a, b, common, total) that connect the sets of each of the regions cells (cell, node), one region a task."""

    def run(batches):
        cell, nodes, sets = None, [], []

        def links():
            if len(nodes) > 1:
                return [(nodes[i], nodes[j], c, t) for i, j, c, t in Region(sets).links()]
            return []

        for b in batches:
            out = []
            for c, node, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _sets(b, 2)):
                if c != cell:
                    out += links()
                    cell, nodes, sets = c, [], []
                nodes.append(node)
                sets.append(h)
            yield _link_batch(out)
        yield _link_batch(links())
        give_back()

    rows = sized_join(texts.select("node", "data"), cells, ["node"], "inner", 40).select("cell", "node", "data")
    with arrow_rows(cells.sparkSession, 256):
        return materialize(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, LINK), "region-links")


def components(edges: DataFrame, one_task: int = 500_000) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b), comp the smallest node reached. Up to one_task edges (8 MB) are joined
    in one task; beyond, large-star and small-star by turns until nothing changes, each round spread over all."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.count() <= one_task:
        return e.coalesce(1).mapInArrow(_union_find, "node long, comp long")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = materialize(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _union_find(batches):
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = (top(z) if z in up else up.setdefault(z, z) for z in (x, y))
            up[max(p, q)] = min(p, q)
    nodes = sorted(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "comp"])


# Step 4


def _sized(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """cells (cell, node, n) with m and w, the region's sets and shingles."""
    if "n" not in cells.columns:
        cells = sized_join(texts.select("node", "n"), cells, ["node"], "inner", 40)
    size = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1")
    return materialize(cells.join(size.hint("merge"), "cell").select("cell", "node", "n", "m", "w"), "cells")


def meet_pivots(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, node, q, common, total, goes) of members of large regions and the pivots of these; goes: the member goes to
    the pivot's region (q null: to the region that is far from all pivots). Parts of a region meet the pivots in
    different tasks."""
    parts = F.greatest(F.lit(1), F.ceil(F.greatest(2 * F.col("w") / CELL_SHINGLES, 2 * F.col("m") / CELL_NODES))).cast("int")
    k = F.pmod(F.xxhash64("node", "cell"), F.lit(PIVOTS))
    pivots = cells.groupBy("cell", k.alias("k")).agg(F.min("node").alias("node"), F.max(parts).alias("parts"))
    pivots = pivots.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), "node")
    asked = cells.select("cell", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(True).alias("member"), "node").unionByName(pivots)
    asked = texts.select("node", "data").join(asked.hint("merge"), "node").select("cell", "part", "member", "node", "data")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, pivots, sets, index = None, [], [], None
        for b in batches:
            out = []
            for cell, part, member, node, h in zip(*(b.column(k).to_pylist() for k in range(4)), _sets(b, 4)):
                if (cell, part) != at:
                    at, pivots, sets, index = (cell, part), [], [], None
                if not member:
                    pivots.append(node)
                    sets.append(h)
                    continue
                if index is None:
                    sizes = np.array([len(x) for x in sets])
                    every, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(every, kind="stable")
                    index = every[order], who[order]
                lo, hi = (np.searchsorted(index[0], h, side) for side in ("left", "right"))
                m = hi - lo
                common = np.bincount(index[1][np.arange(m.sum()) + np.repeat(lo - (np.cumsum(m) - m), m)], minlength=len(pivots))
                total = len(h) + sizes - common
                own = node in pivots  # a pivot has met all
                goes = [bool(p[0]) and not own for p in regions(np, (1 - common / total)[:, None])]
                out += [(cell, node, q, c, t, g) for q, c, t, g in zip([*pivots, None], [*common.tolist(), 0], [*total.tolist(), 1], goes) if (g or DEN * c >= NUM * t) and q != node]
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["cell", "node", "q", "common", "total", "goes"])

    with arrow_rows(cells.sparkSession, 256):
        rows = asked.repartition("cell", "part").sortWithinPartitions("cell", "part", "member")
        return materialize(rows.mapInArrow(run, "cell long, node long, q long, common long, total long, goes boolean"), "met")


def split_regions(large: DataFrame, texts: DataFrame) -> DataFrame:
    """All links that connect the sets of large regions (cell, node, n, m, w)."""
    spark = texts.sparkSession
    links = spark.createDataFrame([], LINK)
    while not large.isEmpty():
        met = meet_pivots(large, texts)
        links = materialize(links.unionByName(met.filter((DEN * F.col("common") >= NUM * F.col("total")) & F.col("q").isNotNull()).select(F.col("node").alias("a"), F.col("q").alias("b"), "common", "total")), "links")
        comp = components(links.select("a", "b"))
        child = met.filter("goes").select("node", F.col("cell").alias("parent"), F.xxhash64("cell", "q").alias("cell"))
        child = sized_join(texts.select("node", "n"), child, ["node"], "inner", 40)
        size = child.groupBy("parent", "cell").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
        whole = large.groupBy("cell").agg(F.max("m").alias("pm"))
        fair = size.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work")).join(whole.withColumnRenamed("cell", "parent"), "parent", "right")
        fair = materialize(fair.select("parent", (F.coalesce("work", F.lit(0.0)) <= F.col("pm") * F.col("pm") / 2).alias("halves")), "halves")
        goes = child.join(fair.filter("halves").select("parent").hint("merge"), "parent", "left_semi").select("cell", "node", "n")
        stays = large.join(fair.filter("NOT halves").select(F.col("parent").alias("cell")).hint("merge"), "cell", "left_semi").select("cell", "node", "n")
        tagged = goes.withColumn("last", F.lit(False)).unionByName(stays.withColumn("last", F.lit(True)))
        tagged = tagged.join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        per = tagged.groupBy("cell", "last", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("kw")).groupBy("cell", "last")
        per = per.agg(F.sum("k").alias("m"), F.sum("kw").alias("w"), F.max(F.struct("k", "kw", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
        todo = materialize(tagged.join(per.hint("merge"), ["cell", "last"]), "regions")
        fits = (F.col("m") <= CELL_NODES) & (F.col("w") <= CELL_SHINGLES)
        ready = todo.filter(fits).select("cell", "node")
        # blocks: the sets outside the largest component meet all
        blocks = lambda m, w: F.greatest(F.lit(1), F.ceil(F.greatest(2 * w / CELL_SHINGLES, 2 * m / CELL_NODES))).cast("int")
        still = todo.filter(~fits & F.col("last")).withColumns({"nb": blocks(F.col("m"), F.col("w")), "no": blocks(F.col("m") - F.col("top.k"), F.col("w") - F.col("top.kw"))})
        i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("nb")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("no"))
        every = still.select("cell", "node", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("j"))
        out = still.filter(F.col("comp") != F.col("top.comp")).select("cell", "node", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), j.alias("j"))
        paired = every.unionByName(out).select(F.xxhash64("cell", "i", "j").alias("cell"), "node").distinct()
        links = materialize(links.unionByName(join_regions(ready.unionByName(paired), texts)), "links")
        large = materialize(todo.filter(~fits & ~F.col("last")).select("cell", "node", "n", "m", "w"), "large")
    return links


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (key, n_shingles, ref, node, component, component_id, k1, k2) of every row, and links (a, b, common, total)
    between nodes: those found, enough to connect all that any link connects."""
    docs = keyed(df, key, text)
    total = docs.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0
    with arrow_rows(df.sparkSession, 2_500):
        listed, path = written(survey(docs, max(12, total // (16 << 20))), "survey")
    rows = listed.filter("kind = 0").select("ref", "id", "k1", "k2", "n", "s1", "s2")
    rows = materialize(rows, "rows")
    # the first ref of equal sets is their node
    nodes = rows.filter("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("ref", "k1", "k2", F.xxhash64("id").alias("rid"), "n")).alias("x"), F.min("id").alias("least"))
    nodes = materialize(nodes.select("s1", "s2", F.col("x.ref").alias("node"), "x.k1", "x.k2", "x.rid", "x.n", "least"), "nodes")
    may = materialize(nodes.join(survivors(listed).withColumnRenamed("ref", "node").hint("merge"), "node", "left_semi").select("node", "k1", "k2", "rid", "n"), "candidates")
    discard(df.sparkSession, path)
    texts = sized_join(docs.withColumn("rid", F.xxhash64("id")), may, ["k1", "k2", "rid"], "inner", 64)
    texts = materialize(texts.groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("data")), "texts")
    with arrow_rows(df.sparkSession, 2_500):
        cells = neighbourhoods(texts, may.agg(F.sum("n")).first()[0] or 0).withColumnRenamed("comp", "cell")
    cells = _sized(cells, texts)
    fits = (F.col("m") <= CELL_NODES) & (F.col("w") <= CELL_SHINGLES)
    links = join_regions(cells.filter(fits).select("cell", "node"), texts)
    large = cells.filter(~fits)
    if not large.isEmpty():
        links = links.unionByName(split_regions(large, texts))
    comp = components(links.select("a", "b"))
    linked = materialize(comp.join(nodes.select("node", "least").hint("merge"), "node"), "linked")
    least = linked.groupBy("comp").agg(F.min("least").alias("all_least"))
    linked = linked.join(least.hint("merge"), "comp").select("node", "comp", "all_least")
    nodes = nodes.join(linked.hint("merge"), "node", "left")
    nodes = nodes.select("s1", "s2", "node", F.coalesce("comp", "node").alias("component"), F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("all_least")).alias("component_id"))
    full = rows.filter("n > 0").join(nodes.hint("merge"), ["s1", "s2"])
    out = [F.col("id").alias(key), F.col("n").alias("n_shingles"), "ref"]
    empty = rows.filter("n = 0").select(*out, F.col("ref").alias("node"), F.col("ref").alias("component"), F.col("id").alias("component_id"), "k1", "k2")
    return full.select(*out, "node", "component", "component_id", "k1", "k2").unionByName(empty), links


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest key, null last (of several texts under it, that with
    the smallest hashes); of repeated rows one. Rows with empty sets all stay. Columns keep their names and values, whatever they are called."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(key).alias("id"), *text_key(t), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    members, _ = join(docs, key, text)
    members = members.withColumnRenamed(key, "id")
    # key and text name a row up to repetition
    names = members.groupBy("id", "k1", "k2").agg(F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("component").alias("component"))
    names = materialize(names, "names")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "rows")
    one = names.filter("n > 0").groupBy("component").agg(F.min(first).alias("x")).select("x.id", "x.k1", "x.k2", (F.col("x.rows") > 1).alias("many"))
    kept = materialize(one.unionByName(names.filter("n = 0").select("id", "k1", "k2", F.lit(False).alias("many"))), "kept")

    def rows_of(kept: DataFrame) -> DataFrame:
        y = kept.select(F.col("id").alias("y"), F.col("k1").alias("y1"), F.col("k2").alias("y2"))
        y = F.broadcast(y) if small_enough(y, 48) else y.hint("merge")
        return whole.join(y, F.col("id").eqNullSafe(F.col("y")) & (F.col("k1") == F.col("y1")) & (F.col("k2") == F.col("y2")))

    out = rows_of(kept.filter("NOT many")).select("whole.*")
    many = kept.filter("many")
    if many.isEmpty():
        return out
    again = rows_of(many).groupBy("id", "k1", "k2").agg(F.first("whole").alias("whole"))
    return out.unionByName(again.select("whole.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return members.select("doc_id", "n_shingles", "component_id")
