"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Automata of blocks of items are built on the driver, at most PASS_WORDS words of items at a time; that is what is
broadcast. More items go in further passes over the documents, whose matches (no texts) are added up. Documents stream through an
automaton word by word, tracking the longest match. Where ten words or more match, the last
ten are a window of an item; items of fewer words are one window. A run of words that no item has, or that is
shorter than the shortest window, can hold no match and resets the automaton.

Defined cases: null and empty texts and items have no words; repeated items count once, by item_id (a null
item_id is the empty string); documents of any length stream in time linear in their words; repeated rows are
judged alike; further columns come back unchanged from decontaminate(), and are not read by find_matches().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import give_back, materialize

WINDOW = 10
#: Words of items in an automaton, and in all automata of one pass (about a kilobyte a word on the driver and in each worker).
BLOCK_WORDS, PASS_WORDS = 100_000, 200_000


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        out[b] = b
    for b in range(65, 91):
        out[b] = b + 32
    return bytes(out)


TABLE = _table()


def words_of(data: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return data.translate(TABLE).split()


class SuffixAutomaton:
    """All word runs of a set of items, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.n_words = sum(len(words) for _, words in items)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                coded.append((name, ids))
                self._add(ids)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        self.items: dict[int, set[str]] = {}  # by the state of a full window
        self.short: dict[int, dict[int, set[str]]] = {}  # by state and length, items below the window
        for name, ids in coded:
            for state, length in self._walk(ids):
                if length >= window:
                    self.items.setdefault(self._at(state, window), set()).add(name)
            if len(ids) < window:
                self.short.setdefault(self._at(state, len(ids)), {}).setdefault(len(ids), set()).add(name)
        self._full: dict[int, int] = {}

    def _add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def _walk(self, ids) -> Iterator[tuple[int, int]]:
        """State and longest match after each word; None is a word of no item."""
        nxt, link, length = self.next, self.link, self.len
        v = l = 0
        for c in ids:
            while v and (c is None or c not in nxt[v]):
                v = link[v]
                l = length[v]
            if c is not None and c in nxt[v]:
                v, l = nxt[v][c], l + 1
            else:
                v = l = 0
            yield v, l

    def _at(self, state: int, n: int) -> int:
        """The state of the last n words of a state that has at least n."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of word places (sorted, disjoint), and the items with windows there."""
        get, n = self.vocabulary.get, len(words)
        ids = list(map(get, words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        least, at = self.shortest, 0
        if not self.vocabulary:
            return spans, found
        while at < n:
            if ids[at] is None:
                at += 1
                continue
            try:
                end = ids.index(None, at)
            except ValueError:
                end = n
            if end - at >= least:
                for place, (v, l) in enumerate(self._walk(ids[at:end]), at):
                    if l >= least:
                        self._hits(v, l, place, spans, found)
            at = end + 1
        return spans, found

    def _hits(self, v: int, l: int, place: int, spans: list, found: set) -> None:
        longest = 0
        if l >= self.window:
            u = self._full.get(v)
            if u is None:
                u = self._full[v] = self._at(v, self.window)
            found |= self.items[u]
            longest = self.window
        if self.short:
            u = v
            while u > 0:
                for n, names in self.short.get(u, {}).items():
                    if n <= l:
                        found |= names
                        longest = max(longest, n)
                u = self.link[u]
        if longest:
            a = place - longest + 1
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, place + 1))


def automata(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over blocks of at most block_words words (or one item), built one at a time."""
    block, n = [], 0
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        words = words_of(bytes(r["t"])) if r["t"] is not None else []
        if block and n + len(words) > block_words:
            yield SuffixAutomaton(block, window)
            block, n = [], 0
        block.append((r["k"], words))
        n += len(words)
    yield SuffixAutomaton(block, window)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def passes(items: DataFrame, window: int = WINDOW, most: int | None = None) -> Iterator[list[SuffixAutomaton]]:
    """The automata, as many at a time as have up to most words (or one item)."""
    group, n, most = [], 0, most or PASS_WORDS
    for a in automata(items, window=window, block_words=min(BLOCK_WORDS, most)):
        if group and n + a.n_words > most:
            yield group
            group, n = [], 0
        group.append(a)
        n += a.n_words
    yield group


def _revived(state: dict) -> SuffixAutomaton:
    """An automaton from its attributes: those are broadcast, so that workers need no copy of the class."""
    a = SuffixAutomaton.__new__(SuffixAutomaton)
    a.__dict__.update(state)
    return a


def _matcher(states: list[dict]):
    models = list(map(_revived, states))

    def match(data: bytes):
        words = words_of(data)
        spans, found = [], set()
        for m in models:
            s, f = m.match(words)
            spans += s
            found |= f
        return words, _union(spans) if len(models) > 1 else spans, found

    return match


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _add_matches(rows: DataFrame, items: DataFrame, text: str, window: int) -> DataFrame:
    """rows with __n (words), __spans (word ranges) and __items. One group of automata is one pass. With more, rows are
    written down once, under a number; each pass writes number, spans and items of the rows it hits, no text, and these are
    joined to the rows in the end."""
    groups = passes(items, window)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _one_pass(rows, first, text)
    found = [StructField("__spans", SPANS), StructField("__items", ArrayType(StringType()))]
    numbered = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    hits = None
    for group in (g for part in ([first, second], groups) for g in part):
        p = _one_pass(numbered.select("__row", F.col(f"`{text}`").alias("data")), group, "data").filter(F.size("__spans") > 0)
        p = materialize(p.select("__row", *[f.name for f in found]), "hits")
        hits = p if hits is None else hits.unionByName(p)
    parts = hits.groupBy("__row").agg(F.flatten(F.collect_list("__spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    joined = _one_pass(numbered, [], text).drop("__spans", "__items").join(parts, "__row", "left").drop("__row")
    nothing = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in found}
    return joined.withColumns(nothing).withColumn("__spans", _united("__spans"))


def _united(spans: str):
    """Ranges in order, overlapping ones and neighbours as one."""
    start = F.array().cast(SPANS)

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        apart = (F.size(done) == 0) | (x["start"] > last["end"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

    return F.when(F.size(spans) < 2, F.col(spans)).otherwise(F.aggregate(F.array_sort(spans), start, add))


def _one_pass(rows: DataFrame, group: list[SuffixAutomaton], text: str) -> DataFrame:
    """rows with __n, __spans and __items by a group of automata, which is broadcast (bounded by PASS_WORDS)."""
    schema = StructType([*rows.schema.fields, StructField("__n", LongType()), StructField("__spans", SPANS), StructField("__items", ArrayType(StringType()))])
    at = rows.columns.index(text)
    shared = rows.sparkSession.sparkContext.broadcast([a.__dict__ for a in group])

    def run(batches):
        import pyarrow as pa

        match, kind_of_spans = _matcher(shared.value), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, all_spans, all_items = [], [], []
            for value in b.column(at):
                t = value.as_py() or b""
                words, spans, found = match(t if isinstance(t, bytes) else t.encode())
                n.append(len(words))
                all_spans.append([{"start": x, "end": y} for x, y in spans])
                all_items.append(sorted(found))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(all_spans, kind_of_spans), pa.array(all_items, pa.list_(pa.string()))], [*b.schema.names, "__n", "__spans", "__items"])
        give_back()

    return rows.mapInArrow(run, schema)


def find_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, spans (word ranges) and items (sorted ids) of every row of docs."""
    rows = _add_matches(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data")), items, "data", window)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select(F.col("key").alias(key), F.col("__n").alias("n_words"), hit.alias("n_hit"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    data = text.encode()
    places, parts, last = [m.span() for m in _WORD.finditer(data)], [], 0
    for x, y in spans:
        parts.append(data[last : places[x][0]])
        last = places[y - 1][1]
    return b"".join([*parts, data[last:]]).decode()


def _rewrite(b, at: int, schema, edit):
    """The batch with edit(k, text) in place of its texts; rows for which that is DROP go."""
    import pyarrow as pa

    texts = [edit(k, v.as_py()) for k, v in enumerate(b.column(at))]
    keep = pa.array([k for k, t in enumerate(texts) if t is not DROP], pa.int64())
    columns = [c.take(keep) for c in b.columns[: len(schema)]]
    columns[at] = pa.array([t for t in texts if t is not DROP], b.column(at).type)
    return pa.RecordBatch.from_arrays(columns, schema.names)


DROP = object()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, most: float = 0.5) -> DataFrame:
    """docs with the hit spans cut out of text, until no window is left (a cut may bring the ends of one together); rows of
    which more than the share most is hit at first are dropped whole, and so are those that hold no word any more. Rows
    without hits stay as they are."""
    schema, at, width = docs.schema, docs.columns.index(text), len(docs.columns)
    groups = passes(items, window)
    first, more = next(groups), next(groups, None)
    if more is None:  # all automata fit: a task cuts until a text is clean
        shared = docs.sparkSession.sparkContext.broadcast([a.__dict__ for a in first])

        def clean(batches):
            match = _matcher(shared.value)

            def edit(k, t):
                words, spans, _ = match(t.encode()) if t else ([], [], None)
                if sum(y - x for x, y in spans) > most * len(words):
                    return DROP
                was = bool(spans)
                while spans:
                    t = _cut(t, spans)
                    words, spans, _ = match(t.encode())
                return DROP if was and not words else t

            for b in batches:
                yield _rewrite(b, at, schema, edit)
            give_back()

        return docs.mapInArrow(clean, schema)

    def cut(most: float):
        def run(batches):
            for b in batches:
                n, ranges = b.column(width).to_pylist(), b.column(width + 1).to_pylist()

                def edit(k, t, n=n, ranges=ranges):
                    spans = [(x["start"], x["end"]) for x in ranges[k]]
                    hit = sum(y - x for x, y in spans)
                    return DROP if hit > most * n[k] or hit == n[k] else _cut(t, spans)

                yield _rewrite(b, at, schema, edit)
            give_back()

        return run

    found = materialize(_add_matches(docs, items, text, window), "matches")
    untouched = lambda d: d.filter(F.size("__spans") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
    out, hits, share = untouched(found), found.filter(F.size("__spans") > 0), most
    while not hits.isEmpty():
        again = materialize(_add_matches(hits.mapInArrow(cut(share), schema), items, text, window), "matches")
        out, hits, share = out.unionByName(untouched(again)), again.filter(F.size("__spans") > 0), 1.0
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL_OP6 = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT item, least(10, len(ws)) AS n, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM i WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(ws[k:k+n-1], ' ') AS w FROM g
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), n AS (
  SELECT DISTINCT n FROM win
), p AS (
  SELECT rid, n.n, unnest(range(1, len(ws) - n.n + 2)) AS k, unnest(list_transform(range(1, len(ws) - n.n + 2), lambda k: array_to_string(ws[k:k+n.n-1], ' '))) AS w FROM d, n WHERE len(ws) >= n.n
), hit AS (
  SELECT p.rid, p.k, p.n, win.item FROM p JOIN win ON p.n = win.n AND p.w = win.w
), places AS (
  SELECT rid, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS place FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN its USING (rid)
"""
