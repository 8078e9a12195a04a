"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width letters to plain ones, drops
invisible characters, and reads digits and signs inside words as the letters they stand for. Lexicon entries
are whole words or word beginnings with weights learned from labels; a match inside an exception phrase, two words
that occur with an entry in clean rows far more often than in toxic ones, does not count. The weighted sum, as such and per 100 words, goes through a logistic curve.

Defined cases: null and empty texts have no match and get the curve's value for none; texts of any length
are matched whole; repeated rows score alike; without labels of both kinds the lexicon is empty and the
score is the share of label 1 (0 without any); further columns of the input stay out of the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, give_back, materialize

#: Letters of other scripts that look like plain ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: What digits and signs stand for inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"
SHORTEST, LONGEST = 4, 8


def folder():
    """The folding function."""
    import re

    table = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    letter = r"[^\W\d_]"
    inside = re.compile(rf"[013457@$!]+(?={letter})|(?<={letter})[013457]+(?!\w)")
    signs = str.maketrans(SUBSTITUTES)

    def fold_text(text: str) -> str:
        text = text.lower()
        if not text.isascii():
            text = text.translate(table)
        return inside.sub(lambda m: m[0].translate(signs), text)

    return fold_text


def _terms(text: str, words) -> set[str]:
    """'=word' for each word and '^beginning' for its beginnings."""
    out = set()
    for w in set(words(text)):
        out.add("=" + w)
        out.update("^" + w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


@dataclass
class ToxicityModel:
    """weights by entry, curve (bias, slope of log sum, slope of log density), exceptions."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = ()

    def matcher(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for term, w in self.weights.items():
            entries.setdefault(term[1:], []).append((term[0], w))
        for p in self.exceptions:
            entries.setdefault(p, []).append(("x", 0.0))
        for key, what in entries.items():
            a.add_word(key, (len(key), what))
        if entries:
            a.make_automaton()
        fold_text = folder()

        def places(t: str) -> dict[int, float]:
            """Weight by place of the matches in folded text."""
            n, hits, safe = len(t), {}, []
            for end, (size, what) in a.iter(t) if entries else ():
                at = end - size + 1
                if at and t[at - 1].isalpha():
                    continue
                whole = end + 1 >= n or not t[end + 1].isalpha()
                for kind, w in what:
                    if kind == "x":
                        if whole:
                            safe.append((at, end))
                    elif kind == "^" or whole:
                        hits[at] = max(hits.get(at, 0.0), w)  # a word counts once, by its weightiest entry
            if safe:
                hits = {at: w for at, w in hits.items() if not any(x <= at <= y for x, y in safe)}
            return hits

        def match(text: str | None) -> tuple[float, int]:
            """Weighted matches and number of words."""
            if not text or not entries:
                return 0.0, len((text or "").split())
            t = fold_text(text)
            return math.fsum(places(t).values()), len(t.split())

        match.places, match.fold = places, fold_text
        return match

    def score(self, total: float, n_words: int) -> float:
        x, y = features(total, n_words)
        z = self.curve[0] + self.curve[1] * x + self.curve[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(total: float, n_words: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(100 * total / max(n_words, 20))


def _count_by_label(texts: DataFrame, name: str, found) -> DataFrame:
    """(name, a, b): in how many texts of label 1 and of label 0 found() has it. found: made once a task, text to a set."""

    def run(batches):
        from collections import Counter

        import pandas as pd

        of, n = found(), (Counter(), Counter())
        table = lambda: pd.DataFrame({name: [*n[1], *n[0]], "a": [*n[1].values(), *[0] * len(n[0])], "b": [*[0] * len(n[1]), *n[0].values()]})
        for b in batches:
            for t, y in zip(b["text"], b["y"], strict=True):
                if isinstance(t, str):
                    n[y].update(of(t))
            if len(n[0]) + len(n[1]) > 200_000:
                yield table()
                n[0].clear()
                n[1].clear()
        if n[0] or n[1]:
            yield table()
        n[0].clear()
        n[1].clear()
        give_back()

    return texts.select("text", "y").mapInPandas(run, f"{name} string, a long, b long").groupBy(name).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _term_finder():
    import re

    fold_text, words = folder(), re.compile(r"[^\W\d_]+").findall
    return lambda t: _terms(fold_text(t), words)


def _phrase_finder(model: ToxicityModel):
    """Pairs of words, one blank apart, of which one begins a match."""

    def make():
        import re

        match, word = model.matcher(), re.compile(r"[^\W\d_]+")

        def phrases(text: str) -> set[str]:
            t = match.fold(text)
            hits = match.places(t)
            if not hits:
                return set()
            w = [(m.start(), m.end(), m[0]) for m in word.finditer(t)]
            return {f"{x[2]} {y[2]}" for x, y in zip(w, w[1:]) if t[x[1] : y[0]] == " " and (x[0] in hits or y[0] in hits)}

        return phrases

    return make


def _logistic(rows: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    import numpy as np

    x = np.array([[1.0, a, b] for a, b, _ in rows])
    y = np.array([c for *_, c in rows])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.02, 0.02])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1e-6, 0.02, 0.02]) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", most: tuple[int, int] = (6_000, 12_000), least: int = 3, ratio: float = 4.0) -> ToxicityModel:
    """A model from a sample by hash of at most about most[0] rows of label 1 and most[1] of label 0. Entries are all
    terms of at least least toxic texts, ratio times as frequent there as in clean ones, whose counts could hardly come
    about by chance; exceptions are all phrases with an entry for which the same holds the other way round."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        share = n.get(1, 0) / max(sum(n.values()), 1)
        return ToxicityModel(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    cut = F.when(F.col("y") == 1, min(1.0, most[0] / n[1])).otherwise(min(1.0, most[1] / n[0])) * 1_000_000
    sample = known.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < cut)
    texts = docs.select(F.col(key).alias("k"), "text").join(F.broadcast(sample), "k").select("text", "y")
    texts = materialize(texts.repartition(F.xxhash64("text")), "labelled")
    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    nt, nn = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nn:  # labels of texts that aren't there: their share is all that is known
        return ToxicityModel(curve=(math.log(n[1] / n[0]), 0.0, 0.0))
    terms = materialize(_count_by_label(texts, "term", _term_finder).filter(F.col("a") >= least), "terms")
    chance = math.log(terms.count() + 2) + 2
    good = terms.filter(_stands_out("a", nt, "b", nn, ratio, chance)).orderBy("term").collect()
    model = ToxicityModel(_choose([(r["term"], r["a"], r["b"]) for r in good], nt, nn))
    phrases = _count_by_label(texts, "phrase", _phrase_finder(model)).filter(F.col("b") >= least)
    model.exceptions = tuple(r["phrase"] for r in phrases.filter(_stands_out("b", nn, "a", nt, ratio, chance)).orderBy("phrase").collect())

    def run(batches):
        import pandas as pd

        match = model.matcher()
        for b in batches:
            f = [features(*match(t if isinstance(t, str) else None)) for t in b["text"]]
            yield pd.DataFrame({"a": [x for x, _ in f], "b": [x for _, x in f], "y": b["y"].astype(float)})

    model.curve = _logistic(sorted((r["a"], r["b"], r["y"]) for r in texts.mapInPandas(run, "a double, b double, y double").collect()))
    return model


def _stands_out(a: str, na: int, b: str, nb: int, ratio: float, chance: float) -> Column:
    """Whether a of na texts against b of nb is ratio times as frequent, and more surprising than chance."""
    x, y, base = F.col(a), F.col(b), na / (na + nb)
    surprise = x * F.log(x / ((x + y) * base)) + F.when(y > 0, y * F.log(y / ((x + y) * (1 - base)))).otherwise(0.0)
    return (x / na >= ratio * (y + 0.5) / nb) & (surprise > chance)


def _choose(good: list[tuple[str, int, int]], nt: int, nn: int) -> dict[str, float]:
    """Weights by term of (term, toxic texts, clean texts), without terms that a shorter beginning covers as well."""
    chosen: dict[str, float] = {}
    for term, a, b in sorted(good, key=lambda x: (x[0][0] == "=", len(x[0]), x[0])):
        w = min(6.0, math.log((a + 0.5) / (nt + 1)) - math.log((b + 0.5) / (nn + 1)))
        covered = [chosen[p] for k in range(SHORTEST, len(term)) if (p := "^" + term[1 : k + 1]) in chosen]
        if not covered or w > max(covered) + 0.7:
            chosen[term] = w
    return chosen


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score under name; all other columns come back."""
    rows = docs.drop(name)
    at = rows.columns.index(text)

    def run(batches):
        import pyarrow as pa

        match = model.matcher()
        for b in batches:
            scores = [model.score(*match(t.as_py())) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])
        give_back()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def train_split(key: str = "doc_id") -> Column:
    return fold(F.col(key), 5) != 0


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more; all columns stay as they are, one named score too."""
    model = learn(docs, labels.filter(train_split()))
    return score_texts(docs, model, name="__toxicity").filter(F.col("__toxicity") < threshold).drop("__toxicity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(train_split()))
    return score_texts(docs, model).select("doc_id", (~train_split()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
