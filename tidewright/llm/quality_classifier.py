"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

cos(Wx + b) features approximate a Gaussian kernel over standardised statistics of the text. Training rows are
summed to normal equations partition by partition; the driver solves one small system. Scores of training rows
left out of the fit are calibrated by pool-adjacent-violators and read off by interpolation.

Defined cases: null texts count as empty, and empty texts have all statistics 0; whole texts are read, however
long; repeated rows score alike; without labels of both kinds the score is the share of label 1 (0.5 without
any label); further columns of the input stay out of the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize

NAMES = (
    "log_words", "mean_word", "distinct", "pairs", "log_lines", "line_words", "dup_lines", "upper", "digit", "signs", "shouts",
    "bars", "points", "wide", "blank", "longest", "top_word", "triples",
)
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SIGNS, POINTS, BLANK = b"#*$%&<>@^~=+_{}[]\\/", b".,;:?'\"()-", b" \t\n\x0b\x0c\r"


def statistics(text: str | None) -> list[float]:
    """The statistics named in NAMES; ratios are to bytes or words."""
    if not text:
        return [0.0] * len(NAMES)
    data, words = text.encode(), text.split()
    n, size = len(words), len(data)
    most = n or 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = lambda chars: (size - len(data.translate(None, chars))) / size
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    after = words[1:]
    return [
        math.log1p(n), min(size / most, 40.0), len(counts) / most, len(set(zip(words, after))) / most, math.log1p(len(lines)), math.log1p(n / (len(lines) or 1)),
        1 - len(set(lines)) / (len(lines) or 1), share(UPPER), share(DIGITS), share(SIGNS), share(b"!"), share(b"|"), share(POINTS), (size - len(text)) / size, share(BLANK),
        math.log1p(max(map(len, words), default=0)), max(counts.values(), default=0) / most, len(set(zip(words, after, words[2:]))) / most,
    ]


@dataclass
class QualityModel:
    """mean and scale of the statistics, the random features' seed and number, ridge weights, calibration steps."""

    mean: list[float]
    scale: list[float]
    dim: int
    seed: int
    weights: list[float]
    xs: list[float]
    ys: list[float]

    def projection(self):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        return rng.normal(0, 1 / math.sqrt(d), (d, self.dim)), rng.uniform(0, 2 * math.pi, self.dim)

    def features(self, stats, projection):
        """Random Fourier features with a constant, one row a document."""
        import numpy as np

        w, b = projection
        x = np.clip((np.asarray(stats, float).reshape(-1, len(self.mean)) - self.mean) / self.scale, -6, 6)
        return np.hstack([math.sqrt(2 / self.dim) * np.cos(x @ w + b), np.ones((len(x), 1))])

    def calibrated(self, raw):
        import numpy as np

        return np.clip(np.interp(raw, self.xs, self.ys), 0.0, 1.0)


def isotonic(x: list[float], y: list[float]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators: block centres and smoothed block means, not falling."""
    rows = sorted(zip(x, y))
    blocks: list[list[float]] = []  # sum of x, sum of y, number
    for a, b in rows:
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], s)]
    xs = [b[0] / b[2] for b in blocks]
    ys = [(b[1] + 0.5) / (b[2] + 1) for b in blocks]
    for i in range(1, len(ys)):
        ys[i] = max(ys[i], ys[i - 1])
    low, high = rows[0][0] - 0.5, rows[-1][0] + 0.5  # beyond the seen range the score still rises a little
    return [low, *xs, high], [ys[0] * 0.9, *ys, 1 - (1 - ys[-1]) * 0.9]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000, dim: int = 256, ridge: float = 1e-3, seed: int = 17) -> QualityModel:
    """A model from a sample by hash of at most about most labelled rows."""
    import numpy as np

    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    n = known.agg(F.count("*").alias("n"), F.avg("y").alias("m")).first()
    d = len(NAMES)
    if not n["n"] or n["m"] in (0.0, 1.0):
        share = 0.5 if not n["n"] else n["m"]
        return QualityModel([0.0] * d, [1.0] * d, 1, seed, [0.0, 0.0], [0.0], [share])
    sample = known.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < min(1.0, most / n["n"]) * 1_000_000)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k").repartition("k")

    def stats(batches):
        import pyarrow as pa

        for b in batches:
            s = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(s[:, i]) for i in range(d)]], ["k", "y", *NAMES])

    table = materialize(rows.select("k", "t", "y").mapInArrow(stats, f"k {rows.schema['k'].dataType.simpleString()}, y int, " + ", ".join(f"{c} double" for c in NAMES)), "statistics")
    m = table.agg(F.count("*").alias("n"), *[F.avg(c).alias("m_" + c) for c in NAMES], *[F.stddev_pop(c).alias("s_" + c) for c in NAMES]).first()
    if not m["n"]:  # labels, but none of a document that is there
        return QualityModel([0.0] * d, [1.0] * d, 1, seed, [0.0, 0.0], [0.0], [float(n["m"])])
    model = QualityModel([m["m_" + c] for c in NAMES], [max(m["s_" + c], 1e-6) for c in NAMES], dim, seed, [], [], [])
    held = F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(4)) == 3

    def sums(batches):
        """A partition's part of the normal equations, as one row."""
        import pyarrow as pa

        a, c, n, projection = np.zeros((dim + 1, dim + 1)), np.zeros(dim + 1), 0, model.projection()
        for b in batches:
            f = model.features(np.column_stack([b.column(i + 1).to_numpy() for i in range(d)]), projection)
            a, c, n = a + f.T @ f, c + f.T @ b.column(0).to_numpy(), n + len(f)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], ["n", "a", "c"])

    parts = table.filter(~held).select("y", *NAMES).mapInArrow(sums, "n long, a binary, c binary").collect()
    model.weights = _ridge([(np.frombuffer(r["a"]).reshape(dim + 1, -1), np.frombuffer(r["c"]), r["n"]) for r in parts], ridge)

    def raw(batches):
        import pyarrow as pa

        projection, w = model.projection(), np.array(model.weights)
        for b in batches:
            f = model.features(np.column_stack([b.column(i + 1).to_numpy() for i in range(d)]), projection)
            yield pa.RecordBatch.from_arrays([pa.array((f @ w).round(9)), b.column(0)], ["x", "y"])

    pairs = [(r["x"], float(r["y"])) for r in table.filter(held).select("y", *NAMES).mapInArrow(raw, "x double, y int").collect()]
    if len({y for _, y in pairs}) < 2:
        pairs = [(r["x"], float(r["y"])) for r in table.select("y", *NAMES).mapInArrow(raw, "x double, y int").collect()]
    model.xs, model.ys = isotonic([x for x, _ in pairs], [y for _, y in pairs])
    return model


def _ridge(parts, ridge: float) -> list[float]:
    import numpy as np

    a, b, n = sum(x for x, _, _ in parts), sum(x for _, x, _ in parts), sum(x for *_, x in parts)
    penalty = np.full(len(b), ridge * n)
    penalty[-1] = 0.0
    return np.linalg.solve(a + np.diag(penalty) + 1e-9 * np.eye(len(b)), b).tolist()


def score_texts(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        projection, w = model.projection(), np.array(model.weights)
        for b in batches:
            scores = [np.zeros(0)]
            for at in range(0, b.num_rows, 1024):
                s = [statistics(t.as_py()) for t in b.column(1)[at : at + 1024]]
                scores.append(model.calibrated(model.features(s, projection) @ w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores), pa.float64())], ["key", "score"])

    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    return score_texts(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
