"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, seeded by its code point; anything else is one blank. An n-gram
binds its letters' vectors, each rotated by its place, by multiplying them; a text bundles its n-grams by adding
them up. A language's prototype bundles its training texts, each at length 1; documents go to the prototype of
largest cosine.

Defined cases: null texts and texts without a letter get 'und' and score 0; without any training row all do;
ties go to the language first in order; texts of any length are read whole; repeated rows are judged alike;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, once_a_worker, sized_join

DIM, GRAM, MOST_KEPT = 1024, 3, 40_000
UND = "und"


class Encoder:
    """Texts to bundled n-gram vectors."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        import numpy as np

        self.np, self.dim, self.gram = np, dim, gram
        self.alpha = np.zeros(0x110000, bool)
        self.alpha[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        self.letters: dict[int, object] = {}
        self.codes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.table = np.zeros((MOST_KEPT, dim), np.int8)
        self.used = 0

    def letter(self, c: int):
        if c not in self.letters:
            self.letters[c] = (self.np.random.default_rng(c).integers(0, 2, self.dim, self.np.int8) * 2 - 1).astype(self.np.int8)
        return self.letters[c]

    def bind(self, code: int):
        v = None
        for k in range(self.gram):
            x = self.np.roll(self.letter(code >> 21 * k & 0x1FFFFF), k)
            v = x if v is None else v * x
        return v

    def grams(self, text: str):
        """Distinct n-gram codes and their numbers; None if the text has no letter."""
        np = self.np
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(self.alpha[c], c, 0)
        c = np.concatenate([[0], c, [0]]).astype(np.uint64)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        if len(c) < self.gram:
            return None
        g = np.zeros(len(c) - self.gram + 1, np.uint64)
        for k in range(self.gram):
            g |= c[self.gram - 1 - k : len(c) - k] << np.uint64(21 * k)
        return np.unique(g, return_counts=True)

    def bundle(self, text: str | None):
        """The text's vector, or None if it has no letter."""
        np = self.np
        found = self.grams(text) if text else None
        if found is None:
            return None
        codes, n = found
        at = np.searchsorted(self.codes, codes)
        hit = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes) if len(self.codes) else np.zeros(len(codes), bool)
        out = n[hit].astype(np.float32) @ self.table[self.place[at[hit]]].astype(np.float32) if hit.any() else np.zeros(self.dim, np.float32)
        missing = codes[~hit]
        if len(missing):
            vectors = np.stack([self.bind(int(c)) for c in missing])
            out = out + n[~hit].astype(np.float32) @ vectors.astype(np.float32)
            room = min(len(missing), MOST_KEPT - self.used)
            if room:
                self.table[self.used : self.used + room] = vectors[:room]
                codes = np.concatenate([self.codes, missing[:room]])
                place = np.concatenate([self.place, np.arange(self.used, self.used + room)])
                order = np.argsort(codes)
                self.codes, self.place = codes[order], place[order]
                self.used += room
        return out


def _encoder() -> Encoder:
    return once_a_worker(("hyper", DIM, GRAM), Encoder)


def learn_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 1_500) -> dict[str, list[float]]:
    """Prototype by language, from a sample by hash of at most about most texts of each. The driver holds one vector a
    language, however many documents there are."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), "k").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    cut = sized_join(rows, counts, ["lang"], "inner", F.octet_length("lang") + 24).filter(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < F.lit(float(most)) / F.col("n") * 1_000_000)

    def run(batches):
        import numpy as np
        import pandas as pd

        sums: dict[str, object] = {}
        e = _encoder()
        for b in batches:
            for t, lang_ in zip(b["text"], b["lang"], strict=True):
                v = e.bundle(t)
                if v is not None:
                    sums[lang_] = sums.get(lang_, 0) + v.astype(np.float64) / (np.linalg.norm(v) or 1.0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [s.tolist() for s in sums.values()]})

    def total(pdf):
        import numpy as np
        import pandas as pd

        v = np.sum(np.stack([np.asarray(x) for x in pdf["v"]]), axis=0)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "v": [(v / (np.linalg.norm(v) or 1.0)).round(9).tolist()]})

    parts = cut.select("text", "lang").mapInPandas(run, "lang string, v array<double>")
    return {r["lang"]: r["v"] for r in parts.groupBy("lang").applyInPandas(total, "lang string, v array<double>").orderBy("lang").collect()}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    names = sorted(prototypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        e = _encoder()
        p = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), DIM)
        for b in batches:
            pred, score = [], []
            for t in b.column(1):
                v = e.bundle(t.as_py()) if names else None
                if v is None:
                    pred.append(UND)
                    score.append(0.0)
                    continue
                s = p @ v / (np.linalg.norm(v) or 1.0)
                k = int(np.argmax(s))
                pred.append(names[k])
                score.append(float(min(1.0, max(0.0, s[k]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    prototypes = learn_prototypes(docs.filter(fold(F.col("doc_id"), 3) != 1).withColumn("k", F.col("doc_id").cast("string")))
    return identify(docs, prototypes).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
