"""Neighbourhoods don't grow together by passages that many sets hold, however large the corpus."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

from tidewright.llm import jaccard_join  # noqa: E402


def test_sets_list_their_rarest_shingles(spark):
    """Texts of 100 words of their own, 150 that four texts share and ten of twenty common passages, set apart by a word: listed by
    what a sample finds often, common passages tie all of them together."""
    r = random.Random(5)
    words = lambda name, n: [f"{name}x{k}" for k in range(n)]
    passages = [words(f"p{k}", 70) for k in range(20)]
    texts = []
    for i in range(120):
        parts = [words(f"own{i}", 100), words(f"four{i // 4}", 150), *r.sample(passages, 10)]
        texts.append((i, " ".join(w for k, p in enumerate(parts) for w in [f"cut{i}x{k}", *p])))
    df = spark.createDataFrame(texts, "node long, text string").select("node", F.lit(958).cast("long").alias("n"), F.col("text").cast("binary").alias("data"))
    rows = jaccard_join.neighbourhoods(df, 958 * 120).collect()
    sizes = {}
    for x in rows:
        sizes.setdefault(x["comp"], set()).add(x["node"])
    assert len(rows) == 120 and max(map(len, sizes.values())) == 4
    assert all(len({n // 4 for n in g}) == 1 for g in sizes.values())
