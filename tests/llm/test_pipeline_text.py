"""The pipeline's stages by their texts, each against a naive one on a small table; tables that are empty while others aren't."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewright.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from test_llm import brute_components, shingles  # noqa: E402

from tidewright.llm import toxicity  # noqa: E402
from tidewright.llm.common import materialize  # noqa: E402
from tidewright.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage has made of them."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in pipeline.STAGES:
        out[name] = docs = materialize(stage(spark, docs, SMALL), name)
    return {k: {r["doc_id"]: r.asDict() for r in d.collect()} for k, d in out.items()}


def texts(rows):
    return {k: r["text"] for k, r in rows.items()}


def test_toxic_documents_go_and_no_others(spark, stages):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    kept = toxicity.reject_toxic(docs, labels)
    assert texts(stages["toxicity"]) == {r["doc_id"]: r["text"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()} & set(stages["documents"])
    clean = set(stages["documents"]) - toxic
    assert len(clean - set(stages["toxicity"])) <= 0.02 * len(clean)  # few labels here; test_held_out_accuracy has more
    assert all(stages["documents"][k]["text"] == t for k, t in texts(stages["toxicity"]).items())


def test_one_document_of_each_group_stays(stages):
    rows = [{"doc_id": k, "text": t} for k, t in texts(stages["toxicity"]).items()]
    groups = defaultdict(list)
    for (key, n, component), _ in brute_components(rows).items():
        groups[component if n else ("none", key)].append(key)
    want = {min(g): stages["toxicity"][min(g)]["text"] for g in groups.values()}
    assert texts(stages["ngram_jaccard_join"]) == want and any(len(g) > 1 for g in groups.values()) and shingles("a b c d e")


def test_repeated_strings_are_cut(stages):
    rows = texts(stages["ngram_jaccard_join"])
    data = {k: (t or "").encode() for k, t in rows.items()}
    seen = defaultdict(int)
    for d in data.values():
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] += 1
    want = {}
    for k, d in data.items():
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        left = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any():
            want[k] = rows[k]
        elif left.strip():
            want[k] = left
    assert texts(stages["suffix_array_dedup"]) == want and want != rows


def hit_words(words, windows):
    hit = [False] * len(words)
    for i in range(len(words)):
        for n in {len(w) for w in windows}:
            if tuple(words[i : i + n]) in windows and i + n <= len(words):
                hit[i : i + n] = [True] * n
    return hit


def test_benchmark_passages_are_cut(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cased = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = word.findall((r["text"] or "").translate(LOWER))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want, cuts = {}, 0
    for k, t in texts(stages["suffix_array_dedup"]).items():
        hit, first = hit_words(word.findall((t or "").translate(LOWER)), windows), True
        while any(hit):
            if first and sum(hit) > 0.5 * len(hit):
                t = None
                break
            first, places, parts, last, i = False, [m.span() for m in cased.finditer(t)], [], 0, 0
            while i < len(hit):
                if hit[i]:
                    j = i
                    while j < len(hit) and hit[j]:
                        j += 1
                    parts.append(t[last : places[i][0]])
                    last, i, cuts = places[j - 1][1], j, cuts + 1
                else:
                    i += 1
            t = "".join([*parts, t[last:]])
            words = word.findall(t.translate(LOWER))
            if not words:
                t = None
                break
            hit = hit_words(words, windows)
        if t is not None or stages["suffix_array_dedup"][k]["text"] is None:
            want[k] = t
    assert texts(stages["benchmark_decontamination"]) == want and cuts > 0


def test_the_mix_takes_what_targets_say(stages):
    before, after = stages["benchmark_decontamination"], stages["mixing"]
    assert all(before[k]["text"] == r["text"] for k, r in after.items())
    size = {k: len((r["text"] or "").encode().split()) for k, r in before.items()}
    sources = sorted({r["source"] for r in before.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, r in before.items() if r["source"] == s) for s in sources}
    weight, target, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, {}, 1.5 * sum(size.values())
    while True:
        open_ = [s for s in sources if s not in target]
        share = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if share * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left = 1.5 * sum(size.values()) - sum(target.values())
    target |= {s: share * weight[s] for s in sources if s not in target}
    for s in sources:
        got = sum(r["taken"] for r in after.values() if r["source"] == s)
        assert abs(got - target[s]) <= max(size.values()), (s, got, target[s])
    assert all(0 < r["taken"] <= 2 * r["size"] and r["size"] == size[k] and r["target"] == pytest.approx(target[r["source"]]) for k, r in after.items())


# tables that are empty while others aren't


@pytest.fixture(scope="module")
def lacking(spark, tmp_path_factory):
    """A function: a folder where one table of the small ones is empty, or labels are of documents that aren't there."""

    def make(table):
        d = str(tmp_path_factory.mktemp(f"lacking-{table}"))
        for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
            df = spark.read.parquet(f"{SMALL}/{t}.parquet")
            if t == "labels" and table == "labelled":
                df = df.withColumn("doc_id", F.col("doc_id") + 10_000_000)
            (df.limit(0) if t == table else df).write.parquet(f"{d}/{t}.parquet")
        return d

    return make


@pytest.mark.parametrize("table", ["documents", "labels", "labelled", "benchmark"])
def test_a_table_without_rows(spark, lacking, table):
    d = lacking(table)
    n = 0 if table == "documents" else spark.read.parquet(f"{d}/documents.parquet").count()
    names = {"documents": [q for q in QUERIES if q not in ("op1_warc", "op11_hard_negatives")], "labels": ["op4_quality_classifier", "op9_toxicity"], "labelled": ["op4_quality_classifier", "op9_toxicity"], "benchmark": ["op6_decontamination"]}[table]
    for name in names:
        assert QUERIES[name](spark, d).count() == n, name
    if table in ("labels", "labelled"):
        assert QUERIES["op4_quality_classifier"](spark, d).filter("score BETWEEN 0 AND 1").count() == n
    last = pipeline.run(spark, d)
    assert last.count() == 0 if table == "documents" else last.count() > 0
