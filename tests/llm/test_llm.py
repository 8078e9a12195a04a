"""The ten operators and the pipeline: against brute force, a library or SQL, and on odd rows."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewright.llm")
import oracle  # noqa: E402
from tidewright.llm import decontamination, jaccard_join, language_id, mixing, quality_classifier, quality_rules, suffix_dedup, token_counts, toxicity, warc  # noqa: E402
from tidewright.llm.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, hash string, key int, row int, node long"


def _words(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, and columns with names that operators use."""
    d = str(tmp_path_factory.mktemp("odd"))
    base = _words(120, 1)
    near = [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(3, 117, 3)]
    passage = " ".join(_words(60, 2))
    texts = [None, "", " \n\t ", "one two", "One  TWO", "a b c d e", " ".join(base), " ".join(base), *map(" ".join, near)]
    texts += [" ".join(_words(30, 10 + k)) + " " + passage + "\n" + " ".join(_words(30, 90 + k)) for k in range(25)]
    texts += [" ".join(_words(60_000, 5, 5_000)), "x" * 5_000, "日本語 テキスト <|endoftext|> é" * 3, "idiot " * 30]
    rows = [(k, t, ["en", "de", None][k % 3], ["b", "a", None, "b"][k % 4], 0, 0.5, 1, "h", 1, 1, 7) for k, t in enumerate(texts)]
    rows += [(3, "one two", "en", "a", 7, 0.5, 1, "h", 1, 1, 7), (3, "one two", "en", "a", 7, 0.5, 1, "h", 1, 1, 7), (None, texts[8], None, None, None, None, None, None, None, None, None), (8, "same id, other text " * 9, "en", "b", 1, 0.1, 2, "z", 2, 2, 2)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(1, " ".join(base[20:45])), (2, "one two"), (2, "one two"), (10, None), (None, passage), (11, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(k, int(k % 3 > 0), int(k % 5 == 0)) for k in range(60)] + [(None, 1, 1), (4, None, None), (4, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://a/ b", "x", 1), (2, None, "x", 1), (2, None, "x", 2), (3, "http://é", None, 1), (None, "http://q", "", 1), (7, "u", "y\r\n\r\nWARC/1.0\r\n", 1), (8, "v", "z" * 3_000_000, 1), (9, "v2", "z" * 3_000_000, 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string, digest int").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (2, [1.0, 2.1], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def rows(spark, d, table="documents"):
    return spark.read.parquet(f"{d}/{table}.parquet").collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty(spark, odd, empty, name):
    table = {"op1_warc": "pages", "op11_hard_negatives": "benchmark"}.get(name, "documents")
    if name == "op11_hard_negatives":  # pairs, see test_search_and_coding.py
        assert QUERIES[name](spark, empty).count() == 0
        return
    assert QUERIES[name](spark, odd).count() == len(rows(spark, odd, table))
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    assert oracle.differences(got, oracle.duck(SMALL).sql(SQL[name]).df()) == []


@pytest.mark.parametrize("name", ["op6_decontamination", "op8_quality_rules"])
def test_sql_on_odd_rows(spark, odd, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    assert oracle.differences(QUERIES[name](spark, odd).toPandas(), c.sql(SQL[name]).df()) == []


# 1


def test_warc_round_trip(spark, odd):
    got = QUERIES["op1_warc"](spark, odd).collect()
    want = Counter((r["page_id"], len((r["html"] or "").encode()), base64.b32encode(hashlib.sha1((r["html"] or "").encode()).digest()).decode()) for r in rows(spark, odd, "pages"))
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    kinds = Counter((r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 1)
    assert kinds == {("response", None): 1, ("revisit", 2): 2}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 3_000_000} == {(9, "response", None), (8, "revisit", 9)}


def test_archives_are_chains_of_gzip_members(spark, odd, tmp_path):
    import gzip
    import pathlib

    warc.write_arc(spark.read.parquet(f"{odd}/pages.parquet"), f"{tmp_path}/arc")
    for f in pathlib.Path(f"{tmp_path}/arc").glob("part-*"):
        data = f.read_bytes()
        assert gzip.decompress(data) == b"".join(warc.members(data)) and len(list(warc.parse_arc(gzip.decompress(data)))) == len(list(warc.parse_arc(data)))
    with pytest.raises(ValueError):
        list(warc.members(data[:-30]))


def test_arc_versions():
    content = b"HTTP/1.1 200 OK\r\n\r\nbody\nwith lines\n"
    for v in (1, 2):
        data = warc.arc_version_block(v, "f.arc", "19990101000000") + b"\n" + warc.arc_record(v, "http://x/a b", "1.2.3.4", "19990203040506", "text/html", content) + b"\n"
        (r,) = warc.parse_arc(data)
        x = warc.convert(r)
        assert x["payload"] == b"body\nwith lines\n" and x["date"] == "1999-02-03T04:05:06Z" and x["kind"] == "response" and x["uri"] == "http://x/a%20b"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-10]))


# 2


def test_mix_meets_targets(spark, odd):
    got = QUERIES["op2_mixing"](spark, odd).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["target"]].append(r["taken"])
    assert all(abs(sum(v) - t) <= len(v) + 1 for t, v in by.items())
    assert sum(by) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, QUERIES["op2_mixing"](spark, odd).collect()), key=str)


def test_nested_budgets(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in mixing.mix(docs, shares=(0.5, 1.0)).collect():
        assert r["taken"] <= r["taken_1"] or r["target"] > r["target_1"]


# 3


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["text"] for r in rows(spark, odd)} | {r["text"] for r in rows(spark, SMALL)}
    m = token_counts.MergeCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for x in [*texts, "՘a 1₏", "a" * 3000, "  \n\n x", "\x85\x1c z"]:
        assert m.count(x) == (len(t.encode(x, add_special_tokens=False).ids) if x else 0)


# 4, 9, 10


def auc(pairs):
    import pandas as pd

    s, y = np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
    r = pd.Series(s).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    d = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert auc([(r["score"], r[label]) for r in got]) >= least
    assert np.mean([r["predicted"] == r[label] for r in got]) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.97


def test_undetermined(spark, odd):
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, odd).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2))


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 500)
    xs, ys = quality_classifier.isotonic(x.tolist(), (x + rng.normal(0, 1, 500) > 0).astype(float).tolist())
    assert xs == sorted(xs) and ys == sorted(ys)


def test_folding_and_exceptions():
    m = toxicity.ToxicityModel({"=idiot": 2.0, "=trash": 1.0, "^lowei": 3.0}, exceptions=("trash can",)).matcher()
    assert m("An 1d10t, an іdiot​, IDIOT$$$ here")[0] == 6.0
    assert m("the trash can and trash")[0] == 1.0
    assert m("loweischaft flowei idiots")[0] == 3.0
    assert m(None) == (0.0, 0) and m("") == (0.0, 0)


def test_normal_equations_and_calibration_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.learn(docs, labels, dim=40)
    rows = docs.join(labels, "doc_id").withColumn("held", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 3).collect()
    stats = np.array([quality_classifier.statistics(r["text"]) for r in rows])
    assert model.mean == pytest.approx(stats.mean(0)) and model.scale == pytest.approx(np.maximum(stats.std(0), 1e-6))
    w, b = model.projection()
    x = np.clip((stats - model.mean) / model.scale, -6, 6)
    f = np.array([[math.sqrt(2 / 40) * math.cos(sum(p * q for p, q in zip(r, w[:, k])) + b[k]) for k in range(40)] + [1.0] for r in x])
    y, held = np.array([r["quality"] for r in rows], float), np.array([r["held"] for r in rows])
    n = (~held).sum()
    want = np.linalg.solve(f[~held].T @ f[~held] + np.diag([1e-3 * n] * 40 + [0.0]) + 1e-9 * np.eye(41), f[~held].T @ y[~held])
    assert model.weights == pytest.approx(want, rel=1e-6, abs=1e-8)
    raw = (f[held] @ want).round(9)
    order = np.argsort(raw, kind="stable")
    # the isotonic fit at each place is the largest of the least means over intervals that hold it
    fit = lambda v, i: max(min(v[a : c + 1].mean() for c in range(i, len(v))) for a in range(i + 1))
    if len(np.unique(raw)) == len(raw):
        v = y[held][order]
        means = sorted({round(fit(v, i), 9) for i in range(len(v))})
        xs, ys = quality_classifier.isotonic(raw.tolist(), y[held].tolist())
        assert len(xs) - 2 == len(means)
    assert model.xs == pytest.approx(quality_classifier.isotonic(raw.tolist(), y[held].tolist())[0], abs=1e-6)


def test_matcher_by_brute_force():
    rng = np.random.default_rng(12)
    letters = "abcd"
    vocabulary = ["".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(60)]
    weights = {("=" if rng.random() < 0.5 else "^") + v: float(rng.integers(1, 9)) for v in vocabulary[:25] if len(v) > 1}
    exceptions = tuple(f"{a} {b}" for a, b in zip(vocabulary[10:20], vocabulary[30:40]))
    match = toxicity.ToxicityModel(weights, exceptions=exceptions).matcher()
    for _ in range(200):
        t = "".join(w + s for w, s in zip(rng.choice(vocabulary, 30), rng.choice([" ", ", ", "  ", "-"], 30, p=[0.7, 0.1, 0.1, 0.1])))
        words = [(m.start(), m.group()) for m in re.finditer(r"[^\W\d_]+", t)]
        safe = {k for e in exceptions for m in re.finditer(rf"(?<![a-z])(?={re.escape(e)}(?![a-z]))", t) for k in range(m.start(), m.start() + len(e))}
        want = sum(max([w for k, w in weights.items() if k[1:] == x and k[0] == "=" or x.startswith(k[1:]) and k[0] == "^"], default=0.0) for at, x in words if at not in safe)
        assert match(t) == (want, len(t.split()))


def test_exception_phrases_are_learned(spark):
    toxic = [f"you are pure scum {k}" for k in range(120)]
    clean = [f"there is pond scum on water {k}" for k in range(60)] + [f"nothing to see here {k}" for k in range(400)]
    texts = [(k, t) for k, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 120)) for k, _ in texts], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert "=scum" in model.weights or any("scum".startswith(k[1:]) for k in model.weights)
    assert "pond scum" in model.exceptions and not {"pure scum"} & set(model.exceptions)
    match = model.matcher()
    assert match("old pond scum there")[0] == 0 < match("you scum there")[0]
    kept = toxicity.reject_toxic(docs.withColumn("score", F.lit(7.0)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and {r["score"] for r in kept.collect()} == {7.0} and kept.filter("doc_id >= 120").count() == 460


def test_profiles_by_brute_force(spark):
    e = language_id.Encoder(dim=64)

    def slow(text):
        c = [0]
        for x in text.lower():
            code = ord(x) if x.isalpha() else 0
            if code or c[-1]:
                c.append(code)
        c += [0] if c[-1] else []
        v = np.zeros(64)
        for i in range(len(c) - 2):
            g = np.ones(64)
            for k in range(3):
                g = g * np.roll(e.letter(c[i + 2 - k]), k)
            v += g
        return v if len(c) > 2 else None

    texts = ["Hello,  World!", "ab", "a", "Äpfel und Öl 123 und", "日本語 テキスト"]
    for t in texts:
        assert np.allclose(e.bundle(t), slow(t))
    assert e.bundle("123 !") is None and slow("123 !") is None
    big = language_id.Encoder()
    docs = spark.createDataFrame([(k, "the house and the garden " * 3 if k % 2 else "das haus und der garten " * 3, "en" if k % 2 else "de") for k in range(12)], "k long, text string, lang string")
    p = language_id.learn_prototypes(docs)
    for lang in ("en", "de"):
        v = sum(big.bundle(r["text"]) / np.linalg.norm(big.bundle(r["text"])) for r in docs.filter(F.col("lang") == lang).collect())
        assert p[lang] == pytest.approx((v / np.linalg.norm(v)).tolist(), abs=1e-6)


def test_clashing_columns_of_rules_and_mixing(spark):
    names = ["doc_id", "text", "source", "n_words", "kept", "hash", "sk", "z", "rest", "at", "left", "held", "rounds", "a.b"]
    rows = [(k, "word " * (k + 1), "ab"[k % 2], *[k] * 11) for k in range(8)]
    docs = spark.createDataFrame(rows).toDF(*names)
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert all(out[k]["n_words"] == k + 1 and out[k]["hash"] == k and out[k]["kept"] in (True, False) for k in range(8))
    mixed = mixing.mix(docs, carry=True)
    assert mixed.columns == [*names, "size", "source_size", "target", "taken"]
    plain = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs).collect()}
    for r in mixed.collect():
        assert tuple(r)[:14] == rows[r["doc_id"]] and tuple(r)[14:] == plain[r["doc_id"]]


def test_string_keys(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")) for t in ("documents", "labels"))
    model = quality_classifier.learn(docs, labels)
    assert quality_classifier.score_texts(docs, model).filter("score BETWEEN 0 AND 1").count() == docs.count()


# 5


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def brute_components(docs):
    sets, inv, up = [shingles(r["text"]) for r in docs], defaultdict(list), list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in inv[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[top(i)] = top(j)
        for g in s:
            inv[g].append(i)
    least = {}
    for i, r in enumerate(docs):
        if r["doc_id"] is not None:
            least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), least.get(top(i))) for i, r in enumerate(docs))


@pytest.mark.parametrize("tight", [False, True])
def test_components_equal_brute_force(spark, odd, tight, monkeypatch):
    if tight:  # neighbourhoods are split over tasks, those that regions don't halve in blocks; components go by rounds
        monkeypatch.setattr(jaccard_join, "CELL_NODES", 6)
        monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 300)
        monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
        monkeypatch.setattr(jaccard_join.components, "__defaults__", (0,))
    got = QUERIES["op5_jaccard_join"](spark, odd).collect()
    assert Counter(map(tuple, got)) == brute_components(rows(spark, odd))


def _deal(spark, parts):
    """Documents, one partition for each of parts."""
    docs = [[(k, t) for k, t in part] for part in parts]
    rdd = spark.sparkContext.parallelize(docs, len(docs)).flatMap(lambda part: part)
    return spark.createDataFrame(rdd, "doc_id long, text string")


def _components(docs):
    members, links = jaccard_join.join(docs)
    assert links.filter("5 * common < 4 * total OR a = b").isEmpty()
    return Counter(map(tuple, members.select("doc_id", "n_shingles", "component_id").collect()))


def test_recall_on_the_test_tables(spark):
    """All links of the synthetic documents, near copies in large groups among them, with the constants of production."""
    d = "/root/testdata/sf0.01"
    got = QUERIES["op5_jaccard_join"](spark, d).collect()
    assert Counter(map(tuple, got)) == brute_components(rows(spark, d))


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("parts", [1, 2, 5])
def test_links_over_batches(spark, parts, batch):
    """300 groups of three texts that begin alike; within a group the last word differs (similarity 0.8 exactly)."""
    texts = []
    for g in range(300):
        w = ["one", "two", "three", "four", "five", *(f"g{g}w{k}" for k in range(7))]
        texts += [" ".join([*w, f"last{k}"]) for k in range(3)]
    every = list(enumerate(texts))
    dealt = [[r for r in every if r[0] % 3 == 0], [r for r in every if r[0] % 3 > 0]] if parts == 2 else [every[k::parts] for k in range(parts)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = _components(_deal(spark, dealt))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_components([{"doc_id": k, "text": t} for k, t in every]) and len({c for _, _, c in got}) == 300


@pytest.mark.parametrize("first", ["base", "variants"])
@pytest.mark.parametrize("nodes", [2_048, 40])
def test_stars(spark, first, nodes, monkeypatch):
    """Variants that are linked with their base and with no other variant, in one task and in several."""
    monkeypatch.setattr(jaccard_join, "CELL_NODES", nodes)
    base = [f"b{k}" for k in range(100)]
    places = [(p, q) for p in range(4, 96) for q in range(4, 96) if q - p >= 5][::11][:300]
    variants = [" ".join(f"x{k}" if j in at else w for j, w in enumerate(base)) for k, at in enumerate(places)]
    rows = list(enumerate([" ".join(base), *variants]))
    parts = [rows[:1], rows[1:150], rows[150:]]
    got = _components(_deal(spark, parts if first == "base" else parts[::-1]))
    assert got == brute_components([{"doc_id": k, "text": t} for k, t in rows]) and {c for _, _, c in got} == {0}


@pytest.mark.parametrize("leaf", [2, 32])
def test_regions_equal_brute_force(leaf, monkeypatch):
    """Clouds of sets around centres, at all distances about the threshold; every link's ends are connected, no more."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rng = np.random.default_rng(6)
    sets = []
    for c in range(12):
        centre = np.arange(80) + 1_000 * (c // 2) + 12 * (c % 2)
        for k in range(14):
            gone = rng.choice(80, rng.integers(0, 16), replace=False)
            sets.append(np.unique(np.concatenate([np.delete(centre, gone), 10**6 + rng.integers(0, 10**6, rng.integers(0, 8))])).astype(np.uint64))
    found = jaccard_join.Region(sets).links()
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j, common, total in found:
        assert common == len(np.intersect1d(sets[i], sets[j])) and 5 * common >= 4 * total and total == len(np.union1d(sets[i], sets[j]))
        assert top(i) != top(j)
        up[top(i)] = top(j)
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) > 100 and all(top(i) == top(j) for i, j in linked)


def test_columns_of_the_users_survive(spark):
    names = ["doc_id", "text", "id", "k1", "k2", "whole", "y", "n", "node", "a.b"]
    docs = spark.createDataFrame([(k, " ".join(_words(40, 50 + k // 2)), *[k] * 8) for k in range(6)]).toDF(*names)
    out = jaccard_join.keep_one(docs)
    assert out.columns == names and sorted(map(tuple, out.collect())) == [(k, " ".join(_words(40, 50 + k // 2)), *[k] * 8) for k in (0, 2, 4)]


def test_one_row_of_a_component_with_null_and_repeated_keys(spark):
    a, b = _words(120, 31), _words(120, 32)
    near = lambda w: " ".join([*w[:60], "x", *w[61:]])
    rows = [(None, " ".join(a)), (None, near(a)), (5, " ".join(b)), (5, near(b)), (5, near(b)), (5, ""), (5, " "), (None, "")]
    got = [r["text"] for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 5 and sorted(x for x in got if not x.strip()) == ["", "", " "]
    assert sum(x in (" ".join(a), near(a)) for x in got) == 1 and sum(x in (" ".join(b), near(b)) for x in got) == 1


# 6


def test_cut_until_clean(spark, odd):
    out = decontamination.decontaminate(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/benchmark.parquet"))
    again = decontamination.find_matches(out, spark.read.parquet(f"{odd}/benchmark.parquet"))
    assert again.filter("n_hit > 0").count() == 0 and out.filter("doc_id < 2").count() == 2


def test_passes_agree(spark, odd, monkeypatch):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda d: sorted(map(str, d.collect()))
    one = key(decontamination.find_matches(docs, items)), key(decontamination.decontaminate(docs, items))
    monkeypatch.setattr(decontamination, "PASS_WORDS", 30)
    assert len(list(decontamination.passes(items))) > 1
    assert (key(decontamination.find_matches(docs, items)), key(decontamination.decontaminate(docs, items))) == one


def test_automaton_blocks_agree(spark, odd):
    items = spark.read.parquet(f"{odd}/benchmark.parquet")
    texts = [decontamination.words_of((r["text"] or "").encode()) for r in rows(spark, odd)]
    (one,) = decontamination.automata(items)
    many = list(decontamination.automata(items, block_words=3))
    for w in texts:
        parts = [m.match(w) for m in many]
        assert one.match(w) == (decontamination._union([x for s, _ in parts for x in s]), set().union(*[f for _, f in parts]))


# 7


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_repeats_equal_brute_force(spark, odd, tight, monkeypatch):
    if tight:  # hot samples, long texts in slices, buckets that split down to single windows
        monkeypatch.setattr(suffix_dedup, "HOT", 2)
        monkeypatch.setattr(suffix_dedup, "MOST_ENTRIES", 3)
        monkeypatch.setattr(suffix_dedup, "SLICE", 5_000)
    docs = rows(spark, odd)
    docs = [r for r in docs if len(r["text"] or "") < 50_000]
    spark.createDataFrame(docs, DOCS).repartition(3).write.mode("overwrite").parquet(f"{odd}/few/documents.parquet")
    got = QUERIES["op7_suffix_dedup"](spark, f"{odd}/few").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(docs, brute_repeats([r["text"] for r in docs])))
    assert Counter(map(tuple, got)) == want


# pipeline


def test_pipeline(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = jaccard_join.materialize(stage(spark, docs, odd), name)
        if k < 4:
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            want = brute_components(before.collect())
            full = {c for (_, n, c), _ in want.items() if n}
            none = sum(m for (_, n, _), m in want.items() if not n)
            assert docs.count() == len(full) + none
        if name == "suffix_array_dedup":
            cut = {r["doc_id"]: r for r in docs.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in cut.values() if r["text"] is not None and r["doc_id"] is not None)
    assert set(columns) <= set(docs.columns) and docs.filter("doc_id = 9 AND (hash <> 'h' OR key <> 1 OR node <> 7)").isEmpty()
    assert docs.filter("taken <= 0").count() == 0 and {"target", "taken", "source_size"} <= set(docs.columns)
    assert docs.agg(F.max(F.col("taken") - 2 * F.col("size"))).first()[0] <= 0
