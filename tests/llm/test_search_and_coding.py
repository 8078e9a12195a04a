"""Hard negatives, piece encoding and periodic runs: against brute force and the library, on odd rows and small blocks."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewright.llm")
import oracle  # noqa: E402
from tidewright.llm import hard_negatives, piece_codec, tandem_runs  # noqa: E402
from tidewright.llm.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, block long, pivot int, x string, rid int"


# hard negatives


def vectors(seed, n=220, dim=6):
    """Ties, a third of all rows alike, nulls, odd components, short vectors, repeated rows and anchors, a null key."""
    rng = random.Random(seed)
    same = [0.5, -0.25, 0.125, 1.0, 0.0, -1.0][:dim]
    out = [(k, same if rng.random() < 0.33 else [rng.choice([-1.0, -0.5, 0.0, 0.3, 0.5, 1.0]) for _ in range(dim)], rng.randrange(4)) for k in range(n)]
    out += [(n, None, 1), (n + 1, [1.0, None, 1.0], 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [math.inf] * dim, 2), (n + 4, same, None), (n + 5, [2.0], 2), (n + 6, [], 2), (None, same, 1)]
    out += [out[100], out[100], (100, [1.0] * dim, 3), out[5], out[5]]
    return [(*r, 1, 2, "x", 3) for r in out]


def brute(rows, positives=5, negatives=5):
    good = []
    for key, v, label, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
            good.append((key, [math.floor(256 * float(np.float32(x))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (key, v, label) in enumerate(good):
        if key is None or key % 100:
            continue
        scored = [(dot(v, w), k, lab) for j, (k, w, lab) in enumerate(good) if j != i]
        for p, pk, _ in sorted((r for r in scored if r[2] == label), key=order)[:positives]:
            hard = sorted((r for r in scored if r[2] != label and 80 * p <= 100 * r[0] <= 100 * p), key=order)[:negatives]
            out += [(key, pk, n + 1, k, p, s) for n, (s, k, _) in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module", params=[1, 2])
def odd_vectors(spark, request, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(f"vectors{request.param}"))
    rows = vectors(request.param)
    spark.createDataFrame(rows, EMBEDDINGS).repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d, rows


@pytest.mark.parametrize("block_rows", [7, 2_048])
def test_hard_negatives_equal_brute_force(spark, odd_vectors, block_rows, monkeypatch):
    d, rows = odd_vectors
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block_rows)  # of 7 rows: many blocks, several rounds
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    got = QUERIES["op11_hard_negatives"](spark, d)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_hard_negatives_equal_sql(spark, odd_vectors):
    import duckdb

    d, _ = odd_vectors
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    assert oracle.differences(QUERIES["op11_hard_negatives"](spark, d).toPandas(), c.sql(SQL["op11_hard_negatives"]).df()) == []


def test_a_search_without_anchors_and_exact_large_scores(spark):
    df = spark.createDataFrame([(1, [1, 2], 1), (2, [2, 1], 2)], "vec_id long, embedding array<long>, label int")
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    big = [(0, [2**28, 3], 1), (1, [2**28, 5], 1), (2, [2**28, 4], 2), (3, [2**28, 5], 2), (4, [2**28 - 1, 5], 2)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<long>, label int")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    s = lambda a, b: big[a][1][0] * big[b][1][0] + big[a][1][1] * big[b][1][1]
    assert got == [(0, 1, 1, 3, s(0, 1), s(0, 3)), (0, 1, 2, 2, s(0, 1), s(0, 2)), (0, 1, 3, 4, s(0, 1), s(0, 4))]


def test_blocks_are_bounded_and_certified_blocks_are_left_out(spark, tmp_path, monkeypatch):
    """Four far groups: an anchor's blocks are those of its own group."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    centres = np.array([[9000, 0, 0], [0, 9000, 0], [0, 0, 9000], [-9000, 0, 0]])
    rows = [(k, (centres[k % 4] + rng.integers(-20, 20, 3)).tolist(), int(k // 4 % 2)) for k in range(2_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>, label int")
    store = hard_negatives.Store(df, "vec_id", "label", "embedding", F.col("vec_id") % 100 == 0)
    sizes = [len(r["keys"]) // 8 for r in store.blocks.collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 50
    probes = store.anchors().withColumns({"low": F.array(F.lit(9000 * 8900)), "high": F.array(F.lit(2**62))})
    asked = store._asks(probes, 0, 10**6).collect()
    assert 0 < len(asked) < 0.5 * len(sizes) * probes.count()


# piece encoding

TEXTS = [None, "", " ", "  two  spaces ", "a\nb\t c\r\n", "<s> </s> <unk> <0x0A>", "▁▁ mark", "日本語 テキスト 😀 \x00 é́", "x" * 30_000, "ab " * 20_000, "1234 5,678.90", "ﬁ Ǆ ½"]


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_encoding_and_decoding_equal_the_library(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice(" ▁\n ab01.,éñ日😀<s>er") for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = [(k if k % 9 else None, t, 5) for k, t in enumerate(texts)]
    got = piece_codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), model).collect()
    want = sorted((r[0] is None, r[0] or 0, np.array(i := lib.encode(r[1] or "", add_bos=True, add_eos=True), "<u4").tobytes(), lib.decode(i)) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert all(r["agrees"] for r in got)
    back = piece_codec.decode_ids(spark.createDataFrame([(1, bytes(got[3]["ids"])), (2, None)], "doc_id long, ids binary"), model).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [got[3]["decoded"], ""]


def test_decoding_of_any_identifiers(model):
    import sentencepiece

    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=model), piece_codec.PieceCodec(model), random.Random(5)
    for _ in range(3_000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), 259, 28705, rng.randint(259, 31_999)]) for _ in range(rng.randrange(9))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids


def test_digests_of_the_query(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in docs:
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode()), True))
    got = QUERIES["op12_sentencepiece"](spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"] and sorted(map(tuple, got.collect())) == sorted(want)


# periodic runs


def plain_runs(x, least=24, copies=3):
    found = {}
    for q in range(1, len(x) // copies + 1):
        i = 0
        while i + q < len(x):
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(least, copies * q):
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_answer(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    left = b" ".join(w for i, w in enumerate(words) if i not in drop)
    facts = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *facts, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest())


def made_texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(120):
        n, k = rng.randrange(140), rng.choice([1, 2, 3, 6, 60])
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(4) if n > 8 else 0):
            a, m = sorted((rng.randrange(n), rng.randrange(n)))
            p = rng.randint(1, max(1, (n - a) // 3))
            x[a : m + 1] = [x[a + (i - a) % p] for i in range(a, m + 1)]
        out.append(rng.choice([" ", "\n", " \t\x0b"]).join(f"w{v}" if v else "\x1cé" for v in x))
    return out


def test_periodic_runs_equal_brute_force(spark, tmp_path):
    texts = [None, "", " \n ", "one", "a " * 23, "a " * 24, "a b " * 5_000, *made_texts(1), *made_texts(2)]
    rows = [(k, t, 1, "r") for k, t in enumerate(texts)] + [(None, "a " * 30, 1, "r"), (6, texts[6], 1, "r")]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string").repartition(3).write.parquet(f"{d}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_answer(k, t) for k, t, *_ in rows), key=repr)


def test_periodic_runs_of_a_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    docs = [r for r in docs if len(r["text"] or "") < 6_000]  # the plain loop takes n * n steps
    want = {plain_answer(r["doc_id"], r["text"]) for r in docs}
    keys = {r["doc_id"] for r in docs}
    assert {tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect() if r["doc_id"] in keys} == want


@pytest.mark.parametrize("least,copies", [(24, 3), (6, 2), (1, 2), (9, 4)])
def test_runs_of_other_lengths(least, copies):
    texts = [t.encode() for t in made_texts(least)]
    n, runs, left = tandem_runs._slice_runs(texts, least, copies)
    for t, m, r, rest in zip(texts, n, runs, left):
        words = t.split()
        want = plain_runs(words, least, copies)
        drop = {i for s, length, q in want for i in range(s + q, s + length)}
        assert m == len(words) and sorted(r) == want and rest.split() == [w for i, w in enumerate(words) if i not in drop]
    with pytest.raises(ValueError):
        tandem_runs.periodic_runs(None, least=0)
