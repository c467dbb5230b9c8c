import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewell.llm import queries
from tidewell.llm.ann import TILE, drawn, entries, reranked, search, visits
from tidewell.llm.bpe import PerfectHash, codec, decoded, encoded
from tidewell.llm.common import table
from tidewell.llm.langid import fit, grams, predict, train

SF = "/root/testdata/sf0.01"


def test_bpe(spark, docs):
    vocabulary = queries.public_vocabulary()
    own = codec(vocabulary)
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    rand = random.Random(2)
    texts = ["".join(rand.choice("abcdeé ñ12\n\t!x'st漢😀") for _ in range(rand.randint(0, 80))) for _ in range(800)]
    texts += ["", " ", "<|endoftext|>", "ab" * 20000, "a" * 5000, " " * 3000, "don't I'll"]
    for t in texts:
        assert own.encode(t) == truth.encode_ordinary(t), t[:80]
        assert own.decode(own.encode(t)) == t.encode()
    for df in (docs, table(spark, SF, "documents")):
        for r in encoded(df.select("doc_id", "text"), vocabulary).collect():
            ids = truth.encode_ordinary(r.text or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = decoded(encoded(docs, vocabulary, ids=True), vocabulary)
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in back.collect())
    assert encoded(docs.limit(0), vocabulary).collect() == []


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    h = PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(3000))
    assert h.slots([b"no", b"3000", b""]) == [-1, -1, -1]
    assert PerfectHash([]).slots([b"a"]) == [-1]


def test_language_id(spark, docs):
    got = queries.op7_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    again = queries.op7_language_id(spark, SF).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in again} == {(r.doc_id, r.lang_pred, r.score) for r in got}
    model = train(docs)
    out = predict(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in out.collect():
        unknown = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == unknown and (r.score == 0 or not unknown)
    assert predict(docs, train(docs.limit(0))).where("lang_pred != 'und'").count() == 0
    assert train(docs.withColumn("lang", F.lit(None).cast("string"))).labels == []
    assert predict(docs.limit(0), model).collect() == []


def plain_ftrl(examples, idf, size, labels, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
    """Dense weights, one coordinate after the other, by the update rule as published."""
    k = len(labels)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + np.sqrt(n[i, c])) / alpha + l2)

    for _ in range(2):
        for label, counts in examples:
            x = {i: (1 + np.log(v)) * idf[i] for i, v in counts.items()}
            norm = np.sqrt(sum(v * v for v in x.values()))
            x = {i: v / norm for i, v in x.items()} | {size: 1.0}
            w = {i: [weight(i, c) for c in range(k)] for i in x}
            s = np.array([sum(v * w[i][c] for i, v in x.items()) for c in range(k)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for i, v in x.items():
                for c in range(k):
                    g = (p[c] - (labels[c] == label)) * v
                    z[i, c] += g - (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / alpha * w[i][c]
                    n[i, c] += g * g
    return np.array([[weight(i, c) for c in range(k)] for i in range(size + 1)])


def test_language_model_against_plain_training(spark):
    """Document frequencies, sample, weights, temperature and scores, all rebuilt on the driver."""
    rows = [r for r in table(spark, SF, "documents").where("length(text) between 40 and 400 and lang is not null").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string").repartition(3)
    model = train(df, bits=10)
    counts = {r.doc_id: dict(zip(*(v.tolist() for v in grams(r.text, 10)), strict=True)) for r in rows}
    idf = {i: np.log((1 + len(rows)) / (1 + sum(i in c for c in counts.values()))) + 1 for i in range(1024)}
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", "text")).collect()]
    lang = {r.doc_id: r.lang for r in rows}
    labels = sorted(set(lang.values()))
    assert model.labels == labels and len(labels) > 2
    learn = [(lang[i], counts[i]) for at, i in enumerate(order) if at % 5 != 4]
    want = plain_ftrl(learn, idf, 1024, labels)
    dense = np.zeros((1024, len(labels)))
    dense[model.row >= 0] = model.weights[model.row[model.row >= 0]]
    assert np.allclose(dense, want[:-1], atol=1e-9) and np.allclose(model.bias, want[-1], atol=1e-9)
    assert 0 < len(model.weights) < 1024 and (model.weights != 0).any(1).all()
    for r in predict(df, model).collect():
        x = np.array([(1 + np.log(v)) * idf[i] for i, v in counts[r.doc_id].items()])
        s = (x / np.sqrt(x @ x) @ want[list(counts[r.doc_id])] + want[-1]) / model.temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert r.lang_pred == labels[int(np.argmax(p))] and abs(r.score - p.max()) < 1e-9


def test_language_sample_is_bounded(spark, monkeypatch):
    """Repeated rows, one label, rare labels and a byte budget; never more than asked for, and never none."""
    from tidewell.llm import langid

    seen = []
    monkeypatch.setattr(langid, "fit", lambda examples, *a, **k: seen.append(examples) or fit(examples, *a, **k))
    rows = [(i, f"mot {i} de plus", "fr") for i in range(300)] + [(7, "the same words", "en")] * 3000 + [(8, "una parola", "it"), (9, None, "it"), (None, "x", "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    train(df, per_label=10)
    train(df, per_label=10, sample_bytes=300)
    train(df.where("lang = 'en'"), per_label=10)
    many = [Counter(e[0] for e in examples) for examples in seen]
    assert many[0] == {"fr": 10, "en": 1, "it": 1} and many[2] == {"en": 1}
    assert 1 <= many[1]["fr"] < 10 and many[1]["en"] == many[1]["it"] == 1


def plain_search(vectors, queries_, top):
    out = {}
    for q, v in queries_:
        scores = sorted((-float(np.dot(v, w)), i) for i, w in vectors if i != q)
        out[q] = scores[:top]
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_nearest_neighbours(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    rows = table(spark, sf, "embeddings").collect()
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in rows]
    want = plain_search(vectors, [x for x in vectors if x[0] % 20 == 0], 20)
    got = {}
    for r in queries.op8_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    by = dict(vectors)
    hit = 0
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[0], x[1]))
        for s, i in found:
            assert abs(s - float(by[q] @ by[i])) < 1e-12
        hit += len({i for _, i in found} & {i for _, i in want[q]})
    assert hit / sum(map(len, want.values())) >= 0.9


def test_only_visited_cells_are_multiplied(spark):
    """Vectors that cluster: a small share of rows is multiplied; the walk takes cells in order."""
    own = np.random.default_rng(3)
    centres = own.normal(size=(40, 16))
    x = centres[own.integers(0, 40, 3000)] + own.normal(size=(3000, 16)) * 0.1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    asked = df.where("vec_id % 30 = 0")
    found, work, index = reranked(df, asked, 20, "vec_id", "embedding", 64, None, 0.93, 20_000, 500)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    hit = sum(len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) for q in got)
    assert hit / 2000 >= 0.9 and index.share <= 0.2 and len(index.members) > 3
    multiplied = work.agg(F.sum("multiplied")).first()[0]
    assert multiplied <= 100 * (index.share * 3000 + 500)
    first, second, held = own.normal(size=9), own.normal(size=40), own.integers(0, 3, (9, 40))
    sums = np.sort((first[:, None] + second[None, :]).ravel())
    depth = visits(first, second, held, 60)
    order = np.argsort(second, kind="stable")
    seen = [(i, j) for i in range(9) for j in order[: depth[i]]]
    assert sum(held[i, j] for i, j in seen) >= 60
    # All cells before the last tile's are visited.
    last = max(first[i] + second[order[(depth[i] - 1) // TILE * TILE]] for i in range(9) if depth[i])
    assert {(i, j) for i in range(9) for j in range(40) if first[i] + second[j] < last} <= set(seen) and last <= sums[-1]


def test_sample_is_that_of_the_least_hashes(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    rows = entries(df, "vec_id", "embedding", 20)
    want = [r.v for r in rows.orderBy(F.xxhash64(F.col("ids")[0]), "ids").limit(400).collect()]
    assert [r.v for r in drawn(rows, 3000, 400).collect()] == want
    assert drawn(rows, 3000, 5000).count() == 3000


def test_nearest_neighbours_edges(spark):
    own = np.random.default_rng(0)
    rows = [(i, own.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] + [0.0] * 5) for i in range(200)]  # one vector, many ids
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [1.0]), (2005, [float("inf")] + [0.0] * 5), (2006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("ids", F.lit(1)).withColumn("v", F.lit(1)).repartition(3)
    usable = [(i, np.array(v)) for i, v in rows if i < 2000]
    want = plain_search(usable, usable, 20)
    got = {}
    for r in search(df, df, visit=1.0, block=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9) + 0.0, r.vec_id))
    assert got == {q: [(round(s, 9) + 0.0, i) for s, i in v] for q, v in want.items()}
    few = df.where("vec_id in (1, 2, 1000)")
    assert search(few, few).count() == 6
    assert search(df.limit(0), df.limit(0)).collect() == []
    assert search(df.where("vec_id = 2001"), df).collect() == []


def test_bpe_that_remembers_little():
    """Ids don't depend on how many pre-tokens are remembered."""
    vocabulary = queries.public_vocabulary()
    own, little = codec(vocabulary), codec(vocabulary, 3)
    rand = random.Random(3)
    for _ in range(50):
        text = " ".join(rand.choice(["alpha", "beta", "x'st", "漢字", "qzqz"]) + str(rand.randrange(20)) for _ in range(rand.randrange(12)))
        assert little.encode(text) == own.encode(text)
    assert little.remembered == 3 and own.remembered == own.REMEMBERED
