import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_simhash import plain_components
from pyspark.sql import functions as F
from tidewell.llm import common
from tidewell.llm import similarity
from tidewell.llm.common import table
from tidewell.llm.components import components
from tidewell.llm.simhash import fingerprint, link, representatives


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def expected(rows, distance=10):
    """Rows that stay, as (id is null, id): similar pairs whose fingerprints are connected, by brute force."""
    marks, members = {}, defaultdict(list)
    for i, t in rows:
        own = frozenset(plain_set(t))
        mark = fingerprint(t, 2)
        marks[own] = min(marks.get(own, 1 << 63), mark - (1 << 64) if mark >> 63 else mark)
        members[own].append((i is None, i or 0))
    sets = list(marks)
    prints = [marks[x] & (2**64 - 1) for x in sets]
    buckets = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= distance)
    roots = plain_components(range(len(sets)), lambda a, b: buckets[a] == buckets[b] and alike(sets[a], sets[b]))
    least = {}
    for x, c in zip(sets, roots, strict=True):
        least[c] = min([*members[x], *([least[c]] if c in least else [])])
    return sorted(least.values())


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_small_tables(spark, docs):
    got = representatives(docs)
    assert got.columns == docs.columns
    assert kept(got) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert representatives(docs.limit(0)).collect() == []


def test_chains_and_a_crowd(spark, monkeypatch):
    """Chains whose ends aren't alike, a crowd of copies, and texts that share half of their words."""
    monkeypatch.setattr(similarity, "BLOCK", 7)
    own = random.Random(4)
    word = lambda: f"w{own.randrange(10**6)}"
    texts = []
    for length in (30, 60, 120, 400):
        for _ in range(6):
            words = [word() for _ in range(length)]
            for _ in range(12):
                texts.append(" ".join(words))
                for _ in range(max(1, length // 60)):
                    words[own.randrange(length)] = word()
    base = [word() for _ in range(200)]
    for _ in range(60):
        words = list(base)
        words[own.randrange(200)] = word()
        texts.append(" ".join(words))
    for i in range(60):
        texts.append(" ".join(base[: 100 + i] + [word() for _ in range(60)]))
    own.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows)
    assert 30 < len(want) < len(rows) / 2
    assert kept(representatives(df)) == want


@pytest.mark.parametrize("options", [{"bucket_rows": 20, "block": 7}, {"parts": 3}, {"distance": 3, "bucket_rows": 20}])
def test_links_do_not_depend_on_the_plan(spark, options):
    """Full buckets, by blocks and by balls, and any number of partitions give the same links."""
    own = random.Random(6)
    values = {own.getrandbits(64) for _ in range(60)}
    for _ in range(3):
        centre = own.getrandbits(64)
        for _ in range(60):
            v = centre
            for b in own.sample(range(64), own.randint(0, 7)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame(list(enumerate(np.array(values, np.uint64).view(np.int64).tolist())), "d long, f long").repartition(5)
    options = {"distance": 9, **options}
    want = plain_components(values, lambda a, b: (a ^ b).bit_count() <= options["distance"])
    got = list(range(len(values)))
    for r in components(link(nodes, **options)).collect():
        got[r.node.d] = r.root.d
    assert got == want


def similar_pairs(texts):
    """All pairs of texts with a similarity of 0.8 or more that share one of their 40 least shingle hashes."""
    sets = [similarity.shingles(t) for t in texts]
    index, pairs = defaultdict(list), set()
    for i, s in enumerate(sets):
        for h in s[:40].tolist():
            pairs.update((j, i) for j in index[h])
            index[h].append(i)
    size = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    close = [(i, j) for i, j in pairs if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))]
    return [(i, j) for i, j in close if (n := size(i, j)) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]


def test_recall_against_brute_force(spark):
    """Of all near copies of 0.01 and 0.1, those whose fingerprints lie within 10 bits; all of those are caught."""
    found = near = 0
    for sf in ("0.01", "0.1"):
        texts = {}
        for r in table(spark, f"/root/testdata/sf{sf}", "documents").where("text is not null").collect():
            texts.setdefault(" ".join(r.text.split()), r.text)
        texts = [t for t in texts.values() if t.split()]
        pairs = similar_pairs(texts)
        apart = [(fingerprint(texts[i], 2) ^ fingerprint(texts[j], 2)).bit_count() for i, j in pairs]
        near, found = near + len(pairs), found + sum(n <= 10 for n in apart)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        ids = {r.doc_id for r in representatives(df).select("doc_id").collect()}
        assert not any(i in ids and j in ids for (i, j), n in zip(pairs, apart, strict=True) if n <= 10)
        touched = {i for p in pairs for i in p}
        assert set(range(len(texts))) - ids <= touched
    assert near > 40 and found / near >= 0.95


def test_rows_that_the_filter_knows_by_chance_stay(spark, monkeypatch):
    """With one word of bits most rows are known to the filter, and the whole keys decide."""
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    rows = spark.range(400).select((F.col("id") % 300).alias("a"), F.lit("clash").alias("word"), F.lit("clash").alias("bits"))
    fates = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7 > 0).alias("stays"), F.when(F.col("id") < 100, 2).otherwise(1).alias("times"))
    out = [r.a for r in common.without(rows, fates, F.col("a")).collect()]
    assert sorted(out) == [i for i in range(300) if i % 7]
    none = fates.where("k < 0")
    assert common.without(rows, none, F.col("a")).count() == 400


def test_only_texts_with_candidates_move(spark, monkeypatch):
    """Of 300 texts the two near copies are fetched for their shingles."""
    fetched, flagged = [], common.flagged
    monkeypatch.setattr(similarity, "flagged", lambda df, names, wanted: fetched.append((names, flagged(df, names, wanted))) or fetched[-1][1])
    own = random.Random(9)
    texts = [" ".join(f"w{own.randrange(10**6)}" for _ in range(80)) for _ in range(299)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[7] + " more"])), "doc_id long, text string")
    assert kept(representatives(df)) == [(False, i) for i in range(299)]
    assert [n.where("known").count() for names, n in fetched if names == ["d", "t"]] == [2]
