import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash
from tidewell.llm.common import table
from tidewell.llm.components import components


def plain_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, near):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    comp = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, comp, strict=True))


def test_near_duplicates(spark, docs):
    for df in (docs, table(spark, "/root/testdata/sf0.01", "documents")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_dense_groups(spark):
    """Random fingerprints, a dense ball, and ladders; by buckets and by balls."""
    own = random.Random(5)
    centre = own.getrandbits(64)
    values = {own.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63}
    for _ in range(150):
        v = centre
        for b in own.sample(range(64), own.randint(0, 5)):
            v ^= 1 << b
        values.add(v)
    v = own.getrandbits(64)
    for _ in range(40):
        for b in own.sample(range(64), 3):
            v ^= 1 << b
        values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(enumerate(signed)), "d long, f long").repartition(5)
    want = plain_components(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    for options in ({}, {"parts": 2}, {"parts": 4}, {"parts": 5}, {"bucket_rows": 3}):
        edges = simhash.link(nodes, **options)
        got = list(range(len(values)))
        for r in components(edges).collect():
            got[r.node.d] = r.root.d
        assert got == want, options


def test_thresholds_are_unequal_and_sum_up():
    x = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    x[:250] &= np.uint64(0xFFFFFFFFFF)  # some partitions tell little
    bits = simhash._bits(x).astype(float)
    parts = simhash.correlated_partitions(bits.T @ bits, len(x), 3)
    assert sorted(b for p in parts for b in p) == list(range(64))
    chunks = simhash.Plan.chunked(parts)
    plan = simhash.Plan(parts, 3, simhash.Plan.histogram(chunks, x), len(x))
    t = plan.thresholds(x)
    assert (t.sum(1) == 3 - 3 + 1).all() and t.min() >= -1 and (t != t[:, :1]).any()


def test_components(spark):
    own = random.Random(3)
    pairs = [(own.randrange(400), own.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 800)]
    df = spark.createDataFrame(pairs, "u long, v long")
    root = list(range(800))
    for _ in range(800):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if all(root[a] == root[b] for a, b in pairs):
            break
    got = list(range(800))
    for r in components(df).collect():
        got[r.node] = r.root
    assert got == root
    assert components(df.limit(0)).collect() == []


def test_fingerprint_of_extremes():
    for t in ("", None, " ", "one", "one two", "A B c", "É Ü x", "w " * 70000, "a b c d", "a\x0bb\x1cc d"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
