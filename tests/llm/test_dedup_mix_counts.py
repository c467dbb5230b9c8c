import hashlib
import re
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, queries
from tidewell.llm.common import fresh_path, salted_lookup, table
from tidewell.llm.exact_dedup import exact_dedup, keep_first
from tidewell.llm.mixing import mix_documents, repeated, source_targets
from tidewell.llm.token_counts import Rollup, counted

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = Counter()
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i))
        for n, i in enumerate(ids):
            out[i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_dedup(docs):
    got = Counter(tuple(r) for r in exact_dedup(docs).collect())
    assert got == expected_dedup([(r.doc_id, r.text) for r in docs.collect()])
    colliding = exact_dedup(docs, digest=lambda c: F.lit("same"), salts=3)
    assert Counter(tuple(r) for r in colliding.collect()) == got
    assert exact_dedup(docs.limit(0)).collect() == []
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got.elements() if r[3])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    answer = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in answer.description]
    want = Counter(tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in answer.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(str(r[c]) for c in sorted(names)) for r in got.collect()) == want


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share, cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        total = sum(weight[s] for s in free)
        got = {s: left * weight[s] / total for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs):
    for df in (docs, table(spark, SF, "documents")):
        rows = mix_documents(df, range_bits=3).collect()
        plain = df.select("doc_id", "text", "source").collect()
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = Counter()
        for r in plain:
            sizes[r.source] += words(r.text)
        want = plain_targets(sizes)
        assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in rows) == sorted(
            (r.doc_id is None, r.doc_id or 0, words(r.text)) for r in plain
        )
        taken = Counter()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert r["taken"] == r["copies"] * r["size"] + r["cut"]
            taken[r["source"]] += r["taken"]
        for s, n in sizes.items():
            assert abs(taken[s] - want[s]) <= 0.5 + 1e-6, s
        assert sorted(map(str, mix_documents(df, range_bits=3).collect())) == sorted(map(str, rows))
    assert mix_documents(docs.limit(0)).collect() == []
    assert repeated(docs.select("doc_id", "text", "lang", "source")).columns == ["doc_id", "text", "lang", "source"]


def test_mixing_against_a_plain_cut(spark, docs):
    """The registered query's own parameters: taken, document by document, in the order of keys."""
    rows = docs.select("doc_id", "text", "source").collect()
    key = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, want = Counter(), Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    for s, target in plain_targets(sizes).items():
        own = sorted((key(r.doc_id), r.doc_id is not None, r.doc_id or 0, words(r.text)) for r in rows if r.source == s)
        budget = int(target + 0.5)
        epochs, left = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, named, i, size in own:
            cut = min(left, size)
            left -= cut
            want[i if named else None, size, epochs * size + cut] += 1
    assert Counter((r.doc_id, r["size"], r["taken"]) for r in mix_documents(docs).collect()) == want


def test_targets_when_all_or_none_are_capped(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 1000}, {"a": 10, "b": 10, None: 10}, {"a": 0, "b": 5}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_rollup(spark, docs):
    rollup = Rollup(spark, fresh_path(spark, "test-rollup"))
    items = counted(docs)
    assert rollup.totals().collect() == []
    assert rollup.commit("one", inserts=items)
    assert not rollup.commit("one", inserts=items)
    total = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    want = defaultdict(lambda: [0, 0])
    for r in items.collect():
        want[r["source"], r["lang"], r["tokenizer"]][0] += 1
        want[r["source"], r["lang"], r["tokenizer"]][1] += r["tokens"]
    assert total() == {k: tuple(v) for k, v in want.items()}
    assert rollup.deltas().count() == len(want) and rollup.ledger().count() == items.count()
    gone = items.where("item = 8 or item = 12345").select("item", "tokenizer")
    change = items.where("item = 6").dropDuplicates(["item", "tokenizer"]).withColumn("tokens", F.lit(100).cast("long"))
    assert rollup.commit("two", deletes=gone, revisions=change)
    for v, words in (("words@1", 30000), ("bytes@1", 150000)):
        n, tokens = want["a", "en", v]
        want["a", "en", v] = [n - 1, tokens - words]
    for v, words in (("words@1", 18), ("bytes@1", 100)):  # the row was there twice; its revision is one item
        n, tokens = want["b", "fr", v]
        want["b", "fr", v] = [n - 1, tokens - words + 100]
    assert total() == {k: tuple(v) for k, v in want.items()}
    assert rollup.compact() and not rollup.compact()
    assert rollup.deltas().count() == len(want) and total() == {k: tuple(v) for k, v in want.items()}
    assert rollup.commit("three", deletes=items.select("item", "tokenizer"))
    left = total()  # items without an id can't be deleted
    assert left == {("a", "en", "words@1"): (1, 5), ("a", "en", "bytes@1"): (1, 19)}
    assert rollup.committed() == ["one", "three", "two"]
    assert rollup.commit("none", inserts=items.limit(0)) and total() == left


def test_rollup_events_of_one_batch(spark):
    """Null counts and items, and a revision or a delete of an item that its own batch inserts."""
    rollup = Rollup(spark, fresh_path(spark, "test-rollup"))
    schema = "item long, source string, lang string, tokenizer string, tokens long"
    new = spark.createDataFrame([(1, "a", "x", "t", 5), (2, "a", "x", "t", None), (None, "a", None, "t", 7), (3, "a", "x", "t", 1)], schema)
    change = spark.createDataFrame([(1, "b", "x", "t", 9)], schema)
    assert rollup.commit("one", inserts=new, revisions=change, deletes=spark.createDataFrame([(3, "t")], "item long, tokenizer string"))
    total = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert total() == {("a", "x", "t"): (1, 0), ("a", None, "t"): (1, 7), ("b", "x", "t"): (1, 9)}
    assert rollup.commit("two", revisions=spark.createDataFrame([(1, "a", "x", "t", 2), (77, "a", "x", "t", 1)], schema))
    assert total() == {("a", "x", "t"): (3, 3), ("a", None, "t"): (1, 7)}


def test_rollup_with_two_writers(spark):
    """Of two writers of one batch one wins, and its rows alone count."""
    path = fresh_path(spark, "test-rollup")
    schema = "item long, source string, lang string, tokenizer string, tokens long"
    one, two = Rollup(spark, path), Rollup(spark, path)
    published = one._publish
    def late(*args):  # the other writer finishes between this one's check and its marker
        assert two.commit("b", inserts=spark.createDataFrame([(1, "s", "l", "t", 5)], schema))
        return published(*args)

    one._publish = late
    assert not one.commit("b", inserts=spark.createDataFrame([(1, "s", "l", "t", 5), (2, "s", "l", "t", 6)], schema))
    assert [tuple(r) for r in two.totals().collect()] == [("s", "l", "t", 1, 5)] and two.committed() == ["b"]


def test_counts_by_the_encoder(spark, docs):
    """A version of the byte-level BPE tokenizer beside the others, in one pass; extra columns stay."""
    import public_tokenizers
    import tiktoken

    vocabulary = queries.public_vocabulary()
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(), special_tokens={})
    got = counted(docs, versions=("words@1",), vocabularies={"bpe50k@1": vocabulary}).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    assert len(got) == 2 * docs.count()
    for r in got:
        if r.tokenizer == "bpe50k@1":
            assert r.tokens in {len(truth.encode_ordinary(t or "")) for t in texts[r["item"]]}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r.tokens in {words(t) for t in texts[r["item"]]} for r in got if r.tokenizer == "words@1")


def test_salted_lookup(spark):
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(90, None)], "i long, k long")
    right = spark.createDataFrame([(7, "seven"), (0, "zero")], "k long, v string")
    got = {r.i: r.v for r in salted_lookup(left, "k", F.col("i"), right, "left").collect()}
    assert got == {r.i: {7: "seven", 0: "zero"}.get(r.k) for r in left.collect()}
    assert salted_lookup(left, "k", F.col("i"), right).count() == 61


def test_keep_first_moves_only_texts_with_copies(spark, monkeypatch):
    """Of 1000 texts the 20 with copies reach the shuffles of whole texts; a filter that knows all rows changes nothing."""
    module, sent = sys.modules["tidewell.llm.exact_dedup"], []
    monkeypatch.setattr(module, "exact_dedup", lambda df, *a: sent.append(df.count()) or exact_dedup(df, *a))
    rows = [(i, f"text  {i}") for i in range(1000)] + [(2000 + i, f"text\t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in keep_first(df).collect()) == list(range(1000))
    assert sent == [40]
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert sorted(r.doc_id for r in keep_first(df).collect()) == list(range(1000))
