"""Exact similarity of word shingles inside buckets of candidates.

Two texts are similar if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.  Candidates come in buckets, as SimHash components
are.  Each bucket first compares all its nodes to its least one.  What these
links leave in different components of one bucket is then compared set by set,
in blocks: each set visits every block of its bucket and links leave as a
forest, so no pair is ever moved.  A bucket of copies is linear, others take a
visit per ``BLOCK`` sets; no link of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, lean, salted_lookup, written
from .components import components
#: About how many sets of a bucket a task holds while the bucket's others visit.
BLOCK = 500


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    Words and shingles are those of ``simhash.fingerprint``.  No words give none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(starts)))


def _sets(rows: DataFrame) -> DataFrame:
    """(f, hashes) of (f, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # row by row: the sets are larger than the texts
                hashes = shingles(b.column(1)[i].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([hashes], pa.list_(pa.int64()))], ["f", "hashes"])

    return rows.mapInArrow(lean(run), "f long, hashes array<long>")


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether sets of these sizes can be that similar."""
    return (F.least(a, b) > 0) & (F.least(a, b) >= similarity * F.greatest(a, b))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v; each u once) whose sets are similar enough."""
    pairs = pairs.withColumn("uf", F.col("u.f")).withColumn("vf", F.col("v.f"))
    own = flagged(sets, ["f"], pairs.select("uf")).where("known")
    one = pairs.join(own.select(F.col("f").alias("uf"), F.col("hashes").alias("a")), "uf")
    two = salted_lookup(one, "vf", F.col("uf"), sets.select(F.col("f").alias("vf"), F.col("hashes").alias("b")))
    both = F.size(F.array_intersect("a", "b"))
    return two.where(both >= similarity * (F.size("a") + F.size("b") - both)).select("u", "v")


class _Block:
    """The sets at home in a block, and which of them are known to be connected."""

    def __init__(self, similarity: float):
        self.similarity, self.home, self.up = similarity, [], {}
        self.hashes = None

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def compare(self, node: tuple, root: int, hashes: np.ndarray) -> Iterator[tuple]:
        """Links of a set to those at home; none where a component has them already."""
        if self.hashes is None:
            self.sizes = np.array([len(h) for _, _, h in self.home])
            flat, owner = np.concatenate([h for _, _, h in self.home]), np.repeat(np.arange(len(self.home)), self.sizes)
            order = np.argsort(flat, kind="stable")
            self.hashes, self.owner = flat[order], owner[order]
        low, high = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.home))
        for i in np.flatnonzero((both > 0) & (both >= self.similarity * (self.sizes + len(hashes) - both))).tolist():
            other, its, _ = self.home[i]
            a, b = self.root(root), self.root(its)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                yield (*node, *other)


def _crossed(similarity: float):
    """Compare the sets of each block; rows come sorted by block, those at home first."""
    names = ["ud", "uf", "ut", "vd", "vf", "vt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None

        def own():
            return [x for h in (block.home if block else []) for x in block.compare(*h)]

        for b in batches:
            key, part, guest, d, f, t, root = (b.column(i).to_pylist() for i in range(7))
            found = []
            for i in range(b.num_rows):
                if (key[i], part[i]) != now:
                    found += own()
                    now, block = (key[i], part[i]), _Block(similarity)
                one = (d[i], f[i], t[i]), root[i], b.column(7)[i].values.to_numpy(zero_copy_only=False)
                if not guest[i]:
                    block.home.append(one)
                elif block.home:
                    found += block.compare(*one)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(6)], names)
        found = own()
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(6)], names)

    return run


def similar_components(nodes: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the components that the similar pairs of each bucket make; roots have no row.

    ``nodes`` has n (struct of d, f and t; f unique), size and key, its bucket;
    ``rows`` the texts, by d and t.
    """
    listed = nodes.select("n", "size", "key")
    least = listed.groupBy("key").agg(F.min(F.struct("n", "size")).alias("_v"), F.count("*").alias("members")).where("members > 1")
    met = salted_lookup(listed, "key", F.col("n.f"), least)
    met, _ = written(met.select("key", "n", "size", F.col("_v.n").alias("v"), F.col("_v.size").alias("v_size"), "members"), "buckets")
    asked, _ = written(met.select("n.d", "n.t", "n.f").distinct(), "asked")  # small ones are broadcast, as their size is known
    near = flagged(rows, ["d", "t"], asked.select("d", "t")).where("known").drop("known")
    sets, _ = written(_sets(near.join(asked, ["d", "t"]).select("f", "text").dropDuplicates(["f"])), "sets")
    stars = met.where((F.col("n") != F.col("v")) & _alike("size", "v_size", similarity)).select(F.col("n").alias("u"), "v").distinct()
    stars, _ = written(stars, "pairs")
    found, _ = written(_verified(stars, sets, similarity), "stars")
    # A node has one bucket, so its star's centre is its root so far.
    known = met.join(found.select(F.col("u").alias("n"), F.col("v").alias("root")), "n", "left").withColumn("root", F.coalesce("root", "n"))
    known, _ = written(known, "known")
    mixed = known.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low != _high")
    open_, _ = written(salted_lookup(known, "key", F.col("n.f"), mixed.select("key")), "open")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = open_.join(sets, open_["n.f"] == sets["f"]).select(
        "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), (F.pmod(F.xxhash64("n"), blocks)).alias("home"), "n", "root", "hashes"
    )
    dealt = dealt.select("key", "block", (F.col("home") != F.col("block")).alias("guest"), "n.d", "n.f", "n.t", F.xxhash64("root").alias("root"), "hashes")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "guest")
    made = dealt.mapInArrow(lean(_crossed(similarity)), "ud long, uf long, ut long, vd long, vf long, vt long")
    node = lambda x: F.struct(F.col(x + "d").alias("d"), F.col(x + "f").alias("f"), F.col(x + "t").alias("t")).alias(x)
    more, _ = written(made.select(node("u"), node("v")).distinct(), "more")
    if more.isEmpty():
        return found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return components(found.unionByName(more))
