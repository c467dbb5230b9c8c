"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: one bit per bit position that over half of a text's shingle
hashes have set.  Linking: the 64 positions are split into ``parts`` partitions,
correlated positions together; a fingerprint gets a threshold for each of them,
unequal, at least -1 and summing to distance - parts + 1.  If two fingerprints
differ in at most ``distance`` bits then in some partition they differ in at
most its threshold, so probing each partition's values within the threshold
finds every link.  The thresholds come from dynamic programming over estimated
candidate counts, from exact histograms of all fingerprints.  Candidates are
verified where they meet and leave as a spanning forest, never as all pairs.

How many partitions there are is chosen by the same costs: more of them take
fewer probes, fewer of them keep the candidates of a large table few.

A bucket that more than ``bucket_rows`` fingerprints share is handled without
comparing its members in one task.  For a distance of up to 4, each member sends
itself to the values within floor(distance / 2) and within ceil(distance / 2)
bits of it; two are within the distance if and only if one's first ball meets
the other's second, so a value that has any member of the first kind joins all
its members.  That is linear in the members.  For larger distances the balls are
too large: members are compared to their bucket's least one, and what that
leaves unconnected in a bucket is compared in blocks, each member visiting all
blocks of its bucket.  Neither way loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, salted_lookup, without, written
from .components import components
from .similarity import shingles, similar_components

BITS = 64
NO_ID = 2**63 - 1


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text, as an unsigned integer.

    A-Z are lower-cased; words are runs of other than ASCII white space;
    shingles are space-joined runs of ``shingle`` words, repeats included, or the
    whole sequence if there are fewer words.  No words give 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    digest = xxhash.xxh64_intdigest
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):  # bounded memory for very long texts
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[shingle - 1 :][at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(starts)).tobytes(), "big")


def with_fingerprints(df: DataFrame, text_col: str, out_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with the fingerprint of ``text_col`` as a signed long in ``out_col``."""
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks.view(np.int64))], [*names, out_col])

    from pyspark.sql.types import LongType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out_col, LongType()))


def _bits(x: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones, lowest bit first."""
    return np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(df: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all rows of ``count(fingerprints)``, an array of ``size`` longs.

    Each task adds up its own; the driver sees ``size`` rows, whatever the input.
    """

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                total += count(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["n"])

    rows = df.mapInArrow(run, "n array<long>").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["pos"]] = r["n"]
    return out


def correlated_partitions(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Split the bit positions into ``parts`` near-equal partitions, correlated ones together.

    ``together`` is the 64 x 64 matrix of counts of both bits set.  Each
    partition starts from the free position that is most correlated with the
    others and takes those most correlated with what it has.
    """
    p = together / max(total, 1)
    mean = np.diag(p)
    var = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(p - np.outer(mean, mean)) / np.outer(var, var)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].sum(), -b)))
            free.remove(group[-1])
        out.append(sorted(group))
    return out


def _values(x: np.ndarray, positions: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for j, b in enumerate(positions):
        out |= (((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64)) << j
    return out


def _masks(width: int, most: int) -> np.ndarray:
    """All values of at most ``most`` set bits among ``width``, fewest first."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)


def _ball(width: int, most: int) -> int:
    return sum(comb(width, k) for k in range(most + 1))


class Plan:
    """Partitions, and the statistics that thresholds are allocated from."""

    #: Cost of sending a probe, against that of comparing a candidate.
    PROBE, CANDIDATE = 100.0, 1.0

    def __init__(self, partitions: list[list[int]], distance: int, hist: np.ndarray, total: int):
        self.partitions, self.distance = partitions, distance
        self.chunks = self.chunked(partitions)
        self.near: list[list[np.ndarray]] = []
        self.shares: list[list[np.ndarray]] = []
        at = 0
        values = np.arange(256, dtype=np.uint8)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        for own in self.chunks:
            tables, shares = [], []
            for _ in own:
                share = hist[at : at + 256] / max(total, 1)
                at += 256
                shares.append(share)
                tables.append(np.stack([(share[None, :] * (apart == d)).sum(1) for d in range(distance + 1)], axis=1))
            self.near.append(tables)
            self.shares.append(shares)
        self.total = total

    def mean_cost(self) -> float:
        """The least cost of a fingerprint whose chunks' distances to the others are as they are on average."""
        found = []
        for own, tables, shares in zip(self.chunks, self.near, self.shares, strict=True):
            dist = np.zeros(self.distance + 1)
            dist[0] = 1
            for _, table, share in zip(own, tables, shares, strict=True):
                dist = np.convolve(dist, share @ table)[: self.distance + 1]
            found.append(np.cumsum(dist)[None, :] * self.total)
        return float(self._allocated(found)[0][0, -1])

    @staticmethod
    def chunked(partitions: list[list[int]]) -> list[list[list[int]]]:
        return [[p[i : i + 8] for i in range(0, len(p), 8)] for p in partitions]

    @staticmethod
    def histogram(chunks: list[list[list[int]]], x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_values(x, c), minlength=256) for own in chunks for c in own])

    def _allocated(self, found: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Least costs by what is spent (each threshold counted from -1), and the choices that reach them.

        ``found`` has, for each partition, the expected candidates of each fingerprint by threshold.
        """
        tau, n = self.distance, len(found[0])
        budget = tau + 1
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        choice = []
        for positions, candidates in zip(self.partitions, found, strict=True):
            sent = np.array([_ball(len(positions), k) for k in range(tau + 1)], float)
            cost = np.concatenate([np.zeros((n, 1)), self.PROBE * sent[None, :] + self.CANDIDATE * candidates], axis=1)
            new, took = np.full_like(best, np.inf), np.zeros((n, budget + 1), np.int8)
            for s in range(budget + 1):
                for t in range(s + 1):
                    c = best[:, s - t] + cost[:, t]
                    better = c < new[:, s]
                    new[better, s], took[better, s] = c[better], t
            best = new
            choice.append(took)
        return best, choice

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """Per fingerprint and partition, a threshold of -1 or more; the cheapest allocation.

        The expected number of fingerprints within t bits in a partition comes
        from the exact histograms of its 8-bit chunks, taken as independent.
        """
        tau, m, n, found = self.distance, len(self.partitions), len(x), []
        for own, tables in zip(self.chunks, self.near, strict=True):
            dist = np.zeros((n, tau + 1))
            dist[:, 0] = 1
            for c, table in zip(own, tables, strict=True):
                p = table[_values(x, c)]
                dist = np.stack([(dist[:, : d + 1] * p[:, d::-1]).sum(1) for d in range(tau + 1)], axis=1)
            found.append(np.cumsum(dist, axis=1) * self.total)
        _, choice = self._allocated(found)
        out, left, rows = np.zeros((n, m), np.int64), np.full(n, tau + 1), np.arange(n)
        for i in reversed(range(m)):
            out[:, i] = choice[i][rows, left]
            left = left - out[:, i]
        return out - 1


def probes(nodes: DataFrame, plan: Plan) -> DataFrame:
    """The buckets of each node (d, f): (part, key, d, f, kind); kind 1 is own value, 2 probe, 3 both."""

    def run(batches):
        masks = {}
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(0).to_numpy(zero_copy_only=False)
            f = b.column(1).to_numpy(zero_copy_only=False)
            x = f.view(np.uint64)
            limits = plan.thresholds(x)
            for i, positions in enumerate(plan.partitions):
                own = _values(x, positions)
                for t in np.unique(limits[:, i]).tolist():
                    rows = np.flatnonzero(limits[:, i] == t)
                    if (len(positions), t) not in masks:
                        masks[len(positions), t] = _masks(len(positions), max(t, 0))
                    m = masks[len(positions), t]
                    kinds = np.full(len(m), 2, np.int8)
                    kinds[0] = 3 if t >= 0 else 1
                    step = max(1, 200_000 // len(m))
                    for at in range(0, len(rows), step):
                        r = rows[at : at + step]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(r) * len(m), i, np.int8)),
                                pa.array((own[r][:, None] ^ m[None, :]).ravel()),
                                pa.array(np.repeat(d[r], len(m))),
                                pa.array(np.repeat(f[r], len(m))),
                                pa.array(np.tile(kinds, len(r))),
                            ],
                            ["part", "key", "d", "f", "kind"],
                        )

    return nodes.select("d", "f").mapInArrow(lean(run), "part byte, key long, d long, f long, kind byte")


class _Forest:
    """Links of a task, kept as no more than a spanning forest; one that outgrows ``MOST`` leaves in pieces."""

    MOST = 2_000_000

    def __init__(self):
        self.pairs: list[tuple[np.ndarray, ...]] = []
        self.held, self.limit = 0, self.MOST

    def add(self, da, fa, db, fb):
        self.pairs.append((da, fa, db, fb))
        self.held += len(da)
        if self.held > self.limit:
            self.pairs = [self.edges()]
            self.held = len(self.pairs[0][0])
            self.limit = max(self.MOST, 2 * self.held)

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The forest, if it has over ``least`` links; it is empty after that."""
        if self.held <= least:
            return
        out = self.edges()
        self.__init__()
        for at in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in out], ["ud", "uf", "vd", "vf"])

    def edges(self) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        if not self.pairs:
            return none, none, none, none
        da, fa, db, fb = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        f, first, at = np.unique(np.concatenate([fa, fb]), return_index=True, return_inverse=True)
        d = np.concatenate([da, db])[first]
        a, b = at[: len(fa)], at[len(fa) :]
        label = np.arange(len(f))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(f)))
        return d[own], f[own], d[label[own]], f[label[own]]


def _links(distance: int):
    """Compare what meets in each bucket; rows come sorted by bucket."""

    def group(forest: _Forest, d, f, kind):
        has, asks = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
        x = f.view(np.uint64)
        for at in range(0, len(asks), max(1, 2_000_000 // max(1, len(has)))):
            p = asks[at : at + max(1, 2_000_000 // max(1, len(has)))]
            i, j = np.nonzero(np.bitwise_count(x[p][:, None] ^ x[has][None, :]) <= distance)
            i, j = p[i], has[j]
            ok = f[i] != f[j]
            forest.add(d[i[ok]], f[i[ok]], d[j[ok]], f[j[ok]])

    def scan(forest: _Forest, part, key, d, f, kind):
        new = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.concatenate((new, [len(part)])))
        for at, n in zip(new[size > 48].tolist(), size[size > 48].tolist(), strict=True):
            group(forest, d[at : at + n], f[at : at + n], kind[at : at + n])
        group_of = np.repeat(np.arange(len(new)), size)
        small = np.flatnonzero((size > 1)[group_of] & (size <= 48)[group_of])  # the small buckets, all at once
        x, g = f.view(np.uint64), group_of
        for k in range(1, int(size[size <= 48].max(initial=1))):
            i, j = small[:-k], small[k:]
            i, j = i[g[i] == g[j]], j[g[i] == g[j]]
            meet = ((kind[i] & 1) & (kind[j] >> 1)) | ((kind[i] >> 1) & (kind[j] & 1))
            ok = (meet != 0) & (f[i] != f[j]) & (np.bitwise_count(x[i] ^ x[j]) <= distance)
            forest.add(d[i[ok]], f[i[ok]], d[j[ok]], f[j[ok]])

    def run(batches):
        forest, kept = _Forest(), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
            part, key = rows[0], rows[1]
            last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                scan(forest, *(x[:cut] for x in rows))
                yield from forest.batches(_Forest.MOST)
            kept = [x[cut:] for x in rows]
        if kept is not None and len(kept[0]):
            scan(forest, *kept)
        yield from forest.batches()

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ball_links(members: DataFrame, distance: int) -> DataFrame:
    """Links within ``distance`` bits among ``members`` (d, f), by midpoints; linear in the members."""
    small, large = distance // 2, -(-distance // 2)
    rings = [[_signed(sum(1 << b for b in c)) for c in combinations(range(BITS), k)] for k in range(large + 1)]
    near = F.array(*[F.lit(m) for ring in rings[: small + 1] for m in ring])
    far = [F.lit(m) for m in rings[large]] if large > small else []
    sent = [F.transform(near, lambda m: F.struct(F.col("f").bitwiseXOR(m).alias("z"), F.lit(True).alias("near")))]
    if far:
        sent.append(F.transform(F.array(*far), lambda m: F.struct(F.col("f").bitwiseXOR(m).alias("z"), F.lit(False).alias("near"))))
    spread = members.distinct().select(F.struct("d", "f").alias("n"), F.explode(F.concat(*sent)).alias("b"))
    # A value has at most as many distinct members as its ball has values, so these lists are bounded.
    met = spread.groupBy("b.z").agg(F.min(F.when(F.col("b.near"), F.col("n"))).alias("v"), F.collect_list("n").alias("all"))
    out = met.where("v is not null and size(all) > 1").select("v", F.explode("all").alias("u")).where("u.f != v.f")
    return out.select("u", "v").distinct()


def _crossed(distance: int):
    """Compare the fingerprints of each block; rows come sorted by bucket and block, those at home first."""

    def compare(forest, home, d, f, root):
        hd, hf, hr = home
        step = max(1, 2_000_000 // max(1, len(hf)))
        for at in range(0, len(f), step):
            x, r = f[at : at + step], root[at : at + step]
            i, j = np.nonzero((np.bitwise_count(x.view(np.uint64)[:, None] ^ hf.view(np.uint64)[None, :]) <= distance) & (r[:, None] != hr[None, :]))
            forest.add(d[at + i], x[i], hd[j], hf[j])

    def run(batches):
        forest, now, home = _Forest(), None, []
        for b in batches:
            part, key, block, guest, d, f, root = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (guest[1:] != guest[:-1])) + 1
            for start, stop in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if start == stop:
                    continue
                own = (int(part[start]), int(key[start]), int(block[start]))
                if own != now:
                    now, home = own, []
                some = (d[start:stop], f[start:stop], root[start:stop])
                if not guest[start]:
                    compare(forest, some, *some)
                    for h in home:
                        compare(forest, h, *some)
                    home.append(some)
                else:
                    for h in home:
                        compare(forest, h, *some)
            yield from forest.batches(_Forest.MOST)
        yield from forest.batches()

    return run


def _block_links(members: DataFrame, distance: int, block: int) -> DataFrame:
    """Links within ``distance`` bits among the members (part, key, d, f) of each bucket, by stars and blocks."""
    bucket = ["part", "key"]
    members, _ = written(members.select(*bucket, F.struct("d", "f").alias("n")).distinct(), "hot-members")
    heads = members.groupBy(*bucket).agg(F.min("n").alias("v"), F.count("*").alias("size"))
    heads, _ = written(heads, "hot-buckets")  # at most parts * total / bucket_rows rows
    close = F.bit_count(F.col("n.f").bitwiseXOR(F.col("v.f"))) <= distance
    met = members.join(heads, bucket)
    stars, _ = written(met.where(close & (F.col("n") != F.col("v"))).select(F.col("n").alias("u"), "v").distinct(), "hot-stars")
    roots = components(stars).withColumnRenamed("node", "n")
    known, _ = written(met.select(*bucket, "n", "size").join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")["f"]), "hot-roots")
    mixed = known.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    mixed, _ = written(mixed.select(*bucket), "hot-mixed")
    blocks = F.ceil(F.col("size") / block).cast("int")
    each = known.join(mixed, bucket, "left_semi").select(*bucket, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("n"), blocks).alias("home"), "n", "root")
    dealt = each.select(*bucket, "block", (F.col("home") != F.col("block")).alias("guest"), "n.d", "n.f", "root")
    dealt = dealt.repartition(*bucket, "block").sortWithinPartitions(*bucket, "block", "guest")
    return stars.unionByName(_edges(dealt.mapInArrow(lean(_crossed(distance)), EDGES)))


EDGES = "ud long, uf long, vd long, vf long"


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.struct(F.col("ud").alias("d"), F.col("uf").alias("f")).alias("u"),
        F.struct(F.col("vd").alias("d"), F.col("vf").alias("f")).alias("v"),
    )


def best_plan(x: DataFrame, total: int, distance: int, parts: int | None = None) -> Plan:
    """The plan of least expected cost, by exact counts over all fingerprints ``x`` (one column)."""
    together = _summed(x, lambda v: (lambda m: (m.T @ m).astype(np.int64).ravel())(_bits(v).astype(np.float32)), BITS * BITS)
    together = together.reshape(BITS, BITS)
    tried = [parts] if parts else list(range(1 if distance < 2 else 2, min(distance + 1, 8) + 1))
    splits = [correlated_partitions(together, total, m) for m in tried]
    chunks = [Plan.chunked(p) for p in splits]
    lengths = [256 * sum(map(len, c)) for c in chunks]
    hist = _summed(x, lambda v: np.concatenate([Plan.histogram(c, v) for c in chunks]), sum(lengths))
    ends = np.cumsum(lengths)
    plans = [Plan(p, distance, hist[end - n : end], total) for p, n, end in zip(splits, lengths, ends, strict=True)]
    return min(plans, key=Plan.mean_cost)


def link(nodes: DataFrame, distance: int = 3, parts: int | None = None, bucket_rows: int = 16384, block: int = 8192) -> DataFrame:
    """Links between nodes (d, f; f unique) that differ in at most ``distance`` bits.

    Returns edges (u, v) of structs (d, f), a subset of the links that connects
    whatever all links connect.  ``parts`` fixes the number of partitions.
    """
    total = nodes.count()
    plan = best_plan(nodes.select("f"), total, distance, parts)
    rows = probes(nodes, plan)
    edges = None
    if total > bucket_rows:  # else no bucket can be larger

        def owns(batches):
            for b in batches:
                v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for i, positions in enumerate(plan.partitions):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int8)), pa.array(_values(v, positions))], ["part", "key"])

        sizes = nodes.select("f").mapInArrow(owns, "part byte, key long").groupBy("part", "key").count()
        # At most parts * total / bucket_rows buckets; as a written table its size decides how it is joined.
        hot, _ = written(sizes.where(F.col("count") > bucket_rows).select("part", "key"), "hot")
        if not hot.isEmpty():
            crowd = rows.join(hot, ["part", "key"], "left_semi")
            edges = _ball_links(crowd.select("d", "f"), distance) if distance <= 4 else _block_links(crowd, distance, block)
            rows = rows.join(hot, ["part", "key"], "left_anti")
    dealt = rows.repartition("part", "key").sortWithinPartitions("part", "key")
    found = _edges(dealt.select("part", "key", "d", "f", "kind").mapInArrow(lean(_links(distance)), EDGES))
    return found if edges is None else found.unionByName(edges)


def classes(marked: DataFrame, id_col: str, mark: str, **options) -> DataFrame:
    """(f, id, root): each distinct fingerprint, its least id, and the least id reachable.

    ``marked`` has ``id_col`` and ``mark``, the fingerprints; it is read more
    than once, so it should be a written table.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    nodes = marked.groupBy(F.col(mark).alias("f")).agg(F.min(ids).alias("d"))
    nodes, _ = written(nodes.select("d", "f"), "nodes")
    roots = components(link(nodes, **options))
    own = F.struct("d", "f")
    # Edges hold a node at most once as ``node``.
    return nodes.withColumn("node", own).join(roots, "node", "left").select(
        "f", "d", F.coalesce(F.col("root"), own).alias("root")
    )


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The near-duplicate component of each row.

    Returns one row per input row: ``id_col``, ``fingerprint`` (16 hex digits)
    and ``component_id``, the smallest id reachable over links, the row's own
    included.  Null or wordless texts have fingerprint 0 and are linked like any
    other; null ids count as larger than any id, and a component of nothing else
    has a null component_id.  Repeated rows and ids are allowed.  Other columns
    are not read.  An empty table gives an empty result.
    """
    marked, _ = written(
        with_fingerprints(df.select(id_col, text_col), text_col, "_f").select(id_col, F.col("_f").alias("f")), "fingerprints"
    )
    known = classes(marked, id_col, "f", **options)
    out = salted_lookup(marked, "f", F.col(id_col), known.select("f", "root"))
    root = F.col("root.d")
    return out.select(
        id_col,
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.when(root != NO_ID, root).alias("component_id"),
    )


def _sketched(rows: DataFrame, shingle: int) -> DataFrame:
    """(d, t, f, size, mark) of (d, t, text): f is a digest of the set of five-word shingles, size its number."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, size, mark = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64)
            for i, text in enumerate(b.column(2)):
                own = shingles(text.as_py())
                f[i], size[i], mark[i] = xxhash.xxh64_intdigest(own.tobytes()), len(own), fingerprint(text.as_py(), shingle)
            more = [pa.array(f.view(np.int64)), pa.array(size), pa.array(mark.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], ["d", "t", "f", "size", "mark"])

    return rows.mapInArrow(lean(run), "d long, t long, f long, size long, mark long")


def representatives(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = 0.8, shingle: int = 2, distance: int = 10, **options
) -> DataFrame:
    """The rows of ``df`` that stay: of each component of near copies the row with the smallest id.

    Candidates are the components of SimHash fingerprints, of ``shingle`` words,
    that lie within ``distance`` bits; inside them texts are near copies if the
    Jaccard similarity of their sets of five-word shingles is ``similarity`` or
    more, exactly.  Equal sets are near copies whatever their fingerprints.
    Wordless and null texts are copies of each other and of nothing else; null
    ids count as larger than any id; of rows repeated with one id and text one
    stays.  ``df`` is read more than once, so it should be a written table; all
    its columns are kept, whatever their names.  An empty table gives an empty
    result.
    """
    d, t = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text_col)
    rows = df.select(d.alias("d"), t.alias("t"), F.col(text_col).alias("text"))
    marked, _ = written(_sketched(rows, shingle), "sketches")
    nodes = marked.groupBy("f").agg(F.min(F.struct("d", "t")).alias("low"), F.max("size").alias("size"), F.min("mark").alias("mark"))
    nodes, _ = written(nodes.select(F.struct("low.d", "f", "low.t").alias("n"), "size", "mark"), "nodes")
    known, _ = written(classes(nodes.select(F.col("n.d").alias("d"), "mark"), "d", "mark", distance=distance, **options), "classes")
    bucketed = salted_lookup(nodes, "mark", F.col("n"), known.select(F.col("f").alias("mark"), F.col("root.f").alias("key")))
    roots = similar_components(bucketed.select("n", "size", "key"), rows, similarity)
    fate = nodes.select("n").join(roots.withColumnRenamed("node", "n"), "n", "left").select("n.f", F.coalesce("root", "n").alias("root"))
    own = (F.col("root.d") == F.col("d")) & (F.col("root.t") == F.col("t"))
    fates = salted_lookup(marked.select("d", "t", "f"), "f", F.col("d"), fate)
    fates = fates.groupBy("d", "t").agg(F.first(own).alias("stays"), F.count("*").alias("times"))
    return without(df, fates, d, t)
