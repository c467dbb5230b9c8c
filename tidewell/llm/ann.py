"""Approximate nearest neighbours: an inverted multi-index.

The two halves of a vector are quantised separately, each to one of ``k``
centroids; a vector's cell is its pair of centroids.  A query visits cells in
the order of summed distance (for the inner product: the least summed negative
product of its halves with the centroids), walked with a heap, until the
visited cells hold a share of all rows.  Only entries of visited cells are
reranked by the exact score, and the best ``top`` stay.

The share is calibrated: the least of ``SHARES`` whose cells hold ``recall`` of
the true neighbours of some queries among a bounded sample of rows.  Vectors that
cluster need few cells; those that hardly do need many.

Rows with equal vectors are one entry, which keeps only the ``top`` + 1
smallest ids: no query can return more of them, so nothing is lost and a vector
that a third of all rows share costs no more than another.

Entries are dealt to shards, runs of neighbouring first centroids that hold
about ``block`` rows, the fuller ones in several blocks; a query goes to the
shards that its cells lie in.  A task holds one block and streams the queries
past it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARES = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)
#: Cells of a row of the walk that leave the heap together.
TILE = 32
#: Queries of the calibration.
ASKED = 200


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of ``x``; at most as many as there are distinct rows."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    own = np.random.default_rng(seed)
    centre = x[own.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The nearest centroid of each row; the distances of ``rows`` rows are held at once."""
    norms, out = (centre**2).sum(1), np.empty(len(x), np.int64)
    for at in range(0, len(x), rows):
        out[at : at + rows] = np.argmin(norms - 2 * (x[at : at + rows] @ centre.T), axis=1)
    return out


def visits(first: np.ndarray, second: np.ndarray, held: np.ndarray, need: float) -> np.ndarray:
    """How far each row of cells is visited until ``need`` rows are held: cells by increasing summed distance.

    ``first`` and ``second`` are the distances of a query's halves to the
    centroids, ``held`` the rows of each cell.  Row i of the result counts the
    visited cells of first centroid i, which are the nearest by ``second``.  The
    heap holds the next tile of each row that the walk has reached, and a row is
    reached when the row before it is, so it never holds more than one a row.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    k = len(sb)
    starts = range(0, k, TILE)
    tiles = np.add.reduceat(held.take(a, axis=0).take(b, axis=1), starts, axis=1).tolist()
    heap, got, depth = [(fa[0] + sb[0], 0, 0)], 0, [0] * len(fa)
    while heap and got < need:
        _, i, t = heap[0]
        got += tiles[i][t]
        depth[i] = t + 1
        if t + 1 < len(starts):
            heapq.heapreplace(heap, (fa[i] + sb[starts[t + 1]], i, t + 1))
        else:
            heapq.heappop(heap)
        if t == 0 and i + 1 < len(fa):
            heapq.heappush(heap, (fa[i + 1] + sb[0], i + 1, 0))
    out = np.zeros(len(fa), np.int32)
    out[a] = np.minimum(np.array(depth) * TILE, k)
    return out


class Index:
    """Centroids and the directory of cells (``k`` squared counts); fixed size."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray], dim: int):
        self.centres, self.dim, self.half = centres, dim, dim // 2
        self.held = np.zeros((len(centres[0]), len(centres[1])), np.int64)
        self.share = 1.0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.centres[0]), nearest(x[:, self.half :], self.centres[1])

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves to the centroids; the same wherever they are computed."""
        return -(self.centres[0] * q[None, : self.half]).sum(1), -(self.centres[1] * q[None, self.half :]).sum(1)

    def calibrate(self, x: np.ndarray, top: int, recall: float) -> None:
        """Set the least share that keeps ``recall`` of the true neighbours of the first rows among all of ``x``."""
        i, j = self.cells(x)
        wanted, within = min(top, len(x) - 1), np.zeros(len(SHARES), np.int64)
        asked = x[:ASKED]
        for n, q in enumerate(asked):
            exact = x @ q
            exact[n] = -np.inf
            by_cell = (self.centres[0] @ q[: self.half])[i] + (self.centres[1] @ q[self.half :])[j]
            place = np.empty(len(x), np.int64)
            place[np.argsort(-by_cell, kind="stable")] = np.arange(len(x))
            true = place[np.argsort(-exact, kind="stable")[:wanted]]
            within += [(true < s * len(x)).sum() for s in SHARES]
        found = within / max(1, wanted * len(asked))
        self.share = next((s for s, held in zip(SHARES, found, strict=True) if wanted > 0 and held >= recall), 1.0)

    def deal(self, block: int) -> None:
        """Shards of neighbouring first centroids with about ``block`` rows, and how many blocks each has."""
        rows = self.held.sum(1)
        away = self.centres[0] - self.centres[0].mean(0)
        order = np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")
        self.shard, self.place = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        self.members: list[np.ndarray] = [[]]
        full = 0
        for i in order.tolist():
            if full and full + rows[i] > block:
                self.members.append([])
                full = 0
            self.shard[i], self.place[i] = len(self.members) - 1, len(self.members[-1])
            self.members[-1].append(i)
            full += rows[i]
        self.members = [np.array(m, np.int64) for m in self.members]
        self.blocks = np.array([max(1, -(-int(rows[m].sum()) // block)) for m in self.members])


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that takes part."""
    v = F.col(vector_col).cast("array<double>")
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(ok).where(F.exists(v, lambda x: x != 0))
    # -0.0 and 0.0 are one value.
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + 0.0).alias("v"))


def entries(df: DataFrame, id_col: str, vector_col: str, top: int) -> DataFrame:
    """(ids, v): the distinct usable vectors, each with its ``top`` + 1 smallest ids.

    The ranks are limited in each task before the exchange, so the copies of one
    vector neither meet nor are listed beyond ``top`` + 1 a task.
    """
    rows = usable(df, id_col, vector_col).distinct()
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("n", place).where(F.col("n") <= top + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def drawn(rows: DataFrame, count: int, sample: int) -> DataFrame:
    """The ``sample`` of ``count`` rows (ids, v) with the least hashes, in that order.

    Those far above are left out before the order: each task would otherwise
    send the least ``sample`` of its own rows to the one that merges them.
    """
    hashed = rows.select("v", F.xxhash64(F.col("ids")[0]).alias("h"), F.col("ids")[0].alias("i"))
    part = (1.25 * sample + 1000) / count
    if part < 1:
        few = hashed.where(F.col("h") < min(int((part - 0.5) * 2**64), 2**63 - 1))
        if few.count() >= sample:  # but for a chance of less than one in a million
            hashed = few
    return hashed.orderBy("h", "i").limit(sample).select("v")


def build(rows: DataFrame, dim: int, total: int, count: int, top: int, k: int, sample: int, block: int, visit: float | None, recall: float) -> tuple[Index, DataFrame]:
    """Fit the index on at most ``sample`` vectors, taken by hash, and assign every entry its cell.

    As many again, if there are more, serve to calibrate the share of rows that a query visits.
    """
    x = _matrix(drawn(rows, count, 2 * sample).toArrow().column("v"), dim)
    fit, other = x[:sample], x[sample:]
    k = max(1, min(k, len(fit) // 4))
    half = dim // 2
    index = Index((kmeans(fit[:, :half], k), kmeans(fit[:, half:], k)), dim)
    if visit is None:
        # A sample's few best are as near as the table's top.
        shown = other if len(other) >= sample // 2 else x
        index.calibrate(shown, -(-top * len(shown) // max(total, 1)), recall)
    else:
        index.share = visit

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j = index.cells(_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], ["ids", "v", "i", "j"])

    placed, _ = written(rows.select("ids", "v").mapInArrow(assign, "ids array<long>, v array<double>, i int, j int"), "entries")
    cells = placed.groupBy("i", "j").agg(F.sum(F.size("ids")).alias("n")).toArrow()  # at most k squared rows
    index.held[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("n").to_numpy()
    index.deal(block)
    return index, placed


def search(
    df: DataFrame,
    queries: DataFrame,
    top: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 512,
    visit: float | None = None,
    recall: float = 0.95,
    sample: int = 20_000,
    block: int = 4096,
) -> DataFrame:
    """The ``top`` rows of ``df`` with the largest inner product for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id and score, in double precision on
    the original vectors; ties go to the smaller id, and a row is no candidate
    of the query with its own id.  ``visit`` fixes the share of rows that a query
    visits, 1.0 being the exact search; by default it is calibrated for
    ``recall``.  At least ``top`` + 1 candidates are visited if there are so
    many.  Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null id or with another length
    than most vectors.  A repeated row is one candidate for each distinct score
    of its id; repeated queries are answered once.
    """
    return reranked(df, queries, top, id_col, vector_col, k, visit, recall, sample, block)[0]


def reranked(df, queries, top, id_col, vector_col, k, visit, recall, sample, block) -> tuple[DataFrame, DataFrame | None, Index | None]:
    """The result of ``search``; the work as (query_id, multiplied), how many entries each task multiplied a query with; and the index."""
    spark = df.sparkSession
    rows, _ = written(entries(df, id_col, vector_col, top), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("vectors")).collect()  # one row a length
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema), None, None
    dim, total, count = max(((r["dim"], r["n"], r["vectors"]) for r in sizes), key=lambda x: (x[1], -x[0]))
    rows = rows.where(F.size("v") == dim)
    index, placed = build(rows, dim, total, count, top, k, sample, block, visit, recall)
    need = max(index.share * total, top + 2)
    held = spark.sparkContext.broadcast(index)  # its size is fixed by k and the dimension

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's row for each block of each shard that it visits, with how far the shard's rows of cells are visited."""
        own = held.value
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                x = _matrix(part.column(1), dim)
                shard, piece, row, depths = [], [], [], []
                for r in range(len(x)):
                    depth = visits(*own.distances(x[r]), own.held, need)
                    for s, members in enumerate(own.members):
                        if depth[members].any():
                            for p in range(int(own.blocks[s])):
                                shard.append(s)
                                piece.append(p)
                                row.append(r)
                                depths.append(depth[members])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard, pa.int32()),
                        pa.array(piece, pa.int32()),
                        pa.array([True] * len(row)),
                        part.column(0).take(pa.array(row, pa.int64())).cast(pa.int64()),
                        pa.array([None] * len(row), pa.list_(pa.int64())),
                        pa.array(depths, pa.list_(pa.int32())),
                        part.column(1).take(pa.array(row, pa.int64())),
                    ],
                    ["shard", "piece", "asks", "query_id", "ids", "cells", "v"],
                )

    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim).distinct().select(F.col("id").alias("query_id"), "v")
    # Walking the cells is work, whatever few bytes the queries are: a task for each partition.
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "query_id")
    form = "shard int, piece int, asks boolean, query_id long, ids array<long>, cells array<int>, v array<double>"
    sent = asked.mapInArrow(route, form)
    listed = lambda values: F.array(*[F.lit(int(n)) for n in values])
    shard = F.element_at(listed(index.shard), F.col("i") + 1)
    stored = placed.select(
        shard.alias("shard"),
        F.pmod(F.xxhash64(F.col("ids")[0]), F.element_at(listed(index.blocks), shard + 1)).cast("int").alias("piece"),
        F.lit(False).alias("asks"),
        F.lit(None).cast("long").alias("query_id"),
        "ids",
        F.array(F.element_at(listed(index.place), F.col("i") + 1), "j").alias("cells"),
        "v",
    )
    dealt = stored.unionByName(sent).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "asks")

    def answers(own, base, cell, ids, part, out):
        asked_for = _matrix(part.column(6), dim)
        slack = 4 * dim * np.finfo(float).eps * np.sqrt((base**2).sum(1).max())  # a product's error bound, by the query's length
        for q, v, depth in zip(part.column(3).to_pylist(), asked_for, part.column(5).to_pylist(), strict=True):
            place = np.empty(len(own.centres[1]), np.int64)
            place[np.argsort(own.distances(v)[1], kind="stable")] = np.arange(len(place))
            visited = np.flatnonzero(place[cell[:, 1]] < np.array(depth)[cell[:, 0]])
            if not len(visited):
                continue
            best = visited
            if len(visited) > top + 1:  # by entries; each holds an id other than the query's or is that query
                near = base.take(visited, axis=0) @ v
                floor = np.partition(near, len(near) - top - 1)[len(near) - top - 1] - slack * np.sqrt((v**2).sum())
                best = visited[~(near < floor)]
            s = (base[best] * v).sum(1)  # in one order of adding, whatever the block
            found = sorted((-x, i) for e, x in zip(best.tolist(), s.tolist(), strict=True) for i in ids[e] if i != q)[:top]
            out.append((q, [i for _, i in found], [-x for x, _ in found], len(visited)))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        at, pending, base, cell, ids = None, [], None, None, None
        for b in batches:
            shard, piece, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple] = []
            for start, stop in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if start == stop:
                    continue
                key, part = (int(shard[start]), int(piece[start])), b.slice(start, stop - start)
                if key != at:
                    at, pending, base = key, [], None
                if not asks[start]:
                    pending.append(part)
                    continue
                if base is None:
                    if not pending:
                        continue
                    base = np.concatenate([_matrix(p.column(6), dim) for p in pending])
                    cell = np.concatenate([_matrix(p.column(5), 2) for p in pending])
                    ids = [x for p in pending for x in p.column(4).to_pylist()]
                    pending = []
                answers(own, base, cell, ids, part, out)
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "ids", "scores", "multiplied"])

    best = dealt.select("shard", "piece", "asks", "query_id", "ids", "cells", "v").mapInArrow(
        rerank, "query_id long, ids array<long>, scores array<double>, multiplied long"
    )
    each = best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    # The ranks are limited in each task before the exchange: no list of a query grows with its blocks.
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = each.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score"), best.select("query_id", "multiplied"), index
