"""Abundances of transcripts in each cell, by expectation-maximisation.

Classes of a cell (distinct target lists with counts) are few after counting,
whatever the number of reads, so a cell is one group of a grouped map.  Sums are
single-precision and in the order of the sorted classes, so results don't depend
on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Iteration bounds, tolerances and the output floor.
LEAST_ITERATIONS, MOST_ITERATIONS = 2, 100
FLOOR, CHECKED_ABOVE, TOLERANCE = np.float32(0.01), np.float32(0.01), np.float32(0.01)
PRIOR, SCALE = np.float32(0.5), np.float32(1e-3)
MOST_TRANSCRIPTS = 20_000_000


def optimise(classes: list[tuple[list[int], int]], length: np.ndarray) -> tuple[dict[int, np.float32], int]:
    """Abundances at or above the floor, by transcript, and the number of iterations."""
    classes = sorted((list(t), c) for t, c in classes)
    tids = np.array([t for ts, _ in classes for t in ts], np.int64)
    known, slot = np.unique(tids, return_inverse=True)
    of = np.repeat(np.arange(len(classes)), [len(ts) for ts, _ in classes])
    count = np.array([c for _, c in classes], np.float32)
    many = np.array([len(ts) > 1 for ts, _ in classes])[of]
    shortest = np.array([length[ts].min() for ts, _ in classes], np.float32)
    own = length[tids].astype(np.float32)
    alpha = np.zeros(len(known), np.float32)
    np.add.at(alpha, slot[~many], count[of[~many]])
    alpha = (alpha + PRIOR) * SCALE
    rounds, settled = 0, True
    while rounds < LEAST_ITERATIONS or (rounds < MOST_ITERATIONS and not settled):
        part = alpha[slot] * shortest[of] / own
        total = np.zeros(len(classes), np.float32)
        np.add.at(total, of, part)  # unbuffered: one after the other
        share = np.divide(count, total, out=np.zeros_like(count), where=total > 0)
        new = np.zeros_like(alpha)
        np.add.at(new, slot, np.where(many, share[of] * part, count[of]))
        settled = not ((new > CHECKED_ABOVE) & (np.abs(alpha - new) > TOLERANCE)).any()
        alpha = new
        rounds += 1
    return {int(t): a for t, a in zip(known, alpha, strict=True) if a >= FLOOR}, rounds


def lengths_of(transcripts: DataFrame) -> np.ndarray:
    """Lengths by tid, for broadcasting; the transcriptome's size is checked."""
    n = transcripts.agg(F.max("tid").alias("n")).first()["n"]
    if n is not None and n >= MOST_TRANSCRIPTS:
        raise ValueError(f"tid {n}: lengths of more than {MOST_TRANSCRIPTS} transcripts are not broadcast")
    out = np.zeros(0 if n is None else n + 1, np.int64)
    for r in transcripts.select("tid", "length").toLocalIterator():
        out[r["tid"]] = r["length"]
    return out


def abundances(classes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(cell, tid, alpha) from (cell, txps, count) and (tid, length)."""
    held = classes.sparkSession.sparkContext.broadcast(lengths_of(transcripts))

    def one_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = optimise(list(zip(pdf["txps"].map(list), pdf["count"], strict=True)), held.value)
        return pd.DataFrame(
            {"cell": pdf["cell"].iloc[0], "tid": np.array(list(found), np.int32), "alpha": np.array(list(found.values()), np.float32)}
        )

    return classes.groupBy("cell").applyInPandas(one_cell, "cell string, tid int, alpha float")


def starting(classes: DataFrame) -> DataFrame:
    """(cell, tid, alpha): unique counts and the prior, in double precision."""
    each = classes.select("cell", F.col("count"), F.size("txps").alias("n"), F.explode(F.array_distinct("txps")).alias("tid"))
    unique = F.sum(F.when(F.col("n") == 1, F.col("count")).otherwise(0))
    return each.groupBy("cell", "tid").agg(((unique + 0.5) * 1e-3).alias("alpha"))


def update(alphas: DataFrame, classes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One step over all cells at once, in double precision, as relational operators."""
    entries = classes.select("cell", "txps", "count", F.posexplode("txps").alias("at", "tid"))
    joined = entries.join(transcripts.select("tid", "length"), "tid").join(alphas, ["cell", "tid"])
    own = Window.partitionBy("cell", "txps")
    part = joined.withColumn("part", F.col("alpha") * F.min("length").over(own) / F.col("length"))
    total = F.sum("part").over(own)
    share = F.when(F.size("txps") == 1, F.col("count").cast("double")).when(total > 0, F.col("count") * F.col("part") / total).otherwise(0.0)
    return part.withColumn("share", share).groupBy("cell", "tid").agg(F.sum("share").alias("alpha"))
