"""The barcode whitelist as a dictionary of exact and one-edit keys.

A whitelist is a table (segment, row, key) of at most a few hundred rows a
segment; its dictionary (segment, key, row) has some thousand keys a segment and
is broadcast.  Row -1 says that rows of different number share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AMBIGUOUS = -1
SCHEMA = "segment int, row long, key string"
LETTERS = ("A", "T", "C", "G")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of one header line and four columns, barcode 4 first; keys are reverse complements."""
    text = spark.read.text(path, wholetext=True).first()
    lines = (text[0] if text else "").splitlines()[1:]
    flip = str.maketrans("ACGT", "TGCA")
    rows = []
    for n, line in enumerate(x for x in lines if x):
        fields = line.split(",")
        if len(fields) > 4:
            raise ValueError(f"whitelist row {n} has {len(fields)} fields, at most 4 are known")
        rows += [(3 - i, n, f.strip().translate(flip)[::-1]) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, SCHEMA)


def edit1_neighbours(key: Column) -> Column:
    """All strings one edit away, and those that a shift at either end brings back to length; with repeats."""
    n = F.length(key)
    letters = F.array(*[F.lit(c) for c in LETTERS])
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    cut = F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))
    padded = F.flatten(F.transform(cut, lambda d: F.flatten(F.transform(letters, lambda c: F.array(F.concat(d, c), F.concat(c, d))))))
    put = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.transform(letters, lambda c: F.concat(F.substring(key, F.lit(1), i), c, F.substring(key, i + 1, n))),
        )
    )
    shifted = F.flatten(F.transform(put, lambda x: F.array(F.substring(x, F.lit(2), n), F.substring(x, F.lit(1), n))))
    swapped = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(letters, lambda c: F.concat(F.substring(key, F.lit(1), i - 1), c, F.substring(key, i + 1, n))),
        )
    )
    swapped = F.when(n > 0, swapped).otherwise(F.array().cast("array<string>"))
    return F.concat(cut, padded, put, shifted, swapped)


def neighbours(whitelist: DataFrame) -> DataFrame:
    """(segment, row, neighbour), distinct."""
    return whitelist.select("segment", "row", F.explode(edit1_neighbours(F.col("key"))).alias("neighbour")).distinct()


def dictionary(whitelist: DataFrame) -> DataFrame:
    """(segment, key, row): exact keys, the last row of equal ones, before one-edit keys."""
    exact = whitelist.groupBy("segment", "key").agg(F.max("row").alias("row"))
    near = neighbours(whitelist).groupBy("segment", F.col("neighbour").alias("key"))
    near = near.agg(F.when(F.min("row") == F.max("row"), F.min("row")).otherwise(AMBIGUOUS).alias("row"))
    return exact.unionByName(near.join(exact, ["segment", "key"], "left_anti"))


def looked_up(df: DataFrame, words: DataFrame, segments: list[str], out: list[str]) -> DataFrame:
    """``df`` with the rows of four segment columns: null if not found, -1 if ambiguous.

    Four broadcast joins, no exchange of ``df``.
    """
    for i, (name, row) in enumerate(zip(segments, out, strict=True)):
        own = words.where(F.col("segment") == i).select(F.col("key").alias(f"_k{i}"), F.col("row").alias(row))
        df = df.join(F.broadcast(own), F.col(name) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return df


def is_ambiguous(rows: list[Column]) -> Column:
    out = F.lit(False)
    for r in rows:
        out = out | F.coalesce(r == AMBIGUOUS, F.lit(False))
    return out
