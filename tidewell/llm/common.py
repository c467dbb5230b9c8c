"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, file_system, fresh_path, scratch, written  # noqa: F401

#: ASCII white space as the contracts define it: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as empty.

    Each run becomes one letter, so no list of a text's words is made.
    """
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.rtrim(marks, F.lit(BLANKS))).cast("long")


#: Bytes of a batch on its way to Python; the default is 10,000 rows, which are 50 MB and more of texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python by bytes, from now on in this session, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, giving freed memory back to the system at its end: the worker lives on, and others beside it."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # of glibc alone
                ctypes.CDLL(None).malloc_trim(0)

    return leaner


def shuffle_width(spark: SparkSession) -> int:
    """Number of salts that spreads one hot key over a whole shuffle."""
    return max(64, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salted_lookup(
    left: DataFrame, key: str, spread: Column, right: DataFrame, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Equi-join ``left`` to ``right`` (at most one row per key), safe for hot keys.

    A key that a third of ``left`` shares would send those rows to one task.
    Here the pairs (key, salt) that occur in ``left`` are made distinct first,
    at most ``salts`` for a key; each fetches the key's row of ``right``; and
    ``left`` joins on key and salt, so a hot key spreads over the whole
    shuffle.  ``spread`` must be a function of the row.  Null keys match
    nothing.  Columns of ``right`` but its key are added.
    """
    salts = salts or shuffle_width(left.sparkSession)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    present = left.where(F.col(key).isNotNull()).select(key, "_salt").distinct()
    fetched = present.join(right, key, "inner")
    return left.join(fetched, [key, "_salt"], how).drop("_salt")


#: Words of 64 bits of the filter in ``flagged``: 2 MB, whatever the table.
FILTER_WORDS = 1 << 18


def flagged(df: DataFrame, names: list[str], wanted: DataFrame) -> DataFrame:
    """``df`` with ``known``: true for rows whose columns ``names`` are a row of ``wanted``, and for some others by chance.

    A bit filter of fixed size holds the hashes of ``wanted``, so that no row of
    ``df`` moves.  The more rows ``wanted`` has, the more others are known; with
    more rows than bits all are.
    """

    def spot(columns):
        h = F.xxhash64(*columns)
        return F.pmod(h, F.lit(FILTER_WORDS)).alias("word"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int").alias("bit")

    one = F.expr("shiftleft(1L, bit)")
    bits, _ = written(wanted.select(*spot(wanted.columns)).groupBy("word").agg(F.bit_or(one).alias("bits")), "filter")
    spots = df.select("*", *spot(names)).join(F.broadcast(bits), "word", "left")  # at most FILTER_WORDS rows
    return spots.withColumn("known", F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False))).drop("word", "bit", "bits")


def without(df: DataFrame, fates: DataFrame, *keys) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they are.

    ``fates`` tells of the ``keys`` of rows, in its first columns, whether they
    stay and how many rows share them; of several that stay one does.  Keys that
    it doesn't tell of stay.  A filter (``flagged``) holds the keys that go or
    repeat: rows it doesn't know stay where they are, and only the others move,
    to be compared by the whole keys.  A table with more such keys than bits
    moves all rows.
    """
    names = fates.columns[: len(keys)]
    fates, _ = written(fates.where("not stays or times > 1"), "fates")
    packed = df.select(F.struct(*df.columns).alias("row"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    spots = flagged(packed, names, fates.select(*names))
    out = spots.where("not known").select("row")
    asked = spots.where("known").select("row", *names)
    out = out.unionByName(asked.join(fates, names, "left_anti").select("row"))
    again = fates.where("stays")
    if not again.isEmpty():
        out = out.unionByName(asked.join(again, names, "left_semi").dropDuplicates(names).select("row"))
    return out.select("row.*")
