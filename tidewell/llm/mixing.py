"""Mixing sources to target weights, without a global sort.

Every row gets a hash-random key.  The key's top bits name a range, so the
rows of a source, hot or not, fall into equal ranges that need no sampling and
are the same in each run.  Sizes are summed per (source, range) and per run of
``RUN`` ranges; running sums over the runs of a source, over the ranges of a run
and inside each range add up to the prefix sums, so that no task sees more than
``RUN`` rows of sums, or one range.  A source's budget is then cut exactly: whole epochs first, the rest from
the front of its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written


def hash_key(value: Column) -> Column:
    """A number of 60 bits from the MD5 of a value as text; null is the empty text."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")

#: A range is the least that one task takes: at 65,536 a source, a third of 100 TB comes in pieces of half a gigabyte.
RANGE_BITS = 16
#: Ranges that are summed up together: 2**RUN_BITS.
RUN_BITS = 8
#: Bits of a row's key.
KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0):
    """Targets of sources from (source, source_size).

    Sources in code point order, null last, take the weights in turn.  The
    budget, ``share`` times all sizes, is shared by weight; a target stops at
    ``cap`` times its source's size and the excess is shared again by weight
    until none is above.  That fixed point has a closed form: in the order of
    cap / weight a prefix of the sources is capped, and the others share what is
    left.  One row per source, so its windows see a small table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    free = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    # The first source that stays below its cap sets the level of all after it.
    shared = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "source_size", "level"))).over(everything)["level"]
    return free.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.least(F.col("most"), F.coalesce(F.col("shared") * F.col("weight"), F.col("most"))).alias("target"),
    )


def mix(
    df: DataFrame,
    size: Column,
    source_col: str = "source",
    key: Column | None = None,
    range_bits: int = RANGE_BITS,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    carry: tuple[str, ...] = (),
    write: bool = True,
) -> DataFrame:
    """How much of each row the mix takes.

    Returns ``carry`` and ``size``, ``source_size``, ``target``, ``taken``,
    ``copies`` (whole copies in ``taken``) and ``cut`` (what is left of it).
    Null sources are one source, after all others; rows of size 0 take 0; rows
    repeated with equal keys are ordered by ``carry``, and rows equal in that
    too share their place in any order, with the same total.  An empty table
    gives an empty result.  ``key`` is hashed, by default the first of ``carry``.
    ``write`` keeps sizes and keys in a table of their own, so that texts are read once.
    """
    spot = hash_key(key if key is not None else F.col(carry[0]))
    rows = df.select(*carry, F.col(source_col).alias("_source"), size.cast("long").alias("size"), spot.alias("_key"))
    # One key that is never null, so that the join below needs no second exchange of the rows.
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("")))
    rows = rows.withColumn("_range", F.shiftright("_key", KEY_BITS - range_bits).cast("int"))
    if write:
        rows, _ = written(rows, "sizes")
    run = F.shiftright("_range", RUN_BITS).alias("_run")
    ranges = rows.groupBy("_name", "_range").agg(F.sum("size").alias("_sum"), F.max("_source").alias("_source")).withColumn("_run", run)
    ranges, _ = written(ranges, "ranges")  # at most 2**range_bits rows a source
    runs = ranges.groupBy("_name", "_run").agg(F.sum("_sum").alias("_sum"), F.max("_source").alias("_source"))
    sizes = runs.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda *by: F.coalesce(F.sum("_sum").over(before(*by)), F.lit(0))
    starts = runs.select("_name", "_run", "_source", so_far("_name", "_run").alias("_start"))
    starts = starts.join(targets, F.col("_source").eqNullSafe(F.col("source"))).select("_name", "_run", "_start", "source_size", "target")
    inside = ranges.select("_name", "_run", "_range", so_far("_name", "_run", "_range").alias("_inside"))
    offsets = inside.join(starts, ["_name", "_run"]).select(
        "_name", "_range", (F.col("_start") + F.col("_inside")).alias("_ahead"), "source_size", "target"
    )
    here = (
        Window.partitionBy("_name", "_range")
        .orderBy("_key", *carry)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("_here", F.coalesce(F.sum("size").over(here), F.lit(0))).join(offsets, ["_name", "_range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - epochs * F.col("source_size") - F.col("_ahead") - F.col("_here")
    cut = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    whole = (F.col("size") > 0) & (cut == F.col("size"))
    return placed.select(
        *carry,
        F.col("_source").alias(source_col),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        (epochs * F.col("size") + cut).cast("long").alias("taken"),
        (epochs + F.when(whole, 1).otherwise(0)).cast("int").alias("copies"),
        F.when(whole, 0).otherwise(cut).cast("long").alias("cut"),
    )


def mix_documents(df: DataFrame, **options) -> DataFrame:
    """``mix`` over documents, their size being their number of words."""
    return mix(df, word_count(F.col("text")), key=F.col("doc_id"), carry=("doc_id",), **options)


def repeated(df: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, each as often as the mix takes it.

    A document that the cut falls into comes whole, so no text is shortened.
    """
    packed = df.select(F.struct(*df.columns).alias("_doc"), F.col("text"), F.col("source"), F.col("doc_id"))
    taken = mix(packed, word_count(F.col("text")), key=F.col("doc_id"), carry=("_doc",), write=False, **options)
    times = F.col("copies") + F.when(F.col("cut") > 0, 1).otherwise(0)
    again = taken.where(times > 0).select("_doc", F.explode(F.sequence(F.lit(1), times)))
    return again.select(*[F.col("_doc").getField(c).alias(c) for c in df.columns])
