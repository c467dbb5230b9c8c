"""Molecules: alignments grouped by read, keyed by cell and UMI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import parse_key

SUPPLEMENTARY, UNMAPPED = 2048, 4


def _grouped(alignments: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One molecule per group; see ``molecules``."""
    own = F.col("flag").bitwiseAND(SUPPLEMENTARY) == 0
    rows = alignments.where(F.col("read_name").isNotNull() & own)
    found = rows.groupBy(*keys).agg(
        F.min_by(F.col("flag").bitwiseAND(UNMAPPED), order).alias("_unmapped"),
        F.array_sort(F.collect_list("tid")).alias("txps"),
    )
    # Depending on the aggregates, the key stays above the aggregation: parsed once a read, not once an alignment.
    kept = (F.col("_unmapped") == 0) & (F.size("txps") > 0)
    return found.withColumn("_key", F.when(kept, parse_key(F.col("read_name")))).where(F.col("_key").isNotNull())


def molecules(alignments: DataFrame, order: Column | None = None) -> DataFrame:
    """(cell, umi, txps) of each read name: one molecule a name.

    ``alignments`` has read_name, flag, tid and, by default, rec_idx.
    Supplementary records and records without a name don't count; a read whose
    first record is unmapped, whose name is malformed or that has no target is
    dropped.  txps is sorted and keeps repeats.
    """
    order = F.col("rec_idx") if order is None else order
    return _grouped(alignments, ["read_name"], order).select("_key.cell", "_key.umi", "txps")


def molecules_by_run(alignments: DataFrame, file_col: str = "file", order: Column | None = None) -> DataFrame:
    """As ``molecules``, but a name that comes again later in a file starts a new molecule."""
    order = F.col("rec_idx") if order is None else order
    rows = alignments.where(F.col("read_name").isNotNull()).withColumn("_o", order)
    at = Window.partitionBy(file_col).orderBy("_o")
    new = F.when(F.lag("read_name").over(at).eqNullSafe(F.col("read_name")), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    return _grouped(runs, [file_col, "_run", "read_name"], F.col("_o")).select("_key.cell", "_key.umi", "txps")


def dedup_exact(found: DataFrame) -> DataFrame:
    """Distinct molecules."""
    return found.select("cell", "umi", "txps").distinct()


def eqclass_counts(deduped: DataFrame) -> DataFrame:
    """(cell, txps, count): how many molecules of a cell share a list of targets."""
    return deduped.groupBy("cell", "txps").agg(F.count("*").cast("int").alias("count"))


def eqclass_text(found: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Molecules as text lines: rendered cell, UMI and target names, tab-separated.

    Names come by a join on tid, so any number of transcripts will do; molecules
    are numbered by their content and row to put the names back in order.
    """
    keyed = found.withColumn("_id", F.monotonically_increasing_id())
    each = keyed.select("_id", "cell", "umi", F.posexplode("txps").alias("_at", "tid"))
    named = each.join(transcripts.select("tid", "name"), "tid")
    lists = named.groupBy("_id", "cell", "umi").agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("n"))
    names = F.transform("n", lambda x: x["name"])
    return lists.select(F.concat_ws("\t", F.right("cell", F.lit(16)), F.col("umi"), F.array_join(names, "\t")).alias("value"))
