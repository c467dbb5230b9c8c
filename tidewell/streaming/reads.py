"""The stateless assignment over a stream of reads, and running deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assign import assign_nanopore


def assign_stream(reads: DataFrame, words: DataFrame, **options) -> DataFrame:
    """``assign_nanopore`` over a streaming ``reads``: its joins are with a static broadcast side."""
    return assign_nanopore(reads, words, **options)


def dedup_stream(molecules: DataFrame, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First occurrences of (cell, umi, txps); with ``time_col`` the state is dropped after ``delay``."""
    keys = ["cell", "umi", "txps"]
    if time_col is None:
        return molecules.dropDuplicates(keys)
    return molecules.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
