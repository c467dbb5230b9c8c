"""The count matrix: cells by transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import key_render
from .abundance import abundances
from .molecules import dedup_exact, eqclass_counts, molecules

#: Letters of a padded cell key that name its range.
PREFIX = 22


@dataclass
class Matrix:
    """barcodes (row, barcode, cell), features (col, name) and triplets (row, col, value), 1-based."""

    barcodes: DataFrame
    features: DataFrame
    triplets: DataFrame

    def header(self) -> DataFrame:
        """One row: cells, transcripts and true number of triplets."""
        count = lambda df, name: df.agg(F.count("*").alias(name))
        one = count(self.barcodes, "cells").crossJoin(count(self.features, "transcripts"))  # one row each
        return one.crossJoin(count(self.triplets, "nnz"))


def numbered_cells(found: DataFrame) -> DataFrame:
    """(cell, row, barcode): cells in the order of their packed values.

    Cells are numbered inside their prefixes, and a running sum over the
    prefixes gives each its offset, so no task sorts all cells.  Keys are padded
    on the left: the prefix leaves 10 letters, which makes at most 4,096
    prefixes of cells of 16 letters.
    """
    cells = found.select("cell").distinct().withColumn("_prefix", F.left("cell", F.lit(PREFIX)))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("_prefix").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    here = F.row_number().over(Window.partitionBy("_prefix").orderBy("cell"))
    placed = cells.withColumn("_here", here).join(offsets, "_prefix")
    row = (F.col("_ahead") + F.col("_here")).cast("int")
    return placed.select("cell", row.alias("row"), key_render(F.col("cell")).alias("barcode"))


def count_matrix(alignments: DataFrame, transcripts: DataFrame, order=None) -> Matrix:
    """From alignments to the matrix; a cell whose abundances are all below the floor keeps its row.

    Molecules are made distinct and counted by their whole keys, each step
    combining before its exchange, so a cell that holds a third of all molecules
    is spread; only its classes meet in one task.
    """
    return matrix_of(eqclass_counts(dedup_exact(molecules(alignments, order))), transcripts)


def matrix_of(classes: DataFrame, transcripts: DataFrame) -> Matrix:
    """The matrix from class counts (cell, txps, count); they are read twice."""
    cells = numbered_cells(classes)
    alphas = abundances(classes, transcripts)
    triplets = alphas.join(cells, "cell").select("row", (F.col("tid") + 1).alias("col"), F.col("alpha").alias("value"), "barcode")
    return Matrix(cells, transcripts.select((F.col("tid") + 1).alias("col"), "name"), triplets)
