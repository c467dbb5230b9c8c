"""The two stages end to end: reads to barcoded reads, alignments to the matrix."""

from __future__ import annotations

import sys

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.assign import assign_illumina, assign_nanopore, keyed_names, paired, stats
from ..operators.matrix import matrix_of
from ..operators.molecules import eqclass_counts, molecules
from ..operators.whitelist import dictionary, read_whitelist
from ..sources.bam import register
from ..sources.sinks import failed_records, passed_records, write_fasta, write_matrix


def _spread(spark: SparkSession, df):
    """A gzip file is read by one task; what follows shouldn't be."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def _warned(assigned) -> None:
    """Say how many matched reads have names that counting will drop."""
    n = assigned.where(keyed_names()).count()
    if n:
        print(f"warning: {n} matched reads have '_' in their names; counting drops them", file=sys.stderr)


def run_nanopore(spark: SparkSession, reads: str, whitelist: str, out: str, one_file: bool = False) -> dict[str, int]:
    """Assign long reads; writes passed and failed reads as FASTA, returns the counts."""
    register(spark)
    words = dictionary(read_whitelist(spark, whitelist))
    scan = _spread(spark, spark.read.format("fastx").load(reads))
    assigned = assign_nanopore(scan, words).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_fasta(passed_records(assigned), f"{out}/passed.bcd.nanopore.fa.gz", one_file)
        write_fasta(failed_records(assigned), f"{out}/failed.bcd.nanopore.fa.gz", one_file)
        _warned(assigned)
        return stats(assigned).first().asDict()
    finally:
        assigned.unpersist()


def run_illumina(spark: SparkSession, r1: str, r2: str, whitelist: str, out: str, one_file: bool = False) -> dict[str, int]:
    """Assign read pairs; writes matched pairs' second reads as FASTA, returns the counts."""
    register(spark)
    words = dictionary(read_whitelist(spark, whitelist))
    load = lambda p: spark.read.format("fastx").load(p)
    assigned = assign_illumina(paired(load(r1), load(r2)), words).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = stats(assigned).first().asDict()
        write_fasta(passed_records(assigned), f"{out}/read.bcd.illumina.fa.gz", one_file)
        _warned(assigned)
        return counts
    finally:
        assigned.unpersist()


def run_count(spark: SparkSession, bam: str, out: str, one_file: bool = True) -> dict[str, int]:
    """From alignments to the matrix files; returns counts of transcripts, molecules and triplets.

    The alignments are decoded once: distinct molecules with their counts, and
    the triplets, are kept, and all else is derived from them.
    """
    register(spark)
    transcripts = spark.read.format("bam_references").load(bam).persist(StorageLevel.MEMORY_AND_DISK)
    found = molecules(spark.read.format("bam").load(bam))
    distinct = found.groupBy("cell", "umi", "txps").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    matrix = matrix_of(eqclass_counts(distinct), transcripts)
    matrix.triplets = matrix.triplets.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("molecules"), F.count("*").alias("deduped")).first().asDict()
        return write_matrix(matrix, out, one_file) | counts
    finally:
        for df in (matrix.triplets, distinct, transcripts):
            df.unpersist()
