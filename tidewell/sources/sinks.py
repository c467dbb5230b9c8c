"""Sinks: gzipped FASTA, the matrix with its barcodes and features, molecule text."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import record_id
from ..operators.assign import one_strand
from ..operators.matrix import Matrix
from ..operators.molecules import eqclass_text

FAILED = ("small", "ambiguous", "mismatch")


def passed_records(assigned: DataFrame) -> DataFrame:
    """(id, seq) of matched reads: name, rendered cell and UMI, and the cDNA, on one strand."""
    rows = one_strand(assigned.where("status = 'matched'"))
    return rows.select(record_id(F.col("name"), F.col("cell"), F.col("umi")).alias("id"), F.col("cdna").alias("seq"))


def failed_records(assigned: DataFrame) -> DataFrame:
    """(id, seq) of long reads without a barcode, unchanged."""
    return assigned.where(F.col("status").isin(*FAILED)).select(F.col("name").alias("id"), "seq")


def write_fasta(records: DataFrame, path: str, one_file: bool = False) -> None:
    """Two lines a record in gzipped parts; ``one_file`` makes it one part, by one task."""
    lines = records.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path, compression="gzip")


def number(x: float) -> str:
    """Shortest text that reads back as the same single-precision value; no exponent, no ``.0``."""
    return np.format_float_positional(np.float32(x), unique=True, trim="-")


def _number_text_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield pd.Series([number(x) for x in v], dtype=object)


def _joined(spark, parts: str, path: str, head: bytes = b"") -> None:
    """One file of ``head`` and the part files in order: bytes are copied, nothing is parsed; the parts go."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(parts).getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(at(parts)) if x.getPath().getName().startswith("part-"))
    out = fs.create(at(path), True)
    try:
        out.write(bytearray(head))
        for name in names:
            part = fs.open(at(f"{parts}/{name}"))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    fs.delete(at(parts), True)


def _packed(lines: list[str]) -> bytes:
    return gzip.compress("".join(f"{x}\n" for x in lines).encode(), mtime=0) if lines else b""


def _write_lines(df: DataFrame, path: str, one_file: bool, head: list[str] = (), packed: bool = True) -> None:
    """The lines ``value`` of ``df``, in its order, written by executors.

    With ``one_file`` the parts are joined, byte by byte, after ``head``: members
    of a gzip stream follow each other.  Else ``path`` is a folder, with ``head`` in
    a file that sorts first.
    """
    spark = df.sparkSession
    parts = f"{path}.parts" if one_file else path
    df.select("value").write.mode("overwrite").text(parts, **({"compression": "gzip"} if packed else {}))
    top = _packed(head) if packed else "".join(f"{x}\n" for x in head).encode()
    if one_file:
        _joined(spark, parts, path, top)
    elif head:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/head{'.gz' if packed else ''}")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(top))
        out.close()


def write_matrix(matrix: Matrix, path: str, one_file: bool = True) -> dict[str, int]:
    """matrix.mtx.gz, barcodes.tsv.gz and features.tsv.gz in the folder ``path``.

    Executors write the lines; one file each is what readers of the format
    expect, so the compressed parts are joined, unless ``one_file`` is off.
    """
    head = matrix.header().first().asDict()
    top = ["%%MatrixMarket matrix coordinate real general", "% Generated by tidewell", f"{head['cells']}\t{head['transcripts']}\t{head['nnz']}"]
    text = F.pandas_udf(_number_text_udf, "string")(F.col("value"))
    rows = matrix.triplets.orderBy("row", "col").select(F.concat_ws("\t", "row", "col", text).alias("value"))
    _write_lines(rows, f"{path}/matrix.mtx.gz", one_file, top)
    _write_lines(matrix.barcodes.orderBy("row").select(F.col("barcode").alias("value")), f"{path}/barcodes.tsv.gz", one_file)
    _write_lines(matrix.features.orderBy("col").select(F.col("name").alias("value")), f"{path}/features.tsv.gz", one_file)
    return head


def write_eqclass_text(found: DataFrame, transcripts: DataFrame, path: str, one_file: bool = True) -> None:
    """The count of targets, their names and lengths, then a line a molecule.

    Executors write the molecules; the head, one line a target, is the driver's.
    """
    listed = list(transcripts.orderBy("tid").select("name", "length").toLocalIterator())
    head = [str(len(listed)), *(f"{r['name']}\t{r['length']}" for r in listed)]
    _write_lines(eqclass_text(found, transcripts), path, one_file, head, packed=False)
