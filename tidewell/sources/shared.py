"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, as
    in tests on a local master, a temporary folder of this machine serves; on a
    cluster that would not be shared, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(sc, "_tidewell_shared", None)
    if made is None:
        made = sc._tidewell_shared = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    return made


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _scopes(spark: SparkSession) -> list[list[str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tidewell_scopes"):
        sc._tidewell_scopes = []
    return sc._tidewell_scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside, at the end; what is still read must be written outside."""
    scopes = _scopes(spark)
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            discard(spark, path)


def fresh_path(spark: SparkSession, name: str, scoped: bool = True) -> str:
    """A new path in the shared folder; what is there goes with the enclosing ``scratch``, if ``scoped``, or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    if scoped and _scopes(spark):
        _scopes(spark)[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor.  The path is returned for ``discard``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)
