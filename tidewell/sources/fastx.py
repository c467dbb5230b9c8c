"""Gzipped or plain FASTQ and FASTA as a Spark data source.

``spark.read.format("fastx").load(path)`` gives file, file_idx (the file's
position by name), read_idx (within the file), name and seq.  A gzip
stream can't be split, so a file is one partition; repartition after the scan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, file_idx int, read_idx long, name string, seq string"
BATCH = 4096


def opened(path: str):
    """The file system of a path and the path in it; Hadoop's names of S3 are known too."""
    for name in ("s3a://", "s3n://"):
        if path.startswith(name):
            path = "s3://" + path.removeprefix(name)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder by name."""
    where, root = opened(path)
    info = where.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    if info.type == pafs.FileType.File:
        return [path]
    found = where.get_file_info(pafs.FileSelector(root))
    return sorted(prefix + f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All members of a gzip stream, or the bytes themselves if it is none."""
    inflate, packed = None, None
    for c in chunks:
        if packed is None:
            packed = c[:2] == b"\x1f\x8b"
        if not packed:
            yield c
            continue
        while c:
            inflate = inflate or zlib.decompressobj(31)
            yield inflate.decompress(c)
            c = inflate.unused_data
            if inflate.eof:
                inflate = None
    if inflate is not None:
        raise ValueError("the gzip stream ends early")


def lines_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for c in chunks:
        *whole, rest = (rest + c).split(b"\n")
        for x in whole:
            yield x.rstrip(b"\r")
    if rest:
        yield rest.rstrip(b"\r")


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """(name, sequence) of each record; sequences may span lines; qualities are dropped."""
    header, parts, first = None, [], None
    it = iter(lines)
    for line in it:
        if header is None:
            if not line:
                continue
            first = line[:1]
            if first not in (b"@", b">"):
                raise ValueError(f"a record must start with @ or >, not {line[:20]!r}")
            header, parts = line[1:], []
        elif first == b">" and line[:1] == b">":
            yield _record(header, parts)
            header, parts = line[1:], []
        elif first == b"@" and line[:1] == b"+":
            need = sum(map(len, parts))
            while need > 0:
                quality = next(it, None)
                if quality is None:
                    raise ValueError(f"the qualities of {header.decode()} end early")
                need -= len(quality)
            if not sum(map(len, parts)):
                next(it, None)  # the empty quality line of an empty sequence
            if need < 0:
                raise ValueError(f"{header.decode()} has more qualities than bases")
            yield _record(header, parts)
            header = None
        else:
            parts.append(line)
    if header is not None:
        if first == b"@":
            raise ValueError(f"record {header.decode()} ends early")
        yield _record(header, parts)


def _record(header: bytes, parts: list[bytes]) -> tuple[str, str]:
    name = header.decode().split(" ")[0].split("\t")[0]
    return name, b"".join(parts).decode()


class _File(InputPartition):
    def __init__(self, path: str, idx: int = 0):
        self.path, self.idx = path, idx


class FastxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(files_of(self.path))]

    def read(self, partition):
        where, at = opened(partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        with where.open_input_stream(at, compression=None) as f:
            chunks = iter(lambda: f.read(1 << 20), b"")
            rows, start = [], 0
            for r in records(lines_of(inflated(chunks))):
                rows.append(r)
                if len(rows) == BATCH:
                    yield _batch(name, partition.idx, start, rows)
                    start, rows = start + len(rows), []
            if rows:
                yield _batch(name, partition.idx, start, rows)


def _batch(name: str, idx: int, start: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    n = len(rows)
    where = [pa.array([name] * n), pa.array([idx] * n, pa.int32()), pa.array(range(start, start + n), pa.int64())]
    return pa.RecordBatch.from_arrays(
        [*where, pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["file", "file_idx", "read_idx", "name", "seq"]
    )


class FastxSource(DataSource):
    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options["path"])
