"""BAM as two Spark data sources, and a small writer.

``bam`` gives alignment records (file, rec_idx, read_name, flag, tid),
``bam_references`` the header's targets (tid, name, length), which must be the
same in all files of a folder.  A file is one partition: record boundaries are known only by reading from the start.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader

from .fastx import _File, files_of, inflated, opened

RECORDS = "file string, rec_idx long, read_name string, flag int, tid int"
REFERENCES = "tid int, name string, length int"
BATCH = 16384


class _Bytes:
    """Exact reads from a stream of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def take(self, n: int, may_end: bool = False) -> bytes | None:
        while len(self.held) - self.at < n:
            more = next(self.chunks, None)
            if more is None:
                if may_end and self.at == len(self.held):
                    return None
                raise ValueError("the BAM file ends early")
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def header(data: _Bytes) -> list[tuple[str, int]]:
    if data.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    data.take(struct.unpack("<i", data.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        name = data.take(struct.unpack("<i", data.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", data.take(4))[0]))
    return out


def alignments(data: _Bytes) -> Iterator[tuple[str | None, int, int | None]]:
    """(name, flag, tid) of each record; a name of ``*`` and a tid of -1 are null."""
    while (size := data.take(4, may_end=True)) is not None:
        body = data.take(struct.unpack("<i", size)[0])
        tid, _, length, _, _, _, flag = struct.unpack_from("<iiBBHHH", body)
        name = body[32 : 32 + length - 1].decode()
        yield None if name in ("*", "") else name, flag, None if tid < 0 else tid


def _stream(path: str):
    where, at = opened(path)
    return where.open_input_stream(at, compression=None)


class BamReader(DataSourceReader):
    def __init__(self, path: str, references: bool):
        self.path, self.references = path, references

    def partitions(self):
        return [_File(self.path)] if self.references else [_File(p) for p in files_of(self.path)]

    def _targets(self):
        """The targets, the same in all files: their numbers are what records refer to."""
        first = None
        for path in files_of(self.path):
            with _stream(path) as f:
                targets = header(_Bytes(inflated(iter(lambda: f.read(1 << 16), b""))))  # noqa: B023
            if first is None:
                first = targets
            elif targets != first:
                raise ValueError(f"{path} has other targets than the files before it")
        return first or []

    def read(self, partition):
        if self.references:
            targets = self._targets()
            columns = [pa.array(range(len(targets)), pa.int32()), pa.array([t[0] for t in targets], pa.string()), pa.array([t[1] for t in targets], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "name", "length"])
            return
        with _stream(partition.path) as f:
            data = _Bytes(inflated(iter(lambda: f.read(1 << 20), b"")))
            header(data)
            file, rows, start = partition.path.rsplit("/", 1)[-1], [], 0
            for r in alignments(data):
                rows.append(r)
                if len(rows) == BATCH:
                    yield _batch(file, start, rows)
                    start, rows = start + len(rows), []
            if rows:
                yield _batch(file, start, rows)


def _batch(file: str, start: int, rows: list) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([file] * n),
            pa.array(range(start, start + n), pa.int64()),
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int32()),
        ],
        ["file", "rec_idx", "read_name", "flag", "tid"],
    )


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return BamReader(self.options["path"], False)


class BamReferencesSource(DataSource):
    @classmethod
    def name(cls):
        return "bam_references"

    def schema(self):
        return REFERENCES

    def reader(self, schema):
        return BamReader(self.options["path"], True)


def register(spark) -> None:
    """Make the formats ``fastx``, ``bam`` and ``bam_references`` known to a session."""
    from .fastx import FastxSource

    for source in (FastxSource, BamSource, BamReferencesSource):
        spark.dataSource.register(source)


def bam_bytes(targets: Iterable[tuple[str, int]], rows: Iterable[tuple[str | None, int, int | None]], block: int = 4000) -> bytes:
    """A BAM file of unplaced sequences, in small blocks so that records cross them."""
    targets = list(targets)
    out = bytearray(b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(targets)))
    for name, length in targets:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for name, flag, tid in rows:
        raw = (name or "*").encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", -1 if tid is None else tid, -1, len(raw), 255, 0, 0, flag, 0, -1, -1, 0) + raw
        out += struct.pack("<i", len(body)) + body
    packed = bytearray()
    for at in range(0, len(out), block):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed += pack.compress(bytes(out[at : at + block])) + pack.flush()
    return bytes(packed)


def write_bam(alignments, targets: list[tuple[str, int]], path: str) -> int:
    """Write (read_name, flag, tid) as one BAM file a partition, all with the same targets; returns the number of records."""
    import uuid

    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        where, at = opened(path)
        where.create_dir(at, recursive=True)
        # A second attempt of a task replaces what the first left: both write the whole file under one name.
        name = f"{at}/part-{TaskContext.get().partitionId():05d}.bam"
        trial = f"{at}/_{uuid.uuid4().hex}"
        with where.open_output_stream(trial, compression=None) as out:
            out.write(bam_bytes(targets, rows, block=60000))
        where.move(trial, name)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    made = alignments.select("read_name", "flag", "tid").mapInArrow(run, "n long")
    return sum(r["n"] for r in made.collect())  # one row a partition
