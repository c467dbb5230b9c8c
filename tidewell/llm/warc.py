"""WARC archives: a writer and a splittable reader.

Each record is a gzip member of its own.  A writing task makes one archive whose
name is its attempt's alone, so attempts never replace each other's files; only
the archives of attempts that finished are listed, each with its own length, and
the files that the run's other attempts left are removed.  A reading task gets a
byte range of an archive.  It scans for the gzip magic, accepts a candidate
member only if it inflates to a WARC header, of any length, and owns the records
of the members that start inside its range, the last of which it reads past the
range's end; a member may hold several records.  No index of an archive is
needed and no archive is read by one task alone.  The writer counts the records
that start in each range, so a reader of its archives fails if one is missing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.fastx import opened
from .common import fresh_path, salted_lookup

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "<urn:no-page:>"
#: Bytes of an archive by which its records are counted, and the least that a reading task takes.
UNIT = 16 << 20
#: Most reading tasks; beyond them a task takes several units.
MOST_TASKS = 50_000
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(page_id) -> str:
    return NO_ID if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _name(uri: str | None) -> str | None:
    if uri is None or uri == NO_ID:
        return None
    return unquote(uri.removeprefix("<urn:page:").removesuffix(">")) if uri.startswith("<urn:page:") else uri


def record(page_id, url: str | None, digest: str, size: int, payload: bytes | None, refers_to, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit (payload None) without.

    A null id or url is written so that it is read back as null.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_named(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        # Line ends would end a header field: they can't occur in a URI.
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def records_of(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0
) -> DataFrame:
    """What to write for each page: id, url, digest, size, refers_to and html (null for a revisit).

    Of pages whose payloads are equal and of at least ``least`` bytes, the one
    with the largest id is the response and the others revisit it; all smaller
    payloads are responses.  Null html is empty.  Payloads are equal when their
    SHA-256 digests are, so choosing the responses moves digests only, with hot
    ones salted; the pages themselves are dealt once, by id.  Rows repeated with
    one id and payload: one response, the others revisit it.  Null ids come last.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    # The id as text, never null: the join and the window then share one exchange of the pages.
    key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), key.alias("_key"), F.sha2(html, 256).alias("_sha")
    )
    asked = rows.select("_key", "_sha", "id").distinct()
    best = asked.groupBy("_sha").agg(F.max("id").alias("best"))
    chosen = salted_lookup(asked, "_sha", F.col("_key"), best).select("_key", "_sha", "best")
    joined = rows.join(chosen, ["_key", "_sha"])
    first = F.row_number().over(Window.partitionBy("_key", "_sha").orderBy("url")) == 1
    size = F.octet_length("html")
    response = ((F.col("id").eqNullSafe(F.col("best"))) & first) | (size < least)
    return joined.select(
        "id",
        "url",
        F.sha1("html").alias("sha1"),
        size.alias("size"),
        response.alias("response"),
        "best",
        "html",
    ).select(
        "id",
        "url",
        "sha1",
        "size",
        F.when(~F.col("response"), F.col("best")).alias("refers_to"),
        "response",
        F.when(F.col("response"), F.col("html")).alias("html"),
    )


def write_archives(records: DataFrame, path: str, run: str | None = None, date: str = "2024-01-01T00:00:00Z", unit: int = UNIT) -> DataFrame:
    """Write ``records_of`` rows as archives in ``path``, lazily.

    Returns (archive, bytes, records), where records lists how many of the
    archive's records start in each ``unit`` bytes of it.  ``run`` names the
    files of this call, for ``tidy``.
    """
    run = run or uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, root = opened(path)
        where.create_dir(root, recursive=True)
        final = f"{run}-{task.partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        counts: list[int] = []
        with where.open_output_stream(f"{root}/{final}", compression=None) as out:  # members are compressed already
            at = 0
            for b in batches:
                for i in range(b.num_rows):  # row by row: one page in memory at a time
                    page, url, sha1, size, refers, response, html = (b.column(c)[i].as_py() for c in range(7))
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    member = record(page, url, digest, size, (html or "").encode() if response else None, refers, date)
                    out.write(member)
                    counts += [0] * (at // unit + 1 - len(counts))
                    counts[at // unit] += 1
                    at += len(member)
            counts += [0] * (-(-at // unit) - len(counts))
        rows = [pa.array([final]), pa.array([at], pa.int64()), pa.array([counts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(rows, ["archive", "bytes", "records"])

    columns = records.select("id", "url", "sha1", "size", "refers_to", "response", "html")
    return columns.mapInArrow(write, "archive string, bytes long, records array<long>")


def tidy(path: str, run: str, listed: list[str]) -> None:
    """Delete what attempts of ``run`` that aren't ``listed`` left in ``path``; all other files stay."""
    where, root = opened(path)
    known = set(listed)
    for info in where.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if info.is_file and info.base_name.startswith(f"{run}-") and info.base_name not in known:
            where.delete_file(info.path)


class _Window:
    """A forward-moving view of a file, read in pieces."""

    def __init__(self, file, size: int, piece: int = 1 << 20):
        self.file, self.size, self.piece, self.at, self.held = file, size, piece, 0, b""

    def read(self, start: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``start``, fewer at the end of the file."""
        stop = min(self.size, start + length)
        if start < self.at or stop > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(min(self.size - start, max(length, self.piece)))
        return self.held[start - self.at : stop - self.at]


def _header(data: bytes) -> dict[str, str] | None:
    """Fields of a WARC header, names in lower case; None if ``data`` is none.

    A line that starts with white space continues the field before it; other
    lines without a colon are passed over.
    """
    if not data.startswith(b"WARC/"):
        return None
    out: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, sep, value = line.partition(":")
        if sep and name.strip():
            last = name.strip().lower()
            out[last] = value.strip()
    return out if out.get("warc-type") and out.get("content-length", "").isdigit() else None


class _Broken(Exception):
    """A member that isn't, or whose bytes end or fail their check sum."""


class _Member:
    """The records of the gzip member that starts at ``start``, one at a time; ``end`` is known after the last."""

    def __init__(self, view: _Window, start: int):
        self.view, self.at, self.end = view, start, None
        self.inflate, self.data, self.piece = zlib.decompressobj(31), bytearray(), 4096

    def more(self) -> bool:
        """Inflate some more; False at the end of the member."""
        if self.inflate.eof:
            return False
        raw = self.view.read(self.at, self.piece)
        self.piece = min(self.piece * 4, 1 << 18)
        if not raw:
            raise _Broken("the archive ends inside a member")
        try:
            self.data += self.inflate.decompress(raw)
        except zlib.error as e:
            raise _Broken(str(e)) from None
        self.at += len(raw)
        if self.inflate.eof:
            self.end = self.at - len(self.inflate.unused_data)
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            searched = 0
            while (split := self.data.find(b"\r\n\r\n", searched)) < 0:
                if not b"WARC/".startswith(bytes(self.data[:5])):
                    raise _Broken("not a record")
                searched = max(0, len(self.data) - 3)
                if not self.more():
                    raise _Broken("the member ends inside a header")
            head = _header(bytes(self.data[:split]))
            if head is None:
                raise _Broken("not a header")
            stop = split + 4 + int(head["content-length"])
            while len(self.data) < stop + 4 and self.more():
                pass
            if len(self.data) < stop:
                raise _Broken("the member ends inside a block")
            block = bytes(self.data[split + 4 : stop])
            del self.data[:stop]
            # The line ends after a block; what follows them is the next record.
            while True:
                self.data = self.data.lstrip(b"\r\n")
                if self.data or not self.more():
                    break
            yield head, block
            if not self.data:
                return


def _scan(view: _Window, start: int, stop: int, gap: list[int]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records whose members start in [start, stop); ``gap[0]`` grows by the bytes after a member, or
    after the archive's start, that belong to none."""
    at, known = start, start == 0
    while True:
        if at >= stop and (not known or at >= view.size):
            return
        if view.read(at, 3) == MAGIC:
            member, count = _Member(view, at), 0
            try:
                for got in member.records():
                    if at >= stop:  # it belongs to the next range; this one only had to know that nothing lies between
                        return
                    count += 1
                    yield got
                at, known = member.end, True
                continue
            except _Broken as e:
                if count:  # a member begun in earnest
                    raise ValueError(f"a member at byte {at} is damaged: {e}") from None
        # A member that follows a member needs no search.
        piece = view.read(at + 1, (1 << 20) + 2)
        hit = piece.find(MAGIC)
        step = 1 + hit if hit >= 0 else max(1, len(piece) - 1)
        if at + step >= view.size or not piece:
            step = view.size - at
        if known:
            gap[0] += step
        at += step


def _fields(head: dict[str, str], block: bytes) -> tuple:
    kind = head["warc-type"]
    http, sep, payload = block.partition(b"\r\n\r\n")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "response":
        own = payload_digest(payload)
        # Digests by other algorithms, or written in another way, aren't compared.
        if digest and len(digest) == len(own) and ":" not in digest and digest.upper() != own:
            raise ValueError(f"payload of record {head.get('warc-record-id')} doesn't match its digest")
        return _name(head.get("warc-record-id")), kind, head.get("warc-target-uri"), own, len(payload), None, payload
    lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    size = int(lengths[0]) if lengths and lengths[0].strip().isdigit() else None
    return _name(head.get("warc-record-id")), kind, head.get("warc-target-uri"), digest, size, _name(head.get("warc-refers-to")), None


def _ranges(archives: list[tuple], split_bytes: int) -> list[tuple[str, int, int, int, int | None]]:
    """(path, start, stop, size, records or None) of each reading task."""
    units = sum(-(-a[1] // split_bytes) for a in archives)
    step = split_bytes * max(1, -(-units // MOST_TASKS))
    out = []
    for path, size, *counts in archives:
        for start in range(0, size, step):
            stop = min(start + step, size)
            known = sum(counts[0][start // split_bytes : -(-stop // split_bytes)]) if counts else None
            out.append((path, start, stop, size, known))
    return out


def scan_archives(spark: SparkSession, archives: list[tuple], split_bytes: int = UNIT, strict: bool = False) -> DataFrame:
    """``read_archives``, and a last row for each byte range with its ``skipped`` bytes, all else null."""
    ranges = _ranges(archives, split_bytes)
    if not ranges:
        return spark.createDataFrame([], f"{RECORDS}, skipped long")
    held = spark.sparkContext.broadcast(ranges)  # at most MOST_TASKS, and one an archive

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "skipped"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for one in b.column(0).to_pylist():
                path, start, stop, size, known = held.value[one]
                where, at = opened(path)
                rows, weight, found, gap = [], 0, 0, [0]
                with where.open_input_file(at) as file:
                    view = _Window(file, size)
                    if start == 0 and view.read(0, 5) == b"WARC/":
                        raise ValueError(f"{path} isn't compressed: records are found by their gzip members")
                    for head, block in _scan(view, start, stop, gap):
                        rows.append((*_fields(head, block), None))
                        weight += len(block)
                        found += 1
                        if weight > 1 << 22 or len(rows) >= 1000:
                            yield batch(rows)
                            rows, weight = [], 0
                if known not in (None, found):
                    raise ValueError(f"{path}, bytes {start} to {stop}: {found} records read of {known} written")
                if strict and gap[0]:
                    raise ValueError(f"{path}: {gap[0]} bytes after byte {start} belong to no valid member")
                yield batch([*rows, (None,) * 7 + (gap[0],)])

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, f"{RECORDS}, skipped long")


def read_archives(spark: SparkSession, archives: list[tuple], split_bytes: int = UNIT, strict: bool = False) -> DataFrame:
    """Records of the archives, given as (path, bytes) or (path, bytes, records): one row each, by byte ranges.

    Returns record_id, record_type, target_uri, payload_digest, payload_bytes,
    refers_to and payload.  A revisit has a null payload, and its digest and
    length are those of the payload it revisits.  ``records`` are the counts of
    ``write_archives``, for a ``unit`` of ``split_bytes``: a range that doesn't
    yield as many is an error.  Bytes that belong to no valid member are
    skipped; ``strict`` makes them an error and ``skipped_bytes`` counts them.
    So are a response whose payload doesn't match its digest, a member that is
    damaged after its first record, and an archive that isn't compressed.  No
    archives, or empty ones, give an empty result.  A payload that itself holds
    a WARC archive in gzip may be taken for members: use no ranges then (a
    ``split_bytes`` beyond the archives).
    """
    return scan_archives(spark, archives, split_bytes, strict).where("skipped is null").drop("skipped")


def skipped_bytes(spark: SparkSession, archives: list[tuple], split_bytes: int = UNIT) -> int:
    """How many bytes of the archives belong to no valid member."""
    return scan_archives(spark, archives, split_bytes).agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]


def archive(pages: DataFrame, path: str | None = None, least: int = 0, split_bytes: int = UNIT, **columns) -> DataFrame:
    """Write ``pages`` as archives and read them back: ``read_archives`` of ``write_archives``.

    Fails if a record that was written isn't read.  Other files in ``path`` are
    left alone.  The list of archives, one entry a writing task, passes through the driver.
    """
    spark = pages.sparkSession
    path, run = path or fresh_path(spark, "warc"), uuid.uuid4().hex
    made = write_archives(records_of(pages, least=least, **columns), path, run, unit=split_bytes).collect()
    tidy(path, run, [r["archive"] for r in made])
    return read_archives(spark, [(f"{path}/{r['archive']}", r["bytes"], r["records"]) for r in made if r["bytes"]], split_bytes, strict=True)
