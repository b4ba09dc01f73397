"""WARC archives as a table of record chunks.

Payloads never exist whole outside the column they come from: they are cut into
chunks before they reach a writer, compressed piece by piece into one gzip
member per record, and read back through a buffer of fixed size as rows of
record identifier and chunk number. Every chunk row carries the bytes and the
SHA-1 of the payload up to its end, so the last row of a record has the digest
of the whole and is checked against the one in the record's header.

Of records with equal payloads the one with the smallest key is a ``response``;
the others are ``revisit`` records that refer to it and have no payload. A
revisit names the full payload's length in an extension header, as its digest
is named in the standard one.

Each task writes archives of bounded size under names of its own attempt. Only
those that the list of the successful tasks names are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.sources.workspace import fresh_path, materialise

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = "urn:record:"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_FILES = "path string, records long, bytes long"
_CHUNKS = (
    "record_id string, chunk int, data binary, total_bytes long, total_sha1 string, last boolean, "
    "record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("chunk", pa.int32()),
        ("data", pa.binary()),
        ("total_bytes", pa.int64()),
        ("total_sha1", pa.string()),
        ("last", pa.bool_()),
        ("record_type", pa.string()),
        ("refers_to", pa.string()),
        ("target_uri", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


@dataclass(frozen=True)
class WarcOptions:
    chunk_bytes: int = 64 << 10  # of a payload in one row, at most
    archive_bytes: int = 64 << 20  # after which a task begins another archive
    smallest_revisit: int = 0  # shorter payloads are always written out
    date: str = "1970-01-01T00:00:00Z"
    batch_bytes: int = 4 << 20  # of chunk rows that a reader hands on at once
    keep_data: bool = True  # whether chunk rows carry their bytes


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _location(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Where archives are: any store that Arrow opens, such as a shared disk, HDFS or S3."""
    if path.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/%@+~"))


def plan_records(pages: DataFrame, options: WarcOptions) -> DataFrame:
    """``pages`` (key, uri, payload: binary) with digest, n and refers_to: the key of the response a record revisits, or null.

    Digests that occur more than once are found with one pre-aggregated count
    and written down, so that both sides of the join are exchanged anew (or the
    measured small one is sent to all) and a digest of many records is split.
    """
    pages = pages.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = pages.where(F.col("n") >= options.smallest_revisit).select("key", "digest", "n").groupBy("digest", "n")
    shared = shared.agg(F.min("key").alias("first"), F.count("*").alias("of")).where("of > 1").select("digest", "n", "first")
    joined = pages.join(materialise(shared, "revisits"), ["digest", "n"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _header(kind: bytes, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [f"WARC-Type: {kind.decode()}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def _uri(value: str | None, record: str) -> str:
    """A target address that fits on a header line; the record's own for a missing one."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._") if value else record


class _Archive:
    def __init__(self, folder: str):
        filesystem, root = _location(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self._out = filesystem.open_output_stream(f"{root}/{self.path.rpartition('/')[2]}", compression=None)
        self.records = self.bytes = 0

    def begin(self, head: bytes) -> None:
        self._gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self._put(self._gzip.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._put(self._gzip.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self._out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self._out.close()
        return self.path, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Write a record per row of ``pages`` (key, uri, payload: binary) and list the archives (path, records, bytes).

    A null payload is empty. Rows without a key get the id of none and come
    after all others when the response is chosen; rows equal in key and payload
    are all written as the response. An empty table writes nothing.
    """
    spark = pages.sparkSession
    filesystem, root = _location(folder)
    filesystem.create_dir(root, recursive=True)
    planned = plan_records(pages.withColumn("payload", F.coalesce("payload", F.lit(b""))), options)
    size = options.chunk_bytes
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("body") - 1, F.lit(0)), F.lit(size))
    # Cut in the row: a record's chunks follow one another in one task.
    chunks = (
        planned.withColumn("body", body)
        .select("key", "uri", "digest", "n", "refers_to", "body", F.explode(starts).alias("start"))
        .select("key", "uri", "digest", "n", "refers_to", "start", F.col("body").substr(F.col("start") + 1, F.lit(size)).alias("data"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: _Archive | None = None
        done: list[tuple[str, int, int]] = []
        within = False
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for row in range(batch.num_rows):
                key, uri, digest, n, refers, start = (c[row].as_py() for c in columns[:6])
                if start == 0:
                    if within:
                        archive.end()
                    if archive and archive.bytes >= options.archive_bytes:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    record = f"{_RECORD_ID}{key}"
                    fields = [
                        ("WARC-Record-ID", f"<{record}>"),
                        ("WARC-Date", options.date),
                        ("WARC-Target-URI", _uri(uri, record)),
                        ("WARC-Payload-Digest", f"sha1:{base32_sha1(bytes.fromhex(digest))}"),
                        ("Content-Type", "application/http;msgtype=response"),
                    ]
                    http = _HTTP % n
                    if refers is None:
                        head = _header(b"response", fields, len(http) + n)
                    else:
                        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{_RECORD_ID}{refers}>"), ("X-Payload-Length", str(n))]
                        head = _header(b"revisit", fields, len(http))
                    archive.begin(head + http)
                    within = True
                archive.add(columns[6][row].as_buffer())
        if archive:
            if within:
                archive.end()
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pydict({name: list(c) for name, c in zip(("path", "records", "bytes"), zip(*done, strict=True), strict=True)})

    return materialise(chunks.mapInArrow(run, _FILES), "archives")


class _Members:
    """The bytes of a gzip file, member after member, through a bounded buffer."""

    def __init__(self, stream, size: int):
        self._stream, self._size = stream, size
        self._unzip, self._raw, self.buffer = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self._unzip.eof:
                self._raw, self._unzip = self._unzip.unused_data, zlib.decompressobj(31)
            if not self._raw:
                self._raw = self._stream.read(self._size)
                if not self._raw:
                    return False
            data = self._unzip.decompress(self._raw, self._size)
            self._raw = self._unzip.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def head(self) -> bytes | None:
        """The next header block, without its blank line; None at the end. Blank lines before it are skipped."""
        while True:
            self.buffer = self.buffer.lstrip(b"\r\n")
            if (end := self.buffer.find(b"\r\n\r\n")) >= 0:
                head, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
                return head
            if not self._more():
                if self.buffer:
                    raise ValueError("an archive ends inside a record's header")
                return None

    def take(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes in pieces."""
        while length:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends inside a record")
            piece, self.buffer = self.buffer[:length], self.buffer[length:]
            length -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _payload(pieces: Iterator[bytes], http: bool) -> Iterator[bytes]:
    """A block without its HTTP header, which is held only until it ends."""
    held = b""
    for piece in pieces:
        if not http:
            yield piece
            continue
        held += piece
        if (end := held.find(b"\r\n\r\n")) >= 0:
            http = False
            if held[end + 4 :]:
                yield held[end + 4 :]
        elif len(held) > 1 << 20:
            raise ValueError("an HTTP header of over a megabyte")


def record_chunks(stream, options: WarcOptions) -> Iterator[dict]:
    """Chunk rows of an open archive, one record after the other; a record without payload has one empty chunk."""
    members = _Members(stream, options.chunk_bytes)
    while (head := members.head()) is not None:
        fields = _fields(head)
        kind = fields.get("warc-type")
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http = fields.get("content-type", "").startswith("application/http")
        base = {
            "record_id": fields["warc-record-id"].strip("<>"),
            "record_type": kind,
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "target_uri": fields.get("warc-target-uri"),
        }
        sha, total, number, waiting = hashlib.sha1(), 0, 0, b""
        for piece in _payload(members.take(int(fields["content-length"])), http):
            waiting += piece
            while len(waiting) > options.chunk_bytes:
                data, waiting = waiting[: options.chunk_bytes], waiting[options.chunk_bytes :]
                sha.update(data)
                total += len(data)
                yield base | {"chunk": number, "data": data, "total_bytes": total, "total_sha1": base32_sha1(sha.digest()), "last": False, "payload_bytes": None, "payload_digest": None}
                number += 1
        sha.update(waiting)
        total += len(waiting)
        found = base32_sha1(sha.digest())
        if kind == "revisit":
            length, full = int(fields.get("x-payload-length", -1)), digest
        else:
            if digest not in (None, found):
                raise ValueError(f"{base['record_id']}: the payload has digest {found}, its header {digest}")
            length, full = total, found
        yield base | {"chunk": number, "data": waiting, "total_bytes": total, "total_sha1": found, "last": True, "payload_bytes": length if length >= 0 else None, "payload_digest": full}


def read_archives(spark: SparkSession, archives: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Chunk rows of the archives (path) that a list names.

    ``payload_bytes`` and ``payload_digest`` stand on a record's last chunk and
    are those of the full payload, for revisits too. A damaged archive or a
    digest that does not fit raises. No archives, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, name = _location(path)
                rows, size = [], 0
                with filesystem.open_input_stream(name, compression=None) as stream:
                    for chunk in record_chunks(stream, options):
                        size += len(chunk["data"]) + 200
                        rows.append(chunk if options.keep_data else chunk | {"data": None})
                        if size >= options.batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS_ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS_ARROW)

    tasks = max(spark.sparkContext.defaultParallelism, archives.count())
    return archives.select("path").repartition(tasks, "path").mapInArrow(run, _CHUNKS)


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")


def record_key(column: str):
    """The key in a record id that ``write_archives`` made; null for the id of none."""
    return F.nullif(F.regexp_replace(column, f"^{re.escape(_RECORD_ID)}", ""), F.lit("None")).cast("long")
