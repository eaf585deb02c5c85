"""WARC files as a chunked record table.

The reader streams a file, plain or gzipped by record, through a buffer of a block and hands a payload on in rows of at
most ``chunk`` bytes, keyed by record and chunk number. Each row carries the SHA-256 of the payload up to its end, so that
no step ever holds a whole record. The writer makes one file a task; both go through the shared folder's file system.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

CHUNK = 64 << 10
PAGE_CHUNK = 1 << 10  # of the query, whose pages have a few thousand bytes
BLOCK = 1 << 20
_FLUSH = 8 << 20
SCHEMA = "path string, record_id string, type string, uri string, page_id long, chunk_no long, chunk_start long, n_bytes long, digest string, is_last boolean, data binary"
_ARROW = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def clean(value: str) -> str:
    """A header value: control characters, which would end the line, are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, body: memoryview, put, place: str = "") -> None:
    """Write a resource record by ``put``, payload in blocks; ``place`` tells records with equal contents apart."""
    digest = hashlib.sha256(body).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{place}\n{page_id}\n{url}\n{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    put("\r\n".join(head).encode())
    for i in range(0, len(body), BLOCK):
        put(body[i : i + BLOCK])
    put(b"\r\n\r\n")


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Write a gzipped file a task under ``folder``, a URI; returns (path, records) of the files when evaluated.

    A task that runs again replaces its file with an equal one. A null body has no record; an empty one has an empty
    payload. A null url or page_id is left out of the header. Equal rows make a record each, with an
    identifier of its own. No row, no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        path, own = f"{at}/part-{ctx.partitionId():06d}.warc.gz", f"{at}/_part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        n, out = 0, None
        for b in batches:
            for i in range(b.num_rows):
                value = b.column(2)[i]
                if not value.is_valid:
                    continue
                if out is None:
                    out = system.open_output_stream(own)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                record(b.column(0)[i].as_py(), b.column(1)[i].as_py(), memoryview(value.as_buffer()), lambda x: out.write(z.compress(x)), f"{ctx.partitionId()}/{n}")
                out.write(z.flush())
                n += 1
        if out is not None:
            out.close()
            system.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "records"])

    cols = [F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`"), F.col(f"`{body}`")]
    return pages.select(*cols).mapInArrow(run, "path string, records long")


class Stream:
    """Bytes of a file, decompressed if gzipped, with never more than about two blocks in memory."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.z, self.over = raw, bytearray(), None, False
        first = raw.read(BLOCK)
        self.gz = first[:2] == b"\x1f\x8b"
        self.rest = first
        self.over = not first

    def fill(self) -> bool:
        """Hold more bytes; False at the end."""
        while True:
            if not self.rest:
                self.rest = self.raw.read(BLOCK)
            if not self.rest:
                if self.z is not None:
                    raise ValueError("the file ends within a gzip member")
                return False
            if not self.gz:
                self.held += self.rest
                self.rest = b""
                return True
            if self.z is None:
                self.z = zlib.decompressobj(31)
            more = self.z.decompress(self.rest, BLOCK)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            elif not self.rest and not more:
                continue
            if more:
                self.held += more
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = 0
        while (i := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if seen > BLOCK:
                raise ValueError("a header line longer than a block")
            if not self.fill():
                if self.held:
                    raise ValueError("the file ends within a header")
                return None
        out = bytes(self.held[:i]).rstrip(b"\r")
        del self.held[: i + 1]
        return out

    def take(self, most: int) -> bytes:
        """At least one byte and at most ``most``; as many as that unless the file ends."""
        while len(self.held) < most:
            if not self.fill():
                raise ValueError("the file ends within a payload")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def chunks(raw: BinaryIO, chunk: int) -> Iterator[tuple]:
    """(record_id, type, uri, page_id, chunk_no, chunk_start, n_bytes, digest, is_last, data) of a file's records, in order."""
    s = Stream(raw)
    while True:
        line = s.line()
        while line == b"":
            line = s.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head: dict[str, str] = {}
        while line := s.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        left, at, no = int(head["content-length"]), 0, 0
        page = head.get("x-page-id")
        key = (head.get("warc-record-id", "").strip("<>"), head.get("warc-type"), head.get("warc-target-uri"), int(page) if page else None)
        sha = hashlib.sha256()
        while True:
            data = s.take(min(left, chunk)) if left else b""
            sha.update(data)
            left -= len(data)
            yield (*key, no, at, len(data), sha.hexdigest(), left == 0, data)
            at, no = at + len(data), no + 1
            if not left:
                break
        said = head.get("warc-payload-digest", "").lower()
        if said.startswith("sha256:") and said[7:] != sha.hexdigest():
            raise ValueError(f"{key[0]}: the payload's digest differs from the header's")


def read_warc(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The records of all .warc and .warc.gz files below ``folder``, a row for each chunk of at most ``chunk`` bytes.

    ``digest`` is the SHA-256 of the payload up to the chunk's end, so that of the last chunk, which ``is_last`` marks, is
    the record's. An empty payload is one chunk of no bytes. Missing headers are null. A file that ends early, a payload
    unlike its digest, or bytes that aren't WARC fail the read. No file, no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], _NAMES)

        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with system.open_input_stream(at, compression=None, buffer_size=0) as raw:
                    for row in chunks(raw, chunk):
                        rows.append((path, *row))
                        size += len(row[-1]) + 200
                        if size > _FLUSH:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    return files.load(folder).select("path").mapInArrow(run, SCHEMA)


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through a WARC file and back as chunks; each chunk's digest covers all bytes up to its end, so the chunks' bytes are left out."""
    work = Workspace(spark, "warc")
    folder = f"{work.path}/files"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    if not work.write(write_warc(pages, folder), "written").count():
        return spark.createDataFrame([], SCHEMA).select("page_id", "uri", "chunk_no", "chunk_start", "n_bytes", "digest", "is_last")
    return read_warc(spark, folder, PAGE_CHUNK).select("page_id", "uri", "chunk_no", "chunk_start", "n_bytes", "digest", "is_last")


SQL = f"""
WITH p AS (SELECT page_id, url, hex(encode(html)) AS h, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL),
c AS (SELECT *, unnest(range(greatest(1, (n + {PAGE_CHUNK - 1}) // {PAGE_CHUNK})::BIGINT)) AS chunk_no FROM p)
SELECT page_id, url AS uri, chunk_no, (chunk_no * {PAGE_CHUNK})::BIGINT AS chunk_start,
       (least(n, (chunk_no + 1) * {PAGE_CHUNK}) - chunk_no * {PAGE_CHUNK})::BIGINT AS n_bytes,
       sha256(unhex(h[1 : 2 * least(n, (chunk_no + 1) * {PAGE_CHUNK})])) AS digest,
       (chunk_no + 1) * {PAGE_CHUNK} >= n AS is_last
FROM c
"""
