"""WARC archives: a writer with revisit records and a sequential reader.

Writing. Every record is a gzip member of its own, in the order in which a task meets its rows; a task starts a new
file when one is full. Pages with equal payloads (by SHA-256) of a minimum size are stored once: the page with the
smallest id as response, the others as revisits that refer to it. The smallest ids are aggregated before the
shuffle, and payloads are never compared in a group.

Reading. A file is read front to back in small pieces and decompressed incrementally, one member per record. The header
ends at the first empty line, the content is framed by Content-Length, and two line breaks end the record. Block
and payload digests are verified; a record that breaks a rule raises an error with file and offset. Files without
compression are read the same way. Memory: one piece and one record.

Defined results: a null payload is empty; a null address is written as the record's own id. Rows with a null id are left
out; rows that repeat an id are records of their own: a row is a revisit if its own payload has a smaller id, so rows with the
smallest id of a payload are all responses, and another payload under the same id is judged by itself. Empty tables give an
archive without files. Tasks can be repeated: files are written under a temporary name first, and a written archive is read
by the list of its files, so what a lost attempt left behind is not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = b"\r\n\r\n"
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"     # fixed value of the format
RECORD = "path string, offset long, record_type string, record_id string, refers_to string, target_uri string, " \
         "content_type string, payload_digest string, payload_length long, payload binary"
RECORD_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                           ("refers_to", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()),
                           ("payload_length", pa.int64()), ("payload", pa.binary())])


@dataclass(frozen=True)
class Archive:
    min_revisit: int = 100              # shorter equal payloads are all stored
    file_bytes: int = 64 << 20          # compressed size at which a new file begins
    date: str = "2000-01-01T00:00:00Z"
    level: int = 6


def record_id(page_id: int) -> str:
    return f"urn:page:{page_id}"


def record(kind: str, page_id: int, uri: str | None, payload: bytes, digest: str, refers_to: int | None, a: Archive) -> bytes:
    """One record, uncompressed. A revisit carries the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {a.date}",
            f"WARC-Target-URI: {quote(uri, safe=_URI_SAFE) if uri else record_id(page_id)}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


_URI_SAFE = "".join(chr(i) for i in range(0x21, 0x7F))


def _member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(pages: DataFrame, folder: str | None = None, a: Archive = Archive(), key: str = "page_id", uri: str = "url", payload: str = "html") -> str:
    """Write one record per row; returns the archive's folder."""
    spark = pages.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = common.non_null_id(pages, key).select(F.col(key).cast("long").alias("page_id"), F.col(uri).alias("uri"),
                                                 F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    marks = rows.filter(F.octet_length("payload") >= a.min_revisit).select("page_id", "digest")
    first = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = marks.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        part, held, size, number = TaskContext.get().partitionId(), [], 0, 0

        def close():
            path = f"{folder}/records/{part:07d}-{number:05d}.warc.gz"
            common.put_file(path, b"".join(held))
            return common.arrays(schema, [path], [len(held)])

        for block in common.blocks(batches, "payload"):
            for page, address, content, refers in zip(*(block.column(c).to_pylist() for c in ("page_id", "uri", "payload", "refers_to"))):
                held.append(_member(record("response" if refers is None else "revisit", page, address, content, hashlib.sha256(content).hexdigest(), refers, a), a.level))
                size += len(held[-1])
                if size >= a.file_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    common.make_dir(f"{folder}/records")
    rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "uri", "payload", "refers_to").mapInArrow(run, "path string, records long").write.parquet(f"{folder}/files")
    return folder


class _Source:
    """Bytes of a file, decompressed member by member, with the offset where the current member began."""

    def __init__(self, stream, name: str):
        self.stream, self.name = stream, name
        self.raw, self.buffer, self.offset, self.taken = stream.read(PIECE), b"", 0, 0
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        """Decompress another piece; false at the end of the member (or of a plain file)."""
        if self.inflate is not None and self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                if self.packed:
                    raise ValueError(f"{self.name}: cut off in the record at {self.offset}")
                return False
        if not self.packed:
            self.buffer, self.raw = self.buffer + self.raw, b""
            return True
        before = len(self.raw)
        self.buffer += self.inflate.decompress(self.raw, 1 << 20)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.taken += before - len(self.raw)
        return True

    def header(self) -> bytes:
        at = 0
        while (end := self.buffer.find(END, at)) < 0:
            at = max(0, len(self.buffer) - 3)
            if not self._more():
                raise ValueError(f"{self.name}: no end of header in the record at {self.offset}")
        out, self.buffer = self.buffer[:end], self.buffer[end + 4:]
        return out

    def take(self, n: int) -> bytes:
        pieces, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError(f"{self.name}: content ends early in the record at {self.offset}")
            pieces.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(pieces)
        self.buffer = whole[n:]
        return whole[:n]

    def next_record(self) -> bool:
        """Go to the next member; a member must end with its record."""
        if self.packed:
            while self._more():
                pass
            if self.buffer:
                raise ValueError(f"{self.name}: bytes behind the record at {self.offset}")
            self.raw = self.raw or self.stream.read(PIECE)
            self.offset, self.inflate = self.taken, zlib.decompressobj(31)
            return bool(self.raw)
        return bool(self.buffer) or self._more()


def records(stream, name: str) -> Iterator[tuple]:
    """All records of a WARC file, verified, as rows of ``RECORD``."""
    source = _Source(stream, name)
    more = bool(source.raw)
    while more:
        lines = source.header().decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"{name}: not a WARC record at {source.offset}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = source.take(int(fields["content-length"]))
        if source.take(4) != END:
            raise ValueError(f"{name}: wrong length of the record at {source.offset}")
        _verify(fields.get("warc-block-digest"), block, name, source.offset)
        payload, length = block, len(block)
        if fields.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(END)
            declared = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
            length = int(declared.get(b"content-length", len(payload)))
        kind = fields["warc-type"]
        if kind != "revisit":
            _verify(fields.get("warc-payload-digest"), payload, name, source.offset)
        strip = lambda x: x.strip("<>") if x else None
        yield (name, source.offset, kind, strip(fields.get("warc-record-id")), strip(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
               fields.get("content-type"), (fields.get("warc-payload-digest") or "").partition(":")[2] or None, length, payload)
        more = source.next_record()


def _verify(digest: str | None, content: bytes, name: str, offset: int) -> None:
    if digest is None:
        return
    kind, _, value = digest.partition(":")
    if kind == "sha256" and hashlib.sha256(content).hexdigest() != value.lower():
        raise ValueError(f"{name}: digest differs in the record at {offset}")


def read(spark: SparkSession, folder: str, with_payload: bool = True, listed: bool = True) -> DataFrame:
    """All records of a written archive, one file after another in each task. ``listed=False`` reads all ``.warc`` and
    ``.warc.gz`` files below the ``records`` folder of an archive that has no list."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = common.file_system(path)
                held, size = [], 0
                with fs.open_input_file(p) as stream:
                    for row in records(stream, path):
                        held.append(row if with_payload else (*row[:-1], None))
                        size += len(row[-1])
                        if size > common.BLOCK_BYTES:
                            yield common.arrays(RECORD_SCHEMA, *map(list, zip(*held)))
                            held, size = [], 0
                if held:
                    yield common.arrays(RECORD_SCHEMA, *map(list, zip(*held)))

    if listed:
        files = spark.read.schema("path string").parquet(f"{folder}/files")
        files = files.repartition(max(1, min(files.count(), 8 * common.shuffle_width(files))), "path")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(f"{folder}/records").select("path")
    return files.mapInArrow(run, RECORD)
