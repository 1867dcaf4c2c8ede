"""Chunks of documents that ask questions about all documents.

A *chunk* is about a megabyte of text with its document ids, packed into one row. For an operator that
compares short pieces of all texts, every chunk sends its distinct piece keys, sorted and packed into one
binary per key range ("bucket"); a bucket sees the keys of all chunks and returns one bit per key it was
sent. So a piece that fills a third of the corpus still reaches a bucket once per chunk, and what is
shuffled is a few bytes per distinct piece instead of a row.

Answers are written to the shared folder and read by the tasks that go through the chunks again.

The number of buckets follows the size of the input; a bucket holds about ``BUCKET_KEYS`` keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKET_KEYS = 1 << 20
CHUNK = "chunk long, ids binary, ends binary, size long, blob binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary()), ("size", pa.int64()), ("blob", pa.binary())])
PAYLOAD = "bucket int, chunk long, payload binary"
PAYLOAD_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
ANSWER = "chunk long, bucket int, bits binary"
ANSWER_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])


def packed_row(chunk: int, ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> list:
    blob = pa.Codec("zstd", compression_level=3).compress(pa.py_buffer(np.ascontiguousarray(data)), asbytes=True) if len(data) else b""
    return [[chunk], [ids.astype(np.int64).tobytes()], [off[1:].astype(np.int64).tobytes()], [len(data)], [blob]]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and document offsets of a packed row."""
    data = np.frombuffer(pa.decompress(row["blob"], row["size"], codec="zstd"), np.uint8) if row["size"] else np.zeros(0, np.uint8)
    return np.frombuffer(row["ids"], np.int64), data, np.concatenate([[0], np.frombuffer(row["ends"], np.int64)])


def pack(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents as a written table of chunks, in the order they are read; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 32
        for block in common.blocks(batches, text):
            data, off = common.flat(block.column(text))
            yield common.arrays(CHUNK_SCHEMA, *packed_row(number, block.column("doc_id").to_numpy(), data, off))
            number += 1

    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return common.stage(docs.mapInArrow(run, CHUNK), "chunks")


def bucket_bits(keys: float) -> int:
    """Bits of the bucket number for about ``keys`` keys in all."""
    return max(3, int(np.ceil(np.log2(max(1.0, keys / BUCKET_KEYS)))))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One packed row at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def cuts(top: np.ndarray, bits: int) -> np.ndarray:
    """Where the buckets begin and end in sorted 64-bit keys."""
    return np.searchsorted(top >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def answer_table(payloads: DataFrame, solve: Callable[[list[bytes]], list[np.ndarray]]) -> str:
    """Solve all buckets and write their answers to the shared folder, one directory per part of the chunk table.

    ``solve`` gets all payloads of a bucket and returns a boolean array for each; answers without a set bit are
    left out. Tasks that go through the chunk table again read the answers of their own part, so the
    texts are never shuffled."""

    def run(table: pa.Table) -> pa.Table:
        chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket")[0].as_py()
        found = solve(table.column("payload").to_pylist())
        rows = [(c, np.packbits(b).tobytes()) for c, b in zip(chunks, found, strict=True) if b.any()]
        return pa.table([[c for c, _ in rows], [bucket] * len(rows), [b for _, b in rows]], schema=ANSWER_SCHEMA)

    folder = f"{common.shared_dir(payloads.sparkSession)}/answers-{uuid.uuid4().hex}"
    payloads.groupBy("bucket").applyInArrow(run, ANSWER).withColumn("part", F.shiftright("chunk", 32)) \
        .repartition("part").write.partitionBy("part").parquet(folder)
    return folder


class Answers:
    """The answers of one part at a time, for use in a task."""

    def __init__(self, folder: str):
        self.folder, self.part = folder, -1
        self.held: dict[int, list[tuple[int, bytes]]] = {}

    def bits(self, chunk: int, cut: np.ndarray) -> np.ndarray:
        """The answers to a chunk as one boolean array over its sorted keys, which ``cut`` divides into buckets."""
        if chunk >> 32 != self.part:
            self.part = chunk >> 32
            self._load()
        out = np.zeros(int(cut[-1]), bool)
        for bucket, bits in self.held.get(chunk, ()):
            s, e = cut[bucket], cut[bucket + 1]
            out[s:e] = np.unpackbits(np.frombuffer(bits, np.uint8), count=e - s)
        return out

    def _load(self) -> None:
        self.held = {}
        fs, path = common.file_system(f"{self.folder}/part={self.part}")
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return
        for f in fs.get_file_info(pafs.FileSelector(path)):
            if f.path.endswith(".parquet"):
                t = pq.ParquetFile(f.path, filesystem=fs).read(["chunk", "bucket", "bits"])
                for chunk, bucket, bits in zip(*(t.column(i).to_pylist() for i in range(3))):
                    self.held.setdefault(chunk, []).append((bucket, bits))
