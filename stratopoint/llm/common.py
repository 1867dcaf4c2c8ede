"""Whole Arrow batches of text as flat numpy arrays: words, lines, spans and their hashes.

A batch of documents is one byte array plus document offsets; every helper works on all
documents of the batch at once. Null texts are empty texts. Hashes are 64-bit polynomials
over prefix sums, so the hash of any span costs one subtraction and one product.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

U64 = np.uint64
BLOCK_BYTES = (1 << 20) - 1    # text handled at once; one longer document is its own block
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RADIX, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLES: dict[int, np.ndarray] = {}      # of a task: one table per radix, as long as the longest block has needed


def powers(radix: int, n: int) -> np.ndarray:
    """radix ** 0 .. n - 1 modulo 2 ** 64, from a table that grows by doubling."""
    if radix not in _TABLES or len(_TABLES[radix]) < n:
        table = np.full(1 << max(16, (n - 1).bit_length()), radix, U64)
        table[0] = 1
        _TABLES[radix] = np.multiply.accumulate(table)
    return _TABLES[radix][:n]


def prefix(values: np.ndarray, lane: int = 0) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any stretch of ``values``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_RADIX + 2 * lane, len(values)), out=out[1:])
    return out


def span(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    inverse = _INVERSE if lane == 0 else pow(_RADIX + 2 * lane, -1, 1 << 64)
    return mix((pre[ends] - pre[starts]) * powers(inverse, len(pre))[starts] + (ends - starts).astype(U64))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE_CODES[data])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, which bounds a task's memory."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < len(size):
            base = end[at] - size[at]
            to = max(at + 1, int(np.searchsorted(end, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offset of each document's first word."""
    n = len(data)
    gap = SPACE[data]
    border = np.zeros(n + 1, bool)
    border[off] = True
    border[0] = border[n] = True
    before, after = border[:n].copy(), border[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(byte_prefix(data), starts, ends)


def windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions where ``size`` consecutive items of one document start, and its row.

    ``counts`` are the documents' item counts in a flat item array."""
    have = np.maximum(counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), have)
    first = np.cumsum(counts) - counts
    return np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(first, have), row


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a flat array over each document's stretch ``off[i] .. off[i + 1]``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a stretch of ``size`` items from one of ``starts``."""
    opened = np.bincount(starts, minlength=n + size)
    edge = opened.copy()
    edge[size:] -= opened[:-size]
    return np.cumsum(edge)[:n] > 0


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ["*"]))


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def arrays(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of numpy arrays and Arrow arrays in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                      schema=schema)


def carried(docs: DataFrame, made: list[str]) -> list[str]:
    """The columns of ``docs`` that an operator passes on: all but those it makes itself."""
    return [c for c in docs.columns if c.lower() not in {m.lower() for m in made}]


def non_null_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with a null id cannot be named in a result; they are left out."""
    return docs.filter(F.col(key).isNotNull())


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the executors and keep the batches that tasks exchange with Python small:
    two of them, on both sides, are held for every core."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; files there survive lost executors,
    and later jobs start from them instead of from the source. Nothing is deleted here: a returned frame
    may still read them, so their life is that of the checkpoint folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def shingles(column: pa.Array, size: int, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of every document as sorted hashes, and their counts.

    A text with fewer words is one shingle of all its words; a text without words has none."""
    data, off = flat(column)
    if fold_case:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, w_off = words(data, off)
    n_words = np.diff(w_off)
    pre = prefix(word_hashes(data, start, end), 1)
    at, row = windows(n_words, size)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    keys = np.concatenate([span(pre, at, at + size, 1), span(pre, w_off[short], w_off[short + 1], 1)])
    row = np.concatenate([row, short])
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[first], np.bincount(row[first], minlength=len(n_words))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of ``edges``; the label is the smallest node it is connected with.

    Alternating large-star and small-star rounds: every round is a handful of aggregates and equi-joins on
    edges, cut by a written table; only a count and a checksum of the edges reach the driver."""
    edge = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    seen = None
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("label")) \
                .union(edge.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now


def gather(flat_values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``starts[i] .. + sizes[i]`` of a flat array one after another, and their offsets."""
    off = np.concatenate([[0], np.cumsum(sizes)])
    return flat_values[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])], off


class UnitCache:
    """Ids of text units that a task has encoded before, in sorted arrays by 64-bit key; emptied when it holds
    more than ``limit`` units, which bounds it to some tens of megabytes."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.keys, self.place = np.zeros(0, U64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.int32), 0

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, solve) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids one after another, and their offsets; ``solve`` gets the new units' texts as a list."""
        keys, where, which = np.unique(span(byte_prefix(data), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._reset()
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != keys[inside]
        if fresh.any():
            raw, new = data.tobytes(), where[fresh]
            self._add(keys[fresh], at[fresh], solve([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist())]))
            at += np.cumsum(fresh) - fresh
        unit = self.place[at][which]
        return gather(self.ids, self.starts[unit], self.sizes[unit])

    def _add(self, keys: np.ndarray, at: np.ndarray, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        n = int(sizes.sum())
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + n, np.int32)])
        self.ids[self.used: self.used + n] = np.fromiter(chain.from_iterable(lists), np.int32, n)
        self.place = np.insert(self.place, at, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += n


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path on it; for use in tasks."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def make_dir(path: str) -> None:
    fs, p = file_system(path)
    fs.create_dir(p, recursive=True)


def put_file(path: str, data: bytes) -> None:
    """Write a file whole: under a name of this attempt first, then renamed, so a repeated task does no harm."""
    fs, p = file_system(path)
    folder, _, name = p.rpartition("/")
    fs.create_dir(folder, recursive=True)
    attempt = f"{folder}/_{uuid.uuid4().hex}-{name}"
    with fs.open_output_stream(attempt, compression=None) as out:
        out.write(data)
    if fs.get_file_info(p).type != pafs.FileType.NotFound:     # of an earlier attempt; some stores do not replace
        fs.delete_file(p)
    fs.move(attempt, p)
