"""Token-id files with keyed access: shards of raw ids behind a minimal perfect hash index.

A shard holds the ids of a run of documents in ascending id order. Its index is a minimal perfect hash:
levels of bit arrays, where a key that falls alone on a bit owns it and the others go on to the next
level; the rank of the bit is the key's slot. A slot stores a 32-bit fingerprint, which turns away keys that
are not in the shard, and the document's number in the shard; the offsets lead to its ids. A lookup reads a
constant number of places. Ids take two bytes where the vocabulary allows it, else four.

Writing: documents are range-partitioned by id and sorted; a task encodes them and writes a file whenever a
shard is full, under a temporary name first, so a repeated task replaces equal files by equal files. The manifest
(one row per shard) is a table beside the shards. Reading back goes through Spark's binary file reader.

Defined results: a null or empty text is only its end id. Rows with a null id are left out. Rows that repeat an
id are stored one after another; a lookup finds the first. Empty tables give a store without shards.

File (little-endian): magic, header of six u64 (documents, ids, bytes per id, levels, bits in all levels, distinct
keys), level sizes u64, bit words u64, rank before every word u32, fingerprints u32, document numbers u32, keys i64,
offsets u64, ids.
"""

from __future__ import annotations

import os
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TOKSHRD1"
U64 = np.uint64
MANIFEST = "part int, number int, path string, first_key long, last_key long, n_docs long, n_tokens long"
MANIFEST_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("first_key", pa.int64()),
                             ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


@dataclass(frozen=True)
class StoreFormat:
    tokenizer: str                       # path of a tokenizers file
    end_id: int = 2
    shard_tokens: int = 1 << 22          # a shard is closed when it holds so many ids
    load: float = 2.0                    # bits per key of a level


# ---- minimal perfect hash -------------------------------------------------------------------------------------

def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return common.mix(keys.astype(U64) + U64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)) % U64(size)


def build_index(keys: np.ndarray, load: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, bit words and ranks for distinct keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = -(-max(64, int(len(left) * load)) // 64) * 64
        at = _bit(left, len(sizes), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    flags = np.concatenate(bits) if bits else np.zeros(0, bool)
    words = np.packbits(flags, bitorder="little").view("<u8")
    count = flags.reshape(-1, 64).sum(1)
    return sizes, words, (np.cumsum(count) - count).astype(np.uint32)


def slots(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of every key; -1 for keys that own no bit. A key of the index always owns one."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes.tolist()):
        at = _bit(keys[open_], level, size).astype(np.int64) + base
        word = words[at >> 6]
        low = U64(1) << (at & 63).astype(U64)
        own = (word & low) != 0
        out[open_[own]] = ranks[at[own] >> 6] + np.bitwise_count(word[own] & (low[own] - U64(1)))
        open_, base = open_[~own], base + size
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (common.mix(keys.astype(U64) ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)).astype(np.uint32)


# ---- shards ---------------------------------------------------------------------------------------------------

def shard_bytes(keys: np.ndarray, off: np.ndarray, ids: np.ndarray, width: int, load: float) -> bytes:
    """A shard file: ``keys`` ascending, ids of document i at ``off[i] .. off[i + 1]``."""
    distinct, first = np.unique(keys, return_index=True)
    sizes, words, ranks = build_index(distinct, load)
    slot = slots(distinct, np.array(sizes, np.int64), words, ranks)
    prints, numbers = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slot], numbers[slot] = fingerprints(distinct), first
    head = np.array([len(keys), len(ids), width, len(sizes), sum(sizes), len(distinct)], "<u8")
    parts = [head, np.array(sizes, "<u8"), words.astype("<u8"), ranks.astype("<u4"), prints.astype("<u4"), numbers.astype("<u4"),
             keys.astype("<i8"), off.astype("<u8"), ids.astype("<u2" if width == 2 else "<u4")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard opened over its bytes."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.raw, self.at = raw, 8
        n, ids, width, levels, bits, distinct = self._take("<u8", 6).tolist()
        self.sizes, self.words, self.ranks = self._take("<u8", levels).astype(np.int64), self._take("<u8", bits // 64), self._take("<u4", bits // 64)
        self.prints, self.numbers = self._take("<u4", distinct), self._take("<u4", distinct)
        self.keys, self.off = self._take("<i8", n), self._take("<u8", n + 1).astype(np.int64)
        self.ids = self._take("<u2" if width == 2 else "<u4", ids)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Document numbers of the keys, -1 where the fingerprint turns a key away."""
        slot = slots(keys, self.sizes, self.words, self.ranks)
        good = slot >= 0
        good[good] = self.prints[slot[good]] == fingerprints(keys[good])
        out = np.full(len(keys), -1, np.int64)
        out[good] = self.numbers[slot[good]]
        return out

    def __getitem__(self, number: int) -> np.ndarray:
        return self.ids[self.off[number]: self.off[number + 1]].astype("<u4")


# ---- encoding -------------------------------------------------------------------------------------------------

_KIND = np.zeros(256, np.uint8)                      # 1 space or line break, 2 letter, 3 digit, 4 other visible ASCII; 0 the rest
_KIND[0x21:0x7F] = 4
_KIND[[0x20, 0x0A]] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[0x30:0x3A] = 3


class Encoder:
    """The tokenizers library behind a cache of units that its words never cross.

    A byte-level tokenizer begins a new word at a single space between two visible characters, around a single
    line break between such, and where ASCII letters, digits and other signs change (an apostrophe may lead a
    contraction, so nothing is cut behind one). A text is encoded as the sequence of these units; special tokens
    hold several kinds of signs, so a text with "<|" is cut at spaces and line breaks only."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.units = common.UnitCache()

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        kind = _KIND[data]
        mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        plain = np.repeat(np.diff(np.searchsorted(mark, off)) == 0, np.diff(off)) if len(mark) else np.ones(n, bool)
        sure = kind > 1                              # last byte of a character that is surely no white space
        sure[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        begin = (kind > 1) | ((data >= 0xC3) & (data < 0xE0))
        lone = np.zeros(n, bool)                     # a space or line break between two such characters
        lone[1:-1] = (kind[1:-1] == 1) & sure[:-2] & begin[2:]
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        cut[:n] |= lone
        cut[1:] |= lone & (data == 0x0A)
        cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 1) & (kind[:-1] > 1) & (data[:-1] != 0x27) & plain[1:]
        starts = np.flatnonzero(cut[:n])
        ids, unit_off = self.units.encode(data, starts, np.append(starts[1:], n), self._solve)
        return ids, unit_off[np.searchsorted(starts, off)]

    def _solve(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def vocabulary_size(spec: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)


# ---- jobs -----------------------------------------------------------------------------------------------------

def write(docs: DataFrame, fmt: StoreFormat, folder: str | None = None, text: str = "text") -> str:
    """Encode ``docs`` and write the store; returns its folder."""
    spark = docs.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with open(fmt.tokenizer, encoding="utf-8") as f:
        spec = f.read()
    width = 2 if max(vocabulary_size(spec), fmt.end_id + 1) <= 1 << 16 else 4

    def run(batches):
        encode, part, number = _encoder(spec), TaskContext.get().partitionId(), 0
        keys, sizes, ids, held = [], [], [], 0

        def close():
            all_keys, size, all_ids = np.concatenate(keys), np.concatenate(sizes), np.concatenate(ids)
            path = f"{folder}/shards/{part:07d}-{number:05d}.tok"
            common.put_file(path, shard_bytes(all_keys, np.concatenate([[0], np.cumsum(size)]), all_ids, width, fmt.load))
            return common.arrays(MANIFEST_SCHEMA, *([x] for x in (part, number, path, all_keys[0], all_keys[-1], len(all_keys), len(all_ids))))

        for block in common.blocks(batches, text):
            got, off = encode(*common.flat(block.column(text)))
            got = np.insert(got, off[1:], fmt.end_id)
            keys.append(block.column("doc_id").to_numpy().astype(np.int64))
            sizes.append(np.diff(off) + 1)
            ids.append(got.astype(np.uint16 if width == 2 else np.uint32))
            held += len(got)
            if held >= fmt.shard_tokens:
                yield close()
                keys, sizes, ids, held, number = [], [], [], 0, number + 1
        if held:
            yield close()

    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    ordered = docs.repartitionByRange(common.shuffle_width(docs), "doc_id").sortWithinPartitions("doc_id")
    common.make_dir(f"{folder}/shards")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the number of ids before each shard; parts and shards are in key order."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    parts = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return shards.withColumn("inside", inside).join(parts, "part").select("part", "number", (F.col("before") + F.col("inside")).alias("shard_start"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a store from its files, each fetched by key through its shard's index:
    doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                part, number = map(int, path.as_py().rpartition("/")[2][:-4].split("-"))
                shard = Shard(raw.as_py())
                place = shard.find(shard.keys)
                repeat = np.append(False, shard.keys[1:] == shard.keys[:-1]) if len(shard.keys) else np.zeros(0, bool)
                place[repeat] = np.flatnonzero(repeat)
                if (place != np.arange(len(place))).any():
                    raise ValueError(f"index of {path} leads to other documents")
                crc = [zlib.crc32(shard[i].tobytes()) for i in place.tolist()]
                n = len(place)
                yield common.arrays(schema, np.full(n, part, np.int32), np.full(n, number, np.int32), shard.keys, shard.off[place],
                                    shard.off[place + 1] - shard.off[place], crc)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(f"{folder}/shards")
    docs = files.select("path", "content").mapInArrow(run, "part int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(_starts(spark, folder), ["part", "number"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) for the keys that the store holds. Keys are routed by the shards' key ranges (a sorted list
    with one entry per shard of ``shard_tokens`` ids), then every shard is opened once for all its keys."""
    spark = keys.sparkSession
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part", "number").select("path", "last_key").collect()
    last, paths = np.array([s.last_key for s in shards], np.int64), [s.path for s in shards]
    routed_schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64())])
    found_schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def route(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            at = np.searchsorted(last, k)
            yield common.arrays(routed_schema, at[at < len(last)], k[at < len(last)])

    def run(table: pa.Table) -> pa.Table:
        fs, path = common.file_system(paths[table.column("shard")[0].as_py()])
        with fs.open_input_file(path) as f:
            shard = Shard(f.read())
        k = table.column("doc_id").to_numpy()
        place = shard.find(k)
        hit = place >= 0
        return pa.table([pa.array(k[hit]), pa.array([shard[i].astype(np.int64) for i in place[hit].tolist()], pa.list_(pa.int64()))], schema=found_schema)

    wanted = keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id")).distinct()
    return wanted.mapInArrow(route, "shard long, doc_id long").groupBy("shard").applyInArrow(run, "doc_id long, ids array<long>")
