"""Alignment of two tokenizers over a corpus, by exact-text deduplication.

Documents are shuffled by their full text, so every distinct text is tokenised and aligned once and carries the number of
documents that hold it. A text's tokens under A and B are compared as bytes; offsets at which both end a token cut
it into groups, and the two tokens that end there are a link. Pair counts are links times multiplicity, over all
documents. Measures are joined back to the document ids by the texts' sha256.

What bounds it: a task goes through a megabyte of text (or one longer text) at a time and keeps only
numpy arrays. Distinct pairs are counted per chunk, then per lane (the chunks of some 64 MB of text), and only then per
pair, so a pair that stands in every text is a row per lane. The counts of a lane's pairs come back as a file of that
lane in the shared folder, which its tasks read; nothing is broadcast but the best count per id of B (one row per entry of the
vocabulary) and texts that more than one document in 256 holds (fewer than 256 rows).

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte (or gives tokens
without bytes for), have no tokens: all measures 0, digest ''. Rows with a null id are left out, repeated rows count
and appear once each. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import Encoder

ALIGNED_BYTES = 1 << 17              # text aligned at once; a chunk puts several of these together
LANE_LINKS = 1 << 24                 # links (some 64 MB of text) whose pairs are looked up together
HOT_SHARE = 256                      # a text that more than 1 / 256 of the documents hold is joined by broadcast
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
CHUNK = ("part int, text_keys array<binary>, copies array<long>, sizes array<struct<n_a: long, n_b: long, n_groups: long>>, digests array<string>, links binary, "
         "pairs array<long>, weights array<long>")
CHUNK_SCHEMA = pa.schema([("part", pa.int32()), ("text_keys", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())),
                          ("sizes", pa.list_(pa.struct([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]))),
                          ("digests", pa.list_(pa.string())), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Tokenizers:
    """Paths of a byte-level tokenizers file (A) and of a SentencePiece model with byte fallback (B)."""

    a: str
    b: str


class Strings:
    """Byte strings by number, in one array."""

    def __init__(self, items: list[bytes]):
        self.sizes = np.array([len(x) for x in items], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return common.gather(self.data, self.starts[ids], self.sizes[ids])


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class PlainEncoder(Encoder):
    """The encoder of A: special tokens in a text are plain text, and few units are held or solved at once."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.library.encode_special_tokens = True
        self.units = common.UnitCache(250_000)

    def _solve(self, units: list[str]) -> list[list[int]]:
        return [ids for at in range(0, len(units), 2000) for ids in super()._solve(units[at: at + 2000])]


class Aligner:
    """Both tokenizers of a task, the bytes of their tokens, and the alignment of whole blocks of texts."""

    def __init__(self, spec_a: str, model_b: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a = PlainEncoder(spec_a)
        self.b = SentencePieceProcessor(model_proto=model_b)
        vocabulary, alphabet = self.a.library.get_vocab(with_added_tokens=True), byte_alphabet()
        names = [""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            names[i] = name
        self.bytes_a = Strings([bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else b"" for name in names])
        self.bytes_b = Strings([bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                                else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())])
        self.decimal = Strings([b"%d," % i for i in range(max(len(names), self.b.get_piece_size()))])

    def tokens(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A with text offsets, ids of B with text offsets; ``raw`` are the texts behind a space."""
        off = np.cumsum([0, *map(len, raw)])
        a, a_off = self.a(np.frombuffer(b"".join(raw), np.uint8), off)
        lists = self.b.encode([r[1:].decode("utf-8", "replace") for r in raw], num_threads=1)
        b_off = np.cumsum([0, *map(len, lists)])
        return a.astype(np.int64), a_off, np.fromiter((i for x in lists for i in x), np.int64, int(b_off[-1])), b_off

    def align(self, raw: list[bytes]) -> Aligned:
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        a, a_off, b, b_off = self.tokens(raw)
        good = np.ones(len(raw), bool)
        for ids, at, strings in ((a, a_off, self.bytes_a), (b, b_off, self.bytes_b)):
            size = strings.sizes[ids]
            good &= (common.per_row(size, at) == np.diff(off)) & (common.per_row(size == 0, at) == 0)
        for ids, at, strings in ((a, a_off, self.bytes_a), (b, b_off, self.bytes_b)):
            got, _ = strings.joined(ids[np.repeat(good, np.diff(at))])
            same = np.ones(len(data), bool)
            same[np.repeat(good, np.diff(off))] = got == data[np.repeat(good, np.diff(off))]
            good = good & (common.per_row(~same, off) == 0)
        return Aligned(self, a[np.repeat(good, np.diff(a_off))], np.diff(a_off) * good, b[np.repeat(good, np.diff(b_off))], np.diff(b_off) * good)


class Aligned:
    """Groups and links of a block of texts whose tokens give the same bytes under A and B."""

    def __init__(self, owner: Aligner, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.owner, self.a, self.b, self.n_a, self.n_b = owner, a, b, n_a, n_b
        end_a, end_b = np.cumsum(owner.bytes_a.sizes[a]), np.cumsum(owner.bytes_b.sizes[b])
        self.cut_a = np.isin(end_a, end_b, assume_unique=True)
        self.cut_b = np.isin(end_b, end_a, assume_unique=True)
        self.n_groups = common.per_row(self.cut_a, np.concatenate([[0], np.cumsum(n_a)]))
        self.links = a[self.cut_a] << 32 | b[self.cut_b]

    def digests(self) -> list[str]:
        """sha256 of every text's groups written out, '' for texts without tokens."""
        group_a, group_b = np.cumsum(self.cut_a) - self.cut_a, np.cumsum(self.cut_b) - self.cut_b
        n = len(self.links)
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
        before_b = upto_b - np.bincount(group_b, minlength=n)
        ids, sign = np.zeros(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.uint8)
        at = np.arange(len(self.a)) + before_b[group_a]                # a group's ids of A, then its ids of B
        ids[at], sign[at] = self.a, np.where(self.cut_a, ord("|"), ord(","))
        at = np.arange(len(self.b)) + upto_a[group_b]
        ids[at], sign[at] = self.b, np.where(self.cut_b, ord(";"), ord(","))
        text, end = self.owner.decimal.joined(ids)
        text[end[1:] - 1] = sign
        cut = end[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        raw = text.tobytes()
        return [hashlib.sha256(raw[s: e - 1]).hexdigest() if e > s else "" for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]


@lru_cache(maxsize=1)
def _aligner(spec_a: str, model_b: bytes) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(spec_a, model_b)


def chunks(texts: DataFrame, t: Tokenizers) -> DataFrame:
    """About a megabyte of distinct texts a row, tokenised and aligned; ``texts``: text, text_key, copies."""
    with open(t.a, encoding="utf-8") as f:
        spec = f.read()
    with open(t.b, "rb") as f:
        model = f.read()

    def run(batches):
        aligner, part = _aligner(spec, model), TaskContext.get().partitionId()
        for block in common.blocks(batches):
            links, sizes, digests = [], [], []
            for few in common.blocks(iter([block]), limit=ALIGNED_BYTES):
                data, off = common.flat(few.column("text"))
                whole = data.tobytes()
                got = aligner.align([b" " + whole[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist())])
                links.append(got.links)
                digests += got.digests()
                sizes += [{"n_a": a, "n_b": b, "n_groups": g} for a, b, g in zip(got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist())]
            all_links, copies = np.concatenate(links), block.column("copies").to_numpy()
            pairs, which = np.unique(all_links, return_inverse=True)
            weights = np.zeros(len(pairs), np.int64)
            np.add.at(weights, which, np.repeat(copies, [s["n_groups"] for s in sizes]))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (part, block.column("text_key").to_pylist(), copies, sizes, digests, all_links.tobytes(), pairs, weights), CHUNK_SCHEMA, strict=True)], schema=CHUNK_SCHEMA)

    return texts.select("text", "text_key", "copies").mapInArrow(run, CHUNK)


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links per lane and pair, and per pair over the corpus (pair, links, best: the highest count of the pair's B id)."""
    per_lane = common.stage(aligned.select("lane", F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
                            .groupBy("lane", F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("links")), "pairs-by-lane")
    counts = common.stage(per_lane.groupBy("pair").agg(F.sum("links").alias("links")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = counts.groupBy(b_id.alias("b")).agg(F.max("links").alias("best"))       # a row per entry of B's vocabulary
    return per_lane, counts.withColumn("b", b_id).join(F.broadcast(best), "b").drop("b")


class Counts:
    """The pair counts of one lane at a time, read from its files in the shared folder."""

    def __init__(self, folder: str):
        self.folder, self.lane = folder, -1

    def of(self, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs, their links, and whether that is the best of the B id."""
        if lane != self.lane:
            fs, path = common.file_system(f"{self.folder}/lane={lane}")
            files = fs.get_file_info(pafs.FileSelector(path)) if fs.get_file_info(path).type == pafs.FileType.Directory else []
            tables = [pq.ParquetFile(f.path, filesystem=fs).read(["pair", "links", "best"]) for f in files if f.path.endswith(".parquet")]
            pair, links, best = (np.concatenate([np.zeros(0, np.int64), *(t.column(c).to_numpy() for t in tables)]) for c in ("pair", "links", "best"))
            order = np.argsort(pair)
            self.lane, self.held = lane, (pair[order], links[order], links[order] == best[order])
        return self.held


def measures(aligned: DataFrame, folder: str) -> DataFrame:
    """text_key and the measures of every distinct text; ``folder``: pair counts by lane."""
    schema = pa.schema([("text_key", pa.binary()), ("copies", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("groups_sha256", pa.string())])

    def run(batches):
        counts = Counts(folder)
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                pair, links, best = counts.of(row.column("lane")[0].as_py())
                sizes = row.column("sizes").flatten()
                n_a, n_b, n_groups = (sizes.field(f).to_numpy() for f in range(3))
                at = np.searchsorted(pair, np.frombuffer(row.column("links")[0].as_py(), np.int64))
                off = np.concatenate([[0], np.cumsum(n_groups)])
                yield common.arrays(schema, row.column("text_keys").flatten(), row.column("copies").flatten(), n_a, n_b, n_groups, n_groups, common.per_row(best[at], off),
                                    common.per_row(links[at], off), row.column("digests").flatten())

    names = ", ".join(f"{m} long" for m in MEASURES)
    return aligned.select("lane", "text_keys", "copies", "sizes", "digests", "links").mapInArrow(run, f"text_key binary, copies long, {names}, groups_sha256 string")


def alignment(docs: DataFrame, t: Tokenizers, text: str = "text") -> DataFrame:
    """doc_id, the measures and groups_sha256 for every row of ``docs``."""
    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key")
    texts = docs.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = common.stage(chunks(texts.select("text", key, "copies"), t), "aligned")
    links = aligned.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x.n_groups))).first()[0] or 0
    aligned = aligned.withColumn("lane", F.pmod("part", F.lit(-(-links // LANE_LINKS) or 1)).cast("int"))
    per_lane, counts = pair_counts(aligned)

    folder = f"{common.shared_dir(docs.sparkSession)}/counts-{uuid.uuid4().hex}"
    per_lane.select("lane", "pair").join(counts, "pair").repartition("lane").write.partitionBy("lane").parquet(folder)
    found = common.stage(measures(aligned, folder), "measures")

    keyed = docs.filter("text <> ''").select("doc_id", key)
    share = F.col("copies") * HOT_SHARE > F.lit(keyed.count())
    few = F.broadcast(found.filter(share))                            # fewer than HOT_SHARE rows
    joined = keyed.join(few, "text_key").union(
        keyed.join(few, "text_key", "left_anti").join(found.filter(~share), "text_key").select("text_key", "doc_id", *found.columns[1:]))
    blank = docs.filter("text is null or text = ''").select("doc_id", *(F.lit(0).cast("long").alias(m) for m in MEASURES), F.lit("").alias("groups_sha256"))
    return joined.select("doc_id", *MEASURES, "groups_sha256").union(blank)
