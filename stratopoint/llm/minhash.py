"""MinHash near-duplicates: circulant MinHash, banding, exact Jaccard on full sets.

All coordinates of a signature come from two permutations of 32-bit numbers: the first scatters the
shingles, the second is read after a circular shift by the number of the coordinate. Bands of the
signature propose candidates; every link is then confirmed on the full shingle sets.

How it stays linear where groups are large:

* texts with equal sets are one representative; copies never meet each other;
* in every bucket all members are first compared with one random member (a star), then components are taken;
* only buckets that still hold several components are looked at again. There every member outside the main
  component meets all members of the bucket, in blocks of bounded size inside a task; only confirmed
  links leave a block. A link is needed only between different components, so none is lost.

A pair at the threshold escapes all bands with probability (1 - t ** rows) ** bands; the number of bands
follows from the threshold so that this is below 1e-7 (28 bands at 0.85, 41 at 0.8), less for closer pairs.

Defined results: null and blank texts have an empty set, component = own id, kept. Rows with a null id are
left out, repeated rows get one result row each. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

U32 = np.uint32
MADE = ["n_shingles", "component_id", "kept"]


@dataclass(frozen=True)
class NearDup:
    shingle_words: int = 5
    percent: int = 80                # link where 100 * intersection >= percent * union
    bands: int = 0                   # 0: the fewest that miss a pair at the threshold with a probability below 1e-7
    rows: int = 5
    left_block: int = 500            # members outside the main component met at once
    right_block: int = 2000

    def __post_init__(self):
        if not self.bands:
            escapes = 1 - (self.percent / 100) ** self.rows
            object.__setattr__(self, "bands", math.ceil(math.log(1e-7) / math.log(escapes)) if escapes else 1)


def permute(y: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection on 32-bit numbers (multiply and xor-shift rounds), in place."""
    y ^= y >> U32(16)
    y *= U32(0x7FEB352D)
    y ^= y >> U32(15)
    y *= U32(0x846CA68B)
    y ^= y >> U32(16)
    return y


def signatures(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates for every non-empty set in a flat list: min of permute(first(x) + k * step)."""
    out = np.zeros((size, int((counts > 0).sum())), U32)
    ends = np.cumsum(counts[counts > 0])
    at = 0
    while at < len(ends):            # stretches that stay in the processor's cache
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + 131_072, "right")))
        first = (common.mix(keys[base: ends[to - 1]]) >> np.uint64(32)).astype(U32)
        begin = np.concatenate([[0], ends[at: to - 1] - base])
        for k in range(size):
            out[k, at:to] = np.minimum.reduceat(permute(first + U32(k * 0x9E3779B1 & 0xFFFFFFFF)), begin)
        at = to
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band and set; keys of different bands differ."""
    out = np.zeros((signature.shape[0] // rows, signature.shape[1]), np.uint64)
    for b in range(len(out)):
        out[b] = b + 1
        for r in range(rows):
            out[b] = common.mix(out[b] ^ signature[b * rows + r].astype(np.uint64))
    return out


def _set_sums(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two checksums for every set in a flat list, the same wherever the set stands in it."""
    off = np.concatenate([[0], np.cumsum(counts)])
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(common.mix(keys ^ np.uint64(salt)), out=total[1:])
        sums.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
    return sums


def sketch(docs: DataFrame, p: NearDup, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two checksums of the set, and its band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for block in common.blocks(batches, text):
            keys, counts = common.shingles(block.column(text), p.shingle_words)
            off = np.concatenate([[0], np.cumsum(counts)])
            sums = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                total = np.concatenate([[0], np.cumsum(common.mix(keys ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
                sums.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
            bands = band_keys(signatures(keys, counts, p.bands * p.rows), p.rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((counts > 0) * p.bands)]), pa.int32()),
                                             pa.array(np.ascontiguousarray(bands.T).reshape(-1).view(np.int64)))
            yield common.arrays(schema, block.column("doc_id").cast(pa.int64()), counts, *sums, lists)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _block_links(ids: np.ndarray, left: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Confirmed links between the left and all members of a block, across labels."""
    sizes = np.array([len(s) for s in sets])
    at = np.flatnonzero(left)
    index = np.concatenate([sets[i] for i in at])
    owner = np.repeat(np.arange(len(at)), sizes[at])
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    found = []
    for m in range(len(ids)):
        lo, hi = np.searchsorted(index, sets[m], "left"), np.searchsorted(index, sets[m], "right")
        have = hi - lo
        if not (total := int(have.sum())):
            continue
        hits = np.repeat(lo - (np.cumsum(have) - have), have) + np.arange(total)
        both = np.bincount(owner[hits], minlength=len(at))
        good = (100 * both >= percent * (sizes[at] + sizes[m] - both)) & (labels[at] != labels[m])
        found += [(ids[i], ids[m]) for i in at[good]]
    return np.array(found, np.int64).reshape(-1, 2)


def links(blocks: DataFrame, docs: DataFrame, p: NearDup, text: str) -> DataFrame:
    """(a, b) links confirmed inside blocks; ``blocks``: block, left (boolean), node, label.

    Members travel as texts, which are smaller than their sets; the sets are made where they are compared."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(rows: pa.Table):
        ids, left = rows.column("node").to_numpy(), rows.column("left").to_numpy(zero_copy_only=False)
        block, label = rows.column("block").to_numpy(), rows.column("label").to_numpy()
        sets: list[np.ndarray] = []
        for part in common.blocks(iter(rows.to_batches())):
            keys, counts = common.shingles(part.column("text"), p.shingle_words)
            sets += np.split(keys, np.cumsum(counts)[:-1])
        cut = np.flatnonzero(np.append(np.insert(block[1:] != block[:-1], 0, True), True))
        for s, e in zip(cut[:-1], cut[1:]):
            if left[s:e].any() and e - s > 1:
                yield _block_links(ids[s:e], left[s:e], label[s:e], sets[s:e], p.percent)

    def run(batches):
        """Rows come sorted by block; a block is solved when the next one begins."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                held.append(part)
                last = part.column("block")[-1].as_py()
                rows = pa.Table.from_batches(held)
                split = int((rows.column("block").to_numpy() != last).sum())
                if split:
                    for found in solve(rows.slice(0, split)):
                        yield common.arrays(schema, found[:, 0], found[:, 1])
                    held = rows.slice(split).to_batches()
        if held:
            for found in solve(pa.Table.from_batches(held)):
                yield common.arrays(schema, found[:, 0], found[:, 1])

    texts = docs.select(F.col("doc_id").alias("node"), F.col(text).alias("text"))
    return blocks.join(texts, "node").repartition("block").sortWithinPartitions("block", "left") \
        .select("block", "left", "node", "label", "text").mapInArrow(run, "a long, b long")


def components(docs: DataFrame, p: NearDup = NearDup(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    sketches = common.stage(sketch(docs, p, text), "sketch")
    classes = sketches.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    band = sketches.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]) \
        .select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    sized = band.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "key")).alias("center")).filter("n > 1")
    members = common.stage(band.join(sized, "key"), "members")

    pairs = members.filter("node <> center").select("center", "node").distinct()
    parts = pairs.groupBy("center").agg(F.ceil(F.count("*") / p.right_block).alias("parts"))
    pairs = pairs.join(parts, "center")
    star = pairs.select(F.xxhash64("center", F.pmod(F.xxhash64("node"), "parts")).alias("block"), F.lit(False).alias("left"), "node", F.col("node").alias("label")) \
        .union(parts.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
               .select(F.xxhash64("center", "part"), F.lit(True), "center", "center"))
    first = common.stage(links(star, docs, p, text), "links")
    labels = common.connected(first, "a", "b")

    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"))
    mixed = per_label.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", "n").alias("main"), F.sum("n").alias("n"),
                                         F.max("n").alias("largest"), F.sum("sum").alias("sum")).filter("labels > 1") \
        .groupBy("n", "sum").agg(F.min("key").alias("key"), F.max("largest").alias("largest"), F.min_by("main", "key").alias("main"))
    mixed = mixed.select("key", "main", F.ceil((F.col("n") - F.col("largest")) / p.left_block).alias("ls"), F.ceil(F.col("n") / p.right_block).alias("rs"))
    rows = labelled.join(mixed, "key")
    left = rows.filter("label <> main").select("key", F.pmod(F.xxhash64("node", F.lit(1)), "ls").alias("l"),
                                               F.explode(F.sequence(F.lit(0).cast("long"), F.col("rs") - 1)).alias("r"), F.lit(True).alias("left"), "node", "label")
    right = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ls") - 1)).alias("l"), F.pmod(F.xxhash64("node", F.lit(2)), "rs").alias("r"),
                        F.lit(False).alias("left"), "node", "label")
    rest = links(left.union(right).select(F.xxhash64("key", "l", "r").alias("block"), "left", "node", "label"), docs, p, text)
    labels = common.connected(first.union(common.stage(rest, "links")), "a", "b")

    return sketches.join(classes, ["set_a", "set_b", "n_shingles"], "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id")) \
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))


def survivors(docs: DataFrame, p: NearDup = NearDup(), text: str = "text") -> DataFrame:
    """One document of every component, the one with the smallest id, in the columns of the input.

    Rows that repeat its id are one row for each set of shingles, the one with the smallest text."""
    kept = common.stage(components(docs, p, text).filter("kept").groupBy("doc_id").count(), "kept")
    again = common.stage(kept.filter("count > 1").select("doc_id"), "repeated")
    once = docs.join(again, "doc_id", "left_anti").join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    many = docs.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for block in common.blocks(batches):
            keys, counts = common.shingles(block.column("text"), p.shingle_words)
            yield pa.RecordBatch.from_arrays([*block.columns, *map(pa.array, [counts.astype(np.int64), *_set_sums(keys, counts)])],
                                             names=["row", "text", "n", "set_a", "set_b"])

    sets = many.mapInArrow(run, T.StructType([*many.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", "set_a", "set_b"))]))
    first = sets.groupBy("row.doc_id", "n", "set_a", "set_b").agg(F.min_by("row", "text").alias("row"))
    return once.union(first.select("row.*"))
