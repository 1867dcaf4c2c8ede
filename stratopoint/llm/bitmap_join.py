"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact intersection of what is left.

A document is the sorted array of its distinct shingle hashes. Texts with equal sets are one representative.

* **Size bands.** A link needs sizes within the threshold of each other. Bands are geometric; a class holds a band and
  those smaller sets that its members can still reach, so every possible pair lies in one class, and a set in one or two.
* **Tiles.** Two linked sets of a class differ in at most d shingles, a number that follows from the largest size of the
  class. Shingles are dealt by hash to d + 1 + e parts, so at least e + 1 parts of linked sets are equal. Every part that is
  not empty is a tile key; the one set in a million that has more than e empty parts also takes the key of
  such sets of its class. Linked sets share a key for certain, nothing is left to chance. Sets with no partner at any
  key never meet anything.
* **Bitmaps.** A set has a bitmap of a power of two of bits, two to four a shingle. Bits that one set has and the
  other lacks each stand for at least one shingle outside the intersection, so their count bounds the overlap
  from above. Bitmaps of different lengths are folded to the shorter.
* **Two passes.** A tile first sees bitmaps only and names the members that could still have a link to another
  component; only their texts travel, and sorted arrays are then intersected. A pair whose members
  are already connected inside the tile is passed over, so a tile emits at most one link a member.

Large groups of near copies: all members of a key first meet one of them (a star, cut into tiles of bounded
size), then components are taken. Keys that still hold several components are sorted by size and cut into blocks; tiles
are pairs of blocks whose sizes can reach the threshold, of which one holds members outside the key's main
component. So no task holds a whole group and no join makes its pairs; every link between different components is found.

Defined results: null and blank texts have an empty set, component = own id. Rows with a null id are left out, rows that
repeat an id get one result row each and are linked by any of their texts. Empty tables give empty results. Only the id and
the text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
MARKS = (0x632BE59BD9B4E019, 0x0FB2D9E1C5A7B46D)      # salts of the two checksums that name a set


@dataclass(frozen=True)
class JaccardJoin:
    shingle_words: int = 5
    percent: int = 80                # link where 100 * intersection >= percent * union
    tile: int = 1024                 # members of one side of a tile
    band_ratio: float = 0.7          # smallest to largest size of a band

    def __post_init__(self):
        if not 75 <= self.percent <= 100:
            raise ValueError("parts of sets that differ in more than a quarter are mostly empty; take a threshold of 75 or more")


@lru_cache(maxsize=8)
def band_edges(percent: int, ratio: float) -> np.ndarray:
    """Smallest set size of every band; all sets below the first edge of 2 are in band 0."""
    edges = [0, 2]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] / ratio)))
    return np.array(edges, np.int64)


@lru_cache(maxsize=None)
def parts_of(smallest: int, largest: int, percent: int) -> tuple[int, int]:
    """Parts for sets of ``smallest`` to ``largest`` shingles, and how many of them may be empty.

    Linked sets differ in at most d shingles, so of d + 1 + e parts at least e + 1 are equal: a set with no more than e
    empty parts shares one with content. e is the least for which a set has more with a probability below one in a million."""
    differ = (2 * largest * (100 - percent)) // (100 + percent)

    def rare(e: int) -> bool:
        m = differ + 1 + e
        if e + 1 >= m:
            return True
        ways = math.lgamma(m + 1) - math.lgamma(e + 2) - math.lgamma(m - e)
        return ways + smallest * math.log1p(-(e + 1) / m) < math.log(1e-6)

    low, high = -1, 1
    while not rare(high):
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if rare(mid) else (mid, high)
    return differ + 1 + high, high


def tile_keys(keys: np.ndarray, counts: np.ndarray, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """All tile keys of the sets in a flat list one after another, and their number for each set."""
    edges = band_edges(p.percent, p.band_ratio)
    off = np.concatenate([[0], np.cumsum(counts)])
    spread = common.mix(keys ^ U64(0x3C79AC492BA7B653))
    value = common.mix(keys ^ U64(0x1C69B3F74AC4AE35))
    found_keys, found_rows = [], []
    band = np.searchsorted(edges, counts, "right") - 1
    upper = edges[band + 1]
    reach = (100 * counts >= p.percent * upper) & (counts > 0)         # could link with sets of the next band
    for klass, rows in [(b, np.flatnonzero((band == b) & (counts > 0))) for b in np.unique(band)] + \
                       [(b + 1, np.flatnonzero((band == b) & reach)) for b in np.unique(band)]:
        if not len(rows):
            continue
        parts, spare = parts_of(max(1, -(-p.percent * int(edges[klass]) // 100)), int(edges[klass + 1]) - 1, p.percent)
        salt = U64(int(klass) * 0xD1342543DE82EF95 & (1 << 64) - 1)
        flat, inner = common.gather(np.arange(len(keys)), off[rows], counts[rows])
        part = ((spread[flat] >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        slot = np.repeat(np.arange(len(rows)), np.diff(inner)) * parts + part
        size = len(rows) * parts
        held = np.bincount(slot, minlength=size)
        order = np.argsort(slot, kind="stable")
        run = np.concatenate([[0], np.cumsum(held)])
        summed = np.concatenate([np.zeros(1, U64), np.cumsum(value[flat][order], dtype=U64)])
        total = summed[run[1:]] - summed[run[:-1]]                     # wrapping sum of the hashes of each part
        full = np.flatnonzero(held)
        name = common.mix(total[full] + held[full].astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (full % parts).astype(U64)
        found_keys.append(common.mix(name + salt))
        found_rows.append(rows[full // parts])
        sparse = np.flatnonzero((held.reshape(len(rows), parts) == 0).sum(1) > spare)
        found_keys.append(np.full(len(sparse), common.mix(np.array([salt], U64))[0], U64))
        found_rows.append(rows[sparse])
    if not found_keys:
        return np.zeros(0, U64), np.zeros(len(counts), np.int64)
    all_keys, all_rows = np.concatenate(found_keys), np.concatenate(found_rows)
    order = np.argsort(all_rows, kind="stable")
    return all_keys[order], np.bincount(all_rows, minlength=len(counts))


def bitmap_bytes(size: int) -> int:
    """Bytes of the bitmap of a set: a power of two, at least 32, two to four bits a shingle."""
    return max(32, (1 << max(0, 2 * size - 1).bit_length()) // 8)


def bitmap(keys: np.ndarray) -> bytes:
    n = bitmap_bytes(len(keys))
    bits = np.zeros(n * 8, bool)
    bits[(common.mix(keys ^ U64(0x2545F4914F6CDD1D)) & U64(n * 8 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """A bitmap of ``n`` bytes from a longer one: bit i stands for all bits that agree with i in the low places."""
    return bits if len(bits) == n else np.bitwise_or.reduce(bits.reshape(-1, n), axis=0)


def possible(sizes: np.ndarray, size: int, outside_a: np.ndarray, outside_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bounds let sets of ``sizes`` link with one of ``size``; ``outside``: bits of one that the other lacks."""
    most = np.minimum(sizes - outside_a, size - outside_b)
    return (100 + percent) * most >= percent * (sizes + size)


class Tile:
    """Members of two blocks; candidates by size and bitmap, links by exact intersection."""

    def __init__(self, left: np.ndarray, label: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int):
        self.left, self.label, self.sizes, self.percent = left, label, sizes, percent
        narrow = min(map(len, maps))
        self.maps = np.stack([folded(np.frombuffer(m, np.uint8), narrow) for m in maps]).view("<u8")
        self.root = list(range(len(sizes)))
        _, first = np.unique(label, return_index=True)                 # what is connected already stays so
        by_label = dict(zip(label[first].tolist(), first.tolist()))
        self.root = [by_label[x] for x in label.tolist()]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def candidates(self, i: int) -> np.ndarray:
        """Members that the bounds let a left member link with, of other labels."""
        at = np.flatnonzero((self.label != self.label[i]) & (100 * np.minimum(self.sizes, self.sizes[i]) >= self.percent * np.maximum(self.sizes, self.sizes[i])))
        if not len(at):
            return at
        mine, other = self.maps[i], self.maps[at]
        return at[possible(self.sizes[at], int(self.sizes[i]), np.bitwise_count(other & ~mine).sum(1, dtype=np.int64),
                           np.bitwise_count(mine & ~other).sum(1, dtype=np.int64), self.percent)]

    def survivors(self) -> np.ndarray:
        out = np.zeros(len(self.sizes), bool)
        for i in np.flatnonzero(self.left).tolist():
            at = self.candidates(i)
            out[at] = True
            out[i] |= len(at) > 0
        return out

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        found = []
        for i in np.flatnonzero(self.left).tolist():
            for j in self.candidates(i).tolist():
                a, b = self.find(i), self.find(j)
                if a != b and linked(sets[i], sets[j], self.percent):
                    self.root[a] = b
                    found.append((i, j))
        return found


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: sorted arrays are intersected by searching the shorter in the longer."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def checksum(keys: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """One number for every set in a flat list, the same wherever the set stands in it."""
    off = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(common.mix(keys ^ U64(salt)), dtype=U64)])
    return (total[off[1:]] - total[off[:-1]]).view(np.int64)


def sketch(docs: DataFrame, p: JaccardJoin, text: str) -> DataFrame:
    """doc_id, n_shingles, two checksums of the set, its bitmap and its tile keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bitmap", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for block in common.blocks(batches, text):
            keys, counts = common.shingles(block.column(text), p.shingle_words)
            off = np.concatenate([[0], np.cumsum(counts)])
            sums = [checksum(keys, counts, salt) for salt in MARKS]
            maps = [bitmap(keys[s:e]) for s, e in zip(off[:-1].tolist(), off[1:].tolist())]
            tiles, have = tile_keys(keys, counts, p)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have)]), pa.int32()), pa.array(tiles.view(np.int64)))
            yield common.arrays(schema, block.column("doc_id").cast(pa.int64()), counts, *sums, pa.array(maps, pa.binary()), lists)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bitmap binary, keys array<long>")


def _tiles(batches, columns: list[str]):
    """The rows of one tile at a time as a table; rows come sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        cut = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for s, e in zip(cut[:-1], cut[1:]):
            if held and held[-1].column("tile")[0].as_py() != tile[s]:
                yield pa.Table.from_batches(held).select(columns).combine_chunks()
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).select(columns).combine_chunks()


def _tile(rows: pa.Table, p: JaccardJoin) -> Tile:
    number = lambda c: rows.column(c).to_numpy()
    return Tile(rows.column("left").to_numpy(zero_copy_only=False), number("label"), number("n"), rows.column("bitmap").to_pylist(), p.percent)


def links(tiles: DataFrame, reps: DataFrame, docs: DataFrame, p: JaccardJoin, text: str, name: str) -> DataFrame:
    """(a, b) confirmed links of different labels inside tiles; ``tiles``: tile, left (boolean), node, label."""
    near_schema = pa.schema([("tile", pa.int64()), ("left", pa.bool_()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()),
                             ("mark", pa.int64()), ("bitmap", pa.binary())])
    pair_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bound(batches):
        for rows in _tiles(batches, near_schema.names):
            keep = _tile(rows, p).survivors()
            if keep.any():
                yield from rows.filter(pa.array(keep)).cast(near_schema).to_batches()

    def solve(batches):
        for rows in _tiles(batches, [*near_schema.names, "text"]):
            sets, marks = [], []
            for part in common.blocks(iter(rows.to_batches())):
                keys, counts = common.shingles(part.column("text"), p.shingle_words)
                sets += np.split(keys, np.cumsum(counts)[:-1])
                marks.append(checksum(keys, counts, MARKS[0]))
            own = np.flatnonzero(np.concatenate(marks) == rows.column("mark").to_numpy())      # not another row's text under the same id
            rows, sets = rows.take(own), [sets[i] for i in own]
            if len(own) < 2:
                continue
            node = rows.column("node").to_numpy()
            found = np.array(_tile(rows, p).links(sets), np.int64).reshape(-1, 2)
            if len(found):
                yield common.arrays(pair_schema, node[found[:, 0]], node[found[:, 1]])

    signed = tiles.join(reps.select("node", "n", "mark", "bitmap"), "node").repartition("tile").sortWithinPartitions("tile", "n", "node")
    near = common.stage(signed.select(*near_schema.names).mapInArrow(bound, "tile long, left boolean, node long, label long, n long, mark long, bitmap binary"), f"near-{name}")
    texts = docs.select(F.col("doc_id").alias("node"), F.col(text).alias("text"))
    full = near.join(texts, "node").repartition("tile").sortWithinPartitions("tile", "n", "node").select(*near_schema.names, "text")
    return common.stage(full.mapInArrow(solve, "a long, b long"), f"links-{name}")


def _stars(members: DataFrame, p: JaccardJoin) -> DataFrame:
    """Tiles in which the members of every key meet one of them."""
    pairs = members.filter("node <> center").select("center", "node").distinct()
    parts = pairs.groupBy("center").agg(F.ceil(F.count("*") / p.tile).alias("parts"))
    spread = pairs.join(parts, "center").select(F.xxhash64("center", F.pmod(F.xxhash64("node"), "parts")).alias("tile"), F.lit(False).alias("left"), "node")
    centers = parts.select("center", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")) \
        .select(F.xxhash64("center", "part").alias("tile"), F.lit(True).alias("left"), F.col("center").alias("node"))
    return spread.union(centers).withColumn("label", F.col("node"))


def _band_tiles(members: DataFrame, labels: DataFrame, p: JaccardJoin) -> DataFrame:
    """Tiles of the keys that hold several components: blocks by size, of which the left hold what is outside the main one."""
    labelled = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"))
    mixed = per_label.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("rows", "label")).alias("main"),
                                         F.sum("rows").alias("rows"), F.sum("sum").alias("sum")).filter("labels > 1") \
        .groupBy("rows", "sum").agg(F.min("key").alias("key"), F.min_by("main", "key").alias("main"))      # equal groups once
    rows = labelled.join(mixed.select("key", "main"), "key") \
        .withColumn("size_band", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / 0.97))).withColumn("outside", F.col("label") != F.col("main"))
    bands = rows.groupBy("key", "size_band").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.ceil(F.count("*") / p.tile).alias("rs"),
                                                 F.ceil(F.count_if("outside") / p.tile).alias("ls"))
    per_key = bands.groupBy("key").agg(F.collect_list(F.struct("size_band", "low", "high", "ls", "rs")).alias("bands"))     # some dozens: a class spans a fixed ratio of sizes
    rows = rows.join(per_key, "key").withColumn("own", F.filter("bands", lambda b: b.size_band == F.col("size_band"))[0])
    near = F.filter("bands", lambda b: (100 * b.high >= p.percent * F.col("own.low")) & (100 * F.col("own.high") >= p.percent * b.low))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.filter("outside").select("*", F.explode(near).alias("other")).select("*", upto("other.rs").alias("r")) \
        .select(F.xxhash64("key", "size_band", F.pmod(F.xxhash64("node", F.lit(1)), "own.ls"), "other.size_band", "r").alias("tile"), F.lit(True).alias("left"), "node", "label")
    right = rows.select("*", F.explode(F.filter(near, lambda b: b.ls > 0)).alias("other")).select("*", upto("other.ls").alias("l")) \
        .select(F.xxhash64("key", "other.size_band", "l", "size_band", F.pmod(F.xxhash64("node", F.lit(2)), "own.rs")).alias("tile"), F.lit(False).alias("left"), "node", "label")
    return left.union(right)


def components(docs: DataFrame, p: JaccardJoin = JaccardJoin(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    docs = common.non_null_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    whole = ["set_a", "set_b", "n_shingles"]
    sketches = common.stage(sketch(docs, p, text), "sets")
    classes = sketches.filter("n_shingles > 0").groupBy(*whole).agg(F.min("doc_id").alias("rep"))
    reps = sketches.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *whole], "left_semi") \
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.col("set_a").alias("mark"), "bitmap", "keys")
    reps = common.stage(reps, "representatives")
    band = reps.select("node", "n", F.explode("keys").alias("key"))
    sized = band.groupBy("key").agg(F.count("*").alias("rows"), F.min_by("node", F.xxhash64("node", "key")).alias("center")).filter("rows > 1")
    members = common.stage(band.join(sized.select("key", "center"), "key"), "members")

    first = links(_stars(members, p), reps, docs, p, text, "stars")
    labels = common.connected(first, "a", "b")
    rest = links(_band_tiles(members, labels, p), reps, docs, p, text, "bands")
    labels = common.connected(first.union(rest), "a", "b")
    return sketches.join(classes, whole, "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("doc_id", "n_shingles", F.coalesce("label", "rep", "doc_id").alias("component_id"))
