"""Centroid clustering with heap-ordered bounds.

Components are scaled and rounded down to integers, so all distances, sums and centroids are exact. A vector keeps
its cluster as long as the *gap* between its distance to the second nearest and to its own centroid is not used
up. When centroids move, the gap of a vector of cluster c shrinks by no more than drift(c) plus the largest drift of
the others. Instead of touching every vector, cluster c adds that to an offset of its own; a gap is stored with the
offset of the time of its scan, and the vectors of a block lie in one heap per cluster in that order. A round pops
the vectors whose stored gap the offset has reached and rescans only those against all centroids; ties are gaps of
nothing, so they are always rescanned. Bounds are rounded against the vector by far more than doubles lose.

Spark's side: vectors are packed into blocks once, in the narrowest integers that hold them, and are never
shuffled. A round is one pass that writes the blocks with their new heaps as a table in the shared folder, the next
round starts from its files, so a lost executor costs its tasks only. A block also reports by how much the vectors
that changed cluster change the sums; clusters x (dimensions + 1) totals are all the driver ever sees, whatever
the number of vectors, and a cluster that holds a third of all vectors is spread over the blocks like any other.

Defined results: rows with a null id, a null vector, another number of components, or a null or non-finite component
are left out. Rows that repeat an id are vectors of their own; equal vectors have equal clusters. With fewer vectors
than clusters every vector starts a cluster. Equal initial hashes are ordered by vector. Components
beyond +-2 ** 27 after scaling raise, because squared distances would leave 64 bits. An empty table gives an empty
result. Only the id and the vector column are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 27
SLACK = 1e-12
BLOCK = "ids binary, width int, vectors binary, cluster binary, sizes array<int>, gaps binary, rows binary, change array<long>"
BLOCK_SCHEMA = pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("vectors", pa.binary()), ("cluster", pa.binary()), ("sizes", pa.list_(pa.int32())),
                          ("gaps", pa.binary()), ("rows", pa.binary()), ("change", pa.list_(pa.int64()))])
RESULT = "vec_id long, cluster int, distance long"
RESULT_SCHEMA = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


@dataclass(frozen=True)
class Clustering:
    dimensions: int = 64
    clusters: int = 16
    rounds: int = 3
    scale: int = 64
    block: int = 8192                # vectors packed into a row
    seed: str = "1"                  # initial centroids: the smallest sha256 of "seed:id"


def usable(vector: str, dimensions: int) -> Column:
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)


class Bounds:
    """The vectors of one block with a heap of (gap + offset at its scan, row) per cluster."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, clusters: int):
        self.ids, self.vectors = ids, vectors
        self.cluster = np.full(len(ids), -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]
        self.change = np.zeros((clusters, vectors.shape[1] + 1), np.int64)

    def expired(self, offsets: np.ndarray) -> list[int]:
        """Rows whose gap is used up, popped from their heaps; at first all rows."""
        if len(self.cluster) and self.cluster[0] < 0:
            return list(range(len(self.cluster)))
        out = []
        for heap, offset in zip(self.heaps, offsets.tolist()):
            while heap and heap[0][0] <= offset:
                out.append(heapq.heappop(heap)[1])
        return out

    def rescan(self, rows: list[int], centroids: np.ndarray, offsets: np.ndarray) -> None:
        """Assign ``rows`` exactly and put them back with fresh gaps."""
        self.change[:] = 0
        if not rows:
            return
        at = np.array(rows)
        x = self.vectors[at].astype(np.int64)
        d = squared(x, centroids)
        own = d.argmin(1).astype(np.int32)             # the first of equals
        near = np.sqrt(d[np.arange(len(at)), own])
        d[np.arange(len(at)), own] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1)) if d.shape[1] > 1 else np.full(len(at), np.inf)
        base = offsets[own]
        keys = np.where(np.isinf(second), np.inf, base + second - near - SLACK * (second + near + base) - 1e-9)
        before = self.cluster[at]
        for c in np.unique(np.concatenate([own, before])):
            if c >= 0:
                came, went = x[(own == c) & (before != c)], x[(before == c) & (own != c)]
                self.change[c, :-1] = came.sum(0) - went.sum(0)
                self.change[c, -1] = len(came) - len(went)
        self.cluster[at] = own
        for c in np.unique(own).tolist():
            mine = np.flatnonzero(own == c)
            entries, heap = list(zip(keys[mine].tolist(), at[mine].tolist())), self.heaps[c]
            if len(entries) * 8 > len(heap):
                heap += entries
                heapq.heapify(heap)
            else:
                for entry in entries:
                    heapq.heappush(heap, entry)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distance of every vector to its own centroid."""
        off = self.vectors.astype(np.int64) - centroids[self.cluster]
        return (off * off).sum(1)

    def packed(self) -> pa.RecordBatch:
        gaps = np.array([g for heap in self.heaps for g, _ in heap], np.float64)
        rows = np.array([r for heap in self.heaps for _, r in heap], np.int32)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (self.ids.tobytes(), self.vectors.itemsize, self.vectors.tobytes(), self.cluster.tobytes(), [len(h) for h in self.heaps],
             gaps.tobytes(), rows.tobytes(), self.change.reshape(-1).tolist()), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)

    @classmethod
    def unpacked(cls, row: dict, clusters: int) -> Bounds:
        ids = np.frombuffer(row["ids"], np.int64)
        out = cls(ids, np.frombuffer(row["vectors"], f"i{row['width']}").reshape(len(ids), -1), clusters)
        out.cluster = np.frombuffer(row["cluster"], np.int32).copy()
        gaps, rows = np.frombuffer(row["gaps"], np.float64).tolist(), np.frombuffer(row["rows"], np.int32).tolist()
        at = 0
        for heap, size in zip(out.heaps, row["sizes"]):
            heap += zip(gaps[at: at + size], rows[at: at + size])      # a list written in heap order is a heap
            at += size
        return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32)


def pack(vectors: DataFrame, p: Clustering) -> DataFrame:
    """Blocks of scaled vectors without bounds; ``vectors``: vec_id, vector."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), p.block):
                part = batch.slice(at, p.block)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = np.floor(p.scale * flat)
                if (np.abs(x) >= LIMIT).any():
                    raise ValueError("a component is too large for exact distances in 64 bits")
                x = narrow(x.astype(np.int64).reshape(len(part), p.dimensions))
                yield Bounds(part.column("vec_id").to_numpy().astype(np.int64), x, p.clusters).packed()

    return vectors.mapInArrow(run, BLOCK)


def _rows(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def advance(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray, p: Clustering) -> DataFrame:
    """One assignment: expired vectors are popped, rescanned and put back."""

    def run(batches):
        for row in _rows(batches):
            block = Bounds.unpacked(row, p.clusters)
            block.rescan(block.expired(offsets), centroids, offsets)
            yield block.packed()

    return blocks.mapInArrow(run, BLOCK)


def assigned(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray, p: Clustering) -> DataFrame:
    """The last assignment as rows: vec_id, cluster, distance."""

    def run(batches):
        for row in _rows(batches):
            block = Bounds.unpacked(row, p.clusters)
            block.rescan(block.expired(offsets), centroids, offsets)
            yield common.arrays(RESULT_SCHEMA, block.ids, block.cluster, block.distances(centroids))

    return blocks.mapInArrow(run, RESULT)


def moved(centroids: np.ndarray, totals: list[int], dimensions: int) -> np.ndarray:
    """Exact means rounded down; a cluster without vectors keeps its centroid."""
    out = centroids.copy()
    for c in range(len(out)):
        *sums, count = totals[c * (dimensions + 1): (c + 1) * (dimensions + 1)]
        if count:
            out[c] = [s // count for s in sums]
    return out


def drifted(offsets: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Offsets after the move from ``old`` to ``new``: own drift plus the largest of the other clusters."""
    drift = np.zeros(len(offsets))
    drift[: len(old)] = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    others = np.array([max(np.delete(drift, c), default=0.0) for c in range(len(drift))])
    return offsets + drift + others


def cluster(vectors: DataFrame, p: Clustering = Clustering(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every usable vector."""
    spark = vectors.sparkSession
    kept = vectors.filter(F.col(key).isNotNull() & usable(vector, p.dimensions)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256), "vector").limit(p.clusters)
    centroids = np.array([[int(np.floor(p.scale * float(x))) for x in r.vector] for r in first.collect()], np.int64).reshape(-1, p.dimensions)
    if not len(centroids):
        return spark.createDataFrame([], f"{RESULT}, cluster_inertia long, inertia long, centroid_sha256 string")

    blocks = common.stage(pack(kept, p), "vectors")
    offsets, totals = np.zeros(p.clusters), [0] * (p.clusters * (p.dimensions + 1))
    for _ in range(p.rounds):
        blocks = common.stage(advance(blocks, centroids, offsets, p), "bounds")
        for r in blocks.select(F.posexplode("change").alias("i", "n")).groupBy("i").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            totals[r.i] += int(r.n)
        new = moved(centroids, totals, p.dimensions)
        offsets, centroids = drifted(offsets, centroids, new), new

    rows = common.stage(assigned(blocks, centroids, offsets, p), "clusters")
    inertia = {r.cluster: int(r.n) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame([(c, n, digest[c]) for c, n in sorted(inertia.items())], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = reduce(int.__add__, inertia.values(), 0)
    return rows.join(F.broadcast(per_cluster), "cluster") \
        .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
