"""Exact neighbour search on parts of a space-filling curve.

Queries and points together are range-partitioned along a Z-order curve, so a part holds both in about the same
place. One shuffle; then

* **at home** every query looks for its neighbours among the points of its own part. A part is sorted along the curve and
  cut into small leaves with bounding boxes; units of queries go through leaves in order of their least possible
  distance until no leaf can matter.
* **abroad** only queries whose ball (the k-th distance found at home, or the radius) reaches the box of another part go
  there, packed by unit. Everything else is final.
* **without a home** (a part with fewer than k points) a unit first asks the nearest part that has k, which gives its ball.

Parts that very many units ask are repeated for as many tasks as the units need; a radius count adds a part or leaf
that lies wholly inside the ball without opening it. The curve runs over order statistics of each axis, so stray points and
dense spots do not coarsen it, and ties of the curve are divided by coordinate. Only one box per part reaches the
driver (a few while there are few parts); parts grow with the input beyond ``MAX_PARTS``, which bounds that. Nothing emits
all pairs.

Rows with equal coordinates are one entry with a multiplicity, so copies of a point cannot blow up a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import constant_rows
from ..session import cut, ship_package

PART = 1 << 17          # entries of a part: large, so that few balls leave it
LEAST_PART = 1 << 12    # of a part that is cut for the cores alone
MAX_PARTS = 1 << 18     # parts at most
MAX_BOXES = 1 << 18     # boxes of all parts; the driver and every task hold them
PART_BOXES = 256        # boxes of a part, as far as that allows
LEAF = 16               # points of a leaf
GROUP = 32              # leaves that are looked at together first
UNIT = 64               # queries that go through the leaves together
ASKED = 1024            # units of queries that ask one copy of a part
STEP = 32               # leaves opened at once
FINE = 1 << 20          # steps of an axis along the curve
SLACK = 1 + 1e-12
XYZ = ("x", "y", "z")
OFFSET = ("dx", "dy", "dz")

FINAL, PARTIAL, PROBE, HOMELESS = range(4)
PARTS = "part int, n_q long, n_p long, total long, repeated long, queries binary, points binary, boxes binary"
PARTS_SCHEMA = pa.schema([("part", pa.int32()), ("n_q", pa.int64()), ("n_p", pa.int64()), ("total", pa.int64()), ("repeated", pa.int64()),
                          ("queries", pa.binary()), ("points", pa.binary()), ("boxes", pa.binary())])
MESSAGE = "kind int, target int, home int, n long, payload binary"
MESSAGE_SCHEMA = pa.schema([("kind", pa.int32()), ("target", pa.int32()), ("home", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
QUERY = (("eid", "<i8"), ("copies", "<i8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("bound", "<f8"))
POINT = (("eid", "<i8"), ("n", "<i8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"))
FOUND = (("eid", "<i8"), ("copies", "<i8"), ("rank", "<i8"), ("neighbour", "<i8"), ("d2", "<f8"), ("dx", "<f8"), ("dy", "<f8"), ("dz", "<f8"))
COUNTED = (("eid", "<i8"), ("copies", "<i8"), ("c", "<i8"))
Columns = dict[str, np.ndarray]


def packed(kinds, columns: Columns) -> bytes:
    return b"".join(np.ascontiguousarray(columns[c], t).tobytes() for c, t in kinds)


def unpacked(kinds, raw: bytes, n: int) -> Columns:
    return {c: np.frombuffer(raw, t, n, 8 * n * i) for i, (c, t) in enumerate(kinds)}


def taken(columns: Columns, at) -> Columns:
    return {c: v[at] for c, v in columns.items()}


def usable() -> Column:
    """Rows with a place; the others have no neighbours."""
    ok = F.lit(True)
    for c in XYZ:
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return ok


def entries(df: DataFrame, keep: int = 1) -> DataFrame:
    """Distinct coordinates with multiplicity n; with keep > 1 the ``keep`` lowest ids each, the first as the query of all."""
    clean = df.where(usable()).select(F.col("point_id").cast("long").alias("eid"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    whole = clean.groupBy(*XYZ).agg(F.min("eid").alias("eid"), F.count(F.lit(1)).alias("n")).select("eid", *XYZ, "n", F.col("n").alias("copies"))
    if keep == 1:
        return whole
    again = whole.where("n > 1").select(*XYZ, "copies")               # only these are looked at once more
    rank = F.row_number().over(Window.partitionBy(*XYZ).orderBy("eid"))
    lowest = clean.join(again, list(XYZ)).withColumn("rn", rank).where(F.col("rn") <= keep)
    return whole.where("n = 1").unionByName(lowest.select("eid", *XYZ, F.lit(1).cast("long").alias("n"), F.when(F.col("rn") == 1, F.col("copies")).alias("copies")))


# Order statistics of an axis: one scale in length between the outer two of all axes, so that cells are cubes and a flat
# cloud is not cut into sheets; beyond them by rank, so that a few points far away take a margin and not the whole curve.
BULK, MARGIN = 2.0 ** -9, 1 / 64
TAIL = [0.0, *(2.0 ** -k for k in range(14, 9, -1)), BULK]
RANKS = [*TAIL, *(1 - r for r in reversed(TAIL))]


def along_curve(ent: DataFrame) -> DataFrame:
    """Add ``curve``, the place on a Z-order curve through cubes, its margins over order statistics of each axis."""
    marks = {}
    at = np.array(ent.approxQuantile(list(XYZ), RANKS, 1e-4))
    inner = at[:, [len(TAIL) - 1, len(TAIL)]]
    length = max(float((inner[:, 1] - inner[:, 0]).max()), 1e-300)
    for c, q, (low, high) in zip(XYZ, at, inner):
        tail = MARGIN * np.array(TAIL) / BULK
        place = np.concatenate([tail, MARGIN + (high - low) / length * (1 - 2 * MARGIN) + MARGIN - tail[::-1]])
        values, last = np.unique(q, return_index=True)
        marks[c] = (values, place[last])

    def run(batches):
        for batch in batches:
            key = np.zeros(len(batch), np.int64)
            for i, c in enumerate(XYZ):
                step = np.minimum(np.interp(batch.column(c).to_numpy(), *marks[c]) * FINE, FINE - 1).astype(np.int64)
                for bit in range(20):
                    key |= (step >> bit & 1) << (3 * bit + i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "curve"])

    return ent.mapInArrow(run, T.StructType([*ent.schema.fields, T.StructField("curve", T.LongType())]))


@dataclass
class Boxes:
    """Parts that have points, and the boxes of runs of their points along the curve; ``owner`` counts in ``part``."""

    part: np.ndarray
    points: np.ndarray
    total: np.ndarray
    owner: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def __post_init__(self):
        self.first = np.searchsorted(self.owner, np.arange(len(self.part) + 1))
        self.part_lo, self.part_hi = (f.reduceat(c, self.first[:-1]) if len(c) else c for f, c in ((np.minimum, self.lo), (np.maximum, self.hi)))

    def gaps(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Squared least distance of a box to every box."""
        return squared_gap(lo, hi, self.lo, self.hi)

    def near(self, lo: np.ndarray, hi: np.ndarray, limit: float, skip: Sequence[int] = ()) -> np.ndarray:
        """Boxes within ``limit`` of a box; only parts that are as near as that are opened, and none in ``skip``."""
        parts = np.flatnonzero(squared_gap(lo, hi, self.part_lo, self.part_hi) <= limit)
        parts = parts[~np.isin(self.part[parts], skip)]
        if not len(parts):
            return parts
        at = np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in parts.tolist()])
        return at[squared_gap(lo, hi, self.lo[at], self.hi[at]) <= limit]

    def inside(self, lo: np.ndarray, hi: np.ndarray, limit: float) -> np.ndarray:
        """Parts of which every box is within ``limit`` of every place in a box."""
        whole = np.zeros(len(self.part), bool)
        for i in np.flatnonzero(squared_gap(lo, hi, self.part_lo, self.part_hi) <= limit).tolist():
            mine = slice(self.first[i], self.first[i + 1])
            whole[i] = (squared_span(lo, hi, self.lo[mine], self.hi[mine]) * SLACK <= limit).all()
        return whole


def runs(points: Columns, size: int) -> np.ndarray:
    """Low and high corners of every ``size`` points, a row each."""
    starts = np.arange(0, len(points["eid"]), size)
    return np.stack([f.reduceat(points[c], starts) for f in (np.minimum, np.maximum) for c in XYZ], 1) if len(starts) else np.zeros((0, 6))


def squared_gap(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared least distance between boxes, the last axis being x, y, z."""
    gap = np.maximum(np.maximum(lo - other_hi, other_lo - hi), 0.0)
    return (gap * gap).sum(-1)


def squared_span(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Squared greatest distance between boxes."""
    far = np.maximum(hi - other_lo, other_hi - lo)
    return (far * far).sum(-1)


class Leaves:
    """The points of a part in curve order, cut into leaves, and groups of them."""

    def __init__(self, points: Columns, leaf: int):
        self.points, self.leaf, self.n = points, leaf, len(points["eid"])
        box = runs(points, leaf)
        self.lo, self.hi = box[:, :3], box[:, 3:]
        self.total = np.add.reduceat(points["n"], np.arange(0, self.n, leaf)) if self.n else np.zeros(0, np.int64)
        first = np.arange(0, len(box), GROUP)
        self.group_lo, self.group_hi, self.group_total = (f.reduceat(v, first) if len(v) else v for f, v in
                                                          ((np.minimum, self.lo), (np.maximum, self.hi), (np.add, self.total)))
        self.group_size = np.minimum(GROUP * leaf, self.n - GROUP * leaf * np.arange(len(first)))

    def of_groups(self, groups: np.ndarray) -> np.ndarray:
        at = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
        return at[at < len(self.lo)]

    def members(self, leaves: np.ndarray) -> np.ndarray:
        at = (leaves[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        return at[at < self.n]

    def distances2(self, q: Columns, at: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q["x"]), len(at)))
        for c in XYZ:
            d = q[c][:, None] - self.points[c][at][None, :]
            total += d * d
        return total

    def nearest(self, q: Columns, k: int, limit: float | None, strict: bool) -> tuple[Columns, np.ndarray]:
        """The k nearest of a unit of queries within their bounds, and the bounds that follow."""
        lo, hi = corners(q)
        bound, found = q["bound"].copy(), []
        far = squared_gap(lo, hi, self.group_lo, self.group_hi)

        def near(groups: np.ndarray) -> np.ndarray:
            """Leaves of the groups that can matter, the nearest first."""
            some = self.of_groups(groups)
            least = squared_gap(lo, hi, self.lo[some], self.hi[some])
            order = np.argsort(least, kind="stable")
            order = order[: np.searchsorted(least[order], bound.max() * SLACK, side="right")]
            return some[order]

        def open_(leaves: np.ndarray, live: np.ndarray) -> None:
            ids = self.members(leaves)
            d2 = self.distances2({c: q[c][live] for c in XYZ}, ids)
            if len(ids) >= k:
                bound[live] = np.minimum(bound[live], np.partition(d2, k - 1, axis=1)[:, k - 1])
            row, col = np.divmod(np.flatnonzero(d2 <= bound[live][:, None]), len(ids))
            found.append((live[row], ids[col], d2[row, col]))

        order = np.argsort(far, kind="stable")                  # a few leaves beside the unit give the first bounds
        order = order[: 1 + np.searchsorted(np.cumsum(self.group_size[order]), k)]
        opened = near(order)[: 1 + -(-2 * k // self.leaf)]
        if len(opened):
            open_(opened, np.arange(len(bound)))
        rest = near(np.flatnonzero(far <= bound.max() * SLACK))
        rest = rest[~np.isin(rest, opened)]
        least = squared_gap(lo, hi, self.lo[rest], self.hi[rest])
        for at in range(0, len(rest), STEP):
            live = np.flatnonzero(bound * SLACK >= least[at])    # the others are done
            if not len(live):
                break
            some = rest[at: at + STEP]
            some = some[squared_gap(*corners({c: q[c][live] for c in XYZ}), self.lo[some], self.hi[some]) <= bound[live].max() * SLACK]
            if len(some):
                open_(some, live)
        row, col, d2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        good = d2 <= bound[row]
        if limit is not None:
            good &= d2 < limit if strict else d2 <= limit
        row, col, d2 = row[good], col[good], d2[good]
        order = np.lexsort((self.points["eid"][col], d2, row))
        row, col, d2 = row[order], col[order], d2[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        row, col, d2, rank = (v[rank <= k] for v in (row, col, d2, rank))
        last = rank == k
        bound[row[last]] = np.minimum(bound[row[last]], d2[last])
        offset = {o: self.points[c][col] - q[c][row] for o, c in zip(OFFSET, XYZ)}
        return {"eid": q["eid"][row], "copies": q["copies"][row], "rank": rank, "neighbour": self.points["eid"][col], "d2": d2, "row": row, "col": col, **offset}, bound

    def within(self, q: Columns, limit: float, enough: int | None = None) -> np.ndarray:
        """Points in the closed ball of every query of a unit; groups and leaves wholly inside all balls are not opened.

        With ``enough`` counting ends, the nearest leaves first, when every query has as many."""
        lo, hi = corners(q)
        inside = squared_span(lo, hi, self.group_lo, self.group_hi) * SLACK <= limit
        count = np.full(len(q["x"]), self.group_total[inside].sum())
        some = self.of_groups(np.flatnonzero(~inside & (squared_gap(lo, hi, self.group_lo, self.group_hi) <= limit * SLACK)))
        inside = squared_span(lo, hi, self.lo[some], self.hi[some]) * SLACK <= limit
        count += self.total[some[inside]].sum()
        gap = squared_gap(lo, hi, self.lo[some], self.hi[some])
        cut_ = ~inside & (gap <= limit * SLACK)
        some = some[cut_] if enough is None else some[cut_][np.argsort(gap[cut_], kind="stable")]
        for at in range(0, len(some), STEP):
            if enough is not None and count.min() >= enough:
                break
            ids = self.members(some[at: at + STEP])
            count += ((self.distances2(q, ids) <= limit).astype(float) @ self.points["n"][ids].astype(float)).astype(np.int64)
        return count


def corners(q: Columns) -> tuple[np.ndarray, np.ndarray]:
    return np.array([q[c].min() for c in XYZ]), np.array([q[c].max() for c in XYZ])


class Parts:
    """The common parts of queries and points as a written table, and the boxes of their points."""

    def __init__(self, both: DataFrame):
        """``both``: eid, x, y, z, n (null: no point), copies (null: no query)."""
        both = cut(both)
        size = both.count()
        cores = both.sparkSession.sparkContext.defaultParallelism
        self.count = max(1, min(MAX_PARTS, max(-(-size // PART), min(2 * cores, size // LEAST_PART))))
        per_part = max(1, min(PART_BOXES, MAX_BOXES // self.count))
        dealt = along_curve(both).repartitionByRange(self.count, "curve", *XYZ) if size else both.withColumn("curve", F.lit(0))

        def run(batches):
            held = [b for b in batches if len(b)]
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            value = {c: rows.column(c).fill_null(0).to_numpy() for c in ("eid", "n", "copies", *XYZ, "curve")}
            value["bound"] = np.full(len(rows), np.inf)
            order = np.lexsort((value["x"], value["curve"]))
            q = taken(value, order[rows.column("copies").is_valid().to_numpy(zero_copy_only=False)[order]])
            p = taken(value, order[rows.column("n").is_valid().to_numpy(zero_copy_only=False)[order]])
            box = runs(p, max(1, -(-len(p["eid"]) // per_part)))
            row = (TaskContext.get().partitionId(), len(q["eid"]), len(p["eid"]), int(p["n"].sum()), int((q["copies"] > 1).sum()),
                   packed(QUERY, q), packed(POINT, p), box.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PARTS_SCHEMA, strict=True)], schema=PARTS_SCHEMA)

        self.table = cut(dealt.mapInArrow(run, PARTS))
        held = self.table.select("part", "n_p", "total", "repeated", "boxes").toPandas()
        self.repeated = int(held["repeated"].sum())
        held = held[held["n_p"] > 0]
        box = [np.frombuffer(b, np.float64).reshape(-1, 6) for b in held["boxes"]]
        corner = np.concatenate([np.zeros((0, 6)), *box])
        self.boxes = Boxes(held["part"].to_numpy(), held["n_p"].to_numpy(), held["total"].to_numpy(), np.repeat(np.arange(len(box)), [len(b) for b in box]),
                           corner[:, :3], corner[:, 3:])


def rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def message(kind: int, kinds, columns: Columns, target: int = -1, home: int = -1) -> pa.RecordBatch:
    row = (kind, target, home, len(columns["eid"]), packed(kinds, columns))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, MESSAGE_SCHEMA, strict=True)], schema=MESSAGE_SCHEMA)


def abroad(q: Columns, boxes: Boxes, skip: Sequence[int]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """For every other part that the balls of a unit reach: which queries go there, and the message that takes them."""
    lo, hi = corners(q)
    place = np.stack([q[c] for c in XYZ], 1)
    near = boxes.near(lo, hi, q["bound"].max() * SLACK, skip)
    for i in np.unique(boxes.owner[near]).tolist():
        mine = near[boxes.owner[near] == i]
        some = (squared_gap(place[:, None], place[:, None], boxes.lo[mine], boxes.hi[mine]) <= q["bound"][:, None] * SLACK).any(1)
        if some.any():
            yield some, message(PROBE, QUERY, taken(q, some), int(boxes.part[i]))


def local_curve(q: Columns) -> np.ndarray:
    """Place on a Z-order curve through the box of the queries."""
    lo, hi = corners(q)
    size = max(float((hi - lo).max()), 1e-300)
    key = np.zeros(len(q["x"]), np.int64)
    for i, c in enumerate(XYZ):
        step = np.minimum((q[c] - lo[i]) / size * 1024, 1023).astype(np.int64)
        for bit in range(10):
            key |= (step >> bit & 1) << (3 * bit + i)
    return key


def at_parts(asked: DataFrame, parts: Parts, answer) -> DataFrame:
    """``answer(queries of a unit, home, leaves, part)`` at the part that messages name, for units of neighbouring queries
    out of all messages from one home; a part that more than ``ASKED`` units ask is repeated, so no task holds all who
    ask one place."""
    leaf, unit = LEAF, UNIT
    copies = asked.groupBy("target").agg(F.ceil(F.sum("n") / (ASKED * UNIT)).alias("copies"))
    held = parts.table.select(F.col("part").alias("target"), "n_p", "points").join(copies, "target") \
        .select("target", "n_p", "points", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    sent = asked.join(copies, "target").withColumn("copy", F.pmod(F.xxhash64("payload"), "copies"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return MESSAGE_SCHEMA.empty_table()
        here = right.slice(0, 1).to_pylist()[0]
        leaves = Leaves(unpacked(POINT, here["points"], here["n_p"]), leaf)
        by_home: dict[int, list[Columns]] = {}
        for row in rows_of(left.to_batches()):
            by_home.setdefault(row["home"], []).append(unpacked(QUERY, row["payload"], row["n"]))
        out = []
        for home, asks in by_home.items():
            q = {c: np.concatenate([a[c] for a in asks]) for c, _ in QUERY}
            q = taken(q, np.argsort(local_curve(q), kind="stable"))
            for at in range(0, len(q["eid"]), unit):
                out += answer(taken(q, slice(at, at + unit)), home, leaves, here["target"])
        return pa.Table.from_batches(out, MESSAGE_SCHEMA)

    return sent.groupBy("target", "copy").cogroup(held.groupBy("target", "copy")).applyInArrow(run, MESSAGE)


def opened(messages: DataFrame, kinds) -> DataFrame:
    """The rows inside result messages."""
    fields = ", ".join(f"{c} {'long' if t == '<i8' else 'double'}" for c, t in kinds)

    def run(batches):
        for row in rows_of(batches):
            got = unpacked(kinds, row["payload"], row["n"])
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], list(got))

    return messages.select("payload", "n").mapInArrow(run, fields)


def _both(queries: DataFrame, points: DataFrame, keep: int) -> DataFrame:
    """Queries and points in one table; a cloud asked about itself is there once."""
    p = entries(points, keep)
    if queries is points:
        return p
    none = F.lit(None).cast("long")
    return entries(queries).select("eid", *XYZ, none.alias("n"), "copies").unionByName(p.withColumn("copies", none))


def _by_unit(row: dict, bound: float) -> Iterator[Columns]:
    q = unpacked(QUERY, row["queries"], row["n_q"])
    for at in range(0, row["n_q"], UNIT):
        yield taken(q, slice(at, at + UNIT)) | {"bound": np.full(min(UNIT, row["n_q"] - at), bound)}


def _to_rows(queries: DataFrame, parts: Parts, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """From one answer per distinct coordinate to one per query row; only coordinates that repeat are joined."""
    alone = found.where("copies = 1").select(F.col("eid").cast(queries.schema["point_id"].dataType).alias("point_id"), *columns)
    if not parts.repeated:
        return alone
    rows = queries.where(usable()).select("point_id", *[F.col(c).cast("double").alias(c) for c in XYZ])
    again = rows.groupBy(*XYZ).agg(F.min(F.col("point_id").cast("long")).alias("eid"), F.count(F.lit(1)).alias("n")).where("n > 1").select("eid", *XYZ)
    named = rows.join(again, list(XYZ)).select("point_id", "eid")
    return alone.unionByName(found.where("copies > 1").join(named, "eid").select("point_id", *columns))


def knn_join(queries: DataFrame, points: DataFrame, k: int = 1, max_radius: float | None = None,
             strict: bool = True, offsets: bool = False) -> DataFrame:
    """The k nearest points of every query: point_id, rank (1..), neighbour, distance2; with ``offsets`` also
    dx, dy, dz from the query to the neighbour.

    Exact; ties go to the lower neighbour id. A query that is itself a point
    finds itself. ``max_radius`` limits the search (strictly below it when
    ``strict``). Queries without any neighbour give no row.
    """
    best, parts = _search(queries, points, k, max_radius, strict, FOUND, lambda got: got)
    at_home, partial = best
    rest = partial.select(*(F.col(c).cast("long") if c == "rank" else c for c, _ in FOUND))
    found = at_home.unionByName(rest).withColumnRenamed("d2", "distance2").withColumn("rank", F.col("rank").cast("int"))
    return _to_rows(queries, parts, found, ["rank", "neighbour", "distance2", *(OFFSET if offsets else ())])


Terms = Callable[[dict, Callable], dict]


def knn_sums(queries: DataFrame, points: DataFrame, k: int, terms: Terms, first: int = 1, max_radius: float | None = None,
             strict: bool = True) -> DataFrame:
    """point_id and sums over its k nearest points, from the ``first`` one on, as ``knn_join`` finds them.

    ``terms(row, sqrt)`` gives the summands by name out of d2, dx, dy and dz, which are arrays or columns. A query that
    ends at home is summed there, so its neighbours are never written; rows with one id are added up.
    """
    names = list(terms({c: np.zeros(0) for c in ("d2", *OFFSET)}, np.sqrt))
    kinds = (("eid", "<i8"), ("copies", "<i8"), *((c, "<f8") for c in names))

    def summed(got: Columns) -> Columns:
        got = taken(got, got["rank"] >= first)
        at = np.flatnonzero(np.diff(got["row"], prepend=-1))
        values = terms(got, np.sqrt)
        return {"eid": got["eid"][at], "copies": got["copies"][at],
                **{c: np.add.reduceat(np.broadcast_to(v, len(got["row"])), at, dtype=float) if len(at) else np.zeros(0) for c, v in values.items()}}

    (at_home, partial), parts = _search(queries, points, k, max_radius, strict, kinds, summed)
    columns = terms({c: F.col(c) for c in ("d2", *OFFSET)}, F.sqrt)
    rest = partial.where(F.col("rank") >= first).groupBy("eid").agg(F.max("copies").alias("copies"), *[F.sum(v if isinstance(v, Column) else F.lit(float(v))).alias(c) for c, v in columns.items()])
    rows = _to_rows(queries, parts, at_home.unionByName(rest), names)
    return rows.groupBy("point_id").agg(*[F.sum(c).alias(c) for c in names])


def _search(queries: DataFrame, points: DataFrame, k: int, max_radius: float | None, strict: bool, kinds, fold) -> tuple[tuple[DataFrame, DataFrame], Parts]:
    """What ``fold`` makes of the neighbours of queries that end at home, as columns ``kinds``, and the ranked neighbours of the others."""
    ship_package(queries.sparkSession)
    parts = Parts(_both(queries, points, k))
    boxes, leaf = parts.boxes, LEAF
    limit = None if max_radius is None else float(max_radius) ** 2
    start = math.inf if limit is None else limit

    def home(batches):
        for row in rows_of(batches):
            leaves = Leaves(unpacked(POINT, row["points"], row["n_p"]), leaf)
            part = row["part"]
            for q in _by_unit(row, start):
                got, q["bound"] = leaves.nearest(q, k, limit, strict)
                lost = np.isinf(q["bound"])
                full = np.flatnonzero(boxes.points >= k)
                out = np.zeros(len(lost), bool)
                if lost.any() and len(full):                          # the ball comes from the nearest part that has k points
                    lo, hi = corners(q)
                    fit = np.flatnonzero(np.isin(boxes.owner, full))
                    near = boxes.owner[fit[np.argmin(boxes.gaps(lo, hi)[fit])]]
                    out |= lost
                    yield message(HOMELESS, QUERY, taken(q, lost), int(boxes.part[near]), part)
                here = np.flatnonzero(~out)
                if len(here):
                    for some, sent in abroad(taken(q, here), boxes, [part]):
                        out[here[some]] = True
                        yield sent
                left = out[got["row"]]
                if left.any():
                    yield message(PARTIAL, FOUND, taken(got, left))
                done = fold(taken(got, ~left))
                if len(done["eid"]):
                    yield message(FINAL, kinds, done)

    def refound(q, home_part, leaves, part):
        got, q["bound"] = leaves.nearest(q, k, limit, strict)
        yield message(PARTIAL, FOUND, got)
        for _, sent in abroad(q, boxes, [home_part, part]):
            yield sent

    def found_there(q, home_part, leaves, part):
        yield message(PARTIAL, FOUND, leaves.nearest(q, k, limit, strict)[0])

    at_home = cut(parts.table.where("n_q > 0").mapInArrow(home, MESSAGE))
    everything = [at_home]
    if at_home.where(F.col("kind") == HOMELESS).head(1):
        everything.append(cut(at_parts(at_home.where(F.col("kind") == HOMELESS), parts, refound)))
    asked = _union([m.where(F.col("kind") == PROBE) for m in everything])
    partial = opened(_union([m.where(F.col("kind") == PARTIAL) for m in everything] + [at_parts(asked, parts, found_there)]), FOUND)
    rank = F.row_number().over(Window.partitionBy("eid").orderBy("d2", "neighbour"))
    merged = partial.withColumn("rank", rank).where(F.col("rank") <= k)
    return (opened(at_home.where(F.col("kind") == FINAL), kinds), merged), parts


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def radius_count(queries: DataFrame, points: DataFrame, radius: float, enough: int | None = None) -> DataFrame:
    """point_id, n: points within ``radius`` (closed), copies and the point itself included.

    Leaves, groups of them and parts wholly inside the sphere add their size without being opened. With ``enough`` a
    count may end there: n is exact below it and at least that many otherwise.
    """
    ship_package(queries.sparkSession)
    parts = Parts(_both(queries, points, 1))
    boxes, leaf, limit = parts.boxes, LEAF, float(radius) ** 2

    def home(batches):
        for row in rows_of(batches):
            leaves, part = Leaves(unpacked(POINT, row["points"], row["n_p"]), leaf), row["part"]
            for q in _by_unit(row, limit):
                lo, hi = corners(q)
                whole = boxes.inside(lo, hi, limit) & (boxes.part != part)
                count = leaves.within(q, limit, enough) + boxes.total[whole].sum()
                out = np.zeros(len(count), bool)
                ask = np.flatnonzero(count < enough) if enough is not None else np.arange(len(count))
                if len(ask):
                    for some, sent in abroad(taken(q, ask), boxes, [part, *boxes.part[whole].tolist()]):
                        out[ask[some]] = True
                        yield sent
                got = {"eid": q["eid"], "copies": q["copies"], "c": count}
                for kind, rows in ((FINAL, ~out), (PARTIAL, out)):
                    if rows.any():
                        yield message(kind, COUNTED, taken(got, rows))

    def counted(q, home_part, leaves, part):
        yield message(PARTIAL, COUNTED, {"eid": q["eid"], "copies": q["copies"], "c": leaves.within(q, limit, enough)})

    at_home = cut(parts.table.where("n_q > 0").mapInArrow(home, MESSAGE))
    partial = opened(at_home.where(F.col("kind") == PARTIAL).unionByName(at_parts(at_home.where(F.col("kind") == PROBE), parts, counted)), COUNTED)
    summed = partial.groupBy("eid").agg(F.max("copies").alias("copies"), F.sum("c").alias("c"))
    found = opened(at_home.where(F.col("kind") == FINAL), COUNTED).unionByName(summed).withColumnRenamed("c", "n")
    nowhere = queries.where(~usable()).select("point_id", F.lit(0).cast("long").alias("n"))
    return _to_rows(queries, parts, found, ["n"]).unionByName(nowhere)


def nn_transfer(target: DataFrame, source: DataFrame, cols: Sequence[str], default: Sequence[float],
                radius: float = 1.0) -> DataFrame:
    """Every target row takes ``cols`` of the nearest source row closer than ``radius``, else ``default``."""
    near = knn_join(target, source, 1, radius).select("point_id", "neighbour")
    given = source.select(F.col("point_id").alias("neighbour"), *[F.col(c).alias("_" + c) for c in cols])
    found = near.join(given, "neighbour").drop("neighbour")
    out = target.join(found, "point_id", "left")
    filled = {c: F.coalesce(F.col("_" + c), F.lit(d)) for c, d in zip(cols, default)}
    return out.withColumns(filled).drop(*["_" + c for c in cols])


def nn_lookup(queries: DataFrame, cloud: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values of the nearest cloud point at any distance, with that distance; NaN reads as no value."""
    near = knn_join(queries, cloud, 1).select("point_id", "neighbour", F.sqrt("distance2").alias("distance"))
    given = cloud.select(F.col("point_id").alias("neighbour"),
                         *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    return near.join(given, "neighbour")


def radius_outlier(df: DataFrame, nb: int, radius: float) -> DataFrame:
    """Keep points with more than ``nb`` points (itself included) within ``radius``."""
    keep = radius_count(df, df, radius, nb + 1).where(F.col("n") > nb).select("point_id")
    return df.join(keep, "point_id", "left_semi")


def mean_distances(df: DataFrame, k: int) -> DataFrame:
    """point_id, mean distance to the k nearest points, itself included."""
    return _mean_of(knn_sums(df, df, k, _distance_terms))


def _distance_terms(row: dict, sqrt: Callable) -> dict:
    return {"n": 1.0, "s": sqrt(row["d2"])}


def _mean_of(sums: DataFrame) -> DataFrame:
    return sums.select("point_id", (F.col("s") / F.col("n")).alias("mean_d"))


def statistical_outlier(df: DataFrame, nb: int = 20, ratio: float = 2.0) -> DataFrame:
    """Drop points whose mean neighbour distance exceeds mean + ratio * sd over the cloud."""
    d = cut(mean_distances(df, nb))
    row = d.where("mean_d > 0").agg(F.avg("mean_d").alias("m"), F.stddev_samp("mean_d").alias("s")).first()
    if row["m"] is None:
        return df.limit(0)
    limit = row["m"] + ratio * (row["s"] or 0.0)
    keep = d.where((F.col("mean_d") > 0) & (F.col("mean_d") < limit)).select("point_id")
    return df.join(keep, "point_id", "left_semi")


def clean(df: DataFrame, nb: int = 24, ratio: float = 2.0, count: int = 12, radius: float = 1.2) -> DataFrame:
    """Statistical, then radius outlier removal; all columns come along by point_id."""
    return radius_outlier(cut(statistical_outlier(df, nb, ratio)), count, radius)


def mean_nn_distance(df: DataFrame, k: int = 4, floor: float = 1e-4) -> DataFrame:
    """point_id, mean distance to the k - 1 nearest other points, at least ``floor``."""
    d = _mean_of(knn_sums(df, df, k, _distance_terms, first=2))
    return d.select("point_id", F.greatest(F.col("mean_d"), F.lit(floor)).alias("mean_d"))


def coverage_by_neighbour(target: DataFrame, source: DataFrame, transforms: dict[str, tuple], radius: float) -> DataFrame:
    """candidate, place, n_points, n_hit, coverage: share of target points with a moved source point within ``radius``.

    All candidates are answered by one search: each has its own copy of both clouds, set so far apart along x that
    no two of them can meet. Candidates are a short list given by the caller.
    """
    names = list(transforms)
    box = {}
    for name, df in (("s", source), ("t", target)):
        box[name] = df.agg(*[f(F.abs(c)).alias(f"{n}{c}") for c in XYZ for n, f in (("hi", F.max),)]).first()
    reach = max((box["t"][f"hi{c}"] or 0.0) for c in XYZ)
    rows = []
    for place, (name, (a, b)) in enumerate(transforms.items()):
        a, b = np.asarray(a, float), np.asarray(b, float)
        far = float(np.abs(a).sum(1).max() * max((box["s"][f"hi{c}"] or 0.0) for c in XYZ) + np.abs(b).max())
        reach = max(reach, far)
        rows.append({"place": place, **{f"a{i}": float(v) for i, v in enumerate(a.ravel())}, **{f"b{i}": float(v) for i, v in enumerate(b)}})
    apart = 4.0 * reach + 4.0 * radius + 1.0
    lanes = constant_rows(rows, "place: int, " + ", ".join([*(f"a{i}: double" for i in range(9)), *(f"b{i}: double" for i in range(3))]))
    key = (F.col("point_id") * F.lit(len(names)) + F.col("c.place")).alias("point_id")
    shift = F.col("c.place") * F.lit(apart)
    moved = [sum((F.col(f"c.a{3 * i + j}") * F.col(x) for j, x in enumerate(XYZ)), F.col(f"c.b{i}")) for i in range(3)]
    src = source.withColumn("c", F.explode(lanes)).select(key, (moved[0] + shift).alias("x"), moved[1].alias("y"), moved[2].alias("z"))
    tgt = target.withColumn("c", F.explode(lanes)).select(key, (F.col("x") + shift).alias("x"), "y", "z")
    near = knn_join(tgt, src, 1, radius, strict=False).groupBy((F.col("point_id") % len(names)).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n_hit"))
    total = target.agg(F.count(F.lit(1)))
    label = target.sparkSession.createDataFrame(list(enumerate(names)), "place int, candidate string")
    found = label.join(near, "place", "left").select("candidate", "place", total.scalar().alias("n_points"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))
    return found.withColumn("coverage", F.col("n_hit") / F.col("n_points"))
