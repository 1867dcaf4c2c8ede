"""Plan-view correlation of a turned model with a target, in blocks of the height raster.

Both rasters are tables of blocks: packed cells of highest z, built in tasks and merged as a stream, so no raster is ever
whole in one place. A pair of a model block and a target window gives, by one product of spectra, all shifts of one
shift block; the products of a shift block are summed before one transform back (overlap-save).

A site that fits one transform is one pair. Beyond that the model is cut into blocks of ``BLOCK`` cells and the target
into windows of twice that; every occupied block meets every occupied window, at every angle: the work grows with the
product of both areas. Rows far outside the bulk are set aside (``bulks``), so a stray point does not widen a raster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import constant_rows
from ..session import cut, ship_package
from .percentiles import finite, quantiles

BLOCK = 1024                # cells per side of a model block beyond one transform
TASK_ROWS = 1 << 18         # points of a task turned together
BROADCAST_BYTES = 64 << 20  # target windows sent to all executors up to this measured size
SPECTRA = 6                 # spectra a task keeps of either side
TAIL = 0.01                 # order statistics that bound the bulk

BLOCKS = "angle double, bi long, bj long, n long, total double, square double, payload binary"
BLOCKS_SCHEMA = pa.schema([("angle", pa.float64()), ("bi", pa.int64()), ("bj", pa.int64()), ("n", pa.int64()), ("total", pa.float64()),
                           ("square", pa.float64()), ("payload", pa.binary())])
BEST = "angle double, score double, px long, py long"
BEST_SCHEMA = pa.schema([("angle", pa.float64()), ("score", pa.float64()), ("px", pa.int64()), ("py", pa.int64())])
BLOCK_KEY = ["angle", "bi", "bj"]
SHIFT_KEY = ["angle", "di", "dj"]


@dataclass
class Bulk:
    """Median place of a cloud, and the box of the rows that are rastered."""

    at: tuple[float, float]
    low: tuple[float, float]
    high: tuple[float, float]

    def rows(self, df: DataFrame) -> DataFrame:
        inside = [F.col(c).between(lo, hi) for c, lo, hi in zip("xy", self.low, self.high)]
        return df.select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).where(inside[0] & inside[1] & finite(F.col("z")))


def bulks(*clouds: DataFrame) -> list[Bulk]:
    """Per cloud the rows between the outer order statistics of x and y, widened by their distance to either side.

    Rows without a finite place are left out; raises when a cloud has none. All clouds are counted in the same passes.
    """
    tagged = [df.select(*[(F.col(c) if k == i else F.lit(None)).cast("double").alias(f"{c}{k}") for k in range(len(clouds)) for c in "xy"])
              for i, df in enumerate(clouds)]
    q = quantiles(reduce(DataFrame.unionByName, tagged), {f"{c}{k}": [TAIL, 0.5, 1 - TAIL] for k in range(len(clouds)) for c in "xy"})
    if any(math.isnan(v) for values in q.values() for v in values):
        raise ValueError("no points with finite coordinates")
    both = [[q[f"{c}{k}"] for c in "xy"] for k in range(len(clouds))]
    return [Bulk(tuple(v[1] for v in axes), tuple(2 * v[0] - v[2] for v in axes), tuple(2 * v[2] - v[0] for v in axes)) for axes in both]


@dataclass
class Side:
    """Lattice of one cloud: cell = floor(turned offset / res) + origin; blocks of ``size`` cells begin every ``stride``."""

    at: tuple[float, float]
    z: float
    origin: tuple[int, int]
    size: int
    stride: int
    window: int | None = None       # cells outside [0, window) are cut off


@dataclass
class Layout:
    """Transform size, both lattices and which shifts of a transform count."""

    res: float
    size: int
    model: Side
    target: Side
    positive: tuple[int, int]       # shifts of a transform from here on are negative

    @property
    def whole(self) -> bool:
        return self.model.size == self.size


def layout(res: float, model: DataFrame, at: tuple[float, float], target: DataFrame, n: int | None = None) -> Layout:
    """Everything in one transform where both fit without wrapping, blocks and windows beyond.

    The model turns about ``at``, the target stays about its mean. With ``n``: one window of n x n cells about either
    middle, and shifts beyond it wrap around.
    """
    box = target.agg(*[f(c).alias(k + c) for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))]).first()
    far = model.agg(F.max(F.hypot(F.col("x") - F.lit(at[0]), F.col("y") - F.lit(at[1]))).alias("reach"), F.avg("z").alias("mz")).first()
    if box["mx"] is None or far["mz"] is None:
        raise ValueError("no points with finite coordinates")
    middle = (box["mx"], box["my"])
    if n:
        return Layout(res, n, Side(at, far["mz"], (n // 2, n // 2), n, n, n), Side(middle, box["mz"], (n // 2, n // 2), n, n, n), (n // 2 + 1, n // 2 + 1))
    low = [math.floor((box["lo" + c] - m) / res) for c, m in zip("xy", middle)]
    wide = [math.floor((box["hi" + c] - m) / res) - a + 1 for c, m, a in zip("xy", middle, low)]
    half = math.ceil(far["reach"] / res) + 1
    need = max(wide) + 2 * half
    size = min(2 * BLOCK, 1 << max(4, math.ceil(math.log2(need))))
    block, stride = (size, size) if need <= size else (BLOCK, BLOCK)
    return Layout(res, size, Side(at, far["mz"], (half, half), block, stride), Side(middle, box["mz"], (-low[0], -low[1]), size, stride), tuple(wide))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in batches:
        held.append(np.stack([b.column(i).to_numpy() for i in range(3)]))
        n += len(b)
        if n >= TASK_ROWS:
            yield np.concatenate(held, 1)
            held, n = [], 0
    if n:
        yield np.concatenate(held, 1)


def _packed(cells: np.ndarray, z: np.ndarray) -> bytes:
    return cells.astype(np.int32).tobytes() + z.astype(np.float32).tobytes()


def _opened(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 8
    return np.frombuffer(payload, np.int32, n), np.frombuffer(payload, np.float32, n, 4 * n)


def _cells(ix: np.ndarray, iy: np.ndarray, z: np.ndarray, side: Side) -> Iterator[tuple[int, int, bytes]]:
    """Blocks touched by some cells, with the highest z of each cell."""
    per = side.size // side.stride
    for back_x in range(per):
        for back_y in range(per):
            bi, bj = ix // side.stride - back_x, iy // side.stride - back_y
            cell = (iy - bj * side.stride) * side.size + (ix - bi * side.stride)
            order = np.lexsort((cell, bj, bi)) if len(bi) and (np.ptp(bi) or np.ptp(bj)) else np.argsort(cell)
            bi, bj, cell, high = bi[order], bj[order], cell[order], z[order]
            new_block = np.flatnonzero(np.r_[len(bi) > 0, (np.diff(bi) != 0) | (np.diff(bj) != 0)])
            first = np.flatnonzero(np.r_[len(bi) > 0, (np.diff(bi) != 0) | (np.diff(bj) != 0) | (np.diff(cell) != 0)])
            if not len(first):
                continue
            high = np.maximum.reduceat(high, first)
            cut_at = np.searchsorted(first, np.r_[new_block, len(bi)])
            for b, lo, hi in zip(new_block.tolist(), cut_at[:-1].tolist(), cut_at[1:].tolist()):
                yield int(bi[b]), int(bj[b]), _packed(cell[first[lo:hi]], high[lo:hi])


def blocks(df: DataFrame, side: Side, res: float, angles: Sequence[float]) -> DataFrame:
    """Blocks of the rasters of ``df`` (x, y, z) at every angle in degrees: packed cells, and sums of z about ``side.z``.

    Tasks send one packed part per block they touch; parts of a block are merged one after another into one dense block,
    so memory does not grow with the rows or parts of a crowded block.
    """
    turns = [(float(a), math.cos(math.radians(a)), math.sin(math.radians(a))) for a in angles]

    def parts(batches):
        for x, y, z in _points(batches):
            dx, dy, z = x - side.at[0], y - side.at[1], z.astype(np.float32)
            for angle, c, s in turns:
                ix = np.floor((c * dx - s * dy) / res).astype(np.int64) + side.origin[0]
                iy = np.floor((s * dx + c * dy) / res).astype(np.int64) + side.origin[1]
                high = z
                if side.window:
                    keep = (ix >= 0) & (ix < side.window) & (iy >= 0) & (iy < side.window)
                    ix, iy, high = ix[keep], iy[keep], z[keep]
                got = list(_cells(ix, iy, high, side))
                if got:
                    bi, bj, payload = zip(*got)
                    none = [0] * len(got)
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(([angle] * len(got), bi, bj, none, none, none, payload), BLOCKS_SCHEMA)],
                                                     schema=BLOCKS_SCHEMA)

    def block(key: tuple, dense: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(dense > -np.inf)
        z = dense[at].astype(np.float64) - side.z
        values = (*key, len(at), z.sum(), z @ z, _packed(at, dense[at]))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCKS_SCHEMA)], schema=BLOCKS_SCHEMA)

    def merged(batches):
        key, dense = None, None
        for row in _rows(batches):
            here = tuple(row[c] for c in BLOCK_KEY)
            if here != key:
                if key:
                    yield block(key, dense)
                key, dense = here, np.full(side.size * side.size, -np.inf, np.float32)
            cells, z = _opened(row["payload"])
            dense[cells] = np.maximum(dense[cells], z)
        if key:
            yield block(key, dense)

    return _dealt(df.select("x", "y", "z").mapInArrow(parts, BLOCKS), BLOCK_KEY, BLOCK_KEY).mapInArrow(merged, BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(len(b)):
            yield b.slice(i, 1).to_pylist()[0]


def _dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*order)


def _spread(table: DataFrame) -> DataFrame:
    """Mean (about the side's z) and deviation of the occupied cells per angle.

    A cell of the target counts once in each of its windows, which leaves both as they are.
    """
    n = F.sum("n")
    variance = F.greatest(F.sum("square") / n - (F.sum("total") / n) * (F.sum("total") / n), F.lit(0.0))
    return table.groupBy("angle").agg((F.sum("total") / n).alias("mean"), F.sqrt(variance).alias("sd"))


def _level(mean: Column, sd: Column, z: float) -> list[Column]:
    return [(mean + F.lit(z)).alias("level"), F.when(sd > 1e-6, sd).otherwise(F.lit(1.0)).alias("unit")]


class Windows:
    """The target's windows, written once."""

    def __init__(self, target: DataFrame, plan: Layout):
        ship_package(target.sparkSession)
        self.plan = plan
        table = cut(blocks(target, plan.target, plan.res, [0.0]))
        self.keys = table.select("bi", "bj", F.length("payload").alias("bytes")).collect()      # one row per occupied window
        small = sum(r["bytes"] for r in self.keys) <= BROADCAST_BYTES
        spread = _spread(table)
        table = table.crossJoin(F.broadcast(spread.drop("angle")))                              # one row of statistics
        table = table.select(F.col("bi").alias("ti"), F.col("bj").alias("tj"), F.col("payload").alias("there"),
                             *[c.alias("t_" + n) for n, c in zip(("level", "unit"), _level(F.col("mean"), F.col("sd"), plan.target.z))])
        self.table = F.broadcast(table) if small else table

    def best(self, model: DataFrame, angles: Sequence[float]) -> DataFrame:
        """angle, score and shift in cells (px, py) with which the turned model's raster fits best."""
        plan = self.plan
        made = cut(blocks(model, plan.model, plan.res, angles))
        stats = _spread(made)                                                                   # a row per angle
        made = made.join(F.broadcast(stats), "angle").select("angle", "bi", "bj", F.col("payload").alias("here"), *_level(F.col("mean"), F.col("sd"), plan.model.z))
        where = constant_rows([{"ti": r["bi"], "tj": r["bj"]} for r in self.keys], "ti: bigint, tj: bigint")
        asked = made.select("*", F.explode(where).alias("w")).select("*", "w.ti", "w.tj").drop("w")
        pairs = asked.join(self.table, ["ti", "tj"]).withColumns({"di": F.col("ti") - F.col("bi"), "dj": F.col("tj") - F.col("bj")})
        found = _dealt(pairs, SHIFT_KEY[:2], [*SHIFT_KEY, "bi", "bj"]).mapInArrow(_correlator(plan), BEST)
        return found.groupBy("angle").agg(F.max_by(F.struct("score", "px", "py"), F.struct("score", -F.col("px"), -F.col("py"))).alias("b")).select("angle", "b.*")


class _Spectra:
    """The latest spectra of one side."""

    def __init__(self, size: int, pitch: int):
        self.size, self.pitch, self.held = size, pitch, {}

    def of(self, key: tuple, payload: bytes, level: float, unit: float) -> np.ndarray:
        if key not in self.held:
            if len(self.held) >= SPECTRA:
                self.held.pop(next(iter(self.held)))
            cells, z = _opened(payload)
            dense = np.zeros((self.size, self.size), np.float32)
            dense[cells // self.pitch, cells % self.pitch] = (z.astype(np.float64) - level) / unit
            self.held[key] = np.fft.rfft2(dense)
        return self.held[key]


def _correlator(plan: Layout):
    def run(batches):
        model, target = _Spectra(plan.size, plan.model.size), _Spectra(plan.size, plan.target.size)
        key, total = None, None

        def best() -> pa.RecordBatch:
            fit = np.fft.irfft2(total, s=(plan.size, plan.size))
            angle, di, dj = key
            if not plan.whole:
                fit = fit[:plan.model.stride, :plan.model.stride]
            at = np.unravel_index(int(fit.argmax()), fit.shape)
            shift = []
            for axis, (s, d) in enumerate(((at[1], di), (at[0], dj))):
                s = int(s) + d * plan.model.stride if not plan.whole else int(s) - (plan.size if s >= plan.positive[axis] else 0)
                shift.append(s - plan.target.origin[axis] + plan.model.origin[axis])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((angle, float(fit[at]), *shift), BEST_SCHEMA)], schema=BEST_SCHEMA)

        for row in _rows(batches):
            here = tuple(row[c] for c in SHIFT_KEY)
            if here != key:
                if key:
                    yield best()
                key, total = here, 0
            there = target.of((row["ti"], row["tj"]), row["there"], row["t_level"], row["t_unit"])
            total = total + there * np.conj(model.of((row["angle"], row["bi"], row["bj"]), row["here"], row["level"], row["unit"]))
        if key:
            yield best()

    return run
