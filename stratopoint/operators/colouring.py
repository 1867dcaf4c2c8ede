"""Reprojection: which camera sees a point best, and what it saw there.

Points never meet cameras in a cross join. Each camera is turned into the
ground cells it can possibly see, level by level from coarse to fine; for the
most central camera every level first drops the cameras that cannot win in a
cell, so that dense flights never list all that see it. Points look up the
cameras of their cell, and the exact test runs on these.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import camera as cam
from ..functions.linear import invert, matmul_cols, matvec_cols
from ..functions.names import sequence_token
from ..session import cut, ship_package

FALLBACK = (107, 107, 107)
BROADCAST_ROWS = 2_000_000  # (cell, camera) rows a broadcast may hold (12 bytes each); beyond it the join shuffles
STRAY = -1                  # the cell of points far from all others; it lists every camera
CELL_CAMERAS = 1 << 18      # cameras of a tile that a task holds for all views; beyond it the tile's points get more copies
SHORT = 8                   # cameras per cell on average at which finer cells are not worth their rows
LOOKUP_CAMERAS = 64         # cameras per cell on average that points still try one by one
TILE_CAMERAS = 2_048        # the same for a shuffled tile, whose points are split further in place
TILE_LIST = 32              # cameras of a tile in one row
TILE_PAIRS = 4_096          # products of points and cameras that are not split further
TILE_POINTS = 200_000       # points of a tile met by one copy of its cameras
TILE_BLOCK = 256            # points of a box that is not halved further when every view of it is wanted
WIDE_CELLS = 65_536         # tiles whose sizes are still broadcast
PAIRS = 1 << 17             # (point, camera) or (cell, camera) pairs worked on at once, whatever the lists hold


def _resolve(transform) -> tuple[np.ndarray, np.ndarray]:
    if transform is None:
        return np.eye(3), np.zeros(3)
    a, b = transform
    return np.asarray(a, float), np.asarray(b, float)


def into_target_frame(cameras: DataFrame, transform=None) -> DataFrame:
    """Cameras whose matrix takes points of the target frame straight to camera coordinates.

    ``transform`` (A, b) maps model to target coordinates. One struct column
    ``camera`` with the 3x4 matrix, the unified optics and the image size.
    """
    inv, off = invert(*_resolve(transform))
    m = matmul_cols(F.col("r"), F.array(*[F.lit(float(v)) for v in inv.ravel()]))
    shift = matvec_cols(F.col("r"), F.array(*[F.lit(float(v)) for v in off]))
    return cameras.select(F.struct(
        "cam_id", "width", "height", *[m[i].alias(f"m{i}") for i in range(9)],
        *[(shift[i] + F.col("t")[i]).alias(f"t{i}") for i in range(3)],
        cam.optics(F.col("model"), F.col("params")).alias("optics")).alias("camera"))


def ground_box(points: DataFrame) -> dict[str, float] | None:
    """Extent of a cloud without far strays: one aggregate and one sketch, a few numbers on the driver.

    An axis reaches twice the span of its middle 98 percent beyond it at most, so a stray point does not blow
    up the cells of all others. ``strays``: points lie outside; they are tried with every camera."""
    for c in "xyz":                  # a point without a place is seen by no camera
        points = points.where(F.abs(c) < F.lit(math.inf))
    aggs = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min_", F.min), ("max_", F.max))]
    row = points.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    if row["min_x"] is None:
        return None
    box = row.asDict() | {"strays": False}
    for c, (lo, hi) in zip("xyz", points.approxQuantile(["x", "y", "z"], [0.01, 0.99], 0.002)):
        room = 2.0 * max(hi - lo, 1e-6)
        for name, bound in ((f"min_{c}", max(box[f"min_{c}"], lo - room)), (f"max_{c}", min(box[f"max_{c}"], hi + room))):
            box["strays"] |= bound != box[name]
            box[name] = bound
    return box


def _square(box: dict[str, float]) -> float:
    side = max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    return max(side, 1e-6) * (1.0 + 1e-9)


class Grid:
    """Ground cells of a cloud: 2^depth per side, cut into height slabs of about the same edge.

    Slabs are a power of two, at most eight, so that the cells of a level lie within those of the level above.
    """

    def __init__(self, box: dict[str, float], depth: int):
        self.box, self.depth = box, depth
        self.side = _square(box)
        self.size = self.side / (1 << depth)
        self.slack = 1e-6 * (1.0 + self.side)
        rise = max(box["max_z"] - box["min_z"], 0.0)
        steps = math.ceil(math.log2(rise / self.side)) + depth if rise > 0 else 0
        self.slabs = 1 << min(3, max(0, steps))
        self.slab = max(rise, 1e-6) * (1.0 + 1e-9) / self.slabs

    def boxes(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles of cells (ix, iy, iz) and half their edges, with some slack."""
        low, edge = np.array([self.box[f"min_{c}"] for c in "xyz"]), np.array([self.size, self.size, self.slab])
        return low + (cells + 0.5) * edge, edge / 2 + self.slack

    def _index(self, c: Column, axis: str, size: float, n: int) -> Column:
        i = F.floor((c - F.lit(self.box[f"min_{axis}"])) / F.lit(size))
        return F.greatest(F.least(i, F.lit(n - 1).cast("long")), F.lit(0).cast("long"))

    def key(self, ix: Column, iy: Column, iz: Column) -> Column:
        return (ix * F.lit(1 << self.depth).cast("long") + iy) * F.lit(self.slabs).cast("long") + iz

    def cell_of(self, x: Column, y: Column, z: Column) -> Column:
        """The cell of a point; STRAY outside the box."""
        n = 1 << self.depth
        key = self.key(self._index(x, "x", self.size, n), self._index(y, "y", self.size, n), self._index(z, "z", self.slab, self.slabs))
        if not self.box["strays"]:
            return key
        inside = F.lit(True)
        for c, name in ((x, "x"), (y, "y"), (z, "z")):
            inside = inside & c.between(F.lit(self.box[f"min_{name}"]), F.lit(self.box[f"max_{name}"]))
        return F.when(inside, key).otherwise(F.lit(STRAY).cast("long"))


CAMERA_FIELDS = ("cam_id", "width", "height", *(f"m{i}" for i in range(9)), *(f"t{i}" for i in range(3)))


def _flat(cameras: pa.StructArray) -> dict[str, np.ndarray]:
    """Camera structs as one array per number."""
    fields = dict(zip([f.name for f in cameras.type], cameras.flatten()))
    fields |= dict(zip([f.name for f in fields["optics"].type], fields["optics"].flatten()))
    return {f: fields[f].to_numpy(zero_copy_only=False) for f in (*CAMERA_FIELDS, *cam.OPTICS)}


def _view_planes(c: dict[str, np.ndarray], max_radius: float) -> np.ndarray:
    """The five half-spaces of every camera's view, (camera, plane, 4)."""
    n = len(c["cam_id"])
    bounds = np.empty((n, 4))
    for i in range(n):
        bounds[i] = cam.view_bounds({k: float(c[k][i]) for k in cam.OPTICS}, c["width"][i], c["height"][i])
    if max_radius > 0:
        bounds = np.clip(bounds, -max_radius, max_radius)
    xlo, xhi, ylo, yhi = (b[:, None] for b in bounds.T)
    m = [np.column_stack([*(c[f"m{3 * i + j}"] for j in range(3)), c[f"t{i}"]]) for i in range(3)]
    return np.stack([m[2], xhi * m[2] - m[0], m[0] - xlo * m[2], yhi * m[2] - m[1], m[1] - ylo * m[2]], 1)


def _box_bounds(c: dict[str, np.ndarray], planes: np.ndarray, who: np.ndarray, mid: np.ndarray, half: np.ndarray, max_radius: float):
    """Of pairs (camera ``who``, box around ``mid``): those the camera may see, with the bounds on its image radius there.

    ``half``: half the edges of all boxes, or of each.
    Returns the places of the pairs kept, the least possible radius and the greatest one (NaN unless the camera
    certainly sees the whole cell).
    """
    seen = np.ones(len(who), bool)
    for k in range(planes.shape[1]):
        p = planes[who, k]
        reach = np.abs(p[:, :3]) @ half if half.ndim == 1 else (np.abs(p[:, :3]) * half).sum(1)
        seen &= p[:, 0] * mid[:, 0] + p[:, 1] * mid[:, 1] + p[:, 2] * mid[:, 2] + p[:, 3] + reach >= 0
    at = np.flatnonzero(seen)
    o, mid, half = {k: v[who[at]] for k, v in c.items()}, mid[at], half if half.ndim == 1 else half[at]
    centre = np.column_stack([sum((o[f"m{3 * i + j}"] * mid[:, j] for j in range(3)), o[f"t{i}"]) for i in range(3)])
    reach = np.column_stack([sum(np.abs(o[f"m{3 * i + j}"]) * half[..., j] for j in range(3)) for i in range(3)])
    near, far = centre[:, 2] - reach[:, 2], np.maximum(centre[:, 2] + reach[:, 2], 1e-5)
    inner = np.maximum(np.abs(centre[:, :2]) - reach[:, :2], 0.0)
    safe = np.where(near > 1e-5, near, 1.0)
    r_min = np.hypot(inner[:, 0], inner[:, 1]) / far
    outer = np.abs(centre[:, :2]) + reach[:, :2]
    r_max = np.hypot(outer[:, 0], outer[:, 1]) / safe
    # a camera is sure of a cell when even the widest distortion keeps it inside the image
    q = r_max * r_max
    grow = 1.0 + (np.abs(o["k1"]) + np.abs(o["k2"]) * q) * q
    tang = 3.0 * (np.abs(o["p1"]) + np.abs(o["p2"])) * q
    sure = near > 1e-5
    for axis, f, p, size in ((0, "fx", "cx", "width"), (1, "fy", "cy", "height")):
        lo = np.minimum((centre[:, axis] - reach[:, axis]) / safe, 0.0) * grow - tang
        hi = np.maximum((centre[:, axis] + reach[:, axis]) / safe, 0.0) * grow + tang
        sure &= (o[f] * lo + o[p] > 1e-6) & (o[f] * hi + o[p] < o[size] - 1e-6)
    if max_radius > 0:
        sure &= r_max < max_radius
    return at, r_min, np.where(sure, r_max, np.nan)


def footprint_cells(target_cams: DataFrame, grid: Grid, max_radius: float = 0.0, above: Grid | None = None) -> DataFrame:
    """(cell, cam_id, r_min, r_sure) for every cell a camera may see, never too few.

    With ``above``, only within the cells of that coarser grid which ``target_cams`` list per camera (``cells``)."""
    n, m = (1 << grid.depth), grid.slabs
    if above is not None:
        side, deep = 1 << (grid.depth - above.depth), grid.slabs // above.slabs
        i, j, k = (a.ravel() for a in np.meshgrid(np.arange(side), np.arange(side), np.arange(deep), indexing="ij"))

    def run(batches):
        for batch in batches:
            c = _flat(batch.column("camera"))
            planes = _view_planes(c, max_radius)
            if above is None:
                count, each = np.full(len(planes), n * n * m), n * n * m
            else:
                lists = batch.column("cells")
                parent = lists.flatten().to_numpy(zero_copy_only=False)
                each = len(i)
                count = np.diff(lists.offsets.to_numpy()) * each
            start = np.append(0, np.cumsum(count))
            for first in range(0, int(start[-1]), PAIRS):
                pair = np.arange(first, min(first + PAIRS, int(start[-1])))
                who = np.searchsorted(start, pair, side="right") - 1
                if above is None:
                    at = pair - start[who]
                    cells = np.column_stack([at // (n * m), at // m % n, at % m])
                else:
                    key, child = parent[pair // each], pair % each
                    a = 1 << above.depth
                    cells = np.column_stack([key // (a * above.slabs) * side + i[child], key // above.slabs % a * side + j[child],
                                             key % above.slabs * deep + k[child]])
                at, r_min, r_sure = _box_bounds(c, planes, who, *grid.boxes(cells), max_radius)
                cells = cells[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cells[:, 0] * n + cells[:, 1]) * m + cells[:, 2], pa.int64()), pa.array(c["cam_id"][who[at]], pa.int32()),
                     pa.array(r_min), pa.array(r_sure, mask=np.isnan(r_sure))], ["cell", "cam_id", "r_min", "r_sure"])

    return target_cams.mapInArrow(run, "cell long, cam_id int, r_min double, r_sure double")


def drop_dominated(cells: DataFrame) -> DataFrame:
    """Keep, per cell, only cameras that can be the most central one somewhere in it.

    A camera that certainly sees the whole cell with radius <= R rules out every
    camera whose radius there is certainly above R.
    """
    best = cells.groupBy("cell").agg(F.min("r_sure").alias("best"))
    return cells.join(best, "cell").where(F.col("best").isNull() | (F.col("r_min") <= F.col("best") + 1e-9))


class CellCameras:
    """The cameras per cell of a cloud, as lists of bounded length, with their measured size."""

    def __init__(self, points: DataFrame, cameras: DataFrame, transform, max_radius: float, best_only: bool):
        ship_package(points.sparkSession)
        self.empty, self.max_radius = True, max_radius
        box = ground_box(points)
        if box is None:
            return
        tasks = points.sparkSession.sparkContext.defaultParallelism
        self.cameras = cut(into_target_frame(cameras, transform).repartition(tasks, "camera.cam_id"))
        # about 64 points per ground cell: finer cells would outnumber what they prune
        self._descend(box, min(12, max(2, int(math.log(max(box["n"], 64) / 64.0, 4)))), best_only)
        if box["strays"]:
            self.cells = self.cells.union(self.cameras.select(F.lit(STRAY).cast("long"), "camera.cam_id"))
            self.rows += self.cameras.count()
        self.empty = self.rows == 0

    def _descend(self, box: dict[str, float], deepest: int, best_only: bool) -> None:
        """Cells level by level, each within what the level above kept, until lists are short, or as long as the
        look-up still may have them and the next level would be too large to broadcast. Where every view is wanted finer
        cells drop nothing but what they do not see, so a first level too large to broadcast is the last one."""
        grid, target = None, self.cameras
        for depth in range(min(deepest, 3), deepest + 1):
            above, grid = grid, Grid(box, depth)
            cells = footprint_cells(target, grid, self.max_radius, above)
            cells = cut((drop_dominated(cells) if best_only else cells).select("cell", "cam_id"))
            rows, places = cells.agg(F.count(F.lit(1)), F.count_distinct("cell")).first()
            if above is not None and rows > BROADCAST_ROWS >= self.rows and (not best_only or self.rows <= LOOKUP_CAMERAS * self.places):
                return
            self.grid, self.cells, self.rows, self.places = grid, cells, rows, places
            if rows <= SHORT * places or rows > BROADCAST_ROWS and (not best_only or rows <= TILE_CAMERAS * places):
                return
            lists = cells.distinct().groupBy("cam_id").agg(F.collect_list("cell").alias("cells"))
            target = self.cameras.join(lists, F.col("camera.cam_id") == F.col("cam_id")).select("camera", "cells")

    def keyed(self, points: DataFrame) -> DataFrame:
        return points.withColumn("cell", self.grid.cell_of(F.col("x"), F.col("y"), F.col("z")))

    def fits_broadcast(self) -> bool:
        return self.rows <= BROADCAST_ROWS

    def lookup(self) -> "CellLookup":
        """Driver copy of the cell table; only called behind fits_broadcast()."""
        flat = self.cameras.select("camera.*")
        flat = flat.select(*CAMERA_FIELDS, "optics.*").join(self.cells.select("cam_id").distinct(), "cam_id", "left_semi")
        arrays = ({n: t[n].to_numpy() for n in t.column_names} for t in (self.cells.toArrow(), flat.toArrow()))
        return CellLookup(*arrays)

    def lists(self, length: int) -> DataFrame:
        """(cell, cams): the cameras of every cell, in lists of about ``length``."""
        n = F.count(F.lit(1)).over(Window.partitionBy("cell"))
        chunk = F.pmod(F.xxhash64("cam_id"), F.ceil(F.col("n") / length))
        full = self.cells.withColumn("n", n).join(self.cameras.withColumn("cam_id", F.col("camera.cam_id")), "cam_id")
        return full.withColumn("chunk", chunk).groupBy("cell", "chunk").agg(F.collect_list("camera").alias("cams")).drop("chunk")

    def beside_points(self, points: DataFrame) -> DataFrame:
        """(cell, piece, kind, cams, point): the cameras of every tile (kind 0) in front of its points (kind 1).

        Points are shuffled once; a tile with very many comes in pieces, each with its own copy of the cameras."""
        keyed = points.select(F.struct(*points.columns).alias("point"), self.grid.cell_of(F.col("x"), F.col("y"), F.col("z")).alias("cell"))
        pieces = keyed.where("cell IS NOT NULL").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_POINTS).alias("pieces"))
        mix = F.xxhash64("point.point_id", "point.x", "point.y", "point.z")
        keyed = keyed.join(pieces, "cell", "left").withColumn("piece", F.pmod(mix, F.coalesce("pieces", F.lit(1024).cast("long"))))
        lists = self.lists(TILE_LIST).join(pieces, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for df in (keyed, lists) for f in df.schema.fields}
        rows = lists.select("cell", "piece", F.lit(0).alias("kind"), "cams", none["point"]).union(
            keyed.select("cell", "piece", F.lit(1).alias("kind"), none["cams"], "point"))
        return rows.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind")

    def all_beside_points(self, points: DataFrame) -> DataFrame:
        """(cell, piece, kind, camera, point): the cameras of every tile, a row each (kind 0), in front of its points (kind 1).

        Points are shuffled once; a tile with very many comes in pieces, each with its own copy of the cameras, and
        one with more cameras than a task holds in shares of them, each with its own copy of the points."""
        keyed = points.select(F.struct(*points.columns).alias("point"), self.grid.cell_of(F.col("x"), F.col("y"), F.col("z")).alias("cell"))
        cells = self.cells.distinct()                    # a camera that comes twice meets its id's cells as two rows
        sizes = cut(keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_POINTS).alias("pieces")).join(
            cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_CAMERAS).alias("shares")), "cell"))
        groups = sizes.agg(F.sum(F.col("pieces") * F.col("shares"))).first()[0] or 1
        tasks = max(points.sparkSession.sparkContext.defaultParallelism, min(4096, groups))
        sizes = F.broadcast(sizes) if self.places <= WIDE_CELLS else sizes

        def copies(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

        mix = F.xxhash64("point.point_id", "point.x", "point.y", "point.z")
        mine = keyed.join(sizes, "cell").withColumn("share", copies("shares")).withColumn("of", F.pmod(mix, F.col("pieces")))
        seen = cells.join(sizes, "cell").join(self.cameras.withColumn("cam_id", F.col("camera.cam_id")), "cam_id").withColumn(
            "share", F.pmod(F.xxhash64("cam_id"), F.col("shares"))).withColumn("of", copies("pieces"))
        piece = (F.col("share") * F.col("pieces") + F.col("of")).alias("piece")
        none = {c: F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((seen, "camera"), (mine, "point"))}
        rows = seen.select("cell", piece, F.lit(0).alias("kind"), "camera", none["point"]).union(
            mine.select("cell", piece, F.lit(1).alias("kind"), none["camera"], "point"))
        return rows.repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece", "kind")


def _every_view(c: dict[str, np.ndarray], planes: np.ndarray, p: np.ndarray, max_radius: float):
    """Row index, camera id, u, v, radius of every camera that sees its point, in pieces of PAIRS pairs at most.

    Points are halved along their longest side down to small boxes; a box meets the cameras that may see it."""
    todo = [(np.flatnonzero(np.isfinite(p).all(1)), np.arange(len(planes)))]
    while todo:
        some, who = todo.pop()
        if not len(some):
            continue
        low, high = p[some].min(0), p[some].max(0)
        mid, half = (low + high) / 2, (high - low) / 2 + 1e-6 * (1.0 + np.abs([low, high]).max())
        who = np.concatenate([part[_box_bounds(c, planes, part, np.broadcast_to(mid, (len(part), 3)), half, max_radius)[0]]
                              for part in (who[first:first + PAIRS] for first in range(0, max(len(who), 1), PAIRS))])
        if len(some) * len(who) > PAIRS and len(some) > TILE_BLOCK:
            parted = np.argpartition(p[some, int(np.argmax(half))], len(some) // 2)
            todo += [(some[parted[:len(some) // 2]], who), (some[parted[len(some) // 2:]], who)]
            continue
        x, y, z = (p[some, i][:, None] for i in range(3))
        step = max(1, PAIRS // len(some))
        for first in range(0, len(who), step):
            o = {k: v[who[first:first + step]] for k, v in c.items()}
            xc, yc, zc = (o[f"m{3 * i}"] * x + o[f"m{3 * i + 1}"] * y + o[f"m{3 * i + 2}"] * z + o[f"t{i}"] for i in range(3))
            front = zc > cam.FRONT_EPS
            depth = np.where(front, zc, 1.0)
            u, v, rad = cam.distort_arrays(o, xc / depth, yc / depth)
            ok = front & (u >= 0) & (u < o["width"]) & (v >= 0) & (v < o["height"])
            if max_radius > 0:
                ok &= rad < max_radius
            row, at = np.nonzero(ok)
            yield some[row], o["cam_id"][at], u[ok], v[ok], rad[ok]


def _most_central(c: dict[str, np.ndarray], p: np.ndarray, max_radius: float):
    """Camera id, u, v, radius of the most central camera of every point (radius infinite: none).

    Points are halved along their longest side; a box keeps the cameras that can be the most central one
    somewhere in it, and small products of points and cameras are evaluated whole."""
    order = np.argsort(c["cam_id"], kind="stable")       # of equal radii the first one is the lowest id
    c = {k: v[order] for k, v in c.items()}
    planes = _view_planes(c, max_radius)
    out = np.zeros(len(p), np.int32), np.zeros(len(p)), np.zeros(len(p)), np.full(len(p), np.inf)
    todo = [(np.flatnonzero(np.isfinite(p).all(1)), np.arange(len(order)))]
    while todo:
        some, who = todo.pop()
        if not len(some):
            continue
        low, high = p[some].min(0), p[some].max(0)
        mid, half = (low + high) / 2, (high - low) / 2 + 1e-6 * (1.0 + np.abs([low, high]).max())
        at, r_min, r_sure = _box_bounds(c, planes, who, np.broadcast_to(mid, (len(who), 3)), half, max_radius)
        least = np.fmin.reduce(r_sure, initial=np.inf)
        who = who[at[r_min <= least + 1e-9]]
        if not len(who):
            continue
        if len(some) * len(who) > TILE_PAIRS and len(some) > 1:
            axis = int(np.argmax(half))
            parted = np.argpartition(p[some, axis], len(some) // 2)
            todo += [(some[parted[:len(some) // 2]], who), (some[parted[len(some) // 2:]], who)]
            continue
        o = {k: v[who] for k, v in c.items()}
        x, y, z = (p[some, i][:, None] for i in range(3))
        xc, yc, zc = (o[f"m{3 * i}"] * x + o[f"m{3 * i + 1}"] * y + o[f"m{3 * i + 2}"] * z + o[f"t{i}"] for i in range(3))
        front = zc > cam.FRONT_EPS
        depth = np.where(front, zc, 1.0)
        u, v, rad = cam.distort_arrays(o, xc / depth, yc / depth)
        ok = front & (u >= 0) & (u < o["width"]) & (v >= 0) & (v < o["height"])
        if max_radius > 0:
            ok &= rad < max_radius
        rad = np.where(ok, rad, np.inf)
        best = rad.argmin(1)
        row = np.arange(len(some))
        for target, value in zip(out, (o["cam_id"][best], u[row, best], v[row, best], rad[row, best])):
            target[some] = value
    return out


class CellLookup:
    """Cameras per cell as flat arrays, evaluated for a whole batch of points at once."""

    def __init__(self, cells: dict[str, np.ndarray], cameras: dict[str, np.ndarray]):
        order = np.argsort(cameras["cam_id"], kind="stable")
        self.col = {n: v[order] for n, v in cameras.items()}
        order = np.lexsort((cells["cam_id"], cells["cell"]))
        self.keys, self.start, self.count = np.unique(cells["cell"][order], return_index=True, return_counts=True)
        self.slot = np.searchsorted(self.col["cam_id"], cells["cam_id"][order]).astype(np.int32)

    def hits(self, cell: np.ndarray, p: np.ndarray, max_radius: float):
        """Row index, camera id, u, v, radius of every camera that sees its point; pieces of whole points and about PAIRS pairs."""
        at = np.minimum(np.searchsorted(self.keys, cell), len(self.keys) - 1)
        count = np.where(self.keys[at] == cell, self.count[at], 0)
        done = np.cumsum(count)
        first = 0
        while first < len(cell):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + PAIRS, side="right")))
            yield self._piece(np.arange(first, last), at[first:last], count[first:last], p, max_radius)
            first = last

    def _piece(self, rows: np.ndarray, at: np.ndarray, n: np.ndarray, p: np.ndarray, max_radius: float):
        row = np.repeat(rows, n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        slot = self.slot[np.repeat(self.start[at], n) + within]
        c = {k: v[slot] for k, v in self.col.items()}
        x, y, z = (p[row, i] for i in range(3))
        xc, yc, zc = (c[f"m{3 * i}"] * x + c[f"m{3 * i + 1}"] * y + c[f"m{3 * i + 2}"] * z + c[f"t{i}"] for i in range(3))
        front = zc > cam.FRONT_EPS
        depth = np.where(front, zc, 1.0)
        u, v, rad = cam.distort_arrays(c, xc / depth, yc / depth)
        ok = front & (u >= 0) & (u < c["width"]) & (v >= 0) & (v < c["height"])
        if max_radius > 0:
            ok &= rad < max_radius
        return row[ok], c["cam_id"][ok], u[ok], v[ok], rad[ok]

    def best(self, cell: np.ndarray, p: np.ndarray, max_radius: float):
        """Row index, camera id, u, v, radius of the most central camera of every point that has one."""
        kept = []
        for row, cid, u, v, rad in self.hits(cell, p, max_radius):
            order = np.lexsort((cid, rad, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            kept.append([a[first] for a in (row, cid, u, v, rad)])
        return [np.concatenate(a) for a in zip(*kept)]


def _coordinates(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in "xyz"])


HIT_FIELDS = [T.StructField("cam_id", T.IntegerType()), T.StructField("u", T.DoubleType()),
              T.StructField("v", T.DoubleType()), T.StructField("rad", T.DoubleType())]


def best_camera(points: DataFrame, cameras: DataFrame, transform=None, max_radius: float = 0.0) -> DataFrame:
    """Add cam_id, u, v, rad of the most central camera seeing each point (null = none).

    Ties go to the lowest cam_id. While the measured cell table is small enough
    to broadcast, points are scored in Arrow batches where they are read and
    not shuffled at all. Beyond that they are shuffled once by tile, behind the
    cameras of the tile, and halved there until few cameras are left.
    """
    found = CellCameras(points, cameras, transform, max_radius, best_only=True)
    if found.empty:
        return points.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in HIT_FIELDS])
    if found.fits_broadcast() and found.rows <= LOOKUP_CAMERAS * found.places:
        lookup = points.sparkSession.sparkContext.broadcast(found.lookup())

        def run(batches):
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                row, cid, u, v, rad = lookup.value.best(batch.column("cell").to_numpy(zero_copy_only=False), _coordinates(batch), max_radius)
                hit = np.zeros(n, bool)
                hit[row] = True
                columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "cell"]
                names = [name for name in batch.schema.names if name != "cell"]
                for name, data, kind in (("cam_id", cid, pa.int32()), ("u", u, pa.float64()),
                                         ("v", v, pa.float64()), ("rad", rad, pa.float64())):
                    filled = np.zeros(n, data.dtype)
                    filled[row] = data
                    columns.append(pa.array(filled, kind, mask=~hit))
                    names.append(name)
                yield pa.RecordBatch.from_arrays(columns, names)

        return found.keyed(points).mapInArrow(run, T.StructType(points.schema.fields + HIT_FIELDS))

    def stream(batches):
        tile, lists, cameras = None, [], None
        for batch in batches:
            n = batch.num_rows
            cell, piece, kind = (batch.column(i).fill_null(-2).to_numpy(zero_copy_only=False) for i in range(3))
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
            xyz = np.column_stack([a.to_numpy(zero_copy_only=False) for a in map(batch.column("point").field, "xyz")])
            columns = [np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.full(n, np.inf)]
            for a, b in zip([0, *turn], [*turn, n]):
                if a == b:
                    continue
                if (cell[a], piece[a]) != tile:
                    tile, lists, cameras = (cell[a], piece[a]), [], None
                if kind[a] == 0:
                    lists.append(_flat(batch.column("cams").slice(a, b - a).flatten()))
                elif lists:
                    cameras = cameras or {k: np.concatenate([x[k] for x in lists]) for k in lists[0]}
                    for column, found_ in zip(columns, _most_central(cameras, xyz[a:b], max_radius)):
                        column[a:b] = found_
            mine = kind == 1
            if mine.any():
                points_ = batch.column("point").filter(pa.array(mine))
                none = ~np.isfinite(columns[3][mine])
                yield pa.RecordBatch.from_arrays(
                    [*points_.flatten(), *[pa.array(c[mine], k, mask=none) for c, k in zip(columns, (pa.int32(), *[pa.float64()] * 3))]],
                    [*[f.name for f in points_.type], *[f.name for f in HIT_FIELDS]])

    return found.beside_points(points).mapInArrow(stream, T.StructType(points.schema.fields + HIT_FIELDS))


def seen_by(points: DataFrame, cameras: DataFrame, transform=None, max_radius: float = 0.0) -> DataFrame:
    """Every (point_id, cam_id, u, v, rad) with the point inside the image.

    The rows are points x cameras by nature and are handed on as they are found. While the measured cell table is
    small enough to broadcast, points are not shuffled; beyond that they are shuffled once by tile, behind the
    cameras of the tile.
    """
    schema = T.StructType([T.StructField("point_id", T.LongType()), *HIT_FIELDS])
    found = CellCameras(points, cameras, transform, max_radius, best_only=False)
    if found.empty:
        return points.sparkSession.createDataFrame([], schema)
    slim = points.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z")
    if found.fits_broadcast():
        lookup = points.sparkSession.sparkContext.broadcast(found.lookup())

        def run(batches):
            for batch in batches:
                ids = batch.column("point_id").to_numpy(zero_copy_only=False)
                cell, xyz = batch.column("cell").to_numpy(zero_copy_only=False), _coordinates(batch)
                for row, cid, u, v, rad in lookup.value.hits(cell, xyz, max_radius):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row], pa.int64()), pa.array(cid, pa.int32()), pa.array(u), pa.array(v), pa.array(rad)],
                        ["point_id", *[f.name for f in HIT_FIELDS]])

        return found.keyed(slim).mapInArrow(run, schema)

    def stream(batches):
        tile, parts, cameras, planes = None, [], None, None
        for batch in batches:
            cell, piece, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows]):
                if a == b:
                    continue
                if (cell[a], piece[a]) != tile:
                    tile, parts, cameras = (cell[a], piece[a]), [], None
                if kind[a] == 0:
                    parts.append(_flat(batch.column("camera").slice(a, b - a)))
                    continue
                if parts:
                    cameras, parts = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}, []
                    planes = _view_planes(cameras, max_radius)
                if cameras is None:
                    continue
                ids, *xyz = (batch.column("point").slice(a, b - a).field(n) for n in ("point_id", *"xyz"))
                xyz = np.column_stack([k.to_numpy(zero_copy_only=False) for k in xyz])
                for row, cid, u, v, rad in _every_view(cameras, planes, xyz, max_radius):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), pa.array(cid, pa.int32()), pa.array(u), pa.array(v), pa.array(rad)],
                        ["point_id", *[f.name for f in HIT_FIELDS]])

    return found.all_beside_points(slim).mapInArrow(stream, schema)


# ------------------------------------------------------------------ rasters

STRIP = 16  # image lines per strip


def image_strips(images: DataFrame, lines: int = STRIP) -> DataFrame:
    """Cut each raster into strips of ``lines`` image lines, so that gathering moves
    a strip and never a whole image per key."""
    binary = dict(images.dtypes)["data"] == "binary"
    stride = F.col("width") * F.col("n_channels") * lines
    strip = F.explode(F.sequence(F.lit(0), ((F.col("height") - 1) / lines).cast("int")))
    df = images.withColumn("strip", strip)
    start = F.col("strip") * stride + 1
    part = F.substring("data", start, stride) if binary else F.slice("data", start, stride)
    return df.select("cam_id", "strip", "width", "height", part.alias("part"))


def _gather(hits: DataFrame, images: DataFrame) -> tuple[DataFrame, Column]:
    """Join hits with the strip they fall on; returns (joined, offset of the pixel in it).

    The strip follows from v alone, and each strip carries its image's size, so hits are shuffled once. Rows
    without a hit get spread keys; the rows of a strip with very many hits are split by the adaptive skew join, which
    only has to repeat that strip.
    """
    line = F.greatest(F.col("v").cast("long"), F.lit(0))
    last = images.agg(F.max("height")).first()[0] or 1
    at = hits.withColumn("_strip", F.coalesce((F.least(line, F.lit(last - 1)) / STRIP).cast("int"), F.lit(0)))
    key = F.coalesce(F.col("cam_id").cast("long"), -1 - F.pmod(F.xxhash64("point_id"), F.lit(1 << 20)))
    at = at.withColumn("_key", key)
    strips = image_strips(images).select(F.col("cam_id").cast("long").alias("_key"), F.col("strip").alias("_strip"), "part",
                                         F.col("width").alias("_w"), F.col("height").alias("_h"))
    # v below the last line belongs to the last strip of its own image: shorter images repeat it up to the tallest one's count
    bottom = F.ceil(F.col("_h") / STRIP).cast("int") - 1
    spread = F.when(F.col("_strip") == bottom, F.sequence("_strip", F.lit((last - 1) // STRIP))).otherwise(F.array("_strip"))
    strips = strips.withColumn("_line", F.col("_strip") * STRIP).withColumn("_strip", F.explode(spread))
    # the planner takes a raster for a hundred bytes and would broadcast gigabytes of them
    joined = at.join(strips.hint("merge"), ["_key", "_strip"], "left")
    px = F.least(F.greatest(F.col("u").cast("long"), F.lit(0)), F.col("_w") - 1)
    py = F.least(F.greatest(F.col("v").cast("long"), F.lit(0)), F.col("_h") - 1)
    return joined, (py - F.col("_line")) * F.col("_w") + px


_TEMP = ("_w", "_h", "_line", "_key", "_strip", "part")


def sample_images(hits: DataFrame, images: DataFrame, fallback: Sequence[int] = FALLBACK) -> DataFrame:
    """Add red, green, blue read at (u, v) of camera cam_id; rows without one get the fallback.

    ``images``: cam_id, height, width, n_channels (3), data BINARY in RGB order.
    """
    joined, pixel = _gather(hits, images)
    triple = F.conv(F.hex(F.substring("part", pixel * 3 + 1, F.lit(3))), 16, 10).cast("int")
    packed = F.coalesce(F.when(F.col("part").isNotNull(), triple),
                        F.lit((fallback[0] << 16) + (fallback[1] << 8) + fallback[2]))
    channel = {n: F.shiftright(packed, s).bitwiseAND(F.lit(255)).cast("short")
               for n, s in (("red", 16), ("green", 8), ("blue", 0))}
    return joined.withColumns(channel).drop(*_TEMP)


def sample_values(hits: DataFrame, rasters: DataFrame, name: str = "temp") -> DataFrame:
    """Like sample_images for one-channel float rasters (data ARRAY<FLOAT>); null = no hit."""
    joined, pixel = _gather(hits, rasters)
    return joined.withColumn(name, F.get("part", pixel.cast("int")).cast("double")).drop(*_TEMP)


def with_optics(cameras: DataFrame, width: int, height: int, hfov: float) -> DataFrame:
    """Same poses, other optics: a distortion-free image with the given field of view."""
    f = (width / 2.0) / math.tan(math.radians(hfov / 2.0))
    params = F.array(*[F.lit(float(v)) for v in (f, width / 2.0, height / 2.0)])
    return cameras.withColumns({"width": F.lit(width), "height": F.lit(height),
                                "model": F.lit("SIMPLE_PINHOLE"), "params": params})


def pair_by_sequence(cameras: DataFrame, others: DataFrame) -> DataFrame:
    """Inner join of two photo tables on the sequence token of the name.

    ``others`` (name, ord) may hold a token twice; the row with the highest
    ``ord`` wins, as the last one written to a map would.
    """
    token = sequence_token(F.col("name"))
    right = (others.groupBy(token.alias("token"))
             .agg(F.max_by("name", F.struct("ord", "name")).alias("pair_name")))
    return cameras.withColumn("token", token).join(right, "token")


def join_geotags(cameras: DataFrame, tags: DataFrame, min_matches: int = 4) -> DataFrame:
    """Cameras with a geotag of the same name; fewer than ``min_matches`` raises."""
    matched = cameras.join(tags, "name")
    n = matched.count()
    if n < min_matches:
        raise ValueError(f"only {n} images with a geotag, need {min_matches}")
    return matched


def match_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cameras present in two models, with both centres."""
    right = b.select("name", F.col("c").alias("c_b"))
    return a.select("name", F.col("c").alias("c_a")).join(right, "name")


def pending(files: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Rows whose key is not done yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def coverage(df: DataFrame, hit: Column | None = None) -> DataFrame:
    """Share of rows with a hit."""
    flag = F.col("cam_id").isNotNull() if hit is None else hit
    return df.agg(F.count(F.lit(1)).alias("n_points"), F.sum(flag.cast("long")).alias("n_hit"),
                  F.avg(flag.cast("double")).alias("coverage"))


CONSISTENCY_POINTS = 1 << 15  # points per tile on average
POINT_BLOCK = 1 << 13         # points of a tile that meet a camera at once
PATCH_BYTES = 1 << 24         # pixels cut out before they are handed on
PATCH_CAMERAS = 16            # cameras whose patches are measured at once


def _windows(c: dict[str, np.ndarray], bounds: np.ndarray, who: np.ndarray, mid: np.ndarray, half: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of pairs (camera, box): first and last column and line of the image that points of the box can fall on."""
    o = {k: v[who] for k, v in c.items()}
    centre = np.column_stack([sum((o[f"m{3 * i + j}"] * mid[:, j] for j in range(3)), o[f"t{i}"]) for i in range(3)])
    reach = np.column_stack([sum(np.abs(o[f"m{3 * i + j}"]) * half[j] for j in range(3)) for i in range(3)])
    near, far = centre[:, 2] - reach[:, 2], centre[:, 2] + reach[:, 2]
    safe = np.where(near > 1e-5, near, 1.0)
    span = []
    for axis in (0, 1):
        low, high = centre[:, axis] - reach[:, axis], centre[:, axis] + reach[:, axis]
        low, high = np.where(low < 0, low / safe, low / np.maximum(far, safe)), np.where(high > 0, high / safe, high / np.maximum(far, safe))
        span.append([np.maximum(low, bounds[who, 2 * axis]), np.minimum(high, bounds[who, 2 * axis + 1])])
    most = [np.maximum(np.abs(low), np.abs(high)) for low, high in span]
    with np.errstate(over="ignore", invalid="ignore"):
        q = most[0] * most[0] + most[1] * most[1]
        bend, tang = (np.abs(o["k1"]) + np.abs(o["k2"]) * q) * q, 3.0 * (np.abs(o["p1"]) + np.abs(o["p2"])) * q
        out = []
        for (low, high), m, f, p, n in zip(span, most, ("fx", "fy"), ("cx", "cy"), size[who].T):
            slack = m * bend + tang + 1e-9 * (1.0 + m)
            ends = np.sort([o[f] * (low - slack) + o[p], o[f] * (high + slack) + o[p]], 0)
            whole = (near <= 1e-5) | ~np.isfinite(ends).all(0)
            out += [np.clip(np.where(whole, 0.0, ends[0] - 1.0), 0, n - 1), np.clip(np.where(whole, n, ends[1] + 1.0), 0, n - 1)]
    return np.column_stack(out).astype(np.int64)


def _seen_tiles(c: dict[str, np.ndarray], planes: np.ndarray, grids: list[Grid]) -> tuple[np.ndarray, np.ndarray]:
    """(camera, tile) pairs in which the camera may see a point, found level by level."""
    n, m = 1 << grids[0].depth, grids[0].slabs
    cells = np.stack(np.meshgrid(np.arange(n), np.arange(n), np.arange(m), indexing="ij"), -1).reshape(-1, 3)
    who, cells = np.repeat(np.arange(len(planes)), len(cells)), np.tile(cells, (len(planes), 1))
    for above, grid in zip([None, *grids], grids):
        if above is not None:
            deep = grid.slabs // above.slabs
            child = np.stack(np.meshgrid(np.arange(2), np.arange(2), np.arange(deep), indexing="ij"), -1).reshape(-1, 3)
            who = np.repeat(who, len(child))
            cells = (cells[:, None, :] * [2, 2, deep] + child).reshape(-1, 3)
        at = _box_bounds(c, planes, who, *grid.boxes(cells), 0.0)[0]
        who, cells = who[at], cells[at]
    return who, cells


def _patches(cameras: DataFrame, images: DataFrame, grids: list[Grid], strays: bool) -> DataFrame:
    """Per tile and camera that may see it: the part of the camera's image that the tile's points can fall on.

    A camera without an image has patches without pixels. ``strays``: the whole image also goes to the tile of stray points."""
    grid = grids[-1]
    n, m = 1 << grid.depth, grid.slabs

    def run(batches):
        for batch in batches:
            camera, data = batch.column("camera"), batch.column("data")
            size = np.column_stack([batch.column(k).fill_null(1).to_numpy(zero_copy_only=False) for k in ("iw", "ih")]).astype(np.int64)
            c = _flat(camera)
            bounds = np.array([cam.view_bounds({k: float(c[k][i]) for k in cam.OPTICS}, c["width"][i], c["height"][i]) for i in range(len(camera))]).reshape(-1, 4)
            planes = _view_planes(c, 0.0)
            for one in range(len(camera)):
                some = {k: v[one:one + 1] for k, v in c.items()}
                _, cells = _seen_tiles(some, planes[one:one + 1], grids)
                mid, half = grid.boxes(cells)
                window = _windows(some, bounds[one:one + 1], np.zeros(len(cells), np.int64), mid, half, size[one:one + 1])
                key = (cells[:, 0] * n + cells[:, 1]) * m + cells[:, 2]
                if strays:
                    key, window = np.append(key, STRAY), np.vstack([window, [[0, size[one, 0] - 1, 0, size[one, 1] - 1]]])
                image = None
                if data[one].is_valid:
                    flat = np.frombuffer(data[one].as_buffer(), np.uint8)
                    image = np.empty((size[one, 1] * size[one, 0], 3), np.uint8)
                    image[:] = FALLBACK                   # pixels that the data does not hold
                    whole = min(len(image), len(flat) // 3)
                    image[:whole] = flat[:whole * 3].reshape(-1, 3)
                    image = image.reshape(size[one, 1], size[one, 0], 3)
                step = max(1, PATCH_BYTES // (int(size[one].prod()) * 3))
                for first in range(0, len(key), step):
                    k, w = key[first:first + step], window[first:first + step]
                    cut_out = [None if image is None else image[y0:y1 + 1, x0:x1 + 1].tobytes() for x0, x1, y0, y1 in w]
                    box = (w[:, 0], w[:, 2], w[:, 1] - w[:, 0] + 1, w[:, 3] - w[:, 2] + 1, np.full(len(k), size[one, 0]), np.full(len(k), size[one, 1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k, pa.int64()), camera.take(pa.array(np.full(len(k), one))), *[pa.array(a, pa.int32()) for a in box], pa.array(cut_out, pa.binary())],
                        ["cell", "camera", "left", "top", "across", "down", "iw", "ih", "pixels"])

    rasters = images.select(F.col("cam_id").alias("_id"), F.col("width").alias("iw"), F.col("height").alias("ih"), "data")
    both = cameras.join(rasters.hint("merge"), F.col("camera.cam_id") == F.col("_id"), "left").select("camera", "iw", "ih", "data")
    schema = T.StructType([T.StructField("cell", T.LongType()), both.schema["camera"],
                           *[T.StructField(k, T.IntegerType()) for k in ("left", "top", "across", "down", "iw", "ih")], T.StructField("pixels", T.BinaryType())])
    return both.mapInArrow(run, schema)


def _patches_outweigh(cameras: DataFrame, grids: list[Grid], sums: float) -> bool:
    """Would ``_patches`` send more bytes of pixels to tiles than ``sums``? Told from the cameras alone."""

    def run(batches):
        for batch in batches:
            total = 0
            for first in range(0, batch.num_rows, PATCH_CAMERAS):
                c = _flat(batch.column("camera").slice(first, PATCH_CAMERAS))
                bounds = np.array([cam.view_bounds({k: float(c[k][i]) for k in cam.OPTICS}, c["width"][i], c["height"][i]) for i in range(len(c["cam_id"]))]).reshape(-1, 4)
                who, cells = _seen_tiles(c, _view_planes(c, 0.0), grids)
                size = np.column_stack([np.nan_to_num(c["width"], nan=1), np.nan_to_num(c["height"], nan=1)]).astype(np.int64)
                x0, x1, y0, y1 = _windows(c, bounds, who, *grids[-1].boxes(cells), size).T
                total += 3 * int(((x1 - x0 + 1) * (y1 - y0 + 1)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([float(total)])], ["bytes"])

    return (cameras.mapInArrow(run, "bytes double").agg(F.sum("bytes")).first()[0] or 0.0) > sums


def _add_views(sums: np.ndarray, p: np.ndarray, c: dict[str, float], bounds, patch: dict) -> None:
    """Add the colours in which a camera sees points to their sums: count, three sums, three sums of squares."""
    pixels = None if patch["pixels"] is None else np.frombuffer(patch["pixels"], np.uint8).reshape(-1, 3).astype(np.int64)
    for first in range(0, len(p), POINT_BLOCK):
        x, y, z = p[first:first + POINT_BLOCK].T
        xc, yc, zc = (c[f"m{3 * i}"] * x + c[f"m{3 * i + 1}"] * y + c[f"m{3 * i + 2}"] * z + c[f"t{i}"] for i in range(3))
        front = zc > cam.FRONT_EPS
        depth = np.where(front, zc, 1.0)
        xn, yn = xc / depth, yc / depth
        at = np.flatnonzero(front & (xn >= bounds[0]) & (xn <= bounds[1]) & (yn >= bounds[2]) & (yn <= bounds[3]))
        u, v, _ = cam.distort_arrays(c, xn[at], yn[at])
        ok = (u >= 0) & (u < c["width"]) & (v >= 0) & (v < c["height"])
        at = at[ok] + first
        if pixels is None:
            rgb = np.broadcast_to(np.array(FALLBACK, np.int64), (len(at), 3))
        else:
            px = np.minimum(u[ok].astype(np.int64), patch["iw"] - 1) - patch["left"]
            py = np.minimum(v[ok].astype(np.int64), patch["ih"] - 1) - patch["top"]
            if len(at) and (min(px.min(), py.min()) < 0 or px.max() >= patch["across"] or py.max() >= patch["down"]):
                raise ValueError("a point falls outside the part of the image that its tile was given")
            rgb = pixels[py * patch["across"] + px]
        sums[at, 0] += 1
        sums[at, 1:4] += rgb
        sums[at, 4:] += rgb * rgb


def color_consistency(points: DataFrame, cameras: DataFrame, images: DataFrame, transform=None,
                      min_views: int = 2) -> DataFrame:
    """Per point seen at least ``min_views`` times: mean over channels of the colour's
    standard deviation across all cameras that see it (0..1 scale).

    Views are points x cameras by nature and are never rows, but seven integer sums per point. Of two ways the one that
    writes less is taken. Where cameras overlap little, points are shuffled once by tile, in front of the parts of the
    images that show the tile; a task holds the points of a tile (a tile with very many comes in pieces) and one patch.
    Where parts of images would outweigh the sums, points are written by tile and images stay in the tasks that read them
    (``consistency``)."""
    from .consistency import SUM_BYTES, streamed_sums

    spark = points.sparkSession
    ship_package(spark)
    names = ("views", *(f"{k}{i}" for k in "sq" for i in range(3)))
    box = ground_box(points)
    slim = points.select(F.col("point_id").cast("long").alias("point_id"), "x", "y", "z")
    if box is None:
        return spark.createDataFrame([], "point_id long, views long, sd double")
    deepest = min(10, max(3, math.ceil(math.log(box["n"] / CONSISTENCY_POINTS, 4))))
    grids = [Grid(box, d) for d in range(deepest + 1)]
    keyed = slim.withColumn("cell", grids[-1].cell_of(F.col("x"), F.col("y"), F.col("z"))).where("cell IS NOT NULL")
    pieces = cut(keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE_POINTS).alias("pieces")))
    tasks = max(spark.sparkContext.defaultParallelism, min(4096, pieces.agg(F.sum("pieces")).first()[0] or 1))
    cores = spark.sparkContext.defaultParallelism
    views = cut(into_target_frame(cameras, transform).repartition(cores, "camera.cam_id"))
    if _patches_outweigh(views, grids, SUM_BYTES * cores * box["n"]):
        placed = " AND ".join(f"abs({c}) < double('inf')" for c in "xyz")      # all others are seen by no camera
        mine = keyed.where(placed).join(F.broadcast(pieces) if deepest < 8 else pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("point_id", "x", "y", "z"), F.col("pieces")))
        return _spread_of_colours(streamed_sums(mine.select("point_id", "x", "y", "z", "cell", "piece"), views, images, tasks), names, min_views)
    patch = _patches(views, images, grids, box["strays"]).join(F.broadcast(pieces) if deepest < 8 else pieces, "cell").withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    mine = keyed.join(F.broadcast(pieces) if deepest < 8 else pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("point_id", "x", "y", "z"), F.col("pieces")))
    parts = [f for f in patch.columns if f not in ("cell", "pieces", "piece")]
    point = F.struct("point_id", "x", "y", "z")
    kinds = {"point": mine.select(point.alias("point")).schema["point"].dataType, "patch": patch.select(F.struct(*parts).alias("patch")).schema["patch"].dataType}
    rows = mine.select("cell", "piece", F.lit(0).alias("kind"), point.alias("point"), F.lit(None).cast(kinds["patch"]).alias("patch")).union(
        patch.select("cell", "piece", F.lit(1).alias("kind"), F.lit(None).cast(kinds["point"]).alias("point"), F.struct(*parts).alias("patch")))

    def stream(batches):
        def sums():
            seen = np.flatnonzero(total[:, 0])
            known = pa.concat_arrays(ids).take(pa.array(seen))
            return pa.RecordBatch.from_arrays([known, *[pa.array(total[seen, i], pa.int64()) for i in range(7)]], ["point_id", *names])

        tile, ids, xyz, place, total = None, [], [], None, None
        for batch in batches:
            cell, piece, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turn = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows]):
                if a == b:
                    continue
                if (cell[a], piece[a]) != tile:
                    if total is not None:
                        yield sums()
                    tile, ids, xyz, place, total = (cell[a], piece[a]), [], [], None, None
                if kind[a] == 0:
                    some = batch.column("point").slice(a, b - a)
                    fields = dict(zip(("point_id", "x", "y", "z"), some.flatten()))
                    ids.append(fields["point_id"])
                    xyz.append(np.column_stack([fields[k].to_numpy(zero_copy_only=False) for k in "xyz"]))
                elif ids:
                    if total is None:
                        place = np.concatenate(xyz)
                        total = np.zeros((len(place), 7), np.int64)
                    some = batch.column("patch").slice(a, b - a)
                    fields = dict(zip(parts, some.flatten()))
                    c = _flat(fields["camera"])
                    bound = [fields[k].to_numpy() for k in parts[1:-1]]
                    for i in range(b - a):
                        one = {k: v[i] for k, v in c.items()}
                        edge = cam.view_bounds({k: float(one[k]) for k in cam.OPTICS}, one["width"], one["height"])
                        room = [1e-9 * (1.0 + abs(e)) for e in edge]
                        edge = (edge[0] - room[0], edge[1] + room[1], edge[2] - room[2], edge[3] + room[3])
                        pixels = fields["pixels"][i]
                        _add_views(total, place, one, edge, dict(zip(parts[1:-1], (int(v[i]) for v in bound)), pixels=pixels.as_buffer() if pixels.is_valid else None))
        if total is not None:
            yield sums()

    summed = rows.repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece", "kind").mapInArrow(
        stream, "point_id long, " + ", ".join(f"{k} long" for k in names))
    return _spread_of_colours(summed, names, min_views)


def _spread_of_colours(sums: DataFrame, names: Sequence[str], min_views: int) -> DataFrame:
    """Views of every point and the mean over channels of the standard deviation, from sums in any number of rows."""
    summed = sums.groupBy("point_id").agg(*[F.sum(k).alias(k) for k in names])
    n = F.col("views").cast("double")
    var = [(F.col(f"q{i}") * n - F.col(f"s{i}").cast("double") * F.col(f"s{i}")) / (n * n * F.lit(255.0 * 255.0)) for i in range(3)]
    sd = [F.sqrt(F.greatest(v, F.lit(0.0))) for v in var]
    return summed.select("point_id", "views", ((sd[0] + sd[1] + sd[2]) / 3).alias("sd")).where(F.col("views") >= min_views)


def consistency_summary(per_point: DataFrame, points: DataFrame) -> DataFrame:
    total = points.agg(F.count(F.lit(1)).alias("n_points"))
    stats = per_point.agg(F.count(F.lit(1)).alias("n_seen"), F.avg("sd").alias("mean_sd"))
    return stats.select("n_seen", total.scalar().alias("n_points"), "mean_sd")


def temperature_stats(df: DataFrame, col: str = "temp") -> DataFrame:
    """Hits, min, median, max and the 2 % / 98 % marks of a temperature column."""
    from .percentiles import quantiles

    q = quantiles(df.where(F.col(col).isNotNull()), {col: [0.02, 0.5, 0.98]})[col]
    base = df.agg(F.count(F.lit(1)).alias("n_points"), F.count(col).alias("n_hit"),
                  F.min(col).alias("t_min"), F.max(col).alias("t_max"))
    lits = [F.lit(v).alias(n) for v, n in zip(q, ("t_lo", "t_median", "t_hi"))]
    return base.select("*", *lits)


def score_candidates(points: DataFrame, cameras: DataFrame, transforms: dict[str, tuple]) -> DataFrame:
    """Coverage of the cloud under each named transform (best first)."""
    parts = []
    for place, (name, transform) in enumerate(transforms.items()):
        c = coverage(best_camera(points, cameras, transform))
        parts.append(c.select(F.lit(name).alias("candidate"), F.lit(place).alias("place"), "n_points", "n_hit", "coverage"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_by_coverage(scores: DataFrame) -> DataFrame:
    """First candidate (in the order they were given) with the highest coverage."""
    return scores.agg(F.max_by("candidate", F.struct("coverage", -F.col("place"))).alias("candidate"),
                      F.max("coverage").alias("coverage"))
