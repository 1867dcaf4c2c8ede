"""Plan-view alignment of an upright model to an upright target: turn, shift, height."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import rot_z
from ..functions.literals import constant_rows
from ..session import cut, ship_package
from .correlate import Windows, bulks, layout
from .grid import DsmGrid, dsm, dsm_quality, top_angles
from .percentiles import quantiles

BROADCAST_CELLS = 2_000_000
DENSE_CELLS = 4_000_000     # cells of a window that is held as a raster, the empty ones included
Pose = tuple[float, float, float, float]   # yaw, tx, ty, tz


def _pose_array(poses: Sequence[Pose]):
    rows = [{"pose": i, "c": math.cos(a), "s": math.sin(a), "tx": float(x), "ty": float(y), "tz": float(z)}
            for i, (a, x, y, z) in enumerate(poses)]
    return constant_rows(rows, "pose: int, c: double, s: double, tx: double, ty: double, tz: double")


class Heights:
    """Heights by cell number: a raster while the window allows it, else sorted numbers."""

    def __init__(self, size: int, key: np.ndarray, z: np.ndarray):
        ok = ~np.isnan(z)
        key, z = key[ok], z[ok].astype(np.float32)              # heights are single precision as they are
        self.dense = size <= DENSE_CELLS
        order = np.argsort(key)
        self.key, self.z = key[order], z[order]
        if self.dense:
            self.z = np.full(size, np.nan, np.float32)
            self.z[key] = z

    def at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Height of every cell as a double, and whether it has one."""
        if self.dense or not len(self.key):
            found = self.z[key].astype(float) if self.dense else np.full(len(key), np.nan)
            return found, ~np.isnan(found)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.z[at].astype(float), self.key[at] == key


class Surface:
    """Height model of the target, ready to score poses of a model."""

    def __init__(self, target: DataFrame, res: float = 0.4):
        self.grid = DsmGrid(target, res)
        self.cells = cut(dsm(target, res, self.grid))
        self.small = self.cells.count() <= BROADCAST_CELLS
        self._held = None

    def _at(self):
        """The cells of a small surface, sent to every executor once."""
        if self._held is None:
            spark = self.cells.sparkSession
            ship_package(spark)
            held = self.cells.select("ix", "iy", "z").toPandas()
            key = held["ix"].to_numpy() * self.grid.ny + held["iy"].to_numpy()
            self._held = spark.sparkContext.broadcast(Heights(self.grid.nx * self.grid.ny, key, held["z"].to_numpy(np.float64, na_value=np.nan)))
        return self._held

    def scores(self, model: DataFrame, n_model: int, poses: Sequence[Pose], sigma: float, min_hits: int = 500) -> list[float]:
        """Robust kernel score of every pose, all poses in one job.

        sum exp(-(r / sigma)^2) / n_model; 0 when fewer than ``min_hits`` points fall in
        the window or on occupied cells, a fit to a corner being no fit. With a small surface every task looks its points
        up and hands on three sums per pose; no row per point and pose is made.
        """
        rows = (self._sums_by_task if self.small else self._sums_by_join)(model, poses, sigma)
        out = [0.0] * len(poses)
        for row in rows:
            if min(row["n"], row["m"]) >= min_hits:
                out[row["pose"]] = row["s"] / n_model
        return out

    def _sums_by_task(self, model: DataFrame, poses: Sequence[Pose], sigma: float) -> list:
        grid, held = self.grid, self._at()

        def run(batches):
            heights, total = held.value, np.zeros((len(poses), 3))
            for batch in batches:
                x, y, z = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz")
                valued = batch.column("z").is_valid().to_numpy(zero_copy_only=False)
                turned = {a: (math.cos(a) * x - math.sin(a) * y, math.sin(a) * x + math.cos(a) * y) for a in {p[0] for p in poses}}
                for i, (a, tx, ty, tz) in enumerate(poses):
                    ix, iy = (np.trunc((v + t - first) / grid.res) for v, t, first in zip(turned[a], (tx, ty), (grid.x0, grid.y0)))
                    inside = np.flatnonzero((ix >= 0) & (ix < grid.nx) & (iy >= 0) & (iy < grid.ny))
                    surface, there = heights.at((ix[inside] * grid.ny + iy[inside]).astype(np.int64))
                    use = inside[there]
                    r = ((z[use] + tz) - surface[there]) / sigma
                    value = np.exp(-r * r)
                    total[i] += len(inside), len(use), value.sum() if valued.all() else value[valued[use]].sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(poses)), pa.int32()), *map(pa.array, total.T)], ["pose", "n", "m", "s"])

        part = model.select("x", "y", "z").mapInArrow(run, "pose int, n double, m double, s double")
        return part.groupBy("pose").agg(*[F.sum(c).alias(c) for c in "nms"]).collect()

    def _sums_by_join(self, model: DataFrame, poses: Sequence[Pose], sigma: float) -> list:
        df = model.select("x", "y", "z", F.explode(_pose_array(poses)).alias("p"))
        x = F.col("p.c") * F.col("x") - F.col("p.s") * F.col("y") + F.col("p.tx")
        y = F.col("p.s") * F.col("x") + F.col("p.c") * F.col("y") + F.col("p.ty")
        ix, iy = self.grid.cell(x, y)
        df = df.select(F.col("p.pose").alias("pose"), (F.col("z") + F.col("p.tz")).alias("mz"), ix.alias("ix"), iy.alias("iy"))
        df = df.where(self.grid.inside(F.col("ix"), F.col("iy")))
        cells = self.cells.withColumnRenamed("z", "surface")
        r = (F.col("mz") - F.col("surface")) / F.lit(float(sigma))
        return (df.join(cells, ["ix", "iy"], "left").groupBy("pose")
                .agg(F.count(F.lit(1)).alias("n"), F.count("surface").alias("m"), F.coalesce(F.sum(F.exp(-r * r)), F.lit(0.0)).alias("s")).collect())


def dsm_score(model: DataFrame, target: DataFrame, poses: Sequence[Pose], sigma: float, res: float = 0.4) -> DataFrame:
    """pose, score for a list of candidate poses."""
    s = Surface(target, res).scores(model, model.count(), poses, sigma)
    return model.sparkSession.createDataFrame(list(enumerate(s)), "pose int, score double")


def coarse_yaw(model: DataFrame, target: DataFrame, res: float = 0.5, n: int | None = None, step: float = 2.0, fine: float = 0.25) -> dict:
    """Turn and plan shift by correlating height rasters over the full circle, then in quarter degrees around the best.

    ``n`` cuts both rasters to n x n cells about the middle of either cloud, with shifts that wrap around; by default
    nothing but stray points is cut off and all shifts are tried. ``second`` is the best score more than ten
    degrees from the winner.
    """
    model = cut(model.select("x", "y", "z"))
    held, aim = bulks(model, target)
    model, target = held.rows(model), aim.rows(target)
    plan = layout(res, model, held.at, target, n)
    windows = Windows(target, plan)
    middle = plan.target.at

    circle = cut(windows.best(model, np.arange(0.0, 360.0, step)))
    top = top_angles(circle)[0].collect()
    around = [top[0]["angle"] + k * fine for k in range(1 - round(step / fine), round(step / fine)) if k]
    close = windows.best(model, around) if around else circle.limit(0)
    won = circle.union(close).agg(F.max_by(F.struct("*"), F.struct("score", -F.abs(F.col("angle") - F.lit(top[0]["angle"])), -F.col("angle")))).first()[0]
    second = top_angles(circle, winner=won["angle"])[1].first()["second"]
    turn = rot_z(math.radians(won["angle"]))
    moved = turn @ np.array([*held.at, 0.0])
    return {"yaw": math.radians(won["angle"]), "tx": float(middle[0] + res * won["px"] - moved[0]), "ty": float(middle[1] + res * won["py"] - moved[1]),
            "score": won["score"], "second": second, "ratio": won["score"] / second if second > 0 else math.inf,
            "top": [(r["angle"], r["score"]) for r in top]}


# sigma of the kernel, first step in metres and last step of the search at each stage
STAGES = ((2.0, 1.0, 0.1), (1.0, 0.4, 0.02), (0.5, 0.15, 2e-4))
# moves tried around the best pose: every axis, and every pair of axes both ways
MOVES = [d for d in itertools.product((-1, 0, 1), repeat=4) if 1 <= sum(map(abs, d)) <= 2]
SHRINK = (1.0, 0.5, 0.25, 0.125)


def fit_to_dsm(model: DataFrame, target: DataFrame, yaw: float, tx: float, ty: float, res: float = 0.4) -> dict:
    """Maximise the surface score over yaw and shift, kernel narrowing in three stages.

    Every round scores all moves around the best pose at four step sizes in one
    job, takes the best of them, or goes on with a sixteenth of the step. The
    turn moves by two degrees per metre of step.
    """
    surface = Surface(target, res)
    model = cut(model.select("x", "y", "z"))
    n = model.count()
    tz = quantiles(target, {"z": [0.5]})["z"][0] - quantiles(model, {"z": [0.5]})["z"][0]
    pose: Pose = (yaw, tx, ty, tz)
    value = 0.0
    for sigma, step, last in STAGES:
        value = surface.scores(model, n, [pose], sigma)[0]
        while step >= last:
            around, sizes = [], []
            for size in (step * k for k in SHRINK):
                unit = (math.radians(2.0 * size), size, size, size)
                around += [tuple(p + d * u for p, d, u in zip(pose, move, unit)) for move in MOVES]
                sizes += [size] * len(MOVES)
            scores = surface.scores(model, n, around, sigma)
            k = max(range(len(around)), key=lambda i: scores[i])
            if scores[k] > value:
                pose, value, step = around[k], scores[k], min(step, 2.0 * sizes[k])
            else:
                step /= 16.0
    return {"yaw": pose[0], "t": list(pose[1:]), "inliers": value}


def auto_align(model: DataFrame, target: DataFrame) -> dict:
    """Coarse turn, fine fit and the quality report, over all points of both clouds."""
    coarse = coarse_yaw(model, target)
    fine = fit_to_dsm(model, target, coarse["yaw"], coarse["tx"], coarse["ty"])
    q = dsm_quality(model, target, fine["yaw"], fine["t"]).first()
    return {**coarse, **fine, "share": q["share"], "median": q["median"]}


def align_table(model: DataFrame, result: dict) -> DataFrame:
    """The result as a one-row table, the form the stage store keeps."""
    row = (float(result["yaw"]), [float(v) for v in result["t"]], float(result["inliers"]), float(result.get("share", 0.0)),
           float(result.get("median", 0.0)), float(result.get("ratio", 0.0)))
    return model.sparkSession.createDataFrame([row], "yaw double, t array<double>, inliers double, share double, median double, ratio double")
