"""Voxels, height grids and the statistics taken over them.

Everything here is a hash aggregation on a composite cell key with map-side
combine: a cell that holds a third of all points costs one row per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.linear import map_point, rot_z
from .percentiles import quantiles


RUN = 1024              # buckets of nearest_time carried over together
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def voxel_key(size: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(size))).alias("v" + c) for c, o in zip("xyz", origin)]


def first_per(df: DataFrame, keys: Sequence[str | Column], order: str = "point_id") -> DataFrame:
    """Row with the smallest ``order`` per key.

    Every column is a ``min_by`` of its own: buffers of fixed width stay in the hash aggregate's map, where one of
    the whole row would be sorted. ``order`` tells the rows of a key apart; columns of variable width are picked
    by a second, semi-joined step.
    """
    wide = [f.name for f in df.schema if f.name != order and not isinstance(f.dataType, _FIXED)]
    if wide:
        low = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
        return df.join(low, order, "left_semi").select(*df.columns)
    rest = [c for c in df.columns if c != order and c not in [k for k in keys if isinstance(k, str)]]
    low = df.groupBy(*keys).agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])
    return low.select(*df.columns)


def voxel_first(df: DataFrame, voxel: float) -> DataFrame:
    """Lowest point_id of every occupied voxel."""
    return first_per(df, voxel_key(voxel))


def voxel_mean(df: DataFrame, voxel: float, cols: Sequence[str] = ("x", "y", "z"), by: Sequence[str] = ()) -> DataFrame:
    """Mean of ``cols`` per voxel; the lattice starts half a voxel below the minimum."""
    row = df.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    if row["x"] is None:
        return df.select(*by, *cols)
    origin = [row[c] - voxel / 2.0 for c in "xyz"]
    keys = voxel_key(voxel, origin)
    means = [F.avg(c).alias(c) for c in cols]
    return df.groupBy(*by, *keys).agg(*means, F.count(F.lit(1)).alias("n"))


def extent(df: DataFrame) -> tuple[float, float, float]:
    row = df.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    return tuple(float(row[c] or 0.0) for c in "xyz")


def voxel_size(df: DataFrame, divisor: float, floor: float) -> float:
    """Voxel edge from the bounding-box diagonal."""
    return max(floor, math.sqrt(sum(v * v for v in extent(df))) / divisor)


class DsmGrid:
    """Origin and size of a height model; cells by truncation towards zero."""

    def __init__(self, df: DataFrame, res: float):
        row = df.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).first()
        self.res = float(res)
        self.x0, self.y0 = row["x0"] - 2 * res, row["y0"] - 2 * res
        self.nx = int((row["x1"] - self.x0) / res) + 4
        self.ny = int((row["y1"] - self.y0) / res) + 4

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (((x - F.lit(self.x0)) / F.lit(self.res)).cast("long"), ((y - F.lit(self.y0)) / F.lit(self.res)).cast("long"))

    def inside(self, ix: Column, iy: Column) -> Column:
        return (ix >= 0) & (ix < self.nx) & (iy >= 0) & (iy < self.ny)


def dsm(df: DataFrame, res: float = 0.4, grid: DsmGrid | None = None) -> DataFrame:
    """Highest z (single precision) per occupied cell: ix, iy, z."""
    grid = grid or DsmGrid(df, res)
    ix, iy = grid.cell(F.col("x"), F.col("y"))
    return df.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.max("z").cast("float").cast("double").alias("z"))


def height_raster(df: DataFrame, cx: float, cy: float, res: float = 0.5, n: int = 512, by: Sequence[str] = ()) -> DataFrame:
    """Highest z per cell of an n x n window about (cx, cy), standardised over the occupied cells."""
    ix = F.floor((F.col("x") - F.lit(cx)) / F.lit(res)) + F.lit(n // 2)
    iy = F.floor((F.col("y") - F.lit(cy)) / F.lit(res)) + F.lit(n // 2)
    cells = (df.select(*by, ix.alias("ix"), iy.alias("iy"), "z")
             .where(F.col("ix").between(0, n - 1) & F.col("iy").between(0, n - 1))
             .groupBy(*by, "ix", "iy").agg(F.max("z").cast("float").cast("double").alias("z")))
    stats = cells.groupBy(*by).agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"))
    # a group has at most n * n cells
    if by:
        joined = cells.join(stats, list(by))
        mean, sd = F.col("mean"), F.col("sd")
    else:
        row = stats.first()
        joined, mean, sd = cells, F.lit(row["mean"]), F.lit(row["sd"])
    value = F.when(sd > 1e-6, (F.col("z") - mean) / F.when(sd > 1e-6, sd).otherwise(F.lit(1.0))).otherwise(F.col("z") - mean)
    return joined.withColumn("value", value).select(*by, "ix", "iy", "value")


def on_dsm(model: DataFrame, cells: DataFrame, grid: DsmGrid, yaw: float = 0.0, t: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Residual r = z - surface of every moved model point that falls on an occupied cell."""
    x, y, z = map_point(rot_z(yaw), t, F.col("x"), F.col("y"), F.col("z"))
    moved = model.select("*", x.alias("mx"), y.alias("my"), z.alias("mz"))
    ix, iy = grid.cell(F.col("mx"), F.col("my"))
    keyed = moved.select("*", ix.alias("ix"), iy.alias("iy")).where(grid.inside(F.col("ix"), F.col("iy")))
    return keyed.join(cells.withColumnRenamed("z", "surface"), ["ix", "iy"]).withColumn("r", F.col("mz") - F.col("surface"))


def dsm_quality(model: DataFrame, target: DataFrame, yaw: float, t: Sequence[float], res: float = 0.4, tol: float = 0.5) -> DataFrame:
    """Share of model points within ``tol`` of the surface and median distance to it (0, 0 when none)."""
    grid = DsmGrid(target, res)
    r = on_dsm(model, dsm(target, res, grid), grid, yaw, t).select(F.abs("r").alias("r"))
    median = quantiles(r, {"r": [0.5]})["r"][0]
    stats = r.agg(F.count(F.lit(1)).alias("n_on"), F.coalesce(F.avg((F.col("r") < tol).cast("double")), F.lit(0.0)).alias("share"))
    return stats.withColumn("median", F.lit(0.0 if math.isnan(median) else median))


def slope_edges(cells: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Cells whose surface differs by more than ``threshold`` from a 4-neighbour."""
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = cells.select("*", F.explode(steps).alias("s")).select(
        (F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), F.col("z").alias("zn"))
    near = cells.join(moved, ["ix", "iy"]).groupBy("ix", "iy").agg(F.max(F.abs(F.col("z") - F.col("zn"))).alias("step"))
    return near.where(F.col("step") > threshold)


def edge_consistency(per_point: DataFrame, points: DataFrame, res: float = 0.4, threshold: float = 1.0) -> DataFrame:
    """Colour consistency restricted to points on height edges of the surface model."""
    grid = DsmGrid(points, res)
    edges = slope_edges(dsm(points, res, grid), threshold).select("ix", "iy")
    ix, iy = grid.cell(F.col("x"), F.col("y"))
    on_edge = points.select("point_id", ix.alias("ix"), iy.alias("iy")).join(edges, ["ix", "iy"], "left_semi")
    return per_point.join(on_edge.select("point_id"), "point_id", "left_semi")


# ------------------------------------------------------------------ profile

def cloud_profile(df: DataFrame) -> DataFrame:
    """Counts, bounds, centroid and half diagonal of the finite points; raises when there are none."""
    from .select import finite

    total = df.agg(F.count(F.lit(1)).alias("n_points"))
    aggs = [F.count(F.lit(1)).alias("n_valid")]
    for c in "xyz":
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    out = finite(df).agg(*aggs)
    span = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    radius = F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]) * 0.5
    out = out.withColumn("radius", F.when(radius > 0, radius).otherwise(F.lit(1.0)))
    checked = F.when(F.col("n_valid") > 0, F.col("n_valid")).otherwise(
        F.raise_error(F.lit("all coordinates are invalid")).cast("long"))
    return out.withColumn("n_points", total.scalar()).withColumn("n_valid", checked)


def floor_percentile(df: DataFrame, col: str, lo: float = 0.02, hi: float = 0.98) -> tuple[float, float]:
    """Elements at floor((m - 1) q) of the finite values; (0, 1) when empty."""
    a, b = quantiles(df, {col: [lo, hi]}, "floor")[col]
    if math.isnan(a):
        return 0.0, 1.0
    return a, (a + 1e-6 if a == b else b)


def distance_to(df: DataFrame, centre: Sequence[float], dims: str = "xyz") -> Column:
    d2 = None
    for c, v in zip("xyz", centre):
        if c in dims:
            e = F.col(c) - F.lit(float(v))
            d2 = e * e if d2 is None else d2 + e * e
    return F.sqrt(d2)


def view_radius(df: DataFrame, p: float = 0.95) -> float:
    """Element at floor((m - 1) p) of the distances to the centroid, else the bounding radius."""
    from .transform import centroid
    from .select import finite

    ok = finite(df)
    d = df.select(distance_to(df, centroid(ok)).alias("d"))
    r = quantiles(d, {"d": [p]}, "floor")["d"][0]
    return r if r and not math.isnan(r) else 0.5 * math.sqrt(sum(v * v for v in extent(ok))) or 1.0


def scene_frame(df: DataFrame, p: float = 0.90, flat: bool = False) -> dict[str, float]:
    """Robust centre (median x, y; middle of the 1 % and 99 % heights) and p-distance to it.

    ``flat``: median z as well, and the distance measured in plan.
    """
    q = quantiles(df, {"x": [0.5], "y": [0.5], "z": [0.01, 0.5, 0.99]})
    z = q["z"][1] if flat else 0.5 * (q["z"][0] + q["z"][2])
    centre = (q["x"][0], q["y"][0], z)
    d = df.select(distance_to(df, centre, "xy" if flat else "xyz").alias("d"))
    return {"cx": centre[0], "cy": centre[1], "cz": z, "radius": quantiles(d, {"d": [p]})["d"][0]}


def residual_stats(pairs: DataFrame, col: str = "residual") -> DataFrame:
    """Mean, median and maximum of a residual column."""
    median = quantiles(pairs, {col: [0.5]})[col][0]
    return pairs.agg(F.avg(col).alias("mean"), F.max(col).alias("max")).withColumn("median", F.lit(median))


def robust_normalize(df: DataFrame, col: str, lo: float = 0.02, hi: float = 0.98, out: str = "norm") -> DataFrame:
    """Stretch between two percentiles to 0..1."""
    a, b = quantiles(df, {col: [lo, hi]})[col]
    value = (F.col(col) - F.lit(a)) / F.lit(b - a + 1e-9)
    return df.withColumn(out, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def intensity_tint(df: DataFrame, base: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Colours of the editor: intensity ramp times base, selection in red."""
    from ..functions.colour import clip, tint
    from .select import selected, visible

    vis = df.where(visible(df))
    a, b = quantiles(vis, {"intensity": [0.02, 0.98]})["intensity"]
    if math.isnan(a):
        rgb = [F.lit(float(v)) for v in base]
    else:
        b = a + 1.0 if b <= a else b
        rgb = tint(clip((F.col("intensity") - F.lit(a)) / F.lit(b - a), 0, 1), base)
    # Fixed value: highlight colour.
    marked = [F.when(selected(df), F.lit(m)).otherwise(c) for m, c in zip((1.0, 0.15, 0.15), rgb)]
    bytes_ = [F.least(F.greatest(c * 255.0, F.lit(0.0)), F.lit(255.0)).cast("short") for c in marked]
    return vis.withColumns(dict(zip(("red", "green", "blue"), bytes_)))


def pair_ratios(pairs: DataFrame, tile: int = 4096) -> DataFrame:
    """Smallest and largest ratio of target to source distance over all pairs of picks.

    All pairs by nature. Rows (pair_id, sx.., tx..) are packed into blocks of about ``tile``; a task meets two blocks at a
    time and hands on three numbers, so no pair is ever a row. A pair without a distance has no ratio but counts.
    """
    names = ("sx", "sy", "sz", "tx", "ty", "tz")
    n = max(1, math.ceil(pairs.count() / tile))
    whole = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0)) == 0
    row = F.struct(F.col("pair_id").alias("id"), whole.alias("whole"), *[F.col(c).cast("double").alias(c) for c in names])
    blocks = (pairs.where("pair_id IS NOT NULL").groupBy(F.pmod(F.xxhash64("pair_id", *names), F.lit(n)).alias("bi"))
              .agg(F.collect_list(row).alias("rows")))
    # every two blocks meet once, under the key (smaller, larger)
    ends = F.when(F.col("bi") <= F.col("other"), F.struct(F.col("bi").alias("a"), F.col("other").alias("b"))).otherwise(
        F.struct(F.col("other").alias("a"), F.col("bi").alias("b")))
    meetings = n * (n + 1) // 2
    tasks = min(meetings, max(4 * pairs.sparkSession.sparkContext.defaultParallelism, meetings // 64))
    spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select(ends.alias("pair"), "bi", "rows")
    left = spread.where(F.col("bi") == F.col("pair.a")).select("pair", F.col("rows").alias("left"))
    right = spread.where(F.col("bi") == F.col("pair.b")).select("pair", F.col("rows").alias("right"))

    def arrays(column: pa.ListArray) -> dict[str, np.ndarray]:
        rows = column.flatten()
        return {f.name: a.to_numpy(zero_copy_only=False) for f, a in zip(rows.type, rows.flatten())}

    def met(batches):
        for batch in batches:
            total, low, high = 0, [], []
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                same = one.column("pair").field("a").equals(one.column("pair").field("b"))
                a, b = arrays(one.column("left")), arrays(one.column("right"))
                for first in range(0, len(a["id"]), 64):
                    part = {c: v[first:first + 64, None] for c, v in a.items()}
                    mine = part["id"] < b["id"] if same else part["id"] != b["id"]
                    total += int(mine.sum())
                    s, t = (np.sqrt((part[p + "x"] - b[p + "x"]) ** 2 + (part[p + "y"] - b[p + "y"]) ** 2 + (part[p + "z"] - b[p + "z"]) ** 2) for p in "st")
                    held = mine & part["whole"] & b["whole"] & ~(s <= 0)
                    ratio = t[held] / s[held]
                    if len(ratio):                      # NaN counts as the greatest number, as in Spark
                        low.append(float(np.fmin.reduce(ratio)))
                        high.append(float(ratio.max()))
            low = [float(np.fmin.reduce(low))] if low else []
            high = [float(np.max(high))] if high else []
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([min(low, default=None)], pa.float64()), pa.array([max(high, default=None)], pa.float64())],
                                             ["n", "low", "high"])

    each = left.repartition(tasks, "pair").join(right.repartition(tasks, "pair").hint("merge"), "pair").mapInArrow(met, "n long, low double, high double")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_pairs"), F.min("low").alias("min_ratio"), F.max("high").alias("max_ratio"))


def arg_extreme(df: DataFrame, value: str, order: str, by: Sequence[str] = (), smallest: bool = False) -> DataFrame:
    """Row with the extreme ``value``; the lowest ``order`` wins ties."""
    if smallest:
        best = F.min(F.struct(F.col(value).alias("_v"), F.col(order).alias("_o"))).alias("best")
        pick = F.col("best._o")
    else:
        best = F.max(F.struct(F.col(value).alias("_v"), (-F.col(order)).alias("_o"))).alias("best")
        pick = -F.col("best._o")
    return df.groupBy(*by).agg(best).select(*by, F.col("best._v").alias(value), pick.alias(order))


def top_angles(scores: DataFrame, k: int = 5, gap: float = 10.0, winner: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(top-k angles by score, best score farther than ``gap`` degrees from the winner, by default the best of all)."""
    top = scores.orderBy(F.desc("score"), "angle").limit(k)
    best = scores.agg(F.max(F.struct("score", (-F.col("angle")).alias("neg")))).first()[0]
    centre = -best["neg"] if winner is None else winner
    apart = F.abs(F.pmod(F.col("angle") - F.lit(centre) + 180.0, F.lit(360.0)) - 180.0)
    second = scores.where(apart > gap).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("second"))
    return top, second.select(F.lit(best["score"]).alias("best"), "second")


def nearest_time(frames: DataFrame, telemetry: DataFrame, bucket: float = 60.0, by: Sequence[str] = ()) -> DataFrame:
    """Telemetry row nearest in time for every frame of the same flight (the columns ``by``); the earlier one wins a tie.

    Time is cut into buckets that sort on their own; what a bucket needs from
    outside is only the last sample before it and the first one after, carried over the occupied buckets, and over
    runs of ``RUN`` buckets first, so that a long recording without a flight key is no single sort either. A frame of a
    flight without telemetry has nulls.
    """
    by = list(by)
    row = F.struct("t", *[c for c in telemetry.columns if c != "t" and c not in by])
    b = F.floor(F.col("t") / F.lit(bucket))
    samples = telemetry.select(*by, b.alias("b"), "t", row.alias("s"), F.lit(None).cast("long").alias("frame"))
    wanted = frames.select(*by, b.alias("b"), "t", F.lit(None).cast(samples.schema["s"].dataType).alias("s"),
                           F.col("frame").cast("long").alias("frame"))
    per = samples.groupBy(*by, "b").agg(F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    occupied = per.unionByName(wanted.select(*by, "b").distinct(), allowMissingColumns=True).groupBy(*by, "b").agg(
        F.max("first_s").alias("first_s"), F.max("last_s").alias("last_s")).withColumn("run", F.floor(F.col("b") / F.lit(RUN)))

    def carried(df: DataFrame, keys: list[str], place: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(place)
        return df.withColumns({"before": F.last("last_s", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
                               "after": F.first("first_s", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))})

    runs = occupied.groupBy(*by, "run").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"))
    lane = [] if by else ["lane"]        # a recording without a key: one row per run of buckets, in one lane
    outer = carried(runs.withColumn("lane", F.lit(0)), by + lane, "run").select(*by, "run", F.col("before").alias("before_run"), F.col("after").alias("after_run"))
    edges = carried(occupied, [*by, "run"], "b").join(outer, [*by, "run"]).select(
        *by, "b", F.coalesce("before", "before_run").alias("before"), F.coalesce("after", "after_run").alias("after"))
    both = samples.unionByName(wanted)
    prev = Window.partitionBy(*by, "b").orderBy("t", F.col("frame").isNotNull(), F.col("s.t").desc())
    nxt = Window.partitionBy(*by, "b").orderBy(F.desc("t"), F.col("frame").isNotNull())
    seen = both.select(*by, "b", "t", "frame", F.last("s", ignorenulls=True).over(prev).alias("p"),
                       F.last("s", ignorenulls=True).over(nxt).alias("n")).where("frame IS NOT NULL")
    j = seen.join(edges, [*by, "b"], "left")
    p, n = F.coalesce("p", "before"), F.coalesce("n", "after")
    j = j.select(*by, "frame", "t", p.alias("p"), n.alias("n"))
    use_prev = F.col("n").isNull() | (F.col("t") - F.col("p.t") <= F.col("n.t") - F.col("t"))
    picked = F.when(F.col("p").isNotNull() & use_prev, F.col("p")).otherwise(F.col("n"))
    rest = [c for c in telemetry.columns if c != "t" and c not in by]
    return j.withColumn("m", picked).select(*by, "frame", F.col("t").alias("frame_t"), F.col("m.t").alias("t"),
                                            *[F.col(f"m.{c}").alias(c) for c in rest])
