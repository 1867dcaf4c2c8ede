"""Rigid, similarity and affine maps, geographic conversion, generators, crops."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import linear as la
from ..functions.colour import sigmoid
from .percentiles import quantiles

EARTH_RADIUS = 6378137.0


def apply_affine(df: DataFrame, a, b, inverse: bool = False) -> DataFrame:
    """x, y, z replaced by A p + b (or by A^-1 (p - b))."""
    if inverse:
        inv = np.linalg.inv(np.asarray(a, float))
        moved = [F.col(c) - F.lit(float(v)) for c, v in zip("xyz", b)]
        cols = [la.linear_row(inv[i], *moved) for i in range(3)]
    else:
        cols = la.map_point(np.asarray(a, float), b, F.col("x"), F.col("y"), F.col("z"))
    return df.withColumns(dict(zip("xyz", cols)))


def apply_similarity(df: DataFrame, s: float, r, t, inverse: bool = False) -> DataFrame:
    return apply_affine(df, s * np.asarray(r, float), t, inverse)


def apply_matrix(df: DataFrame, matrix) -> DataFrame:
    return apply_affine(df, *la.split4(matrix))


def apply_transforms(df: DataFrame, transforms: DataFrame, on: str) -> DataFrame:
    """Every row moved by the transform (a ARRAY(9), b ARRAY(3)) of its key."""
    joined = df.join(transforms.select(on, "a", "b"), on)
    cols = la.map_point_cols(F.col("a"), F.col("b"), F.col("x"), F.col("y"), F.col("z"))
    return joined.withColumns(dict(zip("xyz", cols))).drop("a", "b")


def rigid_euler(df: DataFrame, t: Sequence[float], rpy_deg: Sequence[float]) -> DataFrame:
    return apply_affine(df, la.euler_zyx(*rpy_deg), t)


def centroid(df: DataFrame) -> np.ndarray:
    row = df.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
    return np.array([row["x"], row["y"], row["z"]], float)


def yaw_about_centroid(source: DataFrame, target: DataFrame, deg: float) -> np.ndarray:
    """4x4 that turns the source about its centroid and puts it on the target's."""
    r = la.rot_z(math.radians(deg))
    return la.join4(r, centroid(target) - r @ centroid(source))


def pose_to_transform(points: DataFrame, poses: DataFrame, scale: float = 1.0) -> DataFrame:
    """Poses about the cloud centroid -> transforms about the origin, one row per pose.

    ``poses``: cloud_id, q ARRAY(4) as w, x, y, z, and p ARRAY(3), the wanted
    position of the centroid. Result: M = s R(q), t = p - M c.
    """
    c = points.groupBy("cloud_id").agg(F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("c"))
    r = quat_to_mat(F.col("q"))
    joined = poses.join(c, "cloud_id")
    joined = joined.withColumn("a", F.transform(r, lambda v: v * F.lit(float(scale))))
    moved = la.matvec_cols(F.col("a"), F.col("c"))
    return joined.withColumn("b", F.array(*[F.col("p")[i] - moved[i] for i in range(3)])).drop("c", "q", "p")


def compose(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """left after right, per key: A = Al Ar, b = Al br + bl."""
    j = left.select(on, F.col("a").alias("al"), F.col("b").alias("bl")).join(
        right.select(on, F.col("a").alias("ar"), F.col("b").alias("br")), on)
    shifted = la.matvec_cols(F.col("al"), F.col("br"))
    return j.select(on, la.matmul_cols(F.col("al"), F.col("ar")).alias("a"),
                    F.array(*[shifted[i] + F.col("bl")[i] for i in range(3)]).alias("b"))


def chain_affine(yaw: float, t: Sequence[float], s: float, r, t_enu: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Model -> target as one affine: yaw after the similarity, plus the shift."""
    rz = la.rot_z(yaw)
    return rz @ (s * np.asarray(r, float)), rz @ np.asarray(t_enu, float) + np.asarray(t, float)


def to_enu(df: DataFrame, lat0: float | Column, lon0: float | Column) -> DataFrame:
    """lat, lon, rel_alt -> east, north, up in metres on the equirectangular plane."""
    lat0 = F.lit(lat0) if isinstance(lat0, (int, float)) else lat0
    lon0 = F.lit(lon0) if isinstance(lon0, (int, float)) else lon0
    east = F.radians(F.col("lon") - lon0) * F.cos(F.radians(lat0)) * F.lit(EARTH_RADIUS)
    north = F.radians(F.col("lat") - lat0) * F.lit(EARTH_RADIUS)
    return df.withColumns({"east": east, "north": north, "up": F.col("rel_alt").cast("double")})


def to_enu_about_mean(df: DataFrame) -> DataFrame:
    origin = df.agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0")).first()
    return to_enu(df, origin["lat0"], origin["lon0"])


def quat_to_mat(q: Column) -> Column:
    """w, x, y, z (any length) -> row-major rotation matrix."""
    w, x, y, z = q[0], q[1], q[2], q[3]
    n = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    one = F.lit(1.0)
    return F.array(
        one - n * (y * y + z * z), n * (x * y - z * w), n * (x * z + y * w),
        n * (x * y + z * w), one - n * (x * x + z * z), n * (y * z - x * w),
        n * (x * z - y * w), n * (y * z + x * w), one - n * (x * x + y * y))


def mat_to_quat(r: Column) -> Column:
    """Row-major rotation -> unit quaternion w, x, y, z (largest-component branch)."""
    trace = r[0] + r[4] + r[8]
    one, quarter = F.lit(1.0), F.lit(0.25)

    def branch(inner: Column, build) -> Column:
        s = F.sqrt(F.greatest(inner, F.lit(0.0))) * F.lit(2.0)
        return build(F.when(s > 0, s).otherwise(one), s)

    by_w = branch(trace + one, lambda d, s: F.array(quarter * s, (r[7] - r[5]) / d, (r[2] - r[6]) / d, (r[3] - r[1]) / d))
    by_x = branch(one + r[0] - r[4] - r[8],
                  lambda d, s: F.array((r[7] - r[5]) / d, quarter * s, (r[1] + r[3]) / d, (r[2] + r[6]) / d))
    by_y = branch(one + r[4] - r[0] - r[8],
                  lambda d, s: F.array((r[2] - r[6]) / d, (r[1] + r[3]) / d, quarter * s, (r[5] + r[7]) / d))
    by_z = branch(one + r[8] - r[0] - r[4],
                  lambda d, s: F.array((r[3] - r[1]) / d, (r[2] + r[6]) / d, (r[5] + r[7]) / d, quarter * s))
    q = (F.when(trace > 0, by_w).when((r[0] > r[4]) & (r[0] > r[8]), by_x).when(r[4] > r[8], by_y).otherwise(by_z))
    return F.transform(F.array(q), lambda v: F.transform(
        v, lambda e: e / F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] + v[3] * v[3])))[0]


def quat_mul(a: Column, b: Column) -> Column:
    """Hamilton product, w first."""
    return F.array(
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0])


def center(df: DataFrame) -> DataFrame:
    """Coordinates relative to the centroid of the finite points."""
    from .select import finite

    c = centroid(finite(df))
    return df.withColumns({n: F.col(n) - F.lit(float(v)) for n, v in zip("xyz", c)})


def measure(pairs: DataFrame, up: str = "z") -> DataFrame:
    """Distances between (ax, ay, az) and (bx, by, bz)."""
    d = {c: F.col("b" + c) - F.col("a" + c) for c in "xyz"}
    d2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    out = pairs.withColumns({"dx": d["x"], "dy": d["y"], "dz": d["z"], "distance": F.sqrt(d2)})
    rise = F.col("d" + up)
    flat = F.sqrt(F.greatest(F.lit(0.0), F.col("distance") * F.col("distance") - rise * rise))
    return out.withColumns({"horizontal": flat, "rise": F.abs(rise)})


def point_grid(spark: SparkSession, center: Sequence[float], size: float = 2.0, step: float = 0.1,
               plane: str = "XY", intensity: bool = False) -> DataFrame:
    """Square lattice of points centred on ``center`` in one of the planes XY, XZ, YZ."""
    n = max(2, round(size / step) + 1)
    ids = spark.range(n * n)
    spacing = size / (n - 1)
    u = (F.col("id") % n) * F.lit(spacing) - F.lit(size / 2.0)
    v = F.floor(F.col("id") / n) * F.lit(spacing) - F.lit(size / 2.0)
    axes = {"XY": (u, v, F.lit(0.0)), "XZ": (u, F.lit(0.0), v), "YZ": (F.lit(0.0), u, v)}[plane]
    cols = [(a + F.lit(float(c))).alias(n_) for a, c, n_ in zip(axes, center, "xyz")]
    out = ids.select(F.col("id").alias("point_id"), *cols)
    return out.withColumn("intensity", F.lit(0.0)) if intensity else out


def grids_at(centers: DataFrame, size: float = 2.0, step: float = 0.1) -> DataFrame:
    """The XY lattice around every row (point_id, x, y, z) of a table of centres."""
    n = max(2, round(size / step) + 1)
    spacing = size / (n - 1)
    at = F.sequence(F.lit(0), F.lit(n - 1))
    df = centers.withColumn("iv", F.explode(at)).withColumn("iu", F.explode(at))
    return df.select(F.col("point_id").alias("center_id"), "iu", "iv",
                     (F.col("iu") * F.lit(spacing) - F.lit(size / 2.0) + F.col("x")).alias("x"),
                     (F.col("iv") * F.lit(spacing) - F.lit(size / 2.0) + F.col("y")).alias("y"), "z")


def pixel_to_plane(picks: DataFrame, mvp_inverse: Sequence[float], width: int, height: int, base_z: float = 0.0) -> DataFrame:
    """Where the ray through screen position (sx, sy) meets z = base_z; null when parallel."""
    nx = F.col("sx") / F.lit(float(width)) * 2.0 - 1.0
    ny = F.col("sy") / F.lit(float(height)) * 2.0 - 1.0
    m = [float(v) for v in np.asarray(mvp_inverse, float).ravel()]

    def unproject(depth: float) -> list[Column]:
        row = [F.lit(m[4 * i]) * nx + F.lit(m[4 * i + 1]) * ny + F.lit(m[4 * i + 2] * depth + m[4 * i + 3]) for i in range(4)]
        w = F.when(F.abs(row[3]) > 1e-9, row[3]).otherwise(F.lit(1.0))
        return [row[i] / w for i in range(3)]

    near, far = unproject(-1.0), unproject(1.0)
    out = picks.withColumns({**{f"n{c}": v for c, v in zip("xyz", near)},
                             **{f"d{c}": f - v for c, v, f in zip("xyz", near, far)}})
    ok = F.abs(F.col("dz")) >= 1e-9
    t = (F.lit(float(base_z)) - F.col("nz")) / F.when(ok, F.col("dz")).otherwise(F.lit(1.0))
    return out.withColumns({c: F.when(ok, F.col("n" + c) + t * F.col("d" + c)) for c in "xyz"}).drop(
        "nx", "ny", "nz", "dx", "dy", "dz")


def percentile_crop(df: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows inside the closed percentile box of all three axes."""
    q = quantiles(df, {c: [lo, hi] for c in "xyz"})
    cond = F.lit(True)
    for c in "xyz":
        cond = cond & F.col(c).between(F.lit(q[c][0]), F.lit(q[c][1]))
    return df.where(cond)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


def robust_subset(df: DataFrame, cameras: DataFrame | None, pct=(0.01, 0.99), margin: float = 40.0) -> DataFrame:
    """Percentile box, then closer in plan to the median camera than the farthest camera plus margin."""
    out = percentile_crop(df, *pct)
    if cameras is None:
        return out
    flat = _flat(cameras)
    q = quantiles(flat, {"cx": [0.5], "cy": [0.5]})
    mx, my = q["cx"][0], q["cy"][0]

    def dist(x: Column, y: Column) -> Column:
        return F.sqrt((x - mx) * (x - mx) + (y - my) * (y - my))

    far = flat.agg(F.max(dist(F.col("cx"), F.col("cy")))).first()[0]
    return out if far is None else out.where(dist(F.col("x"), F.col("y")) < F.lit(far + margin))


def camera_distances(cameras: DataFrame) -> DataFrame:
    """Cameras with their distance to the median camera centre."""
    flat = _flat(cameras)
    q = quantiles(flat, {c: [0.5] for c in ("cx", "cy", "cz")})
    d2 = sum(((F.col(c) - q[c][0]) * (F.col(c) - q[c][0]) for c in ("cy", "cz")),
             (F.col("cx") - q["cx"][0]) * (F.col("cx") - q["cx"][0]))
    return flat.withColumn("dist", F.sqrt(d2)).drop("cx", "cy", "cz")


def drop_outlier_cameras(cameras: DataFrame, p: float = 0.95, factor: float = 4.0) -> DataFrame:
    d = camera_distances(cameras)
    limit = quantiles(d, {"dist": [p]})["dist"][0] * factor
    return d.where(F.col("dist") < limit)


def scene_scale(cameras: DataFrame) -> float:
    """1.1 times the 90 % distance to the median centre of the kept cameras."""
    return 1.1 * quantiles(camera_distances(cameras), {"dist": [0.9]})["dist"][0]


def clean_splats(df: DataFrame, cameras: DataFrame, min_radius: float = 70.0, opacity: float = 0.08,
                 scale: float = 3.0) -> DataFrame:
    """Drop splats far from the flight, nearly transparent or oversized."""
    flat = _flat(cameras)
    q = quantiles(flat, {c: [0.5] for c in ("cx", "cy", "cz")})
    radius = max(12.0 * quantiles(camera_distances(cameras), {"dist": [0.9]})["dist"][0], min_radius)
    d = [F.col(c) - F.lit(q["c" + c][0]) for c in "xyz"]
    near = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < F.lit(radius)
    largest = F.greatest(*[F.exp(F.col(f"scale_{i}")) for i in range(3)])
    return df.where(near & (sigmoid(F.col("opacity")) > opacity) & (largest < scale))


def stride_of(n: int, limit: int) -> int:
    """Step that brings n rows to about ``limit``; 1 when nothing has to go."""
    return n // limit + 1 if n > limit else 1


def stride_sample(df: DataFrame, limit: int = 400_000, step: int | None = None) -> DataFrame:
    """Every k-th row by point_id (the dense record index of the source)."""
    k = step if step is not None else stride_of(df.count(), limit)
    return df if k == 1 else df.where(F.col("point_id") % k == 0)


def fixed_sample(df: DataFrame, n: int = 50_000, seed: int = 0) -> DataFrame:
    """Reproducible sample without replacement: the n smallest seeded md5 digests of the ids."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), "point_id")), "point_id").limit(n)


def rerank(df: DataFrame, order: Sequence[str], name: str = "point_id") -> DataFrame:
    """Dense 0-based ordinal in the given order, numbered per range partition.

    Partition sizes are added up in a table with one row per partition, so no
    single task ever sees the whole data.
    """
    from ..session import cut

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # record number inside the partition, fixed by writing it down before it is used twice
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = cut(parts.withColumns({"_part": F.spark_partition_id(), "_rn": within}))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_off"))
    return (parts.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_rn") + F.col("_off")).drop("_part", "_rn", "_off"))


def motion_summary(transforms: DataFrame, voxel_fine: float = 0.05) -> DataFrame:
    """Rotation angle, shift length and the verdicts shown after an alignment.

    ``transforms``: a ARRAY(9), b ARRAY(3), fitness.
    """
    a, b = F.col("a"), F.col("b")
    cos = (a[0] + a[4] + a[8] - F.lit(1.0)) / F.lit(2.0)
    angle = F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))
    shift = F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2])
    out = transforms.withColumns({"rotation_deg": angle, "shift": shift})
    same = (F.col("shift") < voxel_fine) & (F.col("rotation_deg") < 0.5)
    verdict = F.when(same, "identity").when(F.col("fitness") < 0.5, "low").otherwise("ok")
    return out.withColumn("verdict", verdict)
