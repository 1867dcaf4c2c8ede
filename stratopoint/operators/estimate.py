"""Pose estimation: distributed moments, constant-size solve on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear as la
from .colouring import join_geotags
from .edit import union_models
from .grid import nearest_time
from .transform import apply_affine, to_enu

SRC, TGT = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def pair_moments(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, means, centred cross products (t s^T) and centred squared norm of the sources.

    Centred on the exact means in a second aggregate, because raw second
    moments of map coordinates cancel badly.
    """
    means = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m" + c) for c in (*SRC, *TGT)])
    joined = pairs.join(means, list(by))
    d = {c: F.col(c) - F.col("m" + c) for c in (*SRC, *TGT)}
    cross = [F.sum(d[t] * d[s]).alias(f"c_{t}_{s}") for t in TGT for s in SRC]
    norm = F.sum(sum((d[s] * d[s] for s in SRC[1:]), d[SRC[0]] * d[SRC[0]])).alias("ss")
    keep = [F.first("n").alias("n"), *[F.first("m" + c).alias("m" + c) for c in (*SRC, *TGT)]]
    return joined.groupBy(*by).agg(*keep, *cross, norm)


def solve_similarity(m, with_scale: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of one group -> scale, rotation, translation (least squares, no reflection)."""
    n = m["n"]
    cov = np.array([[m[f"c_{t}_{s}"] for s in SRC] for t in TGT]) / n
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones(3)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[2] = -1.0
    r = (u * sign) @ vt
    var = m["ss"] / n
    s = float((d * sign).sum() / var) if with_scale and var > 0 else 1.0
    ms, mt = (np.array([m["m" + c] for c in names]) for names in (SRC, TGT))
    return s, r, mt - s * r @ ms


def fit_similarity(pairs: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation, translation with t ~ s R src + t from (sx.., tx..) rows."""
    return solve_similarity(_moments_row(pairs))


def _moments_row(pairs: DataFrame):
    mean = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m" + c) for c in (*SRC, *TGT)]).first()
    if not mean["n"]:
        raise ValueError("no correspondences")
    d = {c: F.col(c) - F.lit(mean["m" + c]) for c in (*SRC, *TGT)}
    cross = [F.sum(d[t] * d[s]).alias(f"c_{t}_{s}") for t in TGT for s in SRC]
    norm = F.sum(d["sx"] * d["sx"] + d["sy"] * d["sy"] + d["sz"] * d["sz"]).alias("ss")
    return {**mean.asDict(), **pairs.agg(*cross, norm).first().asDict()}


def fit_rigid(pairs: DataFrame) -> np.ndarray:
    """4x4 rigid motion of the same least-squares problem, scale fixed at one."""
    _, r, t = solve_similarity(_moments_row(pairs), with_scale=False)
    return la.join4(r, t)


def fit_groups(pairs: DataFrame, by: str, with_scale: bool = True) -> DataFrame:
    """One fit per group: the moments are a shuffle aggregate, the 3x3 solves run in the executors."""
    def solve(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for m in pdf.to_dict("records"):
                s, r, t = solve_similarity(m, with_scale)
                rows.append((m[by], s, r.ravel().tolist(), t.tolist(), m["n"]))
            yield pd.DataFrame(rows, columns=[by, "s", "r", "t", "n"])

    kind = dict(pairs.dtypes)[by]
    return pair_moments(pairs, [by]).mapInPandas(solve, f"{by} {kind}, s double, r array<double>, t array<double>, n long")


def residuals(pairs: DataFrame, s: float, r: np.ndarray, t: np.ndarray) -> DataFrame:
    """Distance between the moved source and the target of every pair."""
    moved = la.map_point(s * np.asarray(r), t, *[F.col(c) for c in SRC])
    d = [m - F.col(c) for m, c in zip(moved, TGT)]
    return pairs.withColumn("residual", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def centre_pairs(matched: DataFrame) -> DataFrame:
    """Cameras with east, north, up -> correspondences centre -> ENU."""
    return matched.select(F.col("c.x").alias("sx"), F.col("c.y").alias("sy"), F.col("c.z").alias("sz"),
                          F.col("east").alias("tx"), F.col("north").alias("ty"), F.col("up").alias("tz"))


def _geo_fit(located: DataFrame) -> dict:
    pairs = centre_pairs(located)
    s, r, t = fit_similarity(pairs)
    stat = residuals(pairs, s, r, t).agg(F.avg("residual").alias("mean"), F.max("residual").alias("max")).first()
    return {"s": s, "r": r, "t": t, "residual_mean": stat["mean"], "residual_max": stat["max"],
            "warn": stat["mean"] > 5.0}


def georeference(cameras: DataFrame, tags: DataFrame, origin: tuple[float, float] | None = None) -> dict:
    """Similarity from model coordinates to local ENU metres, from same-name geotags.

    The origin is the mean of the matched geotags unless given. ``warn`` marks a
    mean residual above 5 m.
    """
    matched = join_geotags(cameras, tags)
    if origin is None:
        o = matched.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
        origin = (o["lat"], o["lon"])
    return {**_geo_fit(to_enu(matched, *origin)), "lat0": origin[0], "lon0": origin[1]}


def georeference_telemetry(cameras: DataFrame, telemetry: DataFrame, frame: Column, fps: float,
                           origin: tuple[float, float] | None = None) -> dict:
    """The same with positions from flight telemetry: camera at frame / fps takes the nearest sample."""
    timed = cameras.withColumn("frame", frame.cast("long")).withColumn("t", F.col("frame") / F.lit(float(fps)))
    located = timed.drop("t").join(nearest_time(timed.select("frame", "t").distinct(), telemetry).drop("t"), "frame")
    if origin is None:
        o = located.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).first()
        origin = (o["lat"], o["lon"])
    return {**_geo_fit(to_enu(located, *origin)), "lat0": origin[0], "lon0": origin[1]}


def apply_geo(df: DataFrame, geo: dict) -> DataFrame:
    return apply_affine(df, geo["s"] * geo["r"], geo["t"])


def move_cameras(cameras: DataFrame, geo: dict) -> DataFrame:
    """Cameras of a model after the model was moved by a similarity: R' = R Rg^T, c' = s Rg c + t."""
    turn = F.array(*[F.lit(float(v)) for v in geo["r"].T.ravel()])
    r = la.matmul_cols(F.col("r"), turn)
    c = la.map_point(geo["s"] * geo["r"], geo["t"], F.col("c.x"), F.col("c.y"), F.col("c.z"))
    out = cameras.withColumns({"r": r, "c": F.struct(*[v.alias(n) for v, n in zip(c, "xyz")])})
    back = la.matvec_cols(F.col("r"), F.array("c.x", "c.y", "c.z"))
    return out.withColumn("t", F.array(*[-v for v in back]))


def merge_models(cams_a: DataFrame, pts_a: DataFrame, geo_a: dict, cams_b: DataFrame, pts_b: DataFrame, geo_b: dict,
                 offset: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Two models brought into one frame; ids of the second are moved by ``offset``."""
    a, b = move_cameras(cams_a, geo_a).withColumn("camera_no", F.lit(1)), move_cameras(cams_b, geo_b).withColumn("camera_no", F.lit(2))
    return union_models(a, b, offset, "cam_id"), union_models(apply_geo(pts_a, geo_a), apply_geo(pts_b, geo_b), offset)


def model_to_model(a: DataFrame, b: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Similarity between two models from their same-name cameras."""
    from .colouring import match_by_name

    m = match_by_name(a, b)
    pairs = m.select(*[F.col(f"c_a.{c}").alias("s" + c) for c in "xyz"], *[F.col(f"c_b.{c}").alias("t" + c) for c in "xyz"])
    return fit_similarity(pairs)


def yaw_of(r: np.ndarray) -> float:
    return math.degrees(math.atan2(r[1, 0], r[0, 0]))
