"""End-to-end jobs. Every stage is a table under the work folder and is reused when it is there."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colour import palette, to_byte, white_hot
from ..functions.linear import join4, rot_z
from ..operators import align as AL
from ..operators import colouring as C
from ..operators import edit as E
from ..operators import estimate as T
from ..operators import grid as G
from ..operators import icp as IC
from ..operators import neighbours as NB
from ..operators import transform as X
from ..operators.select import finite, visible
from ..session import cut
from ..sources import photos as PH
from ..sources.points import read_points, write_cloud
from ..sources.texts import read_model, stage

# Fixed value: grey of points no thermal camera sees.
UNSEEN = 0.12


def load_cloud(spark: SparkSession, work: str, cloud: str, topic: str | None = None, voxel: float = 0.05) -> DataFrame:
    def build() -> DataFrame:
        return finite(read_points(spark, cloud, topic, voxel, ["point_id", "x", "y", "z"])).select("point_id", "x", "y", "z")

    return stage(spark, work, "cloud", build)


def load_cameras(spark: SparkSession, work: str, model_dir: str) -> tuple[DataFrame, DataFrame]:
    cams = stage(spark, work, "cameras", lambda: read_model(spark, model_dir)[0])
    return cams, stage(spark, work, "model_points", lambda: read_model(spark, model_dir)[1])


def load_photos(spark: SparkSession, work: str, flight: str, max_width: int = 1600) -> tuple[DataFrame, DataFrame]:
    """(rasters, geotags) of the colour photos of a flight."""
    photos = PH.scan_photos(spark, flight)
    if not photos.head(1):
        raise ValueError("no photos in the flight folder")
    names = photos.select("name").distinct()

    def rasters() -> DataFrame:
        return PH.prepare_images(PH.read_images(spark, flight).join(names, "name", "left_semi"), max_width)

    def tags() -> DataFrame:
        return PH.geotags(PH.read_heads(spark, flight).join(names, "name", "left_semi"))

    return stage(spark, work, "images", rasters), stage(spark, work, "gps", tags)


def align_stage(spark: SparkSession, work: str, model: DataFrame, target: DataFrame) -> tuple[float, list[float]]:
    row = stage(spark, work, "align", lambda: AL.align_table(model, AL.auto_align(model, target))).first()
    return row["yaw"], list(row["t"])


def retune(spark: SparkSession, work: str, model: DataFrame, target: DataFrame, yaw: float, t, accept: bool = False) -> DataFrame:
    """Quality of a hand-set turn and shift; ``accept`` makes it the stored alignment."""
    q = G.dsm_quality(model, target, yaw, t)
    if accept:
        r = q.first()
        table = AL.align_table(model, {"yaw": yaw, "t": t, "inliers": 0.0, "share": r["share"], "median": r["median"]})
        table.write.mode("overwrite").parquet(f"{work}/align")
    return q


def recolour(points: DataFrame, cameras: DataFrame, images: DataFrame, affine, max_radius: float = 0.0) -> DataFrame:
    """Colours from a stored model-to-cloud affine."""
    return C.sample_images(C.best_camera(points, cameras, affine, max_radius), images)


def by_camera(rasters: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rasters keyed by the camera of the same name."""
    return rasters.join(cameras.select("cam_id", "name"), "name").select("cam_id", "height", "width", "n_channels", "data")


def colorize(spark: SparkSession, cloud: str, flight: str, out: str, work: str, model_dir: str, topic: str | None = None,
             voxel: float = 0.05, max_width: int = 1600, single: bool = False) -> DataFrame:
    """Cloud + photo flight + reconstruction -> coloured cloud; returns the coverage."""
    points = load_cloud(spark, work, cloud, topic, voxel)
    images, tags = load_photos(spark, work, flight, max_width)
    cams, model_points = load_cameras(spark, work, model_dir)
    geo = T.georeference(cams, tags)
    model = stage(spark, work, "model_enu", lambda: X.robust_subset(
        T.apply_geo(model_points.withColumnRenamed("pid", "point_id"), geo), T.move_cameras(cams, geo)))
    yaw, t = align_stage(spark, work, model, points)
    affine = X.chain_affine(yaw, t, geo["s"], geo["r"], geo["t"])
    spark.createDataFrame([(json.dumps({"A": affine[0].tolist(), "b": affine[1].tolist()}),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{work}/affine")
    hits = C.best_camera(points, cams, affine)
    coloured = stage(spark, work, "coloured", lambda: C.sample_images(hits, by_camera(images, cams)))
    write_cloud(coloured, out, "ply", single, mode="overwrite")
    return C.coverage(coloured)


def thermal(points: DataFrame, cameras: DataFrame, thermal_photos: DataFrame, images: DataFrame, affine, name: str | None = None,
            width: int = 1280, height: int = 1024, hfov: float = 38.2) -> DataFrame:
    """Colours from the thermal photos paired by sequence number, optionally through a palette.

    ``thermal_photos``: name, ord; ``images``: thermal rasters keyed by cam_id.
    """
    cams = C.with_optics(C.pair_by_sequence(cameras, thermal_photos), width, height, hfov)
    seen = C.sample_images(C.best_camera(points, cams, affine), images)
    seen = seen if name is None else cut(seen)      # the percentile passes read it again
    grey = to_byte(F.lit(UNSEEN))
    hit = F.col("cam_id").isNotNull()
    if name is None:
        return seen.withColumns({c: F.when(hit, F.col(c)).otherwise(grey) for c in ("red", "green", "blue")})
    lum = seen.withColumn("lum", F.when(hit, white_hot(*[F.col(c) / 255.0 for c in ("red", "green", "blue")])))
    return _through(G.robust_normalize(lum, "lum"), hit, name).drop("lum", "norm")


def _through(df: DataFrame, hit: Column, name: str) -> DataFrame:
    rgb = [F.when(hit, to_byte(c)).otherwise(to_byte(F.lit(UNSEEN))) for c in palette(F.col("norm"), name)]
    return df.withColumns(dict(zip(("red", "green", "blue"), rgb)))


def temperature(points: DataFrame, cameras: DataFrame, thermal_photos: DataFrame, rasters: DataFrame, affine, width: int = 640,
                height: int = 512, hfov: float = 38.2) -> tuple[DataFrame, DataFrame]:
    """(cloud with temp and iron colours, statistics). Temperatures are null where no camera sees a point."""
    cams = C.with_optics(C.pair_by_sequence(cameras, thermal_photos), width, height, hfov)
    cams = cams.join(rasters.select("cam_id"), "cam_id", "left_semi")
    seen = cut(C.sample_values(C.best_camera(points, cams, affine), rasters))
    norm = G.robust_normalize(seen, "temp")
    return _through(norm, F.col("temp").isNotNull(), "iron").drop("norm"), C.temperature_stats(seen)


def merge(points: DataFrame, slots: DataFrame, log: DataFrame | None = None, transforms: DataFrame | None = None) -> DataFrame:
    """Partial maps into one: optional pose per cloud, merge of the visible ones, replay of an edit log.

    point_id of the result is dense in slot order.
    """
    placed = points if transforms is None else X.apply_transforms(points, transforms, "cloud_id")
    merged = X.rerank(E.merge_clouds(placed, slots).withColumnRenamed("point_id", "part_id"), ["slot", "part_id"])
    return merged if log is None else E.replay(merged, E.read_log(log))


def align_maps(points: DataFrame, slots: DataFrame, align=IC.align_icp) -> DataFrame:
    """cloud_id and affine (a, b) of every visible cloud, placed on the one in the first slot.

    ``align(source, target)`` is a registration that returns a fit; slots are the few rows of an editor."""
    shown = [r["cloud_id"] for r in slots.where("visible").orderBy("slot").select("cloud_id").collect()]
    if not shown:
        raise ValueError("no visible slot")
    first = points.where(F.col("cloud_id") == shown[0])
    rows = [(shown[0], np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0])]
    for cloud in shown[1:]:
        fit = align(points.where(F.col("cloud_id") == cloud), first)
        m = (fit[1] if isinstance(fit, tuple) else fit).matrix
        rows.append((cloud, m[:3, :3].ravel().tolist(), m[:3, 3].tolist()))
    return points.sparkSession.createDataFrame(rows, "cloud_id int, a array<double>, b array<double>")


def merge_maps(points: DataFrame, slots: DataFrame, out: str, log: DataFrame | None = None, align=IC.align_icp, kind: str = "pcd",
               single: bool = False) -> DataFrame:
    """Align the visible maps on the first, merge them, replay the edit log and write the cloud; returns what was written."""
    merged = merge(points, slots, log, align_maps(points, slots, align))
    kept = merged.where(visible(merged)) if "visible" in merged.columns else merged
    write_cloud(kept, out, kind, single, mode="overwrite")
    return kept


def manual_alignment(source: DataFrame, target: DataFrame, picks: DataFrame, radius: float = 1.0, refine: bool = True,
                     crop: tuple[float, float] = (0.01, 0.99), default=C.FALLBACK) -> tuple[DataFrame, tuple[float, np.ndarray]]:
    """Similarity from picked pairs, optionally refined, and the target in the source's colours.

    ``source`` carries red, green, blue. The moved source is cropped to the bulk of its points before the refinement,
    which runs on clouds thinned to a voxel of the target's size and changes the pose, not the scale. Returns
    the coloured target, and scale and 4x4 pose: a source point p goes to pose @ (scale * p).
    """
    s, r, t = T.fit_similarity(picks)
    pose = join4(r, t)
    if refine:
        scaled = source.select("point_id", *[(F.col(c) * F.lit(s)).alias(c) for c in "xyz"])
        voxel = max(0.02, IC._diagonal(target) / 250.0)
        bulk = IC.thinned(X.percentile_crop(scaled, *crop), voxel)
        near = IC.normals(IC.cut(IC.thinned(target, voxel)), voxel * 2.0)
        pose = IC.icp(bulk, near, [voxel * k for k in (6.0, 3.0, 1.5)], [pose], "plane", 80)[0].matrix
    moved = X.apply_matrix(source.withColumns({c: F.col(c) * F.lit(s) for c in "xyz"}), pose)
    return NB.nn_transfer(target, moved, ("red", "green", "blue"), default, radius), (s, pose)


def quality(points: DataFrame, cameras: DataFrame, images: DataFrame, affine=None, n: int | None = None, seed: int = 0) -> DataFrame:
    """Alignment report: colour consistency of all points, or of a fixed sample of ``n``, over all cameras that see them."""
    sample = points if n is None else X.fixed_sample(points, n, seed)
    return C.consistency_summary(C.color_consistency(sample, cameras, images, affine), sample)


def profile(points: DataFrame) -> DataFrame:
    """What the viewer shows about a cloud: counts, bounds, view radius, height stretch."""
    lo, hi = G.floor_percentile(points, "z")
    return G.cloud_profile(points).withColumns({"view_radius": F.lit(G.view_radius(points)), "z_lo": F.lit(lo), "z_hi": F.lit(hi)})


def place(yaw_deg: float, t) -> tuple[np.ndarray, np.ndarray]:
    """Turn and shift as an affine."""
    return rot_z(math.radians(yaw_deg)), np.asarray(t, float)
