"""Selections, transforms, samples and crops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import linear as la
from ..operators import select as S
from ..operators import transform as X
from . import inputs as I
from .registry import query, r6, s6

P = I.with_sql("fx_points")
CAM = I.with_sql("fx_cameras")

# an eye 120 m above the origin looking straight down, near 1 m, far 500 m
WIDTH, HEIGHT = 800, 600
DEPTH_A, DEPTH_B = 501.0 / 499.0, -1000.0 / 499.0
MVP = [1.2, 0.0, 0.0, 0.0,
       0.0, 1.6, 0.0, 0.0,
       0.0, 0.0, -DEPTH_A, DEPTH_A * 120.0 + DEPTH_B,
       0.0, 0.0, -1.0, 120.0]
SCREEN = (f"{P}, screen AS (SELECT *, (1.2e0 * x / (120e0 - z) * 5e-1 + 5e-1) * 8e2 AS sx, "
          f"(1.6e0 * y / (120e0 - z) * 5e-1 + 5e-1) * 6e2 AS sy, "
          f"({-DEPTH_A!r}::DOUBLE * z + {MVP[11]!r}::DOUBLE) / (120e0 - z) AS depth FROM fx_points)")
HEX = [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (0.0, 0.0), (-50.0, 50.0), (-60.0, 0.0)]
TRI = [(10.0, 10.0), (90.0, 20.0), (30.0, 80.0)]


def edge_sql(x: str, y: str, poly) -> str:
    """Even-odd rule as a count of crossed edges."""
    parts = []
    for (xi, yi), (xj, yj) in zip(poly, [poly[-1], *poly[:-1]]):
        den = yj - yi if abs(yj - yi) > 1e-12 else 1e-12
        parts.append(f"CASE WHEN (({yi!r}::DOUBLE > {y}) <> ({yj!r}::DOUBLE > {y})) AND "
                     f"{x} < ({xj - xi!r}::DOUBLE) * ({y} - ({yi!r}::DOUBLE)) / ({den!r}::DOUBLE) + ({xi!r}::DOUBLE) THEN 1 ELSE 0 END")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def screen(spark, sf):
    return S.to_screen(I.points(spark, sf), MVP, WIDTH, HEIGHT)


def marked(df):
    return df.select("point_id", "selected")


@query("finite_filter", f"{P} SELECT point_id, {s6('x','x')}, {s6('sqrt(abs(z))','z')} FROM fx_points "
       "WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark, sf):
    return S.finite(I.points(spark, sf)).select("point_id", r6("x"), r6(F.sqrt(F.abs("z")), "z"))


@query("finite_filter_with_gaps", f"{P} SELECT point_id FROM fx_points WHERE intensity IS NOT NULL AND intensity <> 0")
def finite_filter_with_gaps(spark, sf):
    # the reciprocal is infinite at 0 and missing where intensity is; both kinds of row must go
    p = I.points(spark, sf)
    inv = F.when(F.col("intensity") == 0, F.lit(float("inf"))).otherwise(F.coalesce(1 / F.col("intensity"), F.lit(float("nan"))))
    return S.finite(p.withColumn("z", inv)).select("point_id")


@query("z_slice", f"{P} SELECT point_id, z BETWEEN 1 AND 4 AS visible, z BETWEEN 1 AND 4 AND x > 0 AS selected FROM fx_points")
def z_slice(spark, sf):
    df = I.points(spark, sf).withColumn("selected", F.col("x") > 0)
    return S.z_slice(df, 1.0, 4.0).select("point_id", "visible", "selected")


@query("z_slice_normalised",
       f"{P}, b AS (SELECT min(z) lo, max(z) hi FROM fx_points), p AS (SELECT lo - greatest(1e-3, (hi - lo) * 1e-4) lo, "
       "hi + greatest(1e-3, (hi - lo) * 1e-4) hi FROM b) "
       "SELECT point_id, z BETWEEN lo + 5e-2 * (hi - lo) AND lo + 3e-1 * (hi - lo) AS visible FROM fx_points, p")
def z_slice_normalised(spark, sf):
    return S.z_slice_norm(I.points(spark, sf), 0.05, 0.3).select("point_id", "visible")


@query("height_cut", f"{P}, b AS (SELECT min(z) lo, max(z) - min(z) span FROM fx_points) "
       "SELECT point_id FROM fx_points, b WHERE z >= lo + 1e-1 * span AND z <= lo + 6e-1 * span")
def height_cut(spark, sf):
    return S.height_cut(I.points(spark, sf), 0.1, 0.6).select("point_id")


@query("to_screen", f"{SCREEN} SELECT point_id, {s6('sx','sx')}, {s6('sy','sy')}, {s6('depth','depth')} FROM screen")
def to_screen(spark, sf):
    return screen(spark, sf).select("point_id", r6("sx"), r6("sy"), r6("depth"))


@query("select_box", f"{SCREEN} SELECT point_id, sx BETWEEN 250 AND 520.5 AND sy BETWEEN 100.25 AND 400 AND depth BETWEEN -1 AND 1 "
       "AS selected FROM screen")
def select_box(spark, sf):
    return marked(S.select_box(screen(spark, sf), 250.0, 100.25, 520.5, 400.0))


LASSO = [(200.0, 150.0), (600.0, 120.0), (640.0, 420.0), (410.0, 260.0), (220.0, 480.0)]


@query("select_lasso", f"{SCREEN} SELECT point_id, {edge_sql('sx', 'sy', LASSO)} AND depth BETWEEN -1 AND 1 AS selected FROM screen")
def select_lasso(spark, sf):
    return marked(S.select_lasso(screen(spark, sf), LASSO))


@query("select_prism", f"{P} SELECT point_id, z BETWEEN 5e-1 AND 5e-1 + 3 AND "
       f"{edge_sql('x', 'y', [(a + 3, b - 2) for a, b in HEX])} AS selected FROM fx_points")
def select_prism(spark, sf):
    return marked(S.select_prism(I.points(spark, sf), HEX, 0.0, 3.0, (3.0, -2.0, 0.5)))


@query("points_in_polygon", f"{P} SELECT point_id, {edge_sql('x', 'y', HEX)} AS inside FROM fx_points")
def points_in_polygon(spark, sf):
    return I.points(spark, sf).select("point_id", S.in_polygon(F.col("x"), F.col("y"), HEX).alias("inside"))


@query("points_in_polygons", f"{P} SELECT point_id, CAST(0 AS INT) AS poly_id FROM fx_points WHERE {edge_sql('x', 'y', HEX)} "
       f"UNION ALL SELECT point_id, CAST(1 AS INT) AS poly_id FROM fx_points WHERE {edge_sql('x', 'y', TRI)}")
def points_in_polygons(spark, sf):
    rows = [(k, i, x, y) for k, poly in enumerate((HEX, TRI)) for i, (x, y) in enumerate(poly)]
    edges = spark.createDataFrame(rows, "poly_id int, seq int, px double, py double")
    return S.in_polygons(I.points(spark, sf), edges).select("point_id", "poly_id")


@query("select_sphere", f"{P} SELECT point_id, (x - 10) * (x - 10) + (y + 20) * (y + 20) + (z - 2) * (z - 2) <= 900 AS selected FROM fx_points")
def select_sphere(spark, sf):
    return marked(S.select_sphere(I.points(spark, sf), (10.0, -20.0, 2.0), 30.0))


@query("select_spheres", f"{I.with_sql('fx_points', 'fx_cameras')} SELECT point_id, EXISTS (SELECT 1 FROM fx_cameras c WHERE "
       "(x - c_x) * (x - c_x) + (y - c_y) * (y - c_y) + (z - 0) * (z - 0) <= 36) AS selected FROM fx_points")
def select_spheres(spark, sf):
    centers = I.derived(spark, sf, "fx_cameras").select(F.col("c_x").alias("x"), F.col("c_y").alias("y"), F.lit(0.0).alias("z"))
    return marked(S.select_spheres(I.points(spark, sf), centers, 6.0))


# screen picks derived from the cameras' ground positions, plus the corners that hit nothing
PICKS = "picks AS (SELECT cam_id AS pick_id, 4e2 + c_x * 3e0 AS px, 3e2 + c_y * 2e0 AS py FROM fx_cameras)"


def picks(spark, sf):
    return I.derived(spark, sf, "fx_cameras").select(
        F.col("cam_id").alias("pick_id"), (F.lit(400.0) + F.col("c_x") * 3.0).alias("sx"),
        (F.lit(300.0) + F.col("c_y") * 2.0).alias("sy"))


PICK_SQL = f"{SCREEN}, {I.with_sql('fx_cameras')[5:]}, {PICKS}"


@query("pick_nearest_pixel",
       f"{PICK_SQL}, d AS (SELECT pick_id, point_id, (sx - px) * (sx - px) + (sy - py) * (sy - py) AS d2 FROM screen, picks "
       "WHERE depth BETWEEN -1 AND 1) SELECT pick_id, point_id, round(d2, 6) + 0e0 AS d2 FROM d WHERE d2 <= 100 "
       "QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY d.d2, point_id) = 1")
def pick_nearest_pixel(spark, sf):
    return S.pick_nearest_px(screen(spark, sf), picks(spark, sf)).select("pick_id", "point_id", r6("d2"))


@query("pick_front_most",
       f"{PICK_SQL}, d AS (SELECT pick_id, point_id, 120e0 - z AS w, (sx - px) * (sx - px) + (sy - py) * (sy - py) AS d2 "
       "FROM screen, picks) SELECT pick_id, point_id, round(w, 6) + 0e0 AS w FROM d WHERE d2 <= 256 AND w > 0 "
       "QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY d.w, point_id) = 1")
def pick_front_most(spark, sf):
    return S.pick_front(screen(spark, sf), picks(spark, sf), MVP).select("pick_id", "point_id", r6("score", "w"))


@query("selection_algebra",
       f"{P} SELECT point_id, (z <= 3) AND NOT (x > 0 AND z <= 3) AS inverted, z <= 3 AS all_visible, false AS cleared FROM fx_points")
def selection_algebra(spark, sf):
    df = S.z_slice(I.points(spark, sf).withColumn("selected", F.col("x") > 0), -1.0, 3.0)
    df = df.withColumn("before", F.col("selected"))
    inv = S.invert(df).withColumnRenamed("selected", "inverted")
    everything = S.select_all(inv.withColumn("selected", F.col("before"))).withColumnRenamed("selected", "all_visible")
    return S.clear(everything.withColumn("selected", F.col("before"))).select(
        "point_id", "inverted", "all_visible", F.col("selected").alias("cleared"))


@query("delete_selected", f"{P} SELECT point_id, intensity, false AS selected FROM fx_points WHERE NOT (x > 0 AND y > 0)")
def delete_selected(spark, sf):
    df = I.points(spark, sf).withColumn("selected", (F.col("x") > 0) & (F.col("y") > 0))
    return S.delete_selected(df).select("point_id", "intensity", "selected")


@query("percentile_crop",
       f"{P}, q AS (SELECT quantile_cont(x, 1e-2) xl, quantile_cont(x, 99e-2) xh, quantile_cont(y, 1e-2) yl, quantile_cont(y, 99e-2) yh, "
       "quantile_cont(z, 1e-2) zl, quantile_cont(z, 99e-2) zh FROM fx_points) SELECT point_id FROM fx_points, q "
       "WHERE x BETWEEN xl AND xh AND y BETWEEN yl AND yh AND z BETWEEN zl AND zh")
def percentile_crop(spark, sf):
    return X.percentile_crop(I.points(spark, sf)).select("point_id")


@query("robust_subset",
       f"{I.with_sql('fx_points', 'fx_cameras')}, q AS (SELECT quantile_cont(x, 1e-2) xl, quantile_cont(x, 99e-2) xh, "
       "quantile_cont(y, 1e-2) yl, quantile_cont(y, 99e-2) yh, quantile_cont(z, 1e-2) zl, quantile_cont(z, 99e-2) zh FROM fx_points), "
       "m AS (SELECT quantile_cont(c_x, 5e-1) mx, quantile_cont(c_y, 5e-1) my FROM fx_cameras), "
       "f AS (SELECT max(sqrt((c_x - mx) * (c_x - mx) + (c_y - my) * (c_y - my))) - 60 AS far FROM fx_cameras, m) "
       "SELECT point_id FROM fx_points, q, m, f WHERE x BETWEEN xl AND xh AND y BETWEEN yl AND yh AND z BETWEEN zl AND zh "
       "AND sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) < far")
def robust_subset(spark, sf):
    # a margin inside the flight, so that the distance test bites
    return X.robust_subset(I.points(spark, sf), I.cameras(spark, sf), margin=-60.0).select("point_id")


MED = ("m AS (SELECT quantile_cont(c_x, 5e-1) mx, quantile_cont(c_y, 5e-1) my, quantile_cont(c_z, 5e-1) mz FROM fx_cameras), "
       "d AS (SELECT *, sqrt((c_x - mx) * (c_x - mx) + (c_y - my) * (c_y - my) + (c_z - mz) * (c_z - mz)) AS dist FROM fx_cameras, m)")


@query("camera_outliers", f"{CAM}, {MED} SELECT cam_id, {s6('dist', 'dist')} FROM d "
       "WHERE dist < (SELECT quantile_cont(dist, 5e-1) * 13e-1 FROM d)")
def camera_outliers(spark, sf):
    # tighter than the default rule (0.95 and 4), so that some cameras do go
    return X.drop_outlier_cameras(I.cameras(spark, sf), 0.5, 1.3).select("cam_id", r6("dist"))


@query("scene_scale", f"{CAM}, {MED} SELECT {s6('quantile_cont(dist, 9e-1) * 11e-1', 'scale')} FROM d")
def scene_scale(spark, sf):
    v = X.scene_scale(I.cameras(spark, sf))
    return I.cameras(spark, sf).agg(r6(F.max(F.lit(v)), "scale"))


@query("clean_splats",
       f"{I.with_sql('fx_splats', 'fx_cameras')}, {MED}, r AS (SELECT greatest(12 * quantile_cont(dist, 9e-1), 70) AS far FROM d) "
       "SELECT point_id FROM fx_splats, m, r WHERE sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)) < far "
       "AND 1 / (1 + exp(-opacity)) > 8e-2 AND greatest(exp(scale_0), exp(scale_1), exp(scale_2)) < 3")
def clean_splats(spark, sf):
    return X.clean_splats(I.derived(spark, sf, "fx_splats"), I.cameras(spark, sf)).select("point_id")


@query("stride_sample", f"{P}, n AS (SELECT count(*) // 3000 + 1 AS k, count(*) AS c FROM fx_points) SELECT point_id FROM fx_points, n "
       "WHERE CASE WHEN c > 3000 THEN point_id % k = 0 ELSE true END")
def stride_sample(spark, sf):
    return X.stride_sample(I.points(spark, sf), 3000).select("point_id")


@query("fixed_sample", f"{P} SELECT point_id, {s6('x', 'x')}, {s6('y', 'y')}, {s6('z', 'z')} FROM fx_points ORDER BY md5('7/' || point_id), point_id LIMIT 500")
def fixed_sample(spark, sf):
    return X.fixed_sample(I.points(spark, sf), 500, 7).select("point_id", r6("x"), r6("y"), r6("z"))


@query("dense_ordinal", f"{P} SELECT point_id, row_number() OVER (ORDER BY z, point_id) - 1 AS ordinal FROM fx_points")
def dense_ordinal(spark, sf):
    return X.rerank(I.points(spark, sf), ["z", "point_id"], "ordinal").select("point_id", "ordinal")


A = [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 2.0]]
B = [12.0, -7.0, 1.5]


@query("affine_apply", f"{P} SELECT point_id, {s6('6e-1 * x - 8e-1 * y + 12', 'x')}, {s6('8e-1 * x + 6e-1 * y - 7', 'y')}, "
       f"{s6('2 * z + 15e-1', 'z')} FROM fx_points")
def affine_apply(spark, sf):
    return X.apply_affine(I.points(spark, sf), A, B).select("point_id", r6("x"), r6("y"), r6("z"))


@query("affine_inverse", f"{P} SELECT point_id, {s6('6e-1 * (x - 12) + 8e-1 * (y + 7)', 'x')}, "
       f"{s6('-8e-1 * (x - 12) + 6e-1 * (y + 7)', 'y')}, {s6('(z - 15e-1) / 2', 'z')} FROM fx_points")
def affine_inverse(spark, sf):
    return X.apply_affine(I.points(spark, sf), A, B, inverse=True).select("point_id", r6("x"), r6("y"), r6("z"))


@query("similarity_apply", f"{P} SELECT point_id, {s6('18 * (6e-1 * x - 8e-1 * y) + 10', 'x')}, "
       f"{s6('18 * (8e-1 * x + 6e-1 * y) - 5', 'y')}, {s6('18 * z + 2', 'z')} FROM fx_points")
def similarity_apply(spark, sf):
    r = [[0.6, -0.8, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0]]
    return X.apply_similarity(I.points(spark, sf), 18.0, r, [10.0, -5.0, 2.0]).select("point_id", r6("x"), r6("y"), r6("z"))


@query("rigid_euler", f"{P}, r AS (SELECT point_id, x, cos(radians(30)) * y - sin(radians(30)) * z AS y, sin(radians(30)) * y + cos(radians(30)) * z AS z "
       "FROM fx_points), s AS (SELECT point_id, cos(radians(20)) * x + sin(radians(20)) * z AS x, y, -sin(radians(20)) * x + cos(radians(20)) * z AS z FROM r) "
       f"SELECT point_id, {s6('cos(radians(40)) * x - sin(radians(40)) * y + 1', 'x')}, {s6('sin(radians(40)) * x + cos(radians(40)) * y + 2', 'y')}, "
       f"{s6('z + 3', 'z')} FROM s")
def rigid_euler(spark, sf):
    return X.rigid_euler(I.points(spark, sf), [1.0, 2.0, 3.0], [30.0, 20.0, 40.0]).select("point_id", r6("x"), r6("y"), r6("z"))


@query("yaw_about_centroid",
       f"{P}, s AS (SELECT * FROM fx_points WHERE cloud_id = 0), a AS (SELECT avg(x) ax, avg(y) ay, avg(z) az FROM s), "
       "t AS (SELECT avg(x) bx, avg(y) by_, avg(z) bz FROM fx_points WHERE cloud_id <> 0) "
       f"SELECT point_id, {s6('-(y - ay) + bx', 'x')}, {s6('(x - ax) + by_', 'y')}, {s6('z - az + bz', 'z')} FROM s, a, t")
def yaw_about_centroid(spark, sf):
    p = I.points(spark, sf)
    src, tgt = p.where("cloud_id = 0"), p.where("cloud_id <> 0")
    return X.apply_matrix(src, X.yaw_about_centroid(src, tgt, 90.0)).select("point_id", r6("x"), r6("y"), r6("z"))


POSES = [(0, 1.0, 0.0, 0.0, 0.0, 0.0), (1, 0.8, 0.6, 1.0, 2.0, 0.0), (2, 0.6, 0.8, 0.0, 0.0, 1.0)]


@query("pose_to_transform",
       f"{P}, poses(cloud_id, qw, qz, px, py, pz) AS (VALUES " + ", ".join(f"({p[0]}, {', '.join(f'{v}::DOUBLE' for v in p[1:])})" for p in POSES) +
       "), m AS (SELECT cloud_id, avg(x) cx, avg(y) cy, avg(z) cz FROM fx_points GROUP BY cloud_id), "
       "j AS (SELECT *, 2 * (qw * qw - qz * qz) AS c2, 2 * 2 * qw * qz AS s2 FROM poses JOIN m USING (cloud_id)) "
       f"SELECT CAST(cloud_id AS INT) AS cloud_id, {s6('c2', 'a00')}, {s6('-s2', 'a01')}, {s6('px - (c2 * cx - s2 * cy)', 'b0')}, "
       f"{s6('py - (s2 * cx + c2 * cy)', 'b1')}, {s6('pz - 2 * cz', 'b2')} FROM j")
def pose_to_transform(spark, sf):
    poses = spark.createDataFrame([(p[0], [p[1], 0.0, 0.0, p[2]], list(p[3:])) for p in POSES],
                                  "cloud_id int, q array<double>, p array<double>")
    t = X.pose_to_transform(I.points(spark, sf), poses, 2.0)
    return t.select("cloud_id", r6(F.col("a")[0], "a00"), r6(F.col("a")[1], "a01"),
                    *[r6(F.col("b")[i], f"b{i}") for i in range(3)])


@query("apply_pose_table",
       f"{P} SELECT point_id, {s6('CASE cloud_id WHEN 0 THEN x WHEN 1 THEN 6e-1 * x - 8e-1 * y + 1 ELSE -y END', 'x')}, "
       f"{s6('CASE cloud_id WHEN 0 THEN y WHEN 1 THEN 8e-1 * x + 6e-1 * y + 2 ELSE x END', 'y')} FROM fx_points")
def apply_pose_table(spark, sf):
    rows = [(0, list(np.eye(3).ravel()), [0.0, 0.0, 0.0]),
            (1, [0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 0.0]),
            (2, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0])]
    rows = [(k, [float(v) for v in a], b) for k, a, b in rows]
    t = spark.createDataFrame(rows, "cloud_id int, a array<double>, b array<double>")
    return X.apply_transforms(I.points(spark, sf), F.broadcast(t), "cloud_id").select("point_id", r6("x"), r6("y"))


@query("transform_compose",
       f"{CAM} SELECT cam_id, {s6('cosv * 6e-1 + sinv * 8e-1', 'a00')}, {s6('cosv * -8e-1 + sinv * 6e-1', 'a01')}, "
       f"{s6('cosv * c_x + sinv * c_y + 1', 'b0')}, {s6('sinv * c_x - cosv * c_y + 2', 'b1')}, {s6('-c_z + 3', 'b2')} FROM fx_cameras")
def transform_compose(spark, sf):
    c = I.cameras(spark, sf)
    left = c.select("cam_id", F.col("r").alias("a"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("b"))
    turn = F.array(*[F.lit(v) for v in (0.6, -0.8, 0.0, 0.8, 0.6, 0.0, 0.0, 0.0, 1.0)])
    right = c.select("cam_id", turn.alias("a"), F.array("c.x", "c.y", "c.z").alias("b"))
    t = X.compose(left, right, "cam_id")
    return t.select("cam_id", r6(F.col("a")[0], "a00"), r6(F.col("a")[1], "a01"), *[r6(F.col("b")[i], f"b{i}") for i in range(3)])


@query("chain_affine", f"{P} SELECT point_id, {s6('6e-1 * (2 * x + 1) - 8e-1 * (2 * y + 2) + 4', 'x')}, "
       f"{s6('8e-1 * (2 * x + 1) + 6e-1 * (2 * y + 2) + 5', 'y')}, {s6('2 * z + 3 + 6', 'z')} FROM fx_points")
def chain_affine(spark, sf):
    a, b = X.chain_affine(math.atan2(0.8, 0.6), [4.0, 5.0, 6.0], 2.0, np.eye(3), [1.0, 2.0, 3.0])
    return X.apply_affine(I.points(spark, sf), a, b).select("point_id", r6("x"), r6("y"), r6("z"))


@query("to_enu", f"{I.with_sql('fx_geotags')}, o AS (SELECT avg(lat) lat0, avg(lon) lon0 FROM fx_geotags) "
       "SELECT name, round(radians(lon - lon0) * cos(radians(lat0)) * 6378137e0, 4) + 0e0 AS east, "
       "round(radians(lat - lat0) * 6378137e0, 4) + 0e0 AS north, rel_alt AS up FROM fx_geotags, o")
def to_enu(spark, sf):
    g = X.to_enu_about_mean(I.derived(spark, sf, "fx_geotags"))
    return g.select("name", F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), "up")


@query("rotation_to_quaternion", f"{CAM} SELECT cam_id, "
       "0e0 AS qw_abs, round(sqrt((1 + cosv) / 2), 6) + 0e0 AS qx_abs, round(abs(sinv) / sqrt(2 * (1 + cosv)), 6) + 0e0 AS qy_abs, 0e0 AS qz_abs FROM fx_cameras")
def rotation_to_quaternion(spark, sf):
    q = I.cameras(spark, sf).select("cam_id", X.mat_to_quat(F.col("r")).alias("q"))
    return q.select("cam_id", *[r6(F.abs(F.col("q")[i]), f"q{n}_abs") for i, n in enumerate("wxyz")])


@query("quaternion_product", f"{P} SELECT point_id, {s6('5e-1 * x - 1e-1 * y - 2e-1 * z - 3e-1 * 1', 'w')}, "
       f"{s6('5e-1 * y + 1e-1 * x + 2e-1 * 1 - 3e-1 * z', 'i')}, {s6('5e-1 * z - 1e-1 * 1 + 2e-1 * x + 3e-1 * y', 'j')}, "
       f"{s6('5e-1 * 1 + 1e-1 * z - 2e-1 * y + 3e-1 * x', 'k')} FROM fx_points")
def quaternion_product(spark, sf):
    a = F.array(*[F.lit(v) for v in (0.5, 0.1, 0.2, 0.3)])
    b = F.array("x", "y", "z", F.lit(1.0))
    q = I.points(spark, sf).select("point_id", X.quat_mul(a, b).alias("q"))
    return q.select("point_id", *[r6(F.col("q")[i], n) for i, n in enumerate("wijk")])


@query("center", f"{P}, c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM fx_points) "
       f"SELECT point_id, {s6('x - cx', 'x')}, {s6('y - cy', 'y')}, {s6('z - cz', 'z')} FROM fx_points, c")
def center(spark, sf):
    return X.center(I.points(spark, sf)).select("point_id", r6("x"), r6("y"), r6("z"))


@query("measure", f"{P}, m AS (SELECT point_id, y - x AS dx, z - y AS dy, x - z AS dz FROM fx_points), "
       "d AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM m) "
       f"SELECT point_id, {s6('dist', 'distance')}, {s6('sqrt(greatest(0, dist * dist - dz * dz))', 'horizontal')}, {s6('abs(dz)', 'rise')}, "
       f"{s6('dx', 'dx')}, {s6('dy', 'dy')}, {s6('dz', 'dz')} FROM d")
def measure(spark, sf):
    pairs = I.points(spark, sf).select("point_id", *[F.col(c).alias("a" + c) for c in "xyz"], F.col("y").alias("bx"),
                                       F.col("z").alias("by"), F.col("x").alias("bz"))
    return X.measure(pairs).select("point_id", *[r6(c) for c in ("distance", "horizontal", "rise", "dx", "dy", "dz")])


@query("point_grids", f"{P}, c AS (SELECT * FROM fx_points), i AS (SELECT unnest(range(5)) AS i) "
       f"SELECT point_id AS center_id, CAST(u.i AS INT) AS iu, CAST(v.i AS INT) AS iv, {s6('u.i * 5e-1 - 1 + x', 'x')}, {s6('v.i * 5e-1 - 1 + y', 'y')} "
       "FROM c, i u, i v")
def point_grids(spark, sf):
    g = X.grids_at(I.points(spark, sf), 2.0, 0.5)
    return g.select("center_id", "iu", "iv", r6("x"), r6("y"))


@query("pixel_to_plane", f"{SCREEN} SELECT point_id, {s6('x * (120 - 2) / (120 - z)', 'gx')}, {s6('y * (120 - 2) / (120 - z)', 'gy')} FROM screen")
def pixel_to_plane(spark, sf):
    inverse = np.linalg.inv(np.array(MVP).reshape(4, 4))
    hit = X.pixel_to_plane(screen(spark, sf).select("point_id", "sx", "sy"), inverse, WIDTH, HEIGHT, 2.0)
    return hit.select("point_id", r6("x", "gx"), r6("y", "gy"))


@query("motion_summary",
       f"{CAM} SELECT cam_id, {s6('degrees(acos(greatest(-1, least(1, cosv))))', 'rotation_deg')}, "
       f"{s6('sqrt(c_x * c_x + c_y * c_y + c_z * c_z)', 'shift')}, CASE WHEN cam_id % 10 < 5 THEN 'low' ELSE 'ok' END AS verdict FROM fx_cameras")
def motion_summary(spark, sf):
    t = I.derived(spark, sf, "fx_cameras").select(
        "cam_id", F.array("cosv", -F.col("sinv"), F.lit(0.0), "sinv", "cosv", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"),
        F.array("c_x", "c_y", "c_z").alias("b"), ((F.col("cam_id") % 10) / 10.0).alias("fitness"))
    return X.motion_summary(t).select("cam_id", r6("rotation_deg"), r6("shift"), "verdict")
