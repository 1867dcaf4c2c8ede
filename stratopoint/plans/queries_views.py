"""Reprojection, neighbour joins, edits, rasters and fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions.linear import rot_x, rot_y, rot_z
from ..operators import colouring as C
from ..operators import edit as E
from ..operators import estimate as T
from ..operators import grid as G
from ..operators import neighbours as N
from ..operators import raster as R
from ..operators import transform as X
from . import inputs as I
from . import jobs
from .queries_grid import DSM_SQL, K, MOVED_SQL, SHIFT, SURF, YAW, interp_sql, model, pose_sql
from .queries_select import HEX, edge_sql
from .registry import query, r6, s6

PC = I.with_sql("fx_points", "fx_cameras")
# every point in every camera, by brute force
PROJ = (f"{PC}, n AS (SELECT point_id, cam_id, "
        "(cosv * x + sinv * y + 0e0 * z + (-(cosv * c_x + sinv * c_y))) / (c_z - z) AS xn, "
        "(sinv * x - cosv * y + 0e0 * z + (-(sinv * c_x - cosv * c_y))) / (c_z - z) AS yn FROM fx_points, fx_cameras WHERE c_z - z > 1e-6), "
        "p AS (SELECT *, xn * xn + yn * yn AS r2 FROM n), "
        "uv AS (SELECT point_id, cam_id, 125e0 * (xn * (1 + 1e-2 * r2)) + 80 AS u, 125e0 * (yn * (1 + 1e-2 * r2)) + 64 AS v, sqrt(r2) AS rad FROM p), "
        "seen AS (SELECT * FROM uv WHERE u >= 0 AND u < 160 AND v >= 0 AND v < 128), "
        "hit AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY rad, cam_id) = 1)")


def hits(spark, sf, max_radius=0.0):
    return C.best_camera(I.points(spark, sf), I.cameras(spark, sf), None, max_radius)


@query("best_camera", f"{PROJ} SELECT point_id, cam_id, {s6('u', 'u')}, {s6('v', 'v')}, {s6('rad', 'rad')} FROM fx_points LEFT JOIN hit USING (point_id)")
def best_camera(spark, sf):
    return hits(spark, sf).select("point_id", "cam_id", r6("u"), r6("v"), r6("rad"))


@query("best_camera_within_radius",
       f"{PROJ}, near AS (SELECT * FROM hit WHERE rad < 12e-2) SELECT point_id, cam_id, {s6('rad', 'rad')} FROM fx_points LEFT JOIN near USING (point_id)")
def best_camera_within_radius(spark, sf):
    return hits(spark, sf, 0.12).select("point_id", "cam_id", r6("rad"))


@query("all_views", f"{PROJ} SELECT point_id, cam_id, {s6('u', 'u')}, {s6('v', 'v')} FROM seen")
def all_views(spark, sf):
    return C.seen_by(I.points(spark, sf), I.cameras(spark, sf)).select("point_id", "cam_id", r6("u"), r6("v"))


@query("colour_coverage", f"{PROJ} SELECT count(*) AS n_points, count(cam_id) AS n_hit, {s6('count(cam_id) / CAST(count(*) AS DOUBLE)', 'coverage')} "
       "FROM fx_points LEFT JOIN hit USING (point_id)")
def colour_coverage(spark, sf):
    return C.coverage(hits(spark, sf)).select("n_points", "n_hit", r6("coverage"))


PIX = "CAST(floor(u) AS BIGINT) pu, CAST(floor(v) AS BIGINT) pv"


@query("sample_images",
       f"{PROJ}, near AS (SELECT *, {PIX} FROM hit WHERE rad < 12e-2) SELECT point_id, "
       "CAST(coalesce((7 * pu + 13 * pv + 31 * cam_id) % 256, 107) AS SMALLINT) AS red, "
       "CAST(coalesce((3 * pu + 5 * pv + 17 * cam_id) % 256, 107) AS SMALLINT) AS green, "
       "CAST(coalesce((pu + pv + 101 * cam_id) % 256, 107) AS SMALLINT) AS blue FROM fx_points LEFT JOIN near USING (point_id)")
def sample_images(spark, sf):
    rgb = C.sample_images(hits(spark, sf, 0.12), I.images(I.cameras(spark, sf)))
    return rgb.select("point_id", "red", "green", "blue")


TW, TH, HFOV = 128, 96, 38.2
TF = (TW / 2.0) / math.tan(math.radians(HFOV / 2.0))
THERMAL = (f"{PC}, n AS (SELECT point_id, cam_id, "
           "(cosv * x + sinv * y + 0e0 * z + (-(cosv * c_x + sinv * c_y))) / (c_z - z) AS xn, "
           "(sinv * x - cosv * y + 0e0 * z + (-(sinv * c_x - cosv * c_y))) / (c_z - z) AS yn FROM fx_points, fx_cameras "
           "WHERE c_z - z > 1e-6 AND cam_id % 5 <> 4), "
           f"uv AS (SELECT point_id, cam_id, ({TF!r})::DOUBLE * xn + 64 AS u, ({TF!r})::DOUBLE * yn + 48 AS v, sqrt(xn * xn + yn * yn) AS rad FROM n), "
           "hit AS (SELECT * FROM uv WHERE u >= 0 AND u < 128 AND v >= 0 AND v < 96 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY rad, cam_id) = 1), "
           f"temps AS (SELECT point_id, CAST(CAST(10 + ((11 * floor(u) + 17 * floor(v) + 29 * cam_id) % 400) / 1e1 AS FLOAT) AS DOUBLE) AS temp FROM hit)")


def thermal_cameras(spark, sf):
    """Cameras with a thermal partner photo (every fifth has none), with thermal optics."""
    c = I.cameras(spark, sf)
    others = c.where("cam_id % 5 <> 4").select(F.regexp_replace("name", "_V", "_T").alias("name"), F.lit(0).alias("ord"))
    return C.with_optics(C.pair_by_sequence(c, others), TW, TH, HFOV)


def temperatures(spark, sf):
    c = thermal_cameras(spark, sf)
    return C.sample_values(C.best_camera(I.points(spark, sf), c), I.thermal(c))


@query("pair_by_sequence", f"{I.with_sql('fx_cameras')} SELECT CAST(cam_id AS BIGINT) AS cam_id, replace(name, '_V', '_T') AS pair_name FROM fx_cameras WHERE cam_id % 5 <> 4")
def pair_by_sequence(spark, sf):
    c = I.cameras(spark, sf)
    t = c.where("cam_id % 5 <> 4").select(F.regexp_replace("name", "_V", "_T").alias("name"), F.lit(1).alias("ord"))
    dup = t.select(F.regexp_replace("name", "DJI_2026", "OLD_2025").alias("name"), F.lit(0).alias("ord"))
    return C.pair_by_sequence(c, t.unionByName(dup)).select(F.col("cam_id").cast("long").alias("cam_id"), "pair_name")


@query("thermal_cloud", f"{THERMAL} SELECT point_id, {s6('temp', 'temp')} FROM fx_points LEFT JOIN temps USING (point_id)")
def thermal_cloud(spark, sf):
    return temperatures(spark, sf).select("point_id", r6("temp"))


@query("temperature_stats",
       f"{THERMAL}, a AS (SELECT temp FROM fx_points LEFT JOIN temps USING (point_id)) SELECT count(*) AS n_points, count(temp) AS n_hit, {s6('min(temp)', 't_min')}, "
       f"{s6('max(temp)', 't_max')}, {s6('quantile_cont(temp, 2e-2)', 't_lo')}, {s6('quantile_cont(temp, 5e-1)', 't_median')}, {s6('quantile_cont(temp, 98e-2)', 't_hi')} FROM a")
def temperature_stats(spark, sf):
    t = C.temperature_stats(temperatures(spark, sf))
    return t.select("n_points", "n_hit", *[r6(c) for c in ("t_min", "t_max", "t_lo", "t_median", "t_hi")])


@query("thermal_palette",
       f"{THERMAL}, q AS (SELECT quantile_cont(temp, 2e-2) lo, quantile_cont(temp, 98e-2) hi FROM temps), "
       "t AS (SELECT point_id, least(greatest((temp - lo) / (hi - lo + 1e-9), 0), 1) AS t FROM temps, q) SELECT point_id, round(t, 6) + 0e0 AS t FROM t")
def thermal_palette(spark, sf):
    df = temperatures(spark, sf).where("temp IS NOT NULL")
    return G.robust_normalize(df, "temp", out="t").select("point_id", r6("t"))


@query("geotag_join", f"{I.with_sql('fx_cameras', 'fx_geotags')} SELECT cam_id, round(lat, 6) AS lat, round(lon, 6) AS lon, rel_alt FROM fx_cameras JOIN fx_geotags USING (name)")
def geotag_join(spark, sf):
    j = C.join_geotags(I.cameras(spark, sf), I.derived(spark, sf, "fx_geotags"))
    return j.select("cam_id", r6("lat"), r6("lon"), "rel_alt")


@query("cameras_in_both_models", f"{I.with_sql('fx_cameras')} SELECT name, {s6('c_x', 'xa')}, {s6('c_x * 2', 'xb')} FROM fx_cameras WHERE c_y > 0")
def cameras_in_both_models(spark, sf):
    c = I.cameras(spark, sf)
    other = c.where("c.y > 0").withColumn("c", F.struct((F.col("c.x") * 2).alias("x"), F.col("c.y").alias("y"), F.col("c.z").alias("z")))
    return C.match_by_name(c, other).select("name", r6(F.col("c_a.x"), "xa"), r6(F.col("c_b.x"), "xb"))


@query("pending_images", f"{I.with_sql('fx_cameras')} SELECT name FROM fx_cameras WHERE c_x <= 0")
def pending_images(spark, sf):
    c = I.cameras(spark, sf).select("name", "c.x")
    return C.pending(c, c.where("x > 0")).select("name")


@query("colour_consistency",
       f"{PROJ}, col AS (SELECT point_id, ((7 * CAST(floor(u) AS BIGINT) + 13 * CAST(floor(v) AS BIGINT) + 31 * cam_id) % 256) / 255e0 r, "
       "((3 * CAST(floor(u) AS BIGINT) + 5 * CAST(floor(v) AS BIGINT) + 17 * cam_id) % 256) / 255e0 g, ((CAST(floor(u) AS BIGINT) + CAST(floor(v) AS BIGINT) + 101 * cam_id) % 256) / 255e0 b FROM seen) "
       f"SELECT point_id, count(*) AS views, {s6('(sqrt(var_pop(r)) + sqrt(var_pop(g)) + sqrt(var_pop(b))) / 3', 'sd')} FROM col GROUP BY point_id HAVING count(*) >= 2")
def colour_consistency(spark, sf):
    c = I.cameras(spark, sf)
    return C.color_consistency(I.points(spark, sf), c, I.images(c)).select("point_id", "views", r6("sd"))


CONSISTENCY = (
       f"{PROJ}, col AS (SELECT point_id, ((7 * CAST(floor(u) AS BIGINT) + 13 * CAST(floor(v) AS BIGINT) + 31 * cam_id) % 256) / 255e0 r, "
       "((3 * CAST(floor(u) AS BIGINT) + 5 * CAST(floor(v) AS BIGINT) + 17 * cam_id) % 256) / 255e0 g, ((CAST(floor(u) AS BIGINT) + CAST(floor(v) AS BIGINT) + 101 * cam_id) % 256) / 255e0 b FROM seen), "
       "per AS (SELECT point_id, (sqrt(var_pop(r)) + sqrt(var_pop(g)) + sqrt(var_pop(b))) / 3 AS sd FROM col GROUP BY point_id HAVING count(*) >= 2), "
       "total AS (SELECT count(*) AS n_points FROM fx_points)")


@query("colour_consistency_on_edges",
       f"{CONSISTENCY}, o AS (SELECT min(x) - 4e0 x0, min(y) - 4e0 y0 FROM fx_points), "
       "k AS (SELECT point_id, z, CAST(trunc((x - x0) / 2e0) AS BIGINT) ix, CAST(trunc((y - y0) / 2e0) AS BIGINT) iy FROM fx_points, o), "
       "cells AS (SELECT ix, iy, CAST(CAST(max(z) AS FLOAT) AS DOUBLE) z FROM k GROUP BY 1, 2), "
       "e AS (SELECT DISTINCT a.ix, a.iy FROM cells a, cells b WHERE ((b.ix = a.ix AND abs(b.iy - a.iy) = 1) OR (b.iy = a.iy AND abs(b.ix - a.ix) = 1)) AND abs(a.z - b.z) > 1) "
       f"SELECT count(*) AS n_seen, max(n_points) AS n_points, {s6('avg(sd)', 'mean_sd')} FROM per JOIN k USING (point_id) JOIN e USING (ix, iy), total")
def colour_consistency_on_edges(spark, sf):
    c, p = I.cameras(spark, sf), I.points(spark, sf)
    per = C.color_consistency(p, c, I.images(c))
    return C.consistency_summary(G.edge_consistency(per, p, 2.0, 1.0), p).select("n_seen", "n_points", r6("mean_sd"))


@query("best_candidate_by_coverage",
       f"{PROJ} SELECT 'identity' AS candidate, count(*) AS n_points, count(cam_id) AS n_hit FROM fx_points LEFT JOIN hit USING (point_id)")
def best_candidate_by_coverage(spark, sf):
    p, c = I.points(spark, sf), I.cameras(spark, sf)
    scores = C.score_candidates(p, c, {"identity": (np.eye(3), np.zeros(3)), "shifted": (np.eye(3), np.array([150.0, 90.0, 0.0]))})
    best = C.best_by_coverage(scores).select("candidate")
    return scores.join(best, "candidate", "left_semi").select("candidate", "n_points", "n_hit")


@query("optics_models",
       "WITH u AS (SELECT event_id AS point_id, event_id % 5 AS m, ((event_id * 7) % 100) / 1e2 - 5e-1 AS x, ((event_id * 13) % 100) / 1e2 - 5e-1 AS y FROM events), "
       "r AS (SELECT *, x * x + y * y AS r2, CASE m WHEN 2 THEN 1e-2 WHEN 3 THEN 1e-2 WHEN 4 THEN 1e-2 ELSE 0e0 END AS k1, CASE WHEN m >= 3 THEN -2e-3 ELSE 0e0 END AS k2, "
       "CASE WHEN m = 4 THEN 1e-3 ELSE 0e0 END AS p1, CASE WHEN m = 4 THEN -5e-4 ELSE 0e0 END AS p2, CASE WHEN m IN (1, 4) THEN 510e0 ELSE 500e0 END AS fy FROM u), "
       "d AS (SELECT *, 1 + k1 * r2 + k2 * r2 * r2 AS d FROM r) "
       f"SELECT point_id, {s6('5e2 * (x * d + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + 320', 'u')}, {s6('fy * (y * d + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + 256', 'v')}, {s6('sqrt(r2)', 'rad')} FROM d")
def optics_models(spark, sf):
    i = F.col("event_id")
    kinds = [("SIMPLE_PINHOLE", [500.0, 320.0, 256.0]), ("PINHOLE", [500.0, 510.0, 320.0, 256.0]), ("SIMPLE_RADIAL", [500.0, 320.0, 256.0, 0.01]),
             ("RADIAL", [500.0, 320.0, 256.0, 0.01, -0.002]), ("OPENCV", [500.0, 510.0, 320.0, 256.0, 0.01, -0.002, 0.001, -0.0005])]
    model, params = F.lit(kinds[0][0]), F.array(*[F.lit(v) for v in kinds[0][1]])
    for k in range(1, 5):
        model = F.when(i % 5 == k, F.lit(kinds[k][0])).otherwise(model)
        params = F.when(i % 5 == k, F.array(*[F.lit(v) for v in kinds[k][1]])).otherwise(params)
    df = I.spread(I.table(spark, sf, "events")).select(i.alias("point_id"), cam.optics(model, params).alias("o"),
                                                       F.struct((i * 7 % 100 / 100.0 - 0.5).alias("x"), (i * 13 % 100 / 100.0 - 0.5).alias("y")).alias("n"))
    p = df.select("point_id", cam.distort(F.col("o"), F.col("n")).alias("p"))
    return p.select("point_id", r6(F.col("p.u"), "u"), r6(F.col("p.v"), "v"), r6(F.col("p.rad"), "rad"))


# ------------------------------------------------------------- neighbours

P = I.with_sql("fx_points")
NEAR = ("k AS (SELECT *, CAST(floor(x / {r}) AS BIGINT) gx, CAST(floor(y / {r}) AS BIGINT) gy FROM fx_points), s AS (SELECT unnest([-1, 0, 1]) AS s), "
        "w AS (SELECT point_id, cloud_id, x, y, z, gx + a.s AS gx, gy + b.s AS gy FROM k, s a, s b), "
        "pair AS (SELECT w.point_id AS q, k.point_id AS p, (w.x - k.x) * (w.x - k.x) + (w.y - k.y) * (w.y - k.y) + (w.z - k.z) * (w.z - k.z) AS d2 "
        "FROM w JOIN k USING (gx, gy) WHERE {cond})")


@query("nearest_colour_transfer",
       f"{P}, {NEAR.format(r='25e-1', cond='w.cloud_id = 0 AND k.cloud_id <> 0')}, best AS (SELECT q, p FROM pair WHERE d2 < 625e-2 "
       "QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, p) = 1) SELECT a.point_id, CAST(coalesce(p % 256, 107) AS SMALLINT) AS red "
       "FROM fx_points a LEFT JOIN best ON q = a.point_id WHERE cloud_id = 0")
def nearest_colour_transfer(spark, sf):
    p = I.points(spark, sf)
    src = p.where("cloud_id <> 0").withColumn("red", (F.col("point_id") % 256).cast("short"))
    out = N.nn_transfer(p.where("cloud_id = 0"), src, ["red"], [107], 2.5)
    return out.select("point_id", F.col("red").cast("short").alias("red"))


@query("nearest_lookup",
       f"{P}, pair AS (SELECT a.point_id AS q, b.point_id AS p, b.intensity AS v, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 "
       "FROM fx_points a, fx_points b WHERE a.cloud_id = 2 AND b.cloud_id <> 2) SELECT q AS point_id, round(arg_min(v, (d2, p)), 6) AS intensity, "
       "round(sqrt(min(d2)), 6) AS distance FROM pair GROUP BY q")
def nearest_lookup(spark, sf):
    p = I.points(spark, sf)
    return N.nn_lookup(p.where("cloud_id = 2"), p.where("cloud_id <> 2"), ["intensity"]).select("point_id", r6("intensity"), r6("distance"))


@query("radius_count", f"{P}, {NEAR.format(r='4e0', cond='true')} SELECT q AS point_id, count(*) AS n FROM pair WHERE d2 <= 16 GROUP BY q")
def radius_count(spark, sf):
    p = I.points(spark, sf)
    return N.radius_count(p, p, 4.0)


@query("radius_outlier_removal", f"{P}, {NEAR.format(r='4e0', cond='true')} SELECT q AS point_id FROM pair WHERE d2 <= 16 GROUP BY q HAVING count(*) > 8")
def radius_outlier_removal(spark, sf):
    return N.radius_outlier(I.points(spark, sf), 8, 4.0).select("point_id")


KNN = ("pair AS (SELECT a.point_id AS q, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM fx_points a, fx_points b), "
       "k AS (SELECT q, min(d2, {k}) AS near FROM pair GROUP BY q)")


@query("k_nearest", f"{P}, {KNN.format(k=4)} SELECT q AS point_id, CAST(generate_subscripts(near, 1) AS INT) AS rank, round(unnest(near), 6) AS distance2 FROM k")
def k_nearest(spark, sf):
    p = I.points(spark, sf)
    return N.knn_join(p, p, 4).select("point_id", "rank", r6("distance2"))


@query("mean_neighbour_distance", f"{P}, {KNN.format(k=4)} SELECT q AS point_id, round(greatest((sqrt(near[2]) + sqrt(near[3]) + sqrt(near[4])) / 3, 1e-4), 6) AS mean_d FROM k")
def mean_neighbour_distance(spark, sf):
    return N.mean_nn_distance(I.points(spark, sf)).select("point_id", r6("mean_d"))


@query("statistical_outlier_removal",
       f"{P}, {KNN.format(k=20)}, m AS (SELECT q, list_avg(list_transform(near, lambda v: sqrt(v))) AS d FROM k), t AS (SELECT avg(d) + 2 * stddev_samp(d) AS lim FROM m WHERE d > 0) "
       "SELECT q AS point_id FROM m, t WHERE d > 0 AND d < lim")
def statistical_outlier_removal(spark, sf):
    return N.statistical_outlier(I.points(spark, sf)).select("point_id")


@query("two_stage_clean",
       f"{P}, {KNN.format(k=24)}, m AS (SELECT q, list_avg(list_transform(near, lambda v: sqrt(v))) AS d FROM k), t AS (SELECT avg(d) + 2 * stddev_samp(d) AS lim FROM m WHERE d > 0), "
       "f AS (SELECT fx_points.*, CAST(floor(x / 8e0) AS BIGINT) AS gx, CAST(floor(y / 8e0) AS BIGINT) AS gy FROM fx_points JOIN m ON q = point_id, t WHERE d > 0 AND d < lim), "
       "o AS (SELECT unnest([-1, 0, 1]) AS o), w AS (SELECT x AS wx, y AS wy, z AS wz, gx + a.o AS gx, gy + b.o AS gy FROM f, o a, o b), "
       "n AS (SELECT point_id FROM f JOIN w USING (gx, gy) WHERE (x - wx) * (x - wx) + (y - wy) * (y - wy) + (z - wz) * (z - wz) <= 64 GROUP BY point_id HAVING count(*) > 12) "
       f"SELECT point_id, cloud_id, {s6('x', 'x')}, {s6('y', 'y')}, {s6('z', 'z')} FROM f JOIN n USING (point_id)")
def two_stage_clean(spark, sf):
    return N.clean(I.points(spark, sf), 24, 2.0, 12, 8.0).select("point_id", "cloud_id", r6("x"), r6("y"), r6("z"))


# ------------------------------------------------------------ merge and edit

@query("merge_clouds", f"{P} SELECT CAST(CASE cloud_id WHEN 2 THEN 0 ELSE 1 END AS INT) AS slot, point_id, CAST(NULL AS DOUBLE) AS intensity FROM fx_points WHERE cloud_id <> 1")
def merge_clouds(spark, sf):
    slots = spark.createDataFrame([(2, 0, True), (0, 1, True), (1, 2, False)], "cloud_id int, slot int, visible boolean")
    return E.merge_clouds(I.points(spark, sf), slots).select("slot", "point_id", "intensity")


@query("merge_clouds_with_intensity", f"{P} SELECT cloud_id AS slot, point_id, intensity FROM fx_points WHERE cloud_id <> 2")
def merge_clouds_with_intensity(spark, sf):
    slots = spark.createDataFrame([(0, 0, True), (1, 1, True), (2, 2, False)], "cloud_id int, slot int, visible boolean")
    return E.merge_clouds(I.points(spark, sf), slots).select("slot", "point_id", "intensity")


@query("append_points", f"{P} SELECT point_id, {s6('x', 'x')} FROM fx_points UNION ALL SELECT point_id + 1000000, {s6('x + 1', 'x')} FROM fx_points")
def append_points(spark, sf):
    p = I.points(spark, sf).select("point_id", "x", "intensity")
    more = p.select((F.col("point_id") + 1000000).alias("point_id"), (F.col("x") + 1).alias("x"))
    return E.append_points(p, more).select("point_id", r6("x"))


@query("union_models", f"{P} SELECT point_id AS pid, {s6('x', 'x')} FROM fx_points UNION ALL SELECT point_id + 1000000 AS pid, {s6('y', 'x')} FROM fx_points")
def union_models(spark, sf):
    p = I.points(spark, sf)
    return E.union_models(p.select(F.col("point_id").alias("pid"), "x"), p.select(F.col("point_id").alias("pid"), F.col("y").alias("x"))).select("pid", r6("x"))


@query("names_in_both", f"{I.with_sql('fx_cameras')} SELECT DISTINCT name FROM fx_cameras WHERE c_x > 0 AND c_y > 0")
def names_in_both(spark, sf):
    c = I.cameras(spark, sf)
    return E.intersect_names(c.where("c.x > 0"), c.where("c.y > 0"))


EDITS = [("prism", (tuple(HEX), 0.0, 3.0)), ("delete", ()), ("sphere", ((60.0, 60.0, 1.0), 25.0)), ("delete", ()), ("undo", ()), ("undo", ()), ("redo", ()),
         ("sphere", ((0.0, 90.0, 1.0), 5000.0, )), ("invert", ()), ("delete", ()), ("brush", ((-70.0, 20.0, 1.0), 15.0)), ("brush", ((0.0, 0.0, 9000.0), 1.0)),
         ("undo", ()), ("redo", ()), ("sphere", ((40.0, -70.0, 1.0), 20.0))]


@query("edit_log_replay",
       f"{P}, a AS (SELECT *, z BETWEEN 0 AND 3 AND {edge_sql('x', 'y', HEX)} AS prism FROM fx_points) SELECT point_id, "
       "(x - 40) * (x - 40) + (y + 70) * (y + 70) + (z - 1) * (z - 1) <= 400 AS selected FROM a "
       "WHERE NOT prism AND NOT ((x + 70) * (x + 70) + (y - 20) * (y - 20) + (z - 1) * (z - 1) <= 225)")
def edit_log_replay(spark, sf):
    return E.replay(I.points(spark, sf), [E.Edit(*e) for e in EDITS]).select("point_id", "selected")


# ----------------------------------------------------------------- rasters

W_, H_, FOC = 320, 180, 200.0


def frames(spark, clip=(20.0, 15.0, 10.0, 4.3)):
    return R.orbit_frames(spark, [0.0, 90.0, 180.0, 270.0], (0.0, 0.0, 2.0), 200.0, 45.0, clip)


def frame_sql(clip=(20.0, 15.0, 10.0, 4.3)):
    """The four frames as literal rows."""
    rows = []
    for i, deg in enumerate((0.0, 90.0, 180.0, 270.0)):
        az, el = math.radians(deg), math.radians(45.0)
        c = np.array([0.0, 0.0, 2.0])
        eye = c + 200.0 * np.array([math.cos(el) * math.cos(az), math.cos(el) * math.sin(az), math.sin(el)])
        f = (c - eye) / np.linalg.norm(c - eye)
        r = np.cross(f, [0.0, 0.0, 1.0])
        r /= np.linalg.norm(r)
        up = np.cross(r, f)
        rows.append(f"({i}, " + ", ".join(f"({float(v)!r})::DOUBLE" for v in (*eye, *f, *r, *up, clip[i])) + ")")
    names = "frame, ex, ey, ez, fx, fy, fz, rx, ry, rz, ux, uy, uz, clip_z"
    return f"frames({names}) AS (VALUES {', '.join(rows)})"


RAST = (f"{P}, {frame_sql()}, c AS (SELECT frame, point_id, cloud_id, z, (x - ex) * fx + (y - ey) * fy + (z - ez) * fz AS depth, "
        "(x - ex) * rx + (y - ey) * ry + (z - ez) * rz AS xc, (x - ex) * ux + (y - ey) * uy + (z - ez) * uz AS yc FROM fx_points, frames WHERE z <= clip_z), "
        f"s AS (SELECT *, {FOC} * xc / depth + {W_ / 2} AS px, {H_ / 2} - {FOC} * yc / depth AS py FROM c WHERE depth > 1e-1), "
        "pix AS (SELECT frame, point_id, cloud_id, z, depth, CAST(round_even(px, 0) AS BIGINT) u, CAST(round_even(py, 0) AS BIGINT) v FROM s)")


def painted(spark, sf):
    p = I.points(spark, sf)
    return p.withColumns({"red": (F.col("point_id") % 256).cast("short"), "green": (F.col("point_id") * 3 % 256).cast("short"), "blue": F.lit(7).cast("short")})


@query("orbit_raster",
       f"{RAST} SELECT frame, v, u, point_id, {s6('depth', 'depth')} FROM pix WHERE u BETWEEN 0 AND {W_ - 1} AND v BETWEEN 0 AND {H_ - 1} "
       "QUALIFY row_number() OVER (PARTITION BY frame, v, u ORDER BY pix.depth, point_id) = 1")
def orbit_raster(spark, sf):
    return R.zbuffer(painted(spark, sf), frames(spark), W_, H_, FOC).select("frame", "v", "u", "point_id", r6("depth"))


@query("orbit_raster_splat",
       f"{RAST}, o AS (SELECT unnest([-1, 0, 1]) AS o), w AS (SELECT frame, point_id, depth, v + a.o AS v, u + b.o AS u FROM pix, o a, o b "
       f"WHERE pix.u BETWEEN 0 AND {W_ - 1} AND pix.v BETWEEN 0 AND {H_ - 1}) SELECT frame, v, u, point_id FROM w WHERE u BETWEEN 0 AND {W_ - 1} AND v BETWEEN 0 AND {H_ - 1} "
       "QUALIFY row_number() OVER (PARTITION BY frame, v, u ORDER BY depth, point_id) = 1")
def orbit_raster_splat(spark, sf):
    return R.zbuffer(painted(spark, sf), frames(spark), W_, H_, FOC, splat=1).select("frame", "v", "u", "point_id")


@query("orbit_raster_painter",
       f"{RAST}, o AS (SELECT unnest([-1, 0, 1]) AS o), w AS (SELECT frame, point_id, depth, (a.o + 1) * 3 + b.o + 1 AS no, v + a.o AS v, u + b.o AS u FROM pix, o a, o b "
       f"WHERE pix.u BETWEEN 1 AND {W_ - 2} AND pix.v BETWEEN 1 AND {H_ - 2}) SELECT frame, v, u, point_id FROM w "
       "QUALIFY row_number() OVER (PARTITION BY frame, v, u ORDER BY no DESC, depth, point_id) = 1")
def orbit_raster_painter(spark, sf):
    return R.zbuffer(painted(spark, sf), frames(spark), W_, H_, FOC, splat=1, border=1, painter=True).select("frame", "v", "u", "point_id")


@query("frame_crossfade",
       f"{RAST}, one AS (SELECT frame, v, u, point_id, cloud_id = 0 AS a FROM pix WHERE u BETWEEN 0 AND {W_ - 1} AND v BETWEEN 0 AND {H_ - 1} "
       "QUALIFY row_number() OVER (PARTITION BY cloud_id = 0, frame, v, u ORDER BY depth, point_id) = 1), "
       "m AS (SELECT frame, v, u, coalesce(max(CASE WHEN a THEN point_id % 256 END), 0) AS ra, coalesce(max(CASE WHEN NOT a THEN point_id % 256 END), 0) AS rb FROM one GROUP BY 1, 2, 3) "
       "SELECT frame, v, u, CAST(trunc(ra * (1 - frame / 4e0) + rb * (frame / 4e0)) AS SMALLINT) AS red FROM m")
def frame_crossfade(spark, sf):
    p, f = painted(spark, sf), frames(spark)
    a, b = R.zbuffer(p.where("cloud_id = 0"), f, W_, H_, FOC), R.zbuffer(p.where("cloud_id <> 0"), f, W_, H_, FOC)
    weights = spark.createDataFrame([(i, i / 4.0) for i in range(4)], "frame int, w double")
    return R.crossfade(a, b, weights).select("frame", "v", "u", "red")


@query("hotspot_per_frame",
       f"{RAST}, h AS (SELECT s.frame, s.point_id, s.px, s.py, intensity FROM s JOIN fx_points USING (point_id) WHERE intensity IS NOT NULL AND px BETWEEN 120 AND 200 AND py BETWEEN 60 AND 120) "
       f"SELECT frame, count(*) OVER (PARTITION BY frame) AS n_in_box, {s6('intensity', 'temp')}, point_id, CAST(trunc(px) AS BIGINT) AS u, CAST(trunc(py) AS BIGINT) AS v FROM h "
       "QUALIFY row_number() OVER (PARTITION BY frame ORDER BY intensity DESC, point_id) = 1")
def hotspot_per_frame(spark, sf):
    p = I.points(spark, sf).withColumn("temp", F.col("intensity"))
    return R.hotspots(p, frames(spark), (120.0, 60.0, 200.0, 120.0), W_, H_, FOC).select("frame", "n_in_box", r6("temp"), "point_id", "u", "v")


@query("axis_raster",
       f"{P}, b AS (SELECT quantile_cont(x, 5e-3) a0, quantile_cont(x, 995e-3) a1, quantile_cont(z, 5e-3) b0, quantile_cont(z, 995e-3) b1 FROM fx_points), "
       "d AS (SELECT *, greatest(1, CAST(trunc((a1 - a0) * 4) AS BIGINT)) w, greatest(1, CAST(trunc((b1 - b0) * 4) AS BIGINT)) h FROM b), "
       "p AS (SELECT point_id, w, h, CAST(trunc((x - a0) / (a1 - a0) * (w - 1)) AS BIGINT) u, CAST(trunc((z - b0) / (b1 - b0) * (h - 1)) AS BIGINT) v FROM fx_points, d) "
       "SELECT h - 1 - v AS v, u, max(point_id) AS point_id FROM p WHERE u BETWEEN 0 AND w - 1 AND v BETWEEN 0 AND h - 1 GROUP BY h, v, u")
def axis_raster(spark, sf):
    return R.axis_raster(I.points(spark, sf), "x", "z", "y").select("v", "u", "point_id")


@query("align_preview",
       f"{SURF}, {DSM_SQL.format(t='fx_surface')}, {pose_sql([(YAW, *SHIFT)])}, {MOVED_SQL}, "
       "e AS (SELECT min(x) - 6e-2 * (max(x) - min(x)) AS a0, max(x) + 6e-2 * (max(x) - min(x)) AS a1, min(y) - 6e-2 * (max(y) - min(y)) AS b0, max(y) + 6e-2 * (max(y) - min(y)) AS b1 FROM fx_surface), "
       "g AS (SELECT *, least(640 / (a1 - a0), 480 / (b1 - b0)) AS k FROM e), "
       "p AS (SELECT x, y, z, false AS mark FROM fx_surface UNION ALL SELECT x, y, NULL, true FROM mv), "
       "q AS (SELECT z, mark, CAST(trunc((x - a0) * k + (640 - (a1 - a0) * k) / 2) AS BIGINT) AS u, CAST(trunc(480 - ((y - b0) * k + (480 - (b1 - b0) * k) / 2)) AS BIGINT) AS v FROM p, g), "
       "i AS (SELECT * FROM q WHERE u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479), "
       "l AS (SELECT quantile_cont(z, 2e-2) AS lo, quantile_cont(z, 98e-2) AS hi FROM i WHERE NOT mark), "
       "w AS (SELECT v, u, max(z) AS top, bool_or(mark) AS mark FROM i GROUP BY v, u), "
       "c AS (SELECT v, u, mark, CAST(trunc(60 + least(greatest((top - lo) / greatest(hi - lo, 1e-6), 0), 1) * 170) AS INT) AS grey FROM w, l) "
       "SELECT v, u, " + ", ".join(f"CAST(trunc(coalesce(grey, {ground}) * CASE WHEN mark THEN 45e-2 ELSE 1e0 END + CASE WHEN mark THEN {marker * 0.55!r}e0 ELSE 0e0 END) AS SMALLINT) AS {n}"
                                   for n, ground, marker in (("red", 18, 255.0), ("green", 18, 150.0), ("blue", 22, 40.0))) + " FROM c")
def align_preview(spark, sf):
    return R.align_preview(I.derived(spark, sf, "fx_surface"), model(spark, sf), YAW, SHIFT).select("v", "u", "red", "green", "blue")


@query("frame_strips",
       f"{RAST}, z AS (SELECT frame, v, u, point_id FROM pix WHERE u BETWEEN 0 AND {W_ - 1} AND v BETWEEN 0 AND {H_ - 1} "
       "QUALIFY row_number() OVER (PARTITION BY frame, v, u ORDER BY pix.depth, point_id) = 1), "
       f"b AS (SELECT frame, v // 64 AS strip, 3 * ((v % 64) * {W_} + u) AS pos, point_id FROM z) "
       f"SELECT CAST(frame AS INT) AS frame, CAST(strip AS INT) AS strip, CAST(least(64, {H_} - 64 * strip) AS INT) AS height, {W_} AS width, "
       "CAST(sum((pos + 1) * (point_id % 256) + (pos + 2) * (point_id * 3 % 256) + (pos + 3) * 7) AS BIGINT) AS checksum FROM b GROUP BY frame, strip")
def frame_strips(spark, sf):
    """Strips of the orbit frames; the checksum weighs every byte by its place in its strip."""
    strips = R.frames_to_rasters(R.zbuffer(painted(spark, sf), frames(spark), W_, H_, FOC), W_, H_)
    weighed = "aggregate(sequence(1, length(data)), 0L, (s, i) -> s + i * cast(conv(hex(substring(data, i, 1)), 16, 10) AS BIGINT))"
    return strips.select("frame", "strip", "height", "width", F.expr(weighed).alias("checksum"))


@query("clip_schedule", f"{P}, f AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS frame), c AS (SELECT frame, CASE WHEN frame < 2 THEN 20e0 WHEN frame < 6 THEN 20 - (frame - 2) / 4e0 * 157e-1 ELSE 43e-1 END AS clip_z FROM f) "
       "SELECT CAST(frame AS INT) AS frame, count(*) AS n FROM fx_points, c WHERE z <= clip_z GROUP BY frame")
def clip_schedule(spark, sf):
    clip = R.clip_schedule(8, 20.0, 4.3, 2, 4)
    array = F.array(*[F.struct(F.lit(i).alias("frame"), F.lit(c).alias("clip_z")) for i, c in enumerate(clip)])
    return (I.points(spark, sf).withColumn("f", F.explode(array)).where(F.col("z") <= F.col("f.clip_z"))
            .groupBy(F.col("f.frame").alias("frame")).agg(F.count(F.lit(1)).alias("n")))


VIEW = 64
DOWN = [(float(y), -20.0) for y in range(0, 360, 60)]
AROUND = [(float(y), 60.0) for y in range(0, 360, 45)]


def view_sql(rotations, size: tuple[int, int], place: str, wrap: bool) -> str:
    """Sums of the bilinear pixels of all views of all images, from the formula the images are painted with."""
    w, h = size
    turns = ", ".join(f"({i}, " + ", ".join(f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x)) for x in r.ravel()) + ")" for i, r in enumerate(rotations))
    pixel = {n: f"((({a} * X + {b} * Y + {c} * cam_id) % 256 + 0e0))" for n, (a, b, c) in {"red": (7, 13, 31), "green": (3, 5, 17), "blue": (1, 1, 101)}.items()}

    def corner(name: str, dx: int, dy: int) -> str:
        x, y = f"(x0 + {dx})", f"(y0 + {dy})"
        wrapped = pixel[name].replace("X", f"((({x}) % {w} + {w}) % {w})").replace("Y", f"((({y}) % {h} + {h}) % {h})")
        ok = "seen" if wrap else f"seen AND {x} BETWEEN 0 AND {w - 1} AND {y} BETWEEN 0 AND {h - 1}"
        return f"CASE WHEN {ok} THEN {wrapped} ELSE 0e0 END"

    tone = {n: f"round_even((({corner(n, 0, 0)}) * (1 - fx) + ({corner(n, 1, 0)}) * fx) * (1 - fy) + (({corner(n, 0, 1)}) * (1 - fx) + ({corner(n, 1, 1)}) * fx) * fy, 0)" for n in pixel}
    return (f"{I.with_sql('fx_cameras')}, t(view, r0, r1, r2, r3, r4, r5, r6, r7, r8) AS (SELECT * FROM (VALUES {turns})), "
            f"g AS (SELECT cam_id, t.*, u, v, (u - {VIEW / 2}e0) / {VIEW / 2}e0 AS a, (v - {VIEW / 2}e0) / {VIEW / 2}e0 AS b FROM fx_cameras, t, range({VIEW}) p(u), range({VIEW}) q(v)), "
            "n AS (SELECT *, sqrt(a * a + b * b + 1) AS n FROM g), "
            "d AS (SELECT cam_id, view, u, v, a / n * r0 + b / n * r1 + 1 / n * r2 AS dx, a / n * r3 + b / n * r4 + 1 / n * r5 AS dy, a / n * r6 + b / n * r7 + 1 / n * r8 AS dz FROM n), "
            f"m AS (SELECT cam_id, view, u, v, {place} FROM d), "
            "f AS (SELECT *, CAST(floor(mx) AS BIGINT) AS x0, CAST(floor(my) AS BIGINT) AS y0, mx - floor(mx) AS fx, my - floor(my) AS fy FROM m), "
            f"c AS (SELECT cam_id, view, u, v, {', '.join(f'{e} AS {n}' for n, e in tone.items())} FROM f) "
            "SELECT cam_id, CAST(view AS INT) AS view, " + ", ".join(f"CAST(sum({n} * (1 + (u + 3 * v) % 7)) AS BIGINT) AS {n}" for n in pixel) + " FROM c GROUP BY cam_id, view")


def view_sums(pixels):
    """Sums per view and channel, pixels weighed by their place."""
    weight = 1 + (F.col("u") + 3 * F.col("v")) % 7
    return pixels.groupBy("cam_id", "view").agg(*[F.sum(F.col(c) * weight).cast("long").alias(c) for c in ("red", "green", "blue")])


@query("panorama_views", view_sql([rot_y(math.radians(y)) @ rot_x(math.radians(p)) for y, p in DOWN], (160, 128),
                                  "(atan2(dx, dz) / (2 * pi()) + 5e-1) * 160 AS mx, (5e-1 - asin(least(greatest(dy, -1e0), 1e0)) / pi()) * 128 AS my, true AS seen", True))
def panorama_views(spark, sf):
    return view_sums(R.panorama_pixels(I.images(I.cameras(spark, sf)), out=VIEW))


@query("fisheye_views", view_sql([rot_z(math.radians(y)) @ rot_x(math.radians(p)) for y, p in AROUND], (128, 128),
                                 "64e0 + 64e0 / radians(95e0) * acos(least(greatest(dz, -1e0), 1e0)) * cos(atan2(dy, dx)) AS mx, "
                                 "64e0 + 64e0 / radians(95e0) * acos(least(greatest(dz, -1e0), 1e0)) * sin(atan2(dy, dx)) AS my, "
                                 "acos(least(greatest(dz, -1e0), 1e0)) <= radians(95e0) AS seen", False))
def fisheye_views(spark, sf):
    c = I.cameras(spark, sf).withColumns({"width": F.lit(128), "height": F.lit(128)})
    return view_sums(R.fisheye_pixels(I.images(c), AROUND, out=VIEW))


# -------------------------------------------------------------------- fits

FITP = ("pairs AS (SELECT point_id, cloud_id, x AS sx, y AS sy, z AS sz, 18 * (6e-1 * x - 8e-1 * y) + 10 AS tx, 18 * (8e-1 * x + 6e-1 * y) - 5 AS ty, 18 * z + 2 AS tz FROM fx_points)")


def planted_pairs(spark, sf):
    p = I.points(spark, sf)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return p.select("point_id", "cloud_id", x.alias("sx"), y.alias("sy"), z.alias("sz"), (18.0 * (0.6 * x - 0.8 * y) + 10.0).alias("tx"),
                    (18.0 * (0.8 * x + 0.6 * y) - 5.0).alias("ty"), (18.0 * z + 2.0).alias("tz"))


@query("similarity_per_cloud",
       f"{P} SELECT cloud_id, count(*) AS n, 18e0 AS s, 6e-1 AS r00, -8e-1 AS r01, 10e0 AS t0, -5e0 AS t1, 2e0 AS t2 FROM fx_points GROUP BY cloud_id")
def similarity_per_cloud(spark, sf):
    fit = T.fit_groups(planted_pairs(spark, sf), "cloud_id")
    return fit.select("cloud_id", "n", r6("s"), r6(F.col("r")[0], "r00"), r6(F.col("r")[1], "r01"), *[r6(F.col("t")[i], f"t{i}") for i in range(3)])


@query("pair_moments",
       f"{P}, {FITP} SELECT cloud_id, count(*) AS n, round(covar_pop(tx, sx) * count(*), 2) AS c_tx_sx, round(covar_pop(ty, sz) * count(*), 2) AS c_ty_sz, "
       "round((var_pop(sx) + var_pop(sy) + var_pop(sz)) * count(*), 2) AS ss FROM pairs GROUP BY cloud_id")
def pair_moments(spark, sf):
    m = T.pair_moments(planted_pairs(spark, sf), ["cloud_id"])
    return m.select("cloud_id", "n", *[F.round(c, 2).alias(c) for c in ("c_tx_sx", "c_ty_sz", "ss")])


@query("similarity_residuals", f"{P} SELECT point_id, 0e0 AS residual FROM fx_points")
def similarity_residuals(spark, sf):
    pairs = planted_pairs(spark, sf)
    return T.residuals(pairs, *T.fit_similarity(pairs)).select("point_id", r6("residual"))


@query("rigid_fit", f"{P} SELECT point_id, {s6('6e-1 * x - 8e-1 * y + 3', 'x')}, {s6('8e-1 * x + 6e-1 * y + 4', 'y')}, {s6('z - 1', 'z')} FROM fx_points")
def rigid_fit(spark, sf):
    p = planted_pairs(spark, sf).withColumns({"tx": 0.6 * F.col("sx") - 0.8 * F.col("sy") + 3.0, "ty": 0.8 * F.col("sx") + 0.6 * F.col("sy") + 4.0, "tz": F.col("sz") - 1.0})
    return X.apply_matrix(I.points(spark, sf), T.fit_rigid(p)).select("point_id", r6("x"), r6("y"), r6("z"))


def model_cameras(spark, sf):
    """Cameras in an arbitrary model frame: the inverse of scale 18, yaw (.6, .8), shift (10, -5, 2)."""
    c = I.cameras(spark, sf)
    dx, dy, dz = F.col("c.x") - 10.0, F.col("c.y") + 5.0, F.col("c.z") - 2.0
    centre = F.struct(((0.6 * dx + 0.8 * dy) / 18.0).alias("x"), ((0.6 * dy - 0.8 * dx) / 18.0).alias("y"), (dz / 18.0).alias("z"))
    return c.withColumn("c", centre)


@query("georeference", f"{I.with_sql('fx_cameras')}, m AS (SELECT avg(c_x) mx, avg(c_y) my FROM fx_cameras) "
       "SELECT cam_id, round(c_x - mx, 3) + 0e0 AS east, round(c_y - my, 3) + 0e0 AS north, round(c_z, 3) AS up FROM fx_cameras, m")
def georeference(spark, sf):
    c = model_cameras(spark, sf)
    geo = T.georeference(c, I.derived(spark, sf, "fx_geotags"))
    centres = c.select("cam_id", "c.x", "c.y", "c.z")
    return T.apply_geo(centres, geo).select("cam_id", *[F.round(a, 3).alias(b) for a, b in zip("xyz", ("east", "north", "up"))])


@query("georeference_from_telemetry", f"{I.with_sql('fx_cameras')}, m AS (SELECT avg(c_x) mx, avg(c_y) my FROM fx_cameras) "
       "SELECT cam_id, round(c_x - mx, 3) + 0e0 AS east, round(c_y - my, 3) + 0e0 AS north, round(c_z, 3) AS up FROM fx_cameras, m")
def georeference_from_telemetry(spark, sf):
    """Every camera's geotag logged a hundredth of a second after its frame, between samples from elsewhere."""
    c = model_cameras(spark, sf)
    tags = I.derived(spark, sf, "fx_geotags").join(c.select("name", "cam_id"), "name")
    log = tags.select((F.col("cam_id") / 2.0 + 0.01).alias("t"), "lat", "lon", "rel_alt").unionByName(
        tags.select((F.col("cam_id") / 2.0 + 0.2).alias("t"), (F.col("lat") + 0.1).alias("lat"), "lon", "rel_alt"))
    geo = T.georeference_telemetry(c, log, F.col("cam_id"), 2.0)
    return T.apply_geo(c.select("cam_id", "c.x", "c.y", "c.z"), geo).select("cam_id", *[F.round(a, 3).alias(b) for a, b in zip("xyz", ("east", "north", "up"))])


@query("merge_models",
       f"{PC} SELECT point_id AS pid, {s6('18 * (6e-1 * x - 8e-1 * y) + 10', 'x')} FROM fx_points UNION ALL SELECT point_id + 1000000, {s6('x', 'x')} FROM fx_points")
def merge_models(spark, sf):
    c, p = I.cameras(spark, sf), I.points(spark, sf).select(F.col("point_id").alias("pid"), "x", "y", "z")
    one = {"s": 18.0, "r": rot_z(math.atan2(0.8, 0.6)), "t": np.array([10.0, -5.0, 2.0])}
    two = {"s": 1.0, "r": np.eye(3), "t": np.zeros(3)}
    return T.merge_models(c, p, one, c, p, two)[1].select("pid", r6("x"))


@query("model_to_model", f"{I.with_sql('fx_cameras')} SELECT cam_id, {s6('c_x', 'x')}, {s6('c_y', 'y')}, {s6('c_z', 'z')} FROM fx_cameras")
def model_to_model(spark, sf):
    a, b = model_cameras(spark, sf), I.cameras(spark, sf)
    s, r, t = T.model_to_model(a, b)
    return X.apply_similarity(a.select("cam_id", "c.x", "c.y", "c.z"), s, r, t).select("cam_id", r6("x"), r6("y"), r6("z"))


# -------------------------------------------------------------------- jobs

@query("temperature_job", f"{THERMAL} SELECT point_id, {s6('temp', 'temp')} FROM fx_points LEFT JOIN temps USING (point_id)")
def temperature_job(spark, sf):
    c = I.cameras(spark, sf)
    photos = c.where("cam_id % 5 <> 4").select(F.regexp_replace("name", "_V", "_T").alias("name"), F.lit(0).alias("ord"))
    rasters = I.thermal(C.with_optics(c, TW, TH, HFOV))
    return jobs.temperature(I.points(spark, sf), c, photos, rasters, None, TW, TH, HFOV)[0].select("point_id", r6("temp"))


@query("thermal_job",
       f"{THERMAL}, c AS (SELECT point_id, (((7 * CAST(floor(u) AS BIGINT) + 13 * CAST(floor(v) AS BIGINT) + 31 * cam_id) % 256) / 255e0 + ((3 * CAST(floor(u) AS BIGINT) + 5 * CAST(floor(v) AS BIGINT) + 17 * cam_id) % 256) / 255e0 "
       "+ ((CAST(floor(u) AS BIGINT) + CAST(floor(v) AS BIGINT) + 101 * cam_id) % 256) / 255e0) / 3 AS lum FROM hit), "
       "q AS (SELECT quantile_cont(lum, 2e-2) AS lo, quantile_cont(lum, 98e-2) AS hi FROM c), "
       "w AS (SELECT point_id, least(greatest((lum - lo) / (hi - lo + 1e-9), 0), 1) AS t FROM c, q) "
       "SELECT fx_points.point_id, " + ", ".join(f"CAST(CASE WHEN t IS NULL THEN 31 ELSE round_even(least(greatest({interp_sql(K.JET[0], f)}, 0), 1) * 255, 0) END AS SMALLINT) AS {n}"
                                                 for f, n in zip(K.JET[1:], ("red", "green", "blue"))) + " FROM fx_points LEFT JOIN w ON w.point_id = fx_points.point_id")
def thermal_job(spark, sf):
    c = I.cameras(spark, sf)
    photos = c.where("cam_id % 5 <> 4").select(F.regexp_replace("name", "_V", "_T").alias("name"), F.lit(0).alias("ord"))
    rasters = I.images(C.with_optics(c, TW, TH, HFOV))
    return jobs.thermal(I.points(spark, sf), c, photos, rasters, None, "jet", TW, TH, HFOV).select("point_id", "red", "green", "blue")


@query("merge_job", f"{P} SELECT row_number() OVER (ORDER BY CASE cloud_id WHEN 2 THEN 0 ELSE 1 END, point_id) - 1 AS point_id, {s6('x', 'x')} FROM fx_points "
       "WHERE cloud_id <> 1")
def merge_job(spark, sf):
    slots = spark.createDataFrame([(2, 0, True), (0, 1, True), (1, 2, False)], "cloud_id int, slot int, visible boolean")
    return jobs.merge(I.points(spark, sf), slots).select("point_id", r6("x"))


@query("profile_job",
       f"{P}, r AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS m FROM fx_points), c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM fx_points), "
       "d AS (SELECT sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) d FROM fx_points, c), q AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS m FROM d) "
       "SELECT max(m) AS n_points, max(m) AS n_valid, (SELECT round(max(CASE WHEN k = floor((m - 1) * 95e-2) THEN d END), 6) FROM q) AS view_radius, "
       "round(max(CASE WHEN k = floor((m - 1) * 2e-2) THEN z END), 6) AS z_lo, round(max(CASE WHEN k = floor((m - 1) * 98e-2) THEN z END), 6) AS z_hi FROM r")
def profile_job(spark, sf):
    return jobs.profile(I.points(spark, sf)).select("n_points", "n_valid", r6("view_radius"), r6("z_lo"), r6("z_hi"))


@query("quality_job", f"{CONSISTENCY} SELECT count(*) AS n_seen, max(n_points) AS n_points, {s6('avg(sd)', 'mean_sd')} FROM per, total")
def quality_job(spark, sf):
    c = I.cameras(spark, sf)
    return jobs.quality(I.points(spark, sf), c, I.images(c)).select("n_points", "n_seen", r6("mean_sd"))
