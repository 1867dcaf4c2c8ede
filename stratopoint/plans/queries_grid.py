"""Voxels, height grids, profiles, order statistics, colours and names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import colour as K
from ..functions import names as N
from ..operators import grid as G
from . import inputs as I
from .registry import query, r6, s6

P = I.with_sql("fx_points")
D = I.with_sql("fx_dense")
SURF = I.with_sql("fx_surface")
YAW, SHIFT = math.atan2(0.8, 0.6), (12.0, -7.0, 1.5)


def points(spark, sf):
    return I.points(spark, sf)


def model(spark, sf):
    """The surface seen from a frame turned and shifted, 2 % of its points lifted off."""
    s = I.spread(I.derived(spark, sf, "fx_surface"))
    x, y = F.col("x") - 12.0, F.col("y") + 7.0
    lift = F.when(F.col("point_id") % 50 == 0, F.lit(30.0)).otherwise(F.lit(0.0))
    return s.select("point_id", (x * 0.6 + y * 0.8).alias("x"), (y * 0.6 - x * 0.8).alias("y"), (F.col("z") - 1.5 + lift).alias("z"))


@query("voxel_first", f"{P} SELECT point_id FROM fx_points QUALIFY row_number() OVER "
       "(PARTITION BY floor(x / 5e0), floor(y / 5e0), floor(z / 5e0) ORDER BY point_id) = 1")
def voxel_first(spark, sf):
    return G.voxel_first(points(spark, sf), 5.0).select("point_id")


@query("first_per_key", f"{P} SELECT cloud_id, point_id, {s6('z', 'z')} FROM fx_points QUALIFY row_number() OVER "
       "(PARTITION BY cloud_id, floor(z) ORDER BY point_id) = 1")
def first_per_key(spark, sf):
    df = points(spark, sf).select("cloud_id", "point_id", "z")
    return G.first_per(df, ["cloud_id", F.floor("z").alias("k")]).select("cloud_id", "point_id", r6("z"))


@query("voxel_mean",
       f"{D}, o AS (SELECT min(x) - 2 ox, min(y) - 2 oy, min(z) - 2 oz FROM fx_dense) SELECT {s6('avg(x)', 'x')}, {s6('avg(y)', 'y')}, "
       f"{s6('avg(z)', 'z')}, {s6('avg(intensity)', 'intensity')}, count(*) AS n FROM fx_dense, o "
       "GROUP BY floor((x - ox) / 4e0), floor((y - oy) / 4e0), floor((z - oz) / 4e0)")
def voxel_mean(spark, sf):
    df = I.spread(I.derived(spark, sf, "fx_dense"))
    m = G.voxel_mean(df, 4.0, ("x", "y", "z", "intensity"))
    return m.select(r6("x"), r6("y"), r6("z"), r6("intensity"), "n")


@query("voxel_size_from_extent", f"{D} SELECT {s6('greatest(2e-2, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z))) / 2e2)', 'voxel')} FROM fx_dense")
def voxel_size_from_extent(spark, sf):
    df = I.derived(spark, sf, "fx_dense")
    return df.agg(r6(F.max(F.lit(G.voxel_size(df, 200.0, 0.02))), "voxel"))


DSM_SQL = ("o AS (SELECT min(x) - 8e-1 x0, min(y) - 8e-1 y0 FROM {t}), "
           "cells AS (SELECT CAST(trunc((x - x0) / 4e-1) AS BIGINT) ix, CAST(trunc((y - y0) / 4e-1) AS BIGINT) iy, "
           "CAST(CAST(max(z) AS FLOAT) AS DOUBLE) z FROM {t}, o GROUP BY 1, 2)")


@query("surface_model", f"{D}, {DSM_SQL.format(t='fx_dense')} SELECT ix, iy, {s6('z', 'z')} FROM cells")
def surface_model(spark, sf):
    return G.dsm(I.spread(I.derived(spark, sf, "fx_dense")), 0.4).select("ix", "iy", r6("z"))


@query("height_raster",
       f"{D}, c AS (SELECT CAST(floor((x - 1e2) / 5e-1) AS BIGINT) + 128 ix, CAST(floor((y - 5e1) / 5e-1) AS BIGINT) + 128 iy, z FROM fx_dense), "
       "m AS (SELECT ix, iy, max(z) z FROM c WHERE ix BETWEEN 0 AND 255 AND iy BETWEEN 0 AND 255 GROUP BY 1, 2), "
       f"s AS (SELECT avg(z) mean, stddev_pop(z) sd FROM m) SELECT ix, iy, {s6('(z - mean) / sd', 'value')} FROM m, s")
def height_raster(spark, sf):
    return G.height_raster(I.derived(spark, sf, "fx_dense"), 100.0, 50.0, 0.5, 256).select("ix", "iy", r6("value"))



# the surface in its model's frame, moved back by a pose (c, s, tx, ty, tz); points stay off the cell borders
MOVED_SQL = ("m AS (SELECT point_id, (x - 12e0) * 6e-1 + (y + 7e0) * 8e-1 AS x, (y + 7e0) * 6e-1 - (x - 12e0) * 8e-1 AS y, "
             "z - 15e-1 + CASE WHEN point_id % 50 = 0 THEN 30e0 ELSE 0e0 END AS z FROM fx_surface), "
             "mv AS (SELECT pose, c * x - s * y + tx AS x, s * x + c * y + ty AS y, z + tz AS z FROM m, pose), "
             "hit AS (SELECT pose, mv.z - cells.z AS r FROM mv, o, cells WHERE mv.x >= x0 AND mv.y >= y0 "
             "AND cells.ix = CAST(trunc((mv.x - x0) / 4e-1) AS BIGINT) AND cells.iy = CAST(trunc((mv.y - y0) / 4e-1) AS BIGINT))")
OFF = (SHIFT[0] + 0.05, SHIFT[1] + 0.05, SHIFT[2])


def pose_sql(poses) -> str:
    rows = ", ".join(f"({i}, {math.cos(a)!r}e0, {math.sin(a)!r}e0, {x!r}e0, {y!r}e0, {z!r}e0)" for i, (a, x, y, z) in enumerate(poses))
    return f"pose(pose, c, s, tx, ty, tz) AS (SELECT * FROM (VALUES {rows}))"


@query("surface_residual_quality",
       f"{SURF}, {DSM_SQL.format(t='fx_surface')}, {pose_sql([(YAW, *OFF)])}, {MOVED_SQL} SELECT count(*) AS n_on, "
       f"{s6('avg(CASE WHEN abs(r) < 5e-1 THEN 1e0 ELSE 0e0 END)', 'share')}, {s6('quantile_cont(abs(r), 5e-1)', 'median')} FROM hit")
def surface_residual_quality(spark, sf):
    q = G.dsm_quality(model(spark, sf), I.derived(spark, sf, "fx_surface"), YAW, OFF)
    return q.select("n_on", r6("share"), r6("median"))



@query("surface_residual_on_lattice",
       f"{D}, {DSM_SQL.format(t='fx_dense')}, hit AS (SELECT abs(d.z - c.z) r FROM fx_dense d, o, cells c "
       "WHERE c.ix = CAST(trunc((x - x0) / 4e-1) AS BIGINT) AND c.iy = CAST(trunc((y - y0) / 4e-1) AS BIGINT)) "
       f"SELECT count(*) AS n_on, {s6('avg(CASE WHEN r < 5e-1 THEN 1e0 ELSE 0e0 END)', 'share')}, {s6('quantile_cont(r, 5e-1)', 'median')} FROM hit")
def surface_residual_on_lattice(spark, sf):
    # the cloud against its own surface: how much lies below the top by how far
    df = I.derived(spark, sf, "fx_dense")
    return G.dsm_quality(df, df, 0.0, (0.0, 0.0, 0.0)).select("n_on", r6("share"), r6("median"))


@query("surface_edges",
       f"{D}, {DSM_SQL.format(t='fx_dense')}, n AS (SELECT a.ix, a.iy, max(abs(a.z - b.z)) AS step FROM cells a, cells b "
       "WHERE (b.ix = a.ix AND (b.iy = a.iy + 1 OR b.iy = a.iy - 1)) OR (b.iy = a.iy AND (b.ix = a.ix + 1 OR b.ix = a.ix - 1)) GROUP BY 1, 2) "
       f"SELECT ix, iy, {s6('step', 'step')} FROM n WHERE step > 3")
def surface_edges(spark, sf):
    return G.slope_edges(G.dsm(I.derived(spark, sf, "fx_dense"), 0.4), 3.0).select("ix", "iy", r6("step"))


@query("cloud_profile",
       f"{P} SELECT count(*) AS n_points, count(*) AS n_valid, {s6('min(x)', 'min_x')}, {s6('max(x)', 'max_x')}, {s6('avg(x)', 'mean_x')}, "
       f"{s6('min(y)', 'min_y')}, {s6('max(y)', 'max_y')}, {s6('avg(y)', 'mean_y')}, {s6('min(z)', 'min_z')}, {s6('max(z)', 'max_z')}, "
       f"{s6('avg(z)', 'mean_z')}, {s6('5e-1 * sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y)) + (max(z) - min(z)) * (max(z) - min(z)))', 'radius')} FROM fx_points")
def cloud_profile(spark, sf):
    p = G.cloud_profile(points(spark, sf))
    return p.select("n_points", "n_valid", *[r6(c) for c in p.columns if c not in ("n_points", "n_valid")])


@query("viewer_percentile",
       f"{P}, r AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS k, count(*) OVER () AS m FROM fx_points) "
       "SELECT round(max(CASE WHEN k = floor((m - 1) * 2e-2) THEN z END), 6) AS lo, round(max(CASE WHEN k = floor((m - 1) * 98e-2) THEN z END), 6) AS hi FROM r")
def viewer_percentile(spark, sf):
    df = points(spark, sf)
    lo, hi = G.floor_percentile(df, "z")
    return df.agg(r6(F.max(F.lit(lo)), "lo"), r6(F.max(F.lit(hi)), "hi"))


@query("view_radius",
       f"{P}, c AS (SELECT avg(x) cx, avg(y) cy, avg(z) cz FROM fx_points), d AS (SELECT sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) d FROM fx_points, c), "
       "r AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, count(*) OVER () AS m FROM d) SELECT round(max(CASE WHEN k = floor((m - 1) * 95e-2) THEN d END), 6) AS radius FROM r")
def view_radius(spark, sf):
    df = points(spark, sf)
    return df.agg(r6(F.max(F.lit(G.view_radius(df))), "radius"))


@query("scene_frame",
       f"{P}, c AS (SELECT quantile_cont(x, 5e-1) cx, quantile_cont(y, 5e-1) cy, 5e-1 * (quantile_cont(z, 1e-2) + quantile_cont(z, 99e-2)) cz FROM fx_points) "
       f"SELECT {s6('max(cx)', 'cx')}, {s6('max(cy)', 'cy')}, {s6('max(cz)', 'cz')}, "
       f"{s6('quantile_cont(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)), 9e-1)', 'radius')} FROM fx_points, c")
def scene_frame(spark, sf):
    df = points(spark, sf)
    return df.agg(*[r6(F.max(F.lit(v)), k) for k, v in G.scene_frame(df).items()])


@query("residual_stats", f"{P} SELECT {s6('avg(z)', 'mean')}, {s6('quantile_cont(z, 5e-1)', 'median')}, {s6('max(z)', 'max')} FROM fx_points")
def residual_stats(spark, sf):
    return G.residual_stats(points(spark, sf), "z").select(r6("mean"), r6("median"), r6("max"))


@query("pick_pair_ratios",
       f"{I.with_sql('fx_cameras')}, r AS (SELECT sqrt((a.c_y - b.c_y) * (a.c_y - b.c_y) + (a.c_x - b.c_x) * (a.c_x - b.c_x) + 4 * (a.c_z - b.c_z) * (a.c_z - b.c_z)) / "
       "sqrt((a.c_x - b.c_x) * (a.c_x - b.c_x) + (a.c_y - b.c_y) * (a.c_y - b.c_y) + (a.c_z - b.c_z) * (a.c_z - b.c_z)) AS q "
       f"FROM fx_cameras a, fx_cameras b WHERE a.cam_id < b.cam_id) SELECT count(*) AS n_pairs, {s6('min(q)', 'min_ratio')}, {s6('max(q)', 'max_ratio')} FROM r")
def pick_pair_ratios(spark, sf):
    c = I.derived(spark, sf, "fx_cameras")
    pairs = c.select(F.col("cam_id").alias("pair_id"), F.col("c_x").alias("sx"), F.col("c_y").alias("sy"), F.col("c_z").alias("sz"),
                     F.col("c_y").alias("tx"), F.col("c_x").alias("ty"), (F.col("c_z") * 2.0).alias("tz"))
    return G.pair_ratios(pairs).select("n_pairs", r6("min_ratio"), r6("max_ratio"))


@query("arg_extreme", f"{P}, b AS (SELECT cloud_id, floor(z) AS zi, point_id FROM fx_points) SELECT cloud_id, CAST(zi AS BIGINT) AS zi, point_id FROM b "
       "QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY zi DESC, point_id) = 1")
def arg_extreme(spark, sf):
    df = points(spark, sf).select("cloud_id", "point_id", F.floor("z").alias("zi"))
    return G.arg_extreme(df, "zi", "point_id", ["cloud_id"]).select("cloud_id", "zi", "point_id")


SCORES = "s AS (SELECT floor(x / 2) * 2 + 180 AS angle, sum(z) AS score FROM fx_points GROUP BY 1)"


def angle_scores(spark, sf):
    return points(spark, sf).groupBy((F.floor(F.col("x") / 2) * 2 + 180).cast("double").alias("angle")).agg(F.sum("z").alias("score"))


@query("top_angles", f"{P}, {SCORES} SELECT angle, {s6('score', 'score')} FROM s ORDER BY s.score DESC, angle LIMIT 5")
def top_angles(spark, sf):
    return G.top_angles(angle_scores(spark, sf))[0].select("angle", r6("score"))


@query("second_best_angle",
       f"{P}, {SCORES}, b AS (SELECT angle AS top, score AS best FROM s ORDER BY score DESC, angle LIMIT 1) "
       f"SELECT {s6('max(best)', 'best')}, {s6('max(CASE WHEN abs(((angle - top + 180 + 360) % 360) - 180) > 10 THEN score END)', 'second')} FROM s, b")
def second_best_angle(spark, sf):
    return G.top_angles(angle_scores(spark, sf))[1].select(r6("best"), r6("second"))


@query("nearest_time",
       f"{I.with_sql('fx_telemetry', 'fx_video_frames')}, a AS (SELECT f.frame, f.t AS ft, p.t AS pt, p.lat AS plat, p.rel_alt AS palt FROM fx_video_frames f "
       "ASOF LEFT JOIN fx_telemetry p ON f.t >= p.t), b AS (SELECT f.frame, n.t AS nt, n.lat AS nlat, n.rel_alt AS nalt FROM fx_video_frames f "
       "ASOF LEFT JOIN fx_telemetry n ON f.t <= n.t), j AS (SELECT frame, ft, pt IS NOT NULL AND (nt IS NULL OR ft - pt <= nt - ft) AS back, "
       "pt, plat, palt, nt, nlat, nalt FROM a JOIN b USING (frame)) SELECT frame, round(CASE WHEN back THEN pt ELSE nt END, 6) AS t, "
       "round(CASE WHEN back THEN plat ELSE nlat END, 6) AS lat, round(CASE WHEN back THEN palt ELSE nalt END, 6) AS rel_alt FROM j")
def nearest_time(spark, sf):
    n = G.nearest_time(I.derived(spark, sf, "fx_video_frames"), I.derived(spark, sf, "fx_telemetry"))
    return n.select("frame", r6("t"), r6("lat"), r6("rel_alt"))


# ------------------------------------------------------------------ colours

T = "(value % 100) / 100e0"


def unit(spark, sf):
    return I.spread(I.table(spark, sf, "events")).selectExpr("event_id AS point_id", f"{T} AS t", "value")


def palette_query(name):
    def run(spark, sf):
        rgb = K.palette(F.col("t"), name)
        return unit(spark, sf).select("point_id", *[r6(c, n) for c, n in zip(rgb, "rgb")])

    return run


def interp_sql(xp, fp):
    parts = [f"WHEN t < {b!r}::DOUBLE THEN ({(g - f) / (b - a)!r})::DOUBLE * (t - {a!r}::DOUBLE) + {f!r}::DOUBLE"
             for a, b, f, g in zip(xp, xp[1:], fp, fp[1:])]
    return f"(CASE WHEN t <= {xp[0]!r} THEN {fp[0]!r}::DOUBLE {' '.join(parts)} ELSE {fp[-1]!r}::DOUBLE END)"


U = f"WITH u AS (SELECT event_id AS point_id, {T} AS t, value FROM events)"
for _name, _knots in (("iron", K.IRON), ("jet", K.JET)):
    query(f"palette_{_name}", f"{U} SELECT point_id, " + ", ".join(s6(interp_sql(_knots[0], f), n) for f, n in zip(_knots[1:], "rgb")) + " FROM u")(
        palette_query(_name))
query("palette_turbo3", f"{U} SELECT point_id, " + ", ".join(
    s6(f"least(greatest(15e-1 - abs(4 * t - {k}), 0), 1)", n) for k, n in zip((3, 2, 1), "rgb")) + " FROM u")(palette_query("turbo3"))
query("palette_turbo", f"{U} SELECT point_id, " + ", ".join(
    s6("least(greatest(" + " + ".join(f"({c!r})::DOUBLE * pow(t, {i})" for i, c in enumerate(k)) + ", 0), 1)", n)
    for k, n in zip(K.TURBO, "rgb")) + " FROM u")(palette_query("turbo"))
query("palette_rviz", f"{U}, h AS (SELECT point_id, (1 - t) * 5e0 + 1 AS h FROM u), f AS (SELECT point_id, CAST(floor(h) AS INT) AS i, h - floor(h) AS f FROM h), "
      "n AS (SELECT point_id, i, 1 - CASE WHEN i % 2 = 0 THEN 1 - f ELSE f END AS n FROM f) SELECT point_id, "
      f"{s6('CASE WHEN i <= 1 THEN n WHEN i <= 3 THEN 0 WHEN i = 4 THEN n ELSE 1 END', 'r')}, {s6('CASE WHEN i <= 1 THEN 0 WHEN i = 2 THEN n WHEN i <= 4 THEN 1 ELSE n END', 'g')}, "
      f"{s6('CASE WHEN i <= 2 THEN 1 WHEN i = 3 THEN n ELSE 0 END', 'b')} FROM n")(palette_query("rviz"))
query("palette_hue", f"{U}, h AS (SELECT point_id, ((66e-2 - 83e-2 * t + 1) - floor(66e-2 - 83e-2 * t + 1)) * 6e0 AS h FROM u), "
      "f AS (SELECT point_id, CAST(floor(h) AS INT) % 6 AS i, h - floor(h) AS f FROM h) SELECT point_id, "
      f"{s6('CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 4 THEN f WHEN 5 THEN 1 ELSE 0 END', 'r')}, "
      f"{s6('CASE i WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END', 'g')}, "
      f"{s6('CASE i WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 - f ELSE 0 END', 'b')} FROM f")(palette_query("hue"))


@query("intensity_tint",
       f"{P}, q AS (SELECT quantile_cont(intensity, 2e-2) lo, quantile_cont(intensity, 98e-2) hi FROM fx_points), "
       "t AS (SELECT point_id, x, least(greatest((intensity - lo) / (hi - lo), 0), 1) AS t FROM fx_points, q) SELECT point_id, "
       + ", ".join(f"CAST(trunc(CASE WHEN x > 90 THEN {m} ELSE ({a} + {k} * t) * {b} END * 255e0) AS SMALLINT) AS {n}"
                   for n, m, a, k, b in (("red", "1e0", "2e-1", "8e-1", "1e0"), ("green", "15e-2", "4e-1", "6e-1", "9e-1"), ("blue", "15e-2", "6e-1", "4e-1", "8e-1")))
       + " FROM t")
def intensity_tint(spark, sf):
    df = points(spark, sf).withColumn("selected", F.col("x") > 90)
    return G.intensity_tint(df, (1.0, 0.9, 0.8)).select("point_id", "red", "green", "blue")


@query("robust_normalise", f"{P}, q AS (SELECT quantile_cont(z, 2e-2) lo, quantile_cont(z, 98e-2) hi FROM fx_points) "
       f"SELECT point_id, {s6('least(greatest((z - lo) / (hi - lo + 1e-9), 0), 1)', 'norm')} FROM fx_points, q")
def robust_normalise(spark, sf):
    return G.robust_normalize(points(spark, sf), "z").select("point_id", r6("norm"))


@query("splat_colours",
       f"{I.with_sql('fx_splats')} SELECT point_id, " + ", ".join(s6(f"least(greatest(5e-1 + 0.28209479177387814::DOUBLE * f_dc_{i}, 0), 1)", n) for i, n in enumerate("rgb"))
       + f", {s6('1 / (1 + exp(-opacity))', 'alpha')}, {s6('exp(scale_0)', 's0')} FROM fx_splats")
def splat_colours(spark, sf):
    s = I.spread(I.derived(spark, sf, "fx_splats"))
    return s.select("point_id", *[r6(K.sh_dc_to_rgb(F.col(f"f_dc_{i}")), n) for i, n in enumerate("rgb")],
                    r6(K.sigmoid(F.col("opacity")), "alpha"), r6(F.exp("scale_0"), "s0"))


@query("float_to_byte",
       f"{U} SELECT point_id, CAST(round_even(t * 255e0, 0) AS SMALLINT) AS half_even, CAST(trunc(t * 255e0) AS SMALLINT) AS truncated, "
       "CAST(floor(t * 255e0 + 5e-1) AS SMALLINT) AS half_up FROM u")
def float_to_byte(spark, sf):
    t = F.col("t")
    return unit(spark, sf).select("point_id", K.to_byte(t).alias("half_even"), K.to_byte(t, "trunc").alias("truncated"),
                                  K.to_byte(t, "half_up").alias("half_up"))


@query("pack_and_unpack",
       "SELECT event_id AS point_id, CAST((event_id % 256) * 65536 + (event_id * 7 % 256) * 256 + event_id * 13 % 256 AS INT) AS packed, "
       "CAST(event_id % 256 AS SMALLINT) AS red, CAST(event_id * 7 % 256 AS SMALLINT) AS green, CAST(event_id * 13 % 256 AS SMALLINT) AS blue FROM events")
def pack_and_unpack(spark, sf):
    e = I.table(spark, sf, "events").select(F.col("event_id").alias("point_id"))
    i = F.col("point_id")
    packed = e.withColumn("packed", K.pack_rgb(i % 256, i * 7 % 256, i * 13 % 256))
    return packed.select("point_id", "packed", *[c.alias(n) for c, n in zip(K.unpack_rgb(F.col("packed")), ("red", "green", "blue"))])


@query("brighten", f"{U} SELECT point_id, {s6('least(greatest(18e-1 * t, 0), 1)', 'bright')}, {s6('(t + value / 5e2 + 5e-1) / 3', 'grey')} FROM u")
def brighten(spark, sf):
    return unit(spark, sf).select("point_id", r6(K.brighten(F.col("t")), "bright"),
                                  r6(K.white_hot(F.col("t"), F.col("value") / 500.0, F.lit(0.5)), "grey"))


@query("name_functions",
       "SELECT event_id AS point_id, 'DJI_2026_' || CAST(event_id AS VARCHAR) || '_V.JPG' AS base, CAST(event_id AS VARCHAR) AS token, "
       "CAST(event_id % 1000 AS INT) AS frame, CAST(event_id % 90 AS INT) AS suffix FROM events")
def name_functions(spark, sf):
    i = F.col("event_id").cast("string")
    path = F.concat(F.lit("/flight/a_b/DJI_2026_"), i, F.lit("_V.JPG"))
    frame = F.concat(F.lit("f"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("_v1.jpg"))
    log = F.concat(F.lit("run_"), (F.col("event_id") % 90).cast("string"), F.lit(".db3"))
    return I.table(spark, sf, "events").select(F.col("event_id").alias("point_id"), N.basename(path).alias("base"),
                                               N.sequence_token(path).alias("token"), N.frame_no(frame).alias("frame"), N.log_suffix(log).alias("suffix"))


@query("clock_seconds", "SELECT event_id AS point_id, round((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59) + (event_id % 1000) / 1e3, 6) AS seconds FROM events")
def clock_seconds(spark, sf):
    i = F.col("event_id")
    text = F.format_string("7\n%02d:%02d:%02d,%03d --> 00:00:00,000", i % 24, i % 60, i % 59, i % 1000)
    return I.table(spark, sf, "events").select(i.alias("point_id"), r6(N.clock_seconds(text), "seconds"))
