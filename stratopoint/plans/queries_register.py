"""Alignment, ICP, stream and source queries over the derived tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import join4, rot_z
from ..operators import align as AL
from ..operators import features as FT
from ..operators import icp as IC
from ..operators import neighbours as NB
from ..operators import select as SE
from ..operators import transform as X
from ..sources import rosbag as RB
from ..sources import texts as TX
from ..session import cut, shared_folder
from ..sources.files import make_folder
from ..sources.points import register
from ..streaming import maps as ST
from . import inputs as I
from . import jobs
from .queries_grid import DSM_SQL, MOVED_SQL, OFF, SHIFT, YAW, model, pose_sql
from .registry import query, r6, s6

P = I.with_sql("fx_points")
SURF = I.with_sql("fx_surface")


def surface(spark, sf):
    return I.spread(I.derived(spark, sf, "fx_surface"))


POSES = [(YAW, *OFF), (YAW, OFF[0] + 1.0, OFF[1], OFF[2]), (YAW + 0.1, *OFF)]


@query("surface_score_of_poses",
       f"{SURF}, {DSM_SQL.format(t='fx_surface')}, {pose_sql(POSES)}, {MOVED_SQL}, n AS (SELECT count(*) AS n FROM m), "
       "k AS (SELECT pose, count(*) AS hits, sum(exp(-(r / 5e-1) * (r / 5e-1))) AS total FROM hit GROUP BY pose) "
       f"SELECT CAST(pose.pose AS INT) AS pose, {s6('CASE WHEN coalesce(hits, 0) >= 500 THEN total / n ELSE 0e0 END', 'score')} FROM pose LEFT JOIN k ON k.pose = pose.pose, n")
def surface_score_of_poses(spark, sf):
    return AL.dsm_score(model(spark, sf), surface(spark, sf), POSES, 0.5).select("pose", r6("score"))


def near(df, **found) -> DataFrame:
    """One row: is each found value as near to the planted one as the third number says?"""
    return df.agg(*[F.max(F.lit(bool(abs(v - want) <= tol))).alias(n) for n, (v, want, tol) in found.items()])


@query("coarse_turn", "SELECT true AS yaw, true AS tx, true AS ty, true AS unambiguous")
def coarse_turn(spark, sf):
    """The planted turn within a step of the fine circle, the shift within two cells."""
    m = model(spark, sf)
    c = AL.coarse_yaw(m, surface(spark, sf))
    return near(m, yaw=(math.degrees(c["yaw"]), math.degrees(YAW), 0.5), tx=(c["tx"], SHIFT[0], 1.5), ty=(c["ty"], SHIFT[1], 1.5),
                unambiguous=(float(c["ratio"] > 1.05), 1.0, 0.0))


@query("fine_fit_to_surface", "SELECT true AS yaw, true AS tx, true AS ty, true AS tz")
def fine_fit_to_surface(spark, sf):
    """The planted pose from a start a degree and a foot away."""
    m = model(spark, sf)
    fit = AL.fit_to_dsm(m, surface(spark, sf), YAW + 0.01, SHIFT[0] + 0.3, SHIFT[1] - 0.2)
    return near(m, yaw=(math.degrees(fit["yaw"]), math.degrees(YAW), 0.3), **{n: (fit["t"][i], SHIFT[i], 0.3) for i, n in enumerate(("tx", "ty", "tz"))})


@query("automatic_alignment", "SELECT true AS yaw, true AS tx, true AS ty, true AS tz, true AS share")
def automatic_alignment(spark, sf):
    """Coarse turn and fine fit together, over all points of both clouds."""
    m = model(spark, sf)
    fit = AL.auto_align(m, surface(spark, sf))
    return near(m, yaw=(math.degrees(fit["yaw"]), math.degrees(YAW), 0.3), share=(fit["share"], 0.98, 0.1),
                **{n: (fit["t"][i], SHIFT[i], 0.3) for i, n in enumerate(("tx", "ty", "tz"))})


MOTION = join4(rot_z(math.radians(1.0)), [0.3, -0.2, 0.1])


def displaced(spark, sf) -> DataFrame:
    return X.apply_matrix(I.points(spark, sf), np.linalg.inv(MOTION)).select("point_id", "x", "y", "z")


def back_in_place(fit, spark, sf):
    """The displaced cloud after the found transform: it must lie on the original again."""
    return X.apply_matrix(displaced(spark, sf), fit.matrix).select("point_id", *[F.round(c, 2).alias(c) for c in "xyz"])


PLACE = f"{P} SELECT point_id, round(x, 2) + 0e0 AS x, round(y, 2) + 0e0 AS y, round(z, 2) + 0e0 AS z FROM fx_points"


@query("icp_point_to_point", PLACE)
def icp_point_to_point(spark, sf):
    fit = IC.icp(displaced(spark, sf), I.points(spark, sf), [6.0, 3.0], kind="point", max_iter=80)[0]
    return back_in_place(fit, spark, sf)


@query("icp_point_to_plane", PLACE)
def icp_point_to_plane(spark, sf):
    target = IC.normals(I.points(spark, sf), 12.0)
    fit = IC.icp(displaced(spark, sf), target, [6.0, 3.0], kind="plane", max_iter=80)[0]
    return back_in_place(fit, spark, sf)


def turned(spark, sf):
    """The surface and a copy of it as a model sees it, a big turn and shift away."""
    cloud = surface(spark, sf).select("point_id", "x", "y", "z")
    motion = join4(rot_z(YAW + math.pi / 2), SHIFT)
    return X.apply_matrix(cloud, np.linalg.inv(motion)), cloud, motion


def placed(df, matrix, motion, tol: float):
    """One row: do the corners of a 100 m cube land where the planted motion puts them?"""
    cube = np.array([[x, y, z, 1.0] for x in (0.0, 100.0) for y in (0.0, 100.0) for z in (0.0, 10.0)])
    gap = float(np.abs((cube @ np.asarray(matrix).T - cube @ motion.T)[:, :3]).max())
    return near(df, placed=(gap, 0.0, tol))


@query("generalised_icp", "SELECT true AS placed")
def generalised_icp(spark, sf):
    src = displaced(spark, sf)
    fit = IC.icp(IC.normals(src, 12.0), IC.normals(I.points(spark, sf), 12.0), [6.0, 3.0], kind="generalized")[0]
    return placed(src, fit.matrix, MOTION, 0.05)


@query("feature_registration", "SELECT true AS placed")
def feature_registration(spark, sf):
    """No start at all: features, mutual matches, sampled poses, then the graduated ones; the better one refined."""
    src, tgt, motion = turned(spark, sf)
    a, b = (cut(IC.normals(cut(IC.thinned(df, 2.0)), 4.0)) for df in (src, tgt))
    pairs = FT.feature_pairs(a, b, 2.0)
    starts = [FT.ransac_pose(pairs, 3.0, trials=100_000)[0], *FT.graduated_poses(pairs, 1.0, 3)]
    fits = IC.icp(a, b, [8.0, 4.0, 2.0], starts, "plane", 80)
    return placed(tgt, max(fits, key=lambda f: (f.fitness, -f.rmse)).matrix, motion, 1.0)


@query("registration_evaluation",
       f"{P}, k AS (SELECT *, CAST(floor(x / 3e0) AS BIGINT) gx, CAST(floor(y / 3e0) AS BIGINT) gy FROM fx_points), s AS (SELECT unnest([-1, 0, 1]) AS s), "
       "w AS (SELECT x, y, z, gx + a.s AS gx, gy + b.s AS gy FROM k, s a, s b WHERE cloud_id <> 0), "
       "src AS (SELECT point_id, x + 5e-1 AS x, y, z, CAST(floor((x + 5e-1) / 3e0) AS BIGINT) gx, CAST(floor(y / 3e0) AS BIGINT) gy FROM fx_points WHERE cloud_id = 0), "
       "pair AS (SELECT point_id, min((src.x - w.x) * (src.x - w.x) + (src.y - w.y) * (src.y - w.y) + (src.z - w.z) * (src.z - w.z)) AS d2 FROM src JOIN w USING (gx, gy) GROUP BY point_id), "
       "hit AS (SELECT d2 FROM pair WHERE d2 < 9), n AS (SELECT count(*) AS c FROM src) "
       f"SELECT count(*) AS n, {s6('count(*) / CAST(max(c) AS DOUBLE)', 'fitness')}, {s6('sqrt(avg(d2))', 'rmse')} FROM hit, n")
def registration_evaluation(spark, sf):
    p = I.points(spark, sf)
    e = IC.evaluate(p.where("cloud_id = 0"), p.where("cloud_id <> 0"), 3.0, join4(np.eye(3), [0.5, 0.0, 0.0]))
    return e.select("n", r6("fitness"), r6("rmse"))


@query("icp_correspondences",
       f"{P}, k AS (SELECT *, CAST(floor(x / 3e0) AS BIGINT) gx, CAST(floor(y / 3e0) AS BIGINT) gy FROM fx_points), s AS (SELECT unnest([-1, 0, 1]) AS s), "
       "w AS (SELECT point_id AS t_point_id, x, y, z, gx + a.s AS gx, gy + b.s AS gy FROM k, s a, s b WHERE cloud_id <> 0), "
       "pair AS (SELECT k.point_id, t_point_id, (k.x - w.x) * (k.x - w.x) + (k.y - w.y) * (k.y - w.y) + (k.z - w.z) * (k.z - w.z) AS d2 FROM k JOIN w USING (gx, gy) WHERE cloud_id = 0) "
       f"SELECT point_id, t_point_id, {s6('d2', 'd2')} FROM pair WHERE d2 < 9 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY pair.d2, t_point_id) = 1")
def icp_correspondences(spark, sf):
    p = I.points(spark, sf)
    return IC.correspondences(p.where("cloud_id = 0"), p.where("cloud_id <> 0"), 3.0).select("point_id", "t_point_id", r6("d2"))


@query("surface_normals",
       f"{P}, t AS (SELECT point_id, x, y, 3e-1 * x + 2e-1 * y AS z, CAST(floor(x / 8e0) AS BIGINT) gx, CAST(floor(y / 8e0) AS BIGINT) gy FROM fx_points), s AS (SELECT unnest([-1, 0, 1]) AS s), "
       "w AS (SELECT x, y, z, gx + a.s AS gx, gy + b.s AS gy FROM t, s a, s b), "
       "k AS (SELECT t.point_id, count(*) AS k FROM t JOIN w USING (gx, gy) WHERE (t.x - w.x) * (t.x - w.x) + (t.y - w.y) * (t.y - w.y) + (t.z - w.z) * (t.z - w.z) < 64 GROUP BY 1) "
       "SELECT point_id, round(CASE WHEN k < 3 THEN 0e0 ELSE 3e-1 / sqrt(113e-2) END, 5) AS nx, round(CASE WHEN k < 3 THEN 0e0 ELSE 2e-1 / sqrt(113e-2) END, 5) AS ny, "
       "round(CASE WHEN k < 3 THEN 1e0 ELSE 1e0 / sqrt(113e-2) END, 5) AS nz FROM k")
def surface_normals(spark, sf):
    """Normals of all points laid on a sloping plane; the sign of a normal is free."""
    plane = I.points(spark, sf).withColumn("z", 0.3 * F.col("x") + 0.2 * F.col("y"))
    return IC.normals(plane, 8.0).select("point_id", *[F.round(F.abs(c), 5).alias(c) for c in ("nx", "ny", "nz")])


@query("align_from_picked_pairs", f"{P} SELECT point_id, true AS near FROM fx_points")
def align_from_picked_pairs(spark, sf):
    src, tgt = displaced(spark, sf), I.points(spark, sf)
    picks = src.where("z > 6").select("point_id", *[F.col(c).alias("s" + c) for c in "xyz"]).join(
        tgt.select("point_id", *[F.col(c).alias("t" + c) for c in "xyz"]), "point_id")
    placed = X.apply_matrix(src, IC.align_from_pairs(src, tgt, picks).matrix).select("point_id", *[F.col(c).alias("m" + c) for c in "xyz"])
    gap = sum((F.abs(F.col("m" + c) - F.col(c)) for c in "yz"), F.abs(F.col("mx") - F.col("x")))
    return tgt.join(placed, "point_id").select("point_id", (gap < 0.05).alias("near"))


@query("pick_similarity_and_recolour",
       f"{P} SELECT point_id, CAST(point_id % 256 AS SMALLINT) AS red, CAST(point_id * 3 % 256 AS SMALLINT) AS green FROM fx_points")
def pick_similarity_and_recolour(spark, sf):
    """A coloured copy of the cloud at another scale, placed by picks and refined: every point gets its own colour back."""
    tgt = I.points(spark, sf).select("point_id", "x", "y", "z")
    small = X.apply_matrix(tgt, np.linalg.inv(MOTION)).withColumns({c: F.col(c) / 2.0 for c in "xyz"})
    src = small.select("point_id", "x", "y", "z", *[(F.col("point_id") * k % 256).cast("short").alias(c) for c, k in (("red", 1), ("green", 3), ("blue", 7))])
    picks = src.select("point_id", *[F.col(c).alias("s" + c) for c in "xyz"]).join(tgt.select("point_id", *[F.col(c).alias("t" + c) for c in "xyz"]), "point_id")
    return jobs.manual_alignment(src, tgt, picks, 1.0)[0].select("point_id", "red", "green")


@query("coverage_by_neighbours",
       f"{P}, a AS (SELECT *, CAST(floor(x / 2e0) AS BIGINT) gx, CAST(floor(y / 2e0) AS BIGINT) gy FROM fx_points), o AS (SELECT unnest([-1, 0, 1]) AS o), "
       "b AS (SELECT c.candidate, x + c.d AS x, y, z FROM fx_points, (VALUES ('as it is', 0e0), ('shifted', 15e-1)) c(candidate, d)), "
       "w AS (SELECT candidate, x, y, z, CAST(floor(x / 2e0) AS BIGINT) + p.o AS gx, CAST(floor(y / 2e0) AS BIGINT) + q.o AS gy FROM b, o p, o q), "
       "h AS (SELECT DISTINCT candidate, point_id FROM a JOIN w USING (gx, gy) WHERE (a.x - w.x) * (a.x - w.x) + (a.y - w.y) * (a.y - w.y) + (a.z - w.z) * (a.z - w.z) <= 1), "
       "n AS (SELECT count(*) AS n_points FROM fx_points), c AS (SELECT DISTINCT candidate FROM b) "
       f"SELECT candidate, n_points, count(point_id) AS n_hit, {s6('count(point_id) / CAST(n_points AS DOUBLE)', 'coverage')} FROM c LEFT JOIN h USING (candidate), n GROUP BY candidate, n_points")
def coverage_by_neighbours(spark, sf):
    p = I.points(spark, sf).select("point_id", "x", "y", "z")
    got = NB.coverage_by_neighbour(p, p, {"as it is": (np.eye(3), np.zeros(3)), "shifted": (np.eye(3), np.array([1.5, 0.0, 0.0]))}, 1.0)
    return got.select("candidate", "n_points", "n_hit", r6("coverage"))


@query("deletion_with_count", f"{P} SELECT count(*) FILTER (WHERE z > 8) AS n_deleted, count(*) FILTER (WHERE z <= 8) AS n_kept FROM fx_points")
def deletion_with_count(spark, sf):
    p = I.points(spark, sf).withColumn("selected", F.col("z") > 8)
    left, seen = SE.delete_counted(p)
    n = left.count()
    return left.agg(F.max(F.lit(seen.get["n_deleted"])).alias("n_deleted"), F.max(F.lit(n)).alias("n_kept"))


@query("aligned_merge_written",
       f"{P} SELECT row_number() OVER (ORDER BY cloud_id, point_id) - 1 AS point_id, round(x, 2) + 0e0 AS x, round(y, 2) + 0e0 AS y FROM fx_points")
def aligned_merge_written(spark, sf):
    """Three maps, each a displaced copy of its part, placed by the known motion, merged, written and read again."""
    from ..sources.points import read_points

    register(spark)
    moved = X.apply_matrix(I.points(spark, sf), np.linalg.inv(MOTION))
    first = I.points(spark, sf).where("cloud_id = 0").unionByName(moved.where("cloud_id <> 0"))
    slots = spark.createDataFrame([(0, 0, True), (1, 1, True), (2, 2, True)], "cloud_id int, slot int, visible boolean")
    out = shared_folder(spark, "merged")
    jobs.merge_maps(first, slots, out, align=lambda s, t: IC.Fit(MOTION))
    return read_points(spark, out).select("point_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


# ------------------------------------------------------ messages and streams

MSG = I.with_sql("fx_messages")


def as_messages(spark, sf) -> DataFrame:
    """The event table as a recording: one binary point message per user and topic."""
    import pandas as pd

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from ..sources.encode import point_message

        pdf = pdf.sort_values("msg_seq")
        xyz = pdf[["x", "y", "z"]].to_numpy()
        return pd.DataFrame([(key[0], "sensor_msgs/msg/PointCloud2", int(pdf["msg_seq"].iloc[0]) * 1000, int(pdf["msg_seq"].iloc[0]), point_message(xyz))],
                            columns=["topic", "type", "ts", "msg_seq", "data"])

    rows = I.derived(spark, sf, "fx_messages").withColumn("batch", F.floor(F.col("msg_seq") / 500))
    # written once: the recording is read several times, as a bag on disk would be
    return cut(rows.groupBy("topic", "batch").applyInPandas(encode, RB.MESSAGES))


F32 = "CAST(CAST({c} AS FLOAT) AS DOUBLE)"


@query("bag_topics", f"{MSG} SELECT topic, 'sensor_msgs/msg/PointCloud2' AS type, count(DISTINCT floor(msg_seq / 500)) AS n FROM fx_messages GROUP BY topic")
def bag_topics(spark, sf):
    m = as_messages(spark, sf)
    return RB.bag_topics(m.select("topic", "type").distinct(), m)


@query("decode_messages", f"{MSG} SELECT topic, {s6(F32.format(c='x'), 'x')}, {s6(F32.format(c='y'), 'y')}, {s6(F32.format(c='z'), 'z')} FROM fx_messages")
def decode_messages(spark, sf):
    return RB.decode_clouds(as_messages(spark, sf)).select("topic", r6("x"), r6("y"), r6("z"))


LAST = "last AS (SELECT topic, max(floor(msg_seq / 500)) AS b FROM fx_messages GROUP BY topic)"


@query("latest_message_cloud", f"{MSG}, {LAST} SELECT {s6(F32.format(c='x'), 'x')}, {s6(F32.format(c='y'), 'y')} FROM fx_messages JOIN last USING (topic) "
       "WHERE topic = '/raw' AND floor(msg_seq / 500) = b")
def latest_message_cloud(spark, sf):
    return RB.bag_cloud(as_messages(spark, sf), "/raw", "last").select(r6("x"), r6("y"))


@query("all_messages_cloud", f"{MSG} SELECT row_number() OVER (ORDER BY msg_seq) - 1 AS point_id, {s6(F32.format(c='z'), 'z')} FROM fx_messages WHERE topic = '/cloud_registered'")
def all_messages_cloud(spark, sf):
    return RB.bag_cloud(as_messages(spark, sf), "/cloud_registered", "concat").select("point_id", r6("z"))


THIN = (f"{MSG}, f AS (SELECT topic, msg_seq, {F32.format(c='x')} AS x, {F32.format(c='y')} AS y, {F32.format(c='z')} AS z FROM fx_messages), "
        "v AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY topic, floor(x / 5e-1), floor(y / 5e-1), floor(z / 5e-1) ORDER BY msg_seq) = 1)")


@query("map_from_messages", f"{THIN} SELECT {s6('x', 'x')}, {s6('y', 'y')}, {s6('z', 'z')} FROM v WHERE topic = '/cloud_registered'")
def map_from_messages(spark, sf):
    return RB.bag_cloud(as_messages(spark, sf), "/cloud_registered", "map", 0.5).select(r6("x"), r6("y"), r6("z"))


def _run_stream(spark, sf, build, mode: str, columns) -> DataFrame:
    """Write the recording down as files, stream it and return what the stream holds at the end."""
    folder = shared_folder(spark, "stream")
    as_messages(spark, sf).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    return ST.run_to_table(build(ST.message_stream(spark, f"{folder}/in")), folder, mode).select(*columns)


@query("streamed_map_cells", f"{THIN} SELECT topic, CAST(floor(x / 5e-1) AS BIGINT) AS vx, CAST(floor(y / 5e-1) AS BIGINT) AS vy, CAST(floor(z / 5e-1) AS BIGINT) AS vz FROM v")
def streamed_map_cells(spark, sf):
    return _run_stream(spark, sf, lambda m: ST.map_from_messages(m, 0.5), "append", ["topic", "vx", "vy", "vz"])


@query("streamed_progress", f"{MSG} SELECT topic, count(*) AS n_points, count(DISTINCT floor(msg_seq / 500)) AS n_messages FROM fx_messages GROUP BY topic")
def streamed_progress(spark, sf):
    return _run_stream(spark, sf, ST.progress_stream, "complete", ["topic", "n_points", "n_messages"])


@query("streamed_map_with_watermark", f"{THIN} SELECT topic, count(*) AS n FROM v GROUP BY topic")
def streamed_map_with_watermark(spark, sf):
    """With a watermark longer than the recording late messages change nothing."""
    def build(m):
        timed = RB.decode_clouds(m).withColumn("at", F.timestamp_micros(F.col("ts") + F.lit(10**15)))   # a stream counts time zero itself as late
        return ST.map_stream(timed, 0.5, ("topic",), "at", "30 days")

    return _run_stream(spark, sf, build, "append", ["topic"]).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("streamed_latest", f"{MSG}, f AS (SELECT topic, min(msg_seq) AS first FROM fx_messages GROUP BY topic, floor(msg_seq / 500)) "
       "SELECT topic, max(first) * 1000 AS ts, max(first) AS msg_seq FROM f GROUP BY topic")
def streamed_latest(spark, sf):
    return _run_stream(spark, sf, ST.latest_stream, "complete", ["topic", "ts", "msg_seq"])


# ------------------------------------------------------------------- files

@query("telemetry_text", f"{I.with_sql('fx_telemetry')} SELECT round(t, 3) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon, round(rel_alt, 3) AS rel_alt FROM fx_telemetry")
def telemetry_text(spark, sf):
    t = I.derived(spark, sf, "fx_telemetry")
    ms = F.rint(F.col("t") * 1000).cast("long")
    cue = F.format_string("%02d:%02d:%02d,%03d --> x", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    block = F.format_string("1\n%s\n[latitude: %.6f] [longitude: %.6f] [rel_alt: %.3f abs_alt: 1]", cue, "lat", "lon", "rel_alt")
    broken = t.select(F.concat(cue, F.lit("\n[latitude: 1]")).alias("value"))
    return TX.parse_telemetry(t.select(block.alias("value")).unionByName(broken)).select(
        F.round("t", 3).alias("t"), r6("lat"), r6("lon"), F.round("rel_alt", 3).alias("rel_alt"))


def _written(spark, sf, kind: str) -> DataFrame:
    from ..sources.points import write_cloud

    register(spark)
    path = shared_folder(spark, "out") + "/cloud"
    p = I.points(spark, sf).withColumns({c: (F.col("point_id") * k % 256).cast("short") for c, k in (("red", 1), ("green", 3), ("blue", 7))})
    write_cloud(p.drop("intensity") if kind == "ply" else p.withColumn("intensity", F.coalesce("intensity", F.lit(-1.0))).drop("red", "green", "blue"), path, kind)
    return spark.read.format(kind).load(path)


@query("ply_write_and_read", f"{P} SELECT {s6(F32.format(c='x'), 'x')}, {s6(F32.format(c='y'), 'y')}, {s6(F32.format(c='z'), 'z')}, "
       "CAST(point_id % 256 AS SMALLINT) AS red, CAST(point_id * 7 % 256 AS SMALLINT) AS blue FROM fx_points")
def ply_write_and_read(spark, sf):
    return _written(spark, sf, "ply").select(r6("x"), r6("y"), r6("z"), "red", "blue")


@query("pcd_write_and_read", f"{P} SELECT {s6(F32.format(c='x'), 'x')}, {s6(F32.format(c='y'), 'y')}, {s6(F32.format(c='z'), 'z')}, "
       f"{s6('CAST(CAST(coalesce(intensity, -1) AS FLOAT) AS DOUBLE)', 'intensity')} FROM fx_points")
def pcd_write_and_read(spark, sf):
    return _written(spark, sf, "pcd").select(r6("x"), r6("y"), r6("z"), r6(F.col("intensity").cast("double"), "intensity"))


@query("clouds_in_many_files", f"{P} SELECT row_number() OVER (ORDER BY cloud_id, point_id) - 1 AS point_id, {s6(F32.format(c='x'), 'x')}, {s6(F32.format(c='y'), 'y')}, "
       "CASE WHEN cloud_id = 1 THEN CAST(point_id % 256 AS SMALLINT) END AS red FROM fx_points")
def clouds_in_many_files(spark, sf):
    """A folder with a file per cloud, in both formats, read as one dataset with one running point_id."""
    from ..sources.points import read_points, write_cloud

    register(spark)
    folder = shared_folder(spark, "clouds")
    p = I.points(spark, sf).withColumns({c: (F.col("point_id") % 256).cast("short") for c in ("red", "green", "blue")})
    make_folder(folder)
    for cloud, kind in ((0, "pcd"), (1, "ply"), (2, "pcd")):
        one = p.where(F.col("cloud_id") == cloud)
        write_cloud(one if kind == "ply" else one.drop("red", "green", "blue", "intensity"), f"{folder}/{cloud}.{kind}", kind, single=True)
    return read_points(spark, folder).select("point_id", r6("x"), r6("y"), F.col("red").cast("short").alias("red"))


@query("model_text_round_trip", f"{I.with_sql('fx_cameras')} SELECT cam_id, name, {s6('c_x', 'cx')}, {s6('c_y', 'cy')}, {s6('c_z', 'cz')} FROM fx_cameras")
def model_text_round_trip(spark, sf):
    folder = shared_folder(spark, "model")
    pts = I.points(spark, sf).select(F.col("point_id").alias("pid"), "x", "y", "z", *[F.lit(k).cast("short").alias(c) for c, k in
                                     (("red", 1), ("green", 2), ("blue", 3))], F.lit(0.5).alias("err"))
    TX.write_model(I.cameras(spark, sf).withColumn("camera_no", F.lit(1)), pts, folder)
    return TX.read_model(spark, folder)[0].select("cam_id", "name", *[r6(F.col(f"c.{a}"), "c" + a) for a in "xyz"])


@query("stage_tables_reused", f"{P} SELECT cloud_id, count(*) AS n, {s6('min(x)', 'lo')}, {s6('max(z)', 'hi')} FROM fx_points GROUP BY cloud_id")
def stage_tables_reused(spark, sf):
    """A second run over the same folder reads both stages: what it would build now, an empty cloud, is never written."""
    work, cloud = shared_folder(spark, "stages"), I.points(spark, sf)
    for source in (cloud, cloud.where("false")):
        kept = TX.stage(spark, work, "cloud", lambda source=source: source)
        out = TX.stage(spark, work, "extents", lambda kept=kept: kept.groupBy("cloud_id").agg(
            F.count(F.lit(1)).alias("n"), r6(F.min("x"), "lo"), r6(F.max("z"), "hi")))
    return out


@query("geotag_json_round_trip", f"{I.with_sql('fx_geotags')} SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon, rel_alt FROM fx_geotags")
def geotag_json_round_trip(spark, sf):
    lines = TX.geotag_json(I.derived(spark, sf, "fx_geotags"))
    tags = lines.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "v"))
    return tags.select("name", r6(F.col("v")[0], "lat"), r6(F.col("v")[1], "lon"), F.col("v")[2].alias("rel_alt"))
