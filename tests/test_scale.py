"""Plans and steps that must hold on larger tables."""

import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from stratopoint.operators import align as AL
from stratopoint.operators import colouring as C
from stratopoint.operators import consistency as CC
from stratopoint.operators import matching as MT
from stratopoint.operators import neighbours as NB
from stratopoint.operators import raster as R
from stratopoint.operators import select as S
from stratopoint.plans import inputs as I


def joins(df):
    return re.findall(r"\w*Join\b", df._jdf.queryExecution().executedPlan().toString())


def test_rasters_are_not_broadcast(spark, sf):
    cams = I.cameras(spark, sf)
    hits = spark.range(5).selectExpr("id AS point_id", "CAST(id AS INT) AS cam_id", "1.5D AS u", "2.5D AS v")
    for df in (C.sample_images(hits, I.images(cams)), C.sample_values(hits, I.thermal(cams))):
        assert set(joins(df)) == {"SortMergeJoin"}


def test_pixels_of_views_are_made_beside_their_image(spark, sf):
    cams = I.cameras(spark, sf).limit(2)
    got = R.panorama_pixels(I.images(cams), out=8)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()       # a row per pixel would be shuffled
    assert got.count() == cams.count() * 6 * 64


def test_consistency_makes_no_row_per_view(spark, sf, monkeypatch):
    """Against the views as rows: points and cameras that come twice, a camera without an image, a stray point."""
    p = I.points(spark, sf)
    p = p.union(p.limit(7)).union(p.limit(1).withColumns({"x": F.lit(1e7), "point_id": F.lit(-1).cast("long")}))
    cams = I.cameras(spark, sf)
    cams = cams.union(cams.where("cam_id = 1"))
    cams = cams.withColumns({"model": F.lit("OPENCV"), "params": F.expr("array(125D, 120D, 80D, 64D, 0.01D, -0.002D, 0.001D, -0.0005D)")})
    images = I.images(cams.where("cam_id <> 2")).localCheckpoint()
    sd = [F.stddev_pop(F.col(c) / 255.0) for c in ("red", "green", "blue")]
    views = C.sample_images(C.seen_by(p, cams), images).groupBy("point_id").agg(F.count("*").alias("views"), ((sd[0] + sd[1] + sd[2]) / 3).alias("sd"))
    want = {r.point_id: (r.views, r.sd) for r in views.where("views >= 2").collect()}
    monkeypatch.setattr(C, "seen_by", None)
    for deep, tile in ((C.CONSISTENCY_POINTS, C.TILE_POINTS), (16, 5)):
        monkeypatch.setattr(C, "CONSISTENCY_POINTS", deep)
        monkeypatch.setattr(C, "TILE_POINTS", tile)
        got = {r.point_id: (r.views, r.sd) for r in C.color_consistency(p, cams, images).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_images_that_overlap_much_are_not_sent_to_tiles(spark, sf, monkeypatch):
    p, cams = I.points(spark, sf), I.cameras(spark, sf)
    monkeypatch.setattr(C, "_patches", None)
    assert C.color_consistency(p, cams, I.images(cams)).count() > 0


def test_colours_summed_beside_their_image_are_those_of_patches(spark, sf, monkeypatch):
    """Images too short, too small, without data, twice or missing; points without an id or a place, twice, and a stray; cameras
    without an id; several rounds, writes and blocks, and images too large for a table."""
    p = I.points(spark, sf)
    odd = [p.limit(7), p.limit(5).withColumn("point_id", F.lit(None).cast("long")), p.limit(1).withColumn("x", F.lit(1e7)),
           p.limit(1).withColumn("z", F.lit(-np.inf)), p.limit(1).withColumn("y", F.lit(np.nan))]
    for more in odd:
        p = p.union(more)
    cams = I.cameras(spark, sf)
    cams = cams.union(cams.where("cam_id = 1")).union(cams.where("cam_id = 3").withColumn("cam_id", F.lit(None).cast("int")))
    cams = cams.withColumn("params", F.expr("CASE cam_id % 3 WHEN 0 THEN array(125D, 80D, 64D, 0D) ELSE params END"))
    images = I.images(cams.where("cam_id <> 2 AND cam_id IS NOT NULL"))
    data = F.expr("CASE cam_id % 4 WHEN 0 THEN substring(data, 1, 30001) WHEN 3 THEN NULL ELSE data END")
    images = images.select("cam_id", F.expr("IF(cam_id = 5, 90, height)").alias("height"), F.expr("IF(cam_id = 5, 150, width)").alias("width"), "n_channels", data.alias("data"))
    images = images.localCheckpoint()

    def sums():
        return sorted(map(tuple, C.color_consistency(p, cams, images).fillna(-7, ["point_id"]).collect()))

    monkeypatch.setattr(C, "_patches_outweigh", lambda *_: False)
    want = sums()
    monkeypatch.setattr(C, "_patches_outweigh", lambda *_: True)
    assert sums() == want and len(want) > 200
    for module, name, value in ((CC, "ROUND_POINTS", 300), (CC, "BROADCAST_CAMERAS", 0), (C, "CONSISTENCY_POINTS", 16)):
        monkeypatch.setattr(module, name, value)
    assert sums() == want


def test_colour_sums_do_not_depend_on_tables_or_writes(spark, sf, monkeypatch, tmp_path):
    """Images too large for a table of addends, and sums written before their lanes are full."""
    cams = I.cameras(spark, sf)
    both = C.into_target_frame(cams).join(I.images(cams), F.col("camera.cam_id") == F.col("cam_id")).select(
        "camera", F.col("width").alias("iw"), F.col("height").alias("ih"), "data").toArrow().to_batches()
    tiles = CC.write_tiles(I.points(spark, sf).selectExpr("point_id", "x", "y", "z", "0L AS cell", "0L AS piece"), str(tmp_path)).collect()
    found = []
    for pixels, most in ((CC.TABLE_PIXELS, CC.MOST_VIEWS), (0, 2)):
        monkeypatch.setattr(CC, "TABLE_PIXELS", pixels)
        monkeypatch.setattr(CC, "MOST_VIEWS", most)
        parts = [r for b in CC._colour_sums(CC._Tiles(tiles), str(tmp_path))(both) for r in b.to_pylist() if r["path"]]
        assert (len(parts) > 1) == (most == 2)
        row = {"n": tiles[0]["n"], "path": tiles[0]["path"], "parts": parts}
        found.append(pa.Table.from_batches(CC._unpacked([pa.RecordBatch.from_pylist([row])])))
    assert found[0].equals(found[1]) and found[0].num_rows > 200


def test_all_views_past_a_broadcast(spark, monkeypatch):
    """Against brute force: cells stay those of the first level; points and cameras that come twice, a stray, points without a place or id."""
    rng = np.random.default_rng(11)
    xyz = rng.uniform(-60, 60, (20_000, 3)) * [1, 1, 0.1]
    xyz[100:200] = xyz[:100]
    xyz[200:205] = [[1e7, 0, 0], [np.nan, 0, 0], [0, np.inf, 0], [0, 0, -np.inf], [0, 0, np.nan]]
    spots = np.vstack([rng.uniform(-60, 60, (40, 3)) * [1, 1, 0] + [0, 0, 30], [[1e7, 0, 30]]])
    spots = np.vstack([spots, spots[:2]])
    ids = np.append(np.arange(41), [0, 1])
    r = np.diag([1.0, -1.0, -1.0])
    cams = spark.createDataFrame(
        [(int(i), f"n{i}", r.ravel().tolist(), (-r @ c).tolist(), tuple(map(float, c)), 160, 128, "SIMPLE_PINHOLE", [125.0, 80.0, 64.0]) for i, c in zip(ids, spots)],
        "cam_id int, name string, r array<double>, t array<double>, c struct<x:double,y:double,z:double>, width int, height int, model string, params array<double>")
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz)) // 2, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
    df = df.withColumn("point_id", F.when(F.col("point_id") != 7, F.col("point_id"))).union(
        spark.createDataFrame([(-1, None, 0.0, 0.0)], "point_id long, x double, y double, z double"))
    want = []
    with np.errstate(invalid="ignore"):
        for i, c in zip(ids, spots):
            u, v = 125 * (xyz[:, 0] - c[0]) / (c[2] - xyz[:, 2]) + 80, 125 * (c[1] - xyz[:, 1]) / (c[2] - xyz[:, 2]) + 64
            at = np.flatnonzero((xyz[:, 2] < c[2] - 1e-6) & (u >= 0) & (u < 160) & (v >= 0) & (v < 128) & np.isfinite(xyz).all(1))
            want.append(np.column_stack([np.where(at // 2 == 7, -7, at // 2), np.full(len(at), i), u[at], v[at]]))
    want = np.concatenate(want)
    assert (want[:, 1] == 40).sum() == 1 and (want[:, 0] == -7).any()
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert C.CellCameras(df, cams, None, 0.0, best_only=False).grid.depth == 3          # 20,000 points would allow 4
    for held, tile in ((C.CELL_CAMERAS, C.TILE_POINTS), (4, 100)):
        monkeypatch.setattr(C, "CELL_CAMERAS", held)
        monkeypatch.setattr(C, "TILE_POINTS", tile)
        got = C.seen_by(df, cams).select(F.coalesce("point_id", F.lit(-7)), "cam_id", "u", "v").toPandas().to_numpy(float)
        assert len(got) == len(want)
        got, sure = (a[np.lexsort(a.round(6).T[::-1])] for a in (got, want))
        assert np.abs(got - sure).max() < 1e-6


def test_every_view_of_halved_boxes(monkeypatch):
    rng = np.random.default_rng(3)
    p, spots = rng.uniform(-40, 40, (300, 3)) * [1, 1, 0.1], rng.uniform(-40, 40, (50, 2))
    c = {k: np.zeros(50) for k in (*C.CAMERA_FIELDS, *C.cam.OPTICS)}
    c |= {"cam_id": np.arange(50), "m0": np.ones(50), "m4": -np.ones(50), "m8": -np.ones(50), "t0": -spots[:, 0], "t1": spots[:, 1], "t2": np.full(50, 20.0)}
    c |= {"width": np.full(50, 160), "height": np.full(50, 128), "fx": np.full(50, 125.0), "fy": np.full(50, 125.0), "cx": np.full(50, 80.0), "cy": np.full(50, 64.0)}
    found = []
    for pairs, block in ((C.PAIRS, C.TILE_BLOCK), (64, 4)):
        monkeypatch.setattr(C, "PAIRS", pairs)
        monkeypatch.setattr(C, "TILE_BLOCK", block)
        pieces = list(C._every_view(c, C._view_planes(c, 0.0), p, 0.0))
        assert max(len(x[0]) for x in pieces) <= pairs
        rows = np.column_stack([np.concatenate(a) for a in zip(*pieces)])
        found.append(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
    xn, yn = ((p[:, None, 0] - spots[:, 0]) / (20 - p[:, None, 2]), (spots[:, 1] - p[:, None, 1]) / (20 - p[:, None, 2]))
    want = np.argwhere((125 * xn + 80 >= 0) & (125 * xn + 80 < 160) & (125 * yn + 64 >= 0) & (125 * yn + 64 < 128))
    assert len(want) > 200 and all((f[:, :2] == want).all() for f in found) and (found[0] == found[1]).all()


def test_picks_meet_few_points(spark):
    """Many points on a small screen, as a dense cloud has: picks equal brute force and open few cells."""
    rng = np.random.default_rng(5)
    xyz = rng.random((20_000, 3)) * [60.0, 40.0, 3.0]
    xyz[:400, :2] = np.floor(xyz[:400, :2])                       # on the borders of cells
    xyz[400:500] = xyz[300:400]                                   # copies
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2],
                                             "sx": xyz[:, 0], "sy": xyz[:, 1], "sz": 0.0}))
    spots = np.vstack([rng.random((30, 2)) * [80.0, 60.0] - 10.0, [[5.0, 5.0], [-15.5, 20.0], [1e6, 0.0]]])
    picks = spark.createDataFrame(pd.DataFrame({"pick_id": np.arange(len(spots)) // 2, "sx": spots[:, 0], "sy": spots[:, 1]}))
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, -1.0, 10.0]      # w = 10 - z
    d2 = ((spots[:, None] - xyz[None, :, :2]) ** 2).sum(2)
    front = S.pick_front(df, picks, eye)
    near = S._pick(df, picks, F.col("d2"), F.lit(True), 10.0, True)
    for got, score, reach in ((near, d2, 100.0), (front, np.broadcast_to(10.0 - xyz[:, 2], d2.shape), 256.0)):
        want = {}
        for i in range(len(spots)):
            for k in np.flatnonzero(d2[i] <= reach):
                want[i // 2] = min(want.get(i // 2, (np.inf, 0)), (score[i, k], k))
        assert {r.pick_id: (round(r.score, 9), r.point_id) for r in got.collect()} == {k: (round(v[0], 9), v[1]) for k, v in want.items()}


def test_winners_of_a_task_meet_before_the_shuffle(spark):
    n = 40_000                                                    # four batches of one task onto six pixels
    df = spark.range(0, n, 1, 1).select(F.lit(0).alias("frame"), (F.col("id") % 2).alias("v"), (F.col("id") % 3).alias("u"), F.col("id").alias("point_id"),
                                        (-(F.col("id") % 1000)).cast("double").alias("depth"), *[F.lit(1).alias(c) for c in ("red", "green", "blue")], F.lit(0).alias("no"))
    got = R.nearest_per_pixel(df, False)
    assert {(r.v, r.u): r.point_id for r in got.collect()} == {(i % 2, i % 3): min(range(n), key=lambda k: (-(k % 1000) if (k % 2, k % 3) == (i % 2, i % 3) else 1, k)) for i in range(6)}
    assert R.thinned_per_pixel(df, False).count() == 6


def crowd(spark, n=3000):
    """A flat cloud with a dense spot, copies, repeated ids and a stray point."""
    rng = np.random.default_rng(8)
    xyz = np.round(np.vstack([rng.random((n, 3)) * [40.0, 30.0, 4.0], rng.random((n // 3, 3)) * [2.0, 2.0, 1.0] + [10.0, 10.0, 1.0]]), 2)
    xyz = np.vstack([xyz, xyz[:50], [[1e6, 0.0, 0.0]]])
    ids = np.arange(len(xyz))
    return xyz, spark.createDataFrame(pd.DataFrame({"point_id": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


def test_neighbours_are_summed_at_home(spark, monkeypatch):
    """Means equal brute force, and the neighbours of queries that end at home are never written as rows."""
    monkeypatch.setattr(NB, "PART", 1000)
    xyz, df = crowd(spark)
    d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), 1)
    seen = []
    monkeypatch.setattr(NB, "cut", lambda frame, cut=NB.cut: seen.append(cut(frame)) or seen[-1])
    got = {r.point_id: r.mean_d for r in NB.mean_distances(df, 12).collect()}
    assert all(abs(got[i] - d[i, :12].mean()) < 1e-9 for i in range(len(xyz)))
    home = next(f for f in seen if "payload" in f.columns)
    final = home.where(F.col("kind") == NB.FINAL).selectExpr("sum(n) AS n", "sum(length(payload)) AS b").first()
    assert final.n > 2000 and final.b == 32 * final.n             # four numbers a query, not eight a neighbour
    near = {r.point_id: r.mean_d for r in NB.mean_nn_distance(df, 4).collect()}
    assert all(abs(near[i] - max(d[i, 1:4].mean(), 1e-4)) < 1e-9 for i in range(len(xyz)))


def test_few_queries_leave_a_part_and_far_boxes_are_not_looked_at(spark, monkeypatch):
    """Counts with and without an end equal brute force; a count that is high enough asks no other part."""
    monkeypatch.setattr(NB, "PART", 500)
    xyz, df = crowd(spark)
    n = (((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 9.0).sum(1)
    assert {r.point_id: r.n for r in NB.radius_count(df, df, 3.0).collect()} == dict(enumerate(n.tolist()))
    ended = {r.point_id: r.n for r in NB.radius_count(df, df, 3.0, 40).collect()}
    assert all(ended[i] == c if c < 40 else 40 <= ended[i] <= c for i, c in enumerate(n.tolist()))
    assert {r.point_id for r in NB.radius_outlier(df, 60, 3.0).collect()} == set(np.flatnonzero(n > 60).tolist())
    boxes = NB.Boxes(np.array([3, 5]), np.array([2, 2]), np.array([2, 2]), np.array([0, 0, 1]), np.array([[0.0, 0, 0], [5, 0, 0], [90, 0, 0]]), np.array([[1.0, 1, 1], [6, 1, 1], [91, 1, 1]]))
    spot = np.array([2.0, 0.0, 0.0])
    assert boxes.near(spot, spot, 9.0).tolist() == [0, 1] and boxes.near(spot, spot, 9.0, [3]).tolist() == [] and boxes.near(spot, spot, 1e9).tolist() == [0, 1, 2]


def test_poses_are_scored_without_a_row_per_pose(spark, sf, monkeypatch):
    """Sums in tasks equal the join, with a raster and with sorted cells, nulls and points off the surface included."""
    target = I.derived(spark, sf, "fx_surface")
    model = target.select("x", "y", "z").union(spark.createDataFrame([(None, 1.0, 1.0), (5.0, 5.0, None), (1e7, 0.0, 0.0)], "x double, y double, z double"))
    poses = [(0.0, 0.0, 0.0, 0.0), (0.01, 0.3, -0.2, 0.1), (3.0, 100.0, 100.0, 0.0)]
    for dense in (AL.DENSE_CELLS, 10):
        monkeypatch.setattr(AL, "DENSE_CELLS", dense)
        s = AL.Surface(target)
        assert s.small
        got, want = ({r.pose: (r.n, r.m, round(r.s, 9)) for r in f(model, poses, 0.5)} for f in (s._sums_by_task, s._sums_by_join))
        assert got == want
    seen = []
    monkeypatch.setattr(AL.Surface, "_sums_by_join", lambda *a: seen.append(a))
    assert s.scores(model, 1000, poses, 0.5)[0] > 0.9 and not seen


def test_a_search_drops_what_it_replaces(spark):
    """While poses move far only the match is kept, then eight; sums equal brute force, and old tables are gone."""
    rng = np.random.default_rng(3)
    t = rng.random((3000, 3)) * [30.0, 30.0, 3.0]
    s = t[:200] + 0.01
    table = lambda p: spark.createDataFrame(pd.DataFrame(np.column_stack([np.arange(len(p)), p]), columns=["point_id", *"xyz"]))
    m, folders, kept = MT.Matches(table(s), MT.Target(table(t))), set(), []
    for shift in (0.0, 5.0, 9.0, 9.001, 9.002):
        pose = np.eye(4)
        pose[0, 3] = shift
        got = m.sums({0: pose}, 2.0, "point")[0]
        d2 = (((s + [shift, 0, 0])[:, None] - t) ** 2).sum(2).min(1)
        assert got["n"] == (d2 < 4.0).sum() and np.isclose(got["d2"], d2[d2 < 4.0].sum())
        folders |= set(m.written.folders)
        kept.append(m.kept)
    assert kept[:3] == [MT.KEPT, 1, 1] and kept[3:] == [MT.KEPT] * 2
    assert m.searched == 4 and {f for f in folders if Path(f.removeprefix("file:")).exists()} == set(m.written.folders)
