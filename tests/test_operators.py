import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratopoint.functions import camera as cam
from stratopoint.functions import linear as la
from stratopoint.operators import colouring as C
from stratopoint.operators import edit as E
from stratopoint.operators import estimate as T
from stratopoint.operators import grid as G
from stratopoint.operators import neighbours as N
from stratopoint.operators import raster as R
from stratopoint.operators import transform as X
from stratopoint.operators.percentiles import quantiles
from stratopoint.plans import inputs as I


def make(spark, xyz, **more):
    pdf = pd.DataFrame({"point_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more})
    return spark.createDataFrame(pdf).repartition(4).persist()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one spot, a third in a tight clump, the rest spread widely."""
    rng = np.random.default_rng(3)
    spot = np.tile([[5.0, 5.0, 1.0]], (250, 1))
    clump = rng.normal([20.0, -10.0, 2.0], 1e-2, (250, 3))
    wide = rng.uniform(-100, 100, (250, 3)) * [1, 1, 0.1]
    xyz = np.vstack([spot, clump, wide])
    return xyz, make(spark, xyz)


def brute(q, p):
    return ((q[:, None] - p[None]) ** 2).sum(-1)


def small_parts(monkeypatch):
    for name, value in (("PART", 60), ("LEAF", 8), ("UNIT", 16), ("ASKED", 2)):
        monkeypatch.setattr(N, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_knn_equals_brute_force_under_skew(spark, skewed, monkeypatch, small):
    xyz, df = skewed
    if small:
        small_parts(monkeypatch)
    got = N.knn_join(df, df, 6).toPandas().sort_values(["point_id", "rank"])
    assert len(got) == 6 * len(xyz)
    d2 = brute(xyz, xyz)
    order = np.lexsort((np.broadcast_to(np.arange(len(xyz)), d2.shape), d2), axis=1)[:, :6]
    assert (got["neighbour"].to_numpy().reshape(-1, 6) == order).all()
    assert np.allclose(got["distance2"].to_numpy().reshape(-1, 6), np.take_along_axis(d2, order, 1))


@pytest.mark.parametrize("small", [False, True])
def test_nearest_between_sets_and_radius_rule(spark, skewed, monkeypatch, small):
    xyz, df = skewed
    if small:
        small_parts(monkeypatch)
    q = np.random.default_rng(4).uniform(-120, 120, (100, 3)) * [1, 1, 0.2]
    q[0] = [5.0, 5.0, 3.0]          # exactly 2 away from the crowded spot
    qdf = make(spark, q)
    d = brute(q, xyz)
    free = N.knn_join(qdf, df, 1).toPandas().set_index("point_id")
    assert (free.loc[range(100), "neighbour"].to_numpy() == d.argmin(1)).all()
    near = N.knn_join(qdf, df, 1, 2.0).toPandas()
    assert set(near["point_id"]) == set(np.flatnonzero(d.min(1) < 4.0)) and 0 not in set(near["point_id"])
    n = N.radius_count(qdf, df, 25.0).toPandas().set_index("point_id")["n"]
    assert (n.loc[range(100)].to_numpy() == (d <= 625.0).sum(1)).all()


def test_queries_far_from_all_points(spark, monkeypatch):
    """Parts with queries and no points ask the nearest part first; all of them ask the same one, which is repeated."""
    small_parts(monkeypatch)
    rng = np.random.default_rng(8)
    p, q = rng.uniform(0, 10, (300, 3)), rng.uniform(0, 10, (400, 3)) + [500.0, 0, 0]
    got = N.knn_join(make(spark, q), make(spark, p), 3, offsets=True).toPandas().sort_values(["point_id", "rank"])
    d2 = brute(q, p)
    assert (got["neighbour"].to_numpy().reshape(-1, 3) == np.argsort(d2, 1)[:, :3]).all()
    assert np.allclose(got[["dx", "dy", "dz"]].to_numpy(), p[got["neighbour"]] - q[got["point_id"]])
    count = N.radius_count(make(spark, q), make(spark, p), 505.0).toPandas().set_index("point_id")["n"]
    assert (count.loc[range(400)].to_numpy() == (d2 <= 505.0 ** 2).sum(1)).all()


def test_fewer_points_than_neighbours_and_empty_sides(spark, monkeypatch):
    small_parts(monkeypatch)
    q, p = make(spark, np.random.default_rng(1).uniform(0, 1, (200, 3))), make(spark, np.array([[0.0, 0, 0], [1, 1, 1], [1, 1, 1]]))
    assert N.knn_join(q, p, 5).groupBy("point_id").count().where("count = 3").count() == 200
    none = p.where("false")
    assert N.knn_join(q, none, 2).count() == 0 and N.knn_join(none, q, 2).count() == 0
    assert {r["n"] for r in N.radius_count(q, none, 1.0).collect()} == {0} and N.radius_count(none, q, 1.0).count() == 0


def test_outlier_rules(spark, skewed):
    xyz, df = skewed
    d = np.sqrt(np.sort(brute(xyz, xyz), 1)[:, :20]).mean(1)
    ok = d[d > 0]
    keep = np.flatnonzero((d > 0) & (d < ok.mean() + ok.std(ddof=1)))
    got = {r[0] for r in N.statistical_outlier(df, 20, 1.0).select("point_id").collect()}
    assert got == set(keep)


def test_quantiles_match_numpy(spark, skewed):
    xyz, df = skewed
    big = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("w", F.col("x") + F.col("k") * 0.37)
    w = (xyz[:, :1] + np.arange(10) * 0.37).ravel()
    qs = [0.0, 0.02, 0.33, 0.5, 0.975, 1.0]
    got = quantiles(big, {"w": qs, "x": [0.5]})
    assert np.allclose(got["w"], np.quantile(w, qs), rtol=0, atol=1e-12) and got["x"] == [float(np.median(xyz[:, 0]))]
    low = quantiles(big, {"w": [0.02, 0.98]}, "floor")["w"]
    assert low == [float(np.sort(w)[math.floor((len(w) - 1) * q)]) for q in (0.02, 0.98)]
    assert math.isnan(quantiles(df.where("x > 1e9"), {"x": [0.5]})["x"][0])


@pytest.mark.parametrize("model,params", [
    ("SIMPLE_PINHOLE", [90.0, 80.0, 64.0]), ("PINHOLE", [90.0, 95.0, 80.0, 64.0]), ("RADIAL", [90.0, 80.0, 64.0, -0.25, 0.02]),
    ("OPENCV", [90.0, 95.0, 80.0, 64.0, -0.2, 0.03, 0.002, -0.001])])
@pytest.mark.parametrize("lists", [False, True])
def test_best_camera_any_pose_equals_brute_force(spark, model, params, lists, monkeypatch):
    """Tilted cameras, folding distortion and a similarity: no footprint may lose a view."""
    rng = np.random.default_rng(7)
    xyz = rng.uniform(-60, 60, (400, 3)) * [1, 1, 0.2]
    df = make(spark, xyz)
    s, turn, shift = 2.5, la.euler_zyx(3.0, -4.0, 30.0), np.array([4.0, -3.0, 1.0])
    rows, poses = [], []
    for k in range(12):
        r = la.euler_zyx(180.0 + rng.uniform(-60, 60), rng.uniform(-40, 40), rng.uniform(0, 360))
        c = rng.uniform(-20, 20, 3) * [1, 1, 0] + [0, 0, 14.0]
        t = -r @ c
        poses.append((r, t))
        rows.append((k, f"n{k}", r.ravel().tolist(), t.tolist(), tuple(map(float, c)), 160, 128, model, params))
    cams = spark.createDataFrame(rows, "cam_id int, name string, r array<double>, t array<double>, c struct<x:double,y:double,z:double>, "
                                       "width int, height int, model string, params array<double>")
    if lists:
        monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(C, "CELL_CAMERAS", 3)
    got = C.best_camera(df, cams, (s * turn, shift)).toPandas().sort_values("point_id")
    every = {(r[0], r[1]) for r in C.seen_by(df, cams, (s * turn, shift)).select("point_id", "cam_id").collect()}
    o = dict(zip(cam.OPTICS, (0.0,) * 8))
    o.update({"fx": params[0], "fy": params[1] if model in ("PINHOLE", "OPENCV") else params[0]})
    names = cam.MODEL_PARAMS[model]
    o.update({n: v for n, v in zip(names, params) if n != "f"})
    p = (xyz - shift) @ turn / s
    best, who, want = np.full(len(p), np.inf), np.full(len(p), -1), set()
    for k, (r, t) in enumerate(poses):
        pc = p @ r.T + t
        front = pc[:, 2] > 1e-6
        z = np.where(front, pc[:, 2], 1.0)
        u, v, rad = cam.distort_arrays(o, pc[:, 0] / z, pc[:, 1] / z)
        ok = front & (u >= 0) & (u < 160) & (v >= 0) & (v < 128)
        want |= {(int(i), k) for i in np.flatnonzero(ok)}
        better = ok & (rad < best - 1e-12)
        best[better], who[better] = rad[better], k
    assert every == want and len(want) > 50
    assert (got["cam_id"].fillna(-1).to_numpy() == who).all()


def test_unknown_camera_model_raises(spark, sf):
    cams = I.cameras(spark, sf).withColumn("model", F.lit("FISHEYE"))
    with pytest.raises(Exception, match="unsupported camera model"):
        C.best_camera(I.points(spark, sf), cams).count()


# The picked pairs of the published manual alignment.
PICKS = [
    (-7.516286373138428, 7.799463272094727, 2.4146525859832764, -98.89749145507812, -11.646440505981445, 1.4769796133041382),
    (-1.2945468425750732, 11.85116958618164, 2.841815233230591, -95.79180145263672, 0.35912656784057617, 3.301136016845703),
    (2.8025243282318115, 3.1770741939544678, 5.189945220947266, -104.45699691772461, -6.4865100383758545, 1.391040325164795),
    (-5.834280490875244, -5.668169021606445, 2.1537458896636963, -86.18738555908203, -6.931923866271973, 0.6860355138778687)]


def test_published_pick_fit(spark):
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(PICKS)], "pair_id int, sx double, sy double, sz double, tx double, ty double, tz double")
    s, r, t = T.fit_similarity(pairs)
    stat = G.residual_stats(T.residuals(pairs, s, r, t)).first()
    assert round(s, 6) == 0.563267 and round(stat["mean"], 6) == 6.109410 and round(stat["max"], 6) == 8.985347
    q = G.pair_ratios(pairs).first()
    assert q["n_pairs"] == 6 and round(q["min_ratio"], 6) == 0.651541 and round(q["max_ratio"], 6) == 1.685388
    g = T.fit_groups(pairs.withColumn("g", F.lit(1)), "g").first()
    assert math.isclose(g["s"], s, rel_tol=1e-9) and np.isclose(np.linalg.det(T.fit_rigid(pairs)[:3, :3]), 1.0)


def test_transform_then_inverse_is_identity(spark, sf):
    p = I.points(spark, sf)
    a, b = la.euler_zyx(10, 20, 30) * 1.7, [3.0, -4.0, 5.0]
    back = X.apply_affine(X.apply_affine(p, a, b), a, b, inverse=True)
    j = p.alias("p").join(back.alias("q"), "point_id")
    worst = j.agg(*[F.max(F.abs(F.col(f"p.{c}") - F.col(f"q.{c}"))) for c in "xyz"]).first()
    assert max(worst) < 1e-9


def test_row_order_does_not_matter(spark, sf):
    p = I.points(spark, sf)
    mixed = p.orderBy(F.rand(5)).repartition(3)
    one = {r[0] for r in G.voxel_first(p, 8.0).select("point_id").collect()}
    assert one == {r[0] for r in G.voxel_first(mixed, 8.0).select("point_id").collect()}


def test_history_rules(spark, sf):
    p = I.points(spark, sf)
    hit, miss = ((0.0, 0.0, 1.0), 40.0), ((0.0, 0.0, 900.0), 1.0)
    e = E.Edit
    assert E.effective_steps(p, [e("brush", hit), e("undo"), e("brush", miss), e("redo")]) == (e("brush", hit),)
    # a delete that meets nothing is no change, so there is nothing to undo and the selection stays
    assert E.effective_steps(p, [e("sphere", miss), e("delete"), e("undo")]) == (e("sphere", miss),)
    moves = [e("move", (np.eye(3).tolist(), [float(i), 0.0, 0.0])) for i in range(4)]
    assert E.effective_steps(p, [*moves, *[e("undo")] * 9], limit=2) == tuple(moves[:2])
    box = e("box", ([1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0.0, 0, 0, 0, 0, 100.0], 100, 100, (50.0, 0.0, 100.0, 100.0)))
    assert E.replay(p, [box, e("delete")]).where("x >= 0").count() == 0
    with pytest.raises(ValueError, match="no visible slot"):
        E.merge_clouds(p, spark.createDataFrame([(0, 0, False)], "cloud_id int, slot int, visible boolean"))


def test_schedules_and_views(spark):
    clip = R.clip_schedule(10, 20.0, 4.0, 2, 4, 2, 2)
    assert clip[:3] == [20.0, 20.0, 20.0] and clip[6:8] == [4.0, 4.0] and clip[9] == 12.0
    assert R.crossfade_weights(5, 1, 3) == [0.0, 0.0, 0.5, 1.0, 1.0]
    img = np.full((32, 64, 3), 77, np.uint8)
    df = spark.createDataFrame([(0, 32, 64, 3, img.tobytes())], "cam_id int, height int, width int, n_channels int, data binary")
    out = R.panorama_views(df, out=16).collect()
    assert len(out) == 6 and all(set(r["data"]) == {77} for r in out)
    disc = spark.createDataFrame([(0, 64, 64, 3, np.full((64, 64, 3), 9, np.uint8).tobytes())], df.schema)
    ahead, behind = R.fisheye_views(disc, [(0.0, 0.0), (0.0, 180.0)], out=16).orderBy("view").collect()
    assert np.frombuffer(ahead["data"], np.uint8).reshape(16, 16, 3)[8, 8, 0] == 9 and set(behind["data"]) == {0}


def test_yaw_multistart(spark):
    from stratopoint.operators import icp as IC
    from tests.test_align import blob

    tgt = blob(spark, 240)
    src = X.apply_matrix(tgt, np.linalg.inv(la.join4(la.rot_z(math.radians(180.0)), [3.0, 1.0, 0.2])))
    deg, fit = IC.yaw_multistart(src, tgt, 0.4, 180.0)
    assert deg == 180.0 and fit.fitness > 0.9
    assert abs(la.rotation_angle_deg(fit.matrix[:3, :3]) - 180.0) < 2.0


def test_a_stray_point_leaves_the_parts_small(spark, monkeypatch):
    """One point at 1e9 m must neither change results nor put the cloud into one part."""
    import pandas as pd
    from stratopoint.operators import neighbours as NB

    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.uniform(0, 100, (6000, 3)), [[1e9, 50.0, 5.0]], [[np.nan, 0.0, 0.0]]])
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})).repartition(3)
    monkeypatch.setattr(NB, "PART", 500)
    parts = NB.Parts(NB.entries(df))
    assert parts.table.agg({"n_p": "max"}).first()[0] < 1200 and parts.count >= 12
    assert sorted((parts.boxes.hi - parts.boxes.lo).max(1))[-2] < 101
    near = {r["point_id"]: r["distance2"] for r in NB.knn_join(df, df, 2).where("rank = 2").collect()}
    good = xyz[:6000]
    for i in range(0, 6000, 500):
        d = ((good - good[i]) ** 2).sum(1)
        assert abs(near[i] - np.partition(d, 1)[1]) < 1e-9
    assert len(near) == 6001


def test_stray_points_and_the_camera_grid(spark, sf, monkeypatch):
    from stratopoint.operators import colouring as C
    from stratopoint.plans import inputs as I

    cameras, p = I.cameras(spark, sf), I.points(spark, sf).select("point_id", "x", "y", "z")
    far = spark.createDataFrame([(10**6, 1e9, 0.0, 0.0), (10**6 + 1, 0.0, -1e7, 3.0)], "point_id long, x double, y double, z double")
    alone = {r["point_id"]: (r["cam_id"], r["u"]) for r in C.best_camera(p, cameras).collect()}
    found = C.CellCameras(p.union(far), cameras, None, 0.0, True)
    assert found.grid.box["strays"] and found.grid.side < 1e4
    for rows in (2_000_000, 0):                    # broadcast and shuffle paths
        monkeypatch.setattr(C, "BROADCAST_ROWS", rows)
        both = {r["point_id"]: (r["cam_id"], r["u"]) for r in C.best_camera(p.union(far), cameras).collect()}
        assert {i: both[i] for i in alone} == alone and both[10**6][0] is None


def test_gather_with_images_of_several_sizes(spark):
    from stratopoint.operators import colouring as C

    rng = np.random.default_rng(0)
    raster = {0: rng.integers(0, 255, (40, 30, 3)).astype(np.uint8), 1: rng.integers(0, 255, (20, 50, 3)).astype(np.uint8)}
    images = spark.createDataFrame([(k, *v.shape, v.tobytes()) for k, v in raster.items()], "cam_id int, height int, width int, n_channels int, data binary")
    rows = [(i, 0 if i % 10 else 1, float(rng.uniform(0, 29.9)), float(rng.uniform(0, 19.9))) for i in range(2000)]
    rows += [(5000 + i, None, None, None) for i in range(50)] + [(6000, 1, 99.0, 38.0), (6001, 0, -3.0, 99.0)]
    got = {r["point_id"]: (r["red"], r["green"], r["blue"]) for r in
           C.sample_images(spark.createDataFrame(rows, "point_id long, cam_id int, u double, v double"), images).collect()}
    for i, cam, u, v in rows:
        want = C.FALLBACK
        if cam is not None:
            h, w, _ = raster[cam].shape
            want = tuple(int(c) for c in raster[cam][min(max(int(v), 0), h - 1), min(max(int(u), 0), w - 1)])
        assert got[i] == want, (i, cam, u, v)


def test_nearest_time_keeps_flights_apart(spark, monkeypatch):
    """Many flights that all start at 0, gaps of hours, a flight without telemetry, and the same without a key."""
    monkeypatch.setattr(G, "RUN", 3)
    rng = np.random.default_rng(6)
    tele = {f: np.sort(np.unique(np.concatenate([rng.uniform(0, 400, 40), rng.uniform(9000, 9100, 5)]).round(2))) for f in range(6)}
    ask = {f: np.concatenate([rng.uniform(-50, 9500, 30), tele[f % 6][:3] if f < 6 else [1.0, 2.0, 3.0]]).round(2) for f in range(8)}
    t = spark.createDataFrame([(f, float(v), float(v) * 10 + f) for f, ts in tele.items() for v in ts], "flight int, t double, value double")
    q = spark.createDataFrame([(f, i, float(v)) for f, ts in ask.items() for i, v in enumerate(ts)], "flight int, frame long, t double")

    def nearest(times, v):
        d = np.abs(times - v)
        return times[np.flatnonzero(np.isclose(d, d.min(), rtol=0, atol=1e-9))[0]]

    got = {(r.flight, r.frame): (r.t, r.value) for r in G.nearest_time(q, t, 60.0, by=["flight"]).collect()}
    assert len(got) == q.count()
    for (f, i), (at, value) in got.items():
        if f > 5:
            assert at is None and value is None
        else:
            want = nearest(tele[f], ask[f][i])
            assert abs(at - want) < 1e-9 and value == at * 10 + f
    one = {r.frame: r.t for r in G.nearest_time(q.where("flight = 2"), t.where("flight = 2").drop("flight"), 60.0).collect()}
    assert all(abs(v - nearest(tele[2], ask[2][i])) < 1e-9 for i, v in one.items()) and len(one) == 33


def test_points_without_a_place_are_seen_by_no_camera(spark, sf):
    from stratopoint.operators import colouring as C
    from stratopoint.plans import inputs as I

    pts, cams = I.points(spark, sf).select("point_id", "x", "y", "z"), I.cameras(spark, sf)
    bad = spark.createDataFrame([(-1, float("nan"), 0.0, 0.0), (-2, 0.0, float("inf"), 0.0), (-3, None, 1.0, 1.0), (-4, 0.0, 0.0, float("nan"))], "point_id long, x double, y double, z double")
    want = {r.point_id: (r.cam_id, r.rad) for r in C.best_camera(pts, cams).collect()}
    got = {r.point_id: (r.cam_id, r.rad) for r in C.best_camera(pts.unionByName(bad), cams).collect()}
    assert {i: v for i, v in got.items() if i >= 0} == want and all(got[i] == (None, None) for i in (-1, -2, -3, -4))


def test_spheres_keep_rows_that_share_an_id_apart(spark):
    from stratopoint.operators import select as S

    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0), (2, 0.1, 0.0, 0.0), (2, 0.1, 0.0, 0.0)], "point_id long, x double, y double, z double")
    centers = spark.createDataFrame([(0.05, 0.0, 0.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    for broadcast in (200_000, 0):
        got = sorted((r.point_id, r.x, r.selected) for r in S.select_spheres(df, centers, 0.3, broadcast).collect())
        assert got == [(1, 0.0, True), (1, 5.0, False), (2, 0.1, True), (2, 0.1, True)]


def plain_replay(points, log, limit=None):
    """The editor's history on plain sets of points: the steps that count, and the points left with their selection."""
    import copy

    state, undo, redo = {i: (p, False) for i, p in enumerate(points)}, [], []

    def inside(p, q):
        return sum((a - b) ** 2 for a, b in zip(p, q[0])) <= q[1] ** 2

    for op, q in log:
        if op == "sphere":
            state = {i: (p, inside(p, q)) for i, (p, _) in state.items()}
        elif op == "invert":
            state = {i: (p, not s) for i, (p, s) in state.items()}
        elif op in ("undo", "redo"):
            take, give = (undo, redo) if op == "undo" else (redo, undo)
            if take:
                give.append({i: (p, False) for i, (p, _) in state.items()})
                state = take.pop()
        else:
            gone = {i for i, (p, s) in state.items() if (s if op == "delete" else op == "brush" and inside(p, q))}
            if op != "move" and not gone:
                continue
            undo = [*undo, {i: (p, False) for i, (p, _) in copy.copy(state).items()}]
            undo = undo if limit is None else undo[-limit:]
            redo.clear()
            state = {i: (tuple(a + b for a, b in zip(p, q[1])) if op == "move" else p, False) for i, (p, _) in state.items() if i not in gone}
    return state


@pytest.mark.parametrize("seed,limit", [(0, None), (1, 2), (2, None), (3, 3), (4, None)])
def test_an_edit_log_equals_the_plain_history(spark, seed, limit):
    """Random logs in which many deletes and brushes meet nothing, with undo and redo between them."""
    import random

    rng, eye = random.Random(seed), ((1.0, 0, 0), (0, 1.0, 0), (0, 0, 1.0))
    points = [(float(rng.randint(0, 9)), float(rng.randint(0, 9)), 0.0) for _ in range(60)]
    log = []
    for _ in range(24):
        place = ((float(rng.randint(0, 12)), float(rng.randint(0, 12)), 0.0), rng.choice([0.5, 1.0, 2.5]))
        op = rng.choice(["sphere", "sphere", "delete", "delete", "brush", "undo", "undo", "redo", "invert", "move"])
        log += [(op, place)] if op in ("sphere", "brush") else [("move", (eye, (1.0, -1.0, 0.0)))] if op == "move" else [("sphere", place), ("delete", ())] if op == "delete" else [(op, ())]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id long, x double, y double, z double").repartition(2)
    got = {r.point_id: ((r.x, r.y, r.z), r.selected) for r in E.replay(df, [E.Edit(*e) for e in log], limit).collect()}
    assert got == plain_replay(points, log, limit)


def test_one_scan_answers_all_deletes(spark, monkeypatch):
    df = spark.range(40).selectExpr("id as point_id", "double(id) as x", "0D as y", "0D as z")
    log = [E.Edit(op, q) for k in range(12) for op, q in (("sphere", ((3.0 * k, 0.0, 0.0), 0.6)), ("delete", ()), ("undo", ()), ("sphere", ((3.0 * k + 1, 0.0, 0.0), 0.6)), ("delete", ()))]
    calls, real = [], E.selects_any
    monkeypatch.setattr(E, "selects_any", lambda d, a: calls.append(len(a)) or real(d, a))
    assert sorted(r.point_id for r in E.replay(df, log).collect()) == [i for i in range(40) if i % 3 != 1 or i > 34]
    assert calls == [24]


def test_dense_flight_by_tiles_equals_brute_force(spark, monkeypatch):
    """Many cameras over one place: a camera is not listed in all cells that it sees, and tiles find the same hits."""
    from stratopoint.operators import colouring as C

    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(-50, 50, (20_000, 3)) * [1, 1, 0.05], 2)
    at = np.round(rng.uniform(-50, 50, (1_500, 2)), 2)
    at[700:720] = at[0]                                   # equal radii: the lowest id wins
    down = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    cams = spark.createDataFrame([(k, down, [-float(x), float(y), 45.0], 160, 128, "SIMPLE_PINHOLE", [125.0, 80.0, 64.0]) for k, (x, y) in enumerate(at)],
                                 "cam_id int, r array<double>, t array<double>, width int, height int, model string, params array<double>")
    listed, drop = [], C.drop_dominated
    monkeypatch.setattr(C, "drop_dominated", lambda cells: listed.append(cells.count()) or drop(cells))
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    for name, value in (("TILE_CAMERAS", 200), ("TILE_POINTS", 90), ("TILE_PAIRS", 64), ("TILE_LIST", 7)):
        monkeypatch.setattr(C, name, value, raising=False)
    p = make(spark, xyz)
    got = C.best_camera(p.union(p.limit(5)), cams).select("point_id", "cam_id", "rad").collect()
    assert len(got) == 20_005 and max(listed) < 1_500 * 64
    depth = 45.0 - xyz[:, 2]
    dx, dy = xyz[:, :1] - at[:, 0], xyz[:, 1:2] - at[:, 1]
    u, v = 125.0 * dx / depth[:, None] + 80.0, -125.0 * dy / depth[:, None] + 64.0
    rad = np.where((u >= 0) & (u < 160) & (v >= 0) & (v < 128), np.hypot(dx, dy) / depth[:, None], np.inf)
    best = rad.min(1)
    for r in got:
        assert abs(r["rad"] - best[r["point_id"]]) < 1e-9 and rad[r["point_id"], r["cam_id"]] <= best[r["point_id"]] + 1e-9
        assert r["cam_id"] not in range(700, 720)


def test_pair_ratios_in_blocks(spark):
    """Blocks of a few picks, repeated and null ids, null places and copies: as over all pairs, and no pair is a row."""
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(-9, 9, 6).round(1))) for i in range(60)]
    rows += [(5, *rows[7][1:]), (None, *rows[8][1:]), (70, *rows[9][1:]), (71, None, *rows[1][2:])]
    pairs = spark.createDataFrame(rows, "pair_id long, sx double, sy double, sz double, tx double, ty double, tz double")
    n, ratios = 0, []
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] < b[0]:
                n += 1
                if None not in a + b and (s := math.dist(a[1:4], b[1:4])) > 0:
                    ratios.append(math.dist(a[4:], b[4:]) / s)
    for tile in (7, 4096):
        df = G.pair_ratios(pairs, tile)
        got = df.first()
        assert got["n_pairs"] == n and math.isclose(got["min_ratio"], min(ratios)) and math.isclose(got["max_ratio"], max(ratios))
        assert "MapInArrow" in df._jdf.queryExecution().toString()


def test_rasters_are_painted_a_few_at_a_time(spark):
    """A batch of cameras is not held as one frame of pixels."""
    some = pd.DataFrame({"cam_id": range(100), "width": 6, "height": 4})
    for channels, shape in ((((7, 13, 31, 256), (3, 5, 17, 256), (1, 1, 101, 256)), bytes), (((11, 17, 29, 400),), np.ndarray)):
        parts = list(I._paint(channels)([some]))
        assert max(map(len, parts)) <= 32 and [k for p in parts for k in p["cam_id"]] == list(range(100))
        assert all(isinstance(d, shape) for p in parts for d in p["data"])
