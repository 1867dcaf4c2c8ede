import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratopoint.functions import linear as la
from stratopoint.operators import align as AL
from stratopoint.operators import icp as IC
from stratopoint.operators.transform import apply_matrix


@pytest.fixture(scope="module")
def surface(spark):
    """A stepped roof landscape on a 0.4 m lattice."""
    ix, iy = np.meshgrid(np.arange(150), np.arange(120))
    ix, iy = ix.ravel(), iy.ravel()
    z = ((ix // 20) * 3 + (iy // 25) * 5) % 7 + ix // 60 + np.sin(ix / 7.0) + np.cos(iy / 9.0)
    rows = np.column_stack([ix * 0.4 + 0.2, iy * 0.4 + 0.2, z])
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["x", "y", "z"])
    pdf.insert(0, "point_id", np.arange(len(pdf)))
    df = spark.createDataFrame(pdf).repartition(4).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def model(surface):
    x, y = F.col("x") - 12.0, F.col("y") + 7.0
    lift = F.when(F.col("point_id") % 250 == 0, 30.0).otherwise(0.0)
    return surface.where("point_id % 5 = 0").select(
        "point_id", (0.6 * x + 0.8 * y).alias("x"), (0.6 * y - 0.8 * x).alias("y"), (F.col("z") - 1.5 + lift).alias("z")).persist()


def test_coarse_and_fine(surface, model):
    coarse = AL.coarse_yaw(model, surface, n=256, step=4.0)
    assert abs(math.degrees(coarse["yaw"]) - 53.1301) <= 0.5 and coarse["ratio"] > 1.05
    assert len(coarse["top"]) == 5
    fine = AL.fit_to_dsm(model, surface, coarse["yaw"], coarse["tx"], coarse["ty"])
    assert abs(math.degrees(fine["yaw"]) - 53.1301) < 0.3
    assert np.allclose(fine["t"], [12.0, -7.0, 1.5], atol=0.3)
    assert fine["inliers"] > 0.9


def blob(spark, n=600, seed=1):
    import pandas as pd

    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 10, (n, 2))
    z = np.sin(a[:, 0]) + 0.5 * np.cos(1.7 * a[:, 1]) + 0.1 * a[:, 0]
    wall = np.column_stack([np.full(n // 3, 3.0), rng.uniform(0, 10, n // 3), rng.uniform(1, 5, n // 3)])
    p = np.vstack([np.column_stack([a, z]), wall])
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})).persist()


@pytest.mark.parametrize("kind", ["point", "plane", "generalized"])
def test_icp_recovers_motion(spark, kind):
    tgt = blob(spark)
    motion = la.join4(la.euler_zyx(1.0, -2.0, 3.0), [0.1, -0.15, 0.05])
    src = apply_matrix(tgt, np.linalg.inv(motion))
    if kind != "point":
        tgt = IC.normals(tgt, 1.5).persist()
    if kind == "generalized":
        src = IC.normals(src.persist(), 1.5)
    fit = IC.icp(src, tgt, [2.0, 0.5], kind=kind, max_iter=30)[0]
    assert np.allclose(fit.matrix, motion, atol=1e-3), fit
    assert fit.fitness > 0.99 and fit.rmse < 1e-2
    e = IC.evaluate(src, tgt, 0.05, motion).first()
    assert e["fitness"] == 1.0 and e["rmse"] < 1e-9


def test_correspondences_equal_brute_force(spark):
    tgt = blob(spark, 200)
    got = {(r["point_id"], r["t_point_id"]) for r in IC.correspondences(tgt, tgt, 1.0).collect()}
    assert got == {(i, i) for i in range(tgt.count())}


def test_kept_matches_equal_brute_force_at_every_step(spark, monkeypatch):
    """Half of both clouds crowds in one spot, one point is far off, ids repeat, one row has no place."""
    import pandas as pd

    from stratopoint.operators import matching as MT

    monkeypatch.setattr(MT, "TARGET_PART", 64)
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.random((200, 3)) * [20, 20, 2], 5 + rng.random((200, 3)) * 0.3, [[1e6, 0, 0]]])
    s = np.concatenate([rng.random((150, 3)) * [20, 20, 2], 5 + rng.random((150, 3)) * 0.3, [[-1e6, 0, 0]]])

    def table(p, extra=()):
        return spark.createDataFrame(pd.DataFrame([[i % 7 if extra else i, *v] for i, v in enumerate([*p, *extra])], columns=["point_id", "x", "y", "z"]))

    m = MT.Matches(table(s, [[np.nan, 0.0, 0.0]]), MT.Target(table(t)))
    shifts = [[0, 0, 0], [0.02, 0, 0], [0.03, 0.01, 0], [0.03, 0.0101, 0], [0.5, 0.2, 0.1], [0.5, 0.2001, 0.1]]
    for radius in (1.0, 0.4):
        for shift in shifts:
            poses = {k: la.join4(la.rot_z(0.3 * k), shift) for k in (0, 1)}
            got = m.sums(poses, radius, "point")
            for k, pose in poses.items():
                d2 = (((s @ pose[:3, :3].T + pose[:3, 3])[:, None] - t) ** 2).sum(2)
                near = d2.min(1)
                hit = near < radius * radius
                assert got[k]["n"] == hit.sum() and np.isclose(got[k]["d2"], near[hit].sum())
                assert np.allclose([got[k]["t" + c] for c in "xyz"], t[d2.argmin(1)][hit].sum(0))
    assert m.searched < 2 * len(shifts)


def test_normals_of_plane(spark):
    import pandas as pd

    g = np.stack(np.meshgrid(np.arange(15.0), np.arange(15.0)), -1).reshape(-1, 2)
    z = 0.5 * g[:, 0]
    df = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(g)), "x": g[:, 0], "y": g[:, 1], "z": z}))
    n = IC.normals(df, 2.5).toPandas()[["nx", "ny", "nz"]].to_numpy()
    want = np.array([-0.5, 0.0, 1.0]) / math.sqrt(1.25)
    assert np.allclose(np.abs(n @ want), 1.0, atol=1e-6)


def test_align_from_pairs(spark):
    tgt = blob(spark)
    motion = la.join4(la.euler_zyx(0.0, 0.0, 120.0), [5.0, 2.0, 1.0])
    src = apply_matrix(tgt, np.linalg.inv(motion))
    ids = (1, 50, 300, 700)
    pairs = src.where(F.col("point_id").isin(*ids)).select("point_id", *[F.col(c).alias("s" + c) for c in "xyz"]).join(
        tgt.select("point_id", *[F.col(c).alias("t" + c) for c in "xyz"]), "point_id")
    fit = IC.align_from_pairs(src, tgt, pairs)
    # the two clouds are thinned on different lattices, so the motion is close, not exact
    assert np.allclose(fit.matrix, motion, atol=0.05)
    with pytest.raises(ValueError, match="at least 3"):
        IC.align_from_pairs(src, tgt, pairs.limit(2))


def test_global_registration_finds_a_quarter_turn(spark):
    """Feature matching with no start at all: a motion of 90 degrees about a tilted axis."""
    from stratopoint.operators import features as FT

    tgt = blob(spark, 1500, 3)
    motion = la.join4(la.euler_zyx(10.0, -8.0, 90.0), [4.0, -2.0, 1.0])
    src = apply_matrix(tgt, np.linalg.inv(motion))
    s, t = (IC.cut(IC.normals(df.select("point_id", "x", "y", "z"), 1.2)) for df in (src, tgt))
    pairs = FT.feature_pairs(s, t, 0.4)
    assert pairs.count() > 200
    pose, share = FT.ransac_pose(pairs, 0.6, trials=4000)
    assert share > 0.3 and np.abs(pose - motion).max() < 0.5
    poses = FT.graduated_poses(pairs, 0.2, trials=3)
    assert len(poses) == 3 and min(np.abs(m - motion).max() for m in poses) < 0.3


def test_nearest_features_are_exact(spark, monkeypatch):
    from stratopoint.operators import features as FT

    monkeypatch.setattr(FT, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 4, (40, 33)).astype(float), rng.integers(0, 4, (50, 33)).astype(float)
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "point_id long, f array<double>") for m in (x, y))
    got = {r["point_id"]: (r["other"], r["d2"]) for r in FT.nearest_features(a, b).collect()}
    d2 = ((x[:, None] - y[None]) ** 2).sum(2)
    assert got == {i: (int(d2[i].argmin()), float(d2[i].min())) for i in range(40)}
