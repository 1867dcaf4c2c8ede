import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratopoint.operators import align as AL
from stratopoint.plans import inputs as I
from stratopoint.plans import jobs
from stratopoint.sources.points import read_points, write_cloud
from stratopoint.sources.texts import write_model
from tests.test_sources import jpeg_head, png


@pytest.fixture(scope="module")
def flight(spark, sf, tmp_path_factory):
    """A cloud, photos with geotags and a text model whose frame is the local ENU frame."""
    root = tmp_path_factory.mktemp("flight")
    cams = I.cameras(spark, sf).withColumn("camera_no", F.lit(1))
    tags = {r["name"]: r for r in I.derived(spark, sf, "fx_geotags").collect()}
    (root / "photos").mkdir()
    for r in cams.collect():
        v, u = np.mgrid[0:128, 0:160]
        img = np.stack([u, v, np.full_like(u, r["cam_id"])], -1).astype(np.uint8)
        g = tags[r["name"]]
        meta = jpeg_head(alt=f"+{g['rel_alt']:.3f}", lat=f"{g['lat']:.9f}", lon=f"{g['lon']:.9f}")[2:]
        (root / "photos" / r["name"]).write_bytes(png(img) + meta)
    pts = I.points(spark, sf).select(F.col("point_id").alias("pid"), "x", "y", "z", *[F.lit(0).cast("short").alias(c) for c in ("red", "green", "blue")],
                                     F.lit(0.1).alias("err"))
    write_model(cams, pts, str(root / "model"))
    write_cloud(I.points(spark, sf).drop("intensity"), str(root / "cloud.ply"), "ply", True)
    return root


def test_colorize(spark, sf, flight, monkeypatch):
    geo_mean = I.cameras(spark, sf).agg(F.avg("c.x"), F.avg("c.y")).first()
    # the plan-view search has its own tests; here the known pose stands in for it
    monkeypatch.setattr(AL, "auto_align", lambda m, t: {"yaw": 0.0, "t": [geo_mean[0], geo_mean[1], 0.0], "inliers": 1.0})
    work = str(flight / "work")
    cov = jobs.colorize(spark, str(flight / "cloud.ply"), str(flight / "photos"), str(flight / "out.ply"), work, str(flight / "model"),
                        single=True).first()
    out = read_points(spark, str(flight / "out.ply"))
    assert out.count() == cov["n_points"] == 1000 and 0 < cov["n_hit"] < 1000
    hit = spark.read.parquet(f"{work}/coloured").where("cam_id IS NOT NULL")
    # floor(u), floor(v), camera id are what the pictures show
    off = hit.where((F.col("blue") != F.col("cam_id")) | (F.abs(F.col("red") - F.floor("u")) > 0) | (F.abs(F.col("green") - F.floor("v")) > 0))
    assert off.count() == 0
    a = json.loads(spark.read.text(f"{work}/affine").first()[0])
    assert np.allclose(a["A"], np.eye(3), atol=1e-4)


def test_temperature_thermal_and_quality(spark, sf):
    p, c = I.points(spark, sf), I.cameras(spark, sf)
    photos = c.select(F.regexp_replace("name", "_V", "_T").alias("name"), F.lit(0).alias("ord"))
    cloud, stats = jobs.temperature(p, c, photos, I.thermal(c), None, 160, 128)
    s = stats.first()
    assert s["n_points"] == 1000 and 0 < s["n_hit"] < 1000 and 10 <= s["t_min"] <= s["t_lo"] <= s["t_median"] <= s["t_hi"] <= s["t_max"] < 50
    assert {tuple(r) for r in cloud.where("temp IS NULL").select("red", "green", "blue").distinct().collect()} == {(31, 31, 31)}
    for name in (None, "jet"):
        t = jobs.thermal(p, c, photos, I.images(c), None, name, 160, 128)
        assert t.count() == 1000 and t.where("cam_id IS NULL AND red <> 31").count() == 0
    q = jobs.quality(p, c, I.images(c), n=400).first()
    assert q["n_points"] == 400 and 0 <= (q["mean_sd"] or 0) < 0.5


def test_merge_profile_retune(spark, sf, tmp_path):
    p = I.points(spark, sf)
    slots = spark.createDataFrame([(2, 0, True), (0, 1, True), (1, 2, False)], "cloud_id int, slot int, visible boolean")
    log = spark.createDataFrame([(1, "sphere", "[[0,0,1],60]"), (2, "delete", "[]"), (3, "undo", "[]")], "seq int, op string, params string")
    m = jobs.merge(p, slots, log)
    n = p.where("cloud_id <> 1").count()
    assert m.count() == n and [r[0] for r in m.orderBy("point_id").select("point_id").limit(3).collect()] == [0, 1, 2]
    assert m.orderBy("point_id").first()["cloud_id"] == 2 and m.where("intensity IS NOT NULL").count() == 0
    prof = jobs.profile(p).first()
    assert prof["n_valid"] == 1000 and prof["z_lo"] <= prof["z_hi"] and prof["view_radius"] > 0
    q = jobs.retune(spark, str(tmp_path), p, p, 0.0, [0.0, 0.0, 0.0], accept=True).first()
    assert q["share"] > 0.5 and spark.read.parquet(str(tmp_path / "align")).first()["share"] == q["share"]
