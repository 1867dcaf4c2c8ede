import math

import numpy as np
import pandas as pd
import pytest

from stratopoint.operators import align as AL
from stratopoint.operators import correlate as C


def table(spark, p):
    return spark.createDataFrame(pd.DataFrame(p, columns=["x", "y", "z"])).repartition(3)


def raster(p, res, at, origin, n):
    """Highest z per cell, standardised over the occupied cells."""
    out = np.full((n, n), -np.inf)
    ix, iy = (np.floor((p[:, k] - at[k]) / res).astype(int) + origin for k in (0, 1))
    np.maximum.at(out, (iy, ix), p[:, 2].astype(np.float32).astype(float))
    held = np.isfinite(out)
    out[held] = (out[held] - out[held].mean()) / out[held].std()
    out[~held] = 0.0
    return out


def turned(p, at, angle):
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    d = p[:, :2] - at
    return np.column_stack([c * d[:, 0] - s * d[:, 1], s * d[:, 0] + c * d[:, 1], p[:, 2]])


@pytest.mark.parametrize("block", [4, 8, 512])
def test_blocks_equal_a_plain_correlation(spark, monkeypatch, block):
    """Cut into blocks or whole, the score of every angle is the best of all shifts of the whole rasters."""
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "TASK_ROWS", 16)
    rng = np.random.default_rng(3)
    t = rng.random((300, 3)) * [20, 13, 5]
    m = np.concatenate([t[t[:, 0] < 12], rng.random((40, 3)) * [12, 13, 5]])
    m = turned(m, np.zeros(2), -30.0) + [50.0, 7.0, 2.0]
    held, _ = C.bulks(table(spark, m), table(spark, t))
    plan = C.layout(1.0, table(spark, m), held.at, table(spark, t))
    assert plan.whole == (block == 512)
    angles = [0.0, 30.0, 100.0]
    got = {r["angle"]: r for r in C.Windows(table(spark, t), plan).best(table(spark, m), angles).collect()}
    n, half = 128, 64
    want = raster(t, 1.0, t[:, :2].mean(0), half, n)
    for a in angles:
        have = raster(turned(m, np.array(held.at), a), 1.0, (0.0, 0.0), half, n)
        fit = np.fft.irfft2(np.fft.rfft2(want) * np.conj(np.fft.rfft2(have)), s=(n, n))
        assert np.isclose(got[a]["score"], fit.max(), rtol=1e-4)
        assert np.isclose(fit[got[a]["py"] % n, got[a]["px"] % n], fit.max(), rtol=1e-4)


def test_a_window_wraps_around(spark):
    rng = np.random.default_rng(4)
    t, m = rng.random((200, 3)) * [20, 20, 5], rng.random((200, 3)) * [20, 20, 5]
    held, _ = C.bulks(table(spark, m), table(spark, t))
    plan = C.layout(1.0, table(spark, m), held.at, table(spark, t), 24)
    got = C.Windows(table(spark, t), plan).best(table(spark, m), [0.0]).first()
    want, have = (raster(p, 1.0, at, 12, 24) for p, at in ((t, t[:, :2].mean(0)), (m, held.at)))
    fit = np.fft.irfft2(np.fft.rfft2(want) * np.conj(np.fft.rfft2(have)), s=(24, 24))
    assert np.isclose(got["score"], fit.max(), rtol=1e-4) and -12 < got["px"] <= 12 and -12 < got["py"] <= 12


def site(rng, corners):
    """Stepped roofs in 60 m villages."""
    out = []
    for x, y in corners:
        g = rng.random((3000, 2)) * 60
        out.append(np.column_stack([g + [x, y], (np.floor(g[:, 0] / 9 + x) * 3 + np.floor(g[:, 1] / 11) * 5) % 7]))
    return np.concatenate(out)


def test_a_site_of_twenty_kilometres(spark):
    """Three villages 20 km apart: no raster holds them, the turn and the shift are found in blocks."""
    t = site(np.random.default_rng(5), [(0, 0), (20_000, 300), (9_000, 700)])
    m = turned(t[::2], np.zeros(2), -40.0) + [120.0, -35.0, 1.0]
    c = AL.coarse_yaw(table(spark, m), table(spark, t), step=20.0, fine=20.0)
    back = turned(m + [0, 0, 0], np.zeros(2), math.degrees(c["yaw"])) + [c["tx"], c["ty"], 0.0]
    assert round(math.degrees(c["yaw"])) == 40 and np.abs(back - t[::2])[:, :2].max() < 1.5


def test_stray_points_and_points_without_a_place_change_nothing(spark):
    t = site(np.random.default_rng(6), [(0, 0)])
    m = turned(t[::3], np.zeros(2), -20.0)
    plain = AL.coarse_yaw(table(spark, m), table(spark, t), step=20.0, fine=10.0)
    odd = [[1e9, -1e9, 3.0], [np.nan, 0.0, 1.0], [1.0, 1.0, np.inf]]
    got = AL.coarse_yaw(table(spark, np.concatenate([m, odd])), table(spark, np.concatenate([t, odd])), step=20.0, fine=10.0)
    assert math.isclose(plain["yaw"], got["yaw"]) and abs(got["tx"] - plain["tx"]) <= 1.0 and abs(got["ty"] - plain["ty"]) <= 1.0
    with pytest.raises(ValueError, match="no points"):
        AL.coarse_yaw(table(spark, m).where("false"), table(spark, t))
