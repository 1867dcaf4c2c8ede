"""Palettes and colour conversions, all as codegen-friendly expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knots of the piecewise palettes (position, red, green, blue).
IRON = (
    (0.0, 0.15, 0.35, 0.5, 0.65, 0.8, 0.9, 1.0),
    (0.0, 0.25, 0.55, 0.85, 1.0, 1.0, 1.0, 1.0),
    (0.0, 0.0, 0.0, 0.2, 0.45, 0.7, 0.9, 1.0),
    (0.0, 0.45, 0.55, 0.35, 0.1, 0.0, 0.35, 1.0),
)
JET = (
    (0.0, 0.125, 0.375, 0.625, 0.875, 1.0),
    (0.0, 0.0, 0.0, 1.0, 1.0, 0.5),
    (0.0, 0.0, 1.0, 1.0, 0.0, 0.0),
    (0.5, 1.0, 1.0, 0.0, 0.0, 0.0),
)
# Coefficients of the degree-5 turbo approximation, t^0 .. t^5.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)
# Fixed value: zeroth spherical-harmonic basis constant.
SH_C0 = 0.28209479177387814


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def interp(c: Column, xp: Sequence[float], fp: Sequence[float]) -> Column:
    """Piecewise linear interpolation with flat ends (like numpy.interp)."""
    out = F.when(c <= F.lit(float(xp[0])), F.lit(float(fp[0])))
    for x0, x1, f0, f1 in zip(xp, xp[1:], fp, fp[1:]):
        slope = (f1 - f0) / (x1 - x0)
        out = out.when(c < F.lit(float(x1)), F.lit(slope) * (c - F.lit(float(x0))) + F.lit(float(f0)))
    return out.otherwise(F.lit(float(fp[-1])))


def _poly(t: Column, coeffs: Sequence[float]) -> Column:
    acc = F.lit(float(coeffs[-1]))
    for k in reversed(coeffs[:-1]):
        acc = acc * t + F.lit(float(k))
    return acc


def _rviz(c: Column) -> list[Column]:
    h = (F.lit(1.0) - clip(c, 0, 1)) * F.lit(5.0) + F.lit(1.0)
    i = F.floor(h)
    f = h - i
    n = F.lit(1.0) - F.when(i % 2 == 0, F.lit(1.0) - f).otherwise(f)
    one, zero = F.lit(1.0), F.lit(0.0)
    red = F.when(i <= 1, n).when(i <= 3, zero).when(i == 4, n).otherwise(one)
    green = F.when(i <= 1, zero).when(i == 2, n).when(i <= 4, one).otherwise(n)
    blue = F.when(i <= 2, one).when(i == 3, n).otherwise(zero)
    return [red, green, blue]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    h6 = F.pmod(h, F.lit(1.0)) * F.lit(6.0)
    sector = F.floor(h6) % 6
    f = h6 - F.floor(h6)
    p = v * (F.lit(1.0) - s)
    q = v * (F.lit(1.0) - f * s)
    t = v * (F.lit(1.0) - (F.lit(1.0) - f) * s)

    def choose(*branches: Column) -> Column:
        out = F.when(sector == 0, branches[0])
        for k in range(1, 5):
            out = out.when(sector == k, branches[k])
        return out.otherwise(branches[5])

    return [choose(v, q, p, p, t, v), choose(t, v, v, q, p, p), choose(p, p, t, v, v, q)]


def palette(c: Column, name: str) -> list[Column]:
    """Value in 0..1 -> [red, green, blue] in 0..1."""
    if name in ("iron", "jet"):
        xp, *channels = IRON if name == "iron" else JET
        return [interp(c, xp, fp) for fp in channels]
    if name == "turbo3":
        v = clip(c, 0, 1)
        return [clip(F.lit(1.5) - F.abs(F.lit(4.0) * v - F.lit(k)), 0, 1) for k in (3.0, 2.0, 1.0)]
    if name == "turbo":
        t = clip(c, 0, 1)
        return [clip(_poly(t, k), 0, 1) for k in TURBO]
    if name == "rviz":
        return _rviz(c)
    if name == "hue":
        t = clip(c, 0, 1)
        return hsv_to_rgb(F.lit(0.66) - F.lit(0.83) * t, F.lit(1.0), F.lit(1.0))
    raise ValueError(f"unknown palette {name!r}")


def to_byte(c: Column, mode: str = "rint") -> Column:
    """0..1 -> 0..255: ``rint`` half-even, ``trunc`` towards zero, ``half_up``."""
    scaled = clip(c, 0, 1) * F.lit(255.0)
    if mode == "rint":
        return F.rint(scaled).cast("short")
    if mode == "trunc":
        return scaled.cast("short")
    if mode == "half_up":
        return F.floor(scaled + F.lit(0.5)).cast("short")
    raise ValueError(f"unknown rounding mode {mode!r}")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_rgb(packed: Column) -> list[Column]:
    return [F.shiftright(packed, k).bitwiseAND(F.lit(255)).cast("short") for k in (16, 8, 0)]


def sh_dc_to_rgb(f: Column) -> Column:
    return clip(F.lit(0.5) + F.lit(SH_C0) * f, 0, 1)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def brighten(c: Column, gain: float = 1.8) -> Column:
    return clip(F.lit(float(gain)) * c, 0, 1)


def white_hot(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def tint(t: Column, base: Sequence[float] = (1.0, 1.0, 1.0)) -> list[Column]:
    """Bluish-grey ramp of the intensity view, times the base colour of the cloud."""
    # Offset and slope per channel.
    ramp = ((0.2, 0.8), (0.4, 0.6), (0.6, 0.4))
    return [(F.lit(a) + F.lit(k) * t) * F.lit(float(bc)) for (a, k), bc in zip(ramp, base)]
