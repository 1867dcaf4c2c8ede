"""Camera models as column expressions, and the bounds used to prune cameras."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameter order of the supported camera models.
MODEL_PARAMS = {
    "SIMPLE_PINHOLE": ("f", "cx", "cy"),
    "PINHOLE": ("fx", "fy", "cx", "cy"),
    "SIMPLE_RADIAL": ("f", "cx", "cy", "k1"),
    "RADIAL": ("f", "cx", "cy", "k1", "k2"),
    "OPENCV": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"),
}
FRONT_EPS = 1e-6
UNBOUNDED = 1e13

OPTICS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")
OPTICS_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in OPTICS])


def optics(model: Column, params: Column) -> Column:
    """Bring every camera model to one 8-parameter struct; unknown models raise."""

    def pick(names: tuple[str, ...]) -> Column:
        at = {n: params[i] for i, n in enumerate(names)}
        zero = F.lit(0.0)
        return F.struct(
            at.get("fx", at.get("f")).alias("fx"),
            at.get("fy", at.get("f")).alias("fy"),
            at["cx"].alias("cx"),
            at["cy"].alias("cy"),
            *[at.get(n, zero).alias(n) for n in ("k1", "k2", "p1", "p2")],
        )

    out = None
    for name, names in MODEL_PARAMS.items():
        out = F.when(model == name, pick(names)) if out is None else out.when(model == name, pick(names))
    unknown = F.raise_error(F.concat(F.lit("unsupported camera model: "), model)).cast(OPTICS_TYPE)
    return out.otherwise(unknown)


def normalise(xc: Column, yc: Column, zc: Column) -> Column:
    """Camera coordinates -> struct(front, x, y), x and y divided by depth.

    Depth is guarded before the division because ANSI mode raises on x / 0.
    """
    front = zc > F.lit(FRONT_EPS)
    depth = F.when(front, zc).otherwise(F.lit(1.0))
    return F.struct(front.alias("front"), (xc / depth).alias("x"), (yc / depth).alias("y"))


def distort(o: Column, n: Column) -> Column:
    """Optics struct and normalised struct -> struct(u, v, rad)."""
    x, y = n["x"], n["y"]
    r2 = x * x + y * y
    d = F.lit(1.0) + o["k1"] * r2 + o["k2"] * r2 * r2
    tx = F.lit(2.0) * o["p1"] * x * y + o["p2"] * (r2 + F.lit(2.0) * x * x)
    ty = o["p1"] * (r2 + F.lit(2.0) * y * y) + F.lit(2.0) * o["p2"] * x * y
    return F.struct(
        (o["fx"] * (x * d + tx) + o["cx"]).alias("u"),
        (o["fy"] * (y * d + ty) + o["cy"]).alias("v"),
        F.sqrt(r2).alias("rad"),
    )


def distort_arrays(o: dict, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``distort`` on arrays: one entry per (point, camera) pair."""
    r2 = x * x + y * y
    d = 1.0 + o["k1"] * r2 + o["k2"] * r2 * r2
    tx = 2.0 * o["p1"] * x * y + o["p2"] * (r2 + 2.0 * x * x)
    ty = o["p1"] * (r2 + 2.0 * y * y) + 2.0 * o["p2"] * x * y
    return o["fx"] * (x * d + tx) + o["cx"], o["fy"] * (y * d + ty) + o["cy"], np.sqrt(r2)


def in_image(p: Column, width: Column, height: Column, max_radius: float = 0.0) -> Column:
    """Pixel inside the image (and, when asked for, radius below ``max_radius``)."""
    ok = (p["u"] >= 0) & (p["u"] < width) & (p["v"] >= 0) & (p["v"] < height)
    return ok & (p["rad"] < F.lit(float(max_radius))) if max_radius > 0 else ok


def hits(cams: Column, x: Column, y: Column, z: Column, max_radius: float = 0.0) -> Column:
    """Array of cameras -> array of struct(rad, cam_id, u, v) of those that see the point.

    Every step binds its result once (nested transforms), so no expression is
    repeated; cameras behind the point drop out before the distortion step.
    """
    def step_normalise(c: Column) -> Column:
        cc = [c[f"m{3 * i}"] * x + c[f"m{3 * i + 1}"] * y + c[f"m{3 * i + 2}"] * z + c[f"t{i}"] for i in range(3)]
        return F.struct(c.alias("c"), normalise(*cc).alias("n"))

    def step_distort(s: Column) -> Column:
        return F.struct(s["c"].alias("c"), distort(s["c"]["optics"], s["n"]).alias("p"))

    ahead = F.filter(F.transform(cams, step_normalise), lambda s: s["n"]["front"])
    seen = F.filter(F.transform(ahead, step_distort),
                    lambda s: in_image(s["p"], s["c"]["width"], s["c"]["height"], max_radius))
    return F.transform(seen, lambda s: F.struct(
        s["p"]["rad"].alias("rad"), s["c"]["cam_id"].alias("cam_id"), s["p"]["u"].alias("u"), s["p"]["v"].alias("v")))


def view_bounds(o: dict[str, float], width: float, height: float) -> tuple[float, float, float, float]:
    """Bounds (xlo, xhi, ylo, yhi) on x/Z and y/Z of anything the image can show.

    Without distortion, or with one that only pushes outwards, the image
    border itself bounds the view. Otherwise r*|d(r)| - tangential(r) <= corner
    radius is solved for its largest root, so barrel-fold views stay covered;
    a view with no such root is unbounded.
    """
    xlo, xhi = min(-o["cx"] / o["fx"], 0.0), max((width - o["cx"]) / o["fx"], 0.0)
    ylo, yhi = min(-o["cy"] / o["fy"], 0.0), max((height - o["cy"]) / o["fy"], 0.0)
    k1, k2 = o["k1"], o["k2"]
    tang = 3.0 * np.sqrt(2.0) * (abs(o["p1"]) + abs(o["p2"]))
    if k1 >= 0 and k2 >= 0 and tang == 0:
        return xlo, xhi, ylo, yhi
    corner = np.hypot(max(-xlo, xhi), max(-ylo, yhi))
    lead = next(c for c in (abs(k2), abs(k1), -tang, 1.0) if c != 0.0)
    bound = 0.0
    for sign in (1.0, -1.0):
        # sign * (r + k1 r^3 + k2 r^5) - tang r^2 - corner = 0
        roots = np.roots([sign * k2, 0.0, sign * k1, -tang, sign, -corner])
        real = roots[np.abs(roots.imag) < 1e-9 * (1.0 + np.abs(roots.real))].real
        bound = max([bound, *real[real > 0]])
    r = bound * (1.0 + 1e-9) if lead > 0 and bound > 0 else UNBOUNDED
    return -r, r, -r, r
