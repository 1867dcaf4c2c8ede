"""Selections: predicates on coordinates, screen positions, polygons and spheres.

Clouds carry two optional boolean columns, ``selected`` and ``visible``;
a missing column means nothing selected and everything visible.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut
from .percentiles import finite as finite_value

W_EPS = 1e-12


def visible(df: DataFrame) -> Column:
    return F.col("visible") if "visible" in df.columns else F.lit(True)


def selected(df: DataFrame) -> Column:
    return F.col("selected") if "selected" in df.columns else F.lit(False)


def finite(df: DataFrame) -> DataFrame:
    """Drop rows with a NaN or infinite coordinate."""
    return df.where(reduce(lambda a, b: a & b, [finite_value(F.col(c)) for c in "xyz"]))


def z_slice(df: DataFrame, zmin: float, zmax: float) -> DataFrame:
    """Visible = closed z range; what leaves the slice leaves the selection."""
    inside = F.col("z").between(F.lit(float(zmin)), F.lit(float(zmax)))
    return df.withColumns({"visible": inside, "selected": selected(df) & inside})


def z_slice_norm(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Slice given as fractions of the padded z range of all clouds together."""
    row = df.agg(F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    lo, hi = (0.0, 1.0) if row["lo"] is None else (row["lo"], row["hi"])
    pad = max(1e-3, (hi - lo) * 1e-4)
    lo, hi = lo - pad, hi + pad
    return z_slice(df, lo + low * (hi - lo), lo + high * (hi - lo))


def height_cut(df: DataFrame, lo: float = 0.0, hi: float = 1.0, up: str = "z") -> DataFrame:
    """Keep a fraction range of the height (z or y) after centring on the centroid."""
    row = df.agg(F.avg(up).alias("mean"), F.min(up).alias("lo"), F.max(up).alias("hi")).first()
    if row["mean"] is None:
        return df
    base, span = row["lo"] - row["mean"], max(row["hi"] - row["lo"], 1e-6)
    centred = F.col(up) - F.lit(row["mean"])
    return df.where(centred.between(F.lit(base + lo * span), F.lit(base + hi * span)))


def clip_coordinates(m: Sequence[float], x: Column, y: Column, z: Column) -> list[Column]:
    """Row-major 4x4 literal matrix times (x, y, z, 1)."""
    return [F.lit(float(m[4 * i])) * x + F.lit(float(m[4 * i + 1])) * y + F.lit(float(m[4 * i + 2])) * z
            + F.lit(float(m[4 * i + 3])) for i in range(4)]


def screen_columns(mvp: Sequence[float], width: int, height: int) -> tuple[Column, Column, Column]:
    """sx, sy (origin bottom left) and depth; depth is null behind the eye."""
    cx, cy, cz, cw = clip_coordinates(mvp, F.col("x"), F.col("y"), F.col("z"))
    w = F.when(F.abs(cw) < W_EPS, F.lit(W_EPS)).otherwise(cw)
    return ((cx / w * 0.5 + 0.5) * F.lit(float(width)), (cy / w * 0.5 + 0.5) * F.lit(float(height)),
            F.when(cw >= 0, cz / w))


def to_screen(df: DataFrame, mvp: Sequence[float], width: int, height: int) -> DataFrame:
    return df.withColumns(dict(zip(("sx", "sy", "depth"), screen_columns(mvp, width, height))))


def on_screen() -> Column:
    return F.coalesce(F.col("depth").between(F.lit(-1.0), F.lit(1.0)), F.lit(False))


def in_polygon(x: Column, y: Column, poly: Sequence[Sequence[float]]) -> Column:
    """Even-odd rule as one XOR chain over the edges."""
    inside = None
    for (xi, yi), (xj, yj) in zip(poly, [poly[-1], *poly[:-1]]):
        den = yj - yi if abs(yj - yi) > 1e-12 else 1e-12
        straddles = (F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)
        left = x < F.lit(float(xj - xi)) * (y - F.lit(float(yi))) / F.lit(float(den)) + F.lit(float(xi))
        crossed = straddles & left
        inside = crossed if inside is None else inside != crossed
    return inside


def in_polygons(df: DataFrame, edges: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """(point_id, poly_id) containment for a polygon table (poly_id, seq, px, py).

    A polygon only meets points in the grid cells of its bounding box, so the
    join is an equi-join; its edges travel as one array per polygon.
    """
    ring = F.sort_array(F.collect_list(F.struct("seq", "px", "py")))
    poly = edges.groupBy("poly_id").agg(ring.alias("ring"), F.min("px").alias("x0"), F.max("px").alias("x1"),
                                        F.min("py").alias("y0"), F.max("py").alias("y1"))
    size = poly.agg(F.percentile_approx(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 0.5)).first()[0]
    size = max(float(size or 1.0), 1e-9)

    def cell(c: Column) -> Column:
        return F.floor(c / F.lit(size))

    tiles = (poly.withColumn("gx", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
             .withColumn("gy", F.explode(F.sequence(cell(F.col("y0")), cell(F.col("y1"))))))
    if tiles.count() <= max_broadcast:
        tiles = F.broadcast(tiles)
    joined = (df.select("point_id", "x", "y", cell(F.col("x")).alias("gx"), cell(F.col("y")).alias("gy"))
              .join(tiles, ["gx", "gy"]).where(F.col("x").between(F.col("x0"), F.col("x1"))))
    prev = F.concat(F.slice("ring", F.size("ring"), 1), F.slice("ring", F.lit(1), F.size("ring") - 1))
    x, y = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        den = b["py"] - a["py"]
        den = F.when(F.abs(den) > 1e-12, den).otherwise(F.lit(1e-12))
        hit = ((a["py"] > y) != (b["py"] > y)) & (x < (b["px"] - a["px"]) * (y - a["py"]) / den + a["px"])
        return hit

    pairs = F.arrays_zip(F.col("ring").alias("a"), prev.alias("b"))
    odd = F.size(F.filter(pairs, crosses)) % 2 == 1
    return joined.where(odd).select("point_id", "poly_id")


def _select(df: DataFrame, mask: Column) -> DataFrame:
    """New selection; only visible points may be selected."""
    return df.withColumn("selected", F.coalesce(mask, F.lit(False)) & visible(df))


def select_box(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Closed rectangle on the screen; needs the columns of to_screen."""
    return _select(df, F.col("sx").between(xmin, xmax) & F.col("sy").between(ymin, ymax) & on_screen())


def select_lasso(df: DataFrame, verts: Sequence[Sequence[float]]) -> DataFrame:
    return _select(df, on_screen() & in_polygon(F.col("sx"), F.col("sy"), verts))


def prism_mask(poly: Sequence[Sequence[float]], base_z: float = 0.0, height: float = 2.0,
               offset: Sequence[float] = (0.0, 0.0, 0.0)) -> Column:
    lo = base_z + offset[2]
    ring = [(px + offset[0], py + offset[1]) for px, py in poly]
    return F.col("z").between(F.lit(float(lo)), F.lit(float(lo + max(1e-3, height)))) & in_polygon(F.col("x"), F.col("y"), ring)


def select_prism(df: DataFrame, poly, base_z: float = 0.0, height: float = 2.0, offset=(0.0, 0.0, 0.0)) -> DataFrame:
    """Upright prism over a polygon; the cheap z test comes first."""
    return _select(df, prism_mask(poly, base_z, height, offset))


def sphere_mask(center: Sequence[float], radius: float) -> Column:
    d = [F.col(c) - F.lit(float(v)) for c, v in zip("xyz", center)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.lit(float(radius) * float(radius))


def select_sphere(df: DataFrame, center: Sequence[float], radius: float = 0.3) -> DataFrame:
    return _select(df, sphere_mask(center, radius))


def select_spheres(df: DataFrame, centers: DataFrame, radius: float = 0.3, max_broadcast: int = 200_000) -> DataFrame:
    """Select points within ``radius`` of any row of ``centers`` (x, y, z).

    Centres are spread to the 27 cells they can reach; each point looks up its
    own cell once. A semi and an anti join split the cloud where it is: points are
    never multiplied and never shuffled by id, and rows that share an id keep their own flag.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(float(radius)))

    step = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    spread = centers.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"),
                            cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    for c in ("cx", "cy", "cz"):
        spread = spread.withColumn("d", F.explode(step)).withColumn(c, F.col(c) + F.col("d")).drop("d")
    if spread.count() <= max_broadcast:
        spread = F.broadcast(spread)
    keyed = df.withColumns({"cx": cell("x"), "cy": cell("y"), "cz": cell("z")})
    d2 = sum(((F.col(c) - F.col("q" + c)) * (F.col(c) - F.col("q" + c)) for c in "yz"),
             (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    cond = [keyed[c] == spread[c] for c in ("cx", "cy", "cz")] + [d2 <= F.lit(float(radius) * float(radius))]
    hit, rest = (keyed.join(spread, cond, how).select(*df.columns, F.lit(flag).alias("hit")) for how, flag in (("left_semi", True), ("left_anti", False)))
    return _select(hit.unionByName(rest), F.col("hit")).drop("hit")


PICK_CELL = 8  # points per screen cell at which cells are not divided further


def _pick(df: DataFrame, picks: DataFrame, score: Column, ok: Column, max_px: float, by_distance: bool) -> DataFrame:
    """Best point per screen pick.

    Picks descend through screen cells, from cells of ``max_px`` to those of a few points, and at every level keep the
    cells that can hold the best point: the least score of a cell is known (``by_distance``: bounded by the cell's place),
    and a cell that lies within reach bounds the best one. So picks meet the points of few small cells only, however
    many share the screen.
    """
    pts = df.where(ok).withColumn("score", F.lit(0.0) if by_distance else score).where(
        (F.abs("sx") < F.lit(math.inf)) & (F.abs("sy") < F.lit(math.inf)))
    wide, reach = float(max_px), F.lit(float(max_px) ** 2)

    def bins(c: str, level: int) -> Column:
        return F.floor(F.col(c) / F.lit(wide * 0.5 ** level))

    size = pts.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(bins("sx", 0), bins("sy", 0))).alias("cells")).first()
    finest = min(16, max(0, math.ceil(math.log(max(size["n"], 1) / max(size["cells"], 1) / PICK_CELL + 1e-9, 4))))
    keyed = pts.withColumns({"gx": bins("sx", finest), "gy": bins("sy", finest)})
    cells = keyed.groupBy("gx", "gy").agg(F.min("score").alias("least"))
    cells = cut(cells) if finest else cells
    step = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    at = (picks.select("pick_id", F.col("sx").alias("px"), F.col("sy").alias("py"), bins("sx", 0).alias("gx"), bins("sy", 0).alias("gy"))
          .withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
          .select("pick_id", "px", "py", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")))
    slack = F.lit(1e-9) * (F.abs("px") + F.abs("py") + F.lit(wide))
    for level in range(finest + 1):
        up, edge = finest - level, F.lit(wide * 0.5 ** level)
        there = cells if not up else cells.groupBy(F.shiftright("gx", up).alias("gx"), F.shiftright("gy", up).alias("gy")).agg(F.min("least").alias("least"))
        if level:
            half = F.array(*[F.lit(k).cast("long") for k in (0, 1)])
            at = at.withColumn("dx", F.explode(half)).withColumn("dy", F.explode(half)).select(
                "pick_id", "px", "py", (F.col("gx") * 2 + F.col("dx")).alias("gx"), (F.col("gy") * 2 + F.col("dy")).alias("gy"))
        near, far = F.lit(0.0), F.lit(0.0)
        for p, g in (("px", "gx"), ("py", "gy")):
            low, high = F.col(g) * edge - F.col(p), (F.col(g) + 1) * edge - F.col(p)
            inner = F.greatest(F.greatest(low, -high) - slack, F.lit(0.0))
            outer = F.greatest(F.abs(low), F.abs(high)) + slack
            near, far = near + inner * inner, far + outer * outer
        # NaN is the largest number: no bound
        bound = far if by_distance else F.when(far <= reach, F.col("least")).otherwise(F.lit(math.nan))
        at = (at.join(there, ["gx", "gy"]).withColumns({"near": near, "bound": bound}).where(F.col("near") <= reach)
              .withColumn("best", F.min("bound").over(Window.partitionBy("pick_id")))
              .where(F.col("near" if by_distance else "least") <= F.col("best")).select("pick_id", "px", "py", "gx", "gy"))
        at = cut(at) if level % 4 == 3 else at
    d2 = (F.col("sx") - F.col("px")) * (F.col("sx") - F.col("px")) + (F.col("sy") - F.col("py")) * (F.col("sy") - F.col("py"))
    hits = keyed.join(at, ["gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= reach)
    return (hits.groupBy("pick_id").agg(F.min(F.struct((F.col("d2") if by_distance else F.col("score")).alias("score"), "point_id", "d2")).alias("best"))
            .select("pick_id", "best.point_id", "best.score", "best.d2"))


def pick_nearest_px(df: DataFrame, picks: DataFrame, max_px: float = 10.0) -> DataFrame:
    """Per pick the visible point nearest on screen; no row when none is within ``max_px``."""
    return _pick(df, picks, F.col("d2"), on_screen() & visible(df), max_px, True)


def pick_front(df: DataFrame, picks: DataFrame, mvp: Sequence[float], max_px: float = 16.0) -> DataFrame:
    """Per pick the visible point nearest the eye among those within ``max_px``."""
    w = clip_coordinates(mvp, F.col("x"), F.col("y"), F.col("z"))[3]
    return _pick(df.withColumn("w", w), picks, F.col("w"), (F.col("w") > 0) & visible(df), max_px, False)


def select_all(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", visible(df))


def clear(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", F.lit(False))


def invert(df: DataFrame) -> DataFrame:
    return df.withColumn("selected", ~selected(df) & visible(df))


def delete_selected(df: DataFrame) -> DataFrame:
    """Rows that are not selected, with the selection cleared."""
    return df.where(~selected(df)).withColumn("selected", F.lit(False))


def delete_counted(df: DataFrame, name: str = "deleted") -> tuple[DataFrame, Observation]:
    """``delete_selected`` and an observation whose ``n_deleted`` and ``n_kept`` hold once the result has been computed."""
    seen = Observation(name)
    counted = df.observe(seen, F.count_if(selected(df)).alias("n_deleted"), F.count_if(~selected(df)).alias("n_kept"))
    return delete_selected(counted), seen
