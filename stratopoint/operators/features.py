"""Global registration of two clouds: point feature histograms, matching, sampled and graduated pose search.

Meant for thinned clouds (a voxel is a fixed share of the diagonal), so the number of features is bounded by the
voxel grid and not by the input; ``MOST_PAIRS`` makes that bound explicit where pairs are handed to every task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear as la
from ..session import cut
from .icp import NORMAL, XYZ
from .neighbours import knn_join

BINS = 11               # per angle; three angles make a histogram of 33
MOST_PAIRS = 500_000
BLOCK = 1024            # features of one side in a block of the matching


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def _pair_bins() -> list[Column]:
    """Bins of the three angles between the normals p*, o* of a pair and its line d*.

    The frame sits at the end whose normal is closer to the line, which makes the angles independent of the order."""
    line = [F.col("d" + c) / F.sqrt("d2") for c in XYZ]
    np_, no = [F.col("p" + c) for c in NORMAL], [F.col("o" + c) for c in NORMAL]
    flip = F.abs(_dot(np_, line)) < F.abs(_dot(no, line))
    u = [F.when(flip, o).otherwise(p) for p, o in zip(np_, no)]
    other = [F.when(flip, p).otherwise(o) for p, o in zip(np_, no)]
    d = [F.when(flip, -c).otherwise(c) for c in line]
    v = _cross(d, u)
    size = F.sqrt(_dot(v, v))
    v = [F.when(size > 0, c / size).otherwise(0.0) for c in v]
    w = _cross(u, v)
    values = [((_dot(v, other)) + 1) / 2, (_dot(u, d) + 1) / 2, (F.atan2(_dot(w, other), _dot(u, other)) + math.pi) / (2 * math.pi)]
    return [F.least(F.greatest(F.floor(x * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int") for x in values]


def fpfh(cloud: DataFrame, radius: float, max_nn: int = 100) -> DataFrame:
    """point_id, f (33 numbers) of a cloud with normals: fast point feature histograms (Rusu et al. 2009).

    A point's simple histogram counts the pair angles to its neighbours, in percent; its feature adds the neighbours'
    histograms weighted by one over the squared distance and brings each angle's part to 100.
    """
    near = knn_join(cloud, cloud, max_nn, radius, offsets=True).where("distance2 > 0") \
        .select("point_id", "neighbour", F.col("distance2").alias("d2"), *["d" + c for c in XYZ])
    mine = cloud.select("point_id", *[F.col(c).alias("p" + c) for c in NORMAL])
    theirs = cloud.select(F.col("point_id").alias("neighbour"), *[F.col(c).alias("o" + c) for c in NORMAL])
    near = cut(near)
    pairs = near.join(mine, "point_id").join(theirs, "neighbour")
    bins = dict(zip(("b0", "b1", "b2"), _pair_bins()))
    share = [(F.count_if(F.col(b) == i) * 100.0 / F.count(F.lit(1))).alias(f"{b}_{i}") for b in bins for i in range(BINS)]
    names = [f"b{k}_{i}" for k in range(3) for i in range(BINS)]
    simple = cut(pairs.withColumns(bins).groupBy("point_id").agg(*share))
    around = near.join(simple.withColumnRenamed("point_id", "neighbour"), "neighbour").groupBy("point_id").agg(
        *[F.sum(F.col(n) / F.col("d2")).alias("s" + n) for n in names])
    parts = []
    for k in range(3):
        mine_k = names[k * BINS:(k + 1) * BINS]
        total = sum((F.col("s" + n) for n in mine_k[1:]), F.col("s" + mine_k[0]))
        parts += [F.when(total > 0, F.col("s" + n) * 100.0 / total).otherwise(0.0) + F.col(n) for n in mine_k]
    found = simple.join(around, "point_id").select("point_id", F.array(*parts).alias("f"))
    empty = F.array(*[F.lit(0.0)] * (3 * BINS))
    return cloud.select("point_id").join(found, "point_id", "left").select("point_id", F.coalesce("f", empty).alias("f"))


def nearest_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """point_id of ``a``, other of ``b`` and d2: the exact nearest feature, the lower id among equals.

    Features travel in blocks of ``BLOCK``; a task compares one block with one block and passes on one row per feature."""
    def blocked(df: DataFrame, side: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK))
        packed = df.withColumn(side, F.pmod(F.xxhash64("point_id"), F.lit(n))).groupBy(side).agg(F.collect_list(F.struct("point_id", "f")).alias("items_" + side))
        return packed, n

    (left, _), (right, n) = blocked(a, "l"), blocked(b, "r")
    pairs = left.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(right, "r")

    def best(frames):
        for pdf in frames:
            for mine, theirs in zip(pdf["items_l"], pdf["items_r"]):
                theirs = sorted(theirs, key=lambda t: t["point_id"])
                x, y = (np.array([np.asarray(t["f"], float) for t in side]) for side in (mine, theirs))
                d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0).round(6)
                k = d2.argmin(1)
                yield pd.DataFrame({"point_id": [t["point_id"] for t in mine], "other": [theirs[i]["point_id"] for i in k], "d2": d2[np.arange(len(k)), k]})

    found = pairs.select("items_l", "items_r").mapInPandas(best, "point_id long, other long, d2 double")
    return found.groupBy("point_id").agg(F.min_by("other", F.struct("d2", "other")).alias("other"), F.min("d2").alias("d2"))


def match_features(source: DataFrame, target: DataFrame, f_source: DataFrame, f_target: DataFrame, mutual: bool = True) -> DataFrame:
    """Corresponding points sx.., tx..: nearest features, with ``mutual`` only those that choose each other."""
    pairs = nearest_features(f_source, f_target).select("point_id", "other")
    if mutual:
        back = nearest_features(f_target, f_source).select(F.col("point_id").alias("other"), F.col("other").alias("point_id"))
        pairs = pairs.join(back, ["point_id", "other"])
    s = source.select("point_id", *[F.col(c).alias("s" + c) for c in XYZ])
    t = target.select(F.col("point_id").alias("other"), *[F.col(c).alias("t" + c) for c in XYZ])
    return pairs.join(s, "point_id").join(t, "other")


def _few(pairs: DataFrame) -> np.ndarray:
    """The pairs as an array, by point_id; raises beyond the bound under which they may be handed to all tasks."""
    cols = ["s" + c for c in XYZ] + ["t" + c for c in XYZ]
    if pairs.count() > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs: thin the clouds first")
    return pairs.orderBy("point_id", "other").select(*cols).toPandas().to_numpy().reshape(-1, 6)


def rigid_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Least-squares rotations and shifts (n x 3 x 4) of n small point sets (n x k x 3)."""
    ms, mt = s.mean(1, keepdims=True), t.mean(1, keepdims=True)
    u, _, vt = np.linalg.svd(np.swapaxes(t - mt, 1, 2) @ (s - ms))
    sign = np.ones((len(s), 1, 3))
    sign[:, 0, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    r = (u * sign) @ vt
    return np.concatenate([r, np.swapaxes(mt - ms @ np.swapaxes(r, 1, 2), 1, 2)], 2)


def ransac_pose(pairs: DataFrame, distance: float, edge: float = 0.9, trials: int = 400_000, seed: int = 0) -> tuple[np.ndarray, float]:
    """Pose with most pairs within ``distance``, and their share, over seeded triples of pairs.

    A triple is tried only if its three edges have similar lengths on both sides. Trials are rows, dealt to tasks."""
    spark, table = pairs.sparkSession, _few(pairs)
    if len(table) < 3:
        return np.eye(4), 0.0
    shared = spark.sparkContext.broadcast(table)

    def run(frames):
        p = shared.value
        for pdf in frames:
            draws = np.random.default_rng([seed, int(pdf["id"].iloc[0])]).integers(0, len(p), (len(pdf), 3))
            draws = draws[(draws[:, 0] != draws[:, 1]) & (draws[:, 1] != draws[:, 2]) & (draws[:, 0] != draws[:, 2])]
            s, t = p[draws, :3], p[draws, 3:]
            ls, lt = (np.linalg.norm(x - np.roll(x, 1, 1), axis=2) for x in (s, t))
            good = ((ls >= edge * lt) & (lt >= edge * ls) & (ls > 0)).all(1)
            best = (-1, -1.0, np.zeros(12))
            for m in rigid_of(s[good], t[good]) if good.any() else ():
                r2 = ((p[:, :3] @ m[:, :3].T + m[:, 3] - p[:, 3:]) ** 2).sum(1)
                near = r2 < distance * distance
                best = max(best, (int(near.sum()), -float(r2[near].sum()), m.ravel()), key=lambda b: b[:2])
            yield pd.DataFrame({"n": [best[0]], "cost": [best[1]], "m": [best[2].tolist()]})

    tasks = 4 * spark.sparkContext.defaultParallelism
    won = spark.range(0, trials, 1, tasks).mapInPandas(run, "n int, cost double, m array<double>").agg(F.max(F.struct("n", "cost", "m"))).first()[0]
    if won is None or won["n"] < 3:
        return np.eye(4), 0.0
    m = np.array(won["m"]).reshape(3, 4)
    return la.join4(m[:, :3], m[:, 3]), won["n"] / len(table)


def graduated_poses(pairs: DataFrame, distance: float, trials: int = 10, edge: float = 0.95, tuples: int = 1000, seed: int = 0) -> list[np.ndarray]:
    """Poses by fast global registration (Zhou et al. 2016), one per trial, all trials in the same jobs.

    A trial keeps the pairs of seeded triples with similar edges. Then each round weighs every pair by
    (mu / (mu + r^2))^2 and solves the weighted rigid fit from sums, while mu shrinks to the squared distance."""
    spark, table = pairs.sparkSession, _few(pairs)
    if len(table) < 3:
        return []
    rows = []
    for trial in range(trials):
        draws = np.random.default_rng([seed, trial]).integers(0, len(table), (100 * tuples, 3))
        s, t = table[draws, :3], table[draws, 3:]
        ls, lt = (np.linalg.norm(x - np.roll(x, 1, 1), axis=2) for x in (s, t))
        keep = np.unique(draws[((ls >= edge * lt) & (lt >= edge * ls) & (ls > 0)).all(1)][:tuples])
        keep = keep if len(keep) >= 3 else np.arange(len(table))
        rows.append(pd.DataFrame(table[keep], columns=["s" + c for c in XYZ] + ["t" + c for c in XYZ]).assign(trial=trial))
    held = cut(spark.createDataFrame(pd.concat(rows)))
    span = table.max(0) - table.min(0)
    mu, poses = float((span ** 2).sum()), {k: np.eye(4) for k in range(trials)}
    while True:
        lanes = spark.createDataFrame([(k, *map(float, m[:3].ravel())) for k, m in poses.items()], "trial int, " + ", ".join(f"m{i} double" for i in range(12)))
        df = held.join(F.broadcast(lanes), "trial")                           # one row per trial
        gone = [F.col("t" + c) - sum((F.col(f"m{4 * i + j}") * F.col("s" + b) for j, b in enumerate(XYZ)), F.col(f"m{4 * i + 3}")) for i, c in enumerate(XYZ)]
        w = F.pow(F.lit(mu) / (F.lit(mu) + gone[0] * gone[0] + gone[1] * gone[1] + gone[2] * gone[2]), F.lit(2.0))
        sums = df.withColumn("w", w).groupBy("trial").agg(
            F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(p + c)).alias(p + c) for p in "st" for c in XYZ],
            *[F.sum(F.col("w") * F.col("t" + a) * F.col("s" + b)).alias(a + b) for a in XYZ for b in XYZ]).collect()
        for r in sums:
            ms, mt = (np.array([r[p + c] for c in XYZ]) / r["w"] for p in "st")
            u, _, vt = np.linalg.svd(np.array([[r[a + b] for b in XYZ] for a in XYZ]) / r["w"] - np.outer(mt, ms))
            turn = (u * [1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt))]) @ vt
            poses[r["trial"]] = la.join4(turn, mt - turn @ ms)
        if mu <= distance * distance:
            return [poses[k] for k in range(trials)]
        mu = max(mu / 1.96, distance * distance)


def feature_pairs(source: DataFrame, target: DataFrame, voxel: float, mutual: bool = True) -> DataFrame:
    """Corresponding points of two thinned clouds with normals, features at five voxels."""
    return cut(match_features(source, target, cut(fpfh(source, 5 * voxel)), cut(fpfh(target, 5 * voxel)), mutual))
