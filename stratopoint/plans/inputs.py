"""Tables derived from the given parquet files.

Each entry is (table, select expressions) in SQL that Spark and DuckDB read
alike, so a query and its oracle start from the same rows. Literals use
exponent form: that is DOUBLE in both engines. Nothing is filtered: every row
of the given table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DERIVED: dict[str, tuple[str, list[str]]] = {
    "fx_points": ("events", [
        "event_id AS point_id",
        "CAST(event_id % 3 AS INT) AS cloud_id",
        "((event_id * 7919) % 20011) / 1e2 - 1e2 AS x",
        "((event_id * 104729) % 20021) / 1e2 - 1e2 AS y",
        "value / 25e0 AS z",
        "CASE WHEN event_id % 3 = 2 THEN NULL ELSE value END AS intensity",
    ]),
    "fx_dense": ("lineitem", [
        "l_orderkey AS point_id",
        "l_partkey / 1e1 AS x", "l_suppkey * 1e0 AS y", "l_quantity AS z",
        "l_extendedprice AS intensity",
    ]),
    "fx_cameras": ("supplier", [
        "CAST(s_suppkey AS INT) AS cam_id",
        "concat('DJI_20260101000000_', lpad(CAST(s_suppkey AS VARCHAR(10)), 6, '0'), '_V.JPG') AS name",
        "((s_suppkey * 104729) % 2011) / 1e1 - 1e2 AS c_x",
        "((s_suppkey * 7919) % 2003) / 1e1 - 1e2 AS c_y",
        "45e0 + s_suppkey % 7 AS c_z",
        "CASE s_suppkey % 4 WHEN 0 THEN 6e-1 WHEN 1 THEN 8e-1 WHEN 2 THEN -6e-1 ELSE 28e-2 END AS cosv",
        "CASE s_suppkey % 4 WHEN 0 THEN 8e-1 WHEN 1 THEN 6e-1 WHEN 2 THEN 8e-1 ELSE 96e-2 END AS sinv",
        "125e0 AS f", "80e0 AS pcx", "64e0 AS pcy", "1e-2 AS k",
        "160 AS width", "128 AS height",
    ]),
    "fx_geotags": ("supplier", [
        "concat('DJI_20260101000000_', lpad(CAST(s_suppkey AS VARCHAR(10)), 6, '0'), '_V.JPG') AS name",
        "515e-1 + degrees((((s_suppkey * 7919) % 2003) / 1e1 - 1e2) / 6378137e0) AS lat",
        "74e-1 + degrees((((s_suppkey * 104729) % 2011) / 1e1 - 1e2) / (6378137e0 * cos(radians(515e-1)))) AS lon",
        "45e0 + s_suppkey % 7 AS rel_alt",
    ]),
    "fx_telemetry": ("events", [
        "event_id / 1e1 + ((event_id * 37) % 10) / 1e2 AS t",
        "515e-1 + event_id * 1e-6 AS lat",
        "74e-1 + (event_id % 97) * 1e-6 AS lon",
        "value / 1e1 AS rel_alt",
    ]),
    "fx_video_frames": ("orders", [
        "o_orderkey AS frame",
        "o_orderkey * 37e-2 AS t",
    ]),
    "fx_messages": ("events", [
        "CASE WHEN user_id % 4 = 0 THEN '/raw' ELSE '/cloud_registered' END AS topic",
        "ts", "event_id AS msg_seq",
        "((event_id * 7919) % 2003) / 1e2 AS x", "((event_id * 104729) % 2011) / 1e2 AS y",
        "value / 1e2 AS z",
    ]),
    # a gently stepped surface and the same surface seen by a rotated model
    "fx_surface": ("events", [
        "event_id AS point_id",
        "((event_id * 7919) % 997) / 1e1 AS x",
        "((event_id * 104729) % 1009) / 1e1 AS y",
        "((floor(((event_id * 7919) % 997) / 83e0) * 3 + floor(((event_id * 104729) % 1009) / 101e0) * 5) % 7)"
        " + floor(((event_id * 7919) % 997) / 250e0) AS z",
    ]),
    "fx_splats": ("events", [
        "event_id AS point_id",
        "((event_id * 7919) % 20011) / 1e2 - 1e2 AS x",
        "((event_id * 104729) % 20021) / 1e2 - 1e2 AS y",
        "value / 25e0 AS z",
        "(((event_id * 7919) % 20011) / 1e2 - 1e2) / 5e1 AS f_dc_0",
        "(((event_id * 104729) % 20021) / 1e2 - 1e2) / 5e1 AS f_dc_1",
        "value / 1250e0 AS f_dc_2",
        "value / 25e0 - 5e0 AS opacity",
        "value / 125e0 AS scale_0", "value / 250e0 AS scale_1", "(5e2 - value) / 4e2 AS scale_2",
    ]),
}


PAINTED = 32  # rasters in memory at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a small file comes as one task; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = DERIVED[name]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def with_sql(*names: str) -> str:
    """WITH clause giving the named derived tables to an oracle query."""
    parts = [f"{n} AS (SELECT {', '.join(DERIVED[n][1])} FROM {DERIVED[n][0]})" for n in names]
    return "WITH " + ", ".join(parts)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derived(spark, sf_dir, "fx_points"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived cameras in the package's camera schema (nadir, rotated about z)."""
    c = derived(spark, sf_dir, "fx_cameras")
    zero = F.lit(0.0)
    return c.select(
        "cam_id", "name",
        F.array("cosv", "sinv", zero, "sinv", -F.col("cosv"), zero, zero, zero, F.lit(-1.0)).alias("r"),
        F.array(
            -(F.col("cosv") * F.col("c_x") + F.col("sinv") * F.col("c_y")),
            -(F.col("sinv") * F.col("c_x") - F.col("cosv") * F.col("c_y")),
            F.col("c_z"),
        ).alias("t"),
        F.struct(F.col("c_x").alias("x"), F.col("c_y").alias("y"), F.col("c_z").alias("z")).alias("c"),
        "width", "height", F.lit("SIMPLE_RADIAL").alias("model"),
        F.array("f", "pcx", "pcy", "k").alias("params"),
    )


def _paint(channels):
    """Rasters from integer formulas, painted in the executors from camera ids and sizes."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for first in range(0, len(pdf), PAINTED):     # a batch of cameras would be gigabytes of pixels
                some, rows = pdf.iloc[first:first + PAINTED], []
                for cam, w, h in zip(some["cam_id"], some["width"], some["height"]):
                    v, u = np.mgrid[0:h, 0:w]
                    planes = [(a * u + b * v + c * int(cam)) % m for a, b, c, m in channels]
                    if len(planes) == 3:
                        data = np.stack(planes, -1).astype(np.uint8).tobytes()
                    else:
                        data = (10.0 + planes[0] / 10.0).astype(np.float32).ravel()
                    rows.append((cam, h, w, len(planes), data))
                yield pd.DataFrame(rows, columns=["cam_id", "height", "width", "n_channels", "data"])

    return run


def images(cams: DataFrame) -> DataFrame:
    """RGB raster per camera: (7u+13v+31cam, 3u+5v+17cam, u+v+101cam) mod 256."""
    channels = ((7, 13, 31, 256), (3, 5, 17, 256), (1, 1, 101, 256))
    return spread(cams.select("cam_id", "width", "height")).mapInPandas(
        _paint(channels), "cam_id int, height int, width int, n_channels int, data binary")


def thermal(cams: DataFrame) -> DataFrame:
    """Float raster per camera: 10 + ((11u+17v+29cam) mod 400) / 10."""
    return spread(cams.select("cam_id", "width", "height")).mapInPandas(
        _paint(((11, 17, 29, 400),)), "cam_id int, height int, width int, n_channels int, data array<float>")
