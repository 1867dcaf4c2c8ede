"""Text inputs and outputs: telemetry subtitles, camera models, JSON side files, stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import matvec_cols, transpose_cols
from ..functions.names import clock_seconds
from ..operators.transform import mat_to_quat, quat_to_mat


def parse_telemetry(blocks: DataFrame) -> DataFrame:
    """t, lat, lon, rel_alt from subtitle blocks (column ``value``); incomplete blocks are dropped."""
    def number(label: str) -> Column:
        return F.regexp_extract("value", label + r":\s*([-\d.]+)", 1).try_cast("double")

    df = blocks.select(clock_seconds(F.col("value")).alias("t"), number("latitude").alias("lat"),
                       number("longitude").alias("lon"), number("rel_alt").alias("rel_alt"))
    return df.where("t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND rel_alt IS NOT NULL")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Subtitle files cut at blank lines; one flight is one small file, a folder is many rows."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.explode(F.split("value", r"\n\s*\n")).alias("value"))
    return parse_telemetry(blocks).orderBy("t")


# ------------------------------------------------------------ camera models

def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#"))


def _doubles(tokens: Column, start: int, length: Column | int) -> Column:
    return F.transform(F.slice(tokens, start, length), lambda v: v.cast("double"))


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, model_points) of a text model: cameras.txt, images.txt, points3D.txt."""
    w = F.split(F.trim("value"), r"\s+")
    optics = _lines(spark, f"{folder}/cameras.txt").where("trim(value) <> ''").select(
        w[0].cast("int").alias("camera_no"), w[1].alias("model"), w[2].cast("int").alias("width"), w[3].cast("int").alias("height"),
        _doubles(w, 5, F.size(w) - 4).alias("params"))
    # image lines have ten words and a name that is no number; the lines between hold only keypoints
    image = _lines(spark, f"{folder}/images.txt").where(F.size(w) == 10).where(w[9].try_cast("double").isNull()).select(
        w[0].cast("int").alias("cam_id"), _doubles(w, 2, 4).alias("q"), _doubles(w, 6, 3).alias("t"),
        w[8].cast("int").alias("camera_no"), w[9].alias("name"))
    posed = image.withColumn("r", quat_to_mat(F.col("q")))
    back = matvec_cols(transpose_cols(F.col("r")), F.col("t"))
    cameras = posed.withColumn("c", F.struct(*[(-v).alias(n) for v, n in zip(back, "xyz")])).join(optics, "camera_no").select(
        "cam_id", "name", "r", "t", "c", "width", "height", "model", "params", "camera_no")
    pts = _lines(spark, f"{folder}/points3D.txt").where(F.size(w) >= 8)
    points = pts.select(w[0].cast("long").alias("pid"), *[w[i].cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))],
                        *[w[i].cast("short").alias(n) for i, n in ((4, "red"), (5, "green"), (6, "blue"))],
                        w[7].cast("double").alias("err"), ((F.size(w) - 8) / 2).cast("int").alias("track"))
    return cameras, points


def _ten_digits(c: Column) -> Column:
    return F.format_string("%.10g", c)


def model_lines(cameras: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text lines of a model: cameras, images (quaternion and shift), points."""
    optics = cameras.select("camera_no", "model", "width", "height", "params").dropDuplicates(["camera_no"])
    cam = optics.select(F.concat_ws(" ", "camera_no", "model", "width", "height", F.transform("params", _ten_digits)).alias("value"))
    posed = cameras.withColumn("q", mat_to_quat(F.col("r")))
    img = posed.select(F.concat(F.concat_ws(" ", "cam_id", F.transform("q", _ten_digits), F.transform("t", _ten_digits),
                                            "camera_no", "name"), F.lit("\n")).alias("value"))
    pts = points.select(F.format_string("%d %.6f %.6f %.6f %d %d %d %.3f", "pid", "x", "y", "z", "red", "green", "blue", "err").alias("value"))
    return cam, img, pts


def write_model(cameras: DataFrame, points: DataFrame, folder: str) -> None:
    for df, name in zip(model_lines(cameras, points), ("cameras.txt", "images.txt", "points3D.txt")):
        df.write.mode("overwrite").text(f"{folder}/{name}")


# --------------------------------------------------------------- JSON files

def read_geotag_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON object name -> [lat, lon, rel_alt] as a table."""
    text = spark.read.text(path, wholetext=True)
    tags = text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "v"))
    return tags.select("name", F.col("v")[0].alias("lat"), F.col("v")[1].alias("lon"), F.col("v")[2].alias("rel_alt"))


def geotag_json(tags: DataFrame) -> DataFrame:
    """One JSON object per line and photo; a photo table can be larger than one string."""
    return tags.select(F.to_json(F.create_map("name", F.array("lat", "lon", "rel_alt"))).alias("value"))


def read_matrix_json(spark: SparkSession, path: str, field: str) -> list[list[float]]:
    """A small matrix (or list of points) stored under ``field``."""
    row = spark.read.text(path, wholetext=True).select(
        F.from_json("value", f"`{field}` array<array<double>>").alias("j")).first()
    return [list(r) for r in row["j"][field]]


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of [x, y, z] as (pair_id, x, y, z)."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<array<double>>")).alias("pair_id", "p"))
    return rows.select("pair_id", *[F.col("p")[i].alias(n) for i, n in enumerate("xyz")])


# ------------------------------------------------------------------- stages

def stage(spark: SparkSession, work: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table under ``work``: read when it is complete, else built and written."""
    path = f"{work}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
