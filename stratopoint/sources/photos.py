"""Flight folders: photo inventory, geotags, rasters, thermal grids."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import basename

HEAD = 256 * 1024
# Metadata patterns of the drone photos.
XMP_ALT = r'RelativeAltitude\s*=\s*"?([+-]?[0-9.]+)'
XMP_LAT = r'GpsLatitude\s*=\s*"?([+-]?[0-9.]+)'
XMP_LON = r'GpsLon[gG]itude\s*=\s*"?([+-]?[0-9.]+)'


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(folder).select("path", "length"))


def scan_photos(spark: SparkSession, folder: str) -> DataFrame:
    """path, name of the colour photos: the _V series, or else all JPEGs except thermal ones."""
    every = _files(spark, folder, "*.{jpg,JPG,jpeg,JPEG}").select("path", basename(F.col("path")).alias("name"))
    series = every.where(F.col("name").rlike(r"_V\.(JPG|jpg)$"))
    chosen = series if series.head(1) else every.where(~F.upper("name").endswith("_T.JPG"))
    return chosen.distinct().orderBy("path")


def scan_thermal(spark: SparkSession, folder: str) -> DataFrame:
    return _files(spark, folder, "*_T.JPG").select("path", basename(F.col("path")).alias("name"))


def photo_summary(photos: DataFrame, thermal: DataFrame) -> DataFrame:
    n = thermal.agg(F.count(F.lit(1)))
    return photos.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.min_by("name", "path"), F.lit("")).alias("example")).withColumn(
        "thermal", n.scalar())


def _gps_ifd(head: bytes) -> tuple[float, float] | None:
    """Latitude and longitude from the EXIF GPS directory of a JPEG head."""
    at = head.find(b"Exif\x00\x00")
    if at < 0:
        return None
    tiff = head[at + 6:]
    order = "<" if tiff[:2] == b"II" else ">"

    def directory(offset: int) -> dict[int, tuple[int, int, int]]:
        (n,) = struct.unpack_from(order + "H", tiff, offset)
        return {t: (k, c, offset + 2 + 12 * i + 8) for i in range(n)
                for t, k, c in [struct.unpack_from(order + "HHI", tiff, offset + 2 + 12 * i)]}

    def pointer(place: int) -> int:
        return struct.unpack_from(order + "I", tiff, place)[0]

    main = directory(pointer(4))
    if 0x8825 not in main:
        return None
    gps = directory(pointer(main[0x8825][2]))
    if 2 not in gps or 4 not in gps:
        return None

    def degrees(tag: int, ref: int, negative: bytes) -> float:
        parts = struct.unpack_from(order + "6I", tiff, pointer(gps[tag][2]))
        d, m, s = (parts[2 * i] / parts[2 * i + 1] for i in range(3))
        side = tiff[gps[ref][2]:gps[ref][2] + 1] if ref in gps else b""
        return (d + m / 60 + s / 3600) * (-1.0 if side.upper() == negative else 1.0)

    return degrees(2, 1, b"S"), degrees(4, 3, b"W")


EXIF_TYPE = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def exif_gps(head: Column) -> Column:
    @F.pandas_udf(EXIF_TYPE)
    def parse(heads: pd.Series) -> pd.DataFrame:
        rows = []
        for h in heads:
            try:
                rows.append(_gps_ifd(bytes(h)) or (None, None))
            except (struct.error, ZeroDivisionError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["lat", "lon"], dtype="float64")

    return parse(head)


def read_heads(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPG,jpeg,JPEG}") -> DataFrame:
    """name and the first 256 KB of every photo."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select(basename(F.col("path")).alias("name"), F.substring("content", 1, HEAD).alias("head"))


def geotags(heads: DataFrame) -> DataFrame:
    """name, lat, lon, rel_alt of every photo that has all three.

    Position from EXIF, or from XMP when EXIF has none; height from XMP.
    """
    text = F.decode("head", "ISO-8859-1")

    def xmp(pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("double")

    df = heads.withColumn("gps", exif_gps(F.col("head")))
    pair = xmp(XMP_LAT).isNotNull() & xmp(XMP_LON).isNotNull() & F.col("gps.lat").isNull()
    lat = F.when(pair, xmp(XMP_LAT)).otherwise(F.col("gps.lat"))
    lon = F.when(pair, xmp(XMP_LON)).otherwise(F.col("gps.lon"))
    out = df.select("name", lat.alias("lat"), lon.alias("lon"), xmp(XMP_ALT).alias("rel_alt"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL AND rel_alt IS NOT NULL").dropDuplicates(["name"])


def merge_geotags(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows, and fallback rows only for names the primary lacks."""
    return primary.unionByName(fallback.join(primary.select("name"), "name", "left_anti"))


def _resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Windowed-sinc (three lobes) resampling, separable, widened when shrinking."""
    def axis(a: np.ndarray, n: int) -> np.ndarray:
        scale = a.shape[0] / n
        reach = 3.0 * max(scale, 1.0)
        out = np.empty((n, *a.shape[1:]))
        for i in range(n):
            c = (i + 0.5) * scale
            lo, hi = max(int(c - reach + 0.5), 0), min(int(c + reach + 0.5), a.shape[0])
            x = (np.arange(lo, hi) + 0.5 - c) / max(scale, 1.0)
            k = np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)
            out[i] = np.tensordot(k / k.sum(), a[lo:hi], axes=1)
        return out

    rows = axis(img.astype(float), h)
    both = axis(rows.transpose(1, 0, 2), w).transpose(1, 0, 2)
    return np.clip(np.rint(both), 0, 255).astype(np.uint8)


RASTER = "name string, height int, width int, n_channels int, data binary"


def read_images(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """Decoded photos: name, height, width, n_channels, data as stored by Spark (BGR)."""
    df = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(folder)
    return df.select(basename(F.col("image.origin")).alias("name"), "image.height", "image.width",
                     F.col("image.nChannels").alias("n_channels"), "image.data")


def prepare_images(images: DataFrame, max_width: int = 1600, done: DataFrame | None = None) -> DataFrame:
    """RGB rasters no larger than ``max_width`` on the longer side; never enlarged.

    Names in ``done`` are left out. The unit of work is one image.
    """
    todo = images if done is None else images.join(done.select("name").distinct(), "name", "left_anti")

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels)
                img = img[:, :, 2::-1] if r.n_channels >= 3 else np.repeat(img[:, :, :1], 3, 2)
                s = max_width / max(r.width, r.height)
                if s < 1.0:
                    img = _resize(img, round(r.width * s), round(r.height * s))
                rows.append((r.name, img.shape[0], img.shape[1], 3, np.ascontiguousarray(img).tobytes()))
            yield pd.DataFrame(rows, columns=["name", "height", "width", "n_channels", "data"])

    return todo.select("name", "height", "width", "n_channels", "data").mapInPandas(run, RASTER)


def temperature_rasters(spark: SparkSession, folder: str, width: int = 640, height: int = 512) -> DataFrame:
    """name, height, width, data ARRAY<FLOAT> of raw little-endian grids; files of another size are unusable."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.f32").load(folder)
           .where(F.col("length") == width * height * 4).select(basename(F.col("path")).alias("name"), "content"))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"name": pdf["name"], "height": height, "width": width, "n_channels": 1,
                                "data": [np.frombuffer(c, "<f4") for c in pdf["content"]]})

    return raw.mapInPandas(run, "name string, height int, width int, n_channels int, data array<float>")
