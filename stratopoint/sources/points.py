"""One entry for all point inputs."""

from __future__ import annotations

import json
import posixpath

import pandas as pd
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .files import list_files, open_fs, read_range
from .pcd import PcdSource
from .ply import PlySource
from .records import Chunk
from .rosbag import RosbagSource, bag_cloud
from .table import DEFAULT_SPLIT, PointFile, PointReader, merged_schema


def register(spark: SparkSession) -> None:
    """Make format("pcd"), format("ply") and format("rosbag") known to the session."""
    ship_package(spark)
    for source in (PcdSource, PlySource, RosbagSource):
        spark.dataSource.register(source)


def _names_in(path: str) -> list[str]:
    """File names in a folder of any file system, or the name of the file itself."""
    fs, p = open_fs(path)
    if fs.get_file_info(p).type == FileType.Directory:
        return [posixpath.basename(f.path) for f in fs.get_file_info(FileSelector(p))]
    return [posixpath.basename(path)]


def looks_like_bag(path: str) -> bool:
    return any(f.endswith(".db3") for f in _names_in(path))


def kind_of(path: str) -> str:
    """pcd or ply of one file, from its first bytes and then its name."""
    ext = posixpath.splitext(path)[1].lower()
    if read_range(path, 0, 3).lower() == b"ply" or ext == ".ply":
        return "ply"
    if ext == ".pcd":
        return "pcd"
    raise ValueError(f"unknown point file {path}")


def sniff(path: str) -> str:
    """pcd, ply or rosbag; of a folder the format of its first point file (``read_points`` reads both)."""
    if looks_like_bag(path):
        return "rosbag"
    return kind_of((list_files(path, FORMATS_BY_SUFFIX) or [path])[0])


FORMATS: dict[str, PointFile] = {"pcd": PcdSource.fmt, "ply": PlySource.fmt}
FORMATS_BY_SUFFIX = [s for f in FORMATS.values() for s in f.suffixes]
CHUNK = "no int, path string, kind string, start long, stop long, n long, points long"


def read_points(spark: SparkSession, path: str, topic: str | None = None, voxel: float = 0.05,
                columns: list[str] | None = None, split: int = DEFAULT_SPLIT) -> DataFrame:
    """Cloud from a file, a folder of files (PCD and PLY may be mixed) or a recording (then a topic is needed).

    ``point_id`` counts the records of all files in the order of their names, without gaps and whatever the split
    size. A column that a file does not have is null there. Headers are read and ascii records counted in tasks;
    the driver sees one row per file and per ascii range. ``columns`` limits what is decoded.
    """
    register(spark)
    if looks_like_bag(path):
        if not topic:
            raise ValueError("a recording needs a topic")
        return bag_cloud(spark.read.format("rosbag").load(path), topic, "map", voxel)
    files = list_files(path, FORMATS_BY_SUFFIX) or [path]
    width = min(len(files), 4 * spark.sparkContext.defaultParallelism)

    def heads(batches):
        for pdf in batches:
            for no, f in zip(pdf["no"], pdf["path"]):
                kind = kind_of(f)
                yield pd.DataFrame({"no": [no], "path": f, "kind": kind, "fields": FORMATS[kind].schema(FORMATS[kind].layout(f), columns).json()})

    listed = spark.createDataFrame(list(enumerate(files)), "no int, path string").repartition(width, "path")
    found = listed.mapInPandas(heads, "no int, path string, kind string, fields string").select("kind", "no", "fields").orderBy("no").collect()
    schema = merged_schema([T.StructType.fromJson(json.loads(r["fields"])) for r in found])
    kinds = {r["no"]: r["kind"] for r in found}

    def plan(batches):
        for pdf in batches:
            for no, f in zip(pdf["no"], pdf["path"]):
                fmt = FORMATS[kinds[no]]
                lay = fmt.layout(f)
                parts, counts, limit = PointReader(fmt, {}, schema).planned(f, split)
                if lay.mode == "ascii":
                    parts = [Chunk(f, a, min(parts[0].end, a + split)) for a in range(lay.body, max(parts[0].end, lay.body + 1), split)]
                    counts = [-1] * len(parts)
                yield pd.DataFrame({"no": no, "path": f, "kind": kinds[no], "start": [c.start for c in parts], "stop": [c.end for c in parts],
                                    "n": counts, "points": limit})

    def count(batches):
        for pdf in batches:
            for i in pdf.index[pdf["n"] < 0]:
                fmt, part = FORMATS[pdf.at[i, "kind"]], Chunk(pdf.at[i, "path"], pdf.at[i, "start"], pdf.at[i, "stop"])
                pdf.at[i, "n"] = sum(map(len, PointReader.lines(part, fmt.layout(part.path))))
            yield pdf

    chunks_ = listed.mapInPandas(plan, CHUNK).repartition(4 * spark.sparkContext.defaultParallelism, "path", "start").mapInPandas(count, CHUNK)
    in_file = Window.partitionBy("no").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    chunks_ = chunks_.withColumn("take", F.greatest(F.lit(0), F.least("n", F.col("points") - F.coalesce(F.sum("n").over(in_file), F.lit(0)))))
    before = chunks_.groupBy("no").agg(F.sum("take").alias("records"))                       # one row per file
    before = before.select("no", (F.sum("records").over(Window.orderBy("no")) - F.col("records")).alias("before"))
    inside = F.coalesce(F.sum("take").over(in_file), F.lit(0))
    chunks_ = chunks_.withColumn("inside", inside).join(before, "no").select("path", "kind", "start", "stop", (F.col("before") + F.col("inside")).alias("first"), "take")
    n = chunks_.count()

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield from PointReader(FORMATS[r.kind], {}, schema).read(Chunk(r.path, r.start, r.stop, r.first, r.take))

    def read_arrow(batches):
        yield from read(b.to_pandas() for b in batches)

    return chunks_.repartition(max(1, n), "path", "start").mapInArrow(read_arrow, schema)


def write_cloud(df: DataFrame, path: str, kind: str = "ply", single: bool = False, mode: str = "error") -> None:
    """Write in point_id order: a folder of files, or one file when ``single``.

    An existing target raises, is replaced with ``mode="overwrite"``, or (folders only) grows with ``mode="append"``."""
    if mode not in ("error", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode}")
    fs, p = open_fs(path)
    kind_there = fs.get_file_info(p).type
    if mode == "error" and (kind_there == FileType.File or kind_there == FileType.Directory and list_files(path, FORMATS_BY_SUFFIX)):
        raise FileExistsError(path)
    ordered = df.repartitionByRange("point_id").sortWithinPartitions("point_id")
    names = ["x", "y", "z", *[c for c in ("red", "green", "blue", "intensity") if c in df.columns]]
    ordered.select("point_id", *names).write.format(kind).option("single", str(single).lower()) \
        .mode("overwrite" if mode == "overwrite" else "append").save(path)
