"""format("rosbag"): recorded message logs (SQLite files), and the point messages in them."""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from ..operators.grid import voxel_first
from ..operators.select import finite
from ..operators.transform import rerank

MESSAGES = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ts", T.LongType()),
    T.StructField("msg_seq", T.LongType()), T.StructField("data", T.BinaryType())])
TOPICS = T.StructType([T.StructField("topic", T.StringType()), T.StructField("type", T.StringType())])
ROWS = 2_000   # messages per partition
MSG_BATCH = 64
POINT_BATCH = 200_000
LOG_NUMBER = r"_(\d+)\.db3$"


def log_files(path: str) -> list[str]:
    """The file itself, or the files of a recording in the order of their number."""
    if not os.path.isdir(path):
        return [path]
    found = pd.DataFrame({"name": [f for f in os.listdir(path) if f.endswith(".db3")]})
    if found.empty:
        raise ValueError(f"no .db3 file in {path}")
    found["number"] = pd.to_numeric(found["name"].str.extract(LOG_NUMBER, expand=False)).fillna(0)
    return [os.path.join(path, f) for f in found.sort_values(["number", "name"])["name"]]


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class LogRange(InputPartition):
    path: str
    file_no: int
    first: int
    last: int


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.topic = options.get("topic")
        self.topics_only = options.get("table") == "topics"

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",) and not self.topics_only:
                self.topic = f.value
            else:
                yield f

    def partitions(self):
        out = []
        for no, path in enumerate(log_files(self.options["path"])):
            if self.topics_only:
                out.append(LogRange(path, no, 0, 0))
                continue
            with _connect(path) as con:
                low, high = con.execute("SELECT min(id), max(id) FROM messages").fetchone()
            for a in range(low or 0, (high if high is not None else -1) + 1, ROWS):
                out.append(LogRange(path, no, a, a + ROWS - 1))
        return out

    def read(self, part: LogRange) -> Iterator[pa.RecordBatch]:
        con = _connect(part.path)
        try:
            if self.topics_only:
                rows = con.execute("SELECT name, type FROM topics ORDER BY id").fetchall()
                yield pa.RecordBatch.from_pylist([{"topic": n, "type": t} for n, t in rows],
                                                 pa.schema([("topic", pa.string()), ("type", pa.string())]))
                return
            sql = ("SELECT t.name, t.type, m.timestamp, m.id, m.data FROM messages m JOIN topics t ON t.id = m.topic_id "
                   "WHERE m.id BETWEEN ? AND ?")
            args: list = [part.first, part.last]
            if self.topic is not None:
                sql, args = sql + " AND t.name = ?", [*args, self.topic]
            cur = con.execute(sql + " ORDER BY m.id", args)
            while rows := cur.fetchmany(MSG_BATCH):
                name, kind, ts, ids, data = zip(*rows)
                seq = [(part.file_no << 40) + i for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name), pa.array(kind), pa.array(ts, pa.int64()), pa.array(seq, pa.int64()), pa.array(data, pa.binary())],
                    ["topic", "type", "ts", "msg_seq", "data"])
        finally:
            con.close()


class RosbagSource(DataSource):
    """Options: path, topic (optional), table = messages (default) or topics."""

    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> T.StructType:
        return TOPICS if self.options.get("table") == "topics" else MESSAGES

    def reader(self, schema: T.StructType) -> LogReader:
        return LogReader(dict(self.options))


def bag_topics(topics: DataFrame, messages: DataFrame) -> DataFrame:
    """topic, type, n for every point topic, also those without messages."""
    names = topics.where(F.contains("type", F.lit("PointCloud2"))).groupBy("topic").agg(F.first("type").alias("type"))
    counts = messages.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "topic", "left").select("topic", "type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# Datatype codes of point fields.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


# The parts of a point message in their order. A plain code is a number of that struct type, "text" and
# "bytes" carry a length in front, a list stands for a counted sequence of such parts.
POINT_MESSAGE = (
    ("sec", "i"), ("nanosec", "I"), ("frame_id", "text"), ("height", "I"), ("width", "I"),
    ("fields", [("name", "text"), ("offset", "I"), ("datatype", "B"), ("count", "I")]),
    ("is_bigendian", "B"), ("point_step", "I"), ("row_step", "I"), ("data", "bytes"),
)


def unpack_message(buf: bytes, parts=POINT_MESSAGE) -> dict:
    """Values of a binary message by part name; numbers are aligned to their size, counted from byte 4."""
    order = "<" if buf[1] in (1, 3) else ">"

    def one(kind, at: int):
        if isinstance(kind, list):
            n, at = one("I", at)
            rows = []
            for _ in range(n):
                row, at = group(kind, at)
                rows.append(row)
            return rows, at
        if kind in ("text", "bytes"):
            n, at = one("I", at)
            raw = buf[at:at + n]
            return (raw[:-1].decode("utf-8", "replace") if kind == "text" else raw), at + n
        size = struct.calcsize(kind)
        at = 4 + -(-(at - 4) // size) * size
        return struct.unpack_from(order + kind, buf, at)[0], at + size

    def group(items, at: int):
        row = {}
        for name, kind in items:
            row[name], at = one(kind, at)
        return row, at

    return group(parts, 4)[0]


def decode_message(buf: bytes) -> dict[str, np.ndarray] | None:
    """Point message -> x, y, z (and intensity) arrays; None when it holds no points."""
    m = unpack_message(buf)
    stored = {f["name"]: f for f in m["fields"]}
    wanted = [c for c in ("x", "y", "z", "intensity") if c in stored]
    n = min(m["height"] * m["width"], len(m["data"]) // m["point_step"]) if m["point_step"] else 0
    if n <= 0 or not {"x", "y", "z"} <= stored.keys():
        return None
    record = np.dtype({"names": wanted, "formats": ["<" + FIELD_TYPES.get(stored[c]["datatype"], "f4") for c in wanted],
                       "offsets": [stored[c]["offset"] for c in wanted], "itemsize": m["point_step"]})
    points = np.frombuffer(m["data"], record, n)
    return {c: points[c].astype(np.float64) for c in wanted}


def decoded(data: bytes) -> dict[str, np.ndarray] | None:
    """A message's arrays, None also for a broken message."""
    try:
        return decode_message(bytes(data))
    except (struct.error, IndexError, ValueError):
        return None


def finite_points(data: bytes) -> int:
    """Points of a message that a cloud would keep."""
    cloud = decoded(data)
    return 0 if cloud is None else int(np.isfinite(np.column_stack([cloud[c] for c in "xyz"])).all(1).sum())


DECODED = ("topic string, ts long, msg_seq long, point_idx int, x double, y double, z double, intensity double")


def decode_clouds(messages: DataFrame, single: bool = True) -> DataFrame:
    """Messages -> points; broken messages give nothing, non-finite points are dropped.

    Coordinates pass through single precision, as recorded maps keep them;
    ``intensity`` is null where the message has none.
    """
    def run(frames):
        for pdf in frames:
            pdf["cloud"] = pdf["data"].map(decoded)
            pdf = pdf[pdf["cloud"].notna()]
            size = np.array([len(c["x"]) for c in pdf["cloud"]], np.int64)
            for rows in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(size) // POINT_BATCH)) + 1):
                if not len(rows):
                    continue
                part, n = pdf.iloc[rows], size[rows]
                cols = {c: np.concatenate([p.get(c, np.full(k, np.nan)) for p, k in zip(part["cloud"], n)]) for c in ("x", "y", "z", "intensity")}
                out = pd.DataFrame({k: np.repeat(part[k].to_numpy(), n) for k in ("topic", "ts", "msg_seq")} | cols)
                out = out[np.isfinite(out[["x", "y", "z"]]).all(axis=1)]
                out["point_idx"] = out.groupby("msg_seq", sort=False).cumcount().astype(np.int32)
                if single:
                    out[list(cols)] = out[list(cols)].astype(np.float32).astype(np.float64)
                yield out[["topic", "ts", "msg_seq", "point_idx", "x", "y", "z", "intensity"]]

    out = messages.select("topic", "ts", "msg_seq", "data").mapInPandas(run, DECODED)
    return out.withColumn("intensity", F.nanvl("intensity", F.lit(None).cast("double")))


def bag_cloud(messages: DataFrame, topic: str, mode: str = "map", voxel: float = 0.05, max_messages: int = 0) -> DataFrame:
    """One cloud from a topic: the last message, all of them, or a thinned map.

    point_id follows (ts, msg_seq, point_idx). Intensity is kept only when every
    message with points has it. An unknown topic or a topic without points
    raises.
    """
    chosen = messages.where(F.col("topic") == topic)
    if not chosen.head(1):
        raise ValueError(f"topic {topic} not in the recording")
    if mode == "last":
        newest = chosen.agg(F.max(F.struct("ts", "msg_seq")).alias("m")).first()["m"]
        chosen = chosen.where((F.col("ts") == newest["ts"]) & (F.col("msg_seq") == newest["msg_seq"]))
    if max_messages:
        # the first messages in time, as asked for by the caller
        first = chosen.select("ts", "msg_seq").orderBy("ts", "msg_seq").limit(max_messages)
        chosen = chosen.join(first, ["ts", "msg_seq"], "left_semi")
    points = rerank(finite(decode_clouds(chosen)), ["ts", "msg_seq", "point_idx"])
    if mode == "map" and voxel and voxel > 0:
        points = voxel_first(points, voxel)
    stats = points.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("intensity").isNotNull()).alias("all_i")).first()
    if not stats["n"]:
        raise ValueError(f"no usable points in {topic}")
    return points if stats["all_i"] else points.withColumn("intensity", F.lit(None).cast("double"))
