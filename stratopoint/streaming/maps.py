"""Incremental map building: messages arrive, each voxel keeps its first point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import voxel_key
from ..operators.select import finite
from ..sources.rosbag import MESSAGES, decode_clouds, finite_points

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep voxel state on disk: it grows with the mapped volume and is never dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def message_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Message files (Parquet in the schema of format("rosbag")) as they arrive."""
    reader = spark.readStream.schema(MESSAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def map_stream(points: DataFrame, voxel: float, by: Sequence[str] = ("topic",), event_time: str | None = None,
               watermark: str | None = None) -> DataFrame:
    """First arriving point of every (key, voxel).

    The voxel lattice starts at zero, so the stream equals the batch result when
    messages arrive in time order. With ``watermark`` duplicates are only
    remembered that long: state stays small, and a voxel seen again later counts
    as new. That is opt-in because it changes the result.
    """
    keyed = finite(points).withColumns(dict(zip(("vx", "vy", "vz"), voxel_key(voxel))))
    key = [*by, "vx", "vy", "vz"]
    if watermark is None:
        return keyed.dropDuplicates(key)
    return keyed.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(key)


def map_from_messages(messages: DataFrame, voxel: float) -> DataFrame:
    """Undecoded messages -> map stream."""
    return map_stream(decode_clouds(messages), voxel)


def latest_stream(messages: DataFrame) -> DataFrame:
    """Time of the newest message per topic (update mode)."""
    return messages.groupBy("topic").agg(F.max("ts").alias("ts"), F.max_by("msg_seq", F.struct("ts", "msg_seq")).alias("msg_seq"))


def progress_stream(messages: DataFrame) -> DataFrame:
    """Messages and finite points so far, per topic (complete mode). Messages are counted before they are decoded."""
    def count(frames):
        for pdf in frames:
            pdf["n_points"] = [finite_points(bytes(d)) for d in pdf["data"]]
            yield pdf[["topic", "n_points"]]

    counted = messages.select("topic", "data").mapInPandas(count, "topic string, n_points long")
    return counted.groupBy("topic").agg(F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_messages"))


def run_to_table(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over everything that has arrived and return what it holds, from a table of its batches.

    Append mode keeps all batches; complete mode keeps the newest, which holds everything."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    held = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    if mode == "complete":
        held = held.where(F.col("batch") == held.agg(F.max("batch")).scalar())
    return held.drop("batch")
