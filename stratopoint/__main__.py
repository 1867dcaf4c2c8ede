"""Command line: python -m stratopoint --cloud C --flight F --out O --work W --model M"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import jobs
from .sources.points import looks_like_bag, register
from .sources.rosbag import bag_topics


def main() -> None:
    p = argparse.ArgumentParser(prog="stratopoint", description="colour a point cloud from a photo flight")
    p.add_argument("--cloud", required=True, help="pcd, ply or recording")
    p.add_argument("--topic", help="point topic of a recording")
    p.add_argument("--topics", action="store_true", help="list the point topics of a recording and stop")
    p.add_argument("--flight", help="folder with the photos")
    p.add_argument("--out", help="coloured cloud to write")
    p.add_argument("--work", default="work")
    p.add_argument("--model", help="folder with the text camera model")
    p.add_argument("--width", type=int, default=1600)
    p.add_argument("--voxel", type=float, default=0.05)
    a = p.parse_args()
    spark = SparkSession.builder.appName("stratopoint").getOrCreate()
    if a.topics:
        register(spark)
        if not looks_like_bag(a.cloud):
            p.error("not a recording")
        read = spark.read.format("rosbag")
        bag_topics(spark.read.format("rosbag").option("table", "topics").load(a.cloud), read.load(a.cloud)).show(truncate=False)
        return
    if not (a.flight and a.out and a.model):
        p.error("--flight, --out and --model are needed")
    jobs.colorize(spark, a.cloud, a.flight, a.out, a.work, a.model, a.topic, a.voxel, a.width).show()


if __name__ == "__main__":
    main()
