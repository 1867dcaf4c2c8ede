"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratopoint.plans import catalog  # noqa: E402
from stratopoint.session import local_session  # noqa: E402

HEADLINE = [
    "cloud_profile", "select_lasso", "points_in_polygon", "affine_apply", "percentile_crop", "voxel_first", "voxel_mean",
    "surface_model", "surface_residual_on_lattice", "nearest_time", "colour_coverage", "sample_images", "thermal_cloud",
    "nearest_colour_transfer", "radius_count", "k_nearest", "orbit_raster", "similarity_per_cloud", "edit_log_replay",
    "map_from_messages", "clouds_in_many_files", "coarse_turn", "icp_point_to_plane",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["cloud_profile"](spark, sf_dir).collect()   # start the JVM's compiler and the Python workers
    catalog.QUERIES["map_from_messages"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
