"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the folder with the driver tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from terraflow.operators import fill, flow, stencil  # noqa: E402
from terraflow.plans import QUERIES  # noqa: E402
from terraflow.session import local_session  # noqa: E402

HEADLINE = [
    "raster_stats", "d8_direction", "hillshade", "raster_clip", "point_sample", "fill_stats",
    "path_summary", "flood_corridor", "axis_topk", "zonal_stats", "surface_raster", "frame_metrics", "run_metrics",
    "convex_hull", "log_error_extract", "run_history", "freshness", "dam_search", "wall_ground",
]


def large_raster(spark, side: int = 1024):
    """Hilly cells of one raster of ``side`` cells, and its header."""
    at = spark.range(side * side).selectExpr("0 AS raster_id", f"CAST(id div {side} AS INT) AS row_idx", f"CAST(id % {side} AS INT) AS col_idx")
    hills = F.sin(F.col("row_idx") / 37) * 20 + F.cos(F.col("col_idx") / 53) * 15 - F.col("row_idx") * 0.05
    cells = at.withColumn("z", hills + F.pmod(F.xxhash64("row_idx", "col_idx"), F.lit(100)) / 50)
    return cells, spark.createDataFrame([(0, side, side)], "raster_id int, width int, height int")


def tiled(spark, tile: int, part: str):
    """Fill, accumulation or trace of the large raster in tiles of one size."""
    cells, rasters = large_raster(spark)
    if part == "fill":
        return fill.fill_depressions(cells, rasters, tile=tile)
    tiles = flow.direction_tiles(stencil.d8_direction(cells), tile)
    if part == "accumulate":
        return flow.flow_accumulation(None, tile, tiles)
    starts = spark.range(50).selectExpr("id AS dam_id", "0 AS raster_id", "CAST(20 * id AS INT) AS row_idx", "CAST(1000 - 20 * id AS INT) AS col_idx")
    return flow.downstream_trace(starts, tiles, tile)


#: Beside the headline total: many tiles per raster, so that rims are exchanged.
TILED = [(part, tile) for part in ("fill", "accumulate", "trace") for tile in (32, 256)]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "terraflow-bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    for part, tile in TILED if not sys.argv[1:] else []:
        start = time.perf_counter()
        tiled(spark, tile, part).write.format("noop").mode("overwrite").save()
        seconds[f"{part}_1024_tiles_{tile}"] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
