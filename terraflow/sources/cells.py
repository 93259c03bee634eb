"""Cell tables clustered by tile, so that a window reads its own tiles only.

``write_cells`` lays the cells out in the order of raster, tile row and tile column, with
the tile as columns. Parquet keeps the smallest and largest value of each column for
every row group and page, so a filter on rasters and tiles skips all others. A hot
raster is spread over as many files as its cells fill.

``cells_near`` turns the boxes a query is about (windows, points, lines) into such a filter. The filter is
a list of at most ``RANGES`` boxes of tiles that cover all of them: it narrows what is read,
and the query's own join decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflow.operators.tiles import tile_of
from terraflow.session import materialize, scratch_path

TILE = 256
RANGES = 64
ROW_GROUP_BYTES = 8 << 20
BOX = ["raster_id", "tile_row0", "tile_row1", "tile_col0", "tile_col1"]


def write_cells(cells: DataFrame, tile: int = TILE, group_bytes: int = ROW_GROUP_BYTES, path: str | None = None) -> str:
    """Writes raster_id, row_idx, col_idx and further columns in tile order; returns the folder."""
    path = path or scratch_path(cells.sparkSession, "cells")
    placed = cells.withColumns({"tile_row": tile_of(F.col("row_idx"), tile), "tile_col": tile_of(F.col("col_idx"), tile)})
    order = ["raster_id", "tile_row", "tile_col", "row_idx", "col_idx"]
    # Pages are checked for their size every so many rows: small groups need small pages.
    rows = max(100, min(20_000, group_bytes // 64))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", group_bytes).option(
        "parquet.page.row.count.limit", rows
    ).option("parquet.block.size.row.check.min", 100).parquet(path)
    return path


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def boxes_of(rows: DataFrame, tile: int, row0: Column, row1: Column, col0: Column, col1: Column) -> DataFrame:
    """Tile boxes of rows with raster_id and cell bounds (both ends included); rows without a bound have none."""
    bounds = zip(BOX[1:], (row0, row1, col0, col1), strict=True)
    return rows.select("raster_id", *[tile_of(c, tile).alias(n) for n, c in bounds]).dropna().distinct()


def covering(boxes: DataFrame, ranges: int = RANGES) -> list[tuple[int, int, int, int, int, int]]:
    """At most ``ranges`` bounds (rasters from and to, tile rows, tile columns) that hold all boxes.

    Boxes are taken as they are if there are so few, else one for each raster, else one for
    each of so many stretches of rasters. Only these bounds come to the driver.
    """
    bounds = [F.min("raster_id"), F.max("raster_id"), F.min("tile_row0"), F.max("tile_row1"), F.min("tile_col0"), F.max("tile_col1")]
    boxes = materialize(boxes, "tile-boxes")
    several = boxes.groupBy(*BOX).agg(*bounds).drop(*BOX).limit(ranges + 1).collect()
    if len(several) > ranges:
        several = boxes.groupBy("raster_id").agg(*bounds).drop("raster_id").limit(ranges + 1).collect()
    if len(several) > ranges:
        ends = boxes.agg(F.percentile_approx("raster_id", [k / ranges for k in range(1, ranges + 1)], 10_000).alias("p")).first().p
        stretch = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(ends))[:-1])).cast("array<int>"), lambda x: x < F.col("raster_id")))
        several = boxes.groupBy(stretch.alias("s")).agg(*bounds).drop("s").collect()
    return [tuple(r) for r in several]


def cells_near(cells: DataFrame, boxes: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The cells of a clustered table in and around the tile boxes; all others are skipped by the scan."""
    wanted = F.lit(False)
    for r0, r1, a, b, c, d in covering(boxes, ranges):
        raster = F.col("raster_id") == r0 if r0 == r1 else F.col("raster_id").between(r0, r1)
        wanted |= raster & F.col("tile_row").between(a, b) & F.col("tile_col").between(c, d)
    return cells.filter(wanted)
