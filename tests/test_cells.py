"""Clustered cell tables: what is written, what is skipped, what is found."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terraflow.operators import axis, raster
from terraflow.sources import cells as C

TILE, SIDE = 32, 512


@pytest.fixture(scope="module")
def table(spark):
    """Four rasters of 512 x 512 cells in 1,024 tiles, with gaps; raster 0 is a third more rows than the others."""
    at = spark.range(4 * SIDE * SIDE).selectExpr("CAST(id div (512 * 512) AS INT) AS raster_id", "CAST(id div 512 % 512 AS INT) AS row_idx", "CAST(id % 512 AS INT) AS col_idx", "id * 0.5D AS z")
    path = C.write_cells(at.filter("pmod(hash(row_idx, col_idx), 50) > 0").repartition(7), TILE, 1 << 14)
    return path, C.read_cells(spark, path)


def scanned(df):
    """Rows that came out of the file scan, after row groups and pages were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def groups(path, wanted):
    """Row groups of all files, and those whose statistics allow a row of the wanted boxes."""
    total = held = 0
    for file in pq.ParquetDataset(path).files:
        meta = pq.ParquetFile(file).metadata
        names = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)} if meta.num_row_groups else {}
        for g in range(meta.num_row_groups):
            total += 1
            s = {n: meta.row_group(g).column(i).statistics for n, i in names.items()}
            held += any(
                s["raster_id"].min <= r1 and r0 <= s["raster_id"].max and s["tile_row"].min <= b and a <= s["tile_row"].max and s["tile_col"].min <= d and c <= s["tile_col"].max
                for r0, r1, a, b, c, d in wanted
            )
    return total, held


def test_window_reads_its_tiles(spark, table):
    path, cells = table
    windows = spark.createDataFrame([(1, 2, 100, 130, 200, 260, None), (2, 3, 0, 10, 0, 10, None), (3, 1, None, None, None, None, "out")], "clip_id int, raster_id int, row0 int, row1 int, col0 int, col1 int, error string")
    boxes = C.boxes_of(windows.filter("error IS NULL"), TILE, F.col("row0"), F.col("row1") - 1, F.col("col0"), F.col("col1") - 1)
    near = C.cells_near(cells, boxes)
    pushed = near._jdf.queryExecution().explainString(near.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = next(x for x in pushed.splitlines() if x.startswith("PushedFilters"))
    assert all(f"({c}," in filters for c in ("raster_id", "tile_row", "tile_col"))
    total, held = groups(path, C.covering(boxes))
    assert total > 100 and 0 < held < total / 10
    assert scanned(near) < cells.count() / 10
    got = raster.clip(near, windows, TILE).select("clip_id", "row_idx", "col_idx", "z")
    assert sorted(got.collect()) == sorted(raster.clip(cells, windows, TILE).select("clip_id", "row_idx", "col_idx", "z").collect())
    assert got.filter("clip_id = 1").count() > 1700


def test_points_read_their_tiles(spark, table):
    _, cells = table
    points = spark.createDataFrame([(i, 2, 17 * i, 300 + i) for i in range(5)] + [(9, 0, None, None)], "point_id int, raster_id int, row_idx int, col_idx int")
    row, col = F.col("row_idx"), F.col("col_idx")
    near = C.cells_near(cells, C.boxes_of(points, TILE, row, row, col, col))
    assert scanned(near) < cells.count() / 10
    assert sorted(raster.elevations(points, near).collect()) == sorted(raster.elevations(points, cells).collect())


def test_few_ranges_cover_many_boxes(spark):
    rows = spark.range(500).selectExpr("CAST(id % 90 AS INT) AS raster_id", "CAST(id AS INT) AS r", "CAST(id * 7 % 512 AS INT) AS c")
    boxes = C.boxes_of(rows, TILE, F.col("r"), F.col("r") + 40, F.col("c"), F.col("c"))
    for limit in (1000, 100, 8, 1):
        ranges = C.covering(boxes, limit)
        assert len(ranges) <= limit
        for b in boxes.collect():
            assert any(r0 <= b.raster_id <= r1 and a <= b.tile_row0 and b.tile_row1 <= e and c <= b.tile_col0 and b.tile_col1 <= d for r0, r1, a, e, c, d in ranges)
    assert C.covering(boxes.limit(0)) == []
    assert C.cells_near(boxes.selectExpr("raster_id", "tile_row0 AS tile_row", "tile_col0 AS tile_col"), boxes.limit(0)).count() == 0


def test_axis_samples_from_packed_tiles(spark, table):
    _, cells = table
    spots = spark.range(400).selectExpr("id % 3 AS dam_id", "CAST(id % 3 AS INT) AS raster_id", "id * 0.1D AS distance_m", "CAST(id * 5 % 600 - 20 AS INT) AS row_idx", "CAST(id * 11 % 520 AS INT) AS col_idx")
    got = axis.axis_samples(spots, cells, TILE).select("dam_id", "distance_m", "row_idx", "z")
    want = spots.join(cells, ["raster_id", "row_idx", "col_idx"], "left").select("dam_id", "distance_m", "row_idx", "z")
    key = lambda r: (r.dam_id, r.distance_m)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_axis_terrain_moves_cells_not_samples(spark, table):
    """Elevations of all samples against a plain join, a place given twice, one without an id and one off the terrain among them."""
    _, cells = table
    res = 1.0 / 3600
    rasters = spark.createDataFrame([(r, 70.0, 12.0, res, res, SIDE, SIDE) for r in range(4)], "raster_id int, west double, north double, res_x double, res_y double, width int, height int")
    at = [(1, 0, 9, 9), (1, 0, 300, 200), (1, 0, 300, 200), (2, 3, 0, 511), (None, 1, 77, 5), (3, 2, -50, 9), (4, 9, 5, 5)]
    dams = spark.createDataFrame([(d, r, 70.0 + (c + 0.5) * res, 12.0 - (w + 0.5) * res) for d, r, w, c in at] + [(5, 1, None, 12.0)], "dam_id long, raster_id int, lon double, lat double")
    placed = axis.axis_dams(dams, rasters)
    met = axis.axis_cells(placed)
    got = axis.axis_terrain(placed, met, cells)
    names = ["dam_id", "bearing_deg", "distance_m", "row_idx", "col_idx", "z"]
    spots = axis.axis_spots(dams, rasters)
    want = spots.join(cells, ["raster_id", "row_idx", "col_idx"], "left").select(*names)
    key = lambda df: sorted(map(str, map(tuple, df.select(*names).collect())))
    assert key(got) == key(want) and got.filter("z IS NULL").count() > 1980 and got.filter("z IS NOT NULL").count() > 1980
    assert met.count() < spots.count() / 20
