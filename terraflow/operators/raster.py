"""Raster metadata, statistics, point sampling, clipping and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.operators.quantiles import exact_quantiles
from terraflow.operators.stencil import CELL

OVERVIEW_SIZE = 900


def raster_info(rasters: DataFrame, key: str) -> DataFrame:
    """Usable rasters with bounds; no size, no band or no CRS drops a row."""
    ok = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("band_count") >= 1) & F.col("epsg").isNotNull()
    return rasters.filter(ok).select(
        key, "epsg", "width", "height", "band_count", "west",
        (F.col("north") - F.col("height") * F.col("res_y")).alias("south"),
        (F.col("west") + F.col("width") * F.col("res_x")).alias("east"),
        "north", F.abs("res_x").alias("res_x"), F.abs("res_y").alias("res_y"), "nodata",
    )


def clean_cells(raw: DataFrame, rasters: DataFrame) -> DataFrame:
    """Cells with the nodata value, NaN and infinities set to null."""
    z = F.col("z")
    bad = F.isnan(z) | (F.abs(z) == float("inf")) | (z == F.col("nodata"))
    return raw.join(rasters.select("raster_id", "nodata"), "raster_id").select(
        *CELL, F.when(~F.coalesce(bad, F.lit(False)), z).alias("z")
    )


def statistics(cells: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Count, min, max, mean and exact median; rasters without valid cells drop out."""
    names = {"count": "valid_cells", "min": "minimum", "max": "maximum", "mean": "mean"}
    return exact_quantiles(cells, keys, value, {"median": 0.5}, summary=names)


def locate(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(inside, row, col) of a point on the raster columns beside it.

    The right edge belongs to the last column. A point on the bottom edge lies
    outside, one on the top edge in row 0.
    """
    west, north, rx, ry = (F.col(c) for c in ("west", "north", "res_x", "res_y"))
    w, h = F.col("width"), F.col("height")
    east, south = west + w * rx, north - h * ry
    within = lon.between(west, east) & lat.between(south, north)
    row = F.floor((north - lat) / ry).cast("int")
    col = F.floor((lon - west) / rx).cast("int")
    tol = F.greatest(rx * 1e-6, F.lit(1e-12))
    col = F.when((col >= w) & (F.abs(lon - east) <= tol), w - 1).when(
        (col < 0) & (F.abs(lon - west) <= tol), F.lit(0)
    ).otherwise(col)
    inside = F.coalesce(within & row.between(0, h - 1) & col.between(0, w - 1), F.lit(False))
    return inside, F.when(inside, row), F.when(inside, col)


def points_on_raster(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Points with inside flag, row and column on their raster."""
    frame = rasters.select("raster_id", "west", "north", "res_x", "res_y", "width", "height")
    inside, row, col = locate(F.col("lon"), F.col("lat"))
    return points.join(frame, "raster_id", "left").select(
        *points.columns, inside.alias("inside"), row.alias("row_idx"), col.alias("col_idx")
    )


def sample_points(points: DataFrame, rasters: DataFrame, cells: DataFrame) -> DataFrame:
    """Elevation under each point; outside points stay, with nulls."""
    return elevations(points_on_raster(points, rasters), cells)


def elevations(located: DataFrame, cells: DataFrame) -> DataFrame:
    """Elevation of the cell of each located point, null without one."""
    return located.join(cells.select(*CELL, F.col("z").alias("elevation")), CELL, "left")


def nearest_cell(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(row, col) under a point, clamped into the raster."""
    row = F.floor((F.col("north") - lat) / F.col("res_y")).cast("int")
    col = F.floor((lon - F.col("west")) / F.col("res_x")).cast("int")
    return (
        F.greatest(F.lit(0), F.least(row, F.col("height") - 1)),
        F.greatest(F.lit(0), F.least(col, F.col("width") - 1)),
    )


def clip_windows(centres: DataFrame, rasters: DataFrame, width_km: float = 5.0, height_km: float = 5.0) -> DataFrame:
    """Cell window of each centre (clip_id, raster_id, lon, lat).

    A metric box around the centre goes through the local UTM grid; its corners
    span the window in degrees. ``error`` tells why there is no window. Lengths
    go to the nearest whole cell, offsets to the cell below.
    """
    if width_km <= 0 or height_km <= 0:
        raise ValueError("width_km and height_km must be positive")
    rows = centres.join(rasters, "raster_id")
    epsg = G.utm_epsg(F.col("lon"), F.col("lat"))
    e, n = G.utm_forward(F.col("lon"), F.col("lat"), F.col("_utm"))
    rows = rows.withColumn("_utm", epsg).withColumns({"_e": e, "_n": n})
    half_w, half_h = width_km * 500.0, height_km * 500.0
    signs = F.array(*[F.struct(F.lit(sx).alias("sx"), F.lit(sy).alias("sy")) for sx in (-1.0, 1.0) for sy in (-1.0, 1.0)])
    corner = rows.select("clip_id", "_e", "_n", "_utm", F.explode(signs).alias("s"))
    lon, lat = G.utm_inverse(F.col("_e") + F.col("s.sx") * half_w, F.col("_n") + F.col("s.sy") * half_h, F.col("_utm"))
    box = corner.select("clip_id", lon.alias("lon"), lat.alias("lat")).groupBy("clip_id").agg(
        F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1")
    )
    east = F.col("west") + F.col("width") * F.col("res_x")
    south = F.col("north") - F.col("height") * F.col("res_y")
    rows = rows.join(box, "clip_id").withColumns(
        {
            "_x0": F.greatest("_x0", F.col("west")), "_x1": F.least(F.col("_x1"), east),
            "_y0": F.greatest(F.col("_y0"), south), "_y1": F.least("_y1", F.col("north")),
            "_outside": ~(F.col("lon").between(F.col("west"), east) & F.col("lat").between(south, F.col("north"))),
        }
    )

    def length(span: Column, limit: Column, start: Column) -> Column:
        return F.least(start + F.floor(span + 0.5).cast("int"), limit)

    col0 = F.floor((F.col("_x0") - F.col("west")) / F.col("res_x")).cast("int")
    row0 = F.floor((F.col("north") - F.col("_y1")) / F.col("res_y")).cast("int")
    col1 = length((F.col("_x1") - F.col("_x0")) / F.col("res_x"), F.col("width"), F.greatest(col0, F.lit(0)))
    row1 = length((F.col("_y1") - F.col("_y0")) / F.col("res_y"), F.col("height"), F.greatest(row0, F.lit(0)))
    rows = rows.withColumns(
        {"row0": F.greatest(row0, F.lit(0)), "col0": F.greatest(col0, F.lit(0)), "row1": row1, "col1": col1}
    )
    empty = (F.col("row1") <= F.col("row0")) | (F.col("col1") <= F.col("col0"))
    error = F.when(F.col("_outside"), "centre outside raster").when(
        (F.col("_x0") >= F.col("_x1")) | (F.col("_y0") >= F.col("_y1")), "window outside raster"
    ).when(empty, "window has zero area")
    return rows.withColumn("error", error).select(
        "clip_id", "raster_id", "lon", "lat", "row0", "row1", "col0", "col1", "error"
    )


def clip(cells: DataFrame, windows: DataFrame, tile: int = 256) -> DataFrame:
    """Cells of each usable window.

    Windows are cut into tiles, so the join has the tile in its key and never
    pairs a window with a whole raster.
    """
    w = windows.filter("error IS NULL").select("clip_id", "raster_id", "row0", "row1", "col0", "col1")

    def div(c: Column) -> Column:
        return F.floor(c / tile).cast("int")

    w = w.withColumn("_tr", F.explode(F.sequence(div(F.col("row0")), div(F.col("row1") - 1)))).withColumn(
        "_tc", F.explode(F.sequence(div(F.col("col0")), div(F.col("col1") - 1)))
    )
    c = cells.select(*CELL, "z", div(F.col("row_idx")).alias("_tr"), div(F.col("col_idx")).alias("_tc"))
    inside = (
        (F.col("row_idx") >= F.col("row0")) & (F.col("row_idx") < F.col("row1"))
        & (F.col("col_idx") >= F.col("col0")) & (F.col("col_idx") < F.col("col1"))
    )
    return c.join(w, ["raster_id", "_tr", "_tc"]).filter(inside).select(
        "clip_id", *CELL, "z", (F.col("row_idx") - F.col("row0")).alias("clip_row"),
        (F.col("col_idx") - F.col("col0")).alias("clip_col"),
    )


def clip_stats(clipped: DataFrame, windows: DataFrame, rasters: DataFrame) -> DataFrame:
    """Min, max, mean of each window (NaN when empty) and the centre pixel.

    The centre pixel is rounded half to even, then clamped into the window.
    """
    nan = F.lit(float("nan"))
    stats = clipped.groupBy("clip_id").agg(
        F.min("z").alias("minimum"), F.max("z").alias("maximum"), F.avg("z").alias("mean")
    )
    rows = windows.filter("error IS NULL").join(rasters, "raster_id").join(stats, "clip_id", "left")
    col = F.bround((F.col("lon") - (F.col("west") + F.col("col0") * F.col("res_x"))) / F.col("res_x"))
    row = F.bround(((F.col("north") - F.col("row0") * F.col("res_y")) - F.col("lat")) / F.col("res_y"))
    height, width = F.col("row1") - F.col("row0"), F.col("col1") - F.col("col0")

    def clamp(v: Column, n: Column) -> Column:
        return F.greatest(F.lit(0), F.least(v.cast("int"), n - 1))

    return rows.select(
        "clip_id", height.alias("height"), width.alias("width"),
        *[F.coalesce(c, nan).alias(c) for c in ("minimum", "maximum", "mean")],
        clamp(row, height).alias("dam_row"), clamp(col, width).alias("dam_col"),
    )


def overview(cells: DataFrame, rasters: DataFrame, max_size: int = OVERVIEW_SIZE) -> DataFrame:
    """Block means of rasters whose long side is over ``max_size`` cells."""
    block = F.greatest(F.lit(1), F.ceil(F.greatest("width", "height") / max_size).cast("int"))
    rows = cells.join(rasters.select("raster_id", block.alias("_k")), "raster_id")
    return rows.groupBy(
        "raster_id",
        F.floor(F.col("row_idx") / F.col("_k")).cast("int").alias("row_idx"),
        F.floor(F.col("col_idx") / F.col("_k")).cast("int").alias("col_idx"),
    ).agg(F.avg("z").alias("z"), F.count("z").alias("valid_cells"))
