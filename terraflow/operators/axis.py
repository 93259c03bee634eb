"""Dam axis screening: profiles over all bearings, scores, best candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.operators.tiles import DEFAULT_TILE, TILE, with_tile
from terraflow.session import materialize

INVALID = "INVALID/INSUFFICIENT_DATA"
#: Samples of one task. They are dealt by dam before they are made, so the bytes of their dams say nothing.
SPOTS = 500_000
PLACE = ["dam_id", "raster_id", "lon", "lat"]
GRID = ["west", "north", "res_x", "res_y"]


def axis_dams(dams: DataFrame, rasters: DataFrame) -> DataFrame:
    """Dams (dam_id, raster_id, lon, lat) with the grid of their raster, written."""
    placed = dams.join(rasters.select("raster_id", "west", "north", "res_x", "res_y", "width", "height"), "raster_id")
    return materialize(placed.select(*PLACE, *GRID), "axis-dams")


def _spots(placed: DataFrame, places: int, length_m: float, bearing_step: float, profile_step: float, *more: str) -> DataFrame:
    step = max(1.0, profile_step)
    half = length_m / 2.0
    n_dist = math.ceil((length_m + step / 2.0) / step - 1e-9)
    b_step = max(bearing_step, 0.1)
    n_bearing = math.ceil(180.0 / b_step - 1e-9)
    lines = (
        placed.repartition(_tasks(places * n_bearing * n_dist), "dam_id")
        .withColumn("bearing_deg", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_bearing - 1)), lambda i: i * b_step)))
        .withColumn("distance_m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_dist - 1)), lambda i: i * step - half)))
    )
    lat0 = F.col("lat")
    x0, y0 = G.equirect_xy(F.col("lon"), lat0, lat0)
    turn = F.radians("bearing_deg")
    lon, lat = G.equirect_lonlat(
        x0 + F.col("distance_m") * F.sin(turn), y0 + F.col("distance_m") * F.cos(turn), lat0
    )
    row = F.floor((F.col("north") - F.col("_lat")) / F.col("res_y")).cast("int")
    col = F.floor((F.col("_lon") - F.col("west")) / F.col("res_x")).cast("int")
    return lines.withColumns({"_lon": lon, "_lat": lat}).select(
        "dam_id", "raster_id", "bearing_deg", "distance_m",
        F.col("_lon").alias("sample_lon"), F.col("_lat").alias("sample_lat"),
        row.alias("row_idx"), col.alias("col_idx"), *more,
    )


def axis_spots(
    dams: DataFrame,
    rasters: DataFrame,
    length_m: float = 98.0,
    bearing_step: float = 1.0,
    profile_step: float = 10.0,
) -> DataFrame:
    """Sample places along every bearing of every dam (dam_id, raster_id, lon, lat), with their cells.

    All places of a dam are made in one task, each task having about ``SPOTS`` of them.
    """
    placed = axis_dams(dams, rasters)
    return _spots(placed, placed.count(), length_m, bearing_step, profile_step)


def axis_cells(placed: DataFrame, length_m: float = 98.0, bearing_step: float = 1.0, profile_step: float = 10.0) -> DataFrame:
    """The cells that the lines of each place of ``axis_dams`` meet, each once, written."""
    spots = _spots(placed, placed.count(), length_m, bearing_step, profile_step, "lon", "lat")
    return materialize(spots.select(*PLACE, "row_idx", "col_idx").dropna(subset=["row_idx", "col_idx"]).distinct(), "axis-cells")


def axis_terrain(
    placed: DataFrame, met: DataFrame, cells: DataFrame, length_m: float = 98.0, bearing_step: float = 1.0, profile_step: float = 10.0
) -> DataFrame:
    """All spots of the places of ``axis_dams`` with their elevation, null off the terrain.

    Only places and the different cells they meet (``axis_cells``) are shuffled. The elevations around
    a place become one row, the window of cells that holds its lines, nulls in gaps; the spots are
    made from it once more, dealt by dam, so profiles need no further shuffle.
    """
    found = met.join(cells.filter("z IS NOT NULL").select("raster_id", "row_idx", "col_idx", "z"), ["raster_id", "row_idx", "col_idx"])
    windows = found.groupBy(*PLACE).agg(
        F.min("row_idx").alias("_r0"), F.min("col_idx").alias("_c0"), (F.max("col_idx") - F.min("col_idx") + 1).alias("_w"),
        F.collect_list(F.struct("row_idx", "col_idx", "z")).alias("_e"),
    )

    def offset(row: Column, col: Column) -> Column:
        return (row - F.col("_r0")) * F.col("_w") + col - F.col("_c0")

    entries = F.transform("_e", lambda e: F.struct(offset(e["row_idx"], e["col_idx"]).alias("o"), e["z"].alias("z")))
    windows = windows.withColumn("_e", F.sort_array(entries))

    def filled(entry: Column, i: Column) -> Column:
        gap = entry["o"] - F.coalesce(F.get("_e", i - 1)["o"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(None).cast("double"), gap), F.array(entry["z"]))

    windows = windows.select(*[F.col(c).alias(f"_{c}") for c in PLACE], "_r0", "_c0", "_w", F.flatten(F.transform("_e", filled)).alias("_z"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PLACE]
    around = placed.join(windows, same, "left").select(*PLACE, *GRID, "_r0", "_c0", "_w", "_z")
    spots = _spots(around, placed.count(), length_m, bearing_step, profile_step, "_r0", "_c0", "_w", "_z")
    beside = F.col("col_idx") - F.col("_c0")
    z = F.when((beside >= 0) & (beside < F.col("_w")), F.get("_z", offset(F.col("row_idx"), F.col("col_idx"))))
    return spots.select("dam_id", "raster_id", "bearing_deg", "distance_m", "row_idx", "col_idx", z.alias("z"))


def _tasks(spots: int) -> int:
    return max(1, math.ceil(spots / SPOTS))


def axis_samples(spots: DataFrame, cells: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """The spots with their elevation, null off the terrain.

    Many spots of a dam lie in one cell: a cell that its lines meet is one row with all
    its spots, looked up by offset in its tile, which is one row with its elevations as an
    array, nulls in gaps. The rows are dealt by dam before the spots come apart again, so
    profiles need no further shuffle.
    """
    offset = F.pmod("row_idx", F.lit(tile)) * tile + F.pmod("col_idx", F.lit(tile))
    packed = with_tile(cells.filter("z IS NOT NULL"), tile).groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct(offset.alias("o"), F.col("z")))).alias("_e"))

    def filled(entry: Column, i: Column) -> Column:
        gap = entry["o"] - F.coalesce(F.get("_e", i - 1)["o"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(None).cast("double"), gap), F.array(entry["z"]))

    packed = packed.select(*TILE, F.flatten(F.transform("_e", filled)).alias("_z"))
    met = ["row_idx", "col_idx"]
    rest = [c for c in spots.columns if c not in ("dam_id", "raster_id", *met)]
    groups = with_tile(spots, tile).groupBy("dam_id", *TILE, *met).agg(F.collect_list(F.struct(*rest)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    groups = materialize(groups, "axis-cells")
    tasks = _tasks(groups.agg(F.sum("_n")).first()[0] or 0)
    found = groups.join(packed, TILE, "left").select("dam_id", "raster_id", *met, F.get("_z", offset).alias("z"), "_s")
    found = found.repartition(tasks, "dam_id").select("dam_id", "raster_id", *met, "z", F.explode("_s").alias("s"))
    return found.select("dam_id", "raster_id", *[F.col(f"s.{c}") for c in rest], *met, "z")


def axis_profile(samples: DataFrame) -> DataFrame:
    """Sample counts, distinct cells and elevation range per dam and bearing."""
    cell = F.when(F.col("z").isNotNull(), F.struct("row_idx", "col_idx"))
    return samples.groupBy("dam_id", "bearing_deg").agg(
        F.count(F.lit(1)).alias("samples"), F.count("z").alias("valid"),
        F.size(F.collect_set(cell)).alias("unique_cells"),
        F.min("z").alias("min_elevation_m"), F.max("z").alias("max_elevation_m"),
    )


def axis_score(samples: DataFrame) -> DataFrame:
    """How much each bearing looks like a valley crossing.

    Banks are the first and last 15 % of the profile by distance, the centre is
    its middle 30 %; where a zone has no sample the profile is cut by count.
    A profile needs 3 samples on 2 cells.
    """
    line = W.partitionBy("dam_id", "bearing_deg")
    d = F.col("distance_m")
    rows = samples.filter("z IS NOT NULL").withColumns(
        {
            "_lo": F.min("distance_m").over(line), "_hi": F.max("distance_m").over(line),
            "_n": F.count(F.lit(1)).over(line), "_i": F.row_number().over(line.orderBy("distance_m")) - 1,
        }
    )
    span = F.col("_hi") - F.col("_lo")
    zones = {
        "left": d <= F.col("_lo") + 0.15 * span,
        "right": d >= F.col("_hi") - 0.15 * span,
        "centre": (d >= F.col("_lo") + 0.35 * span) & (d <= F.col("_hi") - 0.35 * span),
    }
    n, i = F.col("_n"), F.col("_i")
    end = F.greatest(F.lit(1), F.floor(n / 6))
    cut = {
        "left": i < end,
        "right": i >= n - end,
        "centre": (i >= F.floor(n / 3)) & (i < F.floor(2 * n / 3) + 1),
    }
    z = F.col("z")
    out = rows.groupBy("dam_id", "bearing_deg").agg(
        F.first("_n").alias("valid"), F.first(span).alias("_span"),
        F.size(F.collect_set(F.struct("row_idx", "col_idx"))).alias("unique_cells"),
        *[F.avg(F.when(c, z)).alias(f"_{k}_zone") for k, c in zones.items()],
        *[F.avg(F.when(c, z)).alias(f"_{k}_cut") for k, c in cut.items()],
    ).filter("valid >= 3 AND unique_cells >= 2 AND _span > 0")
    whole = F.lit(True)
    for k in zones:
        whole = whole & F.col(f"_{k}_zone").isNotNull()
    out = out.withColumns({k: F.when(whole, F.col(f"_{k}_zone")).otherwise(F.col(f"_{k}_cut")) for k in zones})
    left, right = F.col("left") - F.col("centre"), F.col("right") - F.col("centre")
    both = (F.col("left") > F.col("centre")) & (F.col("right") > F.col("centre"))
    lower = F.least(left, right)
    valley = 10.0 * lower + 2.0 * (left + right) - 2.0 * F.abs(left - right)
    quality = (
        F.when(F.col("unique_cells") < 3, INVALID)
        .when(both & (lower > 2.0), "GOOD_CROSS_VALLEY")
        .when(both | (lower > 0), "WEAK_CROSSING")
        .otherwise(INVALID)
    )
    return out.select(
        "dam_id", "bearing_deg", "unique_cells",
        F.when(both, valley).otherwise(-100.0 - F.abs(left) - F.abs(right)).alias("score"),
        left.alias("left_relief_m"), right.alias("right_relief_m"), both.alias("both_ends_above_centre"),
        quality.alias("quality"),
    )


def best_axes(scores: DataFrame, n: int = 10) -> DataFrame:
    """Top bearings of each dam; ties keep bearing order."""
    order = W.partitionBy("dam_id").orderBy(F.col("score").desc(), "bearing_deg")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
