"""Neighbour access on cell tables by two ordered passes.

``cells`` has (raster_id, row_idx, col_idx, z); z null and missing rows are
nodata. A pass along the rows adds the left and right neighbour, a pass along
the columns then brings those triples from above and below: two shuffles of the
cells for all eight neighbours, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["raster_id", "row_idx", "col_idx"]
# Direction index to (row step, column step).
DIRECTIONS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
DIAGONAL = 2.0**0.5
# A neighbour may be up to this much higher per pixel and still be drained to.
START_SLOPE = -1.0


def neighbourhood(cells: DataFrame) -> DataFrame:
    """Cells with n0..n7, the neighbour values in direction order."""
    along_row = W.partitionBy("raster_id", "row_idx").orderBy("col_idx")
    col = F.col("col_idx")
    prev_col, next_col = F.lag("col_idx").over(along_row), F.lead("col_idx").over(along_row)
    rows = cells.select(*CELL, "z").select(
        *CELL, "z",
        prev_col.alias("_pc"), next_col.alias("_nc"),
        F.lag("z").over(along_row).alias("_pz"), F.lead("z").over(along_row).alias("_nz"),
    )
    none = F.lit(None).cast("double")

    def triple(c: Column, left: Column, mid: Column, right: Column, real: bool) -> Column:
        return F.struct(
            c.alias("col_idx"), left.alias("w"), mid.alias("c"), right.alias("e"), F.lit(real).alias("real")
        )

    own = triple(
        col, F.when(F.col("_pc") == col - 1, F.col("_pz")), F.col("z"), F.when(F.col("_nc") == col + 1, F.col("_nz")), True
    )
    # Cells without a row next to this one still carry its value up and down.
    right_gap = F.when(
        F.col("_nc").isNull() | (F.col("_nc") > col + 1),
        triple(col + 1, F.col("z"), none, F.when(F.col("_nc") == col + 2, F.col("_nz")), False),
    )
    left_gap = F.when(
        F.col("_pc").isNull() | (F.col("_pc") < col - 2), triple(col - 1, none, none, F.col("z"), False)
    )
    wide = rows.select(
        "raster_id", "row_idx", F.explode(F.array_compact(F.array(own, right_gap, left_gap))).alias("t")
    ).select("raster_id", "row_idx", "t.*")
    along_col = W.partitionBy("raster_id", "col_idx").orderBy("row_idx")
    here = F.struct("row_idx", "w", "c", "e")
    up, down = F.lag(here).over(along_col), F.lead(here).over(along_col)
    both = wide.withColumns({"_u": up, "_d": down}).filter("real")
    above, below = F.col("_u.row_idx") == F.col("row_idx") - 1, F.col("_d.row_idx") == F.col("row_idx") + 1
    return both.select(
        *CELL, F.col("c").alias("z"),
        *[F.when(above, F.col(f"_u.{s}")).alias(f"n{i}") for i, s in enumerate("wce")],
        F.col("w").alias("n3"), F.col("e").alias("n4"),
        *[F.when(below, F.col(f"_d.{s}")).alias(f"n{i}") for i, s in enumerate("wce", start=5)],
    )


def d8_direction(cells: DataFrame) -> DataFrame:
    """Direction 0..7 of steepest descent in pixel units, -1 for none.

    Ties go to the lowest index. A neighbour under one unit higher per pixel can
    win, so pits and flats drain too and two-cell cycles appear.
    """
    z = F.col("z")
    drops = [
        (z - F.col(f"n{i}")) / F.lit(DIAGONAL if dr and dc else 1.0) for i, (dr, dc) in enumerate(DIRECTIONS)
    ]
    near = neighbourhood(cells).select(*CELL, "z", *[d.alias(f"s{i}") for i, d in enumerate(drops)])
    best = F.greatest(*[F.col(f"s{i}") for i in range(8)])
    pick = F.when(best.isNull() | (best <= START_SLOPE), F.lit(-1))
    for i in range(8):
        pick = pick.when(F.col(f"s{i}") == best, F.lit(i))
    return near.filter("z IS NOT NULL").select(*CELL, "z", pick.otherwise(F.lit(-1)).alias("dir"))


def direction_step(direction: Column, axis: int) -> Column:
    """Row (axis 0) or column (axis 1) step of a direction; null for none."""
    table = F.array(*[F.lit(d[axis]) for d in DIRECTIONS])
    return F.when(direction >= 0, table[direction])


def targets(directions: DataFrame) -> DataFrame:
    """Cells with the cell they drain to."""
    d = F.col("dir")
    return directions.withColumns(
        {"to_row": F.col("row_idx") + direction_step(d, 0), "to_col": F.col("col_idx") + direction_step(d, 1)}
    )


def in_degree(directions: DataFrame) -> DataFrame:
    """Number of cells draining into each cell."""
    into = (
        targets(directions).filter("dir >= 0")
        .groupBy("raster_id", F.col("to_row").alias("row_idx"), F.col("to_col").alias("col_idx"))
        .agg(F.count(F.lit(1)).alias("in_degree"))
    )
    return directions.select(*CELL).join(into, CELL, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def gradient(cells: DataFrame, rasters: DataFrame) -> DataFrame:
    """Row and column slopes per cell; nodata counts as the lowest elevation."""
    low = cells.groupBy("raster_id").agg(F.min("z").alias("_low"), F.max("z").alias("_high"))
    size = rasters.select("raster_id", "width", "height").join(low, "raster_id")
    near = neighbourhood(cells).select(*CELL, "z", "n1", "n3", "n4", "n6").join(size, "raster_id")

    def pad(c: str) -> Column:
        return F.coalesce(F.col(c), F.col("_low"))

    def slope(before: str, after: str, at: str, length: str) -> Column:
        pos, n = F.col(at), F.col(length)
        return (
            F.when(n < 2, F.lit(0.0)).when(pos == 0, pad(after) - pad("z"))
            .when(pos == n - 1, pad("z") - pad(before)).otherwise((pad(after) - pad(before)) / 2)
        )

    return near.select(
        *CELL, "z", F.col("_low").alias("z_low"), F.col("_high").alias("z_high"),
        slope("n1", "n6", "row_idx", "height").alias("dz_row"), slope("n3", "n4", "col_idx", "width").alias("dz_col"),
    )


# Light direction, weights of elevation and light in the relief picture (1 - 0.55 is not the double 0.45).
AZIMUTH, ALTITUDE, GRAY_WEIGHT, SHADE_WEIGHT = 315.0, 45.0, 0.45, 0.55


def hillshade(gradients: DataFrame) -> DataFrame:
    """Light 0..1 on each cell."""
    dx, dy = F.col("dz_col"), F.col("dz_row")
    slope = F.lit(3.141592653589793 / 4) - F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.atan2(-dx, dy)
    az, alt = F.radians(F.lit(AZIMUTH)), F.radians(F.lit(ALTITUDE))
    shade = F.sin(alt) * F.sin(slope) + F.cos(alt) * F.cos(slope) * F.cos(az - aspect)
    return gradients.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)))


def relief_image(shaded: DataFrame) -> DataFrame:
    """Grey level 0..255 of elevation and light; nodata is 0."""
    span = F.col("z_high") - F.col("z_low")
    gray = F.when(span > 0, (F.col("z") - F.col("z_low")) / span).otherwise(F.lit(0.0)) * 255.0
    mixed = gray * GRAY_WEIGHT + F.col("shade") * 255.0 * SHADE_WEIGHT
    level = F.least(F.lit(255.0), F.greatest(F.lit(0.0), mixed)).cast("int")
    return shaded.select(*CELL, F.when(F.col("z").isNotNull(), level).otherwise(F.lit(0)).alias("level"))
