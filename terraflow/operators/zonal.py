"""Terrain statistics inside axis-aligned boxes.

Both sides are keyed by the cells of a hierarchy of grids, each twice as coarse as the one
before. A box is covered by cells of the grid that fits its size, at most ``ACROSS`` + 1 along
each side, and joined to the points of these cells, so a large box makes as few keys
as a small one and no pair outside a shared cell is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.operators.quantiles import exact_quantiles
from terraflow.session import materialize, shuffled


#: Cells along the longer side of a box in the grid of its level, one more where it crosses an edge.
ACROSS = 4
FINEST = 1.0 / 1024


def _at(c: Column, step: Column) -> Column:
    return F.floor(c / step).cast("long")


def _step(level: Column) -> Column:
    return F.pow(F.lit(2.0), level) * FINEST


def _box_levels(boxes: DataFrame) -> DataFrame:
    """Boxes of known corners with ordered ones and the ``_level`` of the grid that fits them."""
    b = boxes.withColumns({
        "_x0": F.least("x0", "x1"), "_x1": F.greatest("x0", "x1"), "_y0": F.least("y0", "y1"), "_y1": F.greatest("y0", "y1"),
    }).filter("x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL")
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / ACROSS
    return b.withColumn("_level", F.greatest(F.ceil(F.log2(F.greatest(side / FINEST, F.lit(1.0)))), F.lit(0)).cast("int"))


def box_keys(boxes: DataFrame) -> DataFrame:
    """The boxes (site_id, x0, x1, y0, y1, corners in any order) with ``_level``, ``_bx`` and ``_by`` of each cell that covers them.

    A box with an unknown corner has no cell.
    """
    b = _box_levels(boxes)
    step = _step(F.col("_level"))
    for c in ("x", "y"):
        b = b.withColumn(f"_b{c}", F.explode(F.sequence(_at(F.col(f"_{c}0"), step), _at(F.col(f"_{c}1"), step))))
    return b


def points_in_boxes(boxes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """(box, point) pairs; ``boxes`` has site_id, x0, x1, y0, y1, edges included.

    Points are keyed once for each level that some box of their site has; there are as many
    levels as doublings between the smallest and the largest box. The keys of the boxes are many
    times the boxes, so they are never broadcast by the size of these.
    """
    boxes = boxes.select("site_id", *keys, "x0", "x1", "y0", "y1")
    b = shuffled(box_keys(boxes).drop("x0", "x1", "y0", "y1"))
    levels = _box_levels(boxes).groupBy("site_id").agg(F.collect_set("_level").alias("_levels"))
    p = points.select("site_id", "x", "y", "z").join(levels, "site_id").withColumn("_level", F.explode("_levels")).drop("_levels")
    step = _step(F.col("_level"))
    p = p.withColumns({"_bx": _at(F.col("x"), step), "_by": _at(F.col("y"), step)})
    inside = F.col("x").between(F.col("_x0"), F.col("_x1")) & F.col("y").between(F.col("_y0"), F.col("_y1"))
    return b.join(p, ["site_id", "_level", "_bx", "_by"]).filter(inside).select("site_id", *keys, "x", "y", "z")


def zonal_range(boxes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with count, lowest and highest terrain; null where there is none."""
    stats = points_in_boxes(boxes, points, keys).groupBy(*keys).agg(
        F.count("z").alias("cell_count"), F.min("z").alias("cell_min"), F.max("z").alias("cell_max")
    )
    return boxes.join(stats, keys, "left")


def zonal_stats(boxes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`zonal_range`, with the exact median.

    The median takes several rounds over the values inside, which are written once.
    """
    pairs = materialize(points_in_boxes(boxes, points, keys).select(*keys, "z"), "box-values")
    names = {"count": "cell_count", "min": "cell_min", "max": "cell_max"}
    return boxes.join(exact_quantiles(pairs, keys, "z", {"cell_median": 0.5}, summary=names), keys, "left")


def box_union(boxes: DataFrame, owner: str) -> DataFrame:
    """Bounds around all boxes of an owner."""
    return boxes.groupBy(owner).agg(
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"),
        F.min("z0").alias("z_min"), F.max("z1").alias("z_max"),
    )


def box_containment(bounds: DataFrame, domains: DataFrame, owner: str, slack: float = 1e-6) -> DataFrame:
    """Named bounds that stick out of the domain of their owner.

    ``bounds`` has (owner, name, x_min .. z_max), null bounds are not checked;
    ``domains`` has (owner, lo_x .. hi_z).
    """
    ok: Column = F.lit(True)
    for c in ("x", "y", "z"):
        ok = ok & (F.col(f"{c}_min") >= F.col(f"lo_{c}") - slack) & (F.col(f"{c}_max") <= F.col(f"hi_{c}") + slack)
    known = F.col("x_min").isNotNull()
    rows = bounds.join(domains, owner)
    text = F.when(known & ~ok, F.concat(F.lit("simulation domain does not fully contain "), "name"))
    return rows.groupBy(owner).agg(
        F.when(F.count(text) == 0, "pass").otherwise("fail").alias("status"), F.sort_array(F.collect_list(text)).alias("errors")
    )


def band_section(points: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a cross-section: near the section line and within its length."""
    half_x = F.when(F.col("axis") == "x", F.col("length_half")).otherwise(F.col("band_half"))
    half_y = F.when(F.col("axis") == "x", F.col("band_half")).otherwise(F.col("length_half"))
    boxes = sections.select(
        "site_id", *keys, (F.col("cx") - half_x).alias("x0"), (F.col("cx") + half_x).alias("x1"),
        (F.col("cy") - half_y).alias("y0"), (F.col("cy") + half_y).alias("y1"),
    )
    return points_in_boxes(boxes, points, keys)


def boxes_in_band(boxes: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes of the same dam that overlap the band of a section."""
    lo = F.when(F.col("axis") == "x", F.col("y0")).otherwise(F.col("x0"))
    hi = F.when(F.col("axis") == "x", F.col("y1")).otherwise(F.col("x1"))
    mid = F.when(F.col("axis") == "x", F.col("cy")).otherwise(F.col("cx"))
    rows = boxes.join(sections.select(*keys, "axis", "cx", "cy", "band_half"), keys)
    return rows.filter((lo <= mid + F.col("band_half")) & (hi >= mid - F.col("band_half"))).select(*boxes.columns)
