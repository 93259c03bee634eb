"""Terrain point clouds: domain points, resampling, local frames, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.operators.ordered import number_rows
from terraflow.session import materialize_some, shuffled


def domain_points(domain: DataFrame, rasters: DataFrame, grids: DataFrame, site: str = "raster_id") -> DataFrame:
    """UTM points at the centres of valid domain cells.

    ``domain`` is a cell table of the domains of all sites, named by column
    ``site``; ``grids`` has the EPSG code of the local grid of each raster.
    """
    frame = rasters.select("raster_id", "west", "north", "res_x", "res_y").join(grids.select("raster_id", "epsg"), "raster_id")
    rows = domain.filter("z IS NOT NULL").join(frame, "raster_id")
    lon = F.col("west") + (F.col("col_idx") + 0.5) * F.col("res_x")
    lat = F.col("north") - (F.col("row_idx") + 0.5) * F.col("res_y")
    x, y = G.utm_forward(lon, lat, F.col("epsg"))
    return rows.select(
        F.col(site).alias("site_id"), "row_idx", "col_idx", x.alias("x"), y.alias("y"), F.col("z")
    )


def native_resolution(rasters: DataFrame) -> DataFrame:
    """Mean cell size in metres."""
    mid = G.mid_latitude(F.col("north"), F.col("height"), F.col("res_y"))
    mx, my = G.cell_metres(F.col("res_x"), F.col("res_y"), mid)
    plain = (F.abs("res_x") + F.abs("res_y")) / 2
    return rasters.select(
        "raster_id", F.when(F.col("epsg") == 4326, (mx + my) / 2).otherwise(plain).alias("native_m")
    )


def grid_resample(points: DataFrame, native: DataFrame, target_m: float) -> DataFrame:
    """Mean elevation per square bin where the target is over 1.5 native cells of the site (site_id, native_m).

    Other sites keep their points. Bins count from the smallest x and y.
    """
    effective = F.greatest(F.lit(target_m), F.col("native_m"))
    frame = points.groupBy("site_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0")).join(
        native.select("site_id", "native_m", effective.alias("res")), "site_id"
    )
    rows = points.join(frame, "site_id")
    coarse = F.col("res") > F.col("native_m") * 1.5

    def index(v: str, v0: str) -> Column:
        return F.floor((F.col(v) - F.col(v0)) / F.col("res")).cast("int")

    binned = rows.filter(coarse).groupBy(
        "site_id", "_x0", "_y0", "res", index("x", "_x0").alias("ix"), index("y", "_y0").alias("iy")
    ).agg(F.avg("z").alias("z"))
    out = binned.select(
        "site_id", "ix", "iy", (F.col("_x0") + (F.col("ix") + 0.5) * F.col("res")).alias("x"),
        (F.col("_y0") + (F.col("iy") + 0.5) * F.col("res")).alias("y"), "z",
    )
    return out.unionByName(rows.filter(~coarse).select("site_id", "x", "y", "z"), allowMissingColumns=True)


def lattice_order(bins: DataFrame) -> DataFrame:
    """Row-major ids of bins: by iy, then ix, from 0 in each site."""
    return number_rows(bins, ["site_id"], "iy", ["ix"], "order").withColumn("order", F.col("order") - 1)


def local_scale(points: DataFrame, scale: float = 0.02) -> DataFrame:
    """Coordinates from the site corner, in metres and in model units."""
    corner = points.groupBy("site_id").agg(F.min("x").alias("origin_x"), F.min("y").alias("origin_y"))
    rows = points.join(corner, "site_id")
    x, y = F.col("x") - F.col("origin_x"), F.col("y") - F.col("origin_y")
    return rows.select(
        *[c for c in points.columns if c not in ("x", "y", "z")], "origin_x", "origin_y", x.alias("x_m"), y.alias("y_m"),
        F.col("z").alias("elevation_m"), (x * scale).alias("x_sim"), (y * scale).alias("y_sim"),
        (F.col("z") * scale).alias("z_sim"),
    )


def terrain_summary(scaled: DataFrame) -> DataFrame:
    """Sample count and ranges of each site."""
    return scaled.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("elevation_m").alias("elev_min"), F.max("elevation_m").alias("elev_max"),
        *[f(c).alias(f"{c}_{n}") for c in ("x_sim", "y_sim", "z_sim") for n, f in (("min", F.min), ("max", F.max))],
    )


def xy_dedupe(points: DataFrame, order: str) -> DataFrame:
    """One point per XY to 9 places, the first in ``order``; others than finite drop out.

    Groups of equal points shrink before the shuffle, however many there are.
    """
    ok = F.lit(True)
    for c in ("x", "y", "z"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rest = [c for c in points.columns if c != order]
    first = F.min_by(F.struct(*rest), order).alias("p")
    return points.filter(ok).groupBy(
        "site_id", F.round("x", 9).alias("_x"), F.round("y", 9).alias("_y")
    ).agg(F.min(order).alias(order), first).select(order, "p.*")


def nearest_sample(targets: DataFrame, points: DataFrame, cell: float, order: str) -> DataFrame:
    """Elevation of the point nearest to each target; ties go to the first point.

    Targets look into the 3 x 3 bins around them. A point found within one bin
    width is the nearest; targets without one go on with bins twice as wide.
    """
    sites = points.select("site_id").distinct()
    open_ones, some = materialize_some(
        targets.join(sites, "site_id", "left_semi").select("dam_id", "site_id", "dam_x", "dam_y"), "nearest"
    )
    found = None
    while some:
        def at(c: str) -> Column:
            return F.floor(F.col(c) / cell).cast("long")

        ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = open_ones.withColumn("o", F.explode(ring)).withColumns(
            {"_bx": at("dam_x") + F.col("o.i"), "_by": at("dam_y") + F.col("o.j")}
        ).drop("o")
        p = points.select("site_id", "x", "y", "z", order, at("x").alias("_bx"), at("y").alias("_by"))
        dx, dy = F.col("x") - F.col("dam_x"), F.col("y") - F.col("dam_y")
        best = near.join(p, ["site_id", "_bx", "_by"]).groupBy("dam_id").agg(
            F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col(order).alias("pt"), F.col("z").alias("z"))).alias("b")
        )
        sure = best.filter(F.col("b.d2") <= cell * cell).select("dam_id", "b.*")
        left, some = materialize_some(
            open_ones.join(sure, "dam_id", "left").select(*open_ones.columns, "d2", "pt", "z"), "nearest", F.col("d2").isNull()
        )
        done = left.filter("d2 IS NOT NULL").select("dam_id", "site_id", "d2", "pt", "z")
        found = done if found is None else found.unionByName(done)
        open_ones = left.filter("d2 IS NULL").select(*open_ones.columns)
        cell *= 2.0
    if found is None:
        found = open_ones.select("dam_id", "site_id", *[F.lit(None).cast("double").alias(c) for c in ("d2", "pt", "z")])
    return targets.join(
        found.select("dam_id", F.sqrt("d2").alias("distance"), F.col("pt").alias("nearest_pt"), F.col("z").alias("dam_z")),
        "dam_id", "left",
    )


def within_radius(targets: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """(target, point) pairs closer than ``radius``, joined on bins of that width, by a shuffle of the nine bins of each target."""

    def at(c: str) -> Column:
        return F.floor(F.col(c) / radius).cast("long")

    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = targets.withColumn("o", F.explode(ring)).withColumns(
        {"_bx": at("dam_x") + F.col("o.i"), "_by": at("dam_y") + F.col("o.j")}
    ).drop("o")
    p = points.select("site_id", "x", "y", "z", at("x").alias("_bx"), at("y").alias("_by"))
    dx, dy = F.col("x") - F.col("dam_x"), F.col("y") - F.col("dam_y")
    return (
        shuffled(near).join(p, ["site_id", "_bx", "_by"])
        .withColumns({"dx": dx, "dy": dy, "dist": F.sqrt(dx * dx + dy * dy)})
        .filter(F.col("dist") <= radius)
        .drop("_bx", "_by")
    )


# Share of level samples from which an anchor counts as a flat plane.
FLAT_SHARE = 0.35


def flat_surface(targets: DataFrame, points: DataFrame, radius: float, tolerance: float) -> DataFrame:
    """Share of samples level with the dam (plane_z) and the relief around it."""
    pairs = within_radius(targets, points, radius)
    level = F.abs(F.col("z") - F.col("plane_z")) <= tolerance
    agg = pairs.filter("plane_z IS NOT NULL").groupBy("dam_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(level) / F.count(F.lit(1))).alias("share"),
        (F.max("z") - F.min("z")).alias("relief"),
    )
    share = F.coalesce("share", F.lit(0.0))
    return targets.join(agg, "dam_id", "left").select(
        "dam_id", "plane_z", F.coalesce("n", F.lit(0)).alias("sample_count"), share.alias("flat_fraction"), "relief",
        (share >= FLAT_SHARE).alias("is_flat_water_plane"),
    )


def upstream_axis(targets: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Direction +x, -x, +y or -y with the highest mean terrain; default +x.

    A sector holds points between a quarter radius and the radius with most of
    their distance along the direction, and needs three of them. Ties go to the
    first direction.
    """
    pairs = within_radius(targets, points, radius)
    ways = [("x", 1.0, F.col("dx")), ("x", -1.0, -F.col("dx")), ("y", 1.0, F.col("dy")), ("y", -1.0, -F.col("dy"))]
    aggs = []
    for i, (_, _, along) in enumerate(ways):
        z = F.when((F.col("dist") > 0.25 * radius) & (along > 0.25 * F.col("dist")), F.col("z"))
        aggs += [F.count(z).alias(f"n{i}"), F.avg(z).alias(f"m{i}")]
    means = pairs.groupBy("dam_id").agg(*aggs)
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"n{i}") >= 3,
                    F.struct(
                        F.col(f"m{i}").alias("score"), F.lit(-i).alias("order"), F.lit(axis).alias("axis"), F.lit(sign).alias("sign")
                    ),
                )
                for i, (axis, sign, _) in enumerate(ways)
            ]
        )
    )
    best = means.select("dam_id", F.array_max(options).alias("b"))
    return targets.join(best, "dam_id", "left").select(
        *targets.columns, F.coalesce("b.axis", F.lit("x")).alias("flow_axis"), F.coalesce("b.sign", F.lit(1.0)).alias("upstream_sign"),
        F.when(F.col("b").isNotNull(), "local-upstream-elevation-heuristic").otherwise("fallback-default").alias("method"),
    )
