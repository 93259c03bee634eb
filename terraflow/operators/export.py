"""Result packages: georegistered rings, GeoJSON features, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.functions.geodesy import utm_inverse
from terraflow.operators.particles import FRAME


def rings_to_lonlat(extents: DataFrame, geo: DataFrame) -> DataFrame:
    """Rings in model units to degrees.

    ``geo`` has one row per run: origin_x, origin_y, scale, epsg. The
    projection is a Column expression applied point by point inside the ring.
    """
    rows = extents.join(geo, "run_id")
    points = rows.select(*FRAME, "origin_x", "origin_y", "scale", "epsg", F.posexplode("ring").alias("i", "p"))
    lon, lat = utm_inverse(
        F.col("origin_x") + F.col("p.x") / F.col("scale"), F.col("origin_y") + F.col("p.y") / F.col("scale"), F.col("epsg")
    )
    ring = F.sort_array(F.collect_list(F.struct("i", "lon", "lat")))
    back = points.select(*FRAME, "i", lon.alias("lon"), lat.alias("lat")).groupBy(*FRAME).agg(ring.alias("r"))
    return extents.join(
        back.select(*FRAME, F.transform("r", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("lonlat")),
        FRAME,
    )


def lonlat_bounds(extents: DataFrame) -> DataFrame:
    """West, south, east, north of all rings of a run."""
    p = extents.select("run_id", F.explode("lonlat").alias("p"))
    return p.groupBy("run_id").agg(
        F.min("p.lon").alias("west"), F.min("p.lat").alias("south"), F.max("p.lon").alias("east"), F.max("p.lat").alias("north")
    )


def flood_features(extents: DataFrame, times: DataFrame) -> DataFrame:
    """One GeoJSON Polygon feature text per frame, coordinates to 7 places."""
    ring = F.transform("lonlat", lambda p: F.array(F.round(p["lon"], 7), F.round(p["lat"], 7)))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct("frame", F.col("time_s").alias("time"), F.col("wet_area").alias("area_units")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        )
    )
    return extents.join(times, FRAME).select(*FRAME, feature.alias("feature"))


def manifests(series: DataFrame, times: DataFrame, bounds: DataFrame, metrics: DataFrame) -> DataFrame:
    """One JSON manifest text per run; arrays hold one element per frame."""
    item = F.struct("frame", "time_s", "particles", "speed_max", "wet_area", "extent", "reach")
    packed = series.join(times, FRAME).groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("s"))

    def rounded(name: str):
        return F.transform(F.col(f"s.{name}"), lambda v: F.round(v, 6)).alias(name)

    doc = F.struct(
        F.struct(F.size("s").alias("count"), F.col("s.particles").alias("counts"), rounded("time_s")).alias("frames"),
        F.struct(*[F.col(c) for c in bounds.columns if c != "run_id"]).alias("bounds"),
        F.struct(*[F.col(c) for c in metrics.columns if c != "run_id"]).alias("metrics"),
        F.struct(rounded("speed_max"), rounded("wet_area"), rounded("extent"), rounded("reach")).alias("series"),
    )
    return packed.join(bounds, "run_id").join(metrics, "run_id").select("run_id", F.to_json(doc).alias("manifest"))
