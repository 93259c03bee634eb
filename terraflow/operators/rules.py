"""Rule checks as set operations over settings, requests and artefacts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflow.session import shuffled

#: Base settings of one task of a join.
TASK_SETTINGS = 500_000

# Inclusive ranges of numeric case settings.
CASE_RANGES = [
    ("particle_spacing", "0.0001", "10.0"),
    ("simulation_time", "0.001", "86400.0"),
    ("time_out", "0.0001", "3600.0"),
    ("domain_margin_xy", "0.0", "10000.0"),
    ("domain_margin_z_bottom", "0.0", "10000.0"),
    ("domain_margin_z_top", "0.0", "10000.0"),
    ("dam_search_radius", "0.001", "10000.0"),
    ("dam_thickness", "0.001", "10000.0"),
    ("dam_crest_height", "0.001", "10000.0"),
    ("dam_embedment", "0.0", "10000.0"),
    ("dam_min_span", "0.001", "10000.0"),
    ("dam_max_span", "0.001", "10000.0"),
    ("dam_segment_length", "0.001", "10000.0"),
    ("dam_valley_threshold", "0.0", "10000.0"),
    ("reservoir_length", "0.001", "100000.0"),
    ("reservoir_water_depth", "0.0", "10000.0"),
    ("reservoir_freeboard", "0.0", "10000.0"),
    ("reservoir_segments", "1", "100000"),
    ("fluid_bed_clearance", "0.0", "10000.0"),
    ("breach_width", "0.0", "10000.0"),
    ("breach_time", "0.0", "86400.0"),
    ("breach_lift_duration", "0.0001", "86400.0"),
    ("breach_lift_distance", "0.0", "10000.0"),
    ("breach_motion_steps", "1", "1000000"),
]
# Inclusive ranges of numeric terrain settings, and the terrain settings that are switches.
TERRAIN_RANGES = [
    ("condition", "max_fill_depth", 1e-6, 1000.0),
    ("domain", "corridor_width_km", 1e-6, 100.0),
    ("sph_terrain", "target_resolution_m", 1e-3, 10000.0),
    ("sph_terrain", "scale", 1e-6, 10.0),
    ("mesh", "max_edge_m", 1e-6, 100.0),
]
TERRAIN_SWITCHES = ["preview", "csv"]
# Settings a scenario file may have at its top level.
ALLOWED_SETTINGS = [
    "name", "display_name", "description", "dam_id", "longitude", "latitude", "dam_longitude", "dam_latitude",
    "data_root", "runs_root", "inputs", "clip", "terrain", "case", "simulation", "postprocess", "dualsphysics_root",
]
# The case parameters a scenario listing shows.
LISTED_PARAMETERS = [
    "reservoir_water_depth", "particle_spacing", "simulation_time", "time_out", "breach_width", "breach_time",
    "reservoir_length", "fluid_bed_clearance",
]
# Limits of run requests (name, low, low is allowed itself, high).
REQUEST_LIMITS = [
    ("reservoir_level", 1.0, True, 100.0),
    ("breach_width", 0.05, True, 1000.0),
    ("breach_time", 0.0, True, 86400.0),
    ("simulation_time", 0.0, False, 3600.0),
    ("particle_spacing", 0.0, False, 10.0),
]
PYTHON_TYPES = {"b": "bool", "s": "str", "z": "NoneType"}


def problems(*checks: Column) -> Column:
    """The texts of the failed checks; each check is null when it holds."""
    return F.array_compact(F.array(*checks))


def joined(texts: Column) -> Column:
    return F.array_join(texts, "; ")


def _between(name: str, value: Column, low: float, high: float) -> Column:
    return F.when(
        ~value.between(low, high),
        F.concat(F.lit(f"{name} must be between {low:.0f} and {high:.0f} (got "), value.cast("string"), F.lit(")")),
    )


def coordinate_problems(lon: Column, lat: Column, dam_lon: Column, dam_lat: Column) -> Column:
    """Range and pairing rules of a study area and an optional dam position."""
    half = dam_lon.isNull() != dam_lat.isNull()
    both = dam_lon.isNotNull() & dam_lat.isNotNull()
    return problems(
        _between("lon", lon, -180, 180),
        _between("lat", lat, -90, 90),
        F.when(half, "dam_lon and dam_lat must be provided together"),
        F.when(both, _between("dam_lon", dam_lon, -180, 180)),
        F.when(both, _between("dam_lat", dam_lat, -90, 90)),
    )


def orientation_problems(axis: Column, sign: Column) -> Column:
    """Axis x or y, sign +1 or -1, and no sign without an axis."""
    return problems(
        F.when(axis.isNotNull() & ~F.lower(axis).isin("x", "y"), "dam_axis must be 'x' or 'y'"),
        F.when(sign.isNotNull() & ~sign.isin(1, -1), "dam_upstream_sign must be +1 or -1"),
        F.when(sign.isNotNull() & axis.isNull(), "dam_upstream_sign requires an explicit dam_axis"),
    )


def merged_config(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Base settings with overrides on top; override-only keys are kept."""
    b = base.withColumnsRenamed({"value": "base_value", "kind": "base_kind"}).withColumn("in_base", F.lit(True))
    o = overrides.withColumnsRenamed({"value": "over_value", "kind": "over_kind"}).withColumn("in_over", F.lit(True))
    return b.join(o, keys, "full").select(
        *keys,
        F.when(F.col("in_over"), F.col("over_value")).otherwise(F.col("base_value")).alias("value"),
        F.coalesce("in_over", F.lit(False)).alias("overridden"),
    )


def case_ranges(spark: SparkSession) -> DataFrame:
    """The range table; a fixed 24 rows, so it is broadcast."""
    rows = [(k, float(lo), float(hi), f"[{lo}, {hi}]") for k, lo, hi in CASE_RANGES]
    return F.broadcast(spark.createDataFrame(rows, "key string, low double, high double, bounds string"))


def range_problems(overrides: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Numeric overrides of numeric settings outside their range."""
    ranges = case_ranges(overrides.sparkSession)
    numeric = base.filter((F.col("kind") == "n") & F.col("key").isin([k for k, _, _ in CASE_RANGES])).select(*keys)
    value = F.col("value").try_cast("double")
    # Only overrides outside their range look for their setting; they are few.
    outside = (
        overrides.filter("kind = 'n'")
        .join(ranges, "key")
        .filter(~value.between(F.col("low"), F.col("high")))
        .select(
            *keys,
            F.concat(
                F.lit("'case.overrides."), "key", F.lit("' = "), "value",
                F.lit(" outside valid range "), "bounds",
            ).alias("problem"),
        )
    )
    # Repetitive settings are far smaller in a shuffle than in a sort: tasks are set by rows.
    tasks = max(1, math.ceil(numeric.count() / TASK_SETTINGS))
    return outside.repartition(tasks, *keys).join(shuffled(numeric.repartition(tasks, *keys)), keys, "left_semi")


def terrain_problems(settings: DataFrame, keys: list[str]) -> DataFrame:
    """Terrain settings (section, key, kind, value) of the wrong type or outside their range."""
    name = F.concat(F.lit("'terrain."), "section", F.lit("."), "key", F.lit("'"))
    switch = F.col("key").isin(TERRAIN_SWITCHES)
    value, outside = F.col("value").try_cast("double"), F.lit(None).cast("string")
    for section, key, low, high in TERRAIN_RANGES:
        here = (F.col("section") == section) & (F.col("key") == key) & ~value.between(low, high)
        outside = F.when(here, F.lit(f" outside valid range [{low}, {high}]")).otherwise(outside)
    problem = (
        F.when(switch & (F.col("kind") != "b"), F.concat(name, F.lit(" must be true/false")))
        .when(~switch & (F.col("kind") != "n"), F.concat(name, F.lit(" must be a number")))
        .when(~switch, F.concat(name, F.lit(" = "), "value", outside))
    )
    return settings.select(*keys, problem.alias("problem")).filter("problem IS NOT NULL")


def type_problems(overrides: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides whose type differs from that of the setting they replace."""
    b = base.select(*keys, F.col("kind").alias("base_kind"))
    name = F.create_map(*[F.lit(x) for pair in PYTHON_TYPES.items() for x in pair])[F.col("base_kind")]
    need = F.when(F.col("base_kind") == "n", " must be a number").otherwise(F.concat(F.lit(" must be of type "), name))
    return (
        overrides.join(b, keys)
        .filter(F.col("kind") != F.col("base_kind"))
        .select(*keys, F.concat(F.lit("'case.overrides."), "key", F.lit("'"), need).alias("problem"))
    )


def unknown_overrides(overrides: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides of settings the base configuration does not have."""
    return overrides.join(base, keys, "left_anti")


def unknown_settings(settings: DataFrame) -> DataFrame:
    """Top-level settings outside the allow list."""
    return settings.filter(~F.col("key").isin(ALLOWED_SETTINGS))


def same_overrides(own: DataFrame, used: DataFrame, owner: str) -> DataFrame:
    """Owners whose used settings equal their own; none used counts as equal."""
    o = own.select(owner, "key", F.col("value").alias("own"), F.lit(True).alias("in_own"))
    u = used.select(owner, "key", F.col("value").alias("used"), F.lit(True).alias("in_used"))
    same = F.coalesce(F.col("in_own") & F.col("in_used"), F.lit(False)) & F.col("own").eqNullSafe(F.col("used"))
    return (
        o.join(u, [owner, "key"], "full")
        .groupBy(owner)
        .agg((F.bool_and(same) | (F.count("in_used") == 0)).alias("validated"))
    )


def request_problems(names: list[str] | None = None) -> Column:
    """Limits of a run request; a null value keeps the scenario's own."""
    checks = []
    for name, low, closed, high in REQUEST_LIMITS:
        if names and name not in names:
            continue
        c = F.col(name)
        below = (c < low) if closed else (c <= low)
        sign = ">=" if closed else ">"
        checks.append(F.when(below, f"{name} must be {sign} {low:g}"))
        checks.append(F.when(c > high, f"{name} must be <= {high:g}"))
    return problems(*checks)


def freshness(recorded: DataFrame, current: DataFrame, params: DataFrame) -> DataFrame:
    """Whether each step may be skipped.

    Fresh: same parameters, at least one output, and every recorded input and
    output still there in the same order with the same time and size.
    """
    place = ["step_id", "kind", "ordinal"]
    r = recorded.select(*place, F.struct("path", "mtime_ns", "size").alias("was"))
    c = current.select(*place, F.struct("path", "mtime_ns", "size").alias("now"))
    state = r.join(c, place, "full").groupBy("step_id").agg(
        F.bool_and(F.col("was").eqNullSafe(F.col("now"))).alias("unchanged"),
        F.count_if((F.col("kind") == "output") & F.col("now").isNotNull()).alias("outputs"),
    )
    return params.join(state, "step_id", "left").select(
        "step_id",
        F.coalesce(
            F.col("recorded_params").eqNullSafe(F.col("current_params"))
            & F.col("unchanged") & (F.col("outputs") > 0),
            F.lit(False),
        ).alias("fresh"),
    )


def rule_summary(checks: DataFrame, owner: str) -> DataFrame:
    """Status, passed checks and the error texts of each owner.

    ``checks`` has one row per rule: owner, ordinal, ok, message.
    """
    failed = F.when(~F.col("ok"), F.struct("ordinal", "message"))
    return checks.groupBy(owner).agg(
        F.when(F.bool_and("ok"), "pass").otherwise("fail").alias("status"),
        F.count_if("ok").alias("checks_passed"),
        F.transform(F.sort_array(F.collect_list(failed)), lambda s: s["message"]).alias("errors"),
    )
