"""Particle snapshots to per-frame and per-run figures.

``particles`` has (run_id, frame, x, y, z, vx, vy, vz); everything after the
first aggregation is one row per frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.functions.scalars import speed
from terraflow.operators.hull import convex_hulls, ring_area
from terraflow.operators.rules import joined, problems

FRAME = ["run_id", "frame"]
BYTES_PER_PARTICLE = 16
NOMINAL_INTERVAL = 0.05


def frame_metrics(particles: DataFrame, setup: DataFrame) -> DataFrame:
    """Count, top speed, extent and reach of each frame that has particles.

    The extent is always the largest coordinate on the flow axis, also where
    the flow runs the other way; reach is null when the dam centre is unknown.
    """
    per = particles.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("particles"),
        F.max(speed(F.col("vx"), F.col("vy"), F.col("vz"))).alias("speed_max"),
        F.max("x").alias("x_max"), F.max("y").alias("y_max"),
    )
    extent = F.when(F.col("flow_axis") == "y", F.col("y_max")).otherwise(F.col("x_max"))
    downstream = -F.coalesce("upstream_sign", F.lit(1.0))
    return (
        per.join(setup.select("run_id", "flow_axis", "upstream_sign", "dam_center"), "run_id")
        .withColumn("extent", extent)
        .withColumn("reach", (F.col("extent") - F.col("dam_center")) * downstream)
        .select(*FRAME, "particles", "speed_max", "extent", "reach")
    )


def frame_spine(setup: DataFrame) -> DataFrame:
    """All frames of each run, one per frame file."""
    return setup.filter("frame_files > 0").select(
        "run_id", F.explode(F.sequence(F.lit(0), F.col("frame_files") - 1)).alias("frame")
    )


def frame_times(setup: DataFrame, times: DataFrame) -> DataFrame:
    """Time of each frame: recorded when complete, else by interval, else the index."""
    t = times.select("run_id", F.col("part").alias("frame"), "time_s")
    rows = frame_spine(setup).join(t, FRAME, "left").join(setup.select("run_id", "time_out"), "run_id")
    complete = F.bool_and(F.col("time_s").isNotNull()).over(W.partitionBy("run_id"))
    has_step = F.coalesce(F.col("time_out") > 0, F.lit(False))
    return rows.withColumn("_all", complete).select(
        *FRAME,
        F.when(F.col("_all"), F.col("time_s"))
        .when(has_step, F.round(F.col("frame") * F.col("time_out"), 6))
        .otherwise(F.col("frame").cast("double")).alias("time_s"),
        (F.col("_all") | has_step).alias("time_known"),
    )


def carry_forward(metrics: DataFrame, setup: DataFrame) -> DataFrame:
    """A row for every frame; empty ones keep the last extent, reach and hull."""
    before = W.partitionBy("run_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    rows = frame_spine(setup).join(metrics, FRAME, "left").join(
        setup.select("run_id", F.col("dam_center").isNotNull().alias("_centre")), "run_id"
    )
    filled = F.col("particles").isNotNull()
    return rows.select(
        *FRAME,
        F.coalesce("particles", F.lit(0)).alias("particles"),
        F.coalesce("speed_max", F.lit(0.0)).alias("speed_max"),
        F.coalesce(F.last("extent", ignorenulls=True).over(before), F.lit(0.0)).alias("extent"),
        F.when(F.col("_centre"), F.coalesce(F.last("reach", ignorenulls=True).over(before), F.lit(0.0))).alias("reach"),
        F.last(F.when(filled, F.col("frame")), ignorenulls=True).over(before).alias("hull_frame"),
    )


def bounds(points: DataFrame, key: str) -> DataFrame:
    """Smallest and largest x, y, z of each group."""
    return points.groupBy(key).agg(
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))]
    )


def merged_bounds(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two bounds tables, with its centre and size."""
    names = [f"{c}_{n}" for c in ("x", "y", "z") for n in ("min", "max")]
    both = first.select(key, *names).unionByName(second.select(key, *names))
    out = both.groupBy(key).agg(*[(F.min if n.endswith("min") else F.max)(n).alias(n) for n in names])
    span = {c: F.col(f"{c}_max") - F.col(f"{c}_min") for c in ("x", "y", "z")}
    return out.select(
        key, *names,
        *[((F.col(f"{c}_min") + F.col(f"{c}_max")) / 2).alias(f"{c}_mid") for c in ("x", "y", "z")],
        F.greatest(F.sqrt(span["x"] * span["x"] + span["y"] * span["y"]), span["z"], F.lit(1e-6)).alias("size"),
    )


def peak_speed(series: DataFrame, times: DataFrame) -> DataFrame:
    """Highest speed of each run with its first frame; frame 0 when nothing moves."""
    rows = series.join(times, FRAME)
    moving = F.col("speed_max") > 0
    best = F.max(F.when(moving, F.struct("speed_max", (-F.col("frame")).alias("neg"), "time_s")))
    return rows.groupBy("run_id").agg(best.alias("b"), F.min_by("time_s", "frame").alias("_t0")).select(
        "run_id",
        F.coalesce(F.col("b.speed_max"), F.lit(0.0)).alias("peak_speed"),
        F.coalesce(-F.col("b.neg"), F.lit(0)).alias("peak_frame"),
        F.coalesce(F.col("b.time_s"), F.col("_t0")).alias("peak_time"),
    )


def run_metrics(series: DataFrame, times: DataFrame, setup: DataFrame) -> DataFrame:
    """Headline figures of each run from its frame series."""
    optional = [
        x for x in (
            F.max_by("wet_area", "frame").alias("area_final") if "wet_area" in series.columns else None,
            F.max("wet_area").alias("area_max") if "wet_area" in series.columns else None,
        ) if x is not None
    ]
    out = series.join(times, FRAME).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.max_by("time_s", "frame").alias("duration_s"),
        F.bool_and("time_known").alias("time_known"),
        F.max("particles").alias("particles_max"), F.min("particles").alias("particles_min"),
        F.sum("particles").alias("particles_total"),
        F.max("reach").alias("reach_max"), F.max_by("reach", "frame").alias("reach_final"),
        F.min("extent").alias("extent_min"), F.max("extent").alias("extent_max"),
        *optional,
    )
    return out.join(setup.select("run_id", "parts_out"), "run_id")


def volume_estimate(series: DataFrame, setup: DataFrame) -> DataFrame:
    """Largest particle count times the particle volume; null without a spacing."""
    top = series.groupBy("run_id").agg(F.max("particles").alias("n"))
    dp = F.col("dp")
    return top.join(setup.select("run_id", "dp"), "run_id").select(
        "run_id", "dp", F.when((dp != 0) & (F.col("n") > 0), F.col("n") * dp * dp * dp).alias("volume")
    )


def frame_offsets(series: DataFrame) -> DataFrame:
    """Byte position and length of each frame in a packed result."""
    before = W.partitionBy("run_id").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    return series.select(
        *FRAME,
        (F.coalesce(F.sum("particles").over(before), F.lit(0)) * BYTES_PER_PARTICLE).alias("offset"),
        (F.col("particles") * BYTES_PER_PARTICLE).alias("length"),
    )


def slice_frame(particles: DataFrame, run_id: int, frame: int) -> DataFrame:
    """Positions and speeds of one frame."""
    return particles.filter((F.col("run_id") == run_id) & (F.col("frame") == frame)).select(
        "x", "y", "z", speed(F.col("vx"), F.col("vy"), F.col("vz")).alias("speed")
    )


def frame_interval(times: DataFrame) -> DataFrame:
    """Mean time between frames; nominal when unknown or not positive."""
    n = F.count(F.lit(1))
    mean = (F.max_by("time_s", "frame") - F.min_by("time_s", "frame")) / (n - 1)
    known = F.bool_and("time_known")
    return times.groupBy("run_id").agg(
        F.when(known & (n > 1) & (mean > 0), mean).otherwise(F.lit(NOMINAL_INTERVAL)).alias("interval_s")
    )


def final_extent_pair(frames: DataFrame) -> DataFrame:
    """Each frame with the last frame of its run, null for the last itself."""
    last = frames.groupBy("run_id").agg(F.max("frame").alias("_last"))
    return frames.join(last, "run_id").select(
        *FRAME, F.when(F.col("frame") != F.col("_last"), F.col("_last")).alias("affected_frame")
    )


def series_arrays(series: DataFrame, times: DataFrame) -> DataFrame:
    """Parallel arrays of each run, one element per frame."""
    rows = series.join(times, FRAME)
    item = F.struct("frame", "time_s", "particles", "speed_max", "extent", "reach")
    packed = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("s"))
    reach = F.col("s.reach")
    return packed.select(
        "run_id", F.col("s.time_s").alias("t"), F.col("s.particles").alias("np"),
        F.col("s.speed_max").alias("speed_max"), F.col("s.extent").alias("extent"),
        F.when(F.exists(reach, lambda r: r.isNotNull()), reach).alias("reach"),
    )


def series_rows(arrays: DataFrame) -> DataFrame:
    """One row per time step from parallel arrays; a missing reach is NaN."""
    nan = F.lit(float("nan"))
    reach = F.coalesce(F.col("reach"), F.transform("t", lambda _: nan))
    zipped = F.arrays_zip(
        F.col("t").alias("t"), F.col("speed_max").alias("speed"), F.col("extent").alias("extent"),
        reach.alias("reach"), F.col("np").alias("np"),
    )
    rows = arrays.select("run_id", F.posexplode(zipped).alias("i", "row")).select("run_id", "i", "row.*")
    return rows.withColumn("reach", F.coalesce("reach", nan))


def snapshot_bbox(particles: DataFrame) -> DataFrame:
    """Count, bounds and presence of a type value in each snapshot."""
    return particles.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("np"),
        *[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))],
        F.bool_or(F.col("type").isNotNull()).alias("has_type"),
    )


def type_warning(snapshots: DataFrame) -> DataFrame:
    """Runs whose snapshots carry no type value at all."""
    return snapshots.groupBy("run_id").agg((~F.bool_or("has_type")).alias("fluid_only_unknown"))


def boundary_proximity(snapshots: DataFrame, domains: DataFrame, margin: float = 0.05) -> DataFrame:
    """Findings of the last snapshot against the domain of its run.

    ``domains`` has one row per run with lo_x .. hi_z (null when unknown),
    flow_axis and upstream_sign. A positive sign tests the far side.
    """
    cols = [f"{c}_{n}" for c in ("x", "y", "z") for n in ("min", "max")]
    last = snapshots.groupBy("run_id").agg(F.max_by(F.struct(*cols), "frame").alias("b")).select("run_id", "b.*")
    rows = domains.join(last, "run_id", "left")

    def low(c: str) -> Column:
        return F.col(f"{c}_min") <= F.col(f"lo_{c}") + margin

    def high(c: str) -> Column:
        return F.col(f"{c}_max") >= F.col(f"hi_{c}") - margin

    ends, sides = [], []
    for axis, side in (("x", "y"), ("y", "x")):
        on = F.col("flow_axis") == axis
        sign = F.col("upstream_sign")
        ends.append(F.when(on & (sign > 0) & high(axis), f"downstream boundary (+{axis.upper()})"))
        ends.append(F.when(on & (sign < 0) & low(axis), f"downstream boundary (-{axis.upper()})"))
        sides.append(F.when(on & (low(side) | high(side)), f"lateral boundary ({side.upper()})"))
    found = problems(
        *ends, *sides,
        F.when(high("z"), "vertical boundary (+Z)"), F.when(low("z"), "vertical boundary (-Z)"),
    )
    unknown = F.lit(False)
    for c in ("x", "y", "z"):
        unknown = unknown | F.col(f"lo_{c}").isNull() | F.col(f"hi_{c}").isNull()
    return rows.select(
        "run_id", F.col("x_min").isNotNull().alias("has_snapshot"),
        F.when(F.col("x_min").isNull(), F.array(F.lit("not enough evidence – no VTK snapshots parsed")))
        .when(unknown, F.array(F.lit("not enough evidence – pointmin / pointmax missing")))
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit("not enough evidence – particles do not appear to be hitting domain bounds")))
        .alias("findings"),
    )


def outflow_verdict(default_domain: Column, drop: Column, has_snapshot: Column, findings: Column) -> Column:
    """The most likely exclusion mechanism."""
    return (
        F.when(default_domain, "simulation-domain bounds (fix 'default' first)")
        .when(drop & ~has_snapshot, "another exclusion mechanism (immediate drop, no snapshot to inspect)")
        .when(F.size(findings) > 0, joined(findings))
        .otherwise("another exclusion mechanism")
    )


def flood_extents(particles: DataFrame, series: DataFrame) -> DataFrame:
    """Hull ring and area of every frame; empty frames keep the last ring, area 0."""
    rings = convex_hulls(particles.select(*FRAME, "x", "y"), FRAME)
    known = rings.select("run_id", F.col("frame").alias("hull_frame"), "ring", ring_area(F.col("ring")).alias("area"))
    nothing = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    rows = series.join(known, ["run_id", "hull_frame"], "left")
    return rows.withColumn("ring", F.coalesce("ring", nothing)).withColumn(
        "wet_area", F.when(F.col("frame") == F.col("hull_frame"), F.col("area")).otherwise(F.lit(0.0))
    ).drop("area")
