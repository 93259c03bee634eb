"""Dam sites: span, walls, reservoir and their checks, for all dams at once.

A plan row is one dam: dam_id, site_id, dam_x, dam_y, dam_z, flow_axis,
upstream_sign, crest_z, water_z, span_start, span_end. The span runs across the
flow axis; terrain comes as points (site_id, x, y, z).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraflow.operators.points import flat_surface, nearest_sample, upstream_axis, within_radius
from terraflow.operators.quantiles import exact_quantiles
from terraflow.operators.rules import problems
from terraflow.operators.zonal import points_in_boxes, zonal_range, zonal_stats
from terraflow.session import materialize


@dataclass(frozen=True)
class SiteParams:
    """Sizes in model units.

    A wall is cut into parts of about ``segment_length``, ``max_wall_segments``
    of them at most; a longer wall has longer parts.
    """

    particle_spacing: float = 0.10
    search_radius: float = 8.0
    thickness: float = 0.30
    crest_height: float = 0.60
    embedment: float = 0.10
    min_span: float = 2.0
    max_span: float = 12.0
    segment_length: float = 0.50
    max_wall_segments: int = 50
    valley_threshold: float = 0.30
    reservoir_length: float = 3.0
    water_depth: float = 0.50
    freeboard: float = 0.05
    reservoir_segments: int = 6
    bed_clearance: float = 0.02
    clip_to_wet_reach: bool = False

    @property
    def band(self) -> float:
        return 2.0 * self.particle_spacing

    @property
    def wall_margin(self) -> float:
        return max(0.05, 0.25 * self.thickness)

    @property
    def trim_step(self) -> float:
        return max(0.5 * self.segment_length, 2.0 * self.particle_spacing)




def _along_x() -> Column:
    return F.col("flow_axis") == "x"


def _box(along0: Column, along1: Column, across0: Column, across1: Column) -> list[Column]:
    """x0, x1, y0, y1 of a box given along and across the flow axis."""
    on_x = _along_x()
    return [
        F.when(on_x, along0).otherwise(across0).alias("x0"), F.when(on_x, along1).otherwise(across1).alias("x1"),
        F.when(on_x, across0).otherwise(along0).alias("y0"), F.when(on_x, across1).otherwise(along1).alias("y1"),
    ]


def _flow_coord() -> Column:
    return F.when(_along_x(), F.col("dam_x")).otherwise(F.col("dam_y"))


def axis_centre() -> Column:
    """Coordinate of the dam on its own line."""
    return F.when(_along_x(), F.col("dam_y")).otherwise(F.col("dam_x"))


def valley_span(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Span of the valley floor around each dam, relative to the dam.

    Lateral bins between the 5th and the 95th percentile of the samples keep
    their lowest terrain. The span is the run of low bins that holds the dam, or
    the nearest run stretched to it, within the smallest and the largest span.
    """
    pairs = within_radius(plans, points, p.search_radius).select(
        "dam_id", F.when(_along_x(), F.col("dy")).otherwise(F.col("dx")).alias("s"), "z"
    )
    counts = pairs.groupBy("dam_id").agg(F.count(F.lit(1)).alias("n"))
    ends = exact_quantiles(pairs, ["dam_id"], "s", {"p5": 0.05, "p95": 0.95})
    span = F.col("p95") - F.col("p5")
    frame = counts.join(ends, "dam_id").withColumn("span", span).withColumn(
        "bin", F.greatest(F.lit(p.particle_spacing), F.col("span") / 40.0)
    ).withColumn("bins", F.ceil(F.col("span") / F.col("bin") - 1e-9).cast("int"))
    usable = (F.col("n") >= 20) & (F.col("span") >= p.min_span) & (F.col("bins") >= 2)
    i = F.floor((F.col("s") - F.col("p5")) / F.col("bin")).cast("int")
    low = (
        pairs.join(frame.filter(usable), "dam_id").withColumn("i", i).filter("i >= 0 AND i < bins")
        .groupBy("dam_id", "i").agg(F.min("z").alias("z"))
    )
    limits = low.groupBy("dam_id").agg(F.min("z").alias("floor"), F.max("z").alias("top"))
    cutoff = F.col("floor") + F.greatest(F.lit(p.valley_threshold), 0.25 * (F.col("top") - F.col("floor")))
    middle = F.least(
        F.col("bins") - 1, F.greatest(F.lit(0), F.ceil(-F.col("p5") / F.col("bin") - 1.0).cast("int"))
    )
    runs = (
        low.join(limits, "dam_id").filter(F.col("z") <= cutoff)
        .withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("dam_id").orderBy("i")))
        .groupBy("dam_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
        .join(frame.withColumn("mid", middle), "dam_id")
    )

    def centre(k: Column) -> Column:
        return F.abs(F.col("p5") + (k + 0.5) * F.col("bin"))

    holds = (F.col("first") <= F.col("mid")) & (F.col("last") >= F.col("mid"))
    near = F.when(holds, F.lit(-1.0)).otherwise(F.least(centre(F.col("first")), centre(F.col("last"))))
    best = runs.withColumn("near", near).groupBy("dam_id").agg(
        F.min(F.struct("near", "first", "last", "mid", "p5", "bin")).alias("b")
    ).select("dam_id", "b.*")
    lo = F.col("p5") + F.least("first", "mid") * F.col("bin")
    hi = F.col("p5") + (F.greatest("last", "mid") + 1) * F.col("bin")
    found = best.select("dam_id", F.least(F.lit(0.0), lo).alias("lo"), F.greatest(F.lit(0.0), hi).alias("hi"))
    narrow = F.col("hi") - F.col("lo") < p.min_span
    wide = F.col("hi") - F.col("lo") > p.max_span
    half = (
        F.when(F.coalesce("n", F.lit(0)) < 20, F.lit(max(p.min_span / 2, 3 * p.particle_spacing)))
        .when(F.col("span") < p.min_span, F.lit(p.min_span / 2))
        .when(F.col("lo").isNull(), F.greatest(F.lit(p.min_span / 2), F.col("span") / 2))
        .when(narrow, F.lit(p.min_span / 2))
    )
    rows = plans.join(frame.select("dam_id", "n", "span"), "dam_id", "left").join(found, "dam_id", "left")
    rows = rows.withColumn("half", half)
    top = F.lit(p.max_span / 2)
    lo = F.when(F.col("half").isNotNull(), -F.col("half")).when(wide, -top).otherwise(F.col("lo"))
    hi = F.when(F.col("half").isNotNull(), F.col("half")).when(wide, top).otherwise(F.col("hi"))
    return rows.select(*plans.columns, lo.alias("s_min"), hi.alias("s_max"))


def lateral_containment(spans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Spans grown on both sides until the terrain beyond each end holds the water.

    Every growth step is a pair of boxes; the first step where both ends are
    held gives the span.
    """
    limit = p.max_span / 2
    steps = F.ceil((F.lit(limit) - F.least(-F.col("s_min"), F.col("s_max"))) / p.band).cast("int") + 1
    grown = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), steps)))).withColumns(
        {
            "lo": F.when(F.col("k") == 0, F.col("s_min")).otherwise(F.greatest(F.col("s_min") - F.col("k") * p.band, F.lit(-limit))),
            "hi": F.when(F.col("k") == 0, F.col("s_max")).otherwise(F.least(F.col("s_max") + F.col("k") * p.band, F.lit(limit))),
        }
    )
    ends = F.array(
        F.when(F.col("lo") > -limit, F.struct(F.lit(0).alias("side"), (F.col("lo") - p.band).alias("a"), F.col("lo").alias("b"))),
        F.when(F.col("hi") < limit, F.struct(F.lit(1).alias("side"), F.col("hi").alias("a"), (F.col("hi") + p.band).alias("b"))),
    )
    open_ends = grown.withColumn("e", F.explode(F.array_compact(ends)))
    half = p.thickness / 2
    boxes = open_ends.select(
        "dam_id", "site_id", "k", "e.side", "water_z",
        *_box(_flow_coord() - half, _flow_coord() + half, axis_centre() + F.col("e.a"), axis_centre() + F.col("e.b")),
    )
    low = zonal_range(boxes, points, ["dam_id", "k", "side"])
    leak = low.groupBy("dam_id", "k").agg(
        F.bool_or(F.col("cell_min") < F.col("water_z") - 1e-6).alias("leaks")
    )
    held = grown.join(leak, ["dam_id", "k"], "left").filter(~F.coalesce("leaks", F.lit(False)))
    first = held.groupBy("dam_id").agg(F.min(F.struct("k", "lo", "hi")).alias("b"))
    wide = F.col("b.hi") - F.col("b.lo") > p.max_span
    return spans.drop("s_min", "s_max").join(
        first.select(
            "dam_id", F.when(wide, F.lit(-limit)).otherwise(F.col("b.lo")).alias("s_min"),
            F.when(wide, F.lit(limit)).otherwise(F.col("b.hi")).alias("s_max"),
        ),
        "dam_id",
    )


def split_span(plans: DataFrame, count: Column) -> DataFrame:
    """``count`` equal parts of each span as rows with seg, s0, s1."""
    width = F.col("span_end") - F.col("span_start")
    rows = plans.filter("span_end > span_start").withColumn("_n", count)
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    part = width / F.col("_n")
    return rows.withColumns(
        {"s0": F.col("span_start") + F.col("seg") * part, "s1": F.col("span_start") + (F.col("seg") + 1) * part}
    ).drop("_n")


def wall_segments(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Wall parts anchored under the lowest ground of their footprint, one crest."""
    half = p.thickness / 2
    parts = split_span(plans, _part_count(F.col("span_end") - F.col("span_start"), p)).select(
        "dam_id", "site_id", "seg", "crest_z", "dam_z",
        *_box(_flow_coord() - half, _flow_coord() + half, F.col("s0"), F.col("s1")),
    )
    m = p.wall_margin
    wide = parts.select(
        "dam_id", "site_id", "seg", (F.col("x0") - m).alias("x0"), (F.col("x1") + m).alias("x1"),
        (F.col("y0") - m).alias("y0"), (F.col("y1") + m).alias("y1"),
    )
    low = zonal_range(wide, points, ["dam_id", "seg"]).select("dam_id", "seg", "cell_min", "cell_max")
    ground = F.coalesce("cell_min", "dam_z")
    return parts.join(low, ["dam_id", "seg"], "left").select(
        "dam_id", "site_id", "seg", "x0", "x1", "y0", "y1", (ground - p.embedment).alias("z0"), F.col("crest_z").alias("z1"),
        ground.alias("ground_z"), F.col("cell_max").alias("terrain_max"),
    )


def _part_count(width: Column, p: SiteParams) -> Column:
    """Number of wall parts of a span."""
    return F.least(F.lit(p.max_wall_segments), F.greatest(F.lit(1), F.bround(width / max(p.segment_length, 1e-6)).cast("int")))


def _nearest_points(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """For each dam, what lies next to the end of its wall after each number of cuts.

    Array ``near`` of (side, cut, any, low): among the points that stay between
    the ends of the wall's footprint up to this cut and not after the next, how
    far across the axis the one nearest to this end lies, and the nearest one
    low enough to carry a wall. The far side counts in negative coordinates, so
    both are minima. There are at most as many rows as cuts.
    """
    half, m, step = p.thickness / 2, p.wall_margin, p.trim_step
    carried = ["dam_id", "flow_axis", "crest_z", "span_start", "span_end"]
    strip = plans.select(
        "site_id", *carried,
        *_box(_flow_coord() - half - m, _flow_coord() + half + m, F.col("span_start") - m, F.col("span_end") + m),
    )
    across = F.when(_along_x(), F.col("y")).otherwise(F.col("x"))
    held = points_in_boxes(strip, points, carried).filter("z IS NOT NULL").select(
        *carried, across.alias("t"), (F.col("z") - p.embedment < F.col("crest_z") - 1e-9).alias("low")
    )
    # Both ends as lower bounds: the span itself, and its mirror image.
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.col("t").alias("t"), F.col("span_start").alias("end")),
        F.struct(F.lit(1).alias("side"), (-F.col("t")).alias("t"), (-F.col("span_end")).alias("end")),
    )
    rows = held.select("dam_id", "low", F.explode(ends).alias("e")).select("dam_id", "low", "e.*")
    cut = F.floor((F.col("t") + m - F.col("end")) / step)
    rows = rows.withColumn("cut", cut).withColumn(
        "cut",
        F.when(F.col("end") + (F.col("cut") + 1) * step - m <= F.col("t"), F.col("cut") + 1)
        .when(F.col("end") + F.col("cut") * step - m > F.col("t"), F.col("cut") - 1).otherwise(F.col("cut")),
    )
    first = rows.groupBy("dam_id", "side", "cut").agg(F.min("t").alias("any"), F.min(F.when(F.col("low"), F.col("t"))).alias("low"))
    return first.groupBy("dam_id").agg(F.collect_list(F.struct("side", "cut", "any", "low")).alias("near"))


def abutment_trim(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Spans without outermost wall parts whose bottom is at or above the crest.

    One cut at a time, left side first, while the span stays over its least
    width. All cuts of a dam lie in one strip, whose points are reduced to the
    nearest ones behind each cut in a single pass; the cuts are then walked as a
    fold over these. Spans that are null or too narrow stay as they are.
    """
    m, step = p.wall_margin, p.trim_step
    plans = materialize(plans, "trim")
    roomy = F.col("span_end") - F.col("span_start") > p.min_span + step
    near = _nearest_points(plans.filter(roomy), points, p)
    bare = F.coalesce(F.col("dam_z") - p.embedment >= F.col("crest_z") - 1e-9, F.lit(False))

    def inverted(side: int, cuts: Column, far: Column) -> Column:
        """No point up to ``far`` carries a wall; without any, the ground at the dam decides."""
        behind = F.filter("near", lambda n: (n["side"] == side) & (n["cut"] >= cuts))
        some = F.coalesce(F.array_min(F.transform(behind, lambda n: n["any"])) <= far, F.lit(False))
        low = F.coalesce(F.array_min(F.transform(behind, lambda n: n["low"])) <= far, F.lit(False))
        return F.when(some, ~low).otherwise(bare)

    def walk(s: Column, _: Column) -> Column:
        start, end = F.col("span_start") + s["left"] * step, F.col("span_end") - s["right"] * step
        count = _part_count(end - start, p)
        part = (end - start) / count
        going = s["going"] & (end - start > p.min_span + step)
        left = going & inverted(0, s["left"], start + part + m)
        right = going & ~left & inverted(1, s["right"], m - (start + (count - 1) * part))
        return F.struct((s["left"] + left.cast("int")).alias("left"), (s["right"] + right.cast("int")).alias("right"), (left | right).alias("going"))

    most = F.ceil((F.col("span_end") - F.col("span_start") - p.min_span) / step).cast("int")
    still = F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(True).alias("going"))
    cuts = F.when(roomy, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), still, walk))
    rows = plans.join(near, "dam_id", "left").withColumn("cuts", cuts)
    moved = {
        "span_start": F.col("span_start") + F.coalesce("cuts.left", F.lit(0)) * step,
        "span_end": F.col("span_end") - F.coalesce("cuts.right", F.lit(0)) * step,
    }
    return rows.withColumns(moved).select(*plans.columns)


def reservoir_segments(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Water parts upstream of the dam with one water line.

    A part lies over the highest bed of its footprint. It is dropped when less
    than one particle deep; with ``clip_to_wet_reach`` a part over a rising bed
    ends where the bed first comes too close to the water line instead.
    """
    sign = F.col("upstream_sign")
    face = _flow_coord() + sign * (p.thickness / 2) + sign * p.bed_clearance
    far = face + sign * p.reservoir_length
    parts = split_span(plans, F.lit(max(1, p.reservoir_segments)))
    boxes = parts.select(
        "dam_id", "site_id", "seg", "flow_axis", "upstream_sign", "water_z", "dam_z", face.alias("face"), F.col("s0"), F.col("s1"),
        *_box(F.least(face, far), F.greatest(face, far), F.col("s0"), F.col("s1")),
    )
    keys = ["dam_id", "seg"]
    limit = F.col("water_z") - p.bed_clearance - p.particle_spacing
    top = zonal_range(boxes, points, keys).withColumn("bed", F.coalesce("cell_max", "dam_z"))
    if p.clip_to_wet_reach:
        least = max(p.particle_spacing, 1e-3)
        dry = top.filter(F.col("bed") > limit + 1e-9).select(*keys, "site_id", "flow_axis", "face", "x0", "x1", "y0", "y1", limit.alias("lim"))
        at = F.abs(F.when(_along_x(), F.col("x")).otherwise(F.col("y")) - F.col("face"))
        pairs = points_in_boxes(dry, points, keys).drop("site_id").join(dry.select(*keys, "flow_axis", "face", "lim"), keys).withColumn("t", at)
        high = F.col("z") > F.col("lim") + 1e-9
        stop = pairs.groupBy(*keys).agg(
            F.min(F.when(high, F.col("t"))).alias("reach"), F.min("t").alias("nearest")
        )
        wet = stop.filter((F.col("nearest") <= least) & (F.col("reach") > least)).select(*keys, "reach")
        bed = pairs.join(wet, keys).filter(F.col("t") < F.col("reach")).groupBy(*keys, "reach").agg(F.max("z").alias("wet_bed"))
        top = top.join(bed, keys, "left").filter((F.col("bed") <= limit + 1e-9) | F.col("reach").isNotNull()).withColumns(
            {"bed": F.coalesce("wet_bed", "bed"), "cell_max": F.coalesce("wet_bed", "cell_max"),
             "reach": F.coalesce("reach", F.lit(p.reservoir_length))}
        )
    else:
        top = top.withColumn("reach", F.lit(p.reservoir_length))
    end = F.col("face") + F.col("upstream_sign") * F.col("reach")
    z0 = F.col("bed") + p.bed_clearance
    return top.filter(F.col("water_z") - z0 >= p.particle_spacing - 1e-9).select(
        "dam_id", "site_id", "seg", *_box(F.least("face", end), F.greatest("face", end), F.col("s0"), F.col("s1")),
        z0.alias("z0"), F.col("water_z").alias("z1"), F.col("bed").alias("ground_z"), F.col("cell_max").alias("terrain_max"),
        (F.col("water_z") - z0).alias("depth"), "reach",
    )


def face_gap(p: SiteParams) -> Column:
    """Distance from the upstream dam face to the near side of a water part."""
    sign = F.col("upstream_sign")
    face = _flow_coord() + sign * (p.thickness / 2)
    near = F.when(_along_x(), F.when(sign > 0, F.col("x0")).otherwise(F.col("x1"))).otherwise(
        F.when(sign > 0, F.col("y0")).otherwise(F.col("y1"))
    )
    return (near - face) * sign


def segment_checks(walls: DataFrame, water: DataFrame, plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Wall and water parts against the terrain under them."""
    m = p.wall_margin
    shape = ["dam_id", "site_id", "seg", "x0", "x1", "y0", "y1", "z0", "z1"]
    both = materialize(
        walls.select(F.lit("dam").alias("kind"), *shape).unionByName(water.select(F.lit("water").alias("kind"), *shape)), "parts"
    )
    grow = F.when(F.col("kind") == "dam", F.lit(m)).otherwise(F.lit(0.0))
    keys = ["dam_id", "kind", "seg"]
    foot = both.select(
        "site_id", *keys, (F.col("x0") - grow).alias("x0"), (F.col("x1") + grow).alias("x1"),
        (F.col("y0") - grow).alias("y0"), (F.col("y1") + grow).alias("y1"),
    )
    stats = zonal_stats(foot, points, keys).select(*keys, "cell_min", "cell_median", "cell_max")
    at = plans.select("dam_id", "dam_x", "dam_y", "flow_axis", "upstream_sign")
    rows = both.join(stats, keys, "left").join(at, "dam_id")
    dam, water_part = F.col("kind") == "dam", F.col("kind") == "water"

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    return rows.select(
        *keys, "z0", "z1", "cell_min", "cell_median", "cell_max",
        F.when(water_part, face_gap(p)).alias("gap"),
        F.when(water_part, F.col("z0") - F.col("cell_max")).alias("clearance_above_max"),
        F.when(water_part, F.col("z0") - F.col("cell_min")).alias("clearance_above_min"),
        F.when(water_part, flag(F.col("cell_max") > F.col("z0") + 1e-3)).alias("overlaps_terrain"),
        F.when(dam, F.col("z0") - F.col("cell_median")).alias("bottom_minus_median"),
        F.when(dam, F.col("z1") - F.col("cell_max")).alias("crest_minus_max"),
        F.when(dam, flag(F.col("z0") <= F.col("cell_median") + 1e-3)).alias("bottom_below_median"),
        F.when(dam, flag(F.col("z1") >= F.col("cell_max") - 1e-3)).alias("crest_above_max"),
    )


def site_warnings(checks: DataFrame, p: SiteParams) -> DataFrame:
    """Warning texts of each dam from its part checks."""
    dam, water = F.col("kind") == "dam", F.col("kind") == "water"

    def spread(c: Column) -> Column:
        return F.max(c) - F.min(c)

    agg = checks.groupBy("dam_id").agg(
        spread(F.when(dam, F.col("z1"))).alias("crest"), spread(F.when(water, F.col("z1"))).alias("line"),
        F.min(F.when(water, F.col("z1") - F.col("z0"))).alias("depth"), F.min("gap").alias("gap0"), F.max("gap").alias("gap1"),
        F.bool_or("overlaps_terrain").alias("overlap"), F.max("clearance_above_min").alias("float"),
        F.bool_and("crest_above_max").alias("above"), F.bool_and("bottom_below_median").alias("anchored"),
    )
    texts = problems(
        F.when(F.col("crest") > 1e-6, "Dam crest is not common"),
        F.when(F.col("line") > 1e-6, "Reservoir water surface is not common"),
        F.when(F.col("depth") <= 0, "Minimum reservoir water depth is non-positive"),
        F.when(F.col("gap0") < -1e-3, "Reservoir overlaps upstream dam face"),
        F.when(F.col("gap1") > p.bed_clearance + 1e-3, "Reservoir is detached from upstream dam face"),
        F.when(F.col("overlap"), "One or more reservoir segments overlap sampled terrain."),
        F.when(F.col("float") > 0.25, "Reservoir bottom floats above the lowest local terrain"),
        F.when(~F.col("above"), "One or more dam segments have a crest below the sampled local terrain maximum."),
        F.when(~F.col("anchored"), "One or more dam segments are not anchored below the sampled local terrain median."),
    )
    return agg.select("dam_id", texts.alias("warnings"))


def validation_rules(
    plans: DataFrame, walls: DataFrame, water: DataFrame, points: DataFrame, flat: DataFrame, p: SiteParams
) -> DataFrame:
    """One row per rule and dam: dam_id, ordinal, ok, message.

    ``flat`` comes from :func:`flat_surface`; it explains ends that cannot hold
    the water and adds a failed rule only then. The part tables are small (a
    dam has at most 50 wall parts) and are used by several rules, so they are
    written once.
    """
    walls, water = materialize(walls, "walls"), materialize(water, "water")

    def rule(base: int, ok: Column, message: Column | str, seg: Column | None = None) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        place = F.lit(base) if seg is None else F.lit(base) + seg
        return F.struct(place.cast("int").alias("ordinal"), F.coalesce(ok, F.lit(False)).alias("ok"), text.alias("message"))

    def rows(df: DataFrame, *rules: Column) -> DataFrame:
        return df.select("dam_id", F.explode(F.array_compact(F.array(*rules))).alias("r")).select("dam_id", "r.*")

    def numbered(head: str, tail: str) -> Column:
        return F.concat(F.lit(head), F.col("seg").cast("string"), F.lit(tail))

    w = walls.groupBy("dam_id").agg(F.count(F.lit(1)).alias("walls"), F.min("z1").alias("c0"), F.max("z1").alias("c1"))
    f = water.groupBy("dam_id").agg(F.count(F.lit(1)).alias("parts"), F.min("z1").alias("l0"), F.max("z1").alias("l1"))
    whole = plans.join(w, "dam_id", "left").join(f, "dam_id", "left")
    has_wall, has_water = F.col("walls") > 0, F.col("parts") > 0

    def within(a: str, b: str, line: str) -> Column:
        return (F.abs(F.col(a) - F.col(line)) <= 1e-6) & (F.abs(F.col(b) - F.col(line)) <= 1e-6)

    general = rows(
        whole,
        rule(0, F.lit(p.bed_clearance > p.particle_spacing), "bed clearance must exceed particle spacing"),
        rule(1, has_wall, "Dam wall has at least one wall segment"),
        F.when(has_wall, rule(2, F.col("c1") - F.col("c0") <= 1e-6, "All dam crests identical")),
        F.when(has_wall, rule(3, within("c0", "c1", "crest_z"), "All dam crests equal the crest level")),
        rule(2000, has_water, "Reservoir has at least one fluid segment"),
        F.when(has_water, rule(2001, F.col("l1") - F.col("l0") <= 1e-6, "All water surfaces identical")),
        F.when(has_water, rule(2002, within("l0", "l1", "water_z"), "All water surfaces equal the water line")),
        rule(9000, F.col("water_z") < F.col("crest_z") - 1e-6, "Water surface stays below dam crest"),
    )
    seg = F.col("seg")
    wall_rules = rows(
        walls,
        rule(1000, F.col("z0") < F.col("z1"), numbered("Dam segment ", " bottom is below crest"), seg * 2),
        rule(1001, F.col("z0") <= F.col("ground_z") + 1e-3, numbered("Dam segment ", " is anchored at or below local terrain"), seg * 2),
    )
    at = plans.select("dam_id", "dam_x", "dam_y", "flow_axis", "upstream_sign")
    gap = face_gap(p)
    water_rules = rows(
        water.join(at, "dam_id"),
        rule(3000, F.col("depth") > 1e-6, numbered("Reservoir segment ", " has positive water depth"), seg * 4),
        rule(3001, gap.between(-1e-3, p.bed_clearance + 1e-3), numbered("Reservoir segment ", " is immediately upstream of dam face"), seg * 4),
        rule(3002, gap >= p.particle_spacing - 1e-3, numbered("Reservoir segment ", " face gap is at least one spacing"), seg * 4),
        F.when(
            F.col("terrain_max").isNotNull(),
            rule(3003, F.col("z0") >= F.col("terrain_max") + p.bed_clearance - 1e-3,
                 numbered("Reservoir segment ", " does not overlap local terrain"), seg * 4),
        ),
    )
    half = p.thickness / 2
    ends = plans.filter("span_end > span_start").withColumn(
        "e",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), (F.col("span_start") - p.band).alias("a"), F.col("span_start").alias("b")),
                F.struct(F.lit(1).alias("side"), F.col("span_end").alias("a"), (F.col("span_end") + p.band).alias("b")),
            )
        ),
    ).select(
        "dam_id", "site_id", "e.side", "water_z",
        *_box(_flow_coord() - half, _flow_coord() + half, F.col("e.a"), F.col("e.b")),
    )
    held = zonal_range(ends, points, ["dam_id", "side"]).filter("cell_min IS NOT NULL").withColumn(
        "ok", F.col("cell_min") >= F.col("water_z") - 1e-3
    )
    end_rules = rows(
        held,
        rule(9001, F.col("ok"), F.when(F.col("side") == 0, "Dam low end terrain reaches water surface").otherwise(
            "Dam high end terrain reaches water surface"), F.col("side")),
    )
    failed = held.filter(~F.col("ok")).select("dam_id").distinct()
    plane = flat.filter("is_flat_water_plane AND plane_z IS NOT NULL").select("dam_id", "plane_z")
    flat_rules = rows(
        plans.join(failed, "dam_id", "left_semi").join(plane, "dam_id").filter(F.col("water_z") > F.col("plane_z") + 1e-6),
        rule(9003, F.lit(False), "Dam anchor sits on a broad flat surface"),
    )
    return general.unionByName(wall_rules).unionByName(water_rules).unionByName(end_rules).unionByName(flat_rules)


def design_sites(sites: DataFrame, points: DataFrame, p: SiteParams, forced: tuple[str, float] | None = None) -> DataFrame:
    """Plans of all dams (dam_id, site_id, dam_x, dam_y) from terrain alone.

    ``forced`` sets flow axis and upstream sign instead of estimating them.
    """
    if forced is not None and (forced[0] not in ("x", "y") or forced[1] not in (1, -1)):
        raise ValueError("forced axis must be 'x' or 'y' and its sign +1 or -1")
    near = nearest_sample(sites, points, max(p.particle_spacing, 0.25), "pt_id")
    reach = max(p.particle_spacing, 0.25)
    centre = near.select(
        "dam_id", "site_id", *[(F.col(f"dam_{c}") + s * reach).alias(f"{c}{i}") for c in "xy" for i, s in enumerate((-1, 1))]
    )
    median = zonal_stats(centre, points, ["dam_id"]).select("dam_id", "cell_median")
    base = near.join(median, "dam_id").withColumn("dam_z", F.coalesce("cell_median", "dam_z")).select(
        "dam_id", "site_id", "dam_x", "dam_y", "dam_z"
    )
    if forced is None:
        base = upstream_axis(base, points, p.search_radius).drop("method")
    else:
        base = base.withColumns({"flow_axis": F.lit(forced[0]), "upstream_sign": F.lit(float(forced[1]))})
    base = materialize(base, "sites")
    sign = F.col("upstream_sign")
    face = _flow_coord() + sign * (p.thickness / 2)
    far = face + sign * p.reservoir_length
    corridor = base.select(
        "dam_id", "site_id",
        *_box(F.least(face, far), F.greatest(face, far), axis_centre() - p.min_span / 2, axis_centre() + p.min_span / 2),
    )
    floor = zonal_range(corridor, points, ["dam_id"]).select("dam_id", "cell_min")
    crest = F.col("dam_z") + p.crest_height
    plans = base.join(floor, "dam_id").withColumns(
        {"crest_z": crest, "water_z": F.least(F.coalesce("cell_min", "dam_z") + p.water_depth, crest - p.freeboard)}
    ).drop("cell_min")
    spans = materialize(valley_span(plans, points, p), "spans")
    held = lateral_containment(spans, points, p)
    plans = held.withColumns(
        {"span_start": axis_centre() + F.col("s_min"), "span_end": axis_centre() + F.col("s_max")}
    ).drop("s_min", "s_max")
    return abutment_trim(plans, points, p)


def plane_tolerance(p: SiteParams) -> float:
    """Vertical band of the flat-plane test."""
    return max(0.05, 0.5 * p.particle_spacing)


def flat_planes(plans: DataFrame, points: DataFrame, p: SiteParams) -> DataFrame:
    """Flat-plane test of each plan around its dam elevation."""
    return flat_surface(plans.withColumn("plane_z", F.col("dam_z")), points, p.search_radius, plane_tolerance(p))
