"""Site design on analytic terrain: a valley, a rising bed, a plane."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from terraflow.operators import rules, site

BASE = site.SiteParams(
    particle_spacing=0.1, search_radius=6.0, thickness=0.5, crest_height=0.8, valley_threshold=1.5, water_depth=0.66, bed_clearance=0.16,
    reservoir_segments=12,
)


def valley(spark, floor_slope=0.0, wall_slope=2.0):
    """Channel of half width 1 around y = 10; the bed rises for x < 10."""
    x, y = np.meshgrid(np.arange(4, 16.05, 0.1), np.arange(4, 16.05, 0.1))
    x, y = x.ravel().round(6), y.ravel().round(6)
    z = np.maximum(0, 10 - x) * floor_slope + np.maximum(0, np.abs(y - 10) - 1) * wall_slope
    pts = spark.createDataFrame(pd.DataFrame({"site_id": 1, "pt_id": range(len(x)), "x": x, "y": y, "z": z})).cache()
    dams = spark.createDataFrame([(7, 1, 10.0, 10.0)], "dam_id long, site_id long, dam_x double, dam_y double")
    return dams, pts


def judge(spark, p, **slopes):
    dams, pts = valley(spark, **slopes)
    plans = site.design_sites(dams, pts, p, forced=("x", -1)).cache()
    walls, water = site.wall_segments(plans, pts, p), site.reservoir_segments(plans, pts, p)
    flat = site.flat_planes(plans, pts, p)
    out = rules.rule_summary(site.validation_rules(plans, walls, water, pts, flat, p), "dam_id").first()
    return plans.first(), out, water.collect(), flat.first()


def test_valley_passes(spark):
    plan, out, water, flat = judge(spark, BASE)
    assert out.status == "pass", out.errors
    assert len(water) > 0 and not flat.is_flat_water_plane
    assert plan.span_start < 10 < plan.span_end and plan.span_end - plan.span_start <= BASE.max_span
    assert plan.water_z == pytest.approx(0.66) and plan.crest_z == pytest.approx(0.8)
    # The terrain beyond both ends stands above the water.
    assert (10 - plan.span_start - 1) * 2.0 >= 0.3


def test_rising_bed_needs_clipping(spark):
    _, off, none, _ = judge(spark, BASE, floor_slope=0.3)
    assert none == [] and off.status == "fail"
    _, on, water, _ = judge(spark, replace(BASE, clip_to_wet_reach=True), floor_slope=0.3)
    assert water and all(0 < w.reach < BASE.reservoir_length for w in water)
    assert not any("Reservoir" in e for e in on.errors)


def test_plane_fails_with_reason(spark):
    _, out, _, flat = judge(spark, BASE, wall_slope=0.0)
    assert out.status == "fail" and flat.is_flat_water_plane and flat.flat_fraction == 1.0
    assert any("flat surface" in e for e in out.errors)


@pytest.mark.parametrize("forced", [("z", 1), ("x", 2)])
def test_forced_axis_is_checked(spark, forced):
    dams, pts = valley(spark)
    with pytest.raises(ValueError):
        site.design_sites(dams, pts, BASE, forced=forced)


def test_trim_drops_abutments(spark):
    dams, pts = valley(spark)
    plan = dams.selectExpr(
        "*", "0D AS dam_z", "'x' AS flow_axis", "-1D AS upstream_sign", "0.8D AS crest_z", "0.6D AS water_z",
        "7D AS span_start", "12.5D AS span_end",
    )
    got = site.abutment_trim(plan, pts, BASE).first()
    start, end = 7.0, 12.5
    while end - start > BASE.min_span + BASE.trim_step:
        n = max(1, round((end - start) / BASE.segment_length))
        part = (end - start) / n
        m = BASE.wall_margin

        def inverted(a, b):
            ys = np.arange(4, 16.05, 0.1).round(6)
            ys = ys[(ys >= a - m) & (ys <= b + m)]
            return (np.maximum(0, np.abs(ys - 10) - 1) * 2).min() - BASE.embedment >= 0.8 - 1e-9

        if inverted(start, start + part):
            start += BASE.trim_step
        elif inverted(end - part, end):
            end -= BASE.trim_step
        else:
            break
    assert (got.span_start, got.span_end) == pytest.approx((start, end))
    assert start > 7.0 and end < 12.5


def test_trim_walks_like_a_plain_loop(spark):
    """Random ground with gaps, both axes, dams with high and low ground of their own, narrow and unknown spans."""
    rng = np.random.default_rng(3)
    p = replace(BASE, min_span=1.0, max_wall_segments=6)
    plans, points = [], []
    for dam in range(60):
        axis = "xy"[dam % 2]
        start, end = 20 + rng.uniform(-6, 0), 20 + rng.uniform(0.2, 6)
        plans.append((dam, dam // 2, 20.0, 20.0, float(rng.choice([-1.0, 3.0])), axis, 1.0, 0.8, 0.6, start, end))
        t = rng.uniform(12, 28, 60)
        t = t[(t < 16) | (t > 17)]
        z = np.where(np.abs(t - 20) < rng.uniform(0.5, 4), 0.0, rng.choice([0.5, 2.0], len(t), p=[0.1, 0.9]))
        along = 20 + rng.uniform(-0.4, 0.4, len(t))
        points += [(dam // 2, *((a, b) if axis == "x" else (b, a)), h) for a, b, h in zip(along.tolist(), t.tolist(), z.tolist(), strict=True)]
    plans.append((99, 99, 0.0, 0.0, 0.0, "x", 1.0, 0.8, 0.6, None, None))
    names = "dam_id long, site_id int, dam_x double, dam_y double, dam_z double, flow_axis string, upstream_sign double, crest_z double, water_z double, span_start double, span_end double"
    frame = spark.createDataFrame(plans, names)
    got = {r.dam_id: (r.span_start, r.span_end) for r in site.abutment_trim(frame, spark.createDataFrame(points, "site_id int, x double, y double, z double"), p).collect()}
    assert got.pop(99) == (None, None)
    m, half, trimmed = p.wall_margin, p.thickness / 2, 0
    for dam, owner, _, _, dam_z, axis, _, crest, _, first, last in plans[:-1]:
        own = np.array([q[1:] if axis == "x" else (q[2], q[1], q[3]) for q in points if q[0] == owner])
        own = own[np.abs(own[:, 0] - 20) <= half + m]
        start, end = first, last

        def inverted(a, b):
            z = own[(own[:, 1] >= a - m) & (own[:, 1] <= b + m), 2]
            return (z.min() if len(z) else dam_z) - p.embedment >= crest - 1e-9

        while end - start > p.min_span + p.trim_step:
            n = min(p.max_wall_segments, max(1, round((end - start) / p.segment_length)))
            part = (end - start) / n
            if inverted(start, start + part):
                start += p.trim_step
            elif inverted(end - part, end):
                end -= p.trim_step
            else:
                break
        trimmed += (start > first) + (end < last)
        assert got[dam] == pytest.approx((start, end)), dam
    assert trimmed > 20
