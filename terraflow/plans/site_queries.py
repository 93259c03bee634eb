"""Dam site queries: spans, walls, reservoirs, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions.scalars import rounded
from terraflow.operators import rules as L
from terraflow.operators import site as D
from terraflow.plans import sqltext as T
from terraflow.plans.registry import query
from terraflow.session import once
from terraflow.sources.views import view

R = T.r
P = D.SiteParams(
    particle_spacing=0.15, thickness=0.5, valley_threshold=0.05, bed_clearance=0.25, max_span=11.0
)
WET = D.SiteParams(
    particle_spacing=0.15, thickness=0.5, valley_threshold=0.05, bed_clearance=0.25, max_span=11.0, clip_to_wet_reach=True
)


def _points(spark, sf):
    """The terrain as points, written once, as the checks of a site read it several times."""
    return once(spark, "terrain", sf, lambda: view(spark, sf, "terrain_points").select("site_id", "x", "y", "z"))


def _round(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, rounded(F.col(n), digits))
    return df


_SPAN = """pr AS (SELECT dam_id, CASE flow_axis WHEN 'x' THEN y - dam_y ELSE x - dam_x END AS s, t.z FROM site_plans p JOIN terrain_points t
  ON t.site_id = p.site_id AND sqrt((x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y)) <= 8),
f0 AS (SELECT dam_id, count(*) AS n, quantile_cont(s, 0.05) AS p5, quantile_cont(s, 0.95) AS p95 FROM pr GROUP BY dam_id),
fr AS (SELECT *, p95 - p5 AS span, greatest(0.15::DOUBLE, (p95 - p5) / 40) AS bin, CAST(ceil((p95 - p5) / greatest(0.15::DOUBLE, (p95 - p5) / 40) - 1e-9) AS INT) AS bins FROM f0),
lo AS (SELECT pr.dam_id, CAST(floor((s - p5) / bin) AS INT) AS i, min(z) AS z FROM pr JOIN fr ON fr.dam_id = pr.dam_id
  WHERE n >= 20 AND span >= 2 AND bins >= 2 AND floor((s - p5) / bin) >= 0 AND floor((s - p5) / bin) < bins GROUP BY 1, 2),
lm AS (SELECT *, min(z) OVER (PARTITION BY dam_id) AS fl, max(z) OVER (PARTITION BY dam_id) AS tp FROM lo),
rn AS (SELECT dam_id, i, i - row_number() OVER (PARTITION BY dam_id ORDER BY i) AS g FROM lm WHERE z <= fl + greatest(0.05::DOUBLE, 0.25::DOUBLE * (tp - fl))),
il AS (SELECT rn.dam_id, g, min(i) AS a, max(i) AS b FROM rn GROUP BY rn.dam_id, g),
im AS (SELECT il.*, p5, bin, least(bins - 1, greatest(0, CAST(ceil(-p5 / bin - 1.0) AS INT))) AS mid FROM il JOIN fr ON fr.dam_id = il.dam_id),
bs AS (SELECT *, row_number() OVER (PARTITION BY dam_id ORDER BY CASE WHEN a <= mid AND b >= mid THEN -1 ELSE
   least(abs(p5 + (a + 0.5::DOUBLE) * bin), abs(p5 + (b + 0.5::DOUBLE) * bin)) END, a) AS k FROM im),
fd AS (SELECT dam_id, least(0::DOUBLE, p5 + least(a, mid) * bin) AS l, greatest(0::DOUBLE, p5 + (greatest(b, mid) + 1) * bin) AS h FROM bs WHERE k = 1),
sp AS (SELECT p.dam_id, CASE WHEN coalesce(n, 0) < 20 THEN 1 WHEN span < 2 THEN 1 WHEN l IS NULL THEN greatest(1, span / 2) WHEN h - l < 2 THEN 1 END AS half, l, h
  FROM site_plans p LEFT JOIN fr ON fr.dam_id = p.dam_id LEFT JOIN fd ON fd.dam_id = p.dam_id),
vs AS (SELECT dam_id, CASE WHEN half IS NOT NULL THEN -half WHEN h - l > 11 THEN -5.5 ELSE l END AS s_min,
  CASE WHEN half IS NOT NULL THEN half WHEN h - l > 11 THEN 5.5 ELSE h END AS s_max FROM sp)"""


@query("valley_span", f"WITH {_SPAN} SELECT dam_id, {R('s_min')} AS s_min, {R('s_max')} AS s_max FROM vs")
def valley_span(spark, sf):
    v = D.valley_span(view(spark, sf, "site_plans"), view(spark, sf, "terrain_points"), P)
    return _round(v.select("dam_id", "s_min", "s_max"), "s_min", "s_max")


@query("lateral_containment", f"""WITH b AS (SELECT dam_id, site_id, dam_x, dam_y, flow_axis, dam_z + 0.05::DOUBLE AS water_z, -1.0::DOUBLE AS a, 1.0::DOUBLE AS c FROM site_plans),
g AS (SELECT *, CASE WHEN k = 0 THEN a ELSE greatest(a - k * 0.3::DOUBLE, -5.5::DOUBLE) END AS lo, CASE WHEN k = 0 THEN c ELSE least(c + k * 0.3::DOUBLE, 5.5::DOUBLE) END AS hi
  FROM b CROSS JOIN range(0, 17) AS kk(k)),
e AS (SELECT *, CASE flow_axis WHEN 'x' THEN dam_y ELSE dam_x END AS m FROM g),
m AS (SELECT e.dam_id, e.k, bool_or(t.z < water_z - 1e-6) AS leaks FROM e JOIN terrain_points t ON t.site_id = e.site_id
  AND abs(CASE flow_axis WHEN 'x' THEN t.x - dam_x ELSE t.y - dam_y END) <= 0.25::DOUBLE
  AND ((lo > -5.5 AND (CASE flow_axis WHEN 'x' THEN t.y ELSE t.x END) BETWEEN m + (lo - 0.3::DOUBLE) AND m + lo)
    OR (hi < 5.5 AND (CASE flow_axis WHEN 'x' THEN t.y ELSE t.x END) BETWEEN m + hi AND m + (hi + 0.3::DOUBLE))) GROUP BY e.dam_id, e.k)
SELECT e.dam_id, {R('arg_min(lo, e.k)')} AS s_min, {R('arg_min(hi, e.k)')} AS s_max FROM e LEFT JOIN m ON m.dam_id = e.dam_id AND m.k = e.k
WHERE NOT coalesce(leaks, false) GROUP BY e.dam_id""")
def lateral_containment(spark, sf):
    spans = view(spark, sf, "site_plans").withColumns(
        {"s_min": F.lit(-1.0), "s_max": F.lit(1.0), "water_z": F.col("dam_z") + 0.05}
    )
    c = D.lateral_containment(spans, view(spark, sf, "terrain_points"), P)
    return _round(c.select("dam_id", "s_min", "s_max"), "s_min", "s_max")


_WALLS = """w0 AS (SELECT *, least(50, greatest(1, CAST(round_even((span_end - span_start) / 0.5::DOUBLE, 0) AS INT))) AS n FROM site_plans),
w1 AS (SELECT w0.*, seg, span_start + seg * ((span_end - span_start) / n) AS s0, span_start + (seg + 1) * ((span_end - span_start) / n) AS s1
  FROM w0 CROSS JOIN range(0, 50) AS g(seg) WHERE seg < n),
w2 AS (SELECT *, CASE flow_axis WHEN 'x' THEN dam_x - 0.25 ELSE s0 END AS x0, CASE flow_axis WHEN 'x' THEN dam_x + 0.25 ELSE s1 END AS x1,
  CASE flow_axis WHEN 'x' THEN s0 ELSE dam_y - 0.25 END AS y0, CASE flow_axis WHEN 'x' THEN s1 ELSE dam_y + 0.25 END AS y1 FROM w1),
ws AS (SELECT w2.dam_id, seg, min(t.z) AS cmin, median(t.z) AS cmed, max(t.z) AS cmax FROM w2 JOIN terrain_points t ON t.site_id = w2.site_id
  AND t.x BETWEEN x0 - 0.125::DOUBLE AND x1 + 0.125::DOUBLE AND t.y BETWEEN y0 - 0.125::DOUBLE AND y1 + 0.125::DOUBLE GROUP BY 1, 2),
wl AS (SELECT w2.dam_id, w2.site_id, w2.seg, x0, x1, y0, y1, coalesce(cmin, dam_z) - 0.1::DOUBLE AS z0, crest_z AS z1, coalesce(cmin, dam_z) AS ground_z,
  cmax AS terrain_max, cmin, cmed FROM w2 LEFT JOIN ws ON ws.dam_id = w2.dam_id AND ws.seg = w2.seg)"""


def _walls(spark, sf):
    return D.wall_segments(view(spark, sf, "site_plans"), _points(spark, sf), P)


_SHAPE = ("x0", "x1", "y0", "y1", "z0", "z1", "ground_z", "terrain_max")


@query("wall_ground", f"WITH {_WALLS} SELECT dam_id, site_id, seg, {', '.join(f'{R(c)} AS {c}' for c in _SHAPE)} FROM wl")
def wall_ground(spark, sf):
    return _round(_walls(spark, sf), *_SHAPE)


def _lowest(s0: str, s1: str) -> str:
    """Lowest ground under a wall part with its margin."""
    return f"""(SELECT min(t.z) FROM terrain_points t WHERE t.site_id = n.site_id
    AND t.x BETWEEN CASE n.flow_axis WHEN 'x' THEN n.dam_x - 0.25 ELSE {s0} END - 0.125::DOUBLE AND CASE n.flow_axis WHEN 'x' THEN n.dam_x + 0.25 ELSE {s1} END + 0.125::DOUBLE
    AND t.y BETWEEN CASE n.flow_axis WHEN 'x' THEN {s0} ELSE n.dam_y - 0.25 END - 0.125::DOUBLE AND CASE n.flow_axis WHEN 'x' THEN {s1} ELSE n.dam_y + 0.25 END + 0.125::DOUBLE)"""


# One step per row: the left end moves in while its part lies too high, else the right end.
_TRIM = f"""tr AS (SELECT dam_id, site_id, flow_axis, dam_x, dam_y, dam_z, crest_z, span_start, span_end, true AS moved FROM site_plans
 UNION ALL SELECT dam_id, site_id, flow_axis, dam_x, dam_y, dam_z, crest_z, CASE WHEN l THEN span_start + {P.trim_step!r}::DOUBLE ELSE span_start END,
  CASE WHEN r AND NOT l THEN span_end - {P.trim_step!r}::DOUBLE ELSE span_end END, l OR r
 FROM (SELECT n.*, roomy AND coalesce({_lowest('span_start', 'span_start + part')}, dam_z) - 0.1::DOUBLE >= crest_z - 1e-9 AS l,
   roomy AND coalesce({_lowest('span_start + (parts - 1) * part', 'span_start + parts * part')}, dam_z) - 0.1::DOUBLE >= crest_z - 1e-9 AS r
   FROM (SELECT *, (span_end - span_start) / parts AS part, span_end - span_start > 2.0::DOUBLE + {P.trim_step!r}::DOUBLE AS roomy
     FROM (SELECT *, least(50, greatest(1, CAST(round_even((span_end - span_start) / 0.5::DOUBLE, 0) AS INT))) AS parts FROM tr WHERE moved) m) n) k)"""


@query("abutment_trim", f"WITH {_TRIM} SELECT dam_id, {R('span_start')} AS span_start, {R('span_end')} AS span_end FROM tr WHERE NOT moved", recursive=True)
def abutment_trim(spark, sf):
    t = D.abutment_trim(view(spark, sf, "site_plans"), view(spark, sf, "terrain_points"), P)
    return _round(t.select("dam_id", "span_start", "span_end"), "span_start", "span_end")


_WATER = """r0 AS (SELECT *, CASE flow_axis WHEN 'x' THEN dam_x ELSE dam_y END + upstream_sign * 0.25::DOUBLE + upstream_sign * 0.25::DOUBLE AS face FROM site_plans),
r1 AS (SELECT r0.*, seg, span_start + seg * ((span_end - span_start) / 6) AS s0, span_start + (seg + 1) * ((span_end - span_start) / 6) AS s1,
  face + upstream_sign * 3.0::DOUBLE AS far, water_z - 0.25::DOUBLE - 0.15::DOUBLE AS lim FROM r0 CROSS JOIN range(0, 6) AS g(seg)),
pt AS (SELECT r1.dam_id, seg, t.z, abs(CASE flow_axis WHEN 'x' THEN t.x ELSE t.y END - face) AS t, lim FROM r1 JOIN terrain_points t ON t.site_id = r1.site_id
  AND CASE flow_axis WHEN 'x' THEN t.x ELSE t.y END BETWEEN least(face, far) AND greatest(face, far)
  AND CASE flow_axis WHEN 'x' THEN t.y ELSE t.x END BETWEEN s0 AND s1),
bd AS (SELECT dam_id, seg, max(z) AS cmax, min(z) AS cmin, median(z) AS cmed, min(CASE WHEN z > lim + 1e-9 THEN t END) AS stop, min(t) AS near FROM pt GROUP BY 1, 2),
wb AS (SELECT pt.dam_id, pt.seg, max(z) AS wbed FROM pt JOIN bd ON bd.dam_id = pt.dam_id AND bd.seg = pt.seg WHERE t < stop GROUP BY 1, 2),
r2 AS (SELECT r1.*, coalesce(cmax, dam_z) AS bed, cmax, cmin, cmed, stop, near, wbed FROM r1 LEFT JOIN bd ON bd.dam_id = r1.dam_id AND bd.seg = r1.seg
  LEFT JOIN wb ON wb.dam_id = r1.dam_id AND wb.seg = r1.seg),
dry AS (SELECT *, bed AS ground_z, cmax AS terrain_max, 3.0::DOUBLE AS reach FROM r2),
wet AS (SELECT *, CASE WHEN bed <= lim + 1e-9 THEN bed ELSE wbed END AS ground_z, CASE WHEN bed <= lim + 1e-9 THEN cmax ELSE wbed END AS terrain_max,
  CASE WHEN bed <= lim + 1e-9 THEN 3.0::DOUBLE ELSE stop END AS reach FROM r2 WHERE bed <= lim + 1e-9 OR (near <= 0.15 AND stop > 0.15))"""


def _water_rows(src: str) -> str:
    return f"""{src}_rs AS (SELECT dam_id, site_id, seg, CASE flow_axis WHEN 'x' THEN least(face, face + upstream_sign * reach) ELSE s0 END AS x0,
  CASE flow_axis WHEN 'x' THEN greatest(face, face + upstream_sign * reach) ELSE s1 END AS x1, CASE flow_axis WHEN 'x' THEN s0 ELSE least(face, face + upstream_sign * reach) END AS y0,
  CASE flow_axis WHEN 'x' THEN s1 ELSE greatest(face, face + upstream_sign * reach) END AS y1, ground_z + 0.25::DOUBLE AS z0, water_z AS z1, ground_z, terrain_max,
  water_z - (ground_z + 0.25::DOUBLE) AS depth, reach, cmin, cmed FROM {src} WHERE water_z - (ground_z + 0.25::DOUBLE) >= 0.15::DOUBLE - 1e-9)"""


_WSHAPE = (*_SHAPE, "depth", "reach")
_WCOLS = ", ".join(f"{R(c)} AS {c}" for c in _WSHAPE)


def _water(spark, sf, params=P):
    return D.reservoir_segments(view(spark, sf, "site_plans"), _points(spark, sf), params)


@query("reservoir_fill", f"WITH {_WATER}, {_water_rows('dry')} SELECT dam_id, site_id, seg, {_WCOLS} FROM dry_rs")
def reservoir_fill(spark, sf):
    return _round(_water(spark, sf), *_WSHAPE)


@query("wet_reach", f"WITH {_WATER}, {_water_rows('wet')} SELECT dam_id, site_id, seg, {_WCOLS} FROM wet_rs")
def wet_reach(spark, sf):
    return _round(_water(spark, sf, WET), *_WSHAPE)


_CHECKS = f"""{_WALLS}, {_WATER}, {_water_rows('dry')},
ck AS (SELECT dam_id, 'dam' AS kind, seg, z0, z1, cmin AS cell_min, cmed AS cell_median, terrain_max AS cell_max, CAST(NULL AS DOUBLE) AS gap,
  CAST(NULL AS DOUBLE) AS clearance_above_max, CAST(NULL AS DOUBLE) AS clearance_above_min, CAST(NULL AS BOOLEAN) AS overlaps_terrain, z0 - cmed AS bottom_minus_median,
  z1 - terrain_max AS crest_minus_max, coalesce(z0 <= cmed + 1e-3, false) AS bottom_below_median, coalesce(z1 >= terrain_max - 1e-3, false) AS crest_above_max FROM wl
 UNION ALL SELECT r.dam_id, 'water', seg, z0, z1, cmin, cmed, terrain_max,
  (CASE flow_axis WHEN 'x' THEN CASE WHEN upstream_sign > 0 THEN x0 ELSE x1 END ELSE CASE WHEN upstream_sign > 0 THEN y0 ELSE y1 END END
   - (CASE flow_axis WHEN 'x' THEN dam_x ELSE dam_y END + upstream_sign * 0.25::DOUBLE)) * upstream_sign,
  z0 - terrain_max, z0 - cmin, coalesce(terrain_max > z0 + 1e-3, false), NULL, NULL, NULL, NULL FROM dry_rs r JOIN site_plans p ON p.dam_id = r.dam_id)"""
_CNUM = ("z0", "z1", "cell_min", "cell_median", "cell_max", "gap", "clearance_above_max", "clearance_above_min", "bottom_minus_median", "crest_minus_max")


def _checks(spark, sf):
    return D.segment_checks(
        _walls(spark, sf), _water(spark, sf), view(spark, sf, "site_plans"), _points(spark, sf), P
    )


@query("segment_checks", f"""WITH {_CHECKS} SELECT dam_id, kind, seg, {', '.join(f'{R(c)} AS {c}' for c in _CNUM)}, overlaps_terrain, bottom_below_median,
  crest_above_max FROM ck""")
def segment_checks(spark, sf):
    return _round(_checks(spark, sf), *_CNUM)


@query("site_warnings", f"""WITH {_CHECKS} SELECT dam_id, concat_ws('; ',
  CASE WHEN max(CASE WHEN kind = 'dam' THEN z1 END) - min(CASE WHEN kind = 'dam' THEN z1 END) > 1e-6 THEN 'Dam crest is not common' END,
  CASE WHEN max(CASE WHEN kind = 'water' THEN z1 END) - min(CASE WHEN kind = 'water' THEN z1 END) > 1e-6 THEN 'Reservoir water surface is not common' END,
  CASE WHEN min(CASE WHEN kind = 'water' THEN z1 - z0 END) <= 0 THEN 'Minimum reservoir water depth is non-positive' END,
  CASE WHEN min(gap) < -1e-3 THEN 'Reservoir overlaps upstream dam face' END,
  CASE WHEN max(gap) > 0.25 + 1e-3 THEN 'Reservoir is detached from upstream dam face' END,
  CASE WHEN bool_or(overlaps_terrain) THEN 'One or more reservoir segments overlap sampled terrain.' END,
  CASE WHEN max(clearance_above_min) > 0.25 THEN 'Reservoir bottom floats above the lowest local terrain' END,
  CASE WHEN NOT bool_and(crest_above_max) THEN 'One or more dam segments have a crest below the sampled local terrain maximum.' END,
  CASE WHEN NOT bool_and(bottom_below_median) THEN 'One or more dam segments are not anchored below the sampled local terrain median.' END) AS warnings
FROM ck GROUP BY dam_id""")
def site_warnings(spark, sf):
    w = D.site_warnings(_checks(spark, sf), P)
    return w.withColumn("warnings", L.joined(F.col("warnings")))


@query("site_validation", f"""WITH {_WALLS}, {_WATER}, {_water_rows('dry')},
wa AS (SELECT dam_id, count(*) AS walls, min(z1) AS c0, max(z1) AS c1 FROM wl GROUP BY dam_id),
fa AS (SELECT dam_id, count(*) AS parts, min(z1) AS l0, max(z1) AS l1 FROM dry_rs GROUP BY dam_id),
pl AS (SELECT p.*, walls, c0, c1, parts, l0, l1 FROM site_plans p LEFT JOIN wa ON wa.dam_id = p.dam_id LEFT JOIN fa ON fa.dam_id = p.dam_id),
wg AS (SELECT r.*, (CASE flow_axis WHEN 'x' THEN CASE WHEN upstream_sign > 0 THEN x0 ELSE x1 END ELSE CASE WHEN upstream_sign > 0 THEN y0 ELSE y1 END END
   - (CASE flow_axis WHEN 'x' THEN dam_x ELSE dam_y END + upstream_sign * 0.25::DOUBLE)) * upstream_sign AS gap FROM dry_rs r JOIN site_plans p ON p.dam_id = r.dam_id),
en AS (SELECT p.dam_id, side, min(t.z) AS z, any_value(water_z) AS water_z FROM site_plans p CROSS JOIN (VALUES (0), (1)) AS v(side) JOIN terrain_points t
  ON t.site_id = p.site_id AND abs(CASE flow_axis WHEN 'x' THEN t.x - dam_x ELSE t.y - dam_y END) <= 0.25::DOUBLE
  AND CASE flow_axis WHEN 'x' THEN t.y ELSE t.x END BETWEEN CASE side WHEN 0 THEN span_start - 0.3::DOUBLE ELSE span_end END
  AND CASE side WHEN 0 THEN span_start ELSE span_end + 0.3::DOUBLE END GROUP BY p.dam_id, side),
ft AS (SELECT p.dam_id, p.dam_z, p.water_z, count(*) FILTER (abs(t.z - dam_z) <= 0.075::DOUBLE) / count(*) AS share FROM site_plans p JOIN terrain_points t ON t.site_id = p.site_id
  AND sqrt((x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y)) <= 8 GROUP BY 1, 2, 3),
ru AS (SELECT dam_id, 0 AS o, true AS ok, 'bed clearance must exceed particle spacing' AS m FROM pl
 UNION ALL SELECT dam_id, 1, coalesce(walls > 0, false), 'Dam wall has at least one wall segment' FROM pl
 UNION ALL SELECT dam_id, 2, c1 - c0 <= 1e-6, 'All dam crests identical' FROM pl WHERE walls > 0
 UNION ALL SELECT dam_id, 3, abs(c0 - crest_z) <= 1e-6 AND abs(c1 - crest_z) <= 1e-6, 'All dam crests equal the crest level' FROM pl WHERE walls > 0
 UNION ALL SELECT dam_id, 2000, coalesce(parts > 0, false), 'Reservoir has at least one fluid segment' FROM pl
 UNION ALL SELECT dam_id, 2001, l1 - l0 <= 1e-6, 'All water surfaces identical' FROM pl WHERE parts > 0
 UNION ALL SELECT dam_id, 2002, abs(l0 - water_z) <= 1e-6 AND abs(l1 - water_z) <= 1e-6, 'All water surfaces equal the water line' FROM pl WHERE parts > 0
 UNION ALL SELECT dam_id, 9000, water_z < crest_z - 1e-6, 'Water surface stays below dam crest' FROM pl
 UNION ALL SELECT dam_id, 1000 + 2 * seg, z0 < z1, concat('Dam segment ', CAST(seg AS VARCHAR), ' bottom is below crest') FROM wl
 UNION ALL SELECT dam_id, 1001 + 2 * seg, z0 <= ground_z + 1e-3, concat('Dam segment ', CAST(seg AS VARCHAR), ' is anchored at or below local terrain') FROM wl
 UNION ALL SELECT dam_id, 3000 + 4 * seg, depth > 1e-6, concat('Reservoir segment ', CAST(seg AS VARCHAR), ' has positive water depth') FROM wg
 UNION ALL SELECT dam_id, 3001 + 4 * seg, gap BETWEEN -1e-3 AND 0.251, concat('Reservoir segment ', CAST(seg AS VARCHAR), ' is immediately upstream of dam face') FROM wg
 UNION ALL SELECT dam_id, 3002 + 4 * seg, gap >= 0.149, concat('Reservoir segment ', CAST(seg AS VARCHAR), ' face gap is at least one spacing') FROM wg
 UNION ALL SELECT dam_id, 3003 + 4 * seg, z0 >= terrain_max + 0.249, concat('Reservoir segment ', CAST(seg AS VARCHAR), ' does not overlap local terrain') FROM wg WHERE terrain_max IS NOT NULL
 UNION ALL SELECT dam_id, 9001 + side, z >= water_z - 1e-3, CASE side WHEN 0 THEN 'Dam low end terrain reaches water surface' ELSE 'Dam high end terrain reaches water surface' END FROM en
 UNION ALL SELECT dam_id, 9003, false, 'Dam anchor sits on a broad flat surface' FROM ft WHERE share >= 0.35 AND water_z > dam_z + 1e-6
   AND dam_id IN (SELECT dam_id FROM en WHERE NOT (z >= water_z - 1e-3)))
SELECT dam_id, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (ok) AS checks_passed,
  coalesce(string_agg(m, '; ' ORDER BY o) FILTER (NOT ok), '') AS errors FROM ru GROUP BY dam_id""")
def site_validation(spark, sf):
    plans, pts = view(spark, sf, "site_plans"), _points(spark, sf)
    rules = D.validation_rules(plans, _walls(spark, sf), _water(spark, sf), pts, D.flat_planes(plans, pts, P), P)
    return L.rule_summary(rules, "dam_id").withColumn("errors", L.joined(F.col("errors")))
