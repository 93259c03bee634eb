"""Point-cloud, surface and zonal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.functions.scalars import rounded
from terraflow.operators import points as P
from terraflow.operators import surface as S
from terraflow.operators import flow as W
from terraflow.operators import zonal as Z
from terraflow.operators.rules import joined
from terraflow.plans import sqltext as T
from terraflow.plans.flow_queries import _CORRIDOR, corridor
from terraflow.plans.raster_queries import _mean
from terraflow.plans.registry import query
from terraflow.sources.views import view

R = T.r


def _round(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, rounded(F.col(n), digits))
    return df


# The domain of a dam is its flood corridor; each dam is a site of its own.
_DOMAIN = _CORRIDOR + """,
gd AS (SELECT raster_id, CAST(greatest(1, least(60, CAST(floor((west + 180.0) / 6.0) AS INT) + 1)) AS INT) + 32600 AS epsg FROM rasters),
dc AS (SELECT co.dam_id, c.raster_id, c.row_idx, c.col_idx, z, west + (c.col_idx + 0.5::DOUBLE) * res_x AS lon, north - (c.row_idx + 0.5::DOUBLE) * res_y AS lat, gd.epsg
  FROM cells c JOIN rasters r ON r.raster_id = c.raster_id JOIN gd ON gd.raster_id = c.raster_id
  JOIN co ON co.raster_id = c.raster_id AND co.row_idx = c.row_idx AND co.col_idx = c.col_idx WHERE z IS NOT NULL),
""" + T.utm_forward_ctes("dc") + """,
dp AS (SELECT dam_id AS site_id, raster_id, row_idx, col_idx, easting AS x, northing AS y, z FROM dc_fwd)"""


def _domain_points(spark, sf):
    rasters = view(spark, sf, "rasters")
    domain = W.domain_cells(corridor(spark, sf), view(spark, sf, "cells"))
    grids = rasters.select("raster_id", G.utm_epsg(F.col("west"), F.col("north")).alias("epsg"))
    return P.domain_points(domain, rasters, grids, "dam_id")


@query("domain_points", f"WITH {_DOMAIN} SELECT site_id, row_idx, col_idx, {R('x', 3)} AS x, {R('y', 3)} AS y, z FROM dp", recursive=True)
def domain_points(spark, sf):
    return _round(_domain_points(spark, sf), "x", "y", digits=3)


_NATIVE = """SELECT raster_id, (abs(res_x) * 111320.0 * cos(radians(north - height * res_y / 2)) + abs(res_y) * 110540.0) / 2 AS native_m FROM rasters"""


@query("native_resolution", f"WITH nr AS ({_NATIVE}) SELECT raster_id, {R('native_m')} AS native_m FROM nr")
def native_resolution(spark, sf):
    return _round(P.native_resolution(view(spark, sf, "rasters")), "native_m")


_BINS = f"""{_DOMAIN}, nr AS ({_NATIVE}), o AS (SELECT site_id, min(x) AS x0, min(y) AS y0 FROM dp GROUP BY site_id),
bn AS (SELECT dp.site_id, CAST(floor((x - x0) / 100) AS INT) AS ix, CAST(floor((y - y0) / 100) AS INT) AS iy, any_value(x0) AS x0, any_value(y0) AS y0,
  {_mean()} AS z FROM dp JOIN o ON o.site_id = dp.site_id JOIN nr ON nr.raster_id = dp.raster_id WHERE 100 > native_m * 1.5 GROUP BY 1, 2, 3)"""


def _bins(spark, sf):
    native = P.native_resolution(view(spark, sf, "rasters"))
    sites = corridor(spark, sf).select(F.col("dam_id").alias("site_id"), "raster_id").distinct().join(native, "raster_id")
    return P.grid_resample(_domain_points(spark, sf), sites, 100.0)


@query("grid_resample", f"WITH {_BINS} SELECT site_id, ix, iy, {R('x0 + (ix + 0.5::DOUBLE) * 100', 3)} AS x, {R('y0 + (iy + 0.5::DOUBLE) * 100', 3)} AS y, {R('z', 7)} AS z FROM bn", recursive=True)
def grid_resample(spark, sf):
    return _round(_round(_bins(spark, sf), "x", "y", digits=3), "z", digits=7)  # means of up to 16 thousandths end there


@query("lattice_order", f'WITH {_BINS} SELECT site_id, ix, iy, row_number() OVER (PARTITION BY site_id ORDER BY iy, ix) - 1 AS "order" FROM bn', recursive=True)
def lattice_order(spark, sf):
    return P.lattice_order(_bins(spark, sf)).select("site_id", "ix", "iy", "order")


_SCALED = f"""{_DOMAIN}, o AS (SELECT site_id, min(x) AS origin_x, min(y) AS origin_y FROM dp GROUP BY site_id),
sd AS (SELECT dp.site_id, row_idx, col_idx, origin_x, origin_y, x - origin_x AS x_m, y - origin_y AS y_m, z AS elevation_m,
  (x - origin_x) * 0.02::DOUBLE AS x_sim, (y - origin_y) * 0.02::DOUBLE AS y_sim, z * 0.02::DOUBLE AS z_sim FROM dp JOIN o ON o.site_id = dp.site_id)"""


@query("local_scale", f"""WITH {_SCALED} SELECT site_id, row_idx, col_idx, {R('origin_x', 3)} AS origin_x, {R('origin_y', 3)} AS origin_y, {R('x_m', 3)} AS x_m,
  {R('y_m', 3)} AS y_m, elevation_m, {R('x_sim', 4)} AS x_sim, {R('y_sim', 4)} AS y_sim, {R('z_sim')} AS z_sim FROM sd""", recursive=True)
def local_scale(spark, sf):
    s = P.local_scale(_domain_points(spark, sf))
    return _round(_round(_round(s, "origin_x", "origin_y", "x_m", "y_m", digits=3), "x_sim", "y_sim", digits=4), "z_sim")


@query("terrain_summary", f"""WITH {_SCALED} SELECT site_id, count(*) AS samples, min(elevation_m) AS elev_min, max(elevation_m) AS elev_max,
  {', '.join(f"{R(f'{f}({c})', 4)} AS {c}_{f}" for c in ('x_sim', 'y_sim', 'z_sim') for f in ('min', 'max'))} FROM sd GROUP BY site_id""", recursive=True)
def terrain_summary(spark, sf):
    s = P.terrain_summary(P.local_scale(_domain_points(spark, sf)))
    return _round(s, *[f"{c}_{f}" for c in ("x_sim", "y_sim", "z_sim") for f in ("min", "max")], digits=4)


# Particle positions serve as a point cloud with many equal points.
@query("xy_dedupe", """SELECT run_id AS site_id, min(pt) AS pt, arg_min(x, pt) AS x, arg_min(y, pt) AS y, arg_min(z, pt) AS z
FROM (SELECT run_id, idp * 64 + frame AS pt, y AS x, z AS y, x AS z FROM particles) q GROUP BY run_id, round(x, 9), round(y, 9)""")
def xy_dedupe(spark, sf):
    pts = view(spark, sf, "particles").selectExpr("run_id AS site_id", "idp * 64 + frame AS pt", "y AS x", "z AS y", "x AS z")
    return P.xy_dedupe(pts, "pt")


_OFF = "SELECT dam_id, site_id, dam_x + CAST(dam_id % 9 AS DOUBLE) * CAST(0.37 AS DOUBLE) AS dam_x, dam_y - CAST(dam_id % 4 AS DOUBLE) * CAST(2.1 AS DOUBLE) AS dam_y FROM {s}"


@query("nearest_sample", f"""WITH s AS ({_OFF.format(s='sites')}), n AS (SELECT dam_id, s.site_id, s.dam_x, s.dam_y, pt_id, z,
  (x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y) AS d2,
  row_number() OVER (PARTITION BY dam_id ORDER BY (x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y), pt_id) AS rn
  FROM s JOIN terrain_points t ON t.site_id = s.site_id)
SELECT dam_id, site_id, dam_x, dam_y, {R('sqrt(d2)')} AS distance, pt_id AS nearest_pt, z AS dam_z FROM n WHERE rn = 1""")
def nearest_sample(spark, sf):
    targets = spark.sql(_OFF.format(s="{s}"), s=view(spark, sf, "sites"))
    return _round(P.nearest_sample(targets, view(spark, sf, "terrain_points"), 1.2, "pt_id"), "distance")


@query("flat_surface", f"""WITH s AS (SELECT s.*, t.z AS plane_z FROM sites s JOIN terrain_points t ON t.site_id = s.site_id AND t.x = s.dam_x AND t.y = s.dam_y),
p AS (SELECT dam_id, plane_z, t.z FROM s JOIN terrain_points t ON t.site_id = s.site_id AND sqrt((x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y)) <= 8)
SELECT dam_id, plane_z, count(*) AS sample_count, {R('count(*) FILTER (abs(z - plane_z) <= 0.05::DOUBLE) / count(*)')} AS flat_fraction,
  {R('max(z) - min(z)')} AS relief, count(*) FILTER (abs(z - plane_z) <= 0.05::DOUBLE) / count(*) >= 0.35 AS is_flat_water_plane FROM p GROUP BY dam_id, plane_z""")
def flat_surface(spark, sf):
    pts = view(spark, sf, "terrain_points")
    at = pts.select("site_id", F.col("x").alias("dam_x"), F.col("y").alias("dam_y"), F.col("z").alias("plane_z"))
    targets = view(spark, sf, "sites").join(at, ["site_id", "dam_x", "dam_y"])
    return _round(P.flat_surface(targets, pts, 8.0, 0.05), "flat_fraction", "relief")


_UP = """pr AS (SELECT dam_id, t.z, x - dam_x AS dx, y - dam_y AS dy, sqrt((x - dam_x) * (x - dam_x) + (y - dam_y) * (y - dam_y)) AS d
  FROM sites s JOIN terrain_points t ON t.site_id = s.site_id),
dr(axis, sign, o) AS (VALUES ('x', 1.0::DOUBLE, 0), ('x', -1.0::DOUBLE, 1), ('y', 1.0::DOUBLE, 2), ('y', -1.0::DOUBLE, 3)),
se AS (SELECT dam_id, axis, sign, o, count(*) AS n, avg(z) AS m FROM pr CROSS JOIN dr
  WHERE d <= 8 AND d > 2 AND sign * CASE axis WHEN 'x' THEN dx ELSE dy END > 0.25 * d GROUP BY 1, 2, 3, 4),
up AS (SELECT *, row_number() OVER (PARTITION BY dam_id ORDER BY m DESC, o) AS rn FROM se WHERE n >= 3)"""


@query("upstream_axis", f"""WITH {_UP} SELECT s.dam_id, s.site_id, dam_x, dam_y, coalesce(axis, 'x') AS flow_axis, coalesce(sign, 1) AS upstream_sign,
  CASE WHEN axis IS NULL THEN 'fallback-default' ELSE 'local-upstream-elevation-heuristic' END AS method
FROM sites s LEFT JOIN up ON up.dam_id = s.dam_id AND rn = 1""")
def upstream_axis(spark, sf):
    return P.upstream_axis(view(spark, sf, "sites"), view(spark, sf, "terrain_points"), 8.0)


@query("zonal_stats", f"""SELECT b.dam_id, b.site_id, seg, b.x0, b.x1, b.y0, b.y1, b.z0, b.z1, nullif(count(t.z), 0) AS cell_count, min(t.z) AS cell_min,
  max(t.z) AS cell_max, {R('median(t.z)')} AS cell_median FROM dam_boxes b LEFT JOIN terrain_points t ON t.site_id = b.site_id
  AND t.x BETWEEN b.x0 AND b.x1 AND t.y BETWEEN b.y0 AND b.y1 GROUP BY ALL""".replace(
    "GROUP BY ALL", "GROUP BY b.dam_id, b.site_id, seg, b.x0, b.x1, b.y0, b.y1, b.z0, b.z1"))
def zonal_stats(spark, sf):
    z = Z.zonal_stats(view(spark, sf, "dam_boxes"), view(spark, sf, "terrain_points"), ["dam_id", "seg"])
    return _round(z, "cell_median")


@query("box_union", """SELECT dam_id, min(x0) AS x_min, max(x1) AS x_max, min(y0) AS y_min, max(y1) AS y_max, min(z0) AS z_min, max(z1) AS z_max
FROM dam_boxes GROUP BY dam_id""")
def box_union(spark, sf):
    return Z.box_union(view(spark, sf, "dam_boxes"), "dam_id")


_DOM = """SELECT dam_id, CAST(0 AS DOUBLE) AS lo_x, CAST(30 AS DOUBLE) AS hi_x, CAST(2 AS DOUBLE) AS lo_y, CAST(34 AS DOUBLE) AS hi_y,
  CAST(0 AS DOUBLE) AS lo_z, CAST(5 AS DOUBLE) AS hi_z FROM {s}"""


@query("box_containment", f"""WITH dm AS ({_DOM.format(s='sites')}), b AS (SELECT dam_id, CASE seg WHEN 0 THEN 'dam' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'terrain' ELSE 'apron' END AS name,
  CASE WHEN dam_id % 6 = 5 AND seg = 1 THEN NULL ELSE x0 END AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max, z0 AS z_min, z1 AS z_max FROM dam_boxes)
SELECT b.dam_id, CASE WHEN bool_and(x_min IS NULL OR (x_min >= lo_x - 1e-6 AND x_max <= hi_x + 1e-6 AND y_min >= lo_y - 1e-6 AND y_max <= hi_y + 1e-6
   AND z_min >= lo_z - 1e-6 AND z_max <= hi_z + 1e-6)) THEN 'pass' ELSE 'fail' END AS status,
  coalesce(string_agg(concat('simulation domain does not fully contain ', name), '; ' ORDER BY name) FILTER (x_min IS NOT NULL AND NOT (x_min >= lo_x - 1e-6
   AND x_max <= hi_x + 1e-6 AND y_min >= lo_y - 1e-6 AND y_max <= hi_y + 1e-6 AND z_min >= lo_z - 1e-6 AND z_max <= hi_z + 1e-6)), '') AS errors
FROM b JOIN dm ON dm.dam_id = b.dam_id GROUP BY b.dam_id""")
def box_containment(spark, sf):
    bounds = view(spark, sf, "dam_boxes").selectExpr(
        "dam_id", "CASE seg WHEN 0 THEN 'dam' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'terrain' ELSE 'apron' END AS name",
        "CASE WHEN dam_id % 6 = 5 AND seg = 1 THEN NULL ELSE x0 END AS x_min", "x1 AS x_max", "y0 AS y_min", "y1 AS y_max",
        "z0 AS z_min", "z1 AS z_max",
    )
    domains = spark.sql(_DOM.format(s="{s}"), s=view(spark, sf, "sites"))
    out = Z.box_containment(bounds, domains, "dam_id")
    return out.withColumn("errors", joined(F.col("errors")))


_SECT = """SELECT dam_id, site_id, CASE WHEN dam_id % 2 = 0 THEN 'x' ELSE 'y' END AS axis, dam_x AS cx, dam_y AS cy, CAST(0.7 AS DOUBLE) AS band_half,
  CAST(6.1 AS DOUBLE) AS length_half FROM {s}"""


@query("band_section", f"""WITH se AS ({_SECT.format(s='sites')})
SELECT 'point' AS kind, dam_id, x AS h, y AS v, z FROM se JOIN terrain_points t ON t.site_id = se.site_id
  AND abs(CASE axis WHEN 'x' THEN y - cy ELSE x - cx END) <= band_half AND abs(CASE axis WHEN 'x' THEN x - cx ELSE y - cy END) <= length_half
UNION ALL SELECT 'box', b.dam_id, x0, y0, z0 FROM dam_boxes b JOIN se ON se.dam_id = b.dam_id
  WHERE CASE axis WHEN 'x' THEN y0 <= cy + band_half AND y1 >= cy - band_half ELSE x0 <= cx + band_half AND x1 >= cx - band_half END""")
def band_section(spark, sf):
    sections = spark.sql(_SECT.format(s="{s}"), s=view(spark, sf, "sites"))
    pts = Z.band_section(view(spark, sf, "terrain_points"), sections, ["dam_id"])
    boxes = Z.boxes_in_band(view(spark, sf, "dam_boxes"), sections, ["dam_id"])
    return pts.selectExpr("'point' AS kind", "dam_id", "x AS h", "y AS v", "z").unionByName(
        boxes.selectExpr("'box' AS kind", "dam_id", "x0 AS h", "y0 AS v", "z0 AS z")
    )


# --- surface -----------------------------------------------------------------

_PT = ", ".join(f"p{s}.pt_id AS i{s}, p{s}.x AS x{s}, p{s}.y AS y{s}, p{s}.z AS z{s}" for s in range(4))


def _corner(s: int, dx: int, dy: int) -> str:
    return f"LEFT JOIN terrain_points p{s} ON p{s}.site_id = k.site_id AND p{s}.ix = k.bx + {dx} AND p{s}.iy = k.bw + {dy}"


def _tri(half: int, a: int, b: int, c: int) -> str:
    cols = ", ".join(f"i{s} AS {v}, x{s} AS x{v}, y{s} AS y{v}, z{s} AS z{v}" for v, s in zip("abc", (a, b, c)))
    return f"SELECT site_id, bx, bw, ((CAST(bw + 1 AS BIGINT) * 2147483648 + (bx + 1)) * 2 + {half}) AS tri_id, {cols} FROM bk"


_TRI = f"""k AS (SELECT DISTINCT site_id, ix - i AS bx, iy - j AS bw FROM terrain_points CROSS JOIN range(0, 2) AS a(i) CROSS JOIN range(0, 2) AS b(j)),
bk AS (SELECT k.*, {_PT} FROM k {_corner(0, 0, 0)} {_corner(1, 1, 0)} {_corner(2, 0, 1)} {_corner(3, 1, 1)}),
tri AS ({_tri(0, 0, 1, 3)} WHERE i0 IS NOT NULL AND i1 IS NOT NULL AND i3 IS NOT NULL
  UNION ALL {_tri(1, 0, 3, 2)} WHERE i0 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL
  UNION ALL {_tri(0, 0, 1, 2)} WHERE i0 IS NOT NULL AND i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NULL
  UNION ALL {_tri(1, 1, 3, 2)} WHERE i0 IS NULL AND i1 IS NOT NULL AND i2 IS NOT NULL AND i3 IS NOT NULL)"""
_E = "sqrt((x{0}-x{1})*(x{0}-x{1}) + (y{0}-y{1})*(y{0}-y{1}) + (z{0}-z{1})*(z{0}-z{1}))"
_N = ("((yb-ya)*(zc-za) - (zb-za)*(yc-ya))", "((zb-za)*(xc-xa) - (xb-xa)*(zc-za))", "((xb-xa)*(yc-ya) - (yb-ya)*(xc-xa))")
_SIZE = f"sqrt({_N[0]}*{_N[0]} + {_N[1]}*{_N[1]} + {_N[2]}*{_N[2]})"
MAX_EDGE = 0.851
_KEPT = f"""{_TRI}, el AS (SELECT *, {_E.format('a', 'b')} AS e_ab, {_E.format('b', 'c')} AS e_bc, {_E.format('c', 'a')} AS e_ca, {_SIZE} AS area FROM tri),
kp AS (SELECT * FROM el WHERE greatest(e_ab, e_bc, e_ca) <= {MAX_EDGE} + 1e-9 AND area > 1e-12)"""


def _triangles(spark, sf):
    return S.lattice_triangles(view(spark, sf, "terrain_points"), "pt_id")


@query("lattice_triangles", f"WITH {_TRI} SELECT site_id, tri_id, a, b, c FROM tri")
def lattice_triangles(spark, sf):
    return _triangles(spark, sf).select("site_id", "tri_id", "a", "b", "c")


@query("orient_triangles", f"""WITH {_TRI}, sw AS (SELECT site_id, tri_id, a, CASE WHEN bx % 2 = 1 THEN c ELSE b END AS b, CASE WHEN bx % 2 = 1 THEN b ELSE c END AS c,
  CASE WHEN bx % 2 = 1 THEN -1 ELSE 1 END * ((xb - xa) * (yc - ya) - (yb - ya) * (xc - xa)) AS cr FROM tri)
SELECT site_id, tri_id, a, CASE WHEN cr < 0 THEN c ELSE b END AS b, CASE WHEN cr < 0 THEN b ELSE c END AS c FROM sw""")
def orient_triangles(spark, sf):
    """Every other block column is turned over first, so that there is something to orient."""
    t = _triangles(spark, sf)
    odd = F.col("bx") % 2 == 1
    turned = t.select(
        "site_id", "tri_id", "a", F.when(odd, F.col("c")).otherwise(F.col("b")).alias("b"),
        F.when(odd, F.col("b")).otherwise(F.col("c")).alias("c"), "pa",
        F.when(odd, F.col("pc")).otherwise(F.col("pb")).alias("pb"), F.when(odd, F.col("pb")).otherwise(F.col("pc")).alias("pc"),
    )
    return S.orient_triangles(turned).select("site_id", "tri_id", "a", "b", "c")


@query("edge_filter", f"""WITH {_KEPT}, rc AS (SELECT site_id, count(*) FILTER (NOT (greatest(e_ab, e_bc, e_ca) <= {MAX_EDGE} + 1e-9 AND area > 1e-12)) AS removed
  FROM el GROUP BY site_id)
SELECT kp.site_id, tri_id, {R('e_ab')} AS e_ab, {R('e_bc')} AS e_bc, {R('e_ca')} AS e_ca, removed FROM kp JOIN rc ON rc.site_id = kp.site_id""")
def edge_filter(spark, sf):
    t = _triangles(spark, sf)
    kept = S.edge_filter(t, MAX_EDGE).select("site_id", "tri_id", "e_ab", "e_bc", "e_ca")
    return _round(kept.join(S.removed_counts(t, MAX_EDGE).drop("kept"), "site_id"), "e_ab", "e_bc", "e_ca")


@query("edge_stats", f"""WITH {_KEPT}, e AS (SELECT site_id, unnest([e_ab, e_bc, e_ca]) AS e FROM kp)
SELECT site_id, {R('min(e)')} AS min_edge, {R('max(e)')} AS max_edge, {R('avg(e)')} AS avg_edge FROM e GROUP BY site_id""")
def edge_stats(spark, sf):
    return _round(S.edge_stats(S.edge_filter(_triangles(spark, sf), MAX_EDGE)), "min_edge", "max_edge", "avg_edge")


@query("facet_normals", f"""WITH {_TRI} SELECT site_id, tri_id, {R(f'{_N[0]} / {_SIZE}')} AS nx, {R(f'{_N[1]} / {_SIZE}')} AS ny, {R(f'{_N[2]} / {_SIZE}')} AS nz FROM tri""")
def facet_normals(spark, sf):
    return _round(S.facet_normals(_triangles(spark, sf)), "nx", "ny", "nz")


@query("mesh_components", f"""WITH {_KEPT},
ed AS MATERIALIZED (SELECT site_id, tri_id, least(a, b) AS p, greatest(a, b) AS q FROM kp UNION ALL SELECT site_id, tri_id, least(b, c), greatest(b, c) FROM kp
  UNION ALL SELECT site_id, tri_id, least(c, a), greatest(c, a) FROM kp),
nb AS MATERIALIZED (SELECT DISTINCT x.site_id, x.tri_id, y.tri_id AS other FROM ed x JOIN ed y ON y.site_id = x.site_id AND y.p = x.p AND y.q = x.q),
lb AS (SELECT 0 AS it, site_id, tri_id, tri_id AS label, true AS moved FROM kp
  UNION ALL SELECT it + 1, site_id, tri_id, nl, nl <> label FROM (
    SELECT l.it, l.site_id, l.tri_id, l.label, m.nl FROM lb l JOIN (SELECT nb.site_id, nb.tri_id, min(o.label) AS nl FROM nb
      JOIN lb o ON o.site_id = nb.site_id AND o.tri_id = nb.other GROUP BY nb.site_id, nb.tri_id) m ON m.site_id = l.site_id AND m.tri_id = l.tri_id) q
  WHERE (SELECT bool_or(moved) FROM lb))
SELECT site_id, count(DISTINCT label) AS components FROM lb WHERE it = (SELECT max(it) FROM lb) GROUP BY site_id""", recursive=True)
def mesh_components(spark, sf):
    return S.mesh_components(S.edge_filter(_triangles(spark, sf), MAX_EDGE))


STEP = 0.3


@query("surface_raster", f"""WITH {_TRI},
o AS (SELECT site_id, floor(min(x) / {STEP}::DOUBLE) * {STEP}::DOUBLE AS gx0, floor(min(y) / {STEP}::DOUBLE) * {STEP}::DOUBLE AS gy0 FROM (
  SELECT site_id, unnest([xa, xb, xc]) AS x, unnest([ya, yb, yc]) AS y FROM tri) q GROUP BY site_id),
cv AS (SELECT tri.*, gx0, gy0, ix, iy, gx0 + ix * {STEP}::DOUBLE - xa AS gx, gy0 + iy * {STEP}::DOUBLE - ya AS gy,
  (xb - xa) * (yc - ya) - (xc - xa) * (yb - ya) AS den FROM tri JOIN o ON o.site_id = tri.site_id
  CROSS JOIN LATERAL (SELECT unnest(range(greatest(0, CAST(floor((least(xa, xb, xc) - gx0) / {STEP}::DOUBLE) AS INT)), CAST(ceil((greatest(xa, xb, xc) - gx0) / {STEP}::DOUBLE) AS INT) + 1)) AS ix) a
  CROSS JOIN LATERAL (SELECT unnest(range(greatest(0, CAST(floor((least(ya, yb, yc) - gy0) / {STEP}::DOUBLE) AS INT)), CAST(ceil((greatest(ya, yb, yc) - gy0) / {STEP}::DOUBLE) AS INT) + 1)) AS iy) b),
uv AS (SELECT *, (gx * (yc - ya) - (xc - xa) * gy) / den AS u, ((xb - xa) * gy - gx * (yb - ya)) / den AS v FROM cv WHERE abs(den) >= 1e-14),
al AS (SELECT site_id, ix, iy, za + u * (zb - za) + v * (zc - za) AS z FROM uv WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9
  UNION ALL SELECT q.site_id, CAST(round_even((x - gx0) / {STEP}::DOUBLE, 0) AS BIGINT), CAST(round_even((y - gy0) / {STEP}::DOUBLE, 0) AS BIGINT), z FROM (
   SELECT site_id, unnest([xa, xb, xc]) AS x, unnest([ya, yb, yc]) AS y, unnest([za, zb, zc]) AS z FROM tri) q JOIN o ON o.site_id = q.site_id)
SELECT al.site_id, ix, iy, {R(f'gx0 + ix * {STEP}::DOUBLE')} AS x, {R(f'gy0 + iy * {STEP}::DOUBLE')} AS y, {R('min(z)')} AS z
FROM al JOIN o ON o.site_id = al.site_id GROUP BY al.site_id, ix, iy, gx0, gy0""")
def surface_raster(spark, sf):
    return _round(S.surface_raster(_triangles(spark, sf), STEP), "x", "y", "z")
