"""Raster, stencil and axis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.functions.scalars import rounded
from terraflow.operators import axis as X
from terraflow.operators import raster as A
from terraflow.operators import stencil as N
from terraflow.plans import sqltext as T
from terraflow.plans.registry import query
from terraflow.session import once
from terraflow.sources import cells as C
from terraflow.sources.views import view

R = T.r
TILE = 32  # small tiles, so that the 64-cell rasters of the test data have several


def _mean(z="z"):
    return f"avg({z})"


@query("raster_info", """
SELECT header_id, epsg, width, height, band_count, west, north - height * res_y AS south, west + width * res_x AS east, north,
  res_x, res_y, nodata FROM raster_headers WHERE width > 0 AND height > 0 AND band_count >= 1 AND epsg IS NOT NULL""")
def raster_info(spark, sf):
    return A.raster_info(view(spark, sf, "raster_headers"), "header_id")


def cell_table(spark, sf):
    """The cleaned cells of all rasters in tile order, written once for all queries that read parts of them."""
    raw, rasters = view(spark, sf, "raw_cells"), view(spark, sf, "rasters")
    return once(spark, "cells", sf, lambda: A.clean_cells(raw, rasters), lambda cells: C.write_cells(cells, TILE, 1 << 16))


@query("cells_scan", "SELECT raster_id, row_idx, col_idx, z, CAST(row_idx // 32 AS INT) AS tile_row, CAST(col_idx // 32 AS INT) AS tile_col FROM cells")
def cells_scan(spark, sf):
    return cell_table(spark, sf)


_STATS = f"""SELECT raster_id, count(z) AS valid_cells, min(z) AS minimum, max(z) AS maximum, {R(_mean())} AS mean,
  {R('median(z)')} AS median FROM cells WHERE z IS NOT NULL GROUP BY raster_id"""


def _stats(spark, sf):
    s = A.statistics(view(spark, sf, "cells"), ["raster_id"])
    return s.withColumn("mean", rounded(F.col("mean"))).withColumn("median", rounded(F.col("median")))


@query("raster_stats", _STATS)
def raster_stats(spark, sf):
    return _stats(spark, sf)


# Dam positions in degrees, a quarter cell off the cell corner.
_DAMS = """SELECT a.dam_pos AS dam_id, a.raster_id, r.west + (a.col_idx + CAST(0.5 AS DOUBLE)) * r.res_x AS lon,
  r.north - (a.row_idx + CAST(0.5 AS DOUBLE)) * r.res_y AS lat FROM {a} a JOIN {r} r ON r.raster_id = a.raster_id"""
_DAMS_SQL = _DAMS.format(a="anchors_on_land", r="rasters")


def dams(spark, sf):
    return spark.sql(
        _DAMS.format(a="{a}", r="{r}"), a=view(spark, sf, "anchors_on_land"), r=view(spark, sf, "rasters")
    )


@query("dam_cell_stats", f"""WITH st AS ({_STATS}), d AS ({_DAMS_SQL})
SELECT dam_id, greatest(0, least(CAST(floor((north - lat) / res_y) AS INT), height - 1)) AS dam_row,
  greatest(0, least(CAST(floor((lon - west) / res_x) AS INT), width - 1)) AS dam_col, st.*
FROM d JOIN rasters r ON r.raster_id = d.raster_id JOIN st ON st.raster_id = d.raster_id""")
def dam_cell_stats(spark, sf):
    row, col = A.nearest_cell(F.col("lon"), F.col("lat"))
    d = dams(spark, sf).join(view(spark, sf, "rasters"), "raster_id")
    return d.select("dam_id", "raster_id", row.alias("dam_row"), col.alias("dam_col")).join(_stats(spark, sf), "raster_id")


_LOCATED = """pt AS (SELECT p.*, west, north, res_x, res_y, width, height, west + width * res_x AS east, north - height * res_y AS south,
  CAST(floor((north - lat) / res_y) AS INT) AS fr, CAST(floor((lon - west) / res_x) AS INT) AS fc
  FROM probe_points p JOIN rasters r ON r.raster_id = p.raster_id),
pq AS (SELECT *, CASE WHEN fc >= width AND abs(lon - east) <= greatest(res_x * 1e-6, 1e-12) THEN width - 1
   WHEN fc < 0 AND abs(lon - west) <= greatest(res_x * 1e-6, 1e-12) THEN 0 ELSE fc END AS cc FROM pt),
pl AS (SELECT *, lon BETWEEN west AND east AND lat BETWEEN south AND north AND fr BETWEEN 0 AND height - 1
   AND cc BETWEEN 0 AND width - 1 AS inside FROM pq)"""


@query("point_in_raster", f"""WITH {_LOCATED} SELECT point_id, raster_id, inside, CASE WHEN inside THEN fr END AS row_idx,
  CASE WHEN inside THEN cc END AS col_idx FROM pl""")
def point_in_raster(spark, sf):
    return A.points_on_raster(view(spark, sf, "probe_points"), view(spark, sf, "rasters")).drop("lon", "lat")


@query("point_sample", f"""WITH {_LOCATED} SELECT point_id, pl.raster_id, inside, CASE WHEN inside THEN fr END AS row_idx,
  CASE WHEN inside THEN cc END AS col_idx, CASE WHEN inside THEN c.z END AS elevation
FROM pl LEFT JOIN cells c ON c.raster_id = pl.raster_id AND c.row_idx = fr AND c.col_idx = cc""")
def point_sample(spark, sf):
    return _point_sample(spark, sf).drop("lon", "lat")


def _point_sample(spark, sf):
    points = A.points_on_raster(view(spark, sf, "probe_points"), view(spark, sf, "rasters"))
    row, col = F.col("row_idx"), F.col("col_idx")
    return A.elevations(points, C.cells_near(cell_table(spark, sf), C.boxes_of(points, TILE, row, row, col, col)))


# Clip centres: the dams, every seventh moved off its raster.
_CENTRES = """SELECT dam_id AS clip_id, raster_id, lon + CASE WHEN dam_id % 7 = 6 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lon, lat FROM {d}"""
_WINDOWS = f"""d AS ({_DAMS_SQL}), ce AS ({_CENTRES.format(d='d')}),
u AS (SELECT ce.*, {T.utm_epsg('lon', 'lat')} AS epsg FROM ce),
{T.utm_forward_ctes('u')},
k AS (SELECT clip_id, epsg, easting + sx * 300 AS easting, northing + sy * 200 AS northing FROM u_fwd
  CROSS JOIN (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) AS s(sx, sy)),
{T.utm_inverse_ctes('k')},
bx AS (SELECT clip_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM k_inv GROUP BY clip_id),
w0 AS (SELECT ce.clip_id, ce.raster_id, ce.lon, ce.lat, west, north, res_x, res_y, width, height,
  greatest(x0, west) AS x0, least(x1, west + width * res_x) AS x1, greatest(y0, north - height * res_y) AS y0, least(y1, north) AS y1,
  NOT (ce.lon BETWEEN west AND west + width * res_x AND ce.lat BETWEEN north - height * res_y AND north) AS outside
  FROM ce JOIN rasters r ON r.raster_id = ce.raster_id JOIN bx ON bx.clip_id = ce.clip_id),
w1 AS (SELECT *, greatest(0, CAST(floor((north - y1) / res_y) AS INT)) AS row0, greatest(0, CAST(floor((x0 - west) / res_x) AS INT)) AS col0 FROM w0),
w2 AS (SELECT *, least(height, row0 + CAST(floor((y1 - y0) / res_y + 0.5) AS INT)) AS row1,
  least(width, col0 + CAST(floor((x1 - x0) / res_x + 0.5) AS INT)) AS col1 FROM w1),
win AS (SELECT *, CASE WHEN outside THEN 'centre outside raster' WHEN x0 >= x1 OR y0 >= y1 THEN 'window outside raster'
  WHEN row1 <= row0 OR col1 <= col0 THEN 'window has zero area' END AS error FROM w2),
cl AS (SELECT clip_id, c.raster_id, c.row_idx, c.col_idx, c.z FROM win JOIN cells c ON c.raster_id = win.raster_id
  AND c.row_idx >= row0 AND c.row_idx < row1 AND c.col_idx >= col0 AND c.col_idx < col1 WHERE error IS NULL)"""


def _windows(spark, sf):
    centres = spark.sql(_CENTRES.format(d="{d}"), d=dams(spark, sf))
    return A.clip_windows(centres, view(spark, sf, "rasters"), 0.6, 0.4)


def _clipped(spark, sf, windows):
    """Cells of the windows, read from their tiles alone."""
    usable = windows.filter("error IS NULL")
    boxes = C.boxes_of(usable, TILE, F.col("row0"), F.col("row1") - 1, F.col("col0"), F.col("col1") - 1)
    return A.clip(C.cells_near(cell_table(spark, sf), boxes), windows, TILE)


@query("raster_clip", f"""WITH {_WINDOWS} SELECT clip_id, raster_id, row_idx, col_idx, z, CAST(NULL AS VARCHAR) AS error FROM cl
UNION ALL SELECT clip_id, raster_id, NULL, NULL, NULL, error FROM win WHERE error IS NOT NULL""")
def raster_clip(spark, sf):
    """Clipped cells, and one error row per centre without a window."""
    w = _windows(spark, sf)
    got = _clipped(spark, sf, w).select("clip_id", "raster_id", "row_idx", "col_idx", "z")
    bad = w.filter("error IS NOT NULL").select("clip_id", "raster_id", "error")
    return got.unionByName(bad, allowMissingColumns=True)


@query("clip_stats", f"""WITH {_WINDOWS}, st AS (SELECT clip_id, min(z) AS minimum, max(z) AS maximum, {_mean()} AS mean FROM cl GROUP BY clip_id)
SELECT win.clip_id, row1 - row0 AS height, col1 - col0 AS width, coalesce(minimum, 'NaN'::DOUBLE) AS minimum,
  coalesce(maximum, 'NaN'::DOUBLE) AS maximum, {R("coalesce(mean, 'NaN'::DOUBLE)", 7)} AS mean,
  greatest(0, least(CAST(round_even(((north - row0 * res_y) - lat) / res_y, 0) AS INT), row1 - row0 - 1)) AS dam_row,
  greatest(0, least(CAST(round_even((lon - (west + col0 * res_x)) / res_x, 0) AS INT), col1 - col0 - 1)) AS dam_col
FROM win LEFT JOIN st ON st.clip_id = win.clip_id WHERE error IS NULL""")
def clip_stats(spark, sf):
    w = _windows(spark, sf)
    s = A.clip_stats(_clipped(spark, sf, w), w, view(spark, sf, "rasters"))
    return s.withColumn("mean", rounded(F.col("mean"), 7))


@query("raster_overview", f"""SELECT raster_id, CAST(floor(row_idx / 3.0) AS INT) AS row_idx, CAST(floor(col_idx / 3.0) AS INT) AS col_idx,
  {R(_mean())} AS z, count(z) AS valid_cells FROM cells GROUP BY 1, 2, 3""")
def raster_overview(spark, sf):
    o = A.overview(view(spark, sf, "cells"), view(spark, sf, "rasters"), max_size=22)
    return o.withColumn("z", rounded(F.col("z")))


DIRECTIONS_SQL = """dirs(dir, dr, dc) AS (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)),
slope AS (SELECT c.raster_id, c.row_idx, c.col_idx, d.dir, dr, dc, (c.z - n.z) / CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2::DOUBLE) ELSE 1 END AS s
  FROM cells c CROSS JOIN dirs d JOIN cells n ON n.raster_id = c.raster_id AND n.row_idx = c.row_idx + dr AND n.col_idx = c.col_idx + dc
  WHERE c.z IS NOT NULL AND n.z IS NOT NULL),
pick AS (SELECT *, row_number() OVER (PARTITION BY raster_id, row_idx, col_idx ORDER BY s DESC, dir) AS rn FROM slope WHERE s > -1),
d8 AS (SELECT c.raster_id, c.row_idx, c.col_idx, c.z, coalesce(p.dir, -1) AS dir, c.row_idx + dr AS to_row, c.col_idx + dc AS to_col
  FROM cells c LEFT JOIN pick p ON p.raster_id = c.raster_id AND p.row_idx = c.row_idx AND p.col_idx = c.col_idx AND rn = 1
  WHERE c.z IS NOT NULL)"""


@query("d8_direction", f"WITH {DIRECTIONS_SQL} SELECT raster_id, row_idx, col_idx, dir FROM d8")
def d8_direction(spark, sf):
    return N.d8_direction(view(spark, sf, "cells")).drop("z")


@query("in_degree", f"""WITH {DIRECTIONS_SQL} SELECT a.raster_id, a.row_idx, a.col_idx, count(b.raster_id) AS in_degree
FROM d8 a LEFT JOIN d8 b ON b.raster_id = a.raster_id AND b.to_row = a.row_idx AND b.to_col = a.col_idx GROUP BY 1, 2, 3""")
def in_degree(spark, sf):
    return N.in_degree(N.d8_direction(view(spark, sf, "cells")))


_GRAD = """lim AS (SELECT raster_id, min(z) AS lo, max(z) AS hi FROM cells GROUP BY raster_id),
pad AS (SELECT c.raster_id, c.row_idx, c.col_idx, c.z, lo, hi, coalesce(c.z, lo) AS p,
  coalesce(n.z, lo) AS n, coalesce(s.z, lo) AS s, coalesce(w.z, lo) AS w, coalesce(e.z, lo) AS e
  FROM cells c JOIN lim ON lim.raster_id = c.raster_id
  LEFT JOIN cells n ON n.raster_id = c.raster_id AND n.row_idx = c.row_idx - 1 AND n.col_idx = c.col_idx
  LEFT JOIN cells s ON s.raster_id = c.raster_id AND s.row_idx = c.row_idx + 1 AND s.col_idx = c.col_idx
  LEFT JOIN cells w ON w.raster_id = c.raster_id AND w.row_idx = c.row_idx AND w.col_idx = c.col_idx - 1
  LEFT JOIN cells e ON e.raster_id = c.raster_id AND e.row_idx = c.row_idx AND e.col_idx = c.col_idx + 1),
gr AS (SELECT raster_id, row_idx, col_idx, z, lo, hi, CASE row_idx WHEN 0 THEN s - p WHEN 63 THEN p - n ELSE (s - n) / 2 END AS dy,
  CASE col_idx WHEN 0 THEN e - p WHEN 63 THEN p - w ELSE (e - w) / 2 END AS dx FROM pad),
sh AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, sin(radians(45::DOUBLE)) * sin(pi() / 4 - atan(sqrt(dx*dx + dy*dy)))
  + cos(radians(45::DOUBLE)) * cos(pi() / 4 - atan(sqrt(dx*dx + dy*dy))) * cos(radians(315::DOUBLE) - atan2(-dx, dy)))) AS shade FROM gr)"""


def _gradient(spark, sf):
    return N.gradient(view(spark, sf, "cells"), view(spark, sf, "rasters"))


@query("gradient", f"WITH {_GRAD} SELECT raster_id, row_idx, col_idx, {R('dy')} AS dz_row, {R('dx')} AS dz_col FROM gr")
def gradient(spark, sf):
    g = _gradient(spark, sf)
    return g.select(*N.CELL, rounded(F.col("dz_row")).alias("dz_row"), rounded(F.col("dz_col")).alias("dz_col"))


@query("hillshade", f"WITH {_GRAD} SELECT raster_id, row_idx, col_idx, {R('shade')} AS shade FROM sh")
def hillshade(spark, sf):
    return N.hillshade(_gradient(spark, sf)).select(*N.CELL, rounded(F.col("shade")).alias("shade"))


@query("relief_image", f"""WITH {_GRAD} SELECT raster_id, row_idx, col_idx, CASE WHEN z IS NULL THEN 0 ELSE CAST(floor(least(255::DOUBLE,
  greatest(0::DOUBLE, CASE WHEN hi > lo THEN (z - lo) / (hi - lo) ELSE 0 END * 255 * 0.45::DOUBLE + shade * 255 * 0.55::DOUBLE))) AS INT) END AS level FROM sh""")
def relief_image(spark, sf):
    return N.relief_image(N.hillshade(_gradient(spark, sf)))


_AXIS = f"""d AS ({_DAMS_SQL}),
li AS (SELECT d.*, CAST(b AS DOUBLE) AS bearing_deg, CAST(k * 10 - 49 AS DOUBLE) AS distance_m FROM d
  CROSS JOIN range(0, 180) AS bb(b) CROSS JOIN range(0, 11) AS kk(k)),
sp AS (SELECT dam_id, li.raster_id, bearing_deg, distance_m,
  CAST(floor((north - degrees((6371000.0::DOUBLE * radians(lat) + distance_m * cos(radians(bearing_deg))) / 6371000.0::DOUBLE)) / res_y) AS INT) AS r,
  CAST(floor((degrees((6371000.0::DOUBLE * cos(radians(lat)) * radians(lon) + distance_m * sin(radians(bearing_deg)))
       / (6371000.0::DOUBLE * cos(radians(lat)))) - west) / res_x) AS INT) AS c
  FROM li JOIN rasters ra ON ra.raster_id = li.raster_id),
sa AS (SELECT sp.*, z FROM sp LEFT JOIN cells ON cells.raster_id = sp.raster_id AND row_idx = r AND col_idx = c)"""
_SCORE = f"""{_AXIS},
va AS (SELECT *, min(distance_m) OVER w AS lo, max(distance_m) OVER w AS hi, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY dam_id, bearing_deg ORDER BY distance_m) - 1 AS i FROM sa WHERE z IS NOT NULL
  WINDOW w AS (PARTITION BY dam_id, bearing_deg)),
zo AS (SELECT dam_id, bearing_deg, min(n) AS valid, min(hi - lo) AS span, count(DISTINCT r * 1000 + c) AS unique_cells,
  {_mean('CASE WHEN distance_m <= lo + 0.15::DOUBLE * (hi - lo) THEN z END')} AS lz,
  {_mean('CASE WHEN distance_m >= hi - 0.15::DOUBLE * (hi - lo) THEN z END')} AS rz,
  {_mean('CASE WHEN distance_m >= lo + 0.35::DOUBLE * (hi - lo) AND distance_m <= hi - 0.35::DOUBLE * (hi - lo) THEN z END')} AS cz,
  {_mean('CASE WHEN i < greatest(1, n // 6) THEN z END')} AS lc, {_mean('CASE WHEN i >= n - greatest(1, n // 6) THEN z END')} AS rc,
  {_mean('CASE WHEN i >= n // 3 AND i < (2 * n) // 3 + 1 THEN z END')} AS cc
  FROM va GROUP BY dam_id, bearing_deg),
zp AS (SELECT dam_id, bearing_deg, unique_cells, CASE WHEN cz IS NULL THEN lc ELSE lz END AS l, CASE WHEN cz IS NULL THEN rc ELSE rz END AS r,
  CASE WHEN cz IS NULL THEN cc ELSE cz END AS c FROM zo WHERE valid >= 3 AND unique_cells >= 2 AND span > 0),
sc AS (SELECT dam_id, bearing_deg, unique_cells, CASE WHEN l > c AND r > c THEN 10.0::DOUBLE * least(l - c, r - c) + 2.0::DOUBLE * ((l - c) + (r - c))
   - 2.0::DOUBLE * abs((l - c) - (r - c)) ELSE -100.0::DOUBLE - abs(l - c) - abs(r - c) END AS score, l - c AS left_relief_m, r - c AS right_relief_m,
  l > c AND r > c AS both_ends_above_centre, CASE WHEN unique_cells < 3 THEN 'INVALID/INSUFFICIENT_DATA'
   WHEN l > c AND r > c THEN CASE WHEN least(l - c, r - c) > 2.0 THEN 'GOOD_CROSS_VALLEY' ELSE 'WEAK_CROSSING' END
   WHEN least(l - c, r - c) > 0 THEN 'WEAK_CROSSING' ELSE 'INVALID/INSUFFICIENT_DATA' END AS quality FROM zp)"""


def _samples(spark, sf):
    """Samples of all axes, each looked up in the window of its dam, read from the tiles that the axes cross."""
    placed = X.axis_dams(dams(spark, sf), view(spark, sf, "rasters"))
    met = X.axis_cells(placed)
    reach = met.groupBy(*X.PLACE).agg(*[f(c).alias(n) for c, n, f in (
        ("row_idx", "r0", F.min), ("row_idx", "r1", F.max), ("col_idx", "c0", F.min), ("col_idx", "c1", F.max))])
    boxes = C.boxes_of(reach, TILE, F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1"))
    return X.axis_terrain(placed, met, C.cells_near(cell_table(spark, sf), boxes))


def _round_score(df):
    for c in ("score", "left_relief_m", "right_relief_m"):
        df = df.withColumn(c, rounded(F.col(c)))
    return df


@query("axis_profile", f"""WITH {_AXIS} SELECT dam_id, bearing_deg, count(*) AS samples, count(z) AS valid,
  count(DISTINCT CASE WHEN z IS NOT NULL THEN r * 1000 + c END) AS unique_cells, min(z) AS min_elevation_m, max(z) AS max_elevation_m
FROM sa GROUP BY dam_id, bearing_deg""")
def axis_profile(spark, sf):
    return X.axis_profile(_samples(spark, sf))


@query("axis_score", f"""WITH {_SCORE} SELECT dam_id, bearing_deg, unique_cells, {R('score')} AS score, {R('left_relief_m')} AS left_relief_m,
  {R('right_relief_m')} AS right_relief_m, both_ends_above_centre, quality FROM sc""")
def axis_score(spark, sf):
    return _round_score(X.axis_score(_samples(spark, sf)))


@query("axis_topk", f"""WITH {_SCORE}, ra AS (SELECT *, row_number() OVER (PARTITION BY dam_id ORDER BY score DESC, bearing_deg) AS rank FROM sc)
SELECT dam_id, bearing_deg, unique_cells, {R('score')} AS score, {R('left_relief_m')} AS left_relief_m, {R('right_relief_m')} AS right_relief_m,
  both_ends_above_centre, quality, rank FROM ra WHERE rank <= 10""")
def axis_topk(spark, sf):
    return _round_score(X.best_axes(X.axis_score(_samples(spark, sf))))
