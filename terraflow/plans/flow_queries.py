"""Iterative raster queries: fill, accumulation, paths, corridors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions.scalars import rounded
from terraflow.operators import fill as L
from terraflow.operators import flow as W
from terraflow.operators import stencil as N
from terraflow.operators.tiles import DEFAULT_TILE
from terraflow.plans import sqltext as T
from terraflow.plans.raster_queries import DIRECTIONS_SQL, TILE, _mean
from terraflow.plans.registry import query
from terraflow.session import once
from terraflow.sources.views import view

R = T.r

# Cells that lie on a cycle of directions, and every walk up to its first such cell.
ACC_SQL = f"""{DIRECTIONS_SQL},
g AS MATERIALIZED (SELECT raster_id, row_idx * 64 + col_idx AS c, CASE WHEN dir >= 0 THEN to_row * 64 + to_col END AS t FROM d8),
reach AS (SELECT raster_id, c AS s, t AS c FROM g WHERE t IS NOT NULL
  UNION SELECT r.raster_id, r.s, g.t FROM reach r JOIN g ON g.raster_id = r.raster_id AND g.c = r.c WHERE g.t IS NOT NULL),
cyc AS MATERIALIZED (SELECT DISTINCT raster_id, s AS c FROM reach WHERE s = c),
w AS (SELECT raster_id, c AS s, c FROM g
  UNION ALL SELECT w.raster_id, w.s, g.t FROM w JOIN g ON g.raster_id = w.raster_id AND g.c = w.c
    WHERE g.t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.raster_id = w.raster_id AND cyc.c = w.c)),
ac AS (SELECT raster_id, c, count(*) AS acc FROM w GROUP BY raster_id, c)"""

_TRACE_RULE = """tr AS (SELECT dam_pos AS dam_id, raster_id, row_idx * 64 + col_idx AS c, 0 AS step, [row_idx * 64 + col_idx] AS seen FROM anchors_on_land
  UNION ALL SELECT tr.dam_id, tr.raster_id, g.t, step + 1, list_append(seen, g.t) FROM tr JOIN g ON g.raster_id = tr.raster_id AND g.c = tr.c
    WHERE g.t IS NOT NULL AND NOT list_contains(seen, g.t))"""
TRACE_SQL = f"""{DIRECTIONS_SQL},
g AS MATERIALIZED (SELECT raster_id, row_idx * 64 + col_idx AS c, CASE WHEN dir >= 0 THEN to_row * 64 + to_col END AS t FROM d8),
{_TRACE_RULE}"""


def _starts(spark, sf):
    return view(spark, sf, "anchors_on_land").selectExpr("dam_pos AS dam_id", "raster_id", "row_idx", "col_idx")


def _tiles(spark, sf, tile=DEFAULT_TILE):
    return W.direction_tiles(N.d8_direction(view(spark, sf, "cells")), tile)


@query("flow_accumulation", f"""WITH {ACC_SQL} SELECT cells.raster_id, row_idx, col_idx, coalesce(acc, -1) AS acc FROM cells
LEFT JOIN ac ON ac.raster_id = cells.raster_id AND ac.c = row_idx * 64 + col_idx""", recursive=True)
def flow_accumulation(spark, sf):
    """Accumulation of every cell; -1 on nodata."""
    acc = W.flow_accumulation(None, TILE, _tiles(spark, sf, TILE))
    cells = view(spark, sf, "cells").select(*N.CELL)
    return cells.join(acc, N.CELL, "left").withColumn("acc", F.coalesce("acc", F.lit(-1)))


@query("downstream_trace", f"""WITH {TRACE_SQL} SELECT dam_id, raster_id, CAST(c // 64 AS INT) AS row_idx, CAST(c % 64 AS INT) AS col_idx,
  step FROM tr""", recursive=True)
def downstream_trace(spark, sf):
    return W.downstream_trace(_starts(spark, sf), _tiles(spark, sf, TILE), TILE)


_KM = "abs(res_y) * 111.32", "abs(res_x) * 111.32 * cos(radians(north - height * res_y / 2))"


@query("path_summary", f"""WITH {ACC_SQL}, {_TRACE_RULE},
n AS (SELECT tr.*, lead(c) OVER (PARTITION BY dam_id ORDER BY step) AS nc FROM tr),
p AS (SELECT n.dam_id, n.raster_id, count(*) AS path_cells, min(CASE WHEN step = 0 THEN nc // 64 END) AS first_row,
  min(CASE WHEN step = 0 THEN nc % 64 END) AS first_col, arg_max(z, step) AS end_elevation, max(acc) AS max_accumulation,
  count(*) FILTER (abs(nc - n.c) = 64) AS v, count(*) FILTER (abs(nc - n.c) = 1) AS h, count(*) FILTER (abs(nc - n.c) IN (63, 65)) AS x
  FROM n JOIN cells ON cells.raster_id = n.raster_id AND row_idx = n.c // 64 AND col_idx = n.c % 64
  LEFT JOIN ac ON ac.raster_id = n.raster_id AND ac.c = n.c GROUP BY n.dam_id, n.raster_id)
SELECT dam_id, p.raster_id, path_cells, first_row, first_col, end_elevation, max_accumulation,
  {R(f'v * ({_KM[0]}) + h * ({_KM[1]}) + x * sqrt(pow({_KM[0]}, 2) + pow({_KM[1]}, 2))')} AS length_km
FROM p JOIN rasters r ON r.raster_id = p.raster_id""", recursive=True)
def path_summary(spark, sf):
    tiles, cells = _tiles(spark, sf), view(spark, sf, "cells")
    path = W.downstream_trace(_starts(spark, sf), tiles)
    acc = W.flow_accumulation(None, tiles=tiles)
    out = W.path_summary(path, cells, acc, view(spark, sf, "rasters"))
    return out.withColumn("length_km", rounded(F.col("length_km")))


_CORRIDOR = f"""{TRACE_SQL},
rad AS (SELECT raster_id, greatest(1, CAST(round_even(150 / ((abs(res_x) * 111320.0 * cos(radians(north - height * res_y / 2))
  + abs(res_y) * 110540.0) / 2), 0) AS INT)) AS radius FROM rasters),
co AS (SELECT DISTINCT dam_id, tr.raster_id, CAST(c // 64 AS INT) + dy AS row_idx, CAST(c % 64 AS INT) + dx AS col_idx
  FROM tr JOIN rad ON rad.raster_id = tr.raster_id CROSS JOIN range(-20, 21) AS yy(dy) CROSS JOIN range(-20, 21) AS xx(dx)
  WHERE dx * dx + dy * dy <= radius * radius AND c // 64 + dy BETWEEN 0 AND 63 AND c % 64 + dx BETWEEN 0 AND 63)"""


def _corridor(spark, sf):
    path = W.downstream_trace(_starts(spark, sf), _tiles(spark, sf))
    return W.flood_corridor(path, view(spark, sf, "rasters"), 0.3)


def corridor(spark, sf):
    """The corridor of every dam, traced once for all queries of the terrain chain."""
    return once(spark, "corridor", sf, lambda: _corridor(spark, sf))


@query("flood_corridor", f"WITH {_CORRIDOR} SELECT * FROM co", recursive=True)
def flood_corridor(spark, sf):
    return _corridor(spark, sf)


@query("domain_cells", f"""WITH {_CORRIDOR}, v AS (SELECT raster_id, count(z) AS n FROM cells GROUP BY raster_id)
SELECT co.dam_id, co.raster_id, co.row_idx, co.col_idx, z, d.domain_cells, {R('d.domain_cells / v.n * 100.0')} AS percent
FROM co LEFT JOIN cells ON cells.raster_id = co.raster_id AND cells.row_idx = co.row_idx AND cells.col_idx = co.col_idx
JOIN (SELECT dam_id, count(*) AS domain_cells FROM co GROUP BY dam_id) d ON d.dam_id = co.dam_id JOIN v ON v.raster_id = co.raster_id""",
       recursive=True)
def domain_cells(spark, sf):
    cells = view(spark, sf, "cells")
    domain = W.domain_cells(corridor(spark, sf), cells)
    size = W.domain_summary(domain, cells).withColumn("percent", rounded(F.col("percent")))
    return domain.join(size, ["dam_id", "raster_id"])


MAX_DEPTH = 1.5
FILL_SQL = f"""nb AS MATERIALIZED (SELECT a.raster_id, a.row_idx * 64 + a.col_idx AS c, b.row_idx * 64 + b.col_idx AS n
  FROM cells a CROSS JOIN range(-1, 2) AS rr(dr) CROSS JOIN range(-1, 2) AS cc(dc)
  JOIN cells b ON b.raster_id = a.raster_id AND b.row_idx = a.row_idx + dr AND b.col_idx = a.col_idx + dc
  WHERE NOT (dr = 0 AND dc = 0) AND a.z IS NOT NULL AND b.z IS NOT NULL),
st AS (SELECT 0 AS it, raster_id, row_idx * 64 + col_idx AS c, z, row_idx IN (0, 63) OR col_idx IN (0, 63) AS seed,
    CASE WHEN row_idx IN (0, 63) OR col_idx IN (0, 63) THEN z ELSE 'inf'::DOUBLE END AS f, true AS moved FROM cells WHERE z IS NOT NULL
  UNION ALL
  SELECT it + 1, raster_id, c, z, seed, nf, nf <> f FROM (
    SELECT s.it, s.raster_id, s.c, s.z, s.seed, s.f, CASE WHEN s.seed THEN s.z WHEN l.low IS NULL THEN 'inf'::DOUBLE WHEN l.low <= s.z THEN s.z
      WHEN l.low - s.z <= {MAX_DEPTH} THEN l.low ELSE 'inf'::DOUBLE END AS nf
    FROM st s LEFT JOIN (SELECT nb.raster_id, nb.c, min(o.f) AS low FROM nb JOIN st o ON o.raster_id = nb.raster_id AND o.c = nb.n
       GROUP BY nb.raster_id, nb.c) l ON l.raster_id = s.raster_id AND l.c = s.c) q
  WHERE (SELECT bool_or(moved) FROM st)),
fl AS (SELECT raster_id, c, z, CASE WHEN isinf(f) THEN z ELSE f END AS filled FROM (
  SELECT *, max(it) OVER () AS mi FROM st) q WHERE it = mi)"""


def _filled(spark, sf, tile=DEFAULT_TILE):
    return L.fill_depressions(view(spark, sf, "cells"), view(spark, sf, "rasters"), MAX_DEPTH, tile)


@query("depression_fill", f"WITH {FILL_SQL} SELECT raster_id, CAST(c // 64 AS INT) AS row_idx, CAST(c % 64 AS INT) AS col_idx, z, filled FROM fl",
       recursive=True)
def depression_fill(spark, sf):
    return _filled(spark, sf, TILE)


@query("fill_stats", f"""WITH {FILL_SQL} SELECT raster_id, min(z) AS orig_min, max(z) AS orig_max, {R(_mean())} AS orig_mean, min(filled) AS cond_min,
  max(filled) AS cond_max, {R(_mean('filled'))} AS cond_mean, count(*) FILTER (filled - z > 1e-6) AS num_modified,
  {R('coalesce(max(CASE WHEN filled - z > 1e-6 THEN filled - z END), 0)')} AS max_change,
  {R('count(*) FILTER (filled - z > 1e-6) / count(*) * 100.0')} AS pct_modified FROM fl GROUP BY raster_id""", recursive=True)
def fill_stats(spark, sf):
    s = L.fill_stats(_filled(spark, sf))
    for c in ("orig_mean", "cond_mean", "max_change", "pct_modified"):
        s = s.withColumn(c, rounded(F.col(c)))
    return s
