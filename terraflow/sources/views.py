"""Input tables derived from the driver tables.

Each view is a SELECT that Spark and DuckDB both parse, so a query and its
check start from the same rows. Elevations are integer millimetres up to one
final division, so no float sum depends on partitioning.

The number of rasters, dams, runs and log lines grows with the driver tables:
one raster per 50 suppliers, one dam per supplier, one run per order, one log
per event user.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflow.operators.ordered import number_rows
from terraflow.session import shuffled

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {}
_SPARK_FORM: dict[str, str] = {}


def each(alias: str, columns: str, rows: list[str]) -> str:
    """Repeat every row once per entry of a short fixed list.

    The checking SQL joins a VALUES list; Spark explodes an array of structs in
    place, which needs no join.
    """
    text = f"CROSS JOIN (VALUES {', '.join(f'({r})' for r in rows)}) AS {alias}({columns})"
    _SPARK_FORM[text] = f"LATERAL VIEW inline(array({', '.join(f'struct({r})' for r in rows)})) {alias} AS {columns}"
    return text


# z NULL = nodata; cells that have no row count as nodata too.
VIEWS["cells"] = """
SELECT raster_id, row_idx, col_idx, z_mm,
       CASE WHEN ln % 37 = 0 THEN NULL ELSE CAST(z_mm AS DOUBLE) / CAST(1000 AS DOUBLE) END AS z
FROM (SELECT raster_id, row_idx, col_idx, ln,
             CAST(40000 + 1500*abs(col_idx-32) + 750*(63-row_idx) + (q*37) % 4000 AS BIGINT) AS z_mm
      FROM (SELECT CAST(floor(CAST(l_suppkey AS DOUBLE) / CAST(50 AS DOUBLE)) AS INT) AS raster_id,
                   CAST(l_orderkey % 64 AS INT) AS row_idx,
                   CAST(l_partkey % 64 AS INT)  AS col_idx,
                   CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
                   CAST(SUM(l_linenumber) AS BIGINT) AS ln
            FROM lineitem GROUP BY 1, 2, 3) g) h"""

VIEWS["rasters"] = """
SELECT raster_id, 4326 AS epsg, 64 AS width, 64 AS height, 1 AS band_count,
       CAST(70 AS DOUBLE) + CAST(raster_id % 200 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS west,
       CAST(11.66 AS DOUBLE) + CAST(floor(CAST(raster_id AS DOUBLE) / CAST(200 AS DOUBLE)) % 600 AS DOUBLE)
           * CAST(0.1 AS DOUBLE) AS north,
       CAST(1 AS DOUBLE) / CAST(3600 AS DOUBLE) AS res_x,
       CAST(1 AS DOUBLE) / CAST(3600 AS DOUBLE) AS res_y,
       CAST(-9999 AS DOUBLE) AS nodata
FROM (SELECT DISTINCT CAST(floor(CAST(l_suppkey AS DOUBLE) / CAST(50 AS DOUBLE)) AS INT) AS raster_id
      FROM lineitem) r"""

# A band as it is read from a file: nodata value, NaN and infinities still in it.
VIEWS["raw_cells"] = """
SELECT raster_id, row_idx, col_idx,
       CASE WHEN z IS NULL AND z_mm % 3 = 0 THEN CAST(-9999 AS DOUBLE)
            WHEN z IS NULL AND z_mm % 3 = 1 THEN CAST('NaN' AS DOUBLE)
            WHEN z IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE z END AS z
FROM cells"""

VIEWS["particles"] = """
SELECT CAST(l_suppkey % 3 AS INT) AS run_id, CAST(l_orderkey % 40 AS INT) AS frame,
       l_orderkey * 10 + l_linenumber AS idp,
       l_extendedprice / CAST(10000 AS DOUBLE) AS x, l_quantity / CAST(5 AS DOUBLE) AS y,
       l_discount * CAST(20 AS DOUBLE) AS z, l_tax * CAST(10 AS DOUBLE) AS vx,
       (l_quantity - 25) / CAST(50 AS DOUBLE) AS vy, -l_discount AS vz
FROM lineitem WHERE NOT (l_suppkey % 3 = 1 AND l_orderkey % 40 = 17)"""

# Run 2 lacks part 39, so its times fall back.
VIEWS["frame_times"] = """
SELECT DISTINCT CAST(l_suppkey % 3 AS INT) AS run_id, CAST(l_orderkey % 40 AS INT) AS part,
       CAST(l_orderkey % 40 AS DOUBLE) * CAST(0.05 AS DOUBLE) AS time_s
FROM lineitem WHERE NOT (l_suppkey % 3 = 2 AND l_orderkey % 40 = 39)"""

# One row per run: frame files on disk, output interval, particle spacing, flow direction.
VIEWS["run_setup"] = """
SELECT CAST(l_suppkey % 3 AS INT) AS run_id, CAST(MAX(l_orderkey % 40) AS INT) + 1 AS frame_files,
       CASE WHEN l_suppkey % 3 = 2 THEN CAST(0.04 AS DOUBLE) END AS time_out,
       CASE WHEN l_suppkey % 3 <> 1 THEN CAST(0.1 AS DOUBLE) END AS dp,
       CASE WHEN l_suppkey % 3 = 1 THEN 'y' ELSE 'x' END AS flow_axis,
       CASE WHEN l_suppkey % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS upstream_sign,
       CASE WHEN l_suppkey % 3 <> 2 THEN CAST(2 AS DOUBLE) END AS dam_center,
       CAST(MAX(l_linenumber) AS BIGINT) AS parts_out
FROM lineitem GROUP BY l_suppkey % 3"""

VIEWS["dams_raw"] = """
SELECT s_suppkey AS pos,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL WHEN s_suppkey % 10 = 7 THEN ''
            ELSE concat('D', CAST(s_suppkey AS VARCHAR(20))) END AS PIC,
       s_name AS dm_name, n_name AS river, r_name AS state,
       concat('District ', CAST(s_suppkey % 7 AS VARCHAR(20))) AS district,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(20 + s_suppkey % 180 AS DOUBLE) END AS ht_found,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 500 AS DOUBLE) END AS frl,
       concat('Office ', CAST(s_suppkey % 3 AS VARCHAR(20))) AS sdso,
       concat('Engineer ', CAST(s_suppkey % 5 AS VARCHAR(20))) AS incharge,
       CAST(1950 + s_suppkey % 70 AS INT) AS cmp_year,
       concat('Basin ', CAST(s_suppkey % 9 AS VARCHAR(20))) AS basin,
       CAST(s_suppkey % 510 AS DOUBLE) AS mx_wt_lel,
       CAST(s_suppkey % 900 AS DOUBLE) AS gs_st_cap, CAST(s_suppkey % 90 AS DOUBLE) AS ds_sp_cap,
       CAST(50 + s_suppkey % 400 AS DOUBLE) AS dm_length,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Earthen' ELSE 'Gravity' END AS dm_type,
       'Irrigation' AS purpose,
       CASE WHEN s_suppkey % 19 = 5 THEN 'unknown' ELSE
       concat(CAST(8 + s_suppkey % 25 AS VARCHAR(20)), '° ', CAST((s_suppkey*7) % 60 AS VARCHAR(20)), ''' ',
              CAST((s_suppkey*13) % 60 AS VARCHAR(20)), '.5" ',
              CASE WHEN s_suppkey % 5 = 1 THEN 'S' ELSE 'N' END) END AS latitude,
       CASE WHEN s_suppkey % 8 = 2 THEN concat(CAST(70 + s_suppkey % 25 AS VARCHAR(20)), '°') ELSE
       concat(CAST(70 + s_suppkey % 25 AS VARCHAR(20)), '° ', CAST((s_suppkey*11) % 60 AS VARCHAR(20)), ''' ',
              CAST((s_suppkey*17) % 60 AS VARCHAR(20)), '.25" E') END AS longitude
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

# Dam position on its raster; the cell may be nodata.
VIEWS["dam_anchors"] = """
SELECT s_suppkey AS dam_pos,
       CAST(floor(CAST(s_suppkey AS DOUBLE) / CAST(50 AS DOUBLE)) AS INT) AS raster_id,
       CAST((s_suppkey*5 + 3) % 64 AS INT) AS row_idx, CAST((s_suppkey*3 + 7) % 64 AS INT) AS col_idx
FROM supplier"""

VIEWS["anchors_on_land"] = """
SELECT a.dam_pos, a.raster_id, a.row_idx, a.col_idx, c.z
FROM dam_anchors a JOIN cells c
  ON a.raster_id = c.raster_id AND a.row_idx = c.row_idx AND a.col_idx = c.col_idx
WHERE c.z IS NOT NULL"""

VIEWS["runs"] = """
SELECT o_orderkey AS run_id, concat('D', CAST(o_custkey % 100 AS VARCHAR(20))) AS dam_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) % 7200 AS seconds,
       concat('runs/', CAST(o_orderkey % 5000 AS VARCHAR(20))) AS run_dir,
       CASE WHEN o_orderkey % 4 = 0 THEN 'runner' ELSE 'web' END AS source,
       o_custkey AS scenario_no
FROM orders"""

VIEWS["run_steps"] = """
SELECT l_orderkey AS run_id, l_linenumber AS ordinal,
       CASE l_linenumber % 4 WHEN 0 THEN 'terrain' WHEN 1 THEN 'sph' WHEN 2 THEN 'case' ELSE 'post' END AS stage,
       CASE l_returnflag WHEN 'A' THEN 'skipped' WHEN 'N' THEN 'executed' ELSE 'failed' END AS status,
       CAST(l_quantity AS BIGINT) AS duration_ds
FROM lineitem"""

# (event time, event id) order the lines of one log.
VIEWS["log_events"] = """
SELECT user_id AS run_id, event_id, ts,
       CASE event_type
         WHEN 'view'     THEN CASE WHEN event_id % 5 = 0 THEN '→ Generate terrain STL ...'
                                   WHEN event_id % 131 = 7 THEN '       RUN COMPLETE'
                                   ELSE '→ Condition DEM ...' END
         WHEN 'click'    THEN CASE WHEN event_id % 7 = 0 THEN '[Time: 0.01] x Np: 3906'
                                   WHEN event_id % 7 = 1 THEN 'Particles out: 41 (total out: 1,041)'
                                   ELSE '✓ Condition DEM (0.3s)' END
         WHEN 'signup'   THEN CASE WHEN event_id % 6 = 0 THEN '✗ Generate terrain STL — FAILED'
                                   WHEN event_id % 6 = 1 THEN '   '
                                   ELSE '↷ Generate flood domain — already exists, skipping' END
         WHEN 'error'    THEN CASE WHEN event_id % 4 = 0 THEN 'Step: Condition DEM'
                                   ELSE concat('Error: code ', CAST(event_id % 9 AS VARCHAR(20))) END
         ELSE concat('00005   0.25   361   74   ', CAST(event_id % 58 AS VARCHAR(20)), ',007   432') END AS line
FROM events"""

VIEWS["run_log"] = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS BIGINT) AS line_no, line
FROM log_events"""

VIEWS["terrain_points"] = """
SELECT raster_id AS site_id, row_idx * 64 + col_idx AS pt_id, col_idx AS ix, 63 - row_idx AS iy,
       CAST(col_idx AS DOUBLE) * CAST(30 AS DOUBLE) AS x_m,
       CAST(63 - row_idx AS DOUBLE) * CAST(30 AS DOUBLE) AS y_m,
       z AS elevation_m,
       CAST(col_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS x, CAST(63 - row_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS y,
       z / CAST(50 AS DOUBLE) AS z
FROM cells WHERE z IS NOT NULL"""

VIEWS["sites"] = """
SELECT dam_pos AS dam_id, raster_id AS site_id,
       CAST(col_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS dam_x,
       CAST(63 - row_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS dam_y
FROM anchors_on_land"""

VIEWS["scenarios"] = """
SELECT c_custkey AS scenario_no,
       CASE WHEN c_custkey % 50 = 9 THEN 'local'
            WHEN c_custkey % 50 = 10 THEN concat('local.', CAST(c_custkey AS VARCHAR(20)))
            WHEN c_custkey % 50 = 11 THEN concat('s', CAST(c_custkey AS VARCHAR(20)), '.example')
            ELSE concat('s', CAST(c_custkey AS VARCHAR(20))) END AS name,
       c_name AS display_name, concat('D', CAST(c_custkey % 120 AS VARCHAR(20))) AS dam_id,
       CASE WHEN c_custkey % 3 = 0 THEN concat('cannot load ', c_name) END AS error
FROM customer"""

# Base settings of every scenario. kind: n = number, b = bool, s = string, z = null.
VIEWS["base_config"] = f"""
SELECT c_custkey AS scenario_no, k.key AS key, k.kind AS kind,
       CASE k.kind WHEN 'n' THEN CAST(k.v + CAST(c_custkey % 4 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS VARCHAR(30))
                   WHEN 'b' THEN 'true' WHEN 's' THEN 'text' END AS value
FROM customer {each("k", "key, kind, v", [
    "'reservoir_water_depth', 'n', CAST(0.5 AS DOUBLE)", "'particle_spacing', 'n', CAST(0.25 AS DOUBLE)",
    "'simulation_time', 'n', CAST(6 AS DOUBLE)", "'time_out', 'n', CAST(0.25 AS DOUBLE)",
    "'breach_width', 'n', CAST(1 AS DOUBLE)", "'breach_time', 'n', CAST(0.25 AS DOUBLE)",
    "'reservoir_segments', 'n', CAST(6 AS DOUBLE)", "'breach_enabled', 'b', CAST(0 AS DOUBLE)",
    "'case_name', 's', CAST(0 AS DOUBLE)", "'force_upstream_axis', 'z', CAST(0 AS DOUBLE)"])}"""

# At most one override per (scenario, key); some keys are unknown to the base settings.
VIEWS["overrides"] = """
SELECT scenario_no, key, substr(MAX(concat(kind, value)), 2) AS value, substr(MAX(concat(kind, value)), 1, 1) AS kind FROM (
  SELECT o_custkey AS scenario_no,
         CASE o_orderkey % 12 WHEN 0 THEN 'reservoir_water_depth' WHEN 1 THEN 'particle_spacing'
           WHEN 2 THEN 'simulation_time' WHEN 3 THEN 'time_out' WHEN 4 THEN 'breach_width'
           WHEN 5 THEN 'breach_time' WHEN 6 THEN 'reservoir_segments' WHEN 7 THEN 'breach_enabled'
           WHEN 8 THEN 'case_name' WHEN 9 THEN 'force_upstream_axis' WHEN 10 THEN 'colour' ELSE 'gate' END AS key,
         CASE WHEN o_orderkey % 5 = 4 THEN 'true'
              ELSE CAST(CAST((o_orderkey * 7) % 4000 AS DOUBLE) / CAST(16 AS DOUBLE) AS VARCHAR(30)) END AS value,
         CASE WHEN o_orderkey % 5 = 4 THEN 'b' ELSE 'n' END AS kind
  FROM orders WHERE o_orderkey % 5 < 3 OR o_orderkey % 5 = 4) t
GROUP BY scenario_no, key"""

# Terrain settings of scenarios: numbers over a wide range, some of the wrong type.
VIEWS["terrain_settings"] = f"""
SELECT c_custkey AS scenario_no, k.section AS section, k.key AS key,
       CASE WHEN (c_custkey + k.step) % 9 = 4 THEN 'b' ELSE k.usual END AS kind,
       CASE WHEN (c_custkey + k.step) % 9 = 4 OR k.usual = 'b' THEN 'true' ELSE CAST(CAST((c_custkey * k.step) % 9000 AS DOUBLE) / CAST(4 AS DOUBLE) AS VARCHAR(30)) END AS value
FROM customer {each("k", "section, key, step, usual", [
    "'condition', 'max_fill_depth', 7, 'n'", "'domain', 'corridor_width_km', 1, 'n'", "'sph_terrain', 'target_resolution_m', 5, 'n'",
    "'sph_terrain', 'scale', 1, 'n'", "'mesh', 'max_edge_m', 3, 'n'", "'mesh', 'preview', 2, 'b'", "'sph_terrain', 'csv', 6, 'n'"])}"""

# What a step recorded, and what is on disk now.
VIEWS["recorded_prints"] = """
SELECT l_orderkey AS step_id, CASE WHEN l_linenumber % 2 = 0 THEN 'input' ELSE 'output' END AS kind,
       l_linenumber AS ordinal, concat('f', CAST(l_partkey AS VARCHAR(20))) AS path,
       l_suppkey * 1000 AS mtime_ns, CAST(l_quantity AS BIGINT) AS size
FROM (SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey, MAX(l_suppkey) AS l_suppkey,
             MAX(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) d"""

VIEWS["current_prints"] = """
SELECT step_id, kind, ordinal, path,
       CASE WHEN mtime_ns % 7000 = 0 THEN mtime_ns + 1 ELSE mtime_ns END AS mtime_ns, size
FROM recorded_prints WHERE size <> 13"""

VIEWS["step_params"] = """
SELECT o_orderkey AS step_id, CASE WHEN o_orderkey % 11 = 0 THEN 'old' ELSE 'same' END AS recorded_params,
       'same' AS current_params
FROM orders"""

# Raster headers as files carry them; some are not usable.
VIEWS["raster_headers"] = """
SELECT s_suppkey AS header_id, CASE WHEN s_suppkey % 13 = 5 THEN NULL ELSE 4326 END AS epsg,
       CASE WHEN s_suppkey % 7 = 3 THEN 0 ELSE 60 + s_suppkey % 9 END AS width, 64 AS height,
       CASE WHEN s_suppkey % 11 = 2 THEN 0 ELSE 1 END AS band_count,
       CAST(70 AS DOUBLE) + CAST(s_suppkey % 90 AS DOUBLE) / CAST(4 AS DOUBLE) AS west,
       CAST(11.5 AS DOUBLE) AS north, CAST(1 AS DOUBLE) / CAST(4096 AS DOUBLE) AS res_x,
       CAST(1 AS DOUBLE) / CAST(4096 AS DOUBLE) AS res_y, CAST(-9999 AS DOUBLE) AS nodata
FROM supplier"""

# Points in and around rasters; some lie exactly on the raster edges.
VIEWS["probe_points"] = """
SELECT p.point_id, p.raster_id,
       r.west + (CASE WHEN point_id % 10 = 0 THEN CAST((point_id * 32) % 96 AS DOUBLE)
                      ELSE CAST(point_id % 70 AS DOUBLE) - CAST(2.75 AS DOUBLE) END) * r.res_x AS lon,
       r.north - (CASE WHEN point_id % 15 = 0 THEN CAST((point_id * 32) % 96 AS DOUBLE)
                       ELSE CAST((point_id * 3) % 69 AS DOUBLE) - CAST(2.25 AS DOUBLE) END) * r.res_y AS lat
FROM (SELECT l_orderkey AS point_id,
             MIN(CAST(floor(CAST(l_suppkey AS DOUBLE) / CAST(50 AS DOUBLE)) AS INT)) AS raster_id
      FROM lineitem GROUP BY l_orderkey) p JOIN rasters r ON p.raster_id = r.raster_id"""

# Requests for a new site; coordinates may be missing, half given or out of range.
VIEWS["site_requests"] = """
SELECT o_orderkey AS request_id, CAST((o_orderkey * 7) % 1600 AS DOUBLE) / CAST(4 AS DOUBLE) - 200 AS lon,
       CAST((o_orderkey * 11) % 800 AS DOUBLE) / CAST(4 AS DOUBLE) - 100 AS lat,
       CASE WHEN o_orderkey % 4 < 2 THEN CAST((o_orderkey * 5) % 1500 AS DOUBLE) / CAST(4 AS DOUBLE) - 187 END AS dam_lon,
       CASE WHEN o_orderkey % 8 < 3 THEN CAST((o_orderkey * 3) % 760 AS DOUBLE) / CAST(4 AS DOUBLE) - 95 END AS dam_lat,
       CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'Y' WHEN 2 THEN 'z' END AS axis,
       CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 2 END AS sign
FROM orders"""

# Files found under the run folders.
VIEWS["listing"] = """
SELECT DISTINCT concat('runs/', CAST(l_orderkey % 5000 AS VARCHAR(20)), '/',
       CASE l_linenumber % 3 WHEN 0 THEN 'run.log' WHEN 1 THEN 'metadata.json' ELSE 'case.xml' END) AS path
FROM lineitem WHERE l_returnflag <> 'R'"""

VIEWS["expected_files"] = f"""
SELECT run_id, run_dir, k.role AS role, concat(run_dir, '/', k.file) AS path
FROM runs {each("k", "role, file", ["'run_log', 'run.log'", "'metadata', 'metadata.json'", "'case_xml', 'case.xml'"])}"""

# Top-level settings present in each scenario file.
VIEWS["settings"] = f"""
SELECT c_custkey AS scenario_no, k.key AS key
FROM customer {each("k", "key, every", ["'name', 1", "'dam_id', 1", "'inputs', 1", "'case', 1", "'colour', 6", "'gate', 9"])}
WHERE c_custkey % k.every = 0"""

# The overrides a run was really started with.
VIEWS["run_overrides"] = """
SELECT scenario_no, key, CASE WHEN scenario_no % 4 = 0 THEN concat(value, '0') ELSE value END AS value
FROM overrides WHERE scenario_no % 5 <> 0"""

# Parameters of run requests; null keeps the scenario's own value.
VIEWS["run_requests"] = """
SELECT run_id, CAST(seconds % 120 AS DOUBLE) AS reservoir_level,
       CASE WHEN run_id % 3 <> 0 THEN CAST(seconds % 1100 AS DOUBLE) / CAST(8 AS DOUBLE) END AS breach_width,
       CASE WHEN run_id % 4 <> 0 THEN CAST(seconds * 16 - 900 AS DOUBLE) END AS breach_time,
       CASE WHEN run_id % 5 <> 0 THEN CAST(seconds % 4000 AS DOUBLE) END AS simulation_time,
       CASE WHEN run_id % 6 <> 0 THEN CAST(seconds % 50 AS DOUBLE) / CAST(4 AS DOUBLE) END AS particle_spacing
FROM runs"""

# Axis-aligned boxes around dams, in model units.
VIEWS["dam_boxes"] = f"""
SELECT dam_id, site_id, k.seg AS seg, dam_x + k.dx AS x0, dam_x + k.dx + CAST(2.5 AS DOUBLE) AS x1,
       dam_y + k.dy AS y0, dam_y + k.dy + CAST(1.5 AS DOUBLE) AS y1,
       CAST(0.5 AS DOUBLE) + k.dx / 8 AS z0, CAST(2 AS DOUBLE) + k.dy / 8 AS z1
FROM sites {each("k", "seg, dx, dy", [
    "0, CAST(-3 AS DOUBLE), CAST(-1 AS DOUBLE)", "1, CAST(-0.5 AS DOUBLE), CAST(-1.25 AS DOUBLE)",
    "2, CAST(1.25 AS DOUBLE), CAST(0.5 AS DOUBLE)", "3, CAST(200 AS DOUBLE), CAST(0 AS DOUBLE)"])}"""

# A simple plan for every dam: where water stands, how high the crest is, its span.
VIEWS["site_plans"] = """
SELECT dam_pos AS dam_id, raster_id AS site_id, CAST(col_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS dam_x,
       CAST(63 - row_idx AS DOUBLE) * CAST(0.6 AS DOUBLE) AS dam_y, z / CAST(50 AS DOUBLE) AS dam_z,
       CASE WHEN dam_pos % 2 = 0 THEN 'x' ELSE 'y' END AS flow_axis,
       CASE WHEN dam_pos % 3 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS upstream_sign,
       z / CAST(50 AS DOUBLE) + CASE WHEN dam_pos % 4 = 0 THEN CAST(0.06 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS crest_z,
       z / CAST(50 AS DOUBLE) + CAST(0.45 AS DOUBLE) AS water_z,
       CAST(CASE WHEN dam_pos % 2 = 0 THEN 63 - row_idx ELSE col_idx END AS DOUBLE) * CAST(0.6 AS DOUBLE) - CAST(2.1 AS DOUBLE) AS span_start,
       CAST(CASE WHEN dam_pos % 2 = 0 THEN 63 - row_idx ELSE col_idx END AS DOUBLE) * CAST(0.6 AS DOUBLE) + CAST(2.6 AS DOUBLE) AS span_end
FROM anchors_on_land"""

_NAME = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")


def _needed(text: str) -> list[str]:
    """Views used by ``text``, each after the views it is built on."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in dict.fromkeys(_NAME.findall(body)):
            if name not in found and VIEWS[name] is not body:
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def with_views(text: str, recursive: bool = False) -> str:
    """Put the definitions ``text`` needs in front of it."""
    text = text.strip()
    parts = [f"{name} AS ({VIEWS[name]}\n)" for name in _needed(text)]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if text.upper().startswith("WITH "):
        rest = text[5:]
        return head + ",\n".join([*parts, rest]) if parts else head + rest
    return (head + ",\n".join(parts) + "\n" + text) if parts else text


# Lazy DataFrames by (application, folder, name): a query uses the same inputs
# many times, and each fresh read would list files and infer the schema again.
_FRAMES: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _FRAMES:
        _FRAMES[key] = make()
    return _FRAMES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table."""
    return _once(spark, sf_dir, f"table {name}", lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a lazy DataFrame."""
    return _once(spark, sf_dir, name, lambda: _build(spark, sf_dir, name))


def _build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "run_log":
        # One log may hold a third of all lines: number them by hour first.
        lines = view(spark, sf_dir, "log_events").withColumn("hour", F.date_trunc("hour", "ts"))
        return number_rows(lines, ["run_id"], "hour", ["ts", "event_id"], "line_no").select(
            "run_id", "line_no", "line"
        )
    # Views this one is built on come in as DataFrames, like the driver tables.
    text, inputs = VIEWS[name], {}
    for joined, exploded in _SPARK_FORM.items():
        text = text.replace(joined, exploded)
    grows = text != VIEWS[name]
    for source in (*BASE_TABLES, *VIEWS):
        used = re.compile(rf"\b(FROM|JOIN) {source}\b")
        if source != name and used.search(text):
            inputs[source] = (table if source in BASE_TABLES else view)(spark, sf_dir, source)
            text = used.sub(rf"\1 {{{source}}}", text)
    rows = spark.sql(text, **inputs)
    return shuffled(rows) if grows else rows
