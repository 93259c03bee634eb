"""Scalar functions over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.functions import scalars as S
from terraflow.plans import sqltext as T
from terraflow.plans.registry import query
from terraflow.sources.views import table, view

R = T.r


def _dams_at(spark, sf):
    """Dams with decimal coordinates, null where unreadable."""
    d = view(spark, sf, "dams_raw")
    return d.select(
        "pos", S.parse_dms(F.col("longitude")).alias("lon"), S.parse_dms(F.col("latitude")).alias("lat")
    )


@query("parse_dms", f"""
SELECT pos, {R(T.dms('latitude'), 6)} AS lat, {R(T.dms('longitude'), 6)} AS lon FROM dams_raw""")
def parse_dms(spark, sf):
    d = view(spark, sf, "dams_raw")
    return d.select(
        "pos",
        S.rounded(S.parse_dms(F.col("latitude"))).alias("lat"),
        S.rounded(S.parse_dms(F.col("longitude"))).alias("lon"),
    )


@query("utm_zone", f"""
WITH spots AS ({T.DAMS_AT}) SELECT pos, {T.utm_zone('lon')} AS zone, {T.utm_epsg('lon', 'lat')} AS epsg FROM spots""")
def utm_zone(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    return _dams_at(spark, sf).select("pos", G.utm_zone(lon).alias("zone"), G.utm_epsg(lon, lat).alias("epsg"))


@query("utm_forward", f"""
WITH spots AS ({T.DAMS_AT}), g AS (SELECT *, {T.utm_epsg('lon', 'lat')} AS epsg FROM spots),
{T.utm_forward_ctes('g')}
SELECT pos, epsg, {R('easting', 3)} AS easting, {R('northing', 3)} AS northing FROM g_fwd""")
def utm_forward(spark, sf):
    lon, lat = F.col("lon"), F.col("lat")
    d = _dams_at(spark, sf).withColumn("epsg", G.utm_epsg(lon, lat))
    e, n = G.utm_forward(lon, lat, F.col("epsg"))
    return d.select("pos", "epsg", S.rounded(e, 3).alias("easting"), S.rounded(n, 3).alias("northing"))


@query("utm_inverse", f"""
WITH g AS (SELECT pos, 32601 + pos % 60 + 100 * (pos % 2) AS epsg,
                  CAST(200000 + (pos * 7919) % 600000 AS DOUBLE) AS easting,
                  CAST(500000 + (pos * 104729) % 8000000 AS DOUBLE) AS northing FROM dams_raw),
{T.utm_inverse_ctes('g')}
SELECT pos, epsg, {R('lon', 8)} AS lon, {R('lat', 8)} AS lat FROM g_inv""")
def utm_inverse(spark, sf):
    d = view(spark, sf, "dams_raw").selectExpr(
        "pos",
        "32601 + pos % 60 + 100 * (pos % 2) AS epsg",
        "CAST(200000 + (pos * 7919) % 600000 AS DOUBLE) AS easting",
        "CAST(500000 + (pos * 104729) % 8000000 AS DOUBLE) AS northing",
    )
    lon, lat = G.utm_inverse(F.col("easting"), F.col("northing"), F.col("epsg"))
    return d.select("pos", "epsg", S.rounded(lon, 8).alias("lon"), S.rounded(lat, 8).alias("lat"))


@query("degree_metres", f"""
WITH m AS (SELECT *, north - height * res_y / 2 AS mid FROM rasters)
SELECT raster_id, {R('abs(res_x) * 111320.0 * cos(radians(mid))', 6)} AS cell_x_m,
       {R('abs(res_y) * 110540.0', 6)} AS cell_y_m,
       {R('abs(res_x) * 111.32 * cos(radians(mid))', 6)} AS cell_x_km, {R('abs(res_y) * 111.32', 6)} AS cell_y_km
FROM m""")
def degree_metres(spark, sf):
    mid = G.mid_latitude(F.col("north"), F.col("height"), F.col("res_y"))
    mx, my = G.cell_metres(F.col("res_x"), F.col("res_y"), mid)
    kx, ky = G.cell_km(F.col("res_x"), F.col("res_y"), mid)
    return view(spark, sf, "rasters").select(
        "raster_id",
        S.rounded(mx).alias("cell_x_m"), S.rounded(my).alias("cell_y_m"),
        S.rounded(kx).alias("cell_x_km"), S.rounded(ky).alias("cell_y_km"),
    )


@query("equirect_xy", f"""
WITH spots AS ({T.DAMS_AT}),
xy AS (SELECT pos, lon, lat, 6371000.0::DOUBLE * cos(radians(lat)) * radians(lon) AS x,
              6371000.0::DOUBLE * radians(lat) AS y FROM spots)
SELECT pos, {R('x', 3)} AS x_m, {R('y', 3)} AS y_m,
       {R('degrees(x / (6371000.0::DOUBLE * cos(radians(lat))))', 8)} AS lon_back,
       {R('degrees(y / 6371000.0::DOUBLE)', 8)} AS lat_back FROM xy""")
def equirect_xy(spark, sf):
    lat = F.col("lat")
    x, y = G.equirect_xy(F.col("lon"), lat, lat)
    lon_b, lat_b = G.equirect_lonlat(F.col("x"), F.col("y"), lat)
    return _dams_at(spark, sf).withColumns({"x": x, "y": y}).select(
        "pos", S.rounded(F.col("x"), 3).alias("x_m"), S.rounded(F.col("y"), 3).alias("y_m"),
        S.rounded(lon_b, 8).alias("lon_back"), S.rounded(lat_b, 8).alias("lat_back"),
    )


@query("metres_to_model", f"""
SELECT pos, {R('dm_length * 0.02::DOUBLE', 6)} AS length_model, {R('ht_found * 0.02::DOUBLE', 6)} AS height_model
FROM dams_raw""")
def metres_to_model(spark, sf):
    return view(spark, sf, "dams_raw").select(
        "pos",
        S.rounded(S.metres_to_model(F.col("dm_length"))).alias("length_model"),
        S.rounded(S.metres_to_model(F.col("ht_found"))).alias("height_model"),
    )


@query("scaled_geometry", f"""
WITH s AS (SELECT run_id, dam_id, CAST(1 + seconds % 100 AS DOUBLE) AS level FROM runs),
d AS (SELECT concat('D', CAST(pos AS VARCHAR)) AS dam_id, ht_found, frl, coalesce(frl, ht_found, 1.0::DOUBLE) AS ref
      FROM dams_raw),
h AS (SELECT run_id, greatest(0.05::DOUBLE, ref * level / 100 * 0.02::DOUBLE) AS water_height,
             greatest(0.1::DOUBLE, (CASE WHEN ht_found <> 0 THEN ht_found ELSE ref END) * 0.02::DOUBLE) AS dam_height
      FROM s JOIN d USING (dam_id)),
w AS (SELECT *, greatest(0.1::DOUBLE, dam_height * 0.3::DOUBLE) AS dam_width FROM h)
SELECT run_id, {R('water_height', 6)} AS water_height, {R('dam_height', 6)} AS dam_height,
       {R('dam_width', 6)} AS dam_width, {R('greatest(1.6::DOUBLE, dam_height * 8)', 6)} AS channel_length,
       {R('greatest(0.67::DOUBLE, dam_width * 4)', 6)} AS channel_width,
       {R('greatest(0.4::DOUBLE, dam_height * 1.5::DOUBLE)', 6)} AS channel_height FROM w""")
def scaled_geometry(spark, sf):
    runs = view(spark, sf, "runs").selectExpr("run_id", "dam_id", "CAST(1 + seconds % 100 AS DOUBLE) AS level")
    dams = view(spark, sf, "dams_raw").selectExpr("concat('D', CAST(pos AS STRING)) AS dam_id", "ht_found", "frl")
    dims = S.scaled_geometry(F.col("ht_found"), F.col("frl"), F.col("level"))
    return runs.join(dams, "dam_id").select("run_id", *[S.rounded(c).alias(n) for n, c in dims.items()])


@query("level_to_depth", f"""
SELECT run_id, 1 + seconds % 100 AS level_percent,
       CASE WHEN 1 + seconds % 100 <> 100
            THEN round((0.5::DOUBLE + (run_id % 4) * 0.5::DOUBLE) * CAST(1 + seconds % 100 AS DOUBLE) / 100, 4)
            ELSE 0.5::DOUBLE + (run_id % 4) * 0.5::DOUBLE END AS depth FROM runs""")
def level_to_depth(spark, sf):
    runs = view(spark, sf, "runs").selectExpr(
        "run_id", "1 + seconds % 100 AS level_percent", "CAST(0.5 AS DOUBLE) + (run_id % 4) * CAST(0.5 AS DOUBLE) AS ref"
    )
    depth = S.level_to_depth(F.col("ref"), F.col("level_percent").cast("double"))
    return runs.select("run_id", "level_percent", depth.alias("depth"))


@query("expected_frames", """
SELECT run_id, CAST(floor(CAST(seconds AS DOUBLE) / (CASE WHEN run_id % 5 = 0 THEN 0.05::DOUBLE
       ELSE CAST(run_id % 5 AS DOUBLE) / 16 END) + 1e-9) AS BIGINT) + 1 AS frames FROM runs""")
def expected_frames(spark, sf):
    runs = view(spark, sf, "runs").selectExpr(
        "run_id", "CAST(seconds AS DOUBLE) AS sim", "CAST(run_id % 5 AS DOUBLE) / 16 AS out"
    )
    return runs.select("run_id", S.expected_frames(F.col("sim"), F.col("out")).alias("frames"))


@query("slugify", f"SELECT page_id, {T.slug('url')} AS slug FROM pages")
def slugify(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))


@query("case_name", f"""
WITH s AS (SELECT page_id, {T.slug('url')} AS slug FROM pages),
n AS (SELECT page_id, slug, regexp_replace(array_to_string(list_transform(
        list_filter(regexp_split_to_array(slug, '[-_]+'), lambda x: x <> ''),
        lambda x: concat(upper(x[1:1]), lower(x[2:]))), ''), '[^A-Za-z0-9_]', '', 'g') AS name FROM s)
SELECT page_id, slug, CASE WHEN name = '' THEN 'Site' ELSE name END AS case_name FROM n""")
def case_name(spark, sf):
    return (
        table(spark, sf, "pages")
        .select("page_id", S.slugify(F.col("url")).alias("slug"))
        .withColumn("case_name", S.case_name(F.col("slug")))
    )


@query("clean_number", """
WITH t AS (SELECT run_id, line_no, line, CASE WHEN line LIKE '00005%' THEN regexp_extract(line, '([0-9,]+) +432$', 1)
                  ELSE line END AS raw FROM run_log)
SELECT run_id, line_no, TRY_CAST(trim(replace(raw, ',', '')) AS DOUBLE) AS value FROM t""")
def clean_number(spark, sf):
    raw = F.when(F.col("line").startswith("00005"), F.regexp_extract("line", "([0-9,]+) +432$", 1)).otherwise(
        F.col("line")
    )
    return view(spark, sf, "run_log").select("run_id", "line_no", S.number_or_null(raw).alias("value"))


_FMT_VALUE = """CASE WHEN o_orderkey % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 89 = 0 THEN CAST(0 AS DOUBLE)
  WHEN o_orderkey % 3 = 0 THEN o_totalprice / CAST(7 AS DOUBLE)
  WHEN o_orderkey % 3 = 1 THEN -o_totalprice / CAST(70000000 AS DOUBLE) ELSE o_totalprice / CAST(7000 AS DOUBLE) END"""


@query("fmt_number", f"""
WITH v AS (SELECT o_orderkey, {_FMT_VALUE} AS v FROM orders)
SELECT o_orderkey, CASE WHEN isnan(v) OR isinf(v) THEN '—'
  WHEN v <> 0 AND abs(v) < 0.01 THEN regexp_replace(format('{{:.1e}}', v), 'e([+-])0(\\d)$', 'e\\1\\2')
  WHEN abs(v) >= 10000 THEN regexp_replace(format('{{:.2e}}', v), 'e([+-])0(\\d)$', 'e\\1\\2')
  ELSE format('{{:.2f}}', v) END AS text FROM v""")
def fmt_number(spark, sf):
    v = F.expr(_FMT_VALUE)
    return table(spark, sf, "orders").select("o_orderkey", S.fmt_number(v).alias("text"))


@query("speed_color", f"""
WITH p AS (SELECT idp, run_id, frame, greatest(0::DOUBLE, least(1::DOUBLE, sqrt(vx*vx+vy*vy+vz*vz))) AS x FROM particles)
SELECT idp, run_id, frame,
 {R('CASE WHEN x < 0.33 THEN 40 + 60 * (x / 0.33::DOUBLE) WHEN x < 0.66 THEN 100 + 155 * ((x - 0.33::DOUBLE) / 0.33::DOUBLE) ELSE 255 END', 4)} AS red,
 {R('CASE WHEN x < 0.33 THEN 90 + 150 * (x / 0.33::DOUBLE) WHEN x < 0.66 THEN 240 - 20 * ((x - 0.33::DOUBLE) / 0.33::DOUBLE) ELSE 220 - 150 * ((x - 0.66::DOUBLE) / 0.34::DOUBLE) END', 4)} AS green,
 {R('CASE WHEN x < 0.33 THEN 230 - 40 * (x / 0.33::DOUBLE) WHEN x < 0.66 THEN 190 - 160 * ((x - 0.33::DOUBLE) / 0.33::DOUBLE) ELSE 30 - 20 * ((x - 0.66::DOUBLE) / 0.34::DOUBLE) END', 4)} AS blue
FROM p""")
def speed_color(spark, sf):
    rgb = S.speed_color(S.speed(F.col("vx"), F.col("vy"), F.col("vz")))
    return (
        view(spark, sf, "particles")
        .select("idp", "run_id", "frame", rgb.alias("rgb"))
        .select("idp", "run_id", "frame",
                *[S.rounded(F.col("rgb")[i], 4).alias(n) for i, n in enumerate(("red", "green", "blue"))])
    )


@query("elevation_color", """
WITH b AS (SELECT raster_id, min(z) AS lo, max(z) AS hi FROM cells GROUP BY raster_id),
t AS (SELECT c.raster_id, row_idx, col_idx, (z - lo) / (CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END) AS t
      FROM cells c JOIN b ON c.raster_id = b.raster_id WHERE z IS NOT NULL)
SELECT raster_id, row_idx, col_idx, CAST(floor(58 + t * 150 + 0.5::DOUBLE) AS BIGINT) AS red,
       CAST(floor(50 + t * 135 + 0.5::DOUBLE) AS BIGINT) AS green,
       CAST(floor(40 + t * 115 + 0.5::DOUBLE) AS BIGINT) AS blue FROM t""")
def elevation_color(spark, sf):
    cells = view(spark, sf, "cells").filter("z IS NOT NULL")
    ends = cells.groupBy("raster_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    rgb = S.elevation_color(F.col("z"), F.col("lo"), F.col("hi"))
    return (
        cells.join(ends, "raster_id")
        .select("raster_id", "row_idx", "col_idx", rgb.alias("rgb"))
        .select("raster_id", "row_idx", "col_idx",
                *[F.col("rgb")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))])
    )


_NOW = "TIMESTAMP '2024-01-30 23:58:00'"


@query("time_ago", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts END AS seen FROM events),
d AS (SELECT event_id, seen, (epoch_us({_NOW}) - epoch_us(seen)) / 1e6 AS delta FROM e)
SELECT event_id, CASE WHEN seen IS NULL THEN '—' WHEN delta < 60 THEN 'just now'
  WHEN delta < 3600 THEN concat(CAST(CAST(floor(delta / 60) AS BIGINT) AS VARCHAR), ' min ago')
  WHEN delta < 86400 THEN concat(CAST(CAST(floor(delta / 3600) AS BIGINT) AS VARCHAR), ' h ago')
  ELSE strftime(seen, '%-m/%-d/%Y') END AS text FROM d""")
def time_ago(spark, sf):
    at = F.when(F.col("event_id") % 41 != 0, F.col("ts").cast("timestamp"))
    now = F.expr(_NOW)
    return table(spark, sf, "events").select("event_id", S.time_ago(at, now).alias("text"))


@query("duration_text", """
SELECT run_id, CASE WHEN seconds < 60 THEN concat(CAST(seconds AS VARCHAR), '.0 s')
  ELSE concat(CAST(seconds // 60 AS VARCHAR), 'm ', CAST(seconds % 60 AS VARCHAR), 's') END AS text FROM runs""")
def duration_text(spark, sf):
    return view(spark, sf, "runs").select("run_id", S.duration_text(F.col("seconds")).alias("text"))


_CLOCK = """SELECT run_id,
  CASE WHEN run_id % 9 = 0 THEN 'soon' ELSE concat(CAST(CAST(created_at AS DATE) AS VARCHAR(20)), 'T08:00:00') END AS started,
  CASE WHEN run_id % 10 = 0 THEN NULL ELSE concat(CAST(CAST(created_at AS DATE) AS VARCHAR(20)), 'T09:',
       lpad(CAST(seconds % 60 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(run_id % 60 AS VARCHAR(20)), 2, '0'), '.25') END AS finished
  FROM {runs}"""


@query("elapsed_seconds", f"""
WITH k AS ({_CLOCK.format(runs='runs')})
SELECT run_id, round((epoch_us(TRY_CAST(finished AS TIMESTAMP)) - epoch_us(TRY_CAST(started AS TIMESTAMP))) / 1e6, 3)
       AS seconds FROM k""")
def elapsed_seconds(spark, sf):
    clock = spark.sql(_CLOCK.format(runs="{runs}"), runs=view(spark, sf, "runs"))
    return clock.select("run_id", S.elapsed_seconds(F.col("started"), F.col("finished")).alias("seconds"))


@query("speed_magnitude", f"""
SELECT idp, run_id, frame, {R('CASE WHEN idp % 17 = 0 THEN 0 ELSE sqrt(vx*vx + vy*vy + vz*vz) END', 6)} AS speed
FROM particles""")
def speed_magnitude(spark, sf):
    p = view(spark, sf, "particles").withColumn("vx", F.when(F.col("idp") % 17 != 0, F.col("vx")))
    return p.select("idp", "run_id", "frame", S.rounded(S.speed(F.col("vx"), F.col("vy"), F.col("vz"))).alias("speed"))


@query("exposure_status", """
SELECT c_custkey, CASE WHEN c_acctbal * 3 > 10000 THEN 'critical' ELSE 'normal' END AS population_status,
       CASE WHEN c_custkey % 3 > 0 THEN 'warning' ELSE 'normal' END AS hospital_status,
       CASE WHEN c_custkey % 4 <> 1 AND c_custkey % 4 > 0 THEN 'warning' ELSE 'normal' END AS school_status FROM customer""")
def exposure_status(spark, sf):
    c = table(spark, sf, "customer")
    labels = S.exposure_status(
        F.col("c_acctbal") * 3, F.col("c_custkey") % 3,
        F.when(F.col("c_custkey") % 4 != 1, F.col("c_custkey") % 4),
    )
    return c.select("c_custkey", *[v.alias(k) for k, v in labels.items()])
