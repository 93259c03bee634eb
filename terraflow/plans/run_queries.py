"""Run history, artefacts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions.scalars import expected_frames
from terraflow.operators import logs as G
from terraflow.operators import runs as U
from terraflow.plans.registry import query
from terraflow.sources import files
from terraflow.sources.views import view

_TS = "date_format(created_at, 'yyyy-MM-dd HH:mm:ss')"


def _runs(spark, sf):
    """Runs with the creation time as text, missing for some."""
    return view(spark, sf, "runs").withColumn("created_at", F.expr(f"CASE WHEN run_id % 31 <> 0 THEN {_TS} END"))


_RUNS = """r AS (SELECT run_id, dam_id, status, seconds, run_dir, source, scenario_no,
  CASE WHEN run_id % 31 <> 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS created_at FROM runs)"""


@query("run_status_filter", f"WITH {_RUNS} SELECT run_id, dam_id, status, created_at FROM r WHERE status = 'completed'")
def run_status_filter(spark, sf):
    return U.with_status(_runs(spark, sf), "completed").select("run_id", "dam_id", "status", "created_at")


@query("recent_runs", f"""WITH {_RUNS} SELECT run_id, status, created_at FROM r
ORDER BY coalesce(created_at, '') DESC, run_id LIMIT 6""")
def recent_runs(spark, sf):
    return U.recent(_runs(spark, sf)).select("run_id", "status", "created_at")


@query("discovered_runs", """
SELECT run_id, run_dir FROM runs r WHERE source = 'runner'
AND NOT EXISTS (SELECT 1 FROM runs w WHERE w.source = 'web' AND w.run_dir = r.run_dir)""")
def discovered_runs(spark, sf):
    runs = view(spark, sf, "runs")
    return U.newly_found(runs.filter("source = 'runner'"), runs.filter("source = 'web'")).select("run_id", "run_dir")


@query("run_history", f"""WITH {_RUNS}
SELECT run_id, dam_id, status, created_at, source, seconds, CAST(NULL AS VARCHAR) AS error FROM r WHERE source = 'web'
UNION ALL SELECT run_id, dam_id, status, created_at, source, NULL,
  CASE WHEN status = 'failed' THEN concat('Step failed: ', dam_id) END FROM r WHERE source = 'runner'
  AND NOT EXISTS (SELECT 1 FROM runs w WHERE w.source = 'web' AND w.run_dir = r.run_dir)""")
def run_history(spark, sf):
    runs = _runs(spark, sf)
    web = runs.filter("source = 'web'").select("run_id", "dam_id", "status", "created_at", "source", "run_dir", "seconds")
    disk = runs.filter("source = 'runner'").select(
        "run_id", "dam_id", "status", "created_at", "source", "run_dir",
        F.when(F.col("status") == "failed", F.concat(F.lit("Step failed: "), "dam_id")).alias("error"),
    )
    return U.newest_first(U.history(web, disk)).drop("run_dir")


@query("latest_run", """
SELECT scenario_no, max(run_id) AS run_id, arg_max(run_dir, run_id) AS run_dir, strftime(finished_at, '%Y-%m-%d') AS finished_at
FROM (SELECT *, created_at AS finished_at, rank() OVER (PARTITION BY scenario_no ORDER BY created_at DESC) AS rk
      FROM runs WHERE status = 'completed') q WHERE rk = 1 GROUP BY scenario_no, finished_at""")
def latest_run(spark, sf):
    runs = view(spark, sf, "runs").withColumnRenamed("created_at", "finished_at")
    return U.latest_success(runs).select(
        "scenario_no", "run_id", "run_dir", F.date_format("finished_at", "yyyy-MM-dd").alias("finished_at")
    )


@query("run_paths", """
SELECT e.run_id, concat('run_dir=', max(e.run_dir), coalesce(string_agg(concat(' ', role, '=', e.path), '' ORDER BY role)
       FILTER (l.path IS NOT NULL), '')) AS paths
FROM expected_files e LEFT JOIN listing l ON l.path = e.path GROUP BY e.run_id""")
def run_paths(spark, sf):
    paths = U.existing_paths(view(spark, sf, "expected_files"), view(spark, sf, "listing"))
    rest = F.array_sort(F.filter(F.map_entries("paths"), lambda e: e["key"] != "run_dir"))
    entries = F.concat(F.filter(F.map_entries("paths"), lambda e: e["key"] == "run_dir"), rest)
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return paths.select("run_id", text.alias("paths"))


@query("missing_outputs", """
SELECT run_id, role, path FROM expected_files e WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.path = e.path)""")
def missing_outputs(spark, sf):
    return U.missing_paths(view(spark, sf, "expected_files"), view(spark, sf, "listing")).select("run_id", "role", "path")


# Stage rows of a run: weights in hundredths, progress in quarters.
_STAGES = """SELECT run_id, ordinal, CAST(ordinal * 4 AS DOUBLE) / CAST(100 AS DOUBLE) AS weight,
  CASE status WHEN 'executed' THEN 'done' WHEN 'skipped' THEN 'active' ELSE CASE WHEN ordinal % 2 = 0 THEN 'failed' ELSE 'pending' END END AS status,
  CASE WHEN duration_ds % 5 <> 0 THEN CAST(duration_ds % 4 AS DOUBLE) / CAST(4 AS DOUBLE) END AS progress FROM {s}"""


@query("stage_progress", f"""WITH st AS ({_STAGES.format(s='run_steps')})
SELECT run_id, round(least(0.999::DOUBLE, CAST(coalesce(sum(CASE WHEN status IN ('done', 'failed') THEN CAST(round(weight * 10000) AS BIGINT)
  WHEN status = 'active' THEN CAST(round(weight * 10000 * coalesce(progress, 0)) AS BIGINT) END), 0) AS DOUBLE) / 10000), 4) AS progress
FROM st GROUP BY run_id""")
def stage_progress(spark, sf):
    return U.stage_progress(spark.sql(_STAGES.format(s="{s}"), s=view(spark, sf, "run_steps")))


@query("step_status_summary", """
SELECT run_id, stage, status, count(*) AS steps, CAST(sum(duration_ds) AS BIGINT) AS duration FROM run_steps GROUP BY 1, 2, 3""")
def step_status_summary(spark, sf):
    return U.step_report(view(spark, sf, "run_steps").withColumnRenamed("duration_ds", "duration"))


@query("interrupted_runs", f"""WITH st AS ({_STAGES.format(s='run_steps')}),
r AS (SELECT run_id, CASE WHEN status = 'running' AND run_id % 2 = 0 THEN 'queued' ELSE status END AS status FROM runs)
SELECT r.run_id, CASE WHEN status0 THEN 'failed' ELSE r.status END AS status,
  CASE WHEN status0 THEN 'Interrupted: the backend restarted while this job was running.' END AS error,
  CASE WHEN r.run_id % 3 = 0 THEN '1999-01-01T00:00:00' WHEN status0 THEN '2000-01-01T00:00:00' END AS finished_at, stages
FROM (SELECT *, status IN ('queued', 'running') AS status0 FROM r) r JOIN (
  SELECT st.run_id, string_agg(CASE WHEN st.status = 'active' AND r.status IN ('queued', 'running') THEN 'failed' ELSE st.status END,
         ' ' ORDER BY ordinal, st.status, weight, progress) AS stages
  FROM st JOIN r ON r.run_id = st.run_id GROUP BY st.run_id) g ON g.run_id = r.run_id""")
def interrupted_runs(spark, sf):
    stages = spark.sql(_STAGES.format(s="{s}"), s=view(spark, sf, "run_steps"))
    packed = stages.groupBy("run_id").agg(F.collect_list(F.struct("ordinal", "status", "weight", "progress")).alias("stages"))
    runs = view(spark, sf, "runs").select(
        "run_id",
        F.when((F.col("status") == "running") & (F.col("run_id") % 2 == 0), "queued").otherwise(F.col("status")).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("run_id") % 3 == 0, "1999-01-01T00:00:00").alias("finished_at"),
    ).join(packed.withColumn("stages", F.array_sort("stages")), "run_id")
    done = U.interrupt_active(runs, F.lit("2000-01-01T00:00:00"))
    return done.withColumn("stages", F.array_join(F.transform("stages", lambda s: s["status"]), " "))


@query("solver_log_source", "SELECT run_id, line_no, line FROM run_log")
def solver_log_source(spark, sf):
    """Logs written as text files of many runs and read back in line order."""
    path = files.write_run_logs(view(spark, sf, "run_log"))
    return files.read_log_files(spark, path, named=True)


_STEPS = r"""p AS (SELECT run_id, line_no, trim(line) AS t FROM run_log),
s AS (SELECT run_id, line_no,
  CASE WHEN regexp_matches(t, '^(\d{4,6})\s+([0-9]+(?:\.[0-9]+)?)\s+(\d+)\s+(\d+)\s+([\d,]+)')
       THEN CAST(regexp_extract(t, '^(\d{4,6})\s+([0-9]+(?:\.[0-9]+)?)', 2) AS DOUBLE)
       WHEN regexp_matches(t, '\[(?:Time:\s*)?([0-9.]+)\].*?Np[:=\s]+(\d+)', 'i')
       THEN CAST(regexp_extract(t, '\[(?:Time:\s*)?([0-9.]+)\].*?Np[:=\s]+(\d+)', 1, 'i') AS DOUBLE) END AS time_s,
  CASE WHEN regexp_matches(t, '^(\d{4,6})\s+([0-9]+(?:\.[0-9]+)?)\s+(\d+)\s+(\d+)\s+([\d,]+)')
       THEN CAST(replace(regexp_extract(t, '^(\d{4,6})\s+([0-9]+(?:\.[0-9]+)?)\s+(\d+)\s+(\d+)\s+([\d,]+)', 5), ',', '') AS BIGINT)
       WHEN regexp_matches(t, '\[(?:Time:\s*)?([0-9.]+)\].*?Np[:=\s]+(\d+)', 'i')
       THEN CAST(regexp_extract(t, '\[(?:Time:\s*)?([0-9.]+)\].*?Np[:=\s]+(\d+)', 2, 'i') AS BIGINT) END AS np,
  CASE WHEN starts_with(t, 'Particles out') THEN CAST(replace(regexp_extract(t, 'total out[:=\s]+([\d,]+)', 1), ',', '') AS BIGINT) END AS o
  FROM p),
steps AS (SELECT s.run_id, line_no, time_s, np, coalesce(q.o, 0) AS total_out FROM s LEFT JOIN
  (SELECT run_id, arg_max(o, line_no) AS o FROM s WHERE o IS NOT NULL GROUP BY run_id) q ON q.run_id = s.run_id WHERE time_s IS NOT NULL)"""


@query("log_step_rows", f"WITH {_STEPS} SELECT * FROM steps")
def log_step_rows(spark, sf):
    return G.step_rows(view(spark, sf, "run_log"))


@query("np_delta", f"""WITH {_STEPS} SELECT run_id, line_no, np,
  np - lag(np, 1, np) OVER (PARTITION BY run_id ORDER BY line_no) AS delta_np FROM steps""")
def np_delta(spark, sf):
    return G.count_changes(G.step_rows(view(spark, sf, "run_log"))).select("run_id", "line_no", "np", "delta_np")


@query("immediate_drop", f"""WITH {_STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS rn FROM steps)
SELECT a.run_id, coalesce(b.np < a.np * 0.5, false) AS immediate_drop FROM n a LEFT JOIN n b ON b.run_id = a.run_id AND b.rn = 2
WHERE a.rn = 1""")
def immediate_drop(spark, sf):
    return G.immediate_drop(G.step_rows(view(spark, sf, "run_log")))


_EVENTS = """e AS (SELECT run_id, line_no, trim(line) AS t, CASE left(trim(line), 1) WHEN '→' THEN 'start' WHEN '✓' THEN 'done'
  WHEN '↷' THEN 'skip' WHEN '✗' THEN 'fail' END AS event FROM run_log),
l AS (SELECT run_id, line_no, event, CASE event WHEN 'start' THEN replace(t[3:], ' ...', '')
  WHEN 'done' THEN regexp_replace(t[3:], '\\s*\\([\\d.]+s\\)\\s*$', '') ELSE split_part(t[3:], ' — ', 1) END AS label FROM e
  WHERE event IS NOT NULL),
fin AS (SELECT run_id, min(line_no) AS n FROM run_log WHERE line LIKE '%RUN COMPLETE%' GROUP BY run_id)"""


@query("stage_timeline", f"""WITH {_EVENTS}
SELECT l.run_id, line_no, event, label, CASE label WHEN 'Condition DEM' THEN 'terrain' WHEN 'Generate flood domain' THEN 'terrain'
  WHEN 'Generate terrain STL' THEN 'sph' ELSE CASE WHEN event <> 'fail' THEN 'postprocess' END END AS stage
FROM l LEFT JOIN fin ON fin.run_id = l.run_id WHERE fin.n IS NULL OR line_no < fin.n""")
def stage_timeline(spark, sf):
    return G.stage_timeline(view(spark, sf, "run_log"))


@query("log_error_extract", """
WITH t AS (SELECT run_id, line_no, trim(line) AS t FROM run_log),
b AS (SELECT *, max(CASE WHEN starts_with(t, 'Error:') OR starts_with(t, 'Configuration error:') THEN line_no END)
      OVER (PARTITION BY run_id ORDER BY line_no) AS block FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, block ORDER BY line_no) AS rn FROM b WHERE block IS NOT NULL
      AND (line_no = block OR NOT (starts_with(t, 'Step:') OR starts_with(t, '==========') OR t = ''))),
g AS (SELECT run_id, block, count(*) AS n, string_agg(t, ' · ' ORDER BY line_no) AS error FROM k WHERE rn <= 6 GROUP BY 1, 2),
c AS (SELECT run_id, coalesce(min(block) FILTER (n = 6), max(block)) AS block FROM g GROUP BY run_id)
SELECT g.run_id, error FROM g JOIN c ON c.run_id = g.run_id AND c.block = g.block""")
def log_error_extract(spark, sf):
    return G.error_text(view(spark, sf, "run_log"))


@query("log_tail_n", """
SELECT run_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_no DESC) AS rn FROM run_log) q
WHERE rn <= 15""")
def log_tail_n(spark, sf):
    return G.tail(view(spark, sf, "run_log"))


@query("find_frames", """
SELECT run_id, 'PartFluid_' || lpad(CAST(frame AS VARCHAR), 4, '0') || '.vtk' AS name, count(*) * 28 > 0 AS filled FROM particles GROUP BY run_id, frame""")
def find_frames(spark, sf):
    """Frame files on disk found by several patterns, each frame once, however many files its particles are in."""
    root = files.write_frame_files(view(spark, sf, "particles"))
    found = files.find_frames(spark, root, ["PartFluid_*.vtk", "Part*_0*.vtk", "*.vtk"])
    return files.found_frames(found)


@query("particle_ingest", """
SELECT run_id, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY frame) - 1 AS INT) AS frame, idp,
  round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS x, round(CAST(CAST(y AS FLOAT) AS DOUBLE), 5) AS y,
  round(CAST(CAST(vy AS FLOAT) AS DOUBLE), 5) + 0.0 AS vy FROM particles""")
def particle_ingest(spark, sf):
    """Particles written as frame files, found on disk and decoded."""
    root = files.write_frame_files(view(spark, sf, "particles"))
    return files.decode_frames(files.frame_files(spark, root)).select(
        "run_id", "frame", "idp", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("x", "y", "vy")]
    )


_RUN_CSV = """csv AS (SELECT run_id, CASE WHEN run_id % 7 = 0 THEN '' ELSE concat(CAST(seconds // 10 AS VARCHAR), ',', lpad(CAST(seconds % 1000 AS VARCHAR), 3, '0')) END AS np,
  CASE WHEN run_id % 5 = 0 THEN 'n/a' ELSE '0.1' END AS dp, CAST(seconds AS VARCHAR) AS tsimul,
  CASE WHEN run_id % 3 = 0 THEN '' ELSE concat(CAST(seconds AS VARCHAR), '.5') END AS physical FROM runs)"""


@query("run_facts_csv", f"""WITH {_RUN_CSV}
SELECT run_id, TRY_CAST(trim(replace(np, ',', '')) AS DOUBLE) AS np, TRY_CAST(dp AS DOUBLE) AS dp,
  coalesce(TRY_CAST(physical AS DOUBLE), TRY_CAST(tsimul AS DOUBLE)) AS physical_time, 'GPU 0' AS hardware FROM csv""")
def run_facts_csv(spark, sf):
    """One ``;`` separated facts row per run, written as text and read back."""
    rows = view(spark, sf, "runs").selectExpr(
        "run_id",
        "CASE WHEN run_id % 7 = 0 THEN '' ELSE concat(CAST(seconds div 10 AS STRING), ',', lpad(CAST(seconds % 1000 AS STRING), 3, '0')) END AS Np",
        "CASE WHEN run_id % 5 = 0 THEN 'n/a' ELSE '0.1' END AS Dp", "CAST(seconds AS STRING) AS TSimul",
        "CASE WHEN run_id % 3 = 0 THEN '' ELSE concat(CAST(seconds AS STRING), '.5') END AS PhysicalTime",
        "'\"GPU 0\"' AS Hardware",
    )
    path = files.write_facts(rows)
    return files.read_run_facts(spark, path).select("run_id", "np", "dp", "physical_time", "hardware")


@query("frame_times_csv", """
SELECT run_id, part, CAST(max(line_no) AS DOUBLE) / 8 AS time_s FROM (
  SELECT run_id, line_no, line_no % 50 AS part FROM run_log WHERE line_no % 11 <> 0) q GROUP BY run_id, part""")
def frame_times_csv(spark, sf):
    """``Part;TimeStep [s]`` rows with bad rows and repeated parts; the last repeat wins."""
    rows = view(spark, sf, "run_log").selectExpr(
        "run_id", "line_no",
        "CASE WHEN line_no % 11 = 0 THEN 'total' ELSE CAST(line_no % 50 AS STRING) END AS part",
        "CAST(line_no / 8D AS STRING) AS time_text",
    )
    return files.read_frame_times(spark, files.write_frame_times(rows))


@query("site_upload_profile", """
WITH s AS (SELECT raster_id, count(z) AS valid_cells, min(z) AS minimum, max(z) AS maximum,
  avg(z) AS mean, round(median(z), 6) AS median FROM cells GROUP BY raster_id)
SELECT r.raster_id, epsg, width, height, round(west, 6) AS west, round(west + width * res_x, 6) AS east,
  valid_cells, minimum, maximum, round(mean, 6) AS mean, median FROM rasters r JOIN s ON s.raster_id = r.raster_id""")
def site_upload_profile(spark, sf):
    from terraflow.operators import raster as A

    info = A.raster_info(view(spark, sf, "rasters"), "raster_id")
    profile = info.join(A.statistics(view(spark, sf, "cells"), ["raster_id"]), "raster_id")
    path = files.write_json(profile, "profile")
    return spark.read.schema(profile.schema).json(path).select(
        "raster_id", "epsg", "width", "height", F.round("west", 6).alias("west"), F.round("east", 6).alias("east"),
        "valid_cells", "minimum", "maximum", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"),
    )
