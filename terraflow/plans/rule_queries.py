"""Rule checks over scenarios, requests and step records."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.operators import rules as L
from terraflow.operators import runs as U
from terraflow.plans.registry import query
from terraflow.sources.views import view

KEYS = ["scenario_no", "key"]


def _bound(name: str, lo: int, hi: int) -> str:
    return (
        f"CASE WHEN NOT ({name} BETWEEN {lo} AND {hi}) THEN "
        f"concat('{name} must be between {lo} and {hi} (got ', CAST({name} AS VARCHAR), ')') END"
    )


@query("lonlat_rules", f"""
SELECT request_id, coalesce(dam_lon_ok, lon) AS dam_lon, coalesce(dam_lat_ok, lat) AS dam_lat, problems FROM (
SELECT request_id, lon, lat, CASE WHEN dam_lat IS NOT NULL THEN dam_lon END AS dam_lon_ok,
       CASE WHEN dam_lon IS NOT NULL THEN dam_lat END AS dam_lat_ok,
  concat_ws('; ', {_bound('lon', -180, 180)}, {_bound('lat', -90, 90)},
   CASE WHEN (dam_lon IS NULL) <> (dam_lat IS NULL) THEN 'dam_lon and dam_lat must be provided together' END,
   CASE WHEN dam_lon IS NOT NULL AND dam_lat IS NOT NULL THEN {_bound('dam_lon', -180, 180)} END,
   CASE WHEN dam_lon IS NOT NULL AND dam_lat IS NOT NULL THEN {_bound('dam_lat', -90, 90)} END) AS problems
FROM site_requests) q""")
def lonlat_rules(spark, sf):
    req = view(spark, sf, "site_requests")
    c = F.col
    both = c("dam_lon").isNotNull() & c("dam_lat").isNotNull()
    return req.select(
        "request_id",
        F.when(both, c("dam_lon")).otherwise(c("lon")).alias("dam_lon"),
        F.when(both, c("dam_lat")).otherwise(c("lat")).alias("dam_lat"),
        L.joined(L.coordinate_problems(c("lon"), c("lat"), c("dam_lon"), c("dam_lat"))).alias("problems"),
    )


@query("axis_sign_rules", """
SELECT request_id, lower(axis) AS axis, sign, concat_ws('; ',
   CASE WHEN lower(axis) NOT IN ('x', 'y') THEN 'dam_axis must be ''x'' or ''y''' END,
   CASE WHEN sign NOT IN (1, -1) THEN 'dam_upstream_sign must be +1 or -1' END,
   CASE WHEN sign IS NOT NULL AND axis IS NULL THEN 'dam_upstream_sign requires an explicit dam_axis' END) AS problems
FROM site_requests""")
def axis_sign_rules(spark, sf):
    return view(spark, sf, "site_requests").select(
        "request_id", F.lower("axis").alias("axis"), "sign",
        L.joined(L.orientation_problems(F.col("axis"), F.col("sign"))).alias("problems"),
    )


_MERGED = """merged AS (SELECT coalesce(b.scenario_no, o.scenario_no) AS scenario_no, coalesce(b.key, o.key) AS key,
  CASE WHEN o.key IS NOT NULL THEN o.value ELSE b.value END AS value, o.key IS NOT NULL AS overridden
  FROM base_config b FULL JOIN overrides o ON b.scenario_no = o.scenario_no AND b.key = o.key)"""


@query("config_merge", f"WITH {_MERGED} SELECT * FROM merged")
def config_merge(spark, sf):
    return L.merged_config(view(spark, sf, "base_config"), view(spark, sf, "overrides"), KEYS)


_LISTED = ", ".join(f"'{k}'" for k in L.LISTED_PARAMETERS)


@query("scenario_catalog", f"""WITH {_MERGED},
p AS (SELECT scenario_no, string_agg(concat(key, '=', value), ' ' ORDER BY key) AS parameters FROM merged
      WHERE key IN ({_LISTED}) GROUP BY scenario_no)
SELECT s.scenario_no, name, display_name, error IS NULL AS ready, error, CASE WHEN error IS NULL THEN dam_id END AS dam_id,
       CASE WHEN error IS NULL THEN parameters END AS parameters
FROM scenarios s LEFT JOIN p ON p.scenario_no = s.scenario_no
WHERE NOT (name = 'local' OR name LIKE 'local.%' OR name LIKE '%.example')""")
def scenario_catalog(spark, sf):
    merged = L.merged_config(view(spark, sf, "base_config"), view(spark, sf, "overrides"), KEYS)
    params = (
        merged.filter(F.col("key").isin(L.LISTED_PARAMETERS))
        .groupBy("scenario_no")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("parameters"))
    )
    ready = F.col("error").isNull()
    text = F.array_join(
        F.transform(F.sort_array(F.map_entries("parameters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "
    )
    return (
        U.listed_scenarios(view(spark, sf, "scenarios"))
        .join(params, "scenario_no", "left")
        .select("scenario_no", "name", "display_name", ready.alias("ready"), "error",
                F.when(ready, F.col("dam_id")).alias("dam_id"), F.when(ready, text).alias("parameters"))
    )


@query("scenario_for_dam", """
SELECT dam_id, min(scenario_no) AS scenario_no, arg_min(name, scenario_no) AS name FROM scenarios
WHERE error IS NULL GROUP BY dam_id""")
def scenario_for_dam(spark, sf):
    return U.first_ready_scenario(view(spark, sf, "scenarios").withColumn("ready", F.col("error").isNull()))


@query("range_rules", """
WITH rr(key, lo, hi, bounds) AS (VALUES """ + ", ".join(
    f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE, '[{lo}, {hi}]')" for k, lo, hi in L.CASE_RANGES) + """)
SELECT o.scenario_no, o.key, concat('''case.overrides.', o.key, ''' = ', o.value, ' outside valid range ', bounds) AS problem
FROM overrides o JOIN base_config b ON b.scenario_no = o.scenario_no AND b.key = o.key AND b.kind = 'n'
JOIN rr ON rr.key = o.key WHERE o.kind = 'n' AND NOT (CAST(o.value AS DOUBLE) BETWEEN lo AND hi)
UNION ALL
SELECT t.scenario_no, t.key, concat('''terrain.', t.section, '.', t.key, CASE
  WHEN t.key IN ('preview', 'csv') THEN ''' must be true/false' WHEN t.kind <> 'n' THEN ''' must be a number'
  ELSE concat(''' = ', t.value, ' outside valid range ', r.bounds) END) AS problem
FROM terrain_settings t LEFT JOIN (VALUES """ + ", ".join(f"('{s}', '{k}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, '[{lo}, {hi}]')" for s, k, lo, hi in L.TERRAIN_RANGES) + """) r(section, key, lo, hi, bounds)
  ON r.section = t.section AND r.key = t.key
WHERE CASE WHEN t.key IN ('preview', 'csv') THEN t.kind <> 'b' WHEN t.kind <> 'n' THEN true ELSE NOT (TRY_CAST(t.value AS DOUBLE) BETWEEN lo AND hi) END""")
def range_rules(spark, sf):
    """Settings of the case and of the terrain."""
    case = L.range_problems(view(spark, sf, "overrides"), view(spark, sf, "base_config"), KEYS)
    return case.unionByName(L.terrain_problems(view(spark, sf, "terrain_settings"), KEYS))


@query("type_rules", """
SELECT o.scenario_no, o.key, concat('''case.overrides.', o.key, '''', CASE b.kind WHEN 'n' THEN ' must be a number'
  WHEN 'b' THEN ' must be of type bool' WHEN 's' THEN ' must be of type str' ELSE ' must be of type NoneType' END) AS problem
FROM overrides o JOIN base_config b ON b.scenario_no = o.scenario_no AND b.key = o.key WHERE b.kind <> o.kind""")
def type_rules(spark, sf):
    return L.type_problems(view(spark, sf, "overrides"), view(spark, sf, "base_config"), KEYS)


@query("unknown_keys", """
SELECT scenario_no, string_agg(problem, '; ' ORDER BY problem) AS problems FROM (
  SELECT scenario_no, concat('unknown setting ''', key, '''') AS problem FROM settings WHERE key IN ('colour', 'gate')
  UNION ALL
  SELECT o.scenario_no, concat('''case.overrides.', o.key, ''' is not a key of the base case config')
  FROM overrides o WHERE NOT EXISTS (SELECT 1 FROM base_config b WHERE b.scenario_no = o.scenario_no AND b.key = o.key)) q
GROUP BY scenario_no""")
def unknown_keys(spark, sf):
    top = L.unknown_settings(view(spark, sf, "settings")).select(
        "scenario_no", F.concat(F.lit("unknown setting '"), "key", F.lit("'")).alias("problem")
    )
    over = L.unknown_overrides(view(spark, sf, "overrides"), view(spark, sf, "base_config"), KEYS).select(
        "scenario_no",
        F.concat(F.lit("'case.overrides."), "key", F.lit("' is not a key of the base case config")).alias("problem"),
    )
    return top.unionByName(over).groupBy("scenario_no").agg(
        F.array_join(F.sort_array(F.collect_list("problem")), "; ").alias("problems")
    )


@query("validated_flag", """
SELECT coalesce(o.scenario_no, u.scenario_no) AS scenario_no,
       bool_and(o.key IS NOT NULL AND u.key IS NOT NULL AND o.value IS NOT DISTINCT FROM u.value) OR count(u.key) = 0 AS validated
FROM overrides o FULL JOIN run_overrides u ON o.scenario_no = u.scenario_no AND o.key = u.key GROUP BY 1""")
def validated_flag(spark, sf):
    return L.same_overrides(view(spark, sf, "overrides"), view(spark, sf, "run_overrides"), "scenario_no")


@query("parameter_limits", "SELECT run_id, concat_ws('; ', " + ", ".join(
    f"CASE WHEN {n} {'<' if closed else '<='} {lo} THEN '{n} must be {'>=' if closed else '>'} {lo:g}' END, "
    f"CASE WHEN {n} > {hi} THEN '{n} must be <= {hi:g}' END" for n, lo, closed, hi in L.REQUEST_LIMITS)
    + ") AS problems FROM run_requests")
def parameter_limits(spark, sf):
    return view(spark, sf, "run_requests").select("run_id", L.joined(L.request_problems()).alias("problems"))


@query("freshness", """
WITH s AS (SELECT coalesce(r.step_id, c.step_id) AS step_id,
  bool_and(r.step_id IS NOT NULL AND c.step_id IS NOT NULL AND r.path = c.path AND r.mtime_ns = c.mtime_ns AND r.size = c.size) AS same,
  count(*) FILTER (coalesce(r.kind, c.kind) = 'output' AND c.step_id IS NOT NULL) AS outputs
  FROM recorded_prints r FULL JOIN current_prints c ON r.step_id = c.step_id AND r.kind = c.kind AND r.ordinal = c.ordinal GROUP BY 1)
SELECT p.step_id, coalesce(recorded_params = current_params AND same AND outputs > 0, false) AS fresh
FROM step_params p LEFT JOIN s ON s.step_id = p.step_id""")
def freshness(spark, sf):
    return L.freshness(view(spark, sf, "recorded_prints"), view(spark, sf, "current_prints"), view(spark, sf, "step_params"))


@query("rule_summary", """
WITH c AS (SELECT run_id, 1 AS ordinal, reservoir_level <= 100 AS ok, 'level' AS message FROM run_requests
  UNION ALL SELECT run_id, 2, coalesce(breach_time >= 0, true), 'time' FROM run_requests
  UNION ALL SELECT run_id, 3, coalesce(breach_width < 100, true), 'width' FROM run_requests)
SELECT run_id, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (ok) AS checks_passed,
       coalesce(string_agg(message, '; ' ORDER BY ordinal) FILTER (NOT ok), '') AS errors FROM c GROUP BY run_id""")
def rule_summary(spark, sf):
    checks = view(spark, sf, "run_requests").selectExpr(
        "run_id",
        "inline(array(named_struct('ordinal', 1, 'ok', reservoir_level <= 100, 'message', 'level'),"
        " named_struct('ordinal', 2, 'ok', coalesce(breach_time >= 0, true), 'message', 'time'),"
        " named_struct('ordinal', 3, 'ok', coalesce(breach_width < 100, true), 'message', 'width')))",
    )
    return L.rule_summary(checks, "run_id").withColumn("errors", L.joined(F.col("errors")))
