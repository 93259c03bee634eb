"""Dam inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraflow.functions.scalars import rounded
from terraflow.operators import dams as D
from terraflow.operators import runs as U
from terraflow.plans import sqltext as T
from terraflow.plans.registry import query
from terraflow.sources import files
from terraflow.sources.views import view

NORMAL = f"""norm AS (SELECT pos, coalesce(nullif(PIC, ''), CAST(pos AS VARCHAR)) AS dam_id, PIC AS pic, dm_name AS name,
  sdso, state, district, river, incharge, ht_found AS height, cmp_year AS completion_year, basin,
  mx_wt_lel AS max_water_level, frl AS full_reservoir_level, gs_st_cap AS gross_storage_capacity,
  ds_sp_cap AS dead_storage_capacity, dm_length AS dam_length, dm_type AS dam_type, purpose,
  {T.r(T.dms('longitude'))} AS longitude, {T.r(T.dms('latitude'))} AS latitude FROM dams_raw)"""


def _dams(spark, sf):
    d = D.normalize(view(spark, sf, "dams_raw"))
    return d.withColumn("longitude", rounded(F.col("longitude"))).withColumn("latitude", rounded(F.col("latitude")))


@query("dam_source", """
SELECT pos, PIC AS pic, dm_name, river, state, district, ht_found, frl, latitude, longitude FROM dams_raw""")
def dam_source(spark, sf):
    """Feature collections of up to 1000 dams each, written and read back."""
    raw = view(spark, sf, "dams_raw")
    path = files.write_feature_collections(raw, "pos", 1000)
    feats = files.read_feature_collections(spark, path, raw.drop("pos").schema)
    return feats.selectExpr(
        "id AS pos", "PIC AS pic", "dm_name", "river", "state", "district",
        "ht_found", "frl", "latitude", "longitude",
    )


@query("dam_normalize", f"WITH {NORMAL} SELECT * FROM norm")
def dam_normalize(spark, sf):
    return _dams(spark, sf)


@query("dam_lookup", f"""WITH {NORMAL}, w AS (SELECT DISTINCT dam_id FROM runs)
SELECT w.dam_id, n.pos, n.name, n.pos IS NOT NULL AS found FROM w LEFT JOIN norm n ON n.dam_id = w.dam_id""")
def dam_lookup(spark, sf):
    wanted = view(spark, sf, "runs").select("dam_id").distinct()
    return D.lookup_many(_dams(spark, sf), wanted).select("dam_id", "pos", "name", "found")


@query("dam_search", f"""WITH {NORMAL} SELECT pos, dam_id, name, river, district, state FROM norm
WHERE state = 'ASIA' AND (contains(lower(name), '1') OR contains(lower(river), '1') OR contains(lower(district), '1')
  OR contains(lower(state), '1') OR contains(lower(pic), '1'))""")
def dam_search(spark, sf):
    return D.search(_dams(spark, sf), text=" 1 ", state="ASIA").select(
        "pos", "dam_id", "name", "river", "district", "state"
    )


@query("dam_digital_twin", f"""WITH {NORMAL} SELECT pos, coalesce(pic, dam_id) AS dam_id, name, river, basin, state, district,
  latitude, longitude, height, dam_length AS length, dam_type AS dam_type, completion_year AS construction_year,
  gross_storage_capacity AS gross_storage, dead_storage_capacity AS dead_storage, full_reservoir_level AS frl,
  max_water_level AS mwl, CAST(NULL AS VARCHAR) AS rainfall, CAST(NULL AS VARCHAR) AS population FROM norm""")
def dam_digital_twin(spark, sf):
    return D.digital_twin(_dams(spark, sf)).selectExpr(
        "pos", "identity.damId AS dam_id", "identity.name AS name", "identity.river AS river",
        "identity.basin AS basin", "identity.state AS state", "identity.district AS district",
        "identity.latitude AS latitude", "identity.longitude AS longitude",
        "structural.height AS height", "structural.length AS length", "structural.damType AS dam_type",
        "structural.constructionYear AS construction_year", "reservoir.grossStorage AS gross_storage",
        "reservoir.deadStorage AS dead_storage", "reservoir.frl AS frl", "reservoir.mwl AS mwl",
        "hydrology.rainfall AS rainfall", "exposure.population AS population",
    )


@query("facet_values", """
SELECT DISTINCT 'river' AS field, river AS value FROM dams_raw WHERE river <> ''
UNION SELECT DISTINCT 'state', state FROM dams_raw WHERE state <> ''""")
def facet_values(spark, sf):
    return D.facet_values(_dams(spark, sf))


@query("inventory_page", f"""WITH {NORMAL}, m AS (SELECT * FROM norm WHERE contains(lower(name), '1')
  OR contains(lower(river), '1') OR contains(lower(district), '1') OR contains(lower(state), '1') OR contains(lower(pic), '1'))
SELECT pos, dam_id, name, (SELECT count(*) FROM m) AS total_matches FROM m ORDER BY pos LIMIT 200""")
def inventory_page(spark, sf):
    return D.page(D.search(_dams(spark, sf), text="1")).select("pos", "dam_id", "name", "total_matches")


@query("dashboard_counts", """
SELECT (SELECT count(*) FROM dams_raw) AS dams, count(*) AS runs,
       count(*) FILTER (status IN ('queued', 'running')) AS active,
       count(*) FILTER (status = 'completed' AND run_id % 3 <> 0) AS results_ready FROM runs""")
def dashboard_counts(spark, sf):
    runs = view(spark, sf, "runs").withColumn(
        "result_available", (F.col("status") == "completed") & (F.col("run_id") % 3 != 0)
    )
    return U.dashboard(view(spark, sf, "dams_raw"), runs)


@query("run_dam_names", """
SELECT run_id, r.dam_id, dm_name AS dam_name FROM runs r LEFT JOIN dams_raw d ON d.PIC = r.dam_id AND d.PIC <> ''""")
def run_dam_names(spark, sf):
    return U.with_dam_names(view(spark, sf, "runs"), view(spark, sf, "dams_raw")).select("run_id", "dam_id", "dam_name")
