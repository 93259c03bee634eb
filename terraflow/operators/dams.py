"""Dam inventory: normalise, look up, search, facets, nested record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.functions.scalars import parse_dms

# Raw inventory fields and the names they take.
RENAMED = {
    "PIC": "pic",
    "dm_name": "name",
    "sdso": "sdso",
    "state": "state",
    "district": "district",
    "river": "river",
    "incharge": "incharge",
    "ht_found": "height",
    "cmp_year": "completion_year",
    "basin": "basin",
    "mx_wt_lel": "max_water_level",
    "frl": "full_reservoir_level",
    "gs_st_cap": "gross_storage_capacity",
    "ds_sp_cap": "dead_storage_capacity",
    "dm_length": "dam_length",
    "dm_type": "dam_type",
    "purpose": "purpose",
}
SEARCHED = ("name", "river", "district", "state", "pic")
PAGE_ROWS = 200


def normalize(raw: DataFrame, position: str = "pos") -> DataFrame:
    """Renamed fields, decimal coordinates and an id that is never empty."""
    dam_id = F.coalesce(F.nullif(F.col("PIC"), F.lit("")), F.col(position).cast("string"))
    return raw.select(
        F.col(position),
        dam_id.alias("dam_id"),
        *[F.col(old).alias(new) for old, new in RENAMED.items()],
        parse_dms(F.col("longitude")).alias("longitude"),
        parse_dms(F.col("latitude")).alias("latitude"),
    )


def lookup(dams: DataFrame, dam_id: str | int) -> DataFrame:
    """The dam with this id, compared as text; an empty result means not found."""
    return dams.filter(F.col("dam_id").cast("string") == F.lit(str(dam_id)))


def lookup_many(dams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted id with its dam, ``found`` telling whether there is one."""
    hit = dams.withColumn("found", F.lit(True))
    return wanted.join(hit, "dam_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def search(dams: DataFrame, text: str = "", river: str = "", state: str = "") -> DataFrame:
    """Dams on a river, in a state, with ``text`` in any searched field."""
    out = dams
    if river:
        out = out.filter(F.col("river") == river)
    if state:
        out = out.filter(F.col("state") == state)
    needle = text.strip().lower()
    if needle:
        hit: Column = F.lit(False)
        for field in SEARCHED:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(field)), F.lit(needle)), F.lit(False))
        out = out.filter(hit)
    return out


def page(matches: DataFrame, position: str = "pos", rows: int = PAGE_ROWS) -> DataFrame:
    """The first matches in source order with the number of all matches."""
    total = matches.agg(F.count(F.lit(1)).alias("n"))
    return matches.orderBy(position).limit(rows).withColumn("total_matches", total.scalar())


def facet_values(dams: DataFrame, fields: Sequence[str] = ("river", "state")) -> DataFrame:
    """Distinct non-empty values of each field, sorted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return (
        dams.select(pairs.alias("p")).select("p.*")
        .filter("value IS NOT NULL AND value <> ''")
        .distinct()
        .orderBy("field", "value")
    )


# Fields of the nested record that no source fills yet.
UNFILLED = {
    "hydrology": ("rainfall", "riverDischarge", "upstreamInflow", "forecastRainfall", "historicalExtremes"),
    "terrain": ("dem", "slope", "elevation", "riverNetwork", "landCover", "downstreamDistance"),
    "environment": ("airQuality", "waterQuality", "temperature", "weather", "soilGeology"),
    "exposure": ("population", "buildings", "roads", "bridges", "hospitals", "schools", "criticalInfrastructure"),
    "monitoring": ("sensors", "remoteSensing", "satelliteObservations", "historicalIncidents", "inspectionRecords"),
}


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def digital_twin(dams: DataFrame) -> DataFrame:
    """One nested record per normalised dam."""

    def finite(name: str) -> Column:
        c = F.col(name)
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)

    identity = F.struct(
        F.coalesce("pic", "dam_id").alias("damId"), "name", "river", "basin", "state", "district",
        finite("latitude"), finite("longitude"),
    )
    structural = F.struct(
        F.col("height"), F.col("dam_length").alias("length"), F.col("dam_type").alias("damType"),
        _none("foundationType"), _none("crestElevation"), _none("spillwayCapacity"), _none("gateInformation"),
        F.col("completion_year").alias("constructionYear"), _none("inspectionInformation"),
    )
    reservoir = F.struct(
        F.col("gross_storage_capacity").alias("grossStorage"), _none("liveStorage"),
        F.col("dead_storage_capacity").alias("deadStorage"), _none("currentLevel"),
        F.col("full_reservoir_level").alias("frl"), F.col("max_water_level").alias("mwl"),
        _none("inflow"), _none("outflow"),
    )
    rest = [F.struct(*[_none(f) for f in fields]).alias(group) for group, fields in UNFILLED.items()]
    return dams.select(
        "pos", identity.alias("identity"), structural.alias("structural"), reservoir.alias("reservoir"), *rest
    )
