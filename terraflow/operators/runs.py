"""Run history, artefacts, step reports and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
INTERRUPTED = "Interrupted: the backend restarted while this job was running."


def with_dam_names(runs: DataFrame, dams: DataFrame) -> DataFrame:
    """Runs with the name of their dam; either raw or normalised field names."""
    have = set(dams.columns)

    def either(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have])

    names = (
        dams.select(either("pic", "PIC").alias("dam_id"), either("name", "dm_name").alias("dam_name"))
        .filter("dam_id IS NOT NULL AND dam_name IS NOT NULL")
        .groupBy("dam_id").agg(F.max("dam_name").alias("dam_name"))
    )
    return runs.join(names, "dam_id", "left")


def newly_found(on_disk: DataFrame, known: DataFrame) -> DataFrame:
    """Runs found on disk whose folder no known run has."""
    return on_disk.join(known.select("run_dir").filter("run_dir IS NOT NULL").distinct(), "run_dir", "left_anti")


def history(known: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Known runs and newly found ones in one schema."""
    return known.unionByName(newly_found(on_disk, known), allowMissingColumns=True)


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.coalesce(F.col("created_at").cast("string"), F.lit("")).desc(), "run_id")


def recent(runs: DataFrame, n: int = 6) -> DataFrame:
    """The newest runs; a missing creation time sorts last."""
    return newest_first(runs).limit(n)


def with_status(runs: DataFrame, status: str = "all") -> DataFrame:
    return newest_first(runs if status == "all" else runs.filter(F.col("status") == status))


def latest_success(runs: DataFrame, scenario: str = "scenario_no") -> DataFrame:
    """The newest completed run of each scenario."""
    newest = F.max(F.struct("finished_at", "run_id", "run_dir"))
    return runs.filter("status = 'completed'").groupBy(scenario).agg(newest.alias("r")).select(scenario, "r.*")


def first_ready_scenario(scenarios: DataFrame) -> DataFrame:
    """The first ready scenario of each dam in listing order."""
    first = F.min(F.struct("scenario_no", "name"))
    return scenarios.filter("ready").groupBy("dam_id").agg(first.alias("s")).select("dam_id", "s.*")


def listed_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenario files without local and example ones."""
    return scenarios.filter(~F.col("name").rlike(r"^local$|^local\.|\.example$"))


def existing_paths(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Map of known locations of each run, only those that exist."""
    found = expected.join(listing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    entry = F.when(F.col("there"), F.struct(F.col("role").alias("key"), F.col("path").alias("value")))
    return found.groupBy("run_id", "run_dir").agg(F.collect_list(entry).alias("e")).select(
        "run_id",
        F.map_from_entries(
            F.concat(F.array(F.struct(F.lit("run_dir").alias("key"), F.col("run_dir").alias("value"))), F.col("e"))
        ).alias("paths"),
    )


def missing_paths(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected artefacts that do not exist."""
    return expected.join(listing.select("path").distinct(), "path", "left_anti")


def dashboard(dams: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of headline counts."""
    d = dams.agg(F.count(F.lit(1)).alias("dams"))
    r = runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"),
        F.count_if("result_available").alias("results_ready"),
    )
    return r.withColumn("dams", d.scalar())


def stage_progress(stages: DataFrame) -> DataFrame:
    """Overall progress of each run from rows (run_id, weight, status, progress)."""
    ended = F.col("status").isin("done", "failed")
    part = F.when(ended, F.col("weight")).when(
        F.col("status") == "active", F.col("weight") * F.greatest(F.lit(0.0), F.coalesce("progress", F.lit(0.0)))
    )
    return stages.groupBy("run_id").agg(
        F.round(F.least(F.coalesce(F.sum(part), F.lit(0.0)), F.lit(0.999)), 4).alias("progress")
    )


def step_report(steps: DataFrame) -> DataFrame:
    """Steps and time of each run by stage and outcome."""
    return steps.groupBy("run_id", "stage", "status").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("duration").alias("duration")
    )


def interrupt_active(runs: DataFrame, now: Column) -> DataFrame:
    """Runs that were queued or running become failed, their active stages too."""
    hit = F.col("status").isin(*ACTIVE)
    failed = F.transform(
        "stages",
        lambda s: s.withField("status", F.when(s["status"] == "active", F.lit("failed")).otherwise(s["status"])),
    )
    return (
        runs.withColumn("error", F.when(hit, F.lit(INTERRUPTED)).otherwise(F.col("error")))
        .withColumn("finished_at", F.when(hit, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")))
        .withColumn("stages", F.when(hit, failed).otherwise(F.col("stages")))
        .withColumn("status", F.when(hit, F.lit("failed")).otherwise(F.col("status")))
    )
