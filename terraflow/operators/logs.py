"""Log lines to step rows, stage events and error texts.

A line is (run_id, line_no, line); ``line_no`` counts from 1 within a run. One
run may hold a large share of all lines, so ordered logic goes through
:mod:`terraflow.operators.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.operators.ordered import first_rows, previous_value, running_max

# The line formats of the solver log and of the run log.
PART_ROW = r"^(\d{4,6})\s+([0-9]+(?:\.[0-9]+)?)\s+(\d+)\s+(\d+)\s+([\d,]+)"
BRACKET_ROW = r"(?i)\[(?:Time:\s*)?([0-9]+(?:\.[0-9]+)?)\].*?Np[:=\s]+(\d+)"
PARTICLES_OUT = r"(?i)Particles\s+out[:=\s]+([\d,]+)(?:\s*\(total\s+out[:=\s]+([\d,]+)\))?"
STEP_MARK = r"^(✓|↷|✗|→)\s(.+)$"
DURATION_SUFFIX = r"\s*\([\d.]+s\)\s*$"
ERROR_MARKS = ("Error:", "Configuration error:")
# The stage a step label belongs to.
STEP_STAGE = {
    "Clip source DEM": "terrain",
    "Condition DEM": "terrain",
    "Generate flow accumulation": "terrain",
    "Generate flood domain": "terrain",
    "Generate SPH terrain (NPZ)": "sph",
    "Generate terrain STL": "sph",
    "Generate DualSPHysics case": "case",
    "Case geometry preview": "geometry",
    "Run GenCase + DualSPHysics + PartVTK": "simulation",
}
EVENT_OF_MARK = {"→": "start", "✓": "done", "↷": "skip", "✗": "fail"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def bare(line: str) -> Column:
    """The line without white space of any kind at its ends."""
    return F.regexp_replace(F.col(line), r"(?U)^\s+|\s+$", "")


def _count(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("long")


def step_rows(lines: DataFrame) -> DataFrame:
    """(time_s, np) of each step line, with the last outflow total of the run."""
    text = bare("line")
    part, bracket = text.rlike(PART_ROW), text.rlike(BRACKET_ROW)
    parsed = lines.select(
        "run_id", "line_no",
        F.when(part, F.regexp_extract(text, PART_ROW, 2))
        .when(bracket, F.regexp_extract(text, BRACKET_ROW, 1)).try_cast("double").alias("time_s"),
        F.when(part, _count(F.regexp_extract(text, PART_ROW, 5)))
        .when(bracket, _count(F.regexp_extract(text, BRACKET_ROW, 2))).alias("np"),
        F.when(
            ~part & ~bracket & text.rlike(PARTICLES_OUT),
            F.coalesce(
                _count(F.regexp_extract(text, PARTICLES_OUT, 2)), _count(F.regexp_extract(text, PARTICLES_OUT, 1))
            ),
        ).alias("out"),
    )
    total = (
        parsed.filter("out IS NOT NULL").groupBy("run_id").agg(F.max_by("out", "line_no").alias("total_out"))
    )
    steps = parsed.filter("time_s IS NOT NULL").drop("out")
    return steps.join(total, "run_id", "left").withColumn("total_out", F.coalesce("total_out", F.lit(0)))


def count_changes(steps: DataFrame) -> DataFrame:
    """Change of the particle count from step to step, 0 for the first."""
    prev = previous_value(steps, ["run_id"], "line_no", "np", "prev_np")
    return prev.withColumn("delta_np", F.col("np") - F.coalesce("prev_np", "np")).drop("prev_np")


def immediate_drop(steps: DataFrame) -> DataFrame:
    """Runs whose second step has under half of the particles of the first."""
    two = first_rows(steps, ["run_id"], "line_no", 2).groupBy("run_id").agg(
        F.min_by("np", "line_no").alias("first_np"),
        F.max_by("np", "line_no").alias("second_np"),
        F.count(F.lit(1)).alias("n"),
    )
    drop = (F.col("n") == 2) & (F.col("second_np") < F.col("first_np") * 0.5)
    return two.select("run_id", drop.alias("immediate_drop"))


def mark_events(lines: DataFrame) -> DataFrame:
    """Stage events of single lines; also marks the closing report line."""
    text = bare("line")
    mark = F.regexp_extract(text, STEP_MARK, 1)
    body = F.regexp_extract(text, STEP_MARK, 2)
    event = _lookup(EVENT_OF_MARK, mark)
    label = (
        F.when(event == "start", F.trim(F.regexp_replace(body, r" \.\.\.", "")))
        .when(event == "done", F.trim(F.regexp_replace(body, DURATION_SUFFIX, "")))
        .when(event.isNotNull(), F.trim(F.split(body, " — ")[0]))
    )
    checked = text.contains("Environment validation:")
    kind = (
        F.when(text.contains("RUN COMPLETE"), "complete")
        .when(text.contains("SCENARIO CHECK"), "start")
        .when(checked & text.contains("PASSED"), "done")
        .when(checked, "fail")
        .otherwise(event)
    )
    stage = _lookup(STEP_STAGE, label)
    return lines.select(
        "run_id", "line_no", kind.alias("event"), label.alias("label"),
        F.when(checked | text.contains("SCENARIO CHECK"), F.lit("validate"))
        .when((event != "fail") & event.isNotNull(), F.coalesce(stage, F.lit("postprocess")))
        .otherwise(stage).alias("stage"),
    ).filter("event IS NOT NULL")


def stage_timeline(lines: DataFrame) -> DataFrame:
    """Stage events in log order; nothing from the closing report on."""
    events = mark_events(lines)
    end = events.filter("event = 'complete'").groupBy("run_id").agg(F.min("line_no").alias("end_line"))
    return (
        events.join(end, "run_id", "left")
        .filter("end_line IS NULL OR line_no < end_line")
        .select("run_id", "line_no", "event", "label", "stage")
    )


def error_text(lines: DataFrame, size: int = 6) -> DataFrame:
    """The error block of each run.

    A marker line opens a block. The first block that reaches ``size`` kept
    lines wins, else the last block.
    """
    text = bare("line")
    is_mark = F.lit(False)
    for m in ERROR_MARKS:
        is_mark = is_mark | text.startswith(m)
    rows = running_max(
        lines.withColumn("text", text).withColumn("mark", is_mark),
        ["run_id"], "line_no", F.when(F.col("mark"), F.col("line_no")), "block",
    )
    skipped = text.startswith("Step:") | text.startswith("=" * 10) | (text == "")
    kept = rows.filter(F.col("block").isNotNull() & (F.col("mark") | ~skipped))
    top = first_rows(kept, ["run_id", "block"], "line_no", size)
    blocks = top.groupBy("run_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("t")
    )
    full, last = F.min(F.when(F.col("n") == size, F.col("block"))), F.max("block")
    chosen = blocks.groupBy("run_id").agg(F.coalesce(full, last).alias("block"))
    return blocks.join(chosen, ["run_id", "block"]).select(
        "run_id", F.array_join(F.transform("t", lambda s: s["text"]), " · ").alias("error")
    )


def tail(lines: DataFrame, n: int = 15) -> DataFrame:
    """The last lines of each run."""
    return first_rows(lines, ["run_id"], "line_no", n, descending=True)
