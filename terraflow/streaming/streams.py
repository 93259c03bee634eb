"""Structured Streaming jobs over logs, frame listings and probe results."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraflow.operators.logs import mark_events
from terraflow.session import scratch_path
from terraflow.streaming.stages import STEP_TOTALS, board, board_text, overall
from terraflow.streaming.state import KEEP_MS, run_events, run_frames


def numbered_line(text: Column) -> list[Column]:
    """run_id, line_no and line of a row that carries them with tabs between; what is no number is null."""
    parts = F.split(text, "\t", 3)
    return [parts[0].try_cast("long").alias("run_id"), parts[1].try_cast("long").alias("line_no"), parts[2].alias("line")]


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New log lines of a folder; the checkpoint of the query is the read position.

    ``files_per_batch`` sets the size of a batch; no query's result depends on it.
    A run or line that is no number is null.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(*numbered_line(F.col("value")))


def drain_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over everything there is, into a Parquet table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, f"{label}-state")).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, label: str) -> DataFrame:
    """Run an update stream; every batch overwrites its own folder, so retries are safe."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _data_batches_only(spark):
        query = (
            stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch_path(spark, f"{label}-state"))
            .outputMode("update").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.parquet(out)


@contextmanager
def _data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Queries started here make no batch without data: one that waits for timers would never have read everything."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def log_page(lines: DataFrame, offset: int) -> DataFrame:
    """Lines of each run after ``offset``, with the length of its log.

    An offset past the end of a log gives no lines, a negative one all of them.
    """
    length = lines.groupBy("run_id").agg(F.max("line_no").alias("log_length"))
    return lines.join(length, "run_id").filter(F.col("line_no") > F.least(F.lit(max(0, offset)), F.col("log_length")))


def stage_states(lines: DataFrame, totals: DataFrame | None = None, keep_ms: int = KEEP_MS) -> DataFrame:
    """Stage board of each run after every batch that brought events for it.

    The state of a run is the set of its events, a few per stage, so lines may
    come in any order and in any batches; it goes ``keep_ms`` after the run closed.
    ``totals`` (run_id, totals: map of stage to steps) is a static table for
    runs whose stages have other steps.
    """
    held = run_events(mark_events(lines), keep_ms)
    steps = None
    if totals is not None:
        held, steps = held.join(totals.select("run_id", "totals"), "run_id", "left"), F.col("totals")
        default = F.create_map(*[F.lit(x) for pair in STEP_TOTALS.items() for x in pair])
        steps = F.coalesce(steps, default)
    made = held.withColumn("board", board(F.col("events"), steps))
    return made.select(
        "run_id", "version", F.size("events").alias("n_events"), F.col("board.current").alias("stage"),
        board_text(F.col("board.stages")).alias("stages"), overall(F.col("board.stages")).alias("progress"),
    )


def latest_states(states: DataFrame) -> DataFrame:
    """The newest board of each run: the one of most events."""
    return states.groupBy("run_id").agg(F.max_by(F.struct("version", "stage", "stages", "progress"), "n_events").alias("s")).select(
        "run_id", "s.*"
    )


def frame_progress(frames: DataFrame, expected: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """Distinct frames seen of those expected and the simulated time, from a stream of frame files.

    A frame in several files, or listed again, counts once. The state of a run
    goes ``keep_ms`` after its last expected frame.
    """
    done = run_frames(frames.join(expected.select("run_id", "expected", "time_out"), "run_id", "left"), keep_ms)
    step = F.coalesce(F.nullif(F.col("time_out"), F.lit(0.0)), F.lit(0.05))
    return done.select(
        "run_id", "done", F.coalesce("expected", F.lit(0)).alias("total"),
        (F.greatest(F.col("done") - 1, F.lit(0)) * step).alias("sim_time"),
    )


def latest_wins(probes: DataFrame, key: str) -> DataFrame:
    """Reachability by the newest probe that says something; online until told otherwise."""
    told = F.when(F.col("result") != "canceled", F.struct("seq", "result"))
    return probes.groupBy(key).agg(F.max(told).alias("last"), F.max("seq").alias("newest")).select(
        key, "newest", F.col("last.seq").alias("decided_by"), F.coalesce(F.col("last.result") == "reachable", F.lit(True)).alias("online")
    )
