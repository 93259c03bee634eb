"""State of streams: equal to the fold over everything, and gone once a run is over."""

import random

import numpy as np
import pytest

from terraflow.streaming import state, streams

FRAMES = "run_id long, frame long, slice long"


def drain(stream, tmp_path, rows):
    """Batches of one drain go to ``rows``; the number of runs that hold state after it."""
    with streams._data_batches_only(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(lambda b, i: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state"))
            .outputMode("update").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def log_text(run, lines):
    return "".join(f"{run}\t{n}\t{text}\n" for n, text in lines)


@pytest.mark.parametrize("keep_ms", [0, 1])
def test_closed_runs_hold_no_state(spark, tmp_path, keep_ms):
    folder = tmp_path / "log"
    folder.mkdir()
    start = [(1, "SCENARIO CHECK"), (2, "Environment validation: PASSED")]
    rows = []

    def more(name, text):
        (folder / name).write_text(text)
        return drain(streams.stage_states(streams.log_stream(spark, str(folder)), keep_ms=keep_ms), tmp_path, rows)

    # The line that closes run 1 comes with the others; a line without a run has a board of its own.
    closed = "".join(log_text(run, [*start, (3, "RUN COMPLETE")]) for run in range(1, 6))
    held = more("a.txt", closed + log_text(7, start) + log_text("", start[:1]))
    assert held == (2 if keep_ms == 0 else 7)
    assert more("b.txt", log_text(7, [(3, "→ Clip source DEM ...")])) == 2
    assert more("c.txt", log_text(7, [(9, "RUN COMPLETE")])) == (1 if keep_ms == 0 else 2)
    last = {r.run_id: r for r in sorted(rows, key=lambda r: r.n_events)}
    assert set(last) == {1, 2, 3, 4, 5, 7, None}
    assert {last[run].version for run in range(1, 6)} == {3} and last[1].n_events == 3
    assert (last[7].n_events, last[7].version) == (4, 9) and last[7].stages.startswith("validate=done ")
    assert last[None].stages.startswith("validate=active ")


def test_late_lines_before_the_timer_count(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rows = []
    lines = [(1, "SCENARIO CHECK"), (2, "Environment validation: FAILED"), (3, "RUN COMPLETE")]
    for k, line in enumerate(reversed(lines)):
        (folder / f"{k}.txt").write_text(log_text(1, [line]))
        drain(streams.stage_states(streams.log_stream(spark, str(folder), 1)), tmp_path, rows)
    assert [r.n_events for r in rows] == [1, 2, 3] and rows[-1].version == 3
    assert rows[-1].stages.startswith("validate=failed ")


def test_frame_state_ends_with_the_run(spark, tmp_path):
    folder = tmp_path / "frames"
    folder.mkdir()
    expected = spark.createDataFrame([(1, 4, 0.5, "x"), (2, 100, None, "x"), (3, 2, 0.0, "x")], "run_id long, expected long, time_out double, frame string")
    rows = []

    def more(name, listing):
        spark.createDataFrame(listing, FRAMES).coalesce(1).write.json(str(folder / name))
        stream = spark.readStream.schema(FRAMES).json(str(folder / "*"))
        return drain(streams.frame_progress(stream, expected, keep_ms=0), tmp_path, rows)

    assert more("a", [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 7, 0), (2, None, 0), (9, 3, 0), (None, 5, 0)]) == 4
    assert more("b", [(1, 3, 0), (1, 2, 1), (1, 0, 1), (3, 1, 0), (3, 0, 0), (2, 8, 0), (2, 7, 1)]) == 3
    last = {r.run_id: (r.done, r.total, r.sim_time) for r in sorted(rows, key=lambda r: r.done)}
    assert last == {1: (4, 4, 1.5), 2: (2, 100, 0.05), 3: (2, 2, 0.05), 9: (1, 0, 0.0), None: (1, 0, 0.0)}


def test_spans_are_the_numbers(spark):
    rng = random.Random(3)
    for _ in range(200):
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = set()
        for _ in range(rng.randrange(5)):
            numbers = [rng.randrange(-20, 40) for _ in range(rng.randrange(12))]
            seen.update(numbers)
            starts, ends = state.merged_spans(starts, ends, np.array(numbers, np.int64))
            assert {n for a, b in zip(starts, ends) for n in range(a, b + 1)} == seen
            assert (starts[1:] > ends[:-1] + 1).all()


def test_event_sets(spark, tmp_path):
    schema = "run_id string, line_no long, event string, stage string"
    listing = [("a", 2, "start", "case"), ("a", 1, "fail", None), ("a", 1, "fail", None), ("b", 5, "complete", None), ("c", None, "fail", "case")]
    rows = []
    for name, part in (("none", []), ("all", listing)):
        spark.createDataFrame(part, schema).write.json(str(tmp_path / "in" / name))
        events = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        drain(state.run_events(events), tmp_path, rows) if part else None
    got = {r.run_id: ([tuple(e) for e in r.events], r.version) for r in rows}
    assert got == {"a": ([(1, "fail", None), (2, "start", "case")], 2), "b": ([(5, "complete", None)], 5), "c": ([(None, "fail", "case")], None)}
