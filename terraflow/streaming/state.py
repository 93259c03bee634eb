"""Keyed state of streams that ends: what a run has shown so far, dropped once the run is over.

Each function takes a stream and gives a row for every run that a
batch says something about. The state of a run is kept while the run is open.
When it is over, a timer is set, and the state goes ``keep_ms`` later (with the
same batch for 0), so that what comes a little late is still counted in. Timers
run out when a later batch is planned. With the trigger ``availableNow`` set
``spark.sql.streaming.noDataMicroBatches.enabled`` to false, as the drains of
``streams`` do: a query that makes batches for its timers never ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long the state of a finished run is kept.
KEEP_MS = 3_600_000


def _hold(state: GroupState, value: tuple, over: bool, keep_ms: int) -> None:
    if over and keep_ms <= 0:
        if state.exists:
            state.remove()
        return
    state.update(value)
    if over:
        state.setTimeoutDuration(keep_ms)


def run_events(events: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """run_id, the distinct ``events`` of the run so far, and ``version``, their largest line.

    ``events`` has run_id, line_no, event and stage; a run is over when one of its
    events is "complete". Rows may come again and in any order. Events that come
    after the state went begin a new set.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(zip(*state.get, strict=True)) if state.exists else set()
        for batch in batches:
            lines, stages = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("line_no", "stage"))
            seen.update((None if n is None else int(n), *e) for n, *e in zip(lines, batch["event"], stages, strict=True))
        ordered = sorted(seen, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2] or ""))
        lines, names, stages = (list(c) for c in zip(*ordered, strict=True))
        _hold(state, (lines, names, stages), "complete" in names, keep_ms)
        yield pd.DataFrame({"run_id": [key[0]], "lines": [lines], "names": [names], "stages": [stages]})

    run_type = events.schema["run_id"].dataType.simpleString()
    lists = "lines array<bigint>, names array<string>, stages array<string>"
    held = events.select("run_id", "line_no", "event", "stage").groupBy("run_id").applyInPandasWithState(
        step, f"run_id {run_type}, {lists}", lists, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
    rows = F.transform(
        F.arrays_zip("lines", "names", "stages"),
        lambda e: F.struct(e["lines"].alias("line_no"), e["names"].alias("event"), e["stages"].alias("stage")),
    )
    return held.select("run_id", rows.alias("events"), F.array_max("lines").alias("version"))


def merged_spans(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of whole numbers (both ends in) with ``numbers`` added; touching spans are one."""
    first, last = np.concatenate([starts, numbers]), np.concatenate([ends, numbers])
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    if not len(first):
        return first, reach
    opens = np.concatenate([[True], first[1:] > reach[:-1] + 1])
    return first[opens], reach[np.concatenate([opens[1:], [True]])]


def run_frames(frames: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """run_id, number ``done`` of distinct frames so far, and the run's expected and time_out.

    ``frames`` has run_id, frame, expected and time_out, the last two one value for
    each run. A run is over when it has as many frames as expected; one without a
    number stays open. The state is the spans of frame numbers seen, so a run whose
    frames come in order holds one span, however many they are. Null frames don't count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, ends = (np.array(a, np.int64) for a in (state.get if state.exists else ((), ())))
        expected = time_out = None
        for batch in batches:
            starts, ends = merged_spans(starts, ends, batch["frame"].dropna().to_numpy(np.int64))
            expected, time_out = (None if pd.isna(v) else v for v in batch[["expected", "time_out"]].iloc[0])
        done = int((ends - starts + 1).sum())
        _hold(state, (starts.tolist(), ends.tolist()), expected is not None and done >= expected, keep_ms)
        row = {"run_id": [key[0]], "done": [done], "expected": pd.array([expected], "Int64"), "time_out": pd.array([time_out], "Float64")}
        yield pd.DataFrame(row)

    run_type = frames.schema["run_id"].dataType.simpleString()
    given = frames.select("run_id", F.col("frame").cast("long").alias("frame"), F.col("expected").cast("long").alias("expected"), F.col("time_out").cast("double").alias("time_out"))
    return given.groupBy("run_id").applyInPandasWithState(
        step, f"run_id {run_type}, done bigint, expected bigint, time_out double", "starts array<bigint>, ends array<bigint>",
        "update", GroupStateTimeout.ProcessingTimeTimeout,
    )
