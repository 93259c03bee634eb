"""Plain logs that grow between batches: each finished line once, with its number."""

import os

from terraflow.sources.logs import GrowingLogReader, LogParts, growing_logs, whole_lines


def texts(rows):
    return sorted((r[0] or 0, os.path.basename(r[1]), r[2], r[4]) for r in rows)


def step(reader, start):
    end = reader.latestOffset()
    return end, [row for p in reader.partitions(start, end) for row in reader.read(p)]


def test_lines_come_once_with_their_numbers(tmp_path):
    (tmp_path / "run=4").mkdir()
    log, other = tmp_path / "run=4" / "Run.out", tmp_path / "solver.log"
    log.write_bytes(b"one\ntwo\r\nthr")
    other.write_bytes(b"no break yet")
    for max_bytes, part_bytes in ((1 << 20, 1 << 20), (1, 1)):
        log.write_bytes(b"one\ntwo\r\nthr")
        other.write_bytes(b"no break yet")
        reader = GrowingLogReader({"path": str(tmp_path), "max_bytes": str(max_bytes), "part_bytes": str(part_bytes)})
        at, rows = step(reader, reader.initialOffset())
        assert texts(rows) == [(4, "Run.out", 1, "one"), (4, "Run.out", 2, "two")] and [r[3] for r in rows] == [0, 4]
        at, rows = step(reader, at)
        assert rows == []
        with log.open("ab") as f:
            f.write(b"ee\n\n\xff\nlast")
        with other.open("ab") as f:
            f.write(b"\n")
        found = []
        for _ in range(6):
            at, rows = step(reader, at)
            found += rows
        assert texts(found) == [(0, "solver.log", 1, "no break yet"), (4, "Run.out", 3, "three"), (4, "Run.out", 4, ""), (4, "Run.out", 5, "\ufffd")]
        # After a restart the position comes from the checkpoint.
        again = GrowingLogReader({"path": str(tmp_path)})
        assert again.latestOffset() == at
        assert again.partitions(at, at) == []
        other.write_bytes(b"new\n")  # shorter than before: a new file
        end, rows = step(again, at)
        assert [r[4] for r in rows if r[0] is None] == ["new"]


def test_stretches_begin_with_lines(tmp_path):
    path = tmp_path / "a.log"
    lines = [b"x" * (k % 50) for k in range(200_000)]
    path.write_bytes(b"\n".join(lines) + b"\n")
    parts = whole_lines(str(path), 0, 0, 1 << 40, 1 << 20)
    assert len(parts) > 2 and parts[0].start == 0 and all(a.stop == b.start for a, b in zip(parts, parts[1:]))
    reader = GrowingLogReader({"path": str(tmp_path)})
    rows = [r for r in reader.read(LogParts(parts))]
    assert [r[2] for r in rows] == list(range(1, len(lines) + 1)) and [r[4].encode() for r in rows] == lines


def test_stream(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    (logs / "run=7").mkdir(parents=True)
    file = logs / "run=7" / "Run.out"
    want = 0
    for batch in range(3):
        with file.open("a") as f:
            f.write("".join(f"line {batch}.{k}\n" for k in range(50)) + "unfinished")
        want += 50
        stream = growing_logs(spark, str(logs)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        stream.trigger(availableNow=True).start().awaitTermination(60)
        rows = spark.read.parquet(out).orderBy("line_no").collect()
        assert [r.line_no for r in rows] == list(range(1, want + 1)) and {r.run_id for r in rows} == {7}
        assert rows[-1].line == f"line {batch}.49"
