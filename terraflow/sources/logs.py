"""A streaming source of plain log files that grow.

``spark.readStream.format("growing_logs").load(folder)`` gives each line of the files below a
folder once, when its line break has arrived: run (from the folder or file name, null
without one), file, line_no (from 1 in its file), byte offset and text. The position of a file is
its number of bytes and lines so far; it is kept in the checkpoint of the query. A
batch takes at most ``max_bytes`` of new text; the driver looks through just these
bytes for the last line break and the number of lines, and tasks read and split them,
each a stretch of at most ``part_bytes`` that begins with a line.

After a restart the reader looks through the files once more, as only Spark knows where it was, and
the first batch takes all there is.

A file that has become shorter is taken for a new one and read from its beginning.
Lines end at ``\\n``, and a ``\\r`` before it belongs to the break; bytes that aren't UTF-8 become the replacement
character. An unfinished last line waits; one longer than ``max_bytes`` widens the batch until its break.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "run_id long, file string, line_no long, offset long, line string"
RUN = re.compile(r"run(?:_id)?=(\d+)[/.]")
CHUNK = 1 << 20


def _files(folder: str) -> list[str]:
    """All files below a folder, by name."""
    if "://" not in folder or folder.startswith("file:"):
        root = folder.removeprefix("file://").removeprefix("file:")
        return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n[0] not in "._")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    head = folder[: len(folder.rstrip("/")) - len(inner.rstrip("/"))]
    return sorted(head + f.path for f in found if f.is_file and f.base_name[0] not in "._")


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _size(file) -> int:
    return file.seek(0, os.SEEK_END)


class LogPart:
    """Bytes ``start`` to ``stop`` of a file, whole lines, with ``line`` lines before them."""

    def __init__(self, path: str, start: int, stop: int, line: int):
        self.path, self.start, self.stop, self.line, self.lines_after = path, start, stop, line, line


class LogParts(InputPartition):
    """What one task reads: a stretch of a large file, or several small files."""

    def __init__(self, parts: list[LogPart]):
        self.parts = parts


def whole_lines(path: str, start: int, line: int, limit: int, part_bytes: int) -> list[LogPart]:
    """Stretches of whole lines from ``start`` (before which ``line`` lines lie), ``limit`` bytes or one line at least if finished."""
    parts: list[LogPart] = []
    with _open(path) as file:
        size = _size(file)
        file.seek(start)
        begin, at, lines, count, last = start, start, line, 0, start  # last: behind the last break seen
        while at < size and (at - start < limit or last == start):
            chunk = file.read(min(CHUNK, size - at, limit - (at - start) if at - start < limit else CHUNK))
            if not chunk:
                break
            cut = chunk.rfind(b"\n") + 1
            if cut:
                count += chunk.count(b"\n")
                last = at + cut
                if last - begin >= part_bytes:
                    parts.append(LogPart(path, begin, last, lines))
                    begin, lines, count = last, lines + count, 0
            at += len(chunk)
    if last > begin:
        parts.append(LogPart(path, begin, last, lines))
        lines += count
    if parts:
        parts[-1].lines_after = lines
    return parts


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.max_bytes = int(options.get("max_bytes", 64 << 20))
        self.part_bytes = int(options.get("part_bytes", 8 << 20))
        # Where the last batch ended; unknown to a reader that takes up the work of an earlier one.
        self.position: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        self.position = {}
        return {"files": "{}"}

    def _held(self, offset: dict) -> dict[str, list[int]]:
        return json.loads(offset["files"])

    def _steps(self, held: dict[str, list[int]], room: int) -> Iterator[tuple[str, list[LogPart]]]:
        for path in _files(self.folder):
            start, line = held.get(path, (0, 0))
            with _open(path) as file:
                size = _size(file)
            if size < start:
                start, line = 0, 0
            if size > start and room > 0:
                parts = whole_lines(path, start, line, room, self.part_bytes)
                if parts:
                    room -= parts[-1].stop - start
                    yield path, parts

    def latestOffset(self) -> dict:
        room = self.max_bytes if self.position is not None else 1 << 62
        self.position = self.position or {}
        for path, parts in self._steps(dict(self.position), room):
            self.position[path] = [parts[-1].stop, parts[-1].lines_after]
        return {"files": json.dumps(self.position, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[LogParts]:
        before, after = self._held(start), self._held(end)
        self.position = dict(after) if self.position is None else self.position
        out: list[LogPart] = []
        for path, (stop, _) in sorted(after.items()):
            begin, line = before.get(path, (0, 0))
            if stop < begin:
                begin, line = 0, 0
            if stop > begin:
                found = whole_lines(path, begin, line, stop - begin, self.part_bytes)
                for part in found:
                    if part.start < stop:
                        part.stop = min(part.stop, stop)
                        out.append(part)
        tasks: list[LogParts] = []
        room = 0
        for part in out:
            if room < part.stop - part.start or not tasks:
                tasks.append(LogParts([]))
                room = max(1, self.part_bytes // 8)
            tasks[-1].parts.append(part)
            room -= part.stop - part.start
        return tasks

    def read(self, partition: LogParts) -> Iterator[tuple]:
        for part in partition.parts:
            yield from self._lines(part)

    def _lines(self, part: LogPart) -> Iterator[tuple]:
        run = RUN.search(part.path)
        with _open(part.path) as file:
            file.seek(part.start)
            at, no, rest = part.start, part.line, b""
            while at < part.stop:
                chunk = file.read(min(CHUNK, part.stop - at))
                at += len(chunk)
                *lines, tail = (rest + chunk).split(b"\n")
                place = at - len(rest) - len(chunk)
                for raw in lines:
                    no += 1
                    yield (int(run[1]) if run else None, part.path, no, place, raw.removesuffix(b"\r").decode("utf-8", "replace"))
                    place += len(raw) + 1
                rest = tail

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLogReader:
        return GrowingLogReader(dict(self.options))


def growing_logs(spark: SparkSession, folder: str, **options: str):
    """The stream of all finished lines below a folder."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(folder)
