"""Particle frames in legacy VTK polydata files, text or binary.

A file is indexed first. Only its declarations are parsed; values between them
are passed over (binary) or counted in chunks (text). The index is dealt into
parts: some rows, and the bytes where each array holds them. A part is read
without the rest of its file, so neither a row nor a task holds a whole frame.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import numpy as np
import pandas as pd

# Scalar type names of legacy VTK files and their widths.
VTK_DTYPES = {
    "char": "i1", "unsigned_char": "u1", "short": "i2", "unsigned_short": "u2", "int": "i4", "unsigned_int": "u4",
    "long": "i8", "unsigned_long": "u8", "float": "f4", "double": "f8",
}
POSITIONS = "\0points"
#: Bytes looked at for one declaration, and read at once where text is counted.
WINDOW, CHUNK = 1 << 16, 1 << 20

_HEADER = re.compile(rb"# vtk DataFile Version[^\n]*\n[^\n]*\n\s*(?P<coding>ASCII|BINARY)\s*\n\s*DATASET\s+(?P<dataset>\w+)[ \t]*\r?\n", re.I)
_END = rb"[ \t]*(?:\r?\n|\Z)"
_DECLARATION = re.compile(
    rb"\s*(?:POINTS\s+(?P<points>\d+)\s+(?P<points_type>\w+)"
    rb"|(?:VERTICES|LINES|POLYGONS|TRIANGLE_STRIPS)\s+\d+\s+(?P<indices>\d+)"
    rb"|POINT_DATA\s+(?P<point_data>\d+)"
    rb"|SCALARS\s+(?P<scalar>\S+)\s+(?P<scalar_type>\w+)(?:[ \t]+(?P<scalar_width>\d+))?[ \t]*\r?\n\s*LOOKUP_TABLE\s+\S+"
    rb"|(?:VECTORS|NORMALS)\s+(?P<vector>\S+)\s+(?P<vector_type>\w+)"
    rb"|FIELD\s+\S+\s+(?P<fields>\d+)"
    rb"|(?P<stop>CELL_DATA\s+\d+|METADATA))" + _END,
    re.I,
)
_FIELD = re.compile(rb"\s*(?P<name>\S+)\s+(?P<width>\d+)\s+(?P<rows>\d+)\s+(?P<type>\w+)" + _END)


class FrameError(ValueError):
    """A frame file that is not readable particle data."""


class _Source:
    """A seekable file and its size."""

    def __init__(self, file: IO[bytes]):
        self.file, self.size = file, file.seek(0, os.SEEK_END)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def after_blanks(self, at: int) -> int:
        while chunk := self.read(at, WINDOW):
            if rest := chunk.lstrip():
                return at + len(chunk) - len(rest)
            at += len(chunk)
        return at


@dataclass(frozen=True)
class Block:
    """Values of one declaration: ``rows`` by ``width``.

    ``marks`` are the bytes where each so many rows begin, and the byte behind the last.
    """

    name: str | None
    rows: int
    width: int
    kind: str
    binary: bool
    marks: list[int]


def _text_marks(source: _Source, at: int, values: int, every: int) -> list[int]:
    """Bytes where each ``every`` of ``values`` numbers begin, and the byte behind the last."""
    marks: list[int] = []
    seen, blank, place = 0, True, at
    while values and (chunk := source.read(place, CHUNK)):
        codes = np.frombuffer(chunk, np.uint8)
        space = codes <= 32
        begins = np.flatnonzero(~space & np.concatenate([[blank], space[:-1]]))[: values - seen]
        first = codes[begins] | 32
        if ((first >= ord("a")) & (first <= ord("z")) & (first != ord("n")) & (first != ord("i"))).any():
            raise FrameError(f"byte {at}: words among {values} values")
        marks += (place + begins[(-seen) % every :: every]).tolist()
        seen += len(begins)
        if seen == values:
            last = int(begins[-1]) if len(begins) else 0
            if len(ends := np.flatnonzero(space[last:])):
                return [*marks, place + last + int(ends[0])]
        place, blank = place + len(chunk), bool(space[-1])
    if seen < values:
        raise FrameError(f"byte {at}: {seen} values in place of {values}")
    return [*marks, place]


def _block(source: _Source, at: int, binary: bool, every: int, name: str | None, rows: int, width: int, kind: bytes) -> Block:
    code = VTK_DTYPES.get(kind.decode("ascii", "replace").lower())
    if code is None:
        raise FrameError(f"byte {at}: values of type {kind!r} are not known")
    if not binary:
        return Block(name, rows, width, code, binary, _text_marks(source, at, rows * width, max(1, every * width)))
    size = width * np.dtype(code).itemsize
    stop = at + rows * size
    if stop > source.size:
        raise FrameError(f"byte {at}: {stop - source.size} bytes are missing")
    return Block(name, rows, width, code, binary, [*range(at, stop, max(1, every * size)), stop])


def blocks(source: _Source, every: int) -> Iterator[Block]:
    """All blocks of a file in their order, up to cell data, marked at each ``every`` rows."""
    header = _HEADER.match(source.read(0, WINDOW))
    if header is None or header["dataset"].upper() != b"POLYDATA":
        raise FrameError("no header of legacy polydata")
    binary, at, points = header["coding"].upper() == b"BINARY", header.end(), 0
    while (at := source.after_blanks(at)) < source.size:
        m = _DECLARATION.match(source.read(at, WINDOW))
        if m is None:
            raise FrameError(f"byte {at}: no known declaration")
        at += m.end()
        wanted: list[tuple[str | None, int, int, bytes]] = []
        if m["stop"]:
            return
        if m["points"]:
            points = int(m["points"])
            wanted.append((POSITIONS, points, 3, m["points_type"]))
        elif m["indices"]:
            wanted.append((None, int(m["indices"]), 1, b"int"))
        elif m["point_data"]:
            points = int(m["point_data"])
        elif m["scalar"]:
            wanted.append((m["scalar"].decode(), points, int(m["scalar_width"] or 1), m["scalar_type"]))
        elif m["vector"]:
            wanted.append((m["vector"].decode(), points, 3, m["vector_type"]))
        for part in wanted:
            block = _block(source, at, binary, every, *part)
            yield block
            at = block.marks[-1]
        for _ in range(int(m["fields"] or 0)):
            at = source.after_blanks(at)
            f = _FIELD.match(source.read(at, WINDOW))
            if f is None:
                raise FrameError(f"byte {at}: an array of a field is missing")
            block = _block(source, at + f.end(), binary, every, f["name"].decode(), int(f["rows"]), int(f["width"]), f["type"])
            yield block
            at = block.marks[-1]


#: Column, array of the file, column of the array.
COLUMNS = (
    ("x", POSITIONS, 0), ("y", POSITIONS, 1), ("z", POSITIONS, 2), ("vx", "Vel", 0), ("vy", "Vel", 1), ("vz", "Vel", 2),
    ("idp", "Idp", 0), ("press", "Press", 0), ("rhop", "Rhop", 0), ("type", "Type", 0),
)


def frame_parts(file: IO[bytes], path: str, part_rows: int) -> list[dict]:
    """The parts of a frame: number of rows, and where each known array holds them."""
    try:
        index = {b.name: b for b in blocks(_Source(file), part_rows)}
        if POSITIONS not in index:
            raise FrameError("no positions")
        points = index[POSITIONS].rows
        for _, array, k in COLUMNS:
            b = index.get(array)
            if b is not None and (b.rows != points or b.width <= k):
                raise FrameError(f"{array}: {b.rows} x {b.width} values for {points} points")
    except FrameError as error:
        raise FrameError(f"{path}: {error}") from None
    held = [index[a] for a in dict.fromkeys(a for _, a, _ in COLUMNS) if a in index]
    return [
        {
            "rows": min(part_rows, points - i * part_rows),
            "arrays": [{"name": b.name, "width": b.width, "kind": b.kind, "binary": b.binary, "start": b.marks[i], "stop": b.marks[i + 1]} for b in held],
        }
        for i in range(-(-points // part_rows))
    ]


def read_part(file: IO[bytes], path: str, part: dict) -> dict[str, np.ndarray | None]:
    """Values of each column in one part; None where the file lacks the array."""
    arrays = {}
    for a in part["arrays"]:
        file.seek(a["start"])
        raw = file.read(a["stop"] - a["start"])
        dtype = np.dtype(a["kind"])
        try:
            flat = np.frombuffer(raw, dtype.newbyteorder(">")) if a["binary"] else np.array(raw.split(), float)
            arrays[a["name"]] = flat.astype(dtype).reshape(part["rows"], a["width"])
        except ValueError as error:
            raise FrameError(f"{path}: bytes {a['start']} to {a['stop']}: {error}") from None
    return {c: arrays[a][:, k] if a in arrays else None for c, a, k in COLUMNS}


def decode_frame(raw: bytes, path: str) -> pd.DataFrame:
    """One row per particle; columns whose array the file lacks are null."""
    file = io.BytesIO(raw)
    parts = [pd.DataFrame({"path": [path] * p["rows"]} | read_part(file, path, p)) for p in frame_parts(file, path, 1 << 20)]
    return pd.concat(parts) if parts else pd.DataFrame(columns=["path", *[c for c, _, _ in COLUMNS]])


def encode_frame(particles: pd.DataFrame) -> bytes:
    """A binary file of positions, ids, and a field with the other arrays that the frame has."""
    n = len(particles)
    stored = [("Vel", ["vx", "vy", "vz"], "float", ">f4"), ("Press", ["press"], "float", ">f4"), ("Rhop", ["rhop"], "float", ">f4"), ("Type", ["type"], "unsigned_char", ">u1")]
    stored = [s for s in stored if set(s[1]) <= set(particles.columns)]
    parts = [
        b"# vtk DataFile Version 3.0\nparticles\nBINARY\nDATASET POLYDATA\n",
        f"POINTS {n} float\n".encode(), particles[["x", "y", "z"]].to_numpy(">f4").tobytes(),
        f"\nPOINT_DATA {n}\nSCALARS Idp unsigned_int\nLOOKUP_TABLE default\n".encode(), particles["idp"].to_numpy(">u4").tobytes(),
        f"\nFIELD FieldData {len(stored)}\n".encode(),
    ]
    for name, columns, kind, dtype in stored:
        parts += [f"{name} {len(columns)} {n} {kind}\n".encode(), particles[columns].to_numpy(dtype).tobytes(), b"\n"]
    return b"".join(parts)
