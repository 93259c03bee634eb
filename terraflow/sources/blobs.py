"""Files with given bytes on shared storage, written and opened by tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import IO
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame


def open_file(path: str) -> IO[bytes]:
    """A seekable file under the path that Spark gives for it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return open("/" + rest.lstrip("/") if colon and scheme == "file" else path, "rb")  # noqa: SIM115
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def put(root: str, path: str, content: bytes) -> None:
    """One file under ``root``; it appears whole, and a repeated write leaves the same file."""
    url = urlparse(root)
    name = f"{path}.{uuid.uuid4().hex}.part"
    if url.scheme in ("", "file"):
        target = os.path.join(url.path, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(os.path.join(url.path, name), "wb") as out:
            out.write(content)
        os.replace(os.path.join(url.path, name), target)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(root)
    system.create_dir(f"{inner}/{path}".rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{inner}/{name}") as out:
        out.write(content)
    system.move(f"{inner}/{name}", f"{inner}/{path}")


def write_blobs(files: DataFrame, root: str) -> int:
    """Writes the (path, content) rows under ``root``; returns how many."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                put(root, path, bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.mapInPandas(save, "n long").groupBy().sum("n").first()[0] or 0
