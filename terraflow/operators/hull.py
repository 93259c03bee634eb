"""Convex hulls of large point groups, reduced in three levels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _chain(points: np.ndarray) -> list[np.ndarray]:
    """One side of the hull of lexicographically sorted points."""
    side: list[np.ndarray] = []
    for p in points:
        while len(side) > 1:
            (ax, ay), (bx, by) = side[-2], side[-1]
            if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                break
            side.pop()
        side.append(p)
    return side


def hull_ring(points: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise hull; up to two distinct points come back as they are."""
    pts = np.unique(np.asarray(points, dtype=float), axis=0)
    if len(pts) <= 2:
        return pts
    lower, upper = _chain(pts), _chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1] + lower[:1])


def _vertices(points: np.ndarray) -> np.ndarray:
    """Points that decide the ring: its corners, and one more where all lie on a line."""
    ring = hull_ring(points)
    if len(ring) != 3:
        return ring[:-1] if len(ring) > 3 else ring
    between = (points != ring[0]).any(axis=1) & (points != ring[1]).any(axis=1)
    return np.concatenate([ring[:2], points[between][:1]])


def drop_inner(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points that are not strictly inside the polygon of their group's extremes.

    The extremes in eight directions are points of the group, so what lies
    inside their polygon is no hull corner. Both aggregate and filter are plain
    Column work, and most points never reach Python.
    """
    keys = list(keys)
    x, y = F.col("x"), F.col("y")
    # Counter-clockwise from the left.
    ends = [
        (F.min_by, x), (F.min_by, x + y), (F.min_by, y), (F.max_by, x - y),
        (F.max_by, x), (F.max_by, x + y), (F.max_by, y), (F.min_by, x - y),
    ]
    aggs = [pick(c, along).alias(f"_{c}{i}") for i, (pick, along) in enumerate(ends) for c in ("x", "y")]
    corners = points.groupBy(*keys).agg(*aggs)
    distinct = F.size(F.array_distinct(F.array(*[F.struct(F.col(f"_x{i}").alias("x"), F.col(f"_y{i}").alias("y")) for i in range(8)])))
    corners = corners.withColumn("_area", distinct > 2)
    inside = F.col("_area")
    for i in range(8):
        ax, ay, bx, by = (F.col(f"_{c}{j}") for j in (i, (i + 1) % 8) for c in ("x", "y"))
        left = (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
        inside = inside & (((ax == bx) & (ay == by)) | left)
    return points.join(corners, keys).filter(~inside).select(*points.columns)


def convex_hulls(points: DataFrame, keys: Sequence[str], salt: int = 16) -> DataFrame:
    """One ring per group of (keys, x, y) rows.

    A hull of hulls is the hull. Points inside the extremes drop out first; then
    every Arrow batch keeps the hull vertices of its groups; the vertices are spread by (group, salt) and reduced the same
    way; only what is left of a group meets in one task.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    head = ", ".join(f"{k} {fields[k]}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xy = batch[["x", "y"]].to_numpy()
            kept = []
            for rows in batch.groupby(keys, sort=False).indices.values():
                kept.append((rows[0], _vertices(xy[rows])))
            if kept:
                first = np.repeat([row for row, _ in kept], [len(r) for _, r in kept])
                out = batch[keys].iloc[first].reset_index(drop=True)
                out[["x", "y"]] = np.concatenate([r for _, r in kept])
                yield out

    def closed(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull_ring(pdf[["x", "y"]].to_numpy())
        row = {k: [pdf[k].iloc[0]] for k in keys}
        row["ring"] = [[{"x": float(a), "y": float(b)} for a, b in ring]]
        return pd.DataFrame(row)

    narrow = f"{head}, x double, y double"
    narrowed = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    reduced = drop_inner(narrowed, keys).mapInPandas(partial, narrow)
    reduced = (
        reduced.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(salt)))
        .repartition(*keys, "_salt")
        .drop("_salt")
        .mapInPandas(partial, narrow)
    )
    return reduced.groupBy(*keys).applyInPandas(closed, f"{head}, ring {RING}")


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 for rings of fewer than 4 points."""
    nxt = F.slice(ring, F.lit(2), F.size(ring) - 1)
    here = F.slice(ring, F.lit(1), F.size(ring) - 1)
    terms = F.zip_with(here, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.size(ring) >= 4, F.abs(total) * 0.5).otherwise(F.lit(0.0))
