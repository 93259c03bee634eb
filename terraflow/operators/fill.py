"""Depression filling with a largest fill depth.

Level of a cell: the lowest water level that reaches it from the raster edge. A
cell is raised to the lowest level among its open neighbours when the raise is
within the limit; a deeper pit keeps its elevation and passes no water. Levels
only fall while the solution is refined, so the fixed point is unique and may be
reached tile by tile: each tile is solved with the levels around it, and a tile
is solved again only when those changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.operators.stencil import CELL, DIRECTIONS
from terraflow.operators.tiles import DEFAULT_TILE, TILE, border_offsets, pack_tiles, tile_of, unpack, with_tile
from terraflow.session import materialize, materialize_some


#: Sweeps that are tried before a tile is flooded cell by cell.
SWEEPS = 48


def solve_tile(z: np.ndarray, level: np.ndarray, seed: np.ndarray, max_depth: float, sweeps: int = SWEEPS) -> np.ndarray:
    """Levels of a tile with a one-cell frame; infinite where no water comes.

    Sweeps over the whole tile solve open terrain quickest. Where water winds
    through a valley they would be many, so the flood takes over.
    """
    n, m = z.shape
    inner = (slice(1, n - 1), slice(1, m - 1))
    ground = z[inner]
    dry = np.isnan(ground)
    for _ in range(sweeps):
        low = np.full(ground.shape, np.inf)
        for dr, dc in DIRECTIONS:
            np.minimum(low, level[1 + dr:n - 1 + dr, 1 + dc:m - 1 + dc], out=low)
        with np.errstate(invalid="ignore"):
            new = np.where(low <= ground, ground, np.where(low - ground <= max_depth, low, np.inf))
        new[dry] = np.inf
        new = np.where(seed, ground, new)
        if np.array_equal(new, level[inner]):
            return level
        level[inner] = new
    return flood_tile(z, level, seed, max_depth)


def flood_tile(z: np.ndarray, level: np.ndarray, seed: np.ndarray, max_depth: float) -> np.ndarray:
    """As :func:`solve_tile`, lowest level first: the first neighbour that reaches a cell is its lowest."""
    n, m = z.shape
    ground = z.ravel().tolist()
    inside = np.zeros((n, m), bool)
    inside[1:-1, 1:-1] = True
    start = np.where(inside, np.inf, level)
    start[1:-1, 1:-1] = np.where(seed, z[1:-1, 1:-1], np.inf)
    out = start.ravel().tolist()
    open_cells = bytearray((inside & ~np.isnan(z) & ~np.isfinite(start)).astype(np.uint8).tobytes())
    heap = [(out[i], i) for i in np.flatnonzero(np.isfinite(start)).tolist()]
    heapq.heapify(heap)
    # Steps never leave the grid: only cells inside are open, and frame cells look inwards only.
    steps = [dr * m + dc for dr, dc in DIRECTIONS]
    last = n * m
    while heap:
        low, at = heapq.heappop(heap)
        for step in steps:
            i = at + step
            if 0 <= i < last and open_cells[i] and abs(i % m - at % m) <= 1:
                open_cells[i] = 0
                g = ground[i]
                if low <= g:
                    out[i] = g
                elif low - g <= max_depth:
                    out[i] = low
                else:
                    continue
                heapq.heappush(heap, (out[i], i))
    level[:] = np.array(out).reshape(n, m)
    return level


def fill_depressions(
    cells: DataFrame, rasters: DataFrame, max_depth: float = 5.0, tile: int = DEFAULT_TILE
) -> DataFrame:
    """Valid cells with ``z`` and the conditioned ``filled`` elevation."""
    size = rasters.select("raster_id", "width", "height")
    packed = materialize(pack_tiles(cells.filter("z IS NOT NULL"), "z", tile).join(size, "raster_id"), "ztiles")
    rim = border_offsets(tile)

    def solve(t) -> tuple[np.ndarray, np.ndarray]:
        r0, c0 = t.tile_row * tile, t.tile_col * tile
        z = np.full((tile + 2, tile + 2), np.nan)
        z[1:-1, 1:-1] = unpack(t.offsets, t.values, tile, np.nan).reshape(tile, tile)
        level = np.full(z.shape, np.inf)
        if t.hr is not None:
            level[np.asarray(t.hr) - r0 + 1, np.asarray(t.hc) - c0 + 1] = np.asarray(t.hv)
        row, col = np.arange(r0, r0 + tile)[:, None], np.arange(c0, c0 + tile)[None, :]
        edge = (row == 0) | (row == t.height - 1) | (col == 0) | (col == t.width - 1)
        seed = edge & ~np.isnan(z[1:-1, 1:-1])
        return z[1:-1, 1:-1].ravel(), solve_tile(z, level, seed, max_depth)[1:-1, 1:-1].ravel()

    def rims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                _, level = solve(t)
                at = rim[np.isfinite(level[rim])]
                yield pd.DataFrame(
                    {
                        "raster_id": t.raster_id, "row_idx": t.tile_row * tile + at // tile,
                        "col_idx": t.tile_col * tile + at % tile, "level": level[at],
                    }
                )

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                z, level = solve(t)
                at = np.flatnonzero(~np.isnan(z))
                yield pd.DataFrame(
                    {
                        "raster_id": t.raster_id, "row_idx": t.tile_row * tile + at // tile,
                        "col_idx": t.tile_col * tile + at % tile, "z": z[at],
                        "filled": np.where(np.isfinite(level[at]), level[at], z[at]),
                    }
                )

    rim_ddl = "raster_id int, row_idx int, col_idx int, level double"
    none = F.lit(None)
    bare = packed.select("*", none.cast("array<int>").alias("hr"), none.cast("array<int>").alias("hc"), none.cast("array<double>").alias("hv"))
    levels, some = materialize_some(bare.mapInPandas(rims, rim_ddl), "levels")
    changed = levels
    while some:
        active = _neighbour_tiles(changed, tile).select(*TILE).distinct()
        again = packed.join(active, TILE, "left_semi").join(_frames(levels, tile, active), TILE, "left")
        solved = again.mapInPandas(rims, rim_ddl)
        old = levels.select(*CELL, F.col("level").alias("old"))
        both, some = materialize_some(
            old.join(solved, CELL, "full").select(
                *CELL, F.least("level", "old").alias("level"),
                (F.col("level") < F.coalesce("old", F.lit(float("inf")))).alias("fell"),
            ),
            "levels", F.col("fell"),
        )
        levels, changed = both.drop("fell"), both.filter("fell").drop("fell")
    return packed.join(_frames(levels, tile), TILE, "left").mapInPandas(
        whole, "raster_id int, row_idx int, col_idx int, z double, filled double"
    )


def _neighbour_tiles(levels: DataFrame, tile: int) -> DataFrame:
    """Rim cells beside each other tile they touch."""
    here = with_tile(levels, tile).withColumnsRenamed({"tile_row": "_r", "tile_col": "_c"})
    beside = F.array_distinct(
        F.array(
            *[
                F.struct(
                    tile_of(F.col("row_idx") + dr, tile).alias("tile_row"),
                    tile_of(F.col("col_idx") + dc, tile).alias("tile_col"),
                )
                for dr, dc in DIRECTIONS
            ]
        )
    )
    return here.withColumn("t", F.explode(beside)).select(*CELL, "level", "_r", "_c", "t.*").filter(
        "tile_row <> _r OR tile_col <> _c"
    ).drop("_r", "_c")


def _frames(levels: DataFrame, tile: int, only: DataFrame | None = None) -> DataFrame:
    """Levels around each tile (of ``only``); at most one frame of cells per tile."""
    cell = F.struct("row_idx", "col_idx", "level")
    beside = _neighbour_tiles(levels, tile)
    if only is not None:
        beside = beside.join(only, TILE, "left_semi")
    packed = beside.groupBy(*TILE).agg(F.collect_list(cell).alias("h"))
    return packed.select(
        *TILE, F.col("h.row_idx").alias("hr"), F.col("h.col_idx").alias("hc"), F.col("h.level").alias("hv")
    )


def fill_stats(filled: DataFrame) -> DataFrame:
    """Elevations before and after, cells raised by over 1e-6, largest raise."""
    rise = F.col("filled") - F.col("z")
    raised = rise > 1e-6
    return filled.groupBy("raster_id").agg(
        F.min("z").alias("orig_min"), F.max("z").alias("orig_max"), F.avg("z").alias("orig_mean"),
        F.min("filled").alias("cond_min"), F.max("filled").alias("cond_max"), F.avg("filled").alias("cond_mean"),
        F.count_if(raised).alias("num_modified"), F.coalesce(F.max(F.when(raised, rise)), F.lit(0.0)).alias("max_change"),
        (F.count_if(raised) / F.count(F.lit(1)) * 100.0).alias("pct_modified"),
    )
