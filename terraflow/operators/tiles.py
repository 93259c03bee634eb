"""Cell tables cut into square tiles, one row per tile.

A tile row holds the cells of one tile as two arrays (offset in the tile,
value). A tile has at most ``tile * tile`` cells, so its size does not grow with
the raster. Tile tables are written once and read by every pass of an iterative
operator; between passes only tile borders move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = ["raster_id", "tile_row", "tile_col"]
DEFAULT_TILE = 256


def tile_of(position: Column, tile: int) -> Column:
    return F.floor(position / tile).cast("int")


def with_tile(df: DataFrame, tile: int, row: str = "row_idx", col: str = "col_idx") -> DataFrame:
    return df.withColumns({"tile_row": tile_of(F.col(row), tile), "tile_col": tile_of(F.col(col), tile)})


def pack_tiles(cells: DataFrame, value: str, tile: int) -> DataFrame:
    """One row per tile: cell offsets and values in the same order."""
    offset = (
        F.pmod(F.col("row_idx"), F.lit(tile)) * tile + F.pmod(F.col("col_idx"), F.lit(tile))
    ).cast("int")
    rows = with_tile(cells, tile).select(*TILE, F.struct(offset.alias("o"), F.col(value).cast("double").alias("v")).alias("c"))
    packed = rows.groupBy(*TILE).agg(F.collect_list("c").alias("c"))
    return packed.select(*TILE, F.col("c.o").alias("offsets"), F.col("c.v").alias("values"))


def unpack(offsets: np.ndarray, values: np.ndarray, tile: int, empty: float) -> np.ndarray:
    """Dense tile from its arrays."""
    grid = np.full(tile * tile, empty, dtype=float)
    grid[np.asarray(offsets, dtype=np.int64)] = np.asarray(values, dtype=float)
    return grid


def border_offsets(tile: int) -> np.ndarray:
    """Offsets of the cells on the rim of a tile."""
    r, c = np.divmod(np.arange(tile * tile), tile)
    return np.flatnonzero((r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1))
