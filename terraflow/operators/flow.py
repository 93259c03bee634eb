"""Flow accumulation, downstream paths and flood corridors on D8 directions.

``directions`` has (raster_id, row_idx, col_idx, dir) for valid cells. Following
directions may end in a cycle, so every operator here is cycle-safe.

Accumulation and tracing work tile by tile and then on a link graph of the
cells where flow leaves a tile. That graph is about as large as the tile
perimeters and is solved by pointer doubling, in a number of rounds that grows
with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.operators.stencil import CELL, DIRECTIONS
from terraflow.operators.tiles import DEFAULT_TILE, TILE, border_offsets, pack_tiles, tile_of, unpack, with_tile
from terraflow.session import materialize, materialize_some

STEP_ROW = np.array([d[0] for d in DIRECTIONS])
STEP_COL = np.array([d[1] for d in DIRECTIONS])
_TILE_DDL = "raster_id int, tile_row int, tile_col int"


class _LocalFlow:
    """Drainage inside one tile: the next cell, cells that leave, peel order."""

    def __init__(self, offsets: np.ndarray, dirs: np.ndarray, tile: int, cut: np.ndarray | None = None):
        d = unpack(offsets, dirs, tile, -2.0).astype(int)
        self.valid = d > -2
        r, c = np.divmod(np.arange(tile * tile), tile)
        safe = np.maximum(d, 0)
        self.to_row, self.to_col = r + STEP_ROW[safe], c + STEP_COL[safe]
        flows = d >= 0
        local = flows & (self.to_row >= 0) & (self.to_row < tile) & (self.to_col >= 0) & (self.to_col < tile)
        self.leaves = flows & ~local
        self.next = np.where(local, self.to_row * tile + self.to_col, -1)
        if cut is not None and len(cut):
            self.blocked = self._downstream(cut)
            self.next[self.blocked] = -1
            self.leaves[self.blocked] = False

    def _downstream(self, starts: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.next), dtype=bool)
        front = np.unique(starts)
        while len(front):
            seen[front] = True
            front = self.next[front]
            front = np.unique(front[front >= 0])
            front = front[~seen[front]]
        return np.flatnonzero(seen)

    def accumulate(self, inflow: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells drained per cell; cells on a cycle receive but never pass on."""
        acc = np.where(self.valid, 1, 0) + inflow
        waiting = np.bincount(self.next[self.next >= 0], minlength=len(self.next))
        front = np.flatnonzero(self.valid & (waiting == 0))
        levels = []
        while len(front):
            levels.append(front)
            down = front[self.next[front] >= 0]
            goal = self.next[down]
            np.add.at(acc, goal, acc[down])
            np.subtract.at(waiting, goal, 1)
            goal = np.unique(goal)
            front = goal[waiting[goal] == 0]
        return acc, levels

    def last_cell(self, levels: list[np.ndarray]) -> np.ndarray:
        """The cell where the way from each cell leaves the tile, -1 if it does not."""
        last = np.full(len(self.next), -1)
        for cells in reversed(levels):
            nxt = self.next[cells]
            last[cells] = np.where(self.leaves[cells], cells, np.where(nxt >= 0, last[nxt], -1))
        return last


def direction_tiles(directions: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Written tile table of directions, shared by the operators below."""
    return materialize(pack_tiles(directions, "dir", tile), "dirtiles")


def _links(tiles: DataFrame, tile: int) -> DataFrame:
    """Per tile border cell: where its way leaves the tile, and what leaves there."""
    rim = border_offsets(tile)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                flow = _LocalFlow(t.offsets, t.values, tile)
                acc, levels = flow.accumulate(np.zeros(tile * tile, dtype=np.int64))
                last = flow.last_cell(levels)
                cells = rim[flow.valid[rim]]
                r0, c0 = t.tile_row * tile, t.tile_col * tile
                yield pd.DataFrame(
                    {
                        "raster_id": t.raster_id,
                        "cell": _ids(cells, r0, c0, tile),
                        "last": [None if x < 0 else int(i) for x, i in zip(last[cells], _ids(last[cells], r0, c0, tile))],
                        "leaves": flow.leaves[cells],
                        "goal": (r0 + flow.to_row[cells]) * 2**32 + c0 + flow.to_col[cells],
                        "amount": acc[cells],
                    }
                ).astype({"last": "Int64"})

    return tiles.mapInPandas(local, "raster_id int, cell long, last long, leaves boolean, goal long, amount long")


def _ids(offsets: np.ndarray, r0: int, c0: int, tile: int) -> np.ndarray:
    r, c = np.divmod(offsets, tile)
    return (r0 + r).astype(np.int64) * 2**32 + c0 + c


NODE = ["raster_id", "node"]


def _cyclic_nodes(links: DataFrame) -> DataFrame:
    """Nodes of a (raster_id, node, nxt) graph that lie on a cycle.

    After 2**k steps only nodes with a longer way are left. When two rounds
    reach the same number of nodes, all of those repeat forever.
    """
    now, some = materialize_some(links.filter("nxt IS NOT NULL").select(*NODE, "nxt"), "jump")
    reached = -1
    while some:
        left = now.agg(F.count_distinct("raster_id", "nxt").alias("n")).first()["n"]
        if left == reached:
            break
        reached = left
        ahead = now.select("raster_id", F.col("node").alias("nxt"), F.col("nxt").alias("after"))
        now, some = materialize_some(
            now.join(ahead, ["raster_id", "nxt"]).select(*NODE, F.col("after").alias("nxt")), "jump"
        )
    return now.select("raster_id", F.col("nxt").alias("node")).distinct()


def _upstream_totals(nodes: DataFrame) -> DataFrame:
    """Sum of ``amount`` over everything upstream of each node of a forest.

    Each round a node holds the sum over its nodes within 2**k steps and knows
    the node 2**k steps ahead, to which it passes that sum.
    """
    more = F.col("nxt").isNotNull()
    now, some = materialize_some(nodes.select(*NODE, "nxt", "amount"), "totals", more)
    while some:
        passed = now.filter("nxt IS NOT NULL").groupBy("raster_id", F.col("nxt").alias("node")).agg(
            F.sum("amount").alias("passed")
        )
        ahead = now.select("raster_id", F.col("node").alias("nxt"), F.col("nxt").alias("after"))
        now, some = materialize_some(
            now.join(passed, NODE, "left").join(ahead, ["raster_id", "nxt"], "left").select(
                *NODE, F.col("after").alias("nxt"), (F.col("amount") + F.coalesce("passed", F.lit(0))).alias("amount")
            ),
            "totals", more,
        )
    return now.drop("nxt")


def flow_accumulation(directions: DataFrame, tile: int = DEFAULT_TILE, tiles: DataFrame | None = None) -> DataFrame:
    """Number of cells that drain through each valid cell, itself included.

    Cells on a cycle receive inflow from outside the cycle and pass nothing on.
    """
    tiles = direction_tiles(directions, tile) if tiles is None else tiles
    rim = materialize(_links(tiles, tile), "links")
    leaving = rim.filter("leaves").select("raster_id", F.col("cell").alias("node"), "goal", "amount")
    arrives = rim.select("raster_id", F.col("cell").alias("goal"), F.col("last").alias("nxt"))
    nodes = leaving.join(arrives, ["raster_id", "goal"], "left")
    cyclic = materialize(_cyclic_nodes(nodes), "cyclic").withColumn("cyclic", F.lit(True))
    marked = nodes.join(cyclic, NODE, "left").join(
        cyclic.select("raster_id", F.col("node").alias("nxt"), F.col("cyclic").alias("_next_cyclic")),
        ["raster_id", "nxt"], "left",
    )
    forest = marked.filter("cyclic IS NULL").withColumn("nxt", F.when(F.col("_next_cyclic").isNull(), F.col("nxt")))
    totals = _upstream_totals(forest)
    into = (
        marked.join(totals.select(*NODE, F.col("amount").alias("total")), NODE, "left")
        .groupBy("raster_id", "goal")
        .agg(F.sum(F.coalesce("total", F.lit(0))).alias("inflow"), F.bool_or(F.col("cyclic").isNotNull()).alias("cut"))
    )
    row, col = F.shiftright("goal", 32).cast("int"), F.col("goal").bitwiseAND(2**32 - 1).cast("int")
    per_tile = with_tile(into.withColumns({"row_idx": row, "col_idx": col}), tile).groupBy(*TILE).agg(
        F.collect_list(F.struct("row_idx", "col_idx", "inflow", "cut")).alias("e")
    )
    per_tile = per_tile.select(
        *TILE, F.col("e.row_idx").alias("er"), F.col("e.col_idx").alias("ec"), F.col("e.inflow").alias("ev"),
        F.col("e.cut").alias("ex"),
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                r0, c0 = t.tile_row * tile, t.tile_col * tile
                inflow = np.zeros(tile * tile, dtype=np.int64)
                cut = None
                if t.er is not None:
                    entry = (np.asarray(t.er) - r0) * tile + np.asarray(t.ec) - c0
                    inflow[entry] = np.asarray(t.ev, dtype=np.int64)
                    cut = entry[np.asarray(t.ex, dtype=bool)]
                flow = _LocalFlow(t.offsets, t.values, tile, cut)
                acc, _ = flow.accumulate(inflow)
                cells = np.flatnonzero(flow.valid)
                yield pd.DataFrame(
                    {"raster_id": t.raster_id, "row_idx": r0 + cells // tile, "col_idx": c0 + cells % tile, "acc": acc[cells]}
                )

    return tiles.join(per_tile, TILE, "left").mapInPandas(finish, "raster_id int, row_idx int, col_idx int, acc long")


def _hops(tiles: DataFrame, starts: DataFrame, tile: int) -> DataFrame:
    """From each rim cell and each start the cell of the next tile that its way enters, and the steps to it.

    (raster_id, node, nxt, len); ``nxt`` is null where the way ends inside the tile.
    """
    rim = border_offsets(tile)
    offset = F.pmod(F.col("row_idx"), F.lit(tile)) * tile + F.pmod(F.col("col_idx"), F.lit(tile))
    inside = with_tile(starts, tile).groupBy(*TILE).agg(F.collect_set(offset).alias("starts"))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                flow = _LocalFlow(t.offsets, t.values, tile)
                _, levels = flow.accumulate(np.zeros(tile * tile, dtype=np.int64))
                last, steps = flow.last_cell(levels), np.zeros(tile * tile, dtype=np.int64)
                for cells in reversed(levels):
                    steps[cells] = np.where(flow.leaves[cells], 1, steps[flow.next[cells]] + 1)
                cells = rim if t.starts is None else np.union1d(rim, np.asarray(t.starts, dtype=np.int64))
                cells = cells[flow.valid[cells]]
                r0, c0 = t.tile_row * tile, t.tile_col * tile
                end = last[cells]
                goal = (r0 + flow.to_row[end]) * 2**32 + c0 + flow.to_col[end]
                yield pd.DataFrame(
                    {
                        "raster_id": t.raster_id, "node": _ids(cells, r0, c0, tile),
                        "nxt": pd.array(np.where(end >= 0, goal, 0), dtype="Int64"), "len": steps[cells],
                    }
                ).assign(nxt=lambda f, e=end: f.nxt.mask(e < 0))

    return tiles.join(inside, TILE, "left").mapInPandas(local, "raster_id int, node long, nxt long, len long")


def _unrolled(hops: DataFrame, cyclic: DataFrame) -> DataFrame:
    """The hops with laps, so that ways around a cycle end.

    Each cycle has an anchor, its smallest node. Passing it leads to lap 1,
    where the way ends before the anchor; by then it has gone round once at least.
    """
    cyclic = materialize(cyclic, "cyclic")
    now = hops.join(cyclic, NODE, "left_semi").select(*NODE, "nxt", F.col("node").alias("low"))
    for _ in range(cyclic.count().bit_length()):
        ahead = now.select("raster_id", F.col("node").alias("nxt"), F.col("nxt").alias("after"), F.col("low").alias("next_low"))
        now = materialize(now.join(ahead, ["raster_id", "nxt"]).select(*NODE, F.col("after").alias("nxt"), F.least("low", "next_low").alias("low")), "anchors")
    anchors = now.filter("node = low").select("raster_id", F.col("node").alias("nxt"), F.lit(True).alias("anchor"))
    rows = hops.join(cyclic.withColumn("cyclic", F.lit(True)), NODE, "left").join(anchors, ["raster_id", "nxt"], "left")
    turn = F.coalesce(F.col("cyclic") & F.col("anchor"), F.lit(False))
    second = rows.filter("cyclic").filter(~turn).withColumns({"lap": F.lit(1), "nlap": F.lit(1)})
    return materialize(rows.withColumn("nlap", turn.cast("int")).unionByName(second).select(*hops.columns), "unrolled")


def _jumps(hops: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Hops of 1, 2, 4 ... tiles up to the longest way; or the nodes of cycles, if there are any.

    When two rounds reach the same number of nodes, all of those repeat for ever.
    """
    jumps, reached = [hops], -1
    while True:
        ahead = jumps[-1].select(
            "raster_id", F.col("node").alias("nxt"), F.col("lap").alias("nlap"), F.col("nxt").alias("after"), F.col("nlap").alias("after_lap"), F.col("len").alias("more")
        )
        longer = jumps[-1].join(ahead, ["raster_id", "nxt", "nlap"]).select(
            *NODE, "lap", F.col("after").alias("nxt"), F.col("after_lap").alias("nlap"), (F.col("len") + F.col("more")).alias("len")
        )
        longer, some = materialize_some(longer, "jumps")
        if not some:
            return jumps, None
        left = longer.agg(F.count_distinct("raster_id", "nxt", "nlap")).first()[0]
        if left == reached:
            return jumps, longer.select("raster_id", F.col("nxt").alias("node")).distinct()
        jumps, reached = [*jumps, longer], left


def downstream_trace(starts: DataFrame, tiles: DataFrame, tile: int = DEFAULT_TILE) -> DataFrame:
    """Ordered downstream path of every start (dam_id, raster_id, row_idx, col_idx).

    Ways from tile to tile are doubled: hops of 1, 2, 4 ... tiles. Taking every
    place seen so far ahead by the longest hop, then by the next shorter one,
    gives each tile entry of each path exactly once, in a number of rounds that
    grows with the logarithm of the tiles crossed. Then each entry is walked once.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                flow = _LocalFlow(t.offsets, t.values, tile)
                _, levels = flow.accumulate(np.zeros(tile * tile, dtype=np.int64))
                on_cycle = flow.valid.copy()
                for cells in levels:
                    on_cycle[cells] = False
                r0, c0 = t.tile_row * tile, t.tile_col * tile
                start = np.asarray(t.entries, dtype=np.int64)
                start = start[flow.valid[start]]
                at, anchor, step, parts = start, np.full(len(start), -1), 0, []
                while len(at):
                    parts.append((start, at, step))
                    nxt = flow.next[at]
                    done = (nxt < 0) | (nxt == anchor)
                    anchor = np.where((anchor < 0) & on_cycle[at], at, anchor)
                    done = done | (nxt == anchor)
                    start, at, anchor, step = start[~done], nxt[~done], anchor[~done], step + 1
                if parts:
                    first, cell = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    yield pd.DataFrame(
                        {
                            "raster_id": t.raster_id, "node": _ids(first, r0, c0, tile), "step": np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]),
                            "row_idx": r0 + cell // tile, "col_idx": c0 + cell % tile,
                        }
                    )

    node = F.shiftleft(F.col("row_idx").cast("long"), 32) + F.col("col_idx")
    hops = _hops(tiles, starts, tile).filter("nxt IS NOT NULL")
    hops = materialize(hops.withColumn("lap", F.lit(0)).withColumn("nlap", F.lit(0)), "hops")
    jumps, cyclic = _jumps(hops)
    if cyclic is not None:
        jumps, _ = _jumps(_unrolled(hops, cyclic))
    place = ["raster_id", "node", "lap"]
    visits = starts.select("dam_id", "raster_id", node.alias("node"), F.lit(0).alias("lap"), F.lit(0).cast("long").alias("base"))
    for jump in reversed(jumps):
        ahead = visits.join(jump, place).select(
            "dam_id", "raster_id", F.col("nxt").alias("node"), F.col("nlap").alias("lap"), (F.col("base") + F.col("len")).alias("base")
        )
        visits = materialize(visits.unionByName(ahead), "visits")
    cells = visits.select(*NODE).distinct().select(
        "raster_id", F.shiftright("node", 32).cast("int").alias("row_idx"), F.col("node").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("col_idx")
    )
    offset = F.pmod(F.col("row_idx"), F.lit(tile)) * tile + F.pmod(F.col("col_idx"), F.lit(tile))
    entries = with_tile(cells, tile).groupBy(*TILE).agg(F.collect_set(offset).alias("entries"))
    pieces = tiles.join(entries, TILE).mapInPandas(walk, "raster_id int, node long, step int, row_idx int, col_idx int")
    steps = visits.join(pieces, NODE).select("dam_id", "raster_id", "row_idx", "col_idx", (F.col("base") + F.col("step")).alias("step"))
    # The path ends before the first cell that was already on it.
    cell = ["dam_id", "raster_id", "row_idx", "col_idx"]
    twice = steps.groupBy(*cell).agg(F.min("step").alias("step"), F.get(F.sort_array(F.collect_set("step")), F.lit(1)).alias("again"))
    end = twice.groupBy("dam_id").agg(F.min("again").alias("end"))
    return twice.join(end, "dam_id").filter("end IS NULL OR step < end").select(*cell, "step")


def path_summary(path: DataFrame, cells: DataFrame, accumulation: DataFrame, rasters: DataFrame) -> DataFrame:
    """Cells, first downstream cell, end elevation, top accumulation and length of each path."""
    ahead = path.select(
        "dam_id", (F.col("step") - 1).alias("step"), F.col("row_idx").alias("_nr"), F.col("col_idx").alias("_nc")
    )
    rows = (
        path.join(cells.select(*CELL, "z"), CELL, "left").join(accumulation.select(*CELL, "acc"), CELL, "left")
        .join(ahead, ["dam_id", "step"], "left")
    )
    dr, dc = F.abs(F.col("_nr") - F.col("row_idx")), F.abs(F.col("_nc") - F.col("col_idx"))
    per = rows.groupBy("dam_id", "raster_id").agg(
        F.count(F.lit(1)).alias("path_cells"),
        F.min(F.when(F.col("step") == 0, F.col("_nr"))).alias("first_row"),
        F.min(F.when(F.col("step") == 0, F.col("_nc"))).alias("first_col"),
        F.max_by("z", "step").alias("end_elevation"), F.max("acc").alias("max_accumulation"),
        F.count_if((dr == 1) & (dc == 0)).alias("_down"), F.count_if((dr == 0) & (dc == 1)).alias("_across"),
        F.count_if((dr == 1) & (dc == 1)).alias("_diagonal"),
    )
    mid = G.mid_latitude(F.col("north"), F.col("height"), F.col("res_y"))
    kx, ky = G.cell_km(F.col("res_x"), F.col("res_y"), mid)
    length = F.col("_down") * ky + F.col("_across") * kx + F.col("_diagonal") * F.sqrt(kx * kx + ky * ky)
    return per.join(rasters, "raster_id").select(
        "dam_id", "raster_id", "path_cells", "first_row", "first_col", "end_elevation", "max_accumulation",
        length.alias("length_km"),
    )


def corridor_radius(rasters: DataFrame, width_km: float) -> DataFrame:
    """Corridor radius in cells, at least 1; halves round to even."""
    mid = G.mid_latitude(F.col("north"), F.col("height"), F.col("res_y"))
    mx, my = G.cell_metres(F.col("res_x"), F.col("res_y"), mid)
    cells = F.bround(F.lit(width_km * 500.0) / ((mx + my) / 2)).cast("int")
    return rasters.select("raster_id", "width", "height", F.greatest(F.lit(1), cells).alias("radius"))


def flood_corridor(path: DataFrame, rasters: DataFrame, width_km: float = 1.0) -> DataFrame:
    """Cells within the corridor radius of each path, clipped to the raster.

    A path cell gives one column interval per row of its disc. Intervals of a
    row are merged before they become cells, so no cell is made twice.
    """
    from pyspark.sql import Window as W

    r = F.col("radius")
    discs = path.join(corridor_radius(rasters, width_km), "raster_id").withColumn(
        "dy", F.explode(F.sequence(-r, r))
    )
    half = F.floor(F.sqrt((r * r - F.col("dy") * F.col("dy")).cast("double"))).cast("int")
    rows = discs.select(
        "dam_id", "raster_id", (F.col("row_idx") + F.col("dy")).alias("row_idx"), "width", "height",
        F.greatest(F.lit(0), F.col("col_idx") - half).alias("lo"),
        F.least(F.col("width") - 1, F.col("col_idx") + half).alias("hi"),
    ).filter("row_idx >= 0 AND row_idx < height AND lo <= hi")
    spans = rows.groupBy("dam_id", "raster_id", "row_idx", "lo").agg(F.max("hi").alias("hi"))
    line = W.partitionBy("dam_id", "raster_id", "row_idx").orderBy("lo")
    reach = F.max("hi").over(line.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("_new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("lo")).cast("int"))
    spans = spans.withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    merged = spans.groupBy("dam_id", "raster_id", "row_idx", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.select("dam_id", "raster_id", "row_idx", F.explode(F.sequence("lo", "hi")).alias("col_idx"))


def domain_cells(corridor: DataFrame, cells: DataFrame) -> DataFrame:
    """Corridor cells with their elevation; nodata cells stay, with null."""
    return corridor.join(cells.select(*CELL, "z"), CELL, "left")


def domain_summary(domain: DataFrame, cells: DataFrame) -> DataFrame:
    """Corridor size and its share of the valid cells of the raster."""
    valid = cells.groupBy("raster_id").agg(F.count("z").alias("valid_cells"))
    size = domain.groupBy("dam_id", "raster_id").agg(F.count(F.lit(1)).alias("domain_cells"))
    share = F.when(F.col("valid_cells") > 0, F.col("domain_cells") / F.col("valid_cells") * 100.0).otherwise(F.lit(0.0))
    return size.join(valid, "raster_id").select("dam_id", "raster_id", "domain_cells", share.alias("percent"))
