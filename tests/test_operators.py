"""Operators against brute force on small random inputs."""

import heapq
import math
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terraflow.operators import fill, flow, hull, ordered, points, quantiles, stencil, surface, zonal


def grid_frame(spark, z):
    """Cell table of a grid; NaN becomes null, a few of those have no row at all."""
    rows = [
        (0, int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c]))
        for r, c in np.ndindex(z.shape)
        if not (np.isnan(z[r, c]) and (r + c) % 2)
    ]
    return spark.createDataFrame(rows, "raster_id int, row_idx int, col_idx int, z double")


def rasters(spark, z):
    return spark.createDataFrame(
        [(0, z.shape[1], z.shape[0], 0.0, 0.0, 0.001, 0.001)],
        "raster_id int, width int, height int, west double, north double, res_x double, res_y double",
    )


def terrain(seed, shape=(14, 11), step=0.7, holes=0.08):
    rng = np.random.default_rng(seed)
    z = np.round(rng.random(shape) * 6 / step) * step
    z[rng.random(shape) < holes] = np.nan
    return z


def near(z, r, c):
    for i, (dr, dc) in enumerate(stencil.DIRECTIONS):
        if 0 <= r + dr < z.shape[0] and 0 <= c + dc < z.shape[1] and not np.isnan(z[r + dr, c + dc]):
            yield i, r + dr, c + dc


def brute_directions(z):
    out = {}
    for r, c in zip(*np.nonzero(~np.isnan(z))):
        best, pick = -1.0, -1
        for i, nr, nc in near(z, r, c):
            slope = (z[r, c] - z[nr, nc]) / (2**0.5 if nr != r and nc != c else 1.0)
            if slope > best:
                best, pick = slope, i
        out[int(r), int(c)] = pick
    return out


def goal(cell, d):
    return (cell[0] + stencil.DIRECTIONS[d][0], cell[1] + stencil.DIRECTIONS[d][1]) if d >= 0 else None


def brute_accumulation(dirs):
    nxt = {c: goal(c, d) for c, d in dirs.items()}
    waiting = dict.fromkeys(dirs, 0)
    for t in nxt.values():
        if t:
            waiting[t] += 1
    acc = dict.fromkeys(dirs, 1)
    ready = deque(c for c, n in waiting.items() if n == 0)
    while ready:
        c = ready.popleft()
        t = nxt[c]
        if t:
            acc[t] += acc[c]
            waiting[t] -= 1
            if waiting[t] == 0:
                ready.append(t)
    return acc


def brute_fill(z, limit):
    level = z.copy()
    done = np.isnan(z)
    queue = []
    for r, c in np.ndindex(z.shape):
        if (r in (0, z.shape[0] - 1) or c in (0, z.shape[1] - 1)) and not done[r, c]:
            heapq.heappush(queue, (z[r, c], r, c))
            done[r, c] = True
    while queue:
        h, r, c = heapq.heappop(queue)
        for _, nr, nc in near(z, r, c):
            if done[nr, nc]:
                continue
            done[nr, nc] = True
            if z[nr, nc] < h and h - z[nr, nc] > limit:
                continue
            level[nr, nc] = max(h, z[nr, nc])
            heapq.heappush(queue, (level[nr, nc], nr, nc))
    return level


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flow_over_tiles(spark, seed):
    z = terrain(seed)
    want = brute_directions(z)
    dirs = stencil.d8_direction(grid_frame(spark, z)).cache()
    assert {(r.row_idx, r.col_idx): r.dir for r in dirs.collect()} == want
    tiles = flow.direction_tiles(dirs, 4)
    acc = flow.flow_accumulation(None, 4, tiles)
    assert {(r.row_idx, r.col_idx): r.acc for r in acc.collect()} == brute_accumulation(want)
    into = stencil.in_degree(dirs)
    goals = [goal(c, d) for c, d in want.items()]
    assert {(r.row_idx, r.col_idx): r.in_degree for r in into.collect()} == {c: goals.count(c) for c in want}
    starts = [(i, 0, r, c) for i, (r, c) in enumerate(list(want)[::5])]
    path = flow.downstream_trace(spark.createDataFrame(starts, "dam_id long, raster_id int, row_idx int, col_idx int"), tiles, 4)
    got = {}
    for row in path.orderBy("dam_id", "step").collect():
        got.setdefault(row.dam_id, []).append((row.row_idx, row.col_idx))
    for i, _, r, c in starts:
        walk, at = [], (r, c)
        while at and at not in walk:
            walk.append(at)
            at = goal(at, want[at])
        assert got[i] == walk


def test_cycle_over_tile_border(spark):
    """Two cells that drain into each other across a tile border, with inflow on both sides."""
    d = {(0, 0): 4, (0, 1): 4, (0, 2): 4, (0, 3): 4, (0, 4): 3, (0, 5): 3, (0, 6): 3}
    df = spark.createDataFrame([(0, r, c, v) for (r, c), v in d.items()], "raster_id int, row_idx int, col_idx int, dir int")
    acc = flow.flow_accumulation(df, 4)
    assert {(r.row_idx, r.col_idx): r.acc for r in acc.collect()} == brute_accumulation(d)


@pytest.mark.parametrize("seed", [4, 5, 6])
@pytest.mark.parametrize("limit", [0.8, 3.0])
def test_fill_over_tiles(spark, seed, limit):
    z = terrain(seed)
    got = fill.fill_depressions(grid_frame(spark, z), rasters(spark, z), limit, 4).collect()
    want = brute_fill(z, limit)
    assert len(got) == int((~np.isnan(z)).sum())
    for r in got:
        assert r.filled == pytest.approx(want[r.row_idx, r.col_idx], abs=1e-12)
        assert r.z <= r.filled <= r.z + limit + 1e-12


def test_corridor(spark):
    path = spark.createDataFrame(
        [(1, 0, r, c, 0) for r, c in [(0, 0), (1, 1), (2, 2), (5, 9)]], "dam_id long, raster_id int, row_idx int, col_idx int, step long"
    )
    z = np.zeros((8, 11))
    size = flow.corridor_radius(rasters(spark, z), 0.45).first().radius
    got = {(r.row_idx, r.col_idx) for r in flow.flood_corridor(path, rasters(spark, z), 0.45).collect()}
    want = {
        (r, c) for r, c in np.ndindex(z.shape)
        if any((r - a) ** 2 + (c - b) ** 2 <= size * size for a, b in [(0, 0), (1, 1), (2, 2), (5, 9)])
    }
    assert size == 2 and got == want


def test_hulls(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "x": rng.normal(size=4000).round(2), "y": rng.normal(size=4000).round(2)})
    pdf = pd.concat([pdf, pd.DataFrame({"g": [8, 8, 9, 9, 9], "x": [1.0, 1.0, 0.0, 1.0, 2.0], "y": [2.0, 2.0, 0.0, 1.0, 2.0]})])
    rows = hull.convex_hulls(spark.createDataFrame(pdf).repartition(5), ["g"])
    out = {r.g: (r.ring, r.area) for r in rows.withColumn("area", hull.ring_area(F.col("ring"))).collect()}
    for g in range(3):
        ring = np.array([[p.x, p.y] for p in out[g][0]])
        assert (ring[0] == ring[-1]).all() and out[g][1] > 0
        edge = np.diff(ring, axis=0)
        pts = pdf.loc[pdf.g == g, ["x", "y"]].to_numpy()
        for (ex, ey), (ax, ay) in zip(edge, ring[:-1]):
            assert (ex * (pts[:, 1] - ay) - ey * (pts[:, 0] - ax) >= -1e-9).all()
        turns = edge[:, 0] * np.roll(edge, -1, axis=0)[:, 1] - edge[:, 1] * np.roll(edge, -1, axis=0)[:, 0]
        assert (turns > 0).all()
    assert len(out[8][0]) == 1 and out[8][1] == 0.0
    assert [(p.x, p.y) for p in out[9][0]] == [(0, 0), (2, 2), (0, 0)] and out[9][1] == 0.0


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "v": rng.normal(size=3000).round(1)})
    pdf.loc[len(pdf)] = [9, 5.0]
    probs = {"p5": 0.05, "median": 0.5, "p95": 0.95}
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, buckets=16, summary={"count": "n", "mean": "m"})
    for r in got.collect():
        v = pdf.loc[pdf.g == r.g, "v"]
        assert r.n == len(v) and r.m == pytest.approx(v.mean())
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)


def test_ordered_buckets(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 200)})
    pdf["n"] = pdf.groupby("k").cumcount() + 1
    pdf["v"] = rng.integers(0, 100, 200)
    df = spark.createDataFrame(pdf)
    top = ordered.running_max(df, ["k"], "n", F.when(F.col("v") % 3 == 0, F.col("v")), "m", 7).toPandas().sort_values(["k", "n"])
    want = pdf.sort_values(["k", "n"]).assign(w=pdf.v.where(pdf.v % 3 == 0)).groupby("k").w.transform(lambda s: s.cummax().ffill())
    assert np.array_equal(top.m.fillna(-1).to_numpy(), want.fillna(-1).to_numpy())
    prev = ordered.previous_value(df, ["k"], "n", "v", "p", 7).toPandas().sort_values(["k", "n"])
    assert np.array_equal(prev.p.fillna(-1).to_numpy(), pdf.sort_values(["k", "n"]).groupby("k").v.shift().fillna(-1).to_numpy())
    last = ordered.first_rows(df, ["k"], "n", 5, 7, descending=True).toPandas()
    assert sorted(last.n) == sorted(pdf.groupby("k").n.apply(lambda s: sorted(s)[-5:]).explode())
    numbered = ordered.number_rows(df.withColumn("b", F.floor(F.col("n") / 9)), ["k"], "b", ["n"], "i").toPandas()
    assert (numbered.i == numbered.n).all()


def test_nearest_far_away(spark):
    rng = np.random.default_rng(10)
    pts = pd.DataFrame({"site_id": 1, "pt": range(300), "x": rng.random(300) * 10, "y": rng.random(300) * 10, "z": rng.random(300)})
    at = pd.DataFrame({"dam_id": [1, 2, 3], "site_id": [1, 1, 2], "dam_x": [5.0, 400.0, 0.0], "dam_y": [5.0, -90.0, 0.0]})
    got = points.nearest_sample(spark.createDataFrame(at), spark.createDataFrame(pts), 0.05, "pt").collect()
    for r in got:
        d = np.hypot(pts.x - r.dam_x, pts.y - r.dam_y)
        assert r.nearest_pt == (int(d.idxmin()) if r.site_id == 1 else None)


def test_zonal(spark):
    rng = np.random.default_rng(11)
    pts = pd.DataFrame({"site_id": rng.integers(0, 2, 500), "x": rng.random(500) * 20, "y": rng.random(500) * 20, "z": rng.random(500).round(3)})
    boxes = pd.DataFrame({"site_id": rng.integers(0, 2, 40), "box": range(40), "x0": rng.random(40) * 22 - 1, "y0": rng.random(40) * 22 - 1})
    boxes["x1"], boxes["y1"] = boxes.x0 - rng.random(40) * 6, boxes.y0 + rng.random(40) * 6
    got = zonal.zonal_stats(spark.createDataFrame(boxes), spark.createDataFrame(pts), ["box"], 1.5).collect()
    assert len(got) == 40
    for r in got:
        z = pts[(pts.site_id == r.site_id) & pts.x.between(r.x1, r.x0) & pts.y.between(r.y0, r.y1)].z
        assert r.cell_count == (len(z) or None)
        if len(z):
            assert (r.cell_min, r.cell_max) == (z.min(), z.max()) and r.cell_median == pytest.approx(z.median())


def test_components(spark):
    rng = np.random.default_rng(12)
    cells = [(0, i, j) for i, j in np.ndindex(30, 30) if rng.random() < 0.75]
    pts = pd.DataFrame([(0, i * 100 + j, i, j, float(i), float(j), 0.0) for _, i, j in cells], columns=["site_id", "pt", "ix", "iy", "x", "y", "z"])
    tri = surface.lattice_triangles(spark.createDataFrame(pts), "pt").cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = surface.mesh_components(tri, tile=8).first().components
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    owner, parent = {}, {}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for t in tri.collect():
        parent[t.tri_id] = t.tri_id
        for p, q in ((t.a, t.b), (t.b, t.c), (t.c, t.a)):
            other = owner.setdefault((min(p, q), max(p, q)), t.tri_id)
            parent[root(other)] = root(t.tri_id)
    assert got == len({root(t) for t in parent}) and got > 1


def test_normals_and_flip(spark):
    pts = [(0, 1, 0, 0, 0.0, 0.0, 0.0), (0, 2, 1, 0, 1.0, 0.0, 1.0), (0, 3, 0, 1, 0.0, 1.0, 0.0), (0, 4, 1, 1, 1.0, 1.0, 1.0)]
    tri = surface.lattice_triangles(spark.createDataFrame(pts, "site_id int, pt int, ix int, iy int, x double, y double, z double"), "pt")
    for n in surface.facet_normals(tri).collect():
        assert (n.nx, n.ny, n.nz) == pytest.approx((-(0.5**0.5), 0.0, 0.5**0.5))
    turned = tri.select("site_id", "tri_id", "a", F.col("c").alias("b"), F.col("b").alias("c"), "pa", F.col("pc").alias("pb"), F.col("pb").alias("pc"))
    same = surface.orient_triangles(turned).select("a", "b", "c").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, tri.select("a", "b", "c").collect()))


def test_flood_equals_sweeps_and_is_quick_in_winding_valleys():
    import time

    import numpy as np

    from terraflow.operators.fill import flood_tile, solve_tile

    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(3, 12, 2)
        z = np.full((n + 2, m + 2), np.nan)
        z[1:-1, 1:-1] = rng.integers(0, 9, (n, m))
        z[rng.random(z.shape) < 0.1] = np.nan
        level = np.full(z.shape, np.inf)
        frame = np.ones(z.shape, bool)
        frame[1:-1, 1:-1] = False
        level[frame & (rng.random(z.shape) < 0.2)] = rng.integers(0, 9)
        seed = (rng.random((n, m)) < 0.1) & ~np.isnan(z[1:-1, 1:-1])
        a, b = solve_tile(z, level.copy(), seed, 3.0, 10**6), flood_tile(z, level.copy(), seed, 3.0)
        assert np.array_equal(a[1:-1, 1:-1], b[1:-1, 1:-1])
    z = np.full((258, 258), np.nan)
    ground = np.full((256, 256), 100.0)
    ground[::2] = 1
    for k, r in enumerate(range(1, 256, 2)):
        ground[r, 255 if k % 2 == 0 else 0] = 1
    z[1:-1, 1:-1] = ground
    seed = np.zeros((256, 256), bool)
    seed[0, 0] = True
    start = time.perf_counter()
    solve_tile(z, np.full(z.shape, np.inf), seed, 5.0)
    assert time.perf_counter() - start < 3


ODD_VALUES = [
    0.0, -0.0, 1e15, -1e300, 1e300, 5e-324, -5e-324, 2.2250738585072014e-308, 1.0, 1.0000000000000002, 0.9999999999999999, 1e17, 1e-13,
    8.0, 7.999999999999999, 1.7976931348623157e308, math.inf, -math.inf, math.nan,
]


def _order(v):
    return (math.isnan(v), 0 if math.isnan(v) else v)


def test_digits_sort_like_values(spark):
    from terraflow.operators.quantiles import with_digits

    rng = random.Random(1)
    values = ODD_VALUES + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(1000)] + [2.0**k for k in range(-1074, 1024, 7)]
    rows = with_digits(spark.createDataFrame([(v,) for v in values], "v double"), "v", 4).collect()
    rows.sort(key=lambda r: _order(r.v))
    for a, b in zip(rows, rows[1:]):
        assert a[1:] <= b[1:] and (a[1:] == b[1:]) == (a.v == b.v), (a, b)


def test_quantiles_by_radix(spark):
    """Against sorting: outliers, neighbours that differ in the last bit, ties, nulls, a null key."""
    from terraflow.operators.quantiles import exact_quantiles

    rng = random.Random(2)
    rows = [
        (None if g == 3 else g, rng.choice([None, rng.choice(ODD_VALUES) if g % 2 else rng.randint(0, 50) / 10, rng.gauss(0, 1)]))
        for g in range(20) for _ in range(rng.randint(1, 150))
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "g int, v double, _total int")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.9}, summary={"count": "n", "min": "lo", "max": "hi"}).collect()}
    for g in {r[0] for r in rows}:
        v = sorted((x for k, x in rows if k == g and x is not None), key=_order)
        assert got[g].n == len(v) and str(got[g].lo) in (str(v[0]), "0.0", "-0.0") and _order(got[g].hi) == _order(v[-1])
        for name, p in (("m", 0.5), ("q", 0.9)):
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            want = lo if _order(lo) == _order(hi) else lo + (hi - lo) * (at - math.floor(at))
            assert _order(got[g][name]) == _order(want)
    assert exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_one_outlier_moves_no_values(spark, monkeypatch):
    """A group of a million values and one far away: what is shuffled is counts, and two rounds settle the median of thousandths."""
    from terraflow.operators import quantiles

    sizes, labels = [], []
    for name in ("materialize", "materialize_some"):
        real = getattr(quantiles, name)

        def counted(df, label, *a, real=real):
            out = real(df, label, *a)
            labels.append(label)
            sizes.append((out[0] if isinstance(out, tuple) else out).count())
            return out

        monkeypatch.setattr(quantiles, name, counted)
    df = spark.range(1_000_000).selectExpr("0 AS g", "IF(id = 7, 1e15D, pmod(hash(id), 100000) / 1000D) AS v")
    row = quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}, summary={"max": "hi"}).first()
    assert row.hi == 1e15 and abs(row.m - 50) < 0.2 and row.m == df.selectExpr("percentile(v, 0.5) AS m").first().m
    assert labels.count("ranks") == 2 and max(sizes) < 400


def test_means_of_any_size(spark):
    from terraflow.operators import raster

    df = spark.createDataFrame([(1, 1e17), (1, 3e17), (2, 1e-13), (2, 3e-13), (3, None), (4, 0.0004), (4, 0.0002), (4, None)], "k int, z double")
    got = {r.k: r.mean for r in raster.statistics(df, ["k"]).collect()}
    assert got.keys() == {1, 2, 4} and got[1] == 2e17 and abs(got[2] - 2e-13) < 1e-28 and abs(got[4] - 0.0003) < 1e-12


def test_long_rivers_take_few_rounds(spark, monkeypatch):
    from terraflow.operators import flow
    from terraflow.operators.stencil import DIRECTIONS

    east = [tuple(d) for d in DIRECTIONS].index((0, 1))
    rows = [(0, 0, c, east if c < 511 else -1) for c in range(512)]
    tiles = flow.direction_tiles(spark.createDataFrame(rows, "raster_id int, row_idx int, col_idx int, dir int"), 2)
    written = []
    for name in ("materialize", "materialize_some"):
        real = getattr(flow, name)
        monkeypatch.setattr(flow, name, lambda df, label, *a, real=real: (written.append(label), real(df, label, *a))[1])
    starts = spark.createDataFrame([(7, 0, 0, 0), (8, 0, 0, 300)], "dam_id long, raster_id int, row_idx int, col_idx int")
    path = flow.downstream_trace(starts, tiles, 2).orderBy("dam_id", "step").collect()
    assert [(r.dam_id, r.step, r.col_idx) for r in path] == [(7, c, c) for c in range(512)] + [(8, c - 300, c) for c in range(300, 512)]
    assert len(written) <= 3 * 8


def test_boxes_of_all_sizes_make_few_keys(spark):
    """A box of five kilometres over metre-spaced points makes as few keys as one of a metre; edges and corners in any order count."""
    rng = random.Random(6)
    pts = [(s, float(x), float(y), rng.random()) for s in (1, 2) for x in range(-20, 40, 2) for y in range(-20, 40, 3)]
    boxes = []
    for i in range(60):
        x, y, w, h = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([0, 0.001, 1, 7, 5000]), rng.choice([0, 3, 40, 5000])
        boxes.append((rng.choice([1, 2, 3]), i, round(x), round(x) + w, round(y) + h, round(y)))
    boxes = [tuple(map(lambda v: float(v) if isinstance(v, float) else v, b[:2])) + tuple(map(float, b[2:])) for b in boxes] + [(1, 99, None, 1.0, 0.0, 1.0)]
    b = spark.createDataFrame(boxes, "site_id int, box int, x0 double, x1 double, y0 double, y1 double")
    assert max(r["count"] for r in zonal.box_keys(b).groupBy("box").count().collect()) <= (zonal.ACROSS + 1) ** 2
    got = zonal.points_in_boxes(b, spark.createDataFrame(pts, "site_id int, x double, y double, z double"), ["box"])
    want = [(s, k, *p[1:]) for s, k, x0, x1, y0, y1 in boxes if x0 is not None for p in pts if p[0] == s and min(x0, x1) <= p[1] <= max(x0, x1) and min(y0, y1) <= p[2] <= max(y0, y1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_scanlines_cover_what_all_cells_do(spark):
    """Large, thin and flat triangles, some with vertices on grid lines, against every cell of the grid."""
    rng = np.random.default_rng(11)
    step, tris = 0.5, []
    for site in range(30):
        for k in range(4):
            p = rng.uniform(0, 20, (3, 3))
            if k == 1:
                p[:, :2] = np.round(p[:, :2] / step) * step
            elif k == 2:  # thin
                p[2, :2] = p[0, :2] + (p[1, :2] - p[0, :2]) * 0.4 + 1e-3
            elif k == 3:  # one side along a grid line
                p[1, 1] = p[0, 1] = round(p[0, 1])
            tris.append((site, k, *[tuple(map(float, v)) for v in p]))
    point = "struct<x:double,y:double,z:double>"
    triangles = spark.createDataFrame(tris, f"site_id int, tri_id long, pa {point}, pb {point}, pc {point}")
    got = {(r.site_id, r.ix, r.iy): r.z for r in surface.surface_raster(triangles, step).collect()}
    want, covered = {}, 0
    for site in range(30):
        own = [np.array(t[2:]) for t in tris if t[0] == site]
        x0, y0 = (np.floor(min(t[:, c].min() for t in own) / step) * step for c in (0, 1))
        for t in own:
            a, u, v = t[0], t[1] - t[0], t[2] - t[0]
            den = u[0] * v[1] - v[0] * u[1]
            for ix in range(60):
                for iy in range(60):
                    gx, gy = x0 + ix * step - a[0], y0 + iy * step - a[1]
                    s, r = (gx * v[1] - v[0] * gy) / den, (u[0] * gy - gx * u[1]) / den
                    if s >= -1e-9 and r >= -1e-9 and s + r <= 1 + 1e-9:
                        covered += 1
                        key = site, ix, iy
                        want[key] = min(want.get(key, np.inf), a[2] + s * u[2] + r * v[2])
            for p in t:
                key = site, int(np.rint((p[0] - x0) / step)), int(np.rint((p[1] - y0) / step))
                want[key] = min(want.get(key, np.inf), p[2])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    origin = triangles.selectExpr("site_id", "explode(array(pa, pb, pc)) AS p").groupBy("site_id").agg(
        (F.floor(F.min("p.x") / step) * step).alias("gx0"), (F.floor(F.min("p.y") / step) * step).alias("gy0")
    )
    assert covered <= surface.scan_cells(triangles.join(origin, "site_id"), step).count() <= 1.02 * covered
