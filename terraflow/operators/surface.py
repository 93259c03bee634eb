"""Triangle surfaces over lattice points.

A triangle is (site_id, tri_id, a, b, c) with vertex ids and pa, pb, pc as
structs of x, y, z.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.session import materialize, materialize_some

VERTICES = ("pa", "pb", "pc")
#: Grid cells in the boxes of one task's triangles. Bytes of triangles say nothing about the cells they cover.
BOX_CELLS = 2_000_000
#: Grid cells along a block of neighbouring triangles that stay together, so that their cells meet before a shuffle.
BLOCK = 8


def lattice_triangles(points: DataFrame, vertex: str) -> DataFrame:
    """Two triangles per full 2 x 2 block of lattice points, one for three corners."""
    corner = F.struct(F.col(vertex).alias("id"), "x", "y", "z")
    blocks = F.explode(
        F.array(
            *[
                F.struct((F.col("ix") - i).alias("bx"), (F.col("iy") - j).alias("by"), F.lit(2 * j + i).alias("slot"))
                for j in (0, 1) for i in (0, 1)
            ]
        )
    )
    rows = points.select("site_id", corner.alias("p"), blocks.alias("k")).select("site_id", "p", "k.*")
    wide = rows.groupBy("site_id", "bx", "by").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("p"))).alias(f"q{s}") for s in range(4)]
    )
    q = [F.col(f"q{s}") for s in range(4)]
    have = [c.isNotNull() for c in q]

    def tri(half: int, a: Column, b: Column, c: Column) -> Column:
        return F.struct(F.lit(half).alias("half"), a.alias("a"), b.alias("b"), c.alias("c"))

    both = F.array(tri(0, q[0], q[1], q[3]), tri(1, q[0], q[3], q[2]))
    shapes = (
        F.when(have[0] & have[1] & have[2] & have[3], both)
        .when(have[0] & have[1] & have[3], F.array(tri(0, q[0], q[1], q[3])))
        .when(have[0] & have[2] & have[3], F.array(tri(1, q[0], q[3], q[2])))
        .when(have[0] & have[1] & have[2], F.array(tri(0, q[0], q[1], q[2])))
        .when(have[1] & have[2] & have[3], F.array(tri(1, q[1], q[3], q[2])))
    )
    out = wide.select("site_id", "bx", "by", F.explode(shapes).alias("t"))
    # Blocks start at -1; the shift keeps ids positive and unique in a site.
    tri_id = ((F.col("by") + 1).cast("long") * 2**31 + (F.col("bx") + 1)) * 2 + F.col("t.half")
    return out.select(
        "site_id", "bx", "by", tri_id.alias("tri_id"), *[F.col(f"t.{v}.id").alias(v) for v in "abc"],
        *[
            F.struct(F.col(f"t.{v}.x").alias("x"), F.col(f"t.{v}.y").alias("y"), F.col(f"t.{v}.z").alias("z")).alias(f"p{v}")
            for v in "abc"
        ],
    )


def _diff(p: str, q: str) -> list[Column]:
    return [F.col(f"{q}.{c}") - F.col(f"{p}.{c}") for c in ("x", "y", "z")]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _norm(u: list[Column]) -> Column:
    return F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])


def orient_triangles(triangles: DataFrame) -> DataFrame:
    """Counter-clockwise in XY: the last two vertices swap where they are not."""
    u, v = _diff("pa", "pb"), _diff("pa", "pc")
    flip = u[0] * v[1] - u[1] * v[0] < 0
    swap = {
        "b": F.when(flip, F.col("c")).otherwise(F.col("b")), "c": F.when(flip, F.col("b")).otherwise(F.col("c")),
        "pb": F.when(flip, F.col("pc")).otherwise(F.col("pb")), "pc": F.when(flip, F.col("pb")).otherwise(F.col("pc")),
    }
    return triangles.select(*[swap.get(c, F.col(c)).alias(c) for c in triangles.columns])


def edge_lengths(triangles: DataFrame) -> DataFrame:
    return triangles.withColumns(
        {"e_ab": _norm(_diff("pa", "pb")), "e_bc": _norm(_diff("pb", "pc")), "e_ca": _norm(_diff("pc", "pa"))}
    )


def keep_rule(max_edge: float) -> Column:
    """No edge over the limit, and an area."""
    area = _norm(_cross(_diff("pa", "pb"), _diff("pa", "pc")))
    return (F.greatest("e_ab", "e_bc", "e_ca") <= max_edge + 1e-9) & (area > 1e-12)


def edge_filter(triangles: DataFrame, max_edge: float = 1.5) -> DataFrame:
    """Kept triangles with their edge lengths."""
    return edge_lengths(triangles).filter(keep_rule(max_edge))


def removed_counts(triangles: DataFrame, max_edge: float = 1.5) -> DataFrame:
    """Kept and removed triangles of each site."""
    keep = keep_rule(max_edge)
    return edge_lengths(triangles).groupBy("site_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def edge_stats(kept: DataFrame) -> DataFrame:
    """Min, max and mean over all three edges of kept triangles."""
    edges = kept.select("site_id", F.explode(F.array("e_ab", "e_bc", "e_ca")).alias("e"))
    return edges.groupBy("site_id").agg(F.min("e").alias("min_edge"), F.max("e").alias("max_edge"), F.avg("e").alias("avg_edge"))


def facet_normals(triangles: DataFrame) -> DataFrame:
    """Unit normals; null where a facet has no area."""
    n = _cross(_diff("pa", "pb"), _diff("pa", "pc"))
    size = _norm(n)
    return triangles.select(
        "site_id", "tri_id", *[F.when(size > 0, c / size).alias(f"n{k}") for k, c in zip("xyz", n)]
    )


def _local_roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest triangle id reachable over shared edges inside one Arrow batch."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        ends = [batch[[p, q]].to_numpy() for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]
        edges = pd.DataFrame(np.sort(np.concatenate(ends), axis=1), columns=["p", "q"])
        edges["site"] = np.tile(batch["site_id"].to_numpy(), 3)
        code = edges.groupby(["site", "p", "q"], sort=False).ngroup().to_numpy()
        owner = np.tile(np.arange(n), 3)
        rank = np.argsort(np.argsort(batch["tri_id"].to_numpy(), kind="stable"), kind="stable")
        order = np.argsort(rank)
        label = rank.copy()
        while True:
            low = np.full(code.max() + 1, n)
            np.minimum.at(low, code, label[owner])
            new = label.copy()
            np.minimum.at(new, owner, low[code])
            new = np.minimum(new, label[order[new]])
            if (new == label).all():
                break
            label = new
        yield pd.DataFrame(
            {"site_id": batch["site_id"], "tri_id": batch["tri_id"], "root": batch["tri_id"].to_numpy()[order[label]]}
        )


def mesh_components(triangles: DataFrame, tile: int = 64) -> DataFrame:
    """Number of edge-connected parts of each site.

    Nearby triangles are joined inside Arrow batches first. What is left is a
    graph of batch roots, solved by the two star operations: every node hands
    its parents' parents to its children, then its parents to each other.
    """
    near = triangles.select(
        "site_id", "tri_id", "a", "b", "c", F.floor(F.col("bx") / tile).alias("_tx"), F.floor(F.col("by") / tile).alias("_ty")
    )
    near = near.repartition("site_id", "_tx", "_ty").sortWithinPartitions("site_id", "_tx", "_ty", "tri_id").drop("_tx", "_ty")
    roots = materialize(near.mapInPandas(_local_roots, "site_id int, tri_id long, root long"), "roots")
    sides = F.explode(F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in ("ab", "bc", "ca")]))
    edges = triangles.select("site_id", "tri_id", sides.alias("e")).join(roots, ["site_id", "tri_id"]).select(
        "site_id", "e", "root"
    ).distinct()
    lowest = edges.groupBy("site_id", "e").agg(F.min("root").alias("parent"))
    links, some = materialize_some(
        edges.join(lowest, ["site_id", "e"]).filter("root <> parent")
        .select("site_id", F.col("root").alias("child"), "parent").distinct(), "stars",
    )
    while some:
        links, some = _star_round(links)
    parts = roots.select("site_id", F.col("root").alias("child")).distinct().join(links, ["site_id", "child"], "left")
    return parts.groupBy("site_id").agg(F.count_if(F.col("parent").isNull()).alias("components"))


def _star_round(links: DataFrame) -> tuple[DataFrame, bool]:
    """One large and one small star step on (child, parent) with parent < child."""
    top = links.groupBy("site_id", "child").agg(F.min("parent").alias("up"))
    above = top.select("site_id", F.col("child").alias("parent"), F.col("up").alias("grand"))
    large = links.join(above, ["site_id", "parent"], "left").select(
        "site_id", "child", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")
    )
    low = large.groupBy("site_id", "child").agg(F.min("parent").alias("m"))
    pairs = large.join(low, ["site_id", "child"])
    both = F.array_compact(
        F.array(
            F.struct(F.col("child").alias("child"), F.col("m").alias("parent"), F.col("moved").alias("moved")),
            F.when(
                F.col("parent") != F.col("m"),
                F.struct(F.col("parent").alias("child"), F.col("m").alias("parent"), F.lit(True).alias("moved")),
            ),
        )
    )
    small = pairs.select("site_id", F.explode(both).alias("s")).select("site_id", "s.*").groupBy(
        "site_id", "child", "parent"
    ).agg(F.bool_or("moved").alias("moved"))
    out, some = materialize_some(small, "stars", F.col("moved"))
    return out.drop("moved"), some


def scan_cells(t: DataFrame, step: float) -> DataFrame:
    """Grid cells that each triangle can cover, with their barycentric coordinates u and v.

    A triangle gives one row per grid line ``iy`` of its box, and a grid line
    one interval of ``ix``: on it, u, v and 1 - u - v are linear in x, so each
    of the three bounds one side. The interval is wider than the triangle by
    rounding only; whether a cell lies inside is for the caller to test.
    """

    def ends(c: str, g: str) -> tuple[Column, Column]:
        vals = [F.col(f"{v}.{c}") for v in VERTICES]
        lo = F.floor((F.least(*vals) - F.col(g)) / step)
        hi = F.ceil((F.greatest(*vals) - F.col(g)) / step)
        return F.greatest(F.lit(0), lo.cast("int")), hi.cast("int")

    (ix0, ix1), (iy0, iy1) = ends("x", "gx0"), ends("y", "gy0")
    u, v = _diff("pa", "pb"), _diff("pa", "pc")
    den = u[0] * v[1] - v[0] * u[1]
    t = t.withColumn("den", den).filter(F.abs("den") >= 1e-14)
    t = t.withColumns({"ix0": ix0, "ix1": ix1, "iy": F.explode(F.sequence(iy0, iy1))})
    gy = F.col("gy0") + F.col("iy") * step - F.col("pa.y")
    # Slope over x and value at x = pa.x of u and v.
    t = t.withColumns({"ua": v[1] / F.col("den"), "ub": -v[0] * gy / F.col("den"), "va": -u[1] / F.col("den"), "vb": u[0] * gy / F.col("den")})
    room = 2e-9 + 1e-12 * (F.abs("ub") + F.abs("vb"))
    low, high = [F.col("ix0").cast("double")], [F.col("ix1").cast("double")]
    for slope, value in (("ua", F.col("ub")), ("va", F.col("vb")), (-(F.col("ua") + F.col("va")), 1 - F.col("ub") - F.col("vb"))):
        slope = F.col(slope) if isinstance(slope, str) else slope
        edge = (F.col("pa.x") - F.col("gx0") - (room + value) / F.nullif(slope, F.lit(0.0))) / step
        low.append(F.when(slope > 0, edge - 1e-6).when((slope == 0) & (value < -room), F.col("ix1") + 1.0))
        high.append(F.when(slope < 0, edge + 1e-6))
    # Both ends stay within a cell of the box before they become integers.
    first = F.ceil(F.least(F.greatest(*low), F.col("ix1") + 1.0)).cast("int")
    last = F.floor(F.greatest(F.least(*high), F.col("ix0") - 1.0)).cast("int")
    # An outer explode, as the planner adds to others a filter that computes all of this again.
    t = t.withColumns({"first": first, "last": last})
    t = t.withColumn("ix", F.explode_outer(F.when(F.col("first") <= F.col("last"), F.sequence("first", "last")))).filter("ix IS NOT NULL")
    gx = F.col("gx0") + F.col("ix") * step - F.col("pa.x")
    return t.withColumns({"u": (gx * v[1] - v[0] * gy) / F.col("den"), "v": (u[0] * gy - gx * u[1]) / F.col("den")})


def surface_raster(triangles: DataFrame, step: float) -> DataFrame:
    """Lowest surface elevation on a regular grid, from facets and their vertices.

    The grid of a site starts at its smallest x and y, rounded down to a step.
    Facets without area in XY only count with their vertices. Triangles are dealt
    by small blocks, not by site, to tasks of about ``BOX_CELLS`` cells.
    """
    triangles = materialize(triangles.select("site_id", *VERTICES), "surface-triangles", hinted=False)
    xs, ys = ([F.col(f"{v}.{c}") for v in VERTICES] for c in "xy")
    box = ((F.greatest(*xs) - F.least(*xs)) / step + 2) * ((F.greatest(*ys) - F.least(*ys)) / step + 2)
    origin = triangles.groupBy("site_id").agg(
        (F.floor(F.min(F.least(*xs)) / step) * step).alias("gx0"), (F.floor(F.min(F.least(*ys)) / step) * step).alias("gy0"),
        F.sum(box).alias("box"),
    )
    origin = materialize(origin, "surface-origins")
    boxes = origin.agg(F.sum("box")).first()[0] or 0
    origin = origin.drop("box")
    placed = triangles.join(origin, "site_id")
    block = [F.floor(F.least(*c) / (BLOCK * step)) for c in (xs, ys)]
    t = scan_cells(placed.repartition(max(1, math.ceil(boxes / BOX_CELLS)), "site_id", *block), step)
    hit = (F.col("u") >= -1e-9) & (F.col("v") >= -1e-9) & (F.col("u") + F.col("v") <= 1 + 1e-9)
    faces = t.filter(hit).select(
        "site_id", "ix", "iy",
        (F.col("pa.z") + F.col("u") * (F.col("pb.z") - F.col("pa.z")) + F.col("v") * (F.col("pc.z") - F.col("pa.z"))).alias("z"),
    )
    snapped = placed.select("site_id", "gx0", "gy0", F.explode(F.array(*VERTICES)).alias("p")).select(
        "site_id", F.rint((F.col("p.x") - F.col("gx0")) / step).cast("int").alias("ix"),
        F.rint((F.col("p.y") - F.col("gy0")) / step).cast("int").alias("iy"), F.col("p.z").alias("z"),
    )
    grid = faces.unionByName(snapped).groupBy("site_id", "ix", "iy").agg(F.min("z").alias("z"))
    return grid.join(origin, "site_id").select(
        "site_id", "ix", "iy", (F.col("gx0") + F.col("ix") * step).alias("x"), (F.col("gy0") + F.col("iy") * step).alias("y"), "z"
    )
