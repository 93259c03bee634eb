"""What showed on larger tables only: joins by estimate, files per run, split frames, ties of digits."""

import os
import re

import pytest
from pyspark.sql import functions as F

from terraflow.functions import scalars
from terraflow.operators import ordered, points, rules, stencil, surface, zonal
from terraflow.plans import stream_queries
from terraflow.plans.registry import QUERIES
from terraflow.session import BROADCAST_ROWS, materialize, once
from terraflow.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["type_rules", "unknown_keys", "range_rules"])
def test_exploded_views_are_joined_by_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in text and text.count("BroadcastHashJoin") == (name == "range_rules")  # its 24 fixed rows


def test_keys_of_boxes_and_discs_are_joined_by_shuffle(spark):
    """The cells of few boxes or targets are many rows, so the size of the former decides nothing."""
    pts = spark.range(50).selectExpr("CAST(id % 2 AS int) AS site_id", "CAST(id AS double) AS x", "CAST(id AS double) AS y", "1D AS z")
    boxes = spark.createDataFrame([(0, 7, 1.0, 5.0, 1.0, 5.0)], "site_id int, box int, x0 double, x1 double, y0 double, y1 double")
    assert "SortMergeJoin" in plan(zonal.points_in_boxes(boxes, pts, ["box"]))
    targets = spark.createDataFrame([(0, 1, 4.0, 4.0)], "site_id int, dam_id int, dam_x double, dam_y double")
    near = points.within_radius(targets, pts, 3.0)
    assert "SortMergeJoin" in plan(near) and sorted(r.x for r in near.collect()) == [2.0, 4.0, 6.0]


def test_written_tables_of_many_rows_are_joined_by_shuffle(spark):
    def repetitive(n):
        return spark.range(n).select((F.col("id") % 2).alias("k"), F.lit("the same text").alias("t"))

    other = spark.range(10**9).select((F.col("id") % 2).alias("k"))
    large = repetitive(BROADCAST_ROWS + 1)
    for _ in range(2):
        for table in (materialize(large), once(spark, "repetitive", "large", lambda: large)):
            assert "SortMergeJoin" in plan(other.join(table, "k"))
    for table in (materialize(repetitive(10)), once(spark, "repetitive", "small", lambda: repetitive(10))):
        assert "BroadcastHashJoin" in plan(other.join(table, "k"))


def test_digits_are_those_of_the_double(spark):
    cases = {1.005: "1.00", 21.935: f"{21.935:.2f}", 0.125: "0.12", 0.375: "0.38", 12350.0: "1.24e+4", 0.00115: f"{0.00115:.1e}".replace("e-03", "e-3"), -2.675: "-2.67"}
    rows = spark.createDataFrame([(v,) for v in cases] + [(None,)], "v double")
    got = {r.v: r.t for r in rows.select("v", scalars.fmt_number(F.col("v")).alias("t")).collect()}
    assert got == cases | {None: "—"}


def test_relief_weights(spark):
    rows = spark.createDataFrame([(1, 0, 0, 42.0, 0.02), (1, 0, 1, 84.0, 0.04)], "raster_id int, row_idx int, col_idx int, z double, shade double")
    got = stencil.relief_image(rows.withColumns({"z_low": F.lit(0.0), "z_high": F.lit(100.0)})).orderBy("col_idx").collect()
    assert [r.level for r in got] == [51, 102]


def test_a_frame_in_several_files_is_one(spark):
    particles = spark.range(50).select(
        F.lit(1).alias("run_id"), (F.col("id") % 2).cast("int").alias("frame"), F.col("id").alias("idp"),
        *[F.col("id").cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")],
    )
    root = files.write_frame_files(particles, rows_per_file=10)
    found = files.find_frames(spark, root, ["PartFluid_*.vtk", "*.vtk"])
    assert found.count() > 2
    assert sorted(map(tuple, files.found_frames(found).collect())) == [(1, "PartFluid_0000.vtk", True), (1, "PartFluid_0001.vtk", True)]


def written(path):
    return sum(n.startswith("part-") or n.endswith((".csv", ".txt")) for _, _, names in os.walk(path) for n in names if n[0] != ".")


def test_files_hold_many_runs(spark):
    runs = spark.range(300).select(F.col("id").alias("run_id"), F.lit("1,234").alias("Np"), F.lit("").alias("Dp"), F.lit("6").alias("TSimul"), F.lit('"GPU 0"').alias("Hardware"))
    path = files.write_facts(runs)
    got = files.read_run_facts(spark, path).orderBy("run_id").collect()
    assert written(path) < 50 and [r.run_id for r in got] == list(range(300))
    assert {(r.np, r.dp, r.physical_time, r.hardware) for r in got} == {(1234.0, None, 6.0, "GPU 0")}

    lines = spark.range(900).select((F.col("id") % 300).alias("run_id"), (F.floor(F.col("id") / 300) + 1).alias("line_no"))
    texts = lines.withColumn("line", F.when(F.col("line_no") != 2, F.concat(F.lit("a\tb "), F.col("line_no").cast("string"))).otherwise(""))
    want = [(r, n, "" if n == 2 else f"a\tb {n}") for r in range(300) for n in (1, 2, 3)]
    path = files.write_run_logs(texts)
    assert written(path) < 50
    assert sorted(map(tuple, files.read_log_files(spark, path, named=True).collect())) == want
    path = files.write_log_files(texts)
    assert written(path) < 50
    streamed = stream_queries.S.drain_to_files(stream_queries.growing_logs(spark, path).select(*stream_queries.S.numbered_line(F.col("line"))), "lines")
    assert sorted(map(tuple, streamed.collect())) == want

    times = lines.select("run_id", "line_no", F.lit("7").alias("part"), F.col("line_no").cast("string").alias("time_text"))
    path = files.write_frame_times(times)
    assert written(path) < 50
    assert sorted(map(tuple, files.read_frame_times(spark, path).collect())) == [(r, 7, 3.0) for r in range(300)]


def test_positions_of_many_buckets_are_joined_by_shuffle(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (None, 1, 7)], "k int, b int, o int")
    numbered = ordered.number_rows(rows, ["k"], "b", ["o"], "n")
    assert "SortMergeJoin" in plan(numbered) and "BroadcastHashJoin" not in plan(numbered)
    assert {(r.o, r.n) for r in numbered.collect()} == {(5, 1), (6, 2), (7, 1)}


def test_triangles_of_one_site_are_dealt_to_many_tasks(spark, monkeypatch):
    """The cells that triangles cover set the number of tasks, not the bytes of the triangles or their site."""
    at = spark.range(900).selectExpr("1 AS site_id", "id AS pt_id", "CAST(id % 30 AS INT) AS ix", "CAST(id div 30 AS INT) AS iy").selectExpr(
        "*", "ix * 0.6D - 5 AS x", "iy * 0.6D AS y", "CAST(pt_id * 7 % 11 AS DOUBLE) AS z")
    triangles = surface.lattice_triangles(at, "pt_id")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(surface.surface_raster(triangles, 0.3))
    monkeypatch.setattr(surface, "BOX_CELLS", 1000)
    many = surface.surface_raster(triangles, 0.3)
    dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan(many))]
    assert dealt and min(dealt) > 20 and "SortMergeJoin" not in plan(many)
    assert key(many) == want and len(want) > 3000


def test_settings_set_the_tasks_of_their_join(spark, monkeypatch):
    monkeypatch.setattr(rules, "TASK_SETTINGS", 10)
    base = spark.range(100).selectExpr("CAST(id AS INT) AS scenario_no", "IF(id < 200, 'breach_time', '') AS key", "IF(id < 90, 'n', 's') AS kind")
    over = spark.range(0, 100, 3).selectExpr("CAST(id AS INT) AS scenario_no", "IF(id < 200, 'breach_time', '') AS key", "'n' AS kind", "IF(id % 2 = 0, '-1', '1') AS value")
    got = rules.range_problems(over, base, ["scenario_no", "key"])
    dealt = re.findall(r"Exchange hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan(got))
    assert set(dealt) == {"9"}
    assert sorted(r.scenario_no for r in got.collect()) == list(range(0, 90, 6))
