"""Scalar functions on hand-picked values."""

import math

import pytest
from pyspark.sql import functions as F

from terraflow.functions import geodesy as G
from terraflow.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("11° 37' 28.000\" N", 11 + 37 / 60 + 28 / 3600),
        ("92° 39′ 33″ e", 92 + 39 / 60 + 33 / 3600),
        ("  5°S", -5.0),
        ("10° 30' w", -10.5),
        ("nothing", None),
        ("", None),
    ],
)
def test_dms(spark, text, want):
    got = one(spark, S.parse_dms(F.col("t")), t=text)
    assert got == want if want is None else got == pytest.approx(want, abs=1e-12)


def test_utm_round_trip(spark):
    rows = spark.range(2000).select(
        (F.rand(3) * 360 - 180).alias("lon"), (F.rand(4) * 160 - 80).alias("lat")
    ).withColumn("epsg", G.utm_epsg(F.col("lon"), F.col("lat")))
    e, n = G.utm_forward(F.col("lon"), F.col("lat"), F.col("epsg"))
    rows = rows.withColumns({"e": e, "n": n})
    lon, lat = G.utm_inverse(F.col("e"), F.col("n"), F.col("epsg"))
    worst = rows.select(F.max(F.abs(lon - F.col("lon"))).alias("a"), F.max(F.abs(lat - F.col("lat"))).alias("b")).first()
    assert worst["a"] < 1e-9 and worst["b"] < 1e-9


def test_utm_meridian(spark):
    e, n = G.utm_forward(F.col("lon"), F.col("lat"), F.lit(32632))
    got = spark.range(1).select(F.lit(9.0).alias("lon"), F.lit(45.0).alias("lat")).select(e.alias("e"), n.alias("n")).first()
    assert got["e"] == pytest.approx(500000.0, abs=1e-6)
    # Quarter meridian arc to 45 degrees on WGS84 is 4 984 944.378 m.
    assert got["n"] == pytest.approx(0.9996 * 4984944.378, abs=2e-3)


@pytest.mark.parametrize(
    ("lon", "lat", "want"), [(-180.0, 1.0, 32601), (180.0, 1.0, 32660), (92.6, 11.6, 32646), (0.0, -0.1, 32731)]
)
def test_utm_epsg(spark, lon, lat, want):
    assert one(spark, G.utm_epsg(F.col("x"), F.col("y")), x=lon, y=lat) == want


@pytest.mark.parametrize(
    ("text", "slug", "name"),
    [
        ("  North Dam (HP) ", "north_dam_hp", "NorthDamHp"),
        ("a--b__c", "a_b_c", "ABC"),
        ("???", None, None),
    ],
)
def test_slug(spark, text, slug, name):
    assert one(spark, S.slugify(F.col("t")), t=text) == slug
    if slug:
        assert one(spark, S.case_name(F.col("t")), t=slug) == name


@pytest.mark.parametrize(
    ("value", "want"),
    [(0.0, "0.00"), (0.005, "5.0e-3"), (-0.001234, "-1.2e-3"), (3.14159, "3.14"), (123456.0, "1.23e+5"), (math.nan, "—"), (math.inf, "—")],
)
def test_fmt_number(spark, value, want):
    assert one(spark, S.fmt_number(F.col("v")), v=value) == want


@pytest.mark.parametrize(("sim", "out", "want"), [(6.0, 0.05, 121), (6.0, 0.0, 121), (0.75, 0.05, 16), (1.0, 0.3, 4)])
def test_expected_frames(spark, sim, out, want):
    assert one(spark, S.expected_frames(F.col("s"), F.col("o")), s=sim, o=out) == want


def test_color_ramp(spark):
    assert one(spark, S.speed_color(F.col("t")), t=-1.0) == [40.0, 90.0, 230.0]
    assert one(spark, S.speed_color(F.col("t")), t=2.0) == pytest.approx([255.0, 70.0, 10.0])


@pytest.mark.parametrize(("seconds", "want"), [(59.96, "60.0 s"), (61.4, "1m 1s"), (3600.0, "60m 0s")])
def test_duration(spark, seconds, want):
    assert one(spark, S.duration_text(F.col("s")), s=seconds) == want


def test_elapsed(spark):
    c = S.elapsed_seconds(F.col("a"), F.col("b"))
    assert one(spark, c, a="2024-01-01T00:00:00", b="2024-01-01T00:01:00.5") == 60.5
    assert one(spark, c, a="soon", b="2024-01-01T00:01:00") is None
