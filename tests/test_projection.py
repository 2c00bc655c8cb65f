"""Swiss LV95 and WGS84: published points, the way there and back, resampling across systems."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import projection as P
from gridloom.sources import grid as G

#: (east, north, longitude, latitude): the projection's origin, and Rigi, whose Bessel coordinates are published.
ORIGIN = (2600000.0, 1200000.0, 7.438632421, 46.951082773)
RIGI = (2679520.05, 1212273.44, 8 + 29 / 60 + 11.111271 / 3600, 47 + 3 / 60 + 28.956592 / 3600)
METRE = 1 / 111_000


def steps_at(spark, steps, **point):
    df = spark.createDataFrame([tuple(point.values())], ", ".join(f"{k} double" for k in point))
    for name, expression in steps.steps:
        df = df.withColumn(name, F.expr(expression))
    return df.first()


def test_published_points(spark):
    got = steps_at(spark, P.to_wgs84_steps(), east=ORIGIN[0], north=ORIGIN[1])
    assert abs(got.lon - ORIGIN[2]) < 0.01 * METRE and abs(got.lat - ORIGIN[3]) < 0.01 * METRE
    got = steps_at(spark, P.to_wgs84_steps(), east=RIGI[0], north=RIGI[1])
    assert abs(math.degrees(got.lam) - RIGI[2]) < 0.01 * METRE and abs(math.degrees(got.phi6) - RIGI[3]) < 0.01 * METRE  # on the Bessel ellipsoid
    back = steps_at(spark, P.to_lv95_steps(), lon=got.lon, lat=got.lat)
    assert math.hypot(back.east - RIGI[0], back.north - RIGI[1]) < 0.01


def test_there_and_back(spark):
    df = spark.range(40 * 30).selectExpr("id", "2480000 + 9077.0 * (id % 40) AS x", "1070000 + 7931.0 * (id div 40) AS y", "'kept' AS east")
    there = P.transformed(df, F.col("x"), F.col("y"), "EPSG:2056", "EPSG:4326", ("lon", "lat"))
    back = P.transformed(there, F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:2056", ("x2", "y2"))
    worst = back.agg(F.max(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("far"), F.min("east").alias("kept")).first()
    assert worst.far < 0.005 and worst.kept == "kept"
    with pytest.raises(ValueError, match="no way from"):
        P.transformed(df, F.col("x"), F.col("y"), "EPSG:2056", "EPSG:3857", ("a", "b"))


def test_resampling_across_systems(spark):
    degrees = G.GridSpec(40, 60, 7.40, 47.00, 0.002, "EPSG:4326")
    metres = G.GridSpec(30, 30, 2598000.0, 1203000.0, 200.0, "EPSG:2056")
    source = G.grid_cells(spark, degrees).withColumn("value", F.col("pixel_id"))
    got = G.nearest_resample(G.grid_cells(spark, metres), source, metres, degrees, ["value"])
    rows = {r.pixel_id: r.value for r in got.collect()}
    assert len(rows) == 900
    for pixel in (0, 29, 435, 899):
        x, y = metres.x0 + (pixel % 30 + 0.5) * 200, metres.y0 - (pixel // 30 + 0.5) * 200
        at = steps_at(spark, P.to_wgs84_steps(), east=x, north=y)
        r, c = math.floor((47.00 - at.lat) / 0.002), math.floor((at.lon - 7.40) / 0.002)
        assert rows[pixel] == (r * 60 + c if 0 <= r < 40 and 0 <= c < 60 else None)
    assert any(v is not None for v in rows.values())
