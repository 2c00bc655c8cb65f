"""Polygon files: round trips, records that are not read, other field types; tiles against single cells."""

from __future__ import annotations

import glob
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.sources import shapefile as S

ROWS = [("Bern", 0, 0, 0.0, 0.0), ("Bern", 0, 1, 10.0, 0.0), ("Bern", 0, 2, 10.0, 10.0), ("Bern", 0, 3, 0.0, 10.0), ("Bern", 7, 0, 4.0, 4.0), ("Bern", 7, 1, 6.0, 4.0), ("Bern", 7, 2, 5.0, 6.5)]
ROWS += [("Zürich", 1, 0, 20.0, 0.0), ("Zürich", 1, 1, 30.0, 5.0), ("Zürich", 1, 2, 22.0, 9.0), ("Uri", 2, 0, 100.0, 100.0), ("Uri", 2, 1, 101.0, 100.0), ("Uri", 2, 2, 100.0, 101.0)]
SCHEMA = "name string, ring_id int, seq int, x double, y double"


def points(df):
    return sorted((r.NAME, r.seq, r.x, r.y) for r in df.collect())


@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, tmp_path, files):
    path = str(tmp_path / "regions")
    assert 1 <= S.write_shapefile(spark.createDataFrame(ROWS, SCHEMA), path, files) <= files
    want = sorted((n, k, x, y) for n, _, k, x, y in ROWS)
    got = S.read_shapefile(spark, path)
    assert points(got) == want and got.select("ring_id", "NAME").distinct().count() == 4
    assert points(S.read_shapefile(spark, path, "NAME", "Zürich")) == [w for w in want if w[0] == "Zürich"]
    assert {r.NAME for r in S.read_shapefile(spark, path, extent=(5.0, 25.0, 1.0, 2.0)).collect()} == {"Bern", "Zürich"}
    assert S.read_shapefile(spark, path, extent=(50.0, 60.0, 0.0, 1.0)).count() == 0
    with pytest.raises(Exception, match="no attributes"):
        S.read_shapefile(spark, path, "KANTON", "x").count()
    assert S.write_shapefile(spark.createDataFrame([], SCHEMA), path) == 0


def test_rings_that_are_not_asked_for_are_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "regions")
    S.write_shapefile(spark.createDataFrame(ROWS, SCHEMA), path)
    name = glob.glob(f"{path}/*.shp")[0]
    data = bytearray(open(name, "rb").read())
    index = np.frombuffer(open(name[:-4] + ".shx", "rb").read()[100:], ">i4").reshape(-1, 2) * 2
    for offset, length in index[1:]:  # records by name: Bern, Uri, Zürich; the numbers of parts of the others are spoilt
        data[offset + 8 + 36 : offset + 8 + length] = b"\x7f" * (length - 36)
    open(name, "wb").write(bytes(data))
    want = sorted((n, k, x, y) for n, _, k, x, y in ROWS if n == "Bern")
    assert points(S.read_shapefile(spark, path, "NAME", "Bern")) == want
    assert points(S.read_shapefile(spark, path, extent=(-5.0, 15.0, -5.0, 15.0))) == want
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert points(S.read_shapefile(spark, path).where(F.col("NAME") == "Bern")) == want
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    with pytest.raises(Exception):
        S.read_shapefile(spark, path).count()
    reader = S.ShapeReader(None, {"path": path})
    monkeypatch.setattr(S, "_BYTES", 100)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 1), (1, 2), (2, 3)]


def test_fields_of_other_types(spark, tmp_path):
    path = tmp_path / "typed.shp"
    ring = [np.array([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]
    made = S.shape_bytes([("a", ring), ("b", ring), ("c", ring)])
    fields = [(b"ID", b"N", 6, 0), (b"AREA", b"F", 8, 2), (b"OPEN", b"L", 1, 0), (b"LABEL", b"C", 5, 0)]
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, 3, 33 + 32 * len(fields), 21)
    table = head + b"".join(n.ljust(11, b"\0") + k + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in fields) + b"\x0d"
    table += b"     42    1.25Tv\xe9lo " + b"*    43    2.25Fgone " + b" ******        ?     "
    for suffix, data in {**made, ".dbf": table}.items():
        if suffix != ".cpg":
            path.with_suffix(suffix).write_bytes(data)
    got = S.read_shapefile(spark, str(path)).where("seq = 0").orderBy("record").collect()
    assert [(r.record, r.ID, r.AREA, r.OPEN, r.LABEL) for r in got] == [(0, 42, 1.25, True, "vélo"), (2, None, None, None, None)]


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_tiles_equal_single_cells(spark, tile):
    df = spark.createDataFrame(ROWS[:10], SCHEMA)
    edges = C.ring_edges(df)
    held = spark.range(60 * 40).selectExpr("id AS pixel_id", "-3.03 + 0.71 * (id % 60) AS x", "-2.04 + 0.37 * (id div 60) AS y")
    pairs = lambda d: sorted(map(tuple, d.select("pixel_id", "region").collect()))
    want = pairs(C.in_polygons(held, edges, band=0.37))
    assert pairs(C.in_polygons_by_tiles(held, edges, band=0.37, tile=tile)) == want and len(want) > 100
