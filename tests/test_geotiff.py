"""GeoTIFF files: round trips, tiles that must not be read, and files of other writers."""

from __future__ import annotations

import glob
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import geotiff as T
from gridloom.sources.grid import GridSpec

GRID = GridSpec(n_rows=300, n_cols=170, x0=1000.0, y0=9000.0, res=10.0)


def cells(spark, rows=300, cols=170):
    held = spark.range(rows * cols).selectExpr("id pixel_id", f"int(id div {cols}) row_idx", f"int(id % {cols}) col_idx")
    return held.where("pixel_id % 7 <> 3").withColumns({"a": F.when(F.col("pixel_id") % 5 != 0, F.col("pixel_id") / 3), "b": (F.col("pixel_id") % 100).cast("double")})


def same(got, want) -> None:
    key = lambda df: sorted(tuple(r) for r in df.select("pixel_id", "row_idx", "col_idx", "a", "b").collect())
    assert key(got) == key(want)


def test_round_trip(spark, tmp_path):
    held, path = cells(spark), str(tmp_path / "g.tif")
    assert T.write_geotiff(held.repartition(7), path, GRID, ["a", "b"], tile=32, block=2) == 5 * 3
    same(T.read_geotiff(spark, path), held)
    layout = T.read_layout(sorted(glob.glob(f"{path}/*.tif"))[0])
    assert layout.bands == ("a", "b") and layout.crs == "EPSG:2056" and (layout.x0, layout.y0, layout.step_x) == (1000.0, 9000.0, 10.0)
    assert T.write_geotiff(held, path, GRID, ["a", "b"], tile=64, block=1) == 5 * 3  # replaces what was there
    got = T.read_geotiff(spark, path, ["a"])
    assert got.columns == ["pixel_id", "row_idx", "col_idx", "x", "y", "a"] and got.count() == held.where("a is not null").count()
    first = got.where("pixel_id = 172").first()
    assert (first.x, first.y) == (1025.0, 8985.0)
    with pytest.raises(Exception, match="layers not in"):
        T.read_geotiff(spark, path, ["a", "c", "d"]).count()
    assert T.read_geotiff(spark, path, empty=True).count() == 300 * 170
    assert T.write_geotiff(held.where("false"), path, GRID, ["a"]) == 0
    with pytest.raises(Exception, match="there twice"):
        T.write_geotiff(held.union(held.limit(1)), path, GRID, ["a"])
    with pytest.raises(Exception, match="outside the"):
        T.write_geotiff(held.withColumn("col_idx", F.col("col_idx") + 1), path, GRID, ["a"])


def test_tiles_outside_are_not_read(spark, tmp_path):
    held, path = cells(spark), str(tmp_path / "g.tif")
    T.write_geotiff(held, path, GRID, ["a", "b"], tile=32, block=3)
    extent = (1000.0 + 400, 1000.0 + 900, 9000.0 - 1300, 9000.0 - 700)  # columns 40 to 89, rows 70 to 129
    want = held.where("col_idx between 40 and 89 and row_idx between 70 and 129 and a is not null")
    schema = T.read_geotiff(spark, path, ["a"]).schema
    options = {"path": path, "extent": ",".join(map(str, extent))}
    tiles = {(p.layout.path, r, c) for p in T.GeoTiffReader(schema, options).partitions() for r, c, _ in p.tiles}
    assert len(tiles) == 3 * 2  # tile rows 2 to 4, tile columns 1 and 2
    assert sum(len(p.tiles) for p in T.GeoTiffReader(schema, {"path": path}).partitions()) == 10 * 6
    # Everything else is overwritten: it is neither read nor inflated.
    for name in glob.glob(f"{path}/*.tif"):
        layout, data = T.read_layout(name), bytearray(open(name, "rb").read())
        n = layout.down * layout.across
        for k, (offset, count) in enumerate(zip(layout.offsets, layout.counts)):
            if k >= n or (name, k // layout.across, k % layout.across) not in tiles:
                data[offset : offset + count] = b"\xff" * count
        open(name, "wb").write(bytes(data))
    ids = lambda df: sorted(r.pixel_id for r in df.select("pixel_id").collect())
    assert ids(T.read_geotiff(spark, path, ["a"], extent)) == ids(want)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert ids(T.read_geotiff(spark, path, ["a"]).where("col_idx >= 40 and col_idx < 90 and row_idx between 70 and 129")) == ids(want)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    with pytest.raises(Exception, match="(?i)decompress|incorrect"):
        T.read_geotiff(spark, path, ["a"]).count()


def lzw(data: bytes) -> bytes:
    """TIFF's LZW, written plainly."""
    bits, out = [], bytearray()

    def put(code, width):
        bits.extend(code >> (width - 1 - i) & 1 for i in range(width))

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        put(table[word], width)
        table[word + bytes([byte])] = len(table) + 2
        if len(table) + 2 == 1 << width:
            width += 1
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([byte])
    if word:
        put(table[word], width)
    put(257, width)
    bits.extend([0] * (-len(bits) % 8))
    for i in range(0, len(bits), 8):
        out.append(int("".join(map(str, bits[i : i + 8])), 2))
    return bytes(out)


def foreign(values: np.ndarray, order: str, big: bool, tile: int | None, apart: bool, compression: int, predictor: int, nodata=None) -> bytes:
    """A TIFF of another layout: values (rows, columns, bands)."""
    height, width, bands = values.shape
    kind = values.dtype
    tw, th = (tile, tile) if tile else (width, 7)
    down, across = -(-height // th), -(-width // tw)
    chunks = []
    for b in range(bands) if apart else [slice(None)]:
        for r in range(down):
            for c in range(across):
                part = values[r * th : (r + 1) * th, c * tw : (c + 1) * tw, b].reshape(len(values[r * th : (r + 1) * th]), -1, 1 if apart else bands)
                if tile:
                    whole = np.zeros((th, tw, part.shape[2]), kind)
                    whole[: part.shape[0], : part.shape[1]] = part
                    part = whole
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = part.astype(kind.newbyteorder(order)).tobytes()
                if predictor == 3:
                    lines = part.astype(kind.newbyteorder(">")).reshape(len(part), -1).view(np.uint8).reshape(len(part), -1, kind.itemsize)
                    planes = lines.transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
                chunks.append({1: bytes, 5: lzw, 8: zlib.compress}[compression](raw))
    places, counts = (T.TILE_OFFSETS, T.TILE_COUNTS) if tile else (T.STRIP_OFFSETS, T.STRIP_COUNTS)
    tags = [
        (T.WIDTH, 4, (width,)), (T.LENGTH, 4, (height,)), (T.BITS, 3, (kind.itemsize * 8,) * bands), (T.COMPRESSION, 3, (compression,)), (T.SAMPLES, 3, (bands,)), (T.PLANAR, 3, (2 if apart else 1,)), (T.PREDICTOR, 3, (predictor,)),
        (places, 16 if big else 4, None), (counts, 4, tuple(map(len, chunks))), (T.FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands), (T.PIXEL_SCALE, 12, (0.5, 0.25, 0.0)), (T.TIE_POINT, 12, (0.0, 0.0, 0.0, 7.0, 47.0, 0.0)),
        (T.GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326)), *([(T.NODATA, 2, f"{nodata}\0".encode())] if nodata is not None else []), *([(T.TILE_WIDTH, 3, (tw,)), (T.TILE_LENGTH, 3, (th,))] if tile else [(T.ROWS_PER_STRIP, 3, (th,))]),
    ]
    tags.sort(key=lambda t: t[0])
    start, body = 16 if big else 8, b"".join(chunks)
    entries, far, at = [], b"", start + len(body)
    for tag, code, data in tags:
        if data is None:
            data = tuple(start + sum(map(len, chunks[:i])) for i in range(len(chunks)))
        raw = data if isinstance(data, bytes) else struct.pack(f"{order}{len(data)}{T.TYPES[code][0]}", *data)
        head = struct.pack(f"{order}HH{'Q' if big else 'I'}", tag, code, len(data))
        room = 8 if big else 4
        if len(raw) > room:
            entries.append(head + struct.pack(f"{order}{'Q' if big else 'I'}", at + len(far)))
            far += raw
        else:
            entries.append(head + raw.ljust(room, b"\0"))
    first = at + len(far)
    mark = b"II" if order == "<" else b"MM"
    header = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, first) if big else struct.pack(f"{order}HI", 42, first))
    return header + body + far + struct.pack(f"{order}{'Q' if big else 'H'}", len(entries)) + b"".join(entries) + b"\0" * 8


@pytest.mark.parametrize("order, big, tile, apart, compression, predictor, kind", [
    ("<", False, 16, False, 8, 2, "i2"), (">", True, None, True, 1, 1, "u1"), (">", False, None, False, 5, 1, "f4"), ("<", True, 16, True, 5, 3, "f4"), ("<", False, None, True, 8, 3, "f8"), (">", False, 32, False, 8, 2, "i4"),
])
def test_files_of_other_writers(spark, tmp_path, order, big, tile, apart, compression, predictor, kind):
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 120, (37, 41, 2)) if kind[0] != "f" else rng.normal(size=(37, 41, 2)).cumsum(axis=0)).astype(kind)
    values[3, 4], values[5, 6, 1] = 99, 99
    path = tmp_path / "other.tiff"
    path.write_bytes(foreign(values, order, big, tile, apart, compression, predictor, nodata=99))
    got = {(r.row_idx, r.col_idx): (r.x, r.y, r.band1, r.band2) for r in T.read_geotiff(spark, str(path)).collect()}
    null = lambda v: None if v == 99 else float(v)
    want = {(r, c): (7 + (c + 0.5) * 0.5, 47 - (r + 0.5) * 0.25, null(values[r, c, 0]), null(values[r, c, 1])) for r in range(37) for c in range(41)}
    want = {k: v for k, v in want.items() if v[2:] != (None, None)}
    assert got == want and T.read_layout(str(path)).crs == "EPSG:4326"


def test_files_that_do_not_fit(spark, tmp_path):
    held = cells(spark, 20)
    T.write_geotiff(held, str(tmp_path / "g.tif"), GRID, ["a"], tile=32)
    T.write_geotiff(held, str(tmp_path / "h.tif"), GridSpec(20, 170, 0.0, 0.0, 20.0), ["a"], tile=32)
    for name in ("g", "h"):
        source = glob.glob(f"{tmp_path}/{name}.tif/*.tif")[0]
        (tmp_path / f"both_{name}.tif").write_bytes(open(source, "rb").read())
    both = tmp_path / "both.tif"
    both.mkdir()
    for name in ("g", "h"):
        (tmp_path / f"both_{name}.tif").rename(both / f"{name}.tif")
    with pytest.raises(Exception, match="differ in reference system, cell size or bands"):
        T.read_geotiff(spark, str(both), ["a"]).count()
    (tmp_path / "no.tif").write_bytes(b"no tiff at all, but long enough")
    with pytest.raises(Exception, match="not a TIFF"):
        T.read_geotiff(spark, str(tmp_path / "no.tif"), ["a"]).count()
    with pytest.raises(Exception, match="nothing.tif"):
        T.read_geotiff(spark, str(tmp_path / "nothing.tif"), ["a"]).count()
