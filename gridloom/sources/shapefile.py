"""Polygon files (ESRI shapefiles) as tables of vertices: a Python data source, and a writer.

The record index gives the partitions.  Of each record the attributes are read first, then the bounding
box, and the rings only if both pass what is asked for: equalities on attributes, and a box.  Parts and
holes are rings of their own.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import hadoop_delete
from ..shipping import ship_package
from .geotiff import _PUSHDOWN, _store

# Fixed values of the format: file code, version and the shape types that are polygons.
CODE, VERSION, POLYGONS = 9994, 1000, (5, 15, 25)
OWN = ("record", "ring_id", "seq", "x", "y")
_BYTES = 8_000_000  # geometry of a partition, about


@dataclass
class Records(InputPartition):
    """Records first to last - 1 of a file, with the places of the first and of the end."""

    path: str
    first: int
    last: int


def _other(path: str, suffix: str) -> str:
    return path[: path.rindex(".")] + suffix


def _fields(path: str) -> tuple[list[tuple[str, str, int, int, int]], int, int, str]:
    """(name, type, offset, length, decimals) of the attributes, the header's and a record's length, the encoding."""
    store, inside = _store(_other(path, ".dbf"))
    with store.open_input_file(inside) as file:
        head = file.read(32)
        if len(head) < 32:
            raise ValueError(f"{path}: no attribute table")
        _, header, record = struct.unpack("<IHH", head[4:12])
        raw = file.read(header - 32)
    out, at = [], 1
    for i in range(0, len(raw) - 31, 32):
        if raw[i] == 0x0D:
            break
        name, kind, length, decimals = raw[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(raw[i + 11]), raw[i + 16], raw[i + 17]
        out.append((name, kind, at, length, decimals))
        at += length
    store, inside = _store(_other(path, ".cpg"))
    encoding = "latin-1"
    if store.get_file_info(inside).type == pafs.FileType.File:
        with store.open_input_file(inside) as file:
            encoding = file.read().decode("ascii", "ignore").strip() or encoding
    return out, header, record, encoding


def _type_of(kind: str, decimals: int) -> str:
    return "long" if kind == "N" and not decimals else "double" if kind in "NF" else "boolean" if kind == "L" else "string"


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").rstrip(" \0") if kind not in "NFL" else raw.decode("latin-1").strip(" \0")
    if kind in "NF":
        if not text or set(text) == {"*"}:
            return None
        return float(text) if decimals or kind == "F" else int(text)
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text or None


class ShapeReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.box = tuple(float(v) for v in options["extent"].split(",")) if options.get("extent") else None
        self.equal = {options["attribute"]: [options["wanted"]]} if options.get("attribute") else {}

    def files(self) -> list[str]:
        path = self.options["path"]
        store, root = _store(path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root))
        prefix = path[: path.index(root)] if root in path else ""
        return sorted(prefix + f.path for f in found if f.is_file and f.base_name.lower().endswith(".shp"))

    def partitions(self):
        out = []
        for path in self.files():
            store, inside = _store(_other(path, ".shx"))
            with store.open_input_file(inside) as file:
                index = np.frombuffer(file.read()[100:], ">i4").reshape(-1, 2)
            if not len(index):
                continue
            cuts = np.flatnonzero(np.diff(np.cumsum(index[:, 1].astype(np.int64) * 2) // _BYTES)) + 1
            edges = [0, *cuts.tolist(), len(index)]
            out += [Records(path, a, b) for a, b in zip(edges[:-1], edges[1:])]
        return out

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        fields, header, width, encoding = _fields(partition.path)
        wanted = {name: (kind, at, n, dec) for name, kind, at, n, dec in fields if name in schema.names or name in self.equal}
        missing = [n for n in [*schema.names, *self.equal] if n not in OWN and n not in wanted]
        if missing:
            raise KeyError(f"{partition.path}: no attributes {missing}; there are {[f[0] for f in fields]}")
        n = partition.last - partition.first
        store, inside = _store(partition.path)
        shx, dbf = (_store(_other(partition.path, s)) for s in (".shx", ".dbf"))
        with dbf[0].open_input_file(dbf[1]) as file:
            file.seek(header + partition.first * width)
            table = file.read(n * width)
        with shx[0].open_input_file(shx[1]) as file:
            file.seek(100 + 8 * partition.first)
            index = np.frombuffer(file.read(8 * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        columns: dict[str, list] = {c: [] for c in schema.names}
        held = 0

        def batch():
            arrays = [pa.array(np.concatenate(v) if f.name in OWN else v).cast(f.type) if v else pa.array([], f.type) for f, v in zip(schema, columns.values())]
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        with store.open_input_file(inside) as file:
            for i in range(n):
                row = table[i * width : (i + 1) * width]
                if row[:1] == b"*":  # deleted
                    continue
                values = {name: _value(row[at : at + size], kind, dec, encoding) for name, (kind, at, size, dec) in wanted.items()}
                if any(values[name] is None or all(str(values[name]) != str(v) for v in asked) for name, asked in self.equal.items()):
                    continue
                file.seek(int(index[i, 0]) + 8)
                head = file.read(min(44, int(index[i, 1])))
                kind = struct.unpack("<i", head[:4])[0]
                if kind == 0:
                    continue
                if kind not in POLYGONS:
                    raise ValueError(f"{partition.path}: shapes of type {kind} are no polygons")
                low_x, low_y, high_x, high_y, n_parts, n_points = struct.unpack("<4d2i", head[4:44])
                if self.box and (high_x < self.box[0] or low_x > self.box[1] or high_y < self.box[2] or low_y > self.box[3]):
                    continue  # its rings are not read
                raw = file.read(4 * n_parts + 16 * n_points)
                parts = [*np.frombuffer(raw, "<i4", n_parts).tolist(), n_points]
                points = np.frombuffer(raw, "<f8", 2 * n_points, 4 * n_parts).reshape(-1, 2)
                number = partition.first + i
                for part, (a, b) in enumerate(zip(parts[:-1], parts[1:])):
                    ring = points[a:b]
                    if len(ring) > 1 and (ring[0] == ring[-1]).all():
                        ring = ring[:-1]  # rings close by themselves
                    own = {"record": np.full(len(ring), number), "ring_id": np.full(len(ring), (number << 20) + part), "seq": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]}
                    for c in schema.names:
                        if c in OWN:
                            columns[c].append(own[c])
                        else:
                            columns[c] += [values[c]] * len(ring)
                    held += len(ring)
                if held > 100_000:
                    yield batch()
                    columns, held = {c: [] for c in schema.names}, 0
        if held:
            yield batch()


class FilteredShapeReader(ShapeReader):
    """The reader where the session hands filters to Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] not in OWN:
                self.equal.setdefault(f.attribute[0], []).append(f.value)
            yield f


class ShapeSource(DataSource):
    @classmethod
    def name(cls):
        return "shapefile"

    def schema(self):
        files = ShapeReader(None, self.options).files()
        fields = _fields(files[0])[0] if files else []
        return ", ".join(["record long", "ring_id long", "seq int", "x double", "y double", *(f"`{n.replace('`', '``')}` {_type_of(k, d)}" for n, k, _, _, d in fields)])

    def reader(self, schema):
        return (FilteredShapeReader if self.options.get("filters") == "on" else ShapeReader)(schema, self.options)


def read_shapefile(spark: SparkSession, path: str, attribute: str | None = None, wanted: str | None = None, extent: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Vertices of the polygons at `path`, a .shp file or a folder of them: record, ring_id, seq, x, y and the attributes.

    Rings do not repeat their first vertex; ring_id tells a file's rings apart.  Records without a shape are
    left out.  `attribute` = `wanted`, and a box that meets `extent` (xmin, xmax, ymin, ymax), decide which
    records' rings are read; an equality filter does so too where the session has filter pushdown for Python sources on.
    """
    ship_package(spark)
    spark.dataSource.register(ShapeSource)
    reader = spark.read.format("shapefile").option("filters", "on" if spark.conf.get(_PUSHDOWN, "false").lower() == "true" else "off")
    if attribute is not None:
        reader = reader.option("attribute", attribute).option("wanted", str(wanted))
    if extent:
        reader = reader.option("extent", ",".join(repr(float(v)) for v in extent))
    return reader.load(path)


def shape_bytes(polygons: list[tuple[str, list[np.ndarray]]], attribute: str = "NAME") -> dict[str, bytes]:
    """The .shp, .shx, .dbf and .cpg of polygons (name, rings)."""
    shapes, index, at = io.BytesIO(), io.BytesIO(), 50
    low, high = np.full(2, np.inf), np.full(2, -np.inf)
    names = [name.encode()[:254] for name, _ in polygons]
    for number, (_, rings) in enumerate(polygons, 1):
        closed = [np.concatenate([r, r[:1]]) for r in rings]
        points = np.concatenate(closed)
        low, high = np.minimum(low, points.min(axis=0)), np.maximum(high, points.max(axis=0))
        starts = np.cumsum([0, *(len(r) for r in closed[:-1])])
        content = struct.pack("<i4d2i", 5, *points.min(axis=0), *points.max(axis=0), len(closed), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
        shapes.write(struct.pack(">2i", number, len(content) // 2) + content)
        index.write(struct.pack(">2i", at, len(content) // 2))
        at += 4 + len(content) // 2
    box = (*low, *high) if polygons else (0.0,) * 4

    def header(size: int) -> bytes:
        return struct.pack(">7i", CODE, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<2i8d", VERSION, 5, *box, 0.0, 0.0, 0.0, 0.0)

    width = max([1, *map(len, names)])
    field = attribute.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([width, 0]) + bytes(14)
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(polygons), 32 + 32 + 1, 1 + width) + field + b"\x0d" + b"".join(b" " + n.ljust(width) for n in names) + b"\x1a"
    return {".shp": header(shapes.tell()) + shapes.getvalue(), ".shx": header(index.tell()) + index.getvalue(), ".dbf": table, ".cpg": b"UTF-8"}


def write_shapefile(vertices: DataFrame, path: str, files: int = 1, attribute: str = "NAME") -> int:
    """Write polygons (name, ring_id, seq, x, y) to a folder of shapefiles, replacing it; returns the number of files.

    A name is one record with all its rings, and in one file; a task holds one file's polygons.
    """
    spark = vertices.sparkSession
    ship_package(spark)
    hadoop_delete(spark, path)
    held = vertices.select(F.col("name").cast("string").alias("name"), F.col("ring_id").cast("long").alias("ring_id"), F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    held = held.withColumn("file", F.pmod(F.xxhash64("name"), F.lit(files)).cast("int"))

    def write(table: pa.Table) -> pa.Table:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        table = table.sort_by([(c, "ascending") for c in ("name", "ring_id", "seq")])
        number = table.column("file")[0].as_py()
        polygons: dict[str, dict[int, list]] = {}
        for name, ring, x, y in zip(*(table.column(c).to_pylist() for c in ("name", "ring_id", "x", "y"))):
            polygons.setdefault(name, {}).setdefault(ring, []).append((x, y))
        made = shape_bytes([(name, [np.array(r) for r in rings.values()]) for name, rings in polygons.items()], attribute)
        for suffix in (".cpg", ".dbf", ".shx", ".shp"):  # readers look for the last one
            part = posixpath.join(root, f".{uuid.uuid4().hex}.part")
            with store.open_output_stream(part) as out:
                out.write(made[suffix])
            store.move(part, posixpath.join(root, f"part-{number:05d}{suffix}"))
        return pa.table({"file": pa.array([number], pa.int32()), "records": pa.array([len(polygons)], pa.int64())})

    return held.groupBy("file").applyInArrow(write, "file int, records long").agg(F.count("*")).first()[0]
