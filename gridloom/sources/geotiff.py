"""GeoTIFF files as grids: a Python data source that reads tiles, and a writer of tiled, compressed files.

Reading.  The tags of every file are parsed first, on the driver; a partition is some neighbouring
tiles of one file.  Only the bands that the schema names are read, and tiles outside the range that
filters (or the option `extent`) leave for x, y, row_idx and col_idx are neither read nor inflated.
Classic and Big TIFF of both byte orders, tiles and strips, bands apart or interleaved, integer and
float samples, no compression, Deflate and LZW with any predictor.

Writing.  A grid becomes one file a block of tiles, so that tasks write files of their own; a folder of
such files is read as one grid.  Bands are apart, so a reader of one layer skips the others.
"""

from __future__ import annotations

import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import hadoop_delete
from ..shipping import ship_package
from .grid import GridSpec

# Tags and keys of TIFF 6.0, GeoTIFF 1.1 and the usual extensions for nodata and band names.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 1025, 2048, 3072
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946

_PLACE = {"x": 0, "col_idx": 0, "y": 1, "row_idx": 1}
_CELLS = 2_000_000  # cells of a partition, about
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Layout:
    """What a file's tags say: geometry, sample type, and where its tiles lie."""

    path: str
    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    bands: tuple[str, ...]
    kind: str
    compression: int
    predictor: int
    apart: bool
    x0: float
    y0: float
    step_x: float
    step_y: float
    crs: str
    nodata: float | None
    offsets: tuple[int, ...] = field(repr=False)
    counts: tuple[int, ...] = field(repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def bare(self) -> Layout:
        return replace(self, offsets=(), counts=())


def _tags(file, size: int) -> tuple[str, dict]:
    """The byte order and the tags of the first directory."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order or '<'}H", head[2:4])[0] if len(head) == 16 else 0
    if order is None or version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count_format, entry, offset_format = ("Q", 20, "Q") if big else ("H", 12, "I")
    file.seek(at)
    n = struct.unpack(f"{order}{count_format}", file.read(struct.calcsize(count_format)))[0]
    raw = file.read(n * entry)
    if len(raw) < n * entry:
        raise ValueError("a directory ends early")
    tags = {}
    for i in range(n):
        tag, kind, number = struct.unpack_from(f"{order}HH{offset_format}", raw, i * entry)
        if kind not in TYPES:
            continue
        code = TYPES[kind]
        size_ = number * (1 if code == "s" else struct.calcsize("=" + code))
        inline = entry - (12 if big else 8)
        if size_ <= inline:
            data = raw[i * entry + entry - inline :][:size_]
        else:
            start = struct.unpack_from(f"{order}{offset_format}", raw, (i + 1) * entry - inline)[0]
            if start + size_ > size:
                raise ValueError(f"tag {tag} lies outside the file")
            file.seek(start)
            data = file.read(size_)
        tags[tag] = data.split(b"\0")[0].decode("latin-1") if code == "s" else struct.unpack(f"{order}{number * len(code)}{code[0]}", data)
    return order, tags


def read_layout(path: str) -> Layout:
    """The layout of the first image of a file."""
    store, inside = _store(path)
    with store.open_input_file(inside) as file:
        try:
            order, tags = _tags(file, file.size())
        except (ValueError, struct.error) as e:
            raise ValueError(f"{path}: {e}") from None
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, samples = tags.get(BITS, (1,)), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind is None or len(set(tags.get(FORMAT, (1,)))) > 1:
        raise ValueError(f"{path}: samples of {bits} bits, format {tags.get(FORMAT)} are not supported")
    if PIXEL_SCALE not in tags or TIE_POINT not in tags:
        raise ValueError(f"{path}: no place and size of cells")
    scale, tie = tags[PIXEL_SCALE], tags[TIE_POINT]
    keys = dict(zip(tags.get(GEO_KEYS, ())[4::4], tags.get(GEO_KEYS, ())[7::4]))
    code = keys.get(PROJECTED_KEY) or keys.get(GEOGRAPHIC_KEY)
    shift = 0.5 if keys.get(RASTER_KEY) == 2 else 0.0  # the tie point is a cell's centre
    names = [f"band{i + 1}" for i in range(samples)]
    if METADATA in tags:
        for item in ElementTree.fromstring(tags[METADATA]).iter("Item"):
            if item.get("role") == "description" and item.get("sample", "").isdigit() and int(item.get("sample")) < samples:
                names[int(item.get("sample"))] = item.text or names[int(item.get("sample"))]
    tiled = TILE_OFFSETS in tags
    width, height = one(WIDTH, 0), one(LENGTH, 0)
    return Layout(
        path, order, width, height, one(TILE_WIDTH, 0) if tiled else width, one(TILE_LENGTH, 0) if tiled else min(one(ROWS_PER_STRIP, height), height), tuple(names), f"{kind}{bits[0] // 8}",
        one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 or samples == 1, tie[3] - (tie[0] + shift) * scale[0], tie[4] + (tie[1] + shift) * scale[1], scale[0], scale[1],
        f"EPSG:{code}" if code else "", float(tags[NODATA]) if tags.get(NODATA, "").strip() else None, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS],
    )


def _lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first."""
    out, table, width, held, bits, before = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if before is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out += word
        before = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _inflated(layout: Layout, raw: bytes, bands: int) -> np.ndarray:
    """The samples of a tile or strip as (rows, columns, bands)."""
    if layout.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif layout.compression == LZW:
        raw = _lzw(raw)
    elif layout.compression != NONE:
        raise ValueError(f"{layout.path}: compression {layout.compression} is not supported")
    kind = np.dtype(layout.order + layout.kind)
    line = layout.tile_width * bands
    rows = len(raw) // (line * kind.itemsize)  # the last strip may be shorter
    if layout.predictor == 3:  # bytes of a line by significance, each told by its difference to the one before
        planes = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * line * kind.itemsize].reshape(rows, -1, bands), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, kind.itemsize, line)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.dtype(">" + layout.kind)).reshape(rows, layout.tile_width, bands)
    samples = np.frombuffer(raw, kind)[: rows * line].reshape(rows, layout.tile_width, bands)
    return np.cumsum(samples, axis=1, dtype=kind.newbyteorder("=")) if layout.predictor == 2 else samples


@dataclass
class Tiles(InputPartition):
    """Tiles of one file: (tile row, tile column, places of the chunks that hold the wanted bands)."""

    layout: Layout
    bands: tuple[int, ...]
    tiles: list[tuple[int, int, list[tuple[int, int]]]]
    row0: int
    col0: int
    columns: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        low, high = [-np.inf, -np.inf], [np.inf, np.inf]
        if options.get("extent"):
            low[0], high[0], low[1], high[1] = (float(v) for v in options["extent"].split(","))
        self.range = {"x": [low[0], high[0]], "y": [low[1], high[1]], "row_idx": [-np.inf, np.inf], "col_idx": [-np.inf, np.inf]}

    def layouts(self) -> list[Layout]:
        path = self.options["path"]
        store, root = _store(path)
        info = store.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        names = [info] if info.is_file else store.get_file_info(pafs.FileSelector(root))
        names = sorted(n.path for n in names if n.is_file and n.base_name.lower().endswith((".tif", ".tiff")))
        prefix = path[: path.index(root)] if root in path else ""
        found = [read_layout(prefix + n) for n in names]
        for x in found[1:]:
            if (x.crs, x.step_x, x.step_y, x.bands) != (found[0].crs, found[0].step_x, found[0].step_y, found[0].bands):
                raise ValueError(f"{x.path} and {found[0].path} differ in reference system, cell size or bands")
        return found

    def partitions(self):
        layouts = self.layouts()
        if not layouts:
            return []
        x0, y0 = (float(self.options[k]) if k in self.options else None for k in ("grid_x0", "grid_y0"))
        x0 = min(x.x0 for x in layouts) if x0 is None else x0
        y0 = max(x.y0 for x in layouts) if y0 is None else y0
        missing = [f for f in self.schema.names if f not in layouts[0].bands and f not in ("pixel_id", "row_idx", "col_idx", "x", "y")]
        if missing:
            raise KeyError(f"layers not in {self.options['path']}: {missing}; there are {list(layouts[0].bands)}")
        columns = int(self.options.get("grid_columns") or max(round((x.x0 - x0) / x.step_x) + x.width for x in layouts))
        out = []
        for layout in layouts:
            wanted = tuple(i for i, b in enumerate(layout.bands) if b in self.schema.names)
            row0, col0 = round((y0 - layout.y0) / layout.step_y), round((layout.x0 - x0) / layout.step_x)
            held, places = 0, []
            for r in range(layout.down):
                for c in range(layout.across):
                    if not self._inside(layout, r, c, row0, col0):
                        continue
                    at = r * layout.across + c
                    chunks = [i * layout.down * layout.across + at for i in wanted] if layout.apart else [at]
                    places.append((r, c, [(layout.offsets[k], layout.counts[k]) for k in chunks]))
                    held += layout.tile_width * layout.tile_height
                    if held >= _CELLS:
                        out.append(Tiles(layout.bare(), wanted, places, row0, col0, columns))
                        held, places = 0, []
            if places:
                out.append(Tiles(layout.bare(), wanted, places, row0, col0, columns))
        return out

    def _inside(self, layout: Layout, r: int, c: int, row0: int, col0: int) -> bool:
        """Whether any cell of a tile may be within the wanted range."""
        rows = np.array([r * layout.tile_height, min((r + 1) * layout.tile_height, layout.height) - 1])
        cols = np.array([c * layout.tile_width, min((c + 1) * layout.tile_width, layout.width) - 1])
        spans = {"row_idx": rows + row0, "col_idx": cols + col0, "x": layout.x0 + (cols + 0.5) * layout.step_x, "y": layout.y0 - (rows + 0.5) * layout.step_y}
        return all(max(s) >= self.range[k][0] and min(s) <= self.range[k][1] for k, s in spans.items())

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        layout, schema = partition.layout, to_arrow_schema(self.schema)
        store, inside = _store(layout.path)
        low_x, high_x = self.range["x"]
        low_y, high_y = self.range["y"]
        with store.open_input_file(inside) as file:
            for r, c, chunks in partition.tiles:
                layers = {}
                for k, (offset, count) in enumerate(chunks):
                    if not count:  # a tile that was never written
                        continue
                    file.seek(offset)
                    raw = file.read(count)
                    if len(raw) < count:
                        raise ValueError(f"{layout.path}: a tile ends early")
                    tile = _inflated(layout, raw, 1 if layout.apart else len(layout.bands))
                    for i in [partition.bands[k]] if layout.apart else partition.bands:
                        layers[layout.bands[i]] = tile[:, :, 0 if layout.apart else i]
                rows = np.arange(r * layout.tile_height, min((r + 1) * layout.tile_height, layout.height))
                cols = np.arange(c * layout.tile_width, min((c + 1) * layout.tile_width, layout.width))
                x, y = layout.x0 + (cols + 0.5) * layout.step_x, layout.y0 - (rows + 0.5) * layout.step_y
                keep_r, keep_c = (y >= low_y) & (y <= high_y), (x >= low_x) & (x <= high_x)
                if not keep_r.any() or not keep_c.any():
                    continue
                shape = (int(keep_r.sum()), int(keep_c.sum()))
                there, masks = np.zeros(shape, bool), {}
                for name, tile in layers.items():
                    values = tile[: len(rows), : len(cols)][keep_r][:, keep_c]
                    null = np.isnan(values) if values.dtype.kind == "f" else np.zeros(shape, bool)
                    if layout.nodata is not None and not np.isnan(layout.nodata):
                        null = null | (values == layout.nodata)
                    there |= ~null
                    masks[name] = (values, null)
                if self.options.get("empty", "drop") != "drop" or not partition.bands:
                    there[:] = True
                grid_r, grid_c = (np.broadcast_to(v, shape)[there] for v in ((rows[keep_r] + partition.row0)[:, None], (cols[keep_c] + partition.col0)[None, :]))
                columns = []
                for f in schema:
                    if f.name in masks:
                        values, null = (v[there] for v in masks[f.name])
                        columns.append(pa.array(values.astype(values.dtype.newbyteorder("=")), mask=null).cast(f.type))
                    elif f.name in layout.bands:
                        columns.append(pa.nulls(len(grid_r), f.type))
                    else:
                        values = {"pixel_id": grid_r * partition.columns + grid_c, "row_idx": grid_r, "col_idx": grid_c, "x": layout.x0 + (grid_c - partition.col0 + 0.5) * layout.step_x, "y": layout.y0 - (grid_r - partition.row0 + 0.5) * layout.step_y}[f.name]
                        columns.append(pa.array(values).cast(f.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class FilteredReader(GeoTiffReader):
    """The reader where the session hands filters to Python sources."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.range and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.range[name][0] = max(self.range[name][0], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.range[name][1] = min(self.range[name][1], f.value)
            yield f  # tiles are left out by it, rows of the others are filtered by Spark


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls):
        return "geotiff"

    def schema(self):
        """All bands, as doubles."""
        reader = GeoTiffReader(None, self.options)
        found = reader.layouts()
        bands = found[0].bands if found else ()
        return ", ".join(["pixel_id long", "row_idx int", "col_idx int", "x double", "y double", *(f"`{b.replace('`', '``')}` double" for b in bands)])

    def reader(self, schema):
        return (FilteredReader if self.options.get("filters") == "on" else GeoTiffReader)(schema, self.options)


def read_geotiff(spark: SparkSession, path: str, layers: list[str] | None = None, extent: tuple[float, float, float, float] | None = None, grid: GridSpec | None = None, empty: bool = False) -> DataFrame:
    """Cells of the GeoTIFF at `path`, a file or a folder of files of one geometry: pixel_id, row_idx, col_idx, x, y and the layers.

    `layers` are the bands to read (by their descriptions, else band1, band2 and so on), all by default;
    ones that are missing are named together.  `extent` (xmin, xmax, ymin, ymax) leaves cells whose centre
    lies in it; tiles outside are not read.  Rows and columns count from the corner of the whole, or of
    `grid`.  Nodata and NaN are NULL; cells without a value in any of the layers are left out, unless `empty`.
    Where the session has filter pushdown for Python sources on, filters on x, y, row_idx and col_idx leave out
    tiles as `extent` does.
    """
    ship_package(spark)
    spark.dataSource.register(GeoTiffSource)
    reader = spark.read.format("geotiff").option("empty", "keep" if empty else "drop").option("filters", "on" if spark.conf.get(_PUSHDOWN, "false").lower() == "true" else "off")
    if extent:
        reader = reader.option("extent", ",".join(repr(float(v)) for v in extent))
    if grid:
        reader = reader.option("grid_x0", repr(grid.x0)).option("grid_y0", repr(grid.y0)).option("grid_columns", str(grid.n_cols))
    if layers is not None:
        reader = reader.schema(", ".join(["pixel_id long", "row_idx int", "col_idx int", "x double", "y double", *(f"`{b.replace('`', '``')}` double" for b in layers)]))
    return reader.load(path)


def _entries(tags: list[tuple[int, int, tuple | bytes]], start: int) -> tuple[bytes, bytes]:
    """A classic little-endian directory at `start` and the values that do not fit into it."""
    tags = sorted(tags, key=lambda t: t[0])
    far_at = start + 2 + 12 * len(tags) + 4
    entries, far = io.BytesIO(), io.BytesIO()
    entries.write(struct.pack("<H", len(tags)))
    for tag, kind, values in tags:
        data = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        entries.write(struct.pack("<HHI", tag, kind, len(values)))
        if len(data) <= 4:
            entries.write(data.ljust(4, b"\0"))
        else:
            entries.write(struct.pack("<I", far_at + far.tell()))
            far.write(data + b"\0" * (len(data) % 2))
    entries.write(struct.pack("<I", 0))
    return entries.getvalue(), far.getvalue()


def tiff_bytes(grid: GridSpec, row0: int, col0: int, height: int, width: int, layers: list[str], tile: int, chunks: dict[tuple[int, int, int], bytes]) -> bytes:
    """A GeoTIFF of deflated float64 tiles: chunks by (band, tile row, tile column); absent ones are empty tiles."""
    down, across = -(-height // tile), -(-width // tile)
    order = [(b, r, c) for b in range(len(layers)) for r in range(down) for c in range(across)]
    counts = [len(chunks.get(k, b"")) for k in order]
    code = int(grid.crs.partition(":")[2] or 0)
    degrees = 4000 <= code < 5000  # geographic systems have these numbers
    items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(x)}</Item>' for i, x in enumerate(layers))
    n = len(layers)

    def tags(offsets):
        return [
            (WIDTH, 4, (width,)), (LENGTH, 4, (height,)), (BITS, 3, (64,) * n), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (n,)), (PLANAR, 3, (2,)), (TILE_WIDTH, 3, (tile,)), (TILE_LENGTH, 3, (tile,)),
            (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, tuple(counts)), (FORMAT, 3, (3,) * n), (PIXEL_SCALE, 12, (grid.res, grid.res, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, grid.x0 + col0 * grid.res, grid.y0 - row0 * grid.res, 0.0)),
            (GEO_KEYS, 3, (1, 1, 1, 3, MODEL_KEY, 0, 1, 2 if degrees else 1, RASTER_KEY, 0, 1, 1, GEOGRAPHIC_KEY if degrees else PROJECTED_KEY, 0, 1, code)),
            (METADATA, 2, f"<GDALMetadata>{items}</GDALMetadata>".encode("latin-1", "xmlcharrefreplace") + b"\0"), (NODATA, 2, b"nan\0"),
        ]

    entries, far = _entries(tags((0,) * len(order)), 8)
    at = 8 + len(entries) + len(far)
    offsets = tuple(int(at + before) if size else 0 for before, size in zip(np.cumsum([0, *counts[:-1]]), counts))
    if at + sum(counts) >= 2**32:
        raise ValueError("a block of tiles passes 4 GB: take smaller blocks")
    entries, far = _entries(tags(offsets), 8)
    return b"".join([struct.pack("<2sHI", b"II", 42, 8), entries, far, *(chunks[k] for k in order if k in chunks)])


def write_geotiff(cells: DataFrame, path: str, grid: GridSpec, layers: list[str], tile: int = 256, block: int = 8) -> int:
    """Write the layers of cells (row_idx, col_idx) to a folder of GeoTIFF files, replacing it; returns the number of files.

    One file covers block x block tiles; a task holds one file's compressed tiles.  Values are float64,
    NULL and absent cells are NaN; a tile without any value is not stored.  A cell that is there twice is an
    error, as is one outside the grid's columns; no cells give an empty folder.
    """
    spark = cells.sparkSession
    if tile % 16:
        raise ValueError("tiles have a multiple of 16 cells a side")
    ship_package(spark)
    hadoop_delete(spark, path)
    side, width = tile * block, grid.n_cols
    block_of = lambda c: F.floor(F.col(c) / side).cast("int")
    tile_of = lambda c: F.floor((F.col(c) % side) / tile).cast("int")
    held = cells.select(block_of("row_idx").alias("block_r"), block_of("col_idx").alias("block_c"), tile_of("row_idx").alias("tile_r"), tile_of("col_idx").alias("tile_c"), "row_idx", "col_idx", *(F.col(x).cast("double").alias(f"layer{i}") for i, x in enumerate(layers)))
    order = ["block_r", "block_c", "tile_r", "tile_c"]

    def run(batches):
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        key, arrays, filled, chunks, last = None, None, None, {}, -1

        def close_tile():
            for b, values in enumerate(arrays):
                if not np.isnan(values).all():
                    chunks[b, key[2], key[3]] = zlib.compress(values.astype("<f8").tobytes(), 6)

        def close_file():
            r0, c0 = key[0] * side, key[1] * side
            data = tiff_bytes(grid, r0, c0, last - r0 + 1, min(side, width - c0), layers, tile, chunks)
            name = posixpath.join(root, f"block_{key[0]:06d}_{key[1]:06d}.tif")
            part = f"{name}.{uuid.uuid4().hex}.part"  # a second attempt of a task replaces the first one's file as a whole
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["file", "bytes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(6)], axis=1)
            values = np.stack([batch.column(6 + b).to_numpy(zero_copy_only=False).astype(np.float64) for b in range(len(layers))])
            if at[:, 5].min() < 0 or at[:, 5].max() >= width or at[:, 4].min() < 0:
                raise ValueError(f"cells outside the {width} columns of the grid")
            cuts = np.r_[0, np.flatnonzero((at[1:, :4] != at[:-1, :4]).any(axis=1)) + 1, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = tuple(int(v) for v in at[a, :4])
                if here != key:
                    if key is not None:
                        close_tile()
                        if here[:2] != key[:2]:
                            yield close_file()
                            chunks, last = {}, -1
                    key = here
                    arrays, filled = np.full((len(layers), tile, tile), np.nan), np.zeros((tile, tile), bool)
                r, c = at[a:b, 4] % side % tile, at[a:b, 5] % side % tile
                if filled[r, c].any() or len(np.unique(r * tile + c)) < b - a:
                    raise ValueError(f"a cell of tile {here} is there twice")
                filled[r, c] = True
                arrays[:, r, c] = values[:, a:b]
                last = max(last, int(at[a:b, 4].max()))
        if key is not None:
            close_tile()
            yield close_file()

    files = held.repartition("block_r", "block_c").sortWithinPartitions(*order).mapInArrow(run, "file string, bytes long")
    return files.agg(F.count("*")).first()[0]
