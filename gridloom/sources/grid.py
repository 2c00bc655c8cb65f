"""Grid tables: one row per cell; scans, geometry checks and sinks.

A grid is stored as Parquet with pixel_id, row_idx, col_idx, optional x, y and one column a layer.
Scans select columns and ranges declaratively, so both reach the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clean
from ..functions.projection import transformed
from ..operators.catalog import INDICATOR_LAYERS, NODATA, OBJECTIVES

KEYS = ("pixel_id", "row_idx", "col_idx")


@dataclass(frozen=True)
class GridSpec:
    """Geometry that all layers of a stack share."""

    n_rows: int
    n_cols: int
    x0: float = 0.0
    y0: float = 0.0
    res: float = 100.0
    crs: str = "EPSG:2056"

    def pixel(self, row: Column, col: Column) -> Column:
        return (row.cast("long") * self.n_cols + col).cast("long")

    def row(self, pixel: Column) -> Column:
        return F.floor(pixel / self.n_cols).cast("int")

    def col(self, pixel: Column) -> Column:
        return (pixel % self.n_cols).cast("int")

    def x(self, col: Column) -> Column:
        return self.x0 + (col + 0.5) * self.res

    def y(self, row: Column) -> Column:
        return self.y0 - (row + 0.5) * self.res


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The grid at the first path that exists, GeoTIFF if it is named so, else Parquet; an error names them all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            if path.rstrip("/").lower().endswith((".tif", ".tiff")):
                from .geotiff import read_geotiff

                return read_geotiff(spark, path)
            return spark.read.parquet(path)
    raise FileNotFoundError(f"no grid at any of {paths}")


def scan_layers(cells: DataFrame, layers: list[str], keep: tuple[str, ...] = (), tolerant: bool = False, nodata: dict[str, float] | None = None) -> DataFrame:
    """Keys and the wanted layers, NaN and nodata as NULL.

    All missing layers are reported at once, unless `tolerant` leaves them out.
    """
    missing = [x for x in layers if x not in cells.columns]
    if missing and not tolerant:
        raise KeyError(f"layers not in the grid: {missing}")
    columns = [F.col(k) for k in (*KEYS, *keep) if k in cells.columns]
    for name in layers:
        if name not in missing:
            value = clean(F.col(name))
            if nodata and name in nodata:
                value = F.nullif(value, F.lit(float(nodata[name])))
            columns.append(value.alias(name))
    return cells.select(*columns)


def scan_objectives(cells: DataFrame, objectives: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keys and the layers of the named objectives, all of them by default; an unknown one is an error, layers that are missing are named together."""
    wanted = list(OBJECTIVES) if objectives is None else objectives
    unknown = [x for x in wanted if x not in OBJECTIVES]
    if unknown:
        raise ValueError(f"unknown objectives {unknown}; there are {list(OBJECTIVES)}")
    return scan_layers(cells, [OBJECTIVES[x] for x in wanted], keep)


def scan_indicators(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keys and whatever of the named indicator layers the grid has, nodata as NULL."""
    return scan_layers(cells, INDICATOR_LAYERS, keep, tolerant=True, nodata=NODATA)


def crop(cells: DataFrame, extent: tuple[float, float, float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Cells with x and y in (xmin, xmax, ymin, ymax): a range predicate for the scan."""
    return cells.where(F.col(x).between(extent[0], extent[1]) & F.col(y).between(extent[2], extent[3]))


def misplaced(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells that lie outside the grid or do not sit at their row-major index."""
    return cells.where(
        ~F.col("row_idx").between(0, grid.n_rows - 1) | ~F.col("col_idx").between(0, grid.n_cols - 1) | (F.col("pixel_id") != grid.pixel(F.col("row_idx"), F.col("col_idx")))
    ).select("pixel_id", "row_idx", "col_idx")


def check_geometry(cells: DataFrame, grid: GridSpec) -> None:
    """Raise if any cell is misplaced."""
    found = misplaced(cells, grid).take(3)
    if found:
        raise ValueError(f"cells do not fit the grid {grid}: {found}")


def nearest_resample(target: DataFrame, source: DataFrame, target_grid: GridSpec, source_grid: GridSpec, layers: list[str]) -> DataFrame:
    """Layers of the source cell in which each target cell's centre lies, NULL outside the source.

    Where reference systems differ, the centre is projected back to the source's; either way the source's
    row and column are computed and joined on.
    """
    held = transformed(target, target_grid.x(F.col("col_idx")), target_grid.y(F.col("row_idx")), target_grid.crs, source_grid.crs, ("__x", "__y"))
    col = F.floor((F.col("__x") - source_grid.x0) / source_grid.res).cast("int")
    row = F.floor((source_grid.y0 - F.col("__y")) / source_grid.res).cast("int")
    picked = source.select(F.col("row_idx").alias("__r"), F.col("col_idx").alias("__c"), *layers)
    return held.withColumns({"__r": row, "__c": col}).join(picked, ["__r", "__c"], "left").drop("__r", "__c", "__x", "__y")


def grid_cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """All cells of a grid: pixel_id, row_idx, col_idx."""
    pixel = F.col("id")
    return spark.range(grid.n_rows * grid.n_cols).select(pixel.alias("pixel_id"), grid.row(pixel).alias("row_idx"), grid.col(pixel).alias("col_idx"))


def write_grid(cells: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    cells.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
