"""Queries on rasters: GeoTIFF written and read, neighbourhoods, quantiles, other reference systems, polygon files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import projection as P
from ..operators import catalog
from ..operators import cells as C
from ..operators.anomaly import to_long
from ..operators.focal import focal
from ..operators.quantiles import quantiles
from ..shared import session_folder, stored
from ..sources import grid as G
from ..sources.geotiff import read_geotiff, write_geotiff
from ..sources.shapefile import read_shapefile, write_shapefile
from .adapter import ANOM, ANOMALIES, CELL, GRID, LAYERS, LONG, anomaly_cells, cells, q_sql, with_xy
from .registry import query


def _written(spark, held, layers: list[str], name: str = "grid.tif") -> str:
    path = f"{session_folder(spark, 'raster')}/{name}"
    write_geotiff(held, path, GRID, layers, tile=64, block=2)
    return path


def _quant(*columns: str, digits: int = 3):
    return [N.quant(F.col(c), digits).alias(c) for c in columns]


_XY = "CAST(2556200 AS DOUBLE) + (col_idx + 0.5) * 100 AS x, CAST(1243700 AS DOUBLE) - (row_idx + 0.5) * 100 AS y"


@query(f"WITH {CELL} SELECT pixel_id, row_idx, col_idx, {_XY}, lulc, {q_sql('smd', 3)} AS smd, {q_sql('ndvi', 3)} AS ndvi FROM cell")
def geotiff_round_trip(spark, sf):
    """Cells written as a folder of GeoTIFF files and read again."""
    path = _written(spark, cells(spark, sf), ["lulc", "smd", "ndvi"])
    held = read_geotiff(spark, path)
    return held.select("pixel_id", "row_idx", "col_idx", "x", "y", F.col("lulc").cast("int").alias("lulc"), *_quant("smd", "ndvi"))


@query(f"""WITH {CELL}, e AS (SELECT max(row_idx) AS last FROM cell)
SELECT pixel_id, row_idx, col_idx, {q_sql('smd', 3)} AS smd FROM cell, e WHERE smd IS NOT NULL AND col_idx BETWEEN 20 AND 69 AND row_idx BETWEEN last // 4 AND last // 2""")
def geotiff_window(spark, sf):
    """One layer in an extent of half the columns and a quarter of the rows: other bands and tiles are not read."""
    held = cells(spark, sf)
    path = _written(spark, held, ["lulc", "smd"])
    last = held.agg(F.max("row_idx")).first()[0] or 0
    extent = (GRID.x0 + 20 * GRID.res, GRID.x0 + 70 * GRID.res, GRID.y0 - (last // 2 + 1) * GRID.res, GRID.y0 - last // 4 * GRID.res)
    return read_geotiff(spark, path, ["smd"], extent, GRID).select("pixel_id", "row_idx", "col_idx", *_quant("smd"))


@query(f"WITH {ANOM} SELECT pixel_id, {', '.join(f'{q_sql(x, 4)} AS {x}' for x in ANOMALIES)} FROM anom WHERE abiotic IS NOT NULL OR biotic IS NOT NULL OR landscape IS NOT NULL")
def anomaly_rasters(spark, sf):
    """The three anomaly layers written as a raster each, and stacked again by cell."""
    held, out = anomaly_cells(spark, sf), None
    for layer in ANOMALIES:
        one = read_geotiff(spark, _written(spark, held, [layer], f"{layer}.tif"), [layer], grid=GRID).select("pixel_id", *_quant(layer, digits=4))
        out = one if out is None else out.join(one, "pixel_id", "full")
    return out


# --- neighbourhoods and quantiles -------------------------------------------------------------------


def _focal_sql(size: int) -> str:
    h = size // 2
    along, across = (f"(PARTITION BY {a} ORDER BY {b} RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)" for a, b in (("row_idx", "col_idx"), ("col_idx", "row_idx")))
    rows = f"SELECT *, sum(smd) OVER w s, sum(smd * smd) OVER w q, count(smd) OVER w n, max(smd) OVER w hi, min(smd) OVER w lo FROM cell WINDOW w AS {along}"
    whole = f"SELECT pixel_id, sum(s) OVER v s, sum(q) OVER v q, sum(n) OVER v n, max(hi) OVER v hi, min(lo) OVER v lo FROM ({rows}) WINDOW v AS {across}"
    return f"""SELECT {size} AS size, pixel_id, {q_sql('s / nullif(n, 0)', 3)} AS mean, {q_sql('s', 2)} AS total, {q_sql('hi', 3)} AS hi, {q_sql('lo', 3)} AS lo,
{q_sql('CASE WHEN n > 1 THEN greatest(0.0, (q - s * s / n) / (n - 1)) END', 2)} AS variance FROM ({whole})"""


@query(f"WITH {CELL} " + " UNION ALL ".join(_focal_sql(size) for size in (3, 15, 31)))
def focal_reducers(spark, sf):
    """Mean, sum, maximum, minimum and variance over windows of 3, 15 and 31 cells."""
    held, out = stored(cells(spark, sf).select("pixel_id", "row_idx", "col_idx", "smd"), "smd"), None
    for size in (3, 15, 31):
        got = focal(held, "smd", size, {"mean": "mean", "total": "sum", "hi": "max", "lo": "min", "variance": "variance"})
        one = got.select(F.lit(size).alias("size"), "pixel_id", *_quant("mean", "hi", "lo"), *_quant("total", "variance", digits=2))
        out = one if out is None else out.unionByName(one)
    return out


_SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(f"""WITH {LONG}, p AS (SELECT CAST(unnest({list(_SHARES)}) AS DOUBLE) p) SELECT variable, p, {q_sql('q', 4)} AS q FROM (
{' UNION ALL '.join(f'SELECT variable, CAST({p} AS DOUBLE) AS p, quantile_cont(value, CAST({p} AS DOUBLE)) AS q FROM long GROUP BY 1' for p in _SHARES)})""")
def layer_quantiles(spark, sf):
    """Quantiles of every layer, whatever its range."""
    held = cells(spark, sf).withColumn("ecosystem", catalog.ecosystem_of(F.col("lulc"))).where("ecosystem IS NOT NULL")
    long = to_long(held, LAYERS, [], "variable", "value")
    return quantiles(long, "value", list(_SHARES), ("variable",)).select("variable", "p", *_quant("q", digits=4))


# --- other reference systems ------------------------------------------------------------------------

_CENTRES = f"SELECT *, x AS east, y AS north FROM (SELECT pixel_id, {_XY} FROM cell)"


@query(f"WITH {CELL} {P.as_sql(P.to_wgs84_steps(), _CENTRES, f'pixel_id, {q_sql("lon", 7)} AS lon, {q_sql("lat", 7)} AS lat')}")
def cells_in_degrees(spark, sf):
    """Longitude and latitude of every cell's centre."""
    held = P.transformed(with_xy(cells(spark, sf)), F.col("x"), F.col("y"), GRID.crs, "EPSG:4326", ("lon", "lat"))
    return held.select("pixel_id", *_quant("lon", "lat", digits=7))


_DEGREES = """SELECT CAST(r AS INT) AS row_idx, CAST(c AS INT) AS col_idx, 6.855e0 + (c + 0.5e0) * 0.001e0 AS lon, 47.345e0 - (r + 0.5e0) * 0.001e0 AS lat
  FROM (SELECT unnest(range((SELECT (max(row_idx) + 1) * 9 // 10 + 10 FROM cell))) AS r), (SELECT unnest(range(150)) AS c)"""


@query(f"""WITH {CELL}, p AS ({P.as_sql(P.to_lv95_steps(), _DEGREES, 'row_idx, col_idx, floor((east - 2556200) / 100) AS sc, floor((1243700 - north) / 100) AS sr')})
SELECT p.row_idx * 150 + p.col_idx AS target_id, c.pixel_id, {q_sql('smd', 3)} AS smd FROM p LEFT JOIN cell c ON c.col_idx = sc AND c.row_idx = sr""")
def reprojected_grid(spark, sf):
    """Nearest resampling onto a grid of thousandths of a degree that covers the cells."""
    held = cells(spark, sf).select("pixel_id", "row_idx", "col_idx", "smd")
    last = held.agg(F.max("row_idx")).first()[0]
    degrees = G.GridSpec(n_rows=(last + 1) * 9 // 10 + 10 if last is not None else 0, n_cols=150, x0=6.855, y0=47.345, res=0.001, crs="EPSG:4326")
    target = G.grid_cells(spark, degrees).withColumnRenamed("pixel_id", "target_id")
    return G.nearest_resample(target, held, degrees, GRID, ["pixel_id", "smd"]).select(F.col("target_id").cast("int").alias("target_id"), "pixel_id", *_quant("smd"))


# --- polygon files ------------------------------------------------------------------------------------

#: Rings as shares of the grid's width and height: A has a hole, B two parts, C lies in A's hole.
_RINGS = {
    "A": [[(0.13, 0.11), (0.82, 0.17), (0.91, 0.83), (0.21, 0.74)], [(0.37, 0.33), (0.63, 0.36), (0.58, 0.61)]],
    "B": [[(0.03, 0.04), (0.31, 0.02), (0.17, 0.29)], [(0.71, 0.79), (0.97, 0.97), (0.44, 0.93)]],
    "C": [[(0.42, 0.38), (0.55, 0.41), (0.53, 0.53)]],
}
_VERTICES = [(name, i, k, fx, fy) for name, rings in _RINGS.items() for i, ring in enumerate(rings) for k, (fx, fy) in enumerate(ring)]
_EDGES = ", ".join(f"('{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for name, rings in _RINGS.items() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]))


def _regions_sql(wanted: str) -> str:
    point = lambda k: f"2556200 + CAST(x{k} AS DOUBLE) * 10000 AS x{k}, 1243700 - CAST(y{k} AS DOUBLE) * (last * 100) AS y{k}"
    return f"""WITH {CELL}, f(region, x1, y1, x2, y2) AS (VALUES {_EDGES}), e AS (SELECT region, {point(1)}, {point(2)} FROM f, (SELECT CAST(max(row_idx) + 1 AS DOUBLE) AS last FROM cell) WHERE region IN ({wanted}))
SELECT pixel_id, region FROM eco, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY pixel_id, region HAVING count(*) % 2 = 1"""


def _polygon_file(spark, held) -> str:
    """The regions, written as shapefiles."""
    path = f"{session_folder(spark, 'polygons')}/regions"
    shares = spark.createDataFrame(_VERTICES, "name string, ring_id int, seq int, fx double, fy double")
    last = held.agg((F.max("row_idx") + 1).cast("double").alias("last"))
    placed = shares.crossJoin(F.broadcast(last)).where("last is not null").withColumns({"x": F.lit(2556200) + F.col("fx") * 10000, "y": F.lit(1243700) - F.col("fy") * (F.col("last") * 100)})
    write_shapefile(placed, path, files=2)
    return path


@query(_regions_sql("'A', 'B', 'C'"))
def polygon_file_cells(spark, sf):
    """Cells by the regions of a polygon file, with holes and several parts; inner tiles are decided as a whole."""
    held = with_xy(stored(cells(spark, sf).select("pixel_id", "row_idx", "col_idx"), "places"))
    shapes = read_shapefile(spark, _polygon_file(spark, held)).withColumnRenamed("NAME", "name")
    return C.in_polygons_by_tiles(held, stored(C.ring_edges(shapes), "edges"), tile=8)


@query(_regions_sql("'A'"))
def polygon_file_region(spark, sf):
    """Cells of one region, whose rings alone are read from the file."""
    held = with_xy(stored(cells(spark, sf).select("pixel_id", "row_idx", "col_idx"), "places"))
    shapes = read_shapefile(spark, _polygon_file(spark, held), "NAME", "A").withColumnRenamed("NAME", "name")
    return C.in_polygons_by_tiles(held, stored(C.ring_edges(shapes), "edges"), tile=8)
