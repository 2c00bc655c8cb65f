"""Masks, eligibility, samples and polygon membership of cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import ECOSYSTEM_CODES, codes_of


def ecosystem_mask(cells: DataFrame, ecosystem: str) -> DataFrame:
    """Cells of an ecosystem ('all': of any; 'no_mask': every cell)."""
    return cells if ecosystem == "no_mask" else cells.where(F.col("lulc").isin(codes_of(ecosystem)))


def eligible(cells: DataFrame, layers: list[str], ecosystem: str = "all", extra: Column | None = None) -> DataFrame:
    """Cells with a value in every layer, of the ecosystem, that meet the optional business rule."""
    out = ecosystem_mask(cells, ecosystem).where(reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in layers)))
    return out if extra is None else out.where(extra)


def rectangle_sample(cells: DataFrame, fraction: float, origin: tuple[int, int] | None = None, seed: int = 42) -> DataFrame:
    """Cells in a contiguous rectangle of sqrt(fraction) of the bounding box's height and width.

    The corner is `origin`, or drawn by `seed`; a rectangle without cells gives all cells.
    """
    box = cells.agg(F.min("row_idx"), F.max("row_idx"), F.min("col_idx"), F.max("col_idx")).first()
    if box[0] is None or not 0 < fraction < 1:
        return cells
    scale = math.sqrt(fraction)
    height, width = max(1, int(scale * (box[1] - box[0] + 1))), max(1, int(scale * (box[3] - box[2] + 1)))
    if origin is None:
        import random

        draw = random.Random(seed)
        origin = (draw.randint(box[0], max(box[0], box[1] - height + 1)), draw.randint(box[2], max(box[2], box[3] - width + 1)))
    inside = cells.where(F.col("row_idx").between(origin[0], origin[0] + height - 1) & F.col("col_idx").between(origin[1], origin[1] + width - 1))
    return cells if inside.isEmpty() else inside


def polygon_edges(spark, polygons: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(region, x1, y1, x2, y2) of closed rings."""
    rows = [(name, *map(float, a), *map(float, b)) for name, ring in polygons.items() for a, b in zip(ring, ring[1:] + ring[:1])]
    return spark.createDataFrame(rows, "region string, x1 double, y1 double, x2 double, y2 double")


def ring_edges(vertices: DataFrame, attribute: str | None = None, wanted: str | None = None) -> DataFrame:
    """(region, x1, y1, x2, y2) from a table of vertices: name, ring_id, seq, x, y; rings close by themselves.

    `attribute` = `wanted` picks polygons before anything else is done (a predicate for the scan).
    A window holds one ring.
    """
    held = vertices if attribute is None else vertices.where(F.col(attribute) == wanted)
    ring = Window.partitionBy("name", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).cast("double")
    edges = held.select(F.col("name").alias("region"), F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))
    return edges.where("x1 <> x2 or y1 <> y2")


def in_polygons(cells: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", band: float = 100.0) -> DataFrame:
    """(pixel_id, region) of cells whose centre lies in a region: an odd number of edges to its right.

    Edges are laid into horizontal bands of height `band` (a cell's, so that a band is a row of the grid)
    and joined on the band's number: a cell meets the few edges of its row, not all of them.  Cells
    outside the bounding box of all edges are cut off by a range predicate first.
    """
    box = edges.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    if box[0] is None:
        return cells.select("pixel_id", F.lit(None).cast("string").alias("region")).limit(0)
    number = lambda c: F.floor((c - F.lit(box[2])) / F.lit(band)).cast("long")
    bands = F.explode(F.sequence(number(F.least("y1", "y2")), number(F.greatest("y1", "y2"))))
    laid = edges.where("y1 <> y2").withColumn("__band", bands)
    near = cells.where(F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3])).select("pixel_id", F.col(x).alias("__x"), F.col(y).alias("__y"))
    near = near.withColumn("__band", number(F.col("__y")))
    crosses = ((F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y"))) & (
        F.col("__x") < (F.col("x2") - F.col("x1")) * (F.col("__y") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1")
    )
    hits = near.join(laid, "__band").where(crosses).groupBy("pixel_id", "region").agg(F.count("*").alias("n"))
    return hits.where("n % 2 = 1").select("pixel_id", "region")


def in_polygons_by_tiles(cells: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", band: float = 100.0, tile: int = 64) -> DataFrame:
    """in_polygons, where tiles of `tile` bands a side that no edge comes near are decided as a whole, by their middle.

    Only cells of the other tiles, along the edges, meet edges.
    """
    side = band * tile
    at = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    held = cells.select("pixel_id", F.col(x).alias("__x"), F.col(y).alias("__y")).withColumns({"__tx": at("__x"), "__ty": at("__y")})
    spread = edges.select(*(F.sequence(F.least(at(f"{c}1"), at(f"{c}2")), F.greatest(at(f"{c}1"), at(f"{c}2"))).alias(f"__t{c}") for c in "xy"))
    near = spread.select(F.explode("__tx").alias("__tx"), "__ty").select("__tx", F.explode("__ty").alias("__ty")).distinct()
    tiles = held.select("__tx", "__ty").distinct().join(near, ["__tx", "__ty"], "left_anti")
    middles = tiles.select(F.struct("__tx", "__ty").alias("pixel_id"), ((F.col("__tx") + 0.5) * side).alias("x"), ((F.col("__ty") + 0.5) * side).alias("y"))
    whole = in_polygons(middles, edges, band=side).select("pixel_id.*", "region")
    along = in_polygons(held.join(near, ["__tx", "__ty"], "left_semi"), edges, "__x", "__y", band)
    return held.join(whole, ["__tx", "__ty"]).select("pixel_id", "region").unionByName(along)


def polygon_mask(cells: DataFrame, edges: DataFrame, region: str, x: str = "x", y: str = "y") -> DataFrame:
    return cells.join(in_polygons(cells, edges.where(F.col("region") == region), x, y), "pixel_id", "left_semi")


def polygon_clip(cells: DataFrame, edges: DataFrame, within: str, x: str = "x", y: str = "y") -> DataFrame:
    """(pixel_id, region) of the parts of all other regions that lie within the region `within`."""
    inside = in_polygons(cells, edges, x, y)
    outer = inside.where(F.col("region") == within).select("pixel_id")
    return inside.where(F.col("region") != within).join(outer, "pixel_id", "left_semi")


def region_ecosystem_mask(cells: DataFrame, ecosystem: str, edges: DataFrame | None = None, region: str | None = None) -> DataFrame:
    """Cells of an ecosystem within a polygon; 'no_mask', or an ecosystem that is not known, lets every cell of the polygon pass."""
    held = cells if region is None else polygon_mask(cells, edges, region)
    return ecosystem_mask(held, ecosystem) if ecosystem == "all" or ecosystem in ECOSYSTEM_CODES else held


def scatter(cells: DataFrame, sparse: DataFrame, value: str, default=None) -> DataFrame:
    """All cells with a sparse value, `default` where there is none."""
    column = F.col(value) if default is None else F.coalesce(F.col(value), F.lit(default))
    return cells.join(sparse.select("pixel_id", value), "pixel_id", "left").withColumn(value, column)
