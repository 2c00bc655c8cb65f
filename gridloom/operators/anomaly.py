"""Standardised anomalies: reshape, z-scores by ecosystem, category means, mosaics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import CATEGORY_CODES, category_of, ecosystem_of


def to_long(cells: DataFrame, layers: list[str], keys: list[str], name: str = "variable", value: str = "value", drop_null: bool = True) -> DataFrame:
    out = cells.unpivot([F.col(k) for k in keys], [F.col(x) for x in layers], name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def to_wide(long: DataFrame, keys: list[str], name: str, value: str, values: list[str]) -> DataFrame:
    return long.groupBy(*keys).pivot(name, values).agg(F.first(value, ignorenulls=True))


def group_stats(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and sample deviation of each group: one partially aggregated pass, a row a group."""
    return long.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def zscore(long: DataFrame, by: list[str], value: str = "value", out: str = "z") -> DataFrame:
    """z of every row in its group; groups whose deviation is 0 or unknown drop out.

    Statistics are aggregated and joined back (a row a group) instead of windowed, so no task holds
    a group; AQE broadcasts them as long as they are small.
    """
    stats = group_stats(long, by, value).where("sd > 0")
    return long.join(stats, by).withColumn(out, (F.col(value) - F.col("mean")) / F.col("sd")).drop("mean", "sd")


def normalise(long: DataFrame, by: list[str], value: str = "value", out: str = "z") -> DataFrame:
    """z of every row in its group, 0 throughout a group whose deviation is 0 or unknown."""
    stats = group_stats(long, by, value)
    z = (F.col(value) - F.col("mean")) / F.when(F.col("sd") != 0, F.col("sd"))
    return long.join(stats, by).withColumn(out, F.coalesce(z, F.lit(0.0))).drop("mean", "sd")


def anomalies(cells: DataFrame, layers: list[str], keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """(keys, ecosystem, variable, value, z): all ecosystems at once, since they are disjoint."""
    held = cells.withColumn("ecosystem", ecosystem_of(F.col("lulc"))).where("ecosystem is not null")
    return zscore(to_long(held, layers, [*keys, "ecosystem"]), ["ecosystem", "variable"])


def category_means(long: DataFrame, keys: list[str], landscape_mode: str = "list") -> DataFrame:
    """Mean anomaly of each category by cell, over the variables that the cell has."""
    held = long.withColumn("category", category_of(F.col("variable"), landscape_mode)).where("category is not null")
    return held.groupBy(*keys, "category").agg(F.avg("z").alias("anomaly"))


def with_anomalies(cells: DataFrame, layers: list[str]) -> DataFrame:
    """All cells with ecosystem, abiotic, biotic and landscape, NULL where a cell has none.

    The same numbers as category_means(anomalies(...)), without turning cells into rows: one partial
    aggregation for the statistics (a row an ecosystem, so they are broadcast), and one projection.
    """
    held = cells.withColumn("ecosystem", ecosystem_of(F.col("lulc")))
    stats = held.where("ecosystem is not null").groupBy("ecosystem").agg(*(f(x).alias(f"__{n}_{x}") for x in layers for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    held = held.join(F.broadcast(stats), "ecosystem", "left")
    z = {x: F.when(F.col(f"__s_{x}") > 0, (F.col(x) - F.col(f"__m_{x}")) / F.col(f"__s_{x}")) for x in layers}
    means = []
    for category, codes in CATEGORY_CODES.items():
        mine = [z[x] for x in layers if x in codes]
        total = reduce(lambda a, b: a + b, (F.coalesce(v, F.lit(0.0)) for v in mine), F.lit(0.0))
        count = reduce(lambda a, b: a + b, (v.isNotNull().cast("int") for v in mine), F.lit(0))
        means.append((total / F.when(count > 0, count)).alias(category))
    return held.select(*cells.columns, "ecosystem", *means)


def anomaly_layers(cells: DataFrame, layers: list[str]) -> DataFrame:
    """Wide result: pixel_id, ecosystem, abiotic, biotic, landscape of the cells that have any of the three."""
    return with_anomalies(cells, layers).select("pixel_id", "ecosystem", *CATEGORY_CODES).where(F.coalesce(*map(F.col, CATEGORY_CODES)).isNotNull())


def mosaic(layers: list[DataFrame], value: str) -> DataFrame:
    """Union of layers (pixel_id, value): of overlapping values the first layer's that has one."""
    every = None
    for order, layer in enumerate(layers):
        part = layer.select("pixel_id", F.col(value), F.lit(order).alias("__order"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("pixel_id").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__order"))).alias(value))
