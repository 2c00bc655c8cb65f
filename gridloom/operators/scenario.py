"""Scenario grids: sampled parameters, their product, lookup and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import linspace

# Parameters of the scenarios; a pair (low, high) is a range, a list has its values.
PARAMETERS = {
    "max_restoration_fraction": [0.1, 0.3],
    "spatial_clustering": [0.0, 0.3],
    "burden_sharing": ["no"],
    "abiotic_effect": (0.005, 0.02),
    "biotic_effect": (0.005, 0.02),
    "landscape_effect": [0.01],
    "anomaly_weight_shape": ["exponential"],
    "anomaly_weight_scale": [1.0],
}


def scenario_grid(spark: SparkSession, parameters: dict = PARAMETERS, n: int = 3) -> DataFrame:
    """All combinations, numbered with the last parameter running fastest."""
    grid = spark.range(1).select(F.lit(0).cast("int").alias("scenario_id"))
    for name, spec in parameters.items():
        values = linspace(*spec, n) if isinstance(spec, tuple) else list(spec)
        entries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)))
        grid = grid.withColumn("__e", F.explode(entries)).withColumn("scenario_id", (F.col("scenario_id") * len(values) + F.col("__e.i")).cast("int")).withColumn(name, F.col("__e.v")).drop("__e")
    return grid


def scenario_by_index(grid: DataFrame, index: int) -> DataFrame:
    found = grid.where(F.col("scenario_id") == index)
    if found.isEmpty():
        raise IndexError(f"no scenario {index}")
    return found


def parameter_summary(grid: DataFrame) -> DataFrame:
    """(parameter, n_values, sampled): the distinct values of each parameter in order, as text."""
    names = [c for c in grid.columns if c != "scenario_id"]
    long = grid.select(*(F.col(c).cast("string").alias(c) for c in names)).unpivot([], names, "parameter", "value")
    return long.groupBy("parameter").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("sampled"))
