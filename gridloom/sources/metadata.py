"""Indicator metadata and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the metadata sheet; the second list is the time-series table.
SHEET = ["code", "Indicator", "Class", "Units", "Sp. coverage, res.", "characteristic", "instrumental_relevance", "Directionality", "Ecosystems", "Time series", "Coverage"]
TIME_SERIES = ["Indicator", "Class", "Ecosystems", "Time series", "Coverage"]
SEPARATORS = (1, 5, 16)


def indicator_sheet(spark: SparkSession, path: str) -> DataFrame:
    """The sheet as CSV with a header; all columns are text, those that are missing NULL."""
    held = spark.read.csv(path, header=True)
    return held.select(*(F.col(f"`{c}`") if c in held.columns else F.lit(None).cast("string").alias(c) for c in SHEET))


def time_series_table(sheet: DataFrame, order: str = "code") -> DataFrame:
    """Five columns of the sheet, numbered by `order`; `line_after` marks rows that a separator follows."""
    numbered = sheet.withColumn("row", F.row_number().over(Window.orderBy(order)))
    return numbered.select("row", *(F.col(f"`{c}`") for c in TIME_SERIES), F.col("row").isin(*SEPARATORS).alias("line_after"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, megabytes) of the files under a path, without reading them."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return held.select("path", (F.col("length") / F.lit(1024.0 * 1024.0)).alias("megabytes"))
