"""Dimensions of the engine: land-cover classes, indicators, categories, legends, regions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Land-cover codes of the ecosystems.
ECOSYSTEM_CODES = {"forest": [12, 13], "agricultural": [15], "grassland": [16, 17]}
# Indicators of the categories.
CATEGORY_CODES = {
    "abiotic": ["smd", "sbd", "soc"],
    "biotic": ["uzl", "tsd", "can", "cdi", "swf_h", "swf_t", "lai", "ndvi"],
    "landscape": ["snh", "frag", "tcd"],
}
# Reference system, bounds (xmin, ymin, xmax, ymax) and shape expected of a region.
REGIONS = {
    "Bern": {"crs": "EPSG:2056", "bounds": (2556200, 1130600, 2677700, 1243700), "shape": None},
    "CH": {"crs": "EPSG:2056", "bounds": (2480000, 1070000, 2834000, 1300000), "shape": (2300, 3600)},
}
# The pair codes and their colours, by the two categories that a map compares.
PAIRS = ["1 - 1", "1 - 2", "1 - 3", "2 - 1", "2 - 2", "2 - 3", "3 - 1", "3 - 2", "3 - 3"]
COLOURS = {
    "ab": ["#d3d3d3", "#88cfcf", "#00c5c5", "#c881bb", "#817eb6", "#0079ae", "#b70092", "#76008f", "#000089"],
    "bl": ["#d3d3d3", "#e1e14d", "#e8e800", "#88cfcf", "#91dc4c", "#96e300", "#00c5c5", "#00d248", "#00d900"],
    "al": ["#d3d3d3", "#e1e14d", "#e8e800", "#c881bb", "#d58a44", "#dc8e00", "#b70092", "#c30036", "#c90000"],
}
# Indicators in use, by ecosystem and category, in order of entry.
INDICATORS = {
    ("Forest", "Abiotic"): ["smd", "sbd", "soc"], ("Agriculture", "Abiotic"): ["smd", "sbd", "soc"], ("Grassland", "Abiotic"): ["smd", "sbd", "soc"],
    ("Forest", "Biotic"): ["tsd", "can", "lai"], ("Agriculture", "Biotic"): ["uzl", "cdi", "swf_h", "swf_t", "ndvi"], ("Grassland", "Biotic"): ["uzl", "swf_h", "swf_t", "ndvi"],
    ("Forest", "Landscape"): ["frag"], ("Agriculture", "Landscape"): ["snh"], ("Grassland", "Landscape"): ["snh"],
}
# Display names.
LABELS = {
    "smd": "Soil Moisture Deficit", "sbd": "Soil Bulk Density", "soc": "Soil Organic Carbon", "tsd": "Tree Species Diversity", "can": "Canopy Height",
    "lai": "Leaf Area Index", "frag": "Forest Fragmentation", "uzl": "UZL Species", "cdi": "Crop Diversity Index", "swf_h": "Small Woody Features (Hedgerows)",
    "swf_t": "Small Woody Features (Trees)", "ndvi": "NDVI", "snh": "Semi-natural Habitat Density",
    "forest_index": "Forest EC Index", "agricultural_index": "Agricultural EC Index", "grass_index": "Grassland & Pastures EC Index",
}
# Codes of the indicator layers, in order of loading, and the one with a nodata value.
INDICATOR_LAYERS = ["forest_index", "agricultural_index", "grass_index", "smd", "sbd", "soc", "uzl", "swf_h", "swf_t", "ndvi", "cdi", "snh", "md", "tsd", "can", "lai", "frag"]
NODATA = {"tsd": -128.0}
# Layers that the objectives are read from.
OBJECTIVES = {
    "abiotic": "abiotic_anomaly", "biotic": "biotic_anomaly", "landscape": "landscape_anomaly",
    "cost": "implementation_cost", "population_proximity": "population_proximity",
}


def codes_of(ecosystem: str) -> list[int]:
    """Land-cover codes of an ecosystem; 'all' is their union."""
    if ecosystem == "all":
        return sorted(sum(ECOSYSTEM_CODES.values(), []))
    if ecosystem not in ECOSYSTEM_CODES:
        raise ValueError(f"unknown ecosystem {ecosystem!r}")
    return ECOSYSTEM_CODES[ecosystem]


def ecosystem_of(lulc: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, codes in ECOSYSTEM_CODES.items():
        out = F.when(lulc.isin(codes), name).otherwise(out)
    return out


def category_of(variable: Column, landscape_mode: str = "list") -> Column:
    """Category of an indicator; landscape_mode 'else' sends every other indicator to landscape."""
    out = F.lit("landscape") if landscape_mode == "else" else F.when(variable.isin(CATEGORY_CODES["landscape"]), "landscape")
    for name in ("abiotic", "biotic"):
        out = F.when(variable.isin(CATEGORY_CODES[name]), name).otherwise(out)
    return out


def legend(spark: SparkSession, which: str) -> DataFrame:
    """Colours (grp, fill) of the pair codes of a comparison: ab, bl or al."""
    return spark.createDataFrame(list(zip(PAIRS, COLOURS[which])), "grp string, fill string")


def indicator_rows(spark: SparkSession) -> DataFrame:
    rows, at = [], 0
    for (ecosystem, kind), codes in INDICATORS.items():
        for code in codes:
            at += 1
            rows.append((code, kind, ecosystem, at))
    return spark.createDataFrame(rows, "indicator string, class string, ecosystem string, input_pos int")


def layers_of(names: list[str], variables: list[str]) -> list[str]:
    """Names of a stack's layers that begin with a wanted variable and `_anom`, by variable, then in the stack's order."""
    return [name for variable in variables for name in names if re.match(re.escape(variable) + "_anom", name)]


def region_rows(spark: SparkSession) -> DataFrame:
    """The regions as a table: name, crs, bounds and the expected shape, NULL where none is."""
    rows = [(name, r["crs"], *map(float, r["bounds"]), *(r["shape"] or (None, None))) for name, r in REGIONS.items()]
    return spark.createDataFrame(rows, "region string, crs string, xmin double, ymin double, xmax double, ymax double, n_rows int, n_cols int")


def region_reference(name: str) -> dict | None:
    """What is known of a region; an unknown one has none."""
    return REGIONS.get(name)


def label_of(name: Column, labels: dict[str, str]) -> Column:
    """Display label, the name itself where there is none."""
    if not labels:
        return name
    pairs = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, name), name)
