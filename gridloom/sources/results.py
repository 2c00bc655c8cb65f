"""Result sinks and scans: decisions, objectives and parameters of optimisation runs."""

from __future__ import annotations

import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(decision: DataFrame, objective: DataFrame, scenario: DataFrame, path: str) -> None:
    """One dataset a kind, partitioned by scenario; an existing run is never overwritten."""
    for name, df in (("decision", decision), ("objective", objective)):
        df.write.mode("errorifexists").partitionBy("scenario_id").parquet(f"{path}/{name}")
    scenario.write.mode("errorifexists").json(f"{path}/scenario")
    run_summary(objective).write.mode("errorifexists").json(f"{path}/summary")


def run_path(spark: SparkSession, folder: str, day: datetime.date, ecosystem: str = "all") -> str:
    """The first free path results[_ecosystem]_ddmm_n in the folder, n from 1, claimed for this run.

    A path is claimed by creating its marker file, which only one of several runs can do.
    """
    jvm = spark.sparkContext._jvm
    base = f"{folder.rstrip('/')}/results{'' if ecosystem == 'all' else '_' + ecosystem}_{day:%d%m}"
    n = 1
    while True:
        marker = jvm.org.apache.hadoop.fs.Path(f"{base}_{n}/_claimed")
        store = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(marker.getParent()):
            try:
                if store.createNewFile(marker):
                    return f"{base}_{n}"
            except Py4JJavaError:
                if not store.exists(marker):
                    raise
        n += 1


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"decision": spark.read.parquet(f"{path}/decision"), "objective": spark.read.parquet(f"{path}/objective"), "scenario": spark.read.json(f"{path}/scenario")}


def run_summary(objective: DataFrame) -> DataFrame:
    """Ranges and means of every objective by scenario, as one nested document a scenario."""
    names = [c for c in objective.columns if c not in ("scenario_id", "sol_id")]
    stats = [F.struct(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean")).alias(c) for c in names]
    return objective.groupBy("scenario_id").agg(F.count("*").alias("n_solutions"), *stats)


def slim(df: DataFrame, *heavy: str) -> DataFrame:
    """Without the columns that are not worth keeping, present or not."""
    return df.drop(*heavy)


def parameter_document(scenarios: DataFrame) -> DataFrame:
    """One row: number of scenarios, and for every parameter its distinct values and, if numeric, its range."""
    parts = []
    for field in scenarios.schema.fields:
        if field.name == "scenario_id":
            continue
        c = F.col(field.name)
        numeric = field.dataType.typeName() in ("double", "float", "integer", "long")
        ends = [F.min(c).alias("min"), F.max(c).alias("max")] if numeric else []
        parts.append(F.struct(F.sort_array(F.collect_set(c)).alias("sampled"), *ends).alias(field.name))
    return scenarios.agg(F.count("*").alias("n_scenarios"), F.struct(*parts).alias("parameters"))


def save_parameters(scenarios: DataFrame, path: str) -> None:
    parameter_document(scenarios).write.mode("errorifexists").json(path)
