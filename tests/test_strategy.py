"""A search with strategies and an evaluation from outside, and the contract that repairs keep."""

from __future__ import annotations

from dataclasses import dataclass

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import evolve, strategy

KEYS = ["scenario_id", "sol_id"]
NAMES = "scenario_id int, max_restoration_fraction double, spatial_clustering double, burden_sharing string, anomaly_weight_shape string, anomaly_weight_scale double"


def grid(spark):
    return spark.range(200).selectExpr(
        "id AS pixel_id", "CAST(id div 20 AS int) AS row_idx", "CAST(id % 20 AS int) AS col_idx", "CAST(id % 4 AS int) AS region_id", "true AS eligible", "sin(id) AS a", "cos(id) AS b", "1.0 + id % 13 AS cost"
    ).persist()


@dataclass(frozen=True)
class FromCorner:
    """k cells nearest to a corner that the solution's number picks; its plans may be spoilt."""

    spoil: str = ""

    def sample(self, cells, wanted, seed):
        return wanted.crossJoin(cells.where("pixel_id = 0").select("pixel_id").distinct()).select(*KEYS, "pixel_id").where("sol_id % 2 = 0")

    def repair(self, plans, cells, wanted, seed):
        far = F.abs(F.col("row_idx") - F.col("sol_id") % 3) + F.abs(F.col("col_idx") - F.col("sol_id") % 5)
        rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(far, "pixel_id"))
        out = cells.join(wanted, "scenario_id").withColumn("r", rank)
        if self.spoil == "count":
            out = out.withColumn("r", F.when(F.col("sol_id") == 1, F.col("r") + 1).otherwise(F.col("r")))
        out = out.where("r <= k").select(*KEYS, "pixel_id")
        if self.spoil == "key":
            out = out.withColumn("sol_id", F.when(F.col("sol_id") == 1, 77).otherwise(F.col("sol_id")))
        if self.spoil == "pixel":
            out = out.withColumn("pixel_id", F.when(F.col("sol_id") == 1, F.col("pixel_id") + 5000).otherwise(F.col("pixel_id")))
        if self.spoil == "twice":
            out = out.withColumn("pixel_id", F.when(F.col("sol_id") == 1, F.lit(3)).otherwise(F.col("pixel_id")))
        return out.withColumn("extra", F.lit(1)) if self.spoil == "column" else out


def judged(plans, solutions, settings):
    """Two objectives of a caller's own: the rows that a plan reaches over, and its cells in odd columns."""
    held = plans.withColumns({"r": F.floor(F.col("pixel_id") / 20), "odd": (F.col("pixel_id") % 2).cast("long")})
    points = held.groupBy(*KEYS).agg((F.max("r") - F.min("r")).alias("span"), F.sum("odd").alias("odd"))
    return solutions.select(*KEYS).join(points, KEYS, "left").fillna(0).withColumn("violation", F.lit(0).cast("long"))


def test_a_strategy_and_an_evaluation_from_outside(spark):
    cells, scenarios = grid(spark), spark.createDataFrame([(0, 0.1, 0.0, "no", "exponential", 1.0), (1, 0.2, 0.0, "yes", "exponential", 1.0)], NAMES)
    choose = lambda row: FromCorner() if row["scenario_id"] == 0 else strategy.of_scenario(row)
    decision, front = evolve.search(cells, scenarios, {"a": 0.1, "b": 0.1}, "cost", population=4, generations=1, strategy=choose, evaluate=judged)
    assert front.columns == [*KEYS, "span", "odd", "violation"] and {r.scenario_id for r in front.collect()} == {0, 1}
    sizes = {(r.scenario_id, r["count"]) for r in decision.groupBy(*KEYS).count().collect()}
    assert sizes == {(0, 20), (1, 40)}
    reach = decision.where("scenario_id = 0").agg(F.max("pixel_id")).first()[0]
    assert reach < 20 * 10  # near a corner
    assert strategy.of_scenario({"spatial_clustering": 0.3, "burden_sharing": "yes"}) == strategy.Spread(True, 0.3)
    assert strategy.of_scenario({"spatial_clustering": 0.0, "burden_sharing": "no"}) == strategy.ByScore()
    with pytest.raises(ValueError, match="unknown burden"):
        strategy.of_scenario({"spatial_clustering": 0.0, "burden_sharing": "maybe"})


def test_repairs_that_break_the_contract_are_named(spark):
    cells = grid(spark).withColumns({"scenario_id": F.lit(0), "score": F.col("a")})
    wanted = spark.createDataFrame([(0, s, 20) for s in range(3)], "scenario_id int, sol_id int, k long")
    for spoil, text in (("count", "solution 1 .* has 19 cells"), ("key", "solution 1 .* has 0 cells"), ("pixel", "20 of them different and 0 known"), ("twice", "1 of them different"), ("column", "a plan has the columns")):
        plans = FromCorner(spoil).repair(None, cells, wanted, 1)
        with pytest.raises(ValueError, match=f"FromCorner: .*{text}"):
            strategy.checked(plans, cells, wanted, "FromCorner")
    good = strategy.checked(FromCorner().repair(None, cells, wanted, 1), cells, wanted, "FromCorner")
    assert good.count() == 60
    with pytest.raises(TypeError, match="no sample and repair"):
        evolve._by_strategy(wanted, lambda row: "random")
