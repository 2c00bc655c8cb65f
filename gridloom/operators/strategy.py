"""How a search samples and repairs plans: a protocol for strategies, the four that scenarios ask for, and its checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .selection import burdened, clustered, random_starts

KEYS = ["scenario_id", "sol_id"]


@runtime_checkable
class Strategy(Protocol):
    """Sampling and repair of plans, for all solutions of some scenarios at once.

    `cells` has scenario_id, pixel_id, row_idx, col_idx, region_id and score, the same cells for every one
    of the scenarios; `wanted` scenario_id, sol_id and k, a row a solution.  A plan is the rows
    (scenario_id, sol_id, pixel_id) of its chosen cells.

    `sample` gives first plans, of any number of cells, also none.  `repair` gives every solution of `wanted`
    exactly k different cells (all, if there are fewer) and nothing else.  Both depend on nothing but their
    inputs and the seed.  Equal strategies are asked once for all their scenarios, so they have to be hashable.
    """

    def sample(self, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame: ...

    def repair(self, plans: DataFrame, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame: ...


def _one_of(cells: DataFrame) -> DataFrame:
    """The cells once, without their scenarios."""
    any_one = cells.select("scenario_id").first()
    return cells.where(F.col("scenario_id") == (any_one[0] if any_one else None)).drop("scenario_id")


@dataclass(frozen=True)
class ByScore:
    """Bits at random; too many or too few are dropped or added by score.

    `most` is the number of cells, where it is known: few are ranked without being counted (see first_by).
    """

    most: int | None = field(default=None, compare=False)

    def sample(self, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
        from .evolve import skipped

        return skipped(_one_of(cells), wanted, 0.5, seed, "start")

    def repair(self, plans: DataFrame, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
        from .evolve import exact

        settings = wanted.groupBy("scenario_id").agg(F.max("k").alias("k"))
        return exact(plans, cells.select("scenario_id", "pixel_id", "score"), settings, "score", wanted, self.most)


@dataclass(frozen=True)
class Spread:
    """Shared among the regions by quotas, pulled together by smoothed density, or first one and then the other."""

    burden: bool
    strength: float
    most: int | None = field(default=None, compare=False)  # as in ByScore

    def sample(self, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
        return random_starts(_one_of(cells), wanted, F.col("k"), seed, tuple(KEYS), self.most)

    def repair(self, plans: DataFrame, cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
        cells = _one_of(cells)
        if self.burden:
            plans = stored(burdened(cells, plans, wanted, seed, tuple(KEYS), most=self.most), "plans")
        if self.strength > 0:
            plans = clustered(cells, plans, wanted, self.strength, F.col("sol_id"), tuple(KEYS), self.most)
        return plans.select(*KEYS, "pixel_id")


def of_scenario(scenario) -> Strategy:
    """The strategy that a scenario's spatial_clustering and burden_sharing ask for."""
    clustering, burden = float(scenario["spatial_clustering"]), scenario["burden_sharing"]
    if burden not in ("no", "yes"):
        raise ValueError(f"unknown burden sharing {burden!r}")
    return Spread(burden == "yes", clustering) if clustering > 0 or burden == "yes" else ByScore()


def checked(plans: DataFrame, cells: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The plans, if they keep a repair's contract; else an error that names the first solution that does not."""
    if sorted(plans.columns) != sorted([*KEYS, "pixel_id"]):
        raise ValueError(f"{name}: a plan has the columns {[*KEYS, 'pixel_id']}, not {plans.columns}")
    n = cells.groupBy("scenario_id").agg(F.count("*").alias("__all"))
    known = cells.select("scenario_id", "pixel_id", F.lit(1).alias("__known"))
    have = plans.join(known, ["scenario_id", "pixel_id"], "left").groupBy(*KEYS).agg(F.count("*").alias("__n"), F.countDistinct("pixel_id").alias("__different"), F.count("__known").alias("__known"))
    every = wanted.join(F.broadcast(n), "scenario_id").join(have, KEYS, "full")
    right = F.coalesce("__n", F.lit(0)) == F.least("k", "__all")
    bad = every.where(~F.coalesce(right & (F.coalesce("__different", F.lit(0)) == F.coalesce("__n", F.lit(0))) & (F.coalesce("__known", F.lit(0)) == F.coalesce("__n", F.lit(0))), F.lit(False)))
    first = bad.orderBy(*KEYS).first()
    if first is not None:
        raise ValueError(f"{name}: solution {first['sol_id']} of scenario {first['scenario_id']} has {first['__n'] or 0} cells, {first['__different'] or 0} of them different and {first['__known'] or 0} known, and wants {first['k']}")
    return plans.select(*KEYS, "pixel_id")
