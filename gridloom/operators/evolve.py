"""Evolutionary search over sparse decisions, for all scenarios at once.

A decision is the set of rows (scenario_id, sol_id, pixel_id).  Every operator carries the
scenario as a key, so one job advances all scenarios by a generation.  Randomness is portable.
"""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.util import inheritable_thread_target

from ..functions.draws import Texts
from ..functions.numeric import draw, uniform
from ..shared import stored
from ..shipping import ship_package
from .effects import objectives, repair_scores
from .pareto import pareto_front
from .selection import KNOWN, best_by, first_drawn
from .strategy import ByScore, Spread, Strategy, checked, of_scenario

KEYS = ["scenario_id", "sol_id"]
_STRATEGIES = 4  # whose jobs run side by side
_DRAWS = 65_536  # that a task makes at once


def initial(cells: DataFrame, scenarios: DataFrame, population: int, seed: int) -> DataFrame:
    """Candidate bits with p = 1/2 for every scenario and solution: rows that are 1."""
    held = cells.select("pixel_id").crossJoin(F.broadcast(numbered(scenarios, population)))
    return held.where(uniform(seed, F.col("scenario_id"), F.col("sol_id"), F.col("pixel_id")) < 0.5).select(*KEYS, "pixel_id")


def skipped(cells: DataFrame, solutions: DataFrame, p: float, seed: int | Column, tag: str = "skip", last: int | None = None) -> DataFrame:
    """Cells of every solution (KEYS) with probability p each, by seeded skips: KEYS and pixel_id.

    Pixel numbers are cut into stretches of about a thousand hits.  In each the number of pixels up to the
    next hit is geometric, floor(ln(1 - u) / ln(1 - p)), u being the draw's seeded number: draws are made for
    hits alone, not for cells, in numpy by some stretches at once.  Hits on numbers without a cell are dropped.  `last` is the greatest number, where known.
    """
    if not 0 <= p < 1:
        raise ValueError("p lies in [0, 1)")
    last = cells.agg(F.max("pixel_id")).first()[0] if last is None else last
    if last is None or p == 0:
        return solutions.select(*KEYS).crossJoin(cells.select("pixel_id").limit(0))
    length = stretch(p)
    mean = length * p
    draws = int(mean + 10 * (mean + 1) ** 0.5 + 30)  # more than a stretch can need
    ship_package(cells.sparkSession)
    runs, several = last // length + 1, max(1, _DRAWS // draws)
    blocks = cells.sparkSession.range(-(-runs // several)).select((F.col("id") * several).alias("__from"))
    seeds = F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), F.lit(tag), *map(F.col, KEYS))
    work = solutions.select(*KEYS, seeds.alias("__seed")).crossJoin(F.broadcast(blocks))
    work = work.repartition(max(1, min(8 * cells.sparkSession.sparkContext.defaultParallelism, blocks.count())), "__from", *KEYS)
    schema = StructType([*(solutions.schema[k] for k in KEYS), StructField("pixel_id", LongType())])
    kinds = [pa.int32() if f.dataType.simpleString() == "int" else pa.int64() for f in schema.fields[:2]]

    def hits(row: dict) -> pa.RecordBatch:
        line = np.arange(row["__from"], min(row["__from"] + several, runs))
        texts = Texts(pa.array(np.repeat(line, draws)), pa.array(np.tile(np.arange(draws), len(line))))
        u = texts.draws(row["__seed"]).reshape(len(line), draws) / 4294967296.0
        place = np.cumsum(np.floor(np.log(1 - u) / math.log(1 - p)).astype(np.int64) + 1, axis=1) - 1
        if (place[:, -1] < length).any():
            raise ValueError("a stretch has more hits than draws")
        found = (place + line[:, None] * length)[place < length]
        return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(found), row[k]), kind) for k, kind in zip(KEYS, kinds)), pa.array(found)], names=schema.names)

    def run(batches):
        for batch in batches:
            yield from map(hits, batch.to_pylist())

    return work.mapInArrow(run, schema).join(cells.select("pixel_id"), "pixel_id", "left_semi").select(*KEYS, "pixel_id")


def stretch(p: float) -> int:
    """Pixels of a stretch in which `skipped` draws: about a thousand hits."""
    return max(1, int(1000 / p))


def numbered(scenarios: DataFrame, population: int) -> DataFrame:
    """(scenario_id, sol_id) of every solution of a population."""
    return scenarios.select("scenario_id").distinct().withColumn("sol_id", F.explode(F.sequence(F.lit(0), F.lit(population - 1))))


def hux(parents: DataFrame, pairs: DataFrame, seed: int | Column, most: int | None = None) -> DataFrame:
    """Children of paired parents (scenario_id, child_id, mother, father): half of the differing cells are swapped.

    Each pair gives two children, 2 * child_id and 2 * child_id + 1; the swapped half of the
    symmetric difference is chosen by seeded order.  `most` is a bound on its cells, where known (see first_by).
    """
    child = ("scenario_id", "child_id")
    mother = pairs.join(parents.withColumnRenamed("sol_id", "mother"), ["scenario_id", "mother"]).select(*child, "pixel_id", F.lit(1).alias("m"))
    father = pairs.join(parents.withColumnRenamed("sol_id", "father"), ["scenario_id", "father"]).select(*child, "pixel_id", F.lit(1).alias("f"))
    both = stored(mother.join(father, [*child, "pixel_id"], "full").withColumns({"m": F.coalesce("m", F.lit(0)), "f": F.coalesce("f", F.lit(0))}), "parents")
    same = both.where("m = f")
    differ = both.where("m <> f")
    half = differ.groupBy(*child).agg(F.floor(F.count("*") / 2).alias("half"), F.count("*").alias("n"))  # a row a pair of parents
    half = half if most is not None and most <= KNOWN else stored(half, "sizes")
    sizes = half.select(*child, F.col("n").alias("__n"), F.col("half").alias("__need"))
    order = draw(seed, F.col("scenario_id"), F.col("child_id"), F.col("pixel_id"))
    swapped = first_drawn(differ.join(F.broadcast(half.drop("n")), list(child)), F.col("half"), order, child, flag="swap", most=most, sizes=sizes)
    first = swapped.where(F.when(F.col("swap"), F.col("f")).otherwise(F.col("m")) == 1).select("scenario_id", (F.col("child_id") * 2).alias("sol_id"), "pixel_id")
    second = swapped.where(F.when(F.col("swap"), F.col("m")).otherwise(F.col("f")) == 1).select("scenario_id", (F.col("child_id") * 2 + 1).alias("sol_id"), "pixel_id")
    kept = same.withColumn("sol_id", F.explode(F.array(F.col("child_id") * 2, F.col("child_id") * 2 + 1))).select("scenario_id", "sol_id", "pixel_id")
    return kept.unionByName(first).unionByName(second)


def bit_flip(decision: DataFrame, cells: DataFrame, seed: int, prob_bit: float, prob_ind: float = 1.0, skip: bool = False, last: int | None = None) -> DataFrame:
    """Flips bits of mutated solutions by seeded draws.

    With `skip` draws are made for flips alone (see skipped); else each cell of each mutated solution is
    drawn by its own number, in a filter without a shuffle.  Only flipped cells and the sparse decision are joined.
    """
    solutions = decision.select(*KEYS).distinct().where(uniform(seed, F.lit("ind"), *map(F.col, KEYS)) < prob_ind)
    flips = skipped(cells, solutions, prob_bit, seed, last=last) if skip else cells.select("pixel_id").crossJoin(F.broadcast(solutions)).where(uniform(seed, F.lit("bit"), *map(F.col, KEYS), F.col("pixel_id")) < prob_bit)
    both = decision.select(*KEYS, "pixel_id", F.lit(1).alias("x")).join(flips.withColumn("y", F.lit(1)), [*KEYS, "pixel_id"], "full")
    return both.where(F.coalesce("x", F.lit(0)) != F.coalesce("y", F.lit(0))).select(*KEYS, "pixel_id")


def exact(decision: DataFrame, cells: DataFrame, settings: DataFrame, score: str, solutions: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Repairs every solution to exactly its scenario's k cells, by score.

    `cells` has pixel_id and the score, by scenario if it has a scenario_id; `settings` scenario_id and k.
    The best k cells of a scenario are ranked once: a solution that is short of cells finds what it
    lacks among them, so only those and its own cells become rows, never the whole grid.  `most` is the
    number of cells, where known (see first_by).
    """
    settings = F.broadcast(settings.select("scenario_id", "k"))
    solutions = decision.select(*KEYS).distinct() if solutions is None else solutions.select(*KEYS)
    scored = cells.join(settings, "scenario_id") if "scenario_id" in cells.columns else cells.crossJoin(settings)
    top = best_by(scored, F.col("k"), score, ("scenario_id",), most=most).select("scenario_id", "pixel_id", score)
    top = top if most is not None and most <= KNOWN else stored(top, "best")
    spare = top.join(F.broadcast(solutions), "scenario_id").select(*KEYS, "pixel_id", F.lit(0).alias("x"), score)
    own = ["scenario_id", "pixel_id"] if "scenario_id" in cells.columns else ["pixel_id"]
    held = decision.select(*KEYS, "pixel_id", F.lit(1).alias("x")).join(cells.select(*own, score), own).select(*KEYS, "pixel_id", "x", score)
    held = held.unionByName(spare).groupBy(*KEYS, "pixel_id").agg(F.max("x").alias("x"), F.max(score).alias(score))
    held = stored(held.join(settings, "scenario_id"), "candidates")
    return best_by(held, F.col("k"), score, tuple(KEYS), chosen="x", most=most).select(*KEYS, "pixel_id")


def _by_strategy(settings: DataFrame, choose: Callable) -> dict[Strategy, list[int]]:
    """Scenarios by the strategy that is chosen for them; settings has a row a scenario."""
    groups: dict[Strategy, list[int]] = {}
    for row in settings.collect():
        found = choose(row)
        if not isinstance(found, Strategy):
            raise TypeError(f"{found!r} has no sample and repair")
        groups.setdefault(found, []).append(row["scenario_id"])
    return groups


def _for_each(settings: DataFrame, cells: DataFrame, solutions: DataFrame, choose: Callable, make: Callable, most: int | None = None) -> DataFrame:
    """What `make` gives for each strategy's cells and wanted solutions, together; the strategies' jobs run side by side.

    `most` is the number of cells, where known.
    """
    if "k" not in solutions.columns:
        solutions = wanted_of(solutions, settings)
    session = settings.sparkSession

    def part(strategy: Strategy, ids: list[int]) -> DataFrame:
        mine = lambda df: df.where(F.col("scenario_id").isin(ids))
        if isinstance(strategy, (ByScore, Spread)):
            strategy = replace(strategy, most=most)
        return stored(make(strategy, mine, mine(cells), mine(solutions)).select(*KEYS, "pixel_id"), "plans")

    groups = _by_strategy(settings, choose)
    with ThreadPoolExecutor(max(1, min(len(groups), _STRATEGIES))) as pool:
        parts = list(pool.map(inheritable_thread_target(session)(part), groups, groups.values()))
    return reduce(DataFrame.unionByName, parts)


def wanted_of(solutions: DataFrame, settings: DataFrame) -> DataFrame:
    """(scenario_id, sol_id, k) of every solution, written once."""
    return stored(solutions.join(F.broadcast(settings.select("scenario_id", "k")), "scenario_id").select(*KEYS, "k"), "wanted")


def repaired(decision: DataFrame, cells: DataFrame, settings: DataFrame, seed: int, solutions: DataFrame, choose: Callable = of_scenario, most: int | None = None) -> DataFrame:
    """Every solution brought to its scenario's k cells by its scenario's strategy; a strategy from outside is checked."""

    def one(strategy, mine, held, wanted):
        if isinstance(strategy, (ByScore, Spread)):
            return strategy.repair(mine(decision), held, wanted, seed)
        return checked(stored(strategy.repair(mine(decision), held, wanted, seed), "plans"), held, wanted, type(strategy).__name__)

    return _for_each(settings, cells, solutions, choose, one, most)


def starts(cells: DataFrame, settings: DataFrame, solutions: DataFrame, seed: int, choose: Callable = of_scenario, most: int | None = None) -> DataFrame:
    """Unrepaired first plans by each scenario's strategy."""
    return _for_each(settings, cells, solutions, choose, lambda strategy, mine, held, wanted: strategy.sample(held, wanted, seed), most)


def front_and_crowding(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Front number and crowding distance of every row of a population's objective matrix."""
    n = len(values)
    none_worse = (values[:, None, :] <= values[None, :, :]).all(axis=2)
    beats = none_worse & (values[:, None, :] < values[None, :, :]).any(axis=2)
    front, left, rank = np.full(n, -1), np.ones(n, bool), 0
    while left.any():
        now = left & ~beats[left].any(axis=0)
        front[now] = rank
        left &= ~now
        rank += 1
    distance = np.zeros(n)
    for f in range(rank):
        rows = np.flatnonzero(front == f)
        for column in values[rows].T:
            order = rows[np.argsort(column, kind="stable")]
            ordered = np.sort(column)
            distance[order[[0, -1]]] = np.inf
            if len(order) > 2 and ordered[-1] > ordered[0]:
                distance[order[1:-1]] += (ordered[2:] - ordered[:-2]) / (ordered[-1] - ordered[0])
    return front, distance


def survive(points: DataFrame, names: list[str], size: int) -> DataFrame:
    """The best `size` solutions of each scenario by front, then crowding (NSGA-II).

    A group is one scenario's parents and children, twice the population at most.
    """

    ship_package(points.sparkSession)

    def best(population: pd.DataFrame) -> pd.DataFrame:
        population = population.sort_values("sol_id", ignore_index=True)
        front, distance = front_and_crowding(population[names].to_numpy(float))
        kept = population.loc[np.lexsort((population["sol_id"], -distance, front))[:size], KEYS].copy()
        kept["place"] = np.arange(1, len(kept) + 1)
        return kept

    return points.select(*KEYS, *names).groupBy("scenario_id").applyInPandas(best, "scenario_id int, sol_id int, place int")


def progress_log(generations: int, say: Callable[[str], None] | None = None, clock: Callable[[], float] = time.monotonic) -> Callable[[int, DataFrame], None]:
    """A callback for `search` that says which generation has ended and how long the rest will take at that pace."""
    say = say or logging.getLogger(__name__).info
    began = clock()

    def told(generation: int, points: DataFrame) -> None:
        done, spent = generation + 1, clock() - began
        say(f"generation {done} of {generations}, {spent:.0f} s, about {spent / done * (generations - done):.0f} s left")

    return told


def settings_of(cells: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios with k, the number of cells that each restores: its fraction of the eligible ones, rounded down."""
    n = cells.where("eligible").count()
    return scenarios.withColumn("k", F.floor(F.col("max_restoration_fraction").cast("double") * F.lit(n)).cast("long"))


def search(cells: DataFrame, scenarios: DataFrame, effects: dict[str, float | str], cost: str, population: int = 8, generations: int = 3, seed: int = 42,
           prob_bit: float = 0.01, callback: Callable[[int, DataFrame], None] | None = None, strategy: Callable = of_scenario, evaluate: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(decision, objective) of the last population's first front, for every scenario, all in the same jobs.

    `cells` has pixel_id, row_idx, col_idx, region_id, eligible, the layers and the cost; `scenarios` the
    columns of scenario_grid, one row a scenario (broadcast).  A scenario's fraction gives its number of
    cells, its clustering and burden sharing its sampling and repair, its effects (columns that `effects`
    names by layer), weight shape and scale its scores and objectives.  Each generation's result is
    written to the shared folder, which cuts the lineage and survives the loss of an executor.
    `callback` is told each generation's number and objective values.

    `strategy` gives the Strategy of a scenario (a row of scenarios with its k), by default the one that its
    parameters ask for.  `evaluate` (plans, solutions, settings) may judge plans in other ways: a row a solution
    with scenario_id, sol_id, the objectives (all minimised) and violation, 0 for plans that are allowed.
    """
    names = [*effects, cost]
    settings = stored(settings_of(cells, scenarios), "settings")
    shape, scale = F.col("anomaly_weight_shape"), F.col("anomaly_weight_scale").cast("double")
    free = cells.where("eligible").select("pixel_id", "row_idx", "col_idx", "region_id", cost, *effects)
    scored = repair_scores(free.crossJoin(F.broadcast(settings)), effects, cost, shape, scale)
    scored = stored(scored.select("scenario_id", "pixel_id", "row_idx", "col_idx", "region_id", "score"), "scores")
    ids = free.select("pixel_id")
    everyone = wanted_of(numbered(settings, population), settings)
    n, last = ids.agg(F.count("*"), F.max("pixel_id")).first()

    def judged(plans: DataFrame, who: DataFrame) -> DataFrame:
        if evaluate is None:
            return objectives(cells, plans, effects, cost, shape=shape, scale=scale, settings=settings, solutions=who, k="k")
        points = evaluate(plans, who, settings)
        missing = [c for c in (*KEYS, "violation") if c not in points.columns]
        if missing or len(points.columns) <= len(KEYS) + 1:
            raise ValueError(f"an evaluation has {[*KEYS, 'violation']} and objectives, not {points.columns}")
        return points

    if evaluate is not None:
        names = [c for c in judged(ids.select(F.lit(0).alias("scenario_id"), F.lit(0).alias("sol_id"), "pixel_id").limit(0), everyone).columns if c not in (*KEYS, "violation")]
    decision = repaired(starts(scored, settings, everyone, seed, strategy, n), scored, settings, seed, everyone, strategy, n)
    known = stored(judged(decision, everyone), "points") if evaluate is None else None  # of the plans in `decision`
    for g in range(generations):
        half = population // 2
        order = uniform(seed + g, F.lit("mate"), *map(F.col, KEYS))
        place = F.row_number().over(Window.partitionBy("scenario_id").orderBy(order, "sol_id"))
        mates = everyone.withColumn("place", place)
        pairs = mates.where(F.col("place") <= half).select("scenario_id", (F.col("place") - 1).alias("child_id"), F.col("sol_id").alias("mother")).join(
            mates.where(F.col("place") > half).select("scenario_id", (F.col("place") - 1 - half).alias("child_id"), F.col("sol_id").alias("father")), ["scenario_id", "child_id"]
        )
        born = stored(hux(decision, pairs, seed + g, n), "children")
        young = stored(bit_flip(born, ids, seed + 1000 + g, prob_bit, skip=True, last=last), "young")
        children = repaired(young, scored, settings, seed + 2000 + g, everyone.where(F.col("sol_id") < 2 * half), strategy, n)
        children = children.withColumn("sol_id", F.col("sol_id") + population)
        every = decision.unionByName(children)
        if known is None:
            points = judged(every, numbered(settings, population + 2 * half))
        else:
            points = known.unionByName(judged(children, numbered(settings, population + 2 * half).where(F.col("sol_id") >= population)))
        points = stored(points, "points")
        best = stored(survive(points, names, population), "best")
        decision = stored(every.join(F.broadcast(best), KEYS).select("scenario_id", (F.col("place") - 1).cast("int").alias("sol_id"), "pixel_id"), "decision")
        if known is not None:
            known = points.join(F.broadcast(best), KEYS).withColumn("sol_id", (F.col("place") - 1).cast("int")).select(*points.columns)
        if callback:
            callback(g, points)
    points = stored(judged(decision, everyone), "points") if known is None else known
    front = pareto_front(points.where("violation = 0"), names, ("scenario_id",))
    return decision.join(F.broadcast(front.select(*KEYS)), KEYS, "left_semi"), front
