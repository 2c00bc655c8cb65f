"""Dominance, fronts, crowding and champions of objective vectors (all minimised).

Fronts of few points are compared in pairs.  Many points are sorted by all objectives, so that only an
earlier point can dominate a later one, and does if it is no worse in the objectives after the first.
Of the points before a range, then, only the front in those objectives matters, which is far smaller;
ranges learn it from each other in doubling steps, and each sweeps its own points once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from ..shipping import ship_package

_AT_ONCE = 4_000_000  # comparisons of one numpy step


def _dominates(names: list[str], x: str, y: str):
    none_worse = reduce(lambda a, b: a & b, (F.col(f"{x}.{n}") <= F.col(f"{y}.{n}") for n in names))
    one_better = reduce(lambda a, b: a | b, (F.col(f"{x}.{n}") < F.col(f"{y}.{n}") for n in names))
    return none_worse & one_better


def _undominated(points: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Points that no point with the same `by` dominates: all pairs of those, so they have to be few."""
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by]
    rivals = points.select(*by, *names).distinct()
    return points.alias("a").join(rivals.alias("b"), reduce(lambda p, q: p & q, same, _dominates(names, "b", "a")), "left_anti")


def _none_above(low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows have no vector of `low` at or below them in every column."""
    free = np.ones(len(rows), bool)
    if not len(low) or not len(rows):
        return free
    if rows.shape[1] == 1:
        return rows[:, 0] < low[:, 0].min()
    order = np.argsort(low[:, 0], kind="stable")
    low = low[order]
    upto = np.searchsorted(low[:, 0], rows[:, 0], side="right")  # vectors no higher in the first column
    if rows.shape[1] == 2:
        least = np.minimum.accumulate(low[:, 1])
        return (upto == 0) | (least[np.maximum(upto - 1, 0)] > rows[:, 1])
    step = max(1, _AT_ONCE // len(rows))
    for a in range(0, int(upto.max()), step):
        some = np.flatnonzero(free & (upto > a))
        part = low[a : a + step]
        hit = np.ones((len(some), len(part)), bool)
        for k in range(rows.shape[1]):
            hit &= part[None, :, k] <= rows[some, None, k]
        free[some[hit.any(axis=1)]] = False
    return free


def sweep(points: np.ndarray, rivals: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Which of distinct points, in ascending order of their columns, none dominates; and the front that later ones meet.

    `rivals` are the columns after the first of points before these; the front is kept in those columns.
    """
    keep = np.zeros(len(points), bool)
    for a in range(0, len(points), block):
        rest = points[a : a + block, 1:]
        alive = np.flatnonzero(_none_above(rivals, rest))
        new = rest[alive]
        below = np.tri(len(new), k=-1, dtype=bool)  # earlier ones
        for k in range(new.shape[1]):
            below &= new[None, :, k] <= new[:, None, k]
        alive, new = alive[~below.any(axis=1)], new[~below.any(axis=1)]
        keep[a + alive] = True
        new = new[front_mask(new)]
        rivals = np.concatenate([rivals[_none_above(new, rivals)], new])
    return keep, rivals


def front_mask(points: np.ndarray) -> np.ndarray:
    """The undominated among points; of equal ones the first."""
    if not points.shape[1]:
        return np.arange(len(points)) == 0
    first = np.unique(points, axis=0, return_index=True)[1]  # in ascending order
    mask = np.zeros(len(points), bool)
    if points.shape[1] == 1:
        mask[first[:1]] = True
    else:
        mask[first[sweep(points[first], points[:0, 1:])[0]]] = True
    return mask


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], axis=1).astype(float) if names else np.zeros((table.num_rows, 0))


def _front_by_ranges(points: DataFrame, names: list[str], keys: list[str], size: int, rows: int) -> DataFrame:
    """The front of distinct vectors of doubles, from ranges of about `rows` of them.

    A group is one range's points of one key, with the front of the points before it in all objectives
    but the first.  Only keys that reach over several ranges, no more than there are ranges, send fronts on.
    """
    ship_package(points.sparkSession)
    parts = max(2, -(-size // rows))
    ranged = points.repartitionByRange(parts, *keys, *names).sortWithinPartitions(*keys, *names).withColumn("__part", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    group, rest = [*keys, "__part"], names[1:]
    last = ranged.groupBy(*keys).agg(F.min("__part").alias("__first"), F.max("__part").alias("__last")).where("__first < __last")

    def lower(table: pa.Table) -> pa.Table:
        """Rows of one group to their front in the objectives after the first."""
        return table.filter(pa.array(front_mask(_columns(table, rest))))

    wide = ranged.join(F.broadcast(last), keys) if keys else ranged.crossJoin(F.broadcast(last))
    fields = [*group, "__last", *rest]
    kept = wide.select(*fields)
    fronts = stored(kept.groupBy(*group).applyInArrow(lower, kept.schema), "fronts")
    step = 1
    while step < parts:  # after a step a range knows the fronts of twice as many ranges
        onward = fronts.withColumn("__part", F.col("__part") + step).where("__part <= __last")
        fronts = stored(fronts.unionByName(onward).select(*fields).groupBy(*group).applyInArrow(lower, kept.schema), "fronts")
        step *= 2
    before = fronts.withColumn("__part", F.col("__part") + 1).where("__part <= __last").select(*group, F.lit(None).cast("double").alias(names[0]), *rest, F.lit(False).alias("__own"))
    every = ranged.select(*group, *names, F.lit(True).alias("__own")).unionByName(before)

    def survivors(table: pa.Table) -> pa.Table:
        own = table.column("__own").to_numpy()
        rivals = _columns(table.filter(pa.array(~own)), rest)
        mine = table.filter(pa.array(own)).sort_by([(n, "ascending") for n in names])
        return mine.filter(pa.array(sweep(_columns(mine, names), rivals)[0]))

    return every.groupBy(*group).applyInArrow(survivors, every.schema).select(*keys, *names)


def pareto_front(points: DataFrame, names: list[str], keys: tuple[str, ...] = (), block: int = 2000, range_rows: int = 50_000) -> DataFrame:
    """Points that no other point of their key dominates; equal points all stay, as do those without some objective.

    Points that are worse than a sum-minimal point of their key in every objective go first, by an
    aggregated filter.  More than two blocks of points are then thinned out in rounds: each block of
    about `block` points, dealt anew every round, keeps its own front, until a round removes few.  What
    is left is compared in pairs if it is few points, else swept in sorted ranges.  `points` is read
    several times, so it should be a written table.
    """
    total = reduce(lambda a, b: a + b, (F.col(n).cast("double") for n in names))
    best = points.groupBy(*keys).agg(F.min_by(F.struct(*names), total).alias("__best"))
    near = points.join(F.broadcast(best), list(keys)) if keys else points.crossJoin(F.broadcast(best))
    worse = reduce(lambda a, b: a & b, (F.col(n) > F.col(f"__best.{n}") for n in names))
    near = near.where(~F.coalesce(worse, F.lit(False))).drop("__best")
    size, before, turn = points.count(), None, 0
    while size > 2 * block and (before is None or size < 0.8 * before):
        deal = F.pmod(F.xxhash64(F.lit(turn), *names), F.lit(-(-size // block)))
        near = stored(_undominated(near.withColumn("__block", deal), names, [*keys, "__block"]).drop("__block"), "front")
        size, before, turn = near.count(), size, turn + 1
    if size <= 2 * block:
        return _undominated(near, names, list(keys))
    whole = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))
    # -0.0 is 0.0; NaN is the worst there is.
    code = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(float("inf"))), F.lit(0.0)) + F.lit(0.0) for n in names]
    coded = [f"__v{i}" for i in range(len(names))]
    held = near.withColumns(dict(zip(coded, code)))
    vectors = held.where(whole).select(*keys, *coded).distinct()
    front = _front_by_ranges(vectors, coded, list(keys), size, range_rows)
    return held.where(whole).join(front, [*keys, *coded], "left_semi").unionByName(held.where(~whole)).drop(*coded)


def ranked_fronts(points: DataFrame, names: list[str], most: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with their front number from 0, up to `most` fronts (populations: few rows)."""
    left, out = points, None
    ids = [*keys, "sol_id"]
    for rank in range(most):
        front = pareto_front(left, names, keys).withColumn("front", F.lit(rank))
        out = front if out is None else out.unionByName(front)
        left = left.join(front.select(*ids), ids, "left_anti")
    return out.unionByName(left.withColumn("front", F.lit(most)))


def _neighbours(points: DataFrame, name: str, keys: list[str], rows: int, size: int) -> DataFrame:
    """(keys, sol_id, __before, __after): the values of `name` next to each point's among its key's, by sorted ranges.

    A window holds one range; what the ends of ranges lack comes from a table of a row a range.
    """
    parts = max(2, -(-size // rows))
    order = [*keys, "__v", "sol_id"]
    held = points.select(*keys, "sol_id", F.col(name).cast("double").alias("__v")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    held = stored(held.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    cell = F.struct(*keys, "__v")
    ends = held.groupBy("__part").agg(F.min_by(cell, "__at").alias("__first"), F.max_by(cell, "__at").alias("__last"))
    line = Window.partitionBy(F.lit(0)).orderBy("__part")
    ends = ends.select("__part", F.lag("__last").over(line).alias("__left"), F.lead("__first").over(line).alias("__right"))
    within = Window.partitionBy("__part").orderBy("__at")
    held = held.withColumns({"__b": F.lag(cell).over(within), "__a": F.lead(cell).over(within)}).join(F.broadcast(ends), "__part")
    held = held.withColumns({"__b": F.coalesce("__b", "__left"), "__a": F.coalesce("__a", "__right")})
    same = lambda c: reduce(lambda a, b: a & b, (F.col(f"{c}.{k}").eqNullSafe(F.col(k)) for k in keys), F.lit(True))
    return held.select(*keys, "sol_id", F.when(same("__b"), F.col("__b.__v")).alias("__before"), F.when(same("__a"), F.col("__a.__v")).alias("__after"))


def crowding(points: DataFrame, names: list[str], keys: tuple[str, ...] = (), most: int = 100_000) -> DataFrame:
    """Crowding distance within a key: sum over objectives of the neighbours' distance, infinite at the ends.

    sol_id is unique within a key.  Up to `most` points go through windows of a key each; more are sorted in
    ranges, so that no task holds a key.  `points` is read several times, so it should be a written table.
    """
    size = points.count()
    if size > most:
        widths = points.groupBy(*keys).agg(*(F.max(n).cast("double").alias(f"__h_{n}") for n in names), *(F.min(n).cast("double").alias(f"__l_{n}") for n in names))
        total = None
        for n in names:
            near = _neighbours(points, n, list(keys), max(1, most // 2), size)
            near = (near.join(widths, list(keys)) if keys else near.crossJoin(F.broadcast(widths))).withColumn("__w", F.col(f"__h_{n}") - F.col(f"__l_{n}"))
            gap = F.col("__after") - F.col("__before")
            gap = F.when(gap.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(gap / F.when(F.col("__w") != 0, F.col("__w")), F.lit(0.0)))
            part = near.select(*keys, "sol_id", gap.alias("__d"))
            total = part if total is None else total.unionByName(part)
        return points.join(total.groupBy(*keys, "sol_id").agg(F.sum("__d").alias("crowding")), [*keys, "sol_id"])
    out, total = points, F.lit(0.0)
    for n in names:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(n, "sol_id")
        span = Window.partitionBy(*(keys or [F.lit(0)]))
        width = (F.max(n).over(span) - F.min(n).over(span)).cast("double")
        gap = (F.lead(n).over(w) - F.lag(n).over(w)).cast("double")
        out = out.withColumn(f"__d_{n}", F.when(gap.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(gap / F.when(width != 0, width), F.lit(0.0))))
        total = total + F.col(f"__d_{n}")
    return out.withColumn("crowding", total).drop(*(f"__d_{n}" for n in names))


def champions(points: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """The best solution of every objective, ties by sol_id; one row a champion with what it wins."""
    rows = points.groupBy(*keys).agg(F.array(*(F.struct(F.lit(n).alias("objective"), F.min_by("sol_id", F.struct(n, "sol_id")).alias("sol_id")) for n in names)).alias("__p"))
    rows = rows.select(*keys, F.explode("__p").alias("__p")).select(*keys, "__p.objective", "__p.sol_id")
    return rows.groupBy(*keys, "sol_id").agg(F.array_join(F.sort_array(F.collect_list("objective")), ",").alias("best_in"))


def best_solution(points: DataFrame, names: list[str], keys: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """The solution with the smallest sum of objectives in each key, ties by sol_id."""
    total = reduce(lambda a, b: a + b, (F.col(n).cast("double") for n in names))
    return points.withColumn("total", total).groupBy(*keys).agg(F.min_by(F.struct("sol_id", "total", *names), F.struct("total", "sol_id")).alias("b")).select(*keys, "b.*")
