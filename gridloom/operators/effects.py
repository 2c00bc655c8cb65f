"""Effects of restoring cells: direct form, gain form, repair scores and the objective experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import if_else, weight


def improved(anomaly: Column, effect: float | Column, shape: str | Column = "exponential", scale: float | Column = 1.0) -> Column:
    """Anomaly after restoration: raised by effect times weight."""
    effect = effect if isinstance(effect, Column) else F.lit(effect)
    return anomaly + effect * weight(anomaly, shape, scale)


def gain(anomaly: Column, effect: float | Column, shape: str | Column = "exponential", scale: float | Column = 1.0) -> Column:
    """1 if restoring the cell lifts it above 0, else 0."""
    return F.when((anomaly <= 0) & (improved(anomaly, effect, shape, scale) > 0), 1).otherwise(0)


def _of(value) -> Column:
    """A parameter: a number, or the name of a column that holds one."""
    return F.col(value) if isinstance(value, str) else F.lit(value)


def repair_scores(cells: DataFrame, effects: dict[str, float | str], cost: str, shape: str | Column = "exponential", scale: float | Column = 1.0, out: str = "score") -> DataFrame:
    """Sum of effect * weight over the layers that are there, less a millionth of the cost relative to its mean.

    Effects, shape and scale may be columns of `cells`.
    """
    total = F.lit(0.0)
    for layer, effect in effects.items():
        if layer in cells.columns:
            total = total + F.coalesce(_of(effect) * weight(F.col(layer), shape, scale), F.lit(0.0))
    mean = cells.agg(F.avg(cost).alias("__mean"))
    return cells.crossJoin(F.broadcast(mean)).withColumn(out, total - F.lit(1e-6) * F.col(cost) / (F.col("__mean") + F.lit(1e-12))).drop("__mean")


def restored(cells: DataFrame, decision: DataFrame, effects: dict[str, float], decay: float = 0.0, shape: str = "exponential", scale: float = 1.0) -> DataFrame:
    """Layers after restoration for every (scenario, solution) of the sparse decision: cells x solutions rows.

    Selected cells get the full effect; with a decay, eligible cells next to a selected one get that
    part of it.  Needs the column `eligible` in cells.
    """
    from .focal import ring

    keys = ["scenario_id", "sol_id"]
    solutions = decision.select(*keys).distinct()
    held = cells.crossJoin(F.broadcast(solutions)).join(decision.select(*keys, "pixel_id", F.lit(1.0).alias("__f")), [*keys, "pixel_id"], "left")
    factor = F.coalesce("__f", F.lit(0.0))
    if decay:
        near = ring(decision.join(cells.select("pixel_id", "row_idx", "col_idx"), "pixel_id"), tuple(keys)).withColumn("__r", F.lit(decay))
        held = held.join(near, [*keys, "row_idx", "col_idx"], "left")
        factor = F.coalesce("__f", "__r", F.lit(0.0))
    for layer, effect in effects.items():
        a = F.col(layer)
        held = held.withColumn(layer, F.when(F.col("eligible") & (factor > 0), improved(a, F.lit(effect) * factor, shape, scale)).otherwise(a))
    return held.withColumn("selected", F.col("__f").isNotNull()).drop("__f", "__r")


def objectives(cells: DataFrame, decision: DataFrame, effects: dict[str, float | str], cost: str | None = None, proximity: str | None = None, decay: float = 0.0, scope: str = "grid",
               shape: str | Column = "exponential", scale: float | Column = 1.0, settings: DataFrame | None = None, solutions: DataFrame | None = None, k: int | str | None = None) -> DataFrame:
    """Objective values of all solutions at once, in the gain form.

    A layer's objective is minus the number of its cells above 0: those that are so anyway plus the
    gains of selected cells (with a decay, of ring cells too).  One join of the sparse decision with
    the cells and one aggregation serve every solution.  Effects, shape, scale and k may be columns of
    `settings`, one row a scenario, so that every scenario is judged by its own parameters.

    Every solution of the decision has a row, also one whose cells are all ineligible; with `solutions`
    (scenario_id, sol_id) also those without any cell.  With k the constraint's value is added as
    `violation`: how far the number of selected cells is from k.
    """
    from .focal import ring

    keys = ["scenario_id", "sol_id"]
    with_settings = lambda df: df if settings is None else df.join(F.broadcast(settings), "scenario_id")
    counted = cells if scope == "grid" else cells.where("eligible")
    base = counted.agg(*(F.count_if(F.col(x) > 0).alias(f"__b_{x}") for x in effects))
    extra = [F.col(c).alias(f"__{n}") for n, c in (("cost", cost), ("prox", proximity)) if c]
    free = cells.where("eligible")
    hit = with_settings(decision.select(*keys, "pixel_id").join(free.select("pixel_id", *effects, *extra, F.lit(1).alias("__e")), "pixel_id", "left"))
    sums = [F.coalesce(F.sum(gain(F.col(x), _of(e), shape, scale)), F.lit(0)).alias(f"__g_{x}") for x, e in effects.items()]
    if cost:
        sums.append(F.coalesce(F.sum("__cost"), F.lit(0.0)).alias(cost))
    if proximity:
        sums.append(F.coalesce(F.avg("__prox"), F.lit(0.0)).alias(proximity))
    out = hit.groupBy(*keys).agg(*sums, F.count("__e").alias("n_selected"))
    if solutions is not None:
        out = solutions.select(*keys).join(out, keys, "left").fillna(0)
    if decay:
        near = ring(decision.join(cells.select("pixel_id", "row_idx", "col_idx"), "pixel_id"), tuple(keys))
        near = with_settings(near.join(free.select("row_idx", "col_idx", *effects), ["row_idx", "col_idx"]))
        ring_sum = near.groupBy(*keys).agg(*(F.sum(gain(F.col(x), _of(e) * F.lit(decay), shape, scale)).alias(f"__r_{x}") for x, e in effects.items()))
        out = out.join(ring_sum, keys, "left")
    out = out.crossJoin(F.broadcast(base))
    values = []
    for x in effects:
        total = F.col(f"__b_{x}") + F.col(f"__g_{x}")
        if decay:
            total = total + F.coalesce(F.col(f"__r_{x}"), F.lit(0))
        values.append((-total).cast("long").alias(x))
    if k is not None:
        out = with_settings(out) if isinstance(k, str) else out
        values.append(F.abs(F.col("n_selected") - _of(k)).cast("long").alias("violation"))
    return out.select(*keys, *values, *([cost] if cost else []), *([proximity] if proximity else []), "n_selected")


# --- experiments on decision layers: dv is 1, 0 or NULL (outside the decision area) -----------------


def set_to_good(cells: DataFrame, layers: list[str], na: str = "null") -> DataFrame:
    """By decision: drop of each layer's sum when selected cells become 0."""
    masked = [(F.coalesce(F.sum(x), F.lit(0.0)) - F.coalesce(F.sum(if_else(F.col("dv") == 1, F.lit(0.0), F.col(x), na)), F.lit(0.0))).alias(x) for x in layers]
    return cells.groupBy("dv_id").agg(*masked)


def proportion_above(cells: DataFrame, layers: list[str], target: int = 0, factor: float = 1.05, na: str = "null") -> DataFrame:
    """By decision: change of each layer's share of cells above 0 when target cells are raised by factor * |value|."""
    share = lambda c: F.avg((c > 0).cast("double"))
    return cells.groupBy("dv_id").agg(*((share(if_else(F.col("dv") == target, F.col(x) + F.lit(factor) * F.abs(x), F.col(x), na)) - share(F.col(x))).alias(x) for x in layers))


def spillover(cells: DataFrame, direct: list[str], spread: str, offsets: list[tuple[int, int]], target: int = 0, factor: float = 1.05, na: str = "null") -> DataFrame:
    """As proportion_above for `direct` layers; the `spread` layer is raised by the share of target cells around it."""
    from .focal import offset_sum

    held = offset_sum(cells.withColumn("__src", (F.col("dv") == target).cast("double")), "__src", offsets, "influence", ("dv_id",))
    share = lambda c: F.avg((c > 0).cast("double"))
    out = [(share(if_else(F.col("dv") == target, F.col(x) + F.lit(factor) * F.abs(x), F.col(x), na)) - share(F.col(x))).alias(x) for x in direct]
    raised = F.col(spread) + F.lit(factor) * F.col("influence") * F.abs(spread)
    return held.groupBy("dv_id").agg(*out, (share(raised) - share(F.col(spread))).alias(spread))
