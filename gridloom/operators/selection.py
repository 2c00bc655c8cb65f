"""Selecting cells: portable random subsets, exact-count repair, quotas, clustering, decision layers.

Taking the first k cells of every key in some order never sorts a key's cells in one task.  A place
in [0, 1) that follows the order deals them into ranges, and ranges are counted.  Where the range of
the k-th cell holds too many, as with outliers or ties, it is split by the bits of the order's columns,
again and again, until few cells are left to rank.  What is then known of a key is the k-th cell; which
cells come before it is a filter.

Where the order is one of random draws, the k-th of n lies near k / n: one pass writes the cells up to a
little beyond that, and only the few on both sides of it are ranked.  Plans of the same cells draw them
together: a task takes a block of cells, and a cell becomes a row only in plans that may take it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.draws import Texts
from ..functions.numeric import draw, ordered_bits, uniform
from ..shared import stored
from ..shipping import ship_package
from .focal import smoothed_draws, square_mean, window_shares
from .quantiles import quantiles

RANGES = 256
RANKED = 10_000  # cells of a key that a window may rank
KNOWN = 1_000_000  # the same where the caller knows a bound, so that nothing has to be counted
_SPLIT = 1024
_PLANS = 16  # plans that are smoothed beside one copy of the cells
_BLOCK = 65_536  # cells that are drawn at once


def truncated(fraction: float, n: Column) -> Column:
    return F.floor(F.lit(fraction).cast("double") * n).cast("long")


def _code(cells: DataFrame, column) -> Column:
    """A long that rises with a column of numbers."""
    column = column if isinstance(column, Column) else F.col(column)
    kind = cells.select(column).schema[0].dataType.simpleString()
    return ordered_bits(column) if kind in ("double", "float") else column.cast("long")


def _with(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the facts of their key; facts have one row a key."""
    if keys:
        return rows.join(F.broadcast(facts), keys, how)
    return rows.join(F.broadcast(facts), F.lit(True), how) if how != "inner" else rows.crossJoin(F.broadcast(facts))


def _range_of_kth(sizes: DataFrame, keys: list[str], codes: list[str], extra: list[str]) -> DataFrame:
    """Of counted ranges (__at, __n, __need, least and greatest codes) the one that the k-th cell of each key lies in."""
    family = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("__n").over(family.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.withColumns({"__before": before, "__need": F.least(F.max("__need").over(family), F.sum("__n").over(family))})
    held = held.where("__need > __before and __need <= __before + __n").withColumn("__need", F.col("__need") - F.col("__before"))
    return held.select(*keys, *extra, "__n", "__need", *(f"{e}{c}" for c in codes for e in ("__lo", "__hi")))


def _inside(codes: list[str]) -> Column:
    """Whether a cell belongs to the range of its key."""
    return reduce(lambda a, b: a & b, (F.col(c).between(F.col(f"__lo{c}"), F.col(f"__hi{c}")) for c in codes), F.col("__b") == F.col("__bin"))


def _told(state: DataFrame, condition: Column) -> tuple[DataFrame, bool]:
    """A written copy, and whether any of its rows meets a condition; both from one job."""
    seen = Observation()
    copy = stored(state.observe(seen, F.count_if(condition).alias("n")), "ranges")
    return copy, bool(seen.get["n"])


def kth_cells(held: DataFrame, keys: list[str], codes: list[str], ranked: int = RANKED) -> DataFrame:
    """(keys, __bin, codes of the k-th cell) of rows with __b, the range of their place, __need and codes.

    __bin is the k-th cell's range of places; where a whole range is taken, the codes are its greatest ones.
    """
    facts = lambda: [F.count("*").alias("__n"), F.max("__need").alias("__need"), *(f(c).alias(f"{e}{c}") for c in codes for e, f in (("__lo", F.min), ("__hi", F.max)))]
    sizes = held.groupBy(*keys, F.col("__b").alias("__at")).agg(*facts())
    state = _range_of_kth(sizes.withColumn("__bin", F.col("__at")), keys, codes, ["__bin"])
    state = state.withColumn("__whole", F.col("__need") == F.col("__n"))
    differ = reduce(lambda a, b: a | b, (F.col(f"__lo{c}") < F.col(f"__hi{c}") for c in codes))
    large = (F.col("__n") > ranked) & (F.col("__need") < F.col("__n")) & differ
    state, any_large = _told(state, large)
    while any_large:
        # The first column that tells cells of the range apart, and how many of its low bits may be left out.
        first = lambda e: F.coalesce(*(F.when(F.col(f"__lo{c}") < F.col(f"__hi{c}"), F.col(f"{e}{c}") if e else F.col(c)) for c in codes))
        wide = state.where(large).withColumns({"__l": first("__lo"), "__h": first("__hi")})
        wide = wide.withColumn("__shift", F.expr(f"element_at(filter(sequence(0, 62), s -> coalesce(try_subtract(shiftright(__h, s), shiftright(__l, s)) < {_SPLIT}, false)), 1)"))
        rows = _with(held.drop("__need"), wide.drop("__n"), keys).where(_inside(codes)).withColumn("__at", first(""))
        rows = rows.withColumn("__at", F.expr("shiftright(__at, __shift) - shiftright(__l, __shift)"))
        sizes = rows.groupBy(*keys, "__at", "__bin").agg(*facts())
        split = _range_of_kth(sizes, keys, codes, ["__bin"]).withColumn("__whole", F.lit(False))
        state, any_large = _told(state.where(~large).unionByName(split), large)
    most = F.lit(2**63 - 1)
    done = state.where("__need = __n").select(*keys, "__bin", *(F.when(F.col("__whole"), most).otherwise(F.col(f"__hi{c}")).alias(f"__k{c}") for c in codes))
    part = _with(held.drop("__need"), state.where("__need < __n").drop("__n"), keys).where(_inside(codes))
    rank = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*codes))
    part = part.withColumn("__rank", rank).where("__rank = __need").select(*keys, "__bin", *(F.col(c).alias(f"__k{c}") for c in codes))
    return done.unionByName(part)


def _few(most: int | None) -> bool:
    """Whether no key has more cells, by a bound that the caller knows, than a window may rank."""
    return most is not None and most <= KNOWN


def first_by(cells: DataFrame, k: int | Column, place: Column, order: list, keys: tuple[str, ...] = (), ranges: int = RANGES, flag: str | None = None, ranked: int = RANKED, most: int | None = None) -> DataFrame:
    """The first k cells of each key in ascending `order`; `place` in [0, 1) never falls along that order.

    `order` holds numbers, without NULLs, that together tell a key's cells apart.  With `flag` all cells, and
    in that column whether a cell is one of those.  What is broadcast has one row a key (a solution, a
    region of a solution).  `cells` are read two or three times.  Keys of no more than `ranked` cells each are
    ranked as they are; so are keys of no more than KNOWN cells, without any job, if `most`, a bound of the caller's, says so.
    With a larger bound keys are taken as large without being counted.
    """
    keys_, codes = list(keys), [f"__c{i}" for i in range(len(order))]
    if _few(most) or (most is None and (cells.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0) <= ranked):
        line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        taken = F.row_number().over(line) <= (k if isinstance(k, Column) else F.lit(k))
        return cells.withColumn(flag, taken) if flag else cells.withColumn("__taken", taken).where("__taken").drop("__taken")
    at = F.least(F.floor(place * ranges), F.lit(ranges - 1)).cast("int")
    need = F.greatest((k if isinstance(k, Column) else F.lit(k)).cast("long"), F.lit(0).cast("long"))
    held = cells.withColumns({"__need": need, "__b": at, **{c: _code(cells, o) for c, o in zip(codes, order)}})
    cut = kth_cells(held.select(*keys_, "__need", "__b", *codes), keys_, codes, ranked)
    upto = F.lit(True)
    for c in reversed(codes):
        upto = (F.col(c) < F.col(f"__k{c}")) | ((F.col(c) == F.col(f"__k{c}")) & upto)
    taken = (F.col("__b") < F.col("__bin")) | ((F.col("__b") == F.col("__bin")) & upto)
    held = _with(held, cut, keys_, "left" if flag else "inner")
    held = held.withColumn(flag, F.coalesce(taken, F.lit(False))) if flag else held.where(taken)
    return held.drop("__need", "__b", "__bin", *codes, *(f"__k{c}" for c in codes))


def first_drawn(cells: DataFrame, k: int | Column, drawn: Column, keys: tuple[str, ...] = (), flag: str | None = None, ranked: int = RANKED, most: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """The k cells of each key with the smallest draws (see numeric.draw), ties by pixel_id; with `flag` all cells, see first_by.

    Draws are even, so the k-th of n lies within a few standard deviations of k / n: cells up to there are written
    in one pass, and those around it ranked.  Draws that are not even (as of cells that are there many times) show in
    the counts and go to first_by.  `cells` are read twice: to be counted, and to be drawn; with `most` see first_by.
    A caller that knows them gives `sizes`, the keys with their cells (__n) and k (__need), which saves the count.
    """
    keys_ = list(keys)
    if _few(most):
        return first_by(cells.withColumn("__d", drawn), k, F.lit(0.0), ["__d", "pixel_id"], keys, flag=flag, most=most).drop("__d")
    need = F.greatest((k if isinstance(k, Column) else F.lit(k)).cast("long"), F.lit(0).cast("long"))
    if sizes is None:
        sizes = cells.withColumn("__need", need).groupBy(*keys).agg(F.count("*").alias("__n"), F.max("__need").alias("__need"))
    sizes = stored(sizes.select(*keys, "__n", F.least("__need", "__n").alias("__need")), "sizes")
    held = cells.withColumn("__d", drawn)
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= ranked:
        return first_by(held, k, F.lit(0.0), ["__d", "pixel_id"], keys, flag=flag, ranked=ranked).drop("__d")
    wanted = _bounds(sizes).where("__need > 0")
    near = held if flag else _with(held, wanted.select(*keys, "__high"), keys_).where("__d <= __high").drop("__high")
    near = stored(near, "draws")
    last = _last_drawn(near, wanted, keys_)
    if last is None:
        return first_by(stored(held, "draws"), k, F.col("__d") / F.lit(2.0**32), ["__d", "pixel_id"], keys, flag=flag, ranked=ranked).drop("__d")
    taken = (F.col("__d") < F.col("__kd")) | ((F.col("__d") == F.col("__kd")) & (F.col("pixel_id") <= F.col("__kp")))
    out = _with(near, last, keys_, "left" if flag else "inner")
    out = out.withColumn(flag, F.coalesce(taken, F.lit(False))) if flag else out.where(taken)
    return out.drop("__d", "__kd", "__kp")


def _bounds(sizes: DataFrame) -> DataFrame:
    """Adds the draws, __low and __high, between which the __need-th of __n draws lies."""
    spread = 6 * F.sqrt(F.col("__need") * (1 - F.col("__need") / F.col("__n"))) + 20
    at = lambda place: F.greatest(F.least(place / F.col("__n"), F.lit(1.0)), F.lit(0.0)) * F.lit(2.0**32)
    return sizes.withColumns({"__low": F.floor(at(F.col("__need") - spread)), "__high": F.ceil(at(F.col("__need") + spread))})


def _last_drawn(near: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, __kd, __kp): draw and number of the __need-th cell of each key, from written draws; None if bounds do not hold it."""
    found = _with(near.select(*keys, "__d"), wanted.select(*keys, "__low", "__high"), keys)
    found = found.groupBy(*keys).agg(F.count_if(F.col("__d") < F.col("__low")).alias("__below"), F.count_if(F.col("__d") <= F.col("__high")).alias("__upto"))
    found = wanted.join(F.broadcast(found), keys, "left") if keys else wanted.crossJoin(F.broadcast(found))
    state, uneven = _told(found.fillna(0, ["__below", "__upto"]), ~F.col("__need").between(F.col("__below") + 1, F.col("__upto")))
    if uneven:
        return None
    around = _with(near.select(*keys, "__d", "pixel_id"), state.select(*keys, "__low", "__high", (F.col("__need") - F.col("__below")).alias("__need")), keys)
    around = around.where("__d between __low and __high")
    around = around.withColumn("__rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__d", "pixel_id")))
    return stored(around.where("__rank = __need").select(*keys, F.col("__d").alias("__kd"), F.col("pixel_id").alias("__kp")), "last")


def _by_blocks(cells: DataFrame, drawn, schema: StructType) -> DataFrame:
    """What `drawn` gives for every block of a task's cells."""

    def run(batches):
        block, size = [], 0
        for batch in batches:
            block, size = [*block, batch], size + batch.num_rows
            if size >= _BLOCK:
                yield drawn(pa.Table.from_batches(block))
                block, size = [], 0
        if size:
            yield drawn(pa.Table.from_batches(block))

    return cells.mapInArrow(run, schema)


def _low_draws(cells: DataFrame, solutions: DataFrame) -> DataFrame:
    """(sol_id, columns of cells, __d) of the cells whose draw, seeded by a solution's number, is no more than their __high."""
    ship_package(cells.sparkSession)
    ids = [r[0] for r in solutions.select("sol_id").collect()]  # a number a solution
    schema = StructType([solutions.schema["sol_id"], *(f for f in cells.schema if f.name != "__high"), StructField("__d", LongType())])
    kept = schema.names[1:-1]
    kind = pa.int32() if schema["sol_id"].dataType.simpleString() == "int" else pa.int64()

    def drawn(cells: pa.Table) -> pa.RecordBatch:
        texts, high = Texts(cells.column("pixel_id").combine_chunks()), cells.column("__high").to_numpy()
        rows, draws = [], []
        for i in ids:
            d = texts.draws(str(i))
            rows.append(np.flatnonzero(d <= high))
            draws.append(d[rows[-1]])
        held = cells.select(kept).take(pa.array(np.concatenate(rows))).combine_chunks()
        who = pa.array(np.repeat(ids, [len(r) for r in rows]), kind)
        return pa.RecordBatch.from_arrays([who, *(held.column(c).combine_chunks() for c in kept), pa.array(np.concatenate(draws))], names=schema.names)

    return _by_blocks(cells, drawn, schema) if ids else cells.sparkSession.createDataFrame([], schema)


def _seeded_draws(cells: DataFrame, wanted: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = (), tail: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """(keys, by, pixel_id, __d) of the cells whose draw is no more than their plan's __high.

    `wanted` has a row a plan (and value of `by`, a column of the cells at most): keys, __seed and __high.  A draw is
    that of the text __seed with the numbers in `tail` behind it.
    """
    ship_package(cells.sparkSession)
    plans: dict[tuple, tuple[str, list]] = {}
    for row in wanted.select(*keys, *by, "__seed", "__high").collect():  # a row a plan and region
        plans.setdefault(tuple(row[k] for k in keys), (row["__seed"], []))[1].append((row[by[0]] if by else None, row["__high"]))
    schema = StructType([*(wanted.schema[k] for k in keys), *(cells.schema[c] for c in by), cells.schema["pixel_id"], StructField("__d", LongType())])
    kinds = [pa.int32() if f.dataType.simpleString() == "int" else pa.int64() for f in schema.fields[: len(keys)]]
    kept = [*by, "pixel_id"]

    def drawn(cells: pa.Table) -> pa.RecordBatch:
        texts = Texts(*(cells.column(c).combine_chunks() for c in tail))
        rows, draws = [], []
        for seed, highs in plans.values():
            if by:
                at = pc.index_in(cells.column(by[0]).combine_chunks(), pa.array([v for v, _ in highs], cells.schema.field(by[0]).type))
                high = np.array([h for _, h in highs] + [-1.0])[at.fill_null(len(highs)).to_numpy(zero_copy_only=False)]
            else:
                high = highs[0][1]
            d = texts.draws(seed)
            rows.append(np.flatnonzero(d <= high))
            draws.append(d[rows[-1]])
        held = cells.select(kept).take(pa.array(np.concatenate(rows))).combine_chunks()
        counts = [len(r) for r in rows]
        who = [pa.array(np.repeat(np.array([p[i] for p in plans], np.int64), counts), kind) for i, kind in enumerate(kinds)]
        out = [*who, *(held.column(c).combine_chunks() for c in kept), pa.array(np.concatenate(draws))]
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    if not plans:
        return cells.sparkSession.createDataFrame([], schema)
    return _by_blocks(cells.select("pixel_id", *by), drawn, schema)


def random_plans(cells: DataFrame, solutions: DataFrame, k: int | Column, by: tuple[str, ...] = (), ranked: int = RANKED) -> DataFrame:
    """(sol_id, by, pixel_id): for every solution k cells, of each `by` if given, with the smallest draws seeded by sol_id.

    Same as random_subset over all cells of every solution, for solutions few enough that each task goes
    through them.  k may be a column of the cells.  Cells are read twice: to be counted, and to be drawn.
    """
    keys = ["sol_id", *by]
    need = F.greatest((k if isinstance(k, Column) else F.lit(k)).cast("long"), F.lit(0).cast("long"))
    sizes = cells.withColumn("__need", need).groupBy(*by).agg(F.count("*").alias("__n"), F.max("__need").alias("__need"))
    sizes = stored(sizes.withColumn("__need", F.least("__need", "__n")), "sizes")
    if (sizes.agg(F.max("__n")).first()[0] or 0) > ranked:
        wanted = _bounds(sizes).where("__need > 0")
        near = _low_draws(_with(cells.select("pixel_id", *by), wanted.select(*by, "__high"), list(by)), solutions)
        near = stored(near, "draws")
        last = _last_drawn(near, wanted.crossJoin(F.broadcast(solutions.select("sol_id"))), keys)
        if last is not None:
            out = _with(near, last, keys).where("__d < __kd or (__d = __kd and pixel_id <= __kp)")
            return out.select(*keys, "pixel_id")
    every = cells.withColumn("__k", need).select("pixel_id", *by, "__k").crossJoin(F.broadcast(solutions.select("sol_id")))
    return random_subset(every, F.col("__k"), F.col("sol_id"), tuple(keys), ranked).select(*keys, "pixel_id")


def random_subset(cells: DataFrame, k: int | Column, seed: int | Column, keys: tuple[str, ...] = (), ranked: int = RANKED, most: int | None = None) -> DataFrame:
    """k cells of each key with the smallest seeded random numbers."""
    return first_drawn(cells, k, draw(seed, F.col("pixel_id")), keys, ranked=ranked, most=most)


def best_by(cells: DataFrame, k: int | Column, score: str, keys: tuple[str, ...] = (), ranges: int = RANGES, chosen: str | None = None, most: int | None = None) -> DataFrame:
    """k cells of each key: those with `chosen` = 1 first (if given), then by score from the highest; ties by pixel_id.

    A missing score counts as the lowest.  With `most` see first_by.
    """
    if _few(most):
        lowest = F.broadcast(cells.agg(F.min(score).cast("double").alias("__low")))
        held = cells.crossJoin(lowest).withColumn("__s", F.coalesce(F.col(score).cast("double"), F.col("__low"), F.lit(0.0))).drop("__low")
        order = [*([1 - F.col(chosen)] if chosen else []), -F.col("__s"), F.col("pixel_id")]
        return first_by(held, k, F.lit(0.0), order, keys, most=most).drop("__s")
    low, high = cells.agg(F.min(score).cast("double"), F.max(score).cast("double")).first()
    held = cells.withColumn("__s", F.coalesce(F.col(score).cast("double"), F.lit(low), F.lit(0.0)))
    wide = None if low is None or not high > low else high - low
    depth = F.least((F.lit(high) - F.col("__s")) / F.lit(wide), F.lit(1.0)) if wide else F.lit(0.0)
    order = [-F.col("__s"), F.col("pixel_id")]
    if chosen:
        depth, order = (depth + 1 - F.col(chosen)) / 2, [1 - F.col(chosen), *order]
    return first_by(held, k, depth, order, keys, ranges).drop("__s")


def repair(candidates: DataFrame, k: int | Column, score: str, keys: tuple[str, ...] = ("sol_id",)) -> DataFrame:
    """Exactly k cells a solution: the chosen ones (x = 1) with the best scores, filled up by the best others."""
    return best_by(candidates, k, score, keys, chosen="x")


def random_repair(candidates: DataFrame, k: int | Column, seed: int | Column, keys: tuple[str, ...] = ("sol_id",), most: int | None = None) -> DataFrame:
    """Exactly k cells a solution by random draws: of too many chosen (x = 1) some are dropped, of too few others are added."""
    k = (k if isinstance(k, Column) else F.lit(k)).cast("long")
    ones = F.sum(F.col("x").cast("long"))
    sizes = candidates.groupBy(*keys).agg(ones.alias("__ones"), F.max(k).alias("__k"))
    sizes = sizes.select(*keys, F.least("__k", "__ones").alias("__keep"), F.greatest(F.col("__k") - F.col("__ones"), F.lit(0)).alias("__add"))
    sizes = sizes if _few(most) else stored(sizes, "sizes")
    need = F.when(F.col("x") == 1, F.col("__keep")).otherwise(F.col("__add"))
    held = _with(candidates, sizes, list(keys)).withColumn("__share", need).drop("__keep", "__add")
    return first_drawn(held, F.col("__share"), draw(seed, *map(F.col, keys), F.col("pixel_id")), (*keys, "x"), most=most).select(*candidates.columns)


def quotas(regions: DataFrame, k: int | Column, mode: str = "equal", keys: tuple[str, ...] = ()) -> DataFrame:
    """Quota of each region (region_id, n): equal or proportional, capped by size, the remainder by region id.

    With keys, every key has the regions of its own, and k may be one of its columns.  One row a region
    (and key): windows are over that table, never over cells.
    """
    k = (k if isinstance(k, Column) else F.lit(k)).cast("long")
    family = Window.partitionBy(*(keys or [F.lit(0)]))
    held = regions.withColumns({"__k": k, "__m": F.count("*").over(family), "__t": F.sum("n").over(family)})
    first = F.floor(F.col("__k") / F.col("__m")) if mode == "equal" else F.floor(F.col("__k").cast("double") * F.col("n") / F.col("__t"))
    held = held.withColumn("__q", F.least(first.cast("long"), F.col("n")))
    order = family.orderBy("region_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce(F.sum(F.col("n") - F.col("__q")).over(order), F.lit(0))
    left = F.col("__k") - F.sum("__q").over(family)
    quota = F.col("__q") + F.greatest(F.lit(0), F.least(F.col("n") - F.col("__q"), left - room))
    return held.withColumn("quota", quota.cast("long")).select(*keys, "region_id", "n", "quota")


def burden_share(cells: DataFrame, k: int, seed: int, mode: str = "equal") -> DataFrame:
    """Cells (with region_id) chosen at random within each region's quota."""
    sizes = quotas(cells.groupBy("region_id").agg(F.count("*").alias("n")), k, mode).select("region_id", "quota")
    held = cells.join(F.broadcast(sizes), "region_id")
    return random_subset(held, F.col("quota"), seed, ("region_id",)).drop("quota")


def burden_repair(candidates: DataFrame, k: int | Column, seed: int | Column, keys: tuple[str, ...] = ("sol_id",), mode: str = "equal") -> DataFrame:
    """Exactly k cells a solution, each region (region_id) within its quota: its chosen cells (x = 1) first, both kinds at random.

    k may be a column of the candidates; the table of quotas that is broadcast has a row a region and key.
    """
    k = k if isinstance(k, Column) else F.lit(k)
    sizes = candidates.groupBy(*keys, "region_id").agg(F.count("*").alias("n"), F.max(k).alias("__w"))
    sizes = quotas(sizes, F.col("__w"), mode, keys).select(*keys, "region_id", "quota")
    held = candidates.join(F.broadcast(sizes), [*keys, "region_id"])
    return random_repair(held, F.col("quota"), seed, (*keys, "region_id")).drop("quota")


def burden_plans(cells: DataFrame, solutions: DataFrame, k: int, mode: str = "equal") -> DataFrame:
    """(sol_id, pixel_id) of k cells for every solution, each within the regions' quotas."""
    sizes = quotas(cells.groupBy("region_id").agg(F.count("*").alias("n")), k, mode).select("region_id", "quota")
    held = cells.select("pixel_id", "region_id").join(F.broadcast(sizes), "region_id")
    return random_plans(held, solutions, F.col("quota"), ("region_id",)).select("sol_id", "pixel_id")


def random_starts(cells: DataFrame, solutions: DataFrame, k: int | Column, seed: int, keys: tuple[str, ...] = ("sol_id",), most: int | None = None) -> DataFrame:
    """(keys, pixel_id) of a random number of cells, 0 to k, for every solution; one of 0 cells has no rows.

    k may be a column of the solutions.
    """
    names = list(map(F.col, keys))
    k = k if isinstance(k, Column) else F.lit(k)
    count = F.floor(uniform(seed, F.lit("start"), *names) * (k + 1)).cast("long")
    wanted = solutions.select(*keys, count.alias("__c"), F.concat_ws(":", F.lit(seed), *names).alias("__seed"))
    n = 0 if _few(most) else cells.count()
    if n > RANKED:
        bounds = stored(_bounds(wanted.select(*keys, "__seed", F.lit(n).cast("long").alias("__n"), F.least("__c", F.lit(n)).alias("__need"))).where("__need > 0"), "sizes")
        near = stored(_seeded_draws(cells, bounds, keys), "draws")
        last = _last_drawn(near, bounds.drop("__seed"), list(keys))
        if last is not None:
            return _with(near, last, list(keys)).where("__d < __kd or (__d = __kd and pixel_id <= __kp)").select(*keys, "pixel_id")
    held = cells.select("pixel_id").crossJoin(F.broadcast(wanted))
    return random_subset(held, F.col("__c"), F.col("__seed"), keys, most=most).select(*keys, "pixel_id")


def dense(cells: DataFrame, plans: DataFrame, solutions: DataFrame, keys: tuple[str, ...] = ("sol_id",)) -> DataFrame:
    """All cells of every solution with x, 1 for those of its plan."""
    held = cells.crossJoin(F.broadcast(solutions)).join(plans.select(*keys, "pixel_id", F.lit(1).alias("x")), [*keys, "pixel_id"], "left")
    return held.withColumn("x", F.coalesce("x", F.lit(0)))


def smoothed_score(held: DataFrame, value: str, strength: float, seed: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds __s: the density of `value` in the window of a clustering strength, and a small seeded noise for ties."""
    size = window_of(strength)
    held = held.withColumn("__f", F.col(value).cast("double")) if size is None else square_mean(held, value, size, "__f", keys, whole=False)
    return held.withColumn("__s", F.floor(F.col("__f") * 1e6 + 0.5) + uniform(seed, F.col("pixel_id"))).drop("__f")


def clustering_repair(candidates: DataFrame, k: int | Column, strength: float, keys: tuple[str, ...] = ("sol_id",)) -> DataFrame:
    """Exactly k cells a solution by the smoothed density of its chosen ones (x = 1)."""
    held = stored(smoothed_score(candidates, "x", strength, F.col(keys[-1]), keys), "scored")  # read several times
    return best_by(held, k, "__s", keys).drop("__s")


def clustered(cells: DataFrame, plans: DataFrame, wanted: DataFrame, strength: float, seed: Column, keys: tuple[str, ...] = ("sol_id",), most: int | None = None) -> DataFrame:
    """(keys, pixel_id): every plan pulled together to its k cells by the smoothed density of its own cells.

    `wanted` has the keys and k, a row a solution; `cells` pixel_id, row_idx and col_idx.  Same as
    clustering_repair over all cells of every solution, but only cells with a chosen one in their window become
    rows; a solution that has fewer of them than k also draws from the others, which all have density 0.
    Densities are counted first (a million levels at most), so that noise is drawn only for cells as dense as the k-th.
    """
    size, keys_ = window_of(strength), list(keys)
    own = plans.select(*keys, "pixel_id").join(cells.select("pixel_id", "row_idx", "col_idx"), "pixel_id")
    if size is None:
        near = own.select(*keys, "pixel_id", F.lit(1.0).alias("__f"))
    else:
        near = window_shares(cells, own, size, keys, -(-wanted.count() // _PLANS)).select(*keys, "pixel_id", F.col("share").alias("__f"))
    near = stored(near.withColumn("__f", F.floor(F.col("__f") * 1e6 + 0.5)), "dense")
    found = near.groupBy(*keys).agg(F.count("*").alias("__n"))
    short = wanted.join(found, keys_, "left").where(F.coalesce("__n", F.lit(0)) < F.col("k")).select(*keys)
    if not short.isEmpty():
        others = cells.select("pixel_id").crossJoin(F.broadcast(short)).join(near.select(*keys, "pixel_id"), [*keys_, "pixel_id"], "left_anti")
        others = others.select(*keys, "pixel_id", F.lit(0).cast("long").alias("__f"))
        near = near.unionByName(others if _few(most) else stored(others, "dense"))
    if _few(most):
        scored = near.join(F.broadcast(wanted.select(*keys, "k")), keys_).withColumn("__s", F.col("__f") + uniform(seed, F.col("pixel_id")))
        return first_by(scored, F.col("k"), F.lit(0.0), [-F.col("__s"), F.col("pixel_id")], keys, most=most).select(*keys, "pixel_id")
    line = Window.partitionBy(*keys)
    levels = near.groupBy(*keys, "__f").agg(F.count("*").alias("__n")).join(F.broadcast(wanted.select(*keys, "k")), keys_)
    levels = levels.withColumns({"__upto": F.sum("__n").over(line.orderBy(F.desc("__f"))), "__all": F.sum("__n").over(line)})
    levels = levels.withColumn("__need", F.least("k", "__all") - F.col("__upto") + F.col("__n")).where("__need between 1 and __n")
    cut = stored(levels.select(*keys, F.col("__f").alias("__cut"), "__n", "__need"), "cuts")
    held = _with(near, cut.select(*keys, "__cut", "__need"), keys_)
    last = first_drawn(held.where("__f = __cut"), F.col("__need"), F.lit(2**32 - 1) - draw(seed, F.col("pixel_id")), keys, sizes=cut)
    return held.where("__f > __cut").select(*keys, "pixel_id").unionByName(last.select(*keys, "pixel_id"))


def burdened(cells: DataFrame, plans: DataFrame, wanted: DataFrame, seed: int | Column, keys: tuple[str, ...] = ("sol_id",), mode: str = "equal", most: int | None = None) -> DataFrame:
    """(keys, pixel_id): every plan brought to its k cells within the regions' quotas, at random.

    Same as burden_repair over all cells of every solution, but cells that are not chosen become rows only in
    regions where a plan has fewer than its quota.  `cells` has pixel_id and region_id, `wanted` the keys and k.
    """
    keys_ = list(keys)
    sizes = cells.groupBy("region_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(wanted.select(*keys, "k")))
    quota = quotas(sizes, F.col("k"), mode, keys).select(*keys, "region_id", "n", "quota")
    held = plans.select(*keys, "pixel_id").join(cells.select("pixel_id", "region_id"), "pixel_id").withColumn("x", F.lit(1))
    few = _few(most)
    held = held if few else stored(held.select(*keys, "region_id", "pixel_id", "x"), "held")
    have = held.groupBy(*keys, "region_id").agg(F.count("*").alias("__n"))
    if not few:
        out = _burdened_by_size(cells, held, stored(quota.join(have, [*keys_, "region_id"], "left").fillna(0, ["__n"]), "quotas"), seed, keys)
        if out is not None:
            return out
    short = quota.drop("n").join(have, [*keys_, "region_id"], "left").where(F.coalesce("__n", F.lit(0)) < F.col("quota")).select(*keys, "region_id")
    others = cells.select("pixel_id", "region_id").join(F.broadcast(short), "region_id").join(held.select(*keys, "pixel_id"), [*keys_, "pixel_id"], "left_anti")
    every = held.select(*keys, "region_id", "pixel_id", "x").unionByName(others.select(*keys, "region_id", "pixel_id", F.lit(0).alias("x")))
    every = stored(every.join(F.broadcast(quota.drop("n")), [*keys_, "region_id"]), "shares")
    return random_repair(every, F.col("quota"), seed, (*keys, "region_id"), most).select(*keys, "pixel_id")


def _burdened_by_size(cells: DataFrame, held: DataFrame, quota: DataFrame, seed: int | Column, keys: tuple[str, ...]) -> DataFrame | None:
    """burdened for many cells: `quota` has n cells, __n chosen ones (rows of `held`) and the quota of every region and plan.

    Regions of no more chosen cells than their quota keep them without draws; what they lack is drawn by blocks of
    cells, and only low draws are compared with the chosen ones.  None if draws turn out uneven.
    """
    by, named = (*keys, "region_id"), [*keys, "region_id"]
    drawn = draw(seed, *map(F.col, by), F.col("pixel_id"))
    quota = quota.where("region_id is not null").withColumn("__over", F.col("__n") > F.col("quota"))
    mine = held.join(F.broadcast(quota.select(*named, "quota", "__over")), named)
    over = quota.where("__over").select(*named, "__n", F.col("quota").alias("__need"))
    parts = [mine.where("not __over"), first_drawn(mine.where("__over"), F.col("quota"), drawn, by, sizes=over)]
    seeds = F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), *map(F.col, keys))
    lack = quota.where("quota > __n").select(*named, seeds.alias("__seed"), (F.col("n") - F.col("__n")).alias("__n"), (F.col("quota") - F.col("__n")).alias("__need"))
    lack = stored(_bounds(lack), "sizes")
    if not lack.isEmpty():
        low = _seeded_draws(cells, lack, keys, ("region_id",), ("region_id", "pixel_id"))
        near = stored(low.join(held.select(*keys, "pixel_id"), [*keys, "pixel_id"], "left_anti"), "draws")
        last = _last_drawn(near, lack.drop("__seed"), named)
        if last is None:
            return None
        parts.append(_with(near, last, named).where("__d < __kd or (__d = __kd and pixel_id <= __kp)"))
    return reduce(DataFrame.unionByName, (p.select(*keys, "pixel_id") for p in parts))


def clustered_plans(cells: DataFrame, plans: DataFrame, strength: float, k: int) -> DataFrame:
    """(sol_id, pixel_id): every plan pulled together to k cells by the smoothed density of its own cells."""
    return clustered(cells, plans, plans.select("sol_id").distinct().withColumn("k", F.lit(k).cast("long")), strength, F.col("sol_id"))


def sampled_plans(cells: DataFrame, solutions: DataFrame, k: int, clustering: float = 0.0, burden: str = "no") -> DataFrame:
    """Starting plans by strategy: random, shared among regions, clustered, or shared first and then clustered."""
    if burden not in ("no", "yes"):
        raise ValueError(f"unknown burden sharing {burden!r}")
    if burden == "yes":
        plans = burden_plans(cells, solutions, k)
    else:
        plans = random_plans(cells, solutions, k)
    return clustered_plans(cells, plans, clustering, k) if clustering > 0 else plans


def window_of(strength: float) -> int | None:
    """Size of the smoothing window for a clustering strength: none, 3, 15 or 31 cells."""
    return None if strength <= 0 else 3 if strength <= 0.34 else 15 if strength <= 0.67 else 31


def cluster(cells: DataFrame, chosen: DataFrame, strength: float, k: int, seed: int) -> DataFrame:
    """k cells by smoothed density of the chosen ones, ties broken by a small seeded noise."""
    one = chosen.select(F.lit(0).alias("__plan"), "pixel_id")
    wanted = cells.sparkSession.range(1).select(F.lit(0).alias("__plan"), F.lit(k).cast("long").alias("k"))
    return cells.join(clustered(cells, one, wanted, strength, F.lit(seed), ("__plan",)).drop("__plan"), "pixel_id", "left_semi")


def quantile_by(cells: DataFrame, value: str, p: float, keys: tuple[str, ...], ranked: int = RANKED) -> DataFrame:
    """(keys, cut): the p quantile of each key's values, interpolated."""
    return quantiles(cells, value, [p], keys, ranked).select(*keys, F.col("q").alias("cut"))


def decision_layers(cells: DataFrame, seeds: DataFrame, p: float, size: int | None, inside: Column) -> DataFrame:
    """(cells, dv_id, dv): seeded noise, smoothed if a window is given, cut at the 1 - p quantile of the cells inside.

    dv is 1 at or above the cut, 0 below, NULL outside the decision area.  Cells go through the windows once for all
    seeds, and noise is written once, a row a cell with a whole number a seed; rows a seed are made where it is read.
    """
    ids = [r[0] for r in seeds.select("dv_id").collect()]  # a number a layer
    held = cells.withColumn("__in", inside)
    if size:
        unit, held = 1e9, smoothed_draws(held, ids, size, "__in", "__noise")
    else:
        unit, held = 2.0**32, held.withColumn("__noise", F.when(F.col("__in"), F.array(*(draw(i, F.col("pixel_id")) for i in ids))))
    held = stored(held, "noise")
    long = held.where("__in").select(F.posexplode("__noise").alias("__layer", "__c"))
    cut = quantiles(long.withColumn("noise", F.col("__c") / F.lit(unit)), "noise", [1 - p], ("__layer",), code="__c").select("__layer", F.col("q").alias("__cut"))
    number = F.element_at(F.array(*map(F.lit, ids)), F.col("__layer") + 1)
    cut = stored(cut.select("__layer", number.alias("dv_id"), "__cut"), "cuts")
    noise = F.get(F.col("__noise"), F.col("__layer")) / F.lit(unit)
    layer = held.crossJoin(F.broadcast(cut))  # a row a layer
    return layer.withColumn("dv", F.when(F.col("__in"), (noise >= F.col("__cut")).cast("int"))).drop("__in", "__noise", "__layer", "__cut")
