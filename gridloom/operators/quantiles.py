"""Exact quantiles of any numbers, for many keys and many quantiles at once, by refined histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean, ordered_bits
from ..shared import stored

_SPLIT = 1024
RANKED = 10_000  # values of a range that a window may rank


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(F.broadcast(facts), keys) if keys else rows.crossJoin(F.broadcast(facts))


def quantiles(df: DataFrame, value: str, shares: list[float], keys: tuple[str, ...] = (), ranked: int = RANKED, code: str | None = None) -> DataFrame:
    """(keys, p, q): the value at each share p of 0 to 1, interpolated between neighbours in rank (type 7).

    NULL and NaN are left out; a key without values has no rows.  Values are counted by the bits of their
    doubles, first by sign and exponent, then, in the ranges that hold a rank that is looked for, by ever
    lower bits, until a range holds one value or few.  No task holds the values of a key: what is
    broadcast has a row a key and share.  Values are written once with their bits.  `code` names a column of whole
    numbers that rise with the values, which saves both; then `df` is read a few times, so it should be a written table.
    """
    if any(not 0 <= p <= 1 for p in shares):
        raise ValueError("shares lie between 0 and 1")
    keys_, bare = list(keys), Window.partitionBy(*(keys or [F.lit(0)]))
    bits = ordered_bits(F.col(value)) if code is None else F.col(code).cast("long")
    held = df.select(*keys, clean(F.col(value)).alias("__v"), bits.alias("__c")).where("__v is not null")
    if code is None:
        held = stored(held, "values")
    facts = (F.count("*").alias("__n"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi"), F.min("__v").alias("__least"))
    first = held.groupBy(*keys, F.shiftright("__c", 52).alias("__at")).agg(*facts)
    upto = lambda family: F.coalesce(F.sum("__n").over(family.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(first.withColumns({"__before": upto(bare), "__all": F.sum("__n").over(bare)}), "ranges")
    place = (F.max("__all") - 1) * F.col("p")
    targets = _joined(first.select(*keys, "__all").distinct(), df.sparkSession.createDataFrame([(float(p),) for p in sorted(set(shares))], "p double"), [])
    targets = targets.groupBy(*keys, "p").agg((place - F.floor(place)).alias("__part"), F.array(F.floor(place) + 1, F.ceil(place) + 1).cast("array<long>").alias("__ranks"))
    targets = targets.select(*keys, "p", "__part", F.posexplode("__ranks").alias("__side", "__rank"))

    def located(sizes: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
        """Of the counted ranges the one that each wanted rank lies in, and its rank there."""
        hit = sizes.join(wanted, on) if on else sizes.crossJoin(F.broadcast(wanted))
        hit = hit.where("__rank > __before and __rank <= __before + __n").withColumn("__rank", F.col("__rank") - F.col("__before"))
        return hit.select(*keys, "p", "__part", "__side", "__rank", "__n", "__lo", "__hi", "__least")

    state = stored(located(first, targets, keys_), "ranks")
    wide = (F.col("__lo") < F.col("__hi")) & (F.col("__n") > ranked)
    while not state.where(wide).isEmpty():
        ranges = state.where(wide).select(*keys, F.col("__lo").alias("__from"), F.col("__hi").alias("__to")).distinct()
        ranges = ranges.withColumn("__shift", F.expr(f"element_at(filter(sequence(0, 62), s -> coalesce(try_subtract(shiftright(__to, s), shiftright(__from, s)) < {_SPLIT}, false)), 1)"))
        rows = _joined(held, ranges, keys_).where("__c between __from and __to")
        family = [*keys, "__from", "__to"]
        sizes = rows.groupBy(*family, F.expr("shiftright(__c, __shift) - shiftright(__from, __shift)").alias("__at")).agg(*facts)
        sizes = sizes.withColumn("__before", upto(Window.partitionBy(*family)))
        wanted = state.where(wide).select(*keys, F.col("__lo").alias("__from"), F.col("__hi").alias("__to"), "p", "__part", "__side", "__rank")
        state = stored(state.where(~wide).unionByName(located(sizes, wanted, family)), "ranks")
    done = state.where("__lo = __hi").select(*keys, "p", "__part", "__side", F.col("__least").alias("__v"))
    ranges = state.where("__lo < __hi")
    rows = _joined(held, ranges.select(*keys, F.col("__lo").alias("__from"), F.col("__hi").alias("__to")).distinct(), keys_).where("__c between __from and __to")
    family = [*keys, "__from", "__to"]
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*family).orderBy("__c")))
    wanted = ranges.select(*keys, F.col("__lo").alias("__from"), F.col("__hi").alias("__to"), "p", "__part", "__side", F.col("__rank").cast("int").alias("__rank"))
    done = done.unionByName(rows.join(F.broadcast(wanted), [*family, "__rank"]).select(*keys, "p", "__part", "__side", "__v"))
    low, high = F.max(F.when(F.col("__side") == 0, F.col("__v"))), F.max(F.when(F.col("__side") == 1, F.col("__v")))
    return done.groupBy(*keys, "p").agg((low * (1 - F.max("__part")) + high * F.max("__part")).alias("q"))
