"""Fisher's natural breaks: class bounds of least within-class variance, exact, for many keys at once.

With the distinct values of a key in order, and prefix sums of weights, values and squares, the cost of a
class is a difference of sums.  The best last start of a class never falls as its end moves up, so the
middle one of a range of ends is solved first and bounds the starts of both halves.

Keys of up to `local` distinct values are solved in a task each, all in one job.  For larger ones prefix
sums are taken over sorted ranges; the driver holds the open subproblems (at most two for every `local` / 2
values), one job a level finds the starts of the middles of all of them, and subproblems that fit a task are
solved there, again all at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..shared import stored
from ..shipping import ship_package

_CHUNK = 1 << 16
_SUMS = ["sw", "sx", "sq"]


def least_starts(best: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, a: int, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For every end the least best[start] + cost of one class from there, and that start, the first of equal ones.

    `starts` are the prefix sums (3, n) at lo, lo + 1 ..., `ends` those at a, a + 1 ...; a start lies before
    its end.  All ranges of a level are solved together, by chunks.
    """
    n = ends.shape[1]
    new, at = np.full(n, np.inf), np.full(n, lo, np.int64)
    first, last = np.array([0]), np.array([n - 1])  # ends, counted from a
    low, high = np.array([0]), np.array([starts.shape[1] - 1])  # starts, counted from lo
    while len(first):
        mid = (first + last) // 2
        top = np.minimum(high, mid + a - 1 - lo)
        size = np.maximum(top - low + 1, 1)  # an end before every start keeps an infinite cost
        part = np.cumsum(size) // chunk
        for nodes in np.split(np.arange(len(first)), np.flatnonzero(np.diff(part)) + 1):
            k = size[nodes]
            begin = np.cumsum(k) - k
            i = np.arange(k.sum()) + np.repeat(low[nodes] - begin, k)
            j = np.repeat(mid[nodes], k)
            w, x, q = ends[:, j] - starts[:, i]
            with np.errstate(invalid="ignore", divide="ignore"):
                cost = np.where(w > 0, best[i] + q - x * x / w, np.inf)
            least = np.minimum.reduceat(cost, begin)
            hit = np.flatnonzero(cost == np.repeat(least, k))
            hit = hit[np.searchsorted(hit, begin)]
            new[mid[nodes]], at[mid[nodes]] = cost[hit], i[hit] + lo
        found = at[mid] - lo
        first, last, low, high = (np.concatenate(x) for x in ((first, mid + 1), (mid - 1, last), (low, found), (found, high)))
        open_ = first <= last
        first, last, low, high = first[open_], last[open_], low[open_], high[open_]
    return new, at


def breaks_of(values: np.ndarray, weights: np.ndarray, classes: int) -> list[float]:
    """The breaks of distinct values in ascending order: the least value, then the greatest of each class."""
    m = len(values)
    if not m:
        return []
    middle = values[np.searchsorted(np.cumsum(weights), weights.sum() / 2)]  # sums around it keep digits beside extreme values
    far = values - middle
    sums = np.stack([np.concatenate([[0.0], np.cumsum(v)]) for v in (weights, weights * far, weights * far * far)])
    best = np.r_[0.0, np.full(m, np.inf)]
    chosen = []
    for _ in range(min(classes, m)):
        new, at = least_starts(best[:m], sums[:, :m], sums[:, 1:], 0, 1)
        best = np.r_[np.inf, new]
        chosen.append(at)
    ends, j = [], m
    for at in reversed(chosen):
        ends.append(float(values[j - 1]))
        j = int(at[j - 1])
    return [float(values[0]), *reversed(ends)]


def natural_breaks_by(df: DataFrame, value: str, classes: int = 5, keys: tuple[str, ...] = (), local: int = 1_000_000) -> DataFrame:
    """(keys, breaks): the bounds of `classes` natural classes of each key's values, from the least one up.

    NULLs are left out, and keys without values with them; a key of fewer distinct values has as many classes.
    """
    ship_package(df.sparkSession)
    held = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").cast("double").alias("__w"))
    held = stored(held, "values")
    sizes = stored(held.groupBy(*keys).agg(F.count("*").alias("__m"), F.percentile_approx("__v", 0.5).alias("__mid")), "sizes")
    schema = StructType([*(df.schema[k] for k in keys), StructField("breaks", ArrayType(DoubleType()))])

    def solved(table: pa.Table) -> pa.Table:
        table = table.sort_by("__v")
        found = breaks_of(table.column("__v").to_numpy(), table.column("__w").to_numpy(), classes)
        return table.slice(0, 1).select(list(keys)).append_column("breaks", pa.array([found], pa.list_(pa.float64())))

    large = sizes.where(F.col("__m") > local)
    if large.isEmpty():
        return held.groupBy(*keys).applyInArrow(solved, schema)
    many = _far_breaks(held, large, classes, list(keys), local)
    small = sizes.where(F.col("__m") <= local).select(*keys)
    few = held.join(small, list(keys), "left_semi") if keys else held.limit(0)
    return few.groupBy(*keys).applyInArrow(solved, schema).unionByName(many)


def _prefix_sums(held: DataFrame, large: DataFrame, keys: list[str], local: int) -> tuple[DataFrame, DataFrame]:
    """(g, j, v, sw, sx, sq): the j-th value of each large key and the sums up to it, from 0; and the keys by number g."""
    total = int(large.agg(F.sum("__m")).first()[0])
    order = Window.partitionBy(F.lit(0)).orderBy(*(keys or ["__m"]))
    names = stored(large.withColumn("__g", F.row_number().over(order)), "keys")  # no more than one in `local` values
    rows = held.join(F.broadcast(names), keys) if keys else held.crossJoin(F.broadcast(names))
    far = F.col("__v") - F.col("__mid")
    rows = rows.select(F.col("__g").alias("g"), F.col("__v").alias("v"), F.col("__w").alias("sw"), (F.col("__w") * far).alias("sx"), (F.col("__w") * far * far).alias("sq"))
    parts = max(2, -(-total // max(1, min(local, 500_000) // 2)))
    rows = rows.repartitionByRange(parts, "g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id())
    rows = stored(rows, "sorted")
    base = rows.groupBy("g", "part").agg(F.count("*").alias("n0"), *(F.sum(c).alias(f"{c}0") for c in _SUMS))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    base = base.select("g", "part", *(F.coalesce(F.sum(f"{c}0").over(before), F.lit(0)).alias(f"{c}0") for c in ("n", *_SUMS)))
    upto = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"n": F.count("*").over(upto), **{c: F.sum(c).over(upto) for c in _SUMS}}).join(F.broadcast(base), ["g", "part"])
    rows = rows.select("g", (F.col("n") + F.col("n0")).alias("j"), "v", *((F.col(c) + F.col(f"{c}0")).alias(c) for c in _SUMS))
    zero = names.select(F.col("__g").alias("g"), F.lit(0).cast("long").alias("j"), F.lit(None).cast("double").alias("v"), *(F.lit(0.0).alias(c) for c in _SUMS))
    return stored(rows.unionByName(zero).withColumn("chunk", F.floor(F.col("j") / _CHUNK)), "sums"), names


def _far_breaks(held: DataFrame, large: DataFrame, classes: int, keys: list[str], local: int) -> DataFrame:
    spark = held.sparkSession
    sums, names = _prefix_sums(held, large, keys, local)
    sizes = {r["__g"]: r["__m"] for r in names.select("__g", "__m").collect()}
    state = sums.withColumn("best", F.when(F.col("j") == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
    passes = []
    for _ in range(classes):  # large keys have more values than classes
        state = _one_more(state, sizes, local)
        passes.append(state)
    at, ends = dict(sizes), {g: [m] for g, m in sizes.items()}
    picked = lambda df, where: {(r["g"], r["j"]): r for r in df.join(F.broadcast(spark.createDataFrame(where, "g int, j long")), ["g", "j"]).collect()}
    for table in reversed(passes):
        found = picked(table, list(at.items()))
        at = {g: found[g, j]["at"] for g, j in at.items()}
        for g, j in at.items():
            ends[g].append(j)
    wanted = [(g, max(j, 1)) for g, js in ends.items() for j in js]
    value = {k: r["v"] for k, r in picked(sums, sorted(set(wanted))).items()}
    rows = [(g, [value[g, max(j, 1)] for j in reversed(js)]) for g, js in ends.items()]
    found = spark.createDataFrame(rows, "__g int, breaks array<double>")
    return names.join(F.broadcast(found), "__g").select(*keys, "breaks")


def _one_more(state: DataFrame, sizes: dict[int, int], local: int) -> DataFrame:
    """The state (g, j, v, sums, chunk, best) with one class more, and `at`, where that class starts."""
    spark = state.sparkSession
    open_, near, solved = [(g, 1, m, 0, m - 1) for g, m in sizes.items()], [], []
    while open_:
        far = [s for s in open_ if s[2] - s[1] + s[4] - s[3] + 2 > local]
        near += [s for s in open_ if s[2] - s[1] + s[4] - s[3] + 2 <= local]
        open_ = []
        if not far:
            break
        middles = [(k, s[0], (s[1] + s[2]) // 2, s[3], min(s[4], (s[1] + s[2]) // 2 - 1)) for k, s in enumerate(far)]
        asked = spark.createDataFrame(middles, "k int, g int, j long, lo long, hi long")
        ends = state.join(F.broadcast(asked), ["g", "j"]).select("k", "g", "j", "lo", "hi", "v", *(F.col(c).alias(f"{c}1") for c in _SUMS))
        ends = stored(ends, "middles")
        chunks = ends.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / _CHUNK), F.floor(F.col("hi") / _CHUNK))))
        starts = state.select("g", "chunk", F.col("j").alias("i"), *_SUMS, "best").join(F.broadcast(chunks.drop("v")), ["g", "chunk"]).where("i between lo and hi")
        x = F.col("sx1") - F.col("sx")
        cost = F.col("best") + (F.col("sq1") - F.col("sq")) - x * x / (F.col("sw1") - F.col("sw"))
        hit = starts.groupBy("k").agg(F.min(F.struct(cost.alias("best"), F.col("i").alias("at"))).alias("hit"))
        for r in ends.join(hit, "k").select("k", "g", "j", "v", *(F.col(f"{c}1").alias(c) for c in _SUMS), "hit.best", "hit.at").collect():
            _, a, b, lo, hi = far[r["k"]]
            solved.append((r["g"], r["j"], r["v"], r["sw"], r["sx"], r["sq"], r["j"] // _CHUNK, r["best"], r["at"]))
            open_ += [s for s in ((r["g"], a, r["j"] - 1, lo, r["at"]), (r["g"], r["j"] + 1, b, r["at"], hi)) if s[1] <= s[2]]
    schema = "g int, j long, v double, sw double, sx double, sq double, chunk long, best double, at long"
    asked = spark.createDataFrame([(k, *s) for k, s in enumerate(near)], "k int, g int, a long, b long, lo long, hi long")

    def rows(first: str, last: str, is_end: bool) -> DataFrame:
        chunks = asked.withColumn("chunk", F.explode(F.sequence(F.floor(F.col(first) / _CHUNK), F.floor(F.col(last) / _CHUNK))))
        return state.drop("at").join(F.broadcast(chunks), ["g", "chunk"]).where(F.col("j").between(F.col(first), F.col(last))).withColumn("is_end", F.lit(is_end))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("j")
        ends, starts = (table.filter(pa.compute.equal(table.column("is_end"), e)) for e in (True, False))
        matrix = lambda t: np.stack([t.column(c).to_numpy() for c in _SUMS])
        lo, a = table.column("lo")[0].as_py(), table.column("a")[0].as_py()
        new, at = least_starts(starts.column("best").to_numpy(), matrix(starts), matrix(ends), lo, a)
        out = ends.select(["g", "j", "v", *_SUMS, "chunk"])
        return out.append_column("best", pa.array(new)).append_column("at", pa.array(at))

    found = rows("a", "b", True).unionByName(rows("lo", "hi", False)).groupBy("k").applyInArrow(solve, schema)
    found = found.unionByName(spark.createDataFrame(solved, schema))
    zero = state.where("j = 0").select("g", "j", "v", *_SUMS, "chunk", F.lit(float("inf")).alias("best"), F.lit(0).cast("long").alias("at"))
    return stored(found.unionByName(zero), "state")
