"""Exact top-k search by distributed histogram selection over integer inner products.

Components become floor(scale * x).  Queries are taken in blocks of bounded size; a block is
broadcast and every task scores its rows against it.  For each query the score of the k-th best is
found by refining a histogram: every pass counts scores by bin of the current range over all rows,
keeps the bin that holds the k-th score, and splits that bin further, until the rows at or above
its lower end are few or the bin is one score wide.  A last pass keeps the rows that reach the
lower end (of those tied there, the smallest ids of each task are enough) and ranks them by score,
ties by id.  No scores are shuffled, only counts and the rows that can still win.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, prepare
from .vectors import matrices, usable

_BINS = 256
_BLOCK_BYTES = 64_000_000
_LARGEST, _TOP = 2.0**63, 2**63 - 1  # scores are longs
_SHRINK = 600


def _integers(matrix: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole doubles, and by row the power of two they were divided by (0 nearly always).

    Rows in which scaling passes the range of doubles are divided by 2**600 first; such quotients only
    tell sizes, exact products are then taken from the components themselves.
    """
    with np.errstate(over="ignore"):
        out = np.floor(scale * matrix)
    power = np.zeros(len(matrix), np.int64)
    wide = np.flatnonzero(~np.isfinite(out).all(axis=1))
    if len(wide):
        power[wide] = _SHRINK
        out[wide] = scale * np.ldexp(matrix[wide], -_SHRINK)
    return out, power


def _exact(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of every component, as Python integers."""
    return [math.floor(y) if math.isfinite(y := scale * x) else scale * int(x) for x in vector.tolist()]


def _wrapped(matrix: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, modulo 2**64."""
    m = np.fmod(matrix, 2.0**64)
    return np.where(m >= 2.0**63, m - 2.0**64, np.where(m < -(2.0**63), m + 2.0**64, m)).astype(np.int64)


def _scores(queries: _Rows, rows: _Rows, scale: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Exact integer products, and which of them pass 64 bits (1 above, -1 below; None: none does).

    Doubles are exact where no sum of a pair can pass 2**53.  The other pairs are multiplied modulo
    2**64, which is right for every product that fits; doubles with their error bound tell which do,
    and Python's integers where that is too close.  Products that do not fit count as the largest or
    the smallest long.
    """
    d = queries.whole.shape[1]
    q_top, r_top = np.abs(queries.whole).max(axis=1, initial=0), np.abs(rows.whole).max(axis=1, initial=0)
    q_top, r_top = np.where(queries.power > 0, np.inf, q_top), np.where(rows.power > 0, np.inf, r_top)
    with np.errstate(over="ignore", invalid="ignore"):
        product = queries.whole @ rows.whole.T
        q = np.flatnonzero(~(q_top * r_top.max(initial=0) * d < 2.0**53))
        r = np.flatnonzero(~(r_top * q_top.max(initial=0) * d < 2.0**53))
        if not len(q) or not len(r):
            return product.astype(np.int64), None
        large = ~(np.outer(q_top, r_top) * d < 2.0**53)
        out = np.where(large, 0.0, product).astype(np.int64)
        a, b, near, large = queries.whole[q], rows.whole[r], product[np.ix_(q, r)], large[np.ix_(q, r)]
        error = (np.abs(a) @ np.abs(b).T) * (d + 2) * 2.0**-52 + 2.0**-900
        top = np.ldexp(_LARGEST, -(queries.power[q][:, None] + rows.power[r][None, :]))
        fits, above, below = np.abs(near) + error < top, near - error >= top, near + error < -top
        plain = (queries.power[q][:, None] + rows.power[r][None, :]) == 0
    part = np.where(plain, _wrapped(a) @ _wrapped(b).T, 0)
    beyond = above.astype(np.int8) - below.astype(np.int8)
    for x, y in zip(*np.nonzero(large & ~(plain & fits) & (beyond == 0))):
        value = sum(u * v for u, v in zip(_exact(queries.given[q[x]], scale), _exact(rows.given[r[y]], scale)))
        beyond[x, y] = (value >= 2**63) - (value < -(2**63))
        part[x, y] = 0 if beyond[x, y] else value
    part = np.where(beyond > 0, _TOP, np.where(beyond < 0, -_TOP - 1, part))
    out[np.ix_(q, r)] = np.where(large, part, out[np.ix_(q, r)])
    if not beyond.any():
        return out, None
    every = np.zeros(out.shape, np.int8)
    every[np.ix_(q, r)] = np.where(large, beyond, 0)
    return out, every


class _Rows:
    """Vectors as given, scaled to whole doubles, and what each was divided by for that."""

    def __init__(self, matrix: np.ndarray, scale: int):
        self.given = matrix
        self.whole, self.power = _integers(matrix, scale)


class _Block:
    """Queries of one block by vector length, with the range in which each one's k-th score lies."""

    def __init__(self, table: pa.Table, scale: int):
        self.parts = [(ids, _Rows(m, scale)) for ids, m in matrices(table.column(0), table.column(1))]


def _visit(sent, scale: int, slice_rows: int = 2048):
    """Shared loop: (part number, query ids, scores, which of them pass a long, row ids) with a query's own row masked out by the callers."""

    def loop(batches):
        block = sent.value
        for batch in batches:
            for ids, matrix in matrices(batch.column(0), batch.column(1)):
                for part, (qids, q) in enumerate(block.parts):
                    if q.given.shape[1] != matrix.shape[1]:
                        continue
                    some = max(1, min(slice_rows, _BLOCK_BYTES // (8 * max(matrix.shape[1], len(qids), 1))))
                    for a in range(0, len(ids), some):
                        rows = ids[a : a + some]
                        yield part, qids, *_scores(q, _Rows(matrix[a : a + some], scale), scale), rows

    return loop


def _histogram(sent, bounds_sent, scale: int):
    """(query, bin, count) of one refinement; bins above the range count as the last bin + 1."""

    def run(batches):
        bounds = bounds_sent.value
        counts = {}
        for part, qids, s, _, rows in _visit(sent, scale)(batches):
            low, width = bounds[part]
            above = s.view(np.uint64) - low.view(np.uint64)[:, None]  # right from low on, even past 2**63
            at = np.minimum(above // width.view(np.uint64)[:, None], np.uint64(_BINS)).astype(np.int64)
            at[s < low[:, None]] = -1
            at[qids[:, None] == rows[None, :]] = -1
            flat = (np.arange(len(qids))[:, None] * (_BINS + 2) + at + 1).ravel()
            c = np.bincount(flat, minlength=len(qids) * (_BINS + 2)).reshape(len(qids), -1)
            counts[part] = counts.get(part, 0) + c
        for part, c in counts.items():
            q, b = np.nonzero(c[:, 1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), part), pa.int32()), pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c[q, b + 1].astype(np.int64))], names=["part", "q", "bin", "n"])

    return run


def _winners(sent, floor_sent, scale: int, k: int):
    """Rows at or above each query's floor; of each task no more than k ties at a score."""

    def run(batches):
        floors = floor_sent.value
        best: dict = {}
        for part, qids, s, beyond, rows in _visit(sent, scale)(batches):
            q, r = np.nonzero((s >= floors[part][:, None]) & (qids[:, None] != rows[None, :]))
            if not len(q):
                continue
            new = (q, np.zeros(len(q), np.int8) if beyond is None else beyond[q, r], s[q, r], rows[r])
            if part in best:
                new = tuple(np.concatenate(x) for x in zip(best[part], new))
            order = np.lexsort((new[3], ~new[2], -new[1], new[0]))
            q, over, score, row = (x[order] for x in new)
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            keep = place < k
            best[part] = (q[keep], over[keep], score[keep], row[keep])
        for part, (q, over, score, row) in best.items():
            ids = sent.value.parts[part][0]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(row, pa.int64()), pa.array(score, pa.int64()), pa.array(over.astype(np.int32))], names=["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long) of the k highest inner products of every query.

    Both inputs are (vec_id, embedding); a query's own id is not among its results, and all rows are
    returned where fewer than k exist.  Vectors that are null, empty, or hold null, NaN or infinite
    components take no part.  Scores are exact whatever the components; the query fails, naming a pair, if
    one that belongs into the result has a score that no long holds, and does not if none does.  Vectors of another length than the query's are not compared with it;
    rows that repeat an id compete one by one (a repeated query id is searched once, by its first
    vector in order); no queries or no rows give no result; other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    scratch = Scratch(spark, "topk")
    rows = usable(vectors)
    asked = scratch.save(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_queries, most = asked.agg(F.count("*"), F.max(F.expr("aggregate(v, 0D, (m, x) -> greatest(m, abs(x)))"))).first()
    widest = rows.agg(F.max(F.size("v")), F.max(F.expr("aggregate(v, 0D, (m, x) -> greatest(m, abs(x)))"))).first()
    # A block is broadcast, and a task holds a histogram of each of its queries.
    blocks = max(1, -(-n_queries * 8 * max(widest[0] or 1, _BINS + 2) // block_bytes))
    order = Window.partitionBy("query_id").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    result = None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about block_bytes
        if not held.num_rows or widest[0] is None:
            continue
        block = _Block(held, scale)
        sent = sc.broadcast(block)
        # No score is larger than the product of the largest components, for every dimension.
        reach = (scale * int(most) + scale) * (scale * int(widest[1]) + scale) * widest[0] + 1
        reach = min(reach, _TOP)
        low = -_TOP - 1 if reach == _TOP else -reach  # the whole range of longs holds those that stand for larger ones
        bounds = [(np.full(len(ids), low, np.int64), np.full(len(ids), -(-(2 * reach + 1) // _BINS), np.int64)) for ids, _ in block.parts]
        open_ = [np.ones(len(ids), bool) for ids, _ in block.parts]
        while any(o.any() for o in open_):
            hist = rows.mapInArrow(lean(_histogram(sent, sc.broadcast(bounds), scale)), "part int, q int, bin int, n long").groupBy("part", "q", "bin").agg(F.sum("n").alias("n"))
            # Of each query only the bin in which the count from above passes k comes to the driver.
            down = Window.partitionBy("part", "q").orderBy(F.desc("bin"))
            hist = hist.withColumn("upto", F.sum("n").over(down))
            hist = hist.groupBy("part", "q").agg(
                F.min_by(F.struct("bin", "n", "upto"), F.when(F.col("upto") >= k, F.col("upto"))).alias("hit")
            )
            seen = hist.collect()
            touched = [np.zeros(len(ids), bool) for ids, _ in block.parts]
            for r in seen:
                part, q = r["part"], r["q"]
                if not open_[part][q]:
                    continue
                touched[part][q] = True
                low, width = bounds[part]
                if r["hit"] is None:  # fewer than k rows at or above the range: all of them count
                    open_[part][q] = False
                    continue
                bin_, n, upto = r["hit"]
                low[q] = min(_TOP, int(low[q]) + bin_ * int(width[q]))
                if width[q] == 1 or upto <= 4 * k:
                    open_[part][q] = False
                width[q] = max(1, -(-int(width[q]) // _BINS))
            for o, t in zip(open_, touched):
                o &= t
        floors = sc.broadcast([low for low, _ in bounds])
        # Written block by block: no plan holds more than one block's scans, and a lost executor repeats no other block.
        found = rows.mapInArrow(lean(_winners(sent, floors, scale, k)), "query_id long, vec_id long, score long, beyond int")
        found = scratch.save(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "winners")
        lost = found.where("beyond <> 0").select("query_id", "vec_id").first()
        if lost is not None:
            raise OverflowError(f"the score of query {lost[0]} and vector {lost[1]} belongs into the result and does not fit a long")
        found = found.select("query_id", "rank", "vec_id", "score")
        result = found if result is None else result.union(found)
    if result is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return result


def topk_digest(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    return top_k(embeddings.select("vec_id", "embedding"), embeddings.where(F.col("vec_id") % every == 0).select("vec_id", "embedding"), k)
