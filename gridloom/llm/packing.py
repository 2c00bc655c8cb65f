"""Best-fit packing of tokenised documents into sequences of fixed capacity, bulk-synchronously.

Documents longer than the capacity are cut, from the end, into full pieces; the first may be
shorter.  Pieces of more than half the capacity cannot share a sequence with each other, so each
opens its own.  The others are placed in rounds over two tables, loose pieces and open gaps:

1. Range sort.  Counts by size (at most two rows a size) deal all pieces and gaps, by descending
   size, gaps before pieces, into ranges of bounded length; one size may span many ranges.
2. Successor sweep.  Each range is swept on its own: a piece takes the smallest gap above it that no
   other has taken.  What finds no partner in its range keeps its rank there.
3. Conflicts by rank.  Pieces left in a range meet the gaps left in the ranges above, nearest first.
   From the number of either in each range follow intervals of ranks that belong together; a join
   on the rank brings the pairs together.
4. Gaps shrink by what they took, and the next round starts.  If nothing fits any more, the largest
   pieces left, as many as their tokens need sequences at least, open new ones.

What is left of few pieces, with the gaps that could still take them, fits one range; then the same
rounds run to their end inside one task.  Ranges hold `range_rows` rows, or more once there would be
more than 10,000 of them, so the driver sees counts of at most 10,000 ranges and no piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, lean_group, prepare
from .tokens import Encoder

_encoders: dict[str, Encoder] = {}
_MOST_RANGES = 10_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece; whole texts, no shuffle.

    A null or empty text gives one piece, the end id; rows that repeat an id, or have none, are cut one
    by one; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        encoder = _encoders.get(tokenizer)
        if encoder is None:
            encoder = _encoders[tokenizer] = Encoder(tokenizer, added=True)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.ids(text.as_py() or "").tobytes() + end
                n = len(raw) // 4
                at, piece = 0, 0
                size = n % capacity or capacity
                while at < n:
                    part = raw[4 * at : 4 * (at + size)]
                    rows.append((doc, piece, at, size, zlib.crc32(part), part))
                    at, piece, size = at + size, piece + 1, capacity
                held += len(raw)
                if held > 16_000_000:
                    yield _piece_batch(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _piece_batch(rows, with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)


def _piece_batch(rows, with_ids: bool) -> pa.RecordBatch:
    doc, piece, start, length, crc, parts = zip(*rows)
    columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        columns.append(pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def sweep(pieces: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """For each of the pieces (sizes in descending order) the index of its gap (same order), or -1.

    Down the sizes, a piece takes the gap seen last that is not taken: the smallest that holds it.
    Equal sizes are taken as runs.
    """
    mate = np.full(len(pieces), -1, np.int64)
    firsts = np.flatnonzero(np.r_[len(pieces) > 0, pieces[1:] != pieces[:-1]][: len(pieces)])
    stack: list[list[int]] = []
    seen = 0
    for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(pieces)]):
        upto = int(np.searchsorted(-gaps, -pieces[a], side="right"))
        if upto > seen:
            stack.append([seen, upto])
            seen = upto
        while a < b and stack:
            first, end = stack[-1]
            n = min(b - a, end - first)
            mate[a : a + n] = np.arange(end - 1, end - 1 - n, -1)
            a += n
            if n == end - first:
                stack.pop()
            else:
                stack[-1][1] = end - n
    return mate


def pack_in_task(key: np.ndarray, size: np.ndarray, seq: np.ndarray, gap: np.ndarray, capacity: int):
    """All rounds at once: (piece key, sequence, offset) of every piece; a sequence is named by the piece that opened it."""
    placed = []
    while len(key):
        order, by = np.lexsort((key, -size)), np.lexsort((seq, -gap))
        key, size, seq, gap = key[order], size[order], seq[by], gap[by]
        mate = sweep(size, gap)
        hit = mate >= 0
        if hit.any():
            at = mate[hit]
            placed.append((key[hit], seq[at], capacity - gap[at]))
            gap[at] -= size[hit]
        else:
            hit[: -(-int(size.sum()) // capacity)] = True
            placed.append((key[hit], key[hit], np.zeros(int(hit.sum()), np.int64)))
            seq, gap = np.concatenate([seq, key[hit]]), np.concatenate([gap, capacity - size[hit]])
        key, size = key[~hit], size[~hit]
        useful = gap >= size.min(initial=capacity)
        seq, gap = seq[useful], gap[useful]
    return [np.concatenate(x) for x in zip(*placed)] if placed else [np.zeros(0, np.int64)] * 3


_PLACED = "key long, sequence_id long, offset long"
_SWEPT = "range long, kind int, key long, size long, seq long, gap long, rank long"  # kind 0: gap, 1: piece, 2: both, matched


def _in_task(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        kind, key, size = (group.column(c).to_numpy() for c in ("kind", "key", "size"))
        out = pack_in_task(key[kind == 1], size[kind == 1], key[kind == 0], size[kind == 0], capacity)
        return pa.table(dict(zip(("key", "sequence_id", "offset"), map(pa.array, out))))

    return run


def _sweep_range(group: pa.Table) -> pa.Table:
    where = group.column("range")[0].as_py()
    kind, key, size = (group.column(c).to_numpy() for c in ("kind", "key", "size"))
    order = np.lexsort((key, kind, -size))
    kind, key, size = kind[order], key[order], size[order]
    key, size, seq, gap = key[kind == 1], size[kind == 1], key[kind == 0], size[kind == 0]
    mate = sweep(size, gap)
    hit = mate >= 0
    at, free = mate[hit], np.ones(len(gap), bool)
    free[at] = False
    n = [int(hit.sum()), int((~hit).sum()), int(free.sum())]
    none = [np.full(k, -1, np.int64) for k in n]
    columns = {
        "range": np.full(sum(n), where),
        "kind": np.repeat(np.array([2, 1, 0], np.int32), n),
        "key": np.r_[key[hit], key[~hit], none[2]],
        "size": np.r_[size[hit], size[~hit], none[2]],
        "seq": np.r_[seq[at], none[1], seq[free]],
        "gap": np.r_[gap[at], none[1], gap[free]],
        "rank": np.r_[none[0], np.arange(n[1]), np.arange(n[2])],
    }
    return pa.table(columns)


def _ranges(cells: list, target: int) -> list[tuple[int, int, int, int]]:
    """(size, kind, first range, ranges) of every size, in the order of the sweep."""
    out, number, held = [], 0, 0
    for size, kind, n in sorted(cells, key=lambda c: (-c[0], c[1])):
        subs = -(-n // target)
        if held and (subs > 1 or held + n > target):
            number, held = number + 1, 0
        out.append((size, kind, number, subs))
        if subs > 1:
            number += subs
        else:
            held += n
    return out


def rank_intervals(counts: dict[int, tuple[int, int]]) -> np.ndarray:
    """Intervals (range of pieces, first rank, range of gaps, last rank, length, first pair number).

    counts has the pieces and the gaps left in each range.  Pieces take gaps of earlier ranges,
    the nearest first and in it from the last rank on.
    """
    stack: list[list[int]] = []
    out, pairs = [], 0
    for where in sorted(counts):
        pieces, gaps = counts[where]
        rank = 0
        while rank < pieces and stack:
            above, left = stack[-1]
            n = min(pieces - rank, left)
            out.append((where, rank, above, left - 1, n, pairs))
            rank, pairs = rank + n, pairs + n
            if n == left:
                stack.pop()
            else:
                stack[-1][1] = left - n
        if gaps:
            stack.append([where, gaps])
    return np.array(out, np.int64).reshape(-1, 6)


def _paired(sent):
    """Adds `pair` to the rows that a sweep left: the number both of a pair have, null for rows without a partner."""

    def lookup(where, rank, first_where, first_rank, last_rank, number):
        key = (first_where << 40) | first_rank
        order = np.argsort(key)
        at = np.searchsorted(key[order], (where << 40) | rank, side="right") - 1
        at = order[np.maximum(at, 0)] if len(order) else np.zeros(len(where), np.int64)
        if not len(order):
            return np.zeros(len(where), np.int64), np.zeros(len(where), bool)
        ok = (first_where[at] == where) & (first_rank[at] <= rank) & (rank <= last_rank[at])
        return number(at, rank), ok

    def run(batches):
        rows = sent.value
        piece_at, a, gap_at, last, n, pair = rows.T if len(rows) else np.zeros((6, 0), np.int64)
        for batch in batches:
            kind, where, rank = (batch.column(c).to_numpy() for c in ("kind", "range", "rank"))
            p, p_ok = lookup(where, rank, piece_at, a, a + n - 1, lambda at, r: pair[at] + r - a[at])
            g, g_ok = lookup(where, rank, gap_at, last - n + 1, last, lambda at, r: pair[at] + last[at] - r)
            value, ok = np.where(kind == 1, p, g), np.where(kind == 1, p_ok, g_ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.int64(), mask=~ok)], names=[*batch.schema.names, "pair"])

    return run


def place_best_fit(pieces: DataFrame, scratch: Scratch, capacity: int, range_rows: int = 100_000) -> DataFrame:
    """(key, sequence_id, offset) of every row (key, length) of pieces of at most half the capacity.

    Keys are distinct, lengths 1 to capacity; a longer piece has the sequence that bears its key, from offset 0.
    """
    spark = pieces.sparkSession
    half = capacity // 2
    alone = pieces.where(F.col("length") > half)
    placed = []
    both = pieces.where(F.col("length") <= half).select(F.lit(1).alias("kind"), "key", F.col("length").alias("size")).union(
        alone.where(F.col("length") < capacity).select(F.lit(0).alias("kind"), "key", (capacity - F.col("length")).alias("size"))
    )
    both = scratch.save(both, "loose")
    while True:
        cells = [tuple(r) for r in both.groupBy("size", "kind").agg(F.count("*").alias("n")).collect()]  # two rows a size at most
        loose = sum(n for _, kind, n in cells if kind == 1)
        if not loose:
            break
        least = min(size for size, kind, _ in cells if kind == 1)
        cells = [c for c in cells if c[0] >= least]
        both = both.where(F.col("size") >= least)
        # A gap takes part in no more placements than there are pieces, so of each size so many are enough.
        if sum(n if kind == 1 else min(n, loose) for _, kind, n in cells) <= range_rows:
            place = F.row_number().over(Window.partitionBy("kind", "size").orderBy("key"))
            few = both.where("kind = 1").union(both.where("kind = 0").withColumn("place", place).where(F.col("place") <= loose).drop("place"))
            placed.append(few.withColumn("range", F.lit(0)).groupBy("range").applyInArrow(lean_group(_in_task(capacity)), _PLACED))
            break
        ranges = _ranges(cells, max(range_rows, sum(n for _, _, n in cells) // _MOST_RANGES))
        plan = spark.createDataFrame(ranges, "size long, kind int, first long, subs long")  # two rows a size at most
        dealt = both.join(F.broadcast(plan), ["size", "kind"]).select(
            (F.col("first") + F.pmod(F.xxhash64("key"), F.col("subs"))).alias("range"), "kind", "key", "size"
        )
        swept = scratch.save(dealt.groupBy("range").applyInArrow(lean_group(_sweep_range), _SWEPT), "swept")
        tally: dict[int, list[int]] = {}
        matched = 0
        for where, kind, n in swept.groupBy("range", "kind").agg(F.count("*").alias("n")).collect():  # three rows a range at most
            if kind == 2:
                matched += n
            else:
                tally.setdefault(where, [0, 0])[1 - kind] = n
        intervals = rank_intervals(tally)
        if matched or len(intervals):
            left = swept.where("kind < 2").mapInArrow(lean(_paired(spark.sparkContext.broadcast(intervals))), f"{_SWEPT}, pair long")
            left = scratch.save(left, "ranked")
            met = left.where("pair is not null").groupBy("pair").agg(*(F.max(c).alias(c) for c in ("key", "size", "seq", "gap")))
            met = scratch.save(met.drop("pair").union(swept.where("kind = 2").select("key", "size", "seq", "gap")), "met")
            placed.append(met.select("key", F.col("seq").alias("sequence_id"), (capacity - F.col("gap")).alias("offset")))
            after = left.where("pair is null").select("kind", F.greatest("key", "seq").alias("key"), F.greatest("size", "gap").alias("size"))
            after = after.union(met.where("gap > size").select(F.lit(0), "seq", F.col("gap") - F.col("size")))
        else:
            # Nothing fits: pieces in descending order of size, by the numbers of the ranges before and the rank within.
            opened = -(-int(swept.where("kind = 1").agg(F.sum("size")).first()[0]) // capacity)
            before, total = [], 0
            for where in sorted(tally):
                before.append((where, total))
                total += tally[where][0]
            bases = spark.createDataFrame(before, "range long, base long")  # a row a range
            some = swept.join(F.broadcast(bases), "range").withColumn("new", (F.col("kind") == 1) & (F.col("base") + F.col("rank") < opened))
            some = scratch.save(some, "opening")
            placed.append(some.where("new").select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            after = some.select(F.when(F.col("new"), 0).otherwise(F.col("kind")).alias("kind"), F.greatest("key", "seq").alias("key"), F.when(F.col("new"), capacity - F.col("size")).otherwise(F.greatest("size", "gap")).alias("size"))
        both = scratch.save(after, "loose")
    out = both.where("false").select("key", F.col("key").alias("sequence_id"), F.col("size").alias("offset"))
    for more in placed:
        out = out.union(more)
    return out


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, range_rows: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    A null text counts as empty and gives one piece that holds the end id alone; every row of an id
    that repeats, or of a null id, is packed as a document of its own; an empty table gives no rows;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, with_ids).withColumn("key", F.monotonically_increasing_id())
    pieces = scratch.save(pieces, "pieces")  # written once, so that the keys stay
    half = capacity // 2
    out = pieces.where(F.col("length") > half).withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})
    placed = scratch.save(place_best_fit(pieces, scratch, capacity, range_rows), "placed")
    out = out.unionByName(pieces.where(F.col("length") <= half).join(placed, "key"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
