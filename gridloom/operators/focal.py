"""Neighbourhoods: windows over tiles, weighted discs, rings and blocks; joins on integer keys.

Square windows are taken tile by tile.  Cells go to the tile they lie in, and values within half a window
of another tile's edge also to that one, so one exchange brings every tile what it needs; numpy then
slides along rows and columns.  A task holds a tile of one key at a time, never a row of the grid.
"""

from __future__ import annotations

from collections.abc import Callable

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..shipping import ship_package

TILE = 256


def _slid(values: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums of every `size` neighbours along an axis."""
    total = np.cumsum(values, axis=axis)
    zero = np.zeros_like(np.take(total, [0], axis=axis))
    total = np.concatenate([zero, total], axis=axis)
    n = total.shape[axis]
    return np.take(total, np.arange(size, n), axis=axis) - np.take(total, np.arange(n - size), axis=axis)


def _sum(values: np.ndarray, size: int, there: np.ndarray | None = None) -> np.ndarray:
    """Sums over windows; with `there`, of a row only where it has a cell in the window's middle column."""
    rows = _slid(values, size, 1)
    if there is not None:
        rows = rows * there[:, size // 2 : there.shape[1] - size // 2]
    return _slid(rows, size, 0)


def _top(values: np.ndarray, size: int) -> np.ndarray:
    """Greatest of every size x size neighbours: running maxima of blocks of `size`, from both of their ends."""
    for axis in (0, 1):
        v = np.moveaxis(values, axis, 0)
        n = len(v)
        padded = np.concatenate([v, np.full((-n % size, *v.shape[1:]), -np.inf)]).reshape(-1, size, *v.shape[1:])
        ahead = np.maximum.accumulate(padded, axis=1).reshape(-1, *v.shape[1:])
        back = np.maximum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1, *v.shape[1:])
        values = np.moveaxis(np.maximum(back[: n - size + 1], ahead[size - 1 : n]), 0, axis)
    return values


def _shifted(values: np.ndarray, half: int, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Sums over given offsets from every cell of an array with a rim of `half`."""
    high, wide = values.shape[0] - 2 * half, values.shape[1] - 2 * half
    total = np.zeros((high, wide))
    for r, c in offsets:
        total += values[half + r : half + r + high, half + c : half + c + wide]
    return total


def _window(reducer, values: np.ndarray, there: np.ndarray, size: int, cells: np.ndarray | None) -> np.ndarray:
    """A reducer over the windows of an array with a rim of half a window; NaN where a window has no value."""
    zero = np.where(there, values, 0.0)
    n = np.rint(_sum(there.astype(float), size, cells))
    some = n > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        if reducer == "count":
            return n
        if reducer == "sum":
            return np.where(some, _sum(zero, size, cells), np.nan)
        if reducer == "mean":
            return np.where(some, _sum(zero, size, cells) / n, np.nan)
        if reducer in ("variance", "sd"):
            shift = zero[there].mean() if there.any() else 0.0  # sums around the mean keep digits
            off = np.where(there, values - shift, 0.0)
            s, q = _sum(off, size), _sum(off * off, size)
            out = np.where(n > 1, np.maximum(0.0, q - s * s / n) / (n - 1), np.nan)
            return np.sqrt(out) if reducer == "sd" else out
        if reducer in ("max", "min"):
            sign = 1.0 if reducer == "max" else -1.0
            return np.where(some, sign * _top(np.where(there, sign * values, -np.inf), size), np.nan)
    if callable(reducer):
        shown = np.lib.stride_tricks.sliding_window_view(np.where(there, values, np.nan), (size, size))
        out = np.empty(shown.shape[:2])
        for r in range(len(shown)):  # a row of windows at a time
            out[r] = reducer(shown[r].reshape(shown.shape[1], -1))
        return out
    raise ValueError(f"unknown reducer {reducer!r}")


def _tiles(place: str, half: int, tile: int):
    """Numbers of the tiles that a cell's value reaches along one axis."""
    return F.explode(F.sequence(F.floor((F.col(place) - half) / tile).cast("int"), F.floor((F.col(place) + half) / tile).cast("int")))


def _tile_of(tile: int) -> dict:
    return {"__r": F.floor(F.col("row_idx") / tile).cast("int"), "__c": F.floor(F.col("col_idx") / tile).cast("int")}


def _rim(cells: DataFrame, half: int, tile: int) -> DataFrame:
    """Copies of the cells within half a window of another tile, for that tile."""
    at = _tile_of(tile)
    edge = lambda c: F.pmod(F.col(c), F.lit(tile))
    near = lambda c: (edge(c) < half) | (edge(c) >= tile - half)
    rim = cells.where(near("row_idx") | near("col_idx")).withColumn("__r", _tiles("row_idx", half, tile)).withColumn("__c", _tiles("col_idx", half, tile))
    return rim.where((F.col("__r") != at["__r"]) | (F.col("__c") != at["__c"])).withColumn("__own", F.lit(False))


def focal(cells: DataFrame, value: str, size: int, reducers: dict[str, str | Callable | list], keys: tuple[str, ...] = (), tile: int = TILE, whole: bool = True) -> DataFrame:
    """Adds columns (name -> reducer) over the size x size window around every cell, cut at edges, NULLs left out.

    Reducers are count, sum, mean, variance and sd (of the sample), max, min, or a function from an array of
    windows (n, size * size), NaN where there is no value, to n numbers, or a list of offsets: the mean over these,
    NULL where the cell itself or any of them has no single value.  A window without what a reducer needs gives NULL.  Cells that are there twice count twice in sums.  All of it takes one exchange.
    With whole=False (count, sum and mean) a window is followed along the cells that are there: a row counts only
    if it has a cell in the column of the window's middle.
    """
    if not whole and not all(r in ("count", "sum", "mean") for r in reducers.values()):
        raise ValueError("only count, sum and mean follow the cells that are there")
    if size % 2 == 0 or size < 1:
        raise ValueError("a window has an odd number of cells a side")
    unknown = [r for r in reducers.values() if not callable(r) and not isinstance(r, list) and r not in ("count", "sum", "mean", "variance", "sd", "max", "min")]
    if unknown:
        raise ValueError(f"unknown reducers {unknown}")
    ship_package(cells.sparkSession)
    half = size // 2
    tile = max(tile, size)
    at = _tile_of(tile)
    own = cells.withColumns({**at, "__v": F.col(value).cast("double"), "__own": F.lit(True)})
    rim = (cells.where(F.col(value).isNotNull()) if whole else cells).select(*keys, "row_idx", "col_idx", F.col(value).cast("double").alias("__v"))
    every = own.unionByName(_rim(rim, half, tile), allowMissingColumns=True)
    names = cells.columns

    def run(table: pa.Table) -> pa.Table:
        mine = table.filter(table.column("__own"))
        if not mine.num_rows:
            return out_of(mine, [np.zeros(0)] * len(reducers))
        r0, c0 = table.column("__r")[0].as_py() * tile, table.column("__c")[0].as_py() * tile
        r, c = table.column("row_idx").to_numpy() - r0 + half, table.column("col_idx").to_numpy() - c0 + half
        v, valid = table.column("__v").fill_null(0.0).to_numpy(), table.column("__v").is_valid().to_numpy()
        # Only the part of the tile that has cells is slid over.
        own_r, own_c = mine.column("row_idx").to_numpy() - r0, mine.column("col_idx").to_numpy() - c0
        top, left = int(own_r.min()), int(own_c.min())
        high, wide = int(own_r.max()) - top + 1 + 2 * half, int(own_c.max()) - left + 1 + 2 * half
        inside = (r >= top) & (r < top + high) & (c >= left) & (c < left + wide)
        at, v, valid = ((r - top) * wide + c - left)[inside], v[inside], valid[inside]
        there_at = None
        if not whole:
            there_at = np.bincount(at, minlength=high * wide).reshape(high, wide) > 0
        at, v = at[valid], v[valid]
        n = np.bincount(at, minlength=high * wide).reshape(high, wide)
        again = bool(len(v)) and int(n.max()) > 1
        values = np.bincount(at, weights=v, minlength=high * wide).reshape(high, wide)
        there = n > 0
        got = []
        for reducer in reducers.values():
            if isinstance(reducer, list):
                total, number = _shifted(values, half, reducer), _shifted(n.astype(float), half, reducer)
                centre = n[half : high - half, half : wide - half] > 0
                out = np.where(centre & (number == len(reducer)), total / len(reducer), np.nan)
            elif again and reducer in ("count", "sum", "mean"):
                total, number = _sum(values, size, there_at), np.rint(_sum(n.astype(float), size, there_at))
                with np.errstate(invalid="ignore", divide="ignore"):
                    out = {"count": number, "sum": np.where(number > 0, total, np.nan), "mean": np.where(number > 0, total / number, np.nan)}[reducer]
            elif again:
                raise ValueError(f"cells of tile ({r0}, {c0}) are there twice")
            else:
                out = _window(reducer, values, there, size, there_at)
            got.append(out[own_r - top, own_c - left])
        return out_of(mine, got)

    def out_of(mine: pa.Table, got: list[np.ndarray]) -> pa.Table:
        columns = [mine.column(c) for c in names] + [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in got]
        return pa.Table.from_arrays(columns, names=[*names, *reducers])

    schema = StructType([*cells.schema.fields, *(StructField(n, DoubleType()) for n in reducers)])
    return every.groupBy(*keys, "__r", "__c").applyInArrow(run, schema)


def square_mean(cells: DataFrame, value: str, size: int, out: str = "focal", keys: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Mean of the size x size window around every cell, cut at edges, NULLs left out; see focal."""
    return focal(cells, value, size, {out: "mean"}, keys, whole=whole)


def smoothed_draws(cells: DataFrame, seeds: list[int], size: int, wanted: str, out: str, tile: int = TILE) -> DataFrame:
    """Adds an array with a whole number for every seed: 10 ** 9 times the mean of the seed's uniform numbers (see
    numeric.uniform) over the size x size window around the cell, rounded half up; NULL where not `wanted`.

    Cells are exchanged once for all seeds; draws are made in the task that holds the tile, and are sums of whole
    numbers, so means are exact up to one division.
    """
    ship_package(cells.sparkSession)
    half = size // 2
    tile = max(tile, size)
    own = cells.withColumns({**_tile_of(tile), "__own": F.lit(True)})
    every = own.unionByName(_rim(cells.select("pixel_id", "row_idx", "col_idx"), half, tile), allowMissingColumns=True)
    names = cells.columns

    def run(table: pa.Table) -> pa.Table:
        is_own = table.column("__own").to_numpy()
        mine = table.filter(table.column("__own"))
        r0, c0 = table.column("__r")[0].as_py() * tile, table.column("__c")[0].as_py() * tile
        r, c = table.column("row_idx").to_numpy() - r0 + half, table.column("col_idx").to_numpy() - c0 + half
        high, wide = int(r.max()) + 1 + half, int(c.max()) + 1 + half
        spot = r * wide + c
        n = np.bincount(spot, minlength=high * wide).reshape(high, wide)
        kept = np.flatnonzero(mine.column(wanted).fill_null(False).to_numpy(zero_copy_only=False))
        r, c = r[is_own][kept] - half, c[is_own][kept] - half
        room = np.rint(_sum(n.astype(float), size))[r, c]
        texts = [b":%d" % p for p in table.column("pixel_id").to_pylist()]
        got = np.empty((len(kept), len(seeds)), np.int32)
        for k, seed in enumerate(seeds):
            head = md5(b"%d" % seed)
            raw = bytearray()
            for text in texts:
                one = head.copy()
                one.update(text)
                raw += one.digest()[:4]
            grid = np.bincount(spot, weights=np.frombuffer(raw, ">u4").astype(float), minlength=high * wide).reshape(high, wide)
            got[:, k] = np.floor(_sum(grid, size)[r, c] / 4294967296.0 / room * 1e9 + 0.5)
        there = np.zeros(mine.num_rows, bool)
        there[kept] = True
        ends = np.concatenate([[0], np.cumsum(there) * len(seeds)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends[:-1].tolist() + [int(ends[-1])], pa.int32()), pa.array(got.ravel()))
        lists = pa.compute.if_else(pa.array(there), lists, pa.scalar(None, lists.type))
        return pa.Table.from_arrays([mine.column(x) for x in names] + [lists], names=[*names, out])

    schema = StructType([*cells.schema.fields, StructField(out, ArrayType(IntegerType()))])
    return every.groupBy("__r", "__c").applyInArrow(run, schema)


def square_variance(cells: DataFrame, value: str, size: int, out: str = "noise", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample variance in the window around every cell, NULLs left out."""
    return focal(cells, value, size, {out: "variance"}, keys)


def window_shares(cells: DataFrame, points: DataFrame, size: int, keys: tuple[str, ...], groups: int = 1, tile: int = TILE) -> DataFrame:
    """(keys, pixel_id, share): the share of points among the cells in the window around every cell that has any.

    Windows follow the cells that are there (see focal).  A task holds one tile's cells and the points of some
    keys in it: the keys are dealt to `groups` groups, so cells are sent once a group, not once a key.
    """
    ship_package(cells.sparkSession)
    half = size // 2
    tile = max(tile, size)
    place = [F.col(c).cast("int").alias(c) for c in ("row_idx", "col_idx")]
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    grid = cells.select(F.col("pixel_id").cast("long").alias("pixel_id"), *place).withColumn("__g", every)
    mine = points.select(*keys, *place).withColumns({"__key": F.xxhash64(*keys), "__g": F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(groups)).cast("int")})
    sent = grid.unionByName(mine, allowMissingColumns=True).withColumn("__r", _tiles("row_idx", half, tile)).withColumn("__c", _tiles("col_idx", half, tile))
    schema = StructType([*(points.schema[k] for k in keys), StructField("pixel_id", LongType()), StructField("share", DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        is_cell = table.column("pixel_id").is_valid()
        held, chosen = table.filter(is_cell), table.filter(pa.compute.invert(is_cell))
        r0, c0 = table.column("__r")[0].as_py() * tile, table.column("__c")[0].as_py() * tile
        at = lambda t: (t.column("row_idx").to_numpy() - r0 + half, t.column("col_idx").to_numpy() - c0 + half)
        r, c = at(held)
        pr, pc = at(chosen)
        out = [chosen.slice(0, 0).select(list(keys))], [], []
        if len(r) and len(pr):
            top, left = int(r.min()), int(c.min())
            high, wide = int(r.max()) - top + 1 + 2 * half, int(c.max()) - left + 1 + 2 * half
            there = np.zeros((high, wide), bool)
            there[r - top + half, c - left + half] = True
            own = (r >= half) & (r < tile + half) & (c >= half) & (c < tile + half)
            ids, r, c = held.column("pixel_id").to_numpy()[own], r[own] - top, c[own] - left
            room = np.rint(_sum(there.astype(float), size, there))[r, c]
            near = (pr >= top) & (pr <= top + high - 1 - 2 * half) & (pc >= left) & (pc <= left + wide - 1 - 2 * half)
            spot = (pr - top + half) * wide + pc - left + half
            _, first, number = np.unique(chosen.column("__key").to_numpy(), return_index=True, return_inverse=True)
            for k, row in enumerate(first):
                n = np.bincount(spot[(number == k) & near], minlength=high * wide).reshape(high, wide)
                n = np.rint(_sum(n.astype(float), size, there))[r, c]
                some = np.flatnonzero(n)
                out[0].append(chosen.select(list(keys)).take(pa.array(np.full(len(some), row))))
                out[1].append(ids[some])
                out[2].append(n[some] / room[some])
        columns = pa.concat_tables(out[0])
        ids, shares = (np.concatenate(v) if v else np.zeros(0) for v in out[1:])
        return columns.append_column("pixel_id", pa.array(ids.astype(np.int64))).append_column("share", pa.array(shares.astype(float)))

    return sent.groupBy("__g", "__r", "__c").applyInArrow(run, schema)


def disc(radius: float, res: float = 1.0) -> list[tuple[int, int]]:
    reach = int(radius // res)
    return [(dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if (dr * dr + dc * dc) * res * res <= radius * radius]


def offset_sum(cells: DataFrame, value: str, offsets: list[tuple[int, int]], out: str = "influence", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over the offsets (equal weights that sum to 1); NULL where the centre or any cell of the window is missing."""
    reach = max((max(abs(r), abs(c)) for r, c in offsets), default=0)
    return focal(cells, value, 2 * reach + 1, {out: list(offsets)}, keys)


def ring(selected: DataFrame, keys: tuple[str, ...] = (), radius: int = 1) -> DataFrame:
    """(keys, row_idx, col_idx) of cells within the radius of a selected one that are not selected."""
    moves = [(r, c) for r, c in disc(radius) if (r, c) != (0, 0)]
    cols = [*keys, "row_idx", "col_idx"]
    step = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in moves))).alias("__o")
    near = selected.select(*cols, step).select(*keys, (F.col("row_idx") + F.col("__o.r")).alias("row_idx"), (F.col("col_idx") + F.col("__o.c")).alias("col_idx"))
    return near.distinct().join(selected.select(*cols), cols, "left_anti")


def block_mean(cells: DataFrame, layers: list[str], factor: int = 2) -> DataFrame:
    row, col = F.floor(F.col("row_idx") / factor).cast("int").alias("row_idx"), F.floor(F.col("col_idx") / factor).cast("int").alias("col_idx")
    return cells.groupBy(row, col).agg(*(F.avg(x).alias(x) for x in layers))
