"""First k under skew, windows over tiles, sparse clustering and quotas, quantiles, skip sampling."""

from __future__ import annotations

import collections
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.numeric import ordered_bits
from gridloom.operators import evolve, focal, quantiles, selection


def test_ordered_bits_are_the_bits(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 1.0, -1.0, 2.0**-1022, 2.0**-1074, 5e-324, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None, 0.1, 1 - 2**-53, 1 + 2**-52]
    values += rng.normal(size=300).tolist() + (rng.normal(size=300) * 10.0 ** rng.integers(-320, 300, 300)).tolist() + [2.0**k for k in range(-1074, 1024, 7)] + [np.nextafter(2.0**k, 0) for k in range(-1020, 1024, 9)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.b for r in df.select("i", ordered_bits(F.col("v")).alias("b")).collect()}
    for i, v in enumerate(values):
        if v is None or math.isnan(v):
            assert got[i] is None
        else:
            bits = struct.unpack("<q", struct.pack("<d", abs(float(v))))[0]
            assert got[i] == (-bits if v < 0 else bits), v


@pytest.mark.parametrize("kind", ["outlier", "ties", "both", "tiny"])
def test_skewed_scores_leave_few_cells_to_rank(spark, kind, monkeypatch):
    rng = np.random.default_rng(4)
    score = rng.random(20_000)
    if kind == "outlier":
        score[7] = 1e18
    if kind == "ties":
        score = np.floor(score * 9) / 9
    if kind == "both":
        score[:15_000], score[19_999] = 0.25, -1e300
    if kind == "tiny":
        score = 2.0 ** -rng.integers(0, 1000, 20_000).astype(float)
    rows = [(i % 2, i, float(s)) for i, s in enumerate(score)]
    df = spark.createDataFrame(rows, "sol_id int, pixel_id long, score double").repartition(4).persist()
    seen = []
    kept = selection.stored
    monkeypatch.setattr(selection, "stored", lambda d, name: seen.append(kept(d, name)) or seen[-1])
    for k in (1, 3000, 9_999):
        monkeypatch.setattr(selection, "RANKED", 100)
        seen.clear()
        got = collections.defaultdict(set)
        out = selection.first_by(df, k, F.lit(0.0), [-F.col("score"), F.col("pixel_id")], ("sol_id",), ranked=100)
        for r in out.collect():
            got[r.sol_id].add(r.pixel_id)
        for key in (0, 1):
            assert got[key] == set(sorted((i for s, i, _ in rows if s == key), key=lambda i: (-score[i], i))[:k])
        last = seen[-1].collect()
        assert len(last) == 2 and all(r["__n"] <= 100 for r in last)
    df.unpersist()


def brute_focal(grid, size, f):
    h, out = size // 2, {}
    for (r, c) in grid:
        near = [grid[p] for p in ((r + a, c + b) for a in range(-h, h + 1) for b in range(-h, h + 1)) if grid.get(p) is not None]
        out[r, c] = f(near) if near else None
    return out


@pytest.mark.parametrize("size, tile", [(3, 4), (5, 8), (15, 16)])
def test_reducers_over_tiles_with_absent_cells(spark, size, tile):
    rng = np.random.default_rng(size)
    grid = {(r, c): None if rng.random() < 0.1 else float(np.round(rng.normal() * 50, 3)) for r in range(-9, 23) for c in range(5, 31) if rng.random() < 0.8}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in grid.items()], "row_idx int, col_idx int, v double, kept string").repartition(3)
    reducers = {"n": "count", "s": "sum", "m": "mean", "var": "variance", "hi": "max", "lo": "min", "med": lambda w: np.nanmedian(w, axis=1)}
    rows = {(r.row_idx, r.col_idx): r for r in focal.focal(df, "v", size, reducers, tile=tile).collect()}
    assert len(rows) == len(grid) and {r.kept for r in rows.values()} == {"x"}
    plain = {"n": len, "s": sum, "m": np.mean, "hi": max, "lo": min, "med": np.median, "var": lambda v: np.var(v, ddof=1) if len(v) > 1 else None}
    for name, f in plain.items():
        for place, want in brute_focal(grid, size, f).items():
            got = rows[place][name]
            if name == "n":
                assert got == (want or 0)
            else:
                assert got is None if want is None else got == pytest.approx(want, abs=1e-8), (name, place)
    assert focal.focal(df, "v", size, {"m": "mean"})._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError, match="unknown reducers"):
        focal.focal(df, "v", 3, {"x": "mode"})


def plans_of(spark, n=900, cols=30):
    cells = spark.range(n).where("id % 11 <> 4").selectExpr("id AS pixel_id", f"CAST(id div {cols} AS int) AS row_idx", f"CAST(id % {cols} AS int) AS col_idx", "CAST(id % 5 AS int) AS region_id").persist()
    solutions = spark.range(4).selectExpr("CAST(id AS int) AS sol_id")
    wanted = solutions.withColumn("k", F.element_at(F.array(F.lit(60), F.lit(200), F.lit(5), F.lit(700)), F.col("sol_id") + 1).cast("long"))
    plans = cells.crossJoin(solutions).where("pixel_id % (sol_id * 40 + 7) = 0 and sol_id < 3").select("sol_id", "pixel_id").persist()
    return cells, wanted, plans


@pytest.mark.parametrize("strength", [0.0, 0.3, 0.6])
def test_sparse_clustering_equals_the_dense_one(spark, strength, monkeypatch):
    cells, wanted, plans = plans_of(spark)
    monkeypatch.setattr(selection, "_PLANS", 3)
    pairs = lambda df: sorted((r.sol_id, r.pixel_id) for r in df.collect())
    held = selection.dense(cells, plans, wanted)
    want = pairs(selection.clustering_repair(held, F.col("k"), strength))
    assert pairs(selection.clustered(cells, plans, wanted, strength, F.col("sol_id"))) == want
    assert collections.Counter(s for s, _ in want) == {0: 60, 1: 200, 2: 5, 3: 700}


def test_sparse_quotas_equal_the_dense_ones(spark):
    cells, wanted, plans = plans_of(spark)
    pairs = lambda df: sorted((r.sol_id, r.pixel_id) for r in df.collect())
    want = pairs(selection.burden_repair(selection.dense(cells, plans, wanted), F.col("k"), 3))
    assert pairs(selection.burdened(cells, plans, wanted, 3)) == want


@pytest.mark.parametrize("ranked", [1, 50, 100_000])
def test_quantiles_of_any_numbers(spark, ranked):
    rng = np.random.default_rng(2)
    values = {0: rng.normal(size=999) * 1e6, 1: np.round(rng.random(500), 1), 2: 10.0 ** rng.integers(-300, 300, 400), 3: np.array([-5.0]), 4: np.array([-1e308, 1e308, 0.0, -0.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [(0, None), (1, math.nan), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in quantiles.quantiles(df, "v", shares, ("g",), ranked).collect()}
    assert len(got) == 25
    for k, v in values.items():
        v = np.sort(v)
        for p in shares:
            at = (len(v) - 1) * p
            want = float(v[math.floor(at)]) * (1 - at % 1) + float(v[math.ceil(at)]) * (at % 1)
            assert got[k, p] == pytest.approx(want, rel=1e-12, abs=0), (k, p)
    one = quantiles.quantiles(df.where("g = 0"), "v", [0.5]).collect()
    assert len(one) == 1 and one[0].q == pytest.approx(np.median(values[0]))
    assert quantiles.quantiles(df.where("false"), "v", [0.5]).count() == 0


def test_skips_hit_as_often_as_draws(spark):
    cells = spark.range(200_000).where("id % 10 <> 3").withColumnRenamed("id", "pixel_id")
    who = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "scenario_id int, sol_id int")
    for p in (0.0005, 0.02, 0.5, 0.9):
        hits = evolve.skipped(cells, who, p, 5)
        n = {(r[0], r[1]): r[2] for r in hits.groupBy("scenario_id", "sol_id").count().collect()}
        assert len(n) == 3 and all(abs(v - 180_000 * p) < 6 * math.sqrt(180_000 * p * (1 - p)) + 1 for v in n.values())
        assert hits.distinct().count() == sum(n.values()) and hits.where("pixel_id % 10 = 3").count() == 0
    assert evolve.skipped(cells, who, 0.0, 5).count() == 0 and evolve.skipped(cells.limit(0), who, 0.5, 5).count() == 0
    plan = evolve.skipped(cells, who, 0.02, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan or "pixel_id" not in plan.split("Join Cross")[1].split("\n")[0]


def test_a_known_bound_gives_the_same_cells_without_a_job(spark):
    cells = spark.range(300).selectExpr("id AS pixel_id", "CAST(id div 20 AS int) AS row_idx", "CAST(id % 20 AS int) AS col_idx", "CAST(id % 5 AS int) AS region_id", "IF(id % 11 = 0, NULL, sin(id)) AS score")
    plans = cells.crossJoin(spark.range(3).selectExpr("CAST(id AS int) AS sol_id")).withColumn("x", (F.col("pixel_id") % (F.col("sol_id") + 3) == 0).cast("int"))
    chosen = plans.where("x = 1").select("sol_id", "pixel_id")
    wanted = spark.createDataFrame([(0, 40), (1, 75), (2, 290)], "sol_id int, k long")
    pairs = lambda df: {(r.sol_id, r.pixel_id) for r in df.collect()}
    assert pairs(selection.burdened(cells, chosen, wanted, 3, most=300)) == pairs(selection.burdened(cells, chosen, wanted, 3))
    assert pairs(selection.clustered(cells, chosen, wanted, 0.3, F.col("sol_id"), most=300)) == pairs(selection.clustered(cells, chosen, wanted, 0.3, F.col("sol_id")))
    spark.sparkContext.setJobGroup("known", "")
    try:
        lazy = [
            (selection.best_by(plans, 60, "score", ("sol_id",), chosen="x", most=300), selection.best_by(plans, 60, "score", ("sol_id",), chosen="x")),
            (selection.random_subset(plans, 60, 5, ("sol_id",), most=300), selection.random_subset(plans, 60, 5, ("sol_id",), ranked=50)),
            (selection.random_repair(plans, 60, 5, most=300), selection.random_repair(plans, 60, 5)),
        ]
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("known"))
        selection.best_by(plans, 60, "score", ("sol_id",), chosen="x", most=300)
        selection.random_subset(plans, 60, 5, ("sol_id",), most=300)
        selection.random_repair(plans, 60, 5, most=300)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("known")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for got, want in lazy:
        assert pairs(got) == pairs(want)


def test_plans_over_many_cells_write_no_grid_a_plan(spark, monkeypatch):
    """Starts, shares and clusters of a grid too large to be ranked: the same plans as by windows, from few rows."""
    n, keys = 20_000, ("scenario_id", "sol_id")
    cells = spark.range(n).selectExpr(
        "id AS pixel_id", "CAST(id div 100 AS int) AS row_idx", "CAST(id % 100 AS int) AS col_idx", "CAST(CASE WHEN id % 7 < 6 THEN id % 5 END AS int) AS region_id"
    ).persist()
    wanted = spark.range(6).selectExpr("CAST(id % 2 AS int) AS scenario_id", "CAST(id AS int) AS sol_id", "1000 + 100 * id AS k").persist()
    over = cells.where("region_id < 2").crossJoin(wanted.select(*keys)).where("pixel_id % 4 = 0").select(*keys, "pixel_id").persist()  # too many in two regions

    def plans():
        starts = selection.random_starts(cells, wanted, F.col("k"), 3, keys, n)
        held = starts.where("sol_id < 4").unionByName(over.where("sol_id >= 4"))
        shared = selection.burdened(cells, held, wanted, 5, keys, most=n)
        close = selection.clustered(cells, held, wanted, 0.3, F.col("sol_id"), keys, n)
        return [sorted(map(tuple, df.select(*keys, "pixel_id").collect())) for df in (starts, shared, close)]

    ranked, written, real = plans(), {}, selection.stored

    def told(df, kind="table", **more):
        back = real(df, kind, **more)
        written[kind] = max(written.get(kind, 0), back.count())
        return back

    monkeypatch.setattr(selection, "KNOWN", 1000)
    monkeypatch.setattr(selection, "RANKED", 1000)
    monkeypatch.setattr(selection, "stored", told)
    assert plans() == ranked
    assert len(ranked[2]) == 7500
    assert "shares" not in written and "scored" not in written and written["draws"] < n, written
