"""Properties of the grid operators on small literal grids."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators import anomaly, catalog, effects, evolve, focal, pareto, scenario, selection, stats
from gridloom.operators import cells as C
from gridloom.sources import grid as G
from gridloom.sources import results


def _grid(spark, values, extra=None):
    values = np.asarray(values, dtype=object)
    rows = [(int(r * values.shape[1] + c), r, c, values[r, c]) for r in range(values.shape[0]) for c in range(values.shape[1])]
    return spark.createDataFrame(rows, "pixel_id long, row_idx int, col_idx int, v double")


def test_nan_and_infinity(spark):
    row = spark.sql("select double('nan') a, double('inf') b, 1.5D c").select(N.clean(F.col("a")), N.or_zero(F.col("a")), N.or_zero(F.col("b")), N.or_zero(F.col("c"))).first()
    assert tuple(row) == (None, 0.0, 0.0, 1.5)


def test_weight_bounds_and_shapes(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-3, 3, 31)], "a double")
    for shape in ("exponential", "gaussian"):
        got = [r[0] for r in df.select(N.weight(F.col("a"), shape, 0.7)).collect()]
        assert all(0 <= w <= 1 for w in got) and got[15] == 1.0
    with pytest.raises(ValueError):
        N.weight(F.col("a"), "square")


def test_gain_boundary(spark):
    df = spark.createDataFrame([(-0.02,), (-0.005,), (0.0,), (0.3,)], "a double")
    assert [r[0] for r in df.select(effects.gain(F.col("a"), 0.01)).collect()] == [0, 1, 1, 0]


def test_condition_with_missing_value(spark):
    df = spark.createDataFrame([(None,), (1,), (0,)], "d int")
    got = df.select(N.if_else(F.col("d") == 1, F.lit("y"), F.lit("n")), N.if_else(F.col("d") == 1, F.lit("y"), F.lit("n"), "else")).collect()
    assert [tuple(r) for r in got] == [(None, "n"), ("y", "y"), ("n", "n")]


def test_zscore_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("c", 7.0)], "g string, value double")
    assert {r.g for r in anomaly.zscore(df, ["g"]).collect()} == {"a"}
    assert [r.z for r in anomaly.normalise(df, ["g"]).where("g <> 'a'").collect()] == [0.0, 0.0, 0.0]


def test_mosaic_takes_the_first_value(spark):
    a = spark.createDataFrame([(1, None), (2, 2.0)], "pixel_id long, v double")
    b = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "pixel_id long, v double")
    assert sorted(map(tuple, anomaly.mosaic([a, b], "v").collect())) == [(1, 10.0), (2, 2.0), (3, 30.0)]


@pytest.mark.parametrize("size", [3, 5])
def test_square_mean_equals_brute_force(spark, size):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(9, 7)).astype(object)
    v[2, 3] = v[0, 0] = None
    got = {(r.row_idx, r.col_idx): r.focal for r in focal.square_mean(_grid(spark, v), "v", size).collect()}
    h = size // 2
    for r in range(9):
        for c in range(7):
            near = [x for x in v[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1].ravel() if x is not None]
            assert got[r, c] == pytest.approx(sum(near) / len(near))


def test_offset_sum_needs_the_whole_window(spark):
    got = {(r.row_idx, r.col_idx): r.influence for r in focal.offset_sum(_grid(spark, np.ones((4, 4))), "v", focal.disc(1)).collect()}
    assert got[1, 1] == 1.0 and got[0, 0] is None and sum(x is not None for x in got.values()) == 4


def test_ring(spark):
    one = _grid(spark, np.ones((3, 3))).where("pixel_id = 4")
    assert sorted(map(tuple, focal.ring(one).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_reclass_and_classes(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (9.0,), (None,)], "v double")
    assert [r[0] for r in df.select(N.class_of(F.col("v"), [0.0, 1.0, 2.0])).collect()] == [1, 1, 2, None, None]
    assert [r[0] for r in df.select(N.class_of(F.col("v"), [0.0, 1.0, 2.0], include_lowest=False)).collect()] == [None, 1, 2, None, None]
    assert [r[0] for r in df.select(N.class3(F.col("v") - 1, F.lit(0.5))).collect()] == ["3", "2", "2", "1", None]


def test_gain_form_equals_direct_form(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i // 10, i % 10, *map(float, rng.normal(0, 0.02, 3)), float(rng.uniform(1, 9)), bool(i % 7)) for i in range(100)]
    cells = spark.createDataFrame(rows, "pixel_id long, row_idx int, col_idx int, abiotic double, biotic double, landscape double, cost double, eligible boolean")
    e = {"abiotic": 0.01, "biotic": 0.02, "landscape": 0.03}
    plans = spark.createDataFrame([(0, s, int(p)) for s in range(3) for p in rng.choice([i for i in range(100) if i % 7], 12, False)], "scenario_id int, sol_id int, pixel_id long")
    for decay in (0.0, 0.5):
        fast = {r.sol_id: (r.abiotic, r.biotic, r.landscape) for r in effects.objectives(cells, plans, e, "cost", decay=decay).collect()}
        full = effects.restored(cells, plans, e, decay).groupBy("sol_id").agg(*(F.count_if(F.col(x) > 0).alias(x) for x in e)).collect()
        assert fast == {r.sol_id: (-r.abiotic, -r.biotic, -r.landscape) for r in full}


def test_exact_counts(spark):
    cells = spark.range(50).select(F.col("id").alias("pixel_id"), (F.col("id") % 7).cast("double").alias("score"), F.lit(0).alias("sol_id"))
    for chosen in (3, 10, 30):
        got = selection.repair(cells.withColumn("x", (F.col("pixel_id") < chosen).cast("int")), 10, "score").collect()
        assert len(got) == 10 and sum(r.x for r in got) == min(10, chosen)
    for k in (0, 1, 17, 50, 80):
        assert selection.random_subset(spark.range(50).withColumnRenamed("id", "pixel_id"), k, 3).count() == min(k, 50)


@pytest.mark.parametrize("mode", ["equal", "proportional"])
def test_quotas(spark, mode):
    sizes = spark.createDataFrame([(1, 2), (2, 50), (3, 9), (4, 30)], "region_id int, n long")
    for k in (1, 4, 40, 91):
        got = selection.quotas(sizes, k, mode).collect()
        assert sum(r.quota for r in got) == k and all(0 <= r.quota <= r.n for r in got)


def test_pareto_front_and_ranks(spark):
    rows = [(0, 0, 1.0, 5.0), (0, 1, 2.0, 2.0), (0, 2, 2.0, 2.0), (0, 3, 3.0, 3.0), (0, 4, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "scenario_id int, sol_id int, a double, b double")
    assert {r.sol_id for r in pareto.pareto_front(df, ["a", "b"], ("scenario_id",)).collect()} == {0, 1, 2, 4}
    assert {r.sol_id: r.front for r in pareto.ranked_fronts(df, ["a", "b"], 2, ("scenario_id",)).collect()} == {0: 0, 1: 0, 2: 0, 4: 0, 3: 1}
    values = np.array([r[2:] for r in rows])
    front, distance = evolve.front_and_crowding(values)
    assert front.tolist() == [0, 0, 0, 1, 0] and np.isinf(distance[[0, 4]]).all()
    best = {r.sol_id: r.best_in for r in pareto.champions(df, ["a", "b"], ("scenario_id",)).collect()}
    assert best == {0: "a", 4: "b"}


def test_polygon_membership(spark):
    cells = _grid(spark, np.ones((6, 6))).withColumns({"x": F.col("col_idx") + 0.5, "y": F.col("row_idx") + 0.5})
    edges = C.polygon_edges(spark, {"L": [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 5.0), (0.0, 5.0)]})
    got = {r.pixel_id for r in C.polygon_mask(cells, edges, "L").collect()}
    assert got == {6 * r + c for r in range(6) for c in range(6) if (r < 2 and c < 4) or (r < 5 and c < 2)}


def test_statistics():
    assert stats.t_p_value(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1.0)
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-10)


def test_natural_breaks(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 10, 11, 30, 31, 33, 60, 90, 91]], "v double")
    assert stats.natural_breaks(df, "v", 5) == [1.0, 2.0, 11.0, 33.0, 60.0, 91.0]
    many = spark.range(5000).select((F.col("id") % 5 * 100 + F.col("id") / 5000).alias("v"))
    assert len(stats.natural_breaks(many, "v", 5, most=500)) == 6


def _dense_breaks(counts: dict, classes: int) -> tuple[list[float], float]:
    """Bounds and within-class sum of squares by the plain dynamic programme."""
    x = sorted(counts)
    m, mean = len(x), sum(v * counts[v] for v in x) / sum(counts.values())
    s = np.cumsum([[0, 0, 0], *([counts[v], counts[v] * (v - mean), counts[v] * (v - mean) ** 2] for v in x)], axis=0)
    best, starts = np.r_[0, np.full(m, np.inf)], []
    for _ in range(classes):
        new, at = np.full(m + 1, np.inf), [0] * (m + 1)
        for j in range(1, m + 1):
            d = s[j] - s[:j]
            cost = best[:j] + d[:, 2] - d[:, 1] ** 2 / d[:, 0]
            at[j] = int(np.argmin(cost))
            new[j] = cost[at[j]]
        best = new
        starts.append(at)
    ends, j = [], m
    for at in reversed(starts):
        ends.append(x[j - 1])
        j = at[j]
    return [x[0], *reversed(ends)], best[m]


def test_natural_breaks_are_exact_over_many_values(spark):
    # Three extreme values are a class each; the rest are cut in the middle.
    values = [*map(float, range(3000)), 1e6, 2e6, 3e6]
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert stats.natural_breaks(df, "v", 5) == [0.0, 1499.0, 2999.0, 1e6, 2e6, 3e6]
    rng = np.random.default_rng(7)
    for size, draw in ((2500, rng.lognormal(3, 1.5, 9000)), (400, rng.normal(0, 1, 3000)), (7, rng.normal(0, 1, 40))):
        pool = draw[:size]
        held = collections.Counter(rng.choice(pool, 4000).tolist())
        df = spark.createDataFrame(list(held.elements()), "double").toDF("v")
        assert stats.natural_breaks(df, "v", 5) == _dense_breaks(held, 5)[0]


def test_fisher_breaks_takes_values_as_they_are(spark):
    from gridloom import catalogue
    from gridloom.plans.adapter import cells

    sf = "/root/testdata/sf0.001"
    held = collections.Counter(r.smd for r in cells(spark, sf).select("smd").collect() if r.smd is not None)
    got = [r.bound for r in catalogue.queries()["fisher_breaks"](spark, sf).orderBy("i").collect()]
    assert got == _dense_breaks(held, 5)[0]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(stats.corr("a", "b")).first()[0] is None


def test_errors(spark):
    cells = _grid(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        catalog.codes_of("ocean")
    with pytest.raises(KeyError, match="p.*q"):
        G.scan_layers(cells, ["p", "v", "q"])
    assert "v" in G.scan_layers(cells, ["p", "v"], tolerant=True).columns
    with pytest.raises(IndexError):
        scenario.scenario_by_index(scenario.scenario_grid(spark), 36)
    with pytest.raises(ValueError):
        G.check_geometry(cells, G.GridSpec(2, 3))
    G.check_geometry(cells, G.GridSpec(2, 2))
    assert catalog.region_reference("nowhere") is None
    with pytest.raises(FileNotFoundError):
        G.first_existing(spark, ["/nowhere/a.parquet"])


def test_rectangle_sample_falls_back(spark):
    cells = _grid(spark, np.ones((10, 10)))
    assert C.rectangle_sample(cells, 0.25, (0, 0)).count() == 25
    assert C.rectangle_sample(cells.where("row_idx in (0, 9)"), 0.04, (4, 4)).count() == 20
    assert C.rectangle_sample(cells, 0.25, seed=3).count() == 25


def test_result_round_trip(spark, tmp_path):
    decision = spark.createDataFrame([(0, 0, 5), (1, 0, 6)], "scenario_id int, sol_id int, pixel_id long")
    objective = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "scenario_id int, sol_id int, a double")
    results.save_run(decision, objective, scenario.scenario_grid(spark, n=2), str(tmp_path / "run"))
    back = results.load_run(spark, str(tmp_path / "run"))
    assert back["decision"].count() == 2 and back["scenario"].count() == 16
    with pytest.raises(Exception, match="(?i)exist"):
        results.save_run(decision, objective, scenario.scenario_grid(spark, n=2), str(tmp_path / "run"))


def test_extent_predicate_reaches_the_scan(spark, tmp_path):
    _grid(spark, np.ones((4, 4))).withColumns({"x": F.col("col_idx") * 1.0, "y": F.col("row_idx") * 1.0}).write.parquet(str(tmp_path / "g"))
    plan = G.crop(spark.read.parquet(str(tmp_path / "g")), (0, 1, 0, 1)).select("pixel_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThanOrEqual(x" in plan and "v:" not in plan.split("ReadSchema")[1]


def grid_cells(spark, n=400, columns=20):
    return spark.range(n).selectExpr(
        "id AS pixel_id", f"CAST(id div {columns} AS int) AS row_idx", f"CAST(id % {columns} AS int) AS col_idx", "CAST(id % 7 AS int) AS region_id", "true AS eligible",
        "sin(id) AS abiotic", "cos(id * 1.3) AS biotic", "sin(id * 0.7 + 1) AS landscape", "100.0 + id % 13 AS implementation_cost",
    )


def test_first_by_equals_a_sort(spark):
    from gridloom.operators.selection import best_by, first_by, quantile_by

    rng = np.random.default_rng(3)
    rows = [(int(k), i, float(v), int(rng.integers(0, 2))) for k in range(3) for i, v in enumerate(np.round(rng.random(300) ** 3, 2))] + [(0, 900, None, 0), (1, 901, None, 1)]
    df = spark.createDataFrame(rows, "sol_id int, pixel_id int, score double, x int").repartition(3)
    for ranges in (1, 7, 256):
        for k in (0, 1, 50, 299, 1000):
            got = {(r.sol_id, r.pixel_id) for r in best_by(df, k, "score", ("sol_id",), ranges, "x").collect()}
            want = set()
            for key in range(3):
                mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[3], -(r[2] if r[2] is not None else min(v for _, _, v, _ in rows if v is not None)), r[1]))
                want |= {(key, r[1]) for r in mine[:k]}
            assert got == want
        flagged = first_by(df.where("score is not null"), 10, F.col("score"), ["score", "pixel_id"], ("sol_id",), ranges, "first").collect()
        assert len(flagged) == 900 and sum(r["first"] for r in flagged) == 30
        cuts = {r.sol_id: r.cut for r in quantile_by(df, "score", 0.8, ("sol_id",), 40 * ranges).collect()}
        for key in range(3):
            assert cuts[key] == pytest.approx(np.quantile([r[2] for r in rows if r[0] == key and r[2] is not None], 0.8), abs=1e-12)


def test_repairs_give_exact_counts(spark):
    from gridloom.operators.selection import burden_repair, clustering_repair, random_repair

    cells = grid_cells(spark)
    plans = cells.crossJoin(spark.range(3).selectExpr("CAST(id AS int) AS sol_id")).withColumn("x", (F.col("pixel_id") % (F.col("sol_id") * 6 + 2) == 0).cast("int"))
    for out in (random_repair(plans, 40, 1), burden_repair(plans, 40, 1), clustering_repair(plans, 40, 0.3)):
        assert {r["count"] for r in out.groupBy("sol_id").count().collect()} == {40}
    shares = burden_repair(plans, 40, 1).groupBy("sol_id", "region_id").count().collect()
    assert {r["count"] for r in shares} == {5, 10}
    kept = random_repair(plans, 40, 1).groupBy("sol_id").agg(F.sum("x").alias("x"), F.count("*").alias("n")).collect()
    had = {r.sol_id: r.x for r in plans.groupBy("sol_id").agg(F.sum("x").alias("x")).collect()}
    assert all(r.x == min(had[r.sol_id], 40) for r in kept)


def test_exact_needs_no_more_than_the_best_cells(spark):
    cells = grid_cells(spark).withColumn("score", F.sin(F.col("pixel_id") * 3.0))
    score = {r.pixel_id: r.score for r in cells.collect()}
    sparse = [(0, 0, p) for p in range(0, 400, 3)] + [(0, 1, p) for p in range(5)] + [(1, 0, p) for p in range(100, 160)]
    decision = spark.createDataFrame(sparse, "scenario_id int, sol_id int, pixel_id long")
    settings = spark.createDataFrame([(0, 30), (1, 60)], "scenario_id int, k long")
    everyone = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0)], "scenario_id int, sol_id int")
    got = {}
    for r in evolve.exact(decision, cells, settings, "score", everyone).collect():
        got.setdefault((r.scenario_id, r.sol_id), set()).add(r.pixel_id)
    for (s, i), k in {(0, 0): 30, (0, 1): 30, (0, 2): 30, (1, 0): 60}.items():
        own = {p for a, b, p in sparse if (a, b) == (s, i)}
        order = sorted(score, key=lambda p: (p not in own, -score[p], p))
        assert got[s, i] == set(order[:k])


def test_objectives_of_plans_without_eligible_cells(spark):
    from gridloom.operators.effects import objectives

    cells = grid_cells(spark, 40).withColumn("eligible", F.col("pixel_id") >= 10)
    decision = spark.createDataFrame([(0, 0, 3), (0, 1, 12), (0, 1, 13)], "scenario_id int, sol_id int, pixel_id long")
    everyone = spark.createDataFrame([(0, i) for i in range(3)], "scenario_id int, sol_id int")
    out = {r.sol_id: r for r in objectives(cells, decision, {"abiotic": 0.5}, "implementation_cost", solutions=everyone, k=2).collect()}
    base = -cells.where("abiotic > 0").count()
    assert {i: (r.n_selected, r.violation) for i, r in out.items()} == {0: (0, 2), 1: (2, 0), 2: (0, 2)}
    assert out[0].abiotic == out[2].abiotic == base and out[1].implementation_cost == 212.0
    assert {r.sol_id for r in objectives(cells, decision, {"abiotic": 0.5}).collect()} == {0, 1}


def test_survivors_equal_a_plain_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(s, i, *map(float, rng.integers(0, 6, 3))) for s in range(2) for i in range(24)]
    points = spark.createDataFrame(rows, "scenario_id int, sol_id int, a double, b double, c double")
    got = {(r.scenario_id, r.sol_id): r.place for r in evolve.survive(points, ["a", "b", "c"], 10).collect()}
    for s in range(2):
        mine = [r for r in rows if r[0] == s]
        front, left, rank = {}, list(mine), 0
        while left:
            now = [p for p in left if not any(all(x <= y for x, y in zip(q[2:], p[2:])) and q[2:] != p[2:] for q in left)]
            front |= {p[1]: rank for p in now}
            left, rank = [p for p in left if p not in now], rank + 1
        kept = sorted((i for k, i in got if k == s), key=lambda i: got[s, i])
        assert len(kept) == 10 and [front[i] for i in kept] == sorted(front[i] for i in kept)
        assert max(front[i] for i in kept) <= min(front[i] for _, i, *_ in mine if i not in kept)


def test_search_follows_its_scenarios(spark):
    names = "scenario_id int, max_restoration_fraction double, spatial_clustering double, burden_sharing string, abiotic_effect double, biotic_effect double, landscape_effect double, anomaly_weight_shape string, anomaly_weight_scale double"
    rows = [
        (0, 0.05, 0.0, "no", 0.1, 0.1, 0.1, "exponential", 1.0), (1, 0.1, 0.0, "yes", 0.1, 0.1, 0.1, "gaussian", 0.5),
        (2, 0.2, 0.3, "no", 0.1, 0.1, 0.1, "exponential", 1.0), (3, 0.15, 0.3, "yes", 0.4, 0.1, 0.1, "exponential", 1.0),
    ]
    cells, told = grid_cells(spark), []
    effects = {x: f"{x}_effect" for x in ("abiotic", "biotic", "landscape")}
    decision, front = evolve.search(cells, spark.createDataFrame(rows, names), effects, "implementation_cost", population=4, generations=2, callback=lambda g, p: told.append((g, p.count())))
    found = front.collect()
    assert {r.scenario_id: r.n_selected for r in found} == {0: 20, 1: 40, 2: 80, 3: 60} and all(r.violation == 0 for r in found)
    assert told == [(0, 32), (1, 32)]
    sizes = decision.groupBy("scenario_id", "sol_id").agg(F.count("*").alias("n"), F.countDistinct("pixel_id").alias("d")).collect()
    assert {(r.scenario_id, r.n, r.d) for r in sizes} == {(0, 20, 20), (1, 40, 40), (2, 80, 80), (3, 60, 60)}
    shares = decision.where("scenario_id = 1").join(cells, "pixel_id").groupBy("sol_id", "region_id").count().collect()
    assert {r["count"] for r in shares} == {5, 10}


def test_scans_name_what_is_wrong(spark):
    from gridloom.sources.grid import scan_indicators, scan_objectives

    cells = grid_cells(spark, 4).withColumn("tsd", F.when(F.col("pixel_id") == 1, -128.0).otherwise(2.0))
    with pytest.raises(ValueError, match="unknown objectives.*forest"):
        scan_objectives(cells, ["forest"])
    with pytest.raises(KeyError, match="abiotic_anomaly.*population_proximity"):
        scan_objectives(cells)
    held = scan_indicators(cells)
    assert held.columns == ["pixel_id", "row_idx", "col_idx", "tsd"] and held.where("tsd is null").count() == 1


def test_plans_read_the_grid_once(spark):
    """No query on anomalies scans line items in its final plan, no polygon query multiplies cells with edges."""
    from gridloom import catalogue

    plan = lambda name: catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    for name in ("pareto_front", "objective_eval", "selection_frequency", "dv_smoothed", "repair_add_drop"):
        text = plan(name)
        assert text.count("lineitem.parquet") == 0 and "CartesianProduct" not in text, name
    for name in ("polygon_mask", "polygon_clip", "region_ecosystem_mask"):
        text = plan(name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text.split("== Physical Plan ==")[1], name


def test_percent_improvement(spark):
    from gridloom.functions.numeric import percent_improvement

    row = spark.sql("select -50.0D a, -60.0D b, 0.0D z").select(percent_improvement(F.col("a"), F.col("b"), True), percent_improvement(F.col("a"), F.col("b")), percent_improvement(F.col("z"), F.col("b"))).first()
    assert row[0] == pytest.approx(20.0) and row[1] == pytest.approx(-20.0) and row[2] == 0.0


def test_progress_tells_the_time_left():
    said, now = [], iter([0.0, 10.0, 30.0])
    told = evolve.progress_log(3, said.append, lambda: next(now))
    told(0, None)
    told(1, None)
    assert said == ["generation 1 of 3, 10 s, about 20 s left", "generation 2 of 3, 30 s, about 15 s left"]


def test_run_paths_are_claimed_once(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 2, 9)
    got = [results.run_path(spark, str(tmp_path), day, e) for e in ("all", "all", "forest", "all")]
    assert [g.rsplit("/", 1)[1] for g in got] == ["results_0902_1", "results_0902_2", "results_forest_0902_1", "results_0902_3"]


def test_layers_by_prefix():
    names = ["smd_anom_forest", "smdx_anom_forest", "soc_anom_grassland", "smd_anom_grassland", "smd_raw"]
    assert catalog.layers_of(names, ["soc", "smd", "none"]) == ["soc_anom_grassland", "smd_anom_forest", "smd_anom_grassland"]


@pytest.mark.parametrize("block", [5, 40, 2000])
def test_fronts_in_blocks_equal_all_pairs(spark, block):
    rng = np.random.default_rng(12)
    rows = [(int(k), i, *map(float, rng.integers(0, 25, 3))) for k in range(2) for i in range(150)]
    df = spark.createDataFrame(rows, "scenario_id int, sol_id int, a double, b double, c double").repartition(3)
    beats = lambda q, p: q[2:] != p[2:] and all(x <= y for x, y in zip(q[2:], p[2:]))
    by_key = {(p[0], p[1]) for p in rows if not any(q[0] == p[0] and beats(q, p) for q in rows)}
    assert {(r.scenario_id, r.sol_id) for r in pareto.pareto_front(df, ["a", "b", "c"], ("scenario_id",), block).collect()} == by_key
    overall = {(p[0], p[1]) for p in rows if not any(beats(q, p) for q in rows)}
    assert {(r.scenario_id, r.sol_id) for r in pareto.pareto_front(df, ["a", "b", "c"], (), block).collect()} == overall
