"""First cells by random draws: against plain sorting, one pass over the cells, odd draws."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridloom.functions.numeric import draw, ordered_bits
from gridloom.operators import selection


def _number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def _plans(spark, n=4000, keys=3):
    return spark.range(n).withColumnRenamed("id", "pixel_id").crossJoin(spark.range(keys).select(F.col("id").cast("int").alias("sol_id")))


@pytest.mark.parametrize("k", [0, 1, 400, 3999, 4000, 9000])
def test_first_drawn_is_the_sorted_head(spark, k):
    found = selection.random_subset(_plans(spark), k, F.col("sol_id"), ("sol_id",), ranked=50)
    wanted = {(s, p) for s in range(3) for _, p in sorted((_number(s, p), p) for p in range(4000))[:k]}
    assert sorted(map(tuple, found.select("sol_id", "pixel_id").collect())) == sorted(wanted)


def test_draws_are_made_in_one_pass(spark):
    """What is returned reads written draws, however often it is read."""
    found = selection.random_subset(_plans(spark), 400, F.col("sol_id"), ("sol_id",), ranked=50)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_uneven_draws_are_taken_exactly(spark):
    held = _plans(spark, 3000, 2)
    odd = F.when(F.col("pixel_id") < 2500, F.lit(5)).otherwise(F.col("pixel_id")).cast("long")
    for k in (10, 2499, 2600):
        found = selection.first_drawn(held, k, odd, ("sol_id",), ranked=50).select("sol_id", "pixel_id").collect()
        assert sorted(map(tuple, found)) == [(s, p) for s in range(2) for p in range(k)]
    flagged = selection.first_drawn(held, 1200, draw(3, F.col("pixel_id")), ("sol_id",), flag="first", ranked=50).collect()
    head = {p for _, p in sorted((_number(3, p), p) for p in range(3000))[:1200]}
    assert len(flagged) == 6000 and all(r["first"] == (r["pixel_id"] in head) for r in flagged)


def test_random_repair_of_many_cells(spark):
    held = _plans(spark).withColumn("x", (F.col("pixel_id") % 10 < F.col("sol_id") + 1).cast("int"))  # 400, 800 and 1,200 chosen
    got = selection.random_repair(held, 800, 7).select("sol_id", "pixel_id", "x").collect()
    wanted = []
    for s in range(3):
        order = sorted((1 - (p % 10 < s + 1), _number(7, s, p), p) for p in range(4000))[:800]
        wanted += [(s, p, 1 - no) for no, _, p in order]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_bits_of_doubles_rise(spark):
    values = [float("-inf"), -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf")]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").select(ordered_bits(F.col("v")).alias("b")).collect()
    bits = [r["b"] for r in rows]
    assert bits[:11] == sorted(bits[:11]) and bits[4] == bits[5] == 0 and bits[11:] == [None, None] and len(set(bits[:11])) == 10


def test_noise_of_all_layers_takes_a_row_a_cell(spark):
    """Smoothed noise, cell by cell, against brute force; tiles of 8 cells, holes, and cells outside the area."""
    from gridloom.operators.focal import smoothed_draws

    cells = [(r * 20 + c, r, c, (r + c) % 3 != 0) for r in range(23) for c in range(20) if (r * 7 + c) % 11]
    df = spark.createDataFrame(cells, "pixel_id long, row_idx int, col_idx int, wanted boolean")
    seeds = [4, 9]
    got = smoothed_draws(df, seeds, 3, "wanted", "noise", tile=8).collect()
    at = {(r, c): p for p, r, c, _ in cells}
    assert len(got) == len(cells)
    for row in got:
        if not row["wanted"]:
            assert row["noise"] is None
            continue
        near = [at[q] for q in ((row["row_idx"] + a, row["col_idx"] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in at]
        assert row["noise"] == [int(sum(_number(s, p) for p in near) / 2**32 / len(near) * 1e9 + 0.5) for s in seeds]


def test_offset_means_go_by_tiles(spark):
    """No join, and no row an offset: one exchange, whatever the number of offsets."""
    from gridloom.operators.focal import disc, focal, offset_sum

    cells = [(r, c, None if (r * 5 + c) % 13 == 0 else float(r * c % 7)) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(cells, "row_idx int, col_idx int, v double")
    assert "Join" not in offset_sum(df, "v", disc(2.0))._jdf.queryExecution().optimizedPlan().toString()
    known = {(r, c): v for r, c, v in cells}
    for row in focal(df, "v", 5, {"m": disc(2.0)}, tile=8).collect():
        near = [known.get((row["row_idx"] + a, row["col_idx"] + b)) for a, b in disc(2.0)]
        wanted = None if row["v"] is None or None in near else sum(near) / len(near)
        assert (row["m"] is None) == (wanted is None) and (wanted is None or abs(row["m"] - wanted) < 1e-12)


def test_windows_of_a_repair_are_taken_once(spark):
    held = _plans(spark, 400, 2).withColumns({"row_idx": (F.col("pixel_id") / 20).cast("int"), "col_idx": (F.col("pixel_id") % 20).cast("int"), "x": (F.col("pixel_id") % 7 == 0).cast("int")})
    found = selection.clustering_repair(held, 50, 0.3)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 100


def test_draws_of_arrays_are_those_of_columns():
    """Numbers of every length, negative and missing ones, seeds of any length, texts of more than a block."""
    import pyarrow as pa

    from gridloom.functions.draws import Texts

    numbers = [0, 7, 10, 99, 100, -5, None, 123456, 10**9, 2**63 - 1, -(2**63)]
    for seed in ("", "3", "41:start:7", "s" * 50, "t" * 70):
        wanted = [_number(seed) if n is None else _number(seed, n) for n in numbers]
        assert Texts(pa.array(numbers, pa.int64())).draws(seed).tolist() == wanted
    assert Texts(pa.array([5, 6, 7], pa.int64()).slice(1)).draws("1").tolist() == [_number(1, 6), _number(1, 7)]


@pytest.mark.parametrize("k", [0, 400, 3999, 9000])
def test_plans_draw_their_cells_together(spark, k):
    """Rows are cells, not cells x solutions, until they are drawn; regions have their own k."""
    cells = spark.range(4000).select(F.col("id").alias("pixel_id"), (F.col("id") % 2).alias("region_id"), (F.lit(k) + F.col("id") % 2).alias("k"))
    solutions = spark.range(3).select(F.col("id").cast("int").alias("sol_id"))
    draws = selection._low_draws(cells.select("pixel_id", F.lit(2**32).alias("__high")), solutions)
    assert "Join" not in draws._jdf.queryExecution().optimizedPlan().toString() and draws.count() == 12000
    found = selection.random_plans(cells, solutions, k, ranked=50)
    assert found.columns == ["sol_id", "pixel_id"] and found.schema["sol_id"].dataType.simpleString() == "int"
    wanted = {(s, p) for s in range(3) for _, p in sorted((_number(s, p), p) for p in range(4000))[:k]}
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    found = selection.random_plans(cells, solutions, F.col("k"), ("region_id",), ranked=50)
    wanted = {(s, r, p) for s in range(3) for r in range(2) for _, p in sorted((_number(s, p), p) for p in range(r, 4000, 2))[: k + r]}
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


SF = "/root/testdata/sf0.001"


def test_maps_of_a_strength_are_clustered_together(spark, monkeypatch):
    """Eight maps of four strengths, of which 0 needs no clustering."""
    from gridloom.plans import workflow_queries

    calls, real = [], selection.clustered
    monkeypatch.setattr(selection, "clustered", lambda *a, **k: calls.append(a[3]) or real(*a, **k))
    assert workflow_queries.parameter_illustration(spark, SF).select("map_id").distinct().count() == 8
    assert sorted(calls) == [0.3, 0.6, 1.0]


def test_candidates_of_a_start_are_written_once(spark, monkeypatch):
    from gridloom.plans import workflow_queries

    seen, real = [], selection.burden_repair
    monkeypatch.setattr(selection, "burden_repair", lambda held, *a: seen.append(held) or real(held, *a))
    assert workflow_queries.burden_start(spark, SF).count() > 0
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_a_saved_run_are_written_once(spark, monkeypatch):
    from gridloom.plans import workflow_queries

    seen, real = [], workflow_queries.results.save_run
    monkeypatch.setattr(workflow_queries.results, "save_run", lambda plans, points, *a: seen.append(points) or real(plans, points, *a))
    assert workflow_queries.saved_summary(spark, SF).count() > 0
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_bits_of_values_are_taken_once(spark):
    """What refines quantiles reads written bits, and gives the same numbers."""
    from gridloom.operators.quantiles import quantiles

    df = spark.range(3000).select((F.col("id") % 2).alias("key"), ((F.col("id") * 7919) % 3001 - 1500.5).alias("v"))
    found = quantiles(df, "v", [0.0, 0.3, 1.0], ("key",), ranked=50)
    assert "doubleToLongBits" not in found._jdf.queryExecution().optimizedPlan().toString()
    for row in found.collect():
        values = sorted(i * 7919 % 3001 - 1500.5 for i in range(row["key"], 3000, 2))
        at = row["p"] * (len(values) - 1)
        low = int(at)
        wanted = values[low] * (1 - at + low) + values[min(low + 1, len(values) - 1)] * (at - low)
        assert abs(row["q"] - wanted) < 1e-9
