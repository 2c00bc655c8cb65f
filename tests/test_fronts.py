"""Fronts and crowding of many points: sorted ranges against plain comparisons of all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pareto


def plain_front(values: np.ndarray) -> np.ndarray:
    keep = np.ones(len(values), bool)
    for i, v in enumerate(values):
        keep[i] = not ((values <= v).all(axis=1) & (values < v).any(axis=1)).any()
    return keep


def sphere(n: int, d: int, seed: int) -> np.ndarray:
    """Points of which none dominates another: on the part of a sphere that faces the origin."""
    v = np.abs(np.random.default_rng(seed).normal(size=(n, d)))
    return 1.0 - v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("d", [1, 2, 3, 4])
def test_front_of_an_array(d):
    rng = np.random.default_rng(d)
    for values in (rng.normal(size=(700, d)), rng.integers(0, 6, (900, d)).astype(float), sphere(600, max(d, 2), d)):
        mask = pareto.front_mask(values)
        want = plain_front(values)
        assert not (mask & ~want).any() and {tuple(v) for v in values[mask]} == {tuple(v) for v in values[want]}
        assert len({tuple(v) for v in values[mask]}) == mask.sum()


@pytest.mark.parametrize("keyed", [False, True])
def test_many_undominated_points(spark, keyed):
    rng = np.random.default_rng(7)
    values = np.concatenate([sphere(4000, 3, 1), sphere(500, 3, 2) + rng.random((500, 1)) * 0.02, np.repeat(sphere(100, 3, 3), 5, axis=0)])
    group = rng.integers(0, 3, len(values)) if keyed else np.zeros(len(values), int)
    rows = [(int(g), i, *map(float, v)) for i, (g, v) in enumerate(zip(group, values))] + [(0, 9000, None, 1.0, 1.0), (0, 9001, float("nan"), 0.9, 0.9)]
    df = spark.createDataFrame(rows, "g int, sol_id int, a double, b double, c double").repartition(5).persist()
    want = {i for g in range(3) for i in np.flatnonzero(group == g)[plain_front(values[group == g])]} | {9000}
    front = pareto.pareto_front(df, ["a", "b", "c"], ("g",) if keyed else (), block=100, range_rows=300)
    got = sorted(r.sol_id for r in front.collect())
    assert set(got) - {9001} == want and len(got) == len(set(got))
    plan = front._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    df.unpersist()


def test_crowding_across_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.random((3000, 2)), 2))]
    df = spark.createDataFrame(rows, "g int, sol_id int, a double, b double").persist()
    for keys in ((), ("g",)):
        one = {r.sol_id: r.crowding for r in pareto.crowding(df, ["a", "b"], keys).collect()}
        many = {r.sol_id: r.crowding for r in pareto.crowding(df, ["a", "b"], keys, most=400).collect()}
        assert one.keys() == many.keys() and len(one) == 3000
        assert all(one[i] == many[i] or abs(one[i] - many[i]) < 1e-12 for i in one)
    df.unpersist()


def test_a_large_front_is_swept_in_time(spark):
    """40,000 points of a sphere in four objectives, none of which goes."""
    values = sphere(40_000, 4, 5)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "sol_id int, a double, b double, c double, d double").repartition(8)
    assert pareto._front_by_ranges(df.select("a", "b", "c", "d"), ["a", "b", "c", "d"], [], 40_000, 5000).agg(F.count("*")).first()[0] == 40_000
