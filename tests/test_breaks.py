"""Natural breaks of many values and keys, in tasks and level by level, against each other and a plain recursion."""

from __future__ import annotations

import numpy as np
import pytest

from gridloom.operators import breaks


def plain_cost(values: np.ndarray, bounds: list[float]) -> float:
    """Sum of squares within the classes that the bounds make."""
    total, low = 0.0, -np.inf
    for high in bounds[1:]:
        mine = values[(values > low) & (values <= high)]
        total, low = total + ((mine - mine.mean()) ** 2).sum(), high
    return total


def plain_best(values: np.ndarray, classes: int) -> float:
    """Least cost by the full recursion over distinct values."""
    x, w = np.unique(values, return_counts=True)
    s = [np.r_[0, np.cumsum(v)] for v in (w, w * x, w * x * x)]
    best = np.r_[0, np.full(len(x), np.inf)]
    for _ in range(classes):
        new = np.full(len(x) + 1, np.inf)
        for j in range(1, len(x) + 1):
            i = np.arange(j)
            new[j] = (best[i] + s[2][j] - s[2][i] - (s[1][j] - s[1][i]) ** 2 / (s[0][j] - s[0][i])).min()
        best = new
    return best[-1]


@pytest.mark.parametrize("local", [500, 1_000_000])
def test_breaks_by_key(spark, local, monkeypatch):
    monkeypatch.setattr(breaks, "_CHUNK", 64)
    rng = np.random.default_rng(1)
    held = {"a": np.round(rng.normal(size=900), 2), "b": np.round(rng.random(700) ** 4 * 100, 1), "c": np.array([3.0, 1.0, 3.0]), "d": np.round(np.r_[rng.normal(size=300), rng.normal(size=300) + 50, 1e4], 1)}
    rows = [(k, float(v)) for k, vs in held.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    got = {r.key: r.breaks for r in breaks.natural_breaks_by(df, "v", 5, ("key",), local).collect()}
    assert got.keys() == held.keys() and got["c"] == [1.0, 1.0, 3.0]
    for k in "abd":
        assert len(got[k]) == 6 and got[k][0] == held[k].min() and got[k][-1] == held[k].max()
        assert plain_cost(held[k], got[k]) == pytest.approx(plain_best(held[k], 5), rel=1e-7, abs=1e-7)
    one = breaks.natural_breaks_by(df.where("key = 'b'"), "v", 4, (), local).collect()
    assert len(one) == 1 and plain_cost(held["b"], one[0].breaks) == pytest.approx(plain_best(held["b"], 4), rel=1e-7)
    assert breaks.natural_breaks_by(df.where("v is null"), "v", 5).count() == 0


def test_tasks_and_levels_agree(spark):
    values = np.random.default_rng(5).normal(size=30_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    far = breaks.natural_breaks_by(df, "v", 5, (), local=22_000).first().breaks
    near = breaks.natural_breaks_by(df, "v", 5).first().breaks
    assert plain_cost(values, far) == pytest.approx(plain_cost(values, near), rel=1e-9)
