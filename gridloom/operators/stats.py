"""Statistics on aggregates: p-values, correlations, natural breaks, k-means."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .breaks import breaks_of, natural_breaks_by


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float | None, df: float) -> float | None:
    """Two-sided p of Student's t; scalar, for the few rows of a summary."""
    if t is None or math.isnan(t) or df <= 0:
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_p(spark, t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, for the rows of a summary."""
    ship_package(spark)

    @F.pandas_udf("double")
    def p_of(values, degrees):
        import pandas as pd

        return pd.Series([t_p_value(None if pd.isna(v) else float(v), float(d)) for v, d in zip(values, degrees)], dtype="float64")

    return p_of(t.cast("double"), df.cast("double"))


def t_of_r(r: Column, n: Column) -> Column:
    """The t of a correlation over n pairs; NULL for a perfect one."""
    return r * F.sqrt((n - 2) / F.when(F.abs(r) < 1, 1 - r * r))


def corr(a: str, b: str) -> Column:
    """Pearson correlation; NULL for constant input, which would divide by zero."""
    x = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a).cast("double"))
    y = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(b).cast("double"))
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def t_statistic(value: str, group: str, zero: str, one: str) -> Column:
    """Equal-variance t of two groups."""
    v0, v1 = F.when(F.col(group) == zero, F.col(value)), F.when(F.col(group) == one, F.col(value))
    n0, n1 = F.count(v0), F.count(v1)
    pooled = ((n0 - 1) * F.var_samp(v0) + (n1 - 1) * F.var_samp(v1)) / F.nullif(n0 + n1 - 2, F.lit(0))
    return (F.avg(v0) - F.avg(v1)) / F.nullif(F.sqrt(pooled * (1 / F.nullif(n0, F.lit(0)) + 1 / F.nullif(n1, F.lit(0)))), F.lit(0.0))


def natural_breaks(df: DataFrame, value: str, classes: int = 5, most: int | None = None, local: int = 1_000_000) -> list[float]:
    """Fisher's natural breaks of a column: class bounds of least within-class variance.

    Exact over all distinct values, none of which come to the driver (see breaks).  With `most`, more distinct
    values than that are first merged into `most` equal-count groups, each told by its mean, and the bounds
    are approximate: the greatest values of groups.
    """
    if most is not None:
        held = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
        if held.select("v").distinct().count() > most:
            cuts = np.unique(np.array(held.agg(F.percentile_approx("v", [i / most for i in range(1, most)], most * 4)).first()[0]))

            @F.pandas_udf("int")
            def bin_of(v):
                import pandas as pd

                return pd.Series(np.searchsorted(cuts, v.to_numpy(), side="left").astype("int32"))

            rows = held.groupBy(bin_of(F.col("v")).alias("b")).agg(F.avg("v").alias("m"), F.count("*").alias("w"), F.max("v").alias("hi"), F.min("v").alias("lo")).orderBy("lo").collect()
            found = breaks_of(np.array([r["m"] for r in rows]), np.array([float(r["w"]) for r in rows]), classes)
            high = {r["m"]: r["hi"] for r in rows}
            return [rows[0]["lo"], *(high[m] for m in found[1:])]
    found = natural_breaks_by(df, value, classes, (), local).first()
    return list(found["breaks"]) if found else []


def kmeans_classes(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Cluster number of every row without NULLs, over standardised columns."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    held = VectorAssembler(inputCols=columns, outputCol="__v").transform(df.dropna(subset=columns))
    held = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(held).transform(held)
    model = KMeans(k=k, seed=seed, featuresCol="__s", predictionCol="cluster").fit(held)
    return model.transform(held).drop("__v", "__s")
