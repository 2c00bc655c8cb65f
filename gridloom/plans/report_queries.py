"""Reporting queries on solutions and objectives: fronts, champions, frequencies, parameter effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import cells as C
from ..operators import effects as E
from ..operators import pareto, stats
from ..operators.anomaly import to_long
from ..operators.quantiles import quantiles
from ..shared import stored
from ..sources.results import run_summary as summary_of
from .adapter import ANOMALIES, COST, EFFECTS, OBJ_SQL, anomaly_cells, decisions, decisions_sql, p_sql, q_sql, stars_sql
from .registry import query

_N = 24
_NAMES = [*ANOMALIES, COST]


def _q(column: str, digits: int = 4):
    return N.quant(F.col(column), digits).alias(column)


def _objectives(spark: SparkSession, sf: str, held: DataFrame | None = None, plans: DataFrame | None = None) -> DataFrame:
    """24 plans as 4 scenarios of 6 solutions, with the parameters that the scenarios stand for; written once."""
    held = anomaly_cells(spark, sf) if held is None else held
    out = E.objectives(held, decisions(held, 0.1, _N) if plans is None else plans, EFFECTS, COST)
    return stored(out.select(
        (F.col("sol_id") % 4).cast("int").alias("scenario_id"), "sol_id", *ANOMALIES, N.quant(F.col(COST), 2).alias(COST),
        F.when(F.col("sol_id") % 4 < 2, 0.1).otherwise(0.3).alias("fraction"), F.when(F.col("sol_id") % 2 == 0, "no").otherwise("yes").alias("burden"),
    ), "objectives")


_O = f"""{decisions_sql(0.1, _N)}, {OBJ_SQL}, ob AS (SELECT CAST(sol_id % 4 AS INT) AS scenario_id, sol_id, abiotic, biotic, landscape, {q_sql('implementation_cost', 2)} AS implementation_cost,
 CAST(CASE WHEN sol_id % 4 < 2 THEN 0.1 ELSE 0.3 END AS DOUBLE) AS fraction, CASE WHEN sol_id % 2 = 0 THEN 'no' ELSE 'yes' END AS burden FROM obj)"""
_LE = " AND ".join(f"b.{x} <= a.{x}" for x in _NAMES)
_LT = " OR ".join(f"b.{x} < a.{x}" for x in _NAMES)
_SUM = "CAST(abiotic AS DOUBLE) + CAST(biotic AS DOUBLE) + CAST(landscape AS DOUBLE) + implementation_cost"


@query(f"WITH {_O} SELECT scenario_id, sol_id, abiotic, biotic, landscape, implementation_cost FROM ob a WHERE NOT EXISTS (SELECT 1 FROM ob b WHERE b.scenario_id = a.scenario_id AND {_LE} AND ({_LT}))")
def pareto_front(spark, sf):
    return pareto.pareto_front(_objectives(spark, sf), _NAMES, ("scenario_id",)).select("scenario_id", "sol_id", *_NAMES)


def _gap(x: str) -> str:
    return f"CASE WHEN lead({x}) OVER (PARTITION BY scenario_id ORDER BY {x}, sol_id) IS NULL OR lag({x}) OVER (PARTITION BY scenario_id ORDER BY {x}, sol_id) IS NULL THEN CAST('inf' AS DOUBLE) ELSE coalesce(CAST(lead({x}) OVER (PARTITION BY scenario_id ORDER BY {x}, sol_id) - lag({x}) OVER (PARTITION BY scenario_id ORDER BY {x}, sol_id) AS DOUBLE) / nullif(CAST(max({x}) OVER (PARTITION BY scenario_id) - min({x}) OVER (PARTITION BY scenario_id) AS DOUBLE), 0), 0) END"


@query(f"WITH {_O}, c AS (SELECT sol_id, {' + '.join(_gap(x) for x in _NAMES)} AS d FROM ob) SELECT sol_id, CASE WHEN d < 1e9 THEN {q_sql('d', 5)} ELSE -1 END AS crowding FROM c")
def crowding_distance(spark, sf):
    held = pareto.crowding(_objectives(spark, sf), _NAMES, ("scenario_id",))
    return held.select("sol_id", F.when(F.col("crowding") < 1e9, N.quant(F.col("crowding"), 5)).otherwise(-1.0).alias("crowding"))


@query(f"""WITH {_O}, c AS ({' UNION ALL '.join(f"SELECT scenario_id, sol_id, '{x}' o FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY {x}, sol_id) r FROM ob) WHERE r = 1" for x in _NAMES)})
SELECT scenario_id, sol_id, string_agg(o, ',' ORDER BY o) AS best_in FROM c GROUP BY 1, 2""")
def champions_per_objective(spark, sf):
    return pareto.champions(_objectives(spark, sf), _NAMES, ("scenario_id",))


@query(f"WITH {_O} SELECT scenario_id, sol_id, {q_sql('total', 2)} AS total FROM (SELECT *, {_SUM} AS total, row_number() OVER (PARTITION BY scenario_id ORDER BY {_SUM}, sol_id) r FROM ob) WHERE r = 1")
def best_solution_per_scenario(spark, sf):
    return pareto.best_solution(_objectives(spark, sf), _NAMES).select("scenario_id", "sol_id", _q("total", 2))


_FREQ = f"{decisions_sql(0.1, _N)}, f AS (SELECT pixel_id p, count(*) * 100.0 / {_N} AS pct FROM dec GROUP BY 1)"


@query(f"WITH {_FREQ} SELECT pixel_id, {q_sql('CASE WHEN eligible THEN coalesce(pct, 0) ELSE -1 END', 4)} AS pct FROM anom LEFT JOIN f ON p = pixel_id")
def selection_frequency(spark, sf):
    held = anomaly_cells(spark, sf)
    pct = decisions(held, 0.1, _N).groupBy("pixel_id").agg((F.count("*") * 100.0 / _N).alias("pct"))
    out = C.scatter(held, pct, "pct").withColumn("pct", F.when(F.col("eligible"), F.coalesce("pct", F.lit(0.0))).otherwise(-1.0))
    return out.select("pixel_id", _q("pct"))


@query(f"WITH {_FREQ} SELECT pixel_id, row_idx, col_idx, {q_sql('coalesce(pct, -1)', 4)} AS pct FROM anom LEFT JOIN f ON p = pixel_id")
def scatter_map(spark, sf):
    held = anomaly_cells(spark, sf)
    pct = decisions(held, 0.1, _N).groupBy("pixel_id").agg((F.count("*") * 100.0 / _N).alias("pct"))
    return C.scatter(held, pct, "pct", -1.0).select("pixel_id", "row_idx", "col_idx", _q("pct"))


@query(f"WITH {_O} SELECT fraction, {q_sql('avg(abiotic + biotic + landscape) FILTER (burden = ' + chr(39) + 'no' + chr(39) + ')', 3)} AS no, {q_sql('avg(abiotic + biotic + landscape) FILTER (burden = ' + chr(39) + 'yes' + chr(39) + ')', 3)} AS yes FROM ob GROUP BY 1")
def effect_summary_pivot(spark, sf):
    held = _objectives(spark, sf).withColumn("total", F.col("abiotic") + F.col("biotic") + F.col("landscape"))
    return held.groupBy("fraction").pivot("burden", ["no", "yes"]).agg(F.avg("total")).select("fraction", _q("no", 3), _q("yes", 3))


@query(f"""WITH {_O}, m AS (SELECT burden, unnest(['total', 'efficiency']) AS metric, unnest([CAST(abiotic + biotic + landscape AS DOUBLE), implementation_cost / nullif(abiotic + biotic + landscape, 0)]) AS v FROM ob)
SELECT burden, metric, {', '.join(f'{q_sql(f"quantile_cont(v, CAST({p} AS DOUBLE))", 2)} AS q{i}' for i, p in enumerate((0, 0.25, 0.5, 0.75, 1)))} FROM m GROUP BY 1, 2""")
def effect_boxplot(spark, sf):
    total = F.col("abiotic") + F.col("biotic") + F.col("landscape")
    held = _objectives(spark, sf).withColumns({"total": total.cast("double"), "efficiency": N.ratio(F.col(COST), total)})
    long = to_long(held, ["total", "efficiency"], ["burden"], "metric", "v")
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = quantiles(long, "v", list(shares), ("burden", "metric")).groupBy("burden", "metric")
    return found.agg(*(N.quant(F.max(F.when(F.col("p") == p, F.col("q"))), 2).alias(f"q{i}") for i, p in enumerate(shares)))


@query(f"WITH {_O} SELECT sol_id, " + ", ".join(q_sql(f"coalesce(CAST({x} - min({x}) OVER () AS DOUBLE) / nullif(max({x}) OVER () - min({x}) OVER (), 0), 0.5)", 5) + f" AS {x}" for x in _NAMES) + " FROM ob")
def minmax_parallel_coords(spark, sf):
    held = _objectives(spark, sf)
    ranges = held.agg(*(c for x in _NAMES for c in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))))
    held = held.crossJoin(F.broadcast(ranges))
    return held.select("sol_id", *(N.quant(N.min_max(F.col(x), F.col(f"lo_{x}"), F.col(f"hi_{x}")), 5).alias(x) for x in _NAMES))


@query(f"WITH {_O} SELECT sol_id, {q_sql('coalesce(50 + 450 * (implementation_cost - min(implementation_cost) OVER ()) / nullif(max(implementation_cost) OVER () - min(implementation_cost) OVER (), 0), 100)', 3)} AS size FROM ob")
def pareto_marker_scale(spark, sf):
    held = _objectives(spark, sf)
    held = held.crossJoin(F.broadcast(held.agg(F.min(COST).alias("lo"), F.max(COST).alias("hi"))))
    return held.select("sol_id", N.quant(F.coalesce(50 + 450 * N.ratio(F.col(COST) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(100.0)), 3).alias("size"))


_V = {"total_anomaly": "CAST(abiotic + biotic + landscape AS DOUBLE)", "implementation_cost": "implementation_cost"}


@query(f"WITH {_O} " + " UNION ALL ".join(f"""SELECT '{n}' AS objective, {q_sql(f"abs(avg({v}) FILTER (burden = 'yes') - avg({v}) FILTER (burden = 'no')) / stddev_samp({v}) FILTER (burden = 'no')", 4)} AS burden_effect, {q_sql(f'corr(fraction, {v})', 4)} AS fraction_r FROM ob""" for n, v in _V.items()))
def param_effect_size(spark, sf):
    held = _objectives(spark, sf).withColumn("total_anomaly", (F.col("abiotic") + F.col("biotic") + F.col("landscape")).cast("double"))
    long = to_long(held, list(_V), ["burden", "fraction"], "objective", "v")
    of = lambda b: F.when(F.col("burden") == b, F.col("v"))
    effect = N.ratio(F.abs(F.avg(of("yes")) - F.avg(of("no"))), F.stddev_samp(of("no")))
    return long.groupBy("objective").agg(N.quant(effect, 4).alias("burden_effect"), N.quant(stats.corr("fraction", "v"), 4).alias("fraction_r"))


@query(f"WITH {_O} SELECT scenario_id, count(*) AS n_solutions, " + ", ".join(f"{q_sql(f'min({x})', 2)} AS {x}_min, {q_sql(f'max({x})', 2)} AS {x}_max, {q_sql(f'avg({x})', 2)} AS {x}_mean" for x in _NAMES) + " FROM ob GROUP BY 1")
def run_summary(spark, sf):
    held = summary_of(_objectives(spark, sf).select("scenario_id", "sol_id", *_NAMES))
    return held.select("scenario_id", "n_solutions", *(N.quant(F.col(f"{x}.{s}"), 2).alias(f"{x}_{s}") for x in _NAMES for s in ("min", "max", "mean")))


@query(f"WITH {_O} SELECT {', '.join(f'{q_sql(f"stddev_pop({x})", 3)} AS {x}' for x in _NAMES)}, {q_sql('corr(abiotic, implementation_cost)', 5)} AS r FROM ob")
def population_spread(spark, sf):
    return _objectives(spark, sf).agg(*(N.quant(F.stddev_pop(x), 3).alias(x) for x in _NAMES), N.quant(stats.corr("abiotic", COST), 5).alias("r"))


@query(f"""WITH {_O}, b AS (SELECT *, {_SUM} AS total FROM ob), m AS (SELECT fraction, burden, arg_min(sol_id, row(total, sol_id)) AS best FROM b GROUP BY 1, 2)
SELECT fraction, burden, a.pixel_id, CAST(CASE WHEN d.pixel_id IS NULL THEN 0 ELSE 1 END AS INT) AS chosen FROM anom a CROSS JOIN m LEFT JOIN dec d ON d.pixel_id = a.pixel_id AND d.sol_id = best WHERE eligible""")
def key_contrast_maps(spark, sf):
    """A map for every contrast of fraction and burden sharing: the cells of its best solution."""
    held = anomaly_cells(spark, sf)
    plans = stored(decisions(held, 0.1, _N), "plans")
    best = pareto.best_solution(_objectives(spark, sf, held, plans), _NAMES, ("fraction", "burden")).select("fraction", "burden", "sol_id")
    chosen = plans.join(F.broadcast(best), "sol_id").select("fraction", "burden", "pixel_id", F.lit(1).alias("chosen"))
    every = held.where("eligible").select("pixel_id").crossJoin(F.broadcast(best.select("fraction", "burden")))
    return every.join(chosen, ["fraction", "burden", "pixel_id"], "left").select("fraction", "burden", "pixel_id", F.coalesce("chosen", F.lit(0)).alias("chosen"))


@query(f"""WITH {_FREQ} SELECT count(*) AS n_eligible, count(*) FILTER (p IS NULL) AS never_selected, {q_sql('min(coalesce(pct, 0))', 4)} AS least, {q_sql('max(coalesce(pct, 0))', 4)} AS most,
{q_sql('100.0 * count(*) FILTER (p IS NULL) / count(*)', 4)} AS never_pct FROM anom LEFT JOIN f ON p = pixel_id WHERE eligible""")
def selection_summary(spark, sf):
    held = anomaly_cells(spark, sf)
    pct = decisions(held, 0.1, _N).groupBy("pixel_id").agg((F.count("*") * 100.0 / _N).alias("pct"))
    never = F.count_if(F.col("pct") == 0)
    return C.scatter(held.where("eligible"), pct, "pct", 0.0).agg(
        F.count("*").alias("n_eligible"), never.alias("never_selected"), N.quant(F.min("pct"), 4).alias("least"), N.quant(F.max("pct"), 4).alias("most"),
        N.quant(100.0 * never / F.count("*"), 4).alias("never_pct"),
    )


_T = "(avg(v) FILTER (burden = 'no') - avg(v) FILTER (burden = 'yes'))"
_POOLED = "((count(v) FILTER (burden = 'no') - 1) * var_samp(v) FILTER (burden = 'no') + (count(v) FILTER (burden = 'yes') - 1) * var_samp(v) FILTER (burden = 'yes')) / (count(v) - 2)"


@query(f"""WITH {_O}, l AS ({' UNION ALL '.join(f"SELECT '{n}' AS objective, burden, fraction, {v} AS v FROM ob" for n, v in _V.items())})
SELECT objective, {q_sql(f"{_T} / sqrt({_POOLED} * (1.0 / count(v) FILTER (burden = 'no') + 1.0 / count(v) FILTER (burden = 'yes')))", 4)} AS t, {q_sql('corr(fraction, v)', 5)} AS r,
{q_sql('corr(fraction, v) * sqrt((count(v) - 2) / (1 - corr(fraction, v) ** 2))', 4)} AS t_of_r FROM l GROUP BY 1""")
def param_effect_statistics(spark, sf):
    """The statistics behind param_effect_pvalues."""
    held = _objectives(spark, sf).withColumn("total_anomaly", (F.col("abiotic") + F.col("biotic") + F.col("landscape")).cast("double"))
    long = to_long(held, list(_V), ["burden", "fraction"], "objective", "v")
    found = long.groupBy("objective").agg(stats.t_statistic("v", "burden", "no", "yes").alias("t"), stats.corr("fraction", "v").alias("r"), F.count("v").alias("n"))
    return found.select("objective", _q("t", 4), _q("r", 5), N.quant(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))), 4).alias("t_of_r"))


_P = f"""l AS ({' UNION ALL '.join(f"SELECT '{n}' AS objective, burden, fraction, {v} AS v FROM ob" for n, v in _V.items())}),
st AS (SELECT objective, count(v) AS n, {_T} / sqrt({_POOLED} * (1.0 / count(v) FILTER (burden = 'no') + 1.0 / count(v) FILTER (burden = 'yes'))) AS t, corr(fraction, v) AS r FROM l GROUP BY 1),
pv AS (SELECT *, {p_sql('t', '(n - 2)')} AS bp, {p_sql('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} AS fp FROM st)"""


@query(f"WITH {_O}, {_P} SELECT objective, {q_sql('t', 4)} AS t, {q_sql('bp', 6)} AS burden_p, {q_sql('r', 5)} AS r, {q_sql('fp', 6)} AS fraction_p, {stars_sql('bp')} AS burden_stars, {stars_sql('fp')} AS fraction_stars FROM pv")
def param_effect_pvalues(spark, sf):
    """Effects of burden sharing and of the fraction restored, with their significance."""
    held = _objectives(spark, sf).withColumn("total_anomaly", (F.col("abiotic") + F.col("biotic") + F.col("landscape")).cast("double"))
    long = to_long(held, list(_V), ["burden", "fraction"], "objective", "v")
    found = long.groupBy("objective").agg(stats.t_statistic("v", "burden", "no", "yes").alias("t"), stats.corr("fraction", "v").alias("r"), F.count("v").alias("n"))
    degrees = F.col("n") - 2
    found = found.withColumns({"bp": stats.t_p(spark, F.col("t"), degrees), "fp": stats.t_p(spark, stats.t_of_r(F.col("r"), F.col("n")), degrees)})
    return found.select("objective", _q("t"), N.quant(F.col("bp"), 6).alias("burden_p"), _q("r", 5), N.quant(F.col("fp"), 6).alias("fraction_p"), N.stars(F.col("bp")).alias("burden_stars"), N.stars(F.col("fp")).alias("fraction_stars"))
