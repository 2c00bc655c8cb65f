"""Queries on decisions: scenarios, effects, objectives, selection, experiments, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import cells as C
from ..operators import effects as E
from ..operators import evolve, pareto, scenario, selection
from ..operators.focal import disc
from .adapter import ANOM, ANOMALIES, COST, EFFECTS, GRID, OBJ_SQL, anomaly_cells, decisions, decisions_sql, gain_sql, q_sql, u_sql, weight_sql
from .registry import query


def _q(column: str, digits: int = 4):
    return N.quant(F.col(column), digits).alias(column)


# --- scenarios ------------------------------------------------------------------------------------

_S = """s AS (SELECT CAST((((a * 2 + b) * 3 + c) * 3 + d) AS INT) AS scenario_id, CAST([0.1, 0.3][a + 1] AS DOUBLE) AS max_restoration_fraction, CAST([0.0, 0.3][b + 1] AS DOUBLE) AS spatial_clustering,
 'no' AS burden_sharing, CAST(0.005 AS DOUBLE) + c * (CAST(0.02 AS DOUBLE) - CAST(0.005 AS DOUBLE)) / 2 AS abiotic_effect, CAST(0.005 AS DOUBLE) + d * (CAST(0.02 AS DOUBLE) - CAST(0.005 AS DOUBLE)) / 2 AS biotic_effect,
 CAST(0.01 AS DOUBLE) AS landscape_effect, 'exponential' AS anomaly_weight_shape, CAST(1.0 AS DOUBLE) AS anomaly_weight_scale
 FROM (SELECT unnest(range(2)) a), (SELECT unnest(range(2)) b), (SELECT unnest(range(3)) c), (SELECT unnest(range(3)) d))"""


_FREE = "(SELECT count(*) FILTER (eligible) FROM anom)"


@query(f"WITH {ANOM}, {_S} SELECT * REPLACE ({q_sql('abiotic_effect', 6)} AS abiotic_effect, {q_sql('biotic_effect', 6)} AS biotic_effect), CAST(floor(max_restoration_fraction * {_FREE}) AS BIGINT) AS k FROM s")
def scenario_grid(spark, sf):
    """All scenarios, with the number of cells that each may restore."""
    held = evolve.settings_of(anomaly_cells(spark, sf), scenario.scenario_grid(spark))
    return held.withColumns({"abiotic_effect": N.quant(F.col("abiotic_effect"), 6), "biotic_effect": N.quant(F.col("biotic_effect"), 6)})


@query(f"WITH {ANOM}, {_S} SELECT scenario_id, max_restoration_fraction, spatial_clustering, {q_sql('abiotic_effect', 6)} AS abiotic_effect, {q_sql('biotic_effect', 6)} AS biotic_effect FROM s WHERE scenario_id = {_FREE} % 36")
def scenario_by_index(spark, sf):
    """The scenario whose number is that of the eligible cells, modulo the number of scenarios."""
    grid = scenario.scenario_grid(spark)
    held = scenario.scenario_by_index(grid, anomaly_cells(spark, sf).where("eligible").count() % grid.count())
    return held.select("scenario_id", "max_restoration_fraction", "spatial_clustering", _q("abiotic_effect", 6), _q("biotic_effect", 6))


_S2 = """s AS (SELECT CAST((((a * 2 + b) * 2 + c) * 2 + d) AS INT) AS scenario_id, [0.1, 0.3][a + 1] AS max_restoration_fraction, CAST([0.0, 0.3][b + 1] AS DOUBLE) AS spatial_clustering, 'no' AS burden_sharing,
 CAST([0.005, 0.02][c + 1] AS DOUBLE) AS abiotic_effect, CAST([0.005, 0.02][d + 1] AS DOUBLE) AS biotic_effect, CAST(0.01 AS DOUBLE) AS landscape_effect, 'exponential' AS anomaly_weight_shape, CAST(1.0 AS DOUBLE) AS anomaly_weight_scale
 FROM (SELECT unnest(range(2)) a), (SELECT unnest(range(2)) b), (SELECT unnest(range(2)) c), (SELECT unnest(range(2)) d))"""


@query(f"WITH {ANOM}, {_S2}, used AS (SELECT * FROM s WHERE scenario_id IN (SELECT region_id % 16 FROM anom)) " + " UNION ALL ".join(f"SELECT '{p}' AS parameter, count(DISTINCT {p}) AS n_values, string_agg(DISTINCT CAST({p} AS VARCHAR), ',' ORDER BY CAST({p} AS VARCHAR)) AS sampled FROM used" for p in scenario.PARAMETERS))
def parameter_summary(spark, sf):
    """The values of every parameter in the scenarios that the regions are given by their numbers."""
    held = scenario.scenario_grid(spark, n=2)
    given = anomaly_cells(spark, sf).select((F.col("region_id") % 16).cast("int").alias("scenario_id")).distinct()
    return scenario.parameter_summary(held.join(given, "scenario_id", "left_semi"))


# --- effects and objectives -----------------------------------------------------------------------


@query(f"WITH {ANOM} SELECT pixel_id, {q_sql(weight_sql('abiotic'), 5)} AS w FROM anom WHERE eligible")
def weight_exponential(spark, sf):
    return anomaly_cells(spark, sf).where("eligible").select("pixel_id", N.quant(N.weight(F.col("abiotic")), 5).alias("w"))


@query(f"WITH {ANOM} SELECT pixel_id, {q_sql('least(greatest(exp(-(abiotic * abiotic) / 0.5), 0.0), 1.0)', 5)} AS w FROM anom WHERE eligible")
def weight_gaussian(spark, sf):
    return anomaly_cells(spark, sf).where("eligible").select("pixel_id", N.quant(N.weight(F.col("abiotic"), "gaussian", 0.5), 5).alias("w"))


_SCORE = f"CAST(0.01 AS DOUBLE) * {weight_sql('abiotic')} + CAST(0.015 AS DOUBLE) * {weight_sql('biotic')} - CAST(0.000001 AS DOUBLE) * implementation_cost / ((SELECT avg(implementation_cost) FROM anom WHERE eligible) + CAST(1e-12 AS DOUBLE))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    held = anomaly_cells(spark, sf).where("eligible")
    return E.repair_scores(held, {"abiotic": 0.01, "biotic": 0.015}, COST)


@query(f"WITH {ANOM} SELECT pixel_id, {q_sql(_SCORE, 7)} AS score FROM anom WHERE eligible")
def repair_scores(spark, sf):
    return _scored(spark, sf).select("pixel_id", _q("score", 7))


@query(f"""WITH {decisions_sql(0.05, 3)} SELECT d.sol_id, a.pixel_id, {', '.join(q_sql(f'{x} + CAST({e} AS DOUBLE) * {weight_sql(x)}', 5) + f' AS {x}' for x, e in EFFECTS.items())} FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id""")
def restoration_effect_cells(spark, sf):
    held = anomaly_cells(spark, sf)
    out = E.restored(held, decisions(held, 0.05, 3), EFFECTS).where("selected")
    return out.select("sol_id", "pixel_id", *(_q(x, 5) for x in ANOMALIES))


_RING = """pos AS (SELECT sol_id, row_idx, col_idx FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id),
near AS (SELECT DISTINCT sol_id, row_idx + dr AS row_idx, col_idx + dc AS col_idx FROM pos, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)), ring AS (SELECT * FROM near EXCEPT SELECT * FROM pos)"""


def _decayed(x: str, e: float) -> str:
    return f"CASE WHEN eligible AND f > 0 THEN {x} + CAST({e} AS DOUBLE) * f * {weight_sql(x)} ELSE {x} END"


@query(f"""WITH {decisions_sql(0.05, 2)}, {_RING}, held AS (SELECT s.sol_id, a.*, CAST(CASE WHEN d.pixel_id IS NOT NULL THEN 1 WHEN r.row_idx IS NOT NULL THEN 0.5 ELSE 0 END AS DOUBLE) AS f, d.pixel_id IS NOT NULL AS selected
 FROM anom a CROSS JOIN (SELECT DISTINCT sol_id FROM dec) s LEFT JOIN dec d ON d.sol_id = s.sol_id AND d.pixel_id = a.pixel_id LEFT JOIN ring r ON r.sol_id = s.sol_id AND r.row_idx = a.row_idx AND r.col_idx = a.col_idx)
SELECT sol_id, pixel_id, selected, {', '.join(q_sql(_decayed(x, e), 5) + f' AS {x}' for x, e in EFFECTS.items())} FROM held""")
def restoration_effect_decay(spark, sf):
    """All cells after restoration, with half the effect on cells next to a selected one."""
    held = anomaly_cells(spark, sf)
    out = E.restored(held, decisions(held, 0.05, 2), EFFECTS, decay=0.5)
    return out.select("sol_id", "pixel_id", "selected", *(_q(x, 5) for x in ANOMALIES))


@query(f"WITH {decisions_sql(0.1)}, {OBJ_SQL} SELECT scenario_id, sol_id, abiotic, biotic, landscape, {q_sql('implementation_cost', 2)} AS implementation_cost, n_selected FROM obj")
def objective_eval(spark, sf):
    held = anomaly_cells(spark, sf)
    out = E.objectives(held, decisions(held, 0.1), EFFECTS, COST)
    return out.select("scenario_id", "sol_id", *ANOMALIES, _q(COST, 2), "n_selected")


@query(f"""WITH {decisions_sql(0.1, 4)}, {OBJ_SQL}, pos AS (SELECT sol_id, row_idx, col_idx FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id),
n AS (SELECT DISTINCT sol_id, row_idx + dr AS row_idx, col_idx + dc AS col_idx FROM pos, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dr, dc)),
ring AS (SELECT * FROM n EXCEPT SELECT * FROM pos),
rg AS (SELECT sol_id, {', '.join(f'sum({gain_sql("a." + x, e * 0.5)}) AS g_{x}' for x, e in EFFECTS.items())} FROM ring r JOIN anom a ON a.row_idx = r.row_idx AND a.col_idx = r.col_idx AND eligible GROUP BY 1)
SELECT o.sol_id, {', '.join(f'CAST({x} - coalesce(g_{x}, 0) AS BIGINT) AS {x}' for x in ANOMALIES)} FROM obj o LEFT JOIN rg ON rg.sol_id = o.sol_id""")
def objective_eval_ring(spark, sf):
    held = anomaly_cells(spark, sf)
    return E.objectives(held, decisions(held, 0.1, 4), EFFECTS, decay=0.5).select("sol_id", *ANOMALIES)


@query(f"WITH {decisions_sql(0.1)}, {OBJ_SQL} SELECT sol_id, {q_sql('implementation_cost', 2)} AS implementation_cost, {q_sql('proximity', 6)} AS proximity FROM obj")
def cost_proximity_objectives(spark, sf):
    held = anomaly_cells(spark, sf).withColumn("proximity", F.abs(F.col("col_idx") - 50))
    return E.objectives(held, decisions(held, 0.1), EFFECTS, COST, "proximity").select("sol_id", _q(COST, 2), _q("proximity", 6))


@query(f"WITH {ANOM} SELECT ecosystem, {', '.join(f'sum({gain_sql(x, e)})::BIGINT AS {x}' for x, e in EFFECTS.items())} FROM anom WHERE eligible GROUP BY 1")
def gain_table(spark, sf):
    return anomaly_cells(spark, sf).where("eligible").groupBy("ecosystem").agg(*(F.sum(E.gain(F.col(x), e)).cast("long").alias(x) for x, e in EFFECTS.items()))


# --- selection ------------------------------------------------------------------------------------


@query(f"WITH {decisions_sql(0.2, 5)} SELECT sol_id, pixel_id FROM dec")
def hash_topk_selection(spark, sf):
    return decisions(anomaly_cells(spark, sf), 0.2, 5).select("sol_id", "pixel_id")


def _candidates(spark: SparkSession, scored: DataFrame) -> DataFrame:
    held = scored.select("pixel_id", N.quant(F.col("score"), 7).alias("score"))
    plans = held.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("sol_id"))))
    limit = F.element_at(F.array(F.lit(0.02), F.lit(0.10), F.lit(0.30)), F.col("sol_id") + 1)
    return plans.withColumn("x", (N.uniform(F.col("sol_id"), F.col("pixel_id")) < limit).cast("int"))


_CAND = f"""cand AS (SELECT sol_id, pixel_id, {q_sql(_SCORE, 7)} AS score, CAST({u_sql('sol_id', 'pixel_id')} < CAST([0.02, 0.10, 0.30][sol_id + 1] AS DOUBLE) AS INT) AS x
 FROM anom, (SELECT CAST(unnest(range(3)) AS INT) sol_id) WHERE eligible)"""


@query(f"""WITH {ANOM}, {_CAND} SELECT sol_id, pixel_id, x FROM (SELECT *, row_number() OVER (PARTITION BY sol_id ORDER BY x DESC, score DESC, pixel_id) r FROM cand)
WHERE r <= (SELECT floor(CAST(0.1 AS DOUBLE) * count(*)) FROM anom WHERE eligible)""")
def repair_add_drop(spark, sf):
    scored = _scored(spark, sf)
    return selection.repair(_candidates(spark, scored), int(0.1 * scored.count()), "score").select("sol_id", "pixel_id", "x")


def _quota_sql(mode: str) -> str:
    first = "floor(k / m)" if mode == "equal" else "floor(CAST(k AS DOUBLE) * n / t)"
    return f"""WITH {ANOM}, e AS (SELECT * FROM anom WHERE eligible), r AS (SELECT region_id, count(*) n FROM e GROUP BY 1),
t AS (SELECT floor(CAST(0.2 AS DOUBLE) * sum(n)) k, count(*) m, sum(n) t FROM r), a AS (SELECT region_id, n, k, least(CAST({first} AS BIGINT), n) q0 FROM r, t),
b AS (SELECT *, k - sum(q0) OVER () AS left_, coalesce(sum(n - q0) OVER (ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) room FROM a),
q AS (SELECT region_id, n, CAST(q0 + greatest(0, least(n - q0, left_ - room)) AS BIGINT) AS quota FROM b)"""


@query(_quota_sql("equal") + f""" SELECT region_id, count(*) AS n_chosen, CAST(sum(pixel_id) AS BIGINT) AS pixels FROM (
SELECT e.*, row_number() OVER (PARTITION BY e.region_id ORDER BY {u_sql('7', 'pixel_id')}, pixel_id) rn, quota FROM e JOIN q ON q.region_id = e.region_id) WHERE rn <= quota GROUP BY 1""")
def burden_quota(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    k = int(0.2 * held.count())
    return selection.burden_share(held, k, 7).groupBy("region_id").agg(F.count("*").alias("n_chosen"), F.sum("pixel_id").alias("pixels"))


@query(_quota_sql("proportional") + " SELECT region_id, n, quota FROM q")
def burden_quota_proportional(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    return selection.quotas(held.groupBy("region_id").agg(F.count("*").alias("n")), int(0.2 * held.count()), "proportional").select("region_id", "n", "quota")


@query(f"""WITH {decisions_sql(0.1, 1)}, g AS (SELECT a.*, CAST(CASE WHEN d.pixel_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) xx FROM anom a LEFT JOIN dec d ON d.pixel_id = a.pixel_id),
r AS (SELECT *, sum(xx) OVER w s, count(xx) OVER w n FROM g WINDOW w AS (PARTITION BY row_idx ORDER BY col_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
f AS (SELECT pixel_id, sum(s) OVER v / sum(n) OVER v AS f FROM r WINDOW v AS (PARTITION BY col_idx ORDER BY row_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT pixel_id FROM f ORDER BY floor(f * 1e6 + 0.5) + {u_sql('3', 'pixel_id')} DESC, pixel_id LIMIT (SELECT count(*) FROM dec)""")
def clustering_topk(spark, sf):
    held = anomaly_cells(spark, sf)
    chosen = decisions(held, 0.1, 1)
    return selection.cluster(held, chosen, 0.3, chosen.count(), 3).select("pixel_id")


@query(_quota_sql("equal").replace("0.2", "0.1") + f""", p AS (SELECT CAST(unnest(range(3)) AS INT) sol_id)
SELECT sol_id, pixel_id FROM (SELECT p.sol_id, e.pixel_id, quota, row_number() OVER (PARTITION BY p.sol_id, e.region_id ORDER BY {u_sql('p.sol_id', 'e.pixel_id')}, e.pixel_id) rn FROM p, e JOIN q ON q.region_id = e.region_id) WHERE rn <= quota""")
def burden_sampling(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    solutions = spark.range(3).select(F.col("id").cast("int").alias("sol_id"))
    return selection.sampled_plans(held, solutions, int(0.1 * held.count()), burden="yes").select("sol_id", "pixel_id")


def _pull_sql(plan: str, size: int | None, cells: str, k: str, seed: str = "sol_id") -> str:
    """(sol_id, pixel_id) of the k densest cells of every plan's smoothed map; `plan` and `cells` are CTEs."""
    h = (size or 1) // 2
    smooth = f"""gr AS (SELECT *, sum(xx) OVER w s, count(xx) OVER w n FROM g WINDOW w AS (PARTITION BY sol_id, row_idx ORDER BY col_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
gf AS (SELECT sol_id, pixel_id, sum(s) OVER v / sum(n) OVER v AS f FROM gr WINDOW v AS (PARTITION BY sol_id, col_idx ORDER BY row_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""
    return f"""g AS (SELECT i.sol_id, c.pixel_id, c.row_idx, c.col_idx, CAST(CASE WHEN p.pixel_id IS NULL THEN 0 ELSE 1 END AS DOUBLE) xx
  FROM {cells} c, (SELECT DISTINCT sol_id FROM {plan}) i LEFT JOIN {plan} p ON p.sol_id = i.sol_id AND p.pixel_id = c.pixel_id),
{smooth}, pulled AS (SELECT sol_id, pixel_id FROM (SELECT sol_id, pixel_id, row_number() OVER (PARTITION BY sol_id ORDER BY floor(f * 1e6 + 0.5) + {u_sql(seed, 'pixel_id')} DESC, pixel_id) rn FROM gf) WHERE rn <= {k})"""


_SHARED = _quota_sql("equal").replace("0.2", "0.1") + f""", p3 AS (SELECT CAST(unnest(range(3)) AS INT) sol_id),
plan AS (SELECT sol_id, pixel_id FROM (SELECT p3.sol_id, e.pixel_id, quota, row_number() OVER (PARTITION BY p3.sol_id, e.region_id ORDER BY {u_sql('p3.sol_id', 'e.pixel_id')}, e.pixel_id) rn FROM p3, e JOIN q ON q.region_id = e.region_id) WHERE rn <= quota)"""


@query(f"{_SHARED}, {_pull_sql('plan', 3, 'e', '(SELECT k FROM t)')} SELECT sol_id, pixel_id FROM pulled")
def combined_sampling(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    solutions = spark.range(3).select(F.col("id").cast("int").alias("sol_id"))
    return selection.sampled_plans(held, solutions, int(0.1 * held.count()), 0.3, "yes")


def _inside():
    return F.col("ecosystem").isNotNull()


def _dv_cells(spark, sf):
    return anomaly_cells(spark, sf)


def _seeds(spark, n):
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("dv_id"))


def _dv_sql(n: int, size: int | None, area: str = "ecosystem IS NOT NULL", head: str = ANOM, held: str = "anom") -> str:
    noise = f"SELECT a.*, dv_id, {u_sql('dv_id', 'pixel_id')} AS noise FROM {held} a, (SELECT CAST(unnest(range(1, {n + 1})) AS INT) dv_id)"
    if size:
        h = size // 2
        noise = f"""SELECT * REPLACE (floor(m * 1e9 + 0.5) / 1e9 AS noise) FROM (SELECT *, sum(s) OVER v / nullif(sum(c) OVER v, 0) AS m FROM (
SELECT *, sum(noise) OVER w s, count(noise) OVER w c FROM ({noise}) WINDOW w AS (PARTITION BY dv_id, row_idx ORDER BY col_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING))
WINDOW v AS (PARTITION BY dv_id, col_idx ORDER BY row_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING))"""
    return f"""{head}, nz AS ({noise}), cut AS (SELECT dv_id d, quantile_cont(noise, CAST(0.8 AS DOUBLE)) q FROM nz WHERE {area} GROUP BY 1),
dv AS (SELECT nz.*, CASE WHEN {area} THEN CAST(noise >= q AS INT) END AS dv FROM nz JOIN cut ON d = dv_id)"""


@query(f"WITH {_dv_sql(2, None)} SELECT dv_id, pixel_id, dv FROM dv")
def dv_random(spark, sf):
    return selection.decision_layers(_dv_cells(spark, sf), _seeds(spark, 2), 0.2, None, _inside()).select("dv_id", "pixel_id", "dv")


@query(f"WITH {_dv_sql(2, 3)} SELECT dv_id, pixel_id, dv FROM dv")
def dv_smoothed(spark, sf):
    return selection.decision_layers(_dv_cells(spark, sf), _seeds(spark, 2), 0.2, 3, _inside()).select("dv_id", "pixel_id", "dv")


@query(f"WITH {_dv_sql(20, 3)} SELECT dv_id, count(*) FILTER (dv = 1) AS n1, count(*) FILTER (dv = 0) AS n0, count(*) FILTER (dv IS NULL) AS n_out FROM dv GROUP BY 1")
def dv_ensemble(spark, sf):
    held = selection.decision_layers(_dv_cells(spark, sf).select("pixel_id", "row_idx", "col_idx", "ecosystem"), _seeds(spark, 20), 0.2, 3, _inside())
    return held.groupBy("dv_id").agg(F.count_if(F.col("dv") == 1).alias("n1"), F.count_if(F.col("dv") == 0).alias("n0"), F.count_if(F.col("dv").isNull()).alias("n_out"))


@query(f"WITH {_dv_sql(100, 3)} SELECT dv_id, count(*) FILTER (dv = 1) AS n1, count(*) FILTER (dv = 0) AS n0, count(*) FILTER (dv IS NULL) AS n_out FROM dv GROUP BY 1")
def dv_ensemble_100(spark, sf):
    held = selection.decision_layers(_dv_cells(spark, sf).select("pixel_id", "row_idx", "col_idx", "ecosystem"), _seeds(spark, 100), 0.2, 3, _inside())
    return held.groupBy("dv_id").agg(F.count_if(F.col("dv") == 1).alias("n1"), F.count_if(F.col("dv") == 0).alias("n0"), F.count_if(F.col("dv").isNull()).alias("n_out"))


@query(f"WITH {_dv_sql(6, 3)} SELECT dv_id, {', '.join(q_sql(f'coalesce(sum({x}), 0) - coalesce(sum(CASE WHEN dv IS NULL THEN NULL WHEN dv = 1 THEN 0 ELSE {x} END), 0)', 4) + f' AS {x}' for x in ANOMALIES)} FROM dv GROUP BY 1")
def experiment_all_to_good(spark, sf):
    held = selection.decision_layers(_dv_cells(spark, sf), _seeds(spark, 6), 0.2, 3, _inside())
    return E.set_to_good(held, ANOMALIES).select("dv_id", *map(_q, ANOMALIES))


def _share(value: str) -> str:
    return f"avg(CASE WHEN ({value}) > 0 THEN 1.0 WHEN ({value}) IS NOT NULL THEN 0.0 END)"


def _raised(x: str) -> str:
    return f"CASE WHEN dv IS NULL THEN NULL WHEN dv = 0 THEN {x} + CAST(1.05 AS DOUBLE) * abs({x}) ELSE {x} END"


@query(f"WITH {_dv_sql(6, 3)} SELECT dv_id, {', '.join(q_sql(f'{_share(_raised(x))} - {_share(x)}', 5) + f' AS {x}' for x in ANOMALIES)} FROM dv GROUP BY 1")
def experiment_prop_above(spark, sf):
    held = selection.decision_layers(_dv_cells(spark, sf), _seeds(spark, 6), 0.2, 3, _inside())
    return E.proportion_above(held, ANOMALIES).select("dv_id", *(_q(x, 5) for x in ANOMALIES))


@query(f"""WITH {_dv_sql(3, 3, "true")}, o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest(range(-3, 4)) a), (SELECT unnest(range(-3, 4)) b) WHERE a * a + b * b <= 9),
i AS (SELECT c.dv_id d, c.pixel_id p, CASE WHEN count(n.dv) = 29 AND any_value(c.dv) IS NOT NULL THEN sum(CASE WHEN n.dv = 0 THEN 1.0 ELSE 0.0 END) / 29.0 END AS infl
 FROM dv c, o LEFT JOIN dv n ON n.dv_id = c.dv_id AND n.row_idx = c.row_idx + dr AND n.col_idx = c.col_idx + dc GROUP BY 1, 2)
SELECT dv_id, {', '.join(q_sql(f'{_share(_raised(x))} - {_share(x)}', 5) + f' AS {x}' for x in ('abiotic', 'biotic'))}, {q_sql(f'{_share("landscape + CAST(1.05 AS DOUBLE) * infl * abs(landscape)")} - {_share("landscape")}', 5)} AS landscape
FROM dv JOIN i ON d = dv_id AND p = pixel_id GROUP BY 1""")
def experiment_spillover(spark, sf):
    held = selection.decision_layers(_dv_cells(spark, sf), _seeds(spark, 3), 0.2, 3, F.lit(True))
    return E.spillover(held, ["abiotic", "biotic"], "landscape", disc(300.0, GRID.res)).select("dv_id", *(_q(x, 5) for x in ANOMALIES))


# --- diagnostics ----------------------------------------------------------------------------------


@query(f"""WITH {ANOM}, k AS (SELECT floor(CAST(0.1 AS DOUBLE) * count(*)) k FROM anom WHERE eligible),
s AS (SELECT sol_id, count(*) FILTER ({u_sql('sol_id', 'pixel_id')} < CAST(0.1 AS DOUBLE)) n FROM anom, (SELECT CAST(unnest(range(20)) AS INT) sol_id) WHERE eligible GROUP BY 1)
SELECT count(*) AS plans, count(*) FILTER (n = k) AS exact, count(*) FILTER (n > k) AS over, count(*) FILTER (n < k) AS under FROM s, k""")
def diagnostics_feasibility(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible").select("pixel_id")
    k = int(0.1 * held.count())
    plans = held.crossJoin(F.broadcast(spark.range(20).select(F.col("id").cast("int").alias("sol_id"))))
    sizes = plans.groupBy("sol_id").agg(F.count_if(N.uniform(F.col("sol_id"), F.col("pixel_id")) < 0.1).alias("n"))
    return sizes.agg(F.count("*").alias("plans"), F.count_if(F.col("n") == k).alias("exact"), F.count_if(F.col("n") > k).alias("over"), F.count_if(F.col("n") < k).alias("under"))


@query(f"""WITH {ANOM}, r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('11', 'pixel_id')}, pixel_id) rn, count(*) OVER () n FROM anom WHERE eligible),
f(fraction) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES (0.05), (0.1), (0.15), (0.2)) v(x))
SELECT fraction, count(*) AS k, CAST(sum({gain_sql('abiotic', 0.01)}) AS BIGINT) AS gained, {q_sql('sum(implementation_cost)', 2)} AS cost FROM f JOIN r ON rn <= floor(fraction * n) GROUP BY 1""")
def diagnostics_sensitivity(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    n = held.count()
    # One seed for all fractions, so smaller plans are part of larger ones.
    wanted = spark.createDataFrame([(f, int(f * n)) for f in (0.05, 0.1, 0.15, 0.2)], "fraction double, k long")
    plans = selection.random_subset(held.crossJoin(F.broadcast(wanted)), F.col("k"), 11, ("fraction",))
    return plans.groupBy("fraction").agg(F.count("*").alias("k"), F.sum(E.gain(F.col("abiotic"), 0.01)).cast("long").alias("gained"), N.quant(F.sum(COST), 2).alias("cost"))


@query(f"""WITH {decisions_sql(0.1, 3)}, b AS (SELECT sol_id, abiotic a0, abiotic + CAST(0.01 AS DOUBLE) * {weight_sql('abiotic')} a1 FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id)
SELECT sol_id, {q_sql('avg(a0)', 5)} AS before, {q_sql('avg(a1)', 5)} AS after, {q_sql('100.0 * count(*) FILTER (a0 > 0) / count(*)', 4)} AS pct_before, {q_sql('100.0 * count(*) FILTER (a1 > 0) / count(*)', 4)} AS pct_after FROM b GROUP BY 1""")
def before_after_restored(spark, sf):
    held = anomaly_cells(spark, sf)
    hit = decisions(held, 0.1, 3).join(held.select("pixel_id", F.col("abiotic").alias("a0"), E.improved(F.col("abiotic"), 0.01).alias("a1")), "pixel_id")
    pct = lambda c: N.quant(100.0 * F.count_if(F.col(c) > 0) / F.count("*"), 4)
    return hit.groupBy("sol_id").agg(N.quant(F.avg("a0"), 5).alias("before"), N.quant(F.avg("a1"), 5).alias("after"), pct("a0").alias("pct_before"), pct("a1").alias("pct_after"))


# --- search ---------------------------------------------------------------------------------------


@query(f"""WITH {decisions_sql(0.05, 4)}, p AS (SELECT 0 c, 0 m, 1 f UNION ALL SELECT 1, 2, 3), b AS (
SELECT c, pixel_id, max(CASE WHEN sol_id = m THEN 1 ELSE 0 END) m1, max(CASE WHEN sol_id = f THEN 1 ELSE 0 END) f1 FROM p JOIN dec ON sol_id IN (m, f) GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {u_sql('5', '0', 'c', 'pixel_id')}, pixel_id) r, count(*) OVER (PARTITION BY c) n FROM b WHERE m1 <> f1),
s AS (SELECT c, pixel_id, m1, f1, r <= floor(n / 2) AS sw FROM d UNION ALL SELECT c, pixel_id, m1, f1, false FROM b WHERE m1 = f1)
SELECT CAST(2 * c AS INT) AS sol_id, pixel_id FROM s WHERE CASE WHEN sw THEN f1 ELSE m1 END = 1 UNION ALL SELECT CAST(2 * c + 1 AS INT), pixel_id FROM s WHERE CASE WHEN sw THEN m1 ELSE f1 END = 1""")
def hux_crossover(spark, sf):
    parents = decisions(anomaly_cells(spark, sf), 0.05, 4)
    pairs = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 2, 3)], "scenario_id int, child_id int, mother int, father int")
    return evolve.hux(parents, pairs, 5).select("sol_id", "pixel_id")


@query(f"""WITH {decisions_sql(0.05, 3)}, m AS (SELECT DISTINCT sol_id FROM dec WHERE {u_sql('9', "'ind'", '0', 'sol_id')} < CAST(0.7 AS DOUBLE)),
f AS (SELECT sol_id, pixel_id FROM m, anom WHERE eligible AND {u_sql('9', "'bit'", '0', 'sol_id', 'pixel_id')} < CAST(0.02 AS DOUBLE)), d AS (SELECT sol_id, pixel_id FROM dec)
(SELECT * FROM d EXCEPT SELECT * FROM f) UNION ALL (SELECT * FROM f EXCEPT SELECT * FROM d)""")
def bitflip_mutation(spark, sf):
    held = anomaly_cells(spark, sf)
    return evolve.bit_flip(decisions(held, 0.05, 3), held.where("eligible"), 9, 0.02, 0.7).select("sol_id", "pixel_id")


def _skips_sql(solutions: str, p: float, seed: str, tag: str) -> str:
    """CTEs up to hits(sol_id, pixel_id): the recursion from one hit of a stretch to the next."""
    length = evolve.stretch(p)
    u = u_sql(seed, f"'{tag}'", "'0'", "sol_id", "run", "draw")
    step = f"CAST(floor(ln(1 - {u}) / ln(1 - CAST({p} AS DOUBLE))) AS BIGINT)"
    return f"""runs AS (SELECT sol_id, unnest(range((SELECT max(pixel_id) FROM anom WHERE eligible) // {length} + 1)) AS run FROM {solutions}),
skips(sol_id, run, draw, place) AS (SELECT sol_id, run, 0, {step.replace('draw', '0')} FROM runs UNION ALL
  SELECT sol_id, run, draw, place + 1 + {step} FROM (SELECT sol_id, run, draw + 1 AS draw, place FROM skips WHERE place < {length})),
hits AS (SELECT sol_id, a.pixel_id FROM skips JOIN anom a ON a.pixel_id = run * {length} + place AND eligible WHERE place < {length})"""


@query(f"WITH RECURSIVE {decisions_sql(0.05, 3)}, d AS (SELECT sol_id, pixel_id FROM dec), m AS (SELECT DISTINCT sol_id FROM dec), {_skips_sql('m', 0.02, '9', 'skip')} (SELECT * FROM d EXCEPT SELECT * FROM hits) UNION ALL (SELECT * FROM hits EXCEPT SELECT * FROM d)")
def skip_mutation(spark, sf):
    """Bit flips of which only the flips are drawn."""
    held = anomaly_cells(spark, sf)
    return evolve.bit_flip(decisions(held, 0.05, 3), held.where("eligible"), 9, 0.02, skip=True).select("sol_id", "pixel_id")


@query(f"WITH RECURSIVE {ANOM}, m AS (SELECT CAST(unnest(range(3)) AS INT) sol_id), {_skips_sql('m', 0.5, '42', 'start')} SELECT sol_id, pixel_id FROM hits")
def random_start(spark, sf):
    """First plans of a search: every bit with probability one half."""
    held = anomaly_cells(spark, sf).where("eligible")
    solutions = spark.range(3).select(F.lit(0).alias("scenario_id"), F.col("id").cast("int").alias("sol_id"))
    return evolve.skipped(held, solutions, 0.5, 42, "start").select("sol_id", "pixel_id")


@query()
def evolve_small(spark, sf):
    """Rows only: the end of an iterative search, for scenarios that differ in every parameter; its steps have their SQL or brute-force tests."""
    rows = [
        (0, 0.05, 0.0, "no", 0.01, 0.015, 0.02, "exponential", 1.0), (1, 0.1, 0.0, "yes", 0.02, 0.01, 0.02, "gaussian", 0.5),
        (2, 0.1, 0.3, "no", 0.01, 0.015, 0.01, "exponential", 1.0), (3, 0.05, 0.3, "yes", 0.02, 0.02, 0.01, "exponential", 2.0),
    ]
    names = "scenario_id int, max_restoration_fraction double, spatial_clustering double, burden_sharing string, abiotic_effect double, biotic_effect double, landscape_effect double, anomaly_weight_shape string, anomaly_weight_scale double"
    return evolve.search(anomaly_cells(spark, sf), spark.createDataFrame(rows, names), {x: f"{x}_effect" for x in ANOMALIES}, COST)[1]
