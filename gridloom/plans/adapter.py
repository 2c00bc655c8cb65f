"""The grid that the registered queries run on: cells made from orders, customers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.anomaly import with_anomalies
from ..operators.selection import random_plans
from ..shared import stored
from ..sources.grid import GridSpec

LAYERS = ["smd", "sbd", "soc", "uzl", "ndvi", "tsd", "snh", "frag"]
EFFECTS = {"abiotic": 0.01, "biotic": 0.015, "landscape": 0.02}
ANOMALIES = list(EFFECTS)
COST = "implementation_cost"
GRID = GridSpec(n_rows=1, n_cols=100, x0=2556200.0, y0=1243700.0, res=100.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, 100 to a row of the grid; layers aggregate the order's lines."""
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("smd"), F.avg("l_extendedprice").alias("sbd"), F.avg(F.col("l_extendedprice") * F.col("l_discount")).alias("soc"),
        F.avg(F.when(F.col("l_returnflag") != "N", disc)).alias("uzl"), F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("ndvi"),
        F.avg(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("tsd"), F.sum("l_quantity").alias("snh"), F.max("l_extendedprice").alias("frag"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    held = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    pixel = F.col("o_orderkey")
    return held.select(
        pixel.alias("pixel_id"), GRID.row(pixel).alias("row_idx"), GRID.col(pixel).alias("col_idx"), (11 + F.col("o_custkey") % 8).cast("int").alias("lulc"),
        F.col("c_nationkey").alias("region_id"), F.col("o_totalprice").alias(COST), *LAYERS,
    )


def with_xy(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": GRID.x(F.col("col_idx")), "y": GRID.y(F.col("row_idx"))})


def anomaly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells with their category anomalies, cost, region and eligibility, written once.

    Queries read it several times, a few columns each; the grid under it is aggregated once.
    """
    held = with_anomalies(stored(cells(spark, sf_dir), "cells", spread=True), LAYERS)
    held = held.select("pixel_id", "row_idx", "col_idx", "lulc", "region_id", COST, "ecosystem", *ANOMALIES)
    return stored(held.withColumn("eligible", F.expr("abiotic IS NOT NULL AND biotic IS NOT NULL AND landscape IS NOT NULL")), "anomalies")


def decisions(held: DataFrame, fraction: float, n: int = 10) -> DataFrame:
    """n seeded random plans, each of floor(fraction * eligible) cells: scenario_id, sol_id, pixel_id."""
    free = held.where("eligible").select("pixel_id")
    solutions = held.sparkSession.range(n).select(F.col("id").cast("int").alias("sol_id"))
    return random_plans(free, solutions, int(fraction * free.count())).select(F.lit(0).alias("scenario_id"), "sol_id", "pixel_id")


# --- the same views as SQL ------------------------------------------------------------------------

CELL = """cell AS (
  SELECT o.o_orderkey AS pixel_id, CAST(floor(o.o_orderkey / 100) AS INT) AS row_idx, CAST(o.o_orderkey % 100 AS INT) AS col_idx,
         CAST(11 + o.o_custkey % 8 AS INT) AS lulc, c.c_nationkey AS region_id, o.o_totalprice AS implementation_cost,
         li.smd, li.sbd, li.soc, li.uzl, li.ndvi, li.tsd, li.snh, li.frag
  FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
  LEFT JOIN (SELECT l_orderkey, avg(l_quantity) smd, avg(l_extendedprice) sbd, avg(l_extendedprice * l_discount) soc,
      avg(CASE WHEN l_returnflag <> 'N' THEN l_extendedprice * (1 - l_discount) END) uzl, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) ndvi,
      avg(l_extendedprice * (1 + l_tax)) tsd, sum(l_quantity) snh, max(l_extendedprice) frag
    FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey),
eco AS (SELECT *, CASE WHEN lulc IN (12, 13) THEN 'forest' WHEN lulc = 15 THEN 'agricultural' WHEN lulc IN (16, 17) THEN 'grassland' END AS ecosystem,
        CAST(2556200 AS DOUBLE) + (col_idx + 0.5) * 100 AS x, CAST(1243700 AS DOUBLE) - (row_idx + 0.5) * 100 AS y FROM cell)"""
LONG = CELL + """,
long AS (SELECT * FROM (SELECT pixel_id, row_idx, col_idx, ecosystem, unnest(['smd','sbd','soc','uzl','ndvi','tsd','snh','frag']) AS variable,
         unnest([smd,sbd,soc,uzl,ndvi,tsd,snh,frag]) AS value FROM eco WHERE ecosystem IS NOT NULL) WHERE value IS NOT NULL),
z AS (SELECT l.*, (value - m) / s AS z FROM long l JOIN (SELECT ecosystem e, variable v, avg(value) m, stddev_samp(value) s FROM long GROUP BY 1, 2) t
      ON e = ecosystem AND v = variable WHERE s > 0)"""
ANOM = LONG + """,
wide AS (SELECT pixel_id p, avg(z) FILTER (variable IN ('smd','sbd','soc')) AS abiotic, avg(z) FILTER (variable IN ('uzl','tsd','ndvi')) AS biotic,
         avg(z) FILTER (variable IN ('snh','frag')) AS landscape FROM z GROUP BY 1),
anom AS (SELECT c.pixel_id, row_idx, col_idx, lulc, region_id, implementation_cost, ecosystem, abiotic, biotic, landscape,
         abiotic IS NOT NULL AND biotic IS NOT NULL AND landscape IS NOT NULL AS eligible FROM eco c LEFT JOIN wide w ON w.p = c.pixel_id)"""


def u_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def q_sql(value: str, digits: int) -> str:
    return f"(floor(({value}) * 1e{digits} + 0.500001) / 1e{digits})"


def p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom: the finite series of even and of odd ones."""
    angle, square = f"atan(abs({t}) / sqrt({df}))", f"({df} / ({df} + ({t}) * ({t})))"
    half = "ln(sqrt(pi()))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - {half} + k * ln({square}))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(1, CAST(({df} - 1) // 2 AS BIGINT) + 1), lambda k: cos({angle}) * exp(lgamma(k) + {half} - ln(2) - lgamma(k + 0.5) + (k - 1) * ln({square})))), 0))"
    return f"greatest(1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END, 0.0)"


def stars_sql(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' WHEN {p} IS NOT NULL THEN 'ns' END"


def decisions_sql(fraction: float, n: int = 10) -> str:
    return f"""{ANOM},
dec AS (SELECT 0 AS scenario_id, sol_id, pixel_id FROM (
  SELECT sol_id, pixel_id, row_number() OVER (PARTITION BY sol_id ORDER BY {u_sql('sol_id', 'pixel_id')}, pixel_id) r
  FROM anom, (SELECT CAST(unnest(range({n})) AS INT) sol_id) WHERE eligible)
  WHERE r <= (SELECT floor(CAST({fraction} AS DOUBLE) * count(*)) FROM anom WHERE eligible))"""


def weight_sql(a: str) -> str:
    return f"least(greatest(exp(-abs({a})), 0.0), 1.0)"


def gain_sql(a: str, e: float) -> str:
    return f"CASE WHEN {a} <= 0 AND {a} + CAST({e} AS DOUBLE) * {weight_sql(a)} > 0 THEN 1 ELSE 0 END"


OBJ_SQL = f"""obj AS (
  SELECT scenario_id, sol_id, {', '.join(f"CAST(-((SELECT count(*) FROM anom WHERE {x} > 0) + sum({gain_sql('a.' + x, e)})) AS BIGINT) AS {x}" for x, e in EFFECTS.items())},
         coalesce(sum(a.implementation_cost), 0) AS implementation_cost, avg(abs(a.col_idx - 50)) AS proximity, count(*) AS n_selected
  FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id GROUP BY 1, 2)"""
