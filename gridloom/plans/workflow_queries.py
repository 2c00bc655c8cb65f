"""Queries on whole steps of the workflow: sources and sinks, regions, class maps, repairs, diagnosis."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import anomaly, catalog, selection
from ..operators import cells as C
from ..operators import effects as E
from ..operators.breaks import natural_breaks_by
from ..operators.stats import corr, t_of_r, t_p
from ..shared import session_folder, stored
from ..sources import grid as G
from ..sources import metadata, results
from ..sources.geotiff import write_geotiff
from .adapter import ANOM, ANOMALIES, CELL, COST, EFFECTS, GRID, LAYERS, LONG, OBJ_SQL, anomaly_cells, cells, decisions, decisions_sql, gain_sql, p_sql, q_sql, stars_sql, table, u_sql, weight_sql, with_xy
from .decision_queries import _dv_sql, _pull_sql, _seeds
from .registry import query


def _q(column: str, digits: int = 4):
    return N.quant(F.col(column), digits).alias(column)


# --- sources and sinks ----------------------------------------------------------------------------


@query(f"WITH {CELL} SELECT pixel_id, row_idx, col_idx, lulc FROM cell")
def scan_first_existing(spark, sf):
    """A land cover raster that is at the second of the paths it may be at."""
    folder = session_folder(spark, "lulc")
    write_geotiff(cells(spark, sf), f"{folder}/lulc.tif", GRID, ["lulc"], tile=64, block=2)
    held = G.first_existing(spark, [f"{folder}/no_such_grid.tif", f"{folder}/lulc.tif", f"{sf}/nation.parquet"])
    return held.select("pixel_id", "row_idx", "col_idx", F.col("lulc").cast("int").alias("lulc"))


@query(f"WITH {CELL} SELECT pixel_id, row_idx, col_idx FROM cell WHERE col_idx >= 90 OR pixel_id <> row_idx * 90 + col_idx")
def geometry_misplaced(spark, sf):
    """What the geometry check finds when cells of 100 columns are taken for a grid of 90."""
    return G.misplaced(cells(spark, sf), G.GridSpec(n_rows=2**31 - 1, n_cols=90))


@query(f"WITH {CELL} SELECT pixel_id, {q_sql('smd', 3)} AS smd, {q_sql('ndvi', 3)} AS ndvi, {q_sql('nullif(tsd, -128)', 3)} AS tsd, {q_sql('frag', 3)} AS frag, CAST(NULL AS DOUBLE) AS lai FROM cell")
def scan_indicator_layers(spark, sf):
    """The named indicator layers; those that the grid lacks are left out, here put back as NULL."""
    held = G.scan_indicators(cells(spark, sf))
    return held.select("pixel_id", *(N.quant(F.col(x), 3).alias(x) if x in held.columns else F.lit(None).cast("double").alias(x) for x in ("smd", "ndvi", "tsd", "frag", "lai")))


@query(f"WITH {ANOM} SELECT pixel_id, {', '.join(q_sql(x, 4) + f' AS {x}_anomaly' for x in ('abiotic', 'landscape'))}, {q_sql('implementation_cost', 2)} AS implementation_cost FROM anom")
def scan_objective_layers(spark, sf):
    held = anomaly_cells(spark, sf)
    held = G.scan_objectives(held.withColumnsRenamed({x: f"{x}_anomaly" for x in ANOMALIES}), ["abiotic", "landscape", "cost"])
    return held.select("pixel_id", _q("abiotic_anomaly"), _q("landscape_anomaly"), _q(COST, 2))


@query(f"WITH {CELL} SELECT pixel_id, row_idx, col_idx, lulc, {q_sql('smd', 3)} AS smd FROM cell")
def grid_round_trip(spark, sf):
    """Cells written as a grid, partitioned by land cover, and read again."""
    path = f"{session_folder(spark, 'grid')}/cells"
    G.write_grid(cells(spark, sf).select("pixel_id", "row_idx", "col_idx", "lulc", "smd"), path, ("lulc",))
    return spark.read.parquet(path).select("pixel_id", "row_idx", "col_idx", "lulc", _q("smd", 3))


@query(f"WITH {decisions_sql(0.1, 6)}, {OBJ_SQL} SELECT run, scenario_id, sol_id, abiotic, n_selected FROM obj, (VALUES (1), (2)) r(run)")
def result_round_trip(spark, sf):
    """The same run saved twice under numbers of its own, and both read again."""
    held = anomaly_cells(spark, sf)
    plans = stored(decisions(held, 0.1, 6), "plans")
    points = stored(E.objectives(held, plans, EFFECTS, COST), "points")
    folder, out = session_folder(spark, "results"), None
    for n in (1, 2):
        path = results.run_path(spark, folder, datetime.date(2024, 5, 17), "forest")
        results.save_run(plans, points, spark.createDataFrame([(0, 0.1)], "scenario_id int, fraction double"), path)
        found = results.load_run(spark, path)["objective"].select(F.regexp_extract(F.lit(path), r"results_forest_1705_(\d+)$", 1).cast("int").alias("run"), "scenario_id", "sol_id", "abiotic", "n_selected")
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {decisions_sql(0.1, 6)}, {OBJ_SQL} SELECT scenario_id, count(*) AS n_solutions, min(abiotic) AS lo, max(abiotic) AS hi, {q_sql('avg(implementation_cost)', 2)} AS cost FROM obj GROUP BY 1")
def saved_summary(spark, sf):
    """The JSON summary of a run's ranges, written and read again."""
    held = anomaly_cells(spark, sf)
    plans = decisions(held, 0.1, 6)
    path = f"{session_folder(spark, 'summary')}/run"
    results.save_run(plans, stored(E.objectives(held, plans, EFFECTS, COST), "points"), spark.createDataFrame([(0, 0.1)], "scenario_id int, fraction double"), path)
    found = spark.read.json(f"{path}/summary")
    return found.select(F.col("scenario_id").cast("int").alias("scenario_id"), "n_solutions", F.col("abiotic.min").alias("lo"), F.col("abiotic.max").alias("hi"), N.quant(F.col(f"{COST}.mean"), 2).alias("cost"))


@query(f"""WITH {CELL}, g(region, crs, xmin, ymin, xmax, ymax, n_rows, n_cols) AS (SELECT * FROM (VALUES ('Bern', 'EPSG:2056', CAST(2556200 AS DOUBLE), CAST(1130600 AS DOUBLE), CAST(2677700 AS DOUBLE), CAST(1243700 AS DOUBLE), NULL, NULL), ('CH', 'EPSG:2056', 2480000, 1070000, 2834000, 1300000, 2300, 3600)) t)
SELECT g.*, (SELECT count(*) FROM eco WHERE x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax) AS n_cells FROM g""")
def region_references(spark, sf):
    """The regions that are known, and how many of the cells lie within their bounds."""
    held = with_xy(cells(spark, sf)).crossJoin(F.broadcast(catalog.region_rows(spark)))  # two regions
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return held.groupBy("region", "crs", "xmin", "ymin", "xmax", "ymax", "n_rows", "n_cols").agg(F.count_if(inside).alias("n_cells"))


@query()
def table_files(spark, sf):
    """Rows only: sizes of files, which SQL over the tables does not see."""
    inside = F.regexp_extract("path", r"([^/]+\.parquet(?:/.*)?)$", 1)
    return metadata.file_sizes(spark, sf).select(inside.alias("file"), "megabytes")


def _sheet(spark, sf):
    """A metadata sheet with some of its columns, written as CSV; Coverage counts the cells with a value."""
    path = f"{session_folder(spark, 'sheet')}/indicators"
    rows = catalog.indicator_rows(spark).groupBy(F.col("indicator").alias("code")).agg(F.min("class").alias("Class"), F.array_join(F.array_sort(F.collect_set("ecosystem")), " / ").alias("Ecosystems"))
    long = anomaly.to_long(cells(spark, sf).where(catalog.ecosystem_of(F.col("lulc")).isNotNull()), LAYERS, ["pixel_id"])
    there = long.groupBy(F.col("variable").alias("code")).agg(F.count("*").cast("string").alias("Coverage"))
    rows = rows.join(F.broadcast(there), "code", "left")  # a row a variable
    rows.withColumn("Indicator", catalog.label_of(F.col("code"), catalog.LABELS)).coalesce(1).write.option("header", True).csv(path)
    return metadata.indicator_sheet(spark, path)


_SHEET = f"""i(code, kind, ecosystem) AS (VALUES {', '.join(f"('{c}', '{k}', '{e}')" for (e, k), codes in catalog.INDICATORS.items() for c in codes)}), labels(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in catalog.LABELS.items())}),
there AS (SELECT variable, CAST(count(*) AS VARCHAR) AS n FROM long GROUP BY 1),
sheet AS (SELECT i.code, any_value(label) AS "Indicator", min(kind) AS "Class", string_agg(DISTINCT ecosystem, ' / ' ORDER BY ecosystem) AS "Ecosystems", any_value(there.n) AS "Coverage" FROM i LEFT JOIN labels ON labels.code = i.code LEFT JOIN there ON variable = i.code GROUP BY 1)"""


@query(f'WITH {LONG}, {_SHEET} SELECT code, "Indicator", "Class", "Ecosystems", CAST(NULL AS VARCHAR) AS "Units", "Coverage" FROM sheet')
def metadata_sheet(spark, sf):
    return _sheet(spark, sf).select("code", "Indicator", "Class", "Ecosystems", "Units", "Coverage")


@query(f'WITH {LONG}, {_SHEET}, n AS (SELECT *, CAST(row_number() OVER (ORDER BY code) AS INT) AS nr FROM sheet) SELECT nr AS row, "Indicator", "Class", "Ecosystems", CAST(NULL AS VARCHAR) AS "Time series", "Coverage", nr IN (1, 5, 16) AS line_after FROM n')
def time_series_table(spark, sf):
    return metadata.time_series_table(_sheet(spark, sf))


# --- cell values ------------------------------------------------------------------------------------

_ODD = "CASE col_idx % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN NULL WHEN 3 THEN CAST('-inf' AS DOUBLE) ELSE smd END"


@query(f"WITH {CELL} SELECT pixel_id, {q_sql('CASE WHEN col_idx % 5 = 4 THEN coalesce(smd, 0) ELSE 0 END', 3)} AS v, col_idx % 5 IN (0, 2) OR smd IS NULL AND col_idx % 5 = 4 AS missing FROM cell")
def sanitised_layer(spark, sf):
    """A layer with NaN and infinities: as 0 throughout, and which cells count as missing."""
    held = cells(spark, sf).select("pixel_id", F.expr(_ODD).alias("odd"))
    return held.select("pixel_id", N.quant(N.or_zero(F.col("odd")), 3).alias("v"), N.clean(F.col("odd")).isNull().alias("missing"))


_R = "corr(smd, frag) FILTER (smd IS NOT NULL AND frag IS NOT NULL)"


@query(f"""WITH {CELL}, c AS (SELECT region_id, count(*) FILTER (smd IS NOT NULL AND frag IS NOT NULL) AS n, {_R} AS r FROM cell GROUP BY 1),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c), p AS (SELECT *, {p_sql('t', '(n - 2)')} AS p FROM t)
SELECT region_id, n, {q_sql('r', 5)} AS r, {q_sql('p', 6)} AS p, {stars_sql('p')} AS stars FROM p""")
def significance_stars(spark, sf):
    """Correlation of moisture deficit and fragmentation in every region, with its significance."""
    both = F.count_if(F.col("smd").isNotNull() & F.col("frag").isNotNull())
    held = cells(spark, sf).groupBy("region_id").agg(both.alias("n"), corr("smd", "frag").alias("r"))
    held = held.withColumn("p", t_p(spark, t_of_r(F.col("r"), F.col("n")), F.col("n") - 2))
    return held.select("region_id", "n", _q("r", 5), _q("p", 6), N.stars(F.col("p")).alias("stars"))


# --- regions --------------------------------------------------------------------------------------

_RINGS = {
    "A": [(2556900.0, 1243650.0), (2561300.0, 1243450.0), (2563100.0, 1241900.0), (2559900.0, 1241250.0), (2557700.0, 1242450.0)],
    "B": [(2559000.0, 1243700.0), (2565000.0, 1243700.0), (2565000.0, 1241700.0), (2559000.0, 1241700.0)],
    "C": [(2556300.0, 1242500.0), (2558300.0, 1242700.0), (2558000.0, 1240900.0)],
}
_VERTICES = ", ".join(f"('{name}', 0, {i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for name, ring in _RINGS.items() for i, (x, y) in enumerate(ring))
_INSIDE = f"""vertex(name, ring_id, seq, x, y) AS (VALUES {_VERTICES}),
edge AS (SELECT name AS region, x AS x1, y AS y1, coalesce(lead(x) OVER r, first(x) OVER r) AS x2, coalesce(lead(y) OVER r, first(y) OVER r) AS y2 FROM vertex WINDOW r AS (PARTITION BY name, ring_id ORDER BY seq)),
inside AS (SELECT pixel_id, region FROM eco, edge WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _edges(spark, wanted=None):
    rows = [(name, 0, i, x, y) for name, ring in _RINGS.items() for i, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "name string, ring_id int, seq int, x double, y double")
    return C.ring_edges(vertices) if wanted is None else C.ring_edges(vertices, "name", wanted)


@query(f"WITH {CELL}, {_INSIDE} SELECT pixel_id, region FROM inside WHERE region = 'B'")
def polygon_table_scan(spark, sf):
    """Polygons from a table of vertices, picked by attribute."""
    return C.in_polygons(with_xy(cells(spark, sf)), _edges(spark, "B"))


@query(f"WITH {CELL}, {_INSIDE} SELECT pixel_id, region FROM inside WHERE region <> 'A' AND pixel_id IN (SELECT pixel_id FROM inside WHERE region = 'A')")
def polygon_clip(spark, sf):
    return C.polygon_clip(with_xy(cells(spark, sf)), _edges(spark), "A")


@query(f"WITH {CELL}, {_INSIDE} SELECT pixel_id, lulc, 'forest' AS mask FROM eco WHERE lulc IN (12, 13) AND pixel_id IN (SELECT pixel_id FROM inside WHERE region = 'A') UNION ALL SELECT pixel_id, lulc, 'no_mask' FROM eco WHERE pixel_id IN (SELECT pixel_id FROM inside WHERE region = 'A')")
def region_ecosystem_mask(spark, sf):
    held, edges = with_xy(cells(spark, sf)), _edges(spark)
    masks = [C.region_ecosystem_mask(held, m, edges, "A").select("pixel_id", "lulc", F.lit(m).alias("mask")) for m in ("forest", "no_mask")]
    return masks[0].unionByName(masks[1])


# --- layer names ----------------------------------------------------------------------------------


@query(f"WITH {LONG} SELECT pixel_id, {q_sql('avg(z) FILTER (variable IN (' + repr('smd') + ', ' + repr('soc') + '))', 4)} AS m FROM z WHERE variable IN ('smd', 'soc') GROUP BY 1")
def layers_by_prefix(spark, sf):
    """Mean over the layers of a stack whose names begin with a wanted variable and `_anom`."""
    held = cells(spark, sf)
    z = anomaly.anomalies(held, ["smd", "soc", "snh"]).withColumn("name", F.concat(F.col("variable"), F.lit("_anom_"), F.col("ecosystem")))
    stack = [f"{v}_anom_{e}" for v in ("snh", "smd", "soc") for e in catalog.ECOSYSTEM_CODES]
    wide = anomaly.to_wide(z, ["pixel_id"], "name", "z", stack)
    wanted = [F.col(x) for x in catalog.layers_of(stack, ["smd", "soc", "absent"])]
    n = sum((c.isNotNull().cast("int") for c in wanted), F.lit(0))
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in wanted), F.lit(0.0)) / F.when(n > 0, n)
    return wide.select("pixel_id", N.quant(mean, 4).alias("m")).where("m IS NOT NULL")


# --- natural breaks and the composite class map -----------------------------------------------------


def _breaks_sql(source: str, classes: int = 5) -> str:
    """CTE brk(g, i, bound): natural breaks of every group g of source(g, v), by the dynamic programme over distinct values."""
    steps = ["b1 AS (SELECT g, i AS j, sq - sx * sx / sw AS best, CAST(0 AS BIGINT) AS start FROM pre WHERE i > 0)"]
    for k in range(2, classes + 1):
        cost = "b.best + (e.sq - s.sq) - (e.sx - s.sx) * (e.sx - s.sx) / (e.sw - s.sw)"
        steps.append(f"b{k} AS (SELECT e.g, e.i AS j, min({cost}) AS best, arg_min(s.i, {cost}) AS start FROM b{k - 1} b JOIN pre s ON s.g = b.g AND s.i = b.j JOIN pre e ON e.g = b.g AND e.i > b.j GROUP BY e.g, e.i)")
    back = [f"e{classes} AS (SELECT g, max(i) AS j FROM pre GROUP BY g)"]
    for k in range(classes, 1, -1):
        back.append(f"e{k - 1} AS (SELECT e.g, b.start AS j FROM e{k} e JOIN b{k} b ON b.g = e.g AND b.j = e.j)")
    ends = " UNION ALL ".join(f"SELECT g, {k} AS i, j FROM e{k}" for k in range(1, classes + 1))
    return f"""val AS (SELECT g, v, CAST(count(*) AS DOUBLE) AS w FROM ({source}) WHERE v IS NOT NULL GROUP BY ALL), mid AS (SELECT g AS mg, sum(v * w) / sum(w) AS c FROM val GROUP BY 1),
pre AS (SELECT g, v, row_number() OVER o AS i, sum(w) OVER o AS sw, sum(w * (v - c)) OVER o AS sx, sum(w * (v - c) * (v - c)) OVER o AS sq FROM val JOIN mid ON mg = g WINDOW o AS (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT DISTINCT g, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), 0.0, 0.0, 0.0 FROM val), {', '.join(steps)}, {', '.join(back)},
brk AS (SELECT g, CAST(0 AS INT) AS i, min(v) AS bound FROM val GROUP BY g UNION ALL SELECT n.g, CAST(n.i AS INT), p.v FROM ({ends}) n JOIN pre p ON p.g = n.g AND p.i = n.j)"""


_SMD = "SELECT 0 AS g, smd AS v FROM cell"


@query(f"WITH {CELL}, {_breaks_sql(_SMD)} SELECT i, bound FROM brk")
def fisher_breaks(spark, sf):
    bounds = natural_breaks_by(cells(spark, sf).select(F.col("smd").cast("double").alias("v")), "v", 5)
    return bounds.select(F.posexplode("breaks").alias("i", "bound"))


def _composite(spark, held):
    """(pixel_id, row_idx, col_idx, ecosystem, out): the condition index of each ecosystem in its own five natural classes, as one map."""
    mine = held.where("ecosystem IS NOT NULL")
    bounds = natural_breaks_by(mine.select("ecosystem", F.col("smd").cast("double").alias("v")), "v", 5, ("ecosystem",))
    mine = mine.join(F.broadcast(bounds), "ecosystem", "left")  # a row an ecosystem
    return mine.select("pixel_id", "row_idx", "col_idx", "ecosystem", N.class_among(F.col("smd"), F.col("breaks")).alias("out"))


_CLASSES = f"""{_breaks_sql('SELECT ecosystem AS g, smd AS v FROM eco WHERE ecosystem IS NOT NULL')},
comp AS (SELECT c.pixel_id, c.row_idx, c.col_idx, c.ecosystem, (SELECT min(greatest(i, 1)) FROM brk WHERE g = c.ecosystem AND c.smd <= bound) AS out FROM eco c WHERE c.ecosystem IS NOT NULL)"""


def _with_ecosystem(spark, sf):
    return stored(cells(spark, sf).withColumn("ecosystem", catalog.ecosystem_of(F.col("lulc"))).select("pixel_id", "row_idx", "col_idx", "lulc", "ecosystem", "smd"), "classes")


@query(f"WITH {CELL}, {_CLASSES} SELECT pixel_id, ecosystem, CAST(out AS INT) AS out FROM comp")
def composite_class_map(spark, sf):
    return _composite(spark, _with_ecosystem(spark, sf)).select("pixel_id", "ecosystem", "out")


@query(f"WITH {CELL}, {_CLASSES} SELECT ecosystem, CAST(out AS VARCHAR) AS val, count(*) AS n FROM comp WHERE CAST(out AS VARCHAR) IN ('1', '2', '3', '4', '5') GROUP BY ALL")
def composite_class_bars(spark, sf):
    """Bars of the class map: classes as text, those of the scale only."""
    held = _composite(spark, _with_ecosystem(spark, sf)).withColumn("val", F.col("out").cast("string"))
    return held.where(F.col("val").isin("1", "2", "3", "4", "5")).groupBy("ecosystem", "val").agg(F.count("*").alias("n"))


def _c3(x: str) -> str:
    return f"CASE WHEN {x} <= -sd_{x} THEN '3' WHEN {x} <= sd_{x} THEN '2' ELSE '1' END"


_PAIRS = {"ab": ("abiotic", "biotic"), "bl": ("biotic", "landscape"), "al": ("abiotic", "landscape")}
_FILLS = ", ".join(f"('{k}', '{p}', '{c}')" for k, colours in catalog.COLOURS.items() for p, c in zip(catalog.PAIRS, colours))


@query(f"""WITH {ANOM}, {_CLASSES}, sd AS (SELECT *, {', '.join(f'stddev_samp({x}) OVER (PARTITION BY ecosystem) sd_{x}' for x in ANOMALIES)} FROM anom WHERE eligible),
pairs AS ({' UNION ALL '.join(f"SELECT row_idx, col_idx, pixel_id, '{k}' AS pair, {_c3(a)} || ' - ' || {_c3(b)} AS grp FROM sd" for k, (a, b) in _PAIRS.items())}), fills(pair, grp, fill) AS (VALUES {_FILLS})
SELECT p.pixel_id, p.pair, CAST(split_part(p.grp, ' - ', 1) AS INT) AS first_class, CAST(split_part(p.grp, ' - ', 2) AS INT) AS second_class, CASE WHEN out IS NULL THEN NULL WHEN out >= 3 THEN 'grey70' ELSE fill END AS shown
FROM pairs p LEFT JOIN fills f ON f.pair = p.pair AND f.grp = p.grp LEFT JOIN comp c ON c.row_idx = p.row_idx AND c.col_idx = p.col_idx""")
def greyed_bivariate_maps(spark, sf):
    """The three pair maps, grey where the composite class says good condition; cells meet by row and column."""
    held = anomaly_cells(spark, sf).where("eligible")
    sds = held.groupBy("ecosystem").agg(*(F.stddev_samp(x).alias(f"sd_{x}") for x in ANOMALIES))
    held = held.join(F.broadcast(sds), "ecosystem")
    code = {x: N.class3(F.col(x), F.col(f"sd_{x}")) for x in ANOMALIES}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.concat_ws(" - ", code[a], code[b]).alias("grp")) for k, (a, b) in _PAIRS.items())))
    pairs = held.select("pixel_id", "row_idx", "col_idx", pairs.alias("p")).select("pixel_id", "row_idx", "col_idx", "p.pair", "p.grp")
    fills = None
    for k in _PAIRS:
        one = catalog.legend(spark, k).withColumn("pair", F.lit(k))
        fills = one if fills is None else fills.unionByName(one)
    classes = _composite(spark, _with_ecosystem(spark, sf)).select("row_idx", "col_idx", "out")
    shown = pairs.join(F.broadcast(fills), ["pair", "grp"], "left").join(classes, ["row_idx", "col_idx"], "left")
    part = F.split("grp", " - ")
    return shown.select("pixel_id", "pair", part[0].cast("int").alias("first_class"), part[1].cast("int").alias("second_class"), N.if_else(F.col("out") >= 3, F.lit("grey70"), F.col("fill")).alias("shown"))


_POOR = f"{ANOM}, {_CLASSES}, classed AS (SELECT a.*, coalesce(out IN (1, 2), false) AS poor FROM anom a LEFT JOIN comp c ON c.pixel_id = a.pixel_id)"


@query(f"WITH {_dv_sql(2, 3, 'poor', _POOR, 'classed')} SELECT dv_id, pixel_id, dv FROM dv")
def dv_poor_condition(spark, sf):
    """Decision layers over the cells of classes 1 and 2 of the composite map."""
    classes = _composite(spark, _with_ecosystem(spark, sf)).select("pixel_id", "out")
    held = anomaly_cells(spark, sf).select("pixel_id", "row_idx", "col_idx").join(classes, "pixel_id", "left")
    return selection.decision_layers(held, _seeds(spark, 2), 0.2, 3, F.coalesce(F.col("out").isin(1, 2), F.lit(False))).select("dv_id", "pixel_id", "dv")


_CENTRES = [(-0.5, 0.0, 0.3), (0.2, -0.4, -0.2), (0.6, 0.7, 0.1)]


@query(f"""WITH {ANOM}, c AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))' for i, (a, b, c) in enumerate(_CENTRES))}) v(k, x, y, z)),
d AS (SELECT pixel_id, abiotic, biotic, landscape, arg_min(k, row((abiotic - x) * (abiotic - x) + (biotic - y) * (biotic - y) + (landscape - z) * (landscape - z), k)) AS cluster FROM anom, c WHERE eligible GROUP BY ALL)
SELECT CAST(cluster AS INT) AS cluster, count(*) AS n, {', '.join(f'{q_sql(f"avg({x})", 4)} AS {x}' for x in ANOMALIES)} FROM d GROUP BY 1""")
def cluster_summary(spark, sf):
    """Size and means of the clusters of given centres; kmeans_clusters finds its own."""
    far = [sum((((F.col(x) - F.lit(v)) * (F.col(x) - F.lit(v))) for x, v in zip(ANOMALIES[1:], c[1:])), (F.col(ANOMALIES[0]) - F.lit(c[0])) * (F.col(ANOMALIES[0]) - F.lit(c[0]))) for c in _CENTRES]
    nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("k")) for i, d in enumerate(far))))["k"]
    return anomaly_cells(spark, sf).where("eligible").groupBy(nearest.alias("cluster")).agg(F.count("*").alias("n"), *(N.quant(F.avg(x), 4).alias(x) for x in ANOMALIES))


# --- sampling and repair --------------------------------------------------------------------------

_BITS = f"""e AS (SELECT * FROM anom WHERE eligible), t0 AS (SELECT floor(CAST(0.1 AS DOUBLE) * count(*)) k FROM e),
bits AS (SELECT sol_id, e.*, CAST({u_sql('sol_id', 'pixel_id')} < CAST([0.02, 0.10, 0.30][sol_id + 1] AS DOUBLE) AS INT) AS x FROM e, (SELECT CAST(unnest(range(3)) AS INT) sol_id))"""
_SHARES = """rg AS (SELECT region_id, count(*) n FROM e GROUP BY 1), tt AS (SELECT k, count(*) m FROM rg, t0 GROUP BY k), qa AS (SELECT region_id, n, k, least(CAST(floor(k / m) AS BIGINT), n) q0 FROM rg, tt),
qb AS (SELECT *, k - sum(q0) OVER () AS left_, coalesce(sum(n - q0) OVER (ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) room FROM qa),
q AS (SELECT region_id, CAST(q0 + greatest(0, least(n - q0, left_ - room)) AS BIGINT) AS quota FROM qb)"""


def _bits(spark, held):
    plans = held.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("sol_id"))))
    limit = F.element_at(F.array(F.lit(0.02), F.lit(0.10), F.lit(0.30)), F.col("sol_id") + 1)
    return plans.withColumn("x", (N.uniform(F.col("sol_id"), F.col("pixel_id")) < limit).cast("int"))


def _eligible(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    return held, int(0.1 * held.count())


@query(f"""WITH {ANOM}, {_BITS} SELECT sol_id, pixel_id, x FROM (SELECT *, row_number() OVER (PARTITION BY sol_id ORDER BY x DESC, {u_sql('13', 'sol_id', 'pixel_id')}, pixel_id) r FROM bits) WHERE r <= (SELECT k FROM t0)""")
def random_repair(spark, sf):
    held, k = _eligible(spark, sf)
    return selection.random_repair(_bits(spark, held), k, 13).select("sol_id", "pixel_id", "x")


_SHARED_BITS = f"""shared AS (SELECT sol_id, pixel_id FROM (SELECT b.*, quota, row_number() OVER (PARTITION BY sol_id, b.region_id ORDER BY x DESC, {u_sql('17', 'sol_id', 'b.region_id', 'pixel_id')}, pixel_id) r FROM bits b JOIN q ON q.region_id = b.region_id) WHERE r <= quota)"""


@query(f"WITH {ANOM}, {_BITS}, {_SHARES}, {_SHARED_BITS} SELECT sol_id, pixel_id FROM shared")
def burden_repair(spark, sf):
    held, k = _eligible(spark, sf)
    return selection.burden_repair(_bits(spark, held), k, 17).select("sol_id", "pixel_id")


@query(f"WITH {ANOM}, {_BITS}, ones AS (SELECT sol_id, pixel_id FROM bits WHERE x = 1), {_pull_sql('ones', 3, 'e', '(SELECT k FROM t0)')} SELECT sol_id, pixel_id FROM pulled")
def clustering_repair(spark, sf):
    held, k = _eligible(spark, sf)
    return selection.clustering_repair(_bits(spark, held), k, 0.3).select("sol_id", "pixel_id")


@query(f"WITH {ANOM}, {_BITS}, {_SHARES}, {_SHARED_BITS}, {_pull_sql('shared', 3, 'e', '(SELECT k FROM t0)')} SELECT sol_id, pixel_id FROM pulled")
def combined_repair(spark, sf):
    """Quotas of the regions first, then the densest cells."""
    held, k = _eligible(spark, sf)
    wanted = spark.range(3).select(F.col("id").cast("int").alias("sol_id"), F.lit(k).cast("long").alias("k"))
    plan = selection.burdened(held, _bits(spark, held).where("x = 1"), wanted, 17)
    return selection.clustered(held, plan, wanted, 0.3, F.col("sol_id"))


@query(f"""WITH {ANOM}, e AS (SELECT * FROM anom WHERE eligible), t0 AS (SELECT floor(CAST(0.1 AS DOUBLE) * count(*)) k FROM e), s AS (SELECT CAST(unnest(range(3)) AS INT) sol_id),
c AS (SELECT sol_id, floor({u_sql('19', "'start'", 'sol_id')} * (k + 1)) c FROM s, t0), first AS (SELECT sol_id, pixel_id, r <= c AS x FROM (SELECT c.*, pixel_id, row_number() OVER (PARTITION BY sol_id ORDER BY {u_sql("concat_ws(':', '19', sol_id)", 'pixel_id')}, pixel_id) r FROM e, c)),
{_SHARES}, b AS (SELECT f.sol_id, f.pixel_id, e.region_id, CAST(x AS INT) x FROM first f JOIN e ON e.pixel_id = f.pixel_id)
SELECT sol_id, pixel_id, x FROM (SELECT b.*, quota, row_number() OVER (PARTITION BY sol_id, b.region_id ORDER BY x DESC, {u_sql('19', 'sol_id', 'b.region_id', 'pixel_id')}, pixel_id) r FROM b JOIN q ON q.region_id = b.region_id) WHERE r <= quota""")
def burden_start(spark, sf):
    """Starting plans of a random number of cells, brought to k cells within the regions' quotas."""
    held, k = _eligible(spark, sf)
    solutions = spark.range(3).select(F.col("id").cast("int").alias("sol_id"))
    every = selection.dense(held.select("pixel_id", "region_id"), selection.random_starts(held, solutions, k, 19), solutions)
    every = stored(every, "dense")  # read several times
    return selection.burden_repair(every, k, 19).select("sol_id", "pixel_id", "x")


_FRACTIONS, _STRENGTHS = (0.15, 0.25, 0.35, 0.5), (0.0, 0.3, 0.6, 1.0)
_WINDOWS = {0.0: 1, 0.3: 3, 0.6: 15, 1.0: 31}


def _map_sql(number: int, fraction: float, strength: float) -> str:
    inner = _pull_sql("p", _WINDOWS[strength], "e", "(SELECT count(*) FROM p)", "42")
    return f"""SELECT {number} AS map_id, pixel_id FROM (WITH p AS (SELECT 0 AS sol_id, pixel_id FROM (SELECT pixel_id, row_number() OVER (ORDER BY {u_sql('42', 'pixel_id')}, pixel_id) rn, count(*) OVER () n FROM e) WHERE rn <= floor(CAST({fraction} AS DOUBLE) * n)), {inner} SELECT pixel_id FROM pulled)"""


_MAPS = [(i, f, 0.3) for i, f in enumerate(_FRACTIONS)] + [(4 + i, 0.25, s) for i, s in enumerate(_STRENGTHS)]


@query(f"WITH {ANOM}, e AS (SELECT * FROM anom WHERE eligible) " + " UNION ALL ".join(_map_sql(*m) for m in _MAPS))
def parameter_illustration(spark, sf):
    """Eight maps: four fractions at one clustering strength, four strengths at one fraction."""
    held = anomaly_cells(spark, sf).where("eligible").select("pixel_id", "row_idx", "col_idx")
    n, out = held.count(), None
    # One seed for all maps, so each cell is drawn once; maps of a strength are clustered together.
    drawn = stored(held.select("pixel_id", N.draw(42, F.col("pixel_id")).alias("drawn")), "draws")
    wanted = spark.createDataFrame([(number, strength, int(fraction * n)) for number, fraction, strength in _MAPS], "map_id int, strength double, k long")
    plans = drawn.crossJoin(F.broadcast(wanted.select("k").distinct()))
    plans = selection.first_drawn(plans, F.col("k"), F.col("drawn"), ("k",)).select("k", "pixel_id")
    for strength in sorted({s for _, _, s in _MAPS}):
        mine = wanted.where(F.col("strength") == strength).select("map_id", "k")
        part = plans.join(F.broadcast(mine), "k").select("map_id", "pixel_id")
        if strength > 0:
            part = selection.clustered(held, part, mine, strength, F.lit(42), ("map_id",))
        out = part if out is None else out.unionByName(part)
    return out


# --- diagnosis of a setup ---------------------------------------------------------------------------


def _percent(base: str, new: str) -> str:
    return f"CASE WHEN ({base}) = 0 THEN 0.0 ELSE 100.0 * (({base}) - ({new})) / abs({base}) END"


_BASE = f"base AS (SELECT {', '.join(f'-count(*) FILTER ({x} > 0) AS {x}' for x in ANOMALIES)} FROM anom)"


@query(f"WITH {decisions_sql(0.1)}, {OBJ_SQL}, {_BASE} SELECT sol_id, {', '.join(q_sql(_percent('base.' + x, 'obj.' + x), 4) + f' AS {x}' for x in ANOMALIES)}, 0.0 AS implementation_cost, CAST(abs(n_selected - (SELECT floor(CAST(0.1 AS DOUBLE) * count(*)) FROM anom WHERE eligible)) AS BIGINT) AS violation FROM obj, base")
def diagnosis_improvement(spark, sf):
    """Percent improvement of every objective by sample plans against restoring nothing, and the constraint's value."""
    held = anomaly_cells(spark, sf)
    k = int(0.1 * held.where("eligible").count())
    nothing = E.objectives(held, decisions(held, 0.1).where("false"), EFFECTS, COST, solutions=spark.createDataFrame([(0, 0)], "scenario_id int, sol_id int"))
    points = E.objectives(held, decisions(held, 0.1), EFFECTS, COST, k=k)
    points = points.crossJoin(F.broadcast(nothing.select(*(F.col(x).alias(f"base_{x}") for x in (*ANOMALIES, COST)))))
    better = [N.quant(N.percent_improvement(F.col(f"base_{x}").cast("double"), F.col(x).cast("double"), True), 4).alias(x) for x in ANOMALIES]
    return points.select("sol_id", *better, N.percent_improvement(F.col(f"base_{COST}"), F.col(COST)).alias(COST), "violation")


@query(f"""WITH {ANOM}, {_BASE}, r AS (SELECT *, row_number() OVER (ORDER BY {u_sql('11', 'pixel_id')}, pixel_id) rn, count(*) OVER () n FROM anom WHERE eligible),
f(fraction) AS (SELECT CAST(x AS DOUBLE) FROM (VALUES (0.05), (0.1), (0.15), (0.2)) v(x)),
g AS (SELECT fraction, count(*) AS k, {', '.join(f'sum({gain_sql("r." + x, e)}) AS g_{x}' for x, e in EFFECTS.items())} FROM f JOIN r ON rn <= floor(fraction * n) GROUP BY 1)
SELECT fraction, k, {q_sql('(' + ' + '.join(_percent('base.' + x, f'base.{x} - g_{x}') for x in ANOMALIES) + ') / 3', 4)} AS improvement FROM g, base""")
def diagnosis_sensitivity(spark, sf):
    """Mean percent improvement of the anomaly objectives by the share of cells restored."""
    held = anomaly_cells(spark, sf)
    free = held.where("eligible")
    n = free.count()
    wanted = spark.createDataFrame([(i, f, int(f * n)) for i, f in enumerate((0.05, 0.1, 0.15, 0.2))], "sol_id int, fraction double, k long")
    plans = selection.random_subset(free.select("pixel_id").crossJoin(F.broadcast(wanted)), F.col("k"), 11, ("sol_id",)).withColumn("scenario_id", F.lit(0))
    points = E.objectives(held, plans, EFFECTS).join(F.broadcast(wanted), "sol_id")
    base = held.agg(*((-F.count_if(F.col(x) > 0)).cast("double").alias(f"base_{x}") for x in ANOMALIES))
    points = points.crossJoin(F.broadcast(base))
    total = sum((N.percent_improvement(F.col(f"base_{x}"), F.col(x).cast("double"), True) for x in ANOMALIES), F.lit(0.0))
    return points.select("fraction", "k", N.quant(total / 3, 4).alias("improvement"))


@query(f"""WITH {decisions_sql(0.1, 3)}, v AS ({' UNION ALL '.join(f"SELECT sol_id, '{x}' AS layer, {x} AS a0, {x} + CAST({e} AS DOUBLE) * {weight_sql(x)} AS a1 FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id" for x, e in EFFECTS.items())})
SELECT sol_id, layer, count(*) AS n, {', '.join(f'{q_sql(f"{f}({c})", 4)} AS {c}_{f}' for c in ('a0', 'a1') for f in ('min', 'max', 'avg'))}, {', '.join(f'{q_sql(f"100.0 * count(*) FILTER ({c} > 0) / count(*)", 4)} AS {c}_above' for c in ('a0', 'a1'))} FROM v GROUP BY 1, 2""")
def diagnosis_before_after(spark, sf):
    """Distribution of every layer over the restored cells, before and after."""
    held = anomaly_cells(spark, sf)
    layers = F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), F.col(x).alias("a0"), E.improved(F.col(x), e).alias("a1")) for x, e in EFFECTS.items())))
    long = decisions(held, 0.1, 3).join(held.select("pixel_id", layers.alias("v")), "pixel_id").select("sol_id", "v.*")
    spread = [N.quant(f(c), 4).alias(f"{c}_{n}") for c in ("a0", "a1") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    above = [N.quant(100.0 * F.count_if(F.col(c) > 0) / F.count("*"), 4).alias(f"{c}_above") for c in ("a0", "a1")]
    return long.groupBy("sol_id", "layer").agg(F.count("*").alias("n"), *spread, *above)


@query(f"WITH {ANOM} SELECT {', '.join(f'{q_sql(f'corr({a}, {b})', 6)} AS {k}' for k, (a, b) in _PAIRS.items())}, count(*) AS n FROM anom WHERE eligible")
def diagnosis_correlations(spark, sf):
    return anomaly_cells(spark, sf).where("eligible").agg(*(N.quant(corr(a, b), 6).alias(k) for k, (a, b) in _PAIRS.items()), F.count("*").alias("n"))


@query(f"""WITH {ANOM} SELECT count(*) AS n, count(*) FILTER (eligible) AS n_eligible, CAST(floor(CAST(0.1 AS DOUBLE) * count(*) FILTER (eligible)) AS BIGINT) AS k, CAST(count(DISTINCT region_id) AS BIGINT) AS n_regions FROM anom""")
def problem_configuration(spark, sf):
    """Size of the problem that a scenario's fraction makes."""
    return anomaly_cells(spark, sf).agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.floor(F.lit(0.1) * F.count_if("eligible")).cast("long").alias("k"), F.countDistinct("region_id").alias("n_regions")
    )
