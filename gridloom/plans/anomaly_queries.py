"""Queries on layers: scans, masks, standardisation, reshape, classes, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import anomaly, catalog, focal
from ..operators import cells as C
from ..operators.stats import corr, kmeans_classes
from ..sources.grid import GridSpec, crop, nearest_resample, scan_layers
from .adapter import ANOM, ANOMALIES, CELL, COST, LAYERS, LONG, anomaly_cells, cells, decisions, decisions_sql, q_sql, with_xy
from .registry import query


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = cells(spark, sf_dir).withColumn("ecosystem", catalog.ecosystem_of(F.col("lulc"))).where("ecosystem IS NOT NULL")
    return anomaly.to_long(held, LAYERS, ["pixel_id", "row_idx", "col_idx", "ecosystem"])


def _q(column: str, digits: int = 4):
    return N.quant(F.col(column), digits).alias(column)


@query(f"WITH {CELL} SELECT pixel_id, x, y FROM eco WHERE x BETWEEN 2557000 AND 2562000 AND y BETWEEN 1240000 AND 1243000")
def scan_extent_crop(spark, sf):
    return crop(with_xy(cells(spark, sf)), (2557000.0, 2562000.0, 1240000.0, 1243000.0)).select("pixel_id", "x", "y")


@query(f"WITH {CELL} SELECT pixel_id, nullif(snh, 50.0) AS snh, {q_sql('smd', 3)} AS smd FROM cell")
def nodata_sentinel(spark, sf):
    return scan_layers(cells(spark, sf), ["snh", "smd"], nodata={"snh": 50.0}).select("pixel_id", "snh", _q("smd", 3))


@query(f"WITH {CELL} SELECT lulc, count(*) AS n, min(pixel_id) AS first_pixel FROM cell WHERE lulc IN (12, 13) GROUP BY lulc")
def ecosystem_mask(spark, sf):
    return C.ecosystem_mask(cells(spark, sf), "forest").groupBy("lulc").agg(F.count("*").alias("n"), F.min("pixel_id").alias("first_pixel"))


@query(f"WITH {CELL} SELECT lulc, count(*) AS n FROM cell WHERE lulc IN (12, 13, 15, 16, 17) GROUP BY lulc")
def ecosystem_mask_all(spark, sf):
    return C.ecosystem_mask(cells(spark, sf), "all").groupBy("lulc").agg(F.count("*").alias("n"))


@query(f"WITH {ANOM} SELECT ecosystem, count(*) AS n, count(*) FILTER (eligible) AS n_eligible FROM anom WHERE ecosystem IS NOT NULL GROUP BY 1")
def eligibility(spark, sf):
    return anomaly_cells(spark, sf).where("ecosystem IS NOT NULL").groupBy("ecosystem").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"))


@query(f"WITH {ANOM} SELECT pixel_id FROM anom WHERE eligible AND implementation_cost < 200000 AND abiotic > 0.1")
def eligibility_rule(spark, sf):
    return C.eligible(anomaly_cells(spark, sf), ANOMALIES, "all", (F.col(COST) < 200000) & (F.col("abiotic") > 0.1)).select("pixel_id")


@query(f"""WITH {ANOM}, b AS (SELECT min(row_idx) r0, max(row_idx) r1, min(col_idx) c0, max(col_idx) c1 FROM anom WHERE eligible),
s AS (SELECT greatest(1, CAST(trunc(sqrt(CAST(0.25 AS DOUBLE)) * (r1 - r0 + 1)) AS INT)) h, greatest(1, CAST(trunc(sqrt(CAST(0.25 AS DOUBLE)) * (c1 - c0 + 1)) AS INT)) w FROM b)
SELECT pixel_id, row_idx, col_idx FROM anom, s WHERE eligible AND row_idx BETWEEN 3 AND 3 + h - 1 AND col_idx BETWEEN 20 AND 20 + w - 1""")
def rectangle_sample(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    return C.rectangle_sample(held, 0.25, (3, 20)).select("pixel_id", "row_idx", "col_idx")


@query(f"WITH {LONG} SELECT pixel_id, ecosystem, variable, {q_sql('z', 4)} AS z FROM z")
def zscore_by_ecosystem(spark, sf):
    return anomaly.zscore(_long(spark, sf), ["ecosystem", "variable"]).select("pixel_id", "ecosystem", "variable", _q("z"))


@query(f"""WITH {CELL}, s AS (SELECT avg(smd) m, stddev_samp(smd) s, avg(1.0) m1, stddev_samp(1.0) s1 FROM cell WHERE smd IS NOT NULL)
SELECT pixel_id, {q_sql("coalesce((smd - m) / nullif(s, 0), 0)", 4)} AS z, coalesce((1.0 - m1) / nullif(s1, 0), CAST(0 AS DOUBLE)) AS z_const FROM cell, s WHERE smd IS NOT NULL""")
def zscore_normaliser(spark, sf):
    held = cells(spark, sf).where("smd IS NOT NULL").select("pixel_id", F.lit(0).alias("g"), "smd", F.lit(1.0).alias("one"))
    out = anomaly.normalise(anomaly.normalise(held, ["g"], "smd", "z"), ["g"], "one", "z_const")
    return out.select("pixel_id", _q("z"), "z_const")


@query(f"""WITH {LONG} SELECT pixel_id, ecosystem, category, {q_sql('avg(z)', 4)} AS anomaly FROM (SELECT *, CASE WHEN variable IN ('smd','sbd','soc') THEN 'abiotic'
WHEN variable IN ('uzl','tsd','ndvi') THEN 'biotic' WHEN variable IN ('snh','frag') THEN 'landscape' END AS category FROM z) GROUP BY 1, 2, 3""")
def ect_mean_anomaly(spark, sf):
    held = anomaly.zscore(_long(spark, sf), ["ecosystem", "variable"])
    return anomaly.category_means(held, ["pixel_id", "ecosystem"]).select("pixel_id", "ecosystem", "category", _q("anomaly"))


@query(f"""WITH {LONG}, r AS (SELECT pixel_id, CASE WHEN variable = 'frag' THEN 'forest_index' ELSE variable END AS variable, z FROM z)
SELECT pixel_id, CASE WHEN variable IN ('smd','sbd','soc') THEN 'abiotic' WHEN variable IN ('uzl','tsd','ndvi') THEN 'biotic' ELSE 'landscape' END AS category, {q_sql('avg(z)', 4)} AS anomaly FROM r GROUP BY 1, 2""")
def ect_mean_landscape_else(spark, sf):
    held = anomaly.zscore(_long(spark, sf), ["ecosystem", "variable"]).withColumn("variable", F.when(F.col("variable") == "frag", "forest_index").otherwise(F.col("variable")))
    return anomaly.category_means(held, ["pixel_id"], "else").select("pixel_id", "category", _q("anomaly"))


@query(f"WITH {ANOM} SELECT pixel_id, ecosystem, {', '.join(q_sql(x, 4) + ' AS ' + x for x in ANOMALIES)} FROM anom WHERE abiotic IS NOT NULL OR biotic IS NOT NULL OR landscape IS NOT NULL")
def anomaly_pipeline_wide(spark, sf):
    return anomaly.anomaly_layers(cells(spark, sf), LAYERS).select("pixel_id", "ecosystem", *map(_q, ANOMALIES))


@query(f"WITH {ANOM} SELECT ecosystem, {', '.join(f'count(*) FILTER ({x} > 0) AS {x}_above, count({x}) AS {x}_n' for x in ANOMALIES)} FROM anom WHERE ecosystem IS NOT NULL GROUP BY 1")
def anomaly_pipeline_counts(spark, sf):
    columns = [c for x in ANOMALIES for c in (F.count_if(F.col(x) > 0).alias(f"{x}_above"), F.count(x).alias(f"{x}_n"))]
    return anomaly_cells(spark, sf).where("ecosystem IS NOT NULL").groupBy("ecosystem").agg(*columns)


@query(f"""WITH {CELL} SELECT pixel_id, {q_sql("coalesce(CASE WHEN lulc IN (12, 13) THEN smd END, CASE WHEN lulc = 15 OR col_idx < 30 THEN uzl END, CASE WHEN lulc IN (16, 17) OR col_idx < 60 THEN snh END)", 3)} AS v
FROM cell WHERE lulc IN (12, 13, 15, 16, 17) OR col_idx < 60""")
def mosaic_first_valid(spark, sf):
    held = cells(spark, sf)
    forest = held.where("lulc IN (12, 13)").select("pixel_id", F.col("smd").alias("v"))
    fields = held.where("lulc = 15 OR col_idx < 30").select("pixel_id", F.col("uzl").alias("v"))
    grass = held.where("lulc IN (16, 17) OR col_idx < 60").select("pixel_id", F.col("snh").alias("v"))
    return anomaly.mosaic([forest, fields, grass], "v").select("pixel_id", _q("v", 3))


@query(f"WITH {LONG} SELECT pixel_id, {q_sql('avg(z)', 4)} AS m, count(*) AS n FROM z GROUP BY 1")
def row_mean_skipna(spark, sf):
    held = anomaly.zscore(_long(spark, sf), ["ecosystem", "variable"])
    return held.groupBy("pixel_id").agg(N.quant(F.avg("z"), 4).alias("m"), F.count("*").alias("n"))


@query(f"""WITH {CELL} SELECT regexp_replace(regexp_replace(v, '_anom_(forest|agricultural|grassland)$', ''), '_anom$', '') AS variable, CASE WHEN ends_with(v, '_forest') THEN 'Forest' WHEN ends_with(v, '_grassland') THEN 'Grassland' ELSE 'Unknown' END AS label, count(a) AS n, count(*) AS n_all
FROM (SELECT unnest(['smd_anom_forest', 'uzl_anom_grassland', 'snh_anom_none', 'ndvi_anom']) v, unnest([smd, uzl, snh, ndvi]) a FROM cell) GROUP BY 1, 2""")
def anomaly_long_unpivot(spark, sf):
    held = cells(spark, sf).selectExpr("pixel_id", "smd AS smd_anom_forest", "uzl AS uzl_anom_grassland", "snh AS snh_anom_none", "ndvi AS ndvi_anom")
    long = anomaly.to_long(held, ["smd_anom_forest", "uzl_anom_grassland", "snh_anom_none", "ndvi_anom"], ["pixel_id"], "v", "a", drop_null=False)
    label = F.when(F.col("v").endswith("_forest"), "Forest").when(F.col("v").endswith("_grassland"), "Grassland").otherwise("Unknown")
    name = F.regexp_replace(F.regexp_replace("v", "_anom_(forest|agricultural|grassland)$", ""), "_anom$", "")
    return long.groupBy(name.alias("variable"), label.alias("label")).agg(F.count("a").alias("n"), F.count("*").alias("n_all"))


@query(f"""WITH {LONG}, m AS (SELECT pixel_id, ecosystem, avg(z) FILTER (variable IN ('smd','sbd','soc')) a, avg(z) FILTER (variable IN ('uzl','tsd','ndvi')) b FROM z GROUP BY 1, 2)
SELECT ecosystem, count(a) AS abiotic, count(b) AS biotic FROM m GROUP BY 1""")
def pivot_ect_wide(spark, sf):
    means = anomaly.category_means(anomaly.anomalies(cells(spark, sf), LAYERS), ["pixel_id", "ecosystem"])
    wide = anomaly.to_wide(means, ["pixel_id", "ecosystem"], "category", "anomaly", ["abiotic", "biotic"])
    return wide.groupBy("ecosystem").agg(F.count("abiotic").alias("abiotic"), F.count("biotic").alias("biotic"))


def _classed(spark, sf):
    held = anomaly_cells(spark, sf).where("eligible")
    sds = held.groupBy("ecosystem").agg(*(F.stddev_samp(x).alias(f"sd_{x}") for x in ANOMALIES))
    held = held.join(F.broadcast(sds), "ecosystem")
    a, b, c = (N.class3(F.col(x), F.col(f"sd_{x}")) for x in ANOMALIES)
    return held.withColumns({"ab": F.concat_ws(" - ", a, b), "bl": F.concat_ws(" - ", b, c), "al": F.concat_ws(" - ", a, c)})


def _c3(x: str) -> str:
    return f"CASE WHEN {x} <= -sd_{x} THEN '3' WHEN {x} <= sd_{x} THEN '2' ELSE '1' END"


_CLASSED = f"""{ANOM}, cl AS (SELECT *, {_c3('abiotic')} || ' - ' || {_c3('biotic')} AS ab, {_c3('biotic')} || ' - ' || {_c3('landscape')} AS bl, {_c3('abiotic')} || ' - ' || {_c3('landscape')} AS al FROM (
SELECT *, {', '.join(f'stddev_samp({x}) OVER (PARTITION BY ecosystem) sd_{x}' for x in ANOMALIES)} FROM anom WHERE eligible)),
legend(grp, fill) AS (VALUES {', '.join(f"('{p}', '{c}')" for p, c in zip(catalog.PAIRS, catalog.COLOURS['ab']))})"""


@query(f"WITH {_CLASSED} SELECT pixel_id, ecosystem, ab, bl, al FROM cl")
def class3_sd_bivariate(spark, sf):
    return _classed(spark, sf).select("pixel_id", "ecosystem", "ab", "bl", "al")


@query(f"WITH {_CLASSED} SELECT ecosystem, ab, fill, count(*) AS n FROM cl LEFT JOIN legend ON grp = ab GROUP BY ALL")
def bivariate_legend_join(spark, sf):
    held = _classed(spark, sf).join(F.broadcast(catalog.legend(spark, "ab")), F.col("ab") == F.col("grp"), "left")
    return held.groupBy("ecosystem", "ab", "fill").agg(F.count("*").alias("n"))


_BREAKS = [0.0, 10.0, 20.0, 26.0, 32.0, 50.0]


@query(f"WITH {CELL} SELECT pixel_id, CASE WHEN smd >= 0 AND smd <= 10 THEN 1 WHEN smd > 10 AND smd <= 20 THEN 2 WHEN smd > 20 AND smd <= 26 THEN 3 WHEN smd > 26 AND smd <= 32 THEN 4 WHEN smd > 32 AND smd <= 50 THEN 5 END AS class FROM cell")
def reclass_breaks(spark, sf):
    return cells(spark, sf).select("pixel_id", N.class_of(F.col("smd"), _BREAKS).alias("class"))


@query(f"WITH {CELL} SELECT lulc, CAST(coalesce(CASE WHEN lulc IN (12, 13) THEN CASE WHEN smd <= 25 THEN 1 WHEN smd <= 50 THEN 2 END END, CASE WHEN lulc = 15 THEN CASE WHEN smd <= 25 THEN 3 WHEN smd <= 50 THEN 4 END END) AS INT) AS class, count(*) AS n FROM cell GROUP BY ALL")
def index_coalesce(spark, sf):
    one = N.class_of(F.col("smd"), [0.0, 25.0, 50.0])
    both = F.coalesce(F.when(F.col("lulc").isin(12, 13), one), F.when(F.col("lulc") == 15, one + 2))
    return cells(spark, sf).groupBy("lulc", both.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {ANOM} SELECT ecosystem, {', '.join(f'{q_sql(f"min({x})", 4)} AS {x}_min, {q_sql(f"max({x})", 4)} AS {x}_max' for x in ANOMALIES)}, {q_sql('max(sqrt(abiotic * abiotic + biotic * biotic + landscape * landscape))', 4)} AS far FROM anom WHERE eligible GROUP BY 1")
def magnitude_ranges(spark, sf):
    far = F.sqrt(sum((F.col(x) * F.col(x) for x in ANOMALIES[1:]), F.col("abiotic") * F.col("abiotic")))
    ranges = [c for x in ANOMALIES for c in (N.quant(F.min(x), 4).alias(f"{x}_min"), N.quant(F.max(x), 4).alias(f"{x}_max"))]
    return anomaly_cells(spark, sf).where("eligible").groupBy("ecosystem").agg(*ranges, N.quant(F.max(far), 4).alias("far"))


@query(f"WITH {CELL} SELECT CAST(floor(row_idx / 2) AS INT) AS row_idx, CAST(floor(col_idx / 2) AS INT) AS col_idx, {q_sql('avg(smd)', 3)} AS smd, {q_sql('avg(snh)', 3)} AS snh FROM cell GROUP BY 1, 2")
def block_mean_2x2(spark, sf):
    return focal.block_mean(cells(spark, sf), ["smd", "snh"]).select("row_idx", "col_idx", _q("smd", 3), _q("snh", 3))


@query(f"""WITH {CELL}, b AS (SELECT min(sbd) lo, max(sbd) hi FROM eco WHERE ecosystem IS NOT NULL)
SELECT ecosystem, CAST(least(20, 1 + floor((sbd - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM eco, b WHERE ecosystem IS NOT NULL AND sbd IS NOT NULL GROUP BY ALL""")
def histogram_20(spark, sf):
    held = cells(spark, sf).withColumn("ecosystem", catalog.ecosystem_of(F.col("lulc"))).where("ecosystem IS NOT NULL AND sbd IS NOT NULL")
    held = held.crossJoin(F.broadcast(held.agg(F.min("sbd").alias("lo"), F.max("sbd").alias("hi"))))
    bin_ = F.least(F.lit(20), 1 + F.floor((F.col("sbd") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20))).cast("int")
    return held.groupBy("ecosystem", bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_CLASSED} SELECT ecosystem, substr(ab, 1, 1) AS class, count(*) AS n FROM cl GROUP BY 1, 2")
def class_bar_counts(spark, sf):
    return _classed(spark, sf).groupBy("ecosystem", F.substring("ab", 1, 1).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {LONG} SELECT variable, count(*) AS n, {q_sql('min(value)', 2)} AS lo, {q_sql('max(value)', 2)} AS hi, {q_sql('avg(value)', 2)} AS mean FROM long GROUP BY 1")
def layer_summary(spark, sf):
    stats = [N.quant(f("value"), 2).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))]
    return _long(spark, sf).groupBy("variable").agg(F.count("*").alias("n"), *stats)


@query(f"""WITH {LONG}, l AS (SELECT variable AS code, {q_sql('min(value)', 2)} lo, {q_sql('max(value)', 2)} hi FROM long GROUP BY 1),
labels(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in catalog.LABELS.items() if k not in ('tsd', 'frag'))})
SELECT l.code, coalesce(label, l.code) AS label, lo, hi FROM l LEFT JOIN labels ON labels.code = l.code""")
def label_lookup(spark, sf):
    known = {k: v for k, v in catalog.LABELS.items() if k not in ("tsd", "frag")}
    held = _long(spark, sf).groupBy(F.col("variable").alias("code")).agg(N.quant(F.min("value"), 2).alias("lo"), N.quant(F.max("value"), 2).alias("hi"))
    return held.select("code", catalog.label_of(F.col("code"), known).alias("label"), "lo", "hi")


@query(f"WITH {ANOM} SELECT ecosystem, {q_sql('corr(abiotic, biotic)', 6)} AS ab, {q_sql('corr(biotic, landscape)', 6)} AS bl, {q_sql('corr(abiotic, landscape)', 6)} AS al FROM anom WHERE eligible GROUP BY 1")
def layer_correlations(spark, sf):
    pairs = (("ab", "abiotic", "biotic"), ("bl", "biotic", "landscape"), ("al", "abiotic", "landscape"))
    return anomaly_cells(spark, sf).where("eligible").groupBy("ecosystem").agg(*(N.quant(corr(a, b), 6).alias(n) for n, a, b in pairs))


@query(f"""WITH {CELL} SELECT pixel_id, {q_sql('lo.smd', 3)} AS near, {q_sql('c.smd', 3)} AS own FROM cell c LEFT JOIN (SELECT row_idx r, col_idx k, smd FROM cell WHERE row_idx % 2 = 0 AND col_idx % 2 = 0) lo ON r = 2 * CAST(floor(c.row_idx / 2) AS INT) AND k = 2 * CAST(floor(c.col_idx / 2) AS INT)""")
def nearest_resample_join(spark, sf):
    held = cells(spark, sf)
    fine, coarse = GridSpec(1, 100, 0.0, 0.0, 100.0), GridSpec(1, 50, 0.0, 0.0, 200.0)
    source = held.where("row_idx % 2 = 0 AND col_idx % 2 = 0").select(F.floor(F.col("row_idx") / 2).cast("int").alias("row_idx"), F.floor(F.col("col_idx") / 2).cast("int").alias("col_idx"), N.quant(F.col("smd"), 3).alias("near"))
    return nearest_resample(held.select("pixel_id", "row_idx", "col_idx", _q("smd", 3)), source, fine, coarse, ["near"]).select("pixel_id", "near", F.col("smd").alias("own"))


_POLYGON = [(2556900.0, 1243650.0), (2561300.0, 1243450.0), (2563100.0, 1241900.0), (2559900.0, 1241250.0), (2557700.0, 1242450.0)]
_EDGES = ", ".join(f"('A', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1]))


@query(f"""WITH {CELL}, e(region, x1, y1, x2, y2) AS (SELECT region, CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), CAST(d AS DOUBLE) FROM (VALUES {_EDGES}) v(region, a, b, c, d))
SELECT pixel_id FROM eco, e WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY pixel_id HAVING count(*) % 2 = 1""")
def polygon_mask(spark, sf):
    return C.polygon_mask(with_xy(cells(spark, sf)), C.polygon_edges(spark, {"A": _POLYGON}), "A").select("pixel_id")


@query(f"""WITH {CELL} SELECT kind, row_idx, col_idx, {q_sql('cost', 2)} AS cost FROM (
SELECT 'crop' AS kind, row_idx, col_idx, sbd * 2 AS cost FROM cell WHERE lulc = 15 UNION ALL SELECT 'grass', row_idx, col_idx, NULL FROM cell WHERE lulc IN (16, 17) UNION ALL SELECT 'forest', row_idx, col_idx, sbd FROM cell WHERE lulc IN (12, 13))""")
def cost_union_join(spark, sf):
    held = cells(spark, sf)
    crop_ = held.where("lulc = 15").select(F.lit("crop").alias("kind"), "pixel_id", (F.col("sbd") * 2).alias("cost"))
    grass = held.where("lulc IN (16, 17)").select(F.lit("grass").alias("kind"), "pixel_id")
    forest = held.where("lulc IN (12, 13)").select(F.lit("forest").alias("kind"), "pixel_id", F.col("sbd").alias("cost"))
    every = crop_.unionByName(grass, allowMissingColumns=True).unionByName(forest)
    return every.join(held.select("pixel_id", "row_idx", "col_idx"), "pixel_id", "left").select("kind", "row_idx", "col_idx", _q("cost", 2))


_IND = ", ".join(f"('{c}', '{kind}', '{eco}', {i})" for i, (c, kind, eco) in enumerate(((c, k, e) for (e, k), codes in catalog.INDICATORS.items() for c in codes), 1))


_HOMES = {"Forest": "forest", "Agriculture": "agricultural", "Grassland": "grassland"}


@query(f"""WITH {LONG}, i(indicator, class, ecosystem, pos) AS (VALUES {_IND}), homes(name, home) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _HOMES.items())}),
there AS (SELECT DISTINCT variable, ecosystem AS e FROM long), r AS (SELECT i.*, row_number() OVER (PARTITION BY i.ecosystem, class ORDER BY pos) id FROM i JOIN homes ON name = i.ecosystem JOIN there ON variable = indicator AND e = home)
SELECT ecosystem, CAST(id AS INT) AS id, max(indicator) FILTER (class = 'Abiotic') AS Abiotic, max(indicator) FILTER (class = 'Biotic') AS Biotic, max(indicator) FILTER (class = 'Landscape') AS Landscape FROM r GROUP BY 1, 2""")
def indicator_class_table(spark, sf):
    """The indicators by class, of those that the grid has values of in their ecosystem."""
    there = _long(spark, sf).groupBy(F.col("variable").alias("indicator"), F.col("ecosystem").alias("home")).count().drop("count")
    homes = F.create_map(*(F.lit(x) for pair in _HOMES.items() for x in pair))
    rows = catalog.indicator_rows(spark).withColumn("home", homes[F.col("ecosystem")]).join(F.broadcast(there), ["indicator", "home"], "left_semi")
    rows = rows.drop("home").withColumn("id", F.row_number().over(Window.partitionBy("ecosystem", "class").orderBy("input_pos")))
    return anomaly.to_wide(rows, ["ecosystem", "id"], "class", "indicator", ["Abiotic", "Biotic", "Landscape"])


_T = 60
_W = {x: f"least(greatest(exp(-abs({x})), 0.0), 1.0)" for x in ANOMALIES}
_PART = " + ".join(_W.values())


@query(f"""WITH {ANOM}, g AS (SELECT CAST(a AS DOUBLE) / {_T - 1} AS w1, CAST(b AS DOUBLE) / {_T - 1} AS w2, a, b FROM (SELECT unnest(range({_T})) a), (SELECT unnest(range({_T})) b)),
placed AS (SELECT CAST(floor({_W['abiotic']} / ({_PART}) * {_T - 1} + 0.5) AS INT) AS i, CAST(floor({_W['biotic']} / ({_PART}) * {_T - 1} + 0.5) AS INT) AS j FROM anom WHERE eligible),
c AS (SELECT i, least(j, {_T - 1} - i) AS j, count(*) AS n FROM placed GROUP BY 1, 2)
SELECT CAST(a AS INT) AS i, CAST(b AS INT) AS j, {q_sql('w2 + 0.5 * (1 - w1 - w2)', 6)} AS x, {q_sql('sqrt(CAST(3 AS DOUBLE)) / 2 * (1 - w1 - w2)', 6)} AS y,
'#' || upper(lpad(to_hex(CAST(floor(w1 * 255.0 + 0.5) AS BIGINT)), 2, '0')) || upper(lpad(to_hex(CAST(floor(w2 * 255.0 + 0.5) AS BIGINT)), 2, '0')) || upper(lpad(to_hex(CAST(floor(greatest(1 - w1 - w2, 0.0) * 255.0 + 0.5) AS BIGINT)), 2, '0')) AS fill, coalesce(n, 0) AS n_cells
FROM g LEFT JOIN c ON c.i = a AND c.j = b WHERE a + b <= {_T - 1}""")
def tricolor_triangle(spark, sf):
    """The colour triangle, with how many cells have each mixture of the three anomalies' weights."""
    n = _T
    axis = lambda name: spark.range(n).select(F.col("id").cast("int").alias(name))
    g = axis("i").crossJoin(F.broadcast(axis("j"))).where(F.col("i") + F.col("j") <= n - 1)
    w1, w2 = F.col("i").cast("double") / (n - 1), F.col("j").cast("double") / (n - 1)
    w3 = 1 - w1 - w2
    half = F.sqrt(F.lit(3.0)) / 2
    whole = N.weight(F.col("abiotic")) + N.weight(F.col("biotic")) + N.weight(F.col("landscape"))
    step = lambda x: F.floor(N.weight(F.col(x)) / whole * (n - 1) + 0.5).cast("int")
    placed = anomaly_cells(spark, sf).where("eligible").select(step("abiotic").alias("i"), step("biotic").alias("j"))
    counts = placed.groupBy("i", F.least("j", F.lit(n - 1) - F.col("i")).alias("j")).agg(F.count("*").alias("n"))
    g = g.join(F.broadcast(counts), ["i", "j"], "left")  # a row a place of the triangle
    return g.select("i", "j", N.quant(w2 + 0.5 * w3, 6).alias("x"), N.quant(half * w3, 6).alias("y"), N.hex_colour(w1, w2, F.greatest(w3, F.lit(0.0))).alias("fill"), F.coalesce("n", F.lit(0)).alias("n_cells"))


_KIND = "CASE WHEN variable IN ('smd','sbd','soc') THEN 'abiotic' WHEN variable IN ('uzl','tsd','ndvi') THEN 'biotic' WHEN variable IN ('snh','frag') THEN 'landscape' END"
_NAMED = f"labels(code, label) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in catalog.LABELS.items())})"


@query(f"""WITH {LONG}, {_NAMED} SELECT ecosystem, variable AS code, count(*) AS n, {q_sql('min(value)', 2)} AS lo, {q_sql('max(value)', 2)} AS hi, {q_sql('avg(value)', 2)} AS mean, {_KIND} AS kind, any_value(label) AS label
FROM long LEFT JOIN labels ON code = variable GROUP BY ecosystem, variable""")
def variable_profile(spark, sf):
    """Range and mean of every variable, with what is known of it."""
    held = _long(spark, sf).groupBy("ecosystem", F.col("variable").alias("code")).agg(F.count("*").alias("n"), *(N.quant(f("value"), 2).alias(n) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))))
    return held.withColumns({"kind": catalog.category_of(F.col("code")), "label": catalog.label_of(F.col("code"), catalog.LABELS)})


@query()
def kmeans_clusters(spark, sf):
    """Rows only: the clustering is iterative."""
    held = kmeans_classes(anomaly_cells(spark, sf).where("eligible").select("pixel_id", *ANOMALIES), ANOMALIES, 3, 42)
    return held.groupBy("cluster").agg(*(F.avg(x).alias(x) for x in ANOMALIES), F.count("*").alias("n"))


def _focal_sql(size: int, digits: int) -> str:
    h = size // 2
    return f"""WITH {CELL}, r AS (SELECT *, sum(smd) OVER w s, count(smd) OVER w n FROM cell WINDOW w AS (PARTITION BY row_idx ORDER BY col_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING))
SELECT pixel_id, {q_sql('sum(s) OVER v / nullif(sum(n) OVER v, 0)', digits)} AS m FROM r WINDOW v AS (PARTITION BY col_idx ORDER BY row_idx RANGE BETWEEN {h} PRECEDING AND {h} FOLLOWING)"""


@query(_focal_sql(3, 3))
def focal_mean_3(spark, sf):
    return focal.square_mean(cells(spark, sf), "smd", 3, "m").select("pixel_id", _q("m", 3))


@query(_focal_sql(15, 3))
def focal_mean_15(spark, sf):
    return focal.square_mean(cells(spark, sf), "smd", 15, "m").select("pixel_id", _q("m", 3))


@query(_focal_sql(31, 3))
def focal_mean_31(spark, sf):
    return focal.square_mean(cells(spark, sf), "smd", 31, "m").select("pixel_id", _q("m", 3))


@query(f"""WITH {CELL}, r AS (SELECT *, sum(smd) OVER w s, sum(smd * smd) OVER w q, count(smd) OVER w n FROM cell WINDOW w AS (PARTITION BY row_idx ORDER BY col_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
v AS (SELECT pixel_id, sum(s) OVER x s, sum(q) OVER x q, sum(n) OVER x n FROM r WINDOW x AS (PARTITION BY col_idx ORDER BY row_idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT pixel_id, {q_sql('greatest(0.0, q - s * s / nullif(n, 0)) / CASE WHEN n > 1 THEN n - 1 END', 2)} AS noise FROM v""")
def focal_variance_3(spark, sf):
    return focal.square_variance(cells(spark, sf), "smd", 3).select("pixel_id", _q("noise", 2))


@query(f"""WITH {CELL}, o AS (SELECT a AS dr, b AS dc FROM (SELECT unnest(range(-3, 4)) a), (SELECT unnest(range(-3, 4)) b) WHERE a * a + b * b <= 9)
SELECT c.pixel_id, {q_sql('CASE WHEN count(n.smd) = 29 AND any_value(c.smd) IS NOT NULL THEN sum(n.smd) / 29.0 END', 3)} AS influence
FROM cell c, o LEFT JOIN cell n ON n.row_idx = c.row_idx + dr AND n.col_idx = c.col_idx + dc GROUP BY c.pixel_id""")
def focal_circle_sum(spark, sf):
    return focal.offset_sum(cells(spark, sf), "smd", focal.disc(300.0, 100.0)).select("pixel_id", _q("influence", 3))


@query(f"""WITH {decisions_sql(0.1, 2)}, s AS (SELECT sol_id, row_idx, col_idx FROM dec d JOIN anom a ON a.pixel_id = d.pixel_id), o(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
n AS (SELECT DISTINCT sol_id, row_idx + dr AS row_idx, col_idx + dc AS col_idx FROM s, o) SELECT * FROM n EXCEPT SELECT * FROM s""")
def neighbour_ring(spark, sf):
    held = anomaly_cells(spark, sf)
    chosen = decisions(held, 0.1, 2).join(held.select("pixel_id", "row_idx", "col_idx"), "pixel_id")
    return focal.ring(chosen, ("sol_id",)).select("sol_id", "row_idx", "col_idx")
