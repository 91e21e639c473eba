"""Aggregations over cells, classes, blocks and land use."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.operators import profile as P
from heatgrid.operators.quantiles import exact_quantiles, quantile_columns
from heatgrid.plans import views as V
from heatgrid.plans.registry import query
from heatgrid.plans.scoring_views import hot_labels, scored
from heatgrid.sources.tables import table

c = F.col
HA = P.HA
BANDS = ["ndvi", "ndbi", "ndre", "ndmi", "mndwi", "bsi"]


def _unpivot(cols, src, by=""):
    by = by + ", " if by else ""
    return " UNION ALL ".join(f"SELECT {by}'{x}' AS variable, CAST({x} AS DOUBLE) AS v FROM {src}" for x in cols)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg1_band_profile", f"""
SELECT variable, count(*) AS n, count(v) AS n_finite, count(*) - count(v) AS n_nan,
  count(*) FILTER (WHERE v = 'inf'::DOUBLE) AS n_pos_inf, count(*) FILTER (WHERE v = '-inf'::DOUBLE) AS n_neg_inf,
  count(*) FILTER (WHERE v = 0) AS n_zero, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean,
  round(stddev_pop(v), 6) AS std FROM ({_unpivot(_NUM, 'lineitem')}) GROUP BY variable""")
def _(spark, sf):
    return P.band_profile(table(spark, sf, "lineitem"), _NUM)


@query("agg2_nodata_audit", f"""
SELECT *, CASE WHEN zeros_inside = 0 AND zeros_outside = 0 THEN 'none' WHEN zeros_outside > zeros_inside THEN 'fill'
  ELSE 'value' END AS zero_kind FROM (
SELECT variable, count(*) FILTER (WHERE inside AND v = 0) AS zeros_inside,
  count(*) FILTER (WHERE NOT inside AND v = 0) AS zeros_outside, count(*) FILTER (WHERE v IS NULL) AS n_null
FROM ({_unpivot(['ndvi', 'ndbi', 'ndmi', 'vegetation_cover'], 'x', 'inside')}) GROUP BY variable)
""".replace("FROM x", "FROM (SELECT *, ndvi IS NOT NULL AND ndbi IS NOT NULL AND ndmi IS NOT NULL AND vegetation_cover IS NOT NULL AS inside FROM dense)"),
       "dense")
def _(spark, sf):
    return P.nodata_audit(V.dense(spark, sf), ["ndvi", "ndbi", "ndmi", "vegetation_cover"])


def _describe_sql(by):
    k = f"{by}, " if by else ""
    return f"""SELECT {k or 'CAST(NULL AS INT) AS year, '} variable, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(quantile_cont(v, 0.25), 6) AS q25,
  round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
  FROM ({_unpivot(['lst_c', 'ndvi', 'ndbi'], 'domain', 'year')}) GROUP BY {k} variable"""


@query("agg3_feature_statistics", f"""
SELECT a.*, v.vegetated_share FROM ({_describe_sql('')} UNION ALL {_describe_sql('year')}) a LEFT JOIN (
  SELECT year, round(avg(CAST(ndvi >= 0.3 AS INT)), 6) AS vegetated_share FROM domain GROUP BY year) v ON a.year = v.year
""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf).select("year", "lst_c", "ndvi", "ndbi")
    cols = ["lst_c", "ndvi", "ndbi"]
    whole = P.describe(d, [], cols).withColumn("year", F.lit(None).cast("int"))
    veg = d.groupBy("year").agg(F.avg((c("ndvi") >= 0.3).cast("int")).alias("vegetated_share"))
    return whole.unionByName(P.describe(d, ["year"], cols)).join(F.broadcast(veg), "year", "left")


_CORR = ["lst_c", "ndvi", "ndbi", "vegetation_cover"]
_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1:]]


@query("agg4_correlation_matrix", " UNION ALL ".join(
    f"SELECT year, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM domain GROUP BY year" for a, b in _PAIRS), "domain")
def _(spark, sf):
    return P.correlations(V.domain(spark, sf), _CORR, ["year"])


def _avg_rank(x):
    return f"rank() OVER (PARTITION BY year ORDER BY {x}) + (count(*) OVER (PARTITION BY year, {x}) - 1) / 2.0"


@query("agg5_pearson_spearman", f"""
SELECT year, count(*) AS n, round(corr(ndvi, lst_c), 6) AS pearson, round(corr(rx, ry), 6) AS spearman
FROM (SELECT *, {_avg_rank('ndvi')} AS rx, {_avg_rank('lst_c')} AS ry FROM domain) GROUP BY year""", "domain")
def _(spark, sf):
    return P.pearson_spearman(V.domain(spark, sf), "ndvi", "lst_c")


@query("agg6_coverage", """
SELECT year, product, round(share, 6) AS coverage, gate, share >= gate AS ok FROM (
  SELECT year, 'l9_st' AS product, avg(CAST(lst_c IS NOT NULL AS INT)) AS share, 0.90::DOUBLE AS gate FROM cells WHERE in_study GROUP BY year
  UNION ALL SELECT year, 's2_10m', avg(CAST(ndvi IS NOT NULL AS INT)), 0.85 FROM cells WHERE in_study GROUP BY year
  UNION ALL SELECT year, 'lulc', avg(CAST(lulc_class IS NOT NULL AS INT)), 0.80 FROM cells WHERE in_study GROUP BY year)
""", "cells")
def _(spark, sf):
    gates = {"l9_st": ("lst_c", 0.90), "s2_10m": ("ndvi", 0.85), "lulc": ("lulc_class", 0.80)}
    n = F.count(F.lit(1))
    w = V.cells(spark, sf).where("in_study").groupBy("year").agg(
        *[(F.count(v) / n).alias(p) for p, (v, _) in gates.items()])
    rows = ", ".join(f"'{p}', {p}, cast({g} as double)" for p, (_, g) in gates.items())
    return w.select("year", F.expr(f"stack(3, {rows}) as (product, coverage, gate)")).withColumn(
        "ok", c("coverage") >= c("gate"))


@query("agg7_block_coverage", "SELECT block_id, " + ", ".join(
    f"round(avg(CAST(lst_c IS NOT NULL AS INT)) FILTER (WHERE year = {y}), 6) AS y{y}" for y in range(2022, 2027))
    + ", bool_or(s < 0.5) AS below_half FROM (SELECT *, avg(CAST(lst_c IS NOT NULL AS INT)) OVER (PARTITION BY year, block_id) AS s"
    " FROM dense) GROUP BY block_id", "dense")
def _(spark, sf):
    y = V.dense(spark, sf).groupBy("block_id", "year").agg((F.count("lst_c") / F.count(F.lit(1))).alias("s"))
    years = list(range(2022, 2027))
    p = y.groupBy("block_id").pivot("year", years).agg(F.first("s"))
    low = y.groupBy("block_id").agg(F.bool_or(c("s") < 0.5).alias("below_half"))
    return p.join(low, "block_id").select("block_id", *[c(f"`{v}`").alias(f"y{v}") for v in years], "below_half")


@query("agg8_class_area", """
SELECT year, y_true, count(*) AS pixels, round(count(*) * 0.09, 6) AS area_ha,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY year), 6) AS percent FROM classed GROUP BY year, y_true""", "classed")
def _(spark, sf):
    return P.class_area(V.classed(spark, sf), "y_true")


@query("agg9_class_area_total", """
SELECT year, CASE WHEN grouping(y_true) = 1 THEN 'TOTAL' ELSE CAST(y_true AS VARCHAR) END AS label, count(*) AS pixels,
  round(count(*) * 0.09, 6) AS area_ha FROM classed GROUP BY GROUPING SETS ((year, y_true), (year))""", "classed")
def _(spark, sf):
    d = V.classed(spark, sf).groupingSets([["year", "y_true"], ["year"]], "year", "y_true").agg(
        F.grouping("y_true").alias("g"), F.count(F.lit(1)).alias("pixels"))
    return d.select("year", F.when(c("g") == 1, "TOTAL").otherwise(c("y_true").cast("string")).alias("label"),
                    "pixels", (c("pixels") * HA).alias("area_ha"))


def hot_defs():
    conf = c("confidence") >= 0.6
    return {"a": c("y_pred") == 2, "b": (c("y_pred") == 2) & conf, "c": (c("severity_score") >= 1.5) & conf}


@query("agg10_block_statistics", """
SELECT year, block_id, count(*) AS n_pixels, count(*) FILTER (WHERE y_true = 0) AS class_0,
  count(*) FILTER (WHERE y_true = 1) AS class_1, count(*) FILTER (WHERE y_true = 2) AS class_2,
  round(count(*) FILTER (WHERE y_true = 2) * 100.0 / count(*), 6) AS high_percent,
  count(*) FILTER (WHERE y_pred = 2) AS hot_a_px, count(*) FILTER (WHERE y_pred = 2 AND confidence >= 0.6) AS hot_b_px,
  count(*) FILTER (WHERE severity_score >= 1.5 AND confidence >= 0.6) AS hot_c_px,
  round(count(*) FILTER (WHERE y_pred = 2) * 0.09, 6) AS hot_a_ha FROM classed GROUP BY year, block_id""", "classed")
def _(spark, sf):
    hot = hot_defs()
    return V.classed(spark, sf).groupBy("year", "block_id").agg(
        F.count(F.lit(1)).alias("n_pixels"), *P.class_counts("y_true", 3),
        P.share(c("y_true") == 2).alias("high_percent"), *[F.count_if(v).alias(f"hot_{k}_px") for k, v in hot.items()],
        (F.count_if(hot["a"]) * HA).alias("hot_a_ha"))


@query("agg11_area_statistics", """
SELECT year, block_id, count(*) AS n, round(count(*) * 0.09, 6) AS area_ha, round(avg(lst_c), 6) AS mean_lst,
  round(quantile_cont(lst_c, 0.5), 6) AS median_lst, min(lst_c) AS min_lst, max(lst_c) AS max_lst,
  round(stddev_samp(lst_c), 6) AS std_lst, round(avg(ndvi), 6) AS mean_ndvi, round(avg(ndbi), 6) AS mean_ndbi,
  round(avg(vegetation_cover), 6) AS mean_veg, round(avg(confidence), 6) AS mean_confidence,
  round(count(*) FILTER (WHERE y_pred = 2) * 100.0 / count(*), 6) AS hotspot_percent
FROM classed GROUP BY year, block_id""", "classed")
def _(spark, sf):
    d, k = V.classed(spark, sf), ["year", "block_id"]
    a = d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * HA).alias("area_ha"), F.avg("lst_c").alias("mean_lst"),
        F.min("lst_c").alias("min_lst"), F.max("lst_c").alias("max_lst"), F.stddev_samp("lst_c").alias("std_lst"),
        F.avg("ndvi").alias("mean_ndvi"), F.avg("ndbi").alias("mean_ndbi"), F.avg("vegetation_cover").alias("mean_veg"),
        F.avg("confidence").alias("mean_confidence"), P.share(c("y_pred") == 2).alias("hotspot_percent"))
    return a.join(quantile_columns(d, k, {"lst_c": ["median_lst"]}, [0.5]), k)


@query("agg12_high_risk_summary", """
SELECT c.year, count(*) AS valid_pixels, count(*) FILTER (WHERE y_pred = 2) AS high_pixels,
  round(count(*) FILTER (WHERE y_pred = 2) * 0.09, 6) AS high_ha, round(count(*) FILTER (WHERE y_pred = 2) * 100.0 / count(*), 6) AS high_percent,
  count(h.zone_id) AS hotspot_pixels, round(count(h.zone_id) * 0.09, 6) AS hotspot_ha, count(DISTINCT h.zone_id) AS n_hotspots,
  round(avg(lst_c), 6) AS mean_lst, round(avg(confidence), 6) AS mean_confidence
FROM classed c LEFT JOIN hot_cells h ON c.year = h.year AND c.row = h.row AND c.col = h.col GROUP BY c.year""", "classed hot_cells")
def _(spark, sf):
    d = V.classed(spark, sf).join(hot_labels(spark, sf), ["year", "row", "col"], "left")
    high, n = c("y_pred") == 2, F.count(F.lit(1))
    return d.groupBy("year").agg(
        n.alias("valid_pixels"), F.count_if(high).alias("high_pixels"), (F.count_if(high) * HA).alias("high_ha"),
        P.share(high).alias("high_percent"), F.count("zone_id").alias("hotspot_pixels"),
        (F.count("zone_id") * HA).alias("hotspot_ha"), F.count_distinct("zone_id").alias("n_hotspots"),
        F.avg("lst_c").alias("mean_lst"), F.avg("confidence").alias("mean_confidence"))


_GB = """CASE WHEN ndvi >= 0.3 THEN 'green_dominant' WHEN ndbi >= 0.1 AND ndvi < 0.3 THEN 'built_dominant' ELSE 'mixed' END"""


@query("agg13_green_built", f"""
SELECT year, {_GB} AS green_built, count(*) AS n, round(avg(lst_c), 6) AS mean_lst, round(avg(severity_score), 6) AS mean_score,
  round(count(*) FILTER (WHERE y_true = 2) * 100.0 / count(*), 6) AS high_percent, round(avg(suitability), 6) AS mean_suitability
FROM scored GROUP BY 1, 2""", "scored")
def _(spark, sf):
    return scored(spark, sf).groupBy("year", C.green_built(c("ndvi"), c("ndbi")).alias("green_built")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lst_c").alias("mean_lst"), F.avg("severity_score").alias("mean_score"),
        P.share(c("y_true") == 2).alias("high_percent"), F.avg("suitability").alias("mean_suitability"))


# Land-use code names.
LANDUSE_NAMES = {0: "unclassified_background", 1: "park", 2: "forest", 3: "grass", 4: "commercial", 5: "industrial",
                 6: "residential", 7: "retail", 8: "farmland"}
_NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in LANDUSE_NAMES.items())


def landuse_name(code):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LANDUSE_NAMES.items() for x in kv])[code], F.lit("untagged"))


@query("agg14_landuse_heat", f"""
SELECT year, CASE landuse_class {_NAMES} ELSE 'untagged' END AS landuse, count(*) AS n, round(avg(lst_c), 6) AS mean_lst,
  round(count(*) FILTER (WHERE y_true = 2) * 100.0 / count(*), 6) AS high_percent, round(avg(suitability), 6) AS mean_suitability
FROM scored GROUP BY 1, 2""", "scored")
def _(spark, sf):
    return scored(spark, sf).groupBy("year", landuse_name(c("landuse_class")).alias("landuse")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lst_c").alias("mean_lst"), P.share(c("y_true") == 2).alias("high_percent"),
        F.avg("suitability").alias("mean_suitability"))


def _bins_sql(x, n, src="classed"):
    edges = ", ".join(str(i / n) for i in range(n + 1))
    inner = " + ".join(f"CAST({x} >= e[{i + 1}] AS INT)" for i in range(1, n))
    return f"""(SELECT s.*, e, {inner} AS bin FROM {src} s JOIN (
      SELECT year AS ey, quantile_cont(CAST({x} AS DOUBLE), [{edges}]) AS e FROM {src} GROUP BY year) ON ey = s.year)"""


@query("agg15_decile_profile", f"""
SELECT year, bin + 1 AS decile, round(any_value(e[bin + 1]), 6) AS edge_lo, round(any_value(e[bin + 2]), 6) AS edge_hi,
  count(*) AS n, round(avg(lst_c), 6) AS mean_lst, round(avg(severity_score), 6) AS mean_score,
  round(count(*) FILTER (WHERE y_true = 2) * 100.0 / count(*), 6) AS high_percent FROM {_bins_sql('ndbi', 10)} GROUP BY year, bin
""", "classed")
def _(spark, sf):
    d = P.quantile_bins(V.classed(spark, sf), ["year"], "ndbi", 10)
    return d.groupBy("year", "bin").agg(
        F.first(c("edges")[c("bin")]).alias("edge_lo"), F.first(c("edges")[c("bin") + 1]).alias("edge_hi"),
        F.count(F.lit(1)).alias("n"), F.avg("lst_c").alias("mean_lst"), F.avg("severity_score").alias("mean_score"),
        P.share(c("y_true") == 2).alias("high_percent")).select(
        "year", (c("bin") + 1).alias("decile"), "edge_lo", "edge_hi", "n", "mean_lst", "mean_score", "high_percent")


@query("agg16_temporal_comparison", """
SELECT c.year, count(*) AS n, round(avg(lst_c), 6) AS mean_lst, round(quantile_cont(lst_c, 0.5), 6) AS median_lst,
  count(DISTINCT h.zone_id) AS n_hotspots, round(any_value(big) * 0.09, 6) AS largest_ha, round(avg(ndvi), 6) AS mean_ndvi
FROM classed c LEFT JOIN hot_cells h ON c.year = h.year AND c.row = h.row AND c.col = h.col
LEFT JOIN (SELECT year, max(n) AS big FROM (SELECT year, zone_id, count(*) AS n FROM hot_cells GROUP BY ALL) GROUP BY year) b
  ON b.year = c.year GROUP BY c.year""", "classed hot_cells")
def _(spark, sf):
    d = V.classed(spark, sf).select("year", "lst_c", "ndvi")
    z = hot_labels(spark, sf).groupBy("year", "zone_id").agg(F.count(F.lit(1)).alias("n"))
    h = z.groupBy("year").agg(F.count(F.lit(1)).alias("n_hotspots"), (F.max("n") * HA).alias("largest_ha"))
    a = d.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("lst_c").alias("mean_lst"), F.avg("ndvi").alias("mean_ndvi"))
    return a.join(quantile_columns(d, ["year"], {"lst_c": ["median_lst"]}, [0.5]), "year").join(h, "year", "left").withColumn(
        "n_hotspots", F.coalesce("n_hotspots", F.lit(0).cast("long")))


_ENV = ["lst_c", "ndvi", "ndbi", "vegetation_cover", "dist_road_m", "dist_vegetation_m"]


@query("agg17_environmental_priority", f"""
SELECT year, suitability_class, variable, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median
FROM ({_unpivot(_ENV, 'scored', 'year, suitability_class')}) GROUP BY ALL""", "scored")
def _(spark, sf):
    long = P.long_form(scored(spark, sf), ["year", "suitability_class"], _ENV)
    k = ["year", "suitability_class", "variable"]
    from heatgrid.operators.quantiles import exact_quantiles_long
    q = exact_quantiles_long(long, k, [0.5]).select(*k, c("q")[0].alias("median"))
    return long.groupBy(*k).agg(F.avg("v").alias("mean")).join(q, k)


_WIDE = ", ".join(f"round(avg({x}), 6) AS mean_{x}, round(quantile_cont({x}, 0.5), 6) AS median_{x}" for x in ("need", "opportunity", "suitability"))


@query("agg18_suitability_summary", f"""
SELECT year, {_WIDE}, {', '.join(f"count(*) FILTER (WHERE suitability_class = {k}) AS class_{k}, round(count(*) FILTER (WHERE suitability_class = {k}) * 100.0 / count(*), 6) AS pct_{k}" for k in range(5))}
FROM scored GROUP BY year""", "scored")
def _(spark, sf):
    d, x = scored(spark, sf), ["need", "opportunity", "suitability"]
    a = d.groupBy("year").agg(
        *[F.avg(v).alias(f"mean_{v}") for v in x], *P.class_counts("suitability_class", 5),
        *[P.share(c("suitability_class") == k).alias(f"pct_{k}") for k in range(5)])
    return a.join(quantile_columns(d, ["year"], {v: [f"median_{v}"] for v in x}, [0.5]), "year")


_REASON = """CASE WHEN scenario = 'v2_constrained' AND water THEN 'water' WHEN scenario = 'v2_constrained' AND buildings THEN 'buildings'
  WHEN scenario = 'v2_constrained' AND road_surfaces THEN 'road_surfaces' WHEN NOT eligible THEN 'landuse_ineligible'
  WHEN NOT vegetation_cover < 0.30 THEN 'planting_space_veg_ge_0.30' ELSE 'FEASIBLE' END"""


@query("agg19_exclusion_accounting", f"""
SELECT year, scenario, {_REASON} AS reason, count(*) AS pixels, round(count(*) * 0.09, 6) AS area_ha
FROM scored, (VALUES ('v2_constrained'), ('v1_parity')) t(scenario) GROUP BY 1, 2, 3""", "scored")
def _(spark, sf):
    d = scored(spark, sf).withColumn("scenario", F.explode(F.array(F.lit("v2_constrained"), F.lit("v1_parity"))))
    held = c("scenario") == "v2_constrained"
    reason = (
        F.when(held & c("water"), "water").when(held & c("buildings"), "buildings")
        .when(held & c("road_surfaces"), "road_surfaces").when(~c("eligible"), "landuse_ineligible")
        .when(~(c("vegetation_cover") < 0.30), "planting_space_veg_ge_0.30").otherwise("FEASIBLE"))
    return d.groupBy("year", "scenario", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("pixels"), (F.count(F.lit(1)) * HA).alias("area_ha"))


@query("agg20_full_area_stats", """
SELECT year, count(*) AS domain_px, count(*) FILTER (WHERE feasible) AS feasible_px,
  round(count(*) FILTER (WHERE feasible) * 0.09, 6) AS feasible_ha, round(avg(need01) FILTER (WHERE feasible), 6) AS mean_cooling_need,
  round(avg(suit01) FILTER (WHERE feasible), 6) AS mean_suitability, round(avg(priority), 6) AS mean_priority FROM scored GROUP BY year
""", "scored")
def _(spark, sf):
    f = c("feasible")
    return scored(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("domain_px"), F.count_if(f).alias("feasible_px"), (F.count_if(f) * HA).alias("feasible_ha"),
        F.avg(F.when(f, c("need01"))).alias("mean_cooling_need"), F.avg(F.when(f, c("suit01"))).alias("mean_suitability"),
        F.avg("priority").alias("mean_priority"))


@query("agg23_distinct_counts", """
SELECT year, count(DISTINCT block_id) AS n_blocks, count(DISTINCT landuse_class) AS n_landuse, count(DISTINCT (row, col)) AS n_cells
FROM domain GROUP BY year""", "domain")
def _(spark, sf):
    return V.domain(spark, sf).groupBy("year").agg(
        F.count_distinct("block_id").alias("n_blocks"), F.count_distinct("landuse_class").alias("n_landuse"),
        F.count_distinct("row", "col").alias("n_cells"))


@query("agg25_quantile_bin_means", f"""
SELECT b.year, bin, n, round(mean_x, 6) AS mean_x, round(mean_y, 6) AS mean_y, r FROM (
  SELECT year, bin, count(*) AS n, avg(ndvi) AS mean_x, avg(lst_c) AS mean_y FROM {_bins_sql('ndvi', 20)} GROUP BY year, bin HAVING count(*) >= 10) b
JOIN (SELECT year, round(corr(ndvi, lst_c), 6) AS r FROM classed GROUP BY year) c ON c.year = b.year""", "classed")
def _(spark, sf):
    d = V.classed(spark, sf)
    b = P.quantile_bins(d, ["year"], "ndvi", 20).groupBy("year", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ndvi").alias("mean_x"), F.avg("lst_c").alias("mean_y")).where("n >= 10")
    return b.join(F.broadcast(d.groupBy("year").agg(F.corr("ndvi", "lst_c").alias("r"))), "year")


@query("agg26_bin2d", """
SELECT year, CAST(floor(need / 5) AS INT) AS bx, CAST(floor(opportunity / 5) AS INT) AS "by", count(*) AS n FROM scored GROUP BY 1, 2, 3
""", "scored")
def _(spark, sf):
    b = [F.floor(c(x) / 5).cast("int").alias(n) for x, n in (("need", "bx"), ("opportunity", "by"))]
    return scored(spark, sf).groupBy("year", *b).agg(F.count(F.lit(1)).alias("n"))


@query("agg27_log_histogram", """
WITH z AS (SELECT year, zone_id, count(*) * 1.0 AS px FROM hot_cells GROUP BY ALL), m AS (SELECT max(px) AS hi FROM z)
SELECT year, CAST(least(floor(ln(px) / ln(hi) * 30 + 1e-9), 29) AS INT) AS bin, count(*) AS n FROM z, m GROUP BY 1, 2""", "hot_cells")
def _(spark, sf):
    z = hot_labels(spark, sf).groupBy("year", "zone_id").agg(F.count(F.lit(1)).cast("double").alias("px"))
    top = z.agg(F.max("px").alias("hi"))
    b = F.least(F.floor(F.log("px") / F.log("hi") * 30 + 1e-9), F.lit(29)).cast("int")
    return z.join(F.broadcast(top)).groupBy("year", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("agg28_area_statistics_long", """
SELECT year, 'domain' AS category, 'all' AS name, count(*) AS pixels FROM scored GROUP BY year
UNION ALL SELECT year, 'class', CAST(suitability_class AS VARCHAR), count(*) FROM scored GROUP BY year, suitability_class
UNION ALL SELECT year, 'scenario_high', scenario, count(*) FILTER (WHERE cls >= 3) FROM scenario_cells GROUP BY year, scenario
""", "scored scenario_cells")
def _(spark, sf):
    from heatgrid.plans.scoring_views import scenario_cells
    d, n = scored(spark, sf), F.count(F.lit(1)).alias("pixels")
    a = d.groupBy("year").agg(n).select("year", F.lit("domain").alias("category"), F.lit("all").alias("name"), "pixels")
    b = d.groupBy("year", c("suitability_class").cast("string").alias("name")).agg(n).select(
        "year", F.lit("class").alias("category"), "name", "pixels")
    s = scenario_cells(spark, sf).groupBy("year", c("scenario").alias("name")).agg(F.count_if(c("cls") >= 3).alias("pixels"))
    return a.unionByName(b).unionByName(s.select("year", F.lit("scenario_high").alias("category"), "name", "pixels"))


@query("agg22_block_aggregate", """
WITH b AS (SELECT year, block_id, avg(severity_score) AS s, avg(lst_c) AS l FROM classed GROUP BY year, block_id),
q AS (SELECT year, quantile_cont(s, [0.25, 0.5, 0.75]) AS qs, quantile_cont(l, [0.25, 0.5, 0.75]) AS ql FROM b GROUP BY year),
k AS (SELECT b.year, block_id, CAST(s >= qs[1] AS INT) + CAST(s >= qs[2] AS INT) + CAST(s >= qs[3] AS INT) AS pred,
  CAST(l >= ql[1] AS INT) + CAST(l >= ql[2] AS INT) + CAST(l >= ql[3] AS INT) AS truth FROM b JOIN q ON b.year = q.year),
v AS (SELECT year, block_id, y_pred AS vote FROM (SELECT year, block_id, y_pred, row_number() OVER (
  PARTITION BY year, block_id ORDER BY count(*) DESC, y_pred) AS r FROM classed GROUP BY year, block_id, y_pred) WHERE r = 1)
SELECT k.year, k.block_id, pred, truth, vote, round(px, 6) AS pixel_accuracy,
  round(avg(CAST(pred = truth AS INT)) OVER (PARTITION BY k.year) - avg(px) OVER (PARTITION BY k.year), 6) AS uplift
FROM k JOIN v ON k.year = v.year AND k.block_id = v.block_id
JOIN (SELECT year, block_id, avg(CAST(y_true = y_pred AS INT)) AS px FROM classed GROUP BY year, block_id) p
  ON p.year = k.year AND p.block_id = k.block_id""", "classed")
def _(spark, sf):
    from heatgrid.operators.classify import class_of
    from heatgrid.operators.composite import mode_composite
    from heatgrid.session import cut
    from pyspark.sql.window import Window as W
    d, k = V.classed(spark, sf), ["year", "block_id"]
    # A quantile of 25 blocks is one block's own mean: means added up twice may differ in the last bit, so they are settled once.
    b = cut(d.groupBy(*k).agg(F.avg("severity_score").alias("s"), F.avg("lst_c").alias("l"),
                              F.avg((c("y_true") == c("y_pred")).cast("int")).alias("pixel_accuracy")))
    q = exact_quantiles(b, ["year"], ["s", "l"], [0.25, 0.5, 0.75]).groupBy("year").agg(
        F.max(F.when(c("variable") == "s", c("q"))).alias("qs"), F.max(F.when(c("variable") == "l", c("q"))).alias("ql"))
    b = b.join(F.broadcast(q), "year").withColumn("pred", class_of(c("s"), c("qs"))).withColumn(
        "truth", class_of(c("l"), c("ql")))
    vote = mode_composite(d, "y_pred", k, "vote").drop("mode_count")
    # A year has at most 25 blocks, so this window is small.
    w = W.partitionBy("year")
    return b.join(vote, k).select(
        *k, "pred", "truth", "vote", "pixel_accuracy",
        (F.avg((c("pred") == c("truth")).cast("int")).over(w) - F.avg("pixel_accuracy").over(w)).alias("uplift"))
