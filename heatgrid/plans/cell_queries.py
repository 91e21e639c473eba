"""Projections, masks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.operators import focal
from heatgrid.plans import views as V
from heatgrid.plans.registry import query
from heatgrid.sources.tables import table

c = F.col
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"


def _nd(a, b):
    return f"round(({a} - {b}) / nullif({a} + {b}, 0), 6) + 0"


@query("cel1_norm_diff", f"""
SELECT year, row, col, {_nd('b8', 'b4')} AS ndvi, {_nd('b11', 'b8a')} AS ndbi, {_nd('b8a', 'b5')} AS ndre,
 {_nd('b5', 'b6')} AS ndmi, {_nd('b3', 'b6')} AS mndwi, {_nd('b5', 'b4')} AS l9_ndvi, {_nd('b6', 'b5')} AS l9_ndbi
FROM composites""", "composites")
def _(spark, sf):
    pairs = {"ndvi": ("b8", "b4"), "ndbi": ("b11", "b8a"), "ndre": ("b8a", "b5"), "ndmi": ("b5", "b6"),
             "mndwi": ("b3", "b6"), "l9_ndvi": ("b5", "b4"), "l9_ndbi": ("b6", "b5")}
    return V.composites(spark, sf).select(
        "year", "row", "col", *[C.norm_diff(c(a), c(b)).alias(n) for n, (a, b) in pairs.items()])


@query("cel2_bsi", """
SELECT year, row, col, round(((b6 + b4) - (b5 + b2)) / nullif((b6 + b4) + (b5 + b2), 0), 6) AS bsi FROM composites
""", "composites")
def _(spark, sf):
    return V.composites(spark, sf).select("year", "row", "col", C.bsi(c("b2"), c("b4"), c("b5"), c("b6")).alias("bsi"))


@query("cel3_lst_c", """
SELECT year, row, col, scene_id, st_b10 * 0.00341802 + 149.0 - 273.15 AS x, qa FROM scene_obs
""".replace(" AS x", "").replace("st_b10 *", "round(st_b10 *").replace("273.15,", "273.15, 6) AS lst_c,"), "scene_obs")
def _(spark, sf):
    return V.scene_obs(spark, sf).select("year", "row", "col", "scene_id", C.lst_c(c("st_b10")).alias("lst_c"), "qa")


@query("cel4_scale_sr", f"""
SELECT {_K.replace(', l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax', '')},
  round(l_extendedprice * 0.0000275 - 0.2, 6) AS sr, round(l_extendedprice / 10000.0, 6) AS s2 FROM lineitem""")
def _(spark, sf):
    p = c("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.scale_sr(p).alias("sr"), C.scale_s2(p).alias("s2"))


@query("cel5_vegetation_cover", """
SELECT year, row, col, CASE WHEN ndvi IS NOT NULL THEN
  round(least(greatest((ndvi - 0.05) / 0.75, 0), 1), 6) END AS vegetation_cover FROM cells""", "cells")
def _(spark, sf):
    return V.cells(spark, sf).select("year", "row", "col", C.vegetation_cover(c("ndvi")).alias("vegetation_cover"))


@query("cel6_qa_clear", """
SELECT year, qa, (qa & 24) = 0 AS clear, count(*) AS n, count(*) FILTER (WHERE (qa & 1) <> 0) AS n_fill
FROM scene_obs GROUP BY year, qa""", "scene_obs")
def _(spark, sf):
    return V.scene_obs(spark, sf).groupBy("year", "qa", C.qa_clear(c("qa")).alias("clear")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("qa").bitwiseAND(C.FILL_BIT) != 0).alias("n_fill"))


@query("cel7_scl_clear", """
SELECT year, scl, scl NOT IN (3, 8, 9, 10) AS clear, (q60 & 3072) = 0 AS qa60_clear, count(*) AS n
FROM (SELECT *, CASE scene_id % 3 WHEN 0 THEN 1024 WHEN 1 THEN 2048 ELSE 512 END AS q60 FROM scene_obs)
GROUP BY ALL""", "scene_obs")
def _(spark, sf):
    q60 = F.when(c("scene_id") % 3 == 0, 1024).when(c("scene_id") % 3 == 1, 2048).otherwise(512)
    return V.scene_obs(spark, sf).groupBy(
        "year", "scl", C.scl_clear(c("scl")).alias("clear"), C.qa60_clear(q60).alias("qa60_clear")
    ).agg(F.count(F.lit(1)).alias("n"))


_VALID = """
v AS (SELECT c.*, m.lulc_class,
  st_b10 IS NOT NULL AND b2 IS NOT NULL AND clear_count >= 1 AS valid_l9,
  b2 IS NOT NULL AND b3 IS NOT NULL AND b4 IS NOT NULL AND b8 IS NOT NULL AND clear_count >= 1 AND b2 > 0 AS valid_s2_10m,
  b5 IS NOT NULL AND b8a IS NOT NULL AND b11 IS NOT NULL AND clear_count >= 1 AS valid_s2_20m,
  m.lulc_class IS NOT NULL AND m.lulc_class BETWEEN 0 AND 8 AS valid_lulc,
  m.lulc_class IS NOT NULL AND m.lulc_class BETWEEN 1 AND 8 AS valid_lulc_dry
  FROM composites c JOIN modes m ON c.year = m.year AND c.row = m.row AND c.col = m.col)"""


def valid_masks(spark, sf):
    from heatgrid.operators.composite import mode_composite
    comp = V.composites(spark, sf).join(
        mode_composite(V.scene_obs(spark, sf), "lulc", out="lulc_class"), ["year", "row", "col"])
    n = c("clear_count")
    return comp.select(
        "year", "row", "col", *[c(b) for b in ("b2", "b3", "b4", "b5", "b8", "b8a", "b11")], "clear_count",
        C.valid_l9(c("st_b10"), c("b2"), n).alias("valid_l9"),
        F.coalesce(C.valid_s2_10m(c("b2"), c("b3"), c("b4"), c("b8"), n), F.lit(False)).alias("valid_s2_10m"),
        C.valid_s2_20m([c("b5"), c("b8a"), c("b11")], n).alias("valid_s2_20m"),
        C.valid_lulc(c("lulc_class")).alias("valid_lulc"),
        C.valid_lulc(c("lulc_class"), water_is_valid=False).alias("valid_lulc_dry"))


@query("cel8_valid_masks", f"""
WITH {_VALID} SELECT year, row, col, coalesce(valid_l9, false) AS valid_l9, coalesce(valid_s2_10m, false) AS valid_s2_10m,
  coalesce(valid_s2_20m, false) AS valid_s2_20m, valid_lulc, valid_lulc_dry FROM v""", "composites modes")
def _(spark, sf):
    return valid_masks(spark, sf).select(
        "year", "row", "col", "valid_l9", "valid_s2_10m", "valid_s2_20m", "valid_lulc", "valid_lulc_dry")


@query("cel9_b2_guard", """
SELECT year, count(*) AS n, count(*) FILTER (WHERE b2 > 0 AND clear) AS valid,
  count(*) FILTER (WHERE clear) AS finite, count(*) FILTER (WHERE b2 = 0 AND clear) AS b2_zero,
  count(*) FILTER (WHERE b2 > 0 AND clear) = count(*) FILTER (WHERE clear) - count(*) FILTER (WHERE b2 = 0 AND clear)
    AS identity_holds
FROM (SELECT *, scl NOT IN (3, 8, 9, 10) AS clear FROM scene_obs) GROUP BY year""", "scene_obs")
def _(spark, sf):
    one = F.when(C.scl_clear(c("scl")), 1).otherwise(0)
    bands = [c(b) for b in ("b2", "b3", "b4", "b8")]
    finite, valid = C.finite_stack(bands, one), C.valid_s2_10m(*bands, one)
    d = V.scene_obs(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"), F.count_if(finite).alias("finite"),
        F.count_if(finite & (c("b2") == 0)).alias("b2_zero"))
    return d.withColumn("identity_holds", c("valid") == c("finite") - c("b2_zero"))


@query("cel10_null_invalid", """
SELECT year, row, col, scene_id, CASE WHEN ok THEN round(b4, 6) END AS b4, CASE WHEN ok THEN round(b8, 6) END AS b8
FROM (SELECT *, scl NOT IN (3, 8, 9, 10) AND b2 > 0 AS ok FROM scene_obs)""", "scene_obs")
def _(spark, sf):
    obs = V.scene_obs(spark, sf).select("year", "row", "col", "scene_id", "scl", "b2", "b4", "b8")
    return C.null_invalid(obs, ["b4", "b8"], C.scl_clear(c("scl")) & (c("b2") > 0)).drop("scl", "b2")


@query("cel11_physical_range", """
SELECT year, row, col, scene_id, round(st_b10 * 0.00341802 + 149.0, 6) AS kelvin FROM scene_obs
WHERE st_b10 * 0.00341802 + 149.0 BETWEEN 250 AND 350 AND st_b10 <> 0""", "scene_obs")
def _(spark, sf):
    k = c("st_b10") * C.LST_SCALE + C.LST_OFFSET
    return V.scene_obs(spark, sf).where(C.in_physical_range(k, c("st_b10"))).select(
        "year", "row", "col", "scene_id", k.alias("kelvin"))


@query("cel12_domain", """
SELECT d.year, d.row, d.col, d.in_study, p.row IS NOT NULL AS in_every_year FROM domain d LEFT JOIN (
  SELECT row, col FROM domain GROUP BY row, col HAVING count(DISTINCT year) = 5) p ON d.row = p.row AND d.col = p.col
""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf)
    pairs = C.paired_cells(d, 5).withColumn("in_every_year", F.lit(True))
    return d.join(pairs, ["row", "col"], "left").select(
        "year", "row", "col", "in_study", F.coalesce("in_every_year", F.lit(False)).alias("in_every_year"))


@query("cel13_block_id", """
SELECT c.year, c.row, c.col, c.block_id,
  CAST((c.row - r0) * 5 // (r1 + 1 - r0) AS INT) * 5 + CAST((c.col - c0) * 5 // (c1 + 1 - c0) AS INT) AS derived_block
FROM cells c JOIN (SELECT year, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM cells GROUP BY year) e
  ON c.year = e.year""", "cells")
def _(spark, sf):
    return C.derived_block_id(V.cells(spark, sf).select("year", "row", "col", "block_id"))


LON0, LAT0 = 76.80, 28.92


def res_of(n):
    return 0.52 / n


@query("cel14_lonlat", f"""
SELECT row, col, round({LON0} + (col + 0.5) * (0.52 / side), 9) AS lon, round({LAT0} - (row + 0.5) * (0.52 / side), 9) AS lat
FROM lattice, grid""", "lattice grid", digits=9)
def _(spark, sf):
    r = res_of(V.side(spark, sf))
    return V.lattice(spark, sf).select(
        "row", "col", C.centre(c("col"), LON0, r).alias("lon"), C.centre(c("row"), LAT0, -r).alias("lat"))


@query("cel14_lonlat_of_cells", f"""
SELECT year, row, col, round({LON0} + (col + 0.5) * (0.52 / side), 9) AS lon, round({LAT0} - (row + 0.5) * (0.52 / side), 9) AS lat
FROM cells, grid""", "cells grid", digits=9)
def _(spark, sf):
    r = res_of(V.side(spark, sf))
    return V.cells(spark, sf).select(
        "year", "row", "col", C.centre(c("col"), LON0, r).alias("lon"), C.centre(c("row"), LAT0, -r).alias("lat"))


_LULC = list(range(8))


@query("cel15_one_hot", "SELECT year, row, col, " + ", ".join(
    f"CAST(coalesce(lulc_class = {v}, false) AS INT) AS lulc_class_{v}" for v in _LULC)
    + ", CAST(lulc_class NOT BETWEEN 0 AND 7 AS INT) AS unseen FROM cells", "cells")
def _(spark, sf):
    d = V.cells(spark, sf).select("year", "row", "col", "lulc_class")
    d = d.withColumn("unseen", (~c("lulc_class").isin(*_LULC)).cast("int"))
    return C.one_hot(d, "lulc_class", _LULC)


@query("cel16_green_built", """
SELECT year, row, col, CASE WHEN ndvi >= 0.3 THEN 'green_dominant' WHEN ndbi >= 0.1 AND ndvi < 0.3 THEN 'built_dominant'
  ELSE 'mixed' END AS green_built FROM domain""", "domain")
def _(spark, sf):
    return V.domain(spark, sf).select("year", "row", "col", C.green_built(c("ndvi"), c("ndbi")).alias("green_built"))


@query("cel17_confidence", """
SELECT year, row, col, confidence, severity_score,
  round(confidence - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)), 6) AS top2_margin FROM classed""", "classed")
def _(spark, sf):
    p = c("probability")
    return V.classed(spark, sf).select(
        "year", "row", "col", C.confidence(p).alias("confidence"), C.severity_score(p).alias("severity_score"),
        F.round(C.top2_margin(p), 6).alias("top2_margin"))


@query("cel18_argmax_class", "SELECT year, row, col, y_pred FROM classed", "classed")
def _(spark, sf):
    return V.classed(spark, sf).select("year", "row", "col", C.argmax_class(c("probability")).alias("y_pred"))


_EDGE = """
nb AS (SELECT year, row, col, cls,
  coalesce((lag(col) OVER h = col - 1 AND lag(cls) OVER h <> cls), false)
  OR coalesce((lead(col) OVER h = col + 1 AND lead(cls) OVER h <> cls), false)
  OR coalesce((lag(row) OVER v = row - 1 AND lag(cls) OVER v <> cls), false)
  OR coalesce((lead(row) OVER v = row + 1 AND lead(cls) OVER v <> cls), false) AS boundary
  FROM (SELECT *, y_pred AS cls FROM classed)
  WINDOW h AS (PARTITION BY year, row ORDER BY col), v AS (PARTITION BY year, col ORDER BY row))"""


@query("cel19_uncertain", f"""
WITH {_EDGE}
SELECT c.year, count(*) AS valid_cells, count(*) FILTER (WHERE u) AS uncertain_cells,
  round(avg(confidence) FILTER (WHERE u), 6) AS confidence_uncertain,
  round(avg(confidence) FILTER (WHERE NOT u), 6) AS confidence_certain,
  round(avg(CAST(boundary AS INT)) FILTER (WHERE u), 6) AS boundary_uncertain,
  round(avg(CAST(boundary AS INT)) FILTER (WHERE NOT u), 6) AS boundary_certain
FROM (SELECT *, round(confidence - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)), 6) < 0.1
        OR confidence < 0.5 AS u FROM classed) c
JOIN nb ON nb.year = c.year AND nb.row = c.row AND nb.col = c.col GROUP BY c.year""", "classed")
def _(spark, sf):
    p = c("probability")
    d = V.classed(spark, sf).select(
        "year", "row", "col", "confidence", "y_pred",
        ((F.round(C.top2_margin(p), 6) < 0.10) | (c("confidence") < 0.50)).alias("u"))
    d = focal.class_boundary(d, "y_pred")
    b, u = c("boundary").cast("int"), c("u")
    return d.groupBy("year").agg(
        F.count(F.lit(1)).alias("valid_cells"), F.count_if(u).alias("uncertain_cells"),
        F.avg(F.when(u, c("confidence"))).alias("confidence_uncertain"),
        F.avg(F.when(~u, c("confidence"))).alias("confidence_certain"),
        F.avg(F.when(u, b)).alias("boundary_uncertain"), F.avg(F.when(~u, b)).alias("boundary_certain"))


@query("cel22_season_windows", """
SELECT l_orderkey, l_linenumber, l_partkey, win FROM lineitem JOIN (
  SELECT 'W0' AS win, 701 AS a, 731 AS z UNION ALL SELECT 'W1', 401, 531 UNION ALL SELECT 'W2', 501, 531
  UNION ALL SELECT 'W3', 601, 630 UNION ALL SELECT 'W4', 501, 630) ON month(l_shipdate) * 100 + day(l_shipdate) BETWEEN a AND z""")
def _(spark, sf):
    from heatgrid.plans.composite_queries import WINDOWS
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.explode(C.season_windows(c("l_shipdate"), WINDOWS)).alias("win"))


@query("cel23_distance_bands", """
SELECT row, col, CASE WHEN dist_road_m < 50 THEN 'road_corridor_<50m' WHEN dist_road_m < 500 THEN '50-500m'
    WHEN dist_road_m < 2000 THEN '500-2000m' ELSE '>=2000m' END AS road_band,
  CASE WHEN dist_vegetation_m < 100 THEN '<100m' WHEN dist_vegetation_m < 250 THEN '100-250m'
    WHEN dist_vegetation_m < 500 THEN '250-500m' ELSE '>=500m' END AS green_band,
  CASE WHEN dist_building_m < 500 THEN '0-500m' WHEN dist_building_m < 1000 THEN '500-1000m'
    WHEN dist_building_m < 2000 THEN '1000-2000m' ELSE '>2000m' END AS train_band FROM cells_static""", "cells_static")
def _(spark, sf):
    return V.cells_static(spark, sf).select(
        "row", "col",
        C.bands_text(c("dist_road_m"), [50, 500, 2000], ["road_corridor_<50m", "50-500m", "500-2000m", ">=2000m"])
        .alias("road_band"),
        C.bands_text(c("dist_vegetation_m"), [100, 250, 500], ["<100m", "100-250m", "250-500m", ">=500m"])
        .alias("green_band"),
        C.bands_text(c("dist_building_m"), [500, 1000, 2000], ["0-500m", "500-1000m", "1000-2000m", ">2000m"])
        .alias("train_band"))


@query("cel25_eligible_landuse", """
SELECT row, col, coalesce(landuse_class NOT IN (5, 7), true) AS eligible FROM cells_static""", "cells_static")
def _(spark, sf):
    return V.cells_static(spark, sf).select("row", "col", C.eligible_landuse(c("landuse_class")).alias("eligible"))


@query("cel26_exclusion_mask", """
SELECT d.year, count(*) AS n_cells, count(*) FILTER (WHERE x.row IS NULL) AS n_excluded,
  count(*) FILTER (WHERE x.row IS NOT NULL) AS n_domain
FROM dense d LEFT JOIN domain x ON d.year = x.year AND d.row = x.row AND d.col = x.col GROUP BY d.year""", "dense domain")
def _(spark, sf):
    inside = V.domain(spark, sf).select("year", "row", "col", F.lit(0).alias("excluded"))
    mask = V.dense(spark, sf).select("year", "row", "col").join(inside, ["year", "row", "col"], "left")
    mask = mask.withColumn("excluded", F.coalesce("excluded", F.lit(1)))
    return mask.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("excluded").alias("n_excluded"),
        F.count_if(c("excluded") == 0).alias("n_domain"))
