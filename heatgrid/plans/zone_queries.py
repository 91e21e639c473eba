"""Hotspots, zones and candidate sites: components, attributes, ranks, trees and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.functions import scores as S
from heatgrid.operators import components as G
from heatgrid.operators import ranking as R
from heatgrid.operators import rings as RG
from heatgrid.operators.composite import mode_composite
from heatgrid.operators.quantiles import exact_quantiles, grouped_quantiles, quantile_columns, ranked
from heatgrid.plans import views as V
from heatgrid.plans.ctes import cte
from heatgrid.plans.profile_queries import LANDUSE_NAMES, _NAMES, landuse_name
from heatgrid.plans.registry import query
from heatgrid.plans.scoring_views import (
    component_ctes, cuts, hot3_labels, hot_labels, scenario_array, scenario_cells, scored, site_labels, zone_labels)

c = F.col
K = ["year", "row", "col"]
HA = 0.09

# --- scores ------------------------------------------------------------------------------------


@query("sco1_robust_minmax", "SELECT year, row, col, round(n_sev, 6) AS n_sev, round(n_ndvi, 6) AS n_ndvi, round(n_ndbi, 6) AS n_ndbi, round(n_lst, 6) AS n_lst FROM norm100", "norm100")
def _(spark, sf):
    d = V.classed(spark, sf)
    names = {"severity_score": "sev", "ndvi": "ndvi", "ndbi": "ndbi", "lst_c": "lst"}
    b = quantile_columns(d, ["year"], {v: [f"{a}_lo", f"{a}_hi"] for v, a in names.items()}, [0.01, 0.99])
    return d.join(F.broadcast(b), "year").select(
        *K, *[F.round(S.scaled(c(v), c(f"{a}_lo"), c(f"{a}_hi")), 9).alias(f"n_{a}") for v, a in names.items()])


@query("sco2_pooled_normalize", "SELECT year, row, col, round(p_lst, 6) AS p_lst, round(p_veg_deficit, 6) AS p_veg_deficit FROM prescored", "prescored")
def _(spark, sf):
    pool = V.domain(spark, sf).withColumn("_all", F.lit(1))
    b = quantile_columns(pool, ["_all"], {"lst_c": ["l1", "l99"], "vegetation_cover": ["g1", "g99"]}, [0.01, 0.99])
    return V.domain(spark, sf).join(F.broadcast(b)).select(
        *K, F.round(S.scaled(c("lst_c"), c("l1"), c("l99")), 6).alias("p_lst"),
        F.round(S.scaled(1 - c("vegetation_cover"), 1 - c("g99"), 1 - c("g1")), 6).alias("p_veg_deficit"))


@query("sco3_road_accessibility", """SELECT row, col, round(CASE WHEN dist_road_m < 50 THEN dist_road_m * 0.8 WHEN dist_road_m <= 500 THEN 100
  WHEN dist_road_m < 2000 THEN 100 - 70 * (dist_road_m - 500) / 1500 ELSE 30 END, 6) AS score FROM cells_static""", "cells_static")
def _(spark, sf):
    return V.cells_static(spark, sf).select("row", "col", S.road_accessibility(c("dist_road_m")).alias("score"))


@query("sco4_green_proximity", "SELECT row, col, round(100 * greatest(0, 1 - dist_vegetation_m / 500), 6) AS score FROM cells_static", "cells_static")
def _(spark, sf):
    return V.cells_static(spark, sf).select("row", "col", S.green_proximity(c("dist_vegetation_m")).alias("score"))


_LU = " ".join(f"WHEN {k} THEN {v}" for k, v in S.LANDUSE_SCORE.items())


@query("sco5_landuse_eligibility", f"""SELECT landuse_class, CAST(CASE landuse_class {_LU} ELSE 50 END AS DOUBLE) AS score,
  CASE landuse_class {_NAMES} ELSE 'untagged' END AS landuse, coalesce(landuse_class NOT IN (5, 7), true) AS eligible, count(*) AS n
FROM cells_static GROUP BY landuse_class""", "cells_static")
def _(spark, sf):
    lu = c("landuse_class")
    return V.cells_static(spark, sf).groupBy("landuse_class").agg(F.count(F.lit(1)).alias("n")).select(
        "landuse_class", S.landuse_eligibility(lu).alias("score"), landuse_name(lu).alias("landuse"),
        C.eligible_landuse(lu).alias("eligible"), "n")


for _key, _cols, _doc in (
    ("sco6_heat_need", ["need", "need_d"], "Heat need, baseline and vegetation variant."),
    ("sco7_cooling_need", ["need01"], "Cooling need over pooled references."),
    ("sco8_opportunity", ["opportunity", "opportunity_d", "opp01"], "Planting opportunity."),
    ("sco9_gated_product", ["suitability", "suit01"], "Need times opportunity."),
    ("sco12_feasible", ["eligible", "water", "buildings", "road_surfaces", "feasible"], "Feasible land."),
    ("sco13_priority", ["priority"], "Half need, half suitability, on feasible land."),
):
    def _score(spark, sf, cols=tuple(_cols)):
        return scored(spark, sf).select(*K, *cols)

    _sel = ", ".join(f"round({x}, 6) AS {x}" if _key not in ("sco12_feasible",) else x for x in _cols)
    query(_key, f"SELECT year, row, col, {_sel} FROM scored", "scored")(_score)


@query("sco10_weighted_geometric", "SELECT year, row, col, scenario, round(score, 6) AS score, cls FROM scenario_cells", "scenario_cells")
def _(spark, sf):
    return scenario_cells(spark, sf).select(*K, "scenario", "score", "cls")


@query("sco11_additive_diagnostic", "SELECT year, row, col, round(0.5 * need + 0.5 * opportunity, 6) AS diagnostic FROM scored", "scored")
def _(spark, sf):
    return scored(spark, sf).select(*K, S.additive(c("need"), c("opportunity")).alias("diagnostic"))


@query("sco14_constraint_class", """SELECT year, CASE WHEN water THEN 1 WHEN buildings THEN 2 WHEN road_surfaces THEN 3 ELSE 0 END AS code,
  count(*) AS n FROM scored GROUP BY 1, 2""", "scored")
def _(spark, sf):
    code = S.constraint_class(c("water"), c("buildings"), c("road_surfaces"))
    return scored(spark, sf).groupBy("year", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


# --- components and zones ------------------------------------------------------------------------

@query("grf1_label_components", "SELECT year, row, col, zone_id, n_px FROM hot_cells", "hot_cells")
def _(spark, sf):
    """Tiles of 16 cells, so that components cross tiles on the check's small grid too."""
    return G.label_components(V.classed(spark, sf).where("y_pred = 2"), ["year"], 10, tile=16)


@query("grf2_hotspots", """
SELECT def, year, count(DISTINCT zone_id) AS n_hotspots, count(*) AS pixels, round(count(*) * 0.09, 6) AS area_ha, max(n_px) AS largest_px
FROM hot3_cells GROUP BY def, year""", "hot3_cells")
def _(spark, sf):
    return hot3_labels(spark, sf).groupBy("def", "year").agg(
        F.count_distinct("zone_id").alias("n_hotspots"), F.count(F.lit(1)).alias("pixels"),
        (F.count(F.lit(1)) * HA).alias("area_ha"), F.max("n_px").alias("largest_px"))


cte("hot_full", "hot_cells classed", "SELECT h.zone_id, h.n_px, c.* FROM hot_cells h JOIN classed c ON c.year = h.year AND c.row = h.row AND c.col = h.col")


def hot_full(spark, sf):
    return hot_labels(spark, sf).join(V.classed(spark, sf), K)


@query("grf3_hotspot_attributes", f"""
WITH lu AS (SELECT year, zone_id, landuse_class AS code, count(*) AS n, row_number() OVER (PARTITION BY year, zone_id ORDER BY count(*) DESC, landuse_class) AS k
  FROM hot_full WHERE landuse_class IS NOT NULL GROUP BY year, zone_id, landuse_class)
SELECT h.year, h.zone_id, count(*) AS pixels, round(count(*) * 0.09, 6) AS area_ha, round(avg(row + 0.5), 6) AS centre_row,
  round(avg(col + 0.5), 6) AS centre_col, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col,
  round(avg(CAST(y_true = 2 AS INT)), 6) AS true_high_share, round(avg(lst_c), 6) AS mean_lst, round(quantile_cont(lst_c, 0.5), 6) AS median_lst,
  max(lst_c) AS max_lst, round(avg(ndvi), 6) AS mean_ndvi, round(avg(CAST(ndvi >= 0.3 AS INT)), 6) AS green_share,
  round(avg(CAST(ndvi < 0.3 AND ndbi >= 0.1 AS INT)), 6) AS built_share, any_value(l1.code) AS top1, any_value(l2.code) AS top2, any_value(l3.code) AS top3
FROM hot_full h LEFT JOIN lu l1 ON l1.year = h.year AND l1.zone_id = h.zone_id AND l1.k = 1
LEFT JOIN lu l2 ON l2.year = h.year AND l2.zone_id = h.zone_id AND l2.k = 2
LEFT JOIN lu l3 ON l3.year = h.year AND l3.zone_id = h.zone_id AND l3.k = 3 GROUP BY h.year, h.zone_id""", "hot_full")
def _(spark, sf):
    d, k = hot_full(spark, sf), ["year", "zone_id"]
    n = F.count(F.lit(1))
    aggs = [
        n.alias("pixels"), (n * HA).alias("area_ha"), F.avg(c("row") + 0.5).alias("centre_row"), F.avg(c("col") + 0.5).alias("centre_col"),
        *[f(x).alias(f"{a}_{x}") for x in ("row", "col") for a, f in (("min", F.min), ("max", F.max))],
        F.avg((c("y_true") == 2).cast("int")).alias("true_high_share"), F.avg("lst_c").alias("mean_lst"), F.max("lst_c").alias("max_lst"),
        F.avg("ndvi").alias("mean_ndvi"), F.avg((c("ndvi") >= 0.3).cast("int")).alias("green_share"),
        F.avg(((c("ndvi") < 0.3) & (c("ndbi") >= 0.1)).cast("int")).alias("built_share")]
    zones = grouped_quantiles(d, k, {"lst_c": ["median_lst"]}, [0.5], aggs)
    # At most nine land-use codes per zone reach the array below.
    lu = d.where("landuse_class is not null").groupBy(*k, "landuse_class").agg(F.count(F.lit(1)).alias("n"))
    top = lu.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct((-c("n")).alias("n"), "landuse_class"))).alias("t"))
    return zones.join(top, k, "left").select("*", *[
        F.try_element_at("t", F.lit(i))["landuse_class"].alias(f"top{i}") for i in (1, 2, 3)]).drop("t")


cte("zone_table", "zone_cells scenario_cells scored", """
SELECT z.scenario, z.year, z.zone_id, count(*) AS pixels, avg(s.score) AS mean_score, avg(d.need) AS mean_need, avg(d.confidence) AS mean_confidence,
  avg(a.agreement) AS mean_agreement, avg(CAST(s.cls >= 3 AS INT)) AS high_share, avg(vegetation_cover) AS mean_veg
FROM zone_cells z JOIN scenario_cells s ON s.scenario = z.scenario AND s.year = z.year AND s.row = z.row AND s.col = z.col
JOIN scored d ON d.year = z.year AND d.row = z.row AND d.col = z.col
JOIN (SELECT year, row, col, avg(CAST(cls >= 3 AS INT)) AS agreement FROM scenario_cells GROUP BY ALL) a ON a.year = z.year AND a.row = z.row AND a.col = z.col
GROUP BY z.scenario, z.year, z.zone_id
""")


def zone_table(spark, sf):
    """A cell carries its scenarios and their agreement with it, so cells meet their zones in one join."""
    cls = F.filter(c("_s.cls"), lambda x: x.isNotNull())
    agree = F.try_divide(F.size(F.filter(cls, lambda x: x >= 3)).cast("double"), F.size(cls))
    s = scored(spark, sf).select(*K, "need", "confidence", "vegetation_cover", scenario_array().alias("_s"))
    s = s.withColumn("agreement", agree).withColumn("_s", F.explode("_s")).select("*", "_s.scenario", "_s.score", "_s.cls").drop("_s")
    d = zone_labels(spark, sf).drop("n_px").join(s, ["scenario", *K])
    return d.groupBy("scenario", "year", "zone_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("score").alias("mean_score"), F.avg("need").alias("mean_need"),
        F.avg("confidence").alias("mean_confidence"), F.avg("agreement").alias("mean_agreement"),
        F.avg((c("cls") >= 3).cast("int")).alias("high_share"), F.avg("vegetation_cover").alias("mean_veg"))


@query("grf4_priority_zones", """
SELECT scenario, year, zone_id, pixels, round(pixels * 0.09, 6) AS area_ha, round(mean_score, 6) AS mean_score, round(high_share, 6) AS high_share,
  round(100 * mean_confidence * mean_agreement, 6) AS priority_confidence FROM zone_table""", "zone_table")
def _(spark, sf):
    return zone_table(spark, sf).select(
        "scenario", "year", "zone_id", "pixels", (c("pixels") * HA).alias("area_ha"), "mean_score", "high_share",
        (c("mean_confidence") * 100 * c("mean_agreement")).alias("priority_confidence"))


@query("grf11_zone_counts", """
SELECT scenario, year, count(*) AS n_zones, CAST(sum(n_px) AS BIGINT) AS zone_px FROM (SELECT DISTINCT scenario, year, zone_id, n_px FROM zone_cells) GROUP BY ALL""", "zone_cells")
def _(spark, sf):
    z = zone_labels(spark, sf).select("scenario", "year", "zone_id", "n_px").distinct()
    return z.groupBy("scenario", "year").agg(F.count(F.lit(1)).alias("n_zones"), F.sum("n_px").alias("zone_px"))


MAX_HA, TOP = 2.0, 100
cte("sites", "site_cells scored", f"""
SELECT *, rank() OVER w * 0 + CAST(row_number() OVER w AS INT) AS rank, usable_ha > {MAX_HA} AS oversized,
  CASE WHEN usable_ha > {MAX_HA} THEN 0 ELSE CAST(sum(CASE WHEN usable_ha > {MAX_HA} THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS INT) END AS rank_excl
FROM (SELECT z.year, z.zone_id, count(*) AS px, round(count(*) * 0.09, 3) AS usable_ha, avg(p_lst) AS need_c, avg(p_veg_deficit) AS veg_c,
  avg(opp01 * 100) AS opp_c, round(0.5 * avg(p_lst) + 0.25 * avg(p_veg_deficit) + 0.25 * avg(opp01 * 100) + 1.2345e-9, 6) AS score,
  avg(CAST(coalesce(landuse_class, 255) = 0 AS INT)) AS untagged_share
  FROM site_cells z JOIN scored s ON s.year = z.year AND s.row = z.row AND s.col = z.col GROUP BY z.year, z.zone_id)
WINDOW w AS (PARTITION BY year ORDER BY score DESC, zone_id)
""".replace("rank() OVER w * 0 + ", ""))


def site_table(spark, sf, top=TOP):
    """Sites with score parts and shortlist flags. The usable area is rounded, as the rule does."""
    d = site_labels(spark, sf).join(scored(spark, sf), K)
    z = d.groupBy("year", "zone_id").agg(
        F.count(F.lit(1)).alias("px"), F.avg("p_lst").alias("need_c"), F.avg("p_veg_deficit").alias("veg_c"),
        F.avg(c("opp01") * 100).alias("opp_c"), F.avg(F.coalesce(c("landuse_class") == 0, F.lit(False)).cast("int")).alias("untagged_share"))
    z = z.withColumn("usable_ha", F.round(c("px") * HA, 3)).withColumn(
        "score", F.round(c("need_c") * 0.5 + c("veg_c") * 0.25 + c("opp_c") * 0.25 + 1.2345e-9, 6))
    return R.shortlist(z, ["year"], "score", "usable_ha", MAX_HA, top)


@query("grf5_candidate_sites", """
SELECT year, zone_id, px, round(usable_ha, 6) AS usable_ha, round(need_c, 6) AS need_c, round(veg_c, 6) AS veg_c, round(opp_c, 6) AS opp_c,
  round(score, 6) AS score, round(untagged_share, 6) AS untagged_share, rank, oversized FROM sites""", "sites")
def _(spark, sf):
    return site_table(spark, sf).drop("rank_excl", "shortlist")


component_ctes("change_cells", """SELECT change, row, col FROM (SELECT a.row, a.col, CASE WHEN a.y_pred = 2 AND b.y_pred = 2 THEN 'persistent'
  WHEN b.y_pred = 2 THEN 'new' WHEN a.y_pred = 2 THEN 'disappeared' END AS change FROM classed a JOIN classed b ON a.row = b.row AND a.col = b.col
  WHERE a.year = 2022 AND b.year = 2026) WHERE change IS NOT NULL""", "classed", "change", 2)


@query("grf6_temporal_zones", "SELECT change, row, col, zone_id, n_px FROM change_cells", "change_cells")
def _(spark, sf):
    from heatgrid.operators.overlap import change_category, year_pair
    p = year_pair(V.classed(spark, sf), 2022, 2026, ["y_pred"])
    p = p.withColumn("change", change_category(c("y_pred_1") == 2, c("y_pred_2") == 2)).where("change <> 'stable_not'")
    return G.label_components(p, ["change"], 2)


@query("grf7_stable_ids")
def _(spark, sf):
    """Chain each year's zones to the last ids they overlap most (30 % of the zone); the largest
    claimant keeps an id, other overlapping zones get ids from 90000, unmatched zones new ones."""
    return stable_ids(hot_labels(spark, sf), [2022, 2023, 2024, 2025, 2026])


def stable_ids(labels, years, min_share=0.30, other=90_000):
    """One join per year against the previous year's ids; zone tables only, cells stay in Spark."""
    from heatgrid.session import cut
    out, prev = None, None
    spark = labels.sparkSession
    top, extra = 0, other
    for y in years:
        z = labels.where(c("year") == y).select("row", "col", "zone_id", "n_px")
        zones = z.select("zone_id", "n_px").distinct()
        if prev is None:
            ids = zones.select("zone_id", c("zone_id").alias("stable_id"), F.lit("new").alias("how"))
        else:
            hit = z.join(prev, ["row", "col"]).groupBy("zone_id", "n_px", "stable_id").agg(F.count(F.lit(1)).alias("n"))
            hit = hit.where(c("n") >= c("n_px") * min_share)
            best = hit.groupBy("zone_id", "n_px").agg(F.max(F.struct("n", (-c("stable_id")).alias("s"))).alias("b")).select(
                "zone_id", "n_px", (-c("b.s")).alias("stable_id"))
            holder = best.groupBy("stable_id").agg(F.max(F.struct("n_px", (-c("zone_id")).alias("z"))).alias("h")).select(
                "stable_id", (-c("h.z")).alias("holder"))
            claim = best.join(holder, "stable_id").withColumn("keeps", c("holder") == c("zone_id"))
            kept = claim.where("keeps").select("zone_id", "stable_id", F.lit("kept").alias("how"))
            split = ranked(claim.where("not keeps").select("zone_id"), [], c("zone_id"), [c("zone_id")], out="_r").select(
                "zone_id", (c("_r") + (extra - 1)).alias("stable_id"), F.lit("split").alias("how"))
            fresh = ranked(zones.join(best, "zone_id", "left_anti").select("zone_id"), [], c("zone_id"), [c("zone_id")], out="_r").select(
                "zone_id", (c("_r") + top).alias("stable_id"), F.lit("new").alias("how"))
            ids = kept.unionByName(split).unionByName(fresh)
        ids = cut(ids)
        top = max(top, ids.where(c("stable_id") < other).agg(F.max("stable_id")).first()[0] or 0)
        extra = max(extra, (ids.where(c("how") == "split").agg(F.max("stable_id")).first()[0] or extra - 1) + 1)
        prev = z.join(ids, "zone_id").select("row", "col", "stable_id")
        rows = ids.join(zones, "zone_id").withColumn("year", F.lit(y))
        out = rows if out is None else out.unionByName(rows)
    return out


component_ctes("plant_cells", """SELECT z.scenario, s.year, s.row, s.col FROM scored s JOIN zone_cells z ON z.year = s.year AND z.row = s.row AND z.col = s.col
  WHERE eligible AND vegetation_cover < 0.30""", "scored zone_cells", "scenario, year", 1)


def plantable(spark, sf):
    """The zones' cells of every scenario, and whether trees can be planted there."""
    z = zone_labels(spark, sf).select("scenario", *K, "zone_id", "n_px")
    return scored(spark, sf).join(z, K).withColumn("plantable", c("eligible") & (c("vegetation_cover") < 0.30))


@query("grf8_plantation_clusters", """
SELECT p.scenario, p.year, p.zone_id AS cluster_id, any_value(p.n_px) AS n_px, min(z.zone_id) AS zone_id, count(DISTINCT z.zone_id) = 1 AS in_one_zone
FROM plant_cells p JOIN zone_cells z ON z.scenario = p.scenario AND z.year = p.year AND z.row = p.row AND z.col = p.col GROUP BY p.scenario, p.year, p.zone_id""", "plant_cells")
def _(spark, sf):
    d = plantable(spark, sf).where("plantable").select("scenario", *K, "zone_id")
    p = G.label_components(d, ["scenario", "year"], 1).withColumnRenamed("zone_id", "cluster_id")
    return p.join(d, ["scenario", *K]).groupBy("scenario", "year", "cluster_id").agg(
        F.first("n_px").alias("n_px"), F.min("zone_id").alias("zone_id"), (F.count_distinct("zone_id") == 1).alias("in_one_zone"))


def hot_rings(spark, sf, tile=16):
    """Outline pieces and rings of the hotspots; small tiles, so that rings cross them on the check's small grid too."""
    p = V.product(spark, sf, "hot_pieces", lambda: RG.outline_pieces(hot_labels(spark, sf), tile=tile))
    return p, V.product(spark, sf, "hot_rings", lambda: RG.zone_rings(p))


_SIDES = " UNION ALL ".join(f"SELECT year, zone_id, row + {a} AS r1, col + {b} AS c1, row + {d} AS r2, col + {e} AS c2 FROM hot_cells"
                            for a, b, d, e in ((0, 0, 0, 1), (1, 0, 1, 1), (0, 0, 1, 0), (0, 1, 1, 1)))


@query("grf9_zone_outline", f"SELECT year, zone_id, r1, c1, r2, c2 FROM ({_SIDES}) GROUP BY ALL HAVING count(*) = 1", "hot_cells")
def _(spark, sf):
    return G.zone_edges(hot_labels(spark, sf))


_QUADS = """
q AS (SELECT year, zone_id, r, c, count(*) AS k, count(*) = 2 AND count(DISTINCT dr) = 2 AND count(DISTINCT dc) = 2 AS diagonal
  FROM (SELECT year, zone_id, row + dr AS r, col + dc AS c, dr, dc FROM hot_cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dr, dc)) GROUP BY ALL)"""


@query("grf9_zone_rings", f"""WITH {_QUADS}, z AS (SELECT year, zone_id, count(*) AS area FROM hot_cells GROUP BY year, zone_id),
p AS (SELECT year, zone_id, count(*) AS perimeter FROM (SELECT year, zone_id, r1, c1, r2, c2 FROM ({_SIDES}) GROUP BY ALL HAVING count(*) = 1) GROUP BY year, zone_id),
e AS (SELECT year, zone_id, count(*) FILTER (WHERE k = 1) AS q1, count(*) FILTER (WHERE k = 3) AS q3, count(*) FILTER (WHERE diagonal) AS qd FROM q GROUP BY year, zone_id)
SELECT z.year, z.zone_id, area, perimeter, q1 + q3 + 2 * qd AS n_corners, CAST((q1 - q3 + 2 * qd) / 4 AS BIGINT) AS outer_less_holes, 0::BIGINT AS n_stray
FROM z JOIN p ON p.year = z.year AND p.zone_id = z.zone_id JOIN e ON e.year = z.year AND e.zone_id = z.zone_id""", "hot_cells")
def _(spark, sf):
    """Rings of every zone: their signed areas add up to the zone's cells, corners and rings to what the cells round each corner say."""
    r = hot_rings(spark, sf)[1]
    owner = r.where("outer").select("year", "zone_id", c("ring").alias("of"), F.lit(True).alias("_there"))
    return r.join(owner, ["year", "zone_id", "of"], "left").groupBy("year", "zone_id").agg(
        F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.sum("n_corners").alias("n_corners"),
        (F.count_if("outer") - F.count_if(~c("outer"))).alias("outer_less_holes"), F.count_if(~c("outer") & c("_there").isNull()).alias("n_stray"))


@query("grf10_zone_geometry_check", """
SELECT h.year, count(DISTINCT zone_id) AS n_zones, count(*) AS zone_px, any_value(m.mask_px) AS mask_px, any_value(m.mask_px) - count(*) AS noise_px,
  max(zone_id) = count(DISTINCT zone_id) AS ids_dense FROM hot_cells h JOIN (SELECT year, count(*) AS mask_px FROM classed WHERE y_pred = 2 GROUP BY year) m ON m.year = h.year
GROUP BY h.year""", "hot_cells classed")
def _(spark, sf):
    m = V.classed(spark, sf).where("y_pred = 2").groupBy("year").agg(F.count(F.lit(1)).alias("mask_px"))
    z = hot_labels(spark, sf).groupBy("year").agg(
        F.count_distinct("zone_id").alias("n_zones"), F.count(F.lit(1)).alias("zone_px"), F.max("zone_id").alias("_m"))
    return z.join(m, "year").select("year", "n_zones", "zone_px", "mask_px", (c("mask_px") - c("zone_px")).alias("noise_px"),
                                    (c("_m") == c("n_zones")).alias("ids_dense"))


# --- ranks ----------------------------------------------------------------------------------------

@query("rnk1_rank_zones", """SELECT scenario, year, zone_id, CAST(row_number() OVER (PARTITION BY scenario, year ORDER BY pixels DESC, round(mean_score, 6) DESC, zone_id) AS INT) AS rank
FROM zone_table""", "zone_table")
def _(spark, sf):
    z = zone_table(spark, sf).withColumn("ms", F.round(c("mean_score") + 1.2345e-9, 6))
    return ranked(z, ["scenario", "year"], -c("pixels"), [-c("ms"), c("zone_id")]).select("scenario", "year", "zone_id", "rank")


@query("rnk2_rank_hotspots", """
SELECT year, zone_id, CAST(rank() OVER (PARTITION BY year ORDER BY hi DESC) AS INT) AS rank_high, CAST(rank() OVER (PARTITION BY year ORDER BY l DESC) AS INT) AS rank_lst,
  CAST(rank() OVER (PARTITION BY year ORDER BY n DESC) AS INT) AS rank_area FROM (SELECT year, zone_id, count(*) AS n, round(avg(lst_c), 6) AS l,
  count(*) FILTER (WHERE y_true = 2) AS hi FROM hot_full GROUP BY ALL)""", "hot_full")
def _(spark, sf):
    z = hot_full(spark, sf).groupBy("year", "zone_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("lst_c") + 1.2345e-9, 6).alias("l"), F.count_if(c("y_true") == 2).alias("hi"))
    for col, out in (("hi", "rank_high"), ("l", "rank_lst"), ("n", "rank_area")):
        z = ranked(z, ["year"], -c(col), out=out, method="rank")
    return z.drop("n", "l", "hi")


@query("rnk3_priority_thirds", """SELECT year, zone_id, rank, CASE WHEN rank <= ceil(n / 3.0) THEN 1 WHEN rank <= 2 * ceil(n / 3.0) THEN 2 ELSE 3 END AS third
FROM (SELECT *, count(*) OVER (PARTITION BY year) AS n FROM sites)""", "sites")
def _(spark, sf):
    z = site_table(spark, sf)
    n = z.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    return z.join(F.broadcast(n), "year").select("year", "zone_id", "rank", R.thirds(c("rank"), c("_n")).alias("third"))


@query("rnk4_shortlist", f"SELECT year, zone_id, rank, rank_excl, NOT oversized AND rank_excl <= {TOP} AS shortlist FROM sites", "sites")
def _(spark, sf):
    return site_table(spark, sf).select("year", "zone_id", "rank", "rank_excl", "shortlist")


@query("rnk5_top_n_explain", """
WITH q AS (SELECT scenario AS qs, year AS qy, quantile_cont(mean_need, [0.2, 0.4, 0.6, 0.8]) AS t FROM zone_table GROUP BY scenario, year)
SELECT scenario, year, zone_id, r AS rank, round(mean_need, 6) AS mean_need,
  1 + CAST(mean_need >= t[1] AS INT) + CAST(mean_need >= t[2] AS INT) + CAST(mean_need >= t[3] AS INT) + CAST(mean_need >= t[4] AS INT) AS need_quintile
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scenario, year ORDER BY pixels DESC, zone_id) AS INT) AS r FROM zone_table) JOIN q ON qs = scenario AND qy = year WHERE r <= 5""", "zone_table")
def _(spark, sf):
    from heatgrid.operators.classify import class_of
    z, by = zone_table(spark, sf), ["scenario", "year"]
    q = exact_quantiles(z, by, ["mean_need"], [0.2, 0.4, 0.6, 0.8]).select(*by, c("q").alias("t"))
    top = ranked(z, by, -c("pixels"), [c("zone_id")]).where("rank <= 5")
    return top.join(F.broadcast(q), by).select(
        *by, "zone_id", "rank", "mean_need", (class_of(c("mean_need"), c("t")) + 1).alias("need_quintile"))


_TREES = "CAST(floor(usable_ha * 1000 + 1e-6) AS BIGINT)"


def trees(d=1000):
    return F.floor(c("usable_ha") * d + 1e-6)


@query("rnk8_plan_under_budget", f"""
SELECT year, zone_id, rank, trees, CAST(sum(trees) OVER w AS BIGINT) AS cum_trees, sum(trees) OVER w <= 20000 AS planned
FROM (SELECT *, {_TREES} AS trees FROM sites WHERE NOT oversized) WINDOW w AS (PARTITION BY year ORDER BY rank)""", "sites")
def _(spark, sf):
    z = site_table(spark, sf).where("not oversized").withColumn("trees", trees())
    return R.plan_prefix(z, ["year"], "trees", F.lit(20000)).select("year", "zone_id", "rank", "trees", "cum_trees", "planned")


@query("rnk8_plan_skip_over")
def _(spark, sf):
    z = site_table(spark, sf, TOP).withColumn("trees", trees().cast("double"))
    return R.plan_skip(z, ["year"], "trees", 10000.0, TOP)


@query("rnk9_cumulative_area", """
SELECT year, zone_id, rank, round(cum_ha, 6) AS cum_ha, min(CASE WHEN cum_ha >= 5 THEN rank END) OVER (PARTITION BY year) AS enters_at FROM (
  SELECT *, sum(usable_ha) OVER (PARTITION BY year ORDER BY rank) AS cum_ha FROM sites WHERE NOT oversized)""", "sites")
def _(spark, sf):
    z = R.running_sum(site_table(spark, sf).where("not oversized"), ["year"], "rank", "usable_ha", "cum_ha")
    first = z.groupBy("year").agg(F.min(F.when(c("cum_ha") >= 5, c("rank"))).alias("enters_at"))
    return z.join(F.broadcast(first), "year").select("year", "zone_id", "rank", "cum_ha", "enters_at")


# --- trees ------------------------------------------------------------------------------------------

@query("sco15_plantable", """SELECT z.scenario, s.year, z.zone_id, count(*) AS px, count(*) FILTER (WHERE eligible AND vegetation_cover < 0.3) AS plantable_px,
  count(*) FILTER (WHERE eligible AND vegetation_cover < 0.3) * 90 AS trees FROM scored s JOIN zone_cells z ON z.year = s.year AND z.row = s.row AND z.col = s.col
GROUP BY ALL""", "scored zone_cells")
def _(spark, sf):
    n = F.count_if("plantable")
    return plantable(spark, sf).groupBy("scenario", "year", "zone_id").agg(
        F.count(F.lit(1)).alias("px"), n.alias("plantable_px"), (n * 90).alias("trees"))


_BYZONE = """
bz AS (SELECT z.scenario, s.year, z.zone_id, count(*) AS px, round(avg(vegetation_cover) * 100, 6) AS veg_percent, round(avg(CAST(y_true = 2 AS INT)) * 100, 6) AS high_percent,
  count(*) FILTER (WHERE eligible AND vegetation_cover < 0.3) AS plantable_px
  FROM scored s JOIN zone_cells z ON z.year = s.year AND z.row = s.row AND z.col = s.col GROUP BY ALL)"""


def by_zone(spark, sf):
    return plantable(spark, sf).groupBy("scenario", "year", "zone_id").agg(
        F.count(F.lit(1)).alias("px"), (F.avg("vegetation_cover") * 100).alias("veg_percent"),
        (F.avg((c("y_true") == 2).cast("int")) * 100).alias("high_percent"), F.count_if("plantable").alias("plantable_px"))


@query("sco16_tree_requirement_by_zone", f"""
WITH {_BYZONE}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY scenario, year ORDER BY plantable_px DESC, zone_id) AS INT) AS rank, count(*) OVER (PARTITION BY scenario, year) AS n FROM bz)
SELECT scenario, year, zone_id, px, veg_percent, high_percent, plantable_px, round(plantable_px * 0.09, 6) AS plantable_ha, plantable_px * 90 AS trees, rank,
  CASE WHEN rank <= ceil(n / 3.0) THEN 1 WHEN rank <= 2 * ceil(n / 3.0) THEN 2 ELSE 3 END AS third FROM r""", "scored zone_cells")
def _(spark, sf):
    by = ["scenario", "year"]
    z = ranked(by_zone(spark, sf), by, -c("plantable_px"), [c("zone_id")])
    n = z.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return z.join(F.broadcast(n), by).select(
        *by, "zone_id", "px", "veg_percent", "high_percent", "plantable_px", (c("plantable_px") * HA).alias("plantable_ha"),
        (c("plantable_px") * 90).alias("trees"), "rank", R.thirds(c("rank"), c("_n")).alias("third"))


@query("sco17_tree_requirement_summary", f"""
WITH {_BYZONE} SELECT scenario, year, density, count(*) AS n_zones, round(sum(plantable_px) * 0.09, 6) AS plantable_ha,
  CAST(round_even(sum(plantable_px) * 0.09 * density, 0) AS BIGINT) AS trees FROM bz, (VALUES (400), (1000), (2500)) t(density) GROUP BY scenario, year, density""", "scored zone_cells")
def _(spark, sf):
    y = by_zone(spark, sf).groupBy("scenario", "year").agg(F.count(F.lit(1)).alias("n_zones"), (F.sum("plantable_px") * HA).alias("plantable_ha"))
    y = y.withColumn("density", F.explode(F.array(*[F.lit(d) for d in (400, 1000, 2500)])))
    return y.select("scenario", "year", "density", "n_zones", "plantable_ha", F.bround(c("plantable_ha") * c("density"), 0).cast("long").alias("trees"))


@query("sco18_reference_trees", "SELECT year, zone_id, " + ", ".join(
    f"CAST(floor(usable_ha * {d} + 1e-6) AS BIGINT) AS trees_{d}" for d in (400, 1000, 2500)) + " FROM sites", "sites")
def _(spark, sf):
    return site_table(spark, sf).select("year", "zone_id", *[trees(d).alias(f"trees_{d}") for d in (400, 1000, 2500)])


@query("sco19_plan_totals", f"SELECT year, CAST(sum({_TREES}) AS BIGINT) AS trees, round(sum(usable_ha), 6) AS area_ha, count(*) AS n_sites FROM sites WHERE NOT oversized AND rank_excl <= {TOP} GROUP BY year", "sites")
def _(spark, sf):
    return site_table(spark, sf).where("shortlist").groupBy("year").agg(
        F.sum(trees()).alias("trees"), F.sum("usable_ha").alias("area_ha"), F.count(F.lit(1)).alias("n_sites"))


component_ctes("extent", "SELECT 0 AS year, row, col FROM cells WHERE lst_c IS NOT NULL GROUP BY row, col", "cells", "year", 1)


@query("agg21_data_extent", "SELECT year, row, col, zone_id, n_px FROM extent", "extent")
def _(spark, sf):
    d = V.cells(spark, sf).groupBy("row", "col").agg(F.bool_or(c("lst_c").isNotNull()).alias("v")).where("v")
    return G.label_components(d.withColumn("year", F.lit(0)), ["year"], 1)




@query("agg24_zone_landuse", f"""
SELECT year, zone_id, round(u, 6) AS untagged_share, CASE WHEN u > 0.5 THEN 'low' WHEN u > 0.2 THEN 'mixed' ELSE 'identified' END AS certainty, landuse_ha FROM (
  SELECT year, zone_id, coalesce(sum(CASE WHEN code = 0 THEN n END), 0) / sum(n) AS u, string_agg(code || '=' || n, ',' ORDER BY code) AS landuse_ha FROM (
    SELECT z.year, z.zone_id, coalesce(landuse_class, 255) AS code, count(*) AS n FROM site_cells z JOIN scored s ON s.year = z.year AND s.row = z.row AND s.col = z.col GROUP BY ALL)
  GROUP BY year, zone_id)""", "site_cells scored")
def _(spark, sf):
    k = ["year", "zone_id"]
    n = site_labels(spark, sf).join(scored(spark, sf), K).groupBy(*k, F.coalesce("landuse_class", F.lit(255)).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # Ten land-use codes at most per zone.
    m = n.groupBy(*k).agg(
        (F.coalesce(F.sum(F.when(c("code") == 0, c("n"))), F.lit(0)) / F.sum("n")).alias("untagged_share"),
        F.array_sort(F.collect_list(F.struct("code", "n"))).alias("m"))
    u = c("untagged_share")
    return m.select(*k, u, F.when(u > 0.5, "low").when(u > 0.2, "mixed").otherwise("identified").alias("certainty"),
                    F.array_join(F.transform("m", lambda x: F.concat(x["code"].cast("string"), F.lit("="), x["n"].cast("string"))), ",").alias("landuse_ha"))


@query("cel24_rationale", """SELECT year, zone_id, 'score=' || CAST(CAST(round_even(score, 0) AS BIGINT) AS VARCHAR) || ' of need ' || CAST(CAST(floor(need_c) AS BIGINT) AS VARCHAR)
  || ', vegetation deficit ' || CAST(CAST(floor(veg_c) AS BIGINT) AS VARCHAR) || ', opportunity ' || CAST(CAST(floor(opp_c) AS BIGINT) AS VARCHAR)
  || CASE WHEN oversized THEN '; oversized' WHEN rank_excl <= 20 THEN '; shortlist' ELSE '; candidate' END AS rationale FROM sites""", "sites")
def _(spark, sf):
    """The text's shortlist is the first 20, not the plan's `TOP`."""
    state = F.when(c("oversized"), "oversized").when(c("shortlist"), "shortlist").otherwise("candidate")
    return site_table(spark, sf, 20).select("year", "zone_id", F.format_string(
        "score=%d of need %d, vegetation deficit %d, opportunity %d; %s", F.bround("score", 0).cast("long"),
        F.floor("need_c"), F.floor("veg_c"), F.floor("opp_c"), state).alias("rationale"))


@query("joi19_zone_lookup", """SELECT c.year, c.row, c.col, s.rank, round(s.score, 6) AS score FROM site_cells c JOIN sites s ON s.year = c.year AND s.zone_id = c.zone_id""", "site_cells sites")
def _(spark, sf):
    z = site_table(spark, sf).select("year", "zone_id", "rank", "score")
    return site_labels(spark, sf).join(z, ["year", "zone_id"]).select(*K, "rank", "score")
