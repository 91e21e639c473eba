"""Views of the planning chain: scores, scenarios, hotspots, zones and sites, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.functions import scores as S
from heatgrid.operators import components as G
from heatgrid.operators.classify import class_of_edges
from heatgrid.operators.quantiles import quantile_columns
from heatgrid.plans import views as V
from heatgrid.plans.ctes import cte

c = F.col
K = ["year", "row", "col"]
VARS = {"severity_score": "sev", "ndvi": "ndvi", "ndbi": "ndbi", "lst_c": "lst", "vegetation_cover": "veg"}

_LU = " ".join(f"WHEN {k} THEN {v}" for k, v in S.LANDUSE_SCORE.items())


def _norm(v, lo, hi, top=100):
    return f"least(greatest((least(greatest({v}, {lo}), {hi}) - {lo}) / ({hi} - {lo}) * {top}, 0), {top})"


cte("norm100", "classed", f"""
SELECT c.*, {', '.join(f'round({_norm(v, f"{a}_lo", f"{a}_hi")}, 9) AS n_{a}' for v, a in VARS.items())},
  CASE WHEN dist_road_m < 50 THEN dist_road_m * 40.0 / 50.0 WHEN dist_road_m <= 500 THEN 100.0
    WHEN dist_road_m < 2000 THEN 100.0 - 70.0 * (dist_road_m - 500) / 1500.0 ELSE 30.0 END AS road_score,
  greatest(0, 1 - dist_vegetation_m / 500.0) * 100.0 AS green_score,
  CASE landuse_class {_LU} ELSE 50 END AS landuse_score
FROM classed c JOIN (SELECT year AS qy, {', '.join(
    f'quantile_cont({v}, 0.01) AS {a}_lo, quantile_cont({v}, 0.99) AS {a}_hi' for v, a in VARS.items())}
  FROM classed GROUP BY year) q ON q.qy = c.year
""")
cte("pooled", "domain", """
SELECT quantile_cont(lst_c, 0.01) AS l1, quantile_cont(lst_c, 0.99) AS l99, quantile_cont(ndvi, 0.01) AS v1,
  quantile_cont(ndvi, 0.99) AS v99, quantile_cont(ndbi, 0.01) AS b1, quantile_cont(ndbi, 0.99) AS b99,
  quantile_cont(vegetation_cover, 0.01) AS g1, quantile_cont(vegetation_cover, 0.99) AS g99 FROM domain
""")
cte("prescored", "norm100 pooled", f"""
SELECT n.*,
  round(0.40 * n_sev + 0.25 * (100 - n_ndvi) + 0.20 * n_ndbi + 0.15 * n_lst, 6) AS need,
  round(0.40 * n_sev + 0.25 * (100 - n_veg) + 0.20 * n_ndbi + 0.15 * n_lst, 6) AS need_d,
  round(0.30 * landuse_score + 0.25 * (100 - n_ndbi) + 0.15 * road_score + 0.15 * green_score + 0.15 * (100 - n_ndvi), 6) AS opportunity,
  round(0.30 * landuse_score + 0.15 * (100 - n_ndbi) + 0.15 * road_score + 0.15 * green_score + 0.25 * (100 - n_veg), 6) AS opportunity_d,
  round(0.55 * {_norm('lst_c', 'l1', 'l99', 1)} + 0.25 * {_norm('(1 - ndvi)', 'v1', 'v99', 1)} + 0.20 * {_norm('ndbi', 'b1', 'b99', 1)}, 6) AS need01,
  round(0.30 * landuse_score / 100 + 0.25 * (1 - {_norm('ndbi', 'b1', 'b99', 1)}) + 0.15 * road_score / 100
    + 0.15 * green_score / 100 + 0.15 * (1 - {_norm('ndvi', 'v1', 'v99', 1)}), 6) AS opp01,
  round({_norm('lst_c', 'l1', 'l99')}, 6) AS p_lst,
  round({_norm('(1 - vegetation_cover)', '(1 - g99)', '(1 - g1)')}, 6) AS p_veg_deficit,
  (row * 31 + col * 17) % 13 = 0 AS water, dist_building_m = 0 AS buildings, dist_road_m = 0 AS road_surfaces,
  coalesce(landuse_class NOT IN (5, 7), true) AS eligible
FROM norm100 n, pooled
""")
cte("scored", "prescored", """
SELECT *, CAST(suitability > 20 AS INT) + CAST(suitability > 40 AS INT) + CAST(suitability > 60 AS INT)
    + CAST(suitability > 80 AS INT) AS suitability_class,
  CASE WHEN feasible THEN round(0.5 * need01 + 0.5 * suit01, 7) END AS priority FROM (
  SELECT *, round(need * opportunity / 100 + 1.2345e-9, 6) AS suitability, round(need01 * opp01 + 1.2345e-9, 6) AS suit01,
    eligible AND NOT (water OR buildings OR road_surfaces) AS feasible FROM prescored)
""")
cte("cuts", "scored", """
SELECT quantile_cont(priority, 1.0/3) AS t1, quantile_cont(priority, 2.0/3) AS t2, quantile_cont(priority, 0.9) AS p90,
  quantile_cont(CASE WHEN feasible THEN need01 END, 0.75) AS nd75 FROM scored
""")
cte("scenario_cells", "scored", """
SELECT year, row, col, block_id, scenario, score, confidence, CAST(score > 20 AS INT) + CAST(score > 40 AS INT) + CAST(score > 60 AS INT)
  + CAST(score > 80 AS INT) AS cls FROM (
  SELECT year, row, col, block_id, confidence, 'A' AS scenario, round(need * opportunity / 100 + 1.2345e-9, 6) AS score FROM scored
  UNION ALL SELECT year, row, col, block_id, confidence, 'B', round(pow(100, 1 - 0.6 - 0.3) * pow(need, 0.6) * pow(opportunity, 0.3) + 1.2345e-9, 6) FROM scored
  UNION ALL SELECT year, row, col, block_id, confidence, 'C', round(pow(100, 1 - 0.3 - 0.5) * pow(need, 0.3) * pow(opportunity, 0.5) + 1.2345e-9, 6) FROM scored
  UNION ALL SELECT year, row, col, block_id, confidence, 'D', round(need_d * opportunity_d / 100 + 1.2345e-9, 6) FROM scored)
""")


def component_ctes(name: str, mask: str, deps: str, keys: str = "year", min_px: int = 10) -> None:
    """Connected components in SQL: least cell number over 8-neighbours, to a fixed point."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    cte(f"{name}_n", deps, f"SELECT *, row_number() OVER (ORDER BY {keys}, row, col) AS id FROM ({mask})")
    cte(f"{name}_e", f"{name}_n", f"""SELECT a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON {on}
  AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.id <> b.id""")
    cte(f"{name}_cc(id, lab) USING KEY (id)", f"{name}_e", f"""SELECT id, id FROM {name}_n UNION
  SELECT e.a, min(x.lab) FROM {name}_cc x JOIN {name}_e e ON x.id = e.b JOIN recurring.{name}_cc r ON r.id = e.a
  WHERE x.lab < r.lab GROUP BY e.a""")
    cte(name, f"{name}_cc(id,lab)".replace("(id,lab)", "(id, lab) USING KEY (id)"), f"""
SELECT {keys}, row, col, CAST(dense_rank() OVER (PARTITION BY {keys} ORDER BY lab) AS INT) AS zone_id, n_px FROM (
  SELECT n.*, lab, CAST(count(*) OVER (PARTITION BY lab) AS INT) AS n_px FROM {name}_n n JOIN {name}_cc c ON c.id = n.id)
WHERE n_px >= {min_px}""")


component_ctes("hot_cells", "SELECT year, row, col FROM classed WHERE y_pred = 2", "classed")
component_ctes("hot3_cells", """SELECT def, year, row, col FROM (
  SELECT 'A' AS def, * FROM classed WHERE y_pred = 2 UNION ALL SELECT 'B', * FROM classed WHERE y_pred = 2 AND confidence >= 0.6
  UNION ALL SELECT 'C', * FROM classed WHERE severity_score >= 1.5 AND confidence >= 0.6)""", "classed", "def, year")
component_ctes("zone_cells", "SELECT scenario, year, row, col FROM scenario_cells WHERE cls >= 2", "scenario_cells", "scenario, year")
component_ctes("site_cells", """SELECT year, row, col FROM scored, cuts WHERE feasible AND priority >= p90 - 0.1 AND need01 >= nd75 - 0.1
  AND vegetation_cover < 0.60""", "scored cuts", "year", 4)


def bounds(d: DataFrame, by, names: dict[str, str]) -> DataFrame:
    return quantile_columns(d, by, {v: [f"{a}_lo", f"{a}_hi"] for v, a in names.items()}, [0.01, 0.99])


def build_scored(spark, sf) -> DataFrame:
    d = V.classed(spark, sf)
    d = d.join(F.broadcast(bounds(d, ["year"], VARS)), "year")
    d = d.withColumns({f"n_{a}": F.round(S.scaled(c(v), c(f"{a}_lo"), c(f"{a}_hi")), 9) for v, a in VARS.items()})
    # Pooled references: one row over all cells of all years.
    pool = V.domain(spark, sf)
    names = {"lst_c": "pl", "ndvi": "pv", "ndbi": "pb", "vegetation_cover": "pg"}
    d = d.join(F.broadcast(bounds(pool.withColumn("_all", F.lit(1)), ["_all"], names).drop("_all")))
    d = d.withColumns({
        "road_score": S.road_accessibility(c("dist_road_m")), "green_score": S.green_proximity(c("dist_vegetation_m")),
        "landuse_score": S.landuse_eligibility(c("landuse_class"))})
    p_ndbi, p_ndvi = S.scaled(c("ndbi"), c("pb_lo"), c("pb_hi"), 1.0), S.scaled(c("ndvi"), c("pv_lo"), c("pv_hi"), 1.0)
    # The bounds of NDVI serve 1-NDVI unchanged: a quirk of the rule that results depend on.
    p_inv = S.scaled(1 - c("ndvi"), c("pv_lo"), c("pv_hi"), 1.0)
    p_lst = S.scaled(c("lst_c"), c("pl_lo"), c("pl_hi"), 1.0)
    need = {"severity_score": c("n_sev"), "one_minus_ndvi": 100 - c("n_ndvi"), "ndbi": c("n_ndbi"), "lst": c("n_lst"),
            "one_minus_vegetation_cover": 100 - c("n_veg")}
    opp = {"landuse": c("landuse_score"), "built_inverse": 100 - c("n_ndbi"), "road": c("road_score"),
           "green": c("green_score"), "headroom": 100 - c("n_ndvi")}
    opp01 = {"landuse": c("landuse_score") / 100, "built_inverse": 1 - p_ndbi, "road": c("road_score") / 100,
             "green": c("green_score") / 100, "headroom": 1 - p_ndvi}
    d = d.withColumns({
        "need": F.round(S.weighted(S.NEED, need, 100.0), 6), "need_d": F.round(S.weighted(S.NEED_D, need, 100.0), 6),
        "opportunity": F.round(S.weighted(S.OPPORTUNITY, opp, 100.0), 6),
        "opportunity_d": F.round(S.weighted(S.OPPORTUNITY_D, {**opp, "headroom": 100 - c("n_veg")}, 100.0), 6),
        "need01": F.round(S.weighted(S.COOLING, {"lst": p_lst, "one_minus_ndvi": p_inv, "ndbi": p_ndbi}, 1.0), 6),
        "opp01": F.round(S.weighted(S.OPPORTUNITY, opp01, 1.0), 6),
        "p_lst": F.round(S.scaled(c("lst_c"), c("pl_lo"), c("pl_hi")), 6),
        "p_veg_deficit": F.round(S.scaled(1 - c("vegetation_cover"), 1 - c("pg_hi"), 1 - c("pg_lo")), 6),
        "water": (c("row") * 31 + c("col") * 17) % 13 == 0, "buildings": c("dist_building_m") == 0,
        "road_surfaces": c("dist_road_m") == 0, "eligible": C.eligible_landuse(c("landuse_class"))})
    d = d.withColumns({
        "suitability": F.round(S.gated_product(c("need"), c("opportunity")) + 1.2345e-9, 6),
        "suit01": F.round(S.gated_product(c("need01"), c("opp01"), 1.0) + 1.2345e-9, 6),
        "feasible": c("eligible") & ~(c("water") | c("buildings") | c("road_surfaces"))})
    d = d.withColumns({
        "suitability_class": class_of_edges(c("suitability"), S.CLASS_EDGES, "left"),
        "priority": F.when(c("feasible"), F.round(c("need01") * 0.5 + c("suit01") * 0.5, 7))})
    return d.drop(*[x for x in d.columns if x.endswith("_lo") or x.endswith("_hi")])


def scored(spark, sf) -> DataFrame:
    return V.product(spark, sf, "scored", lambda: build_scored(spark, sf))


def cuts(spark, sf) -> DataFrame:
    """One row: pooled terciles and the selection constants over feasible land."""
    d = scored(spark, sf).where("feasible").select(F.lit(1).alias("_all"), "priority", "need01")
    q = quantile_columns(d, ["_all"], {"priority": ["t1", "t2", "p90", "_p"], "need01": ["_a", "_b", "_c", "nd75"]},
                         [1 / 3, 2 / 3, 0.9, 0.75])
    return q.select("t1", "t2", "p90", "nd75")


def scenario_array(classes: bool = True):
    """The four scenarios of a scored cell, as an array of (scenario, score, cls), or without the classes."""
    out = []
    for n, (a, b) in S.SCENARIOS.items():
        need, opp = (c("need_d"), c("opportunity_d")) if n == "D" else (c("need"), c("opportunity"))
        v = S.gated_product(need, opp) if a == b == 1.0 else S.weighted_geometric(need, opp, a, b)
        v = F.round(v + 1.2345e-9, 6)
        cls = [class_of_edges(v, S.CLASS_EDGES, "left").alias("cls")] if classes else []
        out.append(F.struct(F.lit(n).alias("scenario"), v.alias("score"), *cls))
    return F.array(*out)


def scenario_cells(spark, sf) -> DataFrame:
    """(cell, scenario, score, cls) in long form; the four scenarios are one array per cell, classed when it is unrolled."""
    return (
        scored(spark, sf).select(*K, "block_id", "confidence", F.explode(scenario_array(False)).alias("s"))
        .select(*K, "block_id", "confidence", "s.scenario", "s.score", class_of_edges(c("s.score"), S.CLASS_EDGES, "left").alias("cls")))


def hot_defs_long(spark, sf) -> DataFrame:
    """One row per hotspot definition a cell meets."""
    conf = c("confidence") >= 0.6
    defs = F.filter(F.array(
        F.when(c("y_pred") == 2, F.lit("A")), F.when((c("y_pred") == 2) & conf, F.lit("B")),
        F.when((c("severity_score") >= 1.5) & conf, F.lit("C"))), lambda x: x.isNotNull())
    return V.classed(spark, sf).select(*K, F.explode(defs).alias("def"))


def hot_labels(spark, sf) -> DataFrame:
    return V.product(spark, sf, "hot_cells", lambda: G.label_components(
        V.classed(spark, sf).where("y_pred = 2"), ["year"], 10))


def hot3_labels(spark, sf) -> DataFrame:
    return V.product(spark, sf, "hot3_cells", lambda: G.label_components(hot_defs_long(spark, sf), ["def", "year"], 10))


def zone_labels(spark, sf, level: int = 2) -> DataFrame:
    return V.product(spark, sf, "zone_cells", lambda: G.label_components(
        scenario_cells(spark, sf).where(c("cls") >= level), ["scenario", "year"], 10))


def site_mask(spark, sf) -> DataFrame:
    """Feasible, high priority and need, open ground. The gates are widened for the fixture's coarse grid."""
    gate = (c("priority") >= c("p90") - 0.1) & (c("need01") >= c("nd75") - 0.1) & (c("vegetation_cover") < 0.60)
    return scored(spark, sf).join(F.broadcast(cuts(spark, sf))).where(c("feasible") & gate)


def site_labels(spark, sf) -> DataFrame:
    return V.product(spark, sf, "site_cells", lambda: G.label_components(site_mask(spark, sf), ["year"], 4))
