"""Recomputing gates. Each runs on the stored tables and on the same tables with faults put in by a rule, so it can fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.functions import scores as S
from heatgrid.operators import checks as Q
from heatgrid.operators import classify as L
from heatgrid.operators import components as G
from heatgrid.operators import gates as GT
from heatgrid.operators import validate as VL
from heatgrid.plans import views as V
from heatgrid.plans.ctes import cte
from heatgrid.plans.join_queries import transitions
from heatgrid.plans.model_queries import _metrics_sql, pinned_folds
from heatgrid.plans.registry import query
from heatgrid.plans.scoring_views import cuts, scored, site_labels, site_mask
from heatgrid.plans.zone_queries import TOP, site_table
from heatgrid.sources.tables import table

c = F.col
K = ["year", "row", "col"]
#: Fixed values of the reference: least valid shares of the thermal and optical products and of the labels.
COVERAGE = {"thermal": 0.90, "optical": 0.85, "labels": 0.80}
FAULT = "(row * 31 + col * 17 + {year}) % 97 = {at}"


def fault(at: int, year: str = "year") -> Column:
    return F.expr(FAULT.format(year=year, at=at))


def both(gate: Callable[[bool], DataFrame]) -> DataFrame:
    """The gate on stored tables and on tampered ones."""
    stored, tampered = (gate(x).withColumn("input", F.lit(n)) for x, n in ((False, "stored"), (True, "tampered")))
    return stored.unionByName(tampered)


def _diff(name: str, saved: str, again: str, keys: str, values: dict[str, str]) -> dict[str, str]:
    """Check id -> SQL that counts its bad keys; `values` says when a column pair (a, b) differs."""
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    out = {"missing": f"SELECT {keys} FROM {again} EXCEPT SELECT {keys} FROM {saved}", "extra": f"SELECT {keys} FROM {saved} EXCEPT SELECT {keys} FROM {again}",
           "repeated": f"SELECT {keys} FROM {saved} GROUP BY {keys} HAVING count(*) > 1"}
    akeys = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    out |= {v: f"SELECT DISTINCT {akeys} FROM {saved} a JOIN {again} b ON {on} WHERE {rule}" for v, rule in values.items()}
    return {f"{name}_{k}": f"SELECT count(*) FROM ({q})" for k, q in out.items()}


def _exact(*names: str) -> dict[str, str]:
    return {v: f"a.{v} IS DISTINCT FROM b.{v}" for v in names}


def _sql(ctes: dict[str, tuple[str, str]], shared: dict[str, str], rules: Callable[[str], dict[str, str]]) -> str:
    """Gate rows for both inputs: of each saved table the stored and the tampered text, shared tables, and counting queries."""
    parts = [f"{k} AS ({v})" for k, v in shared.items()]
    parts += [f"{k}{x} AS ({v})" for k, pair in ctes.items() for x, v in zip("_s _t".split(), pair)]
    rows = [f"SELECT '{n}' AS input, '{k}' AS check_id, n_bad, n_bad = 0 AS ok FROM (SELECT ({q}) AS n_bad)"
            for x, n in (("_s", "stored"), ("_t", "tampered")) for k, q in rules(x).items()]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(rows)}"


def _count(src: str, bad: str) -> str:
    return f"SELECT count(*) FROM {src} WHERE {bad}"


# --- grids and inputs ------------------------------------------------------------------------------------

@query("dq1_raster_audit", """
SELECT scene, res, origin, n_cells, n_expected, CASE WHEN abs(res / 30.0 - 1) > 0.5 THEN 'MISMATCH' WHEN abs(res / 30.0 - 1) > 1e-9 THEN 'RESAMPLING'
  WHEN abs(origin / res - floor(origin / res + 0.5)) > 1e-6 THEN 'HALF_PIXEL_SHIFT' WHEN n_cells <> n_expected THEN 'SAME_GRID' ELSE 'EXACT' END AS alignment
FROM (SELECT s_suppkey AS scene, CAST(CASE s_suppkey % 7 WHEN 1 THEN 60 WHEN 2 THEN 30.5 ELSE 30 END AS DOUBLE) AS res,
  CAST(60 + CASE s_suppkey % 7 WHEN 3 THEN 15 ELSE 0 END AS DOUBLE) AS origin, CAST(s_nationkey + 100 AS BIGINT) AS n_cells,
  CAST(s_nationkey + 100 + CASE s_suppkey % 7 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS n_expected FROM supplier)""")
def _(spark, sf):
    """One raster per supplier; every outcome of the audit occurs."""
    kind, n = c("s_suppkey") % 7, (c("s_nationkey") + 100).cast("long")
    meta = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("scene"), F.when(kind == 1, 60.0).when(kind == 2, 30.5).otherwise(30.0).alias("res"),
        F.when(kind == 3, 75.0).otherwise(60.0).alias("origin"), n.alias("n_cells"), (n + (kind == 4).cast("int")).alias("n_expected"))
    return Q.grid_audit(meta, 30.0)


_BANDS = {"lst_c": "thermal", "ndvi": "optical", "ndbi": "optical", "ndre": "optical", "ndmi": "optical", "mndwi": "optical", "bsi": "optical", "lulc_class": "labels"}
_HOLES = {"ndbi": "year = 2023", "ndmi": "year = 2025 AND (row + col) % 4 = 0", "lulc_class": "year = 2022 AND (row + col) % 4 = 0"}


@query("dq2_band_preflight", f"""
WITH b AS (SELECT year, row, col, lst_c, ndvi, CASE WHEN NOT ({_HOLES['ndbi']}) THEN ndbi END AS ndbi, CASE WHEN year = 2024 AND row % 50 = 0 THEN 'inf'::DOUBLE ELSE ndre END AS ndre,
  CASE WHEN NOT ({_HOLES['ndmi']}) THEN ndmi END AS ndmi, mndwi, bsi, CASE WHEN NOT ({_HOLES['lulc_class']}) THEN CAST(lulc_class AS DOUBLE) END AS lulc_class FROM cells),
l AS ({' UNION ALL '.join(f"SELECT year, '{b}' AS band, {b} AS v FROM b" for b in _BANDS)}),
e AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {COVERAGE[k]}::DOUBLE)" for b, k in _BANDS.items())}) t(band, gate), generate_series(2022, 2027) g(year)),
s AS (SELECT e.year, e.band, gate, count(l.band) AS n, count(*) FILTER (WHERE isfinite(v)) AS n_valid, count(*) FILTER (WHERE isinf(v)) AS n_inf
  FROM e LEFT JOIN l ON l.year = e.year AND l.band = e.band GROUP BY ALL)
SELECT year, band, n, n_valid, n_inf, round(coalesce(n_valid / nullif(n, 0), 0), 6) AS coverage, CASE WHEN n_valid = 0 AND n_inf = 0 THEN 'MISSING' WHEN n_inf > 0 THEN 'INFINITE'
  WHEN coalesce(n_valid / nullif(n, 0), 0) < gate THEN 'LOW' ELSE 'OK' END AS status FROM s""", "cells")
def _(spark, sf):
    """All bands of all years and of one that is not there; a band left out, one with infinities and two with holes among them."""
    d = V.cells(spark, sf).withColumns({b: F.when(~F.expr(hole), c(b)) for b, hole in _HOLES.items()})
    d = d.withColumn("ndre", F.when(F.expr("year = 2024 AND row % 50 = 0"), float("inf")).otherwise(c("ndre")))
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(COVERAGE[k]).alias("gate")) for b, k in _BANDS.items()])
    expected = spark.range(2022, 2028).select(c("id").cast("long").alias("year"), F.explode(pairs).alias("e")).select("year", "e.*")
    return GT.band_preflight(d.withColumn("year", c("year").cast("long")), list(_BANDS), expected)


_PREDICTORS = [*V.INDEX_COLS, "vegetation_cover", "dist_road_m", "dist_vegetation_m", "dist_building_m"]
_F3 = {i: FAULT.format(year="year", at=i) for i in range(5)}


def _features_sql() -> str:
    shared = {"ev": "SELECT DISTINCT year, row, col FROM scene_obs WHERE scl NOT IN (3, 8, 9, 10) AND b2 > 0"}
    wrong = f"""SELECT * REPLACE (CASE WHEN {_F3[0]} THEN NULL ELSE ndvi END AS ndvi, CASE WHEN {_F3[1]} THEN 'inf'::DOUBLE ELSE bsi END AS bsi,
      CAST(block_id + CAST({_F3[2]} AS INT) AS INT) AS block_id, dist_road_m + CASE WHEN {_F3[3]} THEN 500 ELSE 0 END AS dist_road_m) FROM domain
      UNION ALL SELECT * REPLACE (row + 100000 AS row) FROM domain WHERE {_F3[4]}"""

    def rules(x):
        null = " OR ".join(f"{p} IS NULL" for p in _PREDICTORS)
        out = {"null": _count(f"fe{x}", null), "infinite": _count(f"fe{x}", " OR ".join(f"isinf({p})" for p in _PREDICTORS)),
               "block_id": _count(f"fe{x}, grid", "block_id IS DISTINCT FROM CAST(row * 5 // side AS INT) * 5 + CAST(col * 5 // side AS INT)"),
               "no_guarded_observation": _count(f"fe{x} f", "NOT EXISTS (FROM ev WHERE ev.year = f.year AND ev.row = f.row AND ev.col = f.col)")}
        for v in ("dist_road_m", "dist_vegetation_m"):
            out[f"gradient_{v}"] = _count(f"(SELECT {v} - lag({v}) OVER w AS d, col - lag(col) OVER w AS s FROM fe{x} WINDOW w AS (PARTITION BY year, row ORDER BY col))", "s = 1 AND abs(d) > 30.001")
        return out

    return _sql({"fe": ("FROM domain", wrong)}, shared, rules)


@query("dq3_feature_recompute", _features_sql(), "domain scene_obs grid")
def _(spark, sf):
    """Distances to features cannot change by more than a pixel from one cell to the next; rows far off the grid have no observation."""
    n = V.side(spark, sf)
    d = V.domain(spark, sf)
    evidence = V.scene_obs(spark, sf).where(C.scl_clear(c("scl")) & (c("b2") > 0)).select(*K)
    wrong = d.withColumns({
        "ndvi": F.when(~fault(0), c("ndvi")), "bsi": F.when(fault(1), float("inf")).otherwise(c("bsi")),
        "block_id": c("block_id") + fault(2).cast("int"), "dist_road_m": c("dist_road_m") + F.when(fault(3), 500).otherwise(0)})
    wrong = wrong.unionByName(d.where(fault(4)).withColumn("row", c("row") + 100_000))
    block = F.expr(f"cast(row * 5 div {n} as int) * 5 + cast(col * 5 div {n} as int)")
    smooth = {"dist_road_m": 30.001, "dist_vegetation_m": 30.001}
    return both(lambda bad: GT.feature_gates(wrong if bad else d, _PREDICTORS, block, evidence, smooth))


# --- suitability, trees ------------------------------------------------------------------------------------

_PC = "CASE WHEN feasible THEN CAST(CAST(CAST(priority AS FLOAT) AS DOUBLE) >= t1 AS INT) + CAST(CAST(CAST(priority AS FLOAT) AS DOUBLE) >= t2 AS INT) END"
_F5 = {i: FAULT.format(year="year", at=i) for i in range(4)}


def _suitability_sql() -> str:
    shared = {"pc": f"SELECT year, row, col, feasible, priority, {_PC} AS priority_class FROM scored, cuts"}
    wrong = f"""SELECT * REPLACE (CASE WHEN {_F5[0]} AND feasible THEN (priority_class + 1) % 3 WHEN {_F5[1]} AND NOT feasible THEN 0 ELSE priority_class END AS priority_class)
      FROM pc WHERE NOT {_F5[2]} UNION ALL SELECT * FROM pc WHERE {_F5[3]}"""
    count = "SELECT year, priority_class, count(*) AS n FROM pc WHERE priority_class IS NOT NULL GROUP BY ALL"
    saved = {"sa": ("FROM pc", wrong), "re": ("SELECT t1, t2 FROM cuts", "SELECT t1, t2 + 0.01 AS t2 FROM cuts"),
             "sh": (count, f"SELECT year, priority_class, n + CAST(year = 2024 AS INT) AS n FROM ({count}) WHERE NOT (year = 2025 AND priority_class = 1)")}

    def rules(x):
        again = f"(SELECT year, row, col, {_PC} AS priority_class FROM scored, re{x})"
        recount = f"(SELECT year, priority_class, count(*) AS n FROM sa{x} WHERE priority_class IS NOT NULL GROUP BY ALL)"
        return (_diff("class", f"sa{x}", again, "year, row, col", _exact("priority_class")) | {
            "class_off_feasible": _count(f"sa{x}", "(priority_class IS NOT NULL) <> feasible"),
            "thresholds": _count(f"re{x} r, cuts k", "abs(r.t1 - k.t1) > 1e-6 OR abs(r.t2 - k.t2) > 1e-6 OR r.t1 >= r.t2")}
            | _diff("share", f"sh{x}", recount, "year, priority_class", _exact("n")))

    return _sql(saved, shared, rules)


@query("dq5_suitability_recompute", _suitability_sql(), "scored cuts")
def _(spark, sf):
    """Priority classes, their thresholds and the share table."""
    d = scored(spark, sf).select(*K, "feasible", "priority")
    again = cuts(spark, sf).select("t1", "t2")

    def build():
        k = d.join(F.broadcast(again))
        return k.select(*K, "feasible", F.when(c("feasible"), S.priority_class(c("priority"), c("t1"), c("t2"))).alias("priority_class"))

    saved = V.product(spark, sf, "priority_classes", build)
    record = V.product(spark, sf, "priority_thresholds", lambda: again)
    shares = V.product(spark, sf, "priority_shares", lambda: saved.where("priority_class is not null").groupBy("year", "priority_class").agg(F.count(F.lit(1)).alias("n")))
    pc = c("priority_class")
    wrong = saved.where(~fault(2)).withColumn("priority_class", F.when(fault(0) & c("feasible"), (pc + 1) % 3).when(fault(1) & ~c("feasible"), 0).otherwise(pc))
    wrong = wrong.unionByName(saved.where(fault(3)))
    bad_shares = shares.where("not (year = 2025 and priority_class = 1)").withColumn("n", c("n") + (c("year") == 2024).cast("int"))

    def gate(bad):
        s = (wrong if bad else saved).drop("feasible")
        return GT.suitability_gates(s, d, record.withColumn("t2", c("t2") + 0.01) if bad else record, again, bad_shares if bad else shares)

    return both(gate)


_DENSITIES = (400, 1000, 2500)


def _trees_sql() -> str:
    trees = ", ".join(f"(px * {9 * d}) // 100 AS trees_{d}" for d in _DENSITIES)
    shared = {
        "cells0": "SELECT year, row, col, zone_id FROM site_cells",
        "again0": "SELECT n.year, n.row, n.col FROM site_cells_n n JOIN site_cells_cc k ON k.id = n.id JOIN (SELECT lab FROM site_cells_cc GROUP BY lab HAVING count(*) >= 4) g ON g.lab = k.lab",
        "table0": f"""SELECT year, zone_id, usable_ha, score, rank, NOT oversized AND rank_excl <= {TOP} AS shortlist,
          CASE WHEN untagged_share > 0.5 THEN 'low' WHEN untagged_share > 0.2 THEN 'mixed' ELSE 'identified' END AS certainty, {trees} FROM sites"""}
    wrong = """SELECT * REPLACE (round(usable_ha + CASE WHEN zone_id % 7 = 0 THEN 0.01 ELSE 0 END, 3) AS usable_ha, score + CASE WHEN zone_id % 7 = 1 THEN 0.5 ELSE 0 END AS score,
      CASE WHEN zone_id % 7 = 2 THEN NOT shortlist ELSE shortlist END AS shortlist, trees_1000 + CAST(zone_id % 7 = 3 AS INT) AS trees_1000,
      CASE WHEN zone_id % 7 = 4 THEN 'low' ELSE certainty END AS certainty), 0 AS y_true FROM table0 WHERE zone_id % 7 <> 5"""
    cells = f"SELECT * FROM cells0 WHERE NOT {FAULT.format(year='year', at=0)} UNION ALL SELECT year, row + 100000, col, zone_id FROM cells0 WHERE {FAULT.format(year='year', at=1)}"

    def rules(x):
        values = _exact("usable_ha", "rank", "shortlist", "certainty", *[f"trees_{d}" for d in _DENSITIES]) | {"score": "abs(a.score - b.score) > 1e-5"}
        names = ["year", "zone_id", "usable_ha", "score", "rank", "shortlist", "certainty", *[f"trees_{d}" for d in _DENSITIES]]
        columns = ", ".join(f"'{n}'" for n in names)
        return (_diff("cell", f"ce{x}", "again0", "year, row, col", {}) | _diff("site", f"si{x}", "table0", "year, zone_id", values)
                | {"sites_schema": f"SELECT {len(names)} - count(*) FROM (DESCRIBE si{x}) WHERE column_name IN ({columns})",
                   "sites_banned": f"SELECT count(*) FROM (DESCRIBE si{x}) WHERE column_name = 'y_true'"})

    return _sql({"ce": ("FROM cells0", cells), "si": ("FROM table0", wrong)}, shared, rules)


@query("dq6_tree_recompute", _trees_sql(), "sites site_cells site_cells_n")
def _(spark, sf):
    """The site set by its gates and least size again, and every column of the site table."""
    again = G.label_components(site_mask(spark, sf), ["year"], 4)
    table_again = site_table(spark, sf)

    def build():
        z = table_again
        return z.select("year", "zone_id", "usable_ha", "score", "rank", "shortlist", GT.certainty(c("untagged_share")).alias("certainty"),
                        *[GT.exact_trees(c("px"), d).alias(f"trees_{d}") for d in _DENSITIES])

    saved_cells, saved = site_labels(spark, sf), V.product(spark, sf, "site_plan", build)
    bad_cells = saved_cells.where(~fault(0)).unionByName(saved_cells.where(fault(1)).withColumn("row", c("row") + 100_000))
    kind = c("zone_id") % 7
    wrong = saved.where(kind != 5).withColumns({
        "usable_ha": F.round(c("usable_ha") + F.when(kind == 0, 0.01).otherwise(0.0), 3), "score": c("score") + F.when(kind == 1, 0.5).otherwise(0.0),
        "shortlist": F.when(kind == 2, ~c("shortlist")).otherwise(c("shortlist")), "trees_1000": c("trees_1000") + (kind == 3).cast("int"),
        "certainty": F.when(kind == 4, "low").otherwise(c("certainty")), "y_true": F.lit(0)})
    return both(lambda bad: GT.tree_gates(bad_cells if bad else saved_cells, again, wrong if bad else saved, table_again, _DENSITIES, ["y_true"]))


# --- cooling, models ------------------------------------------------------------------------------------------

_LOCKED = "block_id IN (2, 9, 15, 23)"
cte("cooling_cv", "transitions", f"""
SELECT t.*, CAST(t.block_id % 5 AS INT) AS fold, round((y.s - f.s) / (y.n - f.n), 6) AS y_hat FROM transitions t
JOIN (SELECT start_year, sum(delta_lst) AS s, count(*) AS n FROM transitions WHERE NOT {_LOCKED} GROUP BY ALL) y ON y.start_year = t.start_year
JOIN (SELECT start_year, CAST(block_id % 5 AS INT) AS fold, sum(delta_lst) AS s, count(*) AS n FROM transitions WHERE NOT {_LOCKED} GROUP BY ALL) f
  ON f.start_year = t.start_year AND f.fold = CAST(t.block_id % 5 AS INT) WHERE NOT {_LOCKED}""")


def _cooling_sql() -> str:
    f = {i: FAULT.format(year="start_year", at=i) for i in range(4)}
    metrics = """SELECT fold, count(*) AS n, avg(abs(y_hat - delta_lst)) AS mae, sqrt(avg((y_hat - delta_lst) * (y_hat - delta_lst))) AS rmse,
      1 - sum((y_hat - delta_lst) * (y_hat - delta_lst)) / nullif(sum(delta_lst * delta_lst) - sum(delta_lst) * sum(delta_lst) / count(*), 0) AS r2 FROM cooling_cv GROUP BY fold"""
    saved = {
        "pa": ("SELECT start_year, end_year, row, col, delta_lst FROM transitions",
               f"SELECT start_year, end_year + CAST({f[0]} AS INT) AS end_year, row, col, delta_lst + CASE WHEN {f[1]} THEN 0.01 ELSE 0 END AS delta_lst FROM transitions WHERE NOT ({f[2]})"),
        "pr": ("SELECT start_year, row, col, block_id FROM cooling_cv",
               f"SELECT start_year, row, col, block_id FROM cooling_cv WHERE NOT ({f[3]}) UNION ALL SELECT start_year, row, col, block_id FROM transitions WHERE block_id = 9"),
        "me": (metrics, f"SELECT fold, n * CAST(fold <> 1 AS INT) AS n, mae + CASE WHEN fold = 2 THEN 100 ELSE 0 END AS mae, rmse, r2 + CASE WHEN fold = 3 THEN 2 ELSE 0 END AS r2 FROM ({metrics})")}

    def rules(x):
        return (_diff("panel", f"pa{x}", "transitions", "start_year, row, col", _exact("delta_lst")) | {"adjacent": _count(f"pa{x}", "end_year <> start_year + 1")}
                | _diff("predicted", f"pr{x}", f"(SELECT * FROM transitions WHERE NOT {_LOCKED})", "start_year, row, col", {})
                | {"locked_in_cv": _count(f"pr{x}", _LOCKED), "mae_over_rmse": _count(f"me{x}", "mae > rmse + 1e-9"),
                   "r2_range": _count(f"me{x}", "abs(r2) > 1 + 1e-9"), "no_rows": _count(f"me{x}", "n <= 0")})

    return _sql(saved, {}, rules)


@query("dq7_cooling_recompute", _cooling_sql(), "transitions cooling_cv")
def _(spark, sf):
    """The panel of transitions, a cross-validated mean by year (locked blocks left out), and its metrics."""
    keys, year, fold = ["start_year", "row", "col"], "start_year", (c("block_id") % 5).cast("int")

    def build():
        t = transitions(spark, sf).where(~c("block_id").isin(*V.HELD_OUT)).select(*keys, "block_id", "delta_lst", fold.alias("fold"))
        part = t.groupBy(year, "fold").agg(F.sum("delta_lst").alias("_s"), F.count(F.lit(1)).alias("_n"))
        whole = part.groupBy(year).agg(F.sum("_s").alias("_ys"), F.sum("_n").alias("_yn"))
        # A few rows: years and five folds.
        others = part.join(whole, year).select(year, "fold", F.round((c("_ys") - c("_s")) / (c("_yn") - c("_n")), 6).alias("y_hat"))
        return t.join(F.broadcast(others), [year, "fold"])

    predicted, again = V.product(spark, sf, "cooling_cv", build), transitions(spark, sf)
    panel = V.product(spark, sf, "panel", lambda: again.select(*keys, "end_year", "delta_lst"))
    error, y = c("y_hat") - c("delta_lst"), c("delta_lst")
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1))
    metrics = predicted.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
                                            (1 - F.try_divide(F.sum(error * error), spread)).alias("r2"))
    bad_panel = panel.where(~fault(2, year)).withColumns({
        "end_year": c("end_year") + fault(0, year).cast("int"), "delta_lst": c("delta_lst") + F.when(fault(1, year), 0.01).otherwise(0.0)})
    kept = predicted.select(*keys, "block_id")
    bad_predicted = kept.where(~fault(3, year)).unionByName(again.where("block_id = 9").select(*keys, "block_id"))
    bad_metrics = metrics.withColumns({
        "n": c("n") * (c("fold") != 1).cast("int"), "mae": c("mae") + F.when(c("fold") == 2, 100).otherwise(0), "r2": c("r2") + F.when(c("fold") == 3, 2).otherwise(0)})
    return both(lambda bad: GT.cooling_gates(bad_panel if bad else panel, again, bad_predicted if bad else kept, bad_metrics if bad else metrics, V.HELD_OUT))


def _models_sql() -> str:
    f = {i: FAULT.format(year="year", at=i) for i in range(3)}
    pred = "SELECT year, row, col, y_true, y_pred FROM classed"
    wrong = f"SELECT * REPLACE (CASE WHEN {f[0]} THEN (y_pred + 1) % 3 ELSE y_pred END AS y_pred) FROM ({pred}) WHERE NOT ({f[1]}) UNION ALL SELECT * FROM ({pred}) WHERE {f[2]}"
    metrics = f"SELECT year, n, accuracy, macro_f1, support_0, support_1, support_2 FROM ({_metrics_sql('classed', ['year'])})"
    locked = "SELECT year, quantile_cont(lst_c, 1.0/3) AS t1, quantile_cont(lst_c, 2.0/3) AS t2 FROM domain GROUP BY year"
    folds = "SELECT DISTINCT block_id, CAST(block_id % 5 AS INT) AS fold FROM classed"
    saved = {"pr": (pred, wrong), "me": (metrics, f"SELECT * REPLACE (accuracy + CASE WHEN year = 2023 THEN 0.01 ELSE 0 END AS accuracy, support_1 + CAST(year = 2025 AS INT) AS support_1) FROM ({metrics})"),
             "th": ("SELECT year, t1, t2 FROM terciles", f"SELECT year, CASE WHEN year = 2022 THEN t2 ELSE t1 END AS t1, CASE WHEN year = 2022 THEN t1 ELSE t2 END AS t2 FROM ({locked})"),
             "fo": (folds, f"{folds} UNION ALL SELECT block_id, 4 - fold FROM ({folds}) WHERE block_id % 5 < 2")}

    def rules(x):
        near = {v: f"abs(a.{v} - b.{v}) > 1e-6" for v in ("accuracy", "macro_f1")} | _exact("n")
        cut = {v: f"abs(a.{v} - b.{v}) > 1e-6" for v in ("t1", "t2")}
        return (_diff("reload", f"pr{x}", "classed", "year, row, col", _exact("y_pred")) | _diff("metric", f"me{x}", "re0" if x == "_s" else "re1", "year", near)
                | {"support_sum": _count(f"me{x}", "support_0 + support_1 + support_2 <> n")} | _diff("threshold", f"th{x}", "terciles", "year", cut)
                | {"threshold_order": _count(f"th{x}", "t1 >= t2"), "folds_overlap": f"SELECT count(*) FROM (SELECT block_id FROM fo{x} GROUP BY block_id HAVING count(DISTINCT fold) <> 1)"})

    shared = {"bad0": wrong, "re0": f"SELECT year, n, accuracy, macro_f1 FROM ({_metrics_sql('classed', ['year'])})",
              "re1": f"SELECT year, n, accuracy, macro_f1 FROM ({_metrics_sql('bad0', ['year'])})"}
    return _sql(saved, shared, rules)


@query("dq8_model_recompute", _models_sql(), "classed terciles domain")
def _(spark, sf):
    """Stored predictions, metrics, thresholds and folds; the tampered thresholds were taken from locked rows too."""
    classed = V.classed(spark, sf)
    saved = classed.select(*K, "y_true", "y_pred")
    again = V.build_classed(spark, sf).select(*K, "y_pred")
    wrong = saved.where(~fault(1)).withColumn("y_pred", F.when(fault(0), (c("y_pred") + 1) % 3).otherwise(c("y_pred"))).unionByName(saved.where(fault(2)))

    def metrics(d):
        return VL.class_metrics(d, ["year"])

    def limits(d):
        return L.year_thresholds(d, "lst_c", [1 / 3, 2 / 3]).select("year", c("thresholds")[0].alias("t1"), c("thresholds")[1].alias("t2"))

    stored = V.product(spark, sf, "metrics_by_year", lambda: metrics(saved))
    bad_metrics = stored.withColumns({"accuracy": c("accuracy") + F.when(c("year") == 2023, 0.01).otherwise(0.0), "support_1": c("support_1") + (c("year") == 2025).cast("int")})
    thresholds_again = limits(V.train_rows(V.domain(spark, sf)))
    thresholds = V.product(spark, sf, "thresholds_by_year", lambda: thresholds_again)
    turned, leaked = c("year") == 2022, limits(V.domain(spark, sf))
    leaked = leaked.select("year", F.when(turned, c("t2")).otherwise(c("t1")).alias("t1"), F.when(turned, c("t1")).otherwise(c("t2")).alias("t2"))
    folds = pinned_folds(classed)
    bad_folds = folds.unionByName(folds.where("block_id % 5 < 2").withColumn("fold", 4 - c("fold")))

    def gate(bad):
        p = wrong if bad else saved
        return GT.model_gates(p, again, bad_metrics if bad else stored, metrics(p), leaked if bad else thresholds, thresholds_again, bad_folds if bad else folds, 1e-6)

    return both(gate)
