"""Thresholds, classes, ranks and overlap measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import scores as S
from heatgrid.operators import classify as L
from heatgrid.operators import overlap as O
from heatgrid.operators import ranking as R
from heatgrid.operators.quantiles import ranked
from heatgrid.plans import views as V
from heatgrid.plans.join_queries import transitions
from heatgrid.plans.registry import query
from heatgrid.plans.scoring_views import cuts, hot3_labels, hot_labels, scenario_array, scenario_cells, scored, zone_labels
from heatgrid.sources.tables import table

c = F.col
K = ["year", "row", "col"]


@query("cls1_year_quantiles", "SELECT year, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM terciles", "terciles")
def _(spark, sf):
    t = L.year_thresholds(V.train_rows(V.domain(spark, sf)), "lst_c", [1 / 3, 2 / 3])
    return t.select("year", c("thresholds")[0].alias("t1"), c("thresholds")[1].alias("t2"))


@query("cls2_assign_class", """
WITH q AS (SELECT year AS qy, quantile_cont(lst_c, [0.25, 0.5, 0.75]) AS t FROM domain WHERE block_id NOT IN (2, 9, 15, 23) GROUP BY year)
SELECT year, row, col, CAST(lst_c >= t[1] AS INT) + CAST(lst_c >= t[2] AS INT) + CAST(lst_c >= t[3] AS INT) AS right_class,
  CAST(lst_c > t[1] AS INT) + CAST(lst_c > t[2] AS INT) + CAST(lst_c > t[3] AS INT) AS left_class,
  CAST(lst_c >= t[2] AS INT) AS two_class FROM domain JOIN q ON qy = year""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf)
    t = L.year_thresholds(V.train_rows(d), "lst_c", [0.25, 0.5, 0.75])
    right = L.assign_class(d, t, "lst_c", "right_class", "right")
    return right.withColumn("left_class", L.class_of(c("lst_c"), c("thresholds"), "left")).withColumn(
        "two_class", L.class_of(c("lst_c"), F.array(c("thresholds")[1]))).select(*K, "right_class", "left_class", "two_class")


@query("cls3_class_balance", """
SELECT year, y_true, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY year), 6) AS share
FROM classed GROUP BY year, y_true""", "classed")
def _(spark, sf):
    return L.class_balance(V.classed(spark, sf), "y_true")


@query("cls4_rule_baseline", """
WITH tr AS (SELECT * FROM domain WHERE block_id NOT IN (2, 9, 15, 23)),
b AS (SELECT year AS qy, quantile_cont(ndbi, 0.05) AS b5, quantile_cont(ndbi, 0.95) AS b95, quantile_cont(ndvi, 0.05) AS v5,
  quantile_cont(ndvi, 0.95) AS v95 FROM tr GROUP BY year),
s AS (SELECT d.*, round_6((least(greatest(ndbi, b5), b95) - b5) / (b95 - b5) - (least(greatest(ndvi, v5), v95) - v5) / (v95 - v5)) AS s
  FROM domain d JOIN b ON qy = d.year),
q AS (SELECT year AS qy, quantile_cont(s, [0.25, 0.5, 0.75]) AS t FROM s WHERE block_id NOT IN (2, 9, 15, 23) GROUP BY year)
SELECT year, row, col, s, CAST(s >= t[1] AS INT) + CAST(s >= t[2] AS INT) + CAST(s >= t[3] AS INT) AS y_rule
FROM s JOIN q ON qy = year WHERE block_id IN (2, 9, 15, 23)""".replace("round_6((", "round((").replace("(v95 - v5)) AS s", "(v95 - v5), 6) AS s"), "domain")
def _(spark, sf):
    d = V.domain(spark, sf)
    s = L.rule_score(d, V.train_rows(d)).withColumn("s", F.round(c("s") + 1.2345e-9, 6) + 0.0)
    t = L.year_thresholds(V.train_rows(s), "s", [0.25, 0.5, 0.75])
    held = s.where(c("block_id").isin(*V.HELD_OUT))
    return L.assign_class(held, t, "s", "y_rule").select(*K, "s", "y_rule")


@query("cls5_baselines", """
WITH n AS (SELECT year, y_true, count(*) AS n FROM classed WHERE block_id NOT IN (2, 9, 15, 23) GROUP BY year, y_true),
m AS (SELECT year AS qy, arg_min(y_true, -n * 10 + y_true) AS majority, max(CASE WHEN y_true = 0 THEN n END) * 1.0 / sum(n) AS s0,
  sum(CASE WHEN y_true <= 1 THEN n END) * 1.0 / sum(n) AS s1 FROM n GROUP BY year)
SELECT year, row, col, majority, CASE WHEN u < s0 THEN 0 WHEN u < s1 THEN 1 ELSE 2 END AS stratified FROM (
  SELECT *, CAST(('0x' || substr(md5('7|' || year || '|' || row || '|' || col), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0 AS u
  FROM classed WHERE block_id IN (2, 9, 15, 23)) JOIN m ON qy = year""", "classed")
def _(spark, sf):
    d = V.classed(spark, sf)
    n = V.train_rows(d).groupBy("year", "y_true").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("year").agg(
        F.max(F.struct(c("n"), (-c("y_true")).alias("k"))).alias("m"),
        (F.sum(F.when(c("y_true") == 0, c("n"))) / F.sum("n")).alias("s0"),
        (F.sum(F.when(c("y_true") <= 1, c("n"))) / F.sum("n")).alias("s1"))
    u = R.hash_number(7, *K) / 4503599627370496.0
    return d.where(c("block_id").isin(*V.HELD_OUT)).join(F.broadcast(m), "year").select(
        *K, (-c("m.k")).alias("majority"), F.when(u < c("s0"), 0).when(u < c("s1"), 1).otherwise(2).alias("stratified"))


@query("cls6_suitability_class", "SELECT year, suitability_class, count(*) AS n, min(suitability) AS lo, max(suitability) AS hi FROM scored GROUP BY ALL", "scored")
def _(spark, sf):
    d = scored(spark, sf).withColumn("suitability_class", L.class_of_edges(c("suitability"), S.CLASS_EDGES, "left"))
    return d.groupBy("year", "suitability_class").agg(
        F.count(F.lit(1)).alias("n"), F.min("suitability").alias("lo"), F.max("suitability").alias("hi"))


_PCLS = "CAST(CAST(CAST(priority AS FLOAT) AS DOUBLE) >= t1 AS INT) + CAST(CAST(CAST(priority AS FLOAT) AS DOUBLE) >= t2 AS INT)"


@query("cls7_priority_class", f"SELECT year, row, col, {_PCLS} AS priority_class FROM scored, cuts WHERE feasible", "scored cuts")
def _(spark, sf):
    d = scored(spark, sf).where("feasible").join(F.broadcast(cuts(spark, sf)))
    return d.select(*K, S.priority_class(c("priority"), c("t1"), c("t2")).alias("priority_class"))


@query("cls8_hotspot_mask", "SELECT def, year, count(*) AS n FROM hot3_cells_n GROUP BY ALL", "hot3_cells_n")
def _(spark, sf):
    from heatgrid.plans.scoring_views import hot_defs_long
    return hot_defs_long(spark, sf).groupBy("def", "year").agg(F.count(F.lit(1)).alias("n"))


@query("cls9_priority_tier", """
SELECT scenario, year, CASE WHEN cls >= 4 THEN 3 WHEN cls = 3 THEN 2 WHEN cls = 2 THEN 1 ELSE 0 END AS tier, count(*) AS n
FROM scenario_cells GROUP BY 1, 2, 3""", "scenario_cells")
def _(spark, sf):
    return scenario_cells(spark, sf).groupBy("scenario", "year", S.priority_tier(c("cls")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("cls10_boundary_distance", """
SELECT year, CASE WHEN d < 0.5 THEN '0-0.5' WHEN d < 1 THEN '0.5-1' WHEN d < 2 THEN '1-2' ELSE '>=2' END AS band,
  CASE WHEN abs(lst_c - t1) <= abs(lst_c - t2) THEN 0 ELSE 1 END AS pair, count(*) AS n,
  round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy
FROM (SELECT c.*, t1, t2, round(least(abs(lst_c - t1), abs(lst_c - t2)), 6) AS d FROM classed c JOIN terciles t ON t.year = c.year)
GROUP BY 1, 2, 3""", "classed terciles")
def _(spark, sf):
    from heatgrid.functions.cells import bands_text
    d = V.classed(spark, sf)
    t = L.year_thresholds(V.train_rows(d), "lst_c", [1 / 3, 2 / 3])
    d = d.join(F.broadcast(t), "year").withColumn("d", F.round(L.boundary_distance(c("lst_c"), c("thresholds")) + 1.2345e-9, 6))
    return d.groupBy("year", bands_text(c("d"), [0.5, 1, 2], ["0-0.5", "0.5-1", "1-2", ">=2"]).alias("band"),
                     L.nearest_threshold(c("lst_c"), c("thresholds")).alias("pair")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((c("y_true") == c("y_pred")).cast("int")).alias("accuracy"))


# --- set operations ---------------------------------------------------------------------------

_BANDS = ["lst_c", "ndvi", "ndbi", "ndre", "ndmi", "mndwi", "bsi", "vegetation_cover"]


@query("set1_union_years", f"SELECT year, row, col, {', '.join(_BANDS[:-1])}, CASE WHEN year < 2026 THEN vegetation_cover END AS vegetation_cover FROM cells", "cells")
def _(spark, sf):
    """All years, each a frame with its columns in another order; the last lacks one, which is NULL there."""
    d = V.cells(spark, sf)
    out = None
    for i, y in enumerate(range(2022, 2027)):
        bands = _BANDS if y < 2026 else _BANDS[:-1]
        one = d.where(c("year") == y).select(*bands[i:], *K, *bands[:i])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("set2_mask_overlap", """
WITH m AS (SELECT year, a, b, count(*) FILTER (WHERE in_a AND in_b) AS x, count(*) FILTER (WHERE in_a OR in_b) AS u,
  count(*) FILTER (WHERE in_a) AS na, count(*) FILTER (WHERE in_b) AS nb FROM (
  SELECT c.year, p.a, p.b, bool_or(s.scenario = p.a AND s.cls >= 3) AS in_a, bool_or(s.scenario = p.b AND s.cls >= 3) AS in_b
  FROM scored c JOIN scenario_cells s ON s.year = c.year AND s.row = c.row AND s.col = c.col,
  (SELECT x.s AS a, y.s AS b FROM (VALUES ('A'), ('B'), ('C'), ('D')) x(s), (VALUES ('A'), ('B'), ('C'), ('D')) y(s) WHERE x.s < y.s) p
  GROUP BY c.year, c.row, c.col, p.a, p.b) GROUP BY year, a, b)
SELECT year, a, b, x AS intersection_px, u AS union_px, round(x * 1.0 / nullif(u, 0), 6) AS iou, round(x * 1.0 / nullif(na, 0), 6) AS share_of_a,
  round(x * 1.0 / nullif(nb, 0), 6) AS share_of_b FROM m""", "scored scenario_cells")
def _(spark, sf):
    """A cell's four masks (class 3 and up) come from its own row; cells are counted by year and masks before pairs of masks are made."""
    s = scored(spark, sf).select("year", scenario_array(False).alias("_s"))
    masks = {n: F.coalesce(c("_s")[i]["score"] > S.CLASS_EDGES[2], F.lit(False)) for i, n in enumerate(S.SCENARIOS)}
    wide = s.groupBy("year", *[m.alias(n) for n, m in masks.items()]).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), c(x).alias("in_a"), c(y).alias("in_b"))
                      for x in "ABCD" for y in "ABCD" if x < y])
    d = wide.select("year", "n", F.explode(pairs).alias("p")).select("year", "n", "p.*")
    return d.groupBy("year", "a", "b").agg(*O.mask_overlap(c("in_a"), c("in_b"), c("n")))


_PAIR = """(SELECT a.row, a.col, a.y_true AS t1, b.y_true AS t2, a.y_pred = 2 AS h1, b.y_pred = 2 AS h2
  FROM classed a JOIN classed b ON a.row = b.row AND a.col = b.col WHERE a.year = 2022 AND b.year = 2026)"""


def _pair(spark, sf):
    p = O.year_pair(V.classed(spark, sf), 2022, 2026, ["y_true", "y_pred"])
    return p.withColumn("h1", c("y_pred_1") == 2).withColumn("h2", c("y_pred_2") == 2)


@query("set3_change_categories", f"""
SELECT CASE WHEN h1 AND h2 THEN 'persistent' WHEN NOT h1 AND h2 THEN 'new' WHEN h1 AND NOT h2 THEN 'disappeared' ELSE 'stable_not' END AS change,
  count(*) AS pixels, round(count(*) * 0.09, 6) AS area_ha, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent,
  round(sum(count(*) FILTER (WHERE h1 AND h2)) OVER () / sum(count(*) FILTER (WHERE h1 OR h2)) OVER (), 6) AS iou
FROM {_PAIR} GROUP BY 1""", "classed")
def _(spark, sf):
    p = _pair(spark, sf)
    total = p.agg(F.count(F.lit(1)).alias("t"), F.try_divide(
        F.count_if(c("h1") & c("h2")), F.count_if(c("h1") | c("h2"))).alias("iou"))
    n = p.groupBy(O.change_category(c("h1"), c("h2")).alias("change")).agg(F.count(F.lit(1)).alias("pixels"))
    return n.join(F.broadcast(total)).select(
        "change", "pixels", (c("pixels") * 0.09).alias("area_ha"), (c("pixels") * 100.0 / c("t")).alias("percent"), "iou")


@query("set4_transition_matrix", f"""
SELECT a.k AS class_1, b.k AS class_2, coalesce(n, 0) AS n, CAST(coalesce(sum(n) OVER (PARTITION BY a.k), 0) AS BIGINT) AS row_total,
  round(coalesce(n, 0) * 1.0 / nullif(sum(n) OVER (PARTITION BY a.k), 0), 6) AS share
FROM (VALUES (0), (1), (2)) a(k), (VALUES (0), (1), (2)) b(k)
LEFT JOIN (SELECT t1, t2, count(*) AS n FROM {_PAIR} GROUP BY ALL) m ON t1 = a.k AND t2 = b.k""".replace(
    "FROM (VALUES (0), (1), (2)) a(k), (VALUES (0), (1), (2)) b(k)\nLEFT", "FROM (VALUES (0), (1), (2)) a(k) CROSS JOIN (VALUES (0), (1), (2)) b(k)\nLEFT"), "classed")
def _(spark, sf):
    p = _pair(spark, sf).withColumnsRenamed({"y_true_1": "class_1", "y_true_2": "class_2"})
    return O.transition_matrix(p, "class_1", "class_2", [0, 1, 2])


@query("set5_conditional_persistence", f"""
SELECT name, num, den, round(num * 1.0 / nullif(den, 0), 6) AS probability FROM (
  SELECT 'second_given_first' AS name, count(*) FILTER (WHERE t1 = 2 AND t2 = 2) AS num, count(*) FILTER (WHERE t1 = 2) AS den FROM {_PAIR}
  UNION ALL SELECT 'first_given_second', count(*) FILTER (WHERE t1 = 2 AND t2 = 2), count(*) FILTER (WHERE t2 = 2) FROM {_PAIR}
  UNION ALL SELECT 'first', count(*) FILTER (WHERE t1 = 2), count(*) FROM {_PAIR}
  UNION ALL SELECT 'second', count(*) FILTER (WHERE t2 = 2), count(*) FROM {_PAIR})""", "classed")
def _(spark, sf):
    a, b = c("y_true_1") == 2, c("y_true_2") == 2
    one = _pair(spark, sf).agg(F.count_if(a & b).alias("ab"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count(F.lit(1)).alias("n"))
    rows = "'second_given_first', ab, a, 'first_given_second', ab, b, 'first', a, n, 'second', b, n"
    return one.select(F.expr(f"stack(4, {rows}) as (name, num, den)")).withColumn("probability", F.try_divide(c("num"), c("den")))


@query("set6_zone_overlap", """
WITH a AS (SELECT * FROM hot_cells WHERE year = 2022), b AS (SELECT * FROM hot_cells WHERE year = 2026),
p AS (SELECT a.zone_id AS za, b.zone_id AS zb, a.n_px AS na, b.n_px AS nb, count(*) AS shared FROM a JOIN b ON a.row = b.row AND a.col = b.col
  GROUP BY ALL HAVING count(*) >= 0.5 * least(a.n_px, b.n_px)),
best AS (SELECT za, na, nb FROM (SELECT *, row_number() OVER (PARTITION BY za ORDER BY shared DESC, nb DESC, zb) AS k FROM p) WHERE k = 1)
SELECT change, count(*) AS n_zones FROM (
  SELECT CASE WHEN nb < na THEN 'declining' ELSE 'persistent' END AS change FROM best
  UNION ALL SELECT 'lost' FROM (SELECT DISTINCT zone_id FROM a) WHERE zone_id NOT IN (SELECT za FROM best)
  UNION ALL SELECT 'emerging' FROM (SELECT DISTINCT zone_id FROM b) WHERE zone_id NOT IN (SELECT zb FROM p)) GROUP BY change""", "hot_cells")
def _(spark, sf):
    h = hot_labels(spark, sf)
    return O.zone_changes(h.where("year = 2022"), h.where("year = 2026"))


@query("set7_rank_stability", """
WITH z AS (SELECT scenario, year, zone_id, n_px, row_number() OVER (PARTITION BY scenario, year ORDER BY n_px DESC, zone_id) AS r
  FROM (SELECT DISTINCT scenario, year, zone_id, n_px FROM zone_cells)),
t AS (SELECT c.*, r FROM zone_cells c JOIN z ON z.scenario = c.scenario AND z.year = c.year AND z.zone_id = c.zone_id),
a AS (SELECT * FROM t WHERE scenario = 'B' AND r <= 10), o AS (SELECT * FROM t WHERE scenario <> 'B' AND r <= 20),
y AS (SELECT DISTINCT a.year, s.scenario FROM a, (VALUES ('A'), ('C'), ('D')) s(scenario)),
j AS (SELECT o.scenario, a.year, a.zone_id FROM a JOIN o ON a.year = o.year AND a.row = o.row AND a.col = o.col)
SELECT y.scenario, y.year, (SELECT count(DISTINCT zone_id) FROM a WHERE a.year = y.year) AS baseline_zones,
 (SELECT count(DISTINCT zone_id) FROM j WHERE j.year = y.year AND j.scenario = y.scenario) AS persisting_zones,
 (SELECT count(*) FROM j WHERE j.year = y.year AND j.scenario = y.scenario) AS kept_px,
 (SELECT count(*) FROM a WHERE a.year = y.year) - (SELECT count(*) FROM j WHERE j.year = y.year AND j.scenario = y.scenario) AS lost_px,
 (SELECT count(*) FROM o WHERE o.year = y.year AND o.scenario = y.scenario) - (SELECT count(*) FROM j WHERE j.year = y.year AND j.scenario = y.scenario) AS gained_px
FROM y""", "zone_cells")
def _(spark, sf):
    """The ten largest baseline zones against the twenty largest of every other scenario."""
    z = zone_labels(spark, sf)
    zones = z.select("scenario", "year", "zone_id", "n_px").distinct()
    top = ranked(zones, ["scenario", "year"], -c("n_px"), [c("zone_id")], out="r")
    keep = c("r") <= F.when(c("scenario") == "B", 10).otherwise(20)
    t = z.join(top.where(keep).select("scenario", "year", "zone_id"), ["scenario", "year", "zone_id"], "left_semi")
    others = F.explode(F.array(*[F.lit(x) for x in ("A", "C", "D")])).alias("scenario")
    a = t.where("scenario = 'B'").select(*K, c("zone_id").alias("za"), others)
    o = t.where("scenario <> 'B'").select("scenario", *K, F.lit(1).alias("o"))
    j = a.join(o, ["scenario", *K], "full_outer")
    hit = c("za").isNotNull() & c("o").isNotNull()
    return j.groupBy("scenario", "year").agg(
        F.count_distinct("za").alias("baseline_zones"), F.count_distinct(F.when(hit, c("za"))).alias("persisting_zones"),
        F.count_if(hit).alias("kept_px"), F.count_if(c("za").isNotNull() & c("o").isNull()).alias("lost_px"),
        F.count_if(c("za").isNull()).alias("gained_px")).where("baseline_zones > 0")


@query("set8_scenario_agreement", "SELECT year, row, col, round(avg(CAST(cls >= 3 AS INT)), 6) AS agreement FROM scenario_cells GROUP BY ALL", "scenario_cells")
def _(spark, sf):
    return scenario_cells(spark, sf).groupBy(*K).agg(F.avg((c("cls") >= 3).cast("int")).alias("agreement"))


@query("set9_duplicate_audit", """
SELECT key, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (
 SELECT 'order_line' AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'predictors', count(*) FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING count(*) > 1
 UNION ALL SELECT 'conflicting_labels', count(DISTINCT l_returnflag) FROM lineitem GROUP BY l_quantity, l_discount, l_tax HAVING count(DISTINCT l_returnflag) > 1
) GROUP BY key""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    x = ["l_quantity", "l_discount", "l_tax"]
    dup = O.duplicate_audit(li, {"order_line": ["l_orderkey", "l_linenumber"], "predictors": x})
    labels = O.duplicate_audit(li.select(*x, "l_returnflag").distinct(), {"conflicting_labels": x})
    return dup.unionByName(labels)


_TOLERANCE = {"lst_c": 0.01, "ndvi": 1e-6, "ndbi": 1e-6, "bsi": 1e-6, "vegetation_cover": 1e-6}


def _differ_sql(v, tol):
    return (f"count(*) FILTER (WHERE a.row IS NOT NULL AND b.row IS NOT NULL AND NOT coalesce(abs(a.{v} - b.{v}) <= {tol}, a.{v} IS NULL AND b.{v} IS NULL)) AS differ_{v}")


@query("set10_exact_compare", " UNION ALL ".join(f"""
SELECT {y} AS year, count(*) FILTER (WHERE b.row IS NULL) AS only_a, count(*) FILTER (WHERE a.row IS NULL) AS only_b, {', '.join(_differ_sql(v, t) for v, t in _TOLERANCE.items())}
FROM (SELECT * FROM cells WHERE year = {y}) a FULL JOIN (SELECT * FROM cells WHERE year = {y + 1}) b ON a.row = b.row AND a.col = b.col""" for y in range(2022, 2026)), "cells")
def _(spark, sf):
    """Every year beside the next, as one comparison on (year, row, col), with a tolerance for each column."""
    d = V.cells(spark, sf)
    a, b = d.where("year < 2026"), d.where("year > 2022").withColumn("year", c("year") - 1)
    return O.exact_compare(a, b, K, list(_TOLERANCE), _TOLERANCE, by=["year"])


@query("set11_paired_sample", """
SELECT year, row, col, lst_c FROM domain WHERE (row, col) IN (SELECT (row, col) FROM domain GROUP BY row, col HAVING count(DISTINCT year) = 5)""", "domain")
def _(spark, sf):
    from heatgrid.functions.cells import paired_cells
    d = V.domain(spark, sf).select(*K, "lst_c")
    return d.join(paired_cells(d, 5), ["row", "col"], "left_semi")


# --- ranks and samples --------------------------------------------------------------------------

_HASH = "CAST(('0x' || substr(md5('{s}|' || {k}), 1, 13))::BIGINT AS DOUBLE)"
_CELL = "year || '|' || row || '|' || col"


@query("rnk6_sample_per_year", f"""
SELECT year, row, col FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY {_HASH.format(s=42, k=_CELL)}, row, col) AS r FROM domain)
WHERE r <= 500""", "domain")
def _(spark, sf):
    return R.sample_per_group(V.domain(spark, sf).select(*K), ["year"], 500, seed=42)


@query("rnk7_stratified_sample", f"""
WITH q AS (SELECT year AS qy, y_true AS qc, greatest(round_even(600.0 * count(*) / sum(count(*)) OVER (PARTITION BY year), 0), 1) AS quota
  FROM classed GROUP BY year, y_true)
SELECT year, row, col, y_true FROM (SELECT *, row_number() OVER (PARTITION BY year, y_true ORDER BY {_HASH.format(s=7, k=_CELL)}, row, col) AS r FROM classed)
JOIN q ON qy = year AND qc = y_true WHERE r <= quota""", "classed")
def _(spark, sf):
    return R.stratified_sample(V.classed(spark, sf).select(*K, "y_true"), ["year"], "y_true", 600, seed=7)


@query("rnk10_learning_prefix", """
SELECT year, f AS fraction, count(*) AS n_rows, count(DISTINCT block_id) AS n_blocks FROM (
  SELECT year, block_id, dense_rank() OVER (PARTITION BY year ORDER BY block_id) AS k, n FROM (
    SELECT year, block_id, count(*) OVER (PARTITION BY year, block_id) AS n FROM domain WHERE block_id NOT IN (2, 9, 15, 23))) b
JOIN (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) t(f) ON k <= greatest(1, round_even(f * 21, 0)) GROUP BY year, f""", "domain")
def _(spark, sf):
    from heatgrid.operators.validate import learning_prefix
    d = V.train_rows(V.domain(spark, sf))
    out = learning_prefix(d, [0.2, 0.4, 0.6, 0.8, 1.0])
    return out.groupBy("year", "fraction").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("block_id").alias("n_blocks"))
