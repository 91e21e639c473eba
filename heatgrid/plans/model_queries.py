"""Geographic validation, metrics and models. Rule models are checked in SQL; MLlib runs are not."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from heatgrid.operators import models as MM
from heatgrid.operators import protocol as PR
from heatgrid.operators import spatial as SP
from heatgrid.operators import validate as VL
from heatgrid.operators.ranking import hash_number
from heatgrid.plans import views as V
from heatgrid.plans.join_queries import transitions
from heatgrid.plans.registry import query

c = F.col
K = ["year", "row", "col"]


def _metrics_sql(src, by, k=3, per_class=True):
    """Metrics in SQL from a table with y_true and y_pred."""
    b = ", ".join(by)
    cls = "(VALUES (0), (1), (2))"
    keys = f"(SELECT DISTINCT {b} FROM {src})"
    on = " AND ".join(f"t.{x} = g.{x}" for x in by)
    per = f"""
    SELECT {', '.join('g.' + x for x in by)}, k, count(*) FILTER (WHERE y_true = k AND y_pred = k) * 1.0 AS tp, count(*) FILTER (WHERE y_true = k) * 1.0 AS sup,
      count(*) FILTER (WHERE y_pred = k) * 1.0 AS got, count(*) * 1.0 AS tot FROM {keys} g CROSS JOIN {cls} c(k) JOIN {src} t ON {on} GROUP BY {', '.join('g.' + x for x in by)}, k"""
    pr = f"""SELECT *, coalesce(tp / nullif(got, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r,
      coalesce(2 * (coalesce(tp / nullif(got, 0), 0) * coalesce(tp / nullif(sup, 0), 0)) / nullif(coalesce(tp / nullif(got, 0), 0) + coalesce(tp / nullif(sup, 0), 0), 0), 0) AS f FROM ({per})"""
    cols = """CAST(any_value(tot) AS BIGINT) AS n, round(sum(tp) / any_value(tot), 6) AS accuracy, round(sum(r) / count(CASE WHEN sup > 0 THEN 1 END), 6) AS balanced_accuracy,
      round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * sup) / sum(sup), 6) AS weighted_precision,
      round(sum(r * sup) / sum(sup), 6) AS weighted_recall, round(sum(f * sup) / sum(sup), 6) AS weighted_f1,
      round(coalesce((sum(tp) / any_value(tot) - sum(sup * got) / (any_value(tot) * any_value(tot))) / nullif(1 - sum(sup * got) / (any_value(tot) * any_value(tot)), 0), 0), 6) AS kappa"""
    if per_class:
        cols += "".join(f", round(max(CASE WHEN k = {i} THEN p END), 6) AS precision_{i}, round(max(CASE WHEN k = {i} THEN r END), 6) AS recall_{i}, "
                        f"round(max(CASE WHEN k = {i} THEN f END), 6) AS f1_{i}, CAST(max(CASE WHEN k = {i} THEN sup END) AS BIGINT) AS support_{i}" for i in range(k))
    return f"SELECT {b}, {cols} FROM ({pr}) GROUP BY {b}"


def rule_sql(train: str, val: str, by: list[str]) -> str:
    """The rule model in SQL: CTEs ending in `oof` with y_true and y_pred."""
    b = ", ".join(by)

    def on(x, y):
        return " AND ".join(f"{x}.{k} = {y}.{k}" for k in by)

    sc = """round(coalesce((least(greatest(d.ndbi, b5), b95) - b5) / nullif(b95 - b5, 0), 0)
      - coalesce((least(greatest(d.ndvi, v5), v95) - v5) / nullif(v95 - v5, 0), 0), 6)"""
    return f"""
rb AS (SELECT {b}, quantile_cont(ndbi, 0.05) AS b5, quantile_cont(ndbi, 0.95) AS b95, quantile_cont(ndvi, 0.05) AS v5, quantile_cont(ndvi, 0.95) AS v95,
  quantile_cont(lst_c, 1.0/3) AS t1, quantile_cont(lst_c, 2.0/3) AS t2 FROM {train} GROUP BY {b}),
rs AS (SELECT {', '.join('d.' + k for k in by)}, {sc} AS s FROM {train} d JOIN rb ON {on('d', 'rb')}),
rq AS (SELECT {b}, quantile_cont(s, 1.0/3) AS q1, quantile_cont(s, 2.0/3) AS q2 FROM rs GROUP BY {b}),
oof AS (SELECT d.*, {sc} AS rs_s, CAST(d.lst_c >= t1 AS INT) + CAST(d.lst_c >= t2 AS INT) AS y_true,
  CAST({sc} >= q1 AS INT) + CAST({sc} >= q2 AS INT) AS y_pred FROM {val} d JOIN rb ON {on('d', 'rb')} JOIN rq ON {on('d', 'rq')})"""


_FOLDED = """
fm AS (SELECT block_id, CAST(block_id % 5 AS INT) AS fold FROM domain GROUP BY block_id),
dv AS (SELECT d.*, fold FROM domain d JOIN fm ON fm.block_id = d.block_id),
dt AS (SELECT d.* EXCLUDE (fold), f.fold FROM dv d JOIN (SELECT DISTINCT fold FROM fm) f ON f.fold <> d.fold)"""


def pinned_folds(d):
    """Five folds by block number: a fixed assignment that SQL can repeat."""
    return d.select("block_id").distinct().withColumn("fold", (c("block_id") % 5).cast("int"))


def slim(spark, sf):
    return V.domain(spark, sf).select(*K, "block_id", "lst_c", "ndvi", "ndbi")


def oof(spark, sf):
    d = slim(spark, sf)
    return VL.fold_rule_predictions(d, pinned_folds(d))


def lobo(spark, sf):
    d = slim(spark, sf)
    return VL.fold_rule_predictions(d, d.select("block_id", c("block_id").alias("fold")).distinct())


_GREEDY = """
s AS (SELECT block_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block_id) AS i FROM domain WHERE block_id NOT IN (2, 9, 15, 23) GROUP BY block_id),
r(i, loads, block_id, fold, n) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::INTEGER, NULL::INTEGER, NULL::BIGINT
  UNION ALL SELECT s.i, list_transform(range(1, 6), lambda k: r.loads[k] + CASE WHEN k = list_position(r.loads, list_min(r.loads)) THEN s.n ELSE 0 END),
    CAST(s.block_id AS INTEGER), CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER), s.n FROM r JOIN s ON s.i = r.i + 1)"""


@query("ml1_group_folds", f"WITH RECURSIVE {_GREEDY} SELECT block_id, fold, n FROM r WHERE i > 0", "domain")
def _(spark, sf):
    d = slim(spark, sf)
    f = VL.group_folds(d, 5, exclude=V.HELD_OUT)
    n = d.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "block_id")


@query("ml2_spatial_cv", f"WITH {_FOLDED}, {rule_sql('dt', 'dv', ['fold', 'year'])} SELECT year, row, col, fold, y_true, y_pred FROM oof", "domain")
def _(spark, sf):
    return oof(spark, sf).select(*K, "fold", "y_true", "y_pred")


_LOBO = """
dv AS (SELECT *, block_id AS fold FROM domain), dt AS (SELECT d.*, f.fold FROM domain d JOIN (SELECT DISTINCT block_id AS fold FROM domain) f ON f.fold <> d.block_id)"""


@query("ml3_lobo", f"WITH {_LOBO}, {rule_sql('dt', 'dv', ['fold', 'year'])} {_metrics_sql('oof', ['fold'], per_class=False)}", "domain")
def _(spark, sf):
    return VL.class_metrics(lobo(spark, sf), ["fold"], per_class=False)


_HELD = """tr AS (SELECT * FROM domain WHERE block_id NOT IN (2, 9, 15, 23)), va AS (SELECT * FROM domain WHERE block_id IN (2, 9, 15, 23))"""


@query("ml4_locked_holdout", f"WITH {_HELD}, {rule_sql('tr', 'va', ['year'])} {_metrics_sql('oof', ['year'])}", "domain")
def _(spark, sf):
    d = slim(spark, sf)
    held = d.where(c("block_id").isin(*V.HELD_OUT))
    return VL.class_metrics(VL.rule_predictions(V.train_rows(d), held, ["year"]), ["year"])


@query("ml5_class_metrics", _metrics_sql("classed", ["year"]), "classed")
def _(spark, sf):
    return VL.class_metrics(V.classed(spark, sf), ["year"])


@query("ml6_regression_metrics", """
SELECT start_year, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(next_lst) * count(*)), 6) AS r2,
  round(avg(e), 6) AS residual_mean, round(stddev_pop(e), 6) AS residual_std, round(avg(CAST(abs(e) > 2 AS INT)), 6) AS share_over_2
FROM (SELECT *, next_lst - current_lst AS e FROM transitions) GROUP BY start_year""", "transitions")
def _(spark, sf):
    return VL.regression_metrics(transitions(spark, sf), ["start_year"], "next_lst", "current_lst")


_MNAMES = ["accuracy", "macro_f1", "kappa"]


@query("ml7_fold_summary", f"""
WITH {_FOLDED}, {rule_sql('dt', 'dv', ['fold', 'year'])}, m AS ({_metrics_sql('oof', ['fold'], per_class=False).replace('round(', 'round_no(')})
SELECT metric, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std_pop, round(stddev_samp(v), 5) AS std_samp, round(min(v), 5) AS lo, round(max(v), 5) AS hi,
  round(quantile_cont(v, 0.5), 5) AS median, round(max(v) - min(v), 5) AS spread FROM ({' UNION ALL '.join(f"SELECT '{x}' AS metric, {x} AS v FROM m" for x in _MNAMES)}) GROUP BY metric
""".replace("round_no(", "round("), "domain", digits=5)
def _(spark, sf):
    m = VL.class_metrics(oof(spark, sf), ["fold"], per_class=False)
    return VL.fold_summary(m.select("fold", *[F.round(c(x) + 1.2345e-9, 6).alias(x) for x in _MNAMES]), _MNAMES)


@query("ml8_train_validation_gap", f"""
WITH {_FOLDED}, {rule_sql('dt', 'dv', ['fold', 'year'])}, tq AS (SELECT d.fold, avg(CAST((CAST(d.lst_c >= t1 AS INT) + CAST(d.lst_c >= t2 AS INT)) = (CAST(s >= q1 AS INT) + CAST(s >= q2 AS INT)) AS INT)) AS acc
  FROM (SELECT d.*, round(coalesce((least(greatest(d.ndbi, b5), b95) - b5) / nullif(b95 - b5, 0), 0) - coalesce((least(greatest(d.ndvi, v5), v95) - v5) / nullif(v95 - v5, 0), 0), 6) AS s, t1, t2
        FROM dt d JOIN rb ON rb.fold = d.fold AND rb.year = d.year) d JOIN rq ON rq.fold = d.fold AND rq.year = d.year GROUP BY d.fold)
SELECT v.fold, round(tq.acc, 6) AS train_accuracy, round(v.acc, 6) AS validation_accuracy, round(tq.acc - v.acc, 6) AS gap
FROM (SELECT fold, avg(CAST(y_true = y_pred AS INT)) AS acc FROM oof GROUP BY fold) v JOIN tq ON tq.fold = v.fold""", "domain")
def _(spark, sf):
    d = slim(spark, sf)
    train, val = VL.fold_rows(d, pinned_folds(d))
    acc = F.avg((c("y_true") == c("y_pred")).cast("int"))
    t = VL.rule_predictions(train, train, ["fold", "year"]).groupBy("fold").agg(acc.alias("train_accuracy"))
    v = VL.rule_predictions(train, val, ["fold", "year"]).groupBy("fold").agg(acc.alias("validation_accuracy"))
    return t.join(v, "fold").withColumn("gap", c("train_accuracy") - c("validation_accuracy"))


_YP = "(SELECT a.y AS train_year, b.y AS test_year FROM (VALUES (2022), (2023), (2024), (2025), (2026)) a(y), (VALUES (2022), (2023), (2024), (2025), (2026)) b(y) WHERE abs(a.y - b.y) IN (1, 4))"


@query("ml9_temporal_holdout", f"""
WITH yp AS {_YP}, tr AS (SELECT d.*, train_year, test_year FROM domain d JOIN yp ON d.year = train_year), va AS (SELECT d.*, train_year, test_year FROM domain d JOIN yp ON d.year = test_year),
{rule_sql('tr', 'va', ['train_year', 'test_year'])} {_metrics_sql('oof', ['train_year', 'test_year'], per_class=False)}""", "domain")
def _(spark, sf):
    """All adjacent year pairs both ways and the end points: a few copies of each year."""
    d = slim(spark, sf)
    pairs = [(a, b) for a in range(2022, 2027) for b in range(2022, 2027) if abs(a - b) in (1, 4)]
    table = spark.createDataFrame(pairs, "train_year int, test_year int")
    tr = d.join(F.broadcast(table), c("year") == c("train_year"))
    va = d.join(F.broadcast(table), c("year") == c("test_year"))
    p = VL.rule_predictions(tr, va, ["train_year", "test_year"])
    return VL.class_metrics(p, ["train_year", "test_year"], per_class=False)


@query("ml10_ordinal_ensemble", """
SELECT year, row, col, round(a0 / t, 6) AS q0, round(a1 / t, 6) AS q1, round(a2 / t, 6) AS q2 FROM (SELECT *, a0 + a1 + a2 AS t FROM (
  SELECT year, row, col, greatest(1 - g1, 0) AS a0, greatest(g1 - g2, 0) AS a1, greatest(g2, 0) AS a2
  FROM (SELECT *, least(p1 + p2, 1) AS g1, least(p2 + 0.05, 1) AS g2 FROM classed)))""", "classed")
def _(spark, sf):
    g = [F.least(c("p1") + c("p2"), F.lit(1.0)), F.least(c("p2") + 0.05, F.lit(1.0))]
    q = MM.ordinal_probabilities(g)
    return V.classed(spark, sf).select(*K, *[q[i].alias(f"q{i}") for i in range(3)])


@query("ml12_calibration", """
WITH b AS (SELECT year, CAST(least(floor(confidence * 10 + 1e-9), 9) AS INT) AS bin, count(*) AS n, avg(confidence) AS conf, avg(CAST(y_true = y_pred AS INT)) AS acc,
  sum(pow(p0 - CAST(y_true = 0 AS INT), 2) + pow(p1 - CAST(y_true = 1 AS INT), 2) + pow(p2 - CAST(y_true = 2 AS INT), 2)) AS sq FROM classed GROUP BY 1, 2)
SELECT year, round(sum(abs(conf - acc) * n) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b GROUP BY year""", "classed")
def _(spark, sf):
    return VL.calibration(V.classed(spark, sf), ["year"])[1]


@query("ml13_morans_i", """
WITH v AS (SELECT year, row, col, CAST(y_true <> y_pred AS INT) AS e FROM classed), m AS (SELECT year, avg(e) AS m, count(*) AS n FROM v GROUP BY year),
z AS (SELECT v.*, e - m AS z FROM v JOIN m ON m.year = v.year),
l AS (SELECT k.year, k.row, k.col, avg(z) AS lag FROM knn8 k JOIN z ON z.year = k.year AND z.row = k.n_row AND z.col = k.n_col GROUP BY ALL)
SELECT z.year, count(*) AS n, round(count(*) * 1.0 / count(lag) * sum(z * lag) / sum(z * z), 6) AS morans_i, round(-1.0 / (count(*) - 1), 6) AS expected_i
FROM z LEFT JOIN l ON l.year = z.year AND l.row = z.row AND l.col = z.col GROUP BY z.year""", "classed knn8")
def _(spark, sf):
    p = V.classed(spark, sf).select(*K, (c("y_true") != c("y_pred")).cast("int").cast("double").alias("e"))
    return VL.morans_i(p, SP.knn(p, 8), "e")


@query("ml13_morans_permutation", """
WITH v AS (SELECT year, row, col, CAST(y_true <> y_pred AS INT) AS e,
  row_number() OVER (PARTITION BY year ORDER BY CAST(('0x' || substr(md5('42|' || year || '|' || row || '|' || col), 1, 13))::BIGINT AS DOUBLE), row, col) - 1 AS i FROM classed),
m AS (SELECT year, avg(e) AS m, count(*) AS n FROM v GROUP BY year),
z AS (SELECT v.year, row, col, i, n, e - m AS z FROM v JOIN m ON m.year = v.year),
d AS (SELECT year, any_value(n) AS n, sum(z * z) AS d FROM z GROUP BY year),
k AS (SELECT k.year, p.i AS ia, q.i AS ib, p.n, 1.0::DOUBLE / count(*) OVER (PARTITION BY k.year, k.row, k.col) AS w FROM knn8 k
  JOIN z p ON p.year = k.year AND p.row = k.row AND p.col = k.col JOIN z q ON q.year = k.year AND q.row = k.n_row AND q.col = k.n_col),
ks AS (SELECT year, s, (ia + s) % n AS a, (ib + s) % n AS b, w FROM k, range(0, 200) t(s)),
t AS (SELECT ks.year, s, sum(w) AS w, sum(w * za.z * zb.z) AS x FROM ks JOIN z za ON za.year = ks.year AND za.i = ks.a
  JOIN z zb ON zb.year = ks.year AND zb.i = ks.b GROUP BY ks.year, s),
x AS (SELECT t.year, s, n, n / w * x / d AS i, -1.0 / (n - 1) AS e FROM t JOIN d ON d.year = t.year)
SELECT o.year, o.n, round(o.i, 6) AS morans_i, round(o.e, 6) AS expected_i,
  round((1 + sum(CAST(abs(x.i - x.e) >= abs(o.i - o.e) - 1e-9 AS INT))) / 200.0, 6) AS p_value
FROM x o JOIN x ON x.year = o.year AND x.s > 0 WHERE o.s = 0 GROUP BY o.year, o.n, o.i, o.e""", "classed knn8")
def _(spark, sf):
    """Moran's I of the errors with 199 permutations and a two-sided p, the neighbour list joined once."""
    p = V.classed(spark, sf).select(*K, (c("y_true") != c("y_pred")).cast("int").cast("double").alias("e"))
    return VL.morans_permutation(p, SP.knn(p, 8), "e")


_TIER = "CASE WHEN agree >= 5 THEN '5/5' WHEN agree = 4 THEN '4/5' WHEN agree = 3 THEN '3/5' ELSE '<=2/5' END"


@query("ml16_label_permutation", """
WITH d AS (SELECT year, row, col, y_true, y_pred, row_number() OVER (PARTITION BY year ORDER BY row, col) AS i,
  row_number() OVER (PARTITION BY year ORDER BY CAST(('0x' || substr(md5('11|' || year || '|' || row || '|' || col), 1, 13))::BIGINT AS DOUBLE), row, col) AS j FROM classed)
SELECT a.year, round(avg(CAST(a.y_true = a.y_pred AS INT)), 6) AS accuracy, round(avg(CAST(b.y_true = a.y_pred AS INT)), 6) AS permuted_accuracy
FROM d a JOIN d b ON a.year = b.year AND a.i = b.j GROUP BY a.year""", "classed")
def _(spark, sf):
    p = VL.permute(V.classed(spark, sf).select(*K, "y_true", "y_pred"), "y_true", ["year"], 11)
    return p.groupBy("year").agg(
        F.avg((c("y_true") == c("y_pred")).cast("int")).alias("accuracy"),
        F.avg((c("y_true_perm") == c("y_pred")).cast("int")).alias("permuted_accuracy"))


@query("ml17_learning_curve", f"""
WITH tb AS (SELECT block_id, dense_rank() OVER (ORDER BY block_id) AS k FROM (SELECT DISTINCT block_id FROM domain WHERE block_id NOT IN (2, 9, 15, 23))),
tr AS (SELECT d.*, f AS fraction FROM domain d JOIN tb ON tb.block_id = d.block_id JOIN (VALUES (0.2::DOUBLE), (0.6::DOUBLE), (1.0::DOUBLE)) t(f) ON k <= greatest(1, round_even(f * 21, 0))),
va AS (SELECT d.*, f AS fraction FROM domain d, (VALUES (0.2::DOUBLE), (0.6::DOUBLE), (1.0::DOUBLE)) t(f) WHERE block_id IN (2, 9, 15, 23)),
{rule_sql('tr', 'va', ['fraction', 'year'])} {_metrics_sql('oof', ['fraction'], per_class=False)}""", "domain")
def _(spark, sf):
    d, fr = slim(spark, sf), [0.2, 0.6, 1.0]
    tr = VL.learning_prefix(V.train_rows(d), fr)
    va = d.where(c("block_id").isin(*V.HELD_OUT)).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fr])))
    return VL.class_metrics(VL.rule_predictions(tr, va, ["fraction", "year"]), ["fraction"], per_class=False)


@query("ml20_select_model", f"""
WITH {_LOBO}, {rule_sql('dt', 'dv', ['fold', 'year'])}, m AS ({_metrics_sql('oof', ['fold'], per_class=False)})
SELECT fold, macro_f1, accuracy FROM m ORDER BY macro_f1 DESC, accuracy DESC, fold LIMIT 1""", "domain")
def _(spark, sf):
    m = VL.class_metrics(lobo(spark, sf), ["fold"], per_class=False)
    m = m.select("fold", *[F.round(c(x) + 1.2345e-9, 6).alias(x) for x in ("macro_f1", "accuracy")])
    return MM.select_best(m, ["macro_f1", "accuracy"], "fold")


@query("ml21_class_weights", "SELECT year, y_true, round(sum(count(*)) OVER (PARTITION BY year) / (3.0 * count(*)), 6) AS weight FROM classed GROUP BY year, y_true", "classed")
def _(spark, sf):
    return MM.class_weights(V.classed(spark, sf), "y_true", ["year"])


@query("ml23_error_diagnostics", """
SELECT year, 'overall' AS analysis, 'all' AS grp, count(*) AS n, round(avg(CAST(y_true = y_pred AS INT)), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence FROM classed GROUP BY year
UNION ALL SELECT year, 'recall', CAST(y_true AS VARCHAR), count(*), round(avg(CAST(y_true = y_pred AS INT)), 6), round(avg(confidence), 6) FROM classed GROUP BY year, y_true
UNION ALL SELECT year, 'block', CAST(block_id AS VARCHAR), count(*), round(avg(CAST(y_true = y_pred AS INT)), 6), round(avg(confidence), 6) FROM classed GROUP BY year, block_id
UNION ALL SELECT year, 'outcome', CASE WHEN y_true = y_pred THEN 'correct' ELSE 'incorrect' END, count(*), round(avg(CAST(y_true = y_pred AS INT)), 6), round(avg(confidence), 6) FROM classed GROUP BY 1, 3
""", "classed")
def _(spark, sf):
    return MM.error_diagnostics(V.classed(spark, sf))


@query("ml24_leakage_audit", """
SELECT column_name, CASE WHEN column_name IN ('lst_c', 'y_true', 'y_pred', 's') OR column_name LIKE 'lst%' THEN 'target_derived'
  WHEN column_name IN ('row', 'col', 'block_id') THEN 'position' ELSE 'allowed' END AS policy, n FROM (
  SELECT unnest(['lst_c', 'ndvi', 'row', 'block_id', 'vegetation_cover']) AS column_name, (SELECT count(*) FROM domain) AS n)""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf).select("lst_c", "ndvi", "row", "block_id", "vegetation_cover")
    return MM.leakage_audit(d)


# --- MLlib ------------------------------------------------------------------------------------------

FEATURES = ["ndvi", "ndbi", "ndmi", "bsi", "vegetation_cover", "dist_road_m", "dist_vegetation_m", "dist_building_m"]


@query("ml11_reg_then_threshold")
def _(spark, sf):
    d = V.domain(spark, sf)
    p = MM.fit_regressor(V.train_rows(d), d.where(c("block_id").isin(*V.HELD_OUT)), FEATURES, "lst_c", depth=6)
    return MM.threshold_metrics(p, V.train_rows(d))


@query("ml18_nested_cv")
def _(spark, sf):
    d = V.classed(spark, sf)
    return MM.nested_cv(d, FEATURES, "y_true")


@query("ml19_feature_importance")
def _(spark, sf):
    d = V.domain(spark, sf)
    return MM.importances(V.train_rows(d), d.where(c("block_id").isin(*V.HELD_OUT)), FEATURES, "lst_c", depth=6)


@query("ml22_predict_grid")
def _(spark, sf):
    d = V.classed(spark, sf)
    p = MM.predict_classes(V.train_rows(d), d, FEATURES, "y_true", depth=6)
    return p.select(*K, "y_hat", F.array_max("prob").alias("confidence"))


@query("sco20_scenario_cooling", """
WITH f AS (SELECT start_year, regr_slope(delta_lst, vegetation_change) AS b FROM transitions GROUP BY start_year)
SELECT z.year, z.zone_id, density, count(*) AS px, round(avg(b * least(density / 1000.0 * 0.05, 1 - vegetation_cover)), 6) AS mean_delta
FROM site_cells z JOIN scored s ON s.year = z.year AND s.row = z.row AND s.col = z.col JOIN f ON f.start_year = z.year, (VALUES (400), (1000), (2500)) t(density)
GROUP BY z.year, z.zone_id, density""", "transitions site_cells scored")
def _(spark, sf):
    from heatgrid.plans.scoring_views import scored, site_labels
    fit = transitions(spark, sf).groupBy(c("start_year").alias("year")).agg(F.regr_slope("delta_lst", "vegetation_change").alias("b"))
    d = site_labels(spark, sf).join(scored(spark, sf).select(*K, "vegetation_cover"), K).join(F.broadcast(fit), "year")
    d = d.withColumn("density", F.explode(F.array(*[F.lit(x) for x in (400, 1000, 2500)])))
    add = F.least(c("density") / 1000.0 * 0.05, 1 - c("vegetation_cover"))
    return d.groupBy("year", "zone_id", "density").agg(F.count(F.lit(1)).alias("px"), F.avg(c("b") * add).alias("mean_delta"))


@query("sco20_model_cooling")
def _(spark, sf):
    from heatgrid.plans.scoring_views import scored, site_labels
    cells = site_labels(spark, sf).join(scored(spark, sf).drop("s"), K)
    return MM.model_cooling(transitions(spark, sf), cells, (400, 1000, 2500))


@query("sco21_cooling_distribution", """
SELECT start_year, round(min(delta_lst), 6) AS lo, round(quantile_cont(delta_lst, 0.05), 6) AS p05, round(quantile_cont(delta_lst, 0.5), 6) AS median,
  round(quantile_cont(delta_lst, 0.95), 6) AS p95, round(max(delta_lst), 6) AS hi, count(*) FILTER (WHERE abs(delta_lst) > 10) AS n_extreme FROM transitions GROUP BY start_year""", "transitions")
def _(spark, sf):
    from heatgrid.operators.quantiles import quantile_columns
    t = transitions(spark, sf)
    a = t.groupBy("start_year").agg(F.min("delta_lst").alias("lo"), F.max("delta_lst").alias("hi"), F.count_if(F.abs("delta_lst") > 10).alias("n_extreme"))
    return a.join(quantile_columns(t, ["start_year"], {"delta_lst": ["p05", "median", "p95"]}, [0.05, 0.5, 0.95]), "start_year")


# --- the protocols with estimators ------------------------------------------------------------------
# A straight line is the estimator whose fit SQL can repeat: those rows check the whole driver. Forests go the same way.

def _line_sql(train: str, val: str, key: str, x: str = "ndvi", by: tuple[str, ...] = ("year",), more: tuple[str, ...] = ()) -> str:
    """CTEs ending in `oof`: a line fitted per key, classes by the training rows' terciles of each group."""
    fit, cut_ = ", ".join((key, *more)), ", ".join((key, *more, *by))
    on = " AND ".join(f"d.{k} = lr.{k}" for k in (key, *more))
    on2 = " AND ".join(f"d.{k} = th.{k}" for k in (key, *more, *by))
    return f"""
lr AS (SELECT {fit}, regr_slope(lst_c, {x}) AS b1, regr_intercept(lst_c, {x}) AS b0 FROM {train} GROUP BY {fit}),
th AS (SELECT {cut_}, quantile_cont(lst_true, 1.0/3) AS t1, quantile_cont(lst_true, 2.0/3) AS t2 FROM (SELECT *, lst_c AS lst_true FROM {train}) GROUP BY {cut_}),
oof AS (SELECT d.*, CAST(lst_c >= t1 AS INT) + CAST(lst_c >= t2 AS INT) AS y_true, CAST(b0 + b1 * {x} >= t1 AS INT) + CAST(b0 + b1 * {x} >= t2 AS INT) AS y_pred
  FROM {val} d JOIN lr ON {on} JOIN th ON {on2})"""


_METRICS = ("accuracy, balanced_accuracy, macro_precision, macro_recall, macro_f1, weighted_precision, weighted_recall, weighted_f1, kappa")


def _scores_sql(key: str, keys: str, train: str = "dt", val: str = "dv") -> str:
    return f"""SELECT k.{key}, coalesce(a.n, 0) AS n_train, coalesce(b.n, 0) AS n_validation, CASE WHEN a.n > 0 AND b.n > 0 THEN 'ok' ELSE 'empty' END AS status, {_METRICS}
FROM ({keys}) k LEFT JOIN (SELECT {key}, count(*) AS n FROM {train} GROUP BY {key}) a ON a.{key} = k.{key} LEFT JOIN (SELECT {key}, count(*) AS n FROM {val} GROUP BY {key}) b ON b.{key} = k.{key}
LEFT JOIN ({_metrics_sql('oof', [key], per_class=False)}) m ON m.{key} = k.{key}"""


def line(features=("ndvi",)):
    return PR.thresholded(PR.estimator_fit(LinearRegression(), features, "lst_c"))


def forest(depth: int = 6, seed: int = 42, features=None, leaf: int = 2, trees: int = 20):
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return PR.estimator_fit(rf, features or FEATURES)


def cv_input(spark, sf):
    d = V.domain(spark, sf)
    return d.join(F.broadcast(pinned_folds(d)), "block_id")


BLOCKS = range(25)
YEAR_PAIRS = [(a, b) for a in range(2022, 2027) for b in range(2022, 2027) if abs(a - b) in (1, 4)]
FRACTIONS = (0.2, 0.6, 1.0)


def prefixes(d):
    blocks = [r[0] for r in V.train_rows(d).select("block_id").distinct().collect()]  # at most 25 by the grid's rule
    return PR.prefix_splits(PR.block_prefixes(blocks, FRACTIONS), V.HELD_OUT)


def protocol(name, sql, ctes, key, build):
    """Two queries of one protocol: with a line, checked in SQL, and with a forest."""
    query(f"{name}_line", sql, ctes)(lambda spark, sf: PR.scores(build(spark, sf, line(), ["ndvi"]), key))
    query(f"{name}_forest")(lambda spark, sf: PR.scores(build(spark, sf, forest(), FEATURES), key))


protocol("ml2_spatial_cv", f"WITH {_FOLDED}, {_line_sql('dt', 'dv', 'fold')} {_scores_sql('fold', 'SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold')}", "domain", "fold",
         lambda spark, sf, fit, cols: PR.run(cv_input(spark, sf), PR.group_splits("fold", range(5)), fit, [*cols, "fold"]))
protocol("ml3_lobo", f"WITH {_LOBO}, {_line_sql('dt', 'dv', 'fold')} {_scores_sql('fold', 'SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS fold')}", "domain", "fold",
         lambda spark, sf, fit, cols: PR.run(V.domain(spark, sf), PR.group_splits("block_id", BLOCKS), fit, cols))
protocol("ml4_locked_holdout", f"WITH {_HELD}, dt AS (SELECT *, 'holdout' AS fold FROM tr), dv AS (SELECT *, 'holdout' AS fold FROM va), {_line_sql('dt', 'dv', 'fold')} "
         f"{_scores_sql('fold', chr(39).join(('SELECT ', 'holdout', ' AS fold')))}", "domain", "fold",
         lambda spark, sf, fit, cols: PR.run(V.domain(spark, sf), PR.holdout_split("block_id", V.HELD_OUT), fit, cols))
protocol("ml9_temporal_holdout", f"""WITH yp AS (SELECT *, train_year || '-' || test_year AS fold FROM {_YP}), dt AS (SELECT d.*, fold FROM domain d JOIN yp ON d.year = train_year),
dv AS (SELECT d.*, fold FROM domain d JOIN yp ON d.year = test_year), {_line_sql('dt', 'dv', 'fold', by=())} {_scores_sql('fold', 'SELECT fold FROM yp')}""", "domain", "fold",
         lambda spark, sf, fit, cols: PR.run(V.domain(spark, sf), PR.year_splits(YEAR_PAIRS), fit, cols, by=()))
protocol("ml17_learning_curve", f"""WITH tb AS (SELECT block_id, dense_rank() OVER (ORDER BY block_id) AS k FROM (SELECT DISTINCT block_id FROM domain WHERE block_id NOT IN (2, 9, 15, 23))),
fr AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.6::DOUBLE), (1.0::DOUBLE)) t(fraction)), nb AS (SELECT count(*) AS m FROM tb),
dt AS (SELECT d.*, fraction FROM domain d JOIN tb ON tb.block_id = d.block_id, fr, nb WHERE k <= greatest(1, round_even(fraction * m, 0))),
dv AS (SELECT d.*, fraction FROM domain d, fr WHERE block_id IN (2, 9, 15, 23)), {_line_sql('dt', 'dv', 'fraction')} {_scores_sql('fraction', 'SELECT fraction FROM fr')}""", "domain", "fraction",
         lambda spark, sf, fit, cols: PR.run(V.domain(spark, sf), prefixes(V.domain(spark, sf)), fit, cols, key="fraction"))


@query("ml9_leave_one_transition_out", """
WITH f AS (SELECT DISTINCT start_year AS fold FROM transitions), lr AS (SELECT fold, count(*) AS n_train, regr_slope(delta_lst, vegetation_change) AS b1, regr_intercept(delta_lst, vegetation_change) AS b0
  FROM transitions t JOIN f ON t.start_year <> f.fold GROUP BY fold), e AS (SELECT lr.*, delta_lst, delta_lst - (b0 + b1 * vegetation_change) AS e FROM transitions t JOIN lr ON t.start_year = lr.fold)
SELECT fold, any_value(n_train) AS n_train, count(*) AS n_validation, 'ok' AS status, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / (var_pop(delta_lst) * count(*)), 6) AS r2,
  round(avg(e), 6) AS residual_mean, round(stddev_pop(e), 6) AS residual_std, round(avg(CAST(abs(e) > 2 AS INT)), 6) AS share_over_2 FROM e GROUP BY fold""", "transitions")
def _(spark, sf):
    """Every transition predicted by a line through all others."""
    t = transitions(spark, sf)
    splits = [PR.Split(y, c("start_year") != y, c("start_year") == y) for y in range(2022, 2026)]
    runs = PR.run(t, splits, PR.estimator_fit(LinearRegression(), ["vegetation_change"], "delta_lst"), ["vegetation_change"],
                  keep=("start_year", "row", "col", "block_id", "delta_lst"), value=None)
    return PR.scores(runs, regression="delta_lst")


@query("ml10_ordinal_fits")
def _(spark, sf):
    """Real probabilities of reaching each class: one binary forest per threshold, on the held-out blocks."""
    rf = RandomForestClassifier(numTrees=20, maxDepth=6, minInstancesPerNode=2, seed=42)
    runs = PR.run(V.domain(spark, sf), PR.holdout_split("block_id", V.HELD_OUT), PR.ordinal_fit(rf, FEATURES), FEATURES)
    return runs.predictions.select(*K, "y_true", "y_pred", *[c("prob")[i].alias(f"q{i}") for i in range(3)])


SEEDS = (11, 12, 13)


def _refit_sql(permuted: str) -> str:
    """Scores per fold and variant when `permuted` (lst_c or ndvi) is dealt out anew among a fold's training rows of a year."""
    other = "ndvi" if permuted == "lst_c" else "lst_c"
    order = "CAST(('0x' || substr(md5(seed || '|' || year || '|' || row || '|' || col), 1, 13))::BIGINT AS DOUBLE)"
    return f"""WITH {_FOLDED}, sd AS (SELECT * FROM (VALUES {', '.join(f"('seed_{s}', {s})" for s in SEEDS)}) t(variant, seed)),
dn AS (SELECT fold, year, variant, lst_c, ndvi, lst_c AS lst_true, row_number() OVER (PARTITION BY fold, year, variant ORDER BY row, col) AS i,
  row_number() OVER (PARTITION BY fold, year, variant ORDER BY {order}, row, col) AS j FROM dt, sd),
tp AS (SELECT a.fold, a.year, a.variant, b.{permuted}, a.{other} FROM dn a JOIN dn b ON a.fold = b.fold AND a.year = b.year AND a.variant = b.variant AND a.i = b.j
  UNION ALL SELECT fold, year, 'as_is', {permuted}, {other} FROM dt),
lr AS (SELECT fold, variant, regr_slope(lst_c, ndvi) AS b1, regr_intercept(lst_c, ndvi) AS b0 FROM tp GROUP BY fold, variant),
th AS (SELECT fold, year, quantile_cont(lst_c, 1.0/3) AS t1, quantile_cont(lst_c, 2.0/3) AS t2 FROM dt GROUP BY fold, year),
oof AS (SELECT d.fold, variant, CAST(lst_c >= t1 AS INT) + CAST(lst_c >= t2 AS INT) AS y_true, CAST(b0 + b1 * ndvi >= t1 AS INT) + CAST(b0 + b1 * ndvi >= t2 AS INT) AS y_pred
  FROM dv d JOIN lr ON lr.fold = d.fold JOIN th ON th.fold = d.fold AND th.year = d.year)
SELECT fold, variant, accuracy, balanced_accuracy, macro_f1 FROM ({_metrics_sql('oof', ['fold', 'variant'], per_class=False)})"""


def _refits(spark, sf, column, fit, cols):
    variants = {"as_is": None} | {f"seed_{s}": PR.permuted(column, s) for s in SEEDS}
    runs = PR.run(cv_input(spark, sf), PR.group_splits("fold", range(5)), fit, [*cols, "fold"], variants=variants)
    return VL.class_metrics(runs.predictions, ["fold", "variant"], per_class=False)


@query("ml16_label_refit", _refit_sql("lst_c"), "domain")
def _(spark, sf):
    """Training labels dealt out anew and the model fitted again; validation labels stay."""
    return _refits(spark, sf, "lst_c", line(), ["ndvi"]).select("fold", "variant", "accuracy", "balanced_accuracy", "macro_f1")


@query("ml16_feature_refit", _refit_sql("ndvi"), "domain")
def _(spark, sf):
    """A training feature dealt out anew and the model fitted again; validation features stay."""
    return _refits(spark, sf, "ndvi", line(), ["ndvi"]).select("fold", "variant", "accuracy", "balanced_accuracy", "macro_f1")


@query("ml16_label_refit_forest")
def _(spark, sf):
    """Where the forest's score stands among those of forests fitted to permuted labels."""
    return PR.null_position(_refits(spark, sf, "y_true", forest(), FEATURES), "macro_f1", ["fold"])


LINES = ("ndvi", "ndbi", "ndmi", "bsi", "vegetation_cover")


def stability(runs, first, names):
    """Tiers of agreement of stored runs, put side by side on the cell by one groupBy."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate([first, *[n for n in names if n != first]]) for x in (m, i)])
    cells = runs.predictions.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct(order[c("model")].alias("i"), "y_pred"))).alias("_r"))
    return MM.agreement_tiers(cells.select(F.transform("_r", lambda x: x["y_pred"]).alias("runs")))


@query("ml14_prediction_stability", f"""
WITH {_HELD}, th AS (SELECT year, quantile_cont(lst_c, 1.0/3) AS t1, quantile_cont(lst_c, 2.0/3) AS t2 FROM tr GROUP BY year),
lr AS (SELECT {', '.join(f'regr_slope(lst_c, {x}) AS b_{x}, regr_intercept(lst_c, {x}) AS a_{x}' for x in LINES)} FROM tr),
r AS (SELECT [{', '.join(f'CAST(a_{x} + b_{x} * {x} >= t1 AS INT) + CAST(a_{x} + b_{x} * {x} >= t2 AS INT)' for x in LINES)}] AS runs FROM va JOIN th ON th.year = va.year, lr),
a AS (SELECT y.*, len(list_filter(runs, lambda x: x = runs[1])) AS agree, len(list_filter(runs, lambda x: (x = 2) = (runs[1] = 2))) AS hot_agree FROM r y)
SELECT kind, cls, tier, n, round(n * 100.0 / sum(n) OVER (PARTITION BY kind, cls), 6) AS percent FROM (
  SELECT 'overall' AS kind, -1 AS cls, {{_TIER}} AS tier, count(*) AS n FROM a GROUP BY 3
  UNION ALL SELECT 'per_class', runs[1], {{_TIER}}, count(*) FROM a GROUP BY 2, 3
  UNION ALL SELECT 'hotspot', -1, {{_HOT}}, count(*) FROM a GROUP BY 3)""".replace("{_TIER}", _TIER).replace("{_HOT}", _TIER.replace("agree", "hot_agree")), "domain")
def _(spark, sf):
    """Five real runs, one line per predictor, predicted on the held-out blocks."""
    fits = {x: line((x,)) for x in LINES}
    return stability(PR.run(V.domain(spark, sf), PR.holdout_split("block_id", V.HELD_OUT), fits, LINES), LINES[0], LINES)


@query("ml14_seed_stability")
def _(spark, sf):
    """Five forests that differ in nothing but their seed."""
    fits = {f"seed_{s}": forest(seed=s) for s in (42, 7, 123, 2024, 99)}
    return stability(PR.run(V.domain(spark, sf), PR.holdout_split("block_id", V.HELD_OUT), fits, FEATURES), "seed_42", list(fits))


@query("ml15_grid_ablation")
def _(spark, sf):
    """Seeds, regularisation, feature sets and left-out training years, each a fit against the same held-out blocks."""
    d, split = V.domain(spark, sf), PR.holdout_split("block_id", V.HELD_OUT)
    fits = {"base": forest(), "seed_7": forest(seed=7), "seed_123": forest(seed=123), "shallow": forest(depth=3), "deep": forest(depth=10),
            "leaf_20": forest(leaf=20), "no_distance": forest(features=FEATURES[:5]), "distance_only": forest(features=FEATURES[5:])}
    grid = VL.class_metrics(PR.run(d, split, fits, FEATURES).predictions, ["model", "variant"], per_class=False)
    years = {f"without_{y}": PR.without(y) for y in range(2022, 2027)}
    ablated = VL.class_metrics(PR.run(d, split, {"base": forest()}, FEATURES, variants=years).predictions, ["model", "variant"], per_class=False)
    return grid.unionByName(ablated)
