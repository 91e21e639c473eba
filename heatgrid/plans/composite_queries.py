"""Compositing: many scenes to one value per pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.operators import composite as K
from heatgrid.operators.quantiles import exact_quantiles_long
from heatgrid.plans import views as V
from heatgrid.plans.registry import query

_R = ", ".join(f"round({b}, 6) AS {b}" for b in ("st_b10", "b2", "b3", "b4", "b5", "b6", "b8", "b8a", "b11"))


@query("cmp1_median_composite", f"SELECT year, row, col, {_R} FROM composites", "composites")
def _(spark, sf):
    return V.composites(spark, sf).drop("clear_count")


@query("cmp2_clear_count", """
SELECT year, row, col, count(CASE WHEN (qa & 24) = 0 THEN st_b10 END) AS clear_count
FROM scene_obs GROUP BY ALL""", "scene_obs")
def _(spark, sf):
    clear = F.when(C.qa_clear(F.col("qa")), F.col("st_b10"))
    return V.scene_obs(spark, sf).groupBy(*K.PIXEL).agg(F.count(clear).alias("clear_count"))


@query("cmp3_mode_composite", "SELECT * FROM modes", "modes")
def _(spark, sf):
    return K.mode_composite(V.scene_obs(spark, sf), "lulc", out="lulc_class")


_SCENES = """
SELECT year, scene_id, CAST(ts AS DATE) AS day, min(cloud_pct) AS cloud_pct, count(*) AS n_px
FROM scene_obs GROUP BY year, scene_id, CAST(ts AS DATE)"""


@query("cmp4_scene_filter", f"""
SELECT * FROM ({_SCENES}) WHERE month(day) * 100 + day(day) BETWEEN 501 AND 630 AND cloud_pct < 20
""", "scene_obs")
def _(spark, sf):
    return K.scene_filter(K.scene_table(V.scene_obs(spark, sf)), (5, 1), (6, 30), 20)


@query("cmp5_best_scene", f"""
SELECT year, scene_id, cloud_pct FROM (SELECT *, row_number() OVER (
  PARTITION BY year ORDER BY cloud_pct, scene_id) AS k FROM ({_SCENES})) WHERE k = 1""", "scene_obs")
def _(spark, sf):
    return K.best_scene(K.scene_table(V.scene_obs(spark, sf)))


@query("cmp6_dedupe_scenes", f"""
SELECT tile, day, scene_id, cloud_pct FROM (SELECT *, row_number() OVER (
  PARTITION BY tile, day ORDER BY cloud_pct, scene_id) AS k
  FROM (SELECT *, CAST(scene_id % 4 AS INT) AS tile FROM ({_SCENES}))) WHERE k = 1""", "scene_obs")
def _(spark, sf):
    scenes = K.scene_table(V.scene_obs(spark, sf))
    return K.dedupe_scenes(scenes, (F.col("scene_id") % 4).cast("int"))


@query("cmp7_export_guard", """
SELECT year, count(*) AS n_cells, round(count(*) / (side * side * 1.0), 6) AS coverage,
       count(*) / (side * side * 1.0) >= 0.5 AS ok
FROM modes, grid GROUP BY year, side""", "modes grid")
def _(spark, sf):
    n = V.side(spark, sf)
    return K.export_guard(K.mode_composite(V.scene_obs(spark, sf), "lulc"), n * n)


@query("cmp8_class_histogram", """
SELECT year, in_study, lulc_class, count(*) AS n FROM cells GROUP BY ALL""", "cells")
def _(spark, sf):
    return K.class_histogram(V.cells(spark, sf), "lulc_class", ["year", "in_study"])


WINDOWS = {"W0": ((7, 1), (7, 31)), "W1": ((4, 1), (5, 31)), "W2": ((5, 1), (5, 31)),
           "W3": ((6, 1), (6, 30)), "W4": ((5, 1), (6, 30))}
_WIN_SQL = " UNION ALL ".join(
    f"SELECT '{w}' AS win, {a[0] * 100 + a[1]} AS a, {b[0] * 100 + b[1]} AS z" for w, (a, b) in WINDOWS.items())

_ACC_SQL = f"""
acc AS (SELECT win, year, row, col, count(x) AS n, sum(x) AS total, sum(x * x) AS total_sq, min(x) AS lo, max(x) AS hi
  FROM (SELECT w.win, s.*, CASE WHEN (qa & 24) = 0 THEN st_b10 * 0.00341802 + 149.0 - 273.15 END AS x
        FROM scene_obs s JOIN ({_WIN_SQL}) w ON month(ts) * 100 + day(ts) BETWEEN a AND z)
  GROUP BY win, year, row, col)"""


def accumulators(spark, sf):
    obs = V.scene_obs(spark, sf).withColumn("win", F.explode(C.season_windows(F.col("ts"), WINDOWS)))
    return K.cell_accumulators(
        obs, ["win", "year", "row", "col"], C.lst_c(F.col("st_b10")), C.qa_clear(F.col("qa")))


@query("cmp9_cell_accumulators", f"""
WITH {_ACC_SQL}
SELECT win, year, row, col, n, round(total, 6) AS total, round(total_sq, 6) AS total_sq, round(lo, 6) AS lo,
       round(hi, 6) AS hi FROM acc""", "scene_obs")
def _(spark, sf):
    return accumulators(spark, sf)


@query("cmp10_window_metrics", f"""
WITH {_ACC_SQL},
m AS (SELECT *, total / n AS mean, CASE WHEN n >= 2 THEN
        sqrt(greatest(total_sq / n - (total / n) * (total / n), 0)) END AS inter FROM acc WHERE n > 0),
px AS (SELECT win, year, count(*) AS n_px, count(*) / (min(side) * min(side) * 1.0) AS cover1,
        count(*) FILTER (WHERE n >= 2) / (min(side) * min(side) * 1.0) AS cover2, avg(mean) AS mean_lst,
        stddev_pop(mean) AS std_lst, quantile_cont(mean, 0.05) AS p05, quantile_cont(mean, 0.95) AS p95,
        avg(inter) AS mean_interscene_std FROM m, grid GROUP BY win, year),
sc AS (SELECT DISTINCT win, year, scene_id, CAST(ts AS DATE) AS day, cloud_pct, scene_id % 2 AS platform
       FROM scene_obs JOIN ({_WIN_SQL}) w ON month(ts) * 100 + day(ts) BETWEEN a AND z),
ss AS (SELECT win, year, count(*) AS n_scenes, stddev_pop(dayofyear(day)) AS doy_std, min(cloud_pct) AS cloud_min,
        quantile_cont(CAST(cloud_pct AS DOUBLE), 0.5) AS cloud_median, max(cloud_pct) AS cloud_max,
        count(*) FILTER (WHERE platform = 0) AS n_platform_0, count(*) FILTER (WHERE platform = 1) AS n_platform_1
       FROM sc GROUP BY win, year)
SELECT px.win, px.year, n_px, round(cover1, 6) AS cover1, round(cover2, 6) AS cover2, round(mean_lst, 6) AS mean_lst,
  round(std_lst, 6) AS std_lst, round(p05, 6) AS p05, round(p95, 6) AS p95,
  round(mean_interscene_std, 4) AS mean_interscene_std, n_scenes, round(doy_std, 6) AS doy_std, cloud_min,
  round(cloud_median, 6) AS cloud_median, cloud_max, n_platform_0, n_platform_1
FROM px JOIN ss ON px.win = ss.win AND px.year = ss.year""", "scene_obs grid")
def _(spark, sf):
    n2 = float(V.side(spark, sf) ** 2)
    mean = F.col("total") / F.col("n")
    m = (
        accumulators(spark, sf).where("n > 0").withColumn("v", mean)
        .withColumn("inter", F.when(F.col("n") >= 2, F.sqrt(F.greatest(
            F.col("total_sq") / F.col("n") - mean * mean, F.lit(0.0)))))
    )
    px = m.groupBy("win", "year").agg(
        F.count(F.lit(1)).alias("n_px"), (F.count(F.lit(1)) / n2).alias("cover1"),
        (F.count_if(F.col("n") >= 2) / n2).alias("cover2"), F.avg("v").alias("mean_lst"),
        F.stddev_pop("v").alias("std_lst"), F.round(F.avg("inter"), 4).alias("mean_interscene_std"))
    pq = exact_quantiles_long(m, ["win", "year"], [0.05, 0.95]).select(
        "win", "year", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))
    scenes = (
        V.scene_obs(spark, sf).select(
            F.explode(C.season_windows(F.col("ts"), WINDOWS)).alias("win"), "year", "scene_id",
            F.to_date("ts").alias("day"), "cloud_pct", (F.col("scene_id") % 2).cast("int").alias("platform")).distinct()
    )
    base = scenes.groupBy("win", "year").agg(
        F.count(F.lit(1)).alias("n_scenes"), F.stddev_pop(F.dayofyear("day")).alias("doy_std"),
        F.min("cloud_pct").alias("cloud_min"), F.max("cloud_pct").alias("cloud_max"))
    cq = exact_quantiles_long(scenes.withColumn("v", F.col("cloud_pct").cast("double")), ["win", "year"], [0.5])
    plat = (
        scenes.withColumn("p", F.concat(F.lit("n_platform_"), F.col("platform"))).groupBy("win", "year")
        .pivot("p", ["n_platform_0", "n_platform_1"]).count().na.fill(0)
    )
    k = ["win", "year"]
    return (
        px.join(pq, k).join(base, k).join(cq.select(*k, F.col("q")[0].alias("cloud_median")), k).join(plat, k)
    )
