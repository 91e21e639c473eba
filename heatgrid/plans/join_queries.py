"""Joins and spatial relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.operators import spatial as S
from heatgrid.operators import weather as M
from heatgrid.plans import views as V
from heatgrid.plans.cell_queries import LAT0, LON0, res_of
from heatgrid.plans.ctes import cte
from heatgrid.plans.registry import query
from heatgrid.sources.tables import table

c = F.col
K = ["year", "row", "col"]


@query("joi1_attach_static", """
SELECT c.year, c.row, c.col, lst_c, landuse_class, round(dist_road_m, 6) AS dist_road_m,
  round(dist_vegetation_m, 6) AS dist_vegetation_m FROM cells c JOIN cells_static s ON c.row = s.row AND c.col = s.col
""", "cells cells_static")
def _(spark, sf):
    return V.cells(spark, sf).join(V.cells_static(spark, sf), ["row", "col"]).select(
        *K, "lst_c", "landuse_class", "dist_road_m", "dist_vegetation_m")


@query("joi2_join_predictions", """
SELECT p.year, count(*) AS n, count(*) FILTER (WHERE c.lst_c IS NULL) AS n_unmatched, round(avg(c.lst_c), 6) AS mean_lst
FROM classed p LEFT JOIN cells c ON p.year = c.year AND p.row = c.row AND p.col = c.col GROUP BY p.year""", "classed cells")
def _(spark, sf):
    p = V.classed(spark, sf).select(*K, "y_pred")
    return p.join(V.cells(spark, sf).select(*K, "lst_c"), K, "left").groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("lst_c").isNull()).alias("n_unmatched"),
        F.avg("lst_c").alias("mean_lst"))


@query("joi3_merge_features", """
SELECT c.year, c.row, c.col, c.ndvi, s.landuse_class, p.confidence, m.mode_count FROM cells c
JOIN cells_static s ON c.row = s.row AND c.col = s.col
JOIN classed p ON p.year = c.year AND p.row = c.row AND p.col = c.col
JOIN modes m ON m.year = c.year AND m.row = c.row AND m.col = c.col""", "cells cells_static classed modes")
def _(spark, sf):
    from heatgrid.operators.composite import mode_composite
    return (
        V.cells(spark, sf).select(*K, "ndvi")
        .join(V.classed(spark, sf).select(*K, "confidence"), K)
        .join(mode_composite(V.scene_obs(spark, sf), "lulc").select(*K, "mode_count"), K)
        .join(V.cells_static(spark, sf).select("row", "col", "landuse_class"), ["row", "col"]))


@query("joi4_reconcile", """
SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col,
  CASE WHEN a.row IS NULL THEN 'right_only' WHEN b.row IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT * FROM domain WHERE year = 2022) a FULL JOIN (SELECT * FROM domain WHERE year = 2026) b
  ON a.row = b.row AND a.col = b.col""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf)
    a = d.where("year = 2022").select("row", "col", F.lit(1).alias("a"))
    b = d.where("year = 2026").select("row", "col", F.lit(1).alias("b"))
    side = F.when(c("a").isNull(), "right_only").when(c("b").isNull(), "left_only").otherwise("both")
    return a.join(b, ["row", "col"], "full_outer").select("row", "col", side.alias("side"))


@query("joi5_holdout_split", """
SELECT year, block_id, CASE WHEN block_id IN (2, 9, 15, 23) THEN 'locked' ELSE 'development' END AS part,
  (dense_rank() OVER (PARTITION BY year ORDER BY block_id) - 1) % 6 = 2 AS derived_locked, count(*) AS n
FROM domain GROUP BY year, block_id""", "domain")
def _(spark, sf):
    from pyspark.sql.window import Window as W
    d = V.domain(spark, sf).select("year", "block_id")
    locked = spark.createDataFrame([(b,) for b in V.HELD_OUT], "block_id int")
    parts = d.join(F.broadcast(locked), "block_id", "left_semi").withColumn("part", F.lit("locked")).unionByName(
        d.join(F.broadcast(locked), "block_id", "left_anti").withColumn("part", F.lit("development")))
    n = parts.groupBy("year", "block_id", "part").agg(F.count(F.lit(1)).alias("n"))
    rank = F.dense_rank().over(W.partitionBy("year").orderBy("block_id"))
    return n.withColumn("derived_locked", (rank - 1) % 6 == 2)


cte("met_hourly", "", """
SELECT CAST(user_id % 16 AS INT) AS point_id, 28.40 + (user_id % 16 // 4) * 0.16 AS lat,
  76.83 + (user_id % 4) * 0.1733 AS lon, ts AS time_utc, value / 10 AS temperature_2m, value % 100 AS relative_humidity_2m,
  value % 20 AS wind_speed_10m, value % 7 AS precipitation, value * 3 AS shortwave_radiation, value / 1000 AS soil_moisture
FROM events
""")
MET = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "precipitation", "shortwave_radiation", "soil_moisture"]
MET_OUT = ["met_t2m_c", "met_rh_pct", "met_wind_kmh", "met_precip_mm", "met_ssr_wm2", "met_swc_m3m3"]
cte("met_points", "met_hourly", f"""
SELECT year(time_utc) AS met_year, point_id, lat, lon, {', '.join(f'avg({v}) AS {v}' for v in MET)}, count(*) AS n
FROM met_hourly WHERE hour(time_utc) IN (4, 5, 6) AND month(time_utc) = 1 GROUP BY ALL
""")


def met_hourly(spark, sf, *more):
    e = table(spark, sf, "events")
    p, v = c("user_id") % 16, c("value")
    return e.select(
        p.cast("int").alias("point_id"), (F.lit(28.40) + F.floor(p / 4) * 0.16).alias("lat"),
        (F.lit(76.83) + (p % 4) * 0.1733).alias("lon"), c("ts").alias("time_utc"), (v / 10).alias("temperature_2m"),
        (v % 100).alias("relative_humidity_2m"), (v % 20).alias("wind_speed_10m"), (v % 7).alias("precipitation"),
        (v * 3).alias("shortwave_radiation"), (v / 1000).alias("soil_moisture"), *more)


def met_points(spark, sf):
    return M.met_window(met_hourly(spark, sf), MET, hours=(4, 5, 6), months=(1,))


def met_fields(spark, sf):
    """Weather at every grid cell; the fixture's stations report one year, so the year is dropped."""
    r = res_of(V.side(spark, sf))
    grid = V.lattice(spark, sf).select(
        "row", "col", C.centre(c("col"), LON0, r).alias("lon"), C.centre(c("row"), LAT0, -r).alias("lat"),
        F.lit(2024).alias("met_year"))
    out = S.idw(grid, met_points(spark, sf), MET, ["met_year"])
    return out.select("row", "col", *[c(a).alias(b) for a, b in zip(MET, MET_OUT)])


_W = "(1.0 / (pow(g.lat - p.lat, 2) + pow(cos(radians(28.64)) * (g.lon - p.lon), 2) + 1e-6))"


@query("joi6_idw", f"""
WITH g AS (SELECT row, col, {LON0} + (col + 0.5) * (0.52 / side) AS lon, {LAT0} - (row + 0.5) * (0.52 / side) AS lat
  FROM lattice, grid)
SELECT row, col, {', '.join(f'round(sum({_W} * {v}) / sum({_W}), 6) AS {o}' for v, o in zip(MET, MET_OUT))}
FROM g, met_points p GROUP BY row, col""", "lattice grid met_points")
def _(spark, sf):
    return met_fields(spark, sf)


cte("met_year_points", "", f"""
SELECT CAST(2022 + event_id % 5 AS INT) AS year, CAST(user_id % 16 AS INT) AS point_id, 28.40 + (user_id % 16 // 4) * 0.16 AS lat, 76.83 + (user_id % 4) * 0.1733 AS lon,
  avg(value / 10) AS temperature_2m, avg(value % 100) AS relative_humidity_2m, avg(value % 20) AS wind_speed_10m, avg(value % 7) AS precipitation,
  avg(value * 3) AS shortwave_radiation, avg(value / 1000) AS soil_moisture
FROM events WHERE hour(ts) IN (4, 5, 6) AND month(ts) = 1 GROUP BY ALL
""")


def met_year_points(spark, sf):
    """Station means by year. The fixture's readings are of one year: each is dealt to one of the five by its number."""
    e = met_hourly(spark, sf, (c("event_id") % 5 + 2022).cast("int").alias("year"))
    at = F.hour("time_utc").isin(4, 5, 6) & (F.month("time_utc") == 1)
    return e.where(at).groupBy("year", "point_id", "lat", "lon").agg(*[F.avg(n).alias(n) for n in MET])


def with_weather(spark, sf, cells):
    """Every cell with its own year's weather. Stations reach the cells as one array a year: cells are not shuffled for it."""
    r = res_of(V.side(spark, sf))
    placed = cells.withColumns({"lon": C.centre(c("col"), LON0, r), "lat": C.centre(c("row"), LAT0, -r)})
    out = S.idw(placed, met_year_points(spark, sf), MET, ["year"]).drop("lon", "lat")
    return out.withColumnsRenamed(dict(zip(MET, MET_OUT)))


@query("joi6_idw_by_year", f"""
WITH g AS (SELECT year, row, col, {LON0} + (col + 0.5) * (0.52 / side) AS lon, {LAT0} - (row + 0.5) * (0.52 / side) AS lat FROM cells, grid)
SELECT g.year, row, col, {', '.join(f'round(sum({_W} * {v}) / sum({_W}), 6) AS {o}' for v, o in zip(MET, MET_OUT))}
FROM g JOIN met_year_points p ON p.year = g.year GROUP BY g.year, row, col""", "cells grid met_year_points")
def _(spark, sf):
    return with_weather(spark, sf, V.cells(spark, sf).select(*K))


cte("fine", "grid", """
SELECT year, row3, col3, avg(v) AS v, max(label) AS label, bool_or(ok) AS ok FROM (
  SELECT CAST(2022 + (year(l_shipdate) - 1995) % 5 AS INT) AS year,
    CAST((l_orderkey % (side * side)) // side * 3 + l_linenumber % 3 AS INT) AS row3,
    CAST((l_orderkey % (side * side)) % side * 3 + CAST(l_quantity AS BIGINT) % 3 AS INT) AS col3,
    CASE WHEN l_partkey % 10 > 1 THEN 0.1 + l_quantity / 100 END AS v, CAST(l_suppkey % 9 AS INT) AS label,
    l_partkey % 10 > 1 AS ok FROM lineitem, grid) GROUP BY ALL
""")


def fine(spark, sf):
    """A source grid three times finer than the cells, with gaps."""
    n = V.side(spark, sf)
    ok = c("l_partkey") % 10 > 1
    d = table(spark, sf, "lineitem").select(
        (F.lit(2022) + (F.year("l_shipdate") - 1995) % 5).alias("year"),
        F.expr(f"cast((l_orderkey % {n * n}) div {n} * 3 + l_linenumber % 3 as int)").alias("row"),
        F.expr(f"cast((l_orderkey % {n * n}) % {n} * 3 + cast(l_quantity as bigint) % 3 as int)").alias("col"),
        F.when(ok, F.lit(0.1) + c("l_quantity") / 100).alias("v"), (c("l_suppkey") % 9).cast("int").alias("label"),
        ok.alias("ok"))
    return d.groupBy("year", "row", "col").agg(
        F.avg("v").alias("v"), F.max("label").alias("label"), F.bool_or("ok").alias("ok"))


_THIRD, _SHIFT = 1.0 / 3.0, 0.5
_PAIRS = """
e AS (SELECT *, (row3 + 0.5) * (1.0 / 3.0) AS rl, (row3 + 0.5 + 1) * (1.0 / 3.0) AS rh,
  (col3 + 0.5) * (1.0 / 3.0) AS cl, (col3 + 0.5 + 1) * (1.0 / 3.0) AS ch FROM fine),
x AS (SELECT *, unnest(generate_series(CAST(floor(rl) AS INT), CAST(ceil(rh) - 1 AS INT))) AS dr FROM e),
y AS (SELECT *, unnest(generate_series(CAST(floor(cl) AS INT), CAST(ceil(ch) - 1 AS INT))) AS dc FROM x),
z AS (SELECT *, (least(rh, dr + 1) - greatest(rl, dr)) * (least(ch, dc + 1) - greatest(cl, dc)) AS w FROM y)"""


@query("joi7_resample_average", f"""
WITH {_PAIRS} SELECT year, CAST(dr AS INT) AS row, CAST(dc AS INT) AS col, round(CASE WHEN
  sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) > 1e-6 THEN
  sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) END, 6) AS v FROM z GROUP BY year, dr, dc""", "fine")
def _(spark, sf):
    return S.resample_average(fine(spark, sf), "v", _THIRD, (_SHIFT, _SHIFT))


@query("joi8_resample_nearest", """
SELECT f.year, l.row, l.col, f.label FROM lattice l JOIN fine f
  ON f.row3 = l.row * 3 + 1 AND f.col3 = l.col * 3 + 1""", "lattice fine")
def _(spark, sf):
    d = fine(spark, sf).select("year", "row", "col", "label")
    return S.resample_nearest(d, V.lattice(spark, sf).select("row", "col"), 1.0 / 3.0)


@query("joi9_resample_valid", f"""
WITH {_PAIRS} SELECT year, CAST(dr AS INT) AS row, CAST(dc AS INT) AS col, bool_or(ok) AS valid FROM z
WHERE w > 1e-6 GROUP BY year, dr, dc""", "fine")
def _(spark, sf):
    return S.resample_valid(fine(spark, sf), c("ok"), _THIRD, (_SHIFT, _SHIFT))


# One polygon per supplier: a triangle, a square, or a square with a square hole.
_SHAPES = {0: [[(-1.0, -1.0), (1.2, -0.6), (0.1, 1.3), (-1.0, -1.0)]],
           1: [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]],
           2: [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)],
               [(-0.4, -0.4), (-0.4, 0.4), (0.4, 0.4), (0.4, -0.4), (-0.4, -0.4)]]}
_ROWS = [(s, ring, pos, x, y) for s, rings in _SHAPES.items() for ring, pts in enumerate(rings)
         for pos, (x, y) in enumerate(pts)]
cte("vertices", "grid", f"""
SELECT s_suppkey AS feature, ring, pos, CAST(s_suppkey % 9 AS INT) AS value,
  (s_suppkey * 7919 % (side * side)) % side + 0.53 + dx * (1.3 + s_suppkey % 4) AS x,
  (s_suppkey * 7919 % (side * side)) // side + 0.47 + dy * (1.3 + s_suppkey % 4) AS y
FROM supplier JOIN (VALUES {', '.join(f'({s}, {r}, {p}, {x}::DOUBLE, {y}::DOUBLE)' for s, r, p, x, y in _ROWS)})
  t(shape, ring, pos, dx, dy) ON s_suppkey % 3 = shape, grid
""")
cte("poly_edges", "vertices", """
SELECT * FROM (SELECT feature, ring, value, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices
  WINDOW w AS (PARTITION BY feature, ring ORDER BY pos)) WHERE x2 IS NOT NULL
""")


def vertices(spark, sf):
    n = V.side(spark, sf)
    shapes = F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(r).alias("ring"), F.lit(p).alias("pos"),
                                F.lit(x).alias("dx"), F.lit(y).alias("dy")) for s, r, p, x, y in _ROWS])
    key = c("s_suppkey") * 7919 % (n * n)
    size = F.lit(1.3) + c("s_suppkey") % 4
    return (
        table(spark, sf, "supplier")
        .select("s_suppkey", F.explode(F.filter(shapes, lambda v: v["shape"] == c("s_suppkey") % 3)).alias("v"))
        .select(
            c("s_suppkey").alias("feature"), "v.ring", "v.pos", (c("s_suppkey") % 9).cast("int").alias("value"),
            (key % n + 0.53 + c("v.dx") * size).alias("x"),
            (F.expr(f"(s_suppkey * 7919 % {n * n}) div {n}") + 0.47 + c("v.dy") * size).alias("y")))


def edges(spark, sf):
    return S.ring_edges(vertices(spark, sf), ["feature", "ring"])


_INSIDE = """
ins AS (SELECT l.row, l.col, e.feature, any_value(e.value) AS value FROM lattice l JOIN poly_edges e
  ON l.row + 0.5 >= least(y1, y2) AND l.row + 0.5 < greatest(y1, y2)
  AND x1 + (l.row + 0.5 - y1) * (x2 - x1) / (y2 - y1) > l.col + 0.5
  GROUP BY l.row, l.col, e.feature HAVING count(*) % 2 = 1)"""


@query("joi10_rasterize_centre", f"""
WITH {_INSIDE} SELECT row, col, arg_max(value, feature) AS value FROM ins GROUP BY row, col""", "lattice poly_edges")
def _(spark, sf):
    n, v = V.side(spark, sf), vertices(spark, sf)
    values = v.where("ring = 0 and pos = 0").select("feature", "value")
    return S.rasterize_centre(edges(spark, sf).drop("value"), values, n, n)


@query("joi11_rasterize_touched", f"""
WITH {_INSIDE}, cutc AS (SELECT DISTINCT l.row, l.col FROM lattice l JOIN poly_edges e
  ON l.col <= greatest(x1, x2) AND l.col + 1 >= least(x1, x2) AND l.row <= greatest(y1, y2) AND l.row + 1 >= least(y1, y2)
  AND least((y2 - y1) * (l.col - x1) - (x2 - x1) * (l.row - y1), (y2 - y1) * (l.col + 1 - x1) - (x2 - x1) * (l.row - y1),
    (y2 - y1) * (l.col - x1) - (x2 - x1) * (l.row + 1 - y1), (y2 - y1) * (l.col + 1 - x1) - (x2 - x1) * (l.row + 1 - y1)) <= 0
  AND greatest((y2 - y1) * (l.col - x1) - (x2 - x1) * (l.row - y1), (y2 - y1) * (l.col + 1 - x1) - (x2 - x1) * (l.row - y1),
    (y2 - y1) * (l.col - x1) - (x2 - x1) * (l.row + 1 - y1), (y2 - y1) * (l.col + 1 - x1) - (x2 - x1) * (l.row + 1 - y1)) >= 0)
SELECT row, col FROM cutc UNION SELECT row, col FROM ins""", "lattice poly_edges")
def _(spark, sf):
    n = V.side(spark, sf)
    return S.rasterize_touched(edges(spark, sf), n, n)


@query("joi12_distance_to_feature", """
SELECT row, col, round(dist_road_m, 6) AS dist_road_m, round(dist_vegetation_m, 6) AS dist_vegetation_m,
  round(dist_building_m, 6) AS dist_building_m FROM cells_static""", "cells_static")
def _(spark, sf):
    return V.build_static(spark, sf).select("row", "col", "dist_road_m", "dist_vegetation_m", "dist_building_m")


@query("joi13_gap_fill_nearest", """
WITH g AS (SELECT year, row, col, CASE WHEN (row + col) % 4 <> 0 THEN lulc_class END AS label FROM dense),
k AS (SELECT * FROM g WHERE label IS NOT NULL)
SELECT a.year, a.row, a.col, arg_min(b.label, (abs(a.row - b.row) * abs(a.row - b.row) + abs(a.col - b.col) * abs(a.col - b.col))
  * 100000000::BIGINT + b.row * 10000 + b.col) AS label,
  CAST(min(abs(a.row - b.row) * abs(a.row - b.row) + abs(a.col - b.col) * abs(a.col - b.col)) AS DOUBLE) AS d2
FROM g a JOIN k b ON a.year = b.year AND b.row BETWEEN a.row - 9 AND a.row + 9 AND b.col BETWEEN a.col - 9 AND a.col + 9
GROUP BY a.year, a.row, a.col""", "dense")
def _(spark, sf):
    d = V.dense(spark, sf).select(
        *K, F.when((c("row") + c("col")) % 4 != 0, c("lulc_class")).alias("label"))
    return S.gap_fill_nearest(d, "label")


_FOLD = "CAST(block_id % 5 AS INT)"


@query("joi14_nearest_training_distance", f"""
WITH d AS (SELECT *, {_FOLD} AS fold FROM classed),
n AS (SELECT a.year, a.row, a.col, any_value(a.y_true = a.y_pred) AS hit,
  sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))) * 30.0 AS dist
  FROM d a JOIN d b ON a.year = b.year AND a.fold <> b.fold GROUP BY a.year, a.row, a.col)
SELECT year, CASE WHEN dist < 500 THEN '0-500m' WHEN dist < 1000 THEN '500-1000m' WHEN dist < 2000 THEN '1000-2000m'
  ELSE '>2000m' END AS band, count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS accuracy, round(avg(dist), 6) AS mean_dist
FROM n GROUP BY ALL""", "classed")
def _(spark, sf):
    d = V.classed(spark, sf).select(*K, (c("block_id") % 5).alias("own"), (c("y_true") == c("y_pred")).alias("hit"))
    # Training cells of a fold are those of the other four: keys only, the cells themselves are not copied.
    others = F.filter(F.array(*[F.lit(i) for i in range(5)]), lambda k: k != c("own"))
    train = d.select(*K, F.explode(others).alias("fold"))
    d = d.withColumn("fold", c("own").cast("int"))
    far = S.distance_to(d, S.facing(d, train, ["year", "fold"]), "dist", ["year", "fold"])
    band = C.bands_text(c("dist"), [500, 1000, 2000], ["0-500m", "500-1000m", "1000-2000m", ">2000m"])
    return far.groupBy("year", band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c("hit").cast("int")).alias("accuracy"), F.avg("dist").alias("mean_dist"))


cte("knn8", "classed", """
SELECT * FROM (SELECT a.year, a.row, a.col, b.row AS n_row, b.col AS n_col,
  (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) AS d2,
  CAST(row_number() OVER (PARTITION BY a.year, a.row, a.col ORDER BY (a.row - b.row) * (a.row - b.row)
    + (a.col - b.col) * (a.col - b.col), b.row, b.col) AS INT) AS k
  FROM classed a JOIN classed b ON a.year = b.year AND b.row BETWEEN a.row - 7 AND a.row + 7
    AND b.col BETWEEN a.col - 7 AND a.col + 7 AND (a.row <> b.row OR a.col <> b.col)) WHERE k <= 8
""")


@query("joi15_knn", "SELECT year, row, col, k, n_row, n_col, d2 FROM knn8", "knn8")
def _(spark, sf):
    return S.knn(V.classed(spark, sf).select(*K), 8)


def _area_sql():
    e = []
    for i, (dr, dc) in enumerate([(0, 0), (0, 1), (1, 1), (1, 0)]):
        x, y = S.utm_expr(f"({LAT0} - (row + {dr}) * r)", f"({LON0} + (col + {dc}) * r)")
        e.append(f"{x} AS e{i}, {y} AS n{i}")
    twice = " + ".join(f"(e{i} - e0) * (n{j} - n0) - (e{j} - e0) * (n{i} - n0)" for i, j in ((1, 2), (2, 3)))
    return f"""SELECT row, col, round(abs({twice}) / 2, 2) AS area_m2 FROM (
      SELECT row, col, {', '.join(e)} FROM (SELECT *, 0.52 / side AS r FROM lattice, grid))"""


@query("joi16_cell_area_m2", _area_sql(), "lattice grid", digits=2)
def _(spark, sf):
    return S.cell_area_m2(V.lattice(spark, sf).select("row", "col"), LON0, LAT0, res_of(V.side(spark, sf)))


@query("joi16_area_of_cells", f"""
SELECT c.year, c.row, c.col, a.* EXCLUDE (row, col) FROM cells c JOIN ({_area_sql()}) a ON a.row = c.row AND a.col = c.col""", "cells lattice grid", digits=2)
def _(spark, sf):
    """Ground area of the stored cells; a row of the grid has one area, so it is a column expression."""
    return S.cell_area_m2(V.cells(spark, sf).select(*K), LON0, LAT0, res_of(V.side(spark, sf)))


@query("joi17_polygon_area", """
WITH r AS (SELECT feature, ring, abs(sum(x1 * y2 - x2 * y1) / 2) AS a, avg(y1) AS lat FROM (
  SELECT feature, ring, 76.8 + x1 * 0.001 AS x1, 28.4 + y1 * 0.001 AS y1, 76.8 + x2 * 0.001 AS x2, 28.4 + y2 * 0.001 AS y2
  FROM poly_edges) GROUP BY feature, ring)
SELECT feature, round(sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * a * 111.32 * 111.32 * cos(radians(lat))), 4) + 0 AS area_km2,
  count(*) AS n_rings FROM r GROUP BY feature""", "poly_edges", digits=4)
def _(spark, sf):
    v = vertices(spark, sf).withColumn("x", F.lit(76.8) + c("x") * 0.001).withColumn("y", F.lit(28.4) + c("y") * 0.001)
    return S.polygon_area_km2(v.drop("value"))


cte("transitions", "domain", """
SELECT a.year AS start_year, b.year AS end_year, a.row, a.col, a.block_id, a.lst_c AS current_lst, b.lst_c AS next_lst,
  a.ndvi, a.ndbi, a.vegetation_cover, a.landuse_class, a.dist_road_m, a.dist_vegetation_m, a.dist_building_m,
  round(b.lst_c - a.lst_c, 6) AS delta_lst, round(b.vegetation_cover - a.vegetation_cover, 6) AS vegetation_change
FROM domain a JOIN domain b ON b.year = a.year + 1 AND a.row = b.row AND a.col = b.col
""")


def transitions(spark, sf):
    """Each cell beside itself one year on."""
    d = V.domain(spark, sf)
    nxt = d.select((c("year") - 1).alias("year"), "row", "col", c("lst_c").alias("next_lst"),
                   c("vegetation_cover").alias("_nv"))
    return d.join(nxt, K).select(
        c("year").alias("start_year"), (c("year") + 1).alias("end_year"), "row", "col", "block_id",
        c("lst_c").alias("current_lst"), "next_lst", "ndvi", "ndbi", "vegetation_cover", "landuse_class",
        "dist_road_m", "dist_vegetation_m", "dist_building_m",
        F.round(c("next_lst") - c("lst_c"), 6).alias("delta_lst"),
        F.round(c("_nv") - c("vegetation_cover"), 6).alias("vegetation_change"))


@query("joi18_year_transition", """
SELECT start_year, end_year, row, col, current_lst, next_lst, delta_lst + 0 AS delta_lst, vegetation_change + 0 AS vegetation_change
FROM transitions""", "transitions")
def _(spark, sf):
    return transitions(spark, sf).select(
        "start_year", "end_year", "row", "col", "current_lst", "next_lst", "delta_lst", "vegetation_change")


@query("joi20_clip_bbox", """
SELECT kept, count(*) AS n FROM (SELECT feature, max(x) >= 0.2 * any_value(side) - 0.01 AND min(x) <= 0.7 * any_value(side) + 0.01
  AND max(y) >= 0.2 * any_value(side) - 0.01 AND min(y) <= 0.7 * any_value(side) + 0.01 AS kept FROM vertices, grid GROUP BY feature)
GROUP BY kept""", "vertices grid")
def _(spark, sf):
    n = V.side(spark, sf)
    boxes = vertices(spark, sf).groupBy("feature").agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return S.clip_bbox(boxes, (0.2 * n, 0.2 * n, 0.7 * n, 0.7 * n)).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))
