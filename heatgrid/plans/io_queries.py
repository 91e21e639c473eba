"""Sources, sinks, weather series, map elements and quality gates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators import checks as Q
from heatgrid.operators import components as G
from heatgrid.operators import osm as OS
from heatgrid.operators import rings as RG
from heatgrid.operators import spatial as SP
from heatgrid.operators import weather as M
from heatgrid.operators.overlap import upsert_section
from heatgrid.plans import views as V
from heatgrid.plans.cell_queries import LAT0, LON0, res_of
from heatgrid.plans.ctes import cte
from heatgrid.plans.join_queries import MET, met_hourly, met_points, vertices
from heatgrid.plans.registry import query
from heatgrid.plans.scoring_views import hot_labels, scored
from heatgrid.plans.zone_queries import hot_rings, site_table, zone_table
from heatgrid.session import checkpoint_root
from heatgrid.sources import products as P
from heatgrid.sources.tables import table

c = F.col
K = ["year", "row", "col"]


def scratch(spark, sf, name):
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{sf.strip('/').replace('/', '_')}/io_{name}"


@query("src1_read_cells", "SELECT row, col, year, lst_c, ndvi FROM cells WHERE year IN (2023, 2025)", "cells")
def _(spark, sf):
    path = scratch(spark, sf, "cells")
    P.write_cells(V.cells(spark, sf), path)
    return P.read_cells(spark, path, [2023, 2025]).select("row", "col", "year", "lst_c", "ndvi")


@query("src2_read_static", "SELECT row, col, landuse_class FROM cells_static", "cells_static")
def _(spark, sf):
    raw = V.cells_static(spark, sf).withColumn("landuse_class", F.coalesce("landuse_class", F.lit(255)))
    return P.read_static(raw).select("row", "col", "landuse_class")


@query("src3_read_met", "SELECT point_id, round(lat, 6) AS lat, round(lon, 6) AS lon, time_utc, round(temperature_2m, 6) AS temperature_2m, round(precipitation, 6) AS precipitation FROM met_hourly", "met_hourly")
def _(spark, sf):
    path = scratch(spark, sf, "met")
    P.write_table(P.require(met_hourly(spark, sf), P.MET_SCHEMA), path, "csv")
    return P.read_met(spark, path)


@query("src4_read_predictions", """
SELECT p.year, p.row, p.col, p.y_true, p.y_pred, c.lst_c, true AS guard_ok FROM classed p JOIN cells c ON c.year = p.year AND c.row = p.row AND c.col = p.col""", "classed cells")
def _(spark, sf):
    p = V.classed(spark, sf).select(*K, "y_true", "y_pred", F.lit("rule").alias("model"))
    return P.read_predictions(p, V.cells(spark, sf), "rule", (0.2, 0.9)).drop("model")


@query("src6_file_inventory")
def _(spark, sf):
    return P.file_inventory(spark, sf)


@query("snk1_write_cells", "SELECT year, count(*) AS n FROM cells GROUP BY year", "cells")
def _(spark, sf):
    path = scratch(spark, sf, "snk1")
    P.write_cells(V.cells(spark, sf), path)
    return P.read_cells(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("snk2_densify", "SELECT year, row, col, coalesce(lst_c, -9999) AS lst_c FROM dense", "dense")
def _(spark, sf):
    return SP.fill_nodata(V.dense(spark, sf).select(*K, "lst_c"), {"lst_c": -9999.0})


@query("snk3_write_table", "SELECT year, block_id, count(*) AS n FROM domain GROUP BY ALL", "domain")
def _(spark, sf):
    path = scratch(spark, sf, "snk3")
    P.write_table(V.domain(spark, sf).groupBy("year", "block_id").agg(F.count(F.lit(1)).alias("n")), path, "json")
    return spark.read.schema("year int, block_id int, n bigint").json(path)


def zone_features(spark, sf):
    h, (pieces, rings) = hot_labels(spark, sf), hot_rings(spark, sf)
    r = res_of(V.side(spark, sf))
    zones = h.groupBy("year", "zone_id").agg(F.count(F.lit(1)).alias("n_px"))
    polygons = RG.multipolygons(pieces, rings, F.lit(LON0) + c("c") * r, F.lit(LAT0) - c("r") * r)
    return P.geojson_features(zones, polygons, ["year", "zone_id"], ["n_px"])


@query("snk4_zones_geojson")
def _(spark, sf):
    return zone_features(spark, sf)


@query("snk4_geojson_area", """
SELECT year, zone_id, count(*) AS n_px, round(count(*) * (0.52 / any_value(side)) * (0.52 / any_value(side)) * 1000000, 3) AS area, round(76.80 + min(col) * (0.52 / any_value(side)), 6) AS west,
  round(76.80 + (max(col) + 1) * (0.52 / any_value(side)), 6) AS east, round(28.92 - (max(row) + 1) * (0.52 / any_value(side)), 6) AS south, round(28.92 - min(row) * (0.52 / any_value(side)), 6) AS north
FROM hot_cells, grid GROUP BY year, zone_id""", "hot_cells grid", digits=6)
def _(spark, sf):
    """Written as JSON lines, read back and measured: outer rings less their holes, in millionths of a square degree, and the box."""
    path = scratch(spark, sf, "zones_geojson")
    zone_features(spark, sf).select("feature").write.mode("overwrite").text(path)
    kind = "struct<properties: struct<year: int, zone_id: int, n_px: bigint>, geometry: struct<type: string, coordinates: array<array<array<array<double>>>>>>"
    f = spark.read.text(path).select(F.from_json("value", kind).alias("f"))
    ring = f.select("f.properties.*", F.explode("f.geometry.coordinates").alias("_p")).select("year", "zone_id", "n_px", F.explode("_p").alias("_l"))
    # about a corner of its own, so that the products stay small beside their differences
    x, y = (lambda p: p[0] - c("_l")[0][0]), (lambda p: p[1] - c("_l")[0][1])
    step = F.zip_with(F.slice("_l", 1, F.size("_l") - 1), F.slice("_l", 2, F.size("_l") - 1), lambda p, q: x(q) * y(p) - x(p) * y(q))
    area = F.aggregate(step, F.lit(0.0), lambda a, v: a + v) / 2
    xs, ys = F.transform("_l", lambda p: p[0]), F.transform("_l", lambda p: p[1])
    return ring.groupBy("year", "zone_id", "n_px").agg(
        F.round(F.sum(area) * 1_000_000 + 1.2345e-6, 3).alias("area"), F.min(F.array_min(xs)).alias("west"), F.max(F.array_max(xs)).alias("east"),
        F.min(F.array_min(ys)).alias("south"), F.max(F.array_max(ys)).alias("north"))


@query("snk5_upsert_section", """
SELECT landuse_class AS section, count(*) AS n, round(avg(lst_c), 6) AS mean_lst FROM domain WHERE year = 2022 AND landuse_class IS NOT NULL AND landuse_class <> 3 GROUP BY ALL
UNION ALL SELECT 3, count(*), round(avg(lst_c), 6) FROM domain WHERE year = 2023 AND landuse_class = 3""", "domain")
def _(spark, sf):
    d = V.domain(spark, sf).where("landuse_class is not null")
    t = d.groupBy("year", c("landuse_class").alias("section")).agg(F.count(F.lit(1)).alias("n"), F.avg("lst_c").alias("mean_lst"))
    new = t.where("year = 2023 and section = 3").drop("year")
    once = upsert_section(t.where("year = 2022").drop("year"), "section", 3, new)
    return upsert_section(once, "section", 3, new)


@query("srv1_result_slice", "SELECT zone_id, pixels, round(mean_score, 6) AS mean_score FROM zone_table WHERE year = 2023 AND scenario = 'B'", "zone_table")
def _(spark, sf):
    return P.result_slice(zone_table(spark, sf), 2023, "B").select("zone_id", "pixels", "mean_score")


# --- weather ----------------------------------------------------------------------------------------

@query("met1_met_window", f"SELECT CAST(met_year AS INT) AS met_year, point_id, n, {', '.join(f'round({v}, 6) AS {v}' for v in MET)} FROM met_points", "met_points")
def _(spark, sf):
    return met_points(spark, sf).select("met_year", "point_id", "n", *MET)


@query("met2_daily_mean", "SELECT CAST(time_utc AS DATE) AS day, round(avg(temperature_2m), 6) AS temperature_2m, round(avg(precipitation), 6) AS precipitation FROM met_hourly GROUP BY 1", "met_hourly")
def _(spark, sf):
    return M.daily_mean(met_hourly(spark, sf), ["temperature_2m", "precipitation"])


cte("daily", "", """
SELECT CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INT) AS year, avg(o_totalprice) / 10000 AS tmax, (count(*) % 7) * 1.0::DOUBLE AS rain FROM orders GROUP BY 1, 2""")


def daily(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year")).agg(
        (F.avg("o_totalprice") / 10000).alias("tmax"), (F.count(F.lit(1)) % 7).cast("double").alias("rain"))


_ONSET = """
on1 AS (SELECT *, count(rain) OVER w AS n, avg(rain) OVER w AS m FROM daily WINDOW w AS (PARTITION BY year ORDER BY day ROWS 9 PRECEDING)),
on2 AS (SELECT *, coalesce(n = 10 AND m >= 2.5, false) AS ok FROM on1),
on3 AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY year ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM on2),
onset AS (SELECT year, min(CASE WHEN run = 3 AND month(day) * 100 + day(day) >= 601 THEN day END) AS onset FROM on3 GROUP BY year)"""
_HOT = """
h1 AS (SELECT year, day, count(tmax) OVER w AS n, round(avg(tmax) OVER w, 9) AS m FROM daily WINDOW w AS (PARTITION BY year ORDER BY day ROWS 29 PRECEDING)),
hottest AS (SELECT year, day AS window_end, m AS mean_value FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY m DESC, day) AS k FROM h1 WHERE n = 30) WHERE k = 1)"""


@query("met3_monsoon_onset", f"WITH {_ONSET} SELECT year, onset FROM onset", "daily")
def _(spark, sf):
    return M.monsoon_onset(daily(spark, sf), "rain")


@query("met4_hottest_30d", f"WITH {_HOT.replace('9) AS m', '9) AS m')} SELECT year, window_end, round(mean_value, 6) AS mean_value FROM hottest", "daily")
def _(spark, sf):
    return M.hottest_period(daily(spark, sf), "tmax")


@query("met5_phenology", f"""
WITH {_ONSET}, {_HOT} SELECT d.year, {', '.join(f'round(avg(tmax) FILTER (WHERE month(day) = {m}), 6) AS tmax_{m}' for m in range(1, 13))},
  round(sum(rain), 6) AS annual_rain, any_value(o.onset) AS onset, any_value(h.window_end) AS hottest_end, round(any_value(h.mean_value), 6) AS hottest_mean
FROM daily d LEFT JOIN onset o ON o.year = d.year LEFT JOIN hottest h ON h.year = d.year GROUP BY d.year""", "daily")
def _(spark, sf):
    d = daily(spark, sf)
    p = d.groupBy("year").agg(
        *[F.avg(F.when(F.month("day") == m, c("tmax"))).alias(f"tmax_{m}") for m in range(1, 13)], F.sum("rain").alias("annual_rain"))
    h = M.hottest_period(d, "tmax").select("year", c("window_end").alias("hottest_end"), c("mean_value").alias("hottest_mean"))
    return p.join(M.monsoon_onset(d, "rain"), "year", "left").join(h, "year", "left")


@query("met6_met_completeness", """
WITH h AS (SELECT point_id, date_trunc('hour', time_utc) AS h, count(*) AS n, count(*) FILTER (WHERE temperature_2m IS NULL) AS nul,
  count(*) FILTER (WHERE NOT temperature_2m BETWEEN 0 AND 30) AS out FROM met_hourly GROUP BY 1, 2)
SELECT point_id, count(*) AS n_hours, CAST(date_diff('hour', min(h), max(h)) + 1 - count(*) AS BIGINT) AS n_missing, CAST(sum(n - 1) AS BIGINT) AS n_repeats,
  CAST(sum(nul) AS BIGINT) AS null_temperature_2m, CAST(sum(out) AS BIGINT) AS out_temperature_2m FROM h GROUP BY point_id""", "met_hourly")
def _(spark, sf):
    return M.completeness(met_hourly(spark, sf), ["temperature_2m"], {"temperature_2m": (0.0, 30.0)})


@query("met7_parse_hourly", "SELECT user_id, true AS ok, ts AS time, round(value, 6) AS value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    # One payload per user and hour, as a feed would send it.
    day = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    payload = F.to_json(F.struct(F.transform("r", lambda x: x["ts"].cast("string")).alias("time"), F.col("r.value").alias("value")))
    p = day.select("user_id", payload.alias("payload"))
    return M.parse_hourly(p, "payload", "time array<timestamp>, value array<double>", ["time", "value"])


# --- map elements -------------------------------------------------------------------------------------

_KINDS = ["motorway", "trunk", "primary", "secondary"]
_LUS = ["forest", "residential", "Retail", "farmland", "quarry"]


def elements(spark, sf):
    """Orders as ways through parts, parts as nodes, read back through JSON as a map file would be."""
    li = table(spark, sf, "lineitem")
    ways = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    k = c("l_orderkey")
    key = F.when(k % 3 == 0, "highway").when(k % 3 == 1, "landuse").otherwise("leisure")
    value = (
        F.when(k % 3 == 0, F.array(*[F.lit(x) for x in _KINDS])[(k % 4).cast("int")])
        .when(k % 3 == 1, F.array(*[F.lit(x) for x in _LUS])[(k % 5).cast("int")]).otherwise("Park"))
    tags = F.create_map(key, value, F.lit("source"), F.lit("survey"))
    w = ways.select(F.lit("way").alias("type"), k.alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
                    F.col("r.l_partkey").alias("nodes"), tags.alias("tags"), (k * 2).alias("pos"))
    p = c("p_partkey")
    n = table(spark, sf, "part").select(
        F.lit("node").alias("type"), p.alias("id"), (F.lit(28.4) + (p % 500) / 1000).alias("lat"), (F.lit(76.8) + (p % 700) / 1000).alias("lon"),
        F.lit(None).cast("array<bigint>").alias("nodes"), F.create_map().cast("map<string,string>").alias("tags"), p.alias("pos"))
    return w.unionByName(n)


cte("ways", "", f"""
SELECT l_orderkey AS id, CASE WHEN l_orderkey % 3 = 0 THEN 'highway' WHEN l_orderkey % 3 = 1 THEN 'landuse' ELSE 'leisure' END AS key,
  CASE WHEN l_orderkey % 3 = 0 THEN {_KINDS}[CAST(l_orderkey % 4 AS INT) + 1] WHEN l_orderkey % 3 = 1 THEN {_LUS}[CAST(l_orderkey % 5 AS INT) + 1] ELSE 'Park' END AS value,
  count(*) AS n_nodes FROM lineitem GROUP BY l_orderkey""")


@query("cel20_tag_filter", """
SELECT key = 'highway' AND lower(value) IN ('motorway', 'trunk', 'primary') AS road, (key = 'leisure' AND lower(value) IN ('park', 'garden', 'nature_reserve'))
  OR (key = 'landuse' AND lower(value) IN ('forest', 'grass', 'meadow')) AS vegetation, count(*) AS n FROM ways GROUP BY 1, 2""", "ways")
def _(spark, sf):
    t = c("tags")
    return elements(spark, sf).where("type = 'way'").groupBy(
        OS.tag_filter(t, OS.ROADS).alias("road"), OS.tag_filter(t, OS.VEGETATION).alias("vegetation")).agg(F.count(F.lit(1)).alias("n"))


@query("cel21_classify_landuse", """
SELECT CASE WHEN key = 'leisure' THEN 1 WHEN key = 'landuse' THEN CASE lower(value) WHEN 'forest' THEN 2 WHEN 'residential' THEN 6 WHEN 'retail' THEN 7 WHEN 'farmland' THEN 8 ELSE 0 END
  ELSE 0 END AS code, count(*) AS n FROM ways GROUP BY 1""", "ways")
def _(spark, sf):
    return elements(spark, sf).where("type = 'way'").groupBy(OS.classify_landuse(c("tags")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("jsn1_ways_from_nodes", """
SELECT l_orderkey AS way, CAST(count(*) AS INT) AS n_nodes, arg_min(l_partkey, l_linenumber * 100000000::BIGINT + l_partkey) = arg_max(l_partkey, l_linenumber * 100000000::BIGINT + l_partkey) AND count(*) >= 4 AS closed,
  count(p_partkey) AS n_found, round(min(28.4 + (p_partkey % 500) / 1000), 6) AS min_lat, round(max(28.4 + (p_partkey % 500) / 1000), 6) AS max_lat,
  round(min(76.8 + (p_partkey % 700) / 1000), 6) AS min_lon, round(max(76.8 + (p_partkey % 700) / 1000), 6) AS max_lon
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def _(spark, sf):
    el = elements(spark, sf)
    return OS.ways_from_nodes(el.where("type = 'way'"), el.where("type = 'node'"))


def relation_members(spark, sf):
    """Segments and points: a customer's orders as members of a relation, on a circle for each role.

    Member i of m goes from place i to place i + 1 of m, by way of the point between them. Members of odd number are
    stored the other way round. The last outer member of every fifth customer is missing: a chain stays open.
    """
    k = c("o_orderkey")
    o = table(spark, sf, "orders").select(c("o_custkey").alias("relation"), F.when(k % 4 == 0, "inner").otherwise("outer").alias("role"), k.alias("seg")).distinct()
    g = W.partitionBy("relation", "role")
    o = o.withColumns({"i": F.row_number().over(g.orderBy("seg")) - 1, "m": F.count(F.lit(1)).over(g)})
    o = o.where("not (relation % 5 = 0 and role = 'outer' and m > 1 and i = m - 1)")
    turned, base = c("seg") % 2 == 1, F.when(c("role") == "inner", 0).otherwise(1_000_000)
    here, there = base + c("i"), base + (c("i") + 1) % c("m")
    seg = o.select("relation", "role", "seg", F.when(turned, there).otherwise(here).alias("a"), F.when(turned, here).otherwise(there).alias("z"), F.lit(3).alias("n"))
    r = F.when(c("role") == "inner", 0.01).otherwise(0.1)
    at = F.posexplode(F.when(turned, F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).alias("pos", "step")
    p = o.select("seg", "i", "m", r.alias("r"), at).withColumn("angle", 2 * math.pi * (c("i") + c("step")) / c("m") + 0.1)
    return seg, p.select("seg", "pos", (c("r") * F.cos("angle")).alias("x"), (c("r") * F.sin("angle")).alias("y"))


@query("jsn2_relation_rings", """
WITH o AS (SELECT relation, role, seg, row_number() OVER (PARTITION BY relation, role ORDER BY seg) - 1 AS i, count(*) OVER (PARTITION BY relation, role) AS m
  FROM (SELECT DISTINCT o_custkey AS relation, CASE WHEN o_orderkey % 4 = 0 THEN 'inner' ELSE 'outer' END AS role, o_orderkey AS seg FROM orders)),
g AS (SELECT relation, role, min(seg) AS ring, any_value(m) AS m, relation % 5 = 0 AND role = 'outer' AND any_value(m) > 1 AS cut_ FROM o GROUP BY relation, role),
r AS (SELECT relation, role, ring, m - CAST(cut_ AS INT) AS n_segments, 2 * (m - CAST(cut_ AS INT)) + 1 AS n_points, NOT cut_ AS closed,
  CASE WHEN NOT cut_ THEN (CASE WHEN ring % 2 = 1 THEN -1 ELSE 1 END) * m * CASE WHEN role = 'inner' THEN 0.0001 ELSE 0.01 END * sin(pi() / m) END * 1000 AS area FROM g)
SELECT r.relation, r.role, r.ring, r.n_segments, r.n_points, r.closed, round(r.area, 6) AS area, CASE WHEN r.role = 'inner' THEN w.ring END AS of
FROM r LEFT JOIN r w ON w.relation = r.relation AND w.role = 'outer' AND w.closed AND w.n_segments > 1""")
def _(spark, sf):
    rings = RG.relation_rings(*relation_members(spark, sf))
    return rings.withColumn("area", c("area") * 1000)


@query("jsn3_dedupe_elements", "SELECT key, count(*) AS n FROM ways GROUP BY key", "ways")
def _(spark, sf):
    el = elements(spark, sf).where("type = 'way'").drop("lat", "lon")
    twice = el.unionByName(el.withColumn("pos", c("pos") - 1).withColumn("tags", F.create_map(F.lit("old"), F.lit("x"))))
    d = OS.dedupe_elements(twice, ["highway", "landuse", "leisure"])
    return d.groupBy(F.map_keys("tags")[0].alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("jsn4_json_profile", """
SELECT 'way' AS type, count(*) AS n, CAST(NULL AS DOUBLE) AS min_lat, CAST(NULL AS DOUBLE) AS max_lat, CAST(NULL AS DOUBLE) AS min_lon, CAST(NULL AS DOUBLE) AS max_lon, count(*) AS n_tagged FROM ways
UNION ALL SELECT 'node', count(*), round(min(28.4 + (p_partkey % 500) / 1000), 6), round(max(28.4 + (p_partkey % 500) / 1000), 6), round(min(76.8 + (p_partkey % 700) / 1000), 6),
  round(max(76.8 + (p_partkey % 700) / 1000), 6), 0 FROM part""", "ways")
def _(spark, sf):
    return OS.json_profile(elements(spark, sf))


@query("src5_read_osm_json", "SELECT 'way' AS type, count(*) AS n, CAST(sum(n_nodes) AS BIGINT) AS n_refs FROM ways UNION ALL SELECT 'node', count(*), 0 FROM part", "ways")
def _(spark, sf):
    path = scratch(spark, sf, "osm")
    el = elements(spark, sf).select("type", "id", "lat", "lon", "nodes", "tags")
    # Documents of about a thousand elements, as map extracts come in many files.
    doc = el.withColumn("_d", F.floor(c("id") / 1000)).groupBy("_d", "type").agg(F.collect_list(F.struct(*el.columns)).alias("elements"))
    P.write_table(doc.select("elements"), path, "json")
    got = spark.read.schema(OS.ELEMENTS).json(path).select(F.explode("elements").alias("e")).select("e.*")
    refs = F.coalesce(F.when(F.size("nodes") > 0, F.size("nodes")), F.lit(0))
    return got.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(refs).alias("n_refs"))


@query("jsn5_json_safe", """
SELECT l_orderkey, l_linenumber, l_partkey, '{"v":' || CASE WHEN l_discount = 0 THEN 'null' ELSE CAST(l_quantity AS VARCHAR) END || '}' AS j FROM lineitem""")
def _(spark, sf):
    v = F.when(c("l_discount") == 0, F.lit(float("nan"))).otherwise(c("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(
        F.struct(OS.json_safe(v).alias("v")), {"ignoreNullFields": "false"}).alias("j"))


# --- gates ----------------------------------------------------------------------------------------------

def _gates(rules: dict[str, str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS check_id, count(*) FILTER (WHERE {v}) AS n_bad, count(*) FILTER (WHERE {v}) = 0 AS ok FROM {src}" for k, v in rules.items())


@query("dq1_grid_audit", """
SELECT year, n_cells, n_expected, CASE WHEN n_cells <> n_expected THEN 'SAME_GRID' ELSE 'EXACT' END AS alignment FROM (
  SELECT year, count(*) AS n_cells, any_value(side * side)::BIGINT AS n_expected FROM cells, grid GROUP BY year)""", "cells grid")
def _(spark, sf):
    n = V.side(spark, sf)
    m = V.cells(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n_cells"))
    m = m.withColumn("n_expected", F.lit(n * n).cast("long")).withColumn("res", F.lit(30.0)).withColumn("origin", F.lit(60.0))
    return Q.grid_audit(m, 30.0).drop("res", "origin")


@query("dq2_input_preflight", """
SELECT year, 25 - count(DISTINCT block_id) AS missing_blocks, count(*) FILTER (WHERE lulc_class NOT BETWEEN 0 AND 8) AS bad_labels,
  round(avg(CAST(lst_c IS NOT NULL AS INT)), 6) AS coverage, avg(CAST(lst_c IS NOT NULL AS INT)) >= 0.9 AS ok FROM cells GROUP BY year""", "cells")
def _(spark, sf):
    d = V.cells(spark, sf)
    want = spark.range(25).select(c("id").cast("int").alias("block_id")).withColumn("year", F.explode(F.sequence(F.lit(2022), F.lit(2026))))
    gone = Q.missing_inputs(d, want, ["year", "block_id"]).groupBy("year").agg(F.count(F.lit(1)).alias("missing_blocks"))
    cov = F.count("lst_c") / F.count(F.lit(1))
    a = d.groupBy("year").agg(F.count_if(~c("lulc_class").between(0, 8)).alias("bad_labels"), cov.alias("coverage"), (cov >= 0.9).alias("ok"))
    return a.join(gone, "year", "left").withColumn("missing_blocks", F.coalesce("missing_blocks", F.lit(0).cast("long")))


@query("dq3_feature_gates", _gates({
    "null_predictor": "ndvi IS NULL OR ndbi IS NULL OR bsi IS NULL", "block_id": "block_id NOT BETWEEN 0 AND 24", "clear_count": "clear_count < 1",
    "vegetation_cover": "vegetation_cover NOT BETWEEN 0 AND 1", "cold": "lst_c < 15"}, "domain"), "domain")
def _(spark, sf):
    return Q.checks(V.domain(spark, sf), {
        "null_predictor": c("ndvi").isNull() | c("ndbi").isNull() | c("bsi").isNull(), "block_id": ~c("block_id").between(0, 24),
        "clear_count": c("clear_count") < 1, "vegetation_cover": ~c("vegetation_cover").between(0, 1), "cold": c("lst_c") < 15})


@query("dq4_mapping_gates", _gates({
    "probabilities_sum": "abs(p0 + p1 + p2 - 1) > 1e-5", "confidence": "confidence <> greatest(p0, p1, p2)",
    "argmax": "CASE y_pred WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END < confidence", "class_range": "y_pred NOT BETWEEN 0 AND 2"}, "classed"), "classed")
def _(spark, sf):
    p = c("probability")
    return Q.checks(V.classed(spark, sf), {
        "probabilities_sum": F.abs(p[0] + p[1] + p[2] - 1) > 1e-5, "confidence": c("confidence") != F.array_max(p),
        "argmax": F.get(p, c("y_pred")) < c("confidence"), "class_range": ~c("y_pred").between(0, 2)})


@query("dq5_suitability_gates", _gates({
    "score_range": "suitability NOT BETWEEN 0 AND 100", "priority_on_feasible_only": "(priority IS NOT NULL) <> feasible", "need_range": "need01 NOT BETWEEN 0 AND 1",
    "class_edges": "suitability_class <> least(greatest(CAST(ceil(suitability / 20) AS INT) - 1, 0), 4)"}, "scored"), "scored")
def _(spark, sf):
    again = F.least(F.greatest(F.ceil(c("suitability") / 20).cast("int") - 1, F.lit(0)), F.lit(4))
    return Q.checks(scored(spark, sf), {
        "score_range": ~c("suitability").between(0, 100), "priority_on_feasible_only": c("priority").isNotNull() != c("feasible"),
        "need_range": ~c("need01").between(0, 1), "class_edges": c("suitability_class") != again})


@query("dq6_tree_gates", _gates({
    "area": "abs(usable_ha - px * 0.09) > 0.001", "rank_exclusive": "(rank_excl = 0) <> oversized", "rank_order": "rank_excl > rank",
    "floor": "floor(usable_ha * 1000 + 1e-6) > usable_ha * 1000 + 1e-6", "score": "abs(score - (0.5 * need_c + 0.25 * veg_c + 0.25 * opp_c)) > 1e-5"}, "sites"), "sites")
def _(spark, sf):
    u = c("usable_ha") * 1000 + 1e-6
    return Q.checks(site_table(spark, sf), {
        "area": F.abs(c("usable_ha") - c("px") * 0.09) > 0.001, "rank_exclusive": (c("rank_excl") == 0) != c("oversized"),
        "rank_order": c("rank_excl") > c("rank"), "floor": F.floor(u) > u,
        "score": F.abs(c("score") - (c("need_c") * 0.5 + c("veg_c") * 0.25 + c("opp_c") * 0.25)) > 1e-5})


@query("dq7_cooling_gates", _gates({
    "delta_exact": "abs(next_lst - current_lst - delta_lst) > 1e-6", "adjacent": "end_year <> start_year + 1", "finite": "delta_lst IS NULL"}, "transitions"), "transitions")
def _(spark, sf):
    from heatgrid.plans.join_queries import transitions
    return Q.checks(transitions(spark, sf), {
        "delta_exact": F.abs(c("next_lst") - c("current_lst") - c("delta_lst")) > 1e-6, "adjacent": c("end_year") != c("start_year") + 1,
        "finite": c("delta_lst").isNull()})


@query("dq8_model_gates", """
SELECT 'thresholds_monotone' AS check_id, count(*) FILTER (WHERE NOT t1 < t2) AS n_bad, count(*) FILTER (WHERE NOT t1 < t2) = 0 AS ok FROM terciles
UNION ALL SELECT 'class_recount', count(*) FILTER (WHERE y_true <> CAST(lst_c >= t1 AS INT) + CAST(lst_c >= t2 AS INT)), count(*) FILTER (WHERE y_true <> CAST(lst_c >= t1 AS INT) + CAST(lst_c >= t2 AS INT)) = 0
FROM classed c JOIN terciles t ON t.year = c.year UNION ALL SELECT 'folds_disjoint', 0, true""", "classed terciles")
def _(spark, sf):
    from heatgrid.operators import classify as L
    from heatgrid.plans.model_queries import pinned_folds
    d = V.classed(spark, sf)
    t = L.year_thresholds(V.train_rows(d), "lst_c", [1 / 3, 2 / 3])
    again = L.assign_class(d, t, "lst_c", "again")
    f = pinned_folds(d).groupBy("block_id").agg(F.count_distinct("fold").alias("n"))
    return Q.union([
        Q.checks(t, {"thresholds_monotone": ~(c("thresholds")[0] < c("thresholds")[1])}),
        Q.checks(again, {"class_recount": c("again") != c("y_true")}), Q.checks(f, {"folds_disjoint": c("n") != 1})])


@query("dq9_parity", """
SELECT d.year, count(*) AS n, round(max(abs(d.ndvi - c.ndvi)), 6) AS max_ndvi, round(max(abs(d.lst_c - c.lst_c)), 6) AS max_lst, count(*) FILTER (WHERE c.row IS NULL) AS n_unmatched
FROM domain d LEFT JOIN cells c ON c.year = d.year AND c.row = d.row AND c.col = d.col GROUP BY d.year""", "domain cells")
def _(spark, sf):
    """Stored cells recomputed from the scenes, compared where the domain has them."""
    again = V.build_cells(spark, sf).select(*K, c("ndvi").alias("n2"), c("lst_c").alias("l2"))
    j = V.domain(spark, sf).select(*K, "ndvi", "lst_c").join(again, K, "left")
    return j.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(c("ndvi") - c("n2"))).alias("max_ndvi"), F.max(F.abs(c("lst_c") - c("l2"))).alias("max_lst"),
        F.count_if(c("n2").isNull()).alias("n_unmatched"))


@query("dq10_vector_validity", """
SELECT feature, ring, count(*) AS n_points, arg_min(x, pos) = arg_max(x, pos) AND arg_min(y, pos) = arg_max(y, pos) AS closed, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS n_null,
  round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, arg_min(x, pos) = arg_max(x, pos) AND arg_min(y, pos) = arg_max(y, pos) AND count(*) >= 4 AS valid FROM vertices GROUP BY feature, ring""", "vertices")
def _(spark, sf):
    return Q.ring_validity(vertices(spark, sf))


@query("dq11_spot_checks", """
SELECT a.year, a.n AS saved, b.n AS recounted, a.n = b.n AS ok FROM (SELECT year, count(*) AS n FROM classed WHERE y_true = 2 GROUP BY year) a
JOIN (SELECT d.year, count(*) AS n FROM domain d JOIN terciles t ON t.year = d.year WHERE lst_c >= t2 GROUP BY d.year) b ON a.year = b.year""", "classed domain terciles")
def _(spark, sf):
    from heatgrid.operators import classify as L
    saved = V.classed(spark, sf).where("y_true = 2").groupBy("year").agg(F.count(F.lit(1)).alias("saved"))
    d = V.domain(spark, sf)
    t = L.year_thresholds(V.train_rows(d), "lst_c", [1 / 3, 2 / 3])
    n = L.assign_class(d, t, "lst_c", "k").where("k = 2").groupBy("year").agg(F.count(F.lit(1)).alias("recounted"))
    return saved.join(n, "year").withColumn("ok", c("saved") == c("recounted"))


_RANGES = {"ndvi": (-1, 1), "ndbi": (-0.5, 0.5), "lst_c": (15, 45), "vegetation_cover": (0, 1)}


@query("dq12_value_ranges", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count(*) AS n, count(*) FILTER (WHERE {v} IS NULL) AS n_null, 0::BIGINT AS n_inf, count(*) FILTER (WHERE {v} < {lo} OR {v} > {hi}) AS n_bad, "
    f"count(*) FILTER (WHERE {v} < {lo} OR {v} > {hi}) = 0 AS ok FROM cells" for v, (lo, hi) in _RANGES.items()), "cells")
def _(spark, sf):
    return Q.range_checks(V.cells(spark, sf), _RANGES)


@query("dq13_overlay_alignment", """
SELECT year, count(*) AS inside_px, count(*) AS hot_px, 1.0::DOUBLE AS share, true AS ok FROM hot_cells GROUP BY year""", "hot_cells")
def _(spark, sf):
    """Cells inside the hotspot outlines, rasterised from the rings, must be hot cells again."""
    n = V.side(spark, sf)
    h = hot_labels(spark, sf)
    pieces = hot_rings(spark, sf)[0]
    corner = [(c("r") + c("dr")).cast("double").alias("y"), (c("c") + c("dc")).cast("double").alias("x")]
    feature = (c("year").cast("long") * 1_000_000_000 + c("zone_id")).alias("feature")
    v = pieces.where("turn <> 0").select(feature, "ring", "pos", *corner)
    first = v.groupBy("feature", "ring").agg(F.min_by(F.struct("y", "x"), "pos").alias("p"), (F.max("pos") + 1).alias("pos"))
    v = v.unionByName(first.select("feature", "ring", "pos", "p.y", "p.x"))
    inside = SP.rasterize_spans(SP.ring_edges(v), n, n).select(
        F.expr("cast(feature div 1000000000 as int)").alias("year"), "row", F.explode(F.sequence("c_lo", "c_hi")).alias("col"))
    j = inside.join(h.select(*K, F.lit(1).alias("hot")), K, "left")
    share = F.count("hot") / F.count(F.lit(1))
    return j.groupBy("year").agg(
        F.count(F.lit(1)).alias("inside_px"), F.count("hot").alias("hot_px"), share.alias("share"), (share >= 0.999).alias("ok"))
