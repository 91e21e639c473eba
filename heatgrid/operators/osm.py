"""Nested map elements: ways from nodes, tags to classes; rings of relations are in `rings`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag presets and land-use codes.
ROADS = {"highway": ["motorway", "trunk", "primary"]}
VEGETATION = {"leisure": ["park", "garden", "nature_reserve"], "landuse": ["forest", "grass", "meadow"],
              "natural": ["wood", "scrub", "grassland"]}
LANDUSE_CODES = {"park": 1, "forest": 2, "grass": 3, "commercial": 4, "industrial": 5, "residential": 6, "retail": 7, "farmland": 8}
LEISURE_CODES = {"park": 1, "garden": 1, "nature_reserve": 1, "pitch": 3, "playground": 3}
NATURAL_CODES = {"wood": 2, "scrub": 3, "grassland": 3}

ELEMENTS = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,"
    "members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>")


def read_elements(spark, path: str) -> DataFrame:
    """One row per element of map JSON files, with the position it had."""
    raw = spark.read.schema(ELEMENTS).option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("file"), F.posexplode("elements").alias("pos", "e")).select("file", "pos", "e.*")


def tag_filter(tags: Column, wanted: dict[str, Sequence[str]]) -> Column:
    """Any listed value under any listed key, in any letter case."""
    out = F.lit(False)
    for k, vs in wanted.items():
        out = out | F.coalesce(F.lower(tags[k]).isin(*vs), F.lit(False))
    return out


def classify_landuse(tags: Column) -> Column:
    """Land-use code from landuse, else leisure, else natural; 0 when none says."""
    def look(key, table):
        m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return m[F.lower(tags[key])]

    return F.coalesce(look("landuse", LANDUSE_CODES), look("leisure", LEISURE_CODES), look("natural", NATURAL_CODES), F.lit(0))


def dedupe_elements(el: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Last element per (type, id) by position, its listed tags kept. A maximum combines map-side."""
    rest = [c for c in el.columns if c not in ("type", "id", "pos")]
    last = el.groupBy("type", "id").agg(F.max_by(F.struct(*rest), "pos").alias("r"), F.max("pos").alias("pos"))
    return last.select("type", "id", "pos", "r.*").withColumn("tags", F.map_filter("tags", lambda k, _: k.isin(*keep)))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, pos, lat, lon): each way's nodes in order, by an equi join on the node id."""
    refs = ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))
    return refs.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node").select("way", "pos", "node", "lat", "lon")


def ways_from_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per way: points found, points missing, closed or not, and its box. Nothing is gathered."""
    pts = way_points(ways, nodes)
    closed = (F.element_at("nodes", 1) == F.element_at("nodes", -1)) & (F.size("nodes") >= 4)
    got = pts.groupBy("way").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))
    w = ways.select(F.col("id").alias("way"), F.size("nodes").alias("n_nodes"), closed.alias("closed"))
    return w.join(got, "way", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0).cast("long")))


def json_profile(el: DataFrame) -> DataFrame:
    return el.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.count_if(F.size("tags") > 0).alias("n_tagged"))


def json_safe(v: Column) -> Column:
    """NaN and infinities as NULL, for JSON output."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
