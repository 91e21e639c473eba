"""Readers and writers of cell products, predictions, weather, inventories and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
MET_SCHEMA = "point_id int, lat double, lon double, time_utc timestamp, temperature_2m double, precipitation double"


def require(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The frame with exactly these columns and types; a missing one is an error."""
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    missing = [f.name for f in want.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def write_cells(df: DataFrame, path: str) -> None:
    """One folder per year; within it sorted by row, so that row-group statistics skip rows."""
    df.repartition("year", F.floor(F.col("row") / 64)).sortWithinPartitions("year", "row", "col").write.mode(
        "overwrite").partitionBy("year").parquet(path)


def read_cells(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Yearly products as one table; years not asked for are not read."""
    d = spark.read.parquet(path)
    return d.where(F.col("year").isin(*years)) if years is not None else d


def read_static(df: DataFrame, nodata: int = 255) -> DataFrame:
    return df.withColumn("landuse_class", F.nullif("landuse_class", F.lit(nodata)))


def read_met(spark: SparkSession, path: str) -> DataFrame:
    r = spark.read.schema(MET_SCHEMA).option("header", True).option("enforceSchema", False)
    return r.option("timestampFormat", MICROS).csv(path)


def read_predictions(preds: DataFrame, cells: DataFrame, model: str, accuracy: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """One model's predictions with the observed value; `guard_ok` per year tells whether all rows
    matched and the accuracy lies in the expected band."""
    keys = ["year", "row", "col"]
    p = preds.where(F.col("model") == model).join(cells.select(*keys, "lst_c"), keys, "left")
    g = p.groupBy("year").agg(
        F.count_if(F.col("lst_c").isNull()).alias("_u"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("_a"))
    ok = (F.col("_u") == 0) & F.col("_a").between(*accuracy)
    return p.join(F.broadcast(g.select("year", ok.alias("guard_ok"))), "year")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, hash, kind and year of every file below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    year = F.regexp_extract("path", r"(20[0-9]{2})", 1)
    return f.select(
        name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).alias("kind"), F.when(year != "", year.cast("int")).alias("file_year"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True).option("timestampFormat", MICROS)
    w.format(fmt).save(path)


def geojson_features(zones: DataFrame, polygons: DataFrame, keys: Sequence[str], props: Sequence[str]) -> DataFrame:
    """One GeoJSON feature text per zone; `polygons` holds, per zone, outer rings each followed by its holes, as x and y."""
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("polygons").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*keys, *props).alias("properties"), geometry.alias("geometry"))
    return zones.join(polygons, list(keys)).select(*keys, F.to_json(feature).alias("feature"))


def result_slice(table: DataFrame, year: int, scenario: str) -> DataFrame:
    return table.where((F.col("year") == year) & (F.col("scenario") == scenario))
