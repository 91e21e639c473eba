"""What several operators need: tables kept in the shared folder, ids that may be null, components.

`kept` writes a table below `spark.checkpoint.dir` and reads it back: lineage is cut, a lost
executor loses nothing, and later joins start from a plain scan, so that a skewed key can be split
by adaptive execution. `discard` deletes such a table once what was derived from it is stored.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.session import checkpoint_root

NO_ID = -(1 << 63)
WORD = "[^\\x20\\x09-\\x0D]+"


class Kept:
    """A stored table: `.df` reads it, `.discard()` deletes it."""

    def __init__(self, df: DataFrame, path: str) -> None:
        self.df, self.path = df, path

    def discard(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> Kept:
    """Write `df` to the shared folder and read it back; then let Spark drop the shuffles behind it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    return Kept(spark.read.schema(schema).parquet(path), path)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's references to them are collected; do that between phases."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_or_least(name: str) -> Column:
    """The id as a long; a null id counts as one document below all others."""
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NO_ID))


def id_or_null(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so or begins so."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str, *order: Column) -> Kept:
    """`df`, stored in the given order, with each row's place in it (from 0).

    No window over all rows: rows are sorted by ranges, numbered inside a partition, and the partitions' sizes are added up.
    """
    stored = kept(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = stored.df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row for each partition
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("_part", before.alias("_before"))
    within = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    return Kept(stored.df.join(places, part == F.col("_part")).withColumn(name, within + F.col("_before")).drop("_part", "_before"), stored.path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected edge list (u, v) of longs: root is the least node reachable.

    Every round points the neighbours of a node at its least neighbour, first the larger ones, then
    the smaller ones; the edges end as stars. The minimum of a node is combined before rows move,
    and the join that hands it out reads two stored tables, so a node with very many edges is split.
    """
    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        stamp = now.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if stamp == before or stamp[0] == 0:
            break
        before = stamp
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = kept(both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
        low = kept(large.df.groupBy("u").agg(F.min("v").alias("m")))
        small = (large.df.join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.df.select("u", F.col("m").alias("v"))).where("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        new = kept(small)
        for old in (now, least, large, low):
            old.discard()
        now = new
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def bitmap(keys: DataFrame, place: Column, bits: int = 22) -> np.ndarray:
    """Bit set of `place` (0 to 2**bits - 1) over all rows: 2**bits / 8 bytes, whatever the table's size.

    It thins rows before a shuffle when few keys are wanted, and thins nothing when very many are.
    False hits only cost work; misses do not occur.
    """
    rows = (keys.select((place + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] |= np.frombuffer(bytes(r["m"]), np.uint8)
    return out


def high_bits(name: str, bits: int) -> Column:
    """The upper bits of a column of mixed 64-bit hashes, as a place in a bitmap."""
    return F.shiftrightunsigned(F.col(name), 64 - bits)


def in_bitmap(found: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return (found[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
