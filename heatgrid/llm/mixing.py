"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources in code point order (null last) get the weights 3, 1, 2, repeating, and share `share` of all
   words; a target stops at `cap` times its source's size and the excess is reshared by weight, until
   none is above: target = min(cap * size, level * weight).
2. The mix has `total / block` blocks; the highest quotients target / (2k - 1) give each source its number. A block
   has BLOCK words, fewer if the smallest source would not hold LEAST_BLOCKS of them. Sources are numbered
   and quotients ranked by range sorts, so there may be many.
3. Sources are cut into shards by a seeded hash of the id; a source's blocks go to its shards the same way.
   Shards hold about `shard_words` words, so a large source is spread over many tasks.
4. In a shard, documents stand in seeded order and their words are cut into equal blocks. Whole passes take
   every block; what is left of the quota is selected evenly from a seeded start. The words a document
   gives follow from its place by arithmetic, block by block rows are never made.

No document gives more than `cap` times its words, since a shard passes over each block at most that
often. Reruns agree: order and starts depend on ids and the seed alone.

Defined cases: null text has 0 words; a null source is a source of its own, ordered last; a null id is
an id like others; repeated rows each count and take part; an empty table, or one without words, gives
targets and taken words of 0; extra columns of the input are not returned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from heatgrid.llm.arrays import batch_bytes, spans, texts_of
from heatgrid.llm.shared import kept, numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 64
LEAST_BLOCKS = 32
SHARD_WORDS = 1 << 16
MAX_SHARDS = 1 << 16


@F.arrow_udf(T.LongType())
def word_count(column: pa.Array) -> pa.Array:
    """Number of words of each text."""
    column = pc.fill_null(column, b"")
    out = [np.zeros(0, np.int64)]
    for a, b in texts_of(column):
        out.append(np.diff(spans(*batch_bytes(column.slice(a, b - a)))[2]))
    return pa.array(np.concatenate(out).astype(np.int64))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """(source, no, source_size, weight, target) of rows (source, size): one row per source, `no` its place.

    The level rises until the sources below their cap share what the full ones leave: a sum over all sources each time.
    """
    src = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "no", F.col("source").asc_nulls_last()).df
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("no", F.lit(len(weights))) + 1).cast("int")))
    src = kept(src.withColumn("room", cap * F.col("source_size").cast("double"))).df
    whole = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        is_full = F.col("room") <= level * F.col("weight")
        now = src.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("room"))), F.sum(F.when(~is_full, F.col("weight")))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (whole - (now[1] or 0.0)) / now[2]
    return src.select("source", "no", "source_size", "weight", F.least("room", level * F.col("weight")).alias("target"))


def source_quotas(src: DataFrame, blocks: int) -> DataFrame:
    """`src` with quota: how many of `blocks` each source gets, by the highest quotients target / (2k - 1) of all sources."""
    total, n = src.agg(F.sum("target"), F.count(F.lit(1))).first()
    if not total:
        return src.withColumn("quota", F.lit(0).cast("long"))
    each = F.col("target") / float(total)
    few = F.floor(each * max(0.0, blocks - n / 2) + 0.5)  # surely too few, and
    many = F.ceil(each * (blocks + n / 2) + 0.5)  # surely too many: some two quotients a source are left to rank
    src = src.withColumns({"few": few, "many": many})
    rest = blocks - (src.agg(F.sum("few")).first()[0] or 0)
    left = src.where("many > few and target > 0").select("no", "target", F.explode(F.sequence(F.col("few") + 1, F.col("many"))).alias("k"))
    ranked = numbered(left, "place", (F.col("target") / (2 * F.col("k") - 1)).desc(), F.col("no"), F.col("k"))
    won = ranked.df.where(F.col("place") < rest).groupBy("no").agg(F.count(F.lit(1)).alias("won"))
    return src.join(won, "no", "left").withColumn("quota", (F.col("few") + F.coalesce("won", F.lit(0))).cast("long")).drop("few", "many", "won")


def apportion(df: DataFrame, by: Sequence[str], key: str, weight: str, seats: Column, out: str) -> DataFrame:
    """`df` with the number of seats each row gets of its group's: the highest quotients weight / (2k - 1).

    Divisors that give surely too few and surely too many seats leave about two quotients per row to rank.
    """
    group = W.partitionBy(*by)
    df = df.withColumns({
        "_n": seats, "_w": F.col(weight).cast("double"), "_sum": F.sum(F.col(weight).cast("double")).over(group),
        "_half": F.count(F.lit(1)).over(group) / 2.0})
    few = F.when((F.col("_n") > F.col("_half")) & (F.col("_sum") > 0),
                 F.floor(F.col("_w") * (F.col("_n") - F.col("_half")) / F.col("_sum") + 0.5)).otherwise(0)
    many = F.when(F.col("_sum") > 0, F.ceil(F.col("_w") * (F.col("_n") + F.col("_half")) / F.col("_sum") + 0.5)).otherwise(0)
    df = df.withColumns({"_few": few, "_many": many})
    df = df.withColumn("_rest", F.col("_n") - F.sum("_few").over(group))
    rest = df.where("_many > _few and _w > 0").select(
        *by, key, "_w", "_rest", F.explode(F.sequence(F.col("_few") + 1, F.col("_many"))).alias("_k"))
    rank = F.row_number().over(group.orderBy((F.col("_w") / (2 * F.col("_k") - 1)).desc(), F.col(key), "_k"))
    won = rest.withColumn("_r", rank).where("_r <= _rest").groupBy(*by, key).agg(F.count(F.lit(1)).alias("_won"))
    return (df.join(won, [*by, key], "left")
            .withColumn(out, (F.col("_few") + F.coalesce("_won", F.lit(0))).cast("long"))
            .drop("_n", "_w", "_sum", "_half", "_few", "_many", "_rest", "_won"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK,
    shard_words: int = SHARD_WORDS, seed: str = "mix",
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row of `docs`."""
    sizes = kept(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("binary")).alias("size"))).df
    src = kept(source_targets(sizes, weights, share, cap)).df
    total, least = src.where("source_size > 0").agg(F.sum("source_size"), F.min("source_size")).first()
    block = max(1, min(block, (least or 1) // LEAST_BLOCKS))
    per_shard = max(shard_words, -(-(total or 0) // MAX_SHARDS))
    src = source_quotas(src, round(share * (total or 0) / block)).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / per_shard)).cast("long"))
    src = kept(src).df

    place = F.xxhash64(F.lit(seed), F.col("id"))
    rows = sizes.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "id", "size", "source_size", "target", "no", "quota", F.pmod(place, F.col("shards")).alias("shard"),
        F.xxhash64(F.lit(seed), F.lit("order"), F.col("id")).alias("place"))
    rows = kept(rows).df
    shards = rows.groupBy("no", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = apportion(shards, ["no"], "shard", "words", F.col("quota"), "take")
    n = F.greatest(F.lit(1), F.round(F.col("words") / block)).cast("long")
    # a shard's blocks hold words / n words each: so many of them as hold what it is to give
    take = F.round(F.col("take") * block / (F.col("words") / n)).cast("long")
    shards = shards.where("words > 0").withColumns({"n": n, "take": F.least(take, cap * n)}).select(
        "no", "shard", "n", (F.col("words") / F.col("n")).alias("each"), F.expr("take div n").alias("passes"), (F.col("take") % F.col("n")).alias("rest"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("no"), F.col("shard")), n).alias("from"))
    shards = kept(shards).df

    line = W.partitionBy("no", "shard").orderBy("place", "id", "size")
    rows = rows.withColumn("end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.join(shards, ["no", "shard"], "left")

    def chosen(j: Column) -> Column:
        """Of the first j blocks of the shard, how many the last pass selects."""
        return F.floor((j * F.col("rest") + F.col("from")) / F.col("n"))

    def words(x: Column) -> Column:
        """Of the first x words of the shard, how many the last pass selects."""
        j = F.floor(x / F.col("each"))
        return F.floor(F.col("each") * chosen(j) + (x - F.col("each") * j) * (chosen(j + 1) - chosen(j)) + 1e-6)

    start = F.col("end") - F.col("size")
    taken = F.col("passes") * F.col("size") + words(F.col("end")) - words(start)
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))
