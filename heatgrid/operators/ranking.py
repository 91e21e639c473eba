"""Ranks, samples, shortlists and plans under a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.quantiles import ranked


def hash_number(seed: int | str, *cols: str) -> Column:
    """A 52-bit number from the md5 of seed and key: a seeded order that any engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def sample_per_group(
    df: DataFrame, by: Sequence[str], n: int, seed: int = 42, key: Sequence[str] = ("year", "row", "col")
) -> DataFrame:
    """At most n rows per group, without replacement, by hash order: what a capped sample asks for.

    Group sizes are counted first; when none exceeds the cap the sample is the table itself.
    """
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (most or 0) <= n:
        return df
    h = hash_number(seed, *key)
    r = ranked(df, by, h, [F.col(k) for k in key if k not in by], out="_r")
    return r.where(F.col("_r") <= n).drop("_r")


def stratified_sample(
    df: DataFrame, by: Sequence[str], label: str, n: int, seed: int = 42, key: Sequence[str] = ("year", "row", "col")
) -> DataFrame:
    """Proportional quota per class, at least one, rounded half to even."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_t"))
    quota = counts.join(total, by).select(
        *by, label, F.greatest(F.bround(F.lit(float(n)) * F.col("_n") / F.col("_t")), F.lit(1.0)).alias("_q"))
    r = ranked(df, [*by, label], hash_number(seed, *key), [F.col(k) for k in key if k not in by], out="_r")
    return r.join(F.broadcast(quota), [*by, label]).where(F.col("_r") <= F.col("_q")).drop("_r", "_q")


def thirds(rank: Column, n: Column) -> Column:
    """1, 2, 3 in bands of ceil(n/3)."""
    third = F.ceil(n / 3.0)
    return F.when(rank <= third, 1).when(rank <= 2 * third, 2).otherwise(3)


def shortlist(zones: DataFrame, by: Sequence[str], score: str, area: str, max_ha: float, top: int) -> DataFrame:
    """Score rank; oversized zones keep it but get rank_excl 0 and never enter the shortlist."""
    by, tie = list(by), [F.col("zone_id")]
    d = ranked(zones, by, -F.col(score), tie, out="rank").withColumn("oversized", F.col(area) > max_ha)
    fit = ranked(d.where(~F.col("oversized")), by, -F.col(score), tie, out="rank_excl").select(*by, "zone_id", "rank_excl")
    d = d.join(fit, [*by, "zone_id"], "left").withColumn("rank_excl", F.coalesce("rank_excl", F.lit(0)))
    return d.withColumn("shortlist", ~F.col("oversized") & (F.col("rank_excl") <= top))


def running_sum(df: DataFrame, by: Sequence[str], rank: str, value: str, out: str, band: int = 4096) -> DataFrame:
    """Sum of `value` up to each rank: within bands of ranks, plus the total of the bands before."""
    by = list(by)
    d = df.withColumn("_band", F.floor(F.col(rank) / band))
    before = W.partitionBy(*by).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offs = d.groupBy(*by, "_band").agg(F.sum(value).alias("_s")).withColumn(
        "_off", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = W.partitionBy(*by, "_band").orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    return d.join(offs, [*by, "_band"]).withColumn(out, F.sum(value).over(inside) + F.col("_off")).drop("_band", "_off")


def plan_prefix(sites: DataFrame, by: Sequence[str], trees: str, limit: Column) -> DataFrame:
    """Sites in rank order until the next would exceed the limit."""
    d = running_sum(sites, by, "rank", trees, "cum_trees")
    return d.withColumn("planned", F.col("cum_trees") <= limit)


def plan_skip(sites: DataFrame, by: Sequence[str], trees: str, limit: float, top: int) -> DataFrame:
    """Skip a site that would exceed the limit and go on. The fold runs over a shortlist of `top`."""
    short = sites.where(F.col("shortlist") & (F.col("rank_excl") <= top))
    packed = short.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "zone_id", F.col(trees).alias("t")))).alias("s"))
    zero = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("ids"))

    def take(acc, x):
        fits = acc["used"] + x["t"] <= limit
        return F.struct(
            F.when(fits, acc["used"] + x["t"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["ids"], F.array(x["zone_id"]))).otherwise(acc["ids"]).alias("ids"))

    return packed.withColumn("p", F.aggregate("s", zero, take)).select(
        *by, F.col("p.used").alias("used"), F.size("p.ids").alias("n_sites"),
        F.array_join(F.col("p.ids").cast("array<string>"), ",").alias("zone_ids"))
