"""Set operations and overlap measures between masks, classes and zones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_overlap(a: Column, b: Column, n: Column | None = None) -> list[Column]:
    """Intersection, union, IoU and the share of each mask the other covers, as aggregates; a row stands for `n` cells, for one without it."""
    def size(mask: Column) -> Column:
        return F.count_if(mask) if n is None else F.coalesce(F.sum(F.when(mask, n)), F.lit(0))

    both, either = size(a & b), size(a | b)
    return [
        both.alias("intersection_px"), either.alias("union_px"), F.try_divide(both, either).alias("iou"),
        F.try_divide(both, size(a)).alias("share_of_a"), F.try_divide(both, size(b)).alias("share_of_b")]


def year_pair(df: DataFrame, y1: int, y2: int, cols: Sequence[str]) -> DataFrame:
    """Cells stored in both years, `cols` suffixed _1 and _2."""
    side = [
        df.where(F.col("year") == y).select("row", "col", *[F.col(x).alias(f"{x}_{i}") for x in cols])
        for i, y in ((1, y1), (2, y2))]
    return side[0].join(side[1], ["row", "col"])


def change_category(a: Column, b: Column) -> Column:
    return (
        F.when(a & b, "persistent").when(~a & b, "new").when(a & ~b, "disappeared").otherwise("stable_not"))


def transition_matrix(pairs: DataFrame, a: str, b: str, classes: Sequence[int]) -> DataFrame:
    """Counts and row shares over all class pairs, zeros kept. The class frame is a fixed few rows."""
    spark = pairs.sparkSession
    frame = spark.createDataFrame([(int(x), int(y)) for x in classes for y in classes], f"{a} int, {b} int")
    n = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(frame).join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = full.groupBy(a).agg(F.sum("n").alias("row_total"))
    return full.join(F.broadcast(total), a).withColumn("share", F.try_divide(F.col("n"), F.col("row_total")))


def zone_pairs(a: DataFrame, b: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Zone pairs of two label tables that share at least `min_share` of the smaller zone."""
    x = a.select("row", "col", F.col("zone_id").alias("zone_a"), F.col("n_px").alias("n_a"))
    y = b.select("row", "col", F.col("zone_id").alias("zone_b"), F.col("n_px").alias("n_b"))
    p = x.join(y, ["row", "col"]).groupBy("zone_a", "zone_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    return p.where(F.col("shared") >= F.lit(min_share) * F.least("n_a", "n_b"))


def zone_changes(a: DataFrame, b: DataFrame, min_share: float = 0.5) -> DataFrame:
    """(change, n_zones): persistent and declining zones of a, emerging zones of b.

    A matched zone that lost cells to its largest partner is declining.
    """
    p = zone_pairs(a, b, min_share)
    best = p.groupBy("zone_a", "n_a").agg(F.max(F.struct("shared", "n_b", (-F.col("zone_b")).alias("z"))).alias("m"))
    za = a.select(F.col("zone_id").alias("zone_a")).distinct()
    zb = b.select(F.col("zone_id").alias("zone_b")).distinct()
    kept = best.select(F.when(F.col("m.n_b") < F.col("n_a"), "declining").otherwise("persistent").alias("change"))
    lost = za.join(best, "zone_a", "left_anti").select(F.lit("lost").alias("change"))
    new = zb.join(p.select("zone_b").distinct(), "zone_b", "left_anti").select(F.lit("emerging").alias("change"))
    return kept.unionByName(lost).unionByName(new).groupBy("change").agg(F.count(F.lit(1)).alias("n_zones"))


def duplicate_audit(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """Groups met more than once, and the rows beyond the first, per named key."""
    out = None
    for name, cols in keys.items():
        g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(
            F.lit(name).alias("key"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))
        out = g if out is None else out.unionByName(g)
    return out


def exact_compare(
    a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float | Mapping[str, float] = 0.0, by: Sequence[str] = (),
) -> DataFrame:
    """Rows on one side only, and rows whose values differ by more than `tol` (one, or one per column), per column and group."""
    tols = dict(tol) if isinstance(tol, Mapping) else dict.fromkeys(values, tol)
    x = a.select(*keys, F.lit(1).alias("_a"), *[F.col(v).alias(f"a_{v}") for v in values])
    y = b.select(*keys, F.lit(1).alias("_b"), *[F.col(v).alias(f"b_{v}") for v in values])
    j = x.join(y, list(keys), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = {
        v: F.coalesce(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) <= tols[v], F.col(f"a_{v}").isNull() & F.col(f"b_{v}").isNull())
        for v in values}
    return j.groupBy(*by).agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        *[F.count_if(both & ~same[v]).alias(f"differ_{v}") for v in values])


def upsert_section(table: DataFrame, section: str, value: str, rows: DataFrame) -> DataFrame:
    """The table with one section's rows replaced; doing it twice changes nothing."""
    return table.where(F.coalesce(F.col(section) != value, F.lit(True))).unionByName(rows)
