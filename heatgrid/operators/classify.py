"""Thresholds from training rows, classes from thresholds, and the rule-score baseline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from heatgrid.operators.quantiles import exact_quantiles, quantile_columns


def year_thresholds(train: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ("year",)) -> DataFrame:
    """(by, thresholds array) from the given rows only; never pass validation rows."""
    q = exact_quantiles(train, by, [value], probs)
    return q.select(*by, F.col("q").alias("thresholds"))


def class_of(value: Column, thresholds: Column, rule: str = "right") -> Column:
    """right: #(t <= v); left: #(t < v), so an edge belongs to the class below it."""
    hit = {"right": lambda t: value >= t, "left": lambda t: value > t}[rule]
    return F.when(value.isNotNull(), F.size(F.filter(thresholds, hit)))


def assign_class(
    df: DataFrame, thresholds: DataFrame, value: str, out: str, rule: str = "right", by: Sequence[str] = ("year",)
) -> DataFrame:
    """The threshold table has one short row per year (or fold and year): broadcast."""
    return df.join(F.broadcast(thresholds), list(by)).withColumn(
        out, class_of(F.col(value), F.col("thresholds"), rule)
    )


def assign_known_class(
    df: DataFrame, thresholds: Sequence[Row], value: str, out: str, rule: str = "right", by: Sequence[str] = ("year",)
) -> DataFrame:
    """`assign_class` by thresholds already at the driver: they are part of the expression, so that rows read again and again need no join."""
    known = F.lit(None).cast("array<double>")
    for t in thresholds:
        here = [F.col(b) == F.lit(t[b]) for b in by]
        known = F.when(reduce(and_, here), F.array(*[F.lit(float(x)) for x in t["thresholds"]])).otherwise(known)
    return df.withColumn("thresholds", known).where(F.col("thresholds").isNotNull()).withColumn(
        out, class_of(F.col(value), F.col("thresholds"), rule))


def class_of_edges(value: Column, edges: Sequence[float], rule: str = "left") -> Column:
    """`class_of` for fixed edges, without a loop over an array that would work `value` out anew at each edge."""
    hit = {"right": lambda t: value >= t, "left": lambda t: value > t}[rule]
    return sum((hit(F.lit(float(e))).cast("int") for e in edges[1:]), hit(F.lit(float(edges[0]))).cast("int"))


def rule_score(df: DataFrame, train: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """s = scaled(ndbi) - scaled(ndvi), each clipped to the training rows' p5..p95 of its year."""
    bounds = quantile_columns(
        train, by, {"ndbi": ["_b5", "_b95"], "ndvi": ["_v5", "_v95"]}, [0.05, 0.95]
    )
    return scale_by_bounds(df, bounds, by)


def scale_by_bounds(df: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rule score from a small table of bounds per `by`."""

    def scaled(x, lo, hi):
        span = F.col(hi) - F.col(lo)
        clipped = F.least(F.greatest(F.col(x), F.col(lo)), F.col(hi))
        return F.coalesce(F.try_divide(clipped - F.col(lo), span), F.lit(0.0))

    return (
        df.join(F.broadcast(bounds), list(by))
        .withColumn("s", scaled("ndbi", "_b5", "_b95") - scaled("ndvi", "_v5", "_v95"))
        .select(*df.columns, "s")
    )


def class_balance(df: DataFrame, label: str, by: Sequence[str] = ("year",)) -> DataFrame:
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), list(by)).select(
        *by, label, "n", (F.col("n") / F.col("total")).alias("share")
    )


def boundary_distance(value: Column, thresholds: Column) -> Column:
    return F.array_min(F.transform(thresholds, lambda t: F.abs(value - t)))


def nearest_threshold(value: Column, thresholds: Column) -> Column:
    """Index of the closest threshold, the lowest on ties."""
    d = F.transform(thresholds, lambda t: F.abs(value - t))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")
