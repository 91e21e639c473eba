"""Profiles, class areas and grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.operators.quantiles import exact_quantiles_long, long_form, ranked

HA = 0.09
INF = float("inf")


def _stacked(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(*by, F.expr(f"stack({len(cols)}, {pairs}) as (variable, v)"))


def band_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per band: rows, finite, NaN/NULL, infinities, zeros and moments of the finite values."""
    d = _stacked(df, [], cols)
    v = F.col("v")
    nan = v.isNull() | F.isnan(v)
    fin = ~nan & (F.abs(v) < INF)
    x = F.when(fin, v)
    return d.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fin).alias("n_finite"), F.count_if(nan).alias("n_nan"),
        F.count_if(v == INF).alias("n_pos_inf"), F.count_if(v == -INF).alias("n_neg_inf"),
        F.count_if(x == 0).alias("n_zero"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"))


def nodata_audit(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Zeros and NULLs per band inside and outside the region where every band is stored."""
    inside = F.lit(True)
    for b in bands:
        inside = inside & F.col(b).isNotNull()
    d = df.withColumn("inside", inside)
    s = _stacked(d, ["inside"], bands)
    a = s.groupBy("variable").agg(
        F.count_if(F.col("inside") & (F.col("v") == 0)).alias("zeros_inside"),
        F.count_if(~F.col("inside") & (F.col("v") == 0)).alias("zeros_outside"),
        F.count_if(F.col("v").isNull()).alias("n_null"))
    kind = (
        F.when((F.col("zeros_inside") == 0) & (F.col("zeros_outside") == 0), "none")
        .when(F.col("zeros_outside") > F.col("zeros_inside"), "fill").otherwise("value"))
    return a.withColumn("zero_kind", kind)


def describe(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, minimum, quartiles and maximum per group and variable."""
    long = long_form(df, by, cols)
    k = [*by, "variable"]
    base = long.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    q = exact_quantiles_long(long, k, [0.25, 0.5, 0.75])
    return base.join(q.select(*k, *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))]), k)


def correlations(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete Pearson r of every pair, one aggregate pass, as (a, b, r) rows."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    return wide.select(*by, F.expr(f"stack({len(pairs)}, {rows}) as (a, b, r)"))


def pearson_spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ("year",)) -> DataFrame:
    d = ranked(df.select(*by, x, y), by, F.col(x), out="_rx", method="average")
    d = ranked(d, by, F.col(y), out="_ry", method="average")
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def class_area(df: DataFrame, label: str, by: Sequence[str] = ("year",)) -> DataFrame:
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("pixels"))
    total = n.groupBy(*by).agg(F.sum("pixels").alias("_t"))
    return n.join(F.broadcast(total), list(by)).select(
        *by, label, "pixels", (F.col("pixels") * HA).alias("area_ha"),
        (F.col("pixels") * 100.0 / F.col("_t")).alias("percent"))


def share(cond: Column) -> Column:
    return F.count_if(cond) * 100.0 / F.count(F.lit(1))


def class_counts(label: str, n: int) -> list[Column]:
    return [F.count_if(F.col(label) == k).alias(f"class_{k}") for k in range(n)]


def quantile_bins(df: DataFrame, by: Sequence[str], x: str, n: int) -> DataFrame:
    """Adds `bin` = number of inner quantile edges <= x, and the group's `edges`.

    The edge table has one row per group of a low-cardinality `by`: broadcast.
    """
    q = exact_quantiles_long(
        df.select(*by, F.col(x).cast("double").alias("v")).where("v is not null"), by, [i / n for i in range(n + 1)])
    e = q.select(*by, F.col("q").alias("edges"))
    inner = F.slice("edges", 2, n - 1)
    return df.join(F.broadcast(e), list(by)).withColumn(
        "bin", F.size(F.filter(inner, lambda t: F.col(x) >= t)))
