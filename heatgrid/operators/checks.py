"""Data-quality gates: one row per check, (check_id, n_bad, ok)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one aggregate pass; a rule counts the rows where its condition holds (is bad)."""
    one = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"_{i}") for i, bad in enumerate(rules.values())])
    rows = ", ".join(f"'{name}', _{i}" for i, name in enumerate(rules))
    return one.select(F.expr(f"stack({len(rules)}, {rows}) as (check_id, n_bad)")).withColumn("ok", F.col("n_bad") == 0)


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def scalar_check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    """A check over a small table of aggregates: every bad row counts."""
    return checks(df, {name: bad})


def range_checks(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: values outside [lo, hi], NULLs and infinities."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double), cast({lo} as double), cast({hi} as double)" for c, (lo, hi) in ranges.items())
    d = df.select(F.expr(f"stack({len(ranges)}, {pairs}) as (variable, v, lo, hi)"))
    v = F.col("v")
    out = d.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
        F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_bad"))
    return out.withColumn("ok", (F.col("n_bad") == 0) & (F.col("n_inf") == 0))


def grid_audit(meta: DataFrame, res: float, tol: float = 1e-9) -> DataFrame:
    """Alignment class of each raster's grid with the wanted one: offset as a share of a pixel."""
    ratio = F.col("res") / F.lit(res)
    off = F.abs(F.col("origin") / F.col("res") - F.round(F.col("origin") / F.col("res")))
    kind = (
        F.when(F.abs(ratio - 1) > 0.5, "MISMATCH").when(F.abs(ratio - 1) > tol, "RESAMPLING")
        .when(off > 1e-6, "HALF_PIXEL_SHIFT").when(F.col("n_cells") != F.col("n_expected"), "SAME_GRID").otherwise("EXACT"))
    return meta.withColumn("alignment", kind)


def missing_inputs(have: DataFrame, want: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected inputs that are not there."""
    return want.join(have.select(*keys).distinct(), list(keys), "left_anti")


def ring_validity(vertices: DataFrame, keys: Sequence[str] = ("feature", "ring")) -> DataFrame:
    """Per ring: vertices, closed or not, NULLs, and zero-length sides, without gathering the ring."""
    first, last = F.min_by(F.struct("x", "y"), "pos"), F.max_by(F.struct("x", "y"), "pos")
    return vertices.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), (first == last).alias("closed"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_null"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"),
    ).withColumn("valid", F.col("closed") & (F.col("n_points") >= 4) & (F.col("n_null") == 0))
