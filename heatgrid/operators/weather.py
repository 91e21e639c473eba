"""Hourly station weather and daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def met_window(met: DataFrame, names: Sequence[str], hours: Sequence[int], months: Sequence[int]) -> DataFrame:
    """Mean of each variable per station and year over the given hours and months."""
    keep = F.hour("time_utc").isin(*hours) & F.month("time_utc").isin(*months)
    return met.where(keep).groupBy(F.year("time_utc").alias("met_year"), "point_id", "lat", "lon").agg(
        *[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n"))


def daily_mean(met: DataFrame, names: Sequence[str]) -> DataFrame:
    return met.groupBy(F.to_date("time_utc").alias("day")).agg(*[F.avg(n).alias(n) for n in names])


def _days(n_back: int, n_on: int):
    return W.partitionBy("year").orderBy("day").rowsBetween(-n_back, n_on)


def monsoon_onset(daily: DataFrame, value: str, window: int = 10, bound: float = 2.5, persist: int = 3,
                  first: tuple[int, int] = (6, 1)) -> DataFrame:
    """First day from `first` whose trailing mean reaches the bound and keeps it `persist` days."""
    d = daily.withColumn("_n", F.count(value).over(_days(window - 1, 0)))
    d = d.withColumn("_m", F.when(F.col("_n") == window, F.avg(value).over(_days(window - 1, 0))))
    ok = F.coalesce(F.col("_m") >= bound, F.lit(False)).cast("int")
    d = d.withColumn("_ok", ok)
    d = d.withColumn("_run", F.sum("_ok").over(_days(0, persist - 1)))
    md = F.month("day") * 100 + F.dayofmonth("day")
    hit = F.when((F.col("_run") == persist) & (md >= first[0] * 100 + first[1]), F.col("day"))
    return d.groupBy("year").agg(F.min(hit).alias("onset"))


def hottest_period(daily: DataFrame, value: str, window: int = 30) -> DataFrame:
    """End day and mean of the hottest trailing window; the earliest on ties."""
    d = daily.withColumn("_n", F.count(value).over(_days(window - 1, 0)))
    d = d.withColumn("_m", F.round(F.avg(value).over(_days(window - 1, 0)), 9)).where(F.col("_n") == window)
    best = F.max(F.struct(F.col("_m"), (-F.unix_date("day")).alias("neg"))).alias("b")
    return d.groupBy("year").agg(best).select(
        "year", F.date_from_unix_date(-F.col("b.neg")).alias("window_end"), F.col("b._m").alias("mean_value"))


def completeness(met: DataFrame, names: Sequence[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per station: hours seen, hours of its span missing, repeats, NULLs, and values out of range."""
    hours = met.groupBy("point_id", F.date_trunc("hour", "time_utc").alias("h")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(v).isNull()).alias(f"null_{v}") for v in names],
        *[F.count_if(~F.col(v).between(*ranges[v])).alias(f"out_{v}") for v in ranges])
    span = (F.unix_timestamp(F.max("h")) - F.unix_timestamp(F.min("h"))) / 3600 + 1
    return hours.groupBy("point_id").agg(
        F.count(F.lit(1)).alias("n_hours"), (span.cast("long") - F.count(F.lit(1))).alias("n_missing"),
        F.sum(F.col("n") - 1).alias("n_repeats"), *[F.sum(f"null_{v}").alias(f"null_{v}") for v in names],
        *[F.sum(f"out_{v}").alias(f"out_{v}") for v in ranges])


def parse_hourly(df: DataFrame, payload: str, schema: str, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays of a JSON payload as rows; `ok` says whether all arrays have one length."""
    j = df.withColumn("_j", F.from_json(payload, schema))
    sizes = [F.size(F.col("_j")[a]) for a in arrays]
    ok: Column = F.lit(True)
    for s in sizes[1:]:
        ok = ok & (s == sizes[0])
    z = j.withColumn("ok", ok).withColumn("_r", F.explode(F.arrays_zip(*[F.col("_j")[a].alias(a) for a in arrays])))
    keep = [c for c in df.columns if c != payload]
    return z.select(*keep, "ok", *[F.col("_r")[a].alias(a) for a in arrays])
