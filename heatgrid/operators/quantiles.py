"""Exact linear-interpolation quantiles and ranks that never gather a group in one task.

Built-in `percentile` keeps one counting map per group in the final task, which is right for
many small groups and wrong for a group holding a large share of all rows (a year, a block).
Here a group is cut by a fixed, data-independent, monotone bucket of the value: a first pass
counts buckets (map-side combined, so only bucket counts move), running totals tell which bucket
holds each wanted rank, and a second pass orders only the rows of those buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A group above this many rows is not packed into one task's array but split by value bucket.
HOT_ROWS = 200_000


def value_bucket(c: Column, scale: float = 1e-6, steps: int = 512) -> Column:
    """Monotone integer bucket with about 1/steps relative width; needs no look at the data."""
    c = c.cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c) / F.lit(scale)) * F.lit(steps)).cast("int")


def _lerp(lo: Column, hi: Column, frac: Column) -> Column:
    return lo + (hi - lo) * frac


def long_form(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by, variable, v) without NULLs."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(*by, F.expr(f"stack({len(cols)}, {pairs}) as (variable, v)")).where(
        F.col("v").isNotNull()
    )


def exact_quantiles_long(long: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """`by` + (n, q: array<double>) of column `v`, for a low-cardinality `by` of any group size.

    `need` below holds at most two rows per group and probability, hence the broadcast.
    """
    by = list(by)
    b = long.withColumn("_b", value_bucket(F.col("v")))
    hist = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    need = _wanted(hist, by, probs)
    keys = [*by, "_b"]
    picked = b.join(F.broadcast(need.select(*keys)), keys, "left_semi")
    return _settle(picked, need, by, probs)


def leave_out_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], own: str = "own", fold: str = "fold"
) -> DataFrame:
    """`by` + (fold, variable, n, q): quantiles over the rows whose `own` fold is another one.

    A fold's bucket counts are the counts of all rows less its own, so the rows are never copied
    once per fold; only rows of the wanted buckets, much the same ones for every fold, are.
    """
    by = [*by, "variable"]
    b = long_form(df, [own, *by[:-1]], cols).withColumn("_b", value_bucket(F.col("v")))
    mine = b.groupBy(*by, own, "_b").agg(F.count(F.lit(1)).alias("_m"))
    every = mine.groupBy(*by, "_b").agg(F.sum("_m").alias("_n"))
    folds = mine.agg(F.array_sort(F.collect_set(own)).alias("_fs"))
    grid = every.join(F.broadcast(folds)).withColumn(fold, F.explode("_fs")).drop("_fs")
    hist = (
        grid.join(mine.withColumnRenamed(own, fold), [*by, fold, "_b"], "left")
        .withColumn("_n", F.col("_n") - F.coalesce("_m", F.lit(0))).where("_n > 0").drop("_m"))
    keys = [*by, fold]
    need = _wanted(hist, keys, probs)
    wanted = F.broadcast(need.select(*keys, "_b"))
    picked = b.join(wanted, [*by, "_b"]).where(F.col(own) != F.col(fold)).drop(own)
    return _settle(picked, need, keys, probs)


def split_quantiles(
    df: DataFrame, splits: Sequence[Column], by: Sequence[str], value: str, probs: Sequence[float], split: str = "_split"
) -> DataFrame:
    """(split number, `by`, n, q): quantiles over the rows each condition of `splits` holds for, in one pair of passes.

    Rows go by the list of splits they belong to, and their bucket counts are combined before they are counted for
    each split; only rows of the wanted buckets are copied once per split.
    """
    by = list(by)
    ins = F.filter(F.array(*[F.when(s, F.lit(i)) for i, s in enumerate(splits)]), lambda x: x.isNotNull())
    b = df.select(*by, F.col(value).cast("double").alias("v"), ins.alias("_in")).where(F.col("v").isNotNull()).withColumn("_b", value_bucket(F.col("v")))
    keys = [split, *by]
    hist = (
        b.groupBy(*by, "_in", "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(split, F.explode("_in")).groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")))
    need = _wanted(hist, keys, probs)
    picked = b.join(F.broadcast(need.select(*keys, "_b")), [*by, "_b"]).where(F.array_contains(F.col("_in"), F.col(split))).drop("_in")
    return _settle(picked, need, keys, probs)


def _wanted(hist: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Buckets holding a wanted rank: (by, _b, _lo rows before it, _total, _ranks)."""
    run = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    ranks = F.array(
        *[
            f((F.col("_total") - 1) * F.lit(float(p))).cast("long")
            for p in probs
            for f in (F.floor, F.ceil)
        ]
    )
    cum = (
        hist.withColumn("_hi", F.sum("_n").over(run))
        .withColumn("_total", F.sum("_n").over(W.partitionBy(*by)))
        .withColumn("_lo", F.col("_hi") - F.col("_n"))
        .withColumn(
            "_ranks",
            F.array_distinct(
                F.filter(ranks, lambda k: (k >= F.col("_lo")) & (k < F.col("_hi")))
            ),
        )
    )
    return cum.where(F.size("_ranks") > 0).select(*by, "_b", "_lo", "_total", "_ranks")


def _settle(picked: DataFrame, need: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Order the values of the wanted buckets and read the quantiles off: `by` + (n, q)."""
    keys = [*by, "_b"]
    counts = picked.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("_n"))
    inside = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    at_rank = (
        counts.join(F.broadcast(need), keys)
        .withColumn("_end", F.col("_lo") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_k", F.explode("_ranks"))
        .where((F.col("_k") >= F.col("_start")) & (F.col("_k") < F.col("_end")))
    )
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        picks.append(F.max(F.when(F.col("_k") == F.floor(pos), F.col("v"))).alias(f"_l{i}"))
        picks.append(F.max(F.when(F.col("_k") == F.ceil(pos), F.col("v"))).alias(f"_h{i}"))
    wide = at_rank.groupBy(*by, "_total").agg(*picks)
    q = [
        _lerp(
            F.col(f"_l{i}"),
            F.col(f"_h{i}"),
            (F.col("_total") - 1) * F.lit(float(p)) - F.floor((F.col("_total") - 1) * F.lit(float(p))),
        )
        for i, p in enumerate(probs)
    ]
    return wide.select(*by, F.col("_total").alias("n"), F.array(*q).alias("q"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """`by` + (variable, n, q) for several columns in one pair of passes."""
    return exact_quantiles_long(long_form(df, by, cols), [*by, "variable"], probs)


def quantile_columns(
    df: DataFrame, by: Sequence[str], names: dict[str, Sequence[str]], probs: Sequence[float]
) -> DataFrame:
    """One row per `by`; `names` maps a column to the result names, one per probability."""
    q = exact_quantiles(df, by, list(names), probs)
    aggs = [
        F.max(F.when(F.col("variable") == c, F.col("q")[i])).alias(name)
        for c, outs in names.items()
        for i, name in enumerate(outs)
    ]
    return q.groupBy(*by).agg(*aggs)


def _array_quantile(a: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array; NULL when it is empty."""
    pos = (F.size(a) - 1) * F.lit(float(p))
    lo, hi = F.get(a, F.floor(pos).cast("int")), F.get(a, F.ceil(pos).cast("int"))
    return F.when(F.size(a) > 0, _lerp(lo, hi, pos - F.floor(pos)))


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    names: dict[str, Sequence[str]],
    probs: Sequence[float],
    extra: Sequence[Column] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """As `quantile_columns`, for many mostly small groups (pixels, zones).

    A group of up to `hot_rows` rows is packed into one array of rows - one aggregation buffer
    whatever the number of columns - and its columns are sorted in place. Larger groups are split
    off before anything is packed and take the bucketed way. `extra` are further aggregates.
    The hot keys are usually none, and the adaptive planner then drops both joins.
    """
    by = list(by)
    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*by)
    cols = list(names)
    rows = F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"q{i}") for i, c in enumerate(cols)]))
    # Arrays gain nothing from map-side combining: move plain rows once, then pack.
    # The hot keys go before that move; there are at most rows / hot_rows of them.
    packed = df.join(F.broadcast(hot), by, "left_anti").repartition(*by).groupBy(*by).agg(rows.alias("_rows"), *extra)
    others = [c for c in packed.columns if c not in (*by, "_rows")]
    packed = packed.select(*by, *others, *[
        F.sort_array(F.filter(F.col(f"_rows.q{i}"), lambda x: x.isNotNull())).alias(f"_a{i}") for i in range(len(cols))])
    cold = packed.select(*by, *[
        _array_quantile(F.col(f"_a{i}"), p).alias(name)
        for i, c in enumerate(cols) for p, name in zip(probs, names[c])], *others)
    heavy = df.join(F.broadcast(hot), by, "left_semi")
    warm = quantile_columns(heavy, by, names, probs)
    if extra:
        warm = heavy.groupBy(*by).agg(*extra).join(warm, by, "left")
    return cold.unionByName(warm.select(*cold.columns))


def ranked(
    df: DataFrame,
    by: Sequence[str],
    score: Column,
    ties: Sequence[Column] = (),
    out: str = "rank",
    method: str = "row_number",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ascending rank of `score` within `by`, however large the group.

    `row_number` orders equal scores by `ties` (the first must be numeric and also cuts a crowded score into
    pieces), `rank` gives all the lowest position, `average` the mean position. Pass a negated score for
    descending ranks. Rows with a null score or key are left out.
    """
    by = list(by)
    d = df.withColumn("_s", score.cast("double")).withColumn("_b", value_bucket(F.col("_s")))
    if method == "row_number":
        return _numbered(d, by, ties, hot_rows).withColumnRenamed("_pos", out).select(*df.columns, out)
    counts = d.groupBy(*by, "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    coarse = _offsets(counts.groupBy(*by, "_b").agg(F.sum("_n").alias("_m")), by)
    within = W.partitionBy(*by, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    start = (
        counts.join(coarse, [*by, "_b"])
        .withColumn("_off", F.col("_off") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    )
    joined = d.join(start, [*by, "_b", "_s"])
    pos = F.col("_off") + 1 if method == "rank" else F.col("_off") + (F.col("_n") + 1) / 2.0
    kind = "double" if method == "average" else "int"
    return joined.withColumn(out, pos.cast(kind)).select(*df.columns, out)


def _offsets(sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _b, _m rows of the bucket, _off rows of the buckets before it)."""
    before = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0)))


def _numbered(d: DataFrame, by: Sequence[str], ties: Sequence[Column], hot_rows: int) -> DataFrame:
    """Row numbers `_pos` by `_s` and `ties`: rows move once, by bucket.

    Only buckets above `hot_rows` (at most rows / hot_rows of them) are cut further, by score and by bucket of the first tie.
    """
    keys = [*by, "_b"]
    coarse = _offsets(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), by)
    hot = coarse.where(F.col("_m") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    d = d.join(F.broadcast(hot), keys, "left").withColumns({
        "_f": F.when(F.col("_hot"), F.col("_s")).otherwise(0.0),
        "_t": F.when(F.col("_hot"), F.coalesce(value_bucket(ties[0]), F.lit(-1))).otherwise(-1) if ties else F.lit(-1)})
    fine = [*keys, "_f", "_t"]
    within = W.partitionBy(*keys).orderBy("_f", "_t").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        d.where("_hot").groupBy(*fine).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(coarse, keys).select(*fine, (F.col("_off") + F.col("_in")).alias("_off")))
    whole = coarse.where(F.col("_m") <= hot_rows).select(*keys, F.lit(0.0).alias("_f"), F.lit(-1).alias("_t"), "_off")
    order = W.partitionBy(*fine).orderBy("_s", *ties)
    return d.join(whole.unionByName(pieces), fine).withColumn("_pos", (F.col("_off") + F.row_number().over(order)).cast("int"))
