"""Geographic cross-validation and metrics, with any `fit` given as DataFrame -> DataFrame.

The thresholds of a fold come from its training rows only. Rule models take the fold as one more
grouping key, so all folds of a protocol run as one job; MLlib estimators are fitted per fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.operators import classify as L
from heatgrid.operators.quantiles import leave_out_quantiles
from heatgrid.operators.ranking import hash_number
from heatgrid.session import cut

Fit = Callable[[DataFrame, DataFrame], DataFrame]


def group_sizes(df: DataFrame, group: str = "block_id", max_groups: int = 100_000) -> dict:
    """Rows of each group, the largest first. They are all that is brought to the driver; more than `max_groups` are refused."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), group).limit(max_groups + 1).collect()
    if len(sizes) > max_groups:
        raise ValueError(f"{group} has more than {max_groups} values: folds are of few, large groups")
    return {r[group]: r["n"] for r in sizes}


def deal(sizes: Mapping, k: int) -> dict:
    """Group -> fold: whole groups in the given order (the largest first), each to the lightest fold."""
    load, out = [0] * k, {}
    for g, n in sizes.items():
        out[g] = min(range(k), key=lambda i: (load[i], i))
        load[out[g]] += n
    return out


def group_folds(df: DataFrame, k: int = 5, group: str = "block_id", exclude: Sequence[int] = (), max_groups: int = 100_000) -> DataFrame:
    """(group, fold): whole groups, the largest first to the lightest fold."""
    sizes = group_sizes(df.where(~F.col(group).isin(*exclude)) if exclude else df, group, max_groups)
    return df.sparkSession.createDataFrame([(int(g), f) for g, f in deal(sizes, k).items()], f"{group} int, fold int")


def learning_prefix(df: DataFrame, fractions: Sequence[float], group: str = "block_id") -> DataFrame:
    """Rows of the first max(1, round(f n)) sorted groups, once per fraction. The block list is small."""
    blocks = df.select(group).distinct()
    packed = blocks.agg(F.array_sort(F.collect_set(group)).alias("_g"))
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    keep = (
        packed.select("_g", F.explode(fr).alias("fraction"))
        .select("fraction", F.explode(F.slice(
            "_g", 1, F.greatest(F.lit(1), F.bround(F.col("fraction") * F.size("_g"), 0).cast("int")))).alias(group)))
    return df.join(F.broadcast(keep), group)


def fold_rows(df: DataFrame, folds: DataFrame, group: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(train, validation) with a `fold` column, for all folds at once.

    A row is a training row of every fold but its own: k - 1 copies, k a small constant.
    """
    f = F.broadcast(folds.withColumnRenamed("fold", "own"))
    every = folds.agg(F.array_sort(F.collect_set("fold")).alias("_fs"))
    d = df.join(f, group).join(F.broadcast(every))
    train = d.withColumn("fold", F.explode(F.array_remove("_fs", F.col("own")))).drop("_fs", "own")
    return train, d.withColumn("fold", F.col("own")).drop("_fs", "own")


def rule_predictions(train: DataFrame, val: DataFrame, by: Sequence[str], k: int = 3, value: str = "lst_c") -> DataFrame:
    """Validation rows with true class and rule class, thresholds and bounds from training rows only.

    `by` names the protocol key (fold, split) and year; one job whatever the number of folds.
    """
    by = list(by)
    probs = [i / k for i in range(1, k)]
    drop = [x for x in ("y_true", "y_pred", "s", "thresholds") if x in val.columns]
    tr, va = train.drop(*drop), val.drop(*drop)
    truth = L.year_thresholds(tr, value, probs, by)
    nudge = 1.2345e-9
    st = L.rule_score(tr, tr, by).withColumn("s", F.round(F.col("s") + nudge, 6))
    sv = L.rule_score(va, tr, by).withColumn("s", F.round(F.col("s") + nudge, 6))
    cut_s = L.year_thresholds(st, "s", probs, by)
    out = L.assign_class(sv, truth, value, "y_true", by=by).drop("thresholds")
    return L.assign_class(out, cut_s, "s", "y_pred", by=by).drop("thresholds")


def fold_rule_predictions(
    df: DataFrame, folds: DataFrame, group: str = "block_id", k: int = 3, value: str = "lst_c"
) -> DataFrame:
    """The rule model on every fold at once, each row predicted by the fold that left it out.

    Bounds and true-class thresholds come from leave-out counts, without copying rows. The score
    depends on the fold's bounds, so three narrow columns are scored once per other fold; their
    bucket counts are combined before any of it is shuffled.
    """
    probs = [i / k for i in range(1, k)]
    d = df.drop(*[x for x in ("y_true", "y_pred", "s", "thresholds") if x in df.columns])
    d = d.join(F.broadcast(folds.select(group, F.col("fold").alias("own"))), group)
    q = leave_out_quantiles(d, ["year"], ["ndbi", "ndvi", value], [0.05, 0.95, *probs])

    def of(v, i):
        return F.max(F.when(F.col("variable") == v, F.col("q")[i]))

    by = ["fold", "year"]
    # One row per fold and year, read three times below: settled once.
    table = cut(q.groupBy(*by).agg(
        of("ndbi", 0).alias("_b5"), of("ndbi", 1).alias("_b95"), of("ndvi", 0).alias("_v5"), of("ndvi", 1).alias("_v95"),
        F.array(*[of(value, 2 + i) for i in range(len(probs))]).alias("thresholds")))
    bounds, truth = table.drop("thresholds"), table.select(*by, "thresholds")
    every = folds.agg(F.array_sort(F.collect_set("fold")).alias("_fs"))
    narrow = d.select("year", "ndbi", "ndvi", "own").join(F.broadcast(every))
    narrow = narrow.withColumn("fold", F.explode(F.array_remove("_fs", F.col("own")))).drop("_fs", "own")
    nudge = 1.2345e-9

    def score(x):
        return L.scale_by_bounds(x, bounds, by).withColumn("s", F.round(F.col("s") + nudge, 6))

    cut_s = L.year_thresholds(score(narrow), "s", probs, by)
    val = score(d.withColumn("fold", F.col("own")).drop("own"))
    out = L.assign_class(val, truth, value, "y_true", by=by).drop("thresholds")
    return L.assign_class(out, cut_s, "s", "y_pred", by=by).drop("thresholds")


def confusion(pred: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """Counts n_{true}_{pred} per group in one aggregate row."""
    return pred.groupBy(*by).agg(*[
        F.count_if((F.col("y_true") == i) & (F.col("y_pred") == j)).alias(f"n_{i}_{j}") for i in range(k) for j in range(k)])


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(pred: DataFrame, by: Sequence[str], k: int = 3, per_class: bool = True) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted P/R/F1, kappa; 0 where a ratio is undefined."""
    m = confusion(pred, by, k)
    n = {(i, j): F.col(f"n_{i}_{j}").cast("double") for i in range(k) for j in range(k)}
    total = sum((n[i, j] for i in range(k) for j in range(k)), F.lit(0.0))
    sup = [sum((n[i, j] for j in range(k)), F.lit(0.0)) for i in range(k)]
    got = [sum((n[i, j] for i in range(k)), F.lit(0.0)) for j in range(k)]
    p = [_safe(n[i, i], got[i]) for i in range(k)]
    r = [_safe(n[i, i], sup[i]) for i in range(k)]
    f1 = [_safe(2 * p[i] * r[i], p[i] + r[i]) for i in range(k)]
    hit = sum((n[i, i] for i in range(k)), F.lit(0.0))
    acc = _safe(hit, total)
    chance = _safe(sum((sup[i] * got[i] for i in range(k)), F.lit(0.0)), total * total)
    seen = sum(((sup[i] > 0).cast("int") for i in range(k)), F.lit(0))

    def mean(x):
        return sum(x, F.lit(0.0)) / k

    def weighted(x):
        return _safe(sum((x[i] * sup[i] for i in range(k)), F.lit(0.0)), total)

    out = {
        "n": total.cast("long"), "accuracy": acc, "balanced_accuracy": _safe(sum(r, F.lit(0.0)), seen),
        "macro_precision": mean(p), "macro_recall": mean(r), "macro_f1": mean(f1), "weighted_precision": weighted(p),
        "weighted_recall": weighted(r), "weighted_f1": weighted(f1), "kappa": _safe(acc - chance, 1 - chance)}
    if per_class:
        for i in range(k):
            out |= {f"precision_{i}": p[i], f"recall_{i}": r[i], f"f1_{i}": f1[i], f"support_{i}": sup[i].cast("long")}
    return m.select(*by, *[v.alias(a) for a, v in out.items()])


def regression_metrics(pred: DataFrame, by: Sequence[str], y: str, yhat: str) -> DataFrame:
    """MAE, RMSE and R2 = 1 - SSE/SST, with residual spread."""
    e = F.col(y) - F.col(yhat)
    sse = F.sum(e * e)
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(sse, F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), F.avg(e).alias("residual_mean"),
        F.stddev_pop(e).alias("residual_std"), F.avg((F.abs(e) > 2).cast("int")).alias("share_over_2"))


def fold_summary(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in names)
    d = metrics.select(*by, F.expr(f"stack({len(names)}, {pairs}) as (metric, v)"))
    # One value per fold: small groups, so the built-in percentile is right.
    return d.groupBy(*by, "metric").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_pop"), F.stddev_samp("v").alias("std_samp"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", F.lit(0.5)).alias("median"),
        (F.max("v") - F.min("v")).alias("spread"))


def calibration(pred: DataFrame, by: Sequence[str], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bin table, scores): reliability per confidence bin; Brier score and ECE per group."""
    p, by = F.col("probability"), list(by)
    conf = F.array_max(p)
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    ks = F.sequence(F.lit(0), F.size(p) - 1)
    sq = F.aggregate(
        F.zip_with(p, ks, lambda x, k: F.pow(x - (k == F.col("y_true")).cast("int"), 2)), F.lit(0.0), lambda a, x: a + x)
    b = F.least(F.floor(conf * bins + 1e-9), F.lit(bins - 1)).cast("int")
    t = pred.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(hit).alias("accuracy"), F.sum(sq).alias("_sq"))
    s = t.groupBy(*by).agg(
        (F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")) / F.sum("n")).alias("ece"),
        (F.sum("_sq") / F.sum("n")).alias("brier"))
    return t.drop("_sq"), s


def morans_i(pred: DataFrame, edges: DataFrame, value: str, by: Sequence[str] = ("year",)) -> DataFrame:
    """Moran's I with row-standardised neighbour weights: two equi joins on the edge list."""
    by = list(by)
    mean = pred.groupBy(*by).agg(F.avg(value).alias("_m"))
    z = pred.join(F.broadcast(mean), by).select(*by, "row", "col", (F.col(value) - F.col("_m")).alias("z"))
    zn = z.withColumnsRenamed({"row": "n_row", "col": "n_col", "z": "zn"})
    per = edges.join(zn, [*by, "n_row", "n_col"]).groupBy(*by, "row", "col").agg(F.avg("zn").alias("lag"))
    j = z.join(per, [*by, "row", "col"], "left")
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("lag").alias("_w"), F.sum(F.col("z") * F.col("lag")).alias("_x"),
        F.sum(F.col("z") * F.col("z")).alias("_d")).select(
        *by, "n", (F.try_divide(F.col("n").cast("double"), F.col("_w")) * F.try_divide(F.col("_x"), F.col("_d"))).alias("morans_i"),
        (F.lit(-1.0) / (F.col("n") - 1)).alias("expected_i"))


def value_slices(ordered: DataFrame, size: DataFrame, by: Sequence[str], shifts: int, block: int) -> DataFrame:
    """(by, _t, vs): values `_z` of the places `_i` from _t * block on, `block + shifts` of them, round the end of the group."""
    laps = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(shifts) - F.col("_i")) / F.col("n")) + 1)
    u = F.col("_u")
    own = F.floor(u / block)
    d = (
        ordered.join(size.select(*by, "n"), by).withColumn("_lap", F.explode(laps)).withColumn("_u", F.col("_i") + F.col("_lap") * F.col("n"))
        .where(u < F.col("n") + shifts)
        .withColumn("_t", F.explode(F.when((u % block < shifts) & (u >= block), F.array(own, own - 1)).otherwise(F.array(own))))
        .where(F.col("_t") * block < F.col("n"))
    )
    packed = d.groupBy(*by, "_t").agg(F.array_sort(F.collect_list(F.struct("_u", "_z"))).alias("_all"))
    return packed.select(*by, "_t", F.col("_all._z").alias("vs"))


def shifted_values(pred: DataFrame, value: str, by: Sequence[str], shifts: int, seed: int | str, block: int = 1024) -> DataFrame:
    """(by, row, col, v): at every cell the array of its own value and of `shifts` permuted ones, as `morans_permutation` takes them."""
    by, block = list(by), max(block, shifts)
    z = _in_order(pred.select(*by, "row", "col", F.col(value).cast("double").alias("_z")), by, seed)
    slices = value_slices(z, z.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, shifts, block)
    at = (F.col("_i") % block + 1).cast("int")
    return z.withColumn("_t", F.floor(F.col("_i") / block)).join(slices, [*by, "_t"]).select(
        *by, "row", "col", F.slice("vs", at, F.lit(shifts + 1)).alias("v"))


def _in_order(cells: DataFrame, by: Sequence[str], seed: int | str) -> DataFrame:
    """Cells with their place `_i`, from 0, in a seeded random order of each group."""
    from heatgrid.operators.quantiles import ranked

    d = ranked(cells, by, hash_number(seed, *by, "row", "col"), [F.col("row"), F.col("col")], out="_i")
    return d.withColumn("_i", F.col("_i").cast("long") - 1)


def morans_permutation(
    pred: DataFrame, edges: DataFrame, value: str, by: Sequence[str] = ("year",), permutations: int = 199, seed: int | str = 42,
    tiles: int = 8, max_block: int = 1 << 20,
) -> DataFrame:
    """Moran's I with its expected value and a two-sided permutation p, one row per group.

    Cells stand in a seeded random order and permutation c gives a cell the value c places further on, round the end of
    its group: each c alone is a uniformly random permutation. p is (1 + permutations whose |I - E| reaches the observed
    one) / (1 + permutations). An edge travels as two places and a weight. The order is cut into blocks (a `tiles`-th of the
    largest group, `max_block` at most); the edges between two blocks meet those blocks' values once for all permutations.
    Rows whose value is null take no part; a constant group has null I and p.
    """
    by = list(by)
    pred = pred.where(F.col(value).isNotNull())
    mean = pred.groupBy(*by).agg(F.avg(value).alias("_m"))
    z = pred.join(F.broadcast(mean), by).select(*by, "row", "col", (F.col(value) - F.col("_m")).alias("_z"))
    z = cut(_in_order(z, by, seed))
    size = cut(z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_d")))
    most = size.agg(F.max("n")).first()[0] or 1
    block = max(permutations, min(max_block, -(-most // tiles)), 1)
    place = z.select(*by, "row", "col", "_i")
    cells = (
        edges.select(*by, "row", "col", "n_row", "n_col").join(place.withColumnsRenamed({"row": "n_row", "col": "n_col", "_i": "_j"}), [*by, "n_row", "n_col"])
        .groupBy(*by, "row", "col").agg(F.collect_list("_j").alias("_js")).join(place, [*by, "row", "col"])
    )
    i, j = F.col("_i"), F.col("_j")
    links = cells.select(*by, "_i", F.explode("_js").alias("_j"), (F.lit(1.0) / F.size("_js")).alias("_w")).select(
        *by, F.floor(i / block).alias("_ta"), F.floor(j / block).alias("_tb"), (i % block).cast("int").alias("_a"), (j % block).cast("int").alias("_b"), "_w")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block)))
    slices = value_slices(z, size, by, permutations, block).join(size.select(*by, "n"), by)
    slices = slices.select(*by, F.col("_t").alias("_ta"), others.alias("_tb"), F.lit(True).alias("_here"), "vs").unionByName(
        slices.select(*by, others.alias("_ta"), F.col("_t").alias("_tb"), F.lit(False).alias("_here"), "vs"))
    schema = T.StructType([*[z.schema[b] for b in by], T.StructField("_w", T.DoubleType()), T.StructField("_s", T.ArrayType(T.DoubleType()))])
    names = [*by, "_w", "_s"]

    def add(key, links, values):
        if links.empty:
            return pd.DataFrame(columns=names)
        here, there = (np.asarray(values["vs"][values["_here"] == side].iloc[0]) for side in (True, False))
        a, b, w = links["_a"].to_numpy(), links["_b"].to_numpy(), links["_w"].to_numpy()
        sums = [float(np.dot(w * here[a + c], there[b + c])) for c in range(permutations + 1)]
        return pd.DataFrame([(*key[:len(by)], float(w.sum()), sums)], columns=names)

    keys = [*by, "_ta", "_tb"]
    slices = slices.select(*[F.col(x).alias(x) for x in slices.columns])  # columns of their own beside those of `links`
    part = links.groupBy(*keys).cogroup(slices.groupBy(*keys)).applyInPandas(add, schema)
    total = (
        part.select(*by, "_w", F.posexplode("_s").alias("_c", "_x")).groupBy(*by, "_c")
        .agg(F.sum("_w").alias("_w"), F.sum("_x").alias("_x"))
        .join(size, by, "right")
        .withColumn("_e", F.lit(-1.0) / (F.col("n") - 1))
        .withColumn("_i", F.try_divide(F.col("n"), F.col("_w")) * F.try_divide(F.col("_x"), F.when(F.col("_d") > 1e-12, F.col("_d"))))
    )
    seen = total.groupBy(*by, "n", "_e").agg(F.max(F.when(F.col("_c") == 0, F.col("_i"))).alias("morans_i"), F.collect_list(
        F.when(F.col("_c") > 0, F.col("_i"))).alias("_null"))
    reach = F.abs(F.col("morans_i") - F.col("_e")) - 1e-9
    extreme = F.size(F.filter("_null", lambda x: F.abs(x - F.col("_e")) >= reach))
    return seen.select(
        *by, "n", "morans_i", F.col("_e").alias("expected_i"),
        F.when(F.col("morans_i").isNotNull(), (extreme + 1) / F.lit(permutations + 1.0)).alias("p_value"))


def permute(df: DataFrame, value: str, by: Sequence[str], seed: int | str, key: Sequence[str] = ("year", "row", "col")) -> DataFrame:
    """`value` permuted among the rows of each group, by two orders: position and hash of position."""
    from heatgrid.operators.quantiles import ranked

    by = list(by)
    rest = [F.col(k) for k in key if k not in by]
    # Position order needs one number per cell; rows and columns stay below 2^20 here and far beyond.
    pos = F.col("row").cast("double") * F.lit(float(1 << 26)) + F.col("col")
    a = ranked(df, by, pos, rest, out="_i")
    b = ranked(df.select(*key, value), by, hash_number(seed, *key), rest, out="_i").select(
        *by, "_i", F.col(value).alias(f"{value}_perm"))
    return a.join(b, [*by, "_i"]).drop("_i")
