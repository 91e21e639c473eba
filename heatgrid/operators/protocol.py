"""Validation protocols for any estimator: one stored input, many fits at a time, one table of predictions.

A protocol is a list of splits; a split says which rows train and which are predicted. The input is cut
once. All splits' row counts come from one pass, so that a split without training or validation rows
is recorded and not fitted. Class thresholds come from a split's training rows alone, all splits' in one job. Every fit
writes its predictions to the shared folder as soon as it is done, `parallelism` of them at a
time; metrics are aggregates over the table those parts make up, so no model is fitted twice.

What is fitted is a `Fit`: (training rows, validation rows) -> validation rows with `y_pred`, or `y_reg` for
a regression. `estimator_fit` makes one of any pyspark.ml Estimator.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.functions.cells import argmax_class
from heatgrid.operators import classify as L
from heatgrid.operators import models as MM
from heatgrid.operators import validate as VL
from heatgrid.operators.quantiles import split_quantiles
from heatgrid.session import checkpoint_root, cut

#: Groups of thresholds a split that are part of its expression; more of them are joined.
MAX_LITERALS = 50

Fit = Callable[[DataFrame, DataFrame], DataFrame]
Change = Callable[[DataFrame], DataFrame]


class Split(NamedTuple):
    """One fit of a protocol: its name in the key column, and the rows it trains on and predicts."""

    key: object
    train: Column
    validation: Column


class Runs(NamedTuple):
    """predictions: (key, variant, model, the row's own columns, y_true, y_pred or y_reg, prob); status: a row for each split."""

    predictions: DataFrame
    status: DataFrame
    path: str


def group_splits(fold: str, folds: Sequence[int]) -> list[Split]:
    """Each fold predicted by the others; of blocks as folds, this is leave-one-block-out."""
    return [Split(f, F.col(fold) != f, F.col(fold) == f) for f in folds]


def holdout_split(group: str, held: Sequence[int]) -> list[Split]:
    return [Split("holdout", ~F.col(group).isin(*held), F.col(group).isin(*held))]


def year_splits(pairs: Sequence[tuple[int, int]], year: str = "year") -> list[Split]:
    return [Split(f"{a}-{b}", F.col(year) == a, F.col(year) == b) for a, b in pairs]


def prefix_splits(prefixes: Mapping[float, Sequence[int]], held: Sequence[int], group: str = "block_id") -> list[Split]:
    """Growing training blocks against the same held-out ones."""
    return [Split(f, F.col(group).isin(*blocks), F.col(group).isin(*held)) for f, blocks in prefixes.items()]


def block_prefixes(blocks: Sequence[int], fractions: Sequence[float]) -> dict[float, list[int]]:
    """The first max(1, round(f n)) of the sorted blocks, halves to even."""
    ordered = sorted(blocks)
    return {f: ordered[:max(1, round(f * len(ordered)))] for f in fractions}


# --- what is fitted --------------------------------------------------------------------------------

def features_of(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)


def estimator_fit(estimator: Estimator, features: Sequence[str], label: str = "y_true", weighted: bool = True) -> Fit:
    """A Fit of any estimator with a label and a features column.

    Classifiers give `prob` and the class of the highest probability (the lowest class on ties); with `weighted`, classes
    count alike if the estimator takes weights. Regressors give `y_reg`.
    """

    def fit(train: DataFrame, val: DataFrame) -> DataFrame:
        params = {estimator.getParam("labelCol"): label, estimator.getParam("featuresCol"): "_x", estimator.getParam("predictionCol"): "_y"}
        classifier = estimator.hasParam("probabilityCol")
        if classifier:
            params[estimator.getParam("probabilityCol")] = "_p"
            params[estimator.getParam("rawPredictionCol")] = "_r"
            if weighted and estimator.hasParam("weightCol"):
                params[estimator.getParam("weightCol")] = "_w"
                train = MM.with_class_weights(train, label, "_w")
        out = estimator.fit(features_of(train, features), params).transform(features_of(val, features))
        if not classifier:
            return out.withColumnRenamed("_y", "y_reg").drop("_x")
        out = out.withColumn("prob", vector_to_array("_p"))
        return out.withColumn("y_pred", argmax_class(F.col("prob"))).drop("_x", "_p", "_r", "_y")

    return fit


def thresholded(fit: Fit) -> Fit:
    """Classes of a regression by the thresholds of the training rows, which `run` puts on every row."""
    return lambda train, val: fit(train, val).withColumn("y_pred", L.class_of(F.col("y_reg"), F.col("thresholds")))


def rule_fit(by: Sequence[str] = ("year",), k: int = 3, value: str = "lst_c") -> Fit:
    """The built-in rule model as a Fit."""
    return lambda train, val: VL.rule_predictions(train, val, by, k, value).drop("s")


def ordinal_fit(estimator: Estimator, features: Sequence[str], k: int = 3, label: str = "y_true") -> Fit:
    """K - 1 binary fits of P(y >= j), made monotone, clipped and combined to class probabilities."""
    one = estimator_fit(estimator, features, "_at_least")

    def fit(train: DataFrame, val: DataFrame) -> DataFrame:
        for j in range(1, k):
            val = one(train.withColumn("_at_least", (F.col(label) >= j).cast("int")), val)
            val = val.withColumn(f"_g{j}", F.col("prob")[1]).drop("prob", "y_pred")
        at_least = [F.col("_g1")]
        for j in range(2, k):  # a higher class is never likelier to be reached than a lower one
            at_least.append(F.least(at_least[-1], F.col(f"_g{j}")))
        val = val.withColumn("prob", F.array(*MM.ordinal_probabilities(at_least)))
        return val.withColumn("y_pred", argmax_class(F.col("prob"))).drop(*[f"_g{j}" for j in range(1, k)])

    return fit


# --- changes of the training rows ------------------------------------------------------------------

def permuted(column: str, seed: int | str, by: Sequence[str] = ("year",), key: Sequence[str] = ("year", "row", "col")) -> Change:
    """The training rows with one column (a label or a feature) dealt out anew among them, seeded."""

    def change(train: DataFrame) -> DataFrame:
        return VL.permute(train, column, by, seed, key).drop(column).withColumnRenamed(f"{column}_perm", column)

    return change


def without(year: int, column: str = "year") -> Change:
    return lambda train: train.where(F.col(column) != year)


# --- the driver ------------------------------------------------------------------------------------

def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(
    df: DataFrame, splits: Sequence[Split], fits: Fit | Mapping[str, Fit], columns: Sequence[str], key: str = "fold",
    keep: Sequence[str] = ("year", "row", "col", "block_id"), variants: Mapping[str, Change | None] | None = None,
    value: str | None = "lst_c", by: Sequence[str] = ("year",), k: int = 3, parallelism: int = 4,
) -> Runs:
    """Fit and predict every split, under every variant of its training rows, with every model.

    `columns` are what the models read; `value` is cut into k classes by the training rows' quantiles in each group of
    `by`, which training and validation rows must share (empty: one set of thresholds; value None: no classes are made).
    """
    spark = df.sparkSession
    fits = {"model": fits} if callable(fits) else dict(fits)
    variants = dict(variants or {"as_is": None})
    path = f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"
    names = list(dict.fromkeys([*keep, *columns, *([value] if value else [])]))
    base = stored(df.select(*names), f"{path}/input")
    counts = base.agg(*[F.count_if(s.train) for s in splits], *[F.count_if(s.validation) for s in splits]).first()
    n = len(splits)
    rows = [(i, s.key, counts[i], counts[n + i], "ok" if counts[i] and counts[n + i] else "empty") for i, s in enumerate(splits)]
    kind = {str: "string", float: "double"}.get(type(splits[0].key), "int")
    status = spark.createDataFrame([r[1:] for r in rows], f"{key} {kind}, n_train long, n_validation long, status string")

    groups = list(by) or ["_all"]
    if value is not None:
        base = base.withColumn("_all", F.lit(0))
        cuts = cut(split_quantiles(base, [s.train for s in splits], groups, value, [j / k for j in range(1, k)])
                   .select("_split", *groups, F.col("q").alias("thresholds")))
        few = cuts.limit(MAX_LITERALS * n + 1).collect()
        known = len(few) <= MAX_LITERALS * n

    def one(i: int, variant: str) -> list[str]:
        """All models of a split and variant: its training rows are made and written once, whatever passes a fit takes."""
        s = splits[i]
        train, val = base.where(s.train), base.where(s.validation)
        if value is not None and known:
            t = [r for r in few if r["_split"] == i]
            train, val = (L.assign_known_class(x, t, value, "y_true", by=groups) for x in (train, val))
        elif value is not None:
            t = cuts.where(F.col("_split") == i).drop("_split")
            train, val = L.assign_class(train, t, value, "y_true", by=groups), L.assign_class(val, t, value, "y_true", by=groups)
        if variants[variant] is not None:
            train = stored(variants[variant](train), f"{path}/train-{i}-{variant}")
        return [fitted(i, variant, model, train, val) for model in fits]

    def fitted(i: int, variant: str, model: str, train: DataFrame, val: DataFrame) -> str:
        s = splits[i]
        out = fits[model](train, val)
        out = out.select(
            F.lit(s.key).cast(kind).alias(key), F.lit(variant).alias("variant"), F.lit(model).alias("model"), *keep,
            *[c for c in ([value] if value else []) if c not in keep], *[c for c in ("y_true", "y_pred", "y_reg", "prob") if c in out.columns])
        at = f"{path}/part-{i}-{variant}-{model}"
        out.write.parquet(at)
        return at

    todo = [(i, v) for i, *_, state in rows if state == "ok" for v in variants]
    if not todo:
        raise ValueError("no split has both training and validation rows")
    with ThreadPool(MM.fits_at_once(max(r[2] for r in rows), parallelism)) as pool:
        parts = [p for made in pool.starmap(inheritable_thread_target(spark)(one), todo) for p in made]
    return Runs(spark.read.schema(spark.read.parquet(parts[0]).schema).parquet(*parts), status, path)


def scores(runs: Runs, key: str = "fold", by: Sequence[str] = (), regression: str | None = None, k: int = 3) -> DataFrame:
    """Metrics of each split beside its row counts; a split that was not fitted has its counts alone."""
    by = [key, *by]
    m = (VL.regression_metrics(runs.predictions, by, regression, "y_reg") if regression
         else VL.class_metrics(runs.predictions, by, k, per_class=False))
    return runs.status.join(m.drop("n"), key, "left")


def null_position(metrics: DataFrame, metric: str, by: Sequence[str], observed: str = "as_is") -> DataFrame:
    """Where the observed score stands among those of the permuted fits: their mean and spread, and (1 + as good) / (1 + all)."""
    real = metrics.where(F.col("variant") == observed).select(*by, F.col(metric).alias("observed"))
    null = metrics.where(F.col("variant") != observed).select(*by, F.col(metric).alias("_m"))
    good = F.count_if(F.col("_m") >= F.col("observed"))
    return real.join(null, list(by)).groupBy(*by, "observed").agg(
        F.count(F.lit(1)).alias("n_null"), F.avg("_m").alias("null_mean"), F.min("_m").alias("null_lo"), F.max("_m").alias("null_hi"),
        ((good + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
