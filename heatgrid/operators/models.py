"""MLlib models inside the protocols, and the column algebra around them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatgrid.functions.cells import argmax_class
from heatgrid.operators import classify as L
from heatgrid.operators import validate as VL
from heatgrid.session import checkpoint_root, cut


#: More classes than these are no literals (MLlib refuses to infer more, too).
MAX_CLASSES = 100
#: Training rows that fits running side by side may cache, at some 250 bytes a row with 20 trees.
CACHED_ROWS = 24_000_000
#: From this depth on a fit looks up its rows' nodes in a cache, if that fits: three numbers a row and tree make a row twice as wide.
NODE_CACHE_DEPTH, NODE_CACHE_WIDTH = 7, 2
#: Stored training rows that are worth a task of their own: each task sends the statistics of all nodes.
TASK_ROWS = 25_000


def ordinal_probabilities(at_least: Sequence[Column]) -> list[Column]:
    """Class probabilities from P(y >= k), clipped at zero and renormalised."""
    g = [F.lit(1.0), *at_least, F.lit(0.0)]
    raw = [F.greatest(g[i] - g[i + 1], F.lit(0.0)) for i in range(len(g) - 1)]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def agreement_tiers(runs: DataFrame) -> DataFrame:
    """Cells by how many of five runs agree with the first: overall, per class, and on being hot."""
    first = F.col("runs")[0]
    agree = F.size(F.filter("runs", lambda x: x == F.col("runs")[0]))
    hot = F.size(F.filter("runs", lambda x: (x == 2) == (F.col("runs")[0] == 2)))

    def tier(a):
        return F.when(a >= 5, "5/5").when(a == 4, "4/5").when(a == 3, "3/5").otherwise("<=2/5")

    rows = F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit(-1).alias("cls"), tier(agree).alias("tier")),
        F.struct(F.lit("per_class").alias("kind"), first.alias("cls"), tier(agree).alias("tier")),
        F.struct(F.lit("hotspot").alias("kind"), F.lit(-1).alias("cls"), tier(hot).alias("tier")))
    n = runs.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.cls", "r.tier").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("kind", "cls").agg(F.sum("n").alias("_t"))
    return n.join(F.broadcast(total), ["kind", "cls"]).withColumn("percent", F.col("n") * 100.0 / F.col("_t")).drop("_t")


def class_weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Balanced weight n / (k count) per class."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
        j = n.join(F.broadcast(total))
    else:
        j = n.join(n.groupBy(*by).agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k")), list(by))
    return j.select(*by, label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))


def with_class_weights(train: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Training rows with the balanced weight of their class, and the label as a nominal column with its number of values.

    The weights, a row for each class, are brought to the driver and become part of the expression: a fit reads its rows
    several times, and neither a join nor a pass that counts the classes then goes before each reading.
    """
    rows = class_weights(train, label).where(F.col(label).isNotNull()).limit(MAX_CLASSES + 1).collect()
    if not rows or len(rows) > MAX_CLASSES:
        return train.join(F.broadcast(class_weights(train, label).withColumnRenamed("weight", out)), label)
    weight = F.lit(None).cast("double")
    for r in rows:
        weight = F.when(F.col(label) == F.lit(r[label]), F.lit(r["weight"])).otherwise(weight)
    train = train.withColumn(out, weight).where(F.col(out).isNotNull())
    values = [r[label] for r in rows]
    if min(values) < 0 or max(values) < 1 or any(v != int(v) for v in values):
        return train
    return train.withMetadata(label, {"ml_attr": {"type": "nominal", "name": label, "num_vals": int(max(values)) + 1}})


def fits_at_once(rows: int, parallelism: int) -> int:
    """As many fits as their cached rows leave memory for: MLlib keeps the binned training rows of each."""
    return max(1, min(parallelism, CACHED_ROWS // max(1, rows)))


def select_best(metrics: DataFrame, order: Sequence[str], tie: str) -> DataFrame:
    return metrics.orderBy(*[F.col(o).desc() for o in order], tie).limit(1)


def error_diagnostics(pred: DataFrame) -> DataFrame:
    """Accuracy and confidence overall, per true class, per block and by outcome, in one pass."""
    hit = F.col("y_true") == F.col("y_pred")
    rows = F.array(*[
        F.struct(F.lit(a).alias("analysis"), g.alias("grp")) for a, g in (
            ("overall", F.lit("all")), ("recall", F.col("y_true").cast("string")),
            ("block", F.col("block_id").cast("string")), ("outcome", F.when(hit, "correct").otherwise("incorrect")))])
    d = pred.select("year", hit.cast("int").alias("_h"), "confidence", F.explode(rows).alias("r"))
    return d.groupBy("year", "r.analysis", "r.grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_h").alias("accuracy"), F.avg("confidence").alias("mean_confidence"))


def leakage_audit(df: DataFrame) -> DataFrame:
    """Each column of a feature table against the policy: target-derived, position, or allowed."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(x,) for x in df.columns], "column_name string")
    name = F.col("column_name")
    target = name.isin("lst_c", "y_true", "y_pred", "s") | name.startswith("lst")
    policy = F.when(target, "target_derived").when(name.isin("row", "col", "block_id"), "position").otherwise("allowed")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return cols.withColumn("policy", policy).join(F.broadcast(n))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose vector was stored with them are taken as they are."""
    return df if "features" in df.columns else _assembler(features).transform(df)


def caches_nodes(rows: int, depth: int) -> bool:
    return depth >= NODE_CACHE_DEPTH and rows * NODE_CACHE_WIDTH <= CACHED_ROWS


def cached_rows(rows: int, depth: int) -> int:
    """Rows of a fit as `fits_at_once` counts them."""
    return rows * NODE_CACHE_WIDTH if caches_nodes(rows, depth) else rows


def fit_regressor(train, val, features, target, trees=20, depth=8, seed=42) -> DataFrame:
    rf = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="y_reg")
    return Pipeline(stages=[_assembler(features), rf]).fit(train).transform(val).drop("features")


def threshold_metrics(pred: DataFrame, train: DataFrame, value: str = "lst_c") -> DataFrame:
    """Classes of the regressed value by the training terciles, scored as classes and as a number."""
    t = L.year_thresholds(train, value, [1 / 3, 2 / 3])
    d = L.assign_class(pred, t, value, "y_true").withColumn("y_pred", L.class_of(F.col("y_reg"), F.col("thresholds")))
    a = VL.class_metrics(d, ["year"], per_class=False)
    return a.join(VL.regression_metrics(d, ["year"], value, "y_reg").drop("n"), "year")


def predict_classes(train, val, features, label, trees=20, depth=8, seed=42) -> DataFrame:
    """Balanced forest fitted on `train`; `y_hat` and the probability array `prob` on `val`."""
    rf = RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed,
        probabilityCol="_p", rawPredictionCol="", predictionCol="")
    train = with_class_weights(train, label)
    if depth >= NODE_CACHE_DEPTH:
        rf = rf.setCacheNodeIds(caches_nodes(train.count(), depth))
    out = rf.fit(_assembled(train, features)).transform(_assembled(val, features)).withColumn("prob", vector_to_array("_p"))
    return out.withColumn("y_hat", argmax_class(F.col("prob"))).drop("features", "_p")


def _score(train, val, features, label, trees, depth, seed=42) -> DataFrame:
    p = predict_classes(train, val, features, label, trees, depth, seed)
    return VL.class_metrics(p.select(F.col(label).alias("y_true"), F.col("y_hat").alias("y_pred")), [], per_class=False)


def run_grid(train, val, grid, label, trees=20) -> DataFrame:
    """One fit per (name, features, depth, seed): ablations, regularisation and seeds are one table."""
    out = None
    for name, features, depth, seed in grid:
        m = _score(train, val, features, label, trees, depth, seed).select(F.lit(name).alias("run"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def nested_cv(df, features, label, depths=(4, 8), outer=5, inner=4, trees=20, parallelism=4) -> DataFrame:
    """Depth chosen by inner folds of each outer training part only.

    The rows are stored once, as the vectors that the fits read, with their outer fold and their inner fold in each outer
    training part: all are dealt from the group sizes, read once. Each core has one equal file of them (few rows: fewer), so that no
    pass waits for a task left over, and neighbours are alike, so that they meet the same nodes. The inner fits of all outer folds
    do not depend on each other, nor do the outer fits that follow; as many as `fits_at_once` allows are submitted at a time,
    the deep ones first, as in MLlib's CrossValidator.
    """
    spark = df.sparkSession
    sizes = VL.group_sizes(df)
    outer_of = VL.deal(sizes, outer)
    inner_of = [VL.deal({g: n for g, n in sizes.items() if outer_of[g] != o}, inner) for o in range(outer)]
    folds = spark.createDataFrame(
        [(int(g), f, [inner_of[o].get(g) for o in range(outer)]) for g, f in outer_of.items()],
        "block_id int, outer int, inner array<int>")
    path = f"{checkpoint_root(spark).rstrip('/')}/{spark.sparkContext.applicationId}/nested-{uuid.uuid4().hex}"
    files = max(1, min(spark.sparkContext.defaultParallelism, sum(sizes.values()) // TASK_ROWS))
    dealt = df.select("block_id", label, *features).repartition(files)
    vectors = _assembler(features).transform(dealt.sortWithinPartitions("block_id", *features, label))
    placed = vectors.join(F.broadcast(folds), "block_id").select(
        "block_id", label, "features", "outer", *[F.col("inner")[o].alias(f"inner_{o}") for o in range(outer)])
    placed.write.parquet(path)
    d = spark.read.schema(placed.schema).parquet(path)

    def rest(fold_of):
        """Training rows of the largest fit: all but the smallest fold."""
        return max((sum(n for g, n in sizes.items() if fold_of.get(g) not in (None, f)) for f in set(fold_of.values())), default=0)

    def attempt(depth, o, i):
        """An outer training part's inner fold does not hold its outer fold's rows: there the inner number is null."""
        m = _score(d.where(F.col(f"inner_{o}") != i), d.where(F.col(f"inner_{o}") == i), features, label, trees, depth)
        return depth, o, m.agg(F.avg("macro_f1")).first()[0]

    def refit(o, depth):
        return _score(d.where(F.col("outer") != o), d.where(F.col("outer") == o), features, label, trees, depth).select(
            F.lit(o).alias("fold"), F.lit(depth).alias("depth"), "n", "accuracy", "macro_f1")

    def together(rows):
        return ThreadPool(fits_at_once(cached_rows(rows, max(depths)), parallelism))

    todo = [(x, o, i) for x in sorted(depths, reverse=True) for o in range(outer) for i in range(inner)]
    with together(max(map(rest, inner_of))) as pool:
        tries = pool.starmap(inheritable_thread_target(spark)(attempt), todo, chunksize=1)
    best = []
    for o in range(outer):
        scores = {x: [f for y, p, f in tries if (y, p) == (x, o) and f is not None] for x in depths}
        best.append(max(depths, key=lambda x: (round(sum(scores[x]) / max(1, len(scores[x])), 12), -x)))
    with together(rest(outer_of)) as pool:
        rows = pool.starmap(inheritable_thread_target(spark)(refit), list(enumerate(best)), chunksize=1)
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def importances(train, val, features, target, trees=20, depth=8, seed=42) -> DataFrame:
    """Impurity importance, and the rise of MAE when a column is permuted by hash order.

    One column is permuted at a time on one checkpoint of the validation rows, and leaves one number: the joins of
    all columns do not stand side by side in one plan, whose broadcasts would all lie in the driver at once.
    """
    rf = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="y_reg")
    model = Pipeline(stages=[_assembler(features), rf]).fit(cut(train.select(target, *features)))
    built_in = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    val = cut(val.select("year", "row", "col", target, *features))

    def mae(d):
        return model.transform(d).agg(F.avg(F.abs(F.col(target) - F.col("y_reg")))).first()[0]

    base = mae(val)
    rows = []
    for f, imp in zip(features, built_in):
        permuted = mae(VL.permute(val, f, ["year"], f"imp-{f}").drop(f).withColumnRenamed(f"{f}_perm", f))
        rows.append((f, imp, None if permuted is None or base is None else permuted - base))
    return val.sparkSession.createDataFrame(rows, "feature string, importance double, mae_rise double")


def model_cooling(transitions, cells, densities, per_1000=0.05, trees=20, depth=6) -> DataFrame:
    """Zone mean of the predicted change under an assumed vegetation gain, less that under none."""
    features = ["current_lst", "ndvi", "ndbi", "vegetation_cover", "vegetation_change"]
    rf = RandomForestRegressor(labelCol="delta_lst", numTrees=trees, maxDepth=depth, seed=42, predictionCol="delta")
    model = Pipeline(stages=[_assembler(features), rf]).fit(transitions)
    d = cells.withColumn("current_lst", F.col("lst_c")).withColumn(
        "density", F.explode(F.array(*[F.lit(x) for x in (0, *densities)])))
    gain = F.least(F.col("density") / 1000.0 * per_1000, 1 - F.col("vegetation_cover"))
    p = model.transform(d.withColumn("vegetation_change", gain))
    z = p.groupBy("year", "zone_id", "density").agg(F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("px"))
    none = z.where("density = 0").select("year", "zone_id", F.col("mean_delta").alias("_base"))
    return z.where("density > 0").join(none, ["year", "zone_id"]).withColumn(
        "effect", F.col("mean_delta") - F.col("_base")).drop("_base")
