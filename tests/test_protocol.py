"""Protocols with estimators: what trains, what is predicted, what is recorded, and metrics recomputed by SQL."""

import duckdb
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from heatgrid.operators import protocol as PR
from heatgrid.operators import validate as VL
from heatgrid.plans import load_all

load_all()
from heatgrid.plans.model_queries import _metrics_sql  # noqa: E402


@pytest.fixture(scope="module")
def cells(spark):
    """Two years, blocks 0 to 4; block 3 has no rows. The value follows x, with noise by hash."""
    d = spark.range(900).select(
        (2022 + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 30).cast("int").alias("row"), F.expr("cast(id div 30 as int)").alias("col"),
        F.element_at(F.array(*[F.lit(b) for b in (0, 1, 2, 4)]), (F.col("id") % 4 + 1).cast("int")).alias("block_id"),
        ((F.col("id") * 37 % 101) / 10.0).alias("x"), ((F.col("id") * 53 % 17) / 5.0).alias("z"))
    return d.withColumn("lst_c", F.round(20 + F.col("x") + F.col("z") + F.pmod(F.xxhash64("row", "col"), F.lit(7)) / 7.0, 6)).cache()


def test_empty_blocks_are_recorded_and_not_fitted(cells):
    seen = []
    line = PR.thresholded(PR.estimator_fit(LinearRegression(), ["x", "z"], "lst_c"))

    def fit(train, val):
        blocks = [{r[0] for r in d.select("block_id").distinct().collect()} for d in (train, val)]
        seen.append((sorted(blocks[0]), sorted(blocks[1])))
        return line(train, val)

    runs = PR.run(cells, PR.group_splits("block_id", range(5)), fit, ["x", "z"])
    status = {r["fold"]: r for r in PR.scores(runs).collect()}
    assert {f: r["status"] for f, r in status.items()} == {0: "ok", 1: "ok", 2: "ok", 3: "empty", 4: "ok"}
    assert status[3]["n_validation"] == 0 and status[3]["accuracy"] is None and status[3]["n_train"] == 900
    assert sorted(seen) == sorted([([b for b in (0, 1, 2, 4) if b != f], [f]) for f in (0, 1, 2, 4)])
    assert runs.predictions.count() == 900 and all(status[f]["accuracy"] > 0.7 for f in (0, 1, 2, 4))


def test_no_split_to_fit_is_an_error(cells):
    with pytest.raises(ValueError):
        PR.run(cells, PR.holdout_split("block_id", [77]), PR.rule_fit(), ["x"])


def test_thresholds_never_see_validation_rows(cells):
    """A held-out block far above the rest is of the highest class throughout; thresholds stay those of the others."""
    d = cells.withColumn("lst_c", F.when(F.col("block_id") == 2, F.col("lst_c") + 1000).otherwise(F.col("lst_c")))
    seen = []

    def fit(train, val):
        seen.append({tuple(r[0]) for r in train.select("thresholds").union(val.select("thresholds")).distinct().collect()})
        return val.withColumn("y_pred", F.col("y_true"))

    runs = PR.run(d, PR.holdout_split("block_id", [2]), fit, ["x"])
    assert max(max(t) for t in seen[0]) < 100
    assert {r[0] for r in runs.predictions.select("y_true").distinct().collect()} == {2}


def test_metrics_of_stored_predictions_by_sql(spark, cells):
    """Two models under two variants: one table of predictions, whose metrics SQL recomputes from the stored files."""
    tree = DecisionTreeClassifier(maxDepth=4, seed=1)
    fits = {"tree": PR.estimator_fit(tree, ["x", "z"]), "logistic": PR.estimator_fit(LogisticRegression(maxIter=20), ["x", "z"])}
    runs = PR.run(cells, PR.group_splits("block_id", (0, 1, 2, 4)), fits, ["x", "z"], variants={"as_is": None, "mixed": PR.permuted("y_true", 3)})
    by = ["fold", "variant", "model"]
    got = {tuple(r[k] for k in by): r for r in VL.class_metrics(runs.predictions, by, per_class=False).collect()}
    files = f"{runs.path.removeprefix('file:')}/part-*/*.parquet"
    cur = duckdb.sql(f"WITH oof AS (SELECT * FROM '{files}') {_metrics_sql('oof', by, per_class=False)}")
    rows = [dict(zip(cur.columns, r)) for r in cur.fetchall()]
    assert len(rows) == len(got) == 16
    for r in rows:
        mine = got[tuple(r[k] for k in by)]
        assert all(abs(mine[c] - r[c]) < 2e-6 for c in cur.columns if c not in by), r
    # labels dealt out anew teach nothing; where the true score stands among them
    p = {(r["fold"], r["model"]): r for r in PR.null_position(VL.class_metrics(runs.predictions, by, per_class=False), "macro_f1", ["fold", "model"]).collect()}
    assert all(r["observed"] > r["null_mean"] + 0.2 and r["n_null"] == 1 and r["p_value"] == 0.5 for r in p.values())


def test_permuted_rows_keep_their_other_columns(cells):
    d = cells.withColumn("y_true", (F.col("x") > 5).cast("int"))
    got = PR.permuted("y_true", 5)(d)
    assert sorted(got.columns) == sorted(d.columns)
    by = lambda t: {(r["year"], r["y_true"]): r["n"] for r in t.groupBy("year", "y_true").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by(got) == by(d)
    same = got.select("year", "row", "col", "x", "z", "lst_c")
    assert same.exceptAll(d.select(*same.columns)).isEmpty()
    moved = got.join(d.select("year", "row", "col", F.col("y_true").alias("was")), ["year", "row", "col"]).where("was <> y_true").count()
    assert moved > 200


def test_ordinal_probabilities_by_sql(cells):
    fit = PR.ordinal_fit(LogisticRegression(maxIter=20), ["x", "z"])
    runs = PR.run(cells, PR.holdout_split("block_id", [1]), fit, ["x", "z"], key="split")
    files = f"{runs.path.removeprefix('file:')}/part-*/*.parquet"
    bad, n, right = duckdb.sql(f"""
        SELECT count(*) FILTER (WHERE abs(list_sum(prob) - 1) > 1e-9 OR list_min(prob) < 0 OR len(prob) <> 3 OR prob[y_pred + 1] < list_max(prob) - 1e-6),
          count(*), avg(CAST(y_true = y_pred AS INT)) FROM '{files}'""").fetchall()[0]
    assert bad == 0 and n == 225 and right > 0.7


def test_years_and_prefixes(cells):
    line = PR.estimator_fit(LinearRegression(), ["x", "z"], "lst_c")
    runs = PR.run(cells, PR.year_splits([(2022, 2023), (2023, 2022)]), PR.thresholded(line), ["x", "z"], by=())
    assert {r["fold"]: r["n_validation"] for r in runs.status.collect()} == {"2022-2023": 450, "2023-2022": 450}
    assert PR.block_prefixes([4, 0, 2, 1], (0.1, 0.5, 1.0)) == {0.1: [0], 0.5: [0, 1], 1.0: [0, 1, 2, 4]}
    found = PR.scores(PR.run(cells, PR.prefix_splits({0.5: [0, 1]}, [4]), line, ["x", "z"], key="fraction", keep=("year", "row", "col", "block_id", "lst_c")),
                      "fraction", regression="lst_c").first()
    assert (found["n_train"], found["n_validation"]) == (450, 225) and found["mae"] < 0.5
