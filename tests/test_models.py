"""The registered model queries run the whole protocol: every fold, the operators' own number of trees."""

import pytest
from pyspark.sql import functions as F

from heatgrid.operators import models as MM
from heatgrid.plans import load_all
from heatgrid.plans.registry import QUERIES

load_all()
from heatgrid.plans import model_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_nested_cv_makes_all_fits_of_five_outer_and_four_inner_folds(spark, monkeypatch):
    cells = spark.range(250).select(
        (F.col("id") % 25).cast("int").alias("block_id"), (F.col("id") % 3).cast("int").alias("y_true"),
        *[F.lit(0.5).alias(f) for f in model_queries.FEATURES])
    fits = []

    def score(train, val, features, label, trees, depth, seed=42):
        blocks = [{r[0] for r in x.select("block_id").distinct().collect()} for x in (train, val)]
        fits.append((trees, depth, len(blocks[0]), len(blocks[1])))
        assert not blocks[0] & blocks[1]
        # the deeper model scores better, so it has to be the one refitted
        return spark.createDataFrame([(10, 0.5, depth / 10)], "n long, accuracy double, macro_f1 double")

    monkeypatch.setattr(model_queries.V, "classed", lambda *_: cells)
    monkeypatch.setattr(MM, "_score", score)
    rows = QUERIES["ml18_nested_cv"](spark, SF).collect()
    assert sorted((r["fold"], r["depth"]) for r in rows) == [(o, 8) for o in range(5)]
    assert len(fits) == 5 * (2 * 4 + 1) and {f[0] for f in fits} == {20}
    assert sum(f[2:] == (15, 5) for f in fits) == 40 and sum(f[2:] == (20, 5) for f in fits) == 5


class Reached(Exception):
    pass


@pytest.mark.parametrize("name", ["ml11_reg_then_threshold", "ml15_grid_ablation", "ml19_feature_importance", "ml22_predict_grid", "sco20_model_cooling"])
def test_forests_have_the_operators_number_of_trees(spark, monkeypatch, name):
    def forest(numTrees, **_):
        raise Reached(numTrees)

    monkeypatch.setattr(MM, "RandomForestClassifier", forest)
    monkeypatch.setattr(model_queries, "RandomForestClassifier", forest)
    monkeypatch.setattr(MM, "RandomForestRegressor", forest)
    with pytest.raises(Reached, match="^20$"):
        QUERIES[name](spark, SF)
