"""Recomputing gates: each kind of fault is seen, and nothing else is."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heatgrid.operators import gates as GT

SMALL = "/root/testdata/sf0.001"


def found(gate):
    return {r["check_id"]: r["n_bad"] for r in gate.collect() if not r["ok"]}


def test_recompute_diff_sees_each_fault(spark):
    schema = "k string, v double, w int"
    saved = spark.createDataFrame([("a", 1.0, 1), (None, None, 2), ("nan", math.nan, 3), ("near", 1.0, 4), ("far", 1.0, 5), ("extra", 1.0, 6),
                                   ("twice", 1.0, 7), ("twice", 1.0, 7), ("null", None, 8)], schema)
    again = spark.createDataFrame([("a", 1.0, 1), (None, None, 2), ("nan", math.nan, 3), ("near", 1.0 + 1e-7, 4), ("far", 1.1, 5), ("gone", 1.0, 6),
                                   ("twice", 1.0, 9), ("null", 2.0, 8)], schema)
    rows = {r["k"]: r for r in GT.recompute_diff(saved, again, ["k"], {"v": 1e-6, "w": 0}).collect()}
    assert {k: r["changed"] for k, r in rows.items() if r["changed"]} == {"far": ["v"], "twice": ["w"], "null": ["v"]}
    assert found(GT.diff_gate("t", saved, again, ["k"], {"v": 1e-6, "w": 0})) == {"t_missing": 1, "t_extra": 1, "t_repeated": 1, "t_v": 2, "t_w": 1}
    assert found(GT.diff_gate("t", again, again, ["k"], {"v": 0, "w": 0})) == {}
    assert found(GT.diff_gate("t", saved.limit(0), again.limit(0), ["k"], {"v": 0})) == {}


def test_contract_of_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert found(GT.contract_gate("x", df, ["b", "a"])) == {}
    assert found(GT.contract_gate("x", df, ["a", "c", "b"], ["c"], ordered=True)) == {"x_schema": 2, "x_banned": 1}
    assert found(GT.contract_gate("x", df, ["a", "d"])) == {"x_schema": 1}
    cells = spark.createDataFrame([(1, 1, 1)], "year int, row int, col int")
    sites = spark.createDataFrame([(1, 1, 23, 50.0, 1, True, 0.3)], "year int, zone_id int, px int, score double, rank int, shortlist boolean, untagged_share double")
    assert found(GT.tree_gates(cells, cells, sites, sites)) == {"sites_schema": 5}


def test_gradient_looks_at_neighbours_only(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 1.5), (1, 0, 3, 9.0), (1, 1, 4, 30.0), (2, 0, 4, 50.0), (1, 0, 4, None)],
                               "year int, row int, col int, v double")
    assert found(GT.gradient_gate("g", df, {"v": 0.5})) == {}
    assert found(GT.gradient_gate("g", df, {"v": 0.4})) == {"g_v": 1}


def test_trees_are_exact_and_certainty_has_its_edges(spark):
    got = spark.range(0, 200_000).select("id", *[GT.exact_trees(F.col("id"), d).alias(str(d)) for d in (400, 1000, 2500, 7)]).toPandas()
    for d in (400, 1000, 2500, 7):
        assert (got[str(d)] == got["id"] * 9 * d // 100).all()
    shares = spark.createDataFrame([(0.2,), (0.21,), (0.5,), (0.51,)], "u double")
    assert [r[0] for r in shares.select(GT.certainty(F.col("u"))).collect()] == ["identified", "mixed", "mixed", "low"]


@pytest.mark.parametrize("name, never", [
    ("dq3_feature_recompute", set()), ("dq5_suitability_recompute", set()), ("dq7_cooling_recompute", set()), ("dq8_model_recompute", {"reload_extra"})])
def test_registered_gates_pass_stored_tables_and_fail_tampered_ones(spark, name, never):
    rows = entry.queries()[name](spark, SMALL).collect()
    stored = {r["check_id"]: r["ok"] for r in rows if r["input"] == "stored"}
    tampered = {r["check_id"]: r["ok"] for r in rows if r["input"] == "tampered"}
    assert set(stored) == set(tampered) and all(stored.values())
    faults = {"dq3_feature_recompute": ["null", "infinite", "block_id", "gradient_dist_road_m"],
              "dq5_suitability_recompute": ["class_missing", "class_repeated", "class_priority_class", "thresholds", "share_n"],
              "dq7_cooling_recompute": ["panel_missing", "panel_delta_lst", "adjacent", "locked_in_cv", "mae_over_rmse", "r2_range", "no_rows"],
              "dq8_model_recompute": ["reload_missing", "reload_repeated", "reload_y_pred", "support_sum", "threshold_order", "folds_overlap"]}
    assert not any(tampered[x] for x in faults[name])
    assert all(tampered[x] for x in never)
