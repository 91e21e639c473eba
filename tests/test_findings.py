"""Queries on hand-made stored tables: what a larger or less orderly input brought to light."""

import math
from statistics import pstdev

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from heatgrid.functions import scores as S
from heatgrid.functions.cells import nudge
from heatgrid.operators import classify as L
from heatgrid.operators import composite as K
from heatgrid.operators import features as E
from heatgrid.operators import focal as N
from heatgrid.operators import models as MM
from heatgrid.operators import protocol as PR
from heatgrid.operators import quantiles as Q
from heatgrid.operators import spatial as SP
from heatgrid.operators import validate as VL
from heatgrid.plans import load_all
from heatgrid.plans import views as V
from heatgrid.plans import scoring_views as SV
from heatgrid.plans.registry import QUERIES, finish
from heatgrid.session import short_methods


@pytest.fixture
def given(spark, tmp_path, monkeypatch):
    """Stands in for stored tables: `given(name=DataFrame)` returns the folder to name in a query."""
    load_all()
    sf = str(tmp_path / "none")

    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / name))
            monkeypatch.setitem(V._written, (spark.sparkContext.applicationId, sf, name), str(tmp_path / name))
        return sf

    return put


def test_rationale_shortlists_twenty(spark, given):
    """30 sites of one cell: the text names the first 20 as its SQL does."""
    site = spark.range(30).select(F.lit(2022).alias("year"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"))
    cells = site.withColumn("zone_id", F.col("col") + 1).withColumn("n_px", F.lit(1))
    scored = site.select("*", (F.lit(90.0) - F.col("col")).alias("p_lst"), F.lit(50.0).alias("p_veg_deficit"), F.lit(0.5).alias("opp01"), F.lit(1).alias("landuse_class"))
    rows = QUERIES["cel24_rationale"](spark, given(site_cells=cells, scored=scored)).collect()
    state = {r["zone_id"]: r["rationale"].split("; ")[1] for r in rows}
    assert state == {z: "shortlist" if z <= 20 else "candidate" for z in range(1, 31)}


def test_block_classes_from_means_added_once(spark, given, monkeypatch):
    """Sums that come out differently each time they are made, as float sums do over shuffled rows: classes still hold 6, 6, 6 and 7 blocks."""
    noise = F.udf(lambda x: x + __import__("random").random() * 1e-3, "double").asNondeterministic()
    d = spark.range(25).select(F.lit(2022).alias("year"), F.col("id").cast("int").alias("block_id"), F.lit(1.0).alias("severity_score"),
                               F.lit(30.0).alias("lst_c"), F.lit(1).alias("y_true"), F.lit(1).alias("y_pred"))
    sf = given(classed=d)
    stored = V.classed
    monkeypatch.setattr(V, "classed", lambda spark, sf: stored(spark, sf).withColumns({x: noise(x) for x in ("severity_score", "lst_c")}))
    rows = QUERIES["agg22_block_aggregate"](spark, sf).collect()
    for name in ("pred", "truth"):
        got = [r[name] for r in rows]
        assert [got.count(k) for k in range(4)] == [6, 6, 6, 7]


def test_moran_by_blocks(spark):
    """Edges between many blocks of the order, and groups of unlike size, give what one block gives."""
    cells = [(y, i // 20, i % 20, float((i * 7 + y) % 5 < 2)) for y, n in ((1, 400), (2, 61)) for i in range(n)]
    df = spark.createDataFrame(cells, "year int, row int, col int, e double")
    edges = SP.knn(df.select("year", "row", "col"), 8)

    def run(**k):
        return {r["year"]: (r["n"], round(r["morans_i"], 12), r["p_value"]) for r in VL.morans_permutation(df, edges, "e", permutations=19, **k).collect()}

    assert run(tiles=100) == run(tiles=1) == run(max_block=20)


def test_row_numbers_of_crowded_buckets(spark):
    """Buckets above the limit are cut by score and tie, the others are not: the numbers are the same."""
    rows = [(i % 2, float(i % 3), i * 7 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, v double, id int")
    want = {}
    for g in (0, 1):
        want |= {r[2]: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])))}
    for hot in (10, 10_000):
        got = {r["id"]: r["k"] for r in Q.ranked(df, ["g"], F.col("v"), [F.col("id")], out="k", hot_rows=hot).collect()}
        assert got == want


def test_changed_training_rows_are_made_once(spark):
    """However many passes a fit takes, a variant's rows are made once, and two models share them."""
    made = spark.sparkContext.accumulator(0)

    def touch(x):
        made.add(1)
        return x

    mark = F.udf(touch, "double").asNondeterministic()
    df = spark.range(200, numPartitions=2).select(
        F.lit(2022).alias("year"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), (F.col("id") % 4).cast("int").alias("block_id"),
        (F.col("id") % 17).cast("double").alias("ndvi"), (F.col("id") % 13).cast("double").alias("lst_c"))
    fit = PR.thresholded(PR.estimator_fit(LinearRegression(), ["ndvi"], "lst_c"))
    PR.run(df, PR.holdout_split("block_id", (3,)), {"a": fit, "b": fit}, ["ndvi"], variants={"seen": lambda t: t.withColumn("ndvi", mark("ndvi"))})
    assert made.value == 150


def test_importances_leave_one_number_a_column(spark):
    """The result holds one row a column and no plan over the data: nothing of several columns is in the driver at once."""
    df = spark.range(400).select(F.lit(2022).alias("year"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"),
                                 (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 2)
    out = MM.importances(df.where("col % 2 = 0"), df.where("col % 2 = 1"), ["a", "b"], "y", depth=4)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["feature"]: r for r in out.collect()}
    assert got["a"]["importance"] > 0.9 and got["a"]["mae_rise"] > 1 > abs(got["b"]["mae_rise"])


def test_zone_table_joins_cells_once(spark, given):
    """Scores, agreement and cover of a cell come from one row: cells and zones are joined once."""
    cell = spark.createDataFrame([(2022, 0, 0, 90.0, 90.0, 80.0, 80.0, 0.5, 0.2)],
                                 "year int, row int, col int, need double, need_d double, opportunity double, opportunity_d double, confidence double, vegetation_cover double")
    zones = spark.createDataFrame([("A", 2022, 0, 0, 1, 1)], "scenario string, year int, row int, col int, zone_id int, n_px int")
    out = QUERIES["grf4_priority_zones"](spark, given(scored=cell.withColumn("block_id", F.lit(0)), zone_cells=zones))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [(r["pixels"], r["mean_score"], r["high_share"], r["priority_confidence"]) for r in out.collect()] == [(1, 72.0, 1.0, 50.0)]


@pytest.mark.parametrize("hot_rows", [100_000, 100])
def test_composite_with_its_mode(spark, hot_rows):
    """Medians, clear counts and modes of one pass equal those made apart: NULL keys, bands and labels, a crowded pixel, batches cut anywhere."""
    rows = [(2022 if i % 7 else None, i % 3, i % 8 if i % 3 else 0, None if i % 5 == 0 else float(i * 37 % 101), float(i % 13), i % 4 != 1, None if i % 6 == 0 else i * 11 % 4)
            for i in range(1500)]
    d = spark.createDataFrame(rows, "year int, row int, col int, a double, dn double, ok boolean, lab int")
    bands = {"a": F.col("a"), "z": F.when(F.col("ok") & (F.col("row") > 0), F.col("dn"))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = K.median_composite(d, bands, clear=F.col("ok"), dn="dn", label="lab", hot_rows=hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    parts = d.groupBy("year", "row", "col").agg(F.median("a"), F.median(bands["z"]), F.count_if("ok")).collect()
    modes = {tuple(r[:3]): tuple(r[3:]) for r in K.mode_composite(d, "lab").collect()}
    assert {tuple(r) for r in got} == {tuple(r) + modes[tuple(r[:3])] for r in parts} and len(got) == len(parts)


def test_fixed_edges_without_a_loop(spark):
    """Classes by fixed edges are plain comparisons, in scenarios too: the value is not worked out anew at every edge."""
    d = spark.createDataFrame([(None,), (20.0,), (20.5,), (80.0,), (99.0,)], "v double")
    out = d.select(*[L.class_of_edges(F.col("v"), S.CLASS_EDGES, r).alias(r) for r in ("left", "right")])
    assert [tuple(r) for r in out.collect()] == [(None, None), (0, 1), (1, 1), (3, 4), (4, 4)]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_scenarios_are_classed_when_unrolled(spark, given):
    cell = spark.createDataFrame([(2022, 0, 0, 1, 0.5, 90.0, 90.0, 80.0, 80.0)],
                                 "year int, row int, col int, block_id int, confidence double, need double, need_d double, opportunity double, opportunity_d double")
    out = SV.scenario_cells(spark, given(scored=cell))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["scenario"], r["score"], r["cls"]) for r in out.collect()} >= {("A", 72.0, 3), ("D", 72.0, 3)}


def test_products_are_built_from_short_methods(spark, given, tmp_path):
    """The limit holds while a product is built, nested ones too, and is gone afterwards; a session's own limit stays."""
    name, seen = "spark.sql.codegen.hugeMethodLimit", []

    def build(inner=None):
        if inner:
            V.product(spark, str(tmp_path), inner, build)
        seen.append(spark.conf.get(name))
        return spark.range(1)

    V.product(spark, str(tmp_path), "outer", lambda: build("inner"))
    assert seen == ["8000", "8000"] and spark.conf.get(name) == "65535"
    spark.conf.set(name, "20000")
    try:
        with short_methods(spark):
            assert spark.conf.get(name) == "20000"
    finally:
        spark.conf.unset(name)


def test_line_sums_against_brute_force(spark):
    """Gaps in lines, blocks in pieces, NULL values and blocks, NaN, batches cut anywhere: every window is added up anew and no SQL window is left."""
    rows = [(y, r, col, None if (r * 7 + col) % 11 == 0 else col // 3 % 2, None if col % 5 == 0 else (float("nan") if col == 31 else 1e15 if col == 17 else 0.1 * col), 1 + col % 3)
            for y in (1, 2) for r in range(3) for col in range(40) if (col * 13 + r) % 4]
    d = spark.createDataFrame(rows, "year int, row int, col int, block int, v double, n long")
    sums = {"free": N.Sums([("v", None, 2)]), "own": N.Sums([("v", None, 3)], "block"), "less": N.Sums([("n", None, 4), ("n", "m", 1)], "block")}
    d = d.withColumn("m", F.col("n") * 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = N.line_sums(d.repartition("year", "row"), ["year", "row"], "col", sums, ["year", "row", "col"])
        got = {tuple(r[:3]): tuple(r[3:]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert dict(out.dtypes)["less"] == "bigint" and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    for y, r, col, block, *_ in rows:
        near = [x for x in rows if x[:2] == (y, r)]
        own = [x for x in near if x[3] == block]
        free = sum(x[4] or 0 for x in near if abs(x[2] - col) <= 2)
        mine = sum(x[4] or 0 for x in own if abs(x[2] - col) <= 3)
        less = sum(x[5] for x in own if abs(x[2] - col) <= 4) - sum(x[5] for x in own if abs(x[2] - col) <= 1)
        assert got[y, r, col] == (pytest.approx(free, rel=1e-12, nan_ok=True), pytest.approx(mine, rel=1e-12, nan_ok=True), less)


def test_disks_carry_only_what_is_kept(spark):
    """Columns nobody reads stay where they are, though a function over Arrow batches takes all it is given."""
    d = spark.range(100).select(F.lit(2022).alias("year"), F.lit(0).alias("block_id"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"),
                                F.lit(1.0).alias("v"), F.rand(1).alias("idle"))
    out = N.disk_sums(d, ["v"], {}, [2], keep=[])
    assert out.columns == ["year", "block_id", "row", "col", "v_s2", "v_c2"] and "idle" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["v_s2"] for r in out.where("row = 5 and col = 5").collect()} == {13.0}


# --- F3: the rows of a protocol's fits come without joins ---------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_training_rows_of_a_protocol_are_read_without_joins(spark):
    d = spark.range(600).select(
        (2022 + F.col("id") % 2).cast("int").alias("year"), (F.col("id") % 30).cast("int").alias("row"), F.expr("cast(id div 30 as int)").alias("col"),
        (F.col("id") % 3).cast("int").alias("block_id"), ((F.col("id") * 37 % 101) / 10.0).alias("lst_c"))
    seen = []

    def fit(train, val):
        weighted = MM.with_class_weights(train, "y_true")
        joined = train.join(MM.class_weights(train, "y_true"), "y_true").select(*weighted.columns)
        seen.append((_plan(weighted) + _plan(val), weighted.exceptAll(joined).count(), joined.exceptAll(weighted).count(), train.count()))
        return val.withColumn("y_pred", F.col("y_true"))

    runs = PR.run(d, PR.group_splits("block_id", range(3)), fit, ["lst_c"])
    assert len(seen) == 3 and all("Join" not in plan and (a, b, n) == (0, 0, 400) for plan, a, b, n in seen)
    assert runs.predictions.count() == 600


def test_classes_by_known_thresholds_are_those_of_the_join(spark):
    d = spark.createDataFrame([(1, 0.5), (1, 2.0), (1, None), (2, 9.0), (3, 1.0), (None, 1.0)], "year int, v double")
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "year int, thresholds array<double>")
    for rule in ("right", "left"):
        known = L.assign_known_class(d, t.collect(), "v", "y", rule)
        assert sorted(map(str, known.collect())) == sorted(map(str, L.assign_class(d, t, "v", "y", rule).select(*known.columns).collect()))


def test_more_thresholds_than_literals_are_joined(spark, monkeypatch):
    d = spark.range(300).select(
        (2022 + F.col("id") % 3).cast("int").alias("year"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"),
        (F.col("id") % 2).cast("int").alias("block_id"), ((F.col("id") * 37 % 101) / 10.0).alias("lst_c"))
    rows = []
    for most in (50, 1):
        monkeypatch.setattr(PR, "MAX_LITERALS", most)
        runs = PR.run(d, PR.group_splits("block_id", range(2)), lambda train, val: val.withColumn("y_pred", F.col("y_true")), ["lst_c"])
        rows.append(sorted(tuple(r) for r in runs.predictions.collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 300


def test_side_by_side_fits_are_bounded_by_their_cached_rows():
    assert [MM.fits_at_once(n, 4) for n in (0, 1_000, 7_000_000, 11_000_000, 10**9)] == [4, 4, 3, 2, 1]


# --- F4: nested folds are dealt once and stored with the rows ----------------------------------------

def test_nested_folds_are_stored_with_the_rows(spark, monkeypatch):
    d = spark.range(700).select(
        F.expr("cast(least(id % 13, id % 29) as int)").alias("block_id"), (F.col("id") % 3).cast("int").alias("y_true"), F.rand(1).alias("x"))
    fits = []

    def score(train, val, features, label, trees, depth, seed=42):
        blocks = [frozenset(r[0] for r in x.select("block_id").distinct().collect()) for x in (train, val)]
        fits.append((depth, *blocks, "Join" in _plan(train) + _plan(val)))
        return spark.createDataFrame([(10, 0.5, 0.5)], "n long, accuracy double, macro_f1 double")

    monkeypatch.setattr(MM, "_score", score)
    assert [tuple(r)[:2] for r in MM.nested_cv(d, ["x"], "y_true", outer=3, inner=2).collect()] == [(o, 4) for o in range(3)]
    folds = {r["block_id"]: r["fold"] for r in VL.group_folds(d, 3).collect()}
    want = set()
    for o in range(3):
        rest = d.where(~F.col("block_id").isin([b for b, f in folds.items() if f == o]))
        inner = {r["block_id"]: r["fold"] for r in VL.group_folds(rest, 2).collect()}
        want.add((frozenset(inner), frozenset(b for b, f in folds.items() if f == o)))
        want |= {(frozenset(b for b, f in inner.items() if f != i), frozenset(b for b, f in inner.items() if f == i)) for i in range(2)}
    assert {f[1:3] for f in fits} == want and len(fits) == 3 * (2 * 2 + 1) and not any(f[3] for f in fits)


def test_domain_is_joined_once_and_without_a_broadcast(spark):
    """F15 to F25, F27, F29: whoever reads the domain reads a stored table; building it moves both sides by (row, col)."""
    sf = "/root/testdata/sf0.001"
    built = V.build_domain(spark, sf)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
    read = V.domain(spark, sf)
    assert "Join" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.columns == built.columns and read.count() == built.count() and read.exceptAll(built).isEmpty()


def test_mask_overlap_moves_counts_only(spark, given):
    """masks of a cell come from its own row, so no exchange is keyed by cells."""
    rows = [(2022, 0, i, n, o, n, o) for i, (n, o) in enumerate([(90.0, 90.0), (10.0, 10.0), (70.0, 80.0), (None, 50.0)])]
    scored = spark.createDataFrame(rows, "year int, row int, col int, need double, opportunity double, need_d double, opportunity_d double")
    scored = scored.withColumns({"block_id": F.lit(0), "confidence": F.lit(1.0)})
    out = QUERIES["set2_mask_overlap"](spark, given(scored=scored))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning" in line and "row#" in line]
    got = {(r["a"], r["b"]): (r["intersection_px"], r["union_px"], r["iou"], r["share_of_a"], r["share_of_b"]) for r in out.collect()}
    assert len(got) == 6
    b = [n is not None and 100 ** 0.1 * n ** 0.6 * o ** 0.3 > 60 for *_, n, o in rows]
    a = [n is not None and n * o / 100 > 60 for *_, n, o in rows]
    both, either = sum(x and y for x, y in zip(a, b)), sum(x or y for x, y in zip(a, b))
    assert got["A", "B"] == (both, either, round(both / either, 6), round(both / sum(a), 6), round(both / sum(b), 6))


def test_facing_keeps_every_nearest_feature_and_few_others(spark):
    """columns beside the cells leave one feature a grid row; distances are those to all features."""
    cells = spark.range(400).selectExpr("cast(id % 2 as int) as fold", "cast(id div 20 as int) as row", "cast(20 + id % 20 as int) as col")
    features = spark.range(3600).selectExpr("cast(id % 2 as int) as fold", "cast(id div 60 % 30 as int) as row", "cast(id * 7 % 60 as int) as col").where(
        "(row * 31 + col * 17) % 11 < 3 and (fold = 0 or col < 20 or col >= 40)").distinct()
    few = SP.facing(cells, features, ["fold"])
    assert few.where("fold = 1").count() <= 2 * 30 < features.where("fold = 1").count()
    a, b = (SP.nearest_of(cells, f, ["fold"]) for f in (features, few))
    assert a.exceptAll(b).isEmpty() and b.count() == cells.count()


# --- round 4, F1: nested fits read stored vectors, a file for each core, and look up nodes in a cache --

def test_nested_fits_read_stored_vectors_a_file_for_each_core(spark, monkeypatch):
    d = spark.range(700, numPartitions=3).select(
        F.expr("cast(least(id % 13, id % 29) as int)").alias("block_id"), (F.col("id") % 3).cast("int").alias("y_true"), F.rand(1).alias("x"), F.rand(2).alias("z"))
    seen = []

    def score(train, val, features, label, trees, depth, seed=42):
        seen.append((depth, "UDF" in _plan(train) + _plan(val), len(train.inputFiles()), train.select("features").first()[0].size))
        return spark.createDataFrame([(10, 0.5, 0.5)], "n long, accuracy double, macro_f1 double")

    monkeypatch.setattr(MM, "_score", score)
    for rows, files in ((25_000, 1), (100, spark.sparkContext.defaultParallelism)):
        seen.clear()
        monkeypatch.setattr(MM, "TASK_ROWS", rows)
        assert MM.nested_cv(d, ["x", "z"], "y_true", outer=3, inner=2).count() == 3
        assert {s[1:] for s in seen} == {(False, files, 2)}
        assert [s[0] for s in seen].count(8) == 3 * 2 and sum(s[0] == 4 for s in seen[-3:]) == 3


def test_forest_is_the_same_by_cached_nodes_and_stored_vectors(spark, monkeypatch):
    """One forest whether nodes are cached or found from the root, from columns or from vectors; only probabilities are computed."""
    d = spark.range(900, numPartitions=2).select(
        "id", ((F.col("id") * 37 % 101) / 10.0).alias("a"), ((F.col("id") * 17 % 89) / 10.0).alias("b"), ((F.col("id") * 37 % 101 + F.col("id") * 5 % 31) % 3).cast("int").alias("y"))
    train, val = d.where("id % 4 > 0"), d.where("id % 4 = 0")
    made, nodes = [], []
    forest = MM.RandomForestClassifier

    def fitted(**k):
        made.append(forest(**k))
        return made[-1]

    monkeypatch.setattr(MM, "RandomForestClassifier", fitted)
    out = []
    for at, rows in ((7, 24_000_000), (99, 24_000_000), (7, 100)):
        monkeypatch.setattr(MM, "NODE_CACHE_DEPTH", at)
        monkeypatch.setattr(MM, "CACHED_ROWS", rows)
        for t, v in ((train, val), tuple(MM._assembled(x, ["a", "b"]) for x in (train, val))):
            p = MM.predict_classes(t, v, ["a", "b"], "y", trees=5, depth=8)
            out.append(sorted((r["id"], r["y_hat"], tuple(round(x, 12) for x in r["prob"])) for r in p.collect()))
            nodes.append(made[-1].getCacheNodeIds())
    assert all(o == out[0] for o in out) and len(out[0]) == 225
    assert nodes == [True, True, False, False, False, False]
    assert made[-1].getRawPredictionCol() == made[-1].getPredictionCol() == ""


def test_cached_nodes_count_as_rows_and_are_left_out_when_they_do_not_fit():
    assert [MM.cached_rows(n, 8) for n in (5_000_000, 12_000_000, 13_000_000)] == [10_000_000, 24_000_000, 13_000_000]
    assert MM.cached_rows(5_000_000, 4) == 5_000_000


# --- round 4, F2: the feature stack moves cells to tiles, never sums ----------------------------------

def _odd_grid():
    """Gaps, NULL values and blocks, blocks in pieces, a NaN, negative rows, two years."""
    rows = []
    for y in (1, 2):
        for r in range(-5, 21):
            for c in range(23):
                if (r * 5 + c * 3 + y) % 13 == 0:
                    continue
                v = None if (r + 2 * c) % 7 == 0 else float("nan") if (y, r, c) == (2, 3, 4) else ((r * 37 + c * 17 + y) % 101) / 10.0
                rows.append((y, r, c, v, None if (r, c) == (0, 0) else (r // 6 + c // 5) % 3, (r * 7 + c * 3) % 9, float((r * 3 + c) % 4 * 30)))
    return rows


def _odd_stack(spark):
    d = spark.createDataFrame(_odd_grid(), "year int, row int, col int, v double, block_id int, landuse_class int, dist double")
    names = dict.fromkeys([*E.BASES, *E.STD_BANDS, *E.MEAN_BANDS])
    return d.select("year", "row", "col", "block_id", "landuse_class", *[F.col("dist" if n.startswith("dist") else "v").alias(n) for n in names])


def test_feature_stack_moves_cells_once_and_no_sums(spark):
    """One exchange, of the base columns and two tile numbers: neither a second one nor sums of lines."""
    d = _odd_stack(spark)
    out = E.feature_stack(d)
    tree = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Repartition" in x for x in tree) == 1
    exchange = out._jdf.queryExecution().optimizedPlan()
    while exchange.nodeName() != "RepartitionByExpression":
        exchange = exchange.children().head()
    assert exchange.output().size() == len(d.columns) + 2


@pytest.mark.parametrize("size", [192, 7])
def test_feature_stack_against_brute_force(spark, monkeypatch, size):
    """Tiles smaller than a disk or larger than the grid: every cell once, every window whole."""
    monkeypatch.setattr(N, "TILE", size)
    rows = _odd_grid()
    got = {(r["year"], r["row"], r["col"]): r for r in E.feature_stack(_odd_stack(spark)).collect()}
    assert sorted(got) == sorted(r[:3] for r in rows)

    def near(x):
        return pytest.approx(x, rel=1e-9, abs=1e-9, nan_ok=True)

    for y, r, c, v, block, *_ in rows[::5]:
        g = got[y, r, c]
        free = [x for x in rows if x[0] == y and max(abs(x[1] - r), abs(x[2] - c)) <= 5]
        own = [x for x in rows if x[0] == y and x[4] == block]
        for w in (3, 11):
            a = [x[3] for x in free if max(abs(x[1] - r), abs(x[2] - c)) <= w // 2 and x[3] is not None]
            b = [x[3] for x in own if max(abs(x[1] - r), abs(x[2] - c)) <= w // 2 and x[3] is not None]
            assert g[f"ndvi_mean{w}"] == (near(sum(b) / len(b)) if b else None) and g[f"mndwi_mean{w}"] == (near(sum(a) / len(a)) if a else None)
            if any(math.isnan(x) for x in a):  # above all numbers
                assert math.isnan(g[f"ndvi_range{w}"]) and math.isnan(g[f"ndre_std{w}"])
            else:
                assert g[f"ndvi_range{w}"] == (near(max(a) - min(a)) if a else None) and g[f"ndre_std{w}"] == (pytest.approx(pstdev(a), abs=1e-6) if a else None)
        for m, radius in ((50, 2), (500, 17)):
            d = [x for x in own if (x[1] - r) ** 2 + (x[2] - c) ** 2 <= radius ** 2]
            b = [x[3] for x in d if x[3] is not None]
            lu = [sum(x[5] == k for x in d) for k in E.LANDUSE]
            assert g[f"vegetation_cover_mean_{m}m"] == (near(sum(b) / len(b)) if b else None)
            assert g[f"road_pixel_fraction_{m}m"] == near(sum(x[6] == 0 for x in d) / len(d))
            assert g[f"landuse_frac_6_{m}m"] == near(lu[5] / sum(lu) if sum(lu) else 0)
            assert g[f"landuse_dominant_{m}m"] == (1 + lu.index(max(lu)) if sum(lu) else 0)


def test_grid_meets_the_static_table_once(spark):
    """Cells are made dense by the static table itself: one join by cell, and none with a lattice beside it."""
    from heatgrid.plans import focal_queries as FQ
    sf = "/root/testdata/sf0.001"
    grid = FQ.grid_cells(spark, sf)
    assert _plan(grid).count("Join LeftOuter") == 1 and "Range" not in _plan(grid)
    want = V.dense(spark, sf).join(V.cells_static(spark, sf).drop("block_id"), ["row", "col"])
    assert grid.select(*want.columns).exceptAll(want).isEmpty() and grid.count() == want.count()


def test_settled_in_tiles_is_settled_in_results(spark):
    """Halves, values next to them after the nudge, signs, zeros, NaN, infinities and large values: as `finish` rounds them."""
    rng = np.random.default_rng(1)
    x = [0.0, -0.0, 0.5, -0.5, 1e-6, 123456.789015, 1e14 + 0.3, -1e20, 1e300, float("nan"), float("inf"), -float("inf")]
    x += [k / 1e5 + s * 5e-6 - t * nudge(5) for k in range(-50, 50) for s in (0, 1) for t in (0, 1)] + [0.1 * k + 0.000005 for k in range(100)]
    x += list(rng.normal(size=3000)) + list(rng.integers(-10**9, 10**9, 3000) / 1e6) + list(rng.integers(0, 900, 3000) / rng.integers(1, 900, 3000))
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    want = [r["v"] for r in finish(d, 5).orderBy("i").collect()]
    got = E.settled(np.array(x), 5)
    assert [repr(float(g)) for g in got] == [repr(w) for w in want]


def test_feature_table_rounds_its_stack_in_the_tiles(spark):
    """Columns of the stack are rounded once and not again in the plan; unrounded ones rounded by `finish` are the same."""
    d = _odd_stack(spark)
    key = ["year", "row", "col"]
    new = [x for x in E.feature_stack(d).columns if x not in d.columns]
    a = E.feature_stack(d, digits=5).select(*key, *new)
    b = finish(E.feature_stack(d).select(*key, *new), 5)
    assert len(new) == 121 and a.exceptAll(b).isEmpty() and a.count() == b.count()
    plan = _plan(QUERIES["nbr10_feature_table"](spark, "/root/testdata/sf0.001"))
    assert "round((ndvi#" in plan and "round((ndvi_mean3#" not in plan
