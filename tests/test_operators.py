"""Distributed operators against brute force on small fixtures, skew paths included."""

import re
from itertools import takewhile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatgrid.operators import components as G
from heatgrid.operators import focal as N
from heatgrid.operators import overlap as O
from heatgrid.operators import quantiles as Qn
from heatgrid.operators import ranking as R
from heatgrid.operators import spatial as SP
from heatgrid.operators import validate as VL
from heatgrid.operators import weather as M


def frame(spark, n=24, seed=3, hole=0.15):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, n))
    v[rng.random((n, n)) < hole] = np.nan
    rows = [(2022, r, c, (r * 2 // n) * 2 + (c * 2 // n), None if np.isnan(v[r, c]) else float(v[r, c]))
            for r in range(n) for c in range(n)]
    return v, spark.createDataFrame(rows, "year int, row int, col int, block_id int, v double")


def test_exact_quantiles_match_numpy_with_one_dominant_value(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=2000), np.full(1500, 0.25), -rng.lognormal(sigma=4, size=500)])
    df = spark.createDataFrame([(i % 2, float(a)) for i, a in enumerate(x)], "g int, v double")
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in Qn.exact_quantiles(df, ["g"], ["v"], probs).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile(x[g::2], [p * 100 for p in probs]))


def test_hot_groups_take_the_split_way_and_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(0, float(a)) for a in rng.normal(size=900)] + [(1 + i // 3, float(a)) for i, a in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "g int, v double")

    def run(limit):
        d = Qn.grouped_quantiles(df, ["g"], {"v": ["m", "p"]}, [0.5, 0.9], [F.count("v").alias("n")], hot_rows=limit)
        return sorted((r["g"], round(r["m"], 12), round(r["p"], 12), r["n"]) for r in d.collect())

    assert run(10**6) == run(100)


@pytest.mark.parametrize("method", ["row_number", "rank", "average"])
def test_ranked_with_a_third_of_rows_tied(spark, method):
    x = [5.0] * 40 + [float(i) for i in range(80)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, v double")
    got = {r["id"]: r["k"] for r in Qn.ranked(df, [], F.col("v"), [F.col("id")], out="k", method=method).collect()}
    for i, v in enumerate(x):
        less, same = sum(y < v for y in x), sum(y == v for y in x)
        want = {"rank": less + 1, "average": less + (same + 1) / 2,
                "row_number": less + 1 + sum(y == v for y in x[:i])}[method]
        assert got[i] == want


@pytest.mark.parametrize("r", [1, 2, 3, 8, 17])
def test_disk_bands_cover_each_cell_once(r):
    got = np.zeros((2 * r + 1, 2 * r + 1), dtype=int)
    for w, narrower, tall in N.bands(r):
        got[r - tall:r + tall + 1, r - w:r + w + 1] += 1
        if narrower is not None:
            got[r - tall:r + tall + 1, r - narrower:r + narrower + 1] -= 1
    y, x = np.ogrid[-r:r + 1, -r:r + 1]
    assert (got == (x * x + y * y <= r * r)).all() and N.disk_size(r) == got.sum()


def test_disk_and_square_against_brute_force(spark):
    v, df = frame(spark)
    n = len(v)
    d = N.disk_sums(N.spread(df), ["v"], {"cell": F.lit(True)}, [3])
    d = N.focal_mean(d, ["v"], [5])
    got = {(r["row"], r["col"]): r for r in d.collect()}
    block = np.add.outer((np.arange(n) * 2 // n) * 2, np.arange(n) * 2 // n)
    for r in range(n):
        for c in range(n):
            near = [(a, b) for a in range(n) for b in range(n) if block[a, b] == block[r, c]]
            disk = [v[a, b] for a, b in near if (a - r) ** 2 + (b - c) ** 2 <= 9]
            sq = [v[a, b] for a, b in near if abs(a - r) <= 2 and abs(b - c) <= 2 and not np.isnan(v[a, b])]
            g = got[r, c]
            assert g["cell_n3"] == len(disk) and g["v_c3"] == sum(~np.isnan(disk))
            assert g["v_s3"] == pytest.approx(np.nansum(disk))
            assert g["v_mean5"] == (pytest.approx(np.mean(sq)) if sq else None)


def brute_labels(mask):
    lab, n = np.zeros(mask.shape, int), 0
    for r, c in zip(*np.nonzero(mask)):
        if lab[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        lab[r, c] = n
        while todo:
            y, x = todo.pop()
            for a in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for b in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[a, b] and not lab[a, b]:
                        lab[a, b] = n
                        todo.append((a, b))
    return lab


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_components_across_tiles(spark, tile):
    mask = np.random.default_rng(5).random((30, 30)) < 0.4
    mask[12, :] = True
    df = spark.createDataFrame([(1, int(r), int(c)) for r, c in zip(*np.nonzero(mask))], "year int, row int, col int")
    want = brute_labels(mask)
    got = G.label_components(df, ["year"], 1, tile).collect()
    assert len(got) == mask.sum()
    for r in got:
        assert r["zone_id"] == want[r["row"], r["col"]] and r["n_px"] == (want == r["zone_id"]).sum()


def test_small_components_are_dropped_and_ids_stay_dense(spark):
    cells = [(1, 0, 0), (1, 5, 5), (1, 5, 6), (1, 6, 7), (1, 9, 0), (1, 9, 1), (1, 10, 1)]
    got = G.label_components(spark.createDataFrame(cells, "year int, row int, col int"), ["year"], 3).collect()
    assert {(r["row"], r["zone_id"]) for r in got} == {(5, 1), (6, 1), (9, 2), (10, 2)}


def test_long_chain_graph(spark):
    e = spark.createDataFrame([(0, i, i + 1) for i in range(60)] + [(0, 100, 101)], "k int, u long, v long")
    got = {r["node"]: r["root"] for r in G.min_label_graph(e, ["k"]).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100


def test_distance_is_exact(spark):
    rng = np.random.default_rng(7)
    on = rng.random((20, 33)) < 0.03
    rows = [(r, c, bool(on[r, c])) for r in range(20) for c in range(33)]
    df = spark.createDataFrame(rows, "row int, col int, f boolean")
    feats = np.argwhere(on)
    for r in SP.nearest_feature(df, F.col("f")).collect():
        d2 = (feats[:, 0] - r["row"]) ** 2 + (feats[:, 1] - r["col"]) ** 2
        best = min((d, *map(int, f)) for d, f in zip(d2, feats))
        assert (r["d2"], r["f_row"], r["f_col"]) == best


def test_distance_without_features_is_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int")
    assert [r["d"] for r in SP.distance_to_feature(df, F.lit(False), "d").collect()] == [None, None]


def nearest_by_hand(features, row, col):
    return min(((r - row) ** 2 + (c - col) ** 2, r, c) for r, c in features)


def test_distance_on_sparse_cells_with_ties_and_payload(spark):
    """Cells and features are unrelated sets, far apart, of negative numbers too; regular features make many ties."""
    rng = np.random.default_rng(11)
    for features in ({(int(a), int(b)) for a, b in rng.integers(-400, 400, size=(60, 2))},
                     {(r, c) for r in range(-40, 41, 8) for c in range(-40, 41, 8)}):
        cells = {(int(a), int(b)) for a, b in rng.integers(-50, 450, size=(300, 2))}
        df = spark.createDataFrame([(y, r, c, f"{r}/{c}") for y in (1, 2, 3) for r, c in cells], "year int, row int, col int, note string")
        fs = spark.createDataFrame([(y, r, c) for y in (1, 2) for r, c in features], "year int, row int, col int")
        got = SP.nearest_of(df, fs.union(fs), ["year"]).collect()
        assert len(got) == 3 * len(cells)
        for x in got:
            assert x["note"] == f"{x['row']}/{x['col']}"
            near = (x["d2"], x["f_row"], x["f_col"])
            assert near == ((None,) * 3 if x["year"] == 3 else nearest_by_hand(features, x["row"], x["col"]))


def test_distance_of_one_wide_row_in_small_batches(spark):
    """A grid row of many batches: its stack of owners travels from one to the next."""
    rng = np.random.default_rng(12)
    features = {(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 400), rng.integers(0, 3000, 400))}
    df = spark.createDataFrame([(5, c) for c in range(0, 3000, 7)], "row int, col int")
    fs = spark.createDataFrame(sorted(features), "row int, col int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = SP.nearest_of(df, fs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(range(0, 3000, 7))
    assert all((x["d2"], x["f_row"], x["f_col"]) == nearest_by_hand(features, 5, x["col"]) for x in got)


def test_distance_sends_no_payload_to_python(spark):
    df = spark.range(50).selectExpr("cast(id as int) as row", "cast(id as int) as col", "uuid() as payload", "id % 7 = 0 as f")
    lines = SP.nearest_feature(df, F.col("f"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [re.search(r"\w", x).start() for x in lines]
    top = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    below = list(takewhile(lambda i: depth[i] > depth[top], range(top + 1, len(lines))))
    assert below and not any("payload" in lines[i] for i in [top, *below])


def test_gap_fill_takes_the_nearest_label(spark):
    rng = np.random.default_rng(13)
    known = {(int(a), int(b)): int(a * 7 + b) for a, b in rng.integers(0, 30, size=(25, 2))}
    df = spark.createDataFrame([(1, r, c, known.get((r, c))) for r in range(30) for c in range(30)], "year int, row int, col int, label int")
    got = SP.gap_fill_nearest(df, "label").collect()
    assert len(got) == 900
    for x in got:
        d2, r, c = nearest_by_hand(known, x["row"], x["col"])
        assert (x["d2"], x["label"]) == (d2, known[r, c])


def test_knn_on_sparse_points(spark):
    rng = np.random.default_rng(9)
    pts = {(int(a), int(b)) for a, b in rng.integers(0, 60, size=(40, 2))}
    df = spark.createDataFrame([(1, a, b) for a, b in pts], "year int, row int, col int")
    got = {}
    for r in SP.knn(df, 5).collect():
        got.setdefault((r["row"], r["col"]), []).append((r["d2"], r["n_row"], r["n_col"]))
    for p in pts:
        want = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, *q) for q in pts if q != p)[:5]
        assert sorted(got[p]) == want


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 9), (1, 4, 4)], "year int, row int, col int")
    assert SP.knn(df, 8).count() == 6


def test_knn_far_points_look_at_few_tiles(spark):
    dense = [(1, r, c) for r in range(40) for c in range(40)]
    lone = [(1, 3000, 20), (1, -2500, -2500), (1, 10, 900)]
    df = spark.createDataFrame(dense + lone + [(2, 5, 5), (2, 5, 4000)], "year int, row int, col int")
    got = {}
    for r in SP.knn(df, 8).collect():
        got.setdefault((r["year"], r["row"], r["col"]), []).append((r["k"], r["d2"], r["n_row"], r["n_col"]))
    for year, row, col in [*lone, (1, 0, 0), (1, 39, 17), (1, 20, 20), (2, 5, 5), (2, 5, 4000)]:
        near = sorted(((row - b) ** 2 + (col - d) ** 2, b, d) for a, b, d in dense + lone + [(2, 5, 5), (2, 5, 4000)]
                      if a == year and (b, d) != (row, col))[:8]
        assert sorted(got[year, row, col]) == [(i + 1, *n) for i, n in enumerate(near)]
    todo = df.where("row > 100 or row < 0 or col > 100")
    fronts = SP.tile_frontiers(todo, df, 8, ["year"])
    # Each far point keeps some tens of tiles a level, not the millions of offsets around it.
    assert sum(f.count() for f in fronts) < 60 * todo.count() * len(fronts)


def test_resample_ignores_invalid_sources(spark):
    src = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, None), (1, 1, 0, 3.0), (1, 1, 1, None), (1, 2, 2, None)],
                                "year int, row int, col int, v double")
    got = {(r["row"], r["col"]): r["v"] for r in SP.resample_average(src, "v", 0.5).collect()}
    assert got[0, 0] == pytest.approx(2.0) and got[1, 1] is None


def test_idw_by_hand_and_by_parts(spark):
    cells = spark.createDataFrame([(1, 28.0, 77.0)], "year int, lat double, lon double")
    pts = spark.createDataFrame([(1, 0, 28.0, 77.1, 10.0), (1, 1, 28.2, 77.0, 20.0)], "year int, point_id int, lat double, lon double, t double")
    w = [1 / ((np.cos(np.radians(28.64)) * 0.1) ** 2 + 1e-6), 1 / (0.2**2 + 1e-6)]
    want = (10 * w[0] + 20 * w[1]) / sum(w)
    assert SP.idw(cells, pts, ["t"]).first()["t"] == pytest.approx(want)
    assert SP.idw(cells, pts, ["t"], array_points=1).first()["t"] == pytest.approx(want)


def test_idw_null_stations_and_repeated_cells(spark):
    cells = spark.createDataFrame([(1, 28.0, 77.0), (1, 28.0, 77.0), (2, 28.0, 77.0)], "year int, lat double, lon double")
    pts = spark.createDataFrame(
        [(1, 0, 28.0, 77.1, 10.0, None), (1, 1, 28.2, 77.0, None, None), (1, 2, 28.1, 77.0, 4.0, None), (2, 0, 28.0, 77.1, 3.0, 1.0)],
        "year int, point_id int, lat double, lon double, t double, u double")
    w = [1 / ((np.cos(np.radians(28.64)) * 0.1) ** 2 + 1e-6), 1 / (0.1**2 + 1e-6)]
    for size in (512, 2, 1):
        rows = sorted(SP.idw(cells, pts, ["t", "u"], array_points=size).collect(), key=lambda r: r["year"])
        assert [r["t"] for r in rows] == pytest.approx([(10 * w[0] + 4 * w[1]) / sum(w)] * 2 + [3.0])
        assert [r["u"] for r in rows] == [None, None, pytest.approx(1.0)]


def test_hot_groups_leave_before_the_raw_rows_move(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, float(i)) for i in range(900)], "g int, v double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        q = Qn.grouped_quantiles(df, ["g"], {"v": ["med"]}, [0.5], hot_rows=100)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [g" not in plan.split("Union")[0] and "LeftAnti, BuildRight" in plan
        got = {r["g"]: r["med"] for r in q.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {}
    for i in range(900):
        want.setdefault(0 if i % 3 else i, []).append(float(i))
    assert got == {g: float(np.median(v)) for g, v in want.items()}


def test_thresholds_come_from_training_rows_only(spark):
    rows = [(2022, b, float(i), 0.1, i / 100.0) for b in range(2) for i in range(30)]
    rows += [(2022, 9, 1000.0 + i, 0.1, 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "year int, block_id int, lst_c double, ndbi double, ndvi double")
    p = VL.rule_predictions(df.where("block_id < 9"), df.where("block_id = 9"), ["year"])
    assert {r["y_true"] for r in p.collect()} == {2}


def test_folds_keep_blocks_whole_and_balance(spark):
    df = spark.createDataFrame([(b,) for b in range(10) for _ in range(b + 1)], "block_id int")
    f = {r["block_id"]: r["fold"] for r in VL.group_folds(df, 3).collect()}
    assert sorted(f) == list(range(10))
    load = [sum(b + 1 for b in f if f[b] == k) for k in range(3)]
    assert max(load) - min(load) <= 2
    train, val = VL.fold_rows(df, spark.createDataFrame(list(f.items()), "block_id int, fold int"))
    assert val.count() == df.count() and train.count() == 2 * df.count()
    assert train.join(val.select("block_id", "fold").distinct(), ["block_id", "fold"]).count() == 0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 2, 0)], "g int, y_true int, y_pred int")
    m = VL.class_metrics(df, ["g"]).first()
    assert m["accuracy"] == 0.5 and m["recall_2"] == 0.0 and m["precision_2"] == 0.0
    assert m["balanced_accuracy"] == pytest.approx((0.5 + 1 + 0) / 3) and m["kappa"] == pytest.approx((0.5 - 6 / 16) / (1 - 6 / 16))


def test_overlap_is_symmetric(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    x = df.agg(*O.mask_overlap(F.col("a"), F.col("b"))).first()
    y = df.agg(*O.mask_overlap(F.col("b"), F.col("a"))).first()
    assert x["iou"] == y["iou"] == pytest.approx(1 / 3)


def test_plans_under_budget(spark):
    z = spark.createDataFrame([(1, i, 10.0 - i, 1.0, float(t)) for i, t in enumerate([50, 60, 20, 30], 1)],
                              "year int, zone_id int, score double, ha double, trees double")
    s = R.shortlist(z, ["year"], "score", "ha", 5.0, 10)
    planned = [r["zone_id"] for r in R.plan_prefix(s, ["year"], "trees", F.lit(100)).where("planned").collect()]
    assert planned == [1]
    skip = R.plan_skip(s, ["year"], "trees", 100.0, 10).first()
    assert skip["zone_ids"] == "1,3,4" and skip["used"] == 100.0


def test_running_sum_over_bands(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(1, 40)], "g int, k int, v double")
    for r in R.running_sum(df, ["g"], "k", "v", "s", band=7).collect():
        assert r["s"] == r["k"] * (r["k"] + 1) / 2


def test_sample_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(1, i, i % 7) for i in range(500)], "year int, row int, col int")
    a = R.sample_per_group(df, ["year"], 50)
    assert a.count() == 50 and a.exceptAll(R.sample_per_group(df, ["year"], 50)).count() == 0
    assert R.sample_per_group(df, ["year"], 500).count() == 500


def test_monsoon_onset_needs_a_full_window(spark):
    rows = [(f"2022-05-{d:02d}", 2022, 0.0) for d in range(20, 32)] + [(f"2022-06-{d:02d}", 2022, 0.0 if d < 5 else 5.0) for d in range(1, 29)]
    df = spark.createDataFrame(rows, "d string, year int, rain double").withColumn("day", F.to_date("d"))
    # The ten-day mean first reaches 2.5 on the fifth wet day.
    assert str(M.monsoon_onset(df, "rain").first()["onset"]) == "2022-06-09"


def test_moran_permutation_p(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 18
    for year, field in ((1, lambda r, c: float(r > 8)), (2, lambda r, c: float(rng.random())), (3, lambda r, c: 1.0)):
        rows += [(year, r, c, field(r, c)) for r in range(n) for c in range(n)]
    df = spark.createDataFrame([*rows, (1, 50, 50, None)], "year int, row int, col int, e double").cache()
    edges = SP.knn(df.where("e is not null").select("year", "row", "col"), 4).cache()
    got = {r["year"]: r for r in VL.morans_permutation(df, edges, "e", permutations=99).collect()}
    plain = {r["year"]: r["morans_i"] for r in VL.morans_i(df.where("e is not null"), edges, "e").collect()}
    arrays = {(r["year"], r["row"], r["col"]): r["v"] for r in VL.shifted_values(df.where("e is not null"), "e", ["year"], 99, 42, 100).collect()}
    value = {r[:3]: r[3] for r in rows}
    for year in (1, 2):
        cells = [k for k in value if k[0] == year]
        for shift in (1, 50, 99):
            assert sorted(arrays[k][shift] for k in cells) == sorted(value[k] for k in cells)
        assert all(arrays[k][0] == value[k] for k in cells)
        mean, link = np.mean([value[k] for k in cells]), {}
        for e in edges.where(f"year = {year}").collect():
            link.setdefault((year, e["row"], e["col"]), []).append((year, e["n_row"], e["n_col"]))
        spread = sum((value[k] - mean) ** 2 for k in cells)
        i = [sum((arrays[a][s] - mean) * np.mean([arrays[b][s] - mean for b in bs]) for a, bs in link.items()) / spread for s in range(100)]
        e0 = -1 / (len(cells) - 1)
        want = (1 + sum(abs(x - e0) >= abs(i[0] - e0) - 1e-9 for x in i[1:])) / 100
        assert got[year]["p_value"] == pytest.approx(want) and got[year]["n"] == len(cells)
        assert got[year]["morans_i"] == pytest.approx(i[0]) == pytest.approx(plain[year])
    assert got[1]["p_value"] == 0.01 and got[2]["p_value"] > 0.01
    assert got[3]["morans_i"] is None and got[3]["p_value"] is None


def test_shifted_values_wrap_round_small_groups(spark):
    df = spark.createDataFrame([(1, 0, i, float(i)) for i in range(5)], "year int, row int, col int, e double")
    for r in VL.shifted_values(df, "e", ["year"], 12, 7).collect():
        assert len(r["v"]) == 13 and r["v"][0] == r["col"] and r["v"][5] == r["v"][10] == r["v"][0]
        assert sorted(r["v"][:5]) == [0, 1, 2, 3, 4]


def test_zone_over_many_tiles_joins_cells_by_tile_component(spark):
    snake = {(r, c) for r in range(40) for c in range(40) if r % 2 == 0 or c == (39 if r % 4 == 1 else 0)}
    df = spark.createDataFrame([(1, r, c) for r, c in snake] + [(1, 60, 60), (2, 3, 3)], "year int, row int, col int")
    z = G.label_components(df, tile=8)
    rows = z.collect()
    assert {(r["year"], r["zone_id"], r["n_px"]) for r in rows} == {(1, 1, len(snake)), (1, 2, 1), (2, 1, 1)}
    assert len(rows) == len(snake) + 2
    plan = z._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "comp#" in top and "root#" not in top


def test_stable_ids_follow_the_largest_overlap(spark):
    from heatgrid.plans.zone_queries import stable_ids

    rng = np.random.default_rng(12)
    years, cells = [2022, 2023, 2024], []
    for y in years:
        for z, (r, c) in enumerate(rng.integers(0, 24, size=(14, 2)), 1):
            taken = {(a[1], a[2]) for a in cells if a[0] == y}
            box = {(int(r) + i, int(c) + j) for i in range(int(rng.integers(2, 6))) for j in range(int(rng.integers(2, 6)))} - taken
            cells += [(y, a, b, z, len(box)) for a, b in box]
    df = spark.createDataFrame(cells, "year int, row int, col int, zone_id int, n_px int")
    got = {(r["year"], r["zone_id"]): (r["stable_id"], r["how"]) for r in stable_ids(df, years).collect()}
    want, prev, top, extra = {}, None, 0, 90_000
    for y in years:
        zones = {}
        for a, r, c, z, _ in cells:
            if a == y:
                zones.setdefault(z, set()).add((r, c))
        ids = {z: (z, "new") for z in zones} if prev is None else {}
        if prev is not None:
            best = {}
            for z, at in zones.items():
                over = {s: len(at & p) for s, p in prev.items()}
                over = [(-n, s) for s, n in over.items() if n and n >= 0.30 * len(at)]
                if over:
                    best[z] = min(over)[1]
            for s in set(best.values()):
                holder = min((z for z in best if best[z] == s), key=lambda z: (-len(zones[z]), z))
                ids[holder] = (s, "kept")
            for z in sorted(set(best) - set(ids)):
                ids[z] = (extra, "split")
                extra += 1
            for i, z in enumerate(sorted(set(zones) - set(best)), 1):
                ids[z] = (top + i, "new")
        top = max([top, *(s for s, _ in ids.values() if s < 90_000)])
        want.update({(y, z): v for z, v in ids.items()})
        prev = {}
        for z, (s, _) in ids.items():
            prev.setdefault(s, set()).update(zones[z])
    assert got == want
    assert {h for _, h in got.values()} >= {"new", "kept"}
