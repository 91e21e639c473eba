"""Gates that recompute: a saved table against the same table made again, and the rules around it.

Every gate returns rows (check_id, n_bad, ok). `recompute_diff` is the one comparison they share: both tables meet in one
aggregation by key, so a key that is missing, left over, repeated or changed is each seen, NULL keys included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from heatgrid.operators.checks import checks, union


def _same(a: Column, b: Column, tol: float) -> Column:
    equal = a.eqNullSafe(b)
    return equal | F.coalesce(F.abs(a - b) <= tol, F.lit(False)) if tol else equal


def recompute_diff(saved: DataFrame, again: DataFrame, keys: Sequence[str], values: Mapping[str, float]) -> DataFrame:
    """One row per key of either table: n_saved, n_again, and `changed`, the columns that differ by more than their tolerance.

    Tolerance 0 asks for equality, NULL and NaN equal to themselves. Of a repeated key the greatest row is compared.
    """
    row = F.struct(F.lit(True).alias("_here"), *[F.col(v) for v in values]).alias("_row")
    both = saved.select(*keys, F.lit(True).alias("_saved"), row).unionByName(again.select(*keys, F.lit(False).alias("_saved"), row))
    d = both.groupBy(*keys).agg(
        F.count_if("_saved").alias("n_saved"), F.count_if(~F.col("_saved")).alias("n_again"),
        F.max(F.when(F.col("_saved"), F.col("_row"))).alias("_a"), F.max(F.when(~F.col("_saved"), F.col("_row"))).alias("_b"))
    differ = [F.when(~_same(F.col(f"_a.{v}"), F.col(f"_b.{v}"), tol), F.lit(v)) for v, tol in values.items()]
    found = F.array_compact(F.array(*differ)) if differ else F.array().cast("array<string>")
    met = (F.col("n_saved") > 0) & (F.col("n_again") > 0)
    return d.withColumn("changed", F.when(met, found).otherwise(F.array().cast("array<string>"))).drop("_a", "_b")


def diff_gate(name: str, saved: DataFrame, again: DataFrame, keys: Sequence[str], values: Mapping[str, float]) -> DataFrame:
    """Keys that are missing, left over or repeated in the saved table, and changed ones per column."""
    rules = {f"{name}_missing": F.col("n_saved") == 0, f"{name}_extra": F.col("n_again") == 0, f"{name}_repeated": F.col("n_saved") > 1}
    rules |= {f"{name}_{v}": F.array_contains("changed", v) for v in values}
    return checks(recompute_diff(saved, again, keys, values), rules)


def contract_gate(name: str, df: DataFrame, wanted: Sequence[str], banned: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Columns that are missing (or out of place, if the order is part of the contract), and banned ones that are there."""
    have = df.columns
    off = sum(a != b for a, b in zip(wanted, have)) + abs(len(wanted) - len(have)) if ordered else len(set(wanted) - set(have))
    bad = {f"{name}_schema": off, f"{name}_banned": len(set(banned) & set(have))}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.lit(n).cast("long").alias("n_bad")) for k, n in bad.items()]))
    return df.sparkSession.range(1).select(rows.alias("x")).select("x.*").withColumn("ok", F.col("n_bad") == 0)


def gradient_gate(name: str, df: DataFrame, limits: Mapping[str, float], keys: Sequence[str] = ("year",)) -> DataFrame:
    """Neighbours in a grid row whose values differ by more than a smooth field can."""
    line = W.partitionBy(*keys, "row").orderBy("col")
    beside = F.col("col") - F.lag("col").over(line) == 1
    steps = df.select(*[F.when(beside, F.abs(F.col(v) - F.lag(v).over(line))).alias(v) for v in limits])
    return checks(steps, {f"{name}_{v}": F.col(v) > top for v, top in limits.items()})


def band_preflight(df: DataFrame, bands: Sequence[str], expected: DataFrame, by: str = "year") -> DataFrame:
    """Per expected (by, band, gate): MISSING, INFINITE, LOW (valid share below the gate) or OK; inputs not expected are not judged."""
    pairs = ", ".join(f"'{b}', cast(`{b}` as double)" for b in bands)
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    seen = df.select(by, F.expr(f"stack({len(bands)}, {pairs}) as (band, v)")).groupBy(by, "band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("n_valid"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"))
    out = expected.join(seen, [by, "band"], "left").fillna(0, ["n", "n_valid", "n_inf"])
    share = F.coalesce(F.try_divide("n_valid", "n"), F.lit(0.0))
    status = (F.when((F.col("n_valid") == 0) & (F.col("n_inf") == 0), "MISSING").when(F.col("n_inf") > 0, "INFINITE")
              .when(share < F.col("gate"), "LOW").otherwise("OK"))
    return out.select(by, "band", "n", "n_valid", "n_inf", share.alias("coverage"), status.alias("status"))


def feature_gates(
    features: DataFrame, predictors: Sequence[str], block: Column, evidence: DataFrame, smooth: Mapping[str, float],
    keys: Sequence[str] = ("year", "row", "col"),
) -> DataFrame:
    """Predictor table: finite values, block ids as the grid says, no row without a guarded observation, smooth fields.

    `evidence` holds the keys of cells with at least one optical observation that passed the zero guard.
    """
    v = [F.col(p) for p in predictors]
    rules = {"null": sum((x.isNull().cast("int") for x in v), F.lit(0)) > 0,
             "infinite": F.coalesce(F.greatest(F.lit(0.0), *[F.abs(x.cast("double")) for x in v]) == float("inf"), F.lit(False)),
             "block_id": ~F.col("block_id").eqNullSafe(block)}
    bare = features.join(evidence.select(*keys).distinct(), list(keys), "left_anti")
    return union([checks(features, rules), checks(bare, {"no_guarded_observation": F.lit(True)}), gradient_gate("gradient", features, smooth, keys[:1])])


def suitability_gates(
    saved: DataFrame, cells: DataFrame, record: DataFrame, again: DataFrame, shares: DataFrame, tol: float = 1e-6,
    keys: Sequence[str] = ("year", "row", "col"),
) -> DataFrame:
    """Priority classes (saved) against the scores (cells: feasible, priority) and the recorded thresholds (one row: t1, t2);
    those against the recomputed ones (`again`, one row), and the share table (year, priority_class, n) against a recount."""
    t1, t2 = F.col("t1"), F.col("t2")
    p = F.col("priority").cast("float").cast("double")
    expected = cells.join(F.broadcast(record.limit(1))).select(
        *keys, F.when(F.col("feasible"), (p >= t1).cast("int") + (p >= t2).cast("int")).alias("priority_class"))
    on_land = saved.join(cells.select(*keys, "feasible"), list(keys))
    pair = record.select("t1", "t2").join(again.select(t1.alias("_1"), t2.alias("_2")))
    recount = saved.where("priority_class is not null").groupBy("year", "priority_class").agg(F.count(F.lit(1)).alias("n"))
    return union([
        diff_gate("class", saved, expected, keys, {"priority_class": 0}),
        checks(on_land, {"class_off_feasible": F.col("priority_class").isNotNull() != F.col("feasible")}),
        checks(pair, {"thresholds": (F.abs(t1 - F.col("_1")) > tol) | (F.abs(t2 - F.col("_2")) > tol) | (t1 >= t2)}),
        diff_gate("share", shares, recount, ["year", "priority_class"], {"n": 0})])


def certainty(untagged_share: Column) -> Column:
    """How well the land use of a site is known."""
    return F.when(untagged_share > 0.5, "low").when(untagged_share > 0.2, "mixed").otherwise("identified")


def exact_trees(px: Column, density: int) -> Column:
    """floor(0.09 ha a pixel times the density) in whole numbers."""
    whole = px.cast("long") * (9 * density)
    return ((whole - whole % 100) / 100).cast("long")


def tree_gates(
    cells: DataFrame, cells_again: DataFrame, sites: DataFrame, sites_again: DataFrame, densities: Sequence[int] = (400, 1000, 2500),
    banned: Sequence[str] = (), tol: float = 1e-5,
) -> DataFrame:
    """Site cells against the rule applied again; the site table's areas, scores, ranks, shortlist, trees and certainty.

    A site table that lacks columns of the contract is judged by the contract alone.
    """
    keys = ["year", "zone_id"]
    wanted = sites_again.select(
        *keys, F.round(F.col("px") * 0.09, 3).alias("usable_ha"), "score", "rank", "shortlist", certainty(F.col("untagged_share")).alias("certainty"),
        *[exact_trees(F.col("px"), d).alias(f"trees_{d}") for d in densities])
    values = {"usable_ha": 0, "score": tol, "rank": 0, "shortlist": 0, "certainty": 0} | {f"trees_{d}": 0 for d in densities}
    contract = contract_gate("sites", sites, [*keys, *values], banned)
    if not {*keys, *values} <= set(sites.columns):
        return contract
    return union([contract, diff_gate("cell", cells, cells_again, ["year", "row", "col"], {}), diff_gate("site", sites, wanted, keys, values)])


def cooling_gates(
    panel: DataFrame, panel_again: DataFrame, predicted: DataFrame, metrics: DataFrame, locked: Sequence[int],
    keys: Sequence[str] = ("start_year", "row", "col"),
) -> DataFrame:
    """Panel of transitions against the cells; every free row predicted once and no locked one; metrics that can be."""
    free = panel_again.where(~F.col("block_id").isin(*locked))
    r2 = F.col("r2")
    return union([
        diff_gate("panel", panel, panel_again, keys, {"delta_lst": 0}), checks(panel, {"adjacent": F.col("end_year") != F.col("start_year") + 1}),
        diff_gate("predicted", predicted, free, keys, {}), checks(predicted, {"locked_in_cv": F.col("block_id").isin(*locked)}),
        checks(metrics, {"mae_over_rmse": F.col("mae") > F.col("rmse") + 1e-9, "r2_range": (r2 < -1 - 1e-9) | (r2 > 1 + 1e-9), "no_rows": F.col("n") <= 0})])


def model_gates(
    saved: DataFrame, again: DataFrame, metrics: DataFrame, metrics_again: DataFrame, thresholds: DataFrame, thresholds_again: DataFrame,
    folds: DataFrame, tol: float = 1e-9, keys: Sequence[str] = ("year", "row", "col"),
) -> DataFrame:
    """Stored predictions against the reloaded model's, stored metrics against a recount of the stored predictions,
    thresholds (year, t1, t2) against those of training rows alone, and one fold per block."""
    per_block = folds.groupBy("block_id").agg(F.count_distinct("fold").alias("n"))
    total = sum((F.col(f"support_{k}") for k in range(3)), F.lit(0))
    return union([
        diff_gate("reload", saved, again, keys, {"y_pred": 0}),
        diff_gate("metric", metrics, metrics_again, ["year"], {"n": 0, "accuracy": tol, "macro_f1": tol}),
        checks(metrics, {"support_sum": total != F.col("n")}),
        diff_gate("threshold", thresholds, thresholds_again, ["year"], {"t1": tol, "t2": tol}),
        checks(thresholds, {"threshold_order": F.col("t1") >= F.col("t2")}), checks(per_block, {"folds_overlap": F.col("n") != 1})])
