"""Scalar rules by hand-computed values."""

import pytest
from pyspark.sql import functions as F

from heatgrid.functions import cells as C
from heatgrid.functions import scores as S
from heatgrid.operators import classify as L


def one(spark, **cols):
    row = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()
    return row.asDict()


def test_indices(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=C.norm_diff(F.lit(0.6), F.lit(0.2)), z=C.norm_diff(F.lit(0.0), F.lit(0.0)),
            k=C.lst_c(F.lit(44000.0)), v=C.vegetation_cover(F.lit(0.425)), lo=C.vegetation_cover(F.lit(-0.3)),
            hi=C.vegetation_cover(F.lit(0.95)), nul=C.vegetation_cover(n), bsi=C.bsi(F.lit(.1), F.lit(.2), F.lit(.1), F.lit(.4)))
    assert r["a"] == pytest.approx(0.5) and r["z"] is None
    assert r["k"] == pytest.approx(44000 * 0.00341802 + 149.0 - 273.15)
    assert (r["v"], r["lo"], r["hi"], r["nul"]) == (pytest.approx(0.5), 0.0, 1.0, None)
    assert r["bsi"] == pytest.approx(0.4 / 0.8)


def test_masks(spark):
    r = one(spark, clear=C.qa_clear(F.lit(2)), cloud=C.qa_clear(F.lit(8)), shadow=C.qa_clear(F.lit(16)),
            scl=C.scl_clear(F.lit(9)), ok=C.valid_s2_10m(F.lit(.1), F.lit(.1), F.lit(.1), F.lit(.1), F.lit(1)),
            zero=C.valid_s2_10m(F.lit(.0), F.lit(.1), F.lit(.1), F.lit(.1), F.lit(1)),
            water=C.valid_lulc(F.lit(0)), dry=C.valid_lulc(F.lit(0), water_is_valid=False))
    assert r == {"clear": True, "cloud": False, "shadow": False, "scl": False, "ok": True, "zero": False, "water": True, "dry": False}


def test_argmax_ties_take_the_lowest_class(spark):
    p = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    r = one(spark, k=C.argmax_class(p), m=C.top2_margin(p), s=C.severity_score(p))
    assert r["k"] == 0 and r["m"] == 0.0 and r["s"] == pytest.approx(0.8)


def test_class_rules_at_an_edge(spark):
    edges = F.array(*[F.lit(x) for x in (20.0, 40.0)])
    r = one(spark, right=L.class_of(F.lit(20.0), edges, "right"), left=L.class_of(F.lit(20.0), edges, "left"),
            nul=L.class_of(F.lit(None).cast("double"), edges))
    assert (r["right"], r["left"], r["nul"]) == (1, 0, None)


@pytest.mark.parametrize("m,want", [(0, 0), (25, 20), (49.999, 39.9992), (50, 100), (500, 100), (1250, 65), (2000, 30), (9000, 30)])
def test_road_accessibility(spark, m, want):
    assert one(spark, v=S.road_accessibility(F.lit(float(m))))["v"] == pytest.approx(want)


def test_scores(spark):
    r = one(spark, g=S.weighted_geometric(F.lit(50.0), F.lit(80.0), 1.0, 1.0), p=S.gated_product(F.lit(50.0), F.lit(80.0)),
            top=S.weighted_geometric(F.lit(100.0), F.lit(100.0), 0.6, 0.3), green=S.green_proximity(F.lit(125.0)),
            lu=S.landuse_eligibility(F.lit(6)), none=S.landuse_eligibility(F.lit(None).cast("int")),
            low=S.priority_class(F.lit(0.1), F.lit(0.2), F.lit(0.3)), edge=S.priority_class(F.lit(0.25), F.lit(0.25), F.lit(0.5)))
    assert r["g"] == pytest.approx(40) and r["p"] == pytest.approx(40) and r["top"] == pytest.approx(100)
    assert (r["green"], r["lu"], r["none"], r["low"], r["edge"]) == (75.0, 90.0, 50.0, 0, 1)


def test_utm_origin_and_scale(spark):
    from heatgrid.operators.spatial import utm_expr
    e, n = utm_expr("lat", "lon")
    rows = spark.createDataFrame([(0.0, 75.0), (28.6, 77.2)], "lat double, lon double").select(F.expr(e).alias("e"), F.expr(n).alias("n")).collect()
    assert rows[0]["e"] == pytest.approx(500000) and rows[0]["n"] == pytest.approx(0, abs=1e-6)
    # One degree of latitude is about 110.8 km here; the easting lies east of the centre line.
    assert 700000 < rows[1]["e"] < 730000 and 3.16e6 < rows[1]["n"] < 3.17e6
