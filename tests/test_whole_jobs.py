"""Registered queries over the whole job: the shortlist of 100 in the skip plan, the hash in the inventory."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from heatgrid.operators import ranking as R
from heatgrid.plans import load_all
from heatgrid.plans.registry import QUERIES

load_all()
from heatgrid.plans import zone_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_skip_plan_offers_sites_up_to_rank_100(spark, monkeypatch):
    def sites(_, sf, top=zone_queries.TOP):
        z = spark.range(1, 121).select(
            F.lit(2022).alias("year"), F.col("id").cast("int").alias("zone_id"), (200.0 - F.col("id")).alias("score"), F.lit(0.09).alias("usable_ha"))
        return R.shortlist(z, ["year"], "score", "usable_ha", zone_queries.MAX_HA, top)

    monkeypatch.setattr(zone_queries, "site_table", sites)
    row = QUERIES["rnk8_plan_skip_over"](spark, "").first()
    assert row["used"] < 10000 and row["n_sites"] == 100
    assert row["zone_ids"] == ",".join(str(i) for i in range(1, 101))


def test_file_inventory_has_the_hash_of_every_file(spark, tmp_path):
    (tmp_path / "lst_2024.tif").write_bytes(b"abc")
    (tmp_path / "notes.csv").write_bytes(b"x,y\n")
    got = {r["name"]: r["sha256"] for r in QUERIES["src6_file_inventory"](spark, str(tmp_path)).collect()}
    assert got == {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(tmp_path).iterdir()}


# The frozen schema's names, in its order.
FROZEN = [
    "ndvi", "ndbi", "vegetation_cover", "ndmi", "mndwi", "bsi", "ndre", "landuse_class_0.0", "landuse_class_2.0", "landuse_class_4.0",
    "landuse_class_5.0", "landuse_class_6.0", "landuse_class_7.0", "landuse_class_8.0", "lulc_class_0", "lulc_class_1", "lulc_class_2", "lulc_class_3",
    "lulc_class_4", "lulc_class_5", "lulc_class_6", "lulc_class_7", "lulc_class_8", "dist_road_m", "dist_vegetation_m", "dist_building_m", "year",
    "ndvi_mean3", "ndvi_mean5", "ndvi_mean11", "ndbi_mean3", "ndbi_mean5", "ndbi_mean11", "vegetation_cover_mean3", "vegetation_cover_mean5",
    "vegetation_cover_mean11", "ndmi_mean3", "ndmi_mean5", "ndmi_mean11", "bsi_mean3", "bsi_mean5", "bsi_mean11", "dist_road_m_mean3",
    "dist_road_m_mean5", "dist_road_m_mean11", "dist_vegetation_m_mean3", "dist_vegetation_m_mean5", "dist_vegetation_m_mean11", "dist_building_m_mean3",
    "dist_building_m_mean5", "dist_building_m_mean11", "building_pixel_fraction_50m", "road_pixel_fraction_50m", "vegetation_pixel_fraction_50m",
    "vegetation_cover_mean_50m", "landuse_frac_1_50m", "landuse_frac_2_50m", "landuse_frac_3_50m", "landuse_frac_4_50m", "landuse_frac_5_50m",
    "landuse_frac_6_50m", "landuse_frac_7_50m", "landuse_frac_8_50m", "landuse_dominant_50m_0", "landuse_dominant_50m_2", "landuse_dominant_50m_4",
    "landuse_dominant_50m_5", "landuse_dominant_50m_6", "landuse_dominant_50m_7", "landuse_dominant_50m_8", "landuse_entropy_50m", "ndvi_contrast_50m",
    "ndbi_contrast_50m", "building_pixel_fraction_100m", "road_pixel_fraction_100m", "vegetation_pixel_fraction_100m", "vegetation_cover_mean_100m",
    "landuse_frac_1_100m", "landuse_frac_2_100m", "landuse_frac_3_100m", "landuse_frac_4_100m", "landuse_frac_5_100m", "landuse_frac_6_100m",
    "landuse_frac_7_100m", "landuse_frac_8_100m", "landuse_dominant_100m_0", "landuse_dominant_100m_2", "landuse_dominant_100m_4",
    "landuse_dominant_100m_5", "landuse_dominant_100m_6", "landuse_dominant_100m_7", "landuse_dominant_100m_8", "landuse_entropy_100m",
    "ndvi_contrast_100m", "ndbi_contrast_100m", "building_pixel_fraction_250m", "road_pixel_fraction_250m", "vegetation_pixel_fraction_250m",
    "vegetation_cover_mean_250m", "landuse_frac_1_250m", "landuse_frac_2_250m", "landuse_frac_3_250m", "landuse_frac_4_250m", "landuse_frac_5_250m",
    "landuse_frac_6_250m", "landuse_frac_7_250m", "landuse_frac_8_250m", "landuse_dominant_250m_0", "landuse_dominant_250m_2", "landuse_dominant_250m_4",
    "landuse_dominant_250m_5", "landuse_dominant_250m_6", "landuse_dominant_250m_7", "landuse_dominant_250m_8", "landuse_entropy_250m",
    "ndvi_contrast_250m", "ndbi_contrast_250m", "building_pixel_fraction_500m", "road_pixel_fraction_500m", "vegetation_pixel_fraction_500m",
    "vegetation_cover_mean_500m", "landuse_frac_1_500m", "landuse_frac_2_500m", "landuse_frac_3_500m", "landuse_frac_4_500m", "landuse_frac_5_500m",
    "landuse_frac_6_500m", "landuse_frac_7_500m", "landuse_frac_8_500m", "landuse_dominant_500m_0", "landuse_dominant_500m_2", "landuse_dominant_500m_4",
    "landuse_dominant_500m_5", "landuse_dominant_500m_6", "landuse_dominant_500m_7", "landuse_dominant_500m_8", "landuse_entropy_500m",
    "ndvi_contrast_500m", "ndbi_contrast_500m", "met_t2m_c", "met_rh_pct", "met_wind_kmh", "met_precip_mm", "met_ssr_wm2", "met_swc_m3m3", "ndvi_std3",
    "ndvi_std5", "ndvi_std11", "ndbi_std3", "ndbi_std5", "ndbi_std11", "ndre_std3", "ndre_std5", "ndre_std11", "ndmi_std3", "ndmi_std5", "ndmi_std11",
    "mndwi_std3", "mndwi_std5", "mndwi_std11", "bsi_std3", "bsi_std5", "bsi_std11", "vegetation_cover_std3", "vegetation_cover_std5",
    "vegetation_cover_std11", "mndwi_mean3", "mndwi_mean5", "mndwi_mean11", "ndre_mean3", "ndre_mean5", "ndre_mean11", "ndvi_range3", "ndvi_range5",
    "ndvi_range11", "ndbi_range3", "ndbi_range5", "ndbi_range11",
]


def test_feature_table_has_the_frozen_schema_and_the_stack_that_sql_checks(spark):
    d = QUERIES["nbr10_feature_table"](spark, SF)
    assert d.columns[:4] == ["row", "col", "block_id", "lst_c"]
    names = d.columns[4:]
    assert len(names) == len(set(names)) == 178 and names == FROZEN
    rows = {(r["year"], r["row"], r["col"]): r for r in d.collect()}
    stack = QUERIES["nbr10_feature_stack"](spark, SF)
    some = stack.collect()
    assert len(some) == len(rows) > 0
    assert all(rows[r["year"], r["row"], r["col"]][x] == r[x] for r in some for x in stack.columns)
    for r in rows.values():
        for m in (50, 100, 250, 500):
            assert sum(r[f"landuse_dominant_{m}m_{k}"] for k in (0, 2, 4, 5, 6, 7, 8)) <= 1
        assert sum(r[f"lulc_class_{k}"] for k in range(9)) <= 1 and r["met_t2m_c"] is not None
    weather = {}
    for (_, row, col), r in rows.items():
        weather.setdefault((row, col), []).append(r["met_t2m_c"])
    assert all(len(set(v)) == len(v) for v in weather.values())
