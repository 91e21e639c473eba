"""The registry: every query has a unique key and runs; a sample is compared with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["cmp1_median_composite", "cel12_domain", "joi7_resample_average", "joi12_distance_to_feature", "nbr6_disk_class_mix",
          "agg10_block_statistics", "cls7_priority_class", "set4_transition_matrix", "grf1_label_components", "sco16_tree_requirement_by_zone",
          "ml4_locked_holdout", "met3_monsoon_onset", "jsn1_ways_from_nodes", "dq5_suitability_gates"]


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_sql_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "high_percent" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
