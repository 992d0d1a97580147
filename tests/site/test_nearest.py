"""Nearest entries: rows listed under neighbouring cells never go to the driver, and rows at one place are looked up once."""

import os

import pytest

from sitescan.operators import link
from sitescan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["link_register", "entries_not_found", "compare_to_truth"])
def test_listed_cells_are_not_broadcast(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in plan.splitlines() if "Join" in line and "cx#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_equal_places(spark):
    """Of entries at one place the first counts, a null order before others; every asset at a place gets it, an id at two places the nearer."""
    a = spark.createDataFrame([(0, i, "P", float(i % 2), 0.0, 0.0) for i in range(20)] + [(0, 50, "P", 0.9, 0.0, 0.0), (0, 50, "P", 0.99, 0.0, 0.0), (0, 60, "P", None, 0.0, 0.0), (1, 70, "P", 0.0, 0.0, 0.0), (0, 80, "P", 0.5, 0.0, -0.0)], "site_id long, asset_id long, product string, x double, y double, z double")
    e = spark.createDataFrame([(0, 100 - i, float(i % 2), -0.0, 0.0, i) for i in range(20)] + [(0, 200, 1.0, 0.0, 0.0, None)], "site_id long, entry_id long, x double, y double, z double, o int")
    got = sorted(tuple(r) for r in link.nearest(a, e, "asset_id", "entry_id", "o", 0.6).collect())
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in got] == [(0, i, 200 if i % 2 else 100, 0.0) for i in range(20)] + [(0, 50, 200, 0.01), (0, 80, 200, 0.5)]
    assert link.nearest(a, e, "asset_id", "entry_id", "entry_id", 0.5, strict=True).filter("asset_id = 80").count() == 0
