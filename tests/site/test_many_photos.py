"""Many photos with few boxes and tiles each."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescan.operators import nms, tiles
from sitescan.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_photos_together_keep_what_each_keeps_alone():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.choice([0, 1, 2, 3, 14, 64, 65, 90], 30)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = rng.integers(0, 12, (ends[-1], 2)).astype(float)
        x = np.hstack([at, at + rng.integers(-1, 9, (ends[-1], 2))])
        x[rng.integers(len(x), size=3), rng.integers(4)] = np.nan
        for iou, inside in ((0.5, 0.7), (0.5, None), (None, 0.7), (0.0, 0.0)):
            got = nms.kept_boxes(x, ends, iou, inside)
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                assert np.array_equal(np.flatnonzero(got[lo:hi]), nms.kept_order(x[lo:hi], iou, inside))


def test_a_model_may_return_arrays(spark):
    """Some tiles without a box, some with two, batches whole across Arrow's; NaN becomes null, as from a frame."""
    images = spark.range(500).select(F.lit(0).cast("long").alias("site_id"), F.col("id").alias("photo"), F.lit(800).alias("width"), F.lit(600).alias("height"))

    def model(part):
        rows = np.repeat(np.arange(len(part)), part["photo"].to_numpy() % 3)
        return {"row": rows, "x1": np.where(rows == 0, np.nan, rows), "y1": part["photo"].to_numpy()[rows], "x2": np.full(len(rows), len(part)), "y2": rows, "conf": rows, "cls": rows}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = tiles.predict_tiles(tiles.plan_tiles(images, F.array(F.lit(1.0))), lambda: model, 1).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(i % 3 for i in range(500)) and (got.photo == got.y1).all()
    assert got.x1.isna().sum() == (got.y2 == 0).sum() > 0 and set(got.x2) == {16.0, 4.0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_photos_are_dealt_out_before_their_tiles_are_planned(spark):
    plan = QUERIES["predicted_boxes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInArrow")[1]
