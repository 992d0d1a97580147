"""Boxes, tiles, suppression and matching on hand-made tables, with every tie and edge."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitescan.functions import boxes as bx
from sitescan.functions.boxes import Box
from sitescan.functions.text import keyword_check
from sitescan.operators import matching, metrics, nms, tiles

DET = "site_id long, photo string, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
TRUTH = "site_id long, photo string, truth_id long, object_id int, x1 double, y1 double, x2 double, y2 double, difficulty string"


def test_overlap_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 0.0, 0.0, 10.0, 5.0), (0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (5.0, 5.0, 1.0, 9.0, 0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double, ox1 double, oy1 double, ox2 double, oy2 double")
    rows = df.select(bx.box_iou(Box.of(), Box.of("o")).alias("i"), bx.box_inside(Box.of("o"), Box.of()).alias("n")).collect()
    assert rows[0].i < 0.5 and rows[0].i == pytest.approx(0.5) and rows[0].n == pytest.approx(1.0)
    assert rows[1].i == 0 and rows[2].i == 0 and rows[3].i == 0


def test_tiles_of_a_large_photo(spark):
    images = spark.createDataFrame([(0, "a", 4096, 4096), (0, "b", 500, 400), (0, "c", 1500, 1024)], "site_id long, photo string, width int, height int")
    n = {r.photo: r["count"] for r in tiles.plan_tiles(images).groupBy("photo").count().collect()}
    assert n["a"] == 35
    small = {r.photo: r["count"] for r in tiles.plan_tiles(images, tiles.scales_for()).groupBy("photo").count().collect()}
    assert small == {"a": 35, "b": 1, "c": 3}
    last = tiles.plan_tiles(images).filter("photo = 'a' and scale = 1").agg(F.max("x0"), F.max("tile_w")).first()
    assert tuple(last) == (3072, 1024)


def test_tile_borders(spark):
    t = "site_id long, photo string, width int, height int, scale double, x0 int, y0 int, tile_w int, tile_h int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
    base = (0, "a", 4096, 4096, 0.5, 768, 0, 1024, 1024)
    rows = [(*base, 4.0, 1.0, 100.0, 100.0, 0.9, 0), (*base, 3.0, 1.0, 100.0, 100.0, 0.9, 0), (*base, 10.0, 1.0, 1020.0, 100.0, 0.9, 0), (*base, 10.0, 1.0, 1021.0, 100.0, 0.9, 0)]
    got = tiles.untile_boxes(spark.createDataFrame(rows, t)).collect()
    assert [r.x1 for r in got] == [(4 + 768) * 2, (10 + 768) * 2] and got[0].y1 == 2


def test_predictor_is_called_per_batch(spark):
    images = spark.createDataFrame([(0, "a", 4096, 4096)], "site_id long, photo string, width int, height int")

    def predictor():
        return lambda t: pd.DataFrame({"row": t.index, "x1": 10.0, "y1": 10.0, "x2": 20.0, "y2": t.scale * 40 + 20, "conf": 0.5, "cls": 1})

    got = tiles.predict_tiles(tiles.plan_tiles(images), predictor, 3)
    assert got.count() == 35 and got.filter("y2 = scale * 40 + 20").count() == 35


def brute(rows):
    out = []
    for r in sorted(rows, key=lambda r: (-r[7], r[2])):
        ok = True
        for k in out:
            w, h = max(0, min(r[5], k[5]) - max(r[3], k[3])), max(0, min(r[6], k[6]) - max(r[4], k[4]))
            area = lambda b: (b[5] - b[3]) * (b[6] - b[4])
            ok &= not w * h > 0.5 * (area(r) + area(k) - w * h)
        if ok:
            out.append(r)
    return {r[2] for r in out}


def test_nms_against_a_loop_and_its_invariants(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(6):
        for i in range(30):
            x, y, w, h = rng.uniform(0, 60, 2).tolist() + rng.uniform(10, 40, 2).tolist()
            rows.append((0, f"p{p}", i, x, y, x + w, y + h, round(float(rng.uniform(0, 1)), 1), int(rng.integers(3))))
    df = spark.createDataFrame(rows, DET)
    got = {(r.photo, r.det_id) for r in nms.nms(df).collect()}
    assert got == {(f"p{p}", i) for p in range(6) for i in brute([r for r in rows if r[1] == f"p{p}"])}
    clean = nms.suppress(df).toPandas()
    assert {(r.photo, r.det_id) for r in clean.itertuples()} <= got
    assert nms.suppress(df.limit(0)).count() == 0


def test_contained_boxes(spark):
    rows = [(0, "a", 0, 0.0, 0.0, 100.0, 100.0, 0.5, 0), (0, "a", 1, 90.0, 0.0, 110.0, 10.0, 0.4, 0), (0, "a", 2, 80.0, 20.0, 105.0, 30.0, 0.3, 0)]
    assert {r.det_id for r in nms.suppress_contained(spark.createDataFrame(rows, DET)).collect()} == {0, 1}


def two(spark):
    truth = spark.createDataFrame([(0, "a", 1, 7, 0.0, 0.0, 10.0, 10.0, "clear"), (0, "a", 2, 8, 0.0, 0.0, 10.0, 10.0, "hard: small"), (0, "b", 3, 7, 50.0, 50.0, 60.0, 60.0, "clear")], TRUTH)
    dets = spark.createDataFrame([(0, "a", 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, "a", 1, 0.0, 0.0, 10.0, 9.0, 0.8, 0), (0, "a", 2, 0.0, 0.0, 9.0, 9.0, 0.7, 0), (0, "c", 3, 0.0, 0.0, 9.0, 9.0, 0.6, 0)], DET)
    return dets, truth


def test_loose_match_takes_the_first_exclusive_the_last(spark):
    dets, truth = two(spark)
    loose = {r.det_id: (r.truth_id, r.false_alarm) for r in matching.match_loose(dets, truth).collect()}
    assert loose == {0: (1, False), 1: (1, False), 2: (1, False), 3: (None, True)}
    near = truth.filter("photo = 'b'").withColumn("photo", F.lit("c")).withColumns({"x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.lit(30.0), "y2": F.lit(25.0)})
    assert not matching.match_loose(dets, truth, near).filter("false_alarm").count()
    excl = {r.det_id: r.truth_id for r in matching.match_exclusive(dets, truth).collect()}
    assert excl == {0: 2, 1: 1, 2: None, 3: None}
    assert [r.truth_id for r in matching.missed(truth, matching.match_loose(dets, truth)).orderBy("truth_id").collect()] == [2, 3]
    assert {r.photo for r in matching.photos_of_interest(truth, matching.match_loose(dets, truth)).collect()} == {"a", "b", "c"}


def test_scores(spark):
    dets, truth = two(spark)
    rows = {r.threshold: r for r in metrics.detection_metrics(matching.match_exclusive(dets, truth), truth, (0.5, 0.8, 0.95)).collect()}
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].fn) == (2, 2, 1) and rows[0.5].accuracy == 2 / 5
    assert rows[0.95].tp == 0 and rows[0.95].precision == 0 and rows[0.95].f1 == 0
    sweep = {r.threshold: r for r in metrics.confidence_sweep(matching.match_loose(dets, truth), truth, (0.5, 0.95)).collect()}
    assert (sweep[0.5].found, sweep[0.5].clear_found, sweep[0.5].false_alarms, sweep[0.5].total) == (1, 1, 1, 3)
    assert sweep[0.95].found == 0


def test_auc_equals_pairs(spark):
    rng = np.random.default_rng(3)
    for scores, labels in ((rng.integers(-5, 6, 200) / 3, rng.random(200) < 0.4), (np.ones(5), np.array([1, 1, 0, 0, 0], bool)), (np.arange(4.0), np.ones(4, bool))):
        p, n = scores[labels], scores[~labels]
        want = None if not len(p) or not len(n) else float(np.mean((p[:, None] > n) + 0.5 * (p[:, None] == n)))
        df = spark.createDataFrame([(float(s), bool(x)) for s, x in zip(scores, labels, strict=True)], "conf double, correct boolean")
        got = metrics.roc_auc(df).first().auc
        assert got == want if want is None else got == pytest.approx(want)


def test_keywords(spark):
    df = spark.createDataFrame([([("rel-615", 0.9), ("abb", 0.2)], ["REL", "abb"], 0.5, 60.0), ([("x", 1.0)], ["x"], 0.5, 59.0), ([("x", 1.0)], [], 0.5, 99.0), ([("x", 1.0)], ["x"], 0.2, 99.0)], "t array<struct<text:string,conf:double>>, k array<string>, c double, s double")
    assert [r.k for r in df.select(keyword_check(F.col("t"), F.col("k"), F.col("c"), F.col("s")).alias("k")).collect()] == [["REL"], None, None, None]
