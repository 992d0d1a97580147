"""Ordered and sharded files, stored points, records and reports, models of workers, and quantiles by place."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitescan.operators import assets, lift, link, planes, tiles
from sitescan.sources import io


def test_sorted_files_give_one_order(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("v")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_sorted(rows, f"file://{tmp_path}/s", "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = io.read_sorted(spark, f"file://{tmp_path}/s").collect()
    assert len(list(tmp_path.glob("s/*.parquet"))) > 1 and sorted((r.k, r["rank"]) for r in got) == [(k, k + 1) for k in range(5000)]
    io.write_sorted(rows.limit(0), f"file://{tmp_path}/e", "k")
    assert io.read_sorted(spark, f"file://{tmp_path}/e").count() == 0
    same = spark.range(40).select(F.lit(1).alias("k"), "id")
    io.write_sorted(same, f"file://{tmp_path}/t", "k")
    assert sorted(r["rank"] for r in io.read_sorted(spark, f"file://{tmp_path}/t").collect()) == list(range(1, 41))


def test_documents_of_a_site_are_put_together(spark, tmp_path):
    photos = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "site_id long, photo string")
    dets = spark.createDataFrame([(1, "a", 7, 1.0, 2.0, 3.00049, 4.0, 0.12345, 0), (1, "a", 3, 0.0, 0.0, 1.0, 1.0, 0.5, 1), (2, "a", 1, 0.0, 0.0, 1.0, 1.0, 0.5, 1)], "site_id long, photo string, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    classes = spark.createDataFrame([(0, "A"), (1, "B")], "cls int, product string")
    io.write_detections(photos, dets, f"file://{tmp_path}/d", classes, "w")
    back, names, kinds = io.read_detections(spark, f"file://{tmp_path}/d", lines=True)
    assert sorted(map(tuple, names.collect())) == [(1, "a"), (1, "b"), (2, "a")]
    assert sorted((r.site_id, r.det_id, r.x2, r.conf, r.cls) for r in back.collect()) == [(1, 0, 1.0, 0.5, 1), (1, 1, 3.0, 0.123, 0), (2, 0, 1.0, 0.5, 1)]
    assert sorted(map(tuple, kinds.collect())) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "A"), (2, 1, "B")]


def test_stored_points_join_cameras_without_a_shuffle(spark, tmp_path):
    cams = spark.createDataFrame([(s, f"p{s}{i}", i, 0, 8, 8, 1.0, 1.0, 4.0, 4.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0) for s in range(3) for i in range(4)], io.IMAGES)
    points = spark.range(4000).select((F.col("id") % 3).alias("site_id"), (F.col("id") % 4).cast("int").alias("sweep"), F.col("id").alias("idx"), *((F.col("id") % 5).cast("double").alias(a) for a in "xyz"))
    io.store_points(points, "stored_points", f"file://{tmp_path}/p", 4)
    io.store_images(cams, "stored_images", f"file://{tmp_path}/i", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        from sitescan.functions.geometry import project_points

        got = project_points(spark.table("stored_points"), spark.table("stored_images"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert got.count() == project_points(points, cams).count() == 4000
        assert "Exchange" in project_points(points, cams)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE stored_points")
        spark.sql("DROP TABLE stored_images")


def test_models_are_loaded_once_per_worker_and_get_full_batches(spark):
    images = spark.range(40).select(F.lit(0).cast("long").alias("site_id"), F.col("id").alias("photo"), F.lit(1500).alias("width"), F.lit(900).alias("height"))

    def predictor():
        import os
        import uuid

        loaded = uuid.uuid4().int % (1 << 40)

        def model(part):
            return pd.DataFrame({"row": np.arange(len(part)), "x1": float(len(part)), "y1": float(loaded), "x2": float(os.getpid()), "y2": 0.0, "conf": 0.5, "cls": np.int32(0)})

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = pd.concat(tiles.predict_tiles(tiles.plan_tiles(images), predictor, n, name="test-model").toPandas() for n in (3, 5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.groupby("x2").y1.nunique().max() == 1 and len(got) == 2 * tiles.plan_tiles(images).count()
    sizes = got.groupby("x1").size()
    assert sizes.get(16.0, 0) > len(got) / 2  # only a task's last batch holds fewer


def test_quantiles_and_medians_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(0, f"p{b % 3}", b, float(v), *map(float, rng.integers(0, 5, 3))) for b in range(30) for v in rng.integers(0, 6, 1 + b)]
    df = spark.createDataFrame(rows, "site_id long, photo string, box_id long, depth double, x double, y double, z double")
    for share in (0.0, 0.25, 0.6, 1.0):
        got = {(r.box_id, r.q) for r in lift.with_quantile(df, "depth", share, "q").collect()}
        assert len(got) == 30
        for b, q in got:
            assert q == pytest.approx(np.percentile([r[3] for r in rows if r[2] == b], 100 * share), abs=1e-12)
    for r in lift.medians(df).collect():
        own = np.array([x[4:] for x in rows if x[2] == r.box_id])
        assert r.n_points == len(own) and np.allclose(np.median(own, 0), [r.x, r.y, r.z])


def test_points_of_a_plan_are_shuffled_once(spark):
    from sitescan.plans.views import spark_view

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sf = "/root/testdata/sf0.001"
        plan = lift.lift_boxes(*(spark_view(spark, sf, v) for v in ("v_points", "v_images", "v_plates")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
    assert sum("Exchange hashpartitioning(box_id" in line for line in plan.splitlines()) == 1


def test_normals_in_closed_form_are_those_of_numpy(spark):
    rng = np.random.default_rng(8)
    groups = {g: rng.normal(size=(20, 3)) * [1, 0.5, 10.0 ** -(g % 6)] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 10 for g in range(40)}
    line = np.outer(np.arange(5.0), [1, 2, 3])
    rows = [(g, *map(float, p)) for g, pts in {**groups, 90: line, 91: line[:1], 92: np.repeat(line[1:2], 4, 0)}.items() for p in pts]
    got = {r.g: r for r in planes.fit_planes(spark.createDataFrame(rows, "g long, x double, y double, z double"), ["g"]).collect()}
    for g, pts in groups.items():
        want = np.linalg.svd(pts - pts.mean(0))[2][2]
        r = got[g]
        if g % 6:  # else the two smaller spreads are near each other
            assert abs(abs(want @ [r.nx, r.ny, r.nz]) - 1) < 1e-9
        assert r.nx**2 + r.ny**2 + r.nz**2 == pytest.approx(1)
    assert all(got[g].nx is None for g in (90, 91, 92))


def test_records_have_three_digits_and_reports_what_is_missing(spark):
    rows = [(0, 1, 0, s, f"p{s}", s, 1.23456 + s * 1e-4, 2.0, 3.0, 0.61234, 100.0 + s, 100.0, 200.0, 200.0, s) for s in range(6)]
    clustered = spark.createDataFrame(rows, "site_id long, cls int, cluster long, sweep int, photo string, det_id long, x double, y double, z double, conf double, x1 double, y1 double, x2 double, y2 double, join_no long")
    keys = ["site_id", "cls", "cluster"]
    best = assets.best_view(clustered, keys, F.lit(1024.0), F.lit(1024.0), F.col("join_no"))
    normals = spark.createDataFrame([(0, "p0", 0, 0.12349, 0.0, -1.0)], "site_id long, photo string, box_id long, nx double, ny double, nz double")
    classes = spark.createDataFrame([(1, "relay")], "cls int, product string")
    found = assets.asset_records(assets.number_assets(assets.assets_from_clusters(clustered, keys)), best, classes, normals)
    r = found.first()
    assert (r.asset_id, r.product, r.class_id, r.x, r.nx, r.best_photo, r.sightings) == ("asset-01", "relay", 1, 1.235, 0.123, "p0", 6)
    assert r.seen_in[0].conf == 0.612 and r.seen_in[0].box == [100, 100, 200, 200] and len(r.sweeps) == 6
    register = spark.createDataFrame([(0, 1, "T1", 1.2, 2.0, 3.0), (0, 2, "T2", 9.0, 9.0, 9.0), (5, 3, "T3", 0.0, 0.0, 0.0)], "site_id long, entry_id long, tag_name string, x double, y double, z double")
    objects = spark.createDataFrame([(0, 4, 1.2, 2.0, 3.0), (0, 5, 7.0, 7.0, 7.0)], "site_id long, object_id long, x double, y double, z double")
    linked = link.link_register(found, register)
    got = {x.site_id: x for x in link.site_report(linked, register, link.compare_to_truth(found, objects), objects).collect()}
    assert (got[0].assets, got[0].registered, got[0].register_entries_not_found, got[0].objects, got[0].located, got[0].missing) == (1, 1, ["T2"], 2, 1, ["5"])
    assert (got[5].assets, got[5].register_entries_not_found, got[5].objects) == (0, ["T3"], 0)
    assert link.site_report(linked, register).columns == ["site_id", "assets", "registered", "register_entries_not_found"]


def test_register_cells_with_quotes_and_lines(spark, tmp_path):
    head = "tag_name,panel,panel_function,cabinet,x,y,z,last_inspection,next_inspection,maintenance_note\n"
    (tmp_path / "r.csv").write_text(head + '"T ""1""",P,"a, b",C,1,2,3,2024-01-02,,"two\nlines"\n', encoding="utf-8")
    r = io.read_register(spark, f"file://{tmp_path}/r.csv").first()
    assert (r.tag_name, r.panel_function, r.maintenance_note, r.next_inspection) == ('T "1"', "a, b", "two\nlines", None)
