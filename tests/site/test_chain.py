"""The flagship chain from boxes to tags, and writers read back."""

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sitescan.functions import boxes as bx
from sitescan.functions import geometry as geo
from sitescan.operators import assets, cloud, dataset, lift, link, truth
from sitescan.sources import io


def test_late_assets_are_numbered_and_linked_in_order(spark):
    a = spark.createDataFrame([(0, 1, k, float(k), 0.0, 0.0) for k in range(120)], "site_id long, cls int, cluster long, x double, y double, z double")
    got = assets.number_assets(a).withColumn("product", F.lit("P"))
    assert got.filter("asset_no = 100").first().asset_id == "asset-100"
    # asset-11 (x = 10) and asset-100 (x = 99) reach for one entry
    got = got.withColumn("x", F.when(F.col("asset_no").isin(11, 100), 500.0 + F.col("asset_no") / 1000).otherwise(F.col("x")))
    r = spark.createDataFrame([(0, 7, "T", 500.05, 0.0, 0.0)], "site_id long, entry_id long, tag_name string, x double, y double, z double")
    linked = link.link_register(got, r)
    assert [x.asset_id for x in linked.filter("registered").collect()] == ["asset-11"]
    objects = spark.createDataFrame([(0, 1, 5.0, 0.0, 0.0), (0, 2, -9.0, 0.0, 0.0)], "site_id long, object_id long, x double, y double, z double")
    assert [x.object_id for x in link.unlocated(objects, link.compare_to_truth(got, objects)).collect()] == [2]


def test_equal_entries_count_in_the_order_of_the_file(spark, tmp_path):
    head = "tag_name,panel,panel_function,cabinet,x,y,z,last_inspection,next_inspection,maintenance_note\n"
    (tmp_path / "r.csv").write_text(head + "".join(f"{t},P,F,C,1,2,3,2024-01-02,,n\n" for t in ("zz", "aa", "mm")))
    r = io.read_register(spark, f"file://{tmp_path}/r.csv").withColumn("site_id", F.lit(0).cast("long"))
    a = spark.createDataFrame([(0, "asset-01", "P", 1.0, 2.0, 3.1)], "site_id long, asset_id string, product string, x double, y double, z double")
    assert link.link_register(a, r).first().title == "zz"


def room(spark):
    """Points on the wall y = 4 and cameras at six places that look along +y."""
    rng, n = np.random.default_rng(1), 12000
    pts = [pd.DataFrame({"site_id": 0, "sweep": s, "idx": np.arange(n), "x": rng.uniform(-2, 2, n), "y": 4 + rng.normal(0, 0.0005, n), "z": rng.uniform(0.5, 2, n)}) for s in range(6)]
    q = float(np.sqrt(0.5))
    cams = [(0, f"s{s}", s, 0, 1024, 1024, 512.0, 512.0, 512.0, 512.0, q, q, 0.0, 0.0, 0.2 * s - 0.5, 0.0, 1.2) for s in range(6)]
    return spark.createDataFrame(pd.concat(pts), "site_id long, sweep int, idx long, x double, y double, z double"), spark.createDataFrame(cams, io.IMAGES)


def test_boxes_become_tags(spark, tmp_path):
    points, cams = room(spark)
    places = {0: (-0.5, 1.2), 1: (0.8, 1.4)}
    rows = []
    for k, (x, z) in places.items():
        for s in range(6):
            u, v = 512 + 512 * (x - (0.2 * s - 0.5)) / 4, 512 - 512 * (z - 1.2) / 4
            rows.append((0, f"s{s}", 10 * k + s, s, u - 12, v - 12, u + 12, v + 12, 0.5 + 0.05 * s, 0))
    dets = spark.createDataFrame(rows, "site_id long, photo string, det_id long, sweep int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    lifted = lift.lift_boxes(points, cams, dets.withColumn("box_id", F.col("det_id"))).withColumnRenamed("box_id", "det_id")
    # each step is written, as in a job of steps
    dets.join(lifted, ["site_id", "photo", "det_id"]).write.parquet(f"file://{tmp_path}/sightings")
    assets.cluster_sightings(spark.read.parquet(f"file://{tmp_path}/sightings"), 0.15).write.parquet(f"file://{tmp_path}/clustered")
    clustered = spark.read.parquet(f"file://{tmp_path}/clustered")
    keys = ["site_id", "cls", "cluster"]
    found = assets.number_assets(assets.assets_from_clusters(clustered, keys)).join(assets.best_view(clustered, keys, F.lit(1024.0), F.lit(1024.0), F.col("join_no")), keys)
    found.write.parquet(f"file://{tmp_path}/assets")
    found = spark.read.parquet(f"file://{tmp_path}/assets")
    register = spark.createDataFrame([(0, 1, "T1", "P", "F", "C7", -0.45, 4.0, 1.2, None, None, "note")], "site_id long, entry_id long, tag_name string, panel string, panel_function string, cabinet string, x double, y double, z double, last_inspection date, next_inspection date, maintenance_note string")
    products = spark.createDataFrame([("R", "maker", "text", [("t", "d1")])], "name string, manufacturer string, description string, documents array<struct<title:string,doc_id:string>>")
    linked = link.link_products(link.link_register(found.withColumn("product", F.lit("R")).withColumns({"nx": F.lit(0.0), "ny": F.lit(-1.0), "nz": F.lit(0.0)}), register), products)
    tags = link.build_tags(linked, register)
    got = {r.id: r for r in tags.collect()}
    assert set(got) == {"asset-01", "asset-02"}
    one, two = got["asset-01"], got["asset-02"]
    assert one.registered and one.title == "T1" and one.cabinet == "C7" and one.maintenance.note == "note" and one.documents[0].doc_id == "d1"
    assert not two.registered and two.title == "Unregistered R" and two.cabinet is None and two.maintenance is None
    assert one.normal_xyz == [0.0, -1.0, 0.0] and one.detection.best_photo == "s5" and one.detection.scan_positions == 6 and one.crop is None
    for tag, (x, z) in ((one, places[0]), (two, places[1])):
        assert abs(tag.position_xyz[0] - x) < 0.05 and abs(tag.position_xyz[1] - 4) < 0.01 and abs(tag.position_xyz[2] - z) < 0.05
    record = cloud.scene(cams, points, tags.select("site_id", "id", "title"))
    io.write_records(record, f"file://{tmp_path}/scene")
    back = spark.read.json(f"file://{tmp_path}/scene").first()
    assert back.points == 72000 and len(back.sweeps) == 6 and [t.id for t in back.tags] == ["asset-01", "asset-02"]
    thin = cloud.concat_sweeps(points.filter("sweep = 0"), points.filter("sweep > 0"))
    io.write_cloud(thin, f"file://{tmp_path}/cloud")
    assert spark.read.parquet(f"file://{tmp_path}/cloud").count() == 72000
    io.write_detections(dets.select("site_id", "photo").distinct(), dets, f"file://{tmp_path}/dets")
    lines = [json.loads(r.value)["detections"] for r in spark.read.text(f"file://{tmp_path}/dets").collect()]
    assert all(len(x) == 1 for x in lines) and {p for x in lines for p in x} == {f"s{s}" for s in range(6)} and sum(len(v) for x in lines for v in x.values()) == 12


def test_truth_and_labels_are_written_and_read(spark, tmp_path):
    points, cams = room(spark)
    marks = spark.createDataFrame([(0, 1, "s2", "full", 480.0, 480.0, 560.0, 540.0, "m", "wall")], "site_id long, object_id long, photo string, kind string, x1 double, y1 double, x2 double, y2 double, model string, location string")
    objects, seen = truth.ground_truth(points, cams, marks)
    io.write_ground_truth(objects, seen, f"file://{tmp_path}/truth")
    assert spark.read.json(f"file://{tmp_path}/truth/objects").first().object_id == 1
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/truth/appearances").count() == seen.count() > 3
    labels = spark.createDataFrame([("val", "real_1", 0, 0.5, 0.5, 0.25, 0.125), ("train", "real_2", 1, 0.1, 0.2, 0.3, 0.4)], "split string, photo string, cls int, cx double, cy double, w double, h double")
    io.write_yolo_labels(labels, f"file://{tmp_path}/labels")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/labels").collect()) == ["0 0.500000 0.500000 0.250000 0.125000", "1 0.100000 0.200000 0.300000 0.400000"]
    points.select("site_id", "sweep", "idx", *(F.col(a).cast("float") for a in "xyz"), *(F.lit(9).cast("short").alias(c) for c in "rgb")).write.parquet(f"file://{tmp_path}/points")
    assert io.read_points(spark, f"file://{tmp_path}/points").filter("x > 0").count() == points.filter("CAST(x AS FLOAT) > 0").count()


def test_small_functions(spark):
    df = spark.range(1).select(F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for b in ((0, 0, 12, 12), (0, 0, 11, 50)))).alias("boxes"), F.lit("sweep07_face2.jpg").alias("photo"))
    r = df.select(F.size(bx.min_box_size(F.col("boxes"))).alias("n"), geo.sweep_of_photo(F.col("photo")).alias("s"), *bx.from_centre(*(F.lit(v) for v in (0.5, 0.5, 0.25, 0.5, 100.0, 200.0))).named()).first()
    assert (r.n, r.s) == (1, 7) and (r.x1, r.y1, r.x2, r.y2) == (37.5, 50.0, 62.5, 150.0)
    photos = spark.createDataFrame([("train", "used", "scan labels", [1, 2]), ("train", "used", "scan labels", []), ("val", "skipped", "no labels", None)], "split string, status string, reason string, boxes array<int>")
    assert sorted((r.split, r.photos, r.boxes) for r in dataset.dataset_summary(photos).collect())[0] == ("train", 2, 2)
