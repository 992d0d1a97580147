"""Readers, writers, training sets, scan metadata and the stream."""

import json

import numpy as np
from pyspark.sql import functions as F

from sitescan.operators import dataset
from sitescan.sources import ingest, io
from sitescan.streaming import stream


def test_detections_keep_empty_photos(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"weights": "w", "classes": {"0": "A"}, "detections": {"a.jpg": [[1, 2, 3, 4, 0.5, 0], [1.23456, 2, 3, 4, 0.25, 0]], "b.jpg": []}}))
    dets, photos, classes = io.read_detections(spark, f"file://{tmp_path}/d.json")
    assert photos.count() == 2 and [r.det_id for r in dets.orderBy("det_id").collect()] == [0, 1]
    assert classes.first().product == "A"
    assert json.loads(io.detections_json(photos, dets).first().json) == {"a.jpg": [[1, 2, 3, 4, 0.5, 0], [1.235, 2, 3, 4, 0.25, 0]], "b.jpg": []}


def test_register_products_labels_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("tag_name,panel,panel_function,cabinet,x,y,z,last_inspection,next_inspection,maintenance_note\nT1,P,F,C,1.5,2,3,2024-01-02,2025-01-02,\"a, b\"\n")
    r = io.read_register(spark, f"file://{tmp_path}/r.csv").first()
    assert r.x == 1.5 and str(r.next_inspection) == "2025-01-02" and r.maintenance_note == "a, b"
    for folder, maker in (("one", "old"), ("two", "new")):
        (tmp_path / "products" / folder).mkdir(parents=True)
        (tmp_path / "products" / folder / "product.json").write_text(json.dumps({"name": "N", "manufacturer": maker, "documents": [{"doc_id": "d1", "title": "t"}]}, indent=1))
    p = io.read_products(spark, f"file://{tmp_path}/products/*/product.json").collect()
    assert len(p) == 1 and p[0].manufacturer == "new" and p[0].product_id == "two"
    (tmp_path / "labels" / "val").mkdir(parents=True)
    (tmp_path / "labels" / "val" / "real_1.txt").write_text("0 0.5 0.5 0.25 0.125\n\n")
    (tmp_path / "labels" / "val" / "synth_1.txt").write_text("0 0.5 0.5 0.25 0.125\n")
    rows = io.read_yolo_labels(spark, f"file://{tmp_path}/labels/*/*.txt").collect()
    assert [(r.split, r.photo, r.h) for r in rows] == [("val", "real_1", 0.125)]
    (tmp_path / "photo_labels.json").write_text(json.dumps({"_comment": "x", "a.jpg": [[0, 0, 1, 1]], "b.jpg": None}))
    got = {r.name: r.boxes for r in io.read_photo_labels(spark, f"file://{tmp_path}/photo_labels.json").collect()}
    assert got == {"a.jpg": [[0.0, 0.0, 1.0, 1.0]], "b.jpg": None}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "A.JPG").write_bytes(b"\xff\xd8same")
    (tmp_path / "img" / "b.png").write_bytes(b"\xff\xd8same")
    (tmp_path / "img" / "c.txt").write_bytes(b"no")
    files = dataset.dedup_photos(io.read_photo_files(spark, f"file://{tmp_path}/img"))
    assert {r.name: r.duplicate for r in files.collect()} == {"A.JPG": False, "b.png": True}


def test_poses(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"sweeps": [{"index": 0, "name": "s", "points": 5, "rotation_wxyz": [1, 0, 0, 0], "translation_xyz": [1, 2, 3]}], "images": [{"file": "sweep00_face1.jpg", "sweep": 0, "face": 1, "width": 4, "height": 4, "fx": 2.0, "fy": 2.0, "cx": 2.0, "cy": 2.0, "rotation_wxyz": [1, 0, 0, 0], "translation_xyz": [1, 2, 3]}]}))
    sweeps, images = io.read_poses(spark, f"file://{tmp_path}/p.json")
    assert sweeps.first().points == 5 and images.first().ty == 2.0


def test_split_rounds_half_to_even_and_repeats(spark):
    for n, want in ((10, 2), (30, 4), (63, 9)):
        df = spark.createDataFrame([(f"p{i:03d}",) for i in range(n)], "name string")
        a = {r.name: r.split for r in dataset.assign_split(df).collect()}
        assert sum(v == "val" for v in a.values()) == want
        assert a == {r.name: r.split for r in dataset.assign_split(df.repartition(7)).collect()}
        items = dataset.assign_sources(dataset.assign_split(df)).collect()
        assert sorted(r.k for r in items) == list(range(2 * n)) and all(a[r.name] == "train" for r in items)


def test_variations_stay_in_the_photo_and_repeat(spark):
    box = [(100.0, 100.0, 180.0, 160.0)]
    df = spark.createDataFrame([(0, k, "a", 4000, 3000, box if k % 2 else []) for k in range(20)], "site_id long, k long, name string, width int, height int, boxes array<struct<x1:double,y1:double,x2:double,y2:double>>")
    a = {r.k: r for r in dataset.plan_variations(df).collect()}
    assert a == {r.k: r for r in dataset.plan_variations(df.repartition(5)).collect()}
    for k, r in a.items():
        assert 0 <= r.x0 and r.x0 + r.side <= 4000 and 0 <= r.y0 and r.y0 + r.side <= 3000
        assert (320 <= r.side <= 3000) if k % 2 else r.boxes == []
        for b in r.boxes:
            assert 0 <= b.x1 and b.x2 <= 640 and b.x2 - b.x1 >= 10
        m = np.array(r.homography).reshape(3, 3)
        middle = m @ [r.x0 + r.side / 2, r.y0 + r.side / 2, 1]
        assert np.all(np.abs(middle[:2] / middle[2] - 320) < 0.12 * 640)


def test_transform_takes_corners_to_the_square(spark):
    rng = np.random.default_rng(2)
    quads = np.array([[0, 0], [9, 0], [9, 9], [0, 9]]) + rng.uniform(-2, 2, (30, 4, 2))
    df = spark.createDataFrame([tuple(map(float, q.ravel())) for q in quads], ", ".join(f"x{i} double, y{i} double" for i in range(4)))
    got = df.select(F.array(*dataset.to_square([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)], 640.0)).alias("h"), *df.columns).collect()
    for r in got:
        h = np.array(r.h).reshape(3, 3)
        for i, want in enumerate(((0, 0), (640, 0), (640, 640), (0, 640))):
            at = h @ [r[f"x{i}"], r[f"y{i}"], 1]
            assert h[2, 2] == 1 and np.allclose(at[:2] / at[2], want, atol=1e-6)


def test_draws_are_even_and_of_their_key(spark):
    u = [r.u for r in spark.range(4000).select(dataset.draw(3, F.lit(0), F.col("id")).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02 and abs(np.std(u) - 12**-0.5) < 0.02 and len(set(u)) == 4000


def test_pages_and_xml(spark):
    body = b"<e57Root xmlns='http://x/y'><data3D><vectorChild><guid>g</guid><name>a   b</name><points recordCount='7'/></vectorChild></data3D><images2D><vectorChild><guid>i</guid><name>pic 3</name><associatedData3DGuid>g</associatedData3DGuid><pinholeRepresentation><imageWidth>8</imageWidth><imageHeight>8</imageHeight><focalLength>2</focalLength><pixelWidth>0.5</pixelWidth><pixelHeight>0.25</pixelHeight></pinholeRepresentation></vectorChild></images2D></e57Root>" + b" " * 3000
    paged = b"".join(body[i : i + 1020] + b"CRC!" for i in range(0, len(body), 1020))
    df = spark.createDataFrame([(0, bytearray(paged), 0, len(body)), (1, None, 0, 5)], "site_id long, content binary, offset long, length long")
    got = {r.site_id: r.payload for r in ingest.page_payload(df).collect()}
    assert bytes(got[0]) == body and got[1] is None
    xml = ingest.page_payload(df).filter("payload is not null").select("site_id", F.col("payload").cast("string").alias("xml"))
    sweeps, images = ingest.ingest_scan_metadata(xml)
    s, i = sweeps.first(), images.first()
    assert (s.sweep, s.name, s.points, s.qw, s.tx) == (0, "a b", 7, 1.0, 0.0)
    assert (i.photo, i.face, i.fx, i.fy) == ("sweep00_face3.jpg", 3, 4.0, 8.0)


def test_photos_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    box = lambda x, conf: {"x1": x, "y1": 0.0, "x2": x + 80, "y2": 80.0, "conf": conf, "cls": 0, "texts": [{"text": "rel615", "conf": 0.9}]}
    (tmp_path / "in" / "1.json").write_text(json.dumps({"site_id": 0, "photo": "a", "width": 100, "height": 100, "boxes": [box(0.0, 0.5), box(5.0, 0.9), box(200.0, 0.2)]}) + "\n")
    classes = spark.createDataFrame([(0, "P")], "cls int, product string")
    products = spark.createDataFrame([("P", "M", "D", [("d1",)], ["REL"])], "name string, manufacturer string, description string, documents array<struct<doc_id:string>>, ocr_keywords array<string>")
    q = stream.stream_detections(stream.read_photo_stream(spark, f"file://{tmp_path}/in"), classes, products, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    got = {r.det_id: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert set(got) == {1, 2}
    assert got[1].keywords == ["REL"] and got[2].keywords is None and got[1].documents[0].doc_id == "d1"
