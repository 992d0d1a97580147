"""Photos that arrive one by one: each row is a photo with its raw boxes, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescan.functions.boxes import fit_scale
from sitescan.functions.text import keyword_check
from sitescan.operators.link import link_products
from sitescan.operators.nms import places_only, suppressor

BOX = "struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:int,texts:array<struct<text:string,conf:double>>>"
PHOTOS = f"site_id long, photo string, width int, height int, boxes array<{BOX}>"


def read_photo_stream(spark: SparkSession, path: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PHOTOS).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def detect_photos(photos: DataFrame, classes: DataFrame, products: DataFrame, iou: float = 0.5, inside: float = 0.7) -> DataFrame:
    """Per kept box, strongest first: site_id, photo, det_id, box in whole pixels of the full photo, conf, product and its documents, and
    the product keywords read on the plate (null: not checked). Works on streams and on tables alike."""
    shrink = fit_scale(F.col("width"), F.col("height"))
    numbered = F.transform("boxes", lambda b, i: F.struct((-b.conf).alias("o"), i.cast("long").alias("det_id"), *(b[c].alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls", "texts"))))
    rows = photos.withColumn("sorted", F.array_sort(numbered)).withColumn("shrink", shrink)
    rows = rows.withColumn("kept", suppressor(iou, inside)(places_only(F.col("sorted"))))
    rows = rows.withColumn("b", F.explode(F.transform("kept", lambda i: F.get("sorted", i))))
    rows = rows.select("site_id", "photo", F.col("b.det_id").alias("det_id"), *(F.bround(F.col("b." + c) / F.col("shrink"), 0).alias(c) for c in ("x1", "y1", "x2", "y2")), F.round("b.conf", 3).alias("conf"), F.col("b.cls").alias("cls"), F.col("b.texts").alias("texts"))
    rows = rows.join(classes.select("cls", "product"), "cls", "left")
    linked = link_products(rows, products)
    words = products.select(F.col("name").alias("product"), F.col("ocr_keywords").alias("_k"))
    linked = linked.join(words, "product", "left")
    short = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    read = keyword_check(F.col("texts"), F.coalesce("_k", F.array().cast("array<string>")), F.col("conf"), short)
    return linked.withColumn("keywords", read).drop("_k", "texts")


def stream_detections(photos: DataFrame, classes: DataFrame, products: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Start writing the detections of a stream of photos, in append mode, and return the running query."""
    out = detect_photos(photos, classes, products)
    return out.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
