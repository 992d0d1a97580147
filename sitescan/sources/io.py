"""Tables of a site from files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTS = "site_id long, sweep int, idx long, x float, y float, z float, r short, g short, b short"
IMAGES = "site_id long, photo string, sweep int, face int, width int, height int, fx double, fy double, cx double, cy double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
REGISTER = "tag_name string, panel string, panel_function string, cabinet string, x double, y double, z double, last_inspection date, next_inspection date, maintenance_note string"
PRODUCT = "name string, manufacturer string, series string, description string, ocr_keywords array<string>, documents array<struct<title:string,type:string,doc_id:string,url:string,embed_url:string>>"
POSES = (
    "site_id long, sweeps array<struct<index:int,name:string,points:long,rotation_wxyz:array<double>,translation_xyz:array<double>>>, "
    "images array<struct<file:string,sweep:int,face:int,width:int,height:int,fx:double,fy:double,cx:double,cy:double,rotation_wxyz:array<double>,translation_xyz:array<double>>>"
)
DETECTIONS = "site_id long, weights string, classes map<string,string>, detections map<string,array<array<double>>>"
#: First bytes of the file kinds that are read, and the endings of picture names.
SIGNATURES = {"scan": b"ASTM-E57", "jpeg": b"\xff\xd8", "pdf": b"%PDF-"}
PICTURES = ("jpg", "jpeg", "png", "webp", "bmp")


def read_points(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Points in world space; filters on them reach the scan."""
    return spark.read.schema(POINTS).format(kind).option("header", True).load(path)


def read_poses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sweeps, images) of pose files, one JSON document each."""
    doc = spark.read.schema(POSES).option("multiLine", True).json(path)
    site = F.coalesce("site_id", F.lit(0).cast("long")).alias("site_id")
    sweeps = doc.select(site, F.inline("sweeps")).withColumnRenamed("index", "sweep")
    rows = doc.select(site, F.inline("images"))
    q, t = F.col("rotation_wxyz"), F.col("translation_xyz")
    flat = [*(q[i].alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))), *(t[i].alias(n) for i, n in enumerate(("tx", "ty", "tz")))]
    return sweeps, rows.select("site_id", F.col("file").alias("photo"), "sweep", "face", "width", "height", "fx", "fy", "cx", "cy", *flat)


def detections_of(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(detections, photos, classes) of parsed detection documents. det_id is a box's place in its photo's list; photos without
    boxes are in `photos` only."""
    site = F.coalesce("site_id", F.lit(0).cast("long")).alias("site_id")
    photos = doc.select(site, F.explode("detections").alias("photo", "rows"))
    rows = photos.select("site_id", "photo", F.posexplode("rows").alias("det_id", "b"))
    box = [F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "conf"))]
    dets = rows.select("site_id", "photo", F.col("det_id").cast("long").alias("det_id"), *box, F.col("b")[5].cast("int").alias("cls"))
    classes = doc.select(site, F.explode("classes").alias("cls", "product")).select("site_id", F.col("cls").cast("int").alias("cls"), "product").distinct()
    return dets, photos.select("site_id", "photo"), classes


def read_detections(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one document per file or, with `lines`, one per line (as `write_detections` writes them); documents of a site are put together."""
    return detections_of(spark.read.schema(DETECTIONS).option("multiLine", not lines).json(path))


def _rounded_lists(photos: DataFrame, dets: DataFrame) -> DataFrame:
    """site_id, photo, rows: a photo's boxes as [x1, y1, x2, y2, conf, cls] of three digits; photos without boxes keep an empty list."""
    row = F.array(*(F.round(c, 3) for c in ("x1", "y1", "x2", "y2", "conf")), F.col("cls").cast("double"))
    lists = dets.groupBy("site_id", "photo").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_id", row.alias("row")))), lambda r: r.row).alias("rows"))
    full = photos.select("site_id", "photo").join(lists, ["site_id", "photo"], "left")
    return full.withColumn("rows", F.coalesce("rows", F.array().cast("array<array<double>>")))


def detections_json(photos: DataFrame, dets: DataFrame) -> DataFrame:
    """site_id, json: photo -> list of boxes, one document per site, for tools that want it whole; a large site is written by `write_detections`."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("photo", "rows"))))
    return _rounded_lists(photos, dets).groupBy("site_id").agg(F.to_json(entries).alias("json"))


def write_detections(photos: DataFrame, dets: DataFrame, path: str, classes: DataFrame | None = None, weights: str | None = None) -> None:
    """JSON lines of one document per photo (site_id, weights, classes, detections), so that no site is ever one row. `classes` (cls, product) are
    few; each site has them once, in a document without photos, as readers put a site's documents together."""
    lists = _rounded_lists(photos, dets)
    docs = lists.select("site_id", F.lit(weights).cast("string").alias("weights"), F.create_map("photo", "rows").alias("detections"))
    if classes is not None:
        named = lists.select("site_id").distinct().crossJoin(F.broadcast(classes.agg(F.map_from_entries(F.collect_list(F.struct(F.col("cls").cast("string"), "product"))).alias("classes"))))
        docs = docs.unionByName(named.withColumn("weights", F.lit(weights).cast("string")), allowMissingColumns=True)
    docs.write.mode("overwrite").json(path)


def write_sorted(rows: DataFrame, path: str, *by: str) -> None:
    """`rows` as Parquet files in one total order: ranges of `by` are sorted apart and the files' names give the order of the ranges."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def read_sorted(spark: SparkSession, path: str, rank: str = "rank") -> DataFrame:
    """Rows of `write_sorted` with their place in the order, from 1: rows before their file, and their number in it. Only a count per file goes to
    all tasks."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(W.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_file").withColumn(rank, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def store_points(points: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """A table of points bucketed by (site_id, sweep) and sorted in each bucket: joins with cameras and other tables bucketed alike need no shuffle,
    and as rows of a sweep lie together, the bounds kept per row group let a scan of some sweeps skip the others."""
    points.write.mode("overwrite").bucketBy(buckets, "site_id", "sweep").sortBy("site_id", "sweep", "idx").option("path", path).saveAsTable(name)


def store_images(images: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Cameras bucketed like the points of their sweep."""
    images.write.mode("overwrite").bucketBy(buckets, "site_id", "sweep").sortBy("site_id", "sweep").option("path", path).saveAsTable(name)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Register entries with entry_id, a hash of name and position, and entry_order, which sorts as the lines of the files do."""
    rows = spark.read.schema(REGISTER).option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", F.md5(F.concat_ws("|", "tag_name", F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string"))).alias("entry_id"), place.alias("entry_order"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per product folder; product_id is the folder's name, and of equal names the later file wins."""
    rows = spark.read.schema(PRODUCT).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
    rows = rows.withColumn("product_id", F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1))
    last = rows.groupBy("name").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("name", "_file"))), "_file").alias("p"))
    return last.select("name", "p.*")


def labels_of_lines(lines: DataFrame) -> DataFrame:
    """split, photo, cls, cx, cy, w, h of rows (path, value): label lines 'cls cx cy w h'; blank lines are nothing."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value") != "")
    return rows.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)\.[^/.]+$", 1).alias("photo"), p[0].cast("int").alias("cls"), *(p[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def read_yolo_labels(spark: SparkSession, path: str, only_real: bool = True) -> DataFrame:
    rows = labels_of_lines(spark.read.text(path).withColumn("path", F.col("_metadata.file_path")))
    return rows.filter(F.col("photo").startswith("real_")) if only_real else rows


def yolo_line(cls: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, cx, cy, w, h)


def write_yolo_labels(labels: DataFrame, path: str) -> None:
    """Lines under split=.../photo=..., one file per photo and task that holds it."""
    lines = labels.select("split", "photo", yolo_line(*(F.col(c) for c in ("cls", "cx", "cy", "w", "h"))).alias("value"))
    lines.repartition("split", "photo").write.mode("overwrite").partitionBy("split", "photo").text(path)


def photo_labels_of(doc: DataFrame, json: str = "value") -> DataFrame:
    """name, boxes (array<array<double>> in fractions; null: left out on purpose) of label documents; '_comment' is no photo."""
    entries = doc.select(F.explode(F.from_json(json, "map<string,string>")).alias("name", "raw")).filter("name <> '_comment'")
    return entries.select("name", F.from_json("raw", "array<array<double>>").alias("boxes"))


def read_photo_labels(spark: SparkSession, path: str) -> DataFrame:
    return photo_labels_of(spark.read.option("wholetext", True).text(path))


def read_photo_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length, md5, readable of picture files. The hash is made where the bytes are read; they go no further."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.filter(F.lower("path").rlike(rf"\.({'|'.join(PICTURES)})$"))
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.md5("content").alias("md5"), (F.length("content") > 0).alias("readable"))


def check_signature(content: Column, kind: str) -> Column:
    """Whether bytes begin as files of this kind do."""
    want = SIGNATURES[kind]
    return F.coalesce(F.substring(content, 1, len(want)) == F.lit(want), F.lit(False))


def write_ground_truth(objects: DataFrame, appearances: DataFrame, path: str) -> None:
    objects.write.mode("overwrite").json(f"{path}/objects")
    appearances.write.mode("overwrite").option("header", True).csv(f"{path}/appearances")


def write_records(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Nested records (assets, tags, scenes) as JSON lines or Parquet."""
    rows.write.mode("overwrite").format(kind).save(path)


def write_cloud(cloud: DataFrame, path: str) -> None:
    cloud.write.mode("overwrite").partitionBy("site_id").parquet(path)
