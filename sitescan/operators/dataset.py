"""Labelled training sets: duplicates, labels and their precedence, split, and planned variations of photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescan.functions.geometry import settled

BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def dedup_photos(files: DataFrame, key: str = "md5", name: str = "name") -> DataFrame:
    """`files` with duplicate: another file of a smaller name has the same bytes. Only hash and name are shuffled, as a minimum per hash."""
    first = files.groupBy(key).agg(F.min(name).alias("_first"))
    return files.join(first, key).withColumn("duplicate", F.col(name) != F.col("_first")).drop("_first")


def label_photos(files: DataFrame, scan_labels: DataFrame, web_labels: DataFrame) -> DataFrame:
    """`files` (name, duplicate, readable) with status, reason and boxes.

    In this order: a duplicate is skipped, so is an unreadable file; labels of the scan count; a scan photo without labels is an
    empty example; labels from the web count if there are any; a photo listed with null was left out on purpose, the
    others have no labels. Both label tables have (name, boxes).
    """
    s = scan_labels.select("name", F.col("boxes").alias("_s"), F.lit(True).alias("_in_s"))
    w = web_labels.select("name", F.col("boxes").alias("_w"), F.lit(True).alias("_in_w"))
    rows = files.join(s, "name", "left").join(w, "name", "left")
    none = F.array().cast(BOXES)
    scan = F.col("name").startswith("sweep")
    some = F.coalesce(F.size("_w"), F.lit(0)) > 0
    case = F.when(F.col("duplicate"), F.struct(F.lit("skipped").alias("status"), F.lit("duplicate").alias("reason"), none.alias("boxes")))
    for when, status, reason, boxes in (
        (~F.col("readable"), "skipped", "unreadable", none),
        (F.col("_in_s").isNotNull(), "used", "scan labels", F.coalesce("_s", none)),
        (scan, "used", "empty example", none),
        (some, "used", "web labels", F.col("_w")),
        (F.col("_in_w").isNotNull() & F.col("_w").isNull(), "skipped", "left out on purpose", none),
    ):
        case = case.when(when, F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"), boxes.alias("boxes")))
    case = case.otherwise(F.struct(F.lit("skipped").alias("status"), F.lit("no labels").alias("reason"), none.alias("boxes")))
    return rows.withColumn("_c", case).select(*files.columns, "_c.status", "_c.reason", "_c.boxes")


def assign_split(photos: DataFrame, val: float = 0.15, seed: int = 0, name: str = "name") -> DataFrame:
    """`photos` with split: exactly n * val of them, rounded half to even, are 'val', chosen by a hash of seed and name.

    The hash cuts the photos into ranges; only the range in which the quota ends is ranked, so no task orders all of them.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name)))
    rows = photos.withColumn("_h", h).withColumn("_r", F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_n"))
    # at most 4096 ranges
    sizes = sizes.select("_r", (F.sum("_n").over(W.orderBy("_r")) - F.col("_n")).alias("_before"), F.bround(F.sum("_n").over(W.partitionBy()) * val, 0).alias("_quota"))
    rows = rows.join(F.broadcast(sizes), "_r")
    rank = F.row_number().over(W.partitionBy("_r").orderBy("_h", name))
    return rows.withColumn("split", F.when(F.col("_before") + rank <= F.col("_quota"), "val").otherwise("train")).drop("_h", "_r", "_before", "_quota")


def assign_sources(photos: DataFrame, factor: float = 2.0, name: str = "name") -> DataFrame:
    """k, name: for each of round(n * factor) synthetic items its train photo, the k-th in turn by name; n counts all photos."""
    n = photos.agg(F.bround(F.count("*") * factor, 0).cast("long").alias("items"), F.count_if(F.col("split") == "train").alias("t"))
    # names are short and few against points and boxes; ranked within ranges of their hash, then moved by the range's start
    train = photos.filter("split = 'train'").select(name, F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int").alias("_r"))
    sizes = train.groupBy("_r").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_r", (F.sum("_n").over(W.orderBy("_r")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_r").orderBy(name)) - 1
    rows = train.join(F.broadcast(sizes), "_r").withColumn("i", F.col("_before") + rank).crossJoin(F.broadcast(n))
    rows = rows.filter(F.col("i") < F.col("items"))
    return rows.select(F.explode(F.expr("sequence(i, items - 1, t)")).alias("k"), name)


def draw(number: int, *key: Column) -> Column:
    """A number of [0, 1) that depends on `key` and `number` only: the first 48 bits of an MD5, so any task, order or engine draws the same."""
    text = F.concat_ws("|", *(k.cast("string") for k in key), F.lit(str(number)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def to_square(quad: list[tuple[Column, Column]], side: float) -> list[Column]:
    """h00 ... h22 of the perspective transform that takes four corners to those of a square of `side` (from its origin, along x first), h22 being 1:
    the transform from the unit square to the corners has a closed form, and its adjugate leads back."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    den = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, den), F.try_divide(dx1 * sy - sx * dy1, den)
    a, b, d, e = x1 - x0 + g * x1, x3 - x0 + h * x3, y1 - y0 + g * y1, y3 - y0 + h * y3
    last = a * e - b * d
    back = [(e - y0 * h, x0 * h - b, b * y0 - x0 * e), (y0 * g - d, a - x0 * g, x0 * d - a * y0), (d * h - e * g, b * g - a * h, last)]
    return [F.try_divide(v * (side if i < 2 else 1.0), last) for i, row in enumerate(back) for v in row]


def warped(boxes: Column, h: list[Column], side: float, least: float = 10.0, share: float = 0.4) -> Column:
    """An array of boxes through one transform: the box around the four corners, clipped to the square; small and much cut ones are dropped."""
    to = lambda x, y: [F.try_divide(h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2], h[6] * x + h[7] * y + h[8]) for i in (0, 1)]
    corners = F.transform(boxes, lambda b: F.array(*(F.struct(*(v.alias(n) for v, n in zip(to(b[x], b[y]), "uv", strict=True))) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")))))
    span = lambda c, f: (f(F.transform(c, lambda p: p["u"])), f(F.transform(c, lambda p: p["v"])))
    spans = F.transform(corners, lambda c: F.struct(*(v.alias(n) for v, n in zip((*span(c, F.array_min), *span(c, F.array_max)), ("lou", "lov", "hiu", "hiv"), strict=True))))
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(side))
    cut = F.transform(spans, lambda s: F.struct(clip(s["lou"]).alias("x1"), clip(s["lov"]).alias("y1"), clip(s["hiu"]).alias("x2"), clip(s["hiv"]).alias("y2"), ((s["hiu"] - s["lou"]) * (s["hiv"] - s["lov"])).alias("full")))
    sides = lambda b: (b["x2"] - b["x1"], b["y2"] - b["y1"])
    stays = F.filter(cut, lambda b: (sides(b)[0] >= least) & (sides(b)[1] >= least) & (sides(b)[0] * sides(b)[1] >= share * b["full"]))
    return F.transform(stays, lambda b: F.struct(*(b[c].alias(c) for c in ("x1", "y1", "x2", "y2"))))


def plan_variations(items: DataFrame, seed: int = 0, jitter: float = 0.06, out_side: float = 640.0) -> DataFrame:
    """For each item (site_id, k, name, width, height, boxes) a window (side, x0, y0), a perspective transform and the boxes it leaves.

    All draws are hashes of (seed, site_id, k), so a repeated task plans the same. A photo with boxes gets a window of 2.5
    to 8 times a drawn box's longer side, within [320, shorter side of the photo], that holds the box as far as the photo lets it; one without
    a window of 0.3 to 1 times the shorter side, anywhere. Its four corners move by up to `jitter` of the side. Columns only.
    """
    c = F.col
    u = lambda i: draw(i, F.lit(seed), c("site_id"), c("k"))
    lowest = lambda *v: F.least(*v)
    some = F.coalesce(F.size("boxes"), F.lit(0)) > 0
    rows = items.select("site_id", "k", "name", *(c(n).cast("double").alias(n) for n in ("width", "height")), F.coalesce("boxes", F.array().cast(BOXES)).alias("boxes"))
    rows = settled(rows, b=F.when(some, F.get("boxes", F.floor(u(0) * F.size("boxes")).cast("int"))), short=lowest(c("width"), c("height")))
    longer = F.greatest(c("b.x2") - c("b.x1"), c("b.y2") - c("b.y1"))
    near = lowest(F.greatest(longer * (2.5 + 5.5 * u(1)), F.lit(320.0)), c("short"))
    rows = settled(rows, side=F.when(c("b").isNotNull(), near).otherwise(c("short") * (0.3 + 0.7 * u(1))))
    half = c("side") / 2

    def centre(lo: str, hi: str, size: str, draw_: Column) -> Column:
        first, last = F.greatest(c(hi) - half, half), lowest(c(lo) + half, c(size) - half)
        held = F.when(c(size) > c("side"), first + (last - first) * draw_).otherwise(c(size) / 2)
        free = half + (c(size) - c("side")) * draw_
        return F.when(c("b").isNotNull(), lowest(F.greatest(held, half), c(size) - half)).otherwise(free)

    rows = settled(rows, x0=centre("b.x1", "b.x2", "width", u(2)) - half, y0=centre("b.y1", "b.y2", "height", u(3)) - half)
    quad = {}
    for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
        for a, at, d, n in (("x", "x0", dx, 4 + 2 * i), ("y", "y0", dy, 5 + 2 * i)):
            quad[f"q{a}{i}"] = c(at) + (float(d) + jitter * (2 * u(n) - 1)) * c("side")
    rows = settled(rows, **quad)
    rows = settled(rows, homography=F.array(*to_square([(c(f"qx{i}"), c(f"qy{i}")) for i in range(4)], out_side)))
    left = warped(c("boxes"), [c("homography")[i] for i in range(9)], out_side)
    return rows.select("site_id", "k", "name", "side", "x0", "y0", "homography", left.alias("boxes"))


def warp_boxes(boxes: DataFrame, side: float = 640.0, least: float = 10.0, share: float = 0.4) -> DataFrame:
    """Boxes (x1..y2, h00..h22 on the row) through their transforms: bounding box of the four corners, clipped; too small or too much
    cut ones are dropped. Column arithmetic only."""
    c = F.col

    def through(x: Column, y: Column) -> tuple[Column, Column]:
        w = c("h20") * x + c("h21") * y + c("h22")
        return F.try_divide(c("h00") * x + c("h01") * y + c("h02"), w), F.try_divide(c("h10") * x + c("h11") * y + c("h12"), w)

    corners = [through(c(x), c(y)) for x in ("x1", "x2") for y in ("y1", "y2")]
    given, boxes = boxes, settled(boxes, **{f"_p{k}{i}": v for k, q in enumerate(corners) for i, v in enumerate(q)})
    p = [(c(f"_p{k}0"), c(f"_p{k}1")) for k in range(4)]
    lo = [F.least(*(q[i] for q in p)) for i in (0, 1)]
    hi = [F.greatest(*(q[i] for q in p)) for i in (0, 1)]
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(side))
    rows = boxes.withColumns({"_full": (hi[0] - lo[0]) * (hi[1] - lo[1]), "_x1": clip(lo[0]), "_y1": clip(lo[1]), "_x2": clip(hi[0]), "_y2": clip(hi[1])})
    w, h = c("_x2") - c("_x1"), c("_y2") - c("_y1")
    rows = rows.filter((w >= least) & (h >= least) & (w * h >= share * c("_full")))
    keep = [n for n in given.columns if n not in ("x1", "y1", "x2", "y2")]
    return rows.select(*keep, *(c("_" + n).alias(n) for n in ("x1", "y1", "x2", "y2")))


def dataset_summary(photos: DataFrame) -> DataFrame:
    """split, status, reason, photos, boxes."""
    return photos.groupBy("split", "status", "reason").agg(F.count("*").alias("photos"), F.sum(F.size("boxes")).alias("boxes"))
