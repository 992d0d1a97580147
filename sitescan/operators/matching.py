"""Detections against ground truth: one loose way (a box finds an appearance) and one exclusive way (one box, one object)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.functions.boxes import Box, box_iou
from sitescan.sources.shared import dealt

from .nms import box_lists, lists_of, ordered_boxes, places_only


def _overlaps(dets: DataFrame, truth: DataFrame, least: float, strict: bool) -> DataFrame:
    """Each detection with the truth boxes of its photo that it overlaps: an equi-join on the photo with the overlap as residual."""
    t = truth.select("site_id", "photo", "truth_id", "object_id", *Box.of().named("tx1", "ty1", "tx2", "ty2"))
    iou = box_iou(Box.of(), Box.of("t"))
    joined = dets.join(t, ["site_id", "photo"]).withColumn("iou", iou)
    return joined.filter(F.col("iou") > least if strict else F.col("iou") >= least)


def match_loose(dets: DataFrame, truth: DataFrame, loose: DataFrame | None = None, least: float = 0.3, loose_least: float = 0.1) -> DataFrame:
    """Every detection with truth_id, object_id and iou of the best truth box of its photo (the first of equals) if that reaches
    `least`, and false_alarm: it finds nothing, nor touches a loose projection. It does not depend on a threshold, so matching
    runs once for all thresholds."""
    keys = ["site_id", "photo", "det_id"]
    best = _overlaps(dets, truth, least, False).groupBy(*keys).agg(F.max_by(F.struct("truth_id", "object_id", "iou"), F.struct("iou", -F.col("truth_id"))).alias("best"))
    out = dets.join(best, keys, "left").select(dets["*"], "best.truth_id", "best.object_id", "best.iou")
    if loose is None:
        return out.withColumn("false_alarm", F.col("truth_id").isNull())
    near = _overlaps(dets, loose, loose_least, True).select(*keys).distinct().withColumn("near", F.lit(True))
    return out.join(near, keys, "left").withColumn("false_alarm", F.col("truth_id").isNull() & F.col("near").isNull()).drop("near")


def exclusive(dets: np.ndarray, truth: np.ndarray, least: float) -> list[int]:
    """For boxes in order, the index of the truth box each takes, or -1. Of equal overlaps the highest index is taken."""
    area = lambda b: np.maximum(b[..., 2] - b[..., 0], 0) * np.maximum(b[..., 3] - b[..., 1], 0)
    at, many = 0, len(truth)
    out: list[int] = []
    taken = np.zeros(many, bool)
    while at < len(dets) and not taken.all():
        d = dets[at : at + max(1, (1 << 20) // many), None]
        w = np.maximum(np.minimum(d[..., 2], truth[:, 2]) - np.maximum(d[..., 0], truth[:, 0]), 0)
        h = np.maximum(np.minimum(d[..., 3], truth[:, 3]) - np.maximum(d[..., 1], truth[:, 1]), 0)
        iou = w * h / (area(d) + area(truth) - w * h + 1e-9)
        for row in iou:
            row[taken] = -1.0
            best = many - 1 - int(np.argmax(row[::-1]))
            if row[best] < least or taken[best]:
                best = -1
            else:
                taken[best] = True
            out.append(best)
        at += len(iou)
    return out + [-1] * (len(dets) - len(out))


def match_exclusive(dets: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Every detection with the truth_id it takes (null: none) and correct: strongest first, each takes the best box that no
    stronger one has taken. All detections take part; confidence is cut afterwards. Both sides are shuffled once, by photo."""
    box = F.struct("truth_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    t = dealt(truth.select("site_id", "photo", box.alias("t")), "site_id", "photo").groupBy("site_id", "photo").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def run(ds: pa.Array, ts: pa.Array) -> pa.Array:
        ends, ids, x = box_lists(ds, "det_id")
        truth_ends, truth_ids, y = box_lists(ts, "truth_id")
        took = np.full(len(ids), -1, np.int64)
        for i in range(len(ends) - 1):
            lo, hi, first, last = ends[i], ends[i + 1], truth_ends[i], truth_ends[i + 1]
            if last > first:
                got = np.array(exclusive(x[lo:hi], y[first:last], least), np.int64)
                took[lo:hi] = np.where(got >= 0, got + first, -1)
        free = took < 0
        found = truth_ids[np.where(free, 0, took)] if len(truth_ids) else np.zeros(len(ids), np.int64)
        return lists_of(pa.array(found, pa.int64(), mask=free), np.diff(ends))

    taken = F.arrow_udf(run, "array<long>")
    rows = ordered_boxes(dets).join(t, ["site_id", "photo"], "left").withColumn("took", taken(places_only(F.col("boxes")), F.col("t")))
    out = rows.select(F.posexplode("boxes").alias("n", "b"), "took").select("b.row.*", F.get("took", F.col("n")).alias("truth_id"))
    return out.withColumn("correct", F.col("truth_id").isNotNull())


def found(matched: DataFrame) -> DataFrame:
    """Truth appearances that some detection found."""
    return matched.filter("truth_id is not null").select("site_id", "photo", "truth_id").distinct()


def missed(truth: DataFrame, matched: DataFrame) -> DataFrame:
    return truth.join(found(matched), ["site_id", "photo", "truth_id"], "left_anti")


def photos_of_interest(truth: DataFrame, matched: DataFrame) -> DataFrame:
    """Photos that show an object or have a false alarm."""
    keys = ["site_id", "photo"]
    return truth.select(*keys).union(matched.filter("false_alarm").select(*keys)).distinct()
