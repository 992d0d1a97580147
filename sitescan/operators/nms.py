"""Suppression of repeated boxes per photo: an ordered fold, so it runs over arrays of a photo's boxes, of many photos per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.sources.shared import dealt

EPS = 1e-9


def box_lists(column: pa.Array, ident: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column of box structs: where each list starts and ends, all ids, and all boxes (n x 4). Nothing is unpacked row by row."""
    flat = column.flatten()
    sizes = np.zeros(len(column), np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes[valid] = column.value_lengths().drop_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    ids = flat.field(ident).to_numpy(zero_copy_only=False)
    return ends, ids, np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")]).astype(float)


def lists_of(values: pa.Array, sizes: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def kept_order(x: np.ndarray, iou: float | None, inside: float | None) -> np.ndarray:
    """Positions kept of boxes (k x 4) in their order: overlap first, then containment among what overlap has left. Each kept box strikes out
    later ones at once."""
    area = np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)
    order = np.arange(len(x))
    for most, share in ((iou, False), (inside, True)):
        if most is None:
            continue
        open_, at = order, 0
        while at < len(open_) - 1:
            i, rest = open_[at], open_[at + 1 :]
            w = np.minimum(x[i, 2], x[rest, 2]) - np.maximum(x[i, 0], x[rest, 0])
            h = np.minimum(x[i, 3], x[rest, 3]) - np.maximum(x[i, 1], x[rest, 1])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            # without a term in the denominator; 0/0 is no overlap
            hit = both / (area[rest] + EPS) > most if share else both > most * (area[i] + area[rest] - both)
            at += 1
            if hit.any():
                open_ = np.concatenate([open_[:at], rest[~hit]])
        order = open_
    return order


#: Boxes of a photo up to which all its pairs are told at once, and pairs that are held at a time.
SMALL, PAIRS = 64, 1 << 20


def kept_boxes(x: np.ndarray, ends: np.ndarray, iou: float | None, inside: float | None) -> np.ndarray:
    """Which boxes (n x 4) are kept where list i goes from ends[i] to ends[i + 1]; as `kept_order` of each list. Photos with equally many boxes go
    together, so the steps of Python grow with the boxes of a photo, not with the photos."""
    kept, sizes = np.ones(len(x), bool), np.diff(ends)
    for k in np.unique(sizes[sizes > 1]).tolist():
        starts = ends[:-1][sizes == k]
        if k > SMALL:
            for lo in starts.tolist():
                kept[lo : lo + k] = False
                kept[lo + kept_order(x[lo : lo + k], iou, inside)] = True
            continue
        step = max(1, PAIRS // (k * k))
        for at in range(0, len(starts), step):
            places = starts[at : at + step, None] + np.arange(k)
            x1, y1, x2, y2 = np.moveaxis(x[places], 2, 0)
            area = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
            pair = lambda f, a: f(a[:, :, None], a[:, None, :])
            both = np.maximum(pair(np.minimum, x2) - pair(np.maximum, x1), 0) * np.maximum(pair(np.minimum, y2) - pair(np.maximum, y1), 0)
            open_ = np.ones(places.shape, bool)
            for most, share in ((iou, False), (inside, True)):
                if most is None:
                    continue
                hit = both / (area[:, None, :] + EPS) > most if share else both > most * (area[:, :, None] + area[:, None, :] - both)
                for i in range(k - 1):
                    open_[:, i + 1 :] &= ~(open_[:, i, None] & hit[:, i, i + 1 :])
            kept[places] = open_
    return kept


def ordered_boxes(boxes: DataFrame) -> DataFrame:
    """site_id, photo, boxes: all rows of a photo as one array, strongest first, ties by det_id; each holds its place and its whole `row`."""
    one = F.struct((-F.col("conf")).alias("o"), "det_id", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.struct(*(F.col(f"`{c}`") for c in boxes.columns)).alias("row"))
    rows = dealt(boxes.select("site_id", "photo", one.alias("one")), "site_id", "photo")
    return rows.groupBy("site_id", "photo").agg(F.array_sort(F.collect_list("one")).alias("boxes"))


def places_only(boxes: Column) -> Column:
    """What a fold needs of `ordered_boxes`."""
    return F.transform(boxes, lambda b: F.struct(*(b[c].alias(c) for c in ("det_id", "x1", "y1", "x2", "y2"))))


def suppressor(iou: float | None, inside: float | None):
    """An Arrow UDF from arrays of sorted box structs to the places kept, in order."""

    def run(boxes: pa.Array) -> pa.Array:
        ends, _, x = box_lists(boxes, "det_id")
        kept = kept_boxes(x, ends, iou, inside)
        places = np.arange(len(x)) - np.repeat(ends[:-1], np.diff(ends))
        upto = np.concatenate([[0], np.cumsum(kept)])
        return lists_of(pa.array(places[kept].astype(np.int32)), np.diff(upto[ends]))

    return F.arrow_udf(run, "array<int>")


def suppress(boxes: DataFrame, iou: float | None = 0.5, inside: float | None = 0.7) -> DataFrame:
    """Rows (site_id, photo, det_id, ...) left by overlap (> iou with a stronger kept box) and containment (> inside of a kept
    one), strongest first, ties by det_id; class-agnostic. Boxes are shuffled once, with all their columns."""
    photos = ordered_boxes(boxes)
    kept = photos.withColumn("kept", suppressor(iou, inside)(places_only(F.col("boxes"))))
    return kept.select(F.inline(F.transform("kept", lambda i: F.get("boxes", i)["row"])))


def nms(boxes: DataFrame, iou: float = 0.5) -> DataFrame:
    return suppress(boxes, iou, None)


def suppress_contained(boxes: DataFrame, inside: float = 0.7) -> DataFrame:
    return suppress(boxes, None, inside)


def sort_detections(boxes: DataFrame) -> DataFrame:
    """site_id, photo, detections: a photo's boxes as one array, strongest first."""
    one = F.struct((-F.col("conf")).alias("o"), "det_id", "x1", "y1", "x2", "y2", "conf", "cls")
    ordered = F.array_sort(F.collect_list(one))
    return boxes.groupBy("site_id", "photo").agg(F.transform(ordered, lambda b: F.struct(b.det_id.alias("det_id"), b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2"), b.conf.alias("conf"), b.cls.alias("cls"))).alias("detections"))
