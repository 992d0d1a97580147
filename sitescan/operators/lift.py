"""From boxes in photos to positions in space: the range join of projected points with boxes, and its aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescan.functions.boxes import Box, shrink_box, widen_box
from sitescan.functions.geometry import in_frame, project_points

#: Side of the pixel tiles that serve as equi-join keys.
TILE = 64
KEY = ["site_id", "photo", "box_id"]
SIDES = ["x1", "y1", "x2", "y2"]


def box_window():
    """A box's rows together. Box ids first: rows are then told apart by the first bytes that a sort compares."""
    return W.partitionBy("box_id", "photo", "site_id")


def points_in_boxes(pixels: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows of `pixels` (site_id, photo, u, v, ...) joined with the boxes (site_id, photo, box_id, x1..y2, ...) that hold them, ends included.

    A box is listed under every tile it touches, a pixel under its one tile, so the join is an equi-join with `between` as
    residual and a crowded photo is spread over its tiles. Spark broadcasts the boxes where they are few.
    """
    c = F.col
    cells = lambda lo, hi: F.sequence(F.floor(c(lo) / tile), F.floor(c(hi) / tile))
    b = boxes.filter("x2 >= x1 and y2 >= y1").withColumn("_tu", F.explode(cells("x1", "x2"))).withColumn("_tv", F.explode(cells("y1", "y2")))
    p = pixels.withColumn("_tu", F.floor(c("u") / tile)).withColumn("_tv", F.floor(c("v") / tile))
    joined = p.join(b, ["site_id", "photo", "_tu", "_tv"])
    return joined.filter(c("u").between(c("x1"), c("x2")) & c("v").between(c("y1"), c("y2"))).drop("_tu", "_tv")


def visible_points(points: DataFrame, images: DataFrame, boxes: DataFrame) -> DataFrame:
    """In-frame projections, only in photos that have a box: the small side narrows the cameras before the points are projected.

    Points of a sweep at one place are projected as one, with their number n."""
    wanted = images.join(boxes.select("site_id", "photo").distinct(), ["site_id", "photo"], "left_semi")
    places = points.groupBy("site_id", "sweep", "x", "y", "z").agg(F.count("*").alias("n"))
    return project_points(places, wanted).filter(in_frame())


def by_shape(boxes: DataFrame, sides: list[str], find: Callable[[DataFrame], DataFrame], how: str = "inner") -> DataFrame:
    """`boxes` (KEY, `sides`, ...) with what `find` gives by KEY for boxes (KEY, `sides`, m). 'inner' gives a row for each box that has a result,
    'left' each row of `boxes`.

    Boxes of a photo whose sides are equal hold the same points, so `find` gets one of them, under the least id. Rows that share a KEY are parts of
    one box; they go to `find` under their own id, m times where m of them are equal. Results that hold `sides` are those of a part.
    """
    alike = W.partitionBy(*KEY).orderBy("box_id")
    rows = boxes.withColumns({"_nth": F.row_number().over(alike), "_parts": F.count("*").over(alike)})
    rows = rows.withColumn("_own", F.when(F.col("_parts") > 1, F.col("box_id"))).drop("_parts")
    shapes = rows.groupBy("site_id", "photo", *sides, "_own").agg(F.min("box_id").alias("box_id"), F.count("*").alias("m"))
    one = shapes.withColumn("m", F.when(F.col("_own").isNull(), 1).otherwise(F.col("m")))
    found = find(one.drop("_own"))
    found = shapes.drop("m").join(found, [*KEY, *(c for c in sides if c in found.columns)]).drop("box_id")
    names = ["site_id", "photo", *sides]
    new = [c for c in found.columns if c not in (*names, "_own")]
    rows = (rows.filter("_nth = 1") if how == "inner" else rows).drop("_nth").alias("a")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in names] + [F.col("a._own").eqNullSafe(F.col("b._own"))]
    return rows.join(found.alias("b"), on, how).select(*(f"a.{c}" for c in boxes.columns), *(f"b.{c}" for c in new))


def count_of(rows: DataFrame) -> Column:
    """How many points a row stands for: its n, times the m of a box's equal parts, as far as it has them."""
    found = [F.col(c) for c in ("n", "m") if c in rows.columns]
    return found[0] * found[1] if len(found) == 2 else found[0] if found else F.lit(1)


def box_counts(points: DataFrame, images: DataFrame, boxes: DataFrame) -> DataFrame:
    """site_id, photo, box_id, n_points, depth: how many points each box holds and how near the nearest is; boxes without points are dropped."""

    def found(shapes: DataFrame) -> DataFrame:
        got = points_in_boxes(visible_points(points, images, boxes), shapes)
        return got.groupBy(*KEY).agg(F.sum(count_of(got)).alias("n_points"), F.min("depth").alias("depth"))

    return by_shape(boxes.select(*KEY, *SIDES), SIDES, found).drop(*SIDES)


def with_quantile(rows: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """`rows` (KEY, `value`, n, ...) with `name`: the exact quantile of `value` among the points of a box, between two neighbours where it falls between
    them. A row stands for n points, without n for one.

    Rows are sorted inside their box and the one or two that the quantile takes are picked by place, so nothing is held per box. Rows are dealt
    out by box once, for all quantiles and medians of a plan. A box holds at most the points of one sweep; a task streams and, if need be, spills them.
    """
    n = count_of(rows)
    ordered = box_window().orderBy(value)
    upto, many = (F.sum(n).over(ordered.rowsBetween(W.unboundedPreceding, end)) for end in (0, W.unboundedFollowing))
    at = F.lit(share) * (F.col("_many") - 1)
    low = F.floor(at)
    pick = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - n <= k), F.col(value).cast("double"))).over(box_window())
    more = rows.withColumns({"_upto": upto, "_many": many})
    more = more.withColumns({"_low": pick(low), "_high": pick(F.ceil(at))})
    between = F.when((low == at) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise((F.ceil(at) - at) * F.col("_low") + (at - low) * F.col("_high"))
    return more.withColumn(name, between).drop("_upto", "_many", "_low", "_high")


def medians(rows: DataFrame, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """KEY, n_points and the exact median of each of `values` per box, in the same manner: the mean of the middle point or two."""
    n = count_of(rows)
    for a in values:
        rows = rows.withColumn("_" + a, F.sum(n).over(box_window().orderBy(a).rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n_points", F.sum(n).over(box_window()))
    places = F.floor((F.col("n_points") + 1) / 2), F.floor(F.col("n_points") / 2) + 1
    at = lambda a, k: F.max(F.when((F.col("_" + a) >= k) & (F.col("_" + a) - n < k), F.col(a).cast("double")))
    return rows.groupBy(*KEY).agg(F.first("n_points").alias("n_points"), *(((at(a, places[0]) + at(a, places[1])) / 2).alias(a) for a in values))


def _front_median(rows: DataFrame, limit: str) -> DataFrame:
    return medians(rows.filter(F.col("depth") <= F.col(limit) + 0.05))


def lift_boxes(points: DataFrame, images: DataFrame, boxes: DataFrame, margin: float = 0.25, least: int = 5, widen: float = 4.0) -> DataFrame:
    """site_id, photo, box_id, n_points, x, y, z: the per-axis median of the front surface in each box.

    The box shrunk by `margin` counts if it holds `least` points, else the box widened by `widen` pixels; boxes without points
    are dropped. Points in the shrunk boxes are counted first, so that only those of the box that counts are dealt out and sorted.
    """
    inner, outer = shrink_box(Box.of(), margin), widen_box(Box.of(), widen)

    def found(shapes: DataFrame) -> DataFrame:
        pixels = visible_points(points, images, boxes)
        held = points_in_boxes(pixels, shapes.select(*KEY, "m", *inner.named()))
        enough = held.groupBy(*KEY).agg(F.sum(count_of(held)).alias("_held")).filter(F.col("_held") >= least)
        told = shapes.join(enough, KEY, "left")
        sides = [F.when(F.col("_held").isNotNull(), i).otherwise(o).alias(s) for s, i, o in zip(SIDES, inner, outer, strict=True)]
        got = points_in_boxes(pixels, told.select(*KEY, "m", *sides))
        got = got.select(*KEY, "x", "y", "z", "depth", count_of(got).alias("n"))
        return _front_median(with_quantile(got, "depth", 0.25, "front"), "front")

    return by_shape(boxes.select(*KEY, *SIDES), SIDES, found).drop(*SIDES)


def _squares(pixels: DataFrame) -> DataFrame:
    u, v, r = F.col("u"), F.col("v"), F.col("_r")
    return pixels.select(*KEY, "m", (u - r).alias("x1"), (v - r).alias("y1"), (u + r).alias("x2"), (v + r).alias("y2"))


def _around(points: DataFrame, images: DataFrame, pixels: DataFrame, radius: Column, find: Callable[[DataFrame], DataFrame], *values: str) -> DataFrame:
    """The rows of `pixels` with what `find` gives for the points (KEY, `values`, n) in the squares around equal ones."""

    def found(shapes: DataFrame) -> DataFrame:
        got = points_in_boxes(visible_points(points, images, pixels), _squares(shapes))
        return find(got.select(*KEY, *values, count_of(got).alias("n")))

    return by_shape(pixels.withColumn("_r", radius), ["u", "v", "_r"], found, "left").drop("_r")


def pixels_to_world(points: DataFrame, images: DataFrame, pixels: DataFrame, radius: float = 12.0) -> DataFrame:
    """The rows of `pixels` (site_id, photo, box_id, u, v) with the front surface's median around each; null where no point is."""
    return _around(points, images, pixels, F.lit(radius), lambda got: _front_median(with_quantile(got, "depth", 0.25, "front"), "front"), "x", "y", "z", "depth")


def depth_at(points: DataFrame, images: DataFrame, pixels: DataFrame, radius: Column | float = 12.0) -> DataFrame:
    """The rows of `pixels` with depth_at: the first quartile of depth in the square around each; null where no point is."""
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    return _around(points, images, pixels, radius, lambda got: with_quantile(got, "depth", 0.25, "q").groupBy(*KEY).agg(F.first("q").alias("depth_at")), "depth")
