"""Planes through groups of points: moments by Spark, then the 3x3 eigenproblem of each group in closed form, as columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescan.functions.boxes import Box, shrink_box
from sitescan.functions.geometry import cross, dot, ray_plane, settled, sub, vector, with_rotation

from .lift import KEY, SIDES, box_window, by_shape, count_of, points_in_boxes, visible_points, with_quantile

#: A box's keys in the order of `box_window`, so that rows sorted for one need no other sort.
BOX = KEY[::-1]

#: Squared length of a cross product, against the fourth power of the matrix's spread, up to which no direction is told from the others.
FLAT = 1e-12


def with_normal(moments: DataFrame) -> DataFrame:
    """`moments` (xx, yy, zz, xy, xz, yz, ...) with nx, ny, nz: the unit eigenvector of the smallest eigenvalue of the symmetric matrix, its largest
    component positive; null where the two smaller eigenvalues are equal to rounding, as for points on a line.

    The eigenvalue is the least root of the characteristic cubic by its cosine form, which is exact to rounding wherever that root stands
    apart; the vector is the longest of the cross products of two rows of the matrix less the eigenvalue.
    """
    c = F.col
    q = (c("xx") + c("yy") + c("zz")) / 3
    rows = settled(moments, _q=q)
    d = [c(a) - c("_q") for a in ("xx", "yy", "zz")]
    xy, xz, yz = c("xy"), c("xz"), c("yz")
    spread = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + 2 * (xy * xy + xz * xz + yz * yz)) / 6
    det = d[0] * (d[1] * d[2] - yz * yz) - xy * (xy * d[2] - yz * xz) + xz * (xy * yz - d[1] * xz)
    rows = settled(rows, _p2=spread, _det=det)
    cosine = F.try_divide(c("_det"), 2 * c("_p2") * F.sqrt("_p2"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / 3 + 2 * pi / 3
    rows = settled(rows, _least=c("_q") + 2 * F.sqrt("_p2") * F.cos(angle))
    r = ((c("xx") - c("_least"), xy, xz), (xy, c("yy") - c("_least"), yz), (xz, yz, c("zz") - c("_least")))
    pairs = [cross(r[0], r[1]), cross(r[0], r[2]), cross(r[1], r[2])]
    sides = [F.struct(dot(v, v).alias("d"), *(x.alias(n) for x, n in zip(v, "abc", strict=True))) for v in pairs]
    rows = settled(rows, _v=F.array_max(F.array(*sides)))
    v = [c("_v")[n] for n in "abc"]
    most = F.greatest(*map(F.abs, v))
    sign = F.when(F.abs(v[0]) == most, F.signum(v[0])).when(F.abs(v[1]) == most, F.signum(v[1])).otherwise(F.signum(v[2]))
    told = c("_v")["d"] > FLAT * c("_p2") * c("_p2")
    length = F.when(told, sign / F.sqrt(c("_v")["d"]))
    return rows.select(*moments.columns, *((x * length).alias("n" + a) for x, a in zip(v, "xyz", strict=True)))


def fit_planes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, px, py, pz (centroid), nx, ny, nz (unit normal, of either sign; null where the points tell none). Covariances are centred, so millimetres
    count at ten metres. A row stands for n points, without n for one."""
    d = {a: F.col(a).cast("double") for a in "xyz"}
    pairs = ("xx", "yy", "zz", "xy", "xz", "yz")
    if "n" not in points.columns:
        moments = points.groupBy(*keys).agg(
            F.count("*").alias("n"),
            *(F.avg(d[a]).alias(f"p{a}") for a in "xyz"),
            *(F.covar_pop(d[a], d[b]).alias(a + b) for a, b in pairs),
        )
    else:
        own, n = W.partitionBy(*keys), F.col("n")
        rows = points.select(*keys, "n", *(d[a].alias(a) for a in "xyz"), F.sum("n").over(own).alias("_n"), *((F.sum(n * d[a]).over(own) / F.sum("n").over(own)).alias(f"p{a}") for a in "xyz"))
        off = {a: F.col(a) - F.col(f"p{a}") for a in "xyz"}
        moments = rows.groupBy(*keys).agg(
            F.first("_n").alias("_n"),
            *(F.first(f"p{a}").alias(f"p{a}") for a in "xyz"),
            *((F.sum(n * off[a] * off[b]) / F.first("_n")).alias(a + b) for a, b in pairs),
        ).withColumnRenamed("_n", "n")
    return with_normal(moments).select(*keys, "n", "px", "py", "pz", "nx", "ny", "nz")


def plane_distance() -> F.Column:
    return F.abs(dot(sub(vector("x", "y", "z"), vector("px", "py", "pz")), vector("nx", "ny", "nz")))


def refit_planes(points: DataFrame, keys: list[str], near: float = 0.01) -> DataFrame:
    """Planes fitted twice: the second time to the points within `near` of the first."""
    first = fit_planes(points, keys).drop("n")
    return fit_planes(points.join(first, keys).filter(plane_distance() <= near).select(*points.columns), keys)


def plate_planes(points: DataFrame, images: DataFrame, boxes: DataFrame, shapes: DataFrame, margin: float = 0.15, near: float = 0.01) -> DataFrame:
    """Planes by KEY of the plates in boxes of different shape (KEY, x1..y2, m), each shrunk by `margin`; `boxes` say which photos count."""
    inner = shapes.select(*KEY, "m", *shrink_box(Box.of(), margin).named())
    got = points_in_boxes(visible_points(points, images, boxes), inner)
    return refit_planes(got.select(*BOX, "x", "y", "z", count_of(got).alias("n")), BOX, near)


def plate_corners(points: DataFrame, images: DataFrame, boxes: DataFrame, margin: float = 0.15, near: float = 0.01) -> DataFrame:
    """The rows of `boxes` (site_id, photo, box_id, x1..y2, ...) whose points tell a plane, with tl, tr, br, bl, where the rays of their corners meet it,
    and tx, ty, tz of the camera. All is worked out once for boxes of equal sides."""

    def found(shapes: DataFrame) -> DataFrame:
        planes = plate_planes(points, images, boxes, shapes, margin, near).filter("nx is not null").drop("n")
        rows = shapes.join(planes, KEY).join(with_rotation(images), ["site_id", "photo"])
        x1, y1, x2, y2 = Box.of()
        corners = {"tl": (x1, y1), "tr": (x2, y1), "br": (x2, y2), "bl": (x1, y2)}
        at = {k: ray_plane(*uv, vector("px", "py", "pz"), vector("nx", "ny", "nz")) for k, uv in corners.items()}
        return rows.select(*KEY, *SIDES, "tx", "ty", "tz", *(F.struct(*(c.alias(a) for c, a in zip(v, "xyz", strict=True))).alias(k) for k, v in at.items()))

    return by_shape(boxes, SIDES, found, "left").filter("tl is not null")


def surface_normals(points: DataFrame, images: DataFrame, boxes: DataFrame, least: int = 20, share: float = 0.6) -> DataFrame:
    """The boxes' keys with nx, ny, nz of the surface nearest to the camera, facing it; null where a box holds fewer than `least` points."""

    def found(shapes: DataFrame) -> DataFrame:
        got = points_in_boxes(visible_points(points, images, boxes), shapes)
        got = got.select(*KEY, "x", "y", "z", "depth", count_of(got).alias("n"))
        # the window that finds the quantile sorts by depth; so does this one
        whole = box_window().orderBy("depth").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        got = got.withColumn("c", F.sum("n").over(whole)).filter(F.col("c") >= least).drop("c")
        planes = fit_planes(with_quantile(got, "depth", share, "front").filter("depth <= front").select(*BOX, "x", "y", "z", "n"), BOX)
        planes = planes.join(images.select("site_id", "photo", "tx", "ty", "tz"), ["site_id", "photo"])
        away = dot(sub(vector("tx", "ty", "tz"), vector("px", "py", "pz")), vector("nx", "ny", "nz")) < 0
        return planes.select(*KEY, *(F.when(away, -F.col(n)).otherwise(F.col(n)).alias(n) for n in ("nx", "ny", "nz")))

    return by_shape(boxes.select(*KEY, *SIDES), SIDES, found, "left").drop(*SIDES)
