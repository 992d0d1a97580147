"""Ground truth: objects from marked plates, and their appearances in photos."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescan.functions.boxes import Box, box_area, clip_box, in_frame_share
from sitescan.functions.geometry import add, cross, dot, norm, pixel_of, settled, sub, times, unit, vector, view_angle, view_distance, with_rotation

from sitescan.sources.shared import dealt

from .lift import depth_at
from .planes import plate_corners


def _xyz(v) -> Column:
    return F.struct(*(c.alias(a) for c, a in zip(v, "xyz", strict=True)))


def _v(c: Column):
    return c["x"], c["y"], c["z"]


def build_objects(points: DataFrame, images: DataFrame, marks: DataFrame, margin: float = 0.15, near: float = 0.01) -> DataFrame:
    """site_id, object_id, model, location, marked_in, corners (tl, tr, br, bl), center, normal, width_m, height_m.

    Marks (site_id, object_id, photo, kind, x1, y1, x2, y2, model, location) are full boxes, whose corner rays are cut with the plane
    of the plate, or (kind 'tl' or 'tr') one corner x1, y1 with a box around it, which take the sides of the site's first full
    mark of the same model. The plane goes through the points within `near` of a first plane; marks whose points tell no plane give no object.
    """
    about = ["site_id", "object_id", "photo", "kind", "model", "location", "tx", "ty", "tz"]
    marked = plate_corners(points, images, marks.withColumn("box_id", F.col("object_id")), margin, near)
    full = marked.filter("kind = 'full'").select(*about, "tl", "tr", "br", "bl")
    across, down = sub(_v(F.col("tr")), _v(F.col("tl"))), sub(_v(F.col("bl")), _v(F.col("tl")))
    template = full.groupBy("site_id", "model").agg(F.min_by(F.struct(_xyz(across).alias("w"), _xyz(down).alias("d")), "object_id").alias("t"))
    corner = marked.filter("kind in ('tl', 'tr')").join(template, ["site_id", "model"])
    w, d, hit = _v(F.col("t.w")), _v(F.col("t.d")), _v(F.col("tl"))
    corner = corner.select(*about, *(F.when(F.col("kind") == "tl", h).otherwise(h - k).alias("a" + a) for a, h, k in zip("xyz", hit, w, strict=True)), *(v.alias(n + a) for n, vec in (("w", w), ("d", d)) for a, v in zip("xyz", vec, strict=True)))
    tl, w, d = vector("ax", "ay", "az"), vector("wx", "wy", "wz"), vector("dx", "dy", "dz")
    corner = corner.select(*about, _xyz(tl).alias("tl"), _xyz(add(tl, w)).alias("tr"), _xyz(add(add(tl, w), d)).alias("br"), _xyz(add(tl, d)).alias("bl"))
    both = full.unionByName(corner)
    both = settled(both, **{f"{k}{a}": F.col(k)[a] for k in ("tl", "tr", "br", "bl") for a in "xyz"})
    tl, tr, br, bl = (vector(*(k + a for a in "xyz")) for k in ("tl", "tr", "br", "bl"))
    both = settled(both, **dict(zip(("cx", "cy", "cz", "nx", "ny", "nz"), (*times(add(tl, br), F.lit(0.5)), *cross(sub(tr, tl), sub(bl, tl))), strict=True)))
    mid, n = vector("cx", "cy", "cz"), unit(vector("nx", "ny", "nz"))
    out = F.when(dot(n, sub(vector("tx", "ty", "tz"), mid)) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return both.select(
        "site_id", "object_id", "model", "location", F.col("photo").alias("marked_in"), F.array("tl", "tr", "br", "bl").alias("corners"),
        _xyz(mid).alias("center"), _xyz(times(n, out)).alias("normal"), norm(sub(tr, tl)).alias("width_m"), norm(sub(bl, tl)).alias("height_m"),
    )


def for_shapes(objects: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `find` gives for objects (site_id, object_id, ...), worked out once for all objects of a site with equal corners, center and normal.

    `find` gets one object of each shape, without model and location, under an id of its own, and returns rows with site_id and that object_id; each
    comes back for every object of the shape, with the object's own id, model and location.
    """
    shape = [F.coalesce(c, F.lit(None).cast(objects.schema[c].dataType)).alias(c) for c in ("corners", "center", "normal")]
    rows = objects.select("site_id", "object_id", "model", "location", *shape)
    ident = F.struct(F.min("object_id").alias("least"), F.xxhash64("corners", "center", "normal").alias("hash"))
    ids = rows.groupBy("site_id", "corners", "center", "normal").agg(ident.alias("_shape"))
    nothing = [F.lit(None).cast(objects.schema[c].dataType).alias(c) for c in ("model", "location")]
    found = find(dealt(ids.select("site_id", F.col("_shape").alias("object_id"), *nothing, "corners", "center", "normal"), "site_id", "object_id"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("corners", "center", "normal")]
    whose = rows.alias("a").join(ids.alias("b"), [F.col("a.site_id") == F.col("b.site_id"), *on]).select("a.site_id", "_shape", "object_id", "model", "location")
    own = [c for c in ("object_id", "model", "location") if c in found.columns]
    back = found.withColumnRenamed("object_id", "_shape").drop("model", "location")
    return back.join(whose, ["site_id", "_shape"]).select(*(c if c in own else back[c] for c in found.columns))


def project_objects(objects: DataFrame, images: DataFrame, strict: bool = True) -> DataFrame:
    """Every object's corners in every photo of its site, as a box (site_id, photo, object_id, x1..y2, depth of the centre, ...).

    Loose boxes need all four corners in front of the camera and are not clipped. Strict ones need the centre too, and are clipped
    and rated: in_frame, distance_m, view_angle_deg. The pairs are objects times photos of one site, which is the result.
    """
    o = objects.withColumn("center", F.coalesce("center", F.lit(None).cast(objects.schema["center"].dataType)))
    rows = o.join(with_rotation(images), "site_id")
    points = [_v(F.col("corners")[i]) for i in range(4)] + ([_v(F.col("center"))] if strict else [])
    seen = F.array(*(F.struct(*pixel_of(p)) for p in points))
    rows = settled(rows, seen=seen).filter(F.forall("seen", lambda p: p.depth > 0.05))
    us, vs = F.transform(F.slice("seen", 1, 4), lambda p: p.u), F.transform(F.slice("seen", 1, 4), lambda p: p.v)
    rows = settled(rows, x1=F.array_min(us), y1=F.array_min(vs), x2=F.array_max(us), y2=F.array_max(vs))
    if not strict:
        return rows.select("site_id", "photo", "object_id", "x1", "y1", "x2", "y2")
    share = in_frame_share(Box.of(), F.col("width"), F.col("height"))
    camera, centre, normal = vector("tx", "ty", "tz"), _v(F.col("center")), _v(F.col("normal"))
    rows = settled(rows, in_frame=share, distance_m=view_distance(camera, centre), view_angle_deg=view_angle(camera, centre, normal), depth=F.col("seen")[4]["depth"])
    clipped = clip_box(Box.of(), F.col("width"), F.col("height"))
    rows = rows.filter(box_area(clipped) > 0)
    return rows.select("site_id", "photo", "object_id", "model", "location", *clipped.named(), "in_frame", "distance_m", "view_angle_deg", "depth")


def visibility_filter(boxes: DataFrame, most_angle: float = 85.0, least_share: float = 0.2) -> DataFrame:
    return boxes.filter((F.col("view_angle_deg") < most_angle) & (F.col("in_frame") >= least_share))


def occlusion_filter(boxes: DataFrame, points: DataFrame, images: DataFrame, behind: float = 0.25) -> DataFrame:
    """Without appearances in front of whose centre a surface stands. Where no point is seen, nothing is."""
    middle = boxes.select("site_id", "photo", F.col("object_id").alias("box_id"), ((F.col("x1") + F.col("x2")) / 2).alias("u"), ((F.col("y1") + F.col("y2")) / 2).alias("v"), F.greatest(F.lit(6.0), (F.col("x2") - F.col("x1")) / 4).alias("r"))
    seen = depth_at(points, images, middle, F.col("r")).select("site_id", "photo", F.col("box_id").alias("object_id"), "depth_at")
    return boxes.join(seen, ["site_id", "photo", "object_id"], "left").filter(F.col("depth_at").isNull() | (F.col("depth_at") >= F.col("depth") - behind)).drop("depth_at")


def difficulty() -> Column:
    """'clear', or 'hard: ' and the reasons in order."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("in_frame") < 0.95, "cut by photo edge"),
            F.when(F.col("view_angle_deg") > 65, "steep angle"),
            F.when(F.col("x2") - F.col("x1") < 60, "small"),
        )
    )
    return F.when(F.size(reasons) == 0, "clear").otherwise(F.concat(F.lit("hard: "), F.array_join(reasons, ", ")))


def appearances(boxes: DataFrame, *more: str) -> DataFrame:
    """The flat table of appearances: pixels and degrees rounded to whole numbers, halves to even. Columns `more` are taken as they are."""
    pixel = lambda c: F.bround(c, 0).cast("int")
    return boxes.select(
        "site_id", "photo", "object_id", "model", "location", *(pixel(c).alias(c) for c in ("x1", "y1", "x2", "y2")),
        F.bround(F.col("x2") - F.col("x1"), 0).cast("int").alias("width_px"), F.bround("distance_m", 2).alias("distance_m"),
        pixel("view_angle_deg").alias("view_angle_deg"), F.bround("in_frame", 2).alias("in_frame"), difficulty().alias("difficulty"), *more,
    )


def ground_truth(points: DataFrame, images: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, appearances) from marked plates."""
    objects = build_objects(points, images, marks)
    seen = lambda shapes: occlusion_filter(visibility_filter(project_objects(shapes, images)), points, images)
    return objects, for_shapes(objects, lambda shapes: appearances(seen(shapes)))


def truth_summary(rows: DataFrame) -> DataFrame:
    """object_id (null: all), photos, clear_photos, appearances. Rows of an object in a photo become one before photos are counted."""
    clear = F.col("difficulty") == "clear"
    pairs = rows.groupBy("object_id", "site_id", "photo").agg(F.count("*").alias("n"), F.count_if(clear).alias("c"))
    known = F.col("site_id").isNotNull() & F.col("photo").isNotNull()
    counts = [F.count_if(known).alias("photos"), F.count_if(F.col("c") > 0).alias("clear_photos"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("appearances")]
    own = pairs.groupBy("object_id").agg(*counts)
    photos = pairs.groupBy("site_id", "photo").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return own.unionByName(photos.agg(F.lit(None).cast(rows.schema["object_id"].dataType).alias("object_id"), *counts))
