"""Thinned point clouds and the scene record of a viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescan.functions.geometry import in_bounds, quat_wxyz_to_xyzw

#: A room's bounds (x, y, z), ends included.
BOUNDS = ((-10.0, 4.0), (-8.0, 4.0), (-0.5, 3.0))


def _cell(voxel: float, low: tuple[float, float, float]) -> list[F.Column]:
    return [F.floor((F.col(a).cast("double") - lo) / voxel).alias("v" + a) for a, lo in zip("xyz", low, strict=True)]


def voxel_downsample(points: DataFrame, voxel: float = 0.02, bounds=BOUNDS, payload: tuple[str, ...] = (), order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """The first point of each voxel: first per sweep, then over all sweeps in their order with voxels taken again from float32.

    `min_by` on the voxel's key keeps one row per voxel before the shuffle; no window sorts the cloud. Ties in `order` are broken by
    the whole row, so the result does not depend on how the cloud is split.
    """
    low = tuple(b[0] for b in bounds)
    key = ["vx", "vy", "vz"]
    row = F.struct("x", "y", "z", *payload)
    p = points.filter(in_bounds(*bounds)).select("site_id", "sweep", *order, "x", "y", "z", *payload, *_cell(voxel, low))
    first = p.groupBy("site_id", "sweep", *key).agg(F.min_by(F.struct(row.alias("p")), F.struct(*order, "x", "y", "z")).alias("b"))
    f = lambda a: F.col("b.p." + a).cast("float").alias(a)
    q = first.select("site_id", "sweep", *(F.col(k).alias("o" + k) for k in key), *map(f, "xyz"), *(F.col("b.p." + a).alias(a) for a in payload))
    q = q.select("*", *_cell(voxel, low))
    out = q.groupBy("site_id", *key).agg(F.min_by(F.struct("sweep", "x", "y", "z", *payload), F.struct("sweep", "ovx", "ovy", "ovz")).alias("b"))
    return out.select("site_id", "b.*")


def points_per_sweep(cloud: DataFrame) -> DataFrame:
    return cloud.groupBy("site_id", "sweep").agg(F.count("*").alias("points"))


def cloud_stats(cloud: DataFrame) -> DataFrame:
    """Per site: points, and lowest and highest coordinate on each axis."""
    ends = [f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return cloud.groupBy("site_id").agg(F.count("*").alias("points"), *ends)


def concat_sweeps(*clouds: DataFrame) -> DataFrame:
    """Union of clouds by column name."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def scene_sweeps(images: DataFrame) -> DataFrame:
    """site_id, sweep, position of the sweep's first face, faces: its files and orientations (x, y, z, w) in order of face."""
    face = F.struct("face", F.col("photo").alias("file"), quat_wxyz_to_xyzw(F.array("qw", "qx", "qy", "qz")).alias("quaternion_xyzw"))
    position = F.min_by(F.array("tx", "ty", "tz"), "face")
    faces = F.transform(F.array_sort(F.collect_list(face)), lambda f: F.struct(f.file.alias("file"), f.quaternion_xyzw.alias("quaternion_xyzw")))
    return images.groupBy("site_id", "sweep").agg(position.alias("position"), faces.alias("faces"))


def scene(images: DataFrame, cloud: DataFrame, tags: DataFrame) -> DataFrame:
    """One record per site: bounds and size of its cloud, its sweeps and its tags."""
    sweeps = scene_sweeps(images).groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("sweep", "position", "faces"))).alias("sweeps"))
    t = tags.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("tags"))
    return sweeps.join(cloud_stats(cloud), "site_id", "left").join(t, "site_id", "left")
