"""Cameras, rays and angles as column arithmetic. A camera looks along its -Z axis, +X is right and +Y is up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def sub(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def times(a: Vector, k: Column) -> Vector:
    return a[0] * k, a[1] * k, a[2] * k


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def vector(*names: str) -> Vector:
    return tuple(F.col(n).cast("double") for n in names)


def quat_to_rotation(qw: Column, qx: Column, qy: Column, qz: Column) -> list[list[Column]]:
    """The camera-to-world matrix of a quaternion, which need not be of unit length; null for one of length zero."""
    two = F.try_divide(F.lit(2.0), qw * qw + qx * qx + qy * qy + qz * qz)
    one = F.lit(1.0)
    return [
        [one - two * (qy * qy + qz * qz), two * (qx * qy - qz * qw), two * (qx * qz + qy * qw)],
        [two * (qx * qy + qz * qw), one - two * (qx * qx + qz * qz), two * (qy * qz - qx * qw)],
        [two * (qx * qz - qy * qw), two * (qy * qz + qx * qw), one - two * (qx * qx + qy * qy)],
    ]


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that later steps take as they are: the optimizer doesn't write their expressions out wherever they are used,
    which multiplies for long formulas. They come out of a generator of one row; nothing is shuffled."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def with_rotation(images: DataFrame) -> DataFrame:
    """`images` with r00 ... r22, so that the matrix is made once per camera and not once per point."""
    r = quat_to_rotation(*(F.col(c).cast("double") for c in ("qw", "qx", "qy", "qz")))
    return settled(images, **{f"r{i}{j}": r[i][j] for i in range(3) for j in range(3)})


def pixel_of(point: Vector) -> list[Column]:
    """depth, u, v of a world point in the camera of the row (r.., t., f., c.). Depth of zero and below is behind it."""
    d = sub(point, vector("tx", "ty", "tz"))
    pc = [sum((F.col(f"r{j}{i}") * d[j] for j in range(1, 3)), F.col(f"r0{i}") * d[0]) for i in range(3)]
    depth = -pc[2]
    return [
        depth.alias("depth"),
        (F.col("cx") + F.col("fx") * F.try_divide(pc[0], depth)).alias("u"),
        (F.col("cy") - F.col("fy") * F.try_divide(pc[1], depth)).alias("v"),
    ]


def project_points(points: DataFrame, images: DataFrame) -> DataFrame:
    """Every point in each photo of its own sweep: the points' columns with photo, width, height, depth, u, v.

    An equi-join on (site_id, sweep); a site has few cameras, so Spark broadcasts them where their size is known to be small.
    """
    cams = with_rotation(images).drop("idx", "x", "y", "z")
    joined = points.join(cams, ["site_id", "sweep"])
    keep = [c for c in points.columns if c not in ("site_id", "sweep")]
    return joined.select("site_id", "sweep", *keep, "photo", "width", "height", *pixel_of(vector("x", "y", "z")))


def in_frame(depth: Column | None = None) -> Column:
    """In front of the camera and inside the photo."""
    depth = F.col("depth") if depth is None else depth
    return (depth > 0.05) & (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))


def ray_of(u: Column, v: Column) -> Vector:
    """World direction of a pixel's ray in the camera of the row."""
    local = ((u - F.col("cx")) / F.col("fx"), -(v - F.col("cy")) / F.col("fy"), F.lit(-1.0))
    return tuple(F.col(f"r{i}0") * local[0] + F.col(f"r{i}1") * local[1] + F.col(f"r{i}2") * local[2] for i in range(3))


def ray_plane(u: Column, v: Column, centre: Vector, normal: Vector) -> Vector:
    """Where a pixel's ray meets a plane; null where they are parallel."""
    t, d = vector("tx", "ty", "tz"), ray_of(u, v)
    return add(t, times(d, F.try_divide(dot(sub(centre, t), normal), dot(d, normal))))


def view_distance(camera: Vector, centre: Vector) -> Column:
    return norm(sub(camera, centre))


def view_angle(camera: Vector, centre: Vector, normal: Vector) -> Column:
    """Degrees between a surface's normal and the direction to the camera."""
    cosine = dot(normal, unit(sub(camera, centre)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def in_bounds(x: tuple[float, float], y: tuple[float, float], z: tuple[float, float]) -> Column:
    """Inside a box, ends included; plain comparisons, so the filter reaches the Parquet scan."""
    return F.col("x").between(*x) & F.col("y").between(*y) & F.col("z").between(*z)


def sweep_of_photo(photo: Column) -> Column:
    """The sweep in a name like sweep07_face2.jpg."""
    return F.substring(photo, 6, 2).try_cast("int")


def photo_name(sweep: Column, face: Column) -> Column:
    return F.format_string("sweep%02d_face%d.jpg", sweep.cast("int"), face.cast("int"))


def quat_wxyz_to_xyzw(q: Column) -> Column:
    return F.concat(F.slice(q, 2, 3), F.slice(q, 1, 1))
