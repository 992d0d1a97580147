"""Metadata of scan files: XML sections cut out of paged bytes, and read into sweeps and images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: every page ends with a checksum.
PAGE, CHECKSUM = 1024, 4

_QUAT = "struct<w:double,x:double,y:double,z:double>"
_POSE = f"struct<rotation:{_QUAT},translation:struct<x:double,y:double,z:double>>"
SCAN_XML = (
    "data3D struct<vectorChild:array<struct<guid:string,name:string,pose:" + _POSE + ",points:struct<_recordCount:long>>>>, "
    "images2D struct<vectorChild:array<struct<guid:string,name:string,associatedData3DGuid:string,pose:" + _POSE + ","
    "pinholeRepresentation:struct<imageWidth:int,imageHeight:int,focalLength:double,pixelWidth:double,pixelHeight:double,principalPointX:double,principalPointY:double>>>>"
)


def logical_bytes(raw: bytes, offset: int, length: int) -> bytes:
    """`length` bytes from logical position `offset` of a paged file, whose last page may be short."""
    data = np.frombuffer(raw, np.uint8)
    whole = len(data) // PAGE
    body = data[: whole * PAGE].reshape(whole, PAGE)[:, : PAGE - CHECKSUM].reshape(-1)
    rest = data[whole * PAGE :]
    rest = rest[: max(0, len(rest) - CHECKSUM)]
    return np.concatenate([body, rest])[offset : offset + length].tobytes()


def page_payload(df: DataFrame) -> DataFrame:
    """`df` (..., content, offset, length) with payload instead of content: pages without checksums, cut to the range. A null content
    has a null payload."""
    keep = [c for c in df.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "content") + ", payload binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [None if c is None else logical_bytes(bytes(c), int(o), int(n)) for c, o, n in zip(frame.content, frame.offset, frame.length, strict=True)]
            yield frame[keep].assign(payload=pd.Series(out, dtype=object, index=frame.index))

    return df.mapInPandas(run, schema)


def ingest_scan_metadata(xml: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sweeps, images) of rows (site_id, xml).

    A sweep's number is its place in the file; its pose is the identity where elements are missing. Images are pinhole images only,
    joined to their sweep by its guid; the face is the last word of the name.
    """
    doc = xml.select("site_id", F.from_xml("xml", SCAN_XML).alias("d"))
    pose = lambda p: [
        F.coalesce(p["rotation"]["w"], F.lit(1.0)).alias("qw"),
        *(F.coalesce(p["rotation"][a], F.lit(0.0)).alias("q" + a) for a in "xyz"),
        *(F.coalesce(p["translation"][a], F.lit(0.0)).alias("t" + a) for a in "xyz"),
    ]
    s = doc.select("site_id", F.posexplode("d.data3D.vectorChild").alias("sweep", "s"))
    name = F.trim(F.regexp_replace("s.name", r"\s+", " "))
    sweeps = s.select("site_id", "sweep", F.col("s.guid").alias("guid"), name.alias("name"), F.col("s.points._recordCount").alias("points"), *pose(F.col("s.pose")))
    i = doc.select("site_id", F.explode("d.images2D.vectorChild").alias("i")).filter("i.pinholeRepresentation is not null")
    words = F.split(F.trim("i.name"), r"\s+")
    p = F.col("i.pinholeRepresentation")
    images = i.select(
        "site_id", F.col("i.associatedData3DGuid").alias("guid"), F.element_at(words, -1).try_cast("int").alias("face"), p["imageWidth"].alias("width"), p["imageHeight"].alias("height"),
        F.try_divide(p["focalLength"], p["pixelWidth"]).alias("fx"), F.try_divide(p["focalLength"], p["pixelHeight"]).alias("fy"),
        p["principalPointX"].alias("cx"), p["principalPointY"].alias("cy"), *pose(F.col("i.pose")),
    )
    joined = images.join(sweeps.select("site_id", "guid", "sweep"), ["site_id", "guid"]).drop("guid")
    photo = F.format_string("sweep%02d_face%d.jpg", "sweep", "face")
    return sweeps, joined.select("site_id", photo.alias("photo"), "sweep", *(c for c in joined.columns if c not in ("site_id", "sweep")))
