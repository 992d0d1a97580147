"""Search tiles of large photos and the way back from tile boxes to photo boxes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALES = (1.0, 0.5, 0.25)


def scales_for(least: float = 640.0, scales: tuple[float, ...] = SCALES) -> F.Column:
    """Scales worth searching: the full one, and those at which the photo's longer side keeps `least` pixels."""
    longer = F.greatest(F.col("width"), F.col("height"))
    return F.filter(F.array(*map(F.lit, scales)), lambda s: (s == 1.0) | (longer * s >= least))


def plan_tiles(images: DataFrame, scales: F.Column | None = None, tile: int = 1024, step: int = 768) -> DataFrame:
    """One row per tile: site_id, photo, width, height, scale, x0, y0, tile_w, tile_h.

    Tiles start every `step` pixels of the scaled photo; the last of a row or column ends at its edge and is not repeated.
    """
    scales = F.array(*map(F.lit, SCALES)) if scales is None else scales
    rows = images.select("site_id", "photo", "width", "height", F.explode(scales).alias("scale"))
    rows = rows.withColumn("sw", F.floor(F.col("width") * F.col("scale")).cast("int")).withColumn("sh", F.floor(F.col("height") * F.col("scale")).cast("int"))

    def starts(side: str) -> F.Column:
        last = F.greatest(F.col(side) - tile, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last + (step - 1), F.lit(step)), lambda s: F.least(s, last)))

    rows = rows.withColumn("x0", F.explode(starts("sw"))).withColumn("y0", F.explode(starts("sh")))
    size = lambda side, at: F.least(F.lit(tile), F.col(side) - F.col(at))
    return rows.select("site_id", "photo", "width", "height", "scale", "x0", "y0", size("sw", "x0").alias("tile_w"), size("sh", "y0").alias("tile_h"))


#: Models of this worker by name; the oldest goes where there are more than MOST_MODELS.
_MODELS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}
MOST_MODELS = 4


def worker_model(name: str, predictor: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The model of this Python worker, made at its first use: workers serve many tasks, so it is loaded once each."""
    if name not in _MODELS:
        while len(_MODELS) >= MOST_MODELS:
            del _MODELS[next(iter(_MODELS))]
        _MODELS[name] = predictor()
    return _MODELS[name]


#: What a model returns of each box, beside its tile's number.
FOUND = {"x1": np.float64, "y1": np.float64, "x2": np.float64, "y2": np.float64, "conf": np.float64, "cls": np.int32}
#: Boxes of about so many tiles leave a worker in one Arrow batch.
TOGETHER = 4096


def predict_tiles(tiles: DataFrame, predictor: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], partitions: int | None = None, batch: int = 16, name: str | None = None) -> DataFrame:
    """Boxes of a caller's model. `predictor()` gives a function from a batch of tiles to rows (row, x1, y1, x2, y2, conf, cls), as a frame or as a mapping
    of arrays, `row` being the tile's number in its batch. It is called once per Python worker and kept under `name` (none: a name of this call's own).
    Batches hold `batch` tiles wherever Arrow's batches end; only a task's last one may hold fewer. Tiles and boxes are kept in Arrow around the model."""
    if partitions:
        tiles = tiles.repartition(partitions)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema) + ", x1 double, y1 double, x2 double, y2 double, conf double, cls int"
    name = name or uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_model(name, predictor)

        def found(part: pa.Table) -> list[pa.RecordBatch]:
            frame, at, got = part.to_pandas(), [], {c: [] for c in FOUND}
            for lo in range(0, len(frame), batch):
                some = frame.iloc[lo : lo + batch]
                some.index = pd.RangeIndex(len(some))
                boxes = model(some)
                at.append(np.asarray(boxes["row"], np.int64) + lo)
                for c, kind in FOUND.items():
                    got[c].append(np.asarray(boxes[c], kind))
            rows = part.take(pa.array(np.concatenate(at)))
            for c, kind in FOUND.items():
                rows = rows.append_column(c, pa.array(np.concatenate(got[c]), pa.from_numpy_dtype(kind), from_pandas=True))
            return rows.combine_chunks().to_batches()

        rest: list[pa.RecordBatch] = []
        for got in batches:
            rest.append(got)
            many = sum(map(len, rest))
            if many >= max(TOGETHER, batch):
                part = pa.Table.from_batches(rest)
                whole = many - many % batch
                yield from found(part.slice(0, whole))
                rest = part.slice(whole).to_batches()
        if sum(map(len, rest)):
            yield from found(pa.Table.from_batches(rest))

    return tiles.mapInArrow(run, schema)


def untile_boxes(boxes: DataFrame, margin: float = 4.0) -> DataFrame:
    """Boxes in pixels of the full photo, without those that a tile border cuts (unless it is the photo's own border)."""
    c = F.col
    right, bottom = c("x0") + c("tile_w") >= c("width") * c("scale") - 1, c("y0") + c("tile_h") >= c("height") * c("scale") - 1
    whole = (
        ((c("x1") >= margin) | (c("x0") == 0))
        & ((c("y1") >= margin) | (c("y0") == 0))
        & ((c("x2") <= c("tile_w") - margin) | right)
        & ((c("y2") <= c("tile_h") - margin) | bottom)
    )
    moved = [((c(n) + c(o)) / c("scale")).alias(n) for n, o in (("x1", "x0"), ("y1", "y0"), ("x2", "x0"), ("y2", "y0"))]
    return boxes.filter(whole).select("site_id", "photo", *moved, "conf", "cls")
