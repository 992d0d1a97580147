"""Sightings of one physical thing merged into assets."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitescan.functions.boxes import Box, view_quality
from sitescan.sources.shared import dealt, forget, kept

#: Sightings of a class of a site that are folded as one piece; larger ones are cut into tiles.
WHOLE = 20_000
#: Side of a tile, in radii.
TILE = 16


class Fold:
    """Clusters of one piece of space while its sightings come in order, strongest first.

    Centres are kept in cells of side `radius`, so a sighting is compared only with those of the 27 cells around it; cells are numbered so that far ones
    may share a number, which costs a comparison and no more. Members are kept sorted per axis, so a median is two look-ups."""

    NEAR = [(i << 42) + (j << 21) + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def __init__(self, radius: float):
        self.radius = radius
        self.cells: dict[int, list[int]] = {}
        self.members: list[list[list[float]]] = []
        self.centres: list[tuple[float, float, float]] = []

    def cell(self, p: tuple[float, float, float]) -> int:
        r = self.radius
        return (floor(p[0] / r) << 42) + (floor(p[1] / r) << 21) + floor(p[2] / r)

    def nearest(self, p: tuple[float, float, float]) -> int:
        """The nearest cluster whose centre is within the radius, the first of equals; -1 for none."""
        at, best, k, cells, centres = self.cell(p), self.radius, -1, self.cells, self.centres
        x, y, z = p
        for d in self.NEAR:
            for c in cells.get(at + d, ()):
                q = centres[c]
                r = sqrt((q[0] - x) ** 2 + (q[1] - y) ** 2 + (q[2] - z) ** 2)
                if r < best or (r == best and (k < 0 or c < k)):
                    best, k = r, c
        return k

    def open(self, p: tuple[float, float, float]) -> int:
        k = len(self.centres)
        self.members.append([[v] for v in p])
        self.centres.append(p)
        self.cells.setdefault(self.cell(p), []).append(k)
        return k

    def join(self, k: int, p: tuple[float, float, float]) -> int:
        """Put a sighting into cluster k; how many were there before it."""
        before = self.cell(self.centres[k])
        mine = self.members[k]
        n = len(mine[0])
        for axis, v in zip(mine, p, strict=True):
            insort(axis, v)
        half, odd = divmod(n + 1, 2)
        self.centres[k] = tuple(a[half] if odd else (a[half - 1] + a[half]) / 2 for a in mine)
        after = self.cell(self.centres[k])
        if after != before:
            self.cells[before].remove(k)
            self.cells.setdefault(after, []).append(k)
        return n


def greedy_clusters(xyz: np.ndarray, radius: float) -> tuple[list[int], list[int]]:
    """For points in order: the number of the nearest cluster (the first of equals) whose per-axis median of members is within `radius`, or
    of a new one; and how many members it had."""
    f, numbers, joined = Fold(radius), [], []
    for p in map(tuple, xyz.tolist()):
        k = f.nearest(p)
        joined.append(f.join(k, p) if k >= 0 else 0)
        numbers.append(k if k >= 0 else f.open(p))
    return numbers, joined


def greedy_in_tile(xyz: np.ndarray, keys: list[tuple], given: list[tuple | None], radius: float) -> tuple[list[tuple], list[int]]:
    """As `greedy_clusters`, among sightings of other tiles that are in their clusters already: a cluster is named by the key of the sighting that
    opened it, `given` has that name for those of other tiles and None for own ones."""
    f, names, number, out, joined = Fold(radius), [], {}, [], []
    for p, key, name in zip(map(tuple, xyz.tolist()), keys, given, strict=True):
        if name is None:
            k = f.nearest(p)
            name = names[k] if k >= 0 else key
        k = number.get(name)
        if k is None:
            number[name] = f.open(p)
            names.append(name)
            joined.append(0)
        else:
            joined.append(f.join(k, p))
        out.append(name)
    return out, joined


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows of equal first `keys` columns of a sorted task, each whole."""
    open_: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if b.num_rows > 1 else np.empty(0, int)
        cuts = [0, *starts.tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == 0 and open_ and any(open_[-1].column(i)[-1].as_py() != b.column(i)[0].as_py() for i in range(keys)):
                yield pa.Table.from_batches(open_)
                open_ = []
            if lo:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(b.slice(lo, hi - lo))
    if open_:
        yield pa.Table.from_batches(open_)


PLACE = ["site_id", "cls", "tx", "ty", "tz"]


def _order() -> list[Column]:
    """Strongest first; ties by photo and place in its list."""
    return [F.col("conf").desc_nulls_last(), F.col("photo").asc(), F.col("det_id").asc()]


def _folded(rows: DataFrame, radius: float) -> DataFrame:
    """`rows` (PLACE, photo, det_id, conf, xyz, p0 and d0: cluster of a sighting of another tile, else null) to PLACE, photo, det_id, p0, d0, join_no of
    own sightings: the name of the cluster each joins (that of the sighting that opened it) and how many were there before.

    A task gets many tiles at once, sorted, and streams them, so a tile costs no call of its own."""
    kind = {f.name: f.dataType for f in rows.schema}
    names = [*PLACE, "photo", "det_id", "p0", "d0", "join_no"]
    schema = T.StructType([T.StructField(c, T.LongType() if c == "join_no" else kind[c]) for c in names])
    columns = [*PLACE, "photo", "det_id", "conf", "x", "y", "z", "p0", "d0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        for piece in _pieces(batches, len(PLACE)):
            xyz = np.column_stack([piece.column(a).to_numpy() for a in "xyz"])
            photo, det = piece.column("photo"), piece.column("det_id")
            p0, d0 = piece.column("p0"), piece.column("d0")
            if d0.null_count == len(d0):
                numbers, joined = greedy_clusters(xyz, radius)
                opener = np.full(max(numbers) + 1, -1)
                opener[numbers[::-1]] = np.arange(len(numbers))[::-1]
                at = pa.array(opener[numbers])
                p0, d0, own = photo.take(at), det.take(at), None
            else:
                keys = list(zip(photo.to_pylist(), det.to_pylist(), strict=True))
                given = [None if d is None else (p, d) for p, d in zip(p0.to_pylist(), d0.to_pylist(), strict=True)]
                named, joined = greedy_in_tile(xyz, keys, given, radius)
                own = pa.array([g is None for g in given])
                p0, d0 = (pa.chunked_array([pa.array([n[i] for n in named], c.type)]) for i, c in ((0, photo), (1, det)))
            t = pa.table([*(piece.column(c) for c in (*PLACE, "photo", "det_id")), p0, d0, pa.array(joined, pa.int64())], names)
            done.append(t if own is None else t.filter(own))
            if sum(t.num_rows for t in done) >= 8192:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return dealt(rows.select(columns), *PLACE).sortWithinPartitions(*PLACE, *_order()).mapInArrow(run, schema)


def _neighbours(state: DataFrame, radius: float, side: float) -> DataFrame:
    """Of tiled sightings with their clusters (PLACE, photo, det_id, conf, xyz, p0, d0): those that other tiles must know, under the tile that must.

    A cluster's centre, a median by axis, stays in the box around its members; only sightings within `radius` of that box can ever look at it. So its
    members go to every tile that the box, moved out by `radius`, touches, but for the one each lies in."""
    name = ["site_id", "cls", "p0", "d0"]
    reach = lambda f, a, sign: F.floor((f(a) + sign * radius) / side)
    box = state.groupBy(*name).agg(*(e.alias(n + a) for a in "xyz" for n, e in (("lo", reach(F.min, a, -1)), ("hi", reach(F.max, a, 1)))))
    box = box.filter(" or ".join(f"lo{a} < hi{a}" for a in "xyz"))
    for a in "xyz":
        box = box.withColumn("t" + a, F.explode(F.sequence("lo" + a, "hi" + a)))
    moved = state.withColumnsRenamed({"t" + a: "o" + a for a in "xyz"}).join(box.select(*name, "tx", "ty", "tz"), name)
    moved = moved.filter("tx <> ox or ty <> oy or tz <> oz").drop("ox", "oy", "oz")
    return moved.join(state.select(*PLACE).distinct(), PLACE, "left_semi")


def _settled_tiles(rows: DataFrame, radius: float, side: float) -> DataFrame:
    """Clusters of tiled sightings (PLACE, photo, det_id, conf, xyz), exactly as if each class of a site were folded at once.

    Every tile is folded alone, then again among the sightings of other tiles whose clusters come near it, as they were placed the time before, until
    no tile sees other neighbours than the last time. A sighting's place depends on stronger ones only, so each time at least the strongest
    that is wrong is put right for good, and what repeats itself is the fold of the whole. Only tiles whose neighbours changed are folded again."""
    keys = [*PLACE, "photo", "det_id"]
    free = rows.select("*", F.lit(None).cast(rows.schema["photo"].dataType).alias("p0"), F.lit(None).cast(rows.schema["det_id"].dataType).alias("d0"))
    state = kept(rows.join(_folded(free, radius), keys), "clusters")
    seen = None
    seal = F.sum(F.xxhash64("photo", "det_id", "p0", "d0").cast("decimal(38,0)")).alias("seal")
    while True:
        near = kept(_neighbours(state.drop("join_no"), radius, side), "neighbours")
        now = near.groupBy(*PLACE).agg(seal, F.count("*").alias("many"))
        if seen is None:
            changed = now.select(*PLACE)
        else:
            was = seen.groupBy(*PLACE).agg(seal.alias("seal0"), F.count("*").alias("many0"))
            changed = now.join(was, PLACE, "full").filter(~(F.col("seal").eqNullSafe(F.col("seal0")) & F.col("many").eqNullSafe(F.col("many0")))).select(*PLACE)
        changed = kept(changed, "changed")
        if changed.isEmpty():
            forget(near, seen, changed)
            return state
        again = state.drop("p0", "d0", "join_no").join(changed, PLACE, "left_semi")
        both = again.withColumns({"p0": F.lit(None).cast(state.schema["p0"].dataType), "d0": F.lit(None).cast(state.schema["d0"].dataType)})
        both = both.unionByName(near.join(changed, PLACE, "left_semi").select(*both.columns))
        fresh = again.join(_folded(both, radius), keys)
        before, state = state, kept(state.join(changed, PLACE, "left_anti").unionByName(fresh.select(*state.columns)), "clusters")
        forget(before, seen, changed)
        seen = near


def cluster_sightings(sightings: DataFrame, radius: float = 0.15, whole: int = WHOLE, tile: int = TILE) -> DataFrame:
    """`sightings` (site_id, cls, photo, det_id, conf, x, y, z, ...) with cluster, a number within (site_id, cls) in order of opening from 0, and
    join_no, a sighting's place in its cluster from 0.

    Per class, strongest first (ties by photo and det_id), each joins the nearest cluster within `radius` of its median, ends
    included, or opens one. A class of a site of up to `whole` sightings is folded as one piece, a larger one in tiles of `tile` radii
    (`_settled_tiles`), with the same result. What lies in one tile is folded by one task. Sightings without a position are left out.
    """
    small = sightings.select("site_id", "cls", "photo", "det_id", "conf", *(F.col(a).cast("double").alias(a) for a in "xyz")).dropna(subset=["x", "y", "z"])
    small = kept(small, "sightings")
    large = small.groupBy("site_id", "cls").count().filter(F.col("count") > whole).select("site_id", "cls")
    large = kept(large, "large-classes")
    keys = ["site_id", "cls", "photo", "det_id"]
    name = ["site_id", "cls", "p0", "d0"]
    free = [F.lit(None).cast(small.schema["photo"].dataType).alias("p0"), F.lit(None).cast(small.schema["det_id"].dataType).alias("d0")]
    tiled = not large.isEmpty()
    pieces = small.join(large, ["site_id", "cls"], "left_anti") if tiled else small
    got = _folded(pieces.select("*", *(F.lit(0).cast("long").alias("t" + a) for a in "xyz"), *free), radius).select(*keys, "p0", "d0", "join_no")
    if tiled:
        side = tile * radius
        cut = small.join(large, ["site_id", "cls"], "left_semi").select("*", *(F.floor(F.col(a) / side).alias("t" + a) for a in "xyz"))
        cut = kept(cut, "tiled-sightings")
        settled = _settled_tiles(cut, radius, side)
        got = got.unionByName(settled.select(*keys, "p0", "d0", "join_no"))
    got = kept(got, "clusters")
    forget(large, *((cut, settled) if tiled else ()))
    openers = got.filter("join_no = 0").select(*name).join(small.select(F.col("site_id"), F.col("cls"), F.col("photo").alias("p0"), F.col("det_id").alias("d0"), "conf"), name)
    # one row per cluster: the things of one class on one site
    order = W.partitionBy("site_id", "cls").orderBy(F.col("conf").desc_nulls_last(), "p0", "d0")
    numbers = openers.select(*name, (F.row_number().over(order) - 1).cast("long").alias("cluster"))
    return sightings.join(got.join(numbers, name).select(*keys, "cluster", "join_no"), keys)


def assets_from_clusters(clustered: DataFrame, keys: list[str] = ["site_id", "cls", "cluster"], least_sweeps: int = 5) -> DataFrame:  # noqa: B006
    """One row per cluster seen from `least_sweeps` sweeps: confidence-weighted position, sightings, sweeps, mean and max confidence,
    spread_m (largest distance from the position), members in join order."""
    w = F.sum("conf")
    kept = clustered.groupBy(*keys).agg(
        *((F.sum(F.col("conf") * F.col(a)) / w).alias(f"p{a}") for a in "xyz"),
        F.count("*").alias("sightings"),
        F.array_sort(F.collect_set("sweep")).alias("sweeps"),
        F.bround(F.avg("conf"), 3).alias("mean_confidence"),
        F.bround(F.max("conf"), 3).alias("max_confidence"),
    )
    kept = kept.filter(F.size("sweeps") >= least_sweeps)
    far = F.sqrt(sum((F.col(a) - F.col(f"p{a}")) ** 2 for a in "xyz"))
    member = F.struct("join_no", "photo", *(F.bround(c, 0).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")), "conf")
    rest = clustered.join(kept.select(*keys, "px", "py", "pz"), keys).groupBy(*keys).agg(F.max(far).alias("spread_m"), F.array_sort(F.collect_list(member)).alias("seen_in"))
    return kept.join(rest, keys).withColumnsRenamed({"px": "x", "py": "y", "pz": "z"})


def number_assets(assets: DataFrame, order: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """`assets` with asset_no (from 1) and asset_id 'asset-01' ... per site, by class and rounded position, earlier clusters first on
    ties."""
    w = W.partitionBy("site_id").orderBy("cls", *(F.bround(F.col(a), 1) for a in "xyz"), *order)
    return assets.withColumn("asset_no", F.row_number().over(w).cast("long")).withColumn("asset_id", F.format_string("asset-%02d", "asset_no"))


def best_view(clustered: DataFrame, keys: list[str], width: Column, height: Column, order: Column) -> DataFrame:
    """keys, best_photo, best_det, best_box (whole pixels), best_conf of the member of the highest view quality, the first on ties."""
    q = view_quality(Box.of(), F.col("conf"), width, height)
    box = F.array(*(F.bround(c, 0).cast("int") for c in ("x1", "y1", "x2", "y2")))
    best = F.max_by(F.struct("photo", "det_id", box.alias("box"), "conf"), F.struct(q, -order)).alias("b")
    return clustered.groupBy(*keys).agg(best).select(*keys, F.col("b.photo").alias("best_photo"), F.col("b.det_id").alias("best_det"), F.col("b.box").alias("best_box"), F.col("b.conf").alias("best_conf"))


def cluster_summary(clustered: DataFrame, keys: list[str] = ["site_id", "cls", "cluster"], least_sweeps: int = 5) -> DataFrame:  # noqa: B006
    """Per site: kept, rejected, rejected_sightings, rejected_sweeps (sorted sweep counts of the rejected clusters)."""
    c = clustered.groupBy(*keys).agg(F.count_distinct("sweep").alias("s"), F.count("*").alias("n")).withColumn("ok", F.col("s") >= least_sweeps)
    bad = ~F.col("ok")
    return c.groupBy("site_id").agg(F.count_if("ok").alias("kept"), F.count_if(bad).alias("rejected"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("rejected_sightings"), F.array_sort(F.collect_list(F.when(bad, F.col("s")))).alias("rejected_sweeps"))


def asset_records(assets: DataFrame, best: DataFrame, classes: DataFrame, normals: DataFrame | None = None, keys: list[str] = ["site_id", "cls", "cluster"]) -> DataFrame:  # noqa: B006
    """The records of located assets, as they are written and as links measure from: positions, normals, spreads and confidences of three digits.

    `assets` are numbered ones with members, `best` their best views, `classes` (cls, product), `normals` (site_id, photo, box_id: det_id of the best view,
    nx, ny, nz), if there are any. Columns: site_id, asset_id, asset_no, product, class_id, x, y, z, nx, ny, nz, sightings, sweeps, mean_confidence,
    max_confidence, spread_m, best_photo, best_box, seen_in (photo, box, conf).
    """
    three = lambda c: F.round(c, 3)
    rows = assets.join(best, keys).join(classes.select("cls", "product"), "cls", "left")
    if normals is not None:
        n = normals.select("site_id", F.col("photo").alias("best_photo"), F.col("box_id").alias("best_det"), *(three(F.col(a)).alias(a) for a in ("nx", "ny", "nz")))
        rows = rows.join(n, ["site_id", "best_photo", "best_det"], "left")
    else:
        rows = rows.withColumns({a: F.lit(None).cast("double") for a in ("nx", "ny", "nz")})
    seen = F.transform("seen_in", lambda m: F.struct(m.photo.alias("photo"), F.array(m.x1, m.y1, m.x2, m.y2).alias("box"), F.round(m.conf, 3).alias("conf")))
    return rows.select(
        "site_id", "asset_id", "asset_no", "product", F.col("cls").alias("class_id"), *(three(F.col(a)).alias(a) for a in "xyz"), "nx", "ny", "nz", "sightings", "sweeps",
        "mean_confidence", "max_confidence", three(F.col("spread_m")).alias("spread_m"), "best_photo", "best_box", seen.alias("seen_in"),
    )
