"""A synthetic room: plates on walls with known places, seen by cube cameras; and the operators on positions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitescan.functions import geometry as geo
from sitescan.operators import assets, cloud, lift, link, planes, truth

IMAGES = "site_id long, photo string, sweep int, face int, width int, height int, fx double, fy double, cx double, cy double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
POINTS = "site_id long, sweep int, idx long, x float, y float, z float"
Q = math.sqrt(0.5)


@pytest.fixture(scope="module")
def room(spark):
    """A wall at y = 4 with points, seen from three sweeps by a camera that looks along +y."""
    rng, n = np.random.default_rng(1), 15000
    pts = [pd.DataFrame({"site_id": 0, "sweep": s, "idx": np.arange(n), "x": rng.uniform(-3, 3, n), "y": 4 + rng.normal(0, 0.0005, n), "z": rng.uniform(0, 2.5, n)}) for s in range(3)]
    cams = [(0, f"s{s}", s, 0, 1024, 1024, 512.0, 512.0, 512.0, 512.0, Q, Q, 0.0, 0.0, s - 1.0, 0.0, 1.2) for s in range(3)]
    return spark.createDataFrame(pd.concat(pts), POINTS.replace("float", "double")).cache(), spark.createDataFrame(cams, IMAGES)


def test_camera_looks_along_minus_z(spark, room):
    _, cams = room
    p = spark.createDataFrame([(0, 1, 0, 1.0, 4.0, 1.2), (0, 1, 1, 0.0, -1.0, 0.0), (0, 1, 2, 0.0, 0.0, 1.2)], POINTS)
    got = {r.idx: r for r in geo.project_points(p, cams).collect()}
    assert got[0].depth == pytest.approx(4) and got[0].u == pytest.approx(512 + 128) and got[0].v == pytest.approx(512)
    assert got[1].depth < 0 and got[2].u is None
    assert {r.idx for r in geo.project_points(p, cams).filter(geo.in_frame()).collect()} == {0}


def test_join_includes_tile_borders_and_box_ends(spark):
    pix = spark.createDataFrame([(0, "a", 128.0, 64.0), (0, "a", 256.0, 64.0), (0, "a", 127.999, 64.0), (0, "b", 128.0, 64.0)], "site_id long, photo string, u double, v double")
    box = spark.createDataFrame([(0, "a", 1, 128.0, 0.0, 256.0, 64.0)], "site_id long, photo string, box_id long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.u for r in lift.points_in_boxes(pix, box).collect()) == [128.0, 256.0]


def test_lift_finds_the_place(spark, room):
    points, cams = room
    box = spark.createDataFrame([(0, "s1", 1, 600.0, 480.0, 680.0, 540.0), (0, "s1", 2, 640.0, 512.0, 641.0, 513.0), (0, "s1", 3, 0.0, 0.0, 1.0, 1.0)], "site_id long, photo string, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.box_id: r for r in lift.lift_boxes(points, cams, box).collect()}
    assert abs(got[1].x - 1.0) < 0.05 and abs(got[1].y - 4.0) < 0.01 and abs(got[1].z - 1.22) < 0.05
    assert 2 in got and 3 not in got
    n = {r.box_id: r for r in planes.surface_normals(points, cams, box).collect()}
    assert n[1].ny == pytest.approx(-1, abs=0.01) and n[3].nx is None


def test_objects_from_marks_and_their_appearances(spark, room):
    points, cams = room
    marks = spark.createDataFrame([(0, 1, "s1", "full", 600.0, 480.0, 680.0, 540.0, "m", "wall"), (0, 2, "s1", "tl", 400.0, 480.0, 480.0, 540.0, "m", "wall")], "site_id long, object_id long, photo string, kind string, x1 double, y1 double, x2 double, y2 double, model string, location string")
    objects = truth.build_objects(points, cams, marks).cache()
    boxes = truth.visibility_filter(truth.project_objects(objects, cams)).cache()
    seen = truth.appearances(truth.occlusion_filter(boxes, points, cams)).cache()
    o = {r.object_id: r for r in objects.collect()}
    assert o[1].width_m == pytest.approx(80 / 512 * 4, rel=0.01) and o[1].height_m == pytest.approx(60 / 512 * 4, rel=0.01)
    assert o[2].width_m == pytest.approx(o[1].width_m, rel=0.01) and o[1].normal.y == pytest.approx(-1, abs=0.01)
    rows = {(r.photo, r.object_id): r for r in seen.collect()}
    assert len(rows) == 6
    at = rows["s1", 1]
    assert (at.x1, at.y1, at.x2, at.y2) == (600, 480, 680, 540) and at.difficulty == "clear"
    total = {r.object_id: r for r in truth.truth_summary(seen).collect()}
    assert total[None].appearances == 6 and total[1].photos == 3


def test_occlusion(spark, room):
    points, cams = room
    b = spark.createDataFrame([(0, "s1", 1, 500.0, 500.0, 540.0, 540.0, 4.2), (0, "s1", 2, 500.0, 500.0, 540.0, 540.0, 5.0), (0, "s1", 3, 0.0, 1000.0, 4.0, 1004.0, 9.0)], "site_id long, photo string, object_id long, x1 double, y1 double, x2 double, y2 double, depth double")
    assert {r.object_id for r in truth.occlusion_filter(b, points, cams).collect()} == {1, 3}


def test_difficulty_words(spark):
    df = spark.createDataFrame([(1.0, 10.0, 0.0, 80.0), (0.5, 70.0, 0.0, 59.0), (1.0, 65.0, 0.0, 60.0)], "in_frame double, view_angle_deg double, x1 double, x2 double")
    assert [r.d for r in df.select(truth.difficulty().alias("d")).collect()] == ["clear", "hard: cut by photo edge, steep angle, small", "clear"]


def fold(points, radius):
    members = []
    out = []
    for p in points:
        d = [np.linalg.norm(np.median(m, 0) - p) for m in members]
        k = int(np.argmin(d)) if d else -1
        if k >= 0 and d[k] <= radius:
            members[k].append(p)
        else:
            members.append([p])
            k = len(members) - 1
        out.append(k)
    return out


SIGHTING = "site_id long, cls int, sweep int, photo string, det_id long, conf double, x double, y double, z double"


def as_folded(got, rows, radius=0.15):
    """Whether numbers and places in clusters are those of a fold of each class of a site as one piece."""
    mine = {(r.site_id, r.cls, r.photo, r.det_id): (r.cluster, r.join_no) for r in got}
    assert len(mine) == len(got) == len(rows)
    for group in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == group), key=lambda r: (-r[5], r[3], r[4]))
        sizes = {}
        for r, k in zip(own, fold([np.array(r[6:]) for r in own], radius), strict=True):
            assert mine[r[0], r[1], r[3], r[4]] == (k, sizes.get(k, 0)), r
            sizes[k] = sizes.get(k, 0) + 1


def sightings_of(rng, n, spread, sites=1, classes=2, digits=2, things=None):
    rows = []
    for i in range(n):
        p = rng.uniform(0, spread, 3) if things is None else things[rng.integers(len(things))] + rng.normal(0, 0.05, 3)
        rows.append((int(rng.integers(sites)), int(rng.integers(classes)), int(rng.integers(8)), f"p{i % 20}", i, round(float(rng.random()), digits), *map(float, p)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tiles_of_dense_rooms_give_the_clusters_of_one_fold(spark, seed):
    """Rooms full of sightings, where no gap separates anything: small tiles, so that most clusters lie across borders."""
    rng = np.random.default_rng(seed)
    rows = sightings_of(rng, 900, 1.2, digits=1)
    df = spark.createDataFrame(rows, SIGHTING)
    as_folded(assets.cluster_sightings(df, 0.15, whole=50, tile=2).collect(), rows)


def test_things_close_together(spark):
    rng = np.random.default_rng(5)
    rows = sightings_of(rng, 700, 0, sites=2, things=rng.uniform(0, 2, (60, 3))) + sightings_of(rng, 30, 9, sites=1, classes=1)[:0]
    df = spark.createDataFrame(rows, SIGHTING)
    whole = assets.cluster_sightings(df, 0.15)
    as_folded(whole.collect(), rows)
    as_folded(assets.cluster_sightings(df, 0.15, whole=0, tile=3).collect(), rows)


def test_a_median_far_from_all_members_still_counts(spark):
    """Members at two ends and a centre between them, in a tile where none of them lies."""
    places = [(0.0, 0.0, 0.0), (0.14, 0.0, 0.0), (0.07, 0.13, 0.0), (0.07, 0.02, 0.1), (0.2, 0.06, 0.0), (0.31, 0.0, 0.0), (0.22, 0.1, 0.0), (0.15, 0.15, 0.15), (0.15, 0.15, 0.0), (0.1, 0.1, 0.1)] * 3
    rows = [(0, 0, i, "p", i, 1 - i / 100, *(c + 0.013 * (i // 10) for c in p)) for i, p in enumerate(places)]
    df = spark.createDataFrame(rows, SIGHTING)
    as_folded(assets.cluster_sightings(df, 0.15, whole=1, tile=1).collect(), rows)


def test_sightings_without_a_place_and_equal_ones(spark):
    rows = [(0, 0, 1, "p", i, 0.5, 1.0, 1.0, 1.0) for i in range(40)]
    df = spark.createDataFrame([*rows, (0, 0, 1, "q", 99, 0.9, None, 1.0, 1.0)], SIGHTING)
    as_folded(assets.cluster_sightings(df, 0.15, whole=10, tile=1).collect(), rows)
    assert assets.cluster_sightings(df.limit(0)).count() == 0


def test_register_loser_gets_no_second(spark):
    a = spark.createDataFrame([(0, 1, "P", 0.0, 0.0, 0.0), (0, 2, "P", 0.1, 0.0, 0.0), (0, 3, "P", 5.0, 0.0, 0.0), (0, 4, "P", 5.0, 0.31, 0.0)], "site_id long, asset_id long, product string, x double, y double, z double")
    r = spark.createDataFrame([(0, 10, "T", 0.05, 0.0, 0.0), (0, 11, "U", 0.3, 0.0, 0.0), (0, 12, "V", 4.75, 0.0, 0.0)], "site_id long, entry_id long, tag_name string, x double, y double, z double")
    got = {x.asset_id: (x.entry_id, x.title) for x in link.link_register(a, r).collect()}
    assert got == {1: (10, "T"), 2: (None, "Unregistered P"), 3: (12, "V"), 4: (None, "Unregistered P")}
    assert [x.entry_id for x in link.entries_not_found(r, link.link_register(a, r)).collect()] == [11]


def test_voxels_keep_the_first_and_are_stable(spark):
    p = spark.createDataFrame([(0, 0, 2, 0.011, 0.0, 0.0), (0, 0, 1, 0.012, 0.0, 0.0), (0, 1, 0, 0.013, 0.0, 0.0), (0, 0, 0, 99.0, 0.0, 0.0), (0, 1, 5, 0.5, 0.0, 0.0)], POINTS)
    got = cloud.voxel_downsample(p)
    assert {(r.sweep, round(r.x, 3)) for r in got.collect()} == {(0, 0.012), (1, 0.5)}
    again = cloud.voxel_downsample(got.withColumn("idx", F.lit(0)))
    assert again.count() == got.count()
