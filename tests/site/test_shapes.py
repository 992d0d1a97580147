"""Equal boxes, equal places and equal objects are worked on once; results are those of every single one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescan.operators import lift, planes, truth
from sitescan.plans.queries import QUERIES

IMAGES = "site_id long, photo string, sweep int, face int, width int, height int, fx double, fy double, cx double, cy double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"
SF = "/root/testdata/sf0.1"
BOXES = "site_id long, photo string, box_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def wall(spark):
    """2,000 points at 100 places of a plane 4 m before a camera that looks along -z, at (k, k) of 100 pixels; each place 20 times."""
    rows = [(0, 0, float(i % 10 - 5), float(i // 10 - 5), -4.0 + 0.25 * (i % 3)) for i in range(100)] * 20
    cam = (0, "a", 0, 0, 1000, 1000, 400.0, 400.0, 500.0, 500.0, 1.0, 0.0, 0.0, 0.0, 0.013, 0.017, 0.0)
    return spark.createDataFrame(rows, "site_id long, sweep int, x double, y double, z double"), spark.createDataFrame([cam], IMAGES), rows


def counted(monkeypatch, module, name="points_in_boxes"):
    """Rows that a join of points with boxes has given since."""
    seen, join = [], getattr(module, name)

    def held(*args, **more):
        out = join(*args, **more)
        seen.append(out.count())
        return out

    monkeypatch.setattr(module, name, held)
    return seen


def inside(rows, box, widen=0.0):
    got = []
    for _, _, x, y, z in rows:
        u, v = 500 + 400 * (x - 0.013) / -z, 500 - 400 * (y - 0.017) / -z
        if 0 <= u < 1000 and 0 <= v < 1000 and box[0] - widen <= u <= box[2] + widen and box[1] - widen <= v <= box[3] + widen:
            got.append((x, y, z))
    return np.array(got)


def lifted(rows, box):
    w, h = box[2] - box[0], box[3] - box[1]
    held = inside(rows, (box[0] + w / 4, box[1] + h / 4, box[2] - w / 4, box[3] - h / 4))
    held = held if len(held) >= 5 else inside(rows, box, 4)
    front = held[-held[:, 2] <= np.percentile(-held[:, 2], 25) + 0.05]
    return (len(front), *(round(float(v), 9) for v in np.median(front, 0)))


SHAPES = [(200.0, 200.0, 700.0, 700.0), (300.0, 100.0, 640.0, 480.0), (480.0, 480.0, 520.0, 520.0)]


def test_equal_boxes_and_points_are_lifted_once(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, lift)
    boxes = spark.createDataFrame([(0, "a", i, *SHAPES[i % 3]) for i in range(60)], BOXES)
    got = {r.box_id: (r.n_points, *(round(r[a], 9) for a in "xyz")) for r in lift.lift_boxes(points, cams, boxes).collect()}
    assert got == {i: lifted(rows, SHAPES[i % 3]) for i in range(60)}
    assert sum(seen) < 300  # 60 boxes of 2,000 points


def test_parts_of_a_box_count_together(spark, wall):
    points, cams, rows = wall
    a, b, _ = SHAPES
    boxes = spark.createDataFrame([(0, "a", 1, *a), (0, "a", 2, *a), (0, "a", 2, *a), (0, "a", 3, *a), (0, "a", 3, *b), (0, "a", 4, 900.0, 0.0, 100.0, 9.0), (0, "a", 5, None, 0.0, 1.0, 1.0), (0, "b", 6, *a)], BOXES)
    got = {r.box_id: r.n_points for r in lift.lift_boxes(points, cams, boxes).collect()}
    assert got == {1: lifted(rows, a)[0], 2: 2 * lifted(rows, a)[0], 3: lifted(rows, a)[0] + lifted(rows, b)[0]}


def test_equal_marks_are_fitted_once(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, planes)
    marks = spark.createDataFrame([(0, i, "a", "full" if i < 50 else "tr", *SHAPES[i % 2], "m", "room") for i in range(60)], "site_id long, object_id long, photo string, kind string, x1 double, y1 double, x2 double, y2 double, model string, location string")
    got = {r.object_id: r for r in truth.build_objects(points, cams, marks, near=1.0).collect()}
    assert sum(seen) < 200 and len(got) == 60
    for i in range(2, 50):
        assert (got[i].corners, got[i].width_m) == (got[i % 2].corners, got[i % 2].width_m)
    own = inside(rows, (275.0, 275.0, 625.0, 625.0))
    normal = np.linalg.svd(own - own.mean(0))[2][2]
    assert abs(normal @ [got[0].normal[a] for a in "xyz"]) == pytest.approx(1, abs=1e-9)
    for c in got[0].corners:
        assert (np.array([c.x, c.y, c.z]) - own.mean(0)) @ normal == pytest.approx(0, abs=1e-9)
    assert got[50].width_m == pytest.approx(got[0].width_m) and list(got[50].corners[1]) == pytest.approx(list(got[0].corners[0]))


def test_equal_boxes_have_one_normal(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, planes)
    boxes = spark.createDataFrame([(0, "a", i, *SHAPES[i % 2]) for i in range(40)] + [(0, "a", 99, 0.0, 0.0, 1.0, 1.0)], BOXES)
    got = {r.box_id: (r.nx, r.ny, r.nz) for r in planes.surface_normals(points, cams, boxes).collect()}
    assert sum(seen) < 200 and len(got) == 41 and got[99] == (None, None, None)
    own = inside(rows, SHAPES[0])
    own = own[-own[:, 2] <= np.percentile(-own[:, 2], 60)]
    normal = np.linalg.svd(own - own.mean(0))[2][2]
    assert all(abs(normal @ got[i]) == pytest.approx(1, abs=1e-9) and got[i] == got[0] for i in range(0, 40, 2))


def test_objects_of_one_shape_are_projected_once(spark, wall):
    _, cams, _ = wall
    one = lambda x, n: ([(x, 0.2, -4.0), (x + 0.4, 0.2, -4.0), (x + 0.4, -0.2, -4.0), (x, -0.2, -4.0)], (x + 0.2, 0.0, -4.0), n)
    shapes = [one(0.0, (0.0, 0.0, 1.0)), one(1.0, (0.0, 0.0, 1.0)), one(1.0, None)]
    rows = [(s, i, f"m{i % 2}", "room", *shapes[i % 3]) for i in range(30) for s in (0, 1)]
    xyz = "struct<x:double,y:double,z:double>"
    objects = spark.createDataFrame(rows, f"site_id long, object_id long, model string, location string, corners array<{xyz}>, center {xyz}, normal {xyz}")
    for strict in (True, False):
        asked = []

        def found(few, strict=strict, asked=asked):
            asked.append(few.count())
            return truth.project_objects(few, cams, strict)

        got, want = truth.for_shapes(objects, found), truth.project_objects(objects, cams, strict)
        assert got.columns == want.columns and asked == [6] and want.count() == 30
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["object_appearances", "loose_projections", "truth_summary", "truth_files"])
def test_queries_project_each_shape_once(spark, name, monkeypatch):
    asked, project = [], truth.project_objects
    monkeypatch.setattr(truth, "project_objects", lambda objects, *more, **named: asked.append(objects.count()) or project(objects, *more, **named))
    QUERIES[name](spark, SF)
    assert asked == [2400]  # of 15,000 objects


def test_summary_counts_photos_once(spark):
    rows = [(0, "a", 1, "clear"), (0, "a", 1, "hard: small"), (0, "b", 1, "hard: small"), (1, "a", 1, "clear"), (0, "a", 2, "hard: small"), (None, "a", 2, "clear"), (0, "a", None, "clear")]
    got = {(r.object_id, r.photos, r.clear_photos, r.appearances) for r in truth.truth_summary(spark.createDataFrame(rows, "site_id long, photo string, object_id long, difficulty string")).collect()}
    assert got == {(1, 3, 2, 4), (2, 1, 1, 2), (None, 1, 1, 1), (None, 3, 3, 7)}
    assert [tuple(r) for r in truth.truth_summary(spark.createDataFrame([], "site_id long, photo string, object_id long, difficulty string")).collect()] == [(None, 0, 0, 0)]


def spots_of(spark):
    places = [(500.0, 500.0), (420.0, 580.0), (3.0, 3.0)]
    return places, spark.createDataFrame([(0, "a", i, *places[i % 3]) for i in range(60)] + [(0, "a", 7, 420.0, 580.0)], "site_id long, photo string, box_id long, u double, v double")


def test_equal_pixels_are_looked_up_once(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, lift)
    places, spots = spots_of(spark)
    got = lift.pixels_to_world(points, cams, spots, 150.0).collect()
    assert len(got) == 61 and sum(seen) < 100
    for r in got:
        own = inside(rows, (r.u, r.v, r.u, r.v), 150.0)
        front = own[-own[:, 2] <= np.percentile(-own[:, 2], 25) + 0.05] if len(own) else own
        assert r.n_points == (len(front) * (2 if r.box_id == 7 else 1) or None)
        assert r.n_points is None or np.allclose(np.median(front, 0), [r.x, r.y, r.z])


def test_equal_pixels_have_one_depth(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, lift)
    places, spots = spots_of(spark)
    got = lift.depth_at(points, cams, spots, F.when(F.col("u") > 450, 60.0).otherwise(90.0)).collect()
    assert len(got) == 61 and sum(seen) < 60
    for r in got:
        own = inside(rows, (r.u, r.v, r.u, r.v), 60.0 if r.u > 450 else 90.0)
        assert (r.depth_at is None) == (not len(own)) and (r.depth_at is None or r.box_id == 7 or r.depth_at == pytest.approx(np.percentile(-own[:, 2], 25)))


def test_equal_boxes_are_counted_once(spark, wall, monkeypatch):
    points, cams, rows = wall
    seen = counted(monkeypatch, lift)
    boxes = spark.createDataFrame([(0, "a", i, *SHAPES[i % 3]) for i in range(60)] + [(0, "a", 4, *SHAPES[0]), (0, "a", 99, 0.0, 0.0, 1.0, 1.0)], BOXES)
    got = {r.box_id: (r.n_points, round(r.depth, 9)) for r in lift.box_counts(points, cams, boxes).collect()}
    own = [inside(rows, s) for s in SHAPES]
    want = {i: (len(own[i % 3]), -own[i % 3][:, 2].max()) for i in range(60) if len(own[i % 3])}
    want[4] = len(own[0]) + len(own[1]), min(-own[0][:, 2].max(), -own[1][:, 2].max())
    assert got == want and sum(seen) < 300
