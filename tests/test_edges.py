"""Nearest segments, edge classes, dormers without a slope and walls below their story's height, against plain versions."""

import math
import random

from scanlytics.operators import edges as E

POLYGON = "array<struct<x:double,y:double,z:double>>"
POINT = "struct<x:double,y:double,z:double>"


def apart(p, a, b, axes):
    d = [b[k] - a[k] for k in axes]
    sq = sum(x * x for x in d)
    t = max(0.0, min(1.0, sum(x * (p[k] - a[k]) for x, k in zip(d, axes)) / sq)) if sq > 1e-12 else 0.0
    return math.sqrt(sum((p[k] - a[k] - t * x) ** 2 for x, k in zip(d, axes)))


def test_nearest_of_many_segments(spark):
    rng = random.Random(8)
    point = lambda s: (rng.uniform(0, s), rng.uniform(0, 3), rng.uniform(0, s))
    segments = []
    for _ in range(2000):
        a = point(60)
        segments.append(("u", a, (a[0] + rng.uniform(-4, 4), a[1], a[2] + rng.uniform(-4, 4))))
    points = [("u", i, point(60)) for i in range(150)] + [("u", 900, (300.0, 0.0, -40.0)), ("v", 1, (0.0, 0.0, 0.0))]
    p, s = spark.createDataFrame(points, f"uuid string, i int, p {POINT}"), spark.createDataFrame(segments, f"uuid string, a {POINT}, b {POINT}")
    for axes, at in (("xz", (0, 2)), ("xyz", (0, 1, 2))):
        got = {r.i: r.distance for r in E.nearest_segment(p, s, ["uuid"], ["i"], axes).collect()}
        assert set(got) == {i for u, i, _ in points if u == "u"}
        for _, i, x in points[:-1]:
            assert abs(got[i] - min(apart(x, a, b, at) for _, a, b in segments)) < 1e-9
    assert E.nearest_segment(p.limit(0), s, ["uuid"], ["i"]).collect() == []


def test_wall_tops_and_trust(spark):
    wall = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 2.5, 0.0), (0.0, 2.45, 0.0)]
    walls = spark.createDataFrame([("u", 1, wall), ("u", 2, wall[:2])], f"uuid string, room int, corners {POLYGON}")
    assert E.wall_top_segments(walls).count() == 2
    ceilings = spark.createDataFrame([("u", 1, 1, [(1.0, 2.5, 0.1), (2.0, 2.5, 0.2), (2.0, 2.5, 3.0)]), ("u", 2, 2, [(0.0, 0.0, 0.0)] * 3), ("u", 1, 3, [(0.0, 0.0, 0.0)] * 2)], f"uuid string, room int, seq int, corners {POLYGON}")
    planes, rooms = E.wall_top_trust(ceilings, walls)
    got = planes.collect()
    assert [(r.seq, r.n_corners, round(r.trust, 6)) for r in got] == [(1, 3, round(2 / 3, 6))] and 0.19 < got[0].p50 < 0.21 and rooms.count() == 1


def turned(points, angle):
    return [(x * math.cos(angle) - z * math.sin(angle), y, x * math.sin(angle) + z * math.cos(angle)) for x, y, z in points]


def test_ridge_eave_and_isolated_edges(spark):
    """A gable roof, turned: the ridge is shared in both directions, the eaves lie on the footprint, a level piece inside is isolated."""
    rows = []
    for i, angle in enumerate((0.0, 0.6, 2.0)):
        left, right = [(0, 3, 0), (4, 5, 0), (4, 5, 9), (0, 3, 9)], [(8.1, 3, 9), (4.1, 5.1, 9.1), (4.1, 5.1, 0), (8.1, 3, 0)]
        flat = [(2, 3, 2), (3, 3, 2), (3, 3, 3.5), (2, 3, 3.5)]
        rows += [(f"u{i}", 0, k, turned(c, angle)) for k, c in enumerate((left, right, flat))] + [(f"u{i}", 1, 5, turned(left, angle)), (f"u{i}", 0, 6, turned([(0, 0, 0), (0, 9, 0), (0, 9, 1)], angle))]
    planes = spark.createDataFrame([(u, s, k, [tuple(map(float, p)) for p in c]) for u, s, k, c in rows], f"uuid string, story int, seq int, corners {POLYGON}")
    outline = [(0.0, 0.0, 0.0), (8.1, 0.0, 0.0), (8.1, 0.0, 9.0), (0.0, 0.0, 9.0)]
    feet = spark.createDataFrame([(f"u{i}", turned(outline, a)) for i, a in enumerate((0.0, 0.6, 2.0))], f"uuid string, corners {POLYGON}")
    classes = E.edge_classes(planes, feet)
    for i in range(3):
        got = {(r.story, r.seq, r.side): (r.label, r.partner) for r in classes.where(f"uuid = 'u{i}'").collect()}
        assert got[0, 0, 1] == ("ridge_or_hip", 1) and got[0, 1, 1] == ("ridge_or_hip", 0) and got[0, 0, 3] == ("eave", None) and got[0, 1, 3] == ("eave", None)
        assert got[1, 5, 1] == ("eave", None) and all(got[0, 2, k] == ("isolated", None) for k in range(4)) and len(got) == 10
    totals = {r.uuid: (r.n_edges, r.n_level, r.n_sloped, r.ridge_or_hip, r.eave, r.isolated) for r in E.edge_totals(planes, classes).collect()}
    assert totals == {f"u{i}": (16, 10, 6, 2, 4, 4) for i in range(3)}


def test_dormers_and_slopes(spark):
    kind = f"uuid string, seq int, locator_id string, corners {POLYGON}"
    slope = [(0.0, 2.0, 0.0), (4.0, 5.0, 0.0), (4.0, 5.0, 4.0), (0.0, 2.0, 4.0)]
    level = [(0.0, 3.0, 0.0), (4.0, 3.0, 0.0), (4.0, 3.0, 4.0)]
    box = lambda x, y, h=1.0: [(x, y, 1.0), (x + 1, y + h, 1.0), (x + 1, y + h, 2.0), (x, y, 2.0)]
    faces = spark.createDataFrame([("u", 1, "a", box(1.0, 3.0)), ("u", 2, "b", box(4.2, 3.0)), ("u", 3, "c", box(4.5, 3.0)), ("u", 4, "d", box(90.0, 3.0)), ("u", 5, "e", box(1.0, 15.0)), ("v", 6, "f", box(0.0, 0.0)), ("u", 7, "g", [(0.0, 0.0, 0.0)]), ("u", 8, "h", box(1.0, 5.2))], kind)
    ceilings = spark.createDataFrame([("u", 1, "s", slope), ("v", 2, "t", level)], kind)
    got = {r.seq: r.evidence for r in E.dormer_without_host_slope(faces, ceilings).collect()}
    assert got == {3: 0.5, 4: 86.0, 5: 10.0, 6: None}
    assert {r.seq for r in E.dormer_without_host_slope(faces, ceilings.limit(0)).collect()} == set(range(1, 9))


def test_walls_below_their_height(spark):
    def wall(seq, x, size, top, z=0.0, bottom=0.0, angle=0.4):
        return ("u", 0, seq, turned([(x, bottom, z), (x + size, bottom, z), (x + size, top, z), (x, top, z)], angle))

    rows = [wall(1, 0, 8, 2.5), wall(2, 8.5, 8, 2.55), wall(3, 16.6, 1, 2.2), wall(4, 19.2, 1, 2.2), wall(5, 16.6, 1, 2.2, bottom=0.2), wall(6, 16.6, 1, 2.48), wall(7, 16.6, 1, 1.9), wall(8, 3, 1, 2.2, z=0.1), wall(9, 3, 1, 2.2, z=0.3), wall(10, 0, 0.01, 9.0), wall(11, 0, 5, 0.05)]
    df = spark.createDataFrame(rows, f"uuid string, story int, seq int, corners {POLYGON}")
    records = E.wall_records(df)
    assert records.count() == 9
    (cohort,) = E.dominant_height(records).collect()
    centre = (8 * 2.5 + 8 * 2.55 + 2.48) / 17
    assert abs(cohort.dominant_y - centre) < 1e-9 and abs(cohort.coverage - 17 / 23) < 1e-9 and cohort.cohort_floor == 0.0
    got = {r.seq: (r.floor_pass, r.all_pass) for r in E.low_walls(records, E.dominant_height(records, least=0.7)).collect()}
    assert got == {3: (True, True), 4: (True, False), 5: (False, False), 8: (True, True), 9: (True, False)}
    assert E.dominant_height(records, least=0.8).collect() == [] and E.low_walls(records.limit(0), E.dominant_height(records)).collect() == []


def test_ends_just_beyond_the_limit_make_no_ridge(spark):
    plane = lambda x0, x1, y1: [(x0, 3.0, 0.0), (x0, 3.0, 1.0), (x1, y1, 1.0), (x1, y1, 0.0)]
    # 1.3 - 1.0 is above 0.3 in doubles, 2.3 - 2.0 below
    rows = spark.createDataFrame([("u", 0, 1, plane(1.3, 4.0, 6.0)), ("u", 0, 2, plane(1.0, -3.0, 9.0)), ("v", 0, 1, plane(2.3, 5.0, 6.0)), ("v", 0, 2, plane(2.0, -3.0, 9.0))], f"uuid string, story int, seq int, corners {POLYGON}")
    got = {(r.uuid, r.seq, r.partner) for r in E.edge_classes(rows, rows.limit(0).select("uuid", "corners")).where("label = 'ridge_or_hip'").collect()}
    assert got == {("v", 1, 2), ("v", 2, 1)}
