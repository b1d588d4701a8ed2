"""Payloads, field profiles, heights, neighbours, rotation groups, overlaps and roof planes: plain versions and planted cases."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlytics.operators import heights as H
from scanlytics.operators import neighbours as N
from scanlytics.operators import obliques as B
from scanlytics.operators import overlaps as L
from scanlytics.operators import rotations as R
from scanlytics.plans import registry
from scanlytics.plans.capture_queries import rooms
from scanlytics.sources import payloads as P

POLYGON = "array<struct<x:double,y:double,z:double>>"
D = "/root/testdata/sf0.001"


def corners(points, y=0.0):
    return [(float(x), float(y), float(z)) for x, z in points]


def box(x, z, w, d, y=0.0):
    return corners([(x, z), (x + w, z), (x + w, z + d), (x, z + d)], y)


def test_payloads_of_every_shape(spark, tmp_path):
    p = lambda n, **more: {"locator_id": n, "corners": [{"x": 0, "y": 1, "z": 2}, {"x": 1.5, "y": 1, "z": 2}, {"x": 1, "y": 1, "z": 3}], **more}
    hole = [[{"x": 0, "y": 0, "z": 0}] * 3]
    docs = [
        {"uuid": "a", "rooms": [{"locator_id": "r0", "story": 0, "floor": p("f0"), "walls": [p("w0", cutouts=hole), p("w1")]}, {"story": 1, "floor": [p("f1"), p("f2", adjacency="x"), 7]}, {"floor": None}], "ceiling": [p("c0", plane={"a": 0, "b": 1, "c": 0, "d": 3}, holes=hole), {"locator_id": "c1"}], "gaps": []},
        {"uuid": "b", "dormer_faces": [p("d0", cutouts=hole)], "rooms": [], "knee_walls": None},
        {"uuid": "c"}, {"nothing": 1},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, docs)) + "\n\nnot json\n")
    good, bad = P.read_documents(spark, f"file://{tmp_path}/p.json")
    assert good.count() == 3 and sorted(r.reason for r in bad.collect()) == ["no uuid", "not JSON"]
    got = {r.locator_id: r for r in P.payload_surfaces(good).collect()}
    assert set(got) == {"f0", "f1", "f2", "w0", "w1", "c0", "c1", "d0"}
    assert (got["f0"].category, got["f0"].story, got["f0"].room, got["f0"].idx, got["f0"].room_locator) == ("floor", 0, 0, 0, "r0")
    assert (got["f2"].room, got["f2"].idx, got["f2"].adjacency, got["f2"].story) == (1, 1, "x", 1)
    assert [len(got[k].openings) for k in ("w0", "w1", "c0", "c1", "d0")] == [1, 0, 1, 0, 1] and got["c1"].corners == [] and got["c0"].plane.b == 1.0 and got["w0"].corners[1].x == 1.5
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "x.json").write_text(json.dumps(docs[0], indent=2))
    assert P.read_payloads(spark, f"file://{tmp_path}/whole", whole_files=True).count() == 7


def test_profile_of_any_depth(spark):
    deep = {"v": 1}
    for _ in range(30):
        deep = {"d": deep}
    texts = [json.dumps(x) for x in ({"a": 1, "b": [1, "x", None, [True]], "c": {}}, {"a": "s", "b": [], "c": {"e": 1.5}}, deep, 7)] + [None, "{broken"]
    got = {r.path: (r.types, r.seen, r.samples) for r in P.profile_fields(spark.createDataFrame([(t,) for t in texts], "json string")).collect()}
    assert got["a"] == ({"integer": 1, "string": 1}, 2, ["1", "s"])
    assert got["b[]"] == ({"integer": 1, "string": 1, "null": 1}, 3, [None, "1", "x"]) or got["b[]"][0] == {"integer": 1, "string": 1, "null": 1}
    assert got["b[][]"][0] == {"boolean": 1} and got["b"][0] == {"array": 1} and got["c"][0] == {"object": 1} and got["c.e"][0] == {"number": 1} and got[""][0] == {"integer": 1}
    assert got[".".join(["d"] * 30) + ".v"][1] == 1
    assert P.profile_fields(spark.createDataFrame([], "json string")).collect() == []


def test_heights_ties_and_points_outside(spark):
    kind = f"uuid string, wing int, seq int, plane struct<a:double,b:double,c:double,d:double>, corners {POLYGON}"
    flat = lambda y: (0.0, 1.0, 0.0, float(y))
    planes = spark.createDataFrame([("u", 0, 1, flat(3), box(0, 0, 4, 4)), ("u", 0, 2, flat(3), box(0, 0, 4, 4)), ("u", 0, 3, flat(1), box(0, 0, 4, 4)), ("u", 0, 4, (1.0, 0.0, 0.0, 0.0), box(0, 0, 4, 4)), ("u", 1, 5, flat(9), box(0, 0, 9, 9)), ("u", 0, 6, (-0.6, 0.8, 0.0, 0.0), box(0, 0, 4, 4)), ("v", 0, 7, flat(5), box(0, 0, 4, 4))], kind)
    floors = spark.createDataFrame([("u", 0, 1, box(0, 0, 2, 4, 2.0)), ("u", 0, 2, box(3, 0, 1, 1, 0.5)), ("v", 0, 3, [])], f"uuid string, wing int, seq int, corners {POLYGON}")
    wings = spark.createDataFrame([("u", 0, box(0, 0, 5, 5)), ("u", 1, box(0, 0, 9, 9)), ("v", 0, box(0, 0, 5, 5))], f"uuid string, wing int, corners {POLYGON}")
    points = spark.createDataFrame([("u", 1, 1.0, 1.0), ("u", 2, 2.5, 2.0), ("u", 3, 20.0, 1.0), ("u", 4, 8.0, 8.0), ("v", 5, 1.0, 1.0)], "uuid string, point int, x double, z double")
    low = {r.point: (round(r.y, 6), r.chosen, list(r.contenders), r.reason) for r in H.ceiling_y_at(points, planes, floors, wings).collect()}
    assert low == {1: (3.0, 1, [1, 2], "min_y_above_floor"), 2: (1.0, 3, [3, 6, 1, 2], "min_y_above_floor")}  # the second point stands on no floor: the wing's lowest counts
    high = {r.point: (round(r.y, 6), r.chosen, list(r.contenders), r.reason) for r in H.roof_y_at(points, planes, wings).collect()}
    assert high == {1: (3.0, 1, [1, 2, 3, 6], "max_y"), 2: (3.0, 1, [1, 2, 6, 3], "max_y"), 4: (9.0, 5, [5], "single_candidate"), 5: (5.0, 7, [7], "single_candidate")}


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(size=(300, 6)), np.zeros((20, 6))].round(1)  # ties and copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, vector array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)).round(9)
    want = {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:7] for i in range(len(x))}
    for block in (50, 4096):
        got = {}
        for r in N.nearest(df, 7, block).orderBy("key", "rank").collect():
            got.setdefault(r.key, []).append((round(r.distance, 9), r.other))
        assert got == {i: [(pytest.approx(a, abs=1e-8), b) for a, b in w] for i, w in want.items()}
    few = df.limit(3)
    assert N.nearest(few, 7).count() == 6 and N.nearest(df.limit(0), 7).count() == 0
    lof = {r.key: r.factor for r in N.local_outlier_factor(N.nearest(spark.createDataFrame([(i, [float(i % 10), i // 10 * 1.0]) for i in range(100)] + [(100, [50.0, 50.0])], "key int, vector array<double>"), 8)).collect()}
    assert lof[100] > 5 and abs(lof[55] - 1) < 0.2
    plain = N.standardised(spark.createDataFrame([(1, 1.0, None), (2, 3.0, 5.0), (3, None, 5.0)], "key int, a double, `b.c` double"), "key", ["a", "b.c"])
    assert [r.vector for r in plain.orderBy("key").collect()][0] == pytest.approx([-math.sqrt(1.5), 0.0])


def plain_groups(turns, threshold=1.0):
    firsts, out = [], []
    for t in turns:
        angles = [math.degrees(math.acos(max(-1.0, min(1.0, (sum(a * b for a, b in zip(f, t)) - 1) / 2)))) for f in firsts]
        near = [i for i, a in enumerate(angles) if a < threshold]
        out.append(near[0] if near else len(firsts))
        if not near:
            firsts.append(t)
    return out


def test_rotation_groups_against_a_walk(spark):
    rng, rows = random.Random(4), []
    for floor in range(1000):
        for seq in range(1 if floor % 7 == 0 else 400 if floor == 5 else rng.randrange(1, 9)):
            yaw = math.radians(rng.choice([0, 0.7, 1.4, 90, 90.9]) + rng.random() * 0.3)
            t = [math.cos(yaw), 0.0, -math.sin(yaw), 0.0, 0.0, 1.0, 0.0, 0.0, math.sin(yaw), 0.0, math.cos(yaw), 0.0, 1.0, 2.0, 3.0, 1.0]
            rows.append((f"u{floor % 13}", floor, seq, None if rng.random() < 0.1 else float(rng.randrange(50)), t))
    rows.append(("u0", 0, 99, 1.0, [1.0] * 3))
    df = spark.createDataFrame(rows, "uuid string, floor int, seq int, created double, t array<double>")
    got = {(r.uuid, r.floor, r.seq): r.rotation_group for r in R.floor_rotation_groups(df).collect()}
    by: dict = {}
    for u, f, s, c, t in rows[:-1]:
        by.setdefault((u, f), []).append((c or 0.0, s, [t[i] for i in R.TURN]))
    want = {}
    for (u, f), v in by.items():
        v.sort(key=lambda r: r[:2])
        want |= {(u, f, s): g for (_, s, _), g in zip(v, plain_groups([t for _, _, t in v]))}
    assert got == want and max(want.values()) > 2
    _, floors = R.rotation_summary(df.withColumn("yaw", F.lit(0.0)), R.floor_rotation_groups(df))
    assert floors.where("restart").count() == len({k[:2] for k, g in want.items() if g > 0}) and floors.count() == 1000
    assert R.floor_rotation_groups(rooms(spark, D).withColumnRenamed("floor_type", "floor").limit(0)).count() == 0


def test_every_class_of_overlap_is_found(spark):
    rows = registry.queries()["p8_overlap_classes"](spark, "/root/testdata/sf0.01").where("n > 0").groupBy("class").count().collect()
    assert {r["class"] for r in rows} == set(L.CLASSES)


def test_nested_floors_are_no_overlap(spark):
    kind = f"uuid string, seq int, category string, story int, room int, locator_id string, kind string, plane struct<a:double,b:double,c:double,d:double>, corners {POLYGON}, openings array<{POLYGON}>"
    floor = lambda seq, room, *b: ("u", seq, "floor", 0, room, f"f{seq}", "", None, box(*b), [])
    df = spark.createDataFrame([floor(1, 1, 0, 0, 9, 9), floor(2, 2, 1, 1, 2, 2), floor(3, 3, 8, 8, 3, 3)], kind)
    got = {r["class"]: (r.n, r.samples) for r in L.overlap_classes(df).collect()}
    assert got["floor_overlap"] == (1, ["room 1|story=0|area=1.00m2"]) and sum(n for n, _ in got.values()) == 1


def test_shapes_in_common(spark):
    shape = lambda seq, *b: ("u", seq, box(*b))
    table = lambda rows: spark.createDataFrame(rows, f"uuid string, seq int, corners {POLYGON}")
    out = L.iou_features(table([shape(1, 0, 0, 4, 4), shape(2, 90, 90, 1, 1), ("v", 3, box(0, 0, 1, 1))]), table([shape(1, 0, 0, 8, 4)]), table([shape(1, 0, 0, 4, 4), shape(2, 0, 0, 8, 8)]), table([shape(1, 0, 0, 2, 4), shape(2, 1, 0, 2, 4)]))
    got = {r.seq: r.asDict() for r in out.collect()}
    assert [got[1][k] for k in ("iou_footprint", "cover_footprint", "iou_part", "cover_part", "iou_roof", "cover_roof", "n_roofs", "roof_union")] == pytest.approx([0.5, 1.0, 0.25, 1.0, 0.5, 0.5, 2, 12.0])
    assert got[2]["iou_footprint"] == 0.0 and got[2]["iou_part"] is None and got[2]["n_roofs"] == 0 and got[3]["iou_footprint"] is None


def test_rooms_that_hang_together(spark):
    facing = spark.createDataFrame([("u", 1, 0, 2, 0, 2.0), ("u", 2, 0, 1, 0, 1.0), ("u", 3, 1, 4, -1, 0.0), ("u", 5, 0, 5, 1, 3.0)], "uuid string, room_a int, wall_a int, room_b int, wall_b int, overlap_m double")
    doors = spark.createDataFrame([("u", 3, 1), ("u", 4, -1), ("u", 9, 0)], "uuid string, room int, wall int")
    graph = L.room_graph(facing, doors)
    assert {tuple(r) for r in graph.collect()} == {("u", 1, 2, 3.0, False), ("u", 3, 4, 0.0, True)}
    nodes = spark.createDataFrame([("u", i) for i in range(1, 6)], "uuid string, room int")
    assert {r.node: r.component for r in L.room_graph_components(nodes, graph).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_opposing_planes_around_north(spark):
    kind = "uuid string, seq int, azimuth double, incl double, area double, high double"
    planes = spark.createDataFrame([("u", 1, 359.0, 30.0, 9.0, 5.0), ("u", 2, 181.0, 35.0, 9.0, 5.0), ("u", 3, 2.0, 50.0, 1.0, 5.0), ("u", 4, 140.5, 30.0, 1.0, 5.0), ("v", 5, 180.0, 30.0, 1.0, 5.0), ("u", 6, None, 30.0, 1.0, 5.0)], kind)
    assert {(r.a, r.b) for r in B.opposing_pairs(planes).collect()} == {(1, 2), (1, 4)}
    roofs = spark.createDataFrame([("u", "Gable"), ("v", "gable"), ("w", None)], "uuid string, roof_type string")
    got = {r.seq: (r.keep_a, r.keep_b) for r in B.oblique_priors(planes, roofs).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (False, False), 4: (True, True), 5: (True, True), 6: (False, False)}
    hip = spark.createDataFrame([("u", i, a, 30.0, 0.5, 5.0) for i, a in enumerate((0.0, 180.0, 90.0, 270.0, 45.0))], kind)
    kept = {r.seq for r in B.oblique_priors(hip, spark.createDataFrame([("u", "hip")], "uuid string, roof_type string")).where("keep_b").collect()}
    assert kept == {0, 1, 2, 3}
    by_type, dist, top = B.prior_summary(B.oblique_priors(planes, roofs))
    assert {(r["filter"], r.dropped): r.buildings for r in dist.collect()} == {("a", 2): 1, ("a", 0): 1, ("b", 2): 1, ("b", 0): 1} and [tuple(r) for r in top.collect()] == [("u", "gable", 2)]


def test_pieces_of_one_source_are_one_surface(spark):
    kind = f"uuid string, source_idx int, seq int, locator_id string, plane struct<a:double,b:double,c:double,d:double>, corners {POLYGON}"
    tilt = (0.6, -0.8, 0.0, 0.0)
    rows = [("u", 1, 1, "a", tilt, box(0, 0, 2, 2, 1.0)), ("u", 1, 2, "b", tilt, box(1, 0, 2, 2, 3.0) + corners([(0.5, 1)], 4.0)), ("u", None, 3, "c", tilt, box(0, 0, 1, 1)), ("u", 2, 4, "d", tilt, corners([(0, 0), (1, 1), (2, 2)]))]
    got = B.oblique_surfaces(spark.createDataFrame(rows, kind)).collect()
    assert [(r.seq, r.n_pieces, r.low, r.high, r.locator_id) for r in got] == [(1, 2, 1.0, 4.0, "b")]
    assert got[0].azimuth == pytest.approx(270.0) and got[0].incl == pytest.approx(math.degrees(math.acos(0.8))) and got[0].area == pytest.approx(6.25, abs=0.3)
