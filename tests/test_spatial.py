"""Exact areas, envelopes, rules over them and components, on turned polygons and planted cases."""

import math

import pytest
from pyspark.sql import functions as F

from scanlytics.functions import overlay as O
from scanlytics.operators import graph
from scanlytics.operators import spatial as P

POLYGON = "array<struct<x:double,y:double,z:double>>"
SURFACE = f"uuid string, seq int, category string, story int, room int, locator_id string, corners {POLYGON}, openings array<{POLYGON}>"
L = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]


def turned(points, angle=0.0, y=0.0):
    return [(x * math.cos(angle) - z * math.sin(angle), float(y), x * math.sin(angle) + z * math.cos(angle)) for x, z in points]


def box(x, z, w, d):
    return [(x, z), (x + w, z), (x + w, z + d), (x, z + d)]


def surface(seq, category, points, y=0.0, story=0, room=1, angle=0.3, holes=(), uuid="u"):
    return (uuid, seq, category, story, room, f"{uuid}::{category}::{seq}", turned(points, angle, y), [turned(h, angle, y) for h in holes])


@pytest.mark.parametrize("angle", [0.0, 0.37, 1.2, 2.9, math.pi / 2])
def test_areas_in_closed_form(spark, angle):
    region = lambda *polygons: [[turned(r, angle) for r in rings] for rings in polygons]
    cases = [
        (region([box(0, 0, 2, 2)]), region([box(1, 1, 4, 4)]), (4, 16, 1)),
        (region([L]), region([box(0.5, 0.5, 2.5, 2.5)]), (7, 6.25, 2.25)),
        (region([box(0, 0, 4, 4), box(1, 1, 2, 2)]), region([box(0, 0, 2, 2)], [box(0, 0, 2, 2)], [box(2, 2, 2, 2)]), (12, 8, 6)),  # a hole; a polygon twice
        (region([box(0, 0, 1, 1)]), region([box(1, 0, 1, 1)]), (1, 1, 0)),
        (region([[(0, 0), (4, 0), (0, 3)]]), region([[(0, 0), (4, 0), (4, 3)]]), (6, 6, 3)),
        ([], region([L]), (0, 7, 0)),
        (region([[(0, 0), (1, 1)]]), None, (0, 0, 0)),
    ]
    rows = [(i, a, b) for i, (a, b, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, a array<array<{POLYGON}>>, b array<array<{POLYGON}>>")
    got = df.select("i", O.overlaid(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, cases):
        assert tuple(r.o) == pytest.approx(want, abs=1e-9)
    assert df.limit(0).select(O.overlaid(F.col("a"), F.col("b"))).collect() == []


def test_mitred_buffer(spark):
    spike = [(0, 0), (10, 0.1), (0, 0.2)]
    rows = [(turned(p, a),) for p in (box(0, 0, 2, 2), box(0, 0, 2, 2)[::-1], L, spike) for a in (0.0, 0.5)]
    wide = spark.createDataFrame(rows, f"c {POLYGON}").coalesce(1).select(O.buffered(F.col("c"), 0.3).alias("w")).cache()
    wide.count()
    got = [r.o.left for r in wide.select(O.overlaid(F.col("w"), F.col("w")).alias("o")).collect()]
    assert got[:6] == pytest.approx([2.6**2] * 4 + [7 + 16 * 0.3 + 5 * 0.09 - 0.09] * 2, abs=1e-9)
    assert got[6] == pytest.approx(got[7], abs=1e-9) and 1 < got[6] < 1 + 0.3 * 21  # the sharp corner is cut off


def test_overlaps_and_cover(spark):
    rows = [surface(1, "floor", box(0, 0, 10, 10)), surface(2, "ceiling", box(0, 0, 6, 10), 3), surface(3, "ceiling", box(5, 0, 3, 10), 3, holes=[box(5, 0, 1, 1)]), surface(4, "ceiling", box(20, 20, 1, 1)), surface(5, "floor", box(50, 50, 1, 1)), surface(6, "floor", box(0, 0, 1, 1), uuid="v")]
    df = spark.createDataFrame(rows, SURFACE)
    floors, ceilings = df.where("category = 'floor'"), df.where("category = 'ceiling'")
    assert {(r.uuid, r.left, r.right): round(r.area, 6) for r in P.overlay_area(floors, ceilings).collect()} == {("u", 1, 2): 60.0, ("u", 1, 3): 29.0}
    got = {(r.uuid, r.seq): (round(r.area, 6), round(r.share, 6)) for r in P.covered(floors, ceilings).collect()}
    assert got == {("u", 1): (100.0, 0.8), ("u", 5): (1.0, 0.0), ("v", 6): (1.0, 0.0)}  # the hole lies under the other ceiling
    assert P.covered(floors.limit(0), ceilings).collect() == []
    report = {(r.kind, r.bin): r.n for r in P.coverage_report(P.covered(floors, ceilings)).collect()}
    assert report == {("all", ""): 3, ("share", "<= 0.25"): 1, ("share", "> 0.5"): 2, ("area", "<= 1"): 2, ("area", "<= 20"): 1}


def test_coverage_gap_rule(spark):
    """The tests of the rule: a low ceiling does not count, floors of a room are one, rooms whose floors are apart are left out."""
    floors = [surface(1, "floor", box(0, 0, 4, 4), room=1), surface(2, "floor", box(4, 0, 4, 4), room=1), surface(3, "floor", box(20, 0, 4, 4), room=2), surface(4, "floor", box(40, 0, 2, 2), room=3), surface(5, "floor", box(50, 0, 2, 2), room=3), surface(6, "floor", box(60, 0, 0.5, 0.5), room=4)]
    walls = [(*surface(10, "wall", box(0, 0, 1, 1))[:6], [(0.0, 0.0, 0.0), (1.0, 2.5, 0.0), (0.0, 2.5, 0.0)], [])]
    ceilings = [surface(20, "ceiling", box(0, 0, 8, 4), 1.9), surface(21, "ceiling", box(0, 0, 8, 1), 2.0), surface(22, "ceiling", box(20, 0, 4, 1.9), 0.1)]
    df = spark.createDataFrame(floors + walls + ceilings, SURFACE)
    got = {r.room: (r.severity, r.floor_area, r.evidence) for r in P.coverage_gaps(*[df.where(f"category = '{c}'") for c in ("floor", "ceiling", "wall")]).collect()}
    assert got == {1: ("med", 32.0, 0.25), 2: ("med", 16.0, 0.475)}


def test_out_of_envelope(spark):
    """The smaller part of the floors is no envelope; half a metre is given on all sides, corners too."""
    rows = [surface(1, "floor", box(0, 0, 6, 6)), surface(2, "floor", box(6.9, 0, 2, 6)), surface(3, "floor", box(30, 0, 3, 3)), surface(4, "ceiling", box(-0.5, -0.5, 9.9, 7)), surface(5, "wall", box(30, 0, 3, 3)), surface(6, "gap", box(0, 0, 12.0, 1)), surface(7, "ceiling", box(0, 0, 9.6, 1)), surface(8, "wall", box(9, 0, 2, 1)), surface(9, "ceiling", box(0, 0, 1, 1), uuid="none")]
    df = spark.createDataFrame(rows, SURFACE)
    got = {r.seq: (r.severity, r.outside, r.share) for r in P.out_of_envelope(df.where("category != 'floor'"), df.where("category = 'floor'")).collect()}
    assert got == {5: ("high", 9.0, 1.0), 6: ("med", 2.6, round(2.6 / 12, 6)), 8: ("high", 1.6, 0.8)}


def test_ceiling_below_floor_rule(spark):
    """The floor of the story whose walls hold the ceiling counts first, with its highest corner."""
    walls = [("u", 1, "wall", s, 1, "w", [(0.0, y, 0.0), (1.0, y + 2.5, 0.0), (1.0, y, 0.0)], []) for s, y in ((0, 0.0), (1, 3.0))]
    floors = [surface(2, "floor", box(0, 0, 4, 4), 5.0, 1), surface(3, "floor", box(0, 0, 4, 4), 0.0, 0), surface(4, "floor", box(20, 0, 4, 4), 1.0, None)]
    ceilings = [surface(5, "ceiling", box(0, 0, 3, 3), 2.4), surface(6, "ceiling", box(0, 0, 3, 3), 4.0), surface(7, "ceiling", box(20, 0, 3, 3), 0.5), surface(8, "ceiling", box(20, 0, 3, 3), 0.96), surface(9, "ceiling", [(20, 0), (24, 0), (24, 1), (21, 1), (21, 8), (20, 8)], -9.0)]
    df = spark.createDataFrame(walls + floors + ceilings, SURFACE)
    got = {r.seq: (r.severity, r.evidence) for r in P.ceiling_below_floor(*[df.where(f"category = '{c}'") for c in ("ceiling", "floor", "wall")]).collect()}
    assert got == {6: ("high", 1.0), 7: ("high", 0.5)}  # the point inside the angled ceiling lies beyond the floor


def test_components(spark):
    chain = [("u", i, i + 1) for i in range(1, 10_000)] + [("v", 1, 2), ("v", 5, 4), ("v", 7, 7)]
    nodes = [("u", i) for i in range(1, 10_001)] + [("v", i) for i in (1, 2, 4, 5, 7, 9)]
    made = []
    keep, graph.written = graph.written, lambda rows, label: made.append(1) or keep(rows, label)
    try:
        got = {(r.uuid, r.node): r.component for r in graph.connected(spark.createDataFrame(nodes, "uuid string, node int"), spark.createDataFrame(chain, "uuid string, a int, b int")).collect()}
    finally:
        graph.written = keep
    assert len(made) < 20 and len(got) == len(nodes)
    assert all(c == 1 for (u, _), c in got.items() if u == "u") and [got["v", i] for i in (1, 2, 4, 5, 7, 9)] == [1, 1, 4, 4, 7, 9]
    assert graph.connected(spark.createDataFrame(nodes[-2:], "uuid string, node int"), spark.createDataFrame([], "uuid string, a int, b int")).count() == 2
