"""Buildings with few rows meet without a grid and without rounds; the answers are those of the grid and of the rounds."""

import math
import random

from conftest import SMALL
from pyspark.sql import functions as F

from scanlytics.functions import geometry as G
from scanlytics.operators import edges as E
from scanlytics.operators import graph, spatial
from scanlytics.plans.surface_queries import surfaces

POLYGON = "array<struct<x:double,y:double,z:double>>"


def _components(nodes, links):
    head = {n: n for n in nodes}

    def top(n):
        while head[n] != n:
            n = head[n]
        return n

    for u, a, b in links:
        x, y = top((u, a)), top((u, b))
        head[max(x, y)] = min(x, y)
    return {n: top(n)[1] for n in nodes}


def test_components_of_few_links_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [(u, n) for u in range(300) for n in range(12)]
    links = [(u, rng.randrange(12), rng.randrange(12)) for u in range(300) for _ in range(rng.randrange(12))]
    rows, pairs = spark.createDataFrame(nodes, "uuid long, node long"), spark.createDataFrame(links, "uuid long, a long, b long")
    want = _components(nodes, links)
    by_rounds = graph._rounds
    monkeypatch.setattr(graph, "_rounds", lambda links: 1 / 0)
    assert {(r.uuid, r.node): r.component for r in graph.connected(rows, pairs).collect()} == want
    monkeypatch.setattr(graph, "_rounds", by_rounds)
    monkeypatch.setattr(graph, "FEW", 6)  # some buildings by rounds, some at once
    assert {(r.uuid, r.node): r.component for r in graph.connected(rows, pairs).collect()} == want


def test_a_large_surface_is_not_dealt_to_squares(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_grid_pairs", lambda *a: 1 / 0)
    box = lambda a, b: [(a, 0.0, a), (b, 0.0, a), (b, 0.0, b), (a, 0.0, b)]
    left = spark.createDataFrame([("u", 1, box(0.0, 3.0)), ("u", 2, box(900.0, 903.0))], f"uuid string, seq int, corners {POLYGON}")
    right = spark.createDataFrame([("u", 1, box(-500.0, 500.0))], f"uuid string, seq int, corners {POLYGON}")
    assert [(r.left, r.right, r.area) for r in spatial.overlay_area(left, right).collect()] == [(1, 1, 9.0)]


def test_grid_and_direct_meeting_agree(spark, monkeypatch):
    rng = random.Random(9)
    def some(n):
        out = []
        for i in range(n):
            x, z, w, d = rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(0.5, 9), rng.uniform(0.5, 9)
            out.append((rng.choice("uvw"), i, [(x, 0.0, z), (x + w, 0.0, z + 1), (x + w, 0.0, z + d + 1), (x, 0.0, z + d)]))
        return spark.createDataFrame(out, f"uuid string, seq int, corners {POLYGON}")
    left, right = some(60).localCheckpoint(), some(60).localCheckpoint()
    points = left.select("uuid", "seq", F.col("corners")[0].alias("p"))
    lines = right.select("uuid", F.col("corners")[0].alias("a"), F.col("corners")[1].alias("b"))

    def answers():
        pairs = {(r.uuid, r.left, r.right): round(r.area, 7) for r in spatial.overlay_area(left, right).collect()}
        cover = {(r.uuid, r.seq): (round(r.area, 7), round(r.share, 7)) for r in spatial.covered(left, right).collect()}
        held = sorted(tuple(r) for r in spatial.held_by(points.select("uuid", "seq", "p.x", "p.z"), right.withColumnRenamed("seq", "of")).collect())
        near = {(r.uuid, r.seq): round(r.distance, 9) for r in E.nearest_segment(points, lines, ["uuid"], ["seq"]).collect()}
        return pairs, cover, held, near

    direct = answers()
    monkeypatch.setattr(spatial, "CROWD", 0)
    assert answers() == direct
    monkeypatch.setattr(spatial, "CROWD", 39)  # some by the grid, some directly
    assert answers() == direct
    assert all(direct)


def test_corners_are_worked_out_once_a_row(spark):
    rows = surfaces(spark, SMALL).select("uuid", G.area_xz(F.col("corners")), G.unit_normal(F.col("corners")), G.box(F.col("corners"))).where("uuid > 0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("% 29") == 1


def test_walls_on_one_place_are_tried_once(spark, monkeypatch):
    from scanlytics.operators import edges as E

    rng, shapes, rows = random.Random(7), [], []
    for i in range(40):
        by = rng.choice([0.0, 5.0, 90.0]) * math.pi / 180
        shapes.append((rng.choice([0.5, 1.0, 3.0]), math.cos(by), math.sin(by), rng.uniform(0, 6), rng.uniform(0, 6)))
    for seq in range(1500):
        shape = shapes[rng.randrange(40)] if seq % 50 else (1.0, 1.0, 0.0, 20.0 + seq, 0.0)
        rows.append(("u", 0, seq, 2.7 if seq % 3 else 2.5, 0.0, *shape))
    records = spark.createDataFrame(rows, "uuid string, story int, seq int, top double, bottom double, span double, ax double, az double, mx double, mz double")
    cohorts = spark.createDataFrame([("u", 0, 2.7, 1.0, 1e6, 0.0)], "uuid string, story int, dominant_y double, coverage double, perimeter double, cohort_floor double")
    dealt, tiles = [], E.tiles

    def counted(part, *more, **options):
        dealt.append(part.count())
        return tiles(part, *more, **options)

    monkeypatch.setattr(E, "tiles", counted)
    got = {r.seq: r.all_pass for r in E.low_walls(records, cohorts).collect()}

    def goes_on(t, o):
        (_, _, _, _, _, span, ax, az, mx, mz), (*_, o_span, bx, bz, ox, oz) = t, o
        dx, dz = ox - mx, oz - mz
        turned = math.degrees(math.acos(min(1.0, abs(ax * bx + az * bz))))
        return turned <= 8 and abs(dz * ax - dx * az) <= 0.15 and abs(dx * ax + dz * az) - (span + o_span) / 2 <= 0.8

    want = {t[2]: any(goes_on(t, o) for o in rows if o[3] == 2.7) for t in rows if t[3] == 2.5}
    assert got == want and len(set(want.values())) == 2
    assert max(dealt) <= 80  # 40 shapes and 30 walls of their own, not 1,500 walls
