"""Steps that the third round's findings made cheaper: the same answers, with less work."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from scanlytics.functions import geometry as G
from scanlytics.functions import overlay as O
from scanlytics.operators import cohorts, heights, models, neighbours, obliques, spatial
from scanlytics.sources import payloads

POLYGON = "array<struct<x:double,y:double,z:double>>"


def test_areas_of_few_corners_are_compiled(spark):
    """measures of up to four corners are plain arithmetic; lambdas, which Spark interprets, are left for longer lists."""
    rng, rows = random.Random(2), []
    for i in range(60):
        rows.append((i, [tuple(rng.uniform(-5, 5) for _ in range(3)) for _ in range(i % 7)] if i else None))
    got = {r.i: (r.a, r.low) for r in spark.createDataFrame(rows, f"i int, c {POLYGON}").select("i", G.area_3d(F.col("c")).alias("a"), G.low(F.col("c")).alias("low")).collect()}
    for i, c in rows:
        area = 0.0
        if c and len(c) >= 3:
            p, q = np.array(c), np.roll(np.array(c), -1, axis=0)
            area = float(np.linalg.norm(np.cross(p, q).sum(0)) / 2)
        assert abs(got[i][0] - area) < 1e-9 and got[i][1] == (min(p[1] for p in c) if c else None)
    called = []
    G._few(F.col("c"), lambda points: called.append(len(points)) or F.lit(1.0), (4, 3), F.lit(0.0))
    assert called == [4, 3]


def test_convex_polygons_are_clipped_not_swept(monkeypatch):
    """most regions are one convex polygon; the sweep over all sides gives the same areas."""
    rng, kind = random.Random(5), pa.list_(pa.list_(pa.list_(pa.struct([(k, pa.float64()) for k in "xyz"]))))

    def polygon(n):
        x, z, w, d, t = rng.choice([0, 0.5, 1]), rng.choice([0, 0.5, 1]), rng.choice([0.5, 1, 2]), rng.choice([0.5, 1, 3]), rng.choice([0, 0.37])
        points = [(x, z), (x + w, z), (x + w, z + d), (x, z + d)][:n]
        points = points[::-1] if rng.random() < 0.5 else points
        return [{"x": a * np.cos(t) - b * np.sin(t), "y": 0.0, "z": a * np.sin(t) + b * np.cos(t)} for a, b in points]

    convex = [[[[polygon(rng.choice([3, 4]))]] if rng.random() < 0.9 else [] for _ in range(500)] for _ in range(2)]
    bent = [[[[polygon(2)]], [[polygon(4), polygon(3)]], [[polygon(4)], [polygon(4)]], None, [[[polygon(4)[i] for i in (0, 2, 1, 3)]]]][i % 5] for i in range(500)]
    left, right, odd = (pa.array(x, kind) for x in (*convex, bent))
    for a, b in ((left, right), (left, odd), (odd, right)):
        assert np.abs(O.areas(a, b) - O._swept(a, b)).max() < 1e-12
    assert O.areas(left[:0], right[:0]).shape == (0, 3)
    swept = O._swept
    monkeypatch.setattr(O, "_swept", lambda *a: 1 / 0)
    assert O.areas(left, right)[:, 2].max() > 0.5
    monkeypatch.setattr(O, "_swept", swept)


def test_only_pairs_that_touch_are_widened(spark):
    """surfaces are widened in the pairs that need it, not all of them beforehand."""
    box = lambda a, b, z=0.0: [(a, 0.0, z), (b, 0.0, z), (b, 0.0, z + 1), (a, 0.0, z + 1)]
    rows = [("u", 1, 1, box(0.0, 2.0)), ("u", 1, 2, box(2.0, 3.0)), ("u", 1, 3, box(2.5, 4.0)), ("u", 1, 4, box(4.1, 5.0)), ("u", 2, 5, box(0.0, 9.0)), ("u", None, 6, box(7.0, 8.0)), ("u", None, 7, box(7.5, 9.0)), ("v", 1, 1, box(3.0, 4.0, 1.0)), ("v", 1, 2, box(4.0, 5.0, 2.0))]
    table = spark.createDataFrame(rows, f"uuid string, room int, seq int, corners {POLYGON}")
    seen, buffered = [], O.buffered
    O.buffered = lambda corners, reach: seen.append(str(corners)) or buffered(corners, reach)
    try:
        got = {(r.uuid, r.seq): r.component for r in spatial.parts(table, ["room"]).collect()}
    finally:
        O.buffered = buffered
    assert got == {("u", 1): 1, ("u", 2): 1, ("u", 3): 1, ("u", 4): 4, ("u", 5): 5, ("u", 6): 6, ("u", 7): 6, ("v", 1): 1, ("v", 2): 2}
    assert len(seen) == 2  # both sides of a pair; before, the rows themselves
    assert {r.component for r in spatial.parts(table.where("uuid = 'u'"), [], 0.1).collect()} == {1}


def test_a_payload_is_parsed_once(spark, tmp_path):
    """F16: the document was parsed again for each of its lists."""
    (tmp_path / "a.json").write_text('{"uuid":"u","rooms":[{"story":1,"floor":{"locator_id":"f"},"walls":[{"locator_id":"w"},5]},7,{"locator_id":"r","floor":[{"locator_id":"g"},"x"]}],"gaps":[{"locator_id":"p"},3,{"locator_id":"q"}],"ceiling":4}\n{"uuid":"v"}\n')
    out = payloads.read_payloads(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [value") == 1
    got = {(r.category, r.story, r.room, r.room_locator, r.idx, r.locator_id) for r in out.collect()}
    assert got == {("floor", 1, 0, None, 0, "f"), ("wall", 1, 0, None, 0, "w"), ("floor", None, 2, "r", 0, "g"), ("gap", None, None, None, 0, "p"), ("gap", None, None, None, 2, "q")}


def test_blocks_meet_once(spark, monkeypatch):
    """a pair of blocks meets in one task for both directions, and what is found is written, not worked out for each reader."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (300, 3)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "key long, vector array<double>")
    found = neighbours.nearest(rows, 5, block=40)
    got = {(r.key, r["rank"]): (r.other, r.distance) for r in found.collect()}
    away = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2))
    for i in range(300):
        order = sorted((round(away[i, j], 9), j) for j in range(300) if j != i)[:5]
        assert [got[i, k + 1][0] for k in range(5)] == [j for _, j in order]
    assert len(got) == 1500 and "cogroup" not in found._jdf.queryExecution().toString().lower()


def test_weights_are_not_broadcast_and_fits_read_large_splits(spark, monkeypatch):
    """the rows of each building were counted apart and joined, which broadcast them; and each job of a fit answered the driver once a shuffle partition."""
    made = [(f"u{i % 40}" if i % 50 else None, i % 2, float(i), "ab"[i % 2]) for i in range(400)]
    rows = models.prepare(spark.createDataFrame(made, "building_uuid string, label int, size double, kind string"), ["size"], ["kind"])
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    sizes = {}
    for u, *_ in made:
        sizes[u] = sizes.get(u, 0) + 1
    got = rows.collect()
    assert len(got) == 392 and all(abs(r.weight * sizes[r.building_uuid] - 1) < 1e-12 for r in got)
    tool, seen = models.DecisionTreeClassifier, []

    class Tree(tool):
        def fit(self, rest):
            seen.append((rest.rdd.getNumPartitions(), rest.schema["features"].metadata))
            return super().fit(rest)

    monkeypatch.setattr(models, "DecisionTreeClassifier", Tree)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert models.oof_scores(rows, 2, rounds=1).count() == 392
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(seen) == 2 and all(n <= 16 and m == rows.schema["features"].metadata for n, m in seen)


def test_points_meet_wings_and_planes_once(spark):
    """points were joined back to their wings, worked out again to be counted, and tried by lambdas, which Spark interprets."""
    rng, rows = random.Random(4), []
    for i in range(200):
        c = [(rng.uniform(0, 4), 0.0, rng.uniform(0, 4)) for _ in range(i % 7)]
        rows.append((i, c if i else None, rng.uniform(0, 4), rng.uniform(0, 4)))
    x, z = F.col("x"), F.col("z")
    table = spark.createDataFrame(rows, f"i int, c {POLYGON}, x double, z double")
    got = {r.i: r.inside for r in table.select("i", spatial.point_in_polygon(F.col("c"), x, z).alias("inside")).collect()}
    for i, c, px, pz in rows:
        hits = sum((p[2] > pz) != (q[2] > pz) and px < (q[0] - p[0]) * (pz - p[2]) / (q[2] - p[2]) + p[0] for p, q in zip(c or [], (c or [])[1:] + (c or [])[:1]))
        assert got[i] == (len(c or []) >= 3 and hits % 2 == 1)
    called, few = [], G._few
    G._few = lambda corners, f, sizes, otherwise: called.append(sizes) or few(corners, f, sizes, otherwise)
    try:
        spatial.point_in_polygon(F.col("c"), x, z), cohorts.longest_chord(F.col("c"))
    finally:
        G._few = few
    assert called == [(4, 3), (4, 2, 3)]
    box = lambda a, b: [(a, 0.0, 0.0), (b, 0.0, 0.0), (b, 0.0, 2.0), (a, 0.0, 2.0)]
    points = spark.createDataFrame([("u", 1, 1.0, 1.0), ("u", 2, 2.6, 1.0), ("u", 3, 9.0, 1.0), (None, 4, 1.0, 1.0)], "uuid string, point int, x double, z double")
    wings = spark.createDataFrame([("u", 0, box(0.0, 3.0)), ("u", 1, box(2.0, 4.0)), (None, 0, box(0.0, 3.0))], f"uuid string, wing int, corners {POLYGON}")
    plane = lambda d: (0.0, 1.0, 0.0, d)
    planes = spark.createDataFrame([("u", 0, 1, plane(2.0), box(0.0, 4.0)), ("u", 0, 2, plane(3.0), box(0.0, 4.0)), ("u", 1, 3, plane(5.0), box(0.0, 4.0)), ("u", None, 4, plane(9.0), box(0.0, 4.0))], f"uuid string, wing int, seq int, plane struct<a:double,b:double,c:double,d:double>, corners {POLYGON}")
    out = heights.roof_y_at(points, planes, wings)
    assert {(r.point, r.y, r.chosen, tuple(r.contenders), r.reason) for r in out.collect()} == {(1, 3.0, 2, (2, 1), "max_y"), (2, 5.0, 3, (3,), "single_candidate")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3


def test_planes_of_a_roof_meet_once(spark, monkeypatch):
    """planes met three times and were joined back to each mark; now once, with the same marks."""
    rng, rows = random.Random(9), []
    for i in range(160):
        rows.append((rng.choice("uvw"), i, rng.choice([0.0, 30.0, 90.0, 95.5, 180.0, 271.0, rng.uniform(0, 360)]) if i % 20 else None, rng.choice([10.0, 20.0, 45.0, rng.uniform(0, 60)]), rng.uniform(0, 5), rng.uniform(0, 3)))
    rows += [("x", 1, 0.0, 30.0, 1.0, 1.0), ("x", 2, 180.0, 30.0, 1.0, 1.0), ("y", 1, None, None, 1.0, None), (None, 1, 0.0, 1.0, 1.0, 1.0)]
    planes = spark.createDataFrame(rows, "uuid string, seq int, azimuth double, incl double, area double, high double").localCheckpoint()
    monkeypatch.setattr(obliques, "TIER_GAP", 1.0)  # planes whose slopes are so near that they pair are else in one tier
    tiers = planes.join(obliques.pitch_tiers(planes, 1.0), ["uuid", "seq"])
    members = lambda found: {tuple(r) for r in found.select("uuid", "seq").collect()}
    want = [members(obliques._members(obliques.opposing_pairs(planes), "uuid")), members(obliques._members(obliques.opposing_pairs(tiers, keys=("uuid", "tier")), "uuid")), members(obliques.crossing_pairs(planes))]
    assert all(want) and want[0] != want[1] and ("x", 1) not in want[2]
    for crowd in (0, 64, 1000):
        monkeypatch.setattr(spatial, "CROWD", crowd)
        got = obliques._marked(planes).collect()
        assert [{(r.uuid, r.seq) for r in got if r[c]} for c in ("partner", "in_tier", "crossing")] == want
        assert sorted((r.uuid, r.seq) for r in got) == sorted((u, s) for u, s, *_ in rows if u)
    roofs = spark.createDataFrame([("u", "hip"), ("v", "mansard"), ("w", None)], "uuid string, roof_type string")
    assert obliques.oblique_priors(planes, roofs)._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_walls_of_an_axis_are_dealt_once(spark):
    """walls were grouped by bin and by building, and worked out again to be joined to the axis; chords of few corners are compiled."""
    rng, rows = random.Random(6), []
    for i in range(120):
        rows.append((i, [(rng.choice([0.0, 1.0, 3.0]), 0.0, rng.choice([0.0, 2.0, 3.0])) for _ in range(i % 6)]))
    table = spark.createDataFrame(rows, f"i int, corners {POLYGON}")
    for r in table.select("i", "corners", cohorts.longest_chord(F.col("corners")).alias("c")).collect():
        lines = [(q.x - p.x, q.z - p.z, np.hypot(q.x - p.x, q.z - p.z)) for k, p in enumerate(r.corners) for q in r.corners[k + 1 :]]
        best = max(range(len(lines)), key=lambda k: (lines[k][2], -k)) if lines else None
        assert (r.c is None or r.c.length is None) if best is None else np.allclose((r.c.dx, r.c.dz, r.c.length), lines[best])
    walls = spark.createDataFrame([(u, [(0.0, 0.0, 0.0), (x, 0.0, z)]) for u, x, z in (("u", 4.0, 0.0), ("u", 0.0, 3.0), ("u", 1.0, 1.0), ("v", 0.1, 0.0), (None, 1.0, 0.0))], f"uuid string, corners {POLYGON}")
    out = cohorts.principal_axis(walls)
    assert [(r.uuid, r.axis, round(r.coverage, 6)) for r in out.collect()] == [("u", 0.0, round(7 / (7 + 2**0.5), 6))]
    plan = cohorts.principal_axis(walls)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hash") == 1
