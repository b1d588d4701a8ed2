"""One planted violation of each kind, and sound payloads without any."""

from scanlytics.operators import invariants as I

POLYGON = "array<struct<x:double,y:double,z:double>>"
KIND = f"uuid string, seq int, category string, story int, room int, locator_id string, kind string, source string, plane struct<a:double,b:double,c:double,d:double>, corners {POLYGON}, openings array<{POLYGON}>"


def box(x, z, w, d, y=0.0):
    return [(float(a), float(y), float(b)) for a, b in ((x, z), (x, z + d), (x + w, z + d), (x + w, z))]  # faces up


def wall(x, w, low=0.0, high=2.5, z=0.0):
    return [(float(x), low, z), (float(x + w), low, z), (float(x + w), high, z), (float(x), high, z)]


def surface(seq, category, corners, room=None, holes=(), plane=None, kind="", source="", uuid="u", story=0):
    return (uuid, seq, category, story, room, f"{category}{seq}", kind, source, plane, corners, list(holes))


def found(spark, rows, about=(("u", "1", 3),)):
    df = spark.createDataFrame(rows, KIND)
    out = I.invariants(spark.createDataFrame(list(about), "uuid string, schema_version string, tier int"), df)
    return sorted((r.path, r.rule) for r in out.collect())


SOUND = [
    surface(1, "floor", box(0, 0, 4, 4), 1, [box(1, 1, 1, 1)]), surface(2, "floor", box(4, 0, 4, 4), 2), surface(3, "floor", box(5, 1, 1, 1), 3),
    surface(4, "wall", wall(0, 4), 1), surface(5, "wall", wall(4, 4), 2), surface(6, "wall", wall(0, 4, 2.5, 5.0), 1),
    surface(7, "ceiling", box(0, 0, 4, 4, 2.5), 1, plane=(0.0, 1.0, 0.0, 2.5)), surface(8, "ceiling", box(4, 0, 4, 4, 2.5), 2, plane=(0.0, 1.0, 0.0, 2.5)), surface(9, "ceiling", box(5, 1, 1, 1, 2.5), 3, plane=(0.0, 1.0, 0.0, 2.5)),
    surface(10, "ceiling", box(0, 0, 4, 4, 2.5), 1, plane=(0.0, 1.0, 0.0, 2.5), source=I.ATTIC), surface(11, "gap", box(0, 0, 1, 0.02), kind="gap_floor"), surface(12, "dormer_face", wall(0, 1, z=9.0)),
    surface(13, "wall", wall(0, 3, z=4.0), 1), surface(14, "wall", wall(2.5, 2, z=4.0), 2),
]


def test_sound_payloads_have_none(spark):
    assert found(spark, SOUND) == []
    assert found(spark, [], []) == []


def test_each_kind_is_found(spark):
    bad = [
        surface(20, "floor", [(0.0, 0.0, 0.0), (0.0, 0.5, 1.0), (1.0, 0.0, 1.0)], 20), surface(21, "floor", box(90, 0, 1, 1)[::-1], 21), surface(22, "wall", wall(0, 1)[:2], 20),
        surface(23, "floor", box(50, 0, 4, 4), 22, [box(51, 1, 1, 1)[:2], [(51.0, 0.0, 1.0), (51.0, 0.01, 2.0), (52.0, 0.0, 2.0)], box(51, 1, 1, 1, 0.2), box(53, 1, 3, 1)]),
        surface(24, "ceiling", box(70, 0, 1, 1, 2.5), 20, plane=(1.0, 0.05, 0.0, 1.0)), surface(25, "ceiling", box(75, 0, 1, 1, 2.5), 20, plane=(0.0, float("nan"), 0.0, 1.0)),
        surface(26, "gap", wall(0, 1, z=40.0)[:2] + [(1.0, 0.009, 40.0), (0.0, 0.009, 40.0)], kind="x"),
        surface(27, "ceiling", box(3, 0, 3, 4, 2.5), 1, plane=(0.0, -1.0, 0.0, -2.5)), surface(28, "knee_wall", wall(0.5, 3.0)), surface(29, "ceiling", box(30, 0, 3, 4, 2.5), 1, plane=(0.0, 1.0, 0.0, 2.5)),
    ]
    got = found(spark, SOUND + bad, (("u", "2", 3), ("v", "1", 9), ("w", None, None)))
    assert got == sorted([
        ("schema_version", "schema_version"), ("schema_version", "schema_version"), ("classification.tier", "tier"), ("classification.tier", "tier"), ("floor20", "level"), ("floor21", "faces_up"), ("wall22", "corners"), ("floor23.holes[0]", "hole_corners"),
        ("floor23.holes[1]", "hole_level"), ("floor23.holes[2]", "hole_height"), ("floor23.holes[3]", "hole_inside"), ("ceiling24", "upright_plane"), ("ceiling25", "finite_plane"), ("gap26", "sliver_gap"), ("ceiling27", "ceiling_overlap"), ("knee_wall28", "wall_overlap"),
    ] + [("ceiling27", "ceiling_overlap")] * (got.count(("ceiling27", "ceiling_overlap")) - 1))
    assert 1 <= got.count(("ceiling27", "ceiling_overlap")) <= 3


def test_what_is_alone_on_its_plane_meets_nothing(spark, monkeypatch):
    met, near_pairs = [], I.near_pairs

    def counted(left, right, *more):
        met.append(left.count())
        return near_pairs(left, right, *more)

    monkeypatch.setattr(I, "near_pairs", counted)
    rows = [surface(i, "wall", wall(0, 3, z=float(i)), 1) for i in range(20)] + [surface(20, "wall", wall(1, 3, z=3.0), 2)]
    got = found(spark, rows, [])
    assert got == [("wall20", "wall_overlap")] and met[1:] == [0, 2]
