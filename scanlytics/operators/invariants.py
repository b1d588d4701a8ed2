"""What a built payload must hold, as rows of what does not."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..sources.scratch import written
from .overlaps import room_floors
from .spatial import SIDE, near_pairs, regions, shared_area

# fixed values: metres, m2 and shares
LEVEL, HOLE_Y, LEAST_B, CEILING_M2, WALL_M2, WALL_SHARE, APART, THIN, TOUCH, FLOOR_M2 = 1e-3, 0.05, 0.087, 1e-2, 1.0, 0.50, 0.05, 0.01, 0.05, 0.30
ATTIC = "roof_arrangement_attic"


def _row(rows: DataFrame, rule: str, where: Column, expected: str, actual: Column) -> DataFrame:
    return rows.where(F.coalesce(where, F.lit(False))).select("uuid", F.coalesce("locator_id", F.concat_ws("::", "category", F.col("seq").cast("string"))).alias("path"), F.lit(rule).alias("rule"), F.lit(expected).alias("expected"), actual.cast("string").alias("actual"))


def _spread(corners: Column) -> Column:
    return G.high(corners) - G.low(corners)


def flattened(corners: Column) -> Column:
    """A polygon turned into its own plane: corners with ``x, z`` along two directions in the plane and ``y`` 0. Null without an area."""
    def turn(n):
        level = F.abs(n["y"]) < 0.9
        # the first direction is across the normal and the vertical, or the x axis for level planes
        size = F.when(level, F.hypot(n["z"], n["x"])).otherwise(F.hypot(n["z"], n["y"]))
        u = [F.when(level, n["z"] / size).otherwise(0.0), F.when(level, 0.0).otherwise(n["z"] / size), F.when(level, -n["x"] / size).otherwise(-n["y"] / size)]
        v = [n["y"] * u[2] - n["z"] * u[1], n["z"] * u[0] - n["x"] * u[2], n["x"] * u[1] - n["y"] * u[0]]
        return F.struct(*[c.alias(f"u{i}") for i, c in enumerate(u)], *[c.alias(f"v{i}") for i, c in enumerate(v)])

    along = lambda p, t, k: p["x"] * t[f"{k}0"] + p["y"] * t[f"{k}1"] + p["z"] * t[f"{k}2"]
    canon = lambda n: F.struct(*[(n[k] * F.when(F.when((F.abs(n["x"]) >= F.abs(n["y"])) & (F.abs(n["x"]) >= F.abs(n["z"])), n["x"]).when(F.abs(n["y"]) >= F.abs(n["z"]), n["y"]).otherwise(n["z"]) < 0, -1.0).otherwise(1.0)).alias(k) for k in "xyz"])
    return G.once(G.unit_normal(corners), lambda n: G.once(canon(n), lambda m: G.once(turn(m), lambda t: F.when(n.isNotNull(), F.transform(corners, lambda p: F.struct(along(p, t, "u").alias("x"), F.lit(0.0).alias("y"), along(p, t, "v").alias("z")))))))


def least_width(flat: Column) -> Column:
    """The shorter side of the least rectangle along one of a polygon's sides that holds it (``x, z``)."""
    def along(sides):
        def box(s):
            size = F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["z"] - s["p"]["z"])
            c, d = (s["q"]["x"] - s["p"]["x"]) / size, (s["q"]["z"] - s["p"]["z"]) / size
            a, b = F.transform(sides, lambda e: e["p"]["x"] * c + e["p"]["z"] * d), F.transform(sides, lambda e: e["p"]["z"] * c - e["p"]["x"] * d)
            w, h = F.array_max(a) - F.array_min(a), F.array_max(b) - F.array_min(b)
            return F.struct((w * h).alias("area"), F.least(w, h).alias("width"))

        kept = F.filter(sides, lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["z"] - s["p"]["z"]) > 1e-12)
        return F.array_min(F.transform(kept, box))["width"]

    pairs = lambda f: F.transform(f, lambda p, i: F.struct(p.alias("p"), F.get(f, (i + 1) % F.size(f)).alias("q")))
    return G.once(G.once(flat, pairs), along)


def lid_violations(surfaces: DataFrame) -> list[DataFrame]:
    """Floors and level gaps: three corners, level within 1 mm, facing up; their holes: three corners, level, within 5 cm of the lid's height, inside the outline."""
    lids = surfaces.where("category = 'floor' or (category = 'gap' and (kind like '%floor%' or kind like '%ceil%'))").withColumn("up", G.turning(F.col("corners"))["y"])
    big = lids.where("size(corners) >= 3")
    holes = big.select("uuid", "seq", "category", F.col("locator_id").alias("of"), "corners", F.posexplode("openings").alias("i", "hole")).withColumn("locator_id", F.concat(F.coalesce("of", F.lit("")), F.lit(".holes["), F.col("i"), F.lit("]")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, p: s + p["y"]) / F.size(c)
    whole = holes.where("size(hole) >= 3").withColumn("o", O.overlaid(F.array(O.rings(F.col("corners"))), F.array(O.rings(F.col("hole")))))
    return [
        _row(lids, "corners", F.size("corners") < 3, "at least 3 corners", F.size("corners")),
        _row(big, "level", F.round(_spread(F.col("corners")), 9) > LEVEL, "planar Y spread <= 0.001", F.round(_spread(F.col("corners")), 6)),
        _row(big, "faces_up", (F.round(_spread(F.col("corners")), 9) <= LEVEL) & (F.col("up") <= 0), "normal +Y", F.round("up", 6)),
        _row(holes, "hole_corners", F.size("hole") < 3, "at least 3 corners", F.size("hole")),
        _row(holes.where("size(hole) >= 3"), "hole_level", F.round(_spread(F.col("hole")), 9) > LEVEL, "planar hole Y spread <= 0.001", F.round(_spread(F.col("hole")), 6)),
        _row(holes.where("size(hole) >= 3"), "hole_height", F.round(F.abs(mean(F.col("hole")) - mean(F.col("corners"))), 9) > HOLE_Y, "hole Y close to lid Y", F.round(mean(F.col("hole")), 6)),
        _row(whole, "hole_inside", F.col("o.right") - F.col("o.both") > 1e-5, "hole inside outer ring", F.round(F.col("o.right") - F.col("o.both"), 6)),
    ]


def _odd_plane() -> Column:
    return reduce(Column.__or__, [F.col(f"plane.{k}").isNull() | F.isnan(f"plane.{k}") | (F.abs(f"plane.{k}") == math.inf) for k in "abcd"])


def plane_violations(surfaces: DataFrame) -> list[DataFrame]:
    """Ceilings: finite coefficients, and not upright."""
    rows = surfaces.where("category = 'ceiling' and plane is not null")
    odd = _odd_plane()
    return [_row(rows, "finite_plane", odd, "finite plane coefficients", F.to_json("plane")), _row(rows.where(~odd), "upright_plane", F.abs("plane.b") < LEAST_B, f"|b| >= {LEAST_B}", F.col("plane.b"))]


def nested_floors(surfaces: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, room_a, room_b, nested, touch`` (both ways) of rooms whose floors hold one another, or lie within 5 cm of each other in one story and overlap by 0.3 m2 at most."""
    beds = written(room_floors(surfaces.where("category = 'floor'"), side).select("uuid", "seq", "room", "story", "corners", "region"), "beds")
    sizes = shared_area(beds.select("uuid", "room", "region"), None, ["room"], side=side)
    wide = beds.select("uuid", "room", "story", "region", O.buffered(F.col("corners"), TOUCH).alias("wide")).select("uuid", "room", "story", F.col("region").alias("own"), F.col("wide").alias("region"))
    wide = written(wide, "wide")  # meets itself
    meet = near_pairs(wide, wide, side).where("l.room != r.room").groupBy("uuid", F.col("l.room").alias("room_a"), F.col("r.room").alias("room_b"), F.col("l.story").eqNullSafe(F.col("r.story")).alias("same")).agg(*[F.flatten(F.collect_set(f"{s}.{c}")).alias(f"{s}_{c}") for s in "lr" for c in ("own", "region")])
    meet = meet.withColumns({"both": O.overlaid(F.col("l_own"), F.col("r_own"))["both"], "close": O.overlaid(F.col("l_region"), F.col("r_own"))["both"]})
    for s in "ab":
        meet = meet.join(sizes.select("uuid", F.col("room").alias(f"room_{s}"), F.col("area").alias(f"size_{s}")), ["uuid", f"room_{s}"])
    nested = F.col("both") >= F.least("size_a", "size_b") - 1e-6
    return meet.select("uuid", "room_a", "room_b", nested.alias("nested"), (F.col("same") & (F.col("both") <= FLOOR_M2) & (F.col("close") > 1e-9)).alias("touch"))


def overlap_violations(surfaces: DataFrame, side: float = SIDE) -> list[DataFrame]:
    """Ceilings on one plane that overlap by more than 0.01 m2, and walls, knee walls and dormer faces on one plane by more than 1 m2 and half of the smaller one.

    Pieces of the attic, of rooms whose floors hold one another, and walls over each other or of rooms that only touch are allowed. Surfaces of one plane meet in squares of a grid in that plane.
    """
    allowed = written(nested_floors(surfaces, side), "allowed")  # read for both rules
    keyed = lambda rows, plane: G.settled(G.settled(rows.withColumn("plane", plane), "plane").withColumn("k", G.plane_key(F.col("plane"))), "k").select("uuid", "seq", "category", "locator_id", "room", "source", F.concat_ws(":", *[F.col(f"k.{c}").cast("string") for c in "abcd"]).alias("key"), "corners", "openings")
    ceilings = keyed(surfaces.where("category = 'ceiling' and plane is not null and size(corners) >= 3").withColumn("plane", F.when(~_odd_plane(), F.col("plane"))).where("plane is not null"), F.col("plane"))
    upright = surfaces.where("category in ('wall', 'knee_wall', 'dormer_face') and size(corners) >= 3").withColumn("n", G.unit_normal(F.col("corners")))
    upright = G.settled(upright, "n").where("n is not null")
    mean = {k: F.aggregate(F.col(f"corners.{k}"), F.lit(0.0), lambda s, v: s + v) / F.size("corners") for k in "xyz"}
    fitted = F.struct(F.col("n.x").alias("a"), F.col("n.y").alias("b"), F.col("n.z").alias("c"), (F.col("n.x") * mean["x"] + F.col("n.y") * mean["y"] + F.col("n.z") * mean["z"]).alias("d"))
    walls = keyed(upright, fitted)
    out = []
    for name, rows, least, extra in (("ceiling_overlap", ceilings, CEILING_M2, ()), ("wall_overlap", walls, WALL_M2, ("low", "high"))):
        rows = written(rows, "planes")
        shared = rows.groupBy("uuid", "key").agg(F.count("*").alias("n")).where("n > 1").select("uuid", "key")
        rows = rows.join(shared, ["uuid", "key"], "left_semi")  # what is alone on its plane overlaps nothing
        if extra:
            rows = rows.withColumns({"low": G.low(F.col("corners")), "high": G.high(F.col("corners"))}).withColumn("corners", flattened(F.col("corners"))).withColumn("openings", F.array().cast(O.RINGS))
        own = regions(rows, "uuid", "seq", "category", "locator_id", "room", "source", "key", *extra)
        own = written(own.drop("corners"), name)  # both sides read it, and the counts of buildings
        pairs = near_pairs(own, own, side).where("l.key = r.key and l.seq > r.seq").withColumn("o", O.overlaid(F.col("l.region"), F.col("r.region"))).where(F.col("o.both") > least)
        if extra:
            over = (F.col("l.high") <= F.col("r.low") + APART) | (F.col("r.high") <= F.col("l.low") + APART)
            pairs = pairs.where(~over & (F.col("o.both") > F.greatest(F.lit(WALL_M2), WALL_SHARE * F.least("o.left", "o.right"))))
        else:
            pairs = pairs.where((F.coalesce("l.source", F.lit("")) != ATTIC) & (F.coalesce("r.source", F.lit("")) != ATTIC))
        ok = allowed.where(F.col("nested") | (F.col("touch") if extra else F.lit(False))).select("uuid", "room_a", "room_b")
        pairs = pairs.withColumns({"room_a": F.col("l.room"), "room_b": F.col("r.room")}).join(ok, ["uuid", "room_a", "room_b"], "left_anti")
        other = F.coalesce("r.locator_id", F.concat_ws("::", "r.category", F.col("r.seq").cast("string")))
        found = pairs.select("uuid", "l.seq", "l.category", "l.locator_id", F.concat(other, F.lit(" "), F.format_string("%.4f m^2", "o.both")).alias("said"))
        out.append(_row(found, name, F.lit(True), "no overlap on the same plane", F.col("said")))
    return out


def piece_violations(buildings: DataFrame, surfaces: DataFrame) -> list[DataFrame]:
    """What single buildings and pieces must hold: schema version, tier, corners, lids and their holes, planes, widths of gaps."""
    about = buildings.withColumns({"locator_id": F.lit("schema_version"), "category": F.lit(""), "seq": F.lit(0)})
    gaps = surfaces.where("category = 'gap' and size(corners) >= 3").withColumn("width", least_width(flattened(F.col("corners"))))
    return [
        _row(about, "schema_version", ~F.col("schema_version").eqNullSafe(F.lit("1")), "'1'", F.col("schema_version")),
        _row(about.withColumn("locator_id", F.lit("classification.tier")), "tier", ~F.coalesce(F.col("tier").between(1, 8), F.lit(False)), "1..8", F.col("tier")),
        _row(surfaces.where("category not in ('floor', 'gap')"), "corners", F.size("corners") < 3, "at least 3 corners", F.size("corners")),
        *lid_violations(surfaces), *plane_violations(surfaces), _row(gaps, "sliver_gap", F.round("width", 9) < THIN, f"in-plane min width >= {THIN}", F.round("width", 6)),
    ]


def invariants(buildings: DataFrame, surfaces: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, path, rule, expected, actual`` of everything that a payload must not hold; no rows for sound ones.

    ``buildings`` is ``uuid, schema_version, tier``, ``surfaces`` as ``read_payloads`` gives it with a ``seq`` that counts all surfaces of a building.
    """
    surfaces = written(surfaces.select("uuid", "seq", "category", "story", "room", "locator_id", "kind", "source", "plane", "corners", F.coalesce("openings", F.array().cast(O.RINGS)).alias("openings")), "surfaces")
    return reduce(DataFrame.unionByName, [*piece_violations(buildings, surfaces), *overlap_violations(surfaces, side)])
