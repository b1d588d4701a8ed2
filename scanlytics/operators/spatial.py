"""Joins of surfaces in space: points in polygons, areas that overlap, envelopes, edges of neighbouring rooms, coplanar groups.

In buildings of more than ``CROWD`` rows surfaces meet in the squares of a coarse grid (``SIDE`` metres) that their boxes touch, not all with all, and unions are measured in each square apart; in
others, where dealing to squares would only multiply the rows, they meet by building. Areas are exact (``functions.overlay``). All joins are inside a building; none crosses buildings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import geometry as G
from ..functions import overlay as O
from ..sources.scratch import written
from .graph import connected, heads

SIDE = 4.0
CROWD = 64  # rows of a building that meet without a grid
SLIVER = 1e-9  # m2: what is smaller comes from rounding
# fixed values: edges of the histograms of uncovered floor
GAP_SHARES = [0.0, 0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.25, 0.50]
GAP_AREAS = [0.05, 0.25, 1.0, 5.0, 20.0]


def story_bands(surfaces: DataFrame) -> DataFrame:
    """``uuid, story, low, high``: the heights of the walls of each story."""
    walls = surfaces.where("category = 'wall' and story is not null").select("uuid", "story", G.low(F.col("corners")).alias("low"), G.high(F.col("corners")).alias("high"))
    return walls.where("low is not null").groupBy("uuid", "story").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def point_in_polygon(corners: Column, x: Column, z: Column) -> Column:
    """Whether a point lies inside, seen from above, by the number of sides that a ray crosses."""
    def crossed(p: Column, q: Column) -> Column:
        cut = ((p["z"] > z) != (q["z"] > z)) & (x < (q["x"] - p["x"]) * (z - p["z"]) / F.when(q["z"] != p["z"], q["z"] - p["z"]) + p["x"])
        return F.coalesce(cut, F.lit(False))

    def listed(points):
        return sum((crossed(p, q).cast("int") for p, q in zip(points, [*points[1:], points[0]], strict=True)), F.lit(0)) % 2 == 1

    other = (F.size(corners) >= 3) & (F.size(F.filter(G.sides(corners), lambda s: crossed(s["p"], s["q"]))) % 2 == 1)
    return F.coalesce(G._few(corners, listed, (4, 3), other), F.lit(False))


def tiles(rows: DataFrame, corners: Column | None = None, side: float = SIDE) -> DataFrame:
    """A row for every square ``ix, iz`` of a grid that the box of a polygon (or of its points) touches, with the box as ``x0, x1, z0, z1``."""
    box = G.once(F.col("corners") if corners is None else corners, G.box)
    rows = G.settled(rows.withColumn("__box", box), "__box").withColumns({k: F.col(f"__box.{k}") for k in ("x0", "x1", "z0", "z1")}).drop("__box").where("x0 is not null and z0 is not null")
    for k in "xz":
        low, high = F.floor(F.col(f"{k}0") / side), F.floor(F.col(f"{k}1") / side)
        rows = rows.withColumn(f"i{k}", F.explode(F.sequence(low, high)))
    return rows


def regions(surfaces: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``corners, region`` of surfaces with three corners and more; openings are holes of the region where there are any."""
    openings = F.col("openings") if "openings" in surfaces.columns else None
    return surfaces.where("size(corners) >= 3").select(*keep, "corners", F.array(O.rings(F.col("corners"), openings)).alias("region"))


def _outline(region: Column) -> Column:
    """All corners of a region's outlines."""
    return F.flatten(F.transform(region, lambda p: p[0]))


def _region_box(region: Column) -> Column:
    """The box of a region; of a single polygon from its outline."""
    return F.when(F.size(region) == 1, G.box(F.get(F.get(region, F.lit(0)), F.lit(0)))).otherwise(G.once(_outline(region), G.box))


class Crowds:
    """Tells once for all steps which buildings have more than ``CROWD`` of ``rows``, of which all that the steps join are parts."""

    def __init__(self, rows: DataFrame) -> None:
        self.many = written(rows.groupBy("uuid").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("uuid"), "crowded")
        self.none = self.many.isEmpty()


def by_crowd(*tables: DataFrame, keys: tuple[str, ...] = ("uuid",), crowds: Crowds | None = None) -> list[tuple[bool, list[DataFrame]]]:
    """The rows of buildings (or other ``keys``) with at most ``CROWD`` rows in all tables together, and apart from them, where there are any, those of the others (true); ``crowds`` may say it instead of a count."""
    if crowds is not None:
        return [(False, list(tables))] if crowds.none else [(many, [t.join(crowds.many, "uuid", "left_semi" if many else "left_anti") for t in tables]) for many in (False, True)]
    every = tables[0].select(*keys)
    for more in tables[1:]:
        every = every.unionByName(more.select(*keys))
    crowded = written(every.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*keys), "crowded")
    if crowded.isEmpty():
        return [(False, list(tables))]
    return [(many, [t.join(crowded, list(keys), "left_semi" if many else "left_anti") for t in tables]) for many in (False, True)]


def _boxed(rows: DataFrame, name: str) -> DataFrame:
    rows = G.settled(rows, "region")
    return rows.select("uuid", F.struct(*rows.columns).alias(name), _region_box(F.col("region")).alias(f"{name}box"))


def _touch(a: str, b: str) -> Column:
    """Whether two boxes touch."""
    return (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{b}.x0") <= F.col(f"{a}.x1")) & (F.col(f"{a}.z0") <= F.col(f"{b}.z1")) & (F.col(f"{b}.z0") <= F.col(f"{a}.z1"))


def near_pairs(left: DataFrame, right: DataFrame, side: float = SIDE, keys: list[str] | tuple[str, ...] = (), crowds: Crowds | None = None) -> DataFrame:
    """Pairs of rows of one building, and of equal ``keys``, whose regions' boxes touch, each once: structs ``l`` and ``r`` of all columns.

    In buildings of many rows both sides are dealt to squares of a grid and meet there; a pair counts in the square of the least corner that the boxes share.
    """
    found = []
    for many, (some, others) in by_crowd(left, right, crowds=crowds):
        if many:
            found.append(_grid_pairs(some, others, side))
        else:
            found.append(_boxed(some, "l").join(_boxed(others, "r"), "uuid").where(_touch("lbox", "rbox")).select("uuid", "l", "r"))
        for k in keys:
            found[-1] = found[-1].where(F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _grid_pairs(left: DataFrame, right: DataFrame, side: float) -> DataFrame:
    def dealt(rows, name):
        dealt = tiles(rows, _outline(F.col("region")), side)
        return dealt.select("uuid", "ix", "iz", F.struct(*rows.columns).alias(name), F.struct("x0", "x1", "z0", "z1").alias(f"{name}box"))

    both = dealt(left, "l").join(dealt(right, "r"), ["uuid", "ix", "iz"])
    low = {k: F.greatest(F.col(f"lbox.{k}0"), F.col(f"rbox.{k}0")) for k in "xz"}
    high = {k: F.least(F.col(f"lbox.{k}1"), F.col(f"rbox.{k}1")) for k in "xz"}
    for k in "xz":
        both = both.where((low[k] <= high[k]) & (F.floor(low[k] / side) == F.col(f"i{k}")))
    return both.select("uuid", "l", "r")


def held_by(points: DataFrame, polygons: DataFrame, side: float = SIDE, crowds: Crowds | None = None) -> DataFrame:
    """Points (``uuid, x, z``) with every polygon (``uuid, corners``) that holds them; points and boxes meet in squares of a grid where a building has many."""
    own = [c for c in polygons.columns if c not in ("uuid", "corners")]
    near = []
    for many, (place, shapes) in by_crowd(points, polygons.where("size(corners) >= 3"), crowds=crowds):
        if many:
            place = place.withColumns({f"i{k}": F.floor(F.col(k) / side) for k in "xz"})
            boxes = tiles(shapes, side=side).select("uuid", "ix", "iz", "x0", "x1", "z0", "z1", "corners", *own)
            near.append(place.join(boxes, ["uuid", "ix", "iz"]).drop("ix", "iz"))
        else:
            boxes = G.settled(shapes.select("uuid", "corners", *own, G.box(F.col("corners")).alias("__box")), "__box").select("uuid", "__box.x0", "__box.x1", "__box.z0", "__box.z1", "corners", *own)
            near.append(place.join(boxes, "uuid"))
    both = (near[0] if len(near) == 1 else near[0].unionByName(near[1])).where("x between x0 and x1 and z between z0 and z1")
    return both.where(point_in_polygon(F.col("corners"), F.col("x"), F.col("z"))).select(*points.columns, *own)


def shared_area(left: DataFrame, right: DataFrame | None, keys: list[str], where: Column | None = None, side: float = SIDE, crowds: Crowds | None = None) -> DataFrame:
    """``uuid, keys, area, shared``: the area of the union of the regions of a key, and how much of it the union of ``right`` covers.

    ``right`` is ``uuid, region`` and what ``where`` needs to say which of its rows count for which of ``left``; without it nothing is shared.
    In buildings of many rows areas are measured in each square of a grid apart and added up, so no task needs all surfaces of a building.
    """
    found = []
    for many, (own, *over) in by_crowd(left, *([] if right is None else [right]), crowds=crowds):
        found.append((_grid_area if many else _whole_area)(own, over[0] if over else None, keys, where, side))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _whole_area(left: DataFrame, right: DataFrame | None, keys: list[str], where: Column | None, side: float) -> DataFrame:
    ground = left.groupBy("uuid", *keys).agg(F.flatten(F.collect_list("region")).alias("own"))
    if right is None:
        ground = ground.withColumn("over", F.array().cast(f"array<{O.RINGS}>"))
    else:
        ground = ground.withColumn("ownbox", _region_box(F.col("own")))
        cover = G.settled(right, "region").select("uuid", *[c for c in right.columns if c not in ("uuid", "region")], F.col("region").alias("over"), _region_box(F.col("region")).alias("overbox"))
        both = ground.join(cover, "uuid", "left").withColumn("over", F.when(F.col("over").isNotNull() & _touch("ownbox", "overbox") & (F.lit(True) if where is None else where), F.col("over")))
        ground = both.groupBy("uuid", *keys).agg(F.first("own").alias("own"), F.flatten(F.collect_list("over")).alias("over"))
    return ground.select("uuid", *keys, O.overlaid(F.col("own"), F.col("over")).alias("part")).select("uuid", *keys, F.col("part.left").alias("area"), F.col("part.both").alias("shared"))


def _grid_area(left: DataFrame, right: DataFrame | None, keys: list[str], where: Column | None, side: float) -> DataFrame:
    ground = tiles(left, _outline(F.col("region")), side).groupBy("uuid", *keys, "ix", "iz").agg(F.flatten(F.collect_list("region")).alias("own"))
    if right is None:
        ground = ground.withColumn("over", F.array().cast(f"array<{O.RINGS}>"))
    else:
        others = [c for c in right.columns if c not in ("uuid", "region")]
        cover = tiles(right, _outline(F.col("region")), side).select("uuid", "ix", "iz", *others, F.col("region").alias("over"))
        both = ground.join(cover, ["uuid", "ix", "iz"], "left").withColumn("over", F.when(F.col("over").isNotNull() & (F.lit(True) if where is None else where), F.col("over")))
        ground = both.groupBy("uuid", *keys, "ix", "iz").agg(F.first("own").alias("own"), F.flatten(F.collect_list("over")).alias("over"))
    part = O.overlaid(F.col("own"), F.col("over"), O.square(F.col("ix") * side, F.col("iz") * side, side))
    return ground.select("uuid", *keys, part.alias("part")).groupBy("uuid", *keys).agg(F.sum("part.left").alias("area"), F.sum("part.both").alias("shared"))


def overlay_area(left: DataFrame, right: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, left, right, area`` of every pair of surfaces (``uuid, seq``) of a building that overlap seen from above."""
    both = near_pairs(regions(left, "uuid", "seq"), regions(right, "uuid", "seq"), side)
    both = both.select("uuid", F.col("l.seq").alias("left"), F.col("r.seq").alias("right"), O.overlaid(F.col("l.region"), F.col("r.region"))["both"].alias("area"))
    return both.where(F.col("area") > SLIVER)


def covered(floors: DataFrame, covers: DataFrame, side: float = SIDE) -> DataFrame:
    """Per floor (``uuid, seq``): its area and the share that any of ``covers`` in the building lies over."""
    own, over = regions(floors, "uuid", "seq"), regions(covers, "uuid").select("uuid", "region")
    return shared_area(own, over, ["seq"], side=side).where(F.col("area") > SLIVER).select("uuid", "seq", "area", (F.col("shared") / F.col("area")).alias("share"))


def coverage_report(covers: DataFrame) -> DataFrame:
    """Of the rows that ``covered`` gives: rooms by the share and by the area that nothing covers (over 0.05 m2), and the share of all floor area, as ``kind, bin, n, value``."""
    gap = covers.withColumn("gap", F.col("area") * (1 - F.col("share")))
    gappy = gap.where("gap > 0.05").withColumns({"by_share": K.bin_right_closed(F.round(1 - F.col("share"), 9), GAP_SHARES), "by_area": K.bin_right_closed(F.round("gap", 9), GAP_AREAS)})
    bins = [gappy.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("bin")).agg(F.count("*").alias("n"), F.sum("gap").alias("value")) for kind, c in (("share", "by_share"), ("area", "by_area"))]
    whole = gap.agg(F.lit("all").alias("kind"), F.lit("").alias("bin"), F.count("*").alias("n"), (F.sum("gap") / F.sum("area")).alias("value"))
    return bins[0].unionByName(bins[1]).unionByName(whole)


def parts(rows: DataFrame, keys: list[str], reach: float = 1e-6, side: float = SIDE, crowds: Crowds | None = None) -> DataFrame:
    """``uuid, keys, seq, component``: which surfaces (``corners``) of a key hang together, when widened by ``reach``, by least ``seq``.

    Surfaces meet by their boxes, grown by as far as mitres reach; those that overlap as they are hang together, and only the others of these pairs are widened.
    """
    rows = rows.where("size(corners) >= 3").select("uuid", *keys, "seq", "corners")
    grown = 5 * reach + 1e-6
    point = lambda x, sx, z, sz: F.struct((F.col(f"__box.{x}") + sx * grown).alias("x"), F.lit(0.0).alias("y"), (F.col(f"__box.{z}") + sz * grown).alias("z"))
    around = F.array(F.array(F.array(point("x0", -1, "z0", -1), point("x1", 1, "z0", -1), point("x1", 1, "z1", 1), point("x0", -1, "z1", 1))))
    own = G.settled(rows.withColumn("__box", G.box(F.col("corners"))), "__box").withColumn("region", around).drop("__box")
    both = near_pairs(own, own, side, keys, crowds).where(F.col("l.seq") < F.col("r.seq"))
    both = both.select("uuid", F.col("l.seq").alias("a"), F.col("r.seq").alias("b"), F.col("l.corners").alias("x"), F.col("r.corners").alias("y"))
    both = both.withColumn("plain", O.overlaid(F.array(O.rings(F.col("x"))), F.array(O.rings(F.col("y"))))["both"] > SLIVER)
    both = G.settled(both.withColumns({c: F.when(~F.col("plain"), O.buffered(F.col(c), reach)) for c in "xy"}), "plain", "x", "y")
    both = both.withColumn("wide", O.overlaid(F.col("x"), F.col("y"))["both"]).where(F.col("plain") | (F.col("wide") > SLIVER)).select("uuid", "a", "b")
    return rows.drop("corners").join(heads(both).withColumnRenamed("node", "seq"), ["uuid", "seq"], "left").withColumn("component", F.coalesce("component", "seq")).select("uuid", *keys, "seq", "component")


def coverage_gaps(floors: DataFrame, ceilings: DataFrame, walls: DataFrame | None = None, least: float = 0.5, smallest: float = 1.0, slack: float = 0.5, side: float = SIDE) -> DataFrame:
    """Rooms whose floor, of at least ``smallest`` m2, is covered by less than ``least``: high under a fifth, else med.

    A ceiling counts where its top comes within ``slack`` of the top of the room's walls, or the room has none. The floors of a room are one; a room whose floors do not hang
    together is left out. Surfaces are ``uuid, seq, room, corners``.
    """
    tops = (floors.limit(0) if walls is None else walls).groupBy("uuid", "room").agg(F.max(G.high(F.col("corners"))).alias("wall_top"))
    own = regions(floors.where("room is not null"), "uuid", "seq", "room")
    crowds = Crowds(floors.select("uuid").unionByName(ceilings.select("uuid")))
    apart = parts(own, ["room"], side=side, crowds=crowds).groupBy("uuid", "room").agg(F.count_distinct("component").alias("n")).where("n > 1")
    own = own.join(apart, ["uuid", "room"], "left_anti").join(tops, ["uuid", "room"], "left")
    over = regions(ceilings, "uuid").select("uuid", "region", G.high(F.col("corners")).alias("top"))
    reaches = F.col("wall_top").isNull() | (F.col("top") >= F.col("wall_top") - slack)
    rows = shared_area(own, over, ["room", "wall_top"], reaches, side, crowds).withColumns({"area": F.round("area", 9), "share": F.round(F.col("shared") / F.col("area"), 9)})
    rows = rows.where((F.col("area") >= smallest) & (F.col("share") < least))
    return rows.select("uuid", "room", F.lit("ceiling_coverage_gap").alias("rule"), F.when(F.col("share") < 0.2, "high").otherwise("med").alias("severity"), F.round("area", 6).alias("floor_area"), F.round("share", 6).alias("evidence"))


def envelope(floors: DataFrame, reach: float = 0.5, side: float = SIDE) -> DataFrame:
    """``uuid, region``: the largest part of a building's floors, each widened by ``reach`` with mitred corners. Of equal parts the one with the least ``seq``."""
    label = parts(floors, [], reach, side)
    wide = G.settled(floors.where("size(corners) >= 3").select("uuid", "seq", O.buffered(F.col("corners"), reach).alias("region")), "region").join(label, ["uuid", "seq"])
    size = shared_area(wide, None, ["component"], side=side)
    largest = size.groupBy("uuid").agg(F.min_by("component", F.struct(-F.round("area", 6), F.col("component"))).alias("component"))
    return wide.join(largest, ["uuid", "component"], "left_semi").select("uuid", "region")


def out_of_envelope(surfaces: DataFrame, floors: DataFrame, reach: float = 0.5, area: float = 0.25, ratio: float = 0.05, side: float = SIDE) -> DataFrame:
    """Surfaces that stand out of the envelope of their building by an area and a share of their own: high by more than half or 5 m2, else med.

    Buildings without floors have no envelope and no flags. The rule is for walls, ceilings, gaps, knee walls and dormer faces.
    """
    own = surfaces.where("size(corners) >= 3").select("uuid", "seq", F.array(O.rings(F.col("corners"))).alias("region"))
    edge = envelope(floors, reach, side)
    rows = shared_area(own, edge, ["seq"], side=side).join(floors.where("size(corners) >= 3").select("uuid").distinct(), "uuid", "left_semi").where(F.col("area") >= SLIVER)
    rows = rows.withColumns({"outside": F.greatest(F.lit(0.0), F.col("area") - F.col("shared"))}).withColumn("share", F.col("outside") / F.col("area"))
    rows = rows.where((F.round("outside", 9) >= area) & (F.round("share", 9) >= ratio))
    level = F.when((F.round("share", 9) > 0.5) | (F.round("outside", 9) > 5.0), "high").otherwise("med")
    return rows.select("uuid", "seq", F.lit("out_of_envelope").alias("rule"), level.alias("severity"), F.round("outside", 6).alias("outside"), F.round("share", 6).alias("share"))


def inside_point(corners: Column) -> Column:
    """A point inside a polygon: the middle of the widest stretch of the line along x that runs midway between the corners next above and next below the middle of its box."""
    def between(b):
        middle = (b["low"] + b["high"]) / 2
        return F.struct(((F.array_max(F.filter(b["zs"], lambda z: z <= middle)) + F.array_min(F.filter(b["zs"], lambda z: z > middle))) / 2).alias("z"), b["corners"].alias("corners"))

    def crossings(line):
        sides = F.transform(line["corners"], lambda p, i: F.struct(p.alias("p"), F.get(line["corners"], (i + 1) % F.size(line["corners"])).alias("q")))
        cut = F.filter(sides, lambda s: (s["p"]["z"] > line["z"]) != (s["q"]["z"] > line["z"]))
        xs = F.transform(cut, lambda s: s["p"]["x"] + (line["z"] - s["p"]["z"]) * (s["q"]["x"] - s["p"]["x"]) / (s["q"]["z"] - s["p"]["z"]))
        return F.struct(line["z"].alias("z"), F.array_sort(xs).alias("xs"))

    def widest(line):
        spans = F.transform(line["xs"], lambda x, i: F.when((i % 2 == 0) & (i + 1 < F.size(line["xs"])), F.struct((F.get(line["xs"], i + 1) - x).alias("size"), (-i).alias("first"), ((F.get(line["xs"], i + 1) + x) / 2).alias("x"), line["z"].alias("z"))))
        return F.array_max(spans)

    flat = F.transform(corners, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z")))
    box = lambda f: F.struct(f.alias("corners"), F.transform(f, lambda p: p["z"]).alias("zs"), F.array_min(F.transform(f, lambda p: p["z"])).alias("low"), F.array_max(F.transform(f, lambda p: p["z"])).alias("high"))
    best = G.once(flat, lambda f: G.once(box(f), lambda b: G.once(between(b), lambda line: G.once(crossings(line), widest))))
    return F.when(F.size(corners) >= 3, best)


def _middle(axis: str) -> Column:
    listed = lambda points: sum((p[axis] for p in points), F.lit(0.0))
    return G._few(F.col("corners"), listed, (4, 2, 3), F.aggregate("corners", F.lit(0.0), lambda s, p: s + p[axis])) / F.size("corners")


def point_lookup(points: DataFrame, polygons: DataFrame, side: float = SIDE) -> DataFrame:
    """The polygon (``uuid, seq, corners``) that holds each point (``uuid, point, x, z``): of several the one with the nearest centre, then the least ``seq``."""
    near = held_by(points, polygons.withColumns({"cx": _middle("x"), "cz": _middle("z")}).select("uuid", "seq", "cx", "cz", "corners"), side)
    away = F.struct(F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2, 9), F.col("seq"))
    return near.groupBy("uuid", "point").agg(F.min_by("seq", away).alias("seq"))


def ceiling_below_floor(ceilings: DataFrame, floors: DataFrame, walls: DataFrame, slack: float = 0.05, side: float = SIDE) -> DataFrame:
    """Ceilings whose top is under the top of the floor that holds a point inside them.

    Of several floors, the first (by ``seq``) of a story whose walls' height, and half a metre, holds the middle of the ceiling's height; if there is none, the first.
    """
    points = ceilings.where("size(corners) >= 3").select("uuid", "seq", "locator_id", G.low(F.col("corners")).alias("low"), G.high(F.col("corners")).alias("top"), inside_point(F.col("corners")).alias("p"))
    points = points.select("uuid", "seq", "locator_id", "top", ((F.col("low") + F.col("top")) / 2).alias("middle"), "p.x", "p.z")
    beds = floors.where("size(corners) >= 3").select("uuid", F.col("seq").alias("bed"), "story", G.high(F.col("corners")).alias("floor_y"), "corners")
    held = held_by(points, beds, side).join(story_bands(walls).select("uuid", "story", F.col("low").alias("band_low"), F.col("high").alias("band_high")), ["uuid", "story"], "left")
    own = F.coalesce(F.col("middle").between(F.col("band_low") - 0.5, F.col("band_high") + 0.5), F.lit(False))
    first = held.groupBy("uuid", "seq", "locator_id", "top").agg(F.min_by("floor_y", F.struct(~own, F.col("bed"))).alias("floor_y"))
    return first.where(F.col("top") < F.col("floor_y") - slack).select("uuid", "seq", "locator_id", F.lit("ceiling_below_floor").alias("rule"), F.lit("high").alias("severity"), F.round(F.col("floor_y") - F.col("top"), 6).alias("evidence"))


def edges(surfaces: DataFrame, keys: tuple[str, ...] = ("uuid", "story", "room", "seq")) -> DataFrame:
    """The sides of each polygon seen from above: ``keys, side, x1, z1, x2, z2``."""
    rows = surfaces.where("size(corners) >= 3").select(*keys, F.posexplode(G.sides(F.col("corners"))).alias("side", "s"))
    return rows.select(*keys, "side", *[F.col(f"s.{a}.{b}").alias(f"{b}{n}") for a, n in (("p", 1), ("q", 2)) for b in ("x", "z")])


def edge_angle(a: str, b: str) -> Column:
    """Degrees, 0 to 90, between two edges."""
    turn = lambda e: F.degrees(F.atan2(F.col(f"{e}.z2") - F.col(f"{e}.z1"), F.col(f"{e}.x2") - F.col(f"{e}.x1")))
    return K.circular_difference(turn(a), turn(b), 180.0)


def edge_gap(a: str, b: str) -> tuple[Column, Column]:
    """The distance of edge ``b``'s middle from the line of ``a``, and the share of the shorter edge that they have side by side."""
    dx, dz = F.col(f"{a}.x2") - F.col(f"{a}.x1"), F.col(f"{a}.z2") - F.col(f"{a}.z1")
    size = F.sqrt(dx * dx + dz * dz)
    along = lambda x, z: ((F.col(x) - F.col(f"{a}.x1")) * dx + (F.col(z) - F.col(f"{a}.z1")) * dz) / size
    middle = lambda c: (F.col(f"{b}.{c}1") + F.col(f"{b}.{c}2")) / 2
    gap = F.abs((middle("x") - F.col(f"{a}.x1")) * dz - (middle("z") - F.col(f"{a}.z1")) * dx) / size
    s, t = along(f"{b}.x1", f"{b}.z1"), along(f"{b}.x2", f"{b}.z2")
    side = F.greatest(F.lit(0.0), F.least(size, F.greatest(s, t)) - F.greatest(F.lit(0.0), F.least(s, t)))
    return gap, side / F.least(size, F.abs(t - s) + 1e-12)


def edge_pairs(floors: DataFrame, most: float = 0.4, angle: float = 15.0, overlap: float = 0.3, least: float = 0.1) -> DataFrame:
    """Edges of two rooms of a story that run side by side at most ``most`` m apart: thickness in cm and confidence.

    Edges meet where their middles lie in one cell of 8 m or in cells that touch; in stories of more than ``CROWD`` edges they are dealt to these cells, in others they meet by story. Neither side is sent whole to all tasks.
    """
    rows = edges(floors).withColumn("size", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("z2") - F.col("z1")) ** 2)).where(F.col("size") >= least)
    reach = 8.0  # metres in a cell of middles
    rows = rows.withColumns({"cx": F.floor((F.col("x1") + F.col("x2")) / 2 / reach), "cz": F.floor((F.col("z1") + F.col("z2")) / 2 / reach)})
    rows = rows.withColumn("place", F.xxhash64("uuid", "story"))  # a key for null buildings and stories too
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    met = []
    for many, (some,) in by_crowd(rows, keys=("place",)):
        other, same = some, [F.col("a.place") == F.col("b.place"), *[F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("uuid", "story")]]
        if many:
            other = some.withColumn("n", near).withColumns({"cx": F.col("cx") + F.col("n.i"), "cz": F.col("cz") + F.col("n.j")}).drop("n")
            same += [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cx", "cz")]
        else:
            same += [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1 for c in ("cx", "cz")]
        ends = [F.struct(*[f"{s}.{c}" for c in ("uuid", "seq", "side", "x1", "z1", "x2", "z2")]).alias(s) for s in "ab"]
        met.append(some.alias("a").join(other.alias("b").hint("merge"), [*same, F.col("a.room") < F.col("b.room")]).select(*ends))
    both = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    gap, share = edge_gap("a", "b")
    both = both.select(F.col("a.uuid").alias("uuid"), F.col("a.seq").alias("seq_a"), F.col("a.side").alias("side_a"), F.col("b.seq").alias("seq_b"), F.col("b.side").alias("side_b"), gap.alias("gap"), share.alias("overlap"), edge_angle("a", "b").alias("angle"))
    both = both.where((F.col("gap") <= most) & (F.col("angle") <= angle) & (F.col("overlap") >= overlap))
    sure = F.when((F.col("overlap") >= 0.7) & (F.col("angle") <= 5), "high").when(F.col("overlap") >= 0.5, "medium").otherwise("low")
    return both.withColumns({"thickness_cm": F.round(F.col("gap") * 100, 1), "confidence": sure})


def coplanar_groups(pieces: DataFrame, component: float = 0.05, offset: float = 0.5) -> DataFrame:
    """Pieces (``uuid, seq, plane``) in groups of planes that are equal within a tolerance, or linked by such: ``uuid, node, component``."""
    rows = pieces.where("plane is not null").select("uuid", F.col("seq").alias("node"), "plane", F.floor(F.col("plane.d") / (2 * offset)).alias("band"))
    right = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    same = (F.col("a.uuid") == F.col("b.uuid")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node"))
    close = [F.abs(F.col(f"a.plane.{k}") - F.col(f"b.plane.{k}")) <= t for k, t in (("a", component), ("b", component), ("c", component), ("d", offset))]
    links = rows.alias("a").join(right.alias("b"), same & close[0] & close[1] & close[2] & close[3]).select("a.uuid", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return connected(rows, links)


def fragmented(groups: DataFrame) -> DataFrame:
    """Members of coplanar groups of two and more, with the number of their siblings."""
    size = F.count("*").over(Window.partitionBy("uuid", "component"))
    return groups.withColumn("n", size).where("n > 1").select("uuid", F.col("node").alias("seq"), F.lit("roof_fragmented").alias("rule"), (F.col("n") - 1).alias("siblings"))
