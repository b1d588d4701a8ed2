"""What lies over what in a building: classes of overlap, shares of shapes in common, surfaces across wings, rooms that hang together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..sources.scratch import written
from .graph import connected
from .spatial import SIDE, SLIVER, Crowds, near_pairs, parts, regions, shared_area

# fixed values: classes of overlap, m2 and metres
CLASSES = ("ceiling_spans_rooms", "ceiling_floor_dup", "shared_wall_unmerged", "floor_overlap", "roof_vs_top_ceiling", "gap_closure_overlap")
CEILING_M2, FLOOR_M2, GAP_M2, GAP_SHARE, STORY_M, FLAT = 0.01, 0.30, 0.01, 0.10, 0.30, 0.996


def areas_between(left: DataFrame, right: DataFrame, by: Column, side: float = SIDE, crowds: Crowds | None = None) -> DataFrame:
    """``uuid, l, key, area``: for each row of ``left`` (struct ``l``, told apart by ``l.seq``) and each key ``by`` (of the structs ``l`` and ``r``) the area that it shares with the union of the regions of ``right``."""
    pairs = near_pairs(left, right, side, crowds=crowds).withColumn("key", by)
    union = pairs.groupBy("uuid", F.col("l.seq").alias("seq"), "key").agg(F.first("l").alias("l"), F.flatten(F.collect_list("r.region")).alias("over"))
    return union.withColumn("area", O.overlaid(F.col("l.region"), F.col("over"))["both"]).where(F.col("area") > SLIVER).select("uuid", "l", "key", "area")


def room_floors(floors: DataFrame, side: float = SIDE, crowds: Crowds | None = None) -> DataFrame:
    """``uuid, room, story, seq, corners, region, floor_y`` of the pieces that make a room's floor: all, or the first one where they do not hang together; ``floor_y`` is the mean over the room's pieces of their corners' mean."""
    own = regions(floors.where("room is not null"), "uuid", "room", "story", "seq")
    label = parts(own, ["room"], side=side, crowds=crowds).groupBy("uuid", "room").agg(F.count_distinct("component").alias("n"), F.min("seq").alias("first"))
    mean = F.aggregate("corners", F.lit(0.0), lambda s, p: s + p["y"]) / F.size("corners")
    height = floors.where("room is not null and size(corners) > 0").groupBy("uuid", "room").agg(F.avg(mean).alias("floor_y"))
    return own.join(label, ["uuid", "room"]).where("n = 1 or seq = first").join(height, ["uuid", "room"]).drop("n", "first")


def _centre(corners: Column) -> Column:
    """The centre of a polygon's area, seen from above; of its corners where it has none."""
    def weigh(f):
        sides = F.transform(f, lambda p, i: F.struct(p.alias("p"), F.get(f, (i + 1) % F.size(f)).alias("q")))
        cross = lambda e: e["p"]["x"] * e["q"]["z"] - e["q"]["x"] * e["p"]["z"]
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
        return F.aggregate(sides, zero, lambda s, e: F.struct((s["a"] + cross(e)).alias("a"), (s["x"] + (e["p"]["x"] + e["q"]["x"]) * cross(e)).alias("x"), (s["z"] + (e["p"]["z"] + e["q"]["z"]) * cross(e)).alias("z")))

    mean = lambda k: F.aggregate(F.transform(corners, lambda p: p[k]), F.lit(0.0), lambda s, v: s + v) / F.size(corners)
    return G.once(G.once(corners, weigh), lambda s: F.when(F.abs(s["a"]) > 1e-12, F.struct((s["x"] / (3 * s["a"])).alias("x"), (s["z"] / (3 * s["a"])).alias("z"))).otherwise(F.struct(mean("x").alias("x"), mean("z").alias("z"))))


def overlap_findings(surfaces: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, class, place, said``: one row for each finding of the six classes, ``place`` in the order of the surfaces.

    Surfaces are ``uuid, seq, category, story, room, locator_id, kind, plane, corners, openings``. A ceiling over more than one room's floor; a level ceiling at the height of a floor
    that it lies over; walls of two rooms on parallel planes at most 0.6 m apart; floors of two rooms of a story that overlap, but do not hold one another; a level ceiling under a sloped one; and a
    gap or stitch that lies over a ceiling or a floor by more than a tenth of its own area.
    """
    crowds = Crowds(surfaces)
    rooms = written(room_floors(surfaces.where("category = 'floor'"), side, crowds), "floors")  # read by four of the classes
    beds = rooms.select("uuid", "seq", "room", "story", "floor_y", "region")
    outline = lambda rows, *keep: regions(rows.drop("openings"), "uuid", "seq", "locator_id", *keep)
    ceilings = surfaces.where("category = 'ceiling'")
    level = F.abs(F.coalesce("plane.b", F.lit(0.0))) >= FLAT
    over = areas_between(regions(ceilings, "uuid", "seq", "locator_id"), beds, F.col("r.room"), side, crowds).where(F.col("area") > CEILING_M2)
    spans = over.groupBy("uuid", F.col("l.seq").alias("seq"), F.col("l.locator_id").alias("said")).agg(F.count("*").alias("n")).where("n > 1").select("uuid", F.lit(CLASSES[0]).alias("class"), "seq", F.lit(0).alias("then"), "said")
    flat = outline(ceilings.where(F.col("plane").isNotNull() & level).withColumn("c", _centre(F.col("corners"))).withColumn("at", G.plane_y_at(F.col("plane"), F.col("c.x"), F.col("c.z"))).drop("c"), "at")
    on = areas_between(flat, beds, F.struct("r.room", "r.floor_y"), side, crowds).where((F.col("area") > CEILING_M2) & (F.abs(F.col("key.floor_y") - F.col("l.at")) <= STORY_M))
    copies = on.select("uuid", F.lit(CLASSES[1]).alias("class"), F.col("l.seq").alias("seq"), F.lit(0).alias("then"), F.col("l.locator_id").alias("said")).distinct()
    from .surfaces import shared_wall_pairs

    names = surfaces.select("uuid", F.col("seq").alias("seq_a"), F.col("locator_id").alias("said"))
    walls = shared_wall_pairs(surfaces.where("category = 'wall'")).join(names, ["uuid", "seq_a"]).select("uuid", F.lit(CLASSES[2]).alias("class"), F.col("seq_a").alias("seq"), F.col("seq_b").alias("then"), "said")
    sizes = shared_area(beds, None, ["room"], side=side, crowds=crowds).select("uuid", "room", F.col("area").alias("size"))
    meet = near_pairs(beds, beds, side, crowds=crowds).where("l.story <=> r.story and l.room < r.room").groupBy("uuid", F.col("l.room").alias("a"), F.col("r.room").alias("b"), F.col("l.story").alias("story")).agg(F.flatten(F.collect_set("l.region")).alias("x"), F.flatten(F.collect_set("r.region")).alias("y"))
    meet = meet.withColumn("area", O.overlaid(F.col("x"), F.col("y"))["both"]).where(F.col("area") > FLOOR_M2)
    meet = meet.join(sizes.select("uuid", F.col("room").alias("a"), F.col("size").alias("size_a")), ["uuid", "a"]).join(sizes.select("uuid", F.col("room").alias("b"), F.col("size").alias("size_b")), ["uuid", "b"])
    apart = meet.where(F.col("area") < F.least("size_a", "size_b") - 1e-6)
    text = F.concat_ws("|", F.concat(F.lit("room "), F.col("a")), F.concat(F.lit("story="), F.col("story")), F.concat(F.lit("area="), F.format_string("%.2f", "area"), F.lit("m2")))
    floors = apart.select("uuid", F.lit(CLASSES[3]).alias("class"), F.col("a").alias("seq"), F.col("b").alias("then"), text.alias("said"))
    sloped = outline(ceilings.where(F.col("plane").isNotNull() & ~level))
    under = areas_between(flat.drop("at"), sloped, F.col("r.seq"), side, crowds).where(F.col("area") > CEILING_M2).select("uuid", F.lit(CLASSES[4]).alias("class"), F.col("l.seq").alias("seq"), F.lit(0).alias("then"), F.col("l.locator_id").alias("said")).distinct()
    gaps = outline(surfaces.where("category = 'gap' and (kind like '%stitch%' or kind like '%gap%')"))
    allowed = F.greatest(F.lit(GAP_M2), GAP_SHARE * G.area_xz(F.col("l.corners")))
    hits = [areas_between(gaps, beds, F.col("r.room"), side, crowds), areas_between(gaps, outline(ceilings), F.col("r.seq"), side, crowds)]
    closed = reduce(DataFrame.unionByName, [h.withColumn("key", F.col("key").cast("string")) for h in hits]).where(F.round(F.col("area") - allowed, 9) > 0)
    closed = closed.select("uuid", F.lit(CLASSES[5]).alias("class"), F.col("l.seq").alias("seq"), F.lit(0).alias("then"), F.col("l.locator_id").alias("said")).distinct()
    kinds = [r.select("uuid", "class", F.struct(F.col("seq").cast("long").alias("seq"), F.col("then").cast("long").alias("then")).alias("place"), F.col("said").cast("string").alias("said")) for r in (spans, copies, walls, floors, under, closed)]
    return reduce(DataFrame.unionByName, kinds)


def overlap_classes(surfaces: DataFrame, samples: int = 3, side: float = SIDE) -> DataFrame:
    """``uuid, class, n, samples`` for every building and each of the six classes (0 where there is none), with the first ``samples`` locators."""
    surfaces = written(surfaces.select("uuid", "seq", "category", "story", "room", "locator_id", "kind", "plane", "corners", "openings"), "surfaces")  # read many times below
    place = F.row_number().over(Window.partitionBy("uuid", "class").orderBy("place"))
    found = overlap_findings(surfaces, side).withColumn("at", place).groupBy("uuid", "class")  # the findings are worked out once, for numbers and samples
    counts = found.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("at") <= samples, F.struct("at", "said")))), lambda s: s["said"]).alias("samples"))
    every = surfaces.select("uuid").distinct().withColumn("class", F.explode(F.array(*map(F.lit, CLASSES))))
    rows = every.join(counts, ["uuid", "class"], "left")
    return rows.select("uuid", "class", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def iou_with(segments: DataFrame, shapes: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, seq, other, shared, iou, cover``: for every segment (``uuid, seq, corners``) and shape that it overlaps, the area in common over that of both together, and over its own."""
    pairs = near_pairs(regions(segments, "uuid", "seq"), regions(shapes, "uuid", "seq"), side)
    rows = pairs.select("uuid", F.col("l.seq").alias("seq"), F.col("r.seq").alias("other"), O.overlaid(F.col("l.region"), F.col("r.region")).alias("o")).where(F.col("o.both") > SLIVER)
    return rows.select("uuid", "seq", "other", F.col("o.both").alias("shared"), (F.col("o.both") / (F.col("o.left") + F.col("o.right") - F.col("o.both"))).alias("iou"), (F.col("o.both") / F.col("o.left")).alias("cover"))


def iou_features(segments: DataFrame, footprints: DataFrame, building_parts: DataFrame, roofs: DataFrame, side: float = SIDE) -> DataFrame:
    """Per segment with an area: ``iou`` and ``cover`` with the building's footprint (0 where they are apart), with the largest part that holds the segment's centre, and with the best of the final roofs; how many roofs it
    overlaps and the area of their union. A building has one footprint; what is missing gives null."""
    from .spatial import held_by

    own = segments.where("size(corners) >= 3").withColumn("own", G.area_xz(F.col("corners"))).where(F.col("own") > SLIVER)
    named = lambda rows, name: rows.select("uuid", "seq", F.col("iou").alias(f"iou_{name}"), F.col("cover").alias(f"cover_{name}"))
    base = own.select("uuid", "seq").join(footprints.where("size(corners) >= 3").select("uuid", F.lit(True).alias("has")).distinct(), "uuid", "left")
    whole = named(iou_with(own, footprints, side), "footprint")
    centre = own.withColumn("c", _centre(F.col("corners"))).select("uuid", "seq", "c.x", "c.z")
    sized = building_parts.withColumn("part_area", G.area_xz(F.col("corners"))).select("uuid", F.col("seq").alias("other"), "part_area", "corners")
    best = held_by(centre, sized, side).groupBy("uuid", "seq").agg(F.min_by("other", F.struct(-F.round("part_area", 9), F.col("other"))).alias("other"))
    part = named(iou_with(own, building_parts, side).join(best, ["uuid", "seq", "other"]), "part")
    over = iou_with(own, roofs, side)
    top = over.groupBy("uuid", "seq").agg(F.max_by(F.struct("iou", "cover"), F.struct(F.round("iou", 9), -F.col("other"))).alias("t"), F.count("*").alias("n_roofs")).select("uuid", "seq", F.col("t.iou").alias("iou_roof"), F.col("t.cover").alias("cover_roof"), "n_roofs")
    pieces = over.select("uuid", "seq", "other").join(regions(roofs, "uuid", "seq").select("uuid", F.col("seq").alias("other"), "region"), ["uuid", "other"])
    union = shared_area(pieces, None, ["seq"], side=side).select("uuid", "seq", F.col("area").alias("roof_union"))
    rows = base
    for more in (whole, part, top, union):
        rows = rows.join(more, ["uuid", "seq"], "left")
    zero = {f"{k}_footprint": F.when(F.col("has"), F.coalesce(f"{k}_footprint", F.lit(0.0))) for k in ("iou", "cover")}
    return rows.withColumns({**zero, "n_roofs": F.coalesce("n_roofs", F.lit(0))}).drop("has")


def across_wings(pieces: DataFrame, wings: DataFrame, key: str, rule: str, least: float = 1.0, side: float = SIDE) -> DataFrame:
    """Groups of pieces (``uuid, key, seq, locator_id, corners``) whose union lies over two wings (``uuid, wing, corners``) or more by ``least`` m2 each, named by their largest piece.

    With ``key`` a coplanar group this is the rule for roof surfaces, with a wall's strip that for strips. Buildings with fewer than two wings have no flags.
    """
    own = regions(pieces, "uuid", key, "seq", "locator_id")
    over = near_pairs(own, regions(wings, "uuid", "wing"), side).groupBy("uuid", F.col(f"l.{key}").alias(key), F.col("r.wing").alias("wing")).agg(F.flatten(F.collect_list("l.region")).alias("x"), F.first("r.region").alias("y"))
    over = over.where(F.round(O.overlaid(F.col("x"), F.col("y"))["both"], 9) >= least).groupBy("uuid", key).agg(F.array_sort(F.collect_list("wing")).alias("wings")).where("size(wings) >= 2")
    largest = own.groupBy("uuid", key).agg(F.min_by(F.struct("seq", "locator_id"), F.struct(-F.round(G.area_xz(F.col("corners")), 9), F.col("seq"))).alias("m"))
    return over.join(largest, ["uuid", key]).select("uuid", F.col("m.seq").alias("seq"), F.col("m.locator_id").alias("locator_id"), F.lit(rule).alias("rule"), F.lit("med").alias("severity"), "wings")


def room_graph(facing: DataFrame, doors: DataFrame) -> DataFrame:
    """``uuid, a, b, shared_m, by_door``: rooms that share walls, with the length in common, or are joined by a door.

    ``facing`` has pairs of walls that face each other (``uuid, room_a, wall_a, room_b, wall_b, overlap_m``); a negative wall is a made-up one that holds no doors. A door
    (``uuid, room, wall``) leads to every room that faces its wall.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    walls = facing.where("room_a != room_b and overlap_m > 0").select("uuid", *pair("room_a", "room_b"), "overlap_m").groupBy("uuid", "a", "b").agg(F.sum("overlap_m").alias("shared_m"))
    sides = [facing.where(f"wall_{x} >= 0").select("uuid", F.col(f"room_{x}").alias("room"), F.col(f"wall_{x}").alias("wall"), F.col(f"room_{y}").alias("other")) for x, y in ("ab", "ba")]
    led = doors.join(sides[0].unionByName(sides[1]), ["uuid", "room", "wall"]).where("room != other").select("uuid", *pair("room", "other"), F.lit(True).alias("by_door")).distinct()
    both = walls.join(led, ["uuid", "a", "b"], "full")
    return both.select("uuid", "a", "b", F.coalesce("shared_m", F.lit(0.0)).alias("shared_m"), F.coalesce("by_door", F.lit(False)).alias("by_door"))


def room_graph_components(rooms: DataFrame, graph: DataFrame) -> DataFrame:
    """``uuid, node, component`` of every room (``uuid, room``) under the links that ``room_graph`` gives."""
    return connected(rooms.select("uuid", F.col("room").alias("node")).distinct(), graph.select("uuid", "a", "b"))
