"""Edges and tops of surfaces: nearest segments, classes of ceiling edges, trust in wall tops, dormers without a slope, walls that end below their story's height.

Nearest distances among few are found directly, among more than ``CROWD`` rows by rings: points and segments meet in squares of a grid whose side is the reach, and what has found nothing within it goes on with four times the reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import overlay as O
from ..sources.scratch import written
from .spatial import SIDE, SLIVER, by_crowd, tiles

NEAR = 1.0  # metres of the first ring
_SHAPE = ("span", "ax", "az", "mx", "mz")


def to_segment(p: Column, a: Column, b: Column, axes: str = "xz") -> Column:
    """Distance of a point from a segment, in the plane seen from above or in space."""
    along = {k: b[k] - a[k] for k in axes}
    square = sum((along[k] * along[k] for k in axes), F.lit(0.0))
    t = F.when(square > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((along[k] * (p[k] - a[k]) for k in axes), F.lit(0.0)) / square))).otherwise(0.0)
    return F.sqrt(sum(((p[k] - a[k] - t * along[k]) * (p[k] - a[k] - t * along[k]) for k in axes), F.lit(0.0)))


def _rings(asked: DataFrame, keys: list[str], ids: list[str], pairs: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """``keys, ids, distance``: the least that ``pairs`` (rows with ``distance``) finds for each asked row, once it lies within the reach of its ring."""
    left, done, reach = written(asked, "asked"), [], NEAR
    while True:
        best = written(pairs(left, reach).groupBy(*keys, *ids).agg(F.min("distance").alias("distance")).where(F.col("distance") <= reach), "ring")
        done.append(best)
        left = written(left.join(best, [*keys, *ids], "left_anti"), "asked")
        if left.isEmpty():
            break
        reach *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def nearest_segment(points: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], axes: str = "xz") -> DataFrame:
    """``keys, ids, distance`` from each point (``keys, ids, p``) to the nearest segment (``keys, a, b``) of its keys. Points without any have no row."""
    segments = written(segments, "segments")  # read in each ring
    found = []
    for many, (some, lines) in by_crowd(points, segments, keys=tuple(keys)):
        if many:
            found.append(_nearest_by_rings(some, lines, keys, ids, axes))
        else:
            met = some.join(lines, keys).withColumn("distance", to_segment(F.col("p"), F.col("a"), F.col("b"), axes))
            found.append(met.groupBy(*keys, *ids).agg(F.min("distance").alias("distance")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _nearest_by_rings(points: DataFrame, segments: DataFrame, keys: list[str], ids: list[str], axes: str) -> DataFrame:
    have = segments.select(*keys).distinct()

    def pairs(left: DataFrame, reach: float) -> DataFrame:
        at = left.withColumns({f"i{k}": F.floor(F.col(f"p.{k}") / reach) for k in "xz"})
        rows = segments
        for k in "xz":
            low, high = F.floor((F.least(f"a.{k}", f"b.{k}") - reach) / reach), F.floor((F.greatest(f"a.{k}", f"b.{k}") + reach) / reach)
            rows = rows.withColumn(f"i{k}", F.explode(F.sequence(low, high)))
        both = at.join(rows, [*keys, "ix", "iz"])
        return both.withColumn("distance", to_segment(F.col("p"), F.col("a"), F.col("b"), axes))

    return _rings(points.join(have, keys, "left_semi"), keys, ids, pairs)


def wall_top_segments(walls: DataFrame, slack: float = 0.10) -> DataFrame:
    """``uuid, room, a, b``: the lines between a wall's corners within ``slack`` of its top, in the order of x and z and back to the first."""
    tops = F.filter("corners", lambda p: F.abs(p["y"] - F.col("top")) <= slack)
    rows = walls.where("size(corners) >= 3").withColumn("top", G.high(F.col("corners"))).select("uuid", "room", F.array_sort(F.transform(tops, lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"), p["y"].alias("y")))).alias("t")).where("size(t) >= 2")
    return rows.select("uuid", "room", F.inline(G.sides(F.col("t"), "a", "b")))


def wall_top_trust(ceilings: DataFrame, walls: DataFrame, trusted: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Per ceiling plane (``uuid, room, seq``) and per room: corners, median and 95th percentile of the distances in space from its corners to the room's wall tops, and the share of at most ``trusted`` m.

    Rooms without wall tops and planes with fewer than three corners have no row.
    """
    segments = wall_top_segments(walls)
    points = ceilings.where("size(corners) >= 3").select("uuid", "room", "seq", F.posexplode("corners").alias("i", "p"))
    found = nearest_segment(points, segments, ["uuid", "room"], ["seq", "i"], "xyz")
    said = [F.count("*").alias("n_corners"), F.percentile("distance", 0.5).alias("p50"), F.percentile("distance", 0.95).alias("p95"), (F.count_if(F.round("distance", 9) <= trusted) / F.count("*")).alias("trust")]
    return found.groupBy("uuid", "room", "seq").agg(*said), found.groupBy("uuid", "room").agg(*said)


def dormer_without_host_slope(dormers: DataFrame, ceilings: DataFrame, most: float = 0.30, level: float = 0.95, side: float = SIDE) -> DataFrame:
    """Dormer faces further than ``most`` m from every sloped ceiling of their building (the larger of the distances seen from above and in height), and all of them where there is no sloped ceiling.

    ``evidence`` is the distance to the nearest, null without one. A face or ceiling without an area seen from above takes no part.
    """
    faces = dormers.select("uuid", "seq", "locator_id", "corners")
    slopes = ceilings.where("size(corners) >= 3").withColumns({"up": G.unit_normal(F.col("corners"))["y"], "__area": G.area_xz(F.col("corners"))})
    slopes = G.settled(slopes, "up", "__area").where((F.abs("up") <= level) & (F.col("__area") >= SLIVER)).select("uuid", F.col("corners").alias("slope"))
    slopes = written(slopes.withColumns({"slope_low": G.low(F.col("slope")), "slope_high": G.high(F.col("slope"))}), "slopes")  # read in each ring
    some = slopes.select("uuid").distinct()
    asked = faces.where("size(corners) >= 3").where(G.area_xz(F.col("corners")) >= SLIVER).join(some, "uuid", "left_semi")
    sides = lambda c: G.sides(c, "a", "b")
    apart = lambda points, lines: F.array_min(F.transform(points, lambda p: F.array_min(F.transform(lines, lambda s: to_segment(p, s["a"], s["b"])))))

    def met(left: DataFrame, reach: float) -> DataFrame:
        grid = max(side, reach)
        own = tiles(left, side=grid)
        for k in "xz":  # a face looks round itself as far as the reach
            own = own.drop(f"i{k}")
        own = own.distinct()
        for k in "xz":
            own = own.withColumn(f"i{k}", F.explode(F.sequence(F.floor((F.col(f"{k}0") - reach) / grid), F.floor((F.col(f"{k}1") + reach) / grid))))
        own = own.drop("x0", "x1", "z0", "z1")
        other = tiles(slopes, F.col("slope"), grid).drop("x0", "x1", "z0", "z1")
        return own.join(other, ["uuid", "ix", "iz"]).drop("ix", "iz").distinct()

    def measured(both: DataFrame) -> DataFrame:
        both = both.withColumns({"lines": sides(F.col("corners")), "others": sides(F.col("slope"))})
        shared = O.overlaid(F.array(O.rings(F.col("corners"))), F.array(O.rings(F.col("slope"))))["both"]
        flat = F.when(F.col("shared") > SLIVER, 0.0).otherwise(F.least(apart(F.col("corners"), F.col("others")), apart(F.col("slope"), F.col("lines"))))
        height = F.greatest(F.lit(0.0), F.greatest(G.low(F.col("corners")), F.col("slope_low")) - F.least(G.high(F.col("corners")), F.col("slope_high")))
        return both.withColumn("shared", shared).withColumn("distance", F.greatest(flat, height))

    near = []
    for many, (some_faces, some_slopes) in by_crowd(asked, slopes):
        if many:
            near.append(_rings(some_faces, ["uuid"], ["seq"], lambda left, reach: measured(met(left, reach))))
        else:
            near.append(measured(some_faces.join(some_slopes, "uuid")).groupBy("uuid", "seq").agg(F.min("distance").alias("distance")))
    found = near[0] if len(near) == 1 else near[0].unionByName(near[1])
    far = faces.join(found, ["uuid", "seq"]).where(F.round("distance", 9) > most).select("uuid", "seq", "locator_id", F.round("distance", 6).alias("evidence"))
    none = faces.join(some, "uuid", "left_anti").select("uuid", "seq", "locator_id", F.lit(None).cast("double").alias("evidence"))
    return far.unionByName(none).select("uuid", "seq", "locator_id", F.lit("dormer_without_host_slope").alias("rule"), F.lit("med").alias("severity"), "evidence")


def ceiling_edges(planes: DataFrame, shortest: float = 0.2, level: float = 0.05, steepest: float = 80.0) -> DataFrame:
    """``uuid, story, seq, side, a, b, normal, length, dy, horizontal`` of the edges of ceiling planes (``uuid, story, seq, corners``) that are not upright."""
    rows = planes.where("size(corners) >= 3").withColumn("normal", G.unit_normal(F.col("corners"))).where(F.col("normal").isNotNull() & (F.degrees(F.acos(F.least(F.lit(1.0), F.abs("normal.y")))) < steepest))
    pair = G.sides(F.col("corners"), "a", "b")
    out = rows.select("uuid", "story", "seq", "normal", F.posexplode(pair).alias("side", "e")).select("uuid", "story", "seq", "side", "e.a", "e.b", "normal")
    size = F.sqrt(sum(((F.col(f"b.{k}") - F.col(f"a.{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    out = out.withColumns({"length": size, "dy": F.abs(F.col("b.y") - F.col("a.y"))}).where(F.col("length") >= shortest)
    return out.withColumn("horizontal", F.round("dy", 9) <= level)


def edge_classes(planes: DataFrame, footprints: DataFrame, flat: float = 0.30, height: float = 0.20, angle: float = 10.0, eave: float = 0.50) -> DataFrame:
    """Level edges of ceiling planes as ``ridge_or_hip``, ``eave`` or ``isolated``: ``uuid, story, seq, side, length, y_mid, label, partner, partner_angle``.

    A ridge or hip has a level edge of another plane of the story whose ends lie at its ends, in either direction, within ``flat`` m seen from above and ``height`` m, and whose normal differs by ``angle``
    degrees or more; of several the one with the largest angle, then the least ``seq``. Stories of many edges have their ends meet in cells of these sizes. An eave has an end or its middle within ``eave`` m of the footprint (``uuid, corners``).
    """
    edges = written(ceiling_edges(planes).where("horizontal").drop("horizontal", "dy"), "edges")
    cell = lambda p, k: F.floor(F.col(f"{p}.{k}") / (height if k == "y" else flat))
    both_ways = edges.unionByName(edges.withColumns({"a": F.col("b"), "b": F.col("a")}))
    named = lambda rows: rows.select("uuid", "story", F.col("seq").alias("partner"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("normal").alias("turn"))

    def cells(some: DataFrame, others: DataFrame) -> DataFrame:
        other = named(others)
        for k in "xyz":
            other = other.withColumn(f"i{k}", F.explode(F.array(*[cell("c", k) + i for i in (-1, 0, 1)])))
        return some.withColumns({f"i{k}": cell("a", k) for k in "xyz"}).join(other, ["uuid", "story", "ix", "iy", "iz"]).drop("ix", "iy", "iz")

    close = lambda p, q: (F.hypot(F.col(f"{p}.x") - F.col(f"{q}.x"), F.col(f"{p}.z") - F.col(f"{q}.z")) <= flat) & (F.abs(F.col(f"{p}.y") - F.col(f"{q}.y")) <= height)
    near = []
    for many, (some, others) in by_crowd(edges, both_ways, keys=("uuid", "story")):
        near.append((cells(some, others) if many else some.join(named(others), ["uuid", "story"])).where((F.col("seq") != F.col("partner")) & close("a", "c") & close("b", "d")))
    met = near[0] if len(near) == 1 else near[0].unionByName(near[1])
    dot = sum((F.col(f"normal.{k}") * F.col(f"turn.{k}") for k in "xyz"), F.lit(0.0))
    met = met.withColumn("by", F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot))))).where(F.round("by", 9) >= angle)
    ridge = met.groupBy("uuid", "story", "seq", "side").agg(F.min_by(F.struct("partner", "by"), F.struct(-F.round("by", 9), F.col("partner"))).alias("r"))
    lines = footprints.where("size(corners) >= 2").select("uuid", F.inline(G.sides(F.col("corners"), "a", "b")))
    middle = F.struct(*[((F.col(f"a.{k}") + F.col(f"b.{k}")) / 2).alias(k) for k in "xyz"])
    points = edges.select("uuid", "story", "seq", "side", F.explode(F.array("a", "b", middle)).alias("p")).withColumns({f"i{k}": F.floor(F.col(f"p.{k}") / eave) for k in "xz"})
    for k in "xz":
        lines = lines.withColumn(f"i{k}", F.explode(F.sequence(F.floor((F.least(f"a.{k}", f"b.{k}") - eave) / eave), F.floor((F.greatest(f"a.{k}", f"b.{k}") + eave) / eave))))
    at = points.join(lines, ["uuid", "ix", "iz"]).where(F.round(to_segment(F.col("p"), F.col("a"), F.col("b")), 9) <= eave).select("uuid", "story", "seq", "side", F.lit(True).alias("at_eave")).distinct()
    rows = edges.join(ridge, ["uuid", "story", "seq", "side"], "left").join(at, ["uuid", "story", "seq", "side"], "left")
    label = F.when(F.col("r").isNotNull(), "ridge_or_hip").when(F.col("at_eave"), "eave").otherwise("isolated")
    return rows.select("uuid", "story", "seq", "side", "length", ((F.col("a.y") + F.col("b.y")) / 2).alias("y_mid"), label.alias("label"), F.col("r.partner").alias("partner"), F.col("r.by").alias("partner_angle"))


def edge_totals(planes: DataFrame, classes: DataFrame) -> DataFrame:
    """Per building: edges, level and sloped ones, and level ones by class."""
    every = ceiling_edges(planes).groupBy("uuid").agg(F.count("*").alias("n_edges"), F.count_if("horizontal").alias("n_level"))
    kinds = classes.groupBy("uuid").agg(*[F.count_if(F.col("label") == k).alias(k) for k in ("ridge_or_hip", "eave", "isolated")])
    return every.withColumn("n_sloped", F.col("n_edges") - F.col("n_level")).join(kinds, "uuid", "left").fillna(0, ["ridge_or_hip", "eave", "isolated"])


def wall_records(walls: DataFrame) -> DataFrame:
    """``uuid, story, seq, top, bottom, span, ax, az, mx, mz`` of walls with three corners, 0.1 m of height and 0.05 m of length.

    The span is the longest line between corners within 1 cm of the bottom, ``ax, az`` its direction, ``mx, mz`` the middle of these corners.
    """
    from .cohorts import longest_chord

    rows = walls.where("size(corners) >= 3").withColumns({"top": G.high(F.col("corners")), "bottom": G.low(F.col("corners"))})
    rows = G.settled(rows, "top", "bottom").withColumn("low", F.filter("corners", lambda p: p["y"] < F.col("bottom") + 0.01))
    rows = G.settled(rows, "low").where("size(low) >= 2 and round(top - bottom, 9) >= 0.1")
    rows = G.settled(rows.withColumn("c", longest_chord(F.col("low"))), "c").where(F.round("c.length", 9) >= 0.05)
    mean = lambda k: F.aggregate("low", F.lit(0.0), lambda s, p: s + p[k]) / F.size("low")
    rows = rows.select("uuid", "story", "seq", "top", "bottom", F.col("c.length").alias("span"), (F.col("c.dx") / F.col("c.length")).alias("ax"), (F.col("c.dz") / F.col("c.length")).alias("az"), mean("x").alias("mx"), mean("z").alias("mz"))
    return written(rows, "walls")  # all pairs of corners are tried once, not in every step that reads this


def dominant_height(records: DataFrame, reach: float = 0.15, least: float = 0.0) -> DataFrame:
    """``uuid, story, dominant_y, coverage, perimeter, cohort_floor``: the group of wall tops with the largest span of a story, with gaps of at most ``reach`` m inside.

    ``dominant_y`` is the mean of its tops by span, ``coverage`` its share of the story's span, ``cohort_floor`` the median by span of the bottoms of walls that end within ``reach`` of it. Of equal groups the
    lowest. Stories under ``least`` coverage are left out. The tops of a story stand in one window, by different heights.
    """
    tops = records.groupBy("uuid", "story", F.round("top", 9).alias("top")).agg(F.sum("span").alias("span"))
    by = Window.partitionBy("uuid", "story").orderBy("top")
    tops = tops.withColumn("new", F.coalesce((F.round(F.col("top") - F.lag("top").over(by), 9) > reach).cast("int"), F.lit(1))).withColumn("group", F.sum("new").over(by))
    groups = tops.groupBy("uuid", "story", "group").agg(F.sum("span").alias("weight"), (F.sum(F.col("top") * F.col("span")) / F.sum("span")).alias("centre"))
    best = groups.groupBy("uuid", "story").agg(F.min_by(F.struct("centre", "weight"), F.struct(-F.round("weight", 9), F.col("group"))).alias("m"), F.sum("weight").alias("perimeter"))
    best = best.select("uuid", "story", F.col("m.centre").alias("dominant_y"), (F.col("m.weight") / F.col("perimeter")).alias("coverage"), "perimeter")
    low = records.join(best, ["uuid", "story"]).where(F.round(F.abs(F.col("top") - F.col("dominant_y")), 9) <= reach).groupBy("uuid", "story", F.round("bottom", 9).alias("bottom")).agg(F.sum("span").alias("span"))
    run = Window.partitionBy("uuid", "story")
    low = low.withColumns({"so_far": F.sum("span").over(run.orderBy("bottom")), "all": F.sum("span").over(run)}).where("round(so_far, 9) >= round(all / 2, 9)").groupBy("uuid", "story").agg(F.min("bottom").alias("cohort_floor"))
    return best.join(low, ["uuid", "story"], "left").where(F.round("coverage", 9) >= least)


def low_walls(records: DataFrame, cohorts: DataFrame, reach: float = 0.15, short: tuple[float, float] = (0.10, 0.40), share: float = 0.25, floor: float = 0.10, angle: float = 8.0, offset: float = 0.15, gap: float = 0.80) -> DataFrame:
    """``uuid, story, seq, delta, floor_pass, all_pass`` of walls that end below their story's height by ``short`` m and are no longer than ``share`` of the story.

    ``floor_pass`` asks that the wall stands on the cohort's floor, ``all_pass`` besides that a wall of the cohort goes on along its line: turned by at most ``angle`` degrees, ``offset`` m aside, and ``gap`` m
    away along it. Walls whose middles stand in one small square and whose directions are in one small class go on along each other and are not tried; the others are tried once for each
    shape (span, direction and middle) of a story, with the shapes of the cohort that they meet in squares of a grid.
    """
    rows = records.join(written(cohorts, "cohorts"), ["uuid", "story"]).withColumn("delta", F.col("dominant_y") - F.col("top"))
    raw = rows.where(F.round("delta", 9).between(*short) & (F.round(F.col("span") - share * F.col("perimeter"), 9) <= 0))
    raw = written(raw.withColumn("floor_pass", F.coalesce(F.round(F.abs(F.col("bottom") - F.col("cohort_floor")), 9) <= floor, F.lit(False))), "low")
    high = written(rows.where(F.round(F.abs("delta"), 9) <= reach).select("uuid", "story", "seq", *_SHAPE), "high")
    seen = [F.min("seq").alias("first"), F.max("seq").alias("last")]
    another = (F.col("first") != F.col("seq")) | (F.col("last") != F.col("seq"))  # a wall does not go on along itself
    small = max(min(offset, gap) / 2, 1e-10)  # two middles in one square are nearer than the offset and the gap
    spot = {"px": F.floor(F.col("mx") / small), "pz": F.floor(F.col("mz") / small), "way": F.floor(F.pmod(F.degrees(F.atan2("az", "ax")), F.lit(180.0)) / (angle / 2))}
    here = high.withColumns(spot).groupBy("uuid", "story", *spot).agg(*seen)
    target = raw.where("floor_pass").select("uuid", "story", "seq", *_SHAPE).withColumns(spot).join(here, ["uuid", "story", *spot], "left")
    target = written(target.select("uuid", "story", "seq", *_SHAPE, F.coalesce(another, F.lit(False)).alias("near")), "targets")
    rest = target.where("not near").drop("near")
    ends = lambda p, more: [F.struct(*[(F.col(f"{p}m{k}") + s * F.col(f"{p}a{k}") * (F.col(f"{p}span") / 2 + more)).alias(k) for k in "xz"]) for s in (-1, 1)]
    box = [F.col(f"{k}{i}") for k in "xz" for i in (0, 1)]
    own = tiles(rest.select("uuid", "story", *_SHAPE).distinct(), F.array(*ends("", gap)), SIDE).withColumn("box", F.struct(*box)).drop("x0", "x1", "z0", "z1")
    other = high.groupBy("uuid", "story", *[F.col(k).alias(f"o_{k}") for k in _SHAPE]).agg(*seen)
    # a turned wall that goes on stands aside by the offset and by its turn over half its span at most
    aside = offset + 1e-6 + (math.sin(math.radians(min(angle, 90.0))) + 1 - math.cos(math.radians(min(angle, 90.0)))) * F.col("o_span") / 2
    wide = [F.struct(*[(e[k] + s * aside).alias(k) for k in "xz"]) for e in ends("o_", 0.0) for s in (-1, 1)]
    other = tiles(other, F.array(*wide), SIDE).withColumn("o_box", F.struct(*box)).drop("x0", "x1", "z0", "z1")
    both = own.join(other, ["uuid", "story", "ix", "iz"])
    for k in "xz":  # a pair counts in the square of the least corner that the boxes share
        low, top = F.greatest(f"box.{k}0", f"o_box.{k}0"), F.least(f"box.{k}1", f"o_box.{k}1")
        both = both.where((low <= top) & (F.floor(low / SIDE) == F.col(f"i{k}")))
    turn = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(F.col("ax") * F.col("o_ax") + F.col("az") * F.col("o_az")))))
    dx, dz = F.col("o_mx") - F.col("mx"), F.col("o_mz") - F.col("mz")
    along = F.round(F.abs(dx * F.col("ax") + dz * F.col("az")) - (F.col("span") + F.col("o_span")) / 2, 9) <= gap
    both = both.where(F.round(F.abs(dz * F.col("ax") - dx * F.col("az")), 9) <= offset).where(along).where(F.round(turn, 9) <= angle)
    met = both.groupBy("uuid", "story", *_SHAPE).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    tried = rest.join(met, ["uuid", "story", *_SHAPE]).where(another)
    goes_on = target.where("near").select("uuid", "story", "seq").unionByName(tried.select("uuid", "story", "seq")).withColumn("all_pass", F.lit(True))
    return raw.join(goes_on, ["uuid", "story", "seq"], "left").select("uuid", "story", "seq", "delta", "floor_pass", F.coalesce("all_pass", F.lit(False)).alias("all_pass"))
