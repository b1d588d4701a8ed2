"""Queries over surfaces in space, bound to ``lineitem``: rectangles that are turned about the origin, each building by another
angle, so that areas and what holds what stay as they are and SQL has them in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as P
from ..sources.scratch import written
from .registry import query
from .surface_queries import _SF, surfaces


PART_ROWS = 500_000  # rows that one rule works on at once
PARTS = 8  # so many parts at most


def turned(corners, by):
    """Corners turned about the y axis by an angle."""
    return _turned(corners, F.cos(by), F.sin(by))


def _turned(corners, c, s):
    return G.moved(corners, lambda p: turned_point(p, c, s))


def turned_point(p, c, s):
    return F.struct((p["x"] * c - p["z"] * s).alias("x"), p["y"].alias("y"), (p["x"] * s + p["z"] * c).alias("z"))


def angle():
    return F.col("uuid") % 17 * 0.37


def turned_rows(rows):
    """Surfaces with their corners turned, each building by its angle."""
    by = G.settled(rows.withColumns({"__c": F.cos(angle()), "__s": F.sin(angle())}), "__c", "__s")
    return G.settled(by.withColumn("corners", _turned(F.col("corners"), F.col("__c"), F.col("__s"))).select(*rows.columns), "corners")


def _boxes(spark, sf_dir, *categories, turn=True, write=True):
    """The surfaces (of ``categories``, if any are named) without openings, with sides on a grid of half metres, turned by building; ``room`` holds all of a story."""
    half = G.moved(F.col("corners"), lambda p: F.struct((F.floor(p["x"] * 2) / 2).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    rows = surfaces(spark, sf_dir)
    rows = G.settled((rows.where(F.col("category").isin(*categories)) if categories else rows).withColumns({"corners": half, "openings": F.array().cast("array<array<struct<x:double,y:double,z:double>>>")}), "corners")
    rows = rows.where("size(corners) < 3 or corners[0].x < greatest(corners[1].x, get(corners, 2).x)")
    rows = (turned_rows(rows) if turn else G.settled(rows, "corners")).drop("adjacency", "source", "supp")
    return written(rows, "boxes") if write else rows  # read many times


_BOX = _SF + ", bx AS (SELECT *, x0 AS xa, floor((x0 + w) * 2) / 2 AS xb, z0 AS za, z0 + d AS zb FROM sf WHERE NOT few AND w > 0)"
_OVER = "greatest(0, least(a.xb, b.xb) - greatest(a.xa, b.xa)) * greatest(0, least(a.zb, b.zb) - greatest(a.za, b.za))"


@query("f13_point_in_polygon", _BOX + " SELECT uuid, seq, 3.25 > xa AND 3.25 < xb AND 4.25 > za AND 4.25 < zb AS inside FROM bx")
def f13(spark, sf_dir):
    rows = _boxes(spark, sf_dir).where("size(corners) >= 3")
    x, z = 3.25 * F.cos(angle()) - 4.25 * F.sin(angle()), 3.25 * F.sin(angle()) + 4.25 * F.cos(angle())
    return rows.select("uuid", "seq", P.point_in_polygon(F.col("corners"), x, z).alias("inside"))


@query("p1_overlay_area", _BOX + f" SELECT a.uuid, a.seq AS left, b.seq AS right, round({_OVER}, 6) AS area FROM bx a JOIN bx b ON a.uuid = b.uuid WHERE a.category = 'floor' AND b.category = 'ceiling' AND {_OVER} > 0".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def p1(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor", "ceiling")
    return P.overlay_area(rows.where("category = 'floor'"), rows.where("category = 'ceiling'")).withColumn("area", F.round("area", 6))


@query("p2_point_lookup", _BOX + ", pt AS (SELECT uuid, seq AS point, x0 + 0.25 AS x, z0 + 0.25 AS z FROM sf WHERE category = 'wall') SELECT p.uuid, point, arg_min(b.seq, (round(pow(x - (xa + xb) / 2, 2) + pow(z - (za + zb) / 2, 2), 9), b.seq)) AS seq FROM pt p JOIN bx b ON p.uuid = b.uuid AND b.category = 'floor' AND x >= xa AND x < xb AND z >= za AND z < zb GROUP BY p.uuid, point")
def p2(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor")
    at = lambda p: {"x": p["x"] + 0.25, "y": p["y"], "z": p["z"] + 0.25}
    points = surfaces(spark, sf_dir).where("category = 'wall'").withColumn("p", turned_point(at(F.col("corners")[0]), F.cos(angle()), F.sin(angle()))).select("uuid", F.col("seq").alias("point"), "p.x", "p.z")
    return P.point_lookup(points, rows.where("category = 'floor'"))


_COVER = _BOX + f""", pc AS (SELECT a.uuid, a.seq, (a.xb - a.xa) * (a.zb - a.za) AS area, greatest(a.xa, b.xa) AS xa, least(a.xb, b.xb) AS xb, greatest(a.za, b.za) AS za, least(a.zb, b.zb) AS zb, b.seq AS other FROM bx a LEFT JOIN bx b ON a.uuid = b.uuid AND b.category = 'ceiling' AND {_OVER} > 0 WHERE a.category = 'floor' AND (a.xb - a.xa) * (a.zb - a.za) > 0),
ce AS (SELECT DISTINCT uuid, seq, i, j FROM (SELECT uuid, seq, unnest(range(CAST(xa * 2 AS BIGINT), CAST(xb * 2 AS BIGINT))) AS i, za, zb FROM pc WHERE other IS NOT NULL), LATERAL (SELECT unnest(range(CAST(za * 2 AS BIGINT), CAST(zb * 2 AS BIGINT))) AS j)),
cv AS (SELECT p.uuid, p.seq, any_value(area) AS area, any_value(coalesce(n, 0)) * 0.25 / any_value(area) AS share FROM pc p LEFT JOIN (SELECT uuid, seq, count(*) AS n FROM ce GROUP BY ALL) c ON p.uuid = c.uuid AND p.seq = c.seq GROUP BY p.uuid, p.seq)"""


@query("g4_ceiling_cover", _COVER + " SELECT uuid, seq, round(area, 6) AS area, round(share, 6) AS share FROM cv")
def g4(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor", "ceiling")
    return P.covered(rows.where("category = 'floor'"), rows.where("category = 'ceiling'")).select("uuid", "seq", F.round("area", 6).alias("area"), F.round("share", 6).alias("share"))


def _bins(column, edges):
    return f"CASE " + " ".join(f"WHEN {column} <= {e:g} THEN '<= {e:g}'" for e in edges) + f" ELSE '> {edges[-1]:g}' END"


@query("g4_coverage_report", _COVER + f""", gp AS (SELECT area, round(1 - share, 9) AS gap_share, round(area * (1 - share), 9) AS gap FROM cv)
SELECT 'share' AS kind, {_bins('gap_share', P.GAP_SHARES)} AS bin, count(*) AS n, round(sum(gap), 4) AS value FROM gp WHERE gap > 0.05 GROUP BY ALL
UNION ALL SELECT 'area', {_bins('gap', P.GAP_AREAS)}, count(*), round(sum(gap), 4) FROM gp WHERE gap > 0.05 GROUP BY ALL UNION ALL SELECT 'all', '', count(*), round(sum(gap) / sum(area), 4) FROM gp""")
def g4_report(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor", "ceiling")
    return P.coverage_report(P.covered(rows.where("category = 'floor'"), rows.where("category = 'ceiling'"))).withColumn("value", F.round("value", 4))


# rooms of one story and one third of a building's floors; a room counts where all its floors overlap in a chain, found here by spreading the least number
_ROOM = _BOX + f""", fl AS (SELECT uuid, room, seq, xa, xb, za, zb FROM bx WHERE category = 'floor' AND xb > xa AND zb > za),
tc AS (SELECT a.uuid, a.room, a.seq AS s, b.seq AS t FROM fl a JOIN fl b ON a.uuid = b.uuid AND a.room = b.room AND (least(a.xb, b.xb) - greatest(a.xa, b.xa) > 0 AND least(a.zb, b.zb) - greatest(a.za, b.za) >= 0 OR least(a.xb, b.xb) - greatest(a.xa, b.xa) >= 0 AND least(a.zb, b.zb) - greatest(a.za, b.za) > 0)),
rc AS (WITH RECURSIVE go AS (SELECT uuid, room, s, t FROM tc UNION SELECT go.uuid, go.room, go.s, tc.t FROM go JOIN tc ON go.uuid = tc.uuid AND go.room = tc.room AND go.t = tc.s) SELECT uuid, room, s, min(t) AS component FROM go GROUP BY ALL),
whole AS (SELECT uuid, room FROM rc GROUP BY uuid, room HAVING count(DISTINCT component) = 1),
tops AS (SELECT uuid, room, max(y + h) AS top FROM sf WHERE category = 'wall' GROUP BY uuid, room),
ce AS (SELECT uuid, room, unnest(range(CAST(xa * 2 AS BIGINT), CAST(xb * 2 AS BIGINT))) AS i, za, zb FROM fl JOIN whole USING (uuid, room)),
cf AS (SELECT DISTINCT uuid, room, i, j FROM ce, LATERAL (SELECT unnest(range(CAST(za * 2 AS BIGINT), CAST(zb * 2 AS BIGINT))) AS j)),
cv AS (SELECT cf.uuid, cf.room, count(DISTINCT (i, j)) * 0.25 AS area, count(DISTINCT CASE WHEN c.seq IS NOT NULL THEN (i, j) END) * 0.25 AS over FROM cf LEFT JOIN tops USING (uuid, room)
 LEFT JOIN bx c ON c.uuid = cf.uuid AND c.category = 'ceiling' AND (top IS NULL OR c.y + c.h >= top - 0.5) AND i >= c.xa * 2 AND i < c.xb * 2 AND j >= c.za * 2 AND j < c.zb * 2 GROUP BY ALL)
SELECT uuid, room, 'ceiling_coverage_gap' AS rule, CASE WHEN over / area < 0.2 THEN 'high' ELSE 'med' END AS severity, CAST(round(area, 6) AS DOUBLE) AS floor_area, CAST(round(over / area, 6) AS DOUBLE) AS evidence FROM cv WHERE area >= 1 AND over / area < 0.5"""


@query("r8_ceiling_coverage_gap", _ROOM)
def r8(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor", "ceiling")
    return P.coverage_gaps(rows.where("category = 'floor'"), rows.where("category = 'ceiling'"), surfaces(spark, sf_dir).where("category = 'wall'"))


@query("r7_ceiling_below_floor", _BOX + """, bands AS (SELECT uuid, story, min(y) AS low, max(y + h) AS high FROM sf WHERE category = 'wall' GROUP BY ALL),
h AS (SELECT a.uuid, a.seq, a.locator_id, a.y + a.h AS top, arg_min(b.y + b.h, (NOT coalesce(a.y + a.h / 2 BETWEEN low - 0.5 AND high + 0.5, false), b.seq)) AS floor_y FROM bx a JOIN bx b ON a.uuid = b.uuid AND b.category = 'floor'
 AND (a.xa + a.xb) / 2 + 0.013 BETWEEN b.xa AND b.xb AND (a.za + a.zb) / 2 + 0.017 BETWEEN b.za AND b.zb AND b.xb > b.xa LEFT JOIN bands ON bands.uuid = b.uuid AND bands.story = b.story WHERE a.category = 'ceiling' AND a.xb > a.xa GROUP BY ALL)
SELECT uuid, seq, locator_id, 'ceiling_below_floor' AS rule, 'high' AS severity, round(floor_y - top, 6) AS evidence FROM h WHERE top < floor_y - 0.05""")
def r7(spark, sf_dir):
    rows = _boxes(spark, sf_dir, "floor", "ceiling", turn=False)
    aside = G.moved(F.col("corners"), lambda p: F.struct((p["x"] + 0.013).alias("x"), p["y"].alias("y"), (p["z"] + 0.017).alias("z")))
    ceilings = turned_rows(rows.where("category = 'ceiling'").withColumn("corners", aside))
    floors = turned_rows(rows.where("category = 'floor'"))
    return P.ceiling_below_floor(ceilings, floors, surfaces(spark, sf_dir))


@query("p6_coplanar_groups", None)
def p6(spark, sf_dir):
    """Components of equal planes among the ceilings of a building; a test compares them with a plain search."""
    return P.coplanar_groups(surfaces(spark, sf_dir).where("category in ('ceiling', 'dormer_face')"))


@query("r12_roof_fragmented", None)
def r12(spark, sf_dir):
    return P.fragmented(P.coplanar_groups(surfaces(spark, sf_dir).where("category in ('ceiling', 'dormer_face')")))


@query("p5_edge_pairs", None)
def p5(spark, sf_dir):
    return P.edge_pairs(_boxes(spark, sf_dir, "floor", "gap"))


_WIDE = _BOX + f""", fl AS (SELECT uuid, seq, xa - 0.5 AS xa, xb + 0.5 AS xb, za - 0.5 AS za, zb + 0.5 AS zb FROM bx WHERE category = 'floor' AND xb > xa AND zb > za),
tc AS (SELECT a.uuid, a.seq AS s, b.seq AS t FROM fl a JOIN fl b ON a.uuid = b.uuid AND {_OVER} > 0),
rc AS (WITH RECURSIVE go AS (SELECT uuid, s, t FROM tc UNION SELECT go.uuid, go.s, tc.t FROM go JOIN tc ON go.uuid = tc.uuid AND go.t = tc.s) SELECT uuid, s AS seq, min(t) AS part FROM go GROUP BY ALL),
ce AS (SELECT DISTINCT uuid, part, i, j FROM (SELECT uuid, part, unnest(range(CAST(xa * 2 AS BIGINT), CAST(xb * 2 AS BIGINT))) AS i, za, zb FROM fl JOIN rc USING (uuid, seq)), LATERAL (SELECT unnest(range(CAST(za * 2 AS BIGINT), CAST(zb * 2 AS BIGINT))) AS j)),
best AS (SELECT uuid, arg_min(part, (-n, part)) AS part FROM (SELECT uuid, part, count(*) AS n FROM ce GROUP BY ALL) GROUP BY uuid),
inn AS (SELECT ce.* FROM ce JOIN best USING (uuid, part)),
ow AS (SELECT uuid, seq, i, j FROM (SELECT uuid, seq, unnest(range(CAST(xa * 2 AS BIGINT), CAST(xb * 2 AS BIGINT))) AS i, za, zb FROM bx WHERE category IN ('wall', 'ceiling', 'gap', 'knee_wall', 'dormer_face') AND xb > xa), LATERAL (SELECT unnest(range(CAST(za * 2 AS BIGINT), CAST(zb * 2 AS BIGINT))) AS j)),
ot AS (SELECT o.uuid, o.seq, count(*) * 0.25 AS area, count(*) FILTER (WHERE inn.i IS NULL) * 0.25 AS outside FROM ow o JOIN best USING (uuid) LEFT JOIN inn ON inn.uuid = o.uuid AND inn.i = o.i AND inn.j = o.j GROUP BY ALL)
SELECT uuid, seq, 'out_of_envelope' AS rule, CASE WHEN outside / area > 0.5 OR outside > 5 THEN 'high' ELSE 'med' END AS severity, CAST(round(outside, 6) AS DOUBLE) AS outside, CAST(round(outside / area, 6) AS DOUBLE) AS share FROM ot WHERE outside >= 0.25 AND outside / area >= 0.05"""


@query("r9_out_of_envelope", _WIDE)
def r9(spark, sf_dir):
    rows = written(_boxes(spark, sf_dir, write=False).select("uuid", "seq", "category", "corners"), "boxes")
    flags = lambda some: P.out_of_envelope(some.where("category in ('wall', 'ceiling', 'gap', 'knee_wall', 'dormer_face')"), some.where("category = 'floor'"))
    return in_parts(rows, flags)


def in_parts(rows, rule, least=PART_ROWS, most=PARTS):
    """``rule`` of all rows, of a part of the buildings at a time where there are more than ``least`` rows; what a part shuffles takes no disk in the next."""
    n = min(most, 1 + rows.count() // least)
    if n == 1:
        return rule(rows)
    found = [written(rule(rows.where(F.pmod(F.xxhash64("uuid"), F.lit(n)) == part)), "found") for part in range(n)]
    return reduce(lambda a, b: a.unionByName(b), found)
