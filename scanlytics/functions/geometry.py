"""Column functions over polygons and planes. All built-in expressions.

A polygon is ``ARRAY<STRUCT<x, y, z>>`` with y up; a plane is ``STRUCT<a, b, c, d>`` with ``a x + b y + c z = d``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out a single time, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def settled(rows: DataFrame, *names: str) -> DataFrame:
    """Columns that are worked out once a row. Spark otherwise writes their expressions into each place that names them, and inside lambdas works them out for each element."""
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names)))).select(*rows.columns)


def _few(corners: Column, f: Callable[[list[Column]], Column], sizes: tuple[int, ...], otherwise: Column) -> Column:
    """``f`` of the corners one by one for lists of ``sizes``, which Spark compiles; ``otherwise`` for others, whose lambdas it interprets."""
    out = F.when(F.size(corners) == sizes[0], f([F.get(corners, F.lit(i)) for i in range(sizes[0])]))
    for n in sizes[1:]:
        out = out.when(F.size(corners) == n, f([F.get(corners, F.lit(i)) for i in range(n)]))
    return out.otherwise(otherwise)


def moved(corners: Column, f: Callable[[Column], Column]) -> Column:
    """The list of ``f`` of every corner; ``corners`` should be settled."""
    return _few(corners, lambda points: F.array(*map(f, points)), (4, 2, 3), F.transform(corners, f))


def sides(corners: Column, p: str = "p", q: str = "q") -> Column:
    """Each corner with the next one; the last with the first."""
    return once(corners, lambda c: F.transform(c, lambda a, i: F.struct(a.alias(p), F.get(c, (i + 1) % F.size(c)).alias(q))))


def area_xz(corners: Column) -> Column:
    """Area of the polygon seen from above; 0 with fewer than three corners."""
    twice = F.aggregate(sides(corners), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["z"] - e["q"]["x"] * e["p"]["z"])
    return F.when(F.size(corners) >= 3, F.abs(twice) / 2).otherwise(0.0)


def turning(corners: Column) -> Column:
    """The polygon's normal, twice its area long. Null with fewer than three corners."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in AXES])

    def add(s, e):
        p, q = e["p"], e["q"]
        part = {k: (p[u] - q[u]) * (p[v] + q[v]) for k, u, v in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
        return F.struct(*[(s[k] + part[k]).alias(k) for k in AXES])

    return F.when(F.size(corners) >= 3, F.aggregate(sides(corners), zero, add))


def length(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def area_3d(corners: Column) -> Column:
    def listed(points):
        sums = {}
        for k, u, v in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")):
            sums[k] = F.lit(0.0)
            for i, p in enumerate(points):
                q = points[(i + 1) % len(points)]
                sums[k] = sums[k] + (p[u] - q[u]) * (p[v] + q[v])
        return length(sums)

    return F.coalesce(_few(corners, listed, (4, 3), once(turning(corners), length)) / 2, F.lit(0.0))


def unit_normal(corners: Column) -> Column:
    """Null where the polygon has no area (normal shorter than 1e-12)."""
    def scaled(n):
        return once(length(n), lambda size: F.when(size >= 1e-12, F.struct(*[(n[k] / size).alias(k) for k in AXES])))

    return once(turning(corners), scaled)


def net_area(corners: Column, openings: Column) -> Column:
    """Area without holes or cutouts, at least 0."""
    cut = F.aggregate(F.coalesce(openings, F.array()), F.lit(0.0), lambda s, o: s + area_3d(o))
    return F.greatest(F.lit(0.0), area_3d(corners) - cut)


def low(corners: Column, axis: str = "y") -> Column:
    return _few(corners, lambda points: F.least(*[p[axis] for p in points]), (4, 2, 3), F.array_min(F.transform(corners, lambda p: p[axis])))


def high(corners: Column, axis: str = "y") -> Column:
    return _few(corners, lambda points: F.greatest(*[p[axis] for p in points]), (4, 2, 3), F.array_max(F.transform(corners, lambda p: p[axis])))


def box(corners: Column) -> Column:
    """The box seen from above."""
    return F.struct(low(corners, "x").alias("x0"), high(corners, "x").alias("x1"), low(corners, "z").alias("z0"), high(corners, "z").alias("z1"))


def box_overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    along = [F.greatest(F.lit(0.0), F.least(a[f"{k}1"], b[f"{k}1"]) - F.greatest(a[f"{k}0"], b[f"{k}0"])) for k in "xz"]
    return along[0] * along[1]


def plane_y_at(plane: Column, x: Column, z: Column, tiny: float = 1e-6) -> Column:
    """Height of a plane over a point; null for upright planes."""
    return F.when(F.abs(plane["b"]) > tiny, (plane["d"] - plane["a"] * x - plane["c"] * z) / plane["b"])


def worst_residual(plane: Column, corners: Column) -> Column:
    """Largest distance of a corner from the plane."""
    return F.array_max(F.transform(corners, lambda p: F.abs(plane["a"] * p["x"] + plane["b"] * p["y"] + plane["c"] * p["z"] - plane["d"])))


def inclination_deg(plane: Column) -> Column:
    """0 for level planes, 90 for upright ones; null for planes without a normal."""
    size = F.sqrt(plane["a"] * plane["a"] + plane["b"] * plane["b"] + plane["c"] * plane["c"])
    return F.when(size > 1e-9, F.degrees(F.acos(F.least(F.lit(1.0), F.abs(plane["b"]) / size))))


def azimuth_deg(plane: Column, downhill: bool = False) -> Column:
    """Compass direction from 0 to 360 of the normal, or of flowing water; no water flows on level planes."""
    sign = -1 if downhill else 1
    turn = F.pmod(F.degrees(F.atan2(sign * plane["a"], sign * plane["c"])), F.lit(360.0))
    slope = inclination_deg(plane)
    return F.when(slope >= 1e-3, turn) if downhill else F.when(slope.isNotNull(), turn)


def slope_class(slope: Column) -> Column:
    # fixed values: degrees
    return F.when(slope < 5, "nearly_flat").when(slope < 15, "shallow").when(slope < 60, "architectural").when(slope < 80, "steep").when(slope >= 80, "nearly_vertical")


def planes_equivalent(p: Column, q: Column, normal: float = 0.05, offset: float = 0.5) -> Column:
    near = [F.abs(p[k] - q[k]) < (offset if k == "d" else normal) for k in "abcd"]
    return near[0] & near[1] & near[2] & near[3]


def plane_key(plane: Column, normal: float = 2e-3, offset: float = 0.02) -> Column:
    """One key for a plane and its reverse: unit normal and offset in buckets, the largest component positive."""
    size = F.sqrt(plane["a"] * plane["a"] + plane["b"] * plane["b"] + plane["c"] * plane["c"])
    size = F.when(size > 0, size).otherwise(1.0)
    a, b, c = (F.abs(plane[k]) for k in "abc")
    leading = F.when((a >= b) & (a >= c), plane["a"]).when(b >= c, plane["b"]).otherwise(plane["c"])
    sign = F.when(leading < 0, -1.0).otherwise(1.0)
    return F.struct(*[F.bround(sign * (plane[k] / size) / (offset if k == "d" else normal)).cast("long").alias(k) for k in "abcd"])


def locator_kind(locator: Column) -> Column:
    """The middle of ``scope::kind::parts``; empty for other texts and null."""
    pieces = F.split(locator, "::", 3)
    return F.when(F.size(pieces) == 3, pieces[1]).otherwise("")


def locator_parts(locator: Column) -> Column:
    pieces = F.split(locator, "::", 3)
    return F.when((F.size(pieces) == 3) & (F.get(pieces, F.lit(2)) != ""), F.split(F.get(pieces, F.lit(2)), ":")).otherwise(F.array().cast("array<string>"))
