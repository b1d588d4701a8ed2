"""Heights of ceilings and roofs over points: the lower and the upper envelope of the planes of a wing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import written
from .spatial import SIDE, Crowds, _middle, held_by

TINY = 1e-6


def _winged(points: DataFrame, wings: DataFrame, side: float, crowds: Crowds) -> DataFrame:
    """``uuid, point, x, z, wing`` of points that a wing holds: of several the one with the nearest centre, then the least."""
    rows = held_by(points.select("uuid", "point", "x", "z"), wings.select("uuid", "wing", "corners", _middle("x").alias("cx"), _middle("z").alias("cz")), side, crowds)
    return rows.groupBy("uuid", "point", "x", "z").agg(F.min_by("wing", F.struct(F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2, 9), F.col("wing"))).alias("wing"))


def _over(at: DataFrame, planes: DataFrame, side: float, crowds: Crowds) -> DataFrame:
    """A row for each plane of a point's wing whose outline holds the point, with its height there."""
    own = planes.select("uuid", F.col("seq").alias("plane_seq"), F.col("wing").alias("plane_wing"), "plane", "corners")
    return held_by(at, own, side, crowds).where(_same_wing("plane_wing")).withColumn("y", G.plane_y_at(F.col("plane"), F.col("x"), F.col("z"), TINY)).where("y is not null")


def _same_wing(other: str) -> Column:
    """Not ``<=>``, which would become a key of the join and deal rows anew that are dealt by building already."""
    return (F.col("wing") == F.col(other)) | (F.col("wing").isNull() & F.col(other).isNull())


def _crowds(points: DataFrame, *tables: DataFrame) -> Crowds:
    every = points.select("uuid")
    for more in tables:
        every = every.unionByName(more.select("uuid"))
    return Crowds(every)


def _resolved(rows: DataFrame, order: Column, reason: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(F.round(order, 9).alias("by"), F.col("plane_seq").alias("seq"), F.col("y"))))
    out = rows.groupBy("uuid", "point").agg(listed.alias("c"))
    return out.select("uuid", "point", F.col("c")[0]["y"].alias("y"), F.col("c")[0]["seq"].alias("chosen"), F.col("c.seq").alias("contenders"), F.when(F.size("c") == 1, "single_candidate").otherwise(reason).alias("reason"))


def ceiling_y_at(points: DataFrame, planes: DataFrame, floors: DataFrame, wings: DataFrame, side: float = SIDE) -> DataFrame:
    """``uuid, point, y, chosen, contenders, reason``: the lowest plane over the floor at each point (``uuid, point, x, z``).

    The wing with the nearest centre that holds the point gives the planes (``uuid, wing, seq, plane, corners``) and the floor (``uuid, wing, seq, corners``): the one of
    nearest centre that holds the point, by its first corner, or else the wing's lowest. Planes of equal height: the least ``seq``. Points outside all wings, of wings without
    floors or without a plane over the floor have no row; upright planes are none.
    """
    crowds = _crowds(points, planes, floors)
    at = written(_winged(points, wings, side, crowds), "winged")  # met by planes and by floors
    held = _over(at, planes, side, crowds)
    ground = floors.where("size(corners) > 0").withColumn("floor_y", F.col("corners")[0]["y"])
    own = held_by(at, ground.where("size(corners) >= 3").select("uuid", "seq", F.col("wing").alias("floor_wing"), "floor_y", _middle("x").alias("cx"), _middle("z").alias("cz"), "corners"), side, crowds).where(_same_wing("floor_wing"))
    away = F.struct(F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("z") - F.col("cz")) ** 2, 9), F.col("seq"))
    own = own.groupBy("uuid", "point").agg(F.min_by("floor_y", away).alias("own_y"))
    lowest = ground.groupBy("uuid", "wing").agg(F.min("floor_y").alias("low_y"))
    rows = held.join(lowest, ["uuid", "wing"]).join(own, ["uuid", "point"], "left").where(F.col("y") > F.coalesce("own_y", "low_y") + TINY)
    return _resolved(rows, F.col("y"), "min_y_above_floor")


def roof_y_at(points: DataFrame, planes: DataFrame, wings: DataFrame, side: float = SIDE) -> DataFrame:
    """As ``ceiling_y_at``, but the highest plane at each point, whatever the floor."""
    crowds = _crowds(points, planes)
    return _resolved(_over(_winged(points, wings, side, crowds), planes, side, crowds), -F.col("y"), "max_y")
