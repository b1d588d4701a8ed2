"""Capture operators: sessions by yaw, time gaps, story heights and outliers of rooms; raw against merged elements.

``rooms`` has ``uuid, seq`` (order in the file), ``created`` (epoch seconds), ``story, floor_type`` and ``t``
(16 doubles, column-major). ``raw`` and ``merged`` elements have ``uuid, seq, identifier, room_id, surface_type,
story, x, y, z``. Work is dealt by building (``uuid``); nothing gathers a building's rows in one value but where
the result is that list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import yaw_deg


def _by(*keys: str):
    return Window.partitionBy(*keys)


def with_pose(rooms: DataFrame) -> DataFrame:
    """Adds ``yaw`` and the position ``x, y, z`` of the transform; rooms whose transform has not 16 values are left out."""
    t = F.col("t")
    return rooms.where(F.size("t") == 16).withColumns({"yaw": yaw_deg(t), "x": t[12], "y": t[13], "z": t[14]})


def yaw_sessions(rooms: DataFrame, eps: float = 2.0) -> DataFrame:
    """Adds ``session`` (from 0, by first appearance): rooms whose sorted yaws stand at most ``eps`` degrees apart.

    The first and the last group are one where they meet across 180 degrees. A null yaw is a session of its own.
    """
    order = _by("uuid").orderBy(F.col("yaw").asc_nulls_last(), "seq")
    rows = rooms.withColumn("new", F.when(F.col("yaw") - F.lag("yaw").over(order) <= eps, 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("new").over(order))
    all_ = _by("uuid")
    last = F.max(F.when(F.col("yaw").isNotNull(), F.col("part"))).over(all_)
    meets = F.min("yaw").over(all_) + 360 - F.max("yaw").over(all_) <= eps
    rows = rows.withColumns({"last": last, "meets": meets})
    rows = rows.withColumn("part", F.when((F.col("part") == F.col("last")) & F.col("meets"), F.lit(1)).otherwise(F.col("part")))
    rows = rows.withColumn("first", F.min("seq").over(_by("uuid", "part")))
    return rows.withColumn("session", F.dense_rank().over(all_.orderBy("first")) - 1).drop("new", "part", "last", "meets", "first")


def session_summary(sessions: DataFrame) -> DataFrame:
    """Rooms, plain mean and spread of yaw, floor types and minutes from first to last room, per session."""
    return sessions.groupBy("uuid", "session").agg(
        F.count("*").alias("n_rooms"), (F.round(F.avg("yaw"), 6) + 0.0).alias("mean_yaw"), F.round(F.max("yaw") - F.min("yaw"), 6).alias("yaw_spread"),
        F.array_join(F.array_sort(F.collect_set("floor_type")), ",").alias("floor_types"), F.round((F.max("created") - F.min("created")) / 60, 1).alias("span_min"),
    )


def room_time_gaps(rooms: DataFrame, large_min: float = 10.0, eps: float = 2.0) -> DataFrame:
    """Each room against the one created before it; ``large`` looks at the rounded gap."""
    order = _by("uuid").orderBy("created", "seq")
    rows = rooms.withColumns({"from_seq": F.lag("seq").over(order), "gap": F.col("created") - F.lag("created").over(order), "turn": F.abs(F.col("yaw") - F.lag("yaw").over(order))})
    rows = rows.where("from_seq is not null").withColumn("gap_min", F.bround(F.col("gap") / 60, 1))
    same = (F.col("turn") < eps) | (F.abs(F.col("turn") - 360) < eps)
    return rows.select("uuid", "from_seq", "seq", "gap_min", F.bround("turn", 1).alias("yaw_change"), same.alias("same_session"), (F.col("gap_min") > large_min).alias("large"))


def story_y_spread(sessions: DataFrame, limit_m: float = 1.0) -> DataFrame:
    """Stories with two rooms or more whose heights span over ``limit_m``, with (room, height, session) of each room."""
    rows = sessions.groupBy("uuid", "story").agg((F.max("y") - F.min("y")).alias("y_range"), F.count("y").alias("n_rooms"), F.array_sort(F.collect_list(F.struct("seq", "y", "session"))).alias("rooms"))
    return rows.where((F.col("n_rooms") >= 2) & (F.col("y_range") > limit_m))


def floor_time_gaps(rooms: DataFrame, limit_s: float = 300.0) -> DataFrame:
    """Gaps between rooms inside each floor, and from the end of the floor begun before it (minutes)."""
    rows = rooms.withColumn("gap", F.col("created") - F.lag("created").over(_by("uuid", "story").orderBy("created", "seq")))
    floors = rows.groupBy("uuid", "story").agg(
        F.count_if(F.col("gap") > limit_s).alias("gaps_over"), (F.max("gap") / 60).alias("max_gap_min"), (F.min("gap") / 60).alias("min_gap_min"), F.min("created").alias("begun"), F.max("created").alias("ended")
    )
    before = F.lag("ended").over(_by("uuid").orderBy("begun", "story"))
    return floors.withColumn("from_previous_floor_min", (F.col("begun") - before) / 60).drop("begun", "ended")


def floor_consistency(rooms: DataFrame, limit_deg: float = 1.0) -> DataFrame:
    """Mean and population deviation of height and yaw per floor; ``one_yaw`` where yaws span less than ``limit_deg``."""
    mean = lambda f, c: F.round(f(c), 6) + 0.0
    return rooms.groupBy("uuid", "story").agg(
        F.count("*").alias("n_rooms"), mean(F.avg, "y").alias("mean_y"), mean(F.stddev_pop, "y").alias("std_y"), mean(F.avg, "yaw").alias("mean_yaw"), mean(F.stddev_pop, "yaw").alias("std_yaw"),
        (F.max("yaw") - F.min("yaw") < limit_deg).alias("one_yaw"),
    )


def zscore_outliers(rooms: DataFrame, k: float = 3.0) -> DataFrame:
    """Rooms further than ``k`` population deviations from the building's mean on an axis; ties go to X, then Y, then Z."""
    z = lambda c: F.round(F.abs(F.col(c) - F.avg(c).over(_by("uuid"))) / (F.stddev_pop(c).over(_by("uuid")) + 1e-10), 6)
    rows = rooms.withColumns({f"z_{c}": z(c) for c in "xyz"}).withColumn("z_max", F.greatest("z_x", "z_y", "z_z"))
    axis = F.when(F.col("z_x") == F.col("z_max"), "X").when(F.col("z_y") == F.col("z_max"), "Y").otherwise("Z")
    return rows.where(F.col("z_max") > k).select("uuid", "seq", axis.alias("axis"), F.col("z_max").alias("z"))


def story_ranges(rooms: DataFrame, small: float = 0.5, large: float = 6.0) -> DataFrame:
    """Pairs of stories of a building: OVERLAP, SMALL_GAP or LARGE_GAP of their heights, and whether neighbours are inverted.

    Stories are aggregated first, so a building has as many rows as stories.
    """
    stories = rooms.groupBy("uuid", "story").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"))
    stories = stories.withColumn("place", F.row_number().over(_by("uuid").orderBy("story")))
    a = stories.select("uuid", *[F.col(c).alias(f"a_{c}") for c in ("story", "low", "high", "mean", "place")])
    pairs = a.join(stories, "uuid").where(F.col("a_place") < F.col("place"))
    overlap = F.least("a_high", "high") - F.greatest("a_low", "low")
    finding = F.when(overlap > 0, "OVERLAP").when(-overlap < small, "SMALL_GAP").when(-overlap > large, "LARGE_GAP").otherwise("OK")
    inverted = (F.col("place") == F.col("a_place") + 1) & (F.col("a_mean") > F.col("mean"))
    return pairs.select("uuid", F.col("a_story").alias("lower"), F.col("story").alias("upper"), overlap.alias("overlap"), finding.alias("finding"), inverted.alias("inverted"))


def distinct_yaws(rooms: DataFrame) -> DataFrame:
    """Distinct yaws of a building in radians, rounded half to even to two decimals: how many, and their values in order."""
    yaw = F.bround(F.radians("yaw"), 2) + 0.0
    return rooms.groupBy("uuid").agg(F.count_distinct(yaw).alias("n_yaws"), F.array_sort(F.collect_set(yaw)).alias("yaws"), F.round(F.max("yaw") - F.min("yaw"), 6).alias("range_deg"))


def centroid_outliers(rooms: DataFrame) -> DataFrame:
    """Plan distance of each room to the building's centroid: beyond twice the upper median, 10 m, or mean plus two deviations."""
    b = _by("uuid")
    dx, dz = (F.col(c) - F.avg(c).over(b) for c in "xz")
    rows = rooms.withColumn("dist", F.sqrt(dx * dx + dz * dz))
    rows = rows.withColumns({"n": F.count("dist").over(b), "nth": F.row_number().over(b.orderBy("dist"))})
    upper = F.max(F.when(F.col("nth") == F.floor(F.col("n") / 2) + 1, F.col("dist"))).over(b)
    rows = rows.withColumns({"median": upper, "far": F.avg("dist").over(b) + 2 * F.stddev_pop("dist").over(b) + 1e-9})
    d = F.col("dist")
    return rows.select("uuid", "seq", F.round(d, 6).alias("dist"), ((d > 2 * F.col("median")) & (F.col("median") > 0.5)).alias("over_median"), (d > 10).alias("over_10m"), (d > F.col("far")).alias("over_2std"))


def _last_of_each(elements: DataFrame) -> DataFrame:
    """One element per identifier: the last."""
    kept = [c for c in elements.columns if c not in ("uuid", "identifier")]
    return elements.groupBy("uuid", "identifier").agg(F.max_by(F.struct(*kept), "seq").alias("e")).select("uuid", "identifier", "e.*")


def match_elements(merged: DataFrame, raw: DataFrame) -> DataFrame:
    """Every merged element with the raw one of its identifier; ``matched`` is false for those that merging made up."""
    r = _last_of_each(raw).select("uuid", "identifier", F.lit(True).alias("hit"), *[F.col(c).alias(f"raw_{c}") for c in ("room_id", "story", "x", "y", "z")])
    return merged.join(r, ["uuid", "identifier"], "left").withColumn("matched", F.col("hit").isNotNull()).drop("hit")


def match_summary(matches: DataFrame) -> DataFrame:
    """Totals and match rates by surface type, and over all (``surface_type`` ALL)."""
    rows = matches.rollup("surface_type").agg(F.grouping("surface_type").alias("g"), F.count("*").alias("total"), F.count_if("matched").alias("matched"))
    return rows.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("surface_type")).alias("surface_type"), "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), (F.col("matched") / F.col("total")).alias("rate"))


def _moved() -> Column:
    squares = [F.pow(F.col(c) - F.col(f"raw_{c}"), 2) for c in "xyz"]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def wall_displacement(matches: DataFrame, large_m: float = 5.0) -> DataFrame:
    """How far matched walls stand from their raw positions, per building."""
    rows = matches.where("matched and surface_type = 'wall'").withColumn("moved", _moved())
    return rows.groupBy("uuid").agg(
        F.round(F.percentile("moved", 0.5), 6).alias("median_m"), F.round(F.max("moved"), 6).alias("max_m"), F.round(F.percentile("moved", 0.95), 6).alias("p95_m"), F.count("*").alias("n_walls"),
        F.count_if(~F.col("story").eqNullSafe(F.col("raw_story"))).alias("story_changes"), F.count_if(F.col("moved") > large_m).alias("n_large"),
    ).withColumn("story_change_ratio", F.col("story_changes") / F.col("n_walls"))


def dropped_by_room(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Per raw room: its walls, those that merging dropped, and whether all were."""
    walls = lambda e: _last_of_each(e.where("surface_type = 'wall'"))
    kept = walls(merged).select("uuid", "identifier", F.lit(True).alias("kept"))
    rows = walls(raw).join(kept, ["uuid", "identifier"], "left").groupBy("uuid", "room_id")
    return rows.agg(F.count("*").alias("n_walls"), F.count_if(F.col("kept").isNull()).alias("n_dropped")).withColumn("entirely", F.col("n_walls") == F.col("n_dropped"))


def raw_vs_merged_ids(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """Per building: identifiers on both sides, dropped by merging, and new in it."""
    ids = lambda e, c: e.select("uuid", "identifier").distinct().withColumn(c, F.lit(1))
    both = ids(raw, "r").join(ids(merged, "m"), ["uuid", "identifier"], "full_outer")
    return both.groupBy("uuid").agg(F.count_if((F.col("r") == 1) & (F.col("m") == 1)).alias("n_common"), F.count_if(F.col("m").isNull()).alias("n_dropped"), F.count_if(F.col("r").isNull()).alias("n_new"))
