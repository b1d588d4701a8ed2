"""Operators on pairs of rooms, walls or sessions of one building. Pairs are made within a building only, never across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import circular_difference, rotation_angle_deg


def _apart(axes: str, a: str = "a", b: str = "b") -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) ** 2 for k in axes), F.lit(0.0)))


def session_pair_alignment(sessions: DataFrame, digits: int = 2) -> DataFrame:
    """For each two sessions of a building: difference of mean yaw, distance of the nearest rooms and of the mean positions, rounded."""
    rows = sessions.select("uuid", "session", "x", "y", "z")
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, F.expr("a.uuid = b.uuid and a.session < b.session")).groupBy(F.col("a.uuid").alias("uuid"), F.col("a.session").alias("session_a"), F.col("b.session").alias("session_b"))
    near = near.agg(F.round(F.min(_apart("xyz")), digits).alias("min_dist_m"))
    mean = sessions.groupBy("uuid", "session").agg(*[F.avg(c).alias(c) for c in ("yaw", "x", "y", "z")])
    p, q = mean.alias("p"), mean.alias("q")
    both = near.alias("n").join(p, F.expr("n.uuid = p.uuid and n.session_a = p.session")).join(q, F.expr("n.uuid = q.uuid and n.session_b = q.session"))
    turn = F.abs(F.col("p.yaw") - F.col("q.yaw"))
    return both.select("n.uuid", "session_a", "session_b", F.round(F.least(turn, 360 - turn), digits).alias("yaw_diff_deg"), "min_dist_m", F.round(_apart("xyz", "p", "q"), digits).alias("center_dist_m"))


def shared_wall_disagreement(walls: DataFrame, move_m: float = 0.01, turn_deg: float = 0.5, most: int = 10) -> DataFrame:
    """Walls that two rooms hold at different places: the first ``most`` of each building, which is the report's length.

    ``walls`` has ``uuid, seq`` (of the room), ``wall_id`` and ``t``; rows without a wall id take no part.
    """
    rows = walls.where("wall_id is not null").select("uuid", "seq", "wall_id", "t")
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, F.expr("a.uuid = b.uuid and a.wall_id = b.wall_id and a.seq < b.seq"))
    ta, tb = F.col("a.t"), F.col("b.t")
    move = F.sqrt(sum(((ta[i] - tb[i]) ** 2 for i in (12, 13, 14)), F.lit(0.0)))
    out = both.select("a.uuid", "a.wall_id", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), move.alias("m"), rotation_angle_deg(ta, tb).alias("r")).where((F.col("m") > move_m) | (F.col("r") > turn_deg))
    place = F.row_number().over(Window.partitionBy("uuid").orderBy("wall_id", "seq_a", "seq_b"))
    return out.withColumn("place", place).where(F.col("place") <= most).select("uuid", "wall_id", "seq_a", "seq_b", F.round("m", 4).alias("move_m"), F.round("r", 2).alias("turn_deg"))


def session_audit(summary: DataFrame, gaps: DataFrame, spread: DataFrame, disagreement: DataFrame) -> DataFrame:
    """Severity of each building from its sessions, large time gaps between sessions' rooms, uneven stories and walls in two places."""
    m = F.col("mean_yaw")
    per = summary.groupBy("uuid").agg(F.count("*").alias("n_sessions"), F.max(m).alias("top"), F.min(m).alias("low"))
    counts = [gaps.where("large").groupBy("uuid").agg(F.count("*").alias("n_gaps")), spread.groupBy("uuid").agg(F.count("*").alias("n_spreads")), disagreement.groupBy("uuid").agg(F.count("*").alias("n_walls"))]
    for c in counts:
        per = per.join(c, "uuid", "left")
    per = per.fillna(0, ["n_gaps", "n_spreads", "n_walls"])
    n, some = F.col("n_sessions"), (F.col("n_gaps") > 0) | (F.col("n_spreads") > 0) | (F.col("n_walls") > 0)
    level = F.when((n >= 3) | (F.col("n_walls") >= 5), "RED").when((n == 2) & some, "ORANGE").when(n == 2, "YELLOW").otherwise("GREEN")
    return per.select("uuid", "n_sessions", "n_gaps", "n_spreads", "n_walls", level.alias("severity"))


def azimuth_jumps(captures: DataFrame, jump_m: float = 5.0) -> DataFrame:
    """Captures of a story, by azimuth, that stand further than ``jump_m`` from the one before."""
    order = Window.partitionBy("uuid", "story").orderBy("yaw", "seq")
    before = F.lag(F.struct("seq", "x", "y", "z")).over(order)
    rows = captures.withColumns({"a": before, "b": F.struct("x", "y", "z")}).withColumn("jump", _apart("xyz"))
    return rows.where(F.col("jump") > jump_m).select("uuid", "story", F.col("a.seq").alias("from_seq"), "seq", F.round("jump", 4).alias("jump_m"))


def far_walls(rooms: DataFrame, walls: DataFrame, ratio: float = 1.5, least_m: float = 10.0) -> DataFrame:
    """Walls further from the middle of the rooms than ``ratio`` times the furthest room, and than ``least_m``."""
    middle = rooms.groupBy("uuid").agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))

    def away(rows: DataFrame) -> DataFrame:
        return rows.join(middle, "uuid").withColumn("dist", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("z") - F.col("mz")) ** 2))

    furthest = away(rooms).groupBy("uuid").agg(F.max("dist").alias("furthest"))
    out = away(walls).join(furthest, "uuid").where((F.col("dist") > ratio * F.col("furthest") + 1e-9) & (F.col("dist") > least_m))
    return out.select("uuid", "seq", "story", F.round("dist", 4).alias("dist"))


def duplicate_rooms(rooms: DataFrame, near: float = 0.5) -> DataFrame:
    """Pairs of rooms whose rounded middles are less than ``near`` apart on each axis. Rooms meet in bands along x."""
    rows = rooms.select("uuid", "seq", "story", *[F.round(k, 1).alias(k) for k in "xyz"])
    band = F.floor(F.col("x") / near)
    a, b = rows.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("a"), rows.withColumn("band", band).alias("b")
    close = [F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) < near for k in "xyz"]
    both = a.join(b, F.expr("a.uuid = b.uuid and a.band = b.band and a.seq < b.seq")).where(close[0] & close[1] & close[2])
    return both.select("a.uuid", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), F.col("a.story").alias("story_a"), F.col("b.story").alias("story_b"))


def wall_moves(matches: DataFrame, large_m: float = 1.0) -> DataFrame:
    """Least, upper median and largest move of the matched elements of each building, and how many moved far."""
    move = F.sqrt(sum(((F.col(k) - F.col(f"raw_{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
    building = Window.partitionBy("uuid")
    rows = matches.where("matched").withColumn("move", move)
    rows = rows.withColumns({"n": F.count("*").over(building), "place": F.row_number().over(building.orderBy("move"))})
    middle = F.max(F.when(F.col("place") == F.floor(F.col("n") / 2) + 1, F.col("move")))
    return rows.groupBy("uuid").agg(F.count("*").alias("n_walls"), *[F.round(x, 6).alias(k) for x, k in ((F.min("move"), "min_m"), (middle, "median_m"), (F.max("move"), "max_m"))], F.count_if(F.col("move") > large_m).alias("n_large"))


def largest_turn(rooms: DataFrame) -> DataFrame:
    """Largest turn and distance between any two rooms of a story."""
    rows = rooms.select("uuid", "story", "seq", "yaw", "x", "y", "z")
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, F.expr("a.uuid = b.uuid and a.story = b.story and a.seq < b.seq")).groupBy(F.col("a.uuid").alias("uuid"), F.col("a.story").alias("story"))
    return both.agg(F.round(F.max(circular_difference(F.col("a.yaw"), F.col("b.yaw"))), 4).alias("max_turn_deg"), F.round(F.max(_apart("xyz")), 4).alias("max_move_m"), F.count("*").alias("n_pairs"))
