"""Queries over rooms and elements, bound to ``lineitem``; severities, bound to ``customer``; buckets, to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import captures as C
from .registry import query

_KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as rooms with transforms, and their poses."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS)))
    turn = F.radians((F.col("l_partkey") % 8) * 45 - 180 + (F.col("l_suppkey") % 3 - 1) * F.lit(0.9))
    c, s, zero, one = F.cos(turn), F.sin(turn), F.lit(0.0), F.lit(1.0)
    story = F.col("l_linenumber") % 3
    y = story * 3 + (F.col("l_partkey") % 7) * F.lit(0.25)
    t = F.array(c, zero, -s, zero, zero, one, zero, zero, s, zero, c, zero, (F.col("l_partkey") % 20).cast("double"), y.cast("double"), (F.col("l_suppkey") % 20).cast("double"), one)
    made = rows.select(F.col("l_orderkey").alias("uuid"), "seq", (F.unix_date(F.to_date("l_shipdate")) * F.lit(86400.0)).alias("created"), story.cast("int").alias("story"), F.concat(F.lit("floor"), story.cast("string")).alias("floor_type"), t.alias("t"))
    return C.with_pose(made)


_ROOMS = f"""WITH r0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_KEYS)}) AS n, radians((l_partkey % 8) * 45 - 180 + (l_suppkey % 3 - 1) * CAST(0.9 AS DOUBLE)) AS turn FROM lineitem),
r AS (SELECT l_orderkey AS uuid, n AS seq, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * CAST(86400 AS DOUBLE) AS created, l_linenumber % 3 AS story, 'floor' || (l_linenumber % 3) AS floor_type, degrees(atan2(sin(turn), cos(turn))) AS yaw,
 CAST(l_partkey % 20 AS DOUBLE) AS x, CAST((l_linenumber % 3) * 3 + (l_partkey % 7) * CAST(0.25 AS DOUBLE) AS DOUBLE) AS y, CAST(l_suppkey % 20 AS DOUBLE) AS z FROM r0)"""
_SESSIONS = _ROOMS + """, g AS (SELECT *, CASE WHEN yaw - lag(yaw) OVER (PARTITION BY uuid ORDER BY yaw, seq) <= 2 THEN 0 ELSE 1 END AS new FROM r),
p AS (SELECT *, sum(new) OVER (PARTITION BY uuid ORDER BY yaw, seq) AS part FROM g),
m AS (SELECT *, CASE WHEN part = max(part) OVER (PARTITION BY uuid) AND min(yaw) OVER (PARTITION BY uuid) + 360 - max(yaw) OVER (PARTITION BY uuid) <= 2 THEN 1 ELSE part END AS part2 FROM p),
f AS (SELECT *, min(seq) OVER (PARTITION BY uuid, part2) AS first FROM m), s AS (SELECT *, dense_rank() OVER (PARTITION BY uuid ORDER BY first) - 1 AS session FROM f)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.yaw_sessions(rooms(spark, sf_dir))


@query("f2_pose", _ROOMS + " SELECT uuid, seq, round(yaw, 6) AS yaw, x, y, z FROM r")
def f2(spark, sf_dir):
    return rooms(spark, sf_dir).select("uuid", "seq", F.round("yaw", 6).alias("yaw"), "x", "y", "z")


@query("f4_turn_between_rooms", _ROOMS + ", d AS (SELECT uuid, seq, abs(yaw - lag(yaw) OVER (PARTITION BY uuid ORDER BY seq)) AS d FROM r) SELECT uuid, seq, round(least(d, 360 - d), 3) AS angle FROM d WHERE d IS NOT NULL")
def f4(spark, sf_dir):
    before = F.lag("t").over(Window.partitionBy("uuid").orderBy("seq"))
    rows = rooms(spark, sf_dir).withColumn("before", before).where("before is not null")
    return rows.select("uuid", "seq", F.round(K.rotation_angle_deg(F.col("t"), F.col("before")), 3).alias("angle"))


@query("f5_axis_difference", "SELECT l_orderkey, l_linenumber, least(d, 90 - d) AS off_grid FROM (SELECT l_orderkey, l_linenumber, CAST(((l_partkey - l_suppkey) % 90 + 90) % 90 AS DOUBLE) AS d FROM lineitem)")
def f5(spark, sf_dir):
    off = K.circular_difference(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), 90)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", off.alias("off_grid"))


@query("f1_to_int", "SELECT c_custkey, coalesce(CAST(trunc(TRY_CAST(x AS DOUBLE)) AS INTEGER), 0) AS n FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_acctbal AS VARCHAR) WHEN 1 THEN c_name WHEN 2 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer)")
def f1(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.col("c_acctbal").cast("string")).when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, "").otherwise(k.cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", K.to_int(text).alias("n"))


@query("f14_length_bins", "SELECT CASE WHEN n_chars IS NULL THEN 'nan' WHEN n_chars <= 200 THEN '<= 200' WHEN n_chars <= 1000 THEN '<= 1000' WHEN n_chars <= 5000 THEN '<= 5000' ELSE '> 5000' END AS bin, count(*) AS n FROM documents GROUP BY bin")
def f14(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(K.bin_right_closed(F.col("n_chars"), [200, 1000, 5000]).alias("bin")).agg(F.count("*").alias("n"))


@query("f15_length_buckets", "SELECT CASE WHEN n_chars IS NULL THEN NULL WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n FROM documents GROUP BY bucket")
def f15(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy(K.bin_left_closed(F.col("n_chars"), [200, 2000], ["short", "medium", "long"]).alias("bucket")).agg(F.count("*").alias("n"))


@query("c1_yaw_sessions", _SESSIONS + " SELECT uuid, seq, session FROM s")
def c1(spark, sf_dir):
    return _sessions(spark, sf_dir).select("uuid", "seq", "session")


@query("c2_session_summary", _SESSIONS + " SELECT uuid, session, count(*) AS n_rooms, round(avg(yaw), 6) + 0.0 AS mean_yaw, round(max(yaw) - min(yaw), 6) AS yaw_spread, string_agg(DISTINCT floor_type, ',' ORDER BY floor_type) AS floor_types, round((max(created) - min(created)) / 60, 1) AS span_min FROM s GROUP BY uuid, session")
def c2(spark, sf_dir):
    return C.session_summary(_sessions(spark, sf_dir))


@query("c3_room_time_gaps", _ROOMS + """, d AS (SELECT uuid, seq, lag(seq) OVER w AS from_seq, round_even((created - lag(created) OVER w) / 60, 1) AS gap_min, abs(yaw - lag(yaw) OVER w) AS turn FROM r WINDOW w AS (PARTITION BY uuid ORDER BY created, seq))
SELECT uuid, from_seq, seq, gap_min, round_even(turn, 1) AS yaw_change, turn < 2 OR abs(turn - 360) < 2 AS same_session, gap_min > 10 AS large FROM d WHERE from_seq IS NOT NULL""")
def c3(spark, sf_dir):
    return C.room_time_gaps(rooms(spark, sf_dir))


@query("c4_story_y_spread", _SESSIONS + " SELECT uuid, story, max(y) - min(y) AS y_range, count(*) AS n_rooms, string_agg(seq || ':' || session, ',' ORDER BY seq) AS rooms FROM s GROUP BY uuid, story HAVING count(*) >= 2 AND max(y) - min(y) > 1")
def c4(spark, sf_dir):
    said = F.transform("rooms", lambda r: F.concat_ws(":", r["seq"].cast("string"), r["session"].cast("string")))
    return C.story_y_spread(_sessions(spark, sf_dir)).withColumn("rooms", F.array_join(said, ","))


@query("c10_floor_time_gaps", _ROOMS + """, d AS (SELECT *, created - lag(created) OVER (PARTITION BY uuid, story ORDER BY created, seq) AS gap FROM r),
f AS (SELECT uuid, story, count(*) FILTER (gap > 300) AS gaps_over, max(gap) / 60 AS max_gap_min, min(gap) / 60 AS min_gap_min, min(created) AS begun, max(created) AS ended FROM d GROUP BY uuid, story)
SELECT uuid, story, gaps_over, max_gap_min, min_gap_min, (begun - lag(ended) OVER (PARTITION BY uuid ORDER BY begun, story)) / 60 AS from_previous_floor_min FROM f""")
def c10(spark, sf_dir):
    return C.floor_time_gaps(rooms(spark, sf_dir))


@query("c12_floor_consistency", _ROOMS + " SELECT uuid, story, count(*) AS n_rooms, round(avg(y), 6) + 0.0 AS mean_y, round(stddev_pop(y), 6) + 0.0 AS std_y, round(avg(yaw), 6) + 0.0 AS mean_yaw, round(stddev_pop(yaw), 6) + 0.0 AS std_yaw, max(yaw) - min(yaw) < 1 AS one_yaw FROM r GROUP BY uuid, story")
def c12(spark, sf_dir):
    return C.floor_consistency(rooms(spark, sf_dir))


_Z = ", ".join(f"round(abs({c} - avg({c}) OVER b) / (stddev_pop({c}) OVER b + 1e-10), 6) AS z_{c}" for c in "xyz")


@query("s1_zscore_outliers", _ROOMS + f", d AS (SELECT uuid, seq, {_Z} FROM r WINDOW b AS (PARTITION BY uuid)), e AS (SELECT *, greatest(z_x, z_y, z_z) AS z FROM d) SELECT uuid, seq, CASE WHEN z_x = z THEN 'X' WHEN z_y = z THEN 'Y' ELSE 'Z' END AS axis, z FROM e WHERE z > 1.63")
def s1(spark, sf_dir):
    return C.zscore_outliers(rooms(spark, sf_dir), k=1.63)


@query("s2_story_ranges", _ROOMS + """, d AS (SELECT uuid, story, min(y) AS low, max(y) AS high, avg(y) AS mean, row_number() OVER (PARTITION BY uuid ORDER BY story) AS place FROM r GROUP BY uuid, story),
e AS (SELECT a.uuid, a.story AS lower, b.story AS upper, least(a.high, b.high) - greatest(a.low, b.low) AS overlap, b.place = a.place + 1 AND a.mean > b.mean AS inverted FROM d a JOIN d b ON a.uuid = b.uuid AND a.place < b.place)
SELECT *, CASE WHEN overlap > 0 THEN 'OVERLAP' WHEN -overlap < 0.5 THEN 'SMALL_GAP' WHEN -overlap > 6 THEN 'LARGE_GAP' ELSE 'OK' END AS finding FROM e""")
def s2(spark, sf_dir):
    return C.story_ranges(rooms(spark, sf_dir))


@query("s4_distinct_yaws", _ROOMS + " SELECT uuid, count(DISTINCT rad) AS n_yaws, (SELECT string_agg(printf('%.2f', v), ',') FROM (SELECT unnest(list_sort(list(DISTINCT rad))) AS v)) AS yaws, round(max(yaw) - min(yaw), 6) AS range_deg FROM (SELECT *, round_even(radians(yaw), 2) + 0.0 AS rad FROM r) GROUP BY uuid")
def s4(spark, sf_dir):
    return C.distinct_yaws(rooms(spark, sf_dir)).withColumn("yaws", F.array_join(F.transform("yaws", lambda v: F.format_string("%.2f", v)), ","))


@query("s5_centroid_outliers", _ROOMS + """, d AS (SELECT uuid, seq, sqrt((x - mx) * (x - mx) + (z - mz) * (z - mz)) AS dist FROM (SELECT *, avg(x) OVER b AS mx, avg(z) OVER b AS mz FROM r WINDOW b AS (PARTITION BY uuid))),
e AS (SELECT *, count(*) OVER (PARTITION BY uuid) AS n, row_number() OVER (PARTITION BY uuid ORDER BY dist) AS nth, avg(dist) OVER (PARTITION BY uuid) + 2 * stddev_pop(dist) OVER (PARTITION BY uuid) + 1e-9 AS far FROM d),
f AS (SELECT *, max(dist) FILTER (nth = n // 2 + 1) OVER (PARTITION BY uuid) AS median FROM e) SELECT uuid, seq, round(dist, 6) AS dist, dist > 2 * median AND median > 0.5 AS over_median, dist > 10 AS over_10m, dist > far AS over_2std FROM f""")
def s5(spark, sf_dir):
    return C.centroid_outliers(rooms(spark, sf_dir))


def elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``lineitem`` as raw elements, and as merged ones: open rows moved by the tax, returned ones under new identifiers."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS)))
    kind = F.element_at(F.array(F.lit("wall"), F.lit("door"), F.lit("window")), F.col("seq") % 3 + 1)
    at = [(F.col("l_partkey") % 20).cast("double").alias("x"), (F.col("l_linenumber") % 3 * 3).cast("double").alias("y"), (F.col("l_suppkey") % 20).cast("double").alias("z")]
    raw = rows.select(F.col("l_orderkey").alias("uuid"), "seq", F.col("seq").alias("identifier"), (F.col("l_linenumber") % 2).alias("room_id"), kind.alias("surface_type"), (F.col("l_linenumber") % 3).alias("story"), *at, "l_tax", "l_returnflag", "l_linestatus", "l_partkey")
    tax, seq = F.col("l_tax").cast("double"), F.col("seq")
    moved = {"x": F.col("x") + tax, "y": F.col("y") + 2 * tax, "identifier": F.when(F.col("l_returnflag") == "R", seq + 1000).otherwise(seq), "story": (F.col("story") + (F.col("l_partkey") % 5 == 0).cast("int")) % 3}
    drop = ("l_tax", "l_returnflag", "l_linestatus", "l_partkey")
    return raw.drop(*drop), raw.where("l_linestatus = 'O' or l_returnflag = 'R'").withColumns(moved).drop(*drop)


_ELEMENTS = f"""WITH r0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_KEYS)}) AS seq FROM lineitem),
raw AS (SELECT l_orderkey AS uuid, seq, seq AS identifier, l_linenumber % 2 AS room_id, CASE seq % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'door' ELSE 'window' END AS surface_type, l_linenumber % 3 AS story, CAST(l_partkey % 20 AS DOUBLE) AS x, CAST(l_linenumber % 3 * 3 AS DOUBLE) AS y, CAST(l_suppkey % 20 AS DOUBLE) AS z, CAST(l_tax AS DOUBLE) AS tax, l_returnflag, l_linestatus, l_partkey FROM r0),
merged AS (SELECT uuid, seq, CASE WHEN l_returnflag = 'R' THEN seq + 1000 ELSE seq END AS identifier, room_id, surface_type, (story + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END) % 3 AS story, x + tax AS x, y + 2 * tax AS y, z FROM raw WHERE l_linestatus = 'O' OR l_returnflag = 'R'),
matches AS (SELECT m.*, w.identifier IS NOT NULL AS matched, w.story AS raw_story, w.x AS raw_x, w.y AS raw_y, w.z AS raw_z FROM merged m LEFT JOIN raw w ON m.uuid = w.uuid AND m.identifier = w.identifier)"""


@query("m1_match_elements", _ELEMENTS + " SELECT uuid, identifier, surface_type, matched, raw_story FROM matches")
def m1(spark, sf_dir):
    raw, merged = elements(spark, sf_dir)
    return C.match_elements(merged, raw).select("uuid", "identifier", "surface_type", "matched", "raw_story")


@query("m2_match_summary", _ELEMENTS + " SELECT coalesce(surface_type, 'ALL') AS surface_type, count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched, count(*) FILTER (matched) / count(*) AS rate FROM matches GROUP BY ROLLUP (surface_type)")
def m2(spark, sf_dir):
    raw, merged = elements(spark, sf_dir)
    return C.match_summary(C.match_elements(merged, raw))


@query("m3_wall_displacement", _ELEMENTS + """, d AS (SELECT *, sqrt(pow(x - raw_x, 2) + pow(y - raw_y, 2) + pow(z - raw_z, 2)) AS moved FROM matches WHERE matched AND surface_type = 'wall')
SELECT uuid, round(quantile_cont(moved, 0.5), 6) AS median_m, round(max(moved), 6) AS max_m, round(quantile_cont(moved, 0.95), 6) AS p95_m, count(*) AS n_walls, count(*) FILTER (story IS DISTINCT FROM raw_story) AS story_changes, count(*) FILTER (moved > 0.1) AS n_large,
 count(*) FILTER (story IS DISTINCT FROM raw_story) / count(*) AS story_change_ratio FROM d GROUP BY uuid""")
def m3(spark, sf_dir):
    raw, merged = elements(spark, sf_dir)
    return C.wall_displacement(C.match_elements(merged, raw), large_m=0.1)


@query("m4_raw_vs_merged_ids", _ELEMENTS + " SELECT uuid, count(*) FILTER (r = 1 AND m = 1) AS n_common, count(*) FILTER (m IS NULL) AS n_dropped, count(*) FILTER (r IS NULL) AS n_new FROM (SELECT DISTINCT uuid, identifier, 1 AS r FROM raw) FULL JOIN (SELECT DISTINCT uuid, identifier, 1 AS m FROM merged) USING (uuid, identifier) GROUP BY uuid")
def m4(spark, sf_dir):
    return C.raw_vs_merged_ids(*elements(spark, sf_dir))


@query("m4_dropped_by_room", _ELEMENTS + " SELECT w.uuid, w.room_id, count(*) AS n_walls, count(*) FILTER (m.uuid IS NULL) AS n_dropped, count(*) = count(*) FILTER (m.uuid IS NULL) AS entirely FROM raw w LEFT JOIN merged m ON w.uuid = m.uuid AND w.identifier = m.identifier AND m.surface_type = 'wall' WHERE w.surface_type = 'wall' GROUP BY w.uuid, w.room_id")
def m4_rooms(spark, sf_dir):
    return C.dropped_by_room(*elements(spark, sf_dir))
