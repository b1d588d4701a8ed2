"""Queries for features of buildings, merges, walls, normals and roof families, bound to ``lineitem``, ``orders`` and ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from .registry import query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


_PAIRS = """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 9 > 0 AS has, CASE WHEN l_partkey % 17 > 0 THEN l_quantity / 10 END AS mw, 2.5e0 + l_tax * 10 AS mh, CASE WHEN l_linenumber % 2 = 0 THEN 0e0 ELSE 0.21e0 END AS md,
 CASE WHEN l_suppkey % 9 > 0 AND l_partkey % 7 > 0 THEN l_quantity / 10 + (l_suppkey % 5) * 0.0623e0 END AS rw, CASE WHEN l_suppkey % 9 > 0 THEN 2.5e0 + l_tax * 10 + (l_suppkey % 4) * 0.1717e0 END AS rh, CASE WHEN l_suppkey % 9 > 0 AND l_partkey % 3 > 0 THEN 0.05e0 END AS rd FROM lineitem),
q AS (SELECT *, abs(mw - rw) * 100 AS dw, abs(mh - rh) * 100 AS dh, abs(md - rd) * 100 AS dd FROM p),
t AS (SELECT *, CASE WHEN NOT has THEN 'synthesized_in_merge' ELSE concat_ws(';', CASE WHEN dw > 15 THEN printf('dimensions.width: %.1fcm divergence', dw) END, CASE WHEN dh > 20 THEN printf('dimensions.height: %.1fcm divergence', dh) END, CASE WHEN dd > 10 THEN printf('dimensions.depth: %.1fcm divergence', dd) END) END AS flags FROM q)"""


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, part, supp, story = F.col("l_quantity") / 10, F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    height = 2.5 + F.col("l_tax") * 10
    merged = F.struct(F.when(part % 17 > 0, q).alias("width"), height.alias("height"), F.when(story % 2 == 0, 0.0).otherwise(0.21).alias("depth"), story.alias("story"))
    raw = F.struct(F.when(part % 7 > 0, q + (supp % 5) * F.lit(0.0623)).alias("width"), (height + (supp % 4) * F.lit(0.1717)).alias("height"), F.when(part % 3 > 0, 0.05).alias("depth"), story.alias("story"))
    return X.trust_merge(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", merged.alias("merged"), F.when(supp % 9 > 0, raw).alias("raw")))


@query("m7_trust_merge", _PAIRS + """ SELECT l_orderkey, l_linenumber, round(coalesce(rw, mw), 6) AS width, round(coalesce(rh, mh), 6) AS height, CASE WHEN md = 0 THEN coalesce(rd, md) ELSE md END AS depth, round(dh, 6) AS height_cm, flags,
 concat_ws(',', CASE WHEN rw IS NOT NULL THEN 'dimensions.width' END, CASE WHEN has THEN 'dimensions.height' END, CASE WHEN md = 0 AND rd IS NOT NULL THEN 'dimensions.depth' END) AS from_raw,
 concat_ws(',', CASE WHEN rw IS NULL THEN 'dimensions.width' END, CASE WHEN NOT has THEN 'dimensions.height' END, CASE WHEN md <> 0 OR rd IS NULL THEN 'dimensions.depth' END, 'story') AS from_merged FROM t""")
def m7(spark, sf_dir):
    rows = _merges(spark, sf_dir)
    joined = [F.concat_ws(s, c).alias(c) for c, s in (("from_raw", ","), ("from_merged", ","), ("flags", ";"))]
    return rows.select("l_orderkey", "l_linenumber", F.round("surface.width", 6).alias("width"), F.round("surface.height", 6).alias("height"), "surface.depth", F.round(F.col("divergences")["dimensions.height"], 6).alias("height_cm"), *joined)


@query("m6_quality_report", _PAIRS + """, b AS (SELECT o_orderkey AS uuid, o_orderkey % 4 AS sessions, (o_custkey % 23) * 0.5e0 + 0.03e0 AS median_m, (o_custkey % 10) / 10e0 AS ratio FROM orders),
f AS (SELECT l_orderkey AS uuid, count(*) FILTER (dw > 0) AS nw, max(dw) AS max_width, max(dh) AS max_height, avg(nullif(dw, 0)) AS mean_width, avg(nullif(dh, 0)) AS mean_height, count(*) FILTER (NOT has) AS synthesized, count(*) FILTER (flags <> '') AS flagged FROM t GROUP BY l_orderkey),
l AS (SELECT l_orderkey AS uuid, count(*) AS raw_walls, count(*) FILTER (l_partkey % 3 > 0) AS merged_walls, count(*) FILTER (l_suppkey % 4 = 0) AS floor_gaps, avg(l_quantity) FILTER (l_suppkey % 4 = 0) AS mean_gap, median(l_quantity) FILTER (l_suppkey % 4 = 0) AS median_gap, count(*) FILTER (l_returnflag = 'R') AS high FROM lineitem GROUP BY l_orderkey),
j AS (SELECT b.*, coalesce(raw_walls, 0) AS raw_walls, coalesce(merged_walls, 0) AS merged_walls, coalesce(floor_gaps, 0) AS floor_gaps, coalesce(mean_gap, 0) AS mean_gap, coalesce(median_gap, 0) AS median_gap, coalesce(high, 0) AS high, coalesce(max_width, 0) AS max_width, coalesce(max_height, 0) AS max_height, coalesce(mean_width, 0) AS mean_width,
 coalesce(mean_height, 0) AS mean_height, coalesce(synthesized, 0) AS synthesized, coalesce(flagged, 0) AS flagged, CASE WHEN raw_walls > 0 THEN (1 - merged_walls / raw_walls) * 100 ELSE 0 END AS reduction FROM b LEFT JOIN l USING (uuid) LEFT JOIN f USING (uuid)),
k AS (SELECT *, concat_ws(';', CASE WHEN reduction > 50 THEN 'RED: wall_reduction > 50%' END, CASE WHEN max_height > 50 THEN 'RED: max_height_delta > 50cm' END, CASE WHEN sessions >= 3 THEN printf('RED: multi_session (%d scan sessions)', sessions) END, CASE WHEN median_m > 10 THEN printf('RED: median_wall_displacement > 10m (%.1fm)', median_m) END) AS red,
 concat_ws(';', CASE WHEN reduction > 30 THEN 'YELLOW: wall_reduction > 30%' END, CASE WHEN max_height > 20 THEN 'YELLOW: max_height_delta > 20cm' END, CASE WHEN max_width > 15 THEN 'YELLOW: max_width_delta > 15cm' END, CASE WHEN synthesized > 5 THEN 'YELLOW: synthesized_count > 5' END,
 CASE WHEN high > 3 THEN printf('YELLOW: cross_floor_gaps_high > 3 (%d)', high) END, CASE WHEN ratio > 0.5 THEN printf('YELLOW: story_change_ratio > 50%% (%.0f%%)', ratio * 100) END, CASE WHEN median_m > 7 THEN printf('YELLOW: median_wall_displacement > 7m (%.1fm)', median_m) END) AS yellow FROM j)
SELECT uuid, round(reduction, 6) AS reduction_pct, round(max_width, 6) AS max_width_cm, round(mean_width, 6) AS mean_width_cm, round(max_height, 6) AS max_height_cm, round(mean_height, 6) AS mean_height_cm, synthesized, flagged, floor_gaps, round(mean_gap, 6) AS mean_gap_cm, median_gap AS median_gap_cm, high AS cross_gaps_high,
 CASE WHEN red <> '' THEN 'RED' WHEN yellow <> '' THEN 'YELLOW' ELSE 'GREEN' END AS classification, CASE WHEN red <> '' THEN red ELSE yellow END AS flags FROM k""")
def m6(spark, sf_dir):
    lines, uuid, cust = _lines(spark, sf_dir), F.col("l_orderkey").alias("uuid"), F.col("o_custkey")
    homes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("uuid"), (F.col("o_orderkey") % 4).alias("sessions"), ((cust % 23) * F.lit(0.5) + F.lit(0.03)).alias("median_m"), ((cust % 10) / F.lit(10.0)).alias("story_change_ratio"))
    merges = _merges(spark, sf_dir).withColumnRenamed("l_orderkey", "uuid")
    gaps = lines.where("l_suppkey % 4 = 0").select(uuid, F.col("l_quantity").alias("thickness_cm"))
    cross = lines.select(uuid, F.when(F.col("l_returnflag") == "R", "high").otherwise("low").alias("confidence"))
    out = X.quality_report(homes, lines.where("l_partkey % 3 > 0").select(uuid), lines.select(uuid), merges, gaps, cross)
    six = [F.round(c, 6).alias(c) for c in ("reduction_pct", "max_width_cm", "mean_width_cm", "max_height_cm", "mean_height_cm", "mean_gap_cm")]
    return out.select("uuid", *six, "synthesized", "flagged", "floor_gaps", "median_gap_cm", "cross_gaps_high", "classification", F.concat_ws(";", "flags").alias("flags"))


@query("p13_wall_directions", """WITH w AS (SELECT l_orderkey AS uuid, round_even((((88 - 15 * (l_partkey % 12)) % 180 + 180) % 180) / 10e0, 0) * 10 AS bin, 1 + l_quantity / 10 AS length FROM lineitem WHERE l_suppkey % 29 > 0),
b AS (SELECT uuid, bin, sum(length) AS length FROM w GROUP BY uuid, bin), s AS (SELECT uuid, sum(length) AS total FROM b GROUP BY uuid)
SELECT uuid, arg_max(bin, (round(length, 9), -bin)) % 180 AS dominant_azimuth_deg, round(CASE WHEN count(*) > 1 THEN -sum(length / total * ln(length / total)) / ln(count(*)) ELSE 0 END, 6) + 0.0 AS azimuth_entropy FROM b JOIN s USING (uuid) GROUP BY uuid""")
def p13(spark, sf_dir):
    turn, length = F.radians((F.col("l_partkey") % 12) * 15 + 2), 1 + F.col("l_quantity") / 10
    x, z = (F.col("l_suppkey") % 6).cast("double"), F.lit(0.0)
    at = lambda k, y: F.struct((x + k * length * F.cos(turn)).alias("x"), F.lit(y).alias("y"), (z + k * length * F.sin(turn)).alias("z"))
    corners = F.when(F.col("l_suppkey") % 29 == 0, F.array(at(0, 0.0))).otherwise(F.array(at(0, 0.0), at(1, 0.0), at(1, 2.5), at(0, 2.5)))
    walls = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("uuid"), corners.alias("corners"))
    return X.wall_direction_profile(walls).select("uuid", "dominant_azimuth_deg", (F.round("azimuth_entropy", 6) + F.lit(0.0)).alias("azimuth_entropy"))


_WALL_STATS = ("resolution_ratio", "length_mean", "length_std", "length_min", "length_max", "length_total", "top_mean", "top_std", "top_range", "bottom_mean", "bottom_std", "azimuth_mean", "azimuth_std", "azimuth_max_diff", "incl_mean", "incl_std", "incl_max", "nonvertical_share")


@query("l28_source_wall_stats", """WITH w AS (SELECT p_partkey AS wall_id, p_size / 2e0 AS length, p_size % 5 + 2e0 AS top, p_size % 5 * 0.5e0 AS bottom, (p_partkey % 5) * 15e0 + 2 AS az, CAST(p_partkey % 4 AS DOUBLE) AS incl FROM part WHERE p_partkey % 8 > 0),
m AS (SELECT l_orderkey AS "group", CASE WHEN l_suppkey % 10 > 0 THEN l_partkey END AS id FROM lineitem), r AS (SELECT m.*, w.* FROM m LEFT JOIN w ON id = wall_id),
a AS (SELECT *, avg(cos(radians(2 * az))) OVER g AS c, avg(sin(radians(2 * az))) OVER g AS s FROM r WINDOW g AS (PARTITION BY "group"))
SELECT "group", count(wall_id) AS resolved, round(CASE WHEN count(id) > 0 THEN count(wall_id) / count(id) END, 6) AS resolution_ratio, round(avg(length), 6) AS length_mean, round(stddev_pop(length), 6) AS length_std, min(length) AS length_min, max(length) AS length_max, sum(length) AS length_total,
 round(avg(top), 6) AS top_mean, round(stddev_pop(top), 6) AS top_std, max(top) - min(top) AS top_range, round(avg(bottom), 6) AS bottom_mean, round(stddev_pop(bottom), 6) AS bottom_std, round(degrees(atan2(any_value(s), any_value(c))) / 2, 6) AS azimuth_mean,
 CASE WHEN max(az) = min(az) THEN 0 ELSE round(degrees(sqrt(-2 * ln(sqrt(any_value(c) ** 2 + any_value(s) ** 2)))) / 2, 4) END AS azimuth_std, max(az) - min(az) AS azimuth_max_diff, round(avg(incl), 6) AS incl_mean, round(stddev_pop(incl), 6) AS incl_std, max(incl) AS incl_max, round(avg(CAST(incl > 2 AS INTEGER)), 6) AS nonvertical_share
FROM a GROUP BY "group" """)
def l28(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    walls = spark.read.parquet(f"{sf_dir}/part.parquet").where(k % 8 > 0).select(k.alias("wall_id"), (size / F.lit(2.0)).alias("length_m"), (size % 5 + F.lit(2.0)).alias("top_y"), (size % 5 * F.lit(0.5)).alias("bottom_y"), ((k % 5) * F.lit(15.0) + 2).alias("azimuth_deg"), (k % 4).cast("double").alias("incl_deg"))
    members = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("group"), F.when(F.col("l_suppkey") % 10 > 0, F.col("l_partkey")).alias("wall_id"))
    return X.source_wall_stats(members, walls).select("group", "resolved", *[F.round(c, 4 if c == "azimuth_std" else 6).alias(c) for c in _WALL_STATS])


_UNITS = """WITH m AS (SELECT l_partkey AS "group", l_linenumber AS room, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS wall, (l_suppkey % 5 - 2) + 0e0 AS a, (l_linenumber % 2) + 0e0 AS b, (l_orderkey % 3) + 0e0 AS c, l_quantity AS d, row_number() OVER () AS id FROM lineitem),
u AS (SELECT "group", id, a / z AS a, b / z AS b, c / z AS c, d / z AS d FROM (SELECT *, sqrt(a * a + b * b + c * c) AS z FROM m) WHERE z > 0),
e AS (SELECT "group", count(*) AS n, sqrt(avg(a) ** 2 + avg(b) ** 2 + avg(c) ** 2) AS r, min(d) AS low, max(d) AS high FROM u GROUP BY "group"),
cs AS (SELECT x."group", min(v) AS lo, avg(v) AS mean FROM (SELECT x."group", abs(x.a * y.a + x.b * y.b + x.c * y.c) AS v FROM u x JOIN u y ON x."group" = y."group" AND x.id < y.id) x GROUP BY x."group"),
bn AS (SELECT "group", -sum(k / n * ln(k / n)) / ln(10) AS bins FROM (SELECT u."group", any_value(n) AS n, count(*) AS k FROM u JOIN e ON u."group" = e."group" WHERE high - low > 1e-9 GROUP BY u."group", least(floor((d - low) / (high - low) * 10), 9)) GROUP BY "group"),
rm AS (SELECT "group", CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h FROM (SELECT "group", count(*) / sum(count(*)) OVER (PARTITION BY "group") AS p FROM m GROUP BY "group", room) GROUP BY "group"),
wl AS (SELECT "group", CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h FROM (SELECT "group", count(*) / sum(count(*)) OVER (PARTITION BY "group") AS p FROM m WHERE wall IS NOT NULL GROUP BY "group", wall) GROUP BY "group")"""


@query("l29_normal_dispersion", _UNITS + """ SELECT g."group", n AS n_normals, round(r, 6) AS resultant_length, round(1 - r, 6) + 0.0 AS spherical_variance, CASE WHEN r < 1 - 1e-9 THEN round((3 * r - r * r * r) / (1 - r * r), 6) END AS kappa, round(lo, 6) AS cos_min, round(mean, 6) AS cos_mean, CASE WHEN n > 1 THEN round(coalesce(bins, 0), 6) + 0.0 END AS offset_entropy,
 round(rm.h, 6) + 0.0 AS room_entropy, round(wl.h, 6) + 0.0 AS wall_entropy FROM (SELECT DISTINCT "group" FROM m) g LEFT JOIN e USING ("group") LEFT JOIN cs USING ("group") LEFT JOIN bn USING ("group") LEFT JOIN rm USING ("group") LEFT JOIN wl USING ("group")""")
def l29(spark, sf_dir):
    supp, line, zero = F.col("l_suppkey"), F.col("l_linenumber"), F.lit(0.0)
    plane = F.struct((supp % 5 - 2 + zero).alias("a"), (line % 2 + zero).alias("b"), (F.col("l_orderkey") % 3 + zero).alias("c"), F.col("l_quantity").alias("d"))
    members = _lines(spark, sf_dir).select(F.col("l_partkey").alias("group"), plane.alias("plane"), line.alias("room_id"), F.when(supp % 4 > 0, supp).alias("wall_id"))
    six = ("resultant_length", "spherical_variance", "kappa", "cos_min", "cos_mean", "offset_entropy", "room_entropy", "wall_entropy")
    return X.normal_dispersion(members).select("group", "n_normals", *[(F.round(c, 6) + zero).alias(c) for c in six])


def _axes(a: str, b: str) -> str:
    d = f"(({a} - {b}) % 180 + 180) % 180"
    return f"least({d}, 180 - {d})"


@query("l12_derived_features", f"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'gable_complete' WHEN 1 THEN 'gable_along_extend' WHEN 2 THEN 'gable_ambiguous' WHEN 3 THEN 'other' END AS st, CASE WHEN l_partkey % 7 < 6 THEN l_partkey % 7 - 1 END AS k, (l_suppkey % 36) * 10e0 AS plane, CASE WHEN l_partkey % 5 > 0 THEN (l_partkey % 18) * 10e0 END AS az0,
 CASE WHEN l_suppkey % 4 > 0 THEN (l_partkey % 18) * 10e0 + l_linenumber * 7 END AS az1, l_linenumber * 25e0 AS ridge, (l_orderkey % 18) * 10e0 AS major, (l_orderkey % 180) + 0e0 AS building, CASE WHEN l_returnflag <> 'R' THEN l_linenumber % 3 - 1 END AS delta, CASE WHEN l_partkey % 11 > 0 THEN l_linestatus = 'O' END AS arch, CASE WHEN l_suppkey % 13 > 0 THEN l_suppkey % 3 END AS opposing FROM lineitem),
f AS (SELECT *, CASE WHEN st = 'gable_complete' THEN 'gable' WHEN st LIKE 'gable%' THEN 'complex' WHEN k IS NULL OR k < 0 THEN 'unknown' WHEN k = 0 THEN 'flat' WHEN k = 1 THEN 'shed' WHEN k = 2 THEN 'gable' WHEN k = 3 THEN 'complex' ELSE 'hip' END AS family, least({_axes('plane', 'az0')}, {_axes('plane', 'az1')}) AS leg FROM r)
SELECT l_orderkey, l_linenumber, family, CASE WHEN family = 'gable' THEN leg END AS min_az_to_leg, CASE WHEN family = 'gable' THEN leg < 10 END AS matches_gable, {_axes('az0', 'az1')} AS leg_delta, {_axes('ridge', 'major')} AS ridge_vs_major, {_axes('az0', 'major')} AS leg0_vs_major, {_axes('az1', 'major')} AS leg1_vs_major,
 {_axes('plane', 'building')} AS plane_vs_building, delta > 0 AS cross_story, CASE WHEN arch IS NOT NULL THEN arch AND coalesce(opposing = 0, false) END AS orphan_oblique, k = 1 AS one_slanted, k = 2 AS two_slanted, k >= 4 AS many_slanted FROM f""")
def l12(spark, sf_dir):
    order, part, supp, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    ten = F.lit(10.0)
    state = F.when(line % 6 == 0, "gable_complete").when(line % 6 == 1, "gable_along_extend").when(line % 6 == 2, "gable_ambiguous").when(line % 6 == 3, "other")
    rows = _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", state.alias("gable_status"), F.when(part % 7 < 6, part % 7 - 1).alias("n_slanted"), ((supp % 36) * ten).alias("plane_az"), F.when(part % 5 > 0, (part % 18) * ten).alias("az0"),
        F.when(supp % 4 > 0, (part % 18) * ten + line * 7).alias("az1"), (line * F.lit(25.0)).alias("ridge_az"), ((order % 18) * ten).alias("major_az"), (order % 180 + F.lit(0.0)).alias("building_az"),
        F.when(F.col("l_returnflag") != "R", line % 3 - 1).alias("story_delta_max"), F.when(part % 11 > 0, F.col("l_linestatus") == "O").alias("architectural"), F.when(supp % 13 > 0, supp % 3).alias("opposing"),
    )
    needed = {"gable_status", "n_slanted", "plane_az", "az0", "az1", "ridge_az", "major_az", "building_az", "story_delta_max", "architectural", "opposing"}
    return X.derived_features(rows).drop(*needed)
