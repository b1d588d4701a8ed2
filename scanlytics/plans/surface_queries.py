"""Queries over surfaces and their flags, bound to ``lineitem``: rectangles that rise along x, so that SQL has them in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import surfaces as S
from .capture_queries import _KEYS
from .registry import query

_TAGS = (*S.U_VALUES, "somethingElse")


def _corners(*points) -> F.Column:
    return F.array(*[F.struct(x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in points])


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as surfaces. Some have two corners, no width, openings too large for them, or planes that miss their corners."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("n", n)
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = rows.select(
        F.col("l_orderkey").alias("uuid"), F.col("n").alias("seq"), F.element_at(F.array(*map(F.lit, S.CATEGORIES)), F.col("l_linenumber") % 7 + 1).alias("category"), (F.col("l_linenumber") % 3).alias("story"), (F.col("n") % 3).alias("room"),
        F.element_at(F.array(*map(F.lit, _TAGS)), (part % 12).cast("int") + 1).alias("adjacency"), F.col("l_returnflag").alias("source"), part.alias("part"), supp.alias("supp"), (part % 6).cast("double").alias("x0"), (supp % 6).cast("double").alias("z0"),
        F.when(supp % 31 == 0, 0.0).otherwise(1 + F.col("l_quantity") / 10).alias("w"), (1 + F.round(F.col("l_discount") * 10)).alias("d"), (F.col("l_linenumber") % 3 * 3).cast("double").alias("y"), F.round(F.col("l_tax") * 100).alias("h"), (F.col("l_returnflag") == "R").alias("under"),
    )
    part, supp = F.col("part"), F.col("supp")
    x, y, z, w, d, h = (F.col(c) for c in ("x0", "y", "z0", "w", "d", "h"))
    near, far = [(x, y, z), (x + w, y + h, z)], [(x + w, y + h, z + d), (x, y, z + d)]
    size = F.sqrt(h * h + w * w)
    shift = F.when(part % 13 == 0, 0.007).otherwise(0.0)
    plane = F.when(size > 0, F.struct((-h / size).alias("a"), (w / size).alias("b"), F.lit(0.0).alias("c"), ((w * y - h * x) / size + shift).alias("d")))
    share = F.when(supp % 8 == 0, 1.5).when(supp % 4 == 0, 0.5)
    hole = F.when(share.isNotNull(), F.array(_corners((x, y, z), (x + w * share, y + h * share, z), (x + w * share, y + h * share, z + d * share), (x, y, z + d * share)))).otherwise(F.array().cast("array<array<struct<x:double,y:double,z:double>>>"))
    made = rows.select(
        "uuid", "seq", "category", "story", "room", F.concat_ws("::", F.col("uuid").cast("string"), "category", F.concat_ws(":", F.col("room").cast("string"), F.col("seq").cast("string"))).alias("locator_id"), "adjacency", "source", F.when(h > 0, "oblique").otherwise("flat").alias("kind"),
        F.when(supp % 29 == 0, _corners(*near)).when(F.col("under"), _corners(*near, *far)).otherwise(_corners(near[0], far[1], far[0], near[1])).alias("corners"), hole.alias("openings"), plane.alias("plane"), "part", "supp",
    )
    return G.settled(made, "corners")


def _case(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_SF = f"""WITH r0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_KEYS)}) AS n FROM lineitem),
r1 AS (SELECT l_orderkey AS uuid, n AS seq, {_case('l_linenumber % 7', S.CATEGORIES)} AS category, l_linenumber % 3 AS story, n % 3 AS room, {_case('l_partkey % 12', _TAGS)} AS adjacency, l_returnflag AS source, l_partkey AS part, l_suppkey AS supp,
 CAST(l_partkey % 6 AS DOUBLE) AS x0, CAST(l_suppkey % 6 AS DOUBLE) AS z0, CASE WHEN l_suppkey % 31 = 0 THEN 0.0 ELSE 1 + l_quantity / 10 END AS w, 1 + round(l_discount * 10) AS d, CAST(l_linenumber % 3 * 3 AS DOUBLE) AS y, round(l_tax * 100) AS h, l_returnflag = 'R' AS under FROM r0),
sf AS (SELECT *, uuid || '::' || category || '::' || room || ':' || seq AS locator_id, supp % 29 = 0 AS few, CASE WHEN h > 0 THEN 'oblique' ELSE 'flat' END AS kind, sqrt(h * h + w * w) AS size, CASE WHEN supp % 29 = 0 THEN 0 ELSE d * sqrt(h * h + w * w) END AS area,
 CASE WHEN supp % 8 = 0 THEN 2.25 WHEN supp % 4 = 0 THEN 0.25 ELSE 0 END * d * sqrt(h * h + w * w) AS cut, CASE WHEN part % 13 = 0 THEN 0.007 ELSE 0 END AS shift, CASE WHEN supp % 29 <> 0 AND d * sqrt(h * h + w * w) > 0 THEN CASE WHEN under THEN -w ELSE w END / sqrt(h * h + w * w) END AS up FROM r1),
pl AS (SELECT *, -h / size AS a, w / size AS b, (w * y - h * x0) / size + shift AS pd FROM sf WHERE size > 0)"""
_FLAGS = _SF + """, inv AS (SELECT uuid, seq, locator_id, 'ceiling_orientation_inverted' AS rule, 'high' AS severity, round(up, 6) + 0.0 AS evidence, CAST(NULL AS INTEGER) AS cutout FROM sf WHERE category = 'ceiling' AND up < 0.1),
span AS (SELECT uuid, seq, locator_id, 'ceiling_yspan_excessive' AS rule, CASE WHEN h >= 5 THEN 'high' WHEN h >= 3 THEN 'medium' ELSE 'low' END AS severity, h AS evidence, CAST(NULL AS INTEGER) AS cutout FROM sf WHERE category = 'ceiling' AND h > 2),
drops AS (SELECT uuid, seq, locator_id, 'silent_drop' AS rule, 'low' AS severity, CASE WHEN NOT few THEN round(area, 6) END AS evidence, CAST(NULL AS INTEGER) AS cutout FROM sf WHERE few OR area < 1e-4),
outside AS (SELECT uuid, seq, locator_id, 'wall_cutout_outside_outline' AS rule, 'medium' AS severity, round(h * 0.5, 4) AS evidence, 0 AS cutout FROM sf WHERE category = 'wall' AND supp % 8 = 0 AND h > 0),
bent AS (SELECT uuid, seq, locator_id, 'roof_corners_not_planar' AS rule, 'medium' AS severity, CAST(0.007 AS DOUBLE) AS evidence, CAST(NULL AS INTEGER) AS cutout FROM pl WHERE category = 'ceiling' AND kind = 'oblique' AND shift > 0),
flags AS (SELECT * FROM inv UNION ALL SELECT * FROM span UNION ALL SELECT * FROM drops UNION ALL SELECT * FROM outside UNION ALL SELECT * FROM bent)"""
_FLAG_COLUMNS = "uuid, seq, locator_id, rule, severity, evidence"


@query("f6_plan_area", _SF + " SELECT uuid, seq, CASE WHEN few THEN 0.0 ELSE round(w * d, 6) END AS area FROM sf")
def f6(spark, sf_dir):
    return surfaces(spark, sf_dir).select("uuid", "seq", F.round(G.area_xz(F.col("corners")), 6).alias("area"))


@query("f7_area_and_normal", _SF + " SELECT uuid, seq, round(area, 6) AS area, round(up, 6) + 0.0 AS normal_y FROM sf")
def f7(spark, sf_dir):
    c = F.col("corners")
    return surfaces(spark, sf_dir).select("uuid", "seq", F.round(G.area_3d(c), 6).alias("area"), (F.round(G.unit_normal(c)["y"], 6) + 0.0).alias("normal_y"))


@query("f8_net_area", _SF + " SELECT uuid, seq, round(greatest(0, area - cut), 6) AS area FROM sf")
def f8(spark, sf_dir):
    return surfaces(spark, sf_dir).select("uuid", "seq", F.round(G.net_area(F.col("corners"), F.col("openings")), 6).alias("area"))


@query("f9_ranges", _SF + " SELECT uuid, seq, y AS y_low, y + h AS y_high, x0, round(x0 + w, 6) AS x1, z0, CASE WHEN few THEN z0 ELSE z0 + d END AS z1 FROM sf")
def f9(spark, sf_dir):
    c = F.col("corners")
    rows = surfaces(spark, sf_dir).select("uuid", "seq", G.low(c).alias("y_low"), G.high(c).alias("y_high"), G.box(c).alias("b"))
    return rows.select("uuid", "seq", "y_low", "y_high", "b.x0", F.round("b.x1", 6).alias("x1"), "b.z0", "b.z1")


@query("f10_plane_heights", _SF + " SELECT uuid, seq, CASE WHEN b > 1e-6 THEN round(y + (3 - x0) * h / w + shift * size / w, 8) + 0.0 END AS y_at, CAST(round(shift, 6) AS DOUBLE) AS residual FROM pl")
def f10(spark, sf_dir):
    p = F.col("plane")
    rows = surfaces(spark, sf_dir).where(p.isNotNull())
    return rows.select("uuid", "seq", (F.round(G.plane_y_at(p, F.lit(3.0), F.lit(1.0)), 8) + 0.0).alias("y_at"), F.round(G.worst_residual(p, F.col("corners")), 6).alias("residual"))


_SLOPE = "CASE WHEN incl < 5 THEN 'nearly_flat' WHEN incl < 15 THEN 'shallow' WHEN incl < 60 THEN 'architectural' WHEN incl < 80 THEN 'steep' ELSE 'nearly_vertical' END"


@query("f11_plane_orientation", _SF + f", o AS (SELECT *, degrees(acos(least(1.0, abs(b)))) AS incl FROM pl) SELECT uuid, seq, round(incl, 4) AS incl, {_SLOPE} AS slope, CASE WHEN h > 0 THEN CAST(270 AS DOUBLE) END AS azimuth, CASE WHEN h > 0 THEN CAST(90 AS DOUBLE) END AS flow FROM o")
def f11(spark, sf_dir):
    p = F.col("plane")
    incl, oblique = G.inclination_deg(p), F.col("kind") == "oblique"
    turn = F.when(oblique, F.round(G.azimuth_deg(p), 6)), F.round(G.azimuth_deg(p, downhill=True), 6)
    return surfaces(spark, sf_dir).where(p.isNotNull()).select("uuid", "seq", F.round(incl, 4).alias("incl"), G.slope_class(incl).alias("slope"), turn[0].alias("azimuth"), turn[1].alias("flow"))


_PK = _SF + """, k0 AS (SELECT *, CASE WHEN a < 0 AND h >= w THEN -1.0 ELSE 1.0 END AS s FROM pl),
k AS (SELECT *, CAST(round_even(s * a / 2e-3, 0) AS BIGINT) AS ka, CAST(round_even(s * b / 2e-3, 0) AS BIGINT) AS kb, CAST(round_even(s * pd / 0.02, 0) AS BIGINT) AS kd FROM k0)"""


@query("f12_plane_groups", _PK + " SELECT uuid, ka AS a, kb AS b, CAST(0 AS BIGINT) AS c, kd AS d, count(*) AS n, min(seq) AS first_seq FROM k GROUP BY uuid, ka, kb, kd")
def f12(spark, sf_dir):
    return S.plane_groups(surfaces(spark, sf_dir))


@query("f16_locators", _SF + " SELECT uuid, seq, category AS kind, room || '|' || seq AS parts FROM sf")
def f16(spark, sf_dir):
    at = F.col("locator_id")
    return surfaces(spark, sf_dir).select("uuid", "seq", G.locator_kind(at).alias("kind"), F.array_join(G.locator_parts(at), "|").alias("parts"))


@query("r1_ceiling_inverted", _FLAGS + f" SELECT {_FLAG_COLUMNS} FROM inv")
def r1(spark, sf_dir):
    return S.ceiling_inverted(surfaces(spark, sf_dir))


@query("r2_ceiling_yspan", _FLAGS + f" SELECT {_FLAG_COLUMNS} FROM span")
def r2(spark, sf_dir):
    return S.ceiling_yspan(surfaces(spark, sf_dir))


@query("r5_silent_drop", _FLAGS + f" SELECT {_FLAG_COLUMNS} FROM drops")
def r5(spark, sf_dir):
    return S.silent_drops(surfaces(spark, sf_dir))


@query("r6_cutout_outside", _FLAGS + f" SELECT {_FLAG_COLUMNS}, cutout FROM outside")
def r6(spark, sf_dir):
    return S.cutouts_outside(surfaces(spark, sf_dir))


@query("r14_corners_not_planar", _FLAGS + f" SELECT {_FLAG_COLUMNS} FROM bent")
def r14(spark, sf_dir):
    return S.corners_not_planar(surfaces(spark, sf_dir))


@query("r16_all_rules", _FLAGS + " SELECT * FROM flags")
def r16(spark, sf_dir):
    return S.all_rules(surfaces(spark, sf_dir))


@query("r22_rule_frequency", _FLAGS + " SELECT rule, severity, count(*) AS n_flags, count(DISTINCT uuid) AS n_buildings FROM flags GROUP BY rule, severity")
def r22(spark, sf_dir):
    return S.rule_frequency(S.all_rules(surfaces(spark, sf_dir)))


@query("r23_snapshot_diff", _SF + """, b AS (SELECT category, locator_id FROM sf WHERE source <> 'A'), a AS (SELECT category, locator_id FROM sf WHERE source <> 'R'),
j AS (SELECT category, locator_id, b.locator_id IS NOT NULL AS was, a.locator_id IS NOT NULL AS now FROM (SELECT category, locator_id FROM b UNION SELECT category, locator_id FROM a) u LEFT JOIN b USING (category, locator_id) LEFT JOIN a USING (category, locator_id)),
p AS (SELECT *, CASE WHEN NOT now THEN 'removed' WHEN NOT was THEN 'added' END AS side FROM j), q AS (SELECT *, row_number() OVER (PARTITION BY category, side ORDER BY locator_id) AS place FROM p)
SELECT category, count(*) FILTER (was) AS n_before, count(*) FILTER (now) AS n_after, count(*) FILTER (side = 'added') AS n_added, count(*) FILTER (side = 'removed') AS n_removed, count(*) FILTER (now) - count(*) FILTER (was) AS delta,
 coalesce(string_agg(locator_id, ',' ORDER BY locator_id) FILTER (side = 'added' AND place <= 20), '') AS added, coalesce(string_agg(locator_id, ',' ORDER BY locator_id) FILTER (side = 'removed' AND place <= 20), '') AS removed FROM q GROUP BY category""")
def r23(spark, sf_dir):
    rows = surfaces(spark, sf_dir)
    return S.snapshot_diff(rows.where("source != 'A'"), rows.where("source != 'R'"))


def _energy(table: dict[str, float]) -> str:
    u = "CASE adjacency " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {table['unknown']} END"
    return _SF + f""", l AS (SELECT *, CASE WHEN category IN ('wall', 'ceiling') THEN greatest(0, area - cut) ELSE area END AS net, CAST({u} AS DOUBLE) AS u_value FROM sf), loss AS (SELECT *, net * u_value * 20 AS loss_w FROM l),
energy AS (SELECT uuid, sum(loss_w) AS loss_w, sum(CASE WHEN u_value > 0 THEN net ELSE 0 END) AS envelope_m2, sum(CASE WHEN category = 'floor' THEN net ELSE 0 END) AS floor_m2, sum(loss_w) / 20 * 3000 * 24 / 1000 AS kwh FROM loss GROUP BY uuid)"""


_CHANGED = {"externalAir": 0.25, "partyWall": 0.05}


@query("n1_heat_loss", _energy(S.U_VALUES) + " SELECT uuid, seq, round(net, 5) AS area, u_value, round(loss_w, 4) AS loss_w FROM loss")
def n1(spark, sf_dir):
    return S.heat_loss(surfaces(spark, sf_dir)).select("uuid", "seq", F.round("area", 5).alias("area"), "u_value", F.round("loss_w", 4).alias("loss_w"))


@query("n2_building_energy", _energy(S.U_VALUES) + " SELECT uuid, round(loss_w, 3) AS loss_w, round(envelope_m2, 3) AS envelope_m2, round(floor_m2, 3) AS floor_m2, round(kwh, 3) AS kwh FROM energy")
def n2(spark, sf_dir):
    out = S.building_energy(S.heat_loss(surfaces(spark, sf_dir)))
    return out.select("uuid", *[F.round(c, 3).alias(c) for c in ("loss_w", "envelope_m2", "floor_m2", "kwh")])


@query("n6_u_value_overrides", _energy(S.U_VALUES | _CHANGED) + " SELECT adjacency, u_value, count(*) AS n, round(sum(loss_w), 2) AS loss_w FROM loss GROUP BY adjacency, u_value")
def n6(spark, sf_dir):
    return S.heat_loss(surfaces(spark, sf_dir), _CHANGED).groupBy("adjacency", "u_value").agg(F.count("*").alias("n"), F.round(F.sum("loss_w"), 2).alias("loss_w"))


_RULES = (*S.IMPACT_RULES, "ceiling_yspan_excessive")
_IMPACT = _energy(S.U_VALUES) + f""", fl AS (SELECT uuid, seq, {_case('part % 5', _RULES)} AS rule, CASE WHEN part % 5 = 0 THEN (w + 1) * 8 END AS floor_area, CAST(supp % 40 AS DOUBLE) AS covered, CASE WHEN supp % 3 > 0 THEN d * 7 END AS outside FROM sf),
im AS (SELECT *, coalesce(outside, 5.0) * 0.3 * 72 AS lost, greatest(0, floor_area - covered) * 0.2 * 72 AS filled FROM fl LEFT JOIN (SELECT uuid, kwh FROM energy) USING (uuid)),
raw AS (SELECT *, CASE rule WHEN 'ceiling_coverage_gap' THEN filled WHEN 'out_of_envelope' THEN -lost ELSE 0 END AS v FROM im),
impact AS (SELECT uuid, seq, rule, round(v, 3) + 0.0 AS kwh_delta, CASE WHEN kwh > 0 THEN round(abs(v) / kwh, 6) ELSE 0 END AS pct_of_total, CAST(CASE rule WHEN 'ceiling_coverage_gap' THEN 0.78 WHEN 'ceiling_orientation_inverted' THEN 0.9 WHEN 'out_of_envelope' THEN 0.7 WHEN 'silent_drop' THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence FROM raw)"""


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = surfaces(spark, sf_dir)
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEYS)))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    w, d = F.when(supp % 31 == 0, 0.0).otherwise(1 + F.col("l_quantity") / 10), 1 + F.round(F.col("l_discount") * 10)
    flags = base.select(
        F.col("l_orderkey").alias("uuid"), "seq", F.element_at(F.array(*map(F.lit, _RULES)), (part % 5).cast("int") + 1).alias("rule"), F.when(part % 5 == 0, (w + 1) * 8).alias("floor_area_m2"),
        (supp % 40).cast("double").alias("covered_area_m2"), F.when(supp % 3 > 0, d * 7).alias("outside_area_m2"), F.lit(5.0).alias("area_m2"),
    )
    return S.flag_impact(flags, S.building_energy(S.heat_loss(rows))).select("uuid", "seq", "rule", "kwh_delta", "pct_of_total", "confidence")


@query("n3_flag_impact", _IMPACT + " SELECT uuid, seq, rule, kwh_delta, pct_of_total, confidence FROM impact")
def n3(spark, sf_dir):
    return impacts(spark, sf_dir)


@query("n4_impact_calibration", _IMPACT + """, q AS (SELECT rule, count(*) AS n, quantile_cont(abs(kwh_delta), 0.25) AS q1, quantile_cont(abs(kwh_delta), 0.5) AS q2, quantile_cont(abs(kwh_delta), 0.75) AS q3, max(abs(kwh_delta)) AS top, count(*) FILTER (abs(kwh_delta) > 200) AS many FROM impact GROUP BY rule)
SELECT rule, n, round(q2, 6) AS median_kwh, round(CASE WHEN n < 4 THEN top ELSE q2 + 1.5 * (q3 - q1) END, 6) AS threshold_kwh, many / n <= 0.05 AS safe FROM q""")
def n4(spark, sf_dir):
    return S.impact_calibration(impacts(spark, sf_dir))


@query("n5_autofix_candidates", _IMPACT + " SELECT uuid, seq, rule, kwh_delta, 'dry_run' AS action FROM impact WHERE rule IN ('silent_drop', 'ceiling_coverage_gap') AND abs(kwh_delta) <= 100 AND pct_of_total <= 0.01")
def n5(spark, sf_dir):
    return S.autofix_candidates(impacts(spark, sf_dir)).select("uuid", "seq", "rule", "kwh_delta", "action")


_HISTOGRAM = _SF + ", hi AS (SELECT uuid, " + ", ".join(f"count(*) FILTER (adjacency = '{a}') AS {a}" for a in S.U_VALUES) + ", max(part % 4 = 0) AS has_basement, CAST(uuid % 3 + 1 AS INTEGER) AS tier FROM sf GROUP BY uuid)"


@query("g1_adjacency_histogram", _HISTOGRAM + " SELECT uuid, " + ", ".join(S.U_VALUES) + " FROM hi")
def g1(spark, sf_dir):
    return S.adjacency_histogram(surfaces(spark, sf_dir))


@query("g2_adjacency_anomalies", _HISTOGRAM + """, f AS (SELECT uuid, concat_ws(',', CASE WHEN externalAir = 0 THEN 'no_external_air_elements' END, CASE WHEN tier = 1 AND unheatedAttic > 0 THEN 'unheated_attic_on_flat_roof_tier_1' END,
 CASE WHEN has_basement AND basementWallGroundShallow + basementWallGroundDeep = 0 THEN 'has_basement_but_no_basement_walls' END, CASE WHEN NOT has_basement AND basementWallGroundShallow + basementWallGroundDeep > 0 THEN 'no_basement_but_basement_walls_present' END) AS anomalies FROM hi)
SELECT * FROM f WHERE anomalies <> ''""")
def g2(spark, sf_dir):
    rows = surfaces(spark, sf_dir)
    buildings = rows.groupBy("uuid").agg(F.max(F.col("part") % 4 == 0).alias("has_basement")).withColumn("tier", F.col("uuid") % 3 + 1)
    return S.adjacency_anomalies(S.adjacency_histogram(rows), buildings)


_COUNTS = _SF + """, c AS (SELECT uuid, count(DISTINCT story) AS n_stories, count(*) FILTER (category = 'ceiling' AND kind = 'oblique') AS n_oblique, count(*) FILTER (category = 'ceiling' AND kind = 'flat') AS n_flat, max(part % 9 = 0) AS half, max(category = 'gable_closure') AS has_gable FROM sf GROUP BY uuid),
g AS (SELECT *, has_gable AND n_oblique >= 2 AS gable FROM c), t AS (SELECT *, CAST(CASE WHEN n_oblique = 0 AND NOT half THEN CASE WHEN n_stories <= 3 THEN n_stories ELSE 8 END WHEN n_oblique = 0 THEN 4 WHEN gable AND n_flat = 0 THEN 6 WHEN gable THEN 7 WHEN n_stories = 1 THEN 5 ELSE 8 END AS INTEGER) AS tier FROM g)"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, roof = F.col("kind"), F.col("category") == "ceiling"
    rows = surfaces(spark, sf_dir).groupBy("uuid").agg(
        F.count_distinct("story").alias("n_stories"), F.count_if(roof & (kind == "oblique")).alias("n_oblique"), F.count_if(roof & (kind == "flat")).alias("n_flat"),
        F.max(F.col("part") % 9 == 0).alias("has_half_height"), F.max(F.col("category") == "gable_closure").alias("has_gable"),
    )
    return S.building_tier(rows)


@query("g20_building_tier", _COUNTS + " SELECT uuid, n_stories, n_oblique, n_flat, tier FROM t")
def g20(spark, sf_dir):
    return _tiers(spark, sf_dir).select("uuid", "n_stories", "n_oblique", "n_flat", "tier")


@query("g18_tier_distribution", _COUNTS + " SELECT tier, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM t GROUP BY tier")
def g18(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("g19_plane_distribution", _SF + f", o AS (SELECT *, degrees(acos(least(1.0, abs(b)))) AS incl FROM pl WHERE category IN ('ceiling', 'dormer_face')) SELECT CAST(CASE WHEN h > 0 THEN 270 END AS INTEGER) AS azimuth_bin, {_SLOPE} AS slope, CASE WHEN few THEN 2 ELSE 4 END AS n_corners, count(*) AS n, round(sum(area), 4) AS area_m2 FROM o GROUP BY ALL")
def g19(spark, sf_dir):
    return S.plane_distribution(surfaces(spark, sf_dir))


@query("p7_shared_wall_pairs", _PK + " SELECT x.uuid, x.seq AS seq_a, z.seq AS seq_b, round(abs(x.pd - z.pd), 6) AS gap_m FROM k x JOIN k z ON x.uuid = z.uuid AND x.ka = z.ka AND x.kb = z.kb AND x.seq < z.seq AND x.room <> z.room WHERE round(abs(x.pd - z.pd), 6) <= 0.6")
def p7(spark, sf_dir):
    return S.shared_wall_pairs(surfaces(spark, sf_dir))


@query("p10_largest_normal_difference", _SF + """, c AS (SELECT *, CASE WHEN few THEN 0 ELSE w * d END AS plan, x0 + w AS x1, CASE WHEN few THEN z0 ELSE z0 + d END AS z1 FROM pl WHERE category = 'ceiling'), e AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY plan DESC, seq) AS place FROM c)
SELECT x.uuid, round(max(least(90.0, degrees(acos(least(1.0, x.a * z.a + x.b * z.b))))), 4) AS max_delta_deg, count(*) AS n_pairs FROM e x JOIN e z ON x.uuid = z.uuid AND x.place < z.place AND x.place <= 80 AND z.place <= 80
WHERE least(x.plan, z.plan) > 0 AND greatest(0, least(x.x1, z.x1) - greatest(x.x0, z.x0)) * greatest(0, least(x.z1, z.z1) - greatest(x.z0, z.z0)) >= 0.3 * least(x.plan, z.plan) GROUP BY x.uuid""")
def p10(spark, sf_dir):
    return S.largest_normal_difference(surfaces(spark, sf_dir))
