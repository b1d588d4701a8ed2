"""Operators over the surfaces of buildings: rules that flag them, heat loss, and reports on the corpus.

``surfaces`` has ``uuid, seq, category, story, room, locator_id, adjacency, source, kind, corners, openings`` (holes
or cutouts) ``, plane``. A row without corners takes part as an empty polygon where a rule looks for such; elsewhere
it gives no row. Work is dealt by building; no group is gathered in one value but short samples of a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

# fixed values: heat passed in W per m2 and K by what lies beyond the surface
U_VALUES = {
    "externalAir": 0.30, "groundSlab": 0.12, "groundSlabUFH": 0.10, "unheatedAttic": 0.20, "unheatedBasementFloor": 0.25, "basementWallGroundShallow": 0.20,
    "basementWallGroundDeep": 0.15, "internalToHeated": 0.0, "internalToUnheatedHost": 0.60, "partyWall": 0.0, "unknown": 0.30,
}
HDD, DELTA_T = 3000.0, 20.0
CATEGORIES = ("floor", "wall", "gap", "ceiling", "knee_wall", "dormer_face", "gable_closure")
IMPACT_RULES = ("ceiling_coverage_gap", "ceiling_orientation_inverted", "out_of_envelope", "silent_drop")


def _flag(rows: DataFrame, rule: str, severity: Column | str, evidence: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("uuid", "seq", "locator_id", F.lit(rule).alias("rule"), level.alias("severity"), F.round(evidence, 6).alias("evidence"))


def ceiling_inverted(surfaces: DataFrame, least: float = 0.10) -> DataFrame:
    """Ceilings whose normal does not point up; ``evidence`` is its y. Ceilings without area give no flag."""
    rows = surfaces.where("category = 'ceiling'").withColumn("up", G.unit_normal(F.col("corners"))["y"])
    return _flag(rows.where(F.col("up") < least), "ceiling_orientation_inverted", "high", F.col("up") + 0.0)


def ceiling_yspan(surfaces: DataFrame, most: float = 2.0) -> DataFrame:
    """Ceilings that rise by more than ``most`` m: low, medium from 3 m, high from 5 m."""
    rows = surfaces.where("category = 'ceiling'").withColumn("span", G.high(F.col("corners")) - G.low(F.col("corners")))
    level = F.when(F.col("span") >= 5, "high").when(F.col("span") >= 3, "medium").otherwise("low")
    return _flag(rows.where(F.col("span") > most), "ceiling_yspan_excessive", level, F.col("span"))


def silent_drops(surfaces: DataFrame, least: float = 1e-4) -> DataFrame:
    """Surfaces with fewer than three corners (``evidence`` null) or hardly any area, of every category."""
    rows = surfaces.withColumn("few", F.coalesce(F.size("corners") < 3, F.lit(True))).withColumn("area", F.when(~F.col("few"), G.area_3d(F.col("corners"))))
    return _flag(rows.where(F.col("few") | (F.col("area") < least)), "silent_drop", "low", F.col("area"))


def cutouts_outside(surfaces: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row per cutout of a wall that stands above or below it; ``evidence`` is by how much (four decimals)."""
    walls = surfaces.where("category = 'wall'").select("uuid", "seq", "locator_id", "corners", F.posexplode("openings").alias("cutout", "hole"))
    low, high = G.low(F.col("corners")), G.high(F.col("corners"))
    over = F.greatest(F.lit(0.0), low - G.low(F.col("hole"))) + F.greatest(F.lit(0.0), G.high(F.col("hole")) - high)
    rows = walls.withColumn("over", F.when(low.isNotNull() & G.low(F.col("hole")).isNotNull(), over)).where(F.col("over") > tolerance)
    said = F.lit("wall_cutout_outside_outline").alias("rule"), F.lit("medium").alias("severity"), F.round("over", 4).alias("evidence")
    return rows.select("uuid", "seq", "locator_id", *said, "cutout")


def corners_not_planar(surfaces: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Oblique ceilings with a corner off their plane."""
    rows = surfaces.where("category = 'ceiling' and kind = 'oblique'").withColumn("off", G.worst_residual(F.col("plane"), F.col("corners")))
    return _flag(rows.where(F.col("off") > tolerance), "roof_corners_not_planar", "medium", F.col("off"))


def all_rules(surfaces: DataFrame) -> DataFrame:
    """The flags of every rule above, with ``cutout`` where there is one, in one pass over the surfaces."""
    kind = "struct<rule:string,severity:string,evidence:double,cutout:int>"
    corners, ceiling = F.col("corners"), F.col("category") == "ceiling"

    def flag(when: Column, rule: str, severity: Column | str, evidence: Column, cutout: Column | None = None) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(rule).alias("rule"), level.alias("severity"), evidence.cast("double").alias("evidence"), (F.lit(None) if cutout is None else cutout).cast("int").alias("cutout")).cast(kind))

    few = F.coalesce(F.size(corners) < 3, F.lit(True))
    rows = surfaces.withColumns({"__few": few, "__area": F.when(~few, G.area_3d(corners)), "__low": G.low(corners), "__high": G.high(corners)})
    rows = rows.withColumns({"__up": F.when(ceiling, G.unit_normal(corners)["y"]), "__off": F.when(ceiling & (F.col("kind") == "oblique"), G.worst_residual(F.col("plane"), corners))})
    span = F.col("__high") - F.col("__low")
    single = F.array(
        flag(F.col("__up") < 0.10, "ceiling_orientation_inverted", "high", F.round(F.col("__up") + 0.0, 6)),
        flag(ceiling & (span > 2.0), "ceiling_yspan_excessive", F.when(span >= 5, "high").when(span >= 3, "medium").otherwise("low"), F.round(span, 6)),
        flag(F.col("__few") | (F.col("__area") < 1e-4), "silent_drop", "low", F.round("__area", 6)),
        flag(F.col("__off") > 0.005, "roof_corners_not_planar", "medium", F.round("__off", 6)),
    )

    def cut(hole: Column, i: Column) -> Column:
        over = F.greatest(F.lit(0.0), F.col("__low") - G.low(hole)) + F.greatest(F.lit(0.0), G.high(hole) - F.col("__high"))
        return G.once(F.when(F.col("__low").isNotNull() & G.low(hole).isNotNull(), over), lambda x: flag(x > 1e-3, "wall_cutout_outside_outline", "medium", F.round(x, 4), i))

    holes = F.when(F.col("category") == "wall", F.transform("openings", cut))
    found = F.filter(F.concat(single, F.coalesce(holes, F.array().cast(f"array<{kind}>"))), lambda x: x.isNotNull())
    return rows.select("uuid", "seq", "locator_id", F.explode(found).alias("f")).select("uuid", "seq", "locator_id", "f.*")


def rule_frequency(flags: DataFrame) -> DataFrame:
    """Flags and flagged buildings by rule and severity."""
    return flags.groupBy("rule", "severity").agg(F.count("*").alias("n_flags"), F.count_distinct("uuid").alias("n_buildings"))


def u_table(overrides: dict[str, float] | None = None) -> Column:
    """Map from adjacency to U-value, with overrides."""
    merged = U_VALUES | (overrides or {})
    return F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])


def heat_loss(surfaces: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """Net area, U-value and loss in W of each surface. Unknown and null adjacencies use the value of ``unknown``."""
    table = u_table(overrides)
    u = F.coalesce(F.try_element_at(table, F.coalesce("adjacency", F.lit("unknown"))), F.try_element_at(table, F.lit("unknown")))
    area = F.when(F.col("category").isin("wall", "ceiling"), G.net_area(F.col("corners"), F.col("openings"))).otherwise(G.area_3d(F.col("corners")))
    rows = surfaces.select("uuid", "seq", "category", "adjacency", area.alias("area"), u.alias("u_value"))
    return rows.withColumn("loss_w", F.col("area") * F.col("u_value") * DELTA_T)


def building_energy(losses: DataFrame) -> DataFrame:
    """Loss, yearly kWh, envelope area (where heat passes) and floor area by building."""
    rows = losses.groupBy("uuid").agg(
        F.sum("loss_w").alias("loss_w"), F.sum(F.when(F.col("u_value") > 0, F.col("area")).otherwise(0.0)).alias("envelope_m2"), F.sum(F.when(F.col("category") == "floor", F.col("area")).otherwise(0.0)).alias("floor_m2")
    )
    return rows.withColumn("kwh", F.col("loss_w") / DELTA_T * HDD * 24 / 1000)


def flag_impact(flags: DataFrame, energy: DataFrame, fill_u: float = U_VALUES["unheatedAttic"]) -> DataFrame:
    """What mending each flag would change in yearly kWh.

    ``flags`` has ``uuid, rule, floor_area_m2, covered_area_m2, outside_area_m2, area_m2``; missing areas count 0.
    """
    rule, zero = F.col("rule"), F.lit(0.0)
    gap = F.greatest(zero, F.coalesce("floor_area_m2", zero) - F.coalesce("covered_area_m2", zero))
    outside = F.coalesce("outside_area_m2", "area_m2", zero)
    year = HDD * 24 / 1000
    raw = F.when(rule == IMPACT_RULES[0], gap * fill_u * year).when(rule == IMPACT_RULES[2], -(outside * U_VALUES["externalAir"] * year)).otherwise(0.0)
    sure = F.when(rule == IMPACT_RULES[0], 0.78).when(rule == IMPACT_RULES[1], 0.90).when(rule == IMPACT_RULES[2], 0.70).when(rule == IMPACT_RULES[3], 0.95).otherwise(1.0)
    rows = flags.join(energy.select("uuid", F.col("kwh").alias("base")), "uuid", "left").withColumn("raw", raw)
    share = F.when(F.col("base") > 0, F.round(F.abs("raw") / F.col("base"), 6)).otherwise(0.0)
    return rows.withColumns({"kwh_delta": F.round("raw", 3) + 0.0, "pct_of_total": share, "confidence": sure}).drop("raw", "base")


def impact_calibration(impacts: DataFrame, large_kwh: float = 200.0, most: float = 0.05) -> DataFrame:
    """Median, proposed threshold and safety of each rule; with fewer than four flags the threshold is the largest."""
    size = impacts.select(F.coalesce("rule", F.lit("unknown")).alias("rule"), F.abs(F.coalesce("kwh_delta", F.lit(0.0))).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = size.groupBy("rule").agg(F.count("*").alias("n"), q.alias("q"), F.max("v").alias("top"), F.count_if(F.col("v") > large_kwh).alias("n_large"))
    limit = F.when(F.col("n") < 4, F.col("top")).otherwise(F.col("q")[1] + 1.5 * (F.col("q")[2] - F.col("q")[0]))
    return rows.select("rule", "n", F.round(F.col("q")[1], 6).alias("median_kwh"), F.round(limit, 6).alias("threshold_kwh"), (F.col("n_large") / F.col("n") <= most).alias("safe"))


def autofix_candidates(impacts: DataFrame, kwh: float = 100.0, share: float = 0.01, enabled: bool = False) -> DataFrame:
    small = (F.abs(F.coalesce("kwh_delta", F.lit(0.0))) <= kwh) & (F.coalesce("pct_of_total", F.lit(0.0)) <= share)
    return impacts.where(F.col("rule").isin("silent_drop", "ceiling_coverage_gap") & small).withColumn("action", F.lit("recorded" if enabled else "dry_run"))


def adjacency_histogram(surfaces: DataFrame) -> DataFrame:
    """One row per building, one column per known adjacency; 0 where it has none."""
    return surfaces.groupBy("uuid").agg(*[F.count_if(F.col("adjacency") == a).alias(a) for a in U_VALUES])


def adjacency_anomalies(histogram: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adjacencies that cannot be, given ``tier`` and ``has_basement`` of each building; joined with commas."""
    walls, cellar = F.col("basementWallGroundShallow") + F.col("basementWallGroundDeep"), F.col("has_basement")
    found = F.concat_ws(
        ",", F.when(F.col("externalAir") == 0, "no_external_air_elements"), F.when((F.col("tier") == 1) & (F.col("unheatedAttic") > 0), "unheated_attic_on_flat_roof_tier_1"),
        F.when(cellar & (walls == 0), "has_basement_but_no_basement_walls"), F.when(~cellar & (walls > 0), "no_basement_but_basement_walls_present"),
    )
    return histogram.join(buildings, "uuid").select("uuid", found.alias("anomalies")).where("anomalies != ''")


def building_tier(buildings: DataFrame) -> DataFrame:
    """Adds the tier, 1 to 8, from ``n_stories, n_oblique, n_flat, has_half_height, has_gable``.

    A gable counts only where the roof has two oblique surfaces or more. Null counts are 0, null marks false.
    """
    n, oblique, flat = (F.coalesce(c, F.lit(0)) for c in ("n_stories", "n_oblique", "n_flat"))
    half, gable = F.coalesce("has_half_height", F.lit(False)), F.coalesce("has_gable", F.lit(False)) & (oblique >= 2)
    plain = F.when(n.between(1, 3), n).otherwise(8)
    tier = F.when((oblique == 0) & ~half, plain).when(oblique == 0, 4).when(gable & (flat == 0), 6).when(gable, 7).when(n == 1, 5).otherwise(8)
    return buildings.withColumn("tier", tier.cast("int"))


def plane_distribution(surfaces: DataFrame, step: int = 30) -> DataFrame:
    """Planes by azimuth bin, slope class and number of corners, with their area."""
    plane = F.col("plane")
    rows = surfaces.where(F.col("category").isin("ceiling", "dormer_face") & plane.isNotNull())
    turn = F.when(G.inclination_deg(plane) >= 1e-3, (F.floor(F.round(G.azimuth_deg(plane), 6) / step) * step).cast("int"))
    rows = rows.groupBy(turn.alias("azimuth_bin"), G.slope_class(G.inclination_deg(plane)).alias("slope"), F.size("corners").alias("n_corners"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(G.area_3d(F.col("corners"))), 4).alias("area_m2"))


def plane_groups(surfaces: DataFrame) -> DataFrame:
    """Surfaces of one building on one quantised plane, whichever way they face."""
    rows = surfaces.where("plane is not null").groupBy("uuid", G.plane_key(F.col("plane")).alias("key"))
    return rows.agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).select("uuid", "key.*", "n", "first_seq")


def shared_wall_pairs(surfaces: DataFrame, most: float = 0.60) -> DataFrame:
    """Pairs of surfaces of different rooms in one building with one quantised normal and offsets at most ``most`` m apart."""
    key = F.col("k")
    rows = surfaces.where("plane is not null").withColumn("k", G.plane_key(F.col("plane"))).select("uuid", "seq", "room", key["a"].alias("ka"), key["b"].alias("kb"), key["c"].alias("kc"), F.col("plane.d").alias("d"))
    a, b = rows.alias("a"), rows.alias("b")
    same = F.expr("a.uuid = b.uuid and a.ka = b.ka and a.kb = b.kb and a.kc = b.kc and a.seq < b.seq and a.room != b.room")
    gap = F.round(F.abs(F.col("a.d") - F.col("b.d")), 6)
    return a.join(b, same).select("a.uuid", F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"), gap.alias("gap_m")).where(F.col("gap_m") <= most)


def largest_normal_difference(surfaces: DataFrame, pieces: int = 80, share: float = 0.30) -> DataFrame:
    """Largest angle, at most 90 degrees, between two of a building's largest ceilings whose boxes overlap enough.

    Only the ``pieces`` largest take part: that is the measure's definition.
    """
    area = G.area_xz(F.col("corners"))
    order = Window.partitionBy("uuid").orderBy(F.desc("area"), "seq")
    rows = surfaces.where("category = 'ceiling' and plane is not null").select("uuid", "seq", "plane", area.alias("area"), G.box(F.col("corners")).alias("box"))
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pieces)
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, F.expr("a.uuid = b.uuid and a.place < b.place"))
    smaller = F.least(F.col("a.area"), F.col("b.area"))
    dot = sum((F.col(f"a.plane.{k}") * F.col(f"b.plane.{k}") for k in "abc"), F.lit(0.0))
    angle = F.least(F.lit(90.0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))))
    close = both.where((smaller > 0) & (G.box_overlap(F.col("a.box"), F.col("b.box")) >= share * smaller))
    return close.groupBy(F.col("a.uuid").alias("uuid")).agg(F.round(F.max(angle), 4).alias("max_delta_deg"), F.count("*").alias("n_pairs"))


def snapshot_diff(before: DataFrame, after: DataFrame, sample: int = 20) -> DataFrame:
    """Surfaces by category before and after, and how many locators came and went, with the first of each by name."""
    keys = [d.select("category", "locator_id").where("locator_id is not null").groupBy("category", "locator_id").agg(F.count("*").alias(n)) for d, n in ((before, "b"), (after, "a"))]
    both = keys[0].join(keys[1], ["category", "locator_id"], "full_outer")
    gone, new = F.col("a").isNull(), F.col("b").isNull()
    side = F.when(gone, "removed").when(new, "added")
    place = F.row_number().over(Window.partitionBy("category", "side").orderBy("locator_id"))
    per = both.groupBy("category").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("n_after"), F.count_if(new).alias("n_added"), F.count_if(gone).alias("n_removed"))
    few = both.withColumn("side", side).where("side is not null").withColumn("place", place).where(F.col("place") <= sample).groupBy("category")
    said = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("locator_id")))), ",").alias(s) for s in ("added", "removed")]
    return per.join(few.agg(*said), "category", "left").withColumn("delta", F.col("n_after") - F.col("n_before")).fillna("", ["added", "removed"])
