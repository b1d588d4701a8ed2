"""Features of buildings, merged surfaces and groups of planes: trust table, quality classes, walls, normals, roof families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K

# fixed values: which side of a merge is trusted for a field, and the divergences in centimetres that are flagged
TRUST = {
    "dimensions.width": "raw",
    "dimensions.height": "raw",
    "dimensions.depth": "merged unless zero",
    "transform": "merged",
    "polygon_corners": "raw",
    "parent_identifier": "merged",
    "story": "merged",
    "completed_edges": "merged",
    "confidence": "merged",
    "category": "merged",
}
DIVERGENT_CM = {"dimensions.width": 15.0, "dimensions.height": 20.0, "dimensions.depth": 10.0}
SYNTHESIZED = "synthesized_in_merge"
# fixed values: states of the gable extension that name a family by themselves
GABLE_STATES = {"gable_complete": "gable", "gable_along_extend": "complex", "gable_cross_review": "complex", "gable_ambiguous": "complex"}
TINY = 1e-9


def trust_merge(pairs: DataFrame) -> DataFrame:
    """One reconciled ``surface`` per row of ``merged`` and ``raw`` structs (``raw`` null: merging made it up).

    Fields of the structs are named by the last part of the names in ``TRUST``; those that either lacks are left out. Further columns: ``from_raw``,
    ``from_merged`` (names of fields), ``divergences`` (cm by name) and ``flags``.
    """
    has = {c: set(pairs.schema[c].dataType.names) for c in ("merged", "raw")}
    merged, raw, none = F.col("merged"), F.col("raw"), F.col("raw").isNull()
    surface, takes, apart = {c: merged[c] for c in pairs.schema["merged"].dataType.names}, {}, {}
    for name, side in TRUST.items():
        c = name.rsplit(".", 1)[-1]
        if not all(c in h for h in has.values()):
            continue
        take = raw[c].isNotNull() & F.lit(side != "merged")
        if side == "merged unless zero":
            take = take & (F.abs(F.coalesce(merged[c], F.lit(0.0))) < 1e-6)
        takes[name], surface[c] = take & ~none, F.when(take & ~none, raw[c]).otherwise(merged[c])
        if name in DIVERGENT_CM:
            apart[name] = F.abs(merged[c] - raw[c]) * 100
    said = [F.when(cm > DIVERGENT_CM[name], F.format_string(f"{name}: %.1fcm divergence", cm)) for name, cm in apart.items()]
    known = F.array_compact(F.array(*[F.when(cm.isNotNull(), F.struct(F.lit(name), cm)) for name, cm in apart.items()]))
    return pairs.select(
        *[c for c in pairs.columns if c not in has], F.struct(*[v.alias(c) for c, v in surface.items()]).alias("surface"),
        F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in takes.items()])).alias("from_raw"), F.array_compact(F.array(*[F.when(~t, F.lit(n)) for n, t in takes.items()])).alias("from_merged"),
        F.map_from_entries(known).alias("divergences"), F.when(none, F.array(F.lit(SYNTHESIZED))).otherwise(F.array_compact(F.array(*said))).alias("flags"),
    )


def quality_report(buildings: DataFrame, merged: DataFrame, raw: DataFrame, merges: DataFrame, floor_gaps: DataFrame, cross_gaps: DataFrame) -> DataFrame:
    """One row per building of ``buildings`` (``uuid, sessions, median_m, story_change_ratio``) with its class and what speaks for it.

    ``merged`` and ``raw`` hold a row per wall, ``merges`` walls of ``trust_merge``, ``floor_gaps`` a ``thickness_cm`` and ``cross_gaps`` a ``confidence`` per gap.
    Divergences of zero are no divergences. Every table is reduced to one row per building before it is joined.
    """
    counted = lambda t, name: t.groupBy("uuid").agg(F.count("*").alias(name))
    cm = lambda name: F.nullif(F.col("divergences")[name], F.lit(0.0))
    width, height = cm("dimensions.width"), cm("dimensions.height")
    fields = merges.groupBy("uuid").agg(
        F.max(width).alias("max_width_cm"), F.max(height).alias("max_height_cm"), F.avg(width).alias("mean_width_cm"), F.avg(height).alias("mean_height_cm"),
        F.count_if(F.array_contains("flags", SYNTHESIZED)).alias("synthesized"), F.count_if(F.size("flags") > 0).alias("flagged"),
    )
    gaps = floor_gaps.groupBy("uuid").agg(F.count("thickness_cm").alias("floor_gaps"), F.avg("thickness_cm").alias("mean_gap_cm"), F.percentile("thickness_cm", 0.5).alias("median_gap_cm"))
    cross = cross_gaps.groupBy("uuid").agg(F.count("*").alias("cross_gaps"), F.count_if(F.col("confidence") == "high").alias("cross_gaps_high"))
    rows = buildings
    for table in (counted(merged, "merged_walls"), counted(raw, "raw_walls"), fields, gaps, cross):
        rows = rows.join(table, "uuid", "left")
    rows = rows.fillna(0)
    rows = rows.withColumn("reduction_pct", F.when(F.col("raw_walls") > 0, (1 - F.col("merged_walls") / F.col("raw_walls")) * 100).otherwise(0.0))
    return _classified(rows)


def _classified(rows: DataFrame) -> DataFrame:
    c = F.col
    ratio = F.format_string("YELLOW: story_change_ratio > 50%% (%.0f%%)", c("story_change_ratio") * 100)
    red = {
        "RED: wall_reduction > 50%": c("reduction_pct") > 50,
        "RED: max_height_delta > 50cm": c("max_height_cm") > 50,
    }
    severe = [F.when(cond, F.lit(said)) for said, cond in red.items()]
    severe.append(F.when(c("sessions") >= 3, F.format_string("RED: multi_session (%d scan sessions)", "sessions")))
    severe.append(F.when(c("median_m") > 10, F.format_string("RED: median_wall_displacement > 10m (%.1fm)", "median_m")))
    yellow = {
        "YELLOW: wall_reduction > 30%": c("reduction_pct") > 30,
        "YELLOW: max_height_delta > 20cm": c("max_height_cm") > 20,
        "YELLOW: max_width_delta > 15cm": c("max_width_cm") > 15,
        "YELLOW: synthesized_count > 5": c("synthesized") > 5,
    }
    mild = [F.when(cond, F.lit(said)) for said, cond in yellow.items()]
    mild.append(F.when(c("cross_gaps_high") > 3, F.format_string("YELLOW: cross_floor_gaps_high > 3 (%d)", "cross_gaps_high")))
    mild.append(F.when(c("story_change_ratio") > 0.5, ratio))
    mild.append(F.when(c("median_m") > 7, F.format_string("YELLOW: median_wall_displacement > 7m (%.1fm)", "median_m")))
    rows = rows.withColumns({"__red": F.array_compact(F.array(*severe)), "__yellow": F.array_compact(F.array(*mild))})
    bad, fair = F.size("__red") > 0, F.size("__yellow") > 0
    return rows.withColumns({"classification": F.when(bad, "RED").when(fair, "YELLOW").otherwise("GREEN"), "flags": F.when(bad, c("__red")).otherwise(c("__yellow"))}).drop("__red", "__yellow")


def _spread(weights: DataFrame, by: str, weight: str, name: str) -> DataFrame:
    """Entropy of the weights of a group over the log of how many there are: 0 for one, 1 for equal ones."""
    w = F.col(weight)
    total = F.sum(w)
    raw = F.ln(total) - F.sum(F.when(w > 0, w * F.ln(w)).otherwise(0.0)) / total
    return weights.groupBy(by).agg(F.when(total > TINY, F.when(F.count("*") > 1, raw / F.ln(F.count("*"))).otherwise(0.0)).alias(name))


def wall_direction_profile(walls: DataFrame, step: float = 10.0) -> DataFrame:
    """Per building, the bin of azimuths modulo 180 that holds most wall length (ties: the least), and how evenly the bins are filled.

    ``walls`` has ``uuid`` and ``corners``; an azimuth is that of the principal axis in plan, a length the widest distance of two corners.
    """
    x, z = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["z"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size("corners")
    spread = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q)) - total(a) * total(b) / n
    sxx, szz, sxz = spread(x, x), spread(z, z), spread(x, z)
    level = (F.abs(sxz) < TINY) & (F.abs(sxx - szz) < TINY)
    azimuth = F.when(level, 0.0).otherwise(F.pmod(90 - F.degrees(F.atan2(2 * sxz, sxx - szz)) / 2, F.lit(180.0)))
    reach = F.array_max(F.transform("corners", lambda p: F.array_max(F.transform("corners", lambda q: F.hypot(p["x"] - q["x"], p["z"] - q["z"])))))
    bins = walls.where(n >= 2).groupBy("uuid", (F.bround(azimuth / step) * step).alias("bin")).agg(F.sum(F.greatest(reach, F.lit(1e-3))).alias("length"))
    most = bins.groupBy("uuid").agg(F.pmod(F.max_by("bin", F.struct(F.round("length", 9), -F.col("bin"))), F.lit(180.0)).alias("dominant_azimuth_deg"))
    return most.join(_spread(bins, "uuid", "length", "azimuth_entropy"), "uuid")


def _pairwise(values: DataFrame, by: str, own: list[str]) -> DataFrame:
    """Pairs of different values of a group, each once: ``a`` and ``b`` structs with their counts ``n``.

    The work is quadratic in the different values of a group, not in its members.
    """
    counts = values.groupBy(by, *own).agg(F.count("*").alias("n"))
    side = lambda s: counts.select(by, F.struct(*own, "n").alias(s))
    return side("a").join(side("b"), by).where(F.struct(*[F.col(f"a.{c}") for c in own]) < F.struct(*[F.col(f"b.{c}") for c in own]))


def source_wall_stats(members: DataFrame, walls: DataFrame) -> DataFrame:
    """Per ``group`` of members (``group, wall_id``), measures of the walls that they came from.

    ``walls`` has ``wall_id, length_m, top_y, bottom_y, azimuth_deg, incl_deg``. Members without a wall id do not count. A group of no known wall has
    a count of 0 and nulls; the ratio is null where no member names a wall.
    """
    measures = ("length_m", "top_y", "bottom_y", "azimuth_deg", "incl_deg")
    rows = members.select("group", "wall_id").join(walls.select("wall_id", *measures, F.lit(True).alias("known")), "wall_id", "left")
    known = F.count_if("known")
    twice = F.radians(2 * F.col("azimuth_deg"))
    c, s = F.avg(F.cos(twice)), F.avg(F.sin(twice))
    r = F.greatest(F.sqrt(c * c + s * s), F.lit(TINY))
    out = rows.groupBy("group").agg(
        known.alias("resolved"), F.when(F.count("wall_id") > 0, known / F.count("wall_id")).alias("resolution_ratio"),
        F.avg("length_m").alias("length_mean"), F.stddev_pop("length_m").alias("length_std"), F.min("length_m").alias("length_min"), F.max("length_m").alias("length_max"), F.sum("length_m").alias("length_total"),
        F.avg("top_y").alias("top_mean"), F.stddev_pop("top_y").alias("top_std"), (F.max("top_y") - F.min("top_y")).alias("top_range"), F.avg("bottom_y").alias("bottom_mean"), F.stddev_pop("bottom_y").alias("bottom_std"),
        (F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)) / 2).alias("azimuth_mean"), F.when(c.isNotNull(), F.degrees(F.sqrt(F.greatest(-2 * F.ln(r), F.lit(0.0)))) / 2).alias("azimuth_std"),
        F.avg("incl_deg").alias("incl_mean"), F.stddev_pop("incl_deg").alias("incl_std"), F.max("incl_deg").alias("incl_max"), F.avg(F.when(F.col("incl_deg").isNotNull(), (F.col("incl_deg") > 2).cast("double"))).alias("nonvertical_share"),
    )
    apart = K.circular_difference(F.col("a.azimuth_deg"), F.col("b.azimuth_deg"), 180)
    widest = _pairwise(rows.where("azimuth_deg is not null").select("group", "azimuth_deg"), "group", ["azimuth_deg"]).groupBy("group").agg(F.max(apart).alias("__apart"))
    some = F.when(F.col("azimuth_mean").isNotNull(), F.coalesce("__apart", F.lit(0.0)))
    return out.join(widest, "group", "left").withColumn("azimuth_max_diff", some).drop("__apart")


def normal_dispersion(members: DataFrame) -> DataFrame:
    """Per ``group`` of planes (``group, plane, room_id, wall_id``): how far their unit normals spread, and how evenly rooms and walls share them.

    Planes without a normal do not count in the measures of normals; absent ids not in the entropies. ``kappa`` is null for equal normals, the cosines are
    null for fewer than two. Offsets are spread over ten equal bins between the least and the largest.
    """
    size = F.sqrt(sum((F.pow(F.col(f"plane.{c}"), 2) for c in "abc"), F.lit(0.0)))
    rows = members.withColumn("__size", size)
    units = rows.where(F.col("__size") >= TINY).select("group", *[(F.col(f"plane.{c}") / F.col("__size")).alias(c) for c in "abcd"])
    length = F.sqrt(sum((F.pow(F.avg(c), 2) for c in "abc"), F.lit(0.0)))
    out = units.groupBy("group").agg(F.count("*").alias("n_normals"), length.alias("resultant_length"), F.min("d").alias("__low"), F.max("d").alias("__high"), F.count("d").alias("__n"))
    r = F.col("resultant_length")
    out = out.withColumns({"spherical_variance": 1 - r, "kappa": F.when(r < 1 - TINY, (3 * r - r * r * r) / (1 - r * r))})

    a = units.groupBy("group", "a", "b", "c").agg(F.count("*").alias("n"))
    same = a.where("n > 1").groupBy("group").agg(F.sum(F.col("n") * (F.col("n") - 1)).cast("double").alias("total"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.lit(1.0).alias("low"))
    cos = F.abs(sum((F.col(f"a.{c}") * F.col(f"b.{c}") for c in "abc"), F.lit(0.0)))
    both = 2 * F.col("a.n") * F.col("b.n")
    other = _pairwise(units, "group", ["a", "b", "c"]).groupBy("group").agg(F.sum(cos * both).alias("total"), F.sum(both).alias("pairs"), F.min(cos).alias("low"))
    cosines = same.unionByName(other).groupBy("group").agg(F.min("low").alias("cos_min"), (F.sum("total") / F.sum("pairs")).alias("cos_mean"))

    wide = out.where("__high - __low > 1e-9").select("group", "__low", "__high")
    bins = units.where("d is not null").join(wide, "group").groupBy("group", F.least(F.floor((F.col("d") - F.col("__low")) / (F.col("__high") - F.col("__low")) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("group"))
    bins = bins.withColumn("__p", p).groupBy("group").agg((-F.sum(F.col("__p") * F.ln("__p")) / F.ln(F.lit(10.0))).alias("__offsets"))
    out = members.select("group").distinct().join(out, "group", "left").join(cosines, "group", "left").join(bins, "group", "left")
    out = out.withColumn("offset_entropy", F.when(F.col("__n") > 1, F.coalesce("__offsets", F.lit(0.0)))).drop("__low", "__high", "__n", "__offsets")
    for c, name in (("room_id", "room_entropy"), ("wall_id", "wall_entropy")):
        counts = members.where(F.col(c).isNotNull()).groupBy("group", c).agg(F.count("*").alias("n"))
        out = out.join(_spread(counts, "group", "n", name), "group", "left")
    return out


def roof_family(status: Column, slanted: Column) -> Column:
    """A guess at the family of a roof part from the state of its gable extension and its number of slanted planes."""
    out = F.lit(None).cast("string")
    for state, family in GABLE_STATES.items():
        out = F.when(status == state, family).otherwise(out)
    by_count = F.when(slanted.isNull() | (slanted < 0), "unknown").when(slanted == 0, "flat").when(slanted == 1, "shed").when(slanted == 2, "gable").when(slanted == 3, "complex").otherwise("hip")
    return F.coalesce(out, by_count)


def derived_features(rows: DataFrame) -> DataFrame:
    """Adds what follows from features at hand: the family, angles of axes to each other, and marks.

    Needs ``gable_status, n_slanted, plane_az, az0, az1, ridge_az, major_az, building_az, story_delta_max, architectural, opposing``; what cannot be told is null.
    """
    c, axes = F.col, lambda a, b: K.circular_difference(F.col(a), F.col(b), 180)
    family = roof_family(c("gable_status"), c("n_slanted"))
    leg = F.least(axes("plane_az", "az0"), axes("plane_az", "az1"))  # nulls are passed over
    can = (family == "gable") & leg.isNotNull()
    return rows.withColumns({
        "family": family, "min_az_to_leg": F.when(can, leg), "matches_gable": F.when(can, leg < 10), "leg_delta": axes("az0", "az1"), "ridge_vs_major": axes("ridge_az", "major_az"),
        "leg0_vs_major": axes("az0", "major_az"), "leg1_vs_major": axes("az1", "major_az"), "plane_vs_building": axes("plane_az", "building_az"), "cross_story": c("story_delta_max") > 0,
        "orphan_oblique": F.when(c("architectural").isNotNull(), c("architectural") & F.coalesce(c("opposing") == 0, F.lit(False))),
        "one_slanted": c("n_slanted") == 1, "two_slanted": c("n_slanted") == 2, "many_slanted": c("n_slanted") >= 4,
    })
