"""Opposing roof planes, and which planes the type of a roof lets stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import written
from .spatial import SIDE, by_crowd, regions, shared_area

# fixed values: degrees, metres, and the least number of planes that each type of roof needs
PARTNER_AZIMUTH, PARTNER_SLOPE, CLASS_AZIMUTH, CLASS_SLOPE, TIER_GAP, APEX = 40.0, 10.0, 30.0, 10.0, 20.0, 0.25
NEEDED = {"gable": 2, "hip": 4, "cross_gable": 4, "mansard": 4, "pyramid": 4}


def opposing_pairs(planes: DataFrame, azimuth: float = PARTNER_AZIMUTH, slope: float = PARTNER_SLOPE, keys: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """``keys, a, b`` (``a < b`` by ``seq``) of planes (``keys, seq, azimuth, incl``) that face away from each other within ``azimuth`` degrees and slope alike within ``slope``.

    Planes meet in sectors of the circle, one side turned by half a circle, so that only those near a pair's directions are compared.
    """
    width = 360.0 / max(1, int(360.0 / max(azimuth, 1.0)))
    n = int(round(360.0 / width))
    at = planes.where("azimuth is not null and incl is not null").select(*keys, "seq", "azimuth", "incl")
    own = at.withColumn("sector", F.pmod(F.floor(F.pmod(F.col("azimuth"), F.lit(360.0)) / width), F.lit(n)).cast("int"))
    turned = at.withColumn("s", F.floor(F.pmod(F.col("azimuth") + 180.0, F.lit(360.0)) / width).cast("int"))
    turned = turned.withColumn("sector", F.explode(F.array_distinct(F.array(*[F.pmod(F.col("s") + i, F.lit(n)).cast("int") for i in (-1, 0, 1)])))).drop("s")
    near = F.abs(F.pmod(F.col("a.azimuth") - F.col("b.azimuth") + 180.0, F.lit(360.0)) - 180.0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = own.alias("a").join(turned.alias("b"), reduce(Column.__and__, same) & (F.col("a.sector") == F.col("b.sector")) & (F.col("a.seq") != F.col("b.seq")))
    both = both.where((F.round(F.abs(near - 180.0), 9) <= azimuth) & (F.round(F.abs(F.col("a.incl") - F.col("b.incl")), 9) <= slope))
    return both.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.least("a.seq", "b.seq").alias("a"), F.greatest("a.seq", "b.seq").alias("b")).distinct()


def _members(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.select(*keys, F.explode(F.array("a", "b")).alias("seq")).distinct()


def crossing_pairs(planes: DataFrame, tolerance: float = CLASS_AZIMUTH, slope: float = CLASS_SLOPE) -> DataFrame:
    """``uuid, seq`` of planes in an opposing pair for which the building has another one across it, within ``tolerance`` of a right angle."""
    pairs = opposing_pairs(planes, tolerance, slope)
    axes = pairs.join(planes.select("uuid", F.col("seq").alias("a"), F.pmod(F.col("azimuth"), F.lit(180.0)).alias("axis")), ["uuid", "a"])
    seen = axes.select("uuid", F.round("axis", 9).alias("axis")).distinct()
    across = F.abs(F.abs(F.col("l.axis") - F.col("r.axis")) - 90.0)  # axes are under 180 degrees apart, so this is the distance of their angle on a circle of 360 from a right one
    ok = seen.alias("l").join(seen.alias("r"), (F.col("l.uuid") == F.col("r.uuid")) & (F.round(across, 9) <= tolerance), "left_semi")
    return _members(axes.withColumn("axis", F.round("axis", 9)).join(ok, ["uuid", "axis"], "left_semi"), "uuid")


def pitch_tiers(planes: DataFrame, least: float = TIER_GAP) -> DataFrame:
    """``uuid, seq, tier``: 0 and 1 below and above the widest gap between neighbouring slopes of a building (of equal gaps the steepest), all 0 where it is under ``least``. Neighbours stand in one window for each building."""
    by = Window.partitionBy("uuid").orderBy("incl", "seq")
    rows = planes.withColumns({"place": F.row_number().over(by), "gap": F.round(F.lead("incl").over(by) - F.col("incl"), 9)})
    cut = rows.where("gap is not null").groupBy("uuid").agg(F.max(F.struct("gap", "place")).alias("m"))
    return rows.join(cut, "uuid", "left").select("uuid", "seq", F.when((F.col("m.gap") >= least) & (F.col("place") > F.col("m.place")), 1).otherwise(0).alias("tier"))


def oblique_surfaces(pieces: DataFrame, side: float = SIDE) -> DataFrame:
    """One row for each source plane of a roof: pieces (``uuid, source_idx, seq, locator_id, plane, corners``) of one ``source_idx`` are one surface.

    ``uuid, seq`` (the source), ``azimuth, incl`` of the piece with the most corners (of those, the first), ``area`` of the union, ``n_pieces, low, high, locator_id``.
    """
    rows = pieces.where("source_idx is not null and size(corners) >= 3")
    area = shared_area(regions(rows, "uuid", "source_idx"), None, ["source_idx"], side=side).where("area > 1e-6")
    up = F.when(F.col("plane.b") < 0, -1.0).otherwise(1.0)
    size = F.sqrt(sum((F.col(f"plane.{k}") * F.col(f"plane.{k}") for k in "abc"), F.lit(0.0)))
    size = F.when(size > 0, size).otherwise(1.0)
    turn, slope = F.pmod(F.degrees(F.atan2(up * F.col("plane.a"), up * F.col("plane.c"))), F.lit(360.0)), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.abs(F.col("plane.b")) / size))))
    chosen = F.min_by(F.struct(turn.alias("azimuth"), slope.alias("incl"), F.col("locator_id")), F.struct(-F.size("corners"), F.col("seq")))
    made = rows.groupBy("uuid", "source_idx").agg(chosen.alias("m"), F.count("*").alias("n_pieces"), F.min(G.low(F.col("corners"))).alias("low"), F.max(G.high(F.col("corners"))).alias("high"))
    return made.join(area, ["uuid", "source_idx"]).select("uuid", F.col("source_idx").alias("seq"), "m.azimuth", "m.incl", "area", "n_pieces", "low", "high", "m.locator_id")


def _marked(planes: DataFrame) -> DataFrame:
    """Planes with ``n`` and ``apex`` (planes of the building and the middle one of their tops), ``largest`` (``seq``), and whether each has a ``partner``, one ``in_tier``, and is ``crossing``: as ``opposing_pairs``,
    ``pitch_tiers`` and ``crossing_pairs`` say, in one pass.

    Planes meet once, within the widest limits; all else are windows over a building, so rows are dealt by building once and not joined back.
    """
    whole = Window.partitionBy("uuid")
    slopes, tops = whole.orderBy("incl", "seq"), whole.orderBy("high", "seq")
    rows = planes.where("uuid is not null").withColumns({"place": F.row_number().over(slopes), "gap": F.round(F.lead("incl").over(slopes) - F.col("incl"), 9)})
    rows = rows.withColumns({"cut": F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", "place", "incl", "seq"))).over(whole), "top": F.row_number().over(tops), "n": F.count("*").over(whole)})
    rows = rows.withColumns({"apex": F.max(F.when(F.expr("top = n div 2 + 1"), F.col("high"))).over(whole), "largest": F.min_by("seq", F.struct(-F.round("area", 9), F.col("seq"))).over(whole)})
    rows = rows.withColumns({"cut_incl": F.when(F.col("cut.gap") >= TIER_GAP, F.col("cut.incl")), "cut_seq": F.when(F.col("cut.gap") >= TIER_GAP, F.col("cut.seq"))}).drop("gap", "cut", "top")
    steep = lambda incl, seq: F.coalesce((F.col(incl) > F.col("cut_incl")) | ((F.col(incl) == F.col("cut_incl")) & (F.col(seq) > F.col("cut_seq"))), F.lit(False))
    others = planes.where("azimuth is not null and incl is not null").select("uuid", F.col("seq").alias("other"), F.col("azimuth").alias("turn"), F.col("incl").alias("slope"))
    width = max(PARTNER_AZIMUTH, CLASS_AZIMUTH)
    off = F.round(F.abs(F.abs(F.pmod(F.col("azimuth") - F.col("turn") + 180.0, F.lit(360.0)) - 180.0) - 180.0), 9)
    apart = F.round(F.abs(F.col("incl") - F.col("slope")), 9)
    near = (F.col("seq") != F.col("other")) & (off <= width) & (apart <= max(PARTNER_SLOPE, CLASS_SLOPE))
    met = []
    for many, (own, with_) in by_crowd(rows, others):
        if many:  # in sectors of the circle, as in ``opposing_pairs``
            own, with_ = own.withColumn("sector", _sector(F.col("azimuth"), width)), with_.withColumn("sector2", F.explode(F.array_distinct(F.array(*[_sector(F.col("turn") + 180.0, width, i) for i in (-1, 0, 1)]))))
        with_ = with_.withColumnRenamed("uuid", "building")
        same = F.col("uuid") == F.col("building")
        met.append(own.join(with_, same & near & (F.col("sector") == F.col("sector2")) if many else same & near, "left").drop("building", "sector", "sector2"))
    both = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    paired, classed = (off <= PARTNER_AZIMUTH) & (apart <= PARTNER_SLOPE), (off <= CLASS_AZIMUTH) & (apart <= CLASS_SLOPE)
    axis = F.round(F.pmod(F.when(F.col("seq") < F.col("other"), F.col("azimuth")).otherwise(F.col("turn")), F.lit(180.0)), 9)  # that of the pair's first plane
    both = both.withColumns({"partner": paired, "in_tier": paired & (steep("incl", "seq") == steep("slope", "other")), "axis": F.when(classed, F.round(axis * 1e9).cast("long"))})
    # axes are under 180 degrees apart, so those across an axis are further up or down it by a right angle, give or take; in whole billionths of a degree
    ends = [int(round((90.0 + sign * CLASS_AZIMUTH) * 1e9)) for sign in (-1, 1)]
    line = whole.orderBy("axis")
    across = (F.count("axis").over(line.rangeBetween(*ends)) > 0) | (F.count("axis").over(line.rangeBetween(-ends[1], -ends[0])) > 0)
    both = both.withColumn("crossing", F.col("axis").isNotNull() & across)
    kept = [c for c in both.columns if c not in ("uuid", "place", "other", "turn", "slope", "axis", "cut_incl", "cut_seq", "partner", "in_tier", "crossing")]
    return both.groupBy("uuid", "place").agg(*[F.first(c).alias(c) for c in kept], *[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("partner", "in_tier", "crossing")])


def _sector(azimuth: Column, width: float, more: int = 0) -> Column:
    """Which of equal sectors of at least ``width`` degrees holds a direction, and ``more`` sectors on."""
    n = max(1, int(360.0 / max(width, 1.0)))
    return F.pmod(F.floor(F.pmod(azimuth, F.lit(360.0)) / (360.0 / n)) + more, F.lit(n)).cast("int")


def oblique_priors(planes: DataFrame, roofs: DataFrame) -> DataFrame:
    """Planes (``uuid, seq, azimuth, incl, area, high``) with ``keep_a`` and ``keep_b``: what the type of their roof (``uuid, roof_type``) lets stand.

    ``keep_a`` asks planes of gables for an opposing one. ``keep_b`` asks for what the type needs: gables an opposing plane, hips and cross gables two pairs across each other (or an opposing plane and over 1 m2), mansards an
    opposing plane of their tier, pyramids a top near the middle one, sheds the largest plane only, complex roofs an opposing plane or 4 m2; none and flat let nothing stand, other types everything. A building with fewer
    planes than its type needs, or of which nothing would be left, keeps all.
    """
    planes = planes if hasattr(planes, "written_at") else written(planes, "planes")  # read many times below
    kind = F.lower(F.coalesce("roof_type", F.lit("")))
    rows = _marked(planes).join(roofs.select("uuid", kind.alias("roof_type")), "uuid", "left").fillna("", ["roof_type"])
    t = F.col("roof_type")
    stays = F.when(t.isin("none", "flat"), F.lit(False)).when(t == "shed", F.col("seq") == F.col("largest")).when(t == "gable", F.col("partner")).when(t.isin("hip", "cross_gable"), F.col("crossing") | (F.col("partner") & (F.col("area") > 1.0)))
    stays = stays.when(t == "mansard", F.col("in_tier")).when(t == "pyramid", (F.col("n") >= 3) & (F.round(F.abs(F.col("high") - F.col("apex")), 9) <= APEX * 4)).when(t == "complex", F.col("partner") | (F.col("area") >= 4.0)).otherwise(F.lit(True))
    needed = reduce(lambda w, kv: w.when(t == kv[0], kv[1]), list(NEEDED.items())[1:], F.when(t == "gable", NEEDED["gable"])).otherwise(0)
    rows = rows.withColumns({"keep_a": (t != "gable") | (F.col("n") < 2) | F.col("partner"), "keep_b": (F.col("n") < needed) | stays})
    rows = rows.withColumns({f"any_{f}": F.max(f"keep_{f}").over(Window.partitionBy("uuid")) for f in "ab"})
    rows = rows.withColumns({"keep_a": F.col("keep_a") | ~F.col("any_a"), "keep_b": F.col("keep_b") | (~F.col("any_b") & ~t.isin("none", "flat"))})
    return rows.select(*planes.columns, "roof_type", "keep_a", "keep_b")


def prior_summary(kept: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per filter and roof type (``unknown`` where it is empty) buildings, planes, kept and dropped; how many buildings lose how many planes; and the ``top`` buildings by planes that the second filter drops."""
    both = [kept.select("uuid", "roof_type", F.lit(f).alias("filter"), F.col(f"keep_{f}").alias("keep")) for f in "ab"]
    per = both[0].unionByName(both[1]).groupBy("filter", "uuid", F.when(F.col("roof_type") == "", "unknown").otherwise(F.col("roof_type")).alias("roof_type")).agg(F.count("*").alias("planes"), F.count_if("keep").alias("kept"))
    per = per.withColumn("dropped", F.col("planes") - F.col("kept"))
    by_type = per.groupBy("filter", "roof_type").agg(F.count("*").alias("buildings"), *[F.sum(c).alias(c) for c in ("planes", "kept", "dropped")])
    most = per.where("filter = 'b' and dropped > 0").orderBy(F.desc("dropped"), F.desc("uuid"), F.desc("roof_type")).limit(top).select("uuid", "roof_type", "dropped")
    return by_type, per.groupBy("filter", "dropped").agg(F.count("*").alias("buildings")), most
