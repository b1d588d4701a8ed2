"""Reports that join several sources of a home or a building, compare cohorts, and prepare labels and features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import geometry as G
from ..sources.scratch import new_folder
from .spatial import story_bands
from .reviews import LIMITS, combined_severity

# fixed values: how a reconciliation says that it saw several sessions, and the order of severities
MULTI_SESSION = r"multi_session\s*\((\d+)\s*scan\s*sessions?\)"
SEVERITIES = ("RED", "ORANGE", "YELLOW", "GREEN")


def multi_session(flags: Column) -> Column:
    """The count in the first flag that names several sessions; 0 without one."""
    hit = F.get(F.filter(flags, lambda f: f.rlike(MULTI_SESSION)), F.lit(0))
    return F.coalesce(F.regexp_extract(hit, MULTI_SESSION, 1).try_cast("int"), F.lit(0))


def reasons(*said: Column, between: str = " ; ") -> Column:
    """The reasons that hold (the others are null), joined."""
    return F.concat_ws(between, *said)


def impacted_scans(local: DataFrame, *exports: DataFrame) -> DataFrame:
    """``local`` (``home_id, local, sessions, recon_class, recon_flags``) with per-home exports, severity and ``rank``.

    Where exports share a column the later one that has a value counts. Homes without a row in an export have zeros there.
    """
    rows = local
    for i, export in enumerate(exports):
        own = [c for c in export.columns if c != "home_id"]
        rows = rows.join(export.select("home_id", *[F.col(c).alias(f"__{i}_{c}") for c in own]), "home_id", "left")
        for c in own:
            before = [F.col(c)] if c in rows.columns else []
            rows = rows.withColumn(c, F.coalesce(F.col(f"__{i}_{c}"), *before, F.lit(0))).drop(f"__{i}_{c}")
    missing = [c for c in (*LIMITS, "ar_reinit") if c not in rows.columns]
    rows = combined_severity(rows.withColumns({c: F.lit(0) for c in missing}) if missing else rows)
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    falling = ("bursts_under_10s", "merge_errors", "scan_errors", "bursts_under_60s", "incomplete_scans", "ar_reinit", "sessions")
    # the ranks of a report: its rows are sorted once as a whole, by design
    order = [level, *[F.desc(F.coalesce(c, F.lit(0))) for c in falling], F.col("home_id")]
    return ranked(rows, order)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers all rows from 1 in an order: ranges are sorted apart and start after the counts of those before.

    The sorted rows are written once, to the shared folder, and both the counts and the rows are read from there: a second
    evaluation of the sort may cut its ranges elsewhere.
    """
    path = new_folder(rows.sparkSession, "ranked")
    rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    table = rows.sparkSession.read.parquet(path)
    first = table.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__low"))
    first = first.withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")  # a row for each partition
    return table.join(F.broadcast(first), "__part").withColumn(name, F.col("__at") - F.col("__low") + F.col("__before") + 1).drop("__part", "__at", "__low", "__before")


def pipeline_state(homes: DataFrame, files: DataFrame, results: DataFrame) -> DataFrame:
    """How far each home came: ``files`` has ``has_merged, has_recon`` for homes with output, ``results`` their reconciliations (class null: unreadable)."""
    rows = homes.join(files.withColumn("__out", F.lit(True)), "home_id", "left").join(results.withColumn("__read", F.lit(True)), "home_id", "left")
    state = F.when(F.col("__out").isNull(), "NO_OUTPUT").when(~F.coalesce("has_merged", F.lit(False)), "PIPELINE_BROKEN").when(~F.coalesce("has_recon", F.lit(False)), "RECON_BROKEN")
    state = state.when(F.col("__read").isNull(), "RECON_PARSE_ERR").when(F.coalesce("recon_class", F.lit("")) == "", "RECON_UNKNOWN").otherwise(F.concat(F.lit("RECON_"), "recon_class"))
    return rows.withColumn("pipeline_state", state).drop("__out", "__read")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value and their share of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).withColumn("share", F.col("n") / F.col("__all")).drop("__all")  # the right side is one row


def scan_health(outputs: DataFrame, broken: DataFrame, trouble: DataFrame) -> DataFrame:
    """Homes with output (``home_id, has_merged, flags, storeys``) that have an issue: counts, sessions beyond storeys, and a summary."""
    rows = outputs.join(broken, "home_id", "left").join(trouble, "home_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = rows.withColumns({c: zero(c) for c in ("broken_rooms", "merge_errors", "upload_failed", "storeys")})
    rows = rows.withColumns({"pipeline_broken": ~F.col("has_merged"), "multi_session": multi_session(F.col("flags")).cast("long")})
    rows = rows.withColumn("excess", F.when(F.col("storeys") > 0, F.greatest(F.lit(0).cast("long"), F.col("multi_session") - F.col("storeys"))).otherwise(F.col("multi_session")))
    rows = rows.where("broken_rooms > 0 or merge_errors > 0 or upload_failed > 0 or pipeline_broken or excess > 0")
    many = lambda c, one: F.concat(F.col(c).cast("string"), F.lit(f" {one}"), F.when(F.col(c) == 1, "").otherwise("s"))
    extra = F.concat(F.col("excess").cast("string"), F.lit(" extra ARKit session"), F.when(F.col("excess") == 1, "").otherwise("s"), F.lit(" ("), F.col("multi_session").cast("string"), F.lit(" for "), many("storeys", "user storey"), F.lit(")"))
    said = reasons(
        F.when(F.col("pipeline_broken"), "no merged.json"),
        F.when(F.col("broken_rooms") > 0, many("broken_rooms", "broken room")),
        F.when(F.col("merge_errors") > 0, F.concat(F.col("merge_errors").cast("string"), F.lit(" mergeRoomsError"))),
        F.when(F.col("upload_failed") > 0, F.concat(F.col("upload_failed").cast("string"), F.lit(" scanUploadFailed"))),
        F.when((F.col("excess") > 0) & (F.col("storeys") > 0), extra).when(F.col("excess") > 0, F.concat(F.col("multi_session").cast("string"), F.lit(" ARKit sessions"))),
        between=" · ",
    )
    return rows.select("home_id", "broken_rooms", "merge_errors", "upload_failed", "pipeline_broken", "multi_session", "storeys", "excess", said.alias("summary"))


def cohort_table(rows: DataFrame, cohort: str, metrics: list[str]) -> DataFrame:
    """Mean, median, least and largest of each metric for each cohort, one row for a metric and a cohort."""
    long = rows.select(cohort, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("m")).select(cohort, "m.*")
    return long.groupBy(cohort, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.percentile_approx("v", 0.5, 10_000).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))


def control_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of the key: the same ones on every run and every machine."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"))), key).limit(n)


def extreme_elements(rooms: DataFrame, width: float = 30.0, height: float = 10.0, far: float = 30.0) -> DataFrame:
    """Buildings (of ``uuid, x, y, z``) with a box wider or higher than allowed, or two positions over ``far`` apart along an axis."""
    box = rooms.groupBy("uuid").agg(F.count("*").alias("n_rooms"), *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in ("x", "y", "z")])
    return box.withColumns({"wide": F.greatest("span_x", "span_z") > width, "high": F.col("span_y") > height, "far": F.greatest("span_x", "span_y", "span_z") > far})


def split_provenance(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Adds ``parent_proposal_id`` and ``is_split_child``: named by ``splits`` (``parent_id, original_id, children``), or by a ``#`` in the id."""
    parents = splits.select(F.coalesce("parent_id", "original_id").alias("parent_proposal_id"), F.explode("children").alias("proposal_id")).where("parent_proposal_id is not null and proposal_id is not null").dropDuplicates(["proposal_id"])
    rows = labels.join(parents, "proposal_id", "left")
    return rows.withColumn("is_split_child", F.col("parent_proposal_id").isNotNull() | F.col("proposal_id").contains("#"))


def resolution_report(labels: DataFrame, lists: list[str]) -> DataFrame:
    """One row: totals, buildings, split children, rows where each list has entries, and counts by label and by kind as maps."""
    have = [F.count_if(F.coalesce(F.size(c) > 0, F.lit(False))).alias(f"have_{c}") for c in lists]
    total = labels.agg(F.count("*").alias("total"), F.count_distinct("building_uuid").alias("buildings"), F.count_if("is_split_child").alias("split_children"), *have)
    by = [labels.groupBy(c).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(c, F.lit("")), "count")))).alias(f"by_{c}")) for c in ("label", "kind")]
    return total.crossJoin(by[0]).crossJoin(by[1])  # one row each


def group_accept_fraction(labels: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Adds for each named set of keys the share of accepted labels among its rows. Shares are worked out by group and joined back, so a large group is not sorted."""
    for name, by in keys.items():
        share = labels.groupBy(*by).agg(F.avg((F.col("label") == "accepted").cast("double")).alias(name))
        same = reduce(lambda a, c: a & c, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])
        labels = labels.alias("l").join(share.alias("r"), same, "left").select("l.*", f"r.{name}")
    return labels


def dist_stats(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Per group: Gini of absolute values, skewness, kurtosis (3 for a normal one) and the circular autocorrelation of lag 1 in ``order``."""
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull()).withColumn("__v", v)
    turn = Window.partitionBy(group).orderBy(*order)
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.avg("__v").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.abs("__v"), *order))
    rows = rows.withColumn("__x", F.col("__v") - mean).withColumn("__i", place)
    rows = rows.withColumn("__next", F.coalesce(F.lead("__x").over(turn), F.first("__x").over(whole)))
    n, total, square = F.count("*"), F.sum(F.abs("__v")), F.sum(F.col("__x") * F.col("__x"))
    gini = F.when(F.max(F.abs("__v")) < 1e-9, 0.0).otherwise((2 * F.sum(F.col("__i") * F.abs("__v")) - (n + 1) * total) / (n * total))
    flat = F.stddev_pop("__v") <= 1e-9
    return rows.groupBy(group).agg(
        n.alias("n"), gini.alias("gini"), F.when(n >= 3, F.when(flat, 0.0).otherwise(F.skewness("__v"))).alias("skewness"), F.when(n >= 4, F.when(flat, 0.0).otherwise(F.kurtosis("__v") + 3)).alias("kurtosis"),
        F.when(square > 0, F.sum(F.col("__x") * F.col("__next")) / square).alias("autocorrelation"),
    )


def group_folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Adds ``fold``: all rows of one key in one fold, dealt by a hash."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def score_quality(features: DataFrame, key: str, model: dict[str, tuple[float, float, float]], intercept: float, top: int = 6) -> DataFrame:
    """``score, predicted_rating`` and the ``top`` contributions by size of a linear model ``{feature: (mean, std, weight)}``; null features are 0, a std of 0 is 1."""
    part = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - mean) / (std or 1.0) * weight for c, (mean, std, weight) in model.items()}
    raw = reduce(lambda a, b: a + b, part.values(), F.lit(float(intercept)))
    rating = F.greatest(F.lit(1.0), F.least(F.lit(5.0), raw))
    parts = F.array(*[F.struct((-F.abs(p)).alias("by"), F.lit(i).alias("i"), F.lit(c).alias("feature"), F.round(p, 4).alias("value")) for i, (c, p) in enumerate(part.items())])
    best = F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value")))
    return features.select(key, F.round((rating - 1) / 4, 4).alias("score"), F.round(rating, 3).alias("predicted_rating"), best.alias("components"))


def autonomy(scored: DataFrame, reject: float = 0.10, accept: float = 0.90) -> DataFrame:
    """Adds ``decision`` to rows with ``rule_fires, score``: reject where the rule fires or the score is low, accept where it is high, else review."""
    return scored.withColumn("decision", F.when(F.col("rule_fires") | (F.col("score") < reject), "reject").when(F.col("score") > accept, "accept").otherwise("review"))


def with_rating(rows: DataFrame, ratings: DataFrame, chosen: list[str]) -> DataFrame:
    """The rows of buildings that were rated as one of ``chosen``."""
    return rows.join(ratings.where(F.col("rating").isin(*chosen)).select("uuid"), "uuid", "left_semi")


def compare_to_expected(actual: DataFrame, expected: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """One row for each building and metric: both values, their difference and whether it is within the tolerance. A missing side never is."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name), F.lit(float(t)).alias("tolerance")) for m, t in tolerances.items()])).alias("m")).select(key, "m.*")
    both = long(actual, "actual").join(long(expected, "expected"), [key, "metric", "tolerance"], "full")
    return both.withColumn("difference", F.abs(F.col("actual") - F.col("expected"))).withColumn("ok", F.coalesce(F.col("difference") <= F.col("tolerance"), F.lit(False)))


def systematic_holdout(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Every k-th id in order, ``most`` at most, with k the count over ``most``; all if there are fewer."""
    if most <= 0:
        return rows.limit(0)
    ids = rows.select(key).distinct()
    count = ids.count()
    if count <= most:
        return ids
    return ranked(ids, [F.col(key)], "__n").where(F.pmod(F.col("__n") - 1, F.lit(count // most)) == 0).orderBy("__n").limit(most).select(key)


def signal_availability(roofs: DataFrame) -> DataFrame:
    """Per building: how many 30-degree directions (modulo 180) its sloped surfaces (``uuid, story, azimuth, area``) have, their count and the spread of story areas."""
    story = roofs.groupBy("uuid", "story").agg(F.sum("area").alias("area"), F.count("azimuth").alias("n"), F.collect_set(F.floor(F.pmod(F.col("azimuth"), F.lit(180.0)) / 30)).alias("bins"))  # 6 at most
    return story.groupBy("uuid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("bins")))).alias("directions"), F.sum("n").alias("n_sloped"), (F.max("area") - F.min("area")).alias("area_spread"))


def envelope_diff(surfaces: DataFrame, variants: tuple[str, str]) -> DataFrame:
    """Per source: the area in two variants, its change, and how many ids came and went."""
    a, b = variants
    ids = surfaces.groupBy("source", "locator_id").agg(*[F.sum(F.when(F.col("variant") == v, F.col("area"))).alias(n) for v, n in ((a, "was"), (b, "now"))])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return ids.groupBy("source").agg(zero("was").alias("area_before"), zero("now").alias("area_after"), (zero("now") - zero("was")).alias("delta"), F.count_if(F.col("was").isNull() & F.col("now").isNotNull()).alias("added"), F.count_if(F.col("now").isNull() & F.col("was").isNotNull()).alias("removed"))


def feature_coverage(wanted: DataFrame, emitted: DataFrame) -> DataFrame:
    """``feature, status`` of every name: both, missing (wanted only) or extra (emitted only)."""
    both = wanted.select("feature", F.lit(1).alias("w")).distinct().join(emitted.select("feature", F.lit(1).alias("e")).distinct(), "feature", "full")
    return both.select("feature", F.when(F.col("e").isNull(), "missing").when(F.col("w").isNull(), "extra").otherwise("both").alias("status"))


def class_summary(findings: DataFrame, buildings: DataFrame, classes: list[str]) -> DataFrame:
    """Per class, those without a finding too: buildings with one, their share of all, and findings."""
    every = findings.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counts = findings.groupBy("class").agg(F.count_distinct("uuid").alias("buildings"), F.count("*").alias("total"))
    all_ = buildings.agg(F.count_distinct("uuid").alias("__all"))
    rows = every.join(counts, "class", "left").crossJoin(F.broadcast(all_)).fillna(0, ["buildings", "total"])  # the right side is one row
    return rows.select("class", "buildings", (F.col("buildings") / F.col("__all")).alias("share"), "total")


def longest_chord(corners: Column) -> Column:
    """``dx, dz, length`` of the longest line between two corners, seen from above; of equal ones the first."""
    line = lambda p, q: F.struct((q["x"] - p["x"]).alias("dx"), (q["z"] - p["z"]).alias("dz"))
    size = lambda e: F.sqrt(e["dx"] * e["dx"] + e["dz"] * e["dz"])
    pairs = lambda c: F.flatten(F.transform(c, lambda p, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda q: line(p, q))))
    sized = lambda c: F.transform(pairs(c), lambda e: F.struct(e["dx"].alias("dx"), e["dz"].alias("dz"), size(e).alias("length")))
    longest = lambda s: F.aggregate(s, F.get(s, F.lit(0)), lambda a, e: F.when(e["length"] > a["length"], e).otherwise(a))

    def listed(points):
        lines = []
        for i, p in enumerate(points):
            for q in points[i + 1 :]:
                dx, dz = q["x"] - p["x"], q["z"] - p["z"]
                lines.append(F.struct(F.sqrt(dx * dx + dz * dz).alias("length"), F.lit(-len(lines)).alias("place"), dx.alias("dx"), dz.alias("dz")))
        best = F.when(lines[0]["length"].isNull(), lines[0]).otherwise(F.greatest(*lines)) if len(lines) > 1 else lines[0]
        return F.struct(best["dx"].alias("dx"), best["dz"].alias("dz"), best["length"].alias("length"))

    return G._few(corners, listed, (4, 2, 3), G.once(G.once(corners, sized), longest))


def principal_axis(walls: DataFrame, least: float = 0.2, tolerance: float = 12.0) -> DataFrame:
    """``uuid, axis, coverage``: the direction (modulo 90) of most wall length, in bins of 2 degrees that lend half to their neighbours, and the share of length within ``tolerance`` of it. Equal bins: the smaller.

    Walls are dealt to tasks by building once, and what follows are windows over a building.
    """
    rows = G.settled(walls.where("uuid is not null and size(corners) >= 2").select("uuid", longest_chord(F.col("corners")).alias("c")), "c").where(F.col("c.length") >= least)
    rows = rows.select("uuid", F.pmod(F.round(F.degrees(F.atan2("c.dz", "c.dx")), 9), F.lit(90.0)).alias("az"), "c.length").repartition("uuid")
    near = F.explode(F.array(*[F.struct(F.lit(o).alias("by"), F.lit(w).alias("w")) for o, w in ((0, 1.0), (1, 0.5), (-1, 0.5))]))
    bins = rows.select("uuid", "az", "length", near.alias("n")).withColumn("bin", F.pmod(F.bround(F.col("az") / 2, 0).cast("int") + F.col("n.by"), F.lit(45)))
    bins = bins.withColumn("weight", F.sum(F.col("length") * F.col("n.w")).over(Window.partitionBy("uuid", "bin")))
    bins = bins.withColumn("axis", F.min_by("bin", F.struct(-F.round("weight", 6), F.col("bin"))).over(Window.partitionBy("uuid")) * 2.0)
    away = K.circular_difference(F.col("az"), F.col("axis"), 90.0)
    return bins.where("n.by = 0").groupBy("uuid", "axis").agg((F.sum(F.when(away <= tolerance, F.col("length")).otherwise(0.0)) / F.sum("length")).alias("coverage"))


def irregular_footprint(walls: DataFrame, least: float = 0.70) -> DataFrame:
    """Buildings whose walls do not follow one axis."""
    return principal_axis(walls).where(F.col("coverage") < least).select("uuid", F.lit("roof_irregular_footprint").alias("rule"), F.round("coverage", 6).alias("evidence"))


def knee_wall_misplaced(surfaces: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Knee walls whose middle is further from the top of all stories' walls than allowed."""
    top = story_bands(surfaces).groupBy("uuid").agg(F.max("high").alias("top"))
    middle = (G.low(F.col("corners")) + G.high(F.col("corners"))) / 2
    rows = surfaces.where("category = 'knee_wall'").join(top, "uuid").withColumn("evidence", F.abs(middle - F.col("top")))
    return rows.where(F.col("evidence") > tolerance).select("uuid", "seq", "locator_id", F.lit("knee_wall_misplaced").alias("rule"), F.lit("med").alias("severity"), F.round("evidence", 6).alias("evidence"))


def story_ceiling_overcount(surfaces: DataFrame, rooms: DataFrame, few: int = 2, many: int = 5, ratio: float = 3.0) -> DataFrame:
    """Stories (of ``rooms``: ``uuid, story``) with too many ceiling pieces for their rooms; a piece belongs to the first story whose walls' height, and half a metre, holds its middle."""
    middle = (G.low(F.col("corners")) + G.high(F.col("corners"))) / 2
    pieces = surfaces.where("category = 'ceiling'").select("uuid", "seq", middle.alias("mid")).where("mid is not null")
    held = pieces.join(story_bands(surfaces), "uuid").where("mid between low - 0.5 and high + 0.5").groupBy("uuid", "seq").agg(F.min("story").alias("story"))
    ceilings = held.groupBy("uuid", "story").agg(F.count("*").alias("n_ceilings"))
    stories = rooms.where("story is not null").groupBy("uuid", "story").agg(F.count("*").alias("n_rooms"))
    top = stories.groupBy("uuid").agg(F.max("story").alias("top"))
    rows = stories.join(top, "uuid").join(ceilings, ["uuid", "story"], "left").fillna(0, ["n_ceilings"]).withColumn("ratio", F.col("n_ceilings") / F.col("n_rooms"))
    full, high = (F.col("n_rooms") <= few) & (F.col("n_ceilings") >= many), (F.col("story") != F.col("top")) & (F.col("ratio") > ratio)
    level = F.when(full & (F.col("ratio") >= 8), "high").when(full, "medium").when(F.col("ratio") > 5, "medium").otherwise("low")
    return rows.where(full | high).select("uuid", "story", F.lit("story_ceiling_overcount").alias("rule"), level.alias("severity"), F.when(full, "oversaturated").otherwise("high_ratio").alias("pattern"), "n_rooms", "n_ceilings")


def height_modes(rooms: DataFrame, gap: float = 0.10) -> DataFrame:
    """Modes of floor height in each story: heights in order, a new mode where the next one is ``gap`` or more higher."""
    story = Window.partitionBy("uuid", "story").orderBy("y")
    steps = rooms.groupBy("uuid", "story", "y").agg(F.count("*").alias("n")).withColumn("new", F.coalesce((F.round(F.col("y") - F.lag("y").over(story), 9) >= gap).cast("int"), F.lit(1)))
    return steps.withColumn("mode", F.sum("new").over(story)).groupBy("uuid", "story", "mode").agg(F.sum("n").alias("n_rooms"), F.min("y").alias("low"), F.max("y").alias("high"))
