"""Reports over groups: two groups side by side, rates by bin, classifier counts, confidence of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_numbers(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Count, mean, median and upper quartile of a number for each label; nulls take no part.

    The quartile stands at 0.75 (n + 1) from 1, between neighbours; up to four values give the largest. Values are
    counted first, so that only distinct ones are put in order.
    """
    counted = rows.where(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(label).alias("label"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    group = Window.partitionBy("label")
    upto = counted.withColumns({"upto": F.sum("m").over(group.orderBy("v")), "n": F.sum("m").over(group)})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col("v")))

    n = F.col("n")
    low = F.least(F.greatest(F.floor((n + 1) * 0.75), F.lit(1)), n - 1)
    out = upto.groupBy("label", "n").agg((F.sum(F.col("v") * F.col("m")) / F.first("n")).alias("mean"), at(F.floor((n + 1) / 2)).alias("m1"), at(F.floor((n + 2) / 2)).alias("m2"), at(low).alias("q1"), at(low + 1).alias("q2"), F.max("v").alias("top"))
    part = (n + 1) * 0.75 - F.least(F.greatest(F.floor((n + 1) * 0.75), F.lit(1)), n - 1)
    return out.select("label", "n", F.round("mean", 6).alias("mean"), ((F.col("m1") + F.col("m2")) / 2).alias("median"), F.when(n > 4, F.col("q1") + part * (F.col("q2") - F.col("q1"))).otherwise(F.col("top")).alias("p75"))


def compare_marks(rows: DataFrame, label: str, mark: str, of: object, against: object) -> DataFrame:
    """How often a mark is true under two labels, and the lift of the first over the second (0 where that is never)."""
    share = [F.avg(F.when(F.col(label) == v, F.col(mark).cast("double"))) for v in (of, against)]
    return rows.agg(share[0].alias("rate"), share[1].alias("rate_against")).withColumn("lift", F.when(F.col("rate_against") > 0, F.col("rate") / F.col("rate_against")).otherwise(0.0))


def event_context(events: DataFrame, event: str, around: int = 3, homes: int = 5) -> DataFrame:
    """The events before and after the first one of that name, in each of the first ``homes`` homes that have it."""
    rows = events.where("home_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("home_id").orderBy("ts", "seq")))
    first = rows.where(F.col("event") == event).groupBy("home_id").agg(F.min("place").alias("at")).orderBy("home_id").limit(homes)
    near = rows.join(F.broadcast(first), "home_id").withColumn("step", F.col("place") - F.col("at"))
    return near.where(F.abs("step") <= around).select("home_id", "step", "seq", "event")


def confidence_tier(homes: DataFrame) -> DataFrame:
    """Tier and reasons from ``severity, verdict, missing`` and the counts of what went wrong; null counts are 0."""
    broken, marks = F.coalesce("missing", F.lit(False)), [F.coalesce(F.col(c) == "RED", F.lit(False)) for c in ("severity", "verdict")]
    tier = F.when(broken | (marks[0] & marks[1]), "HIGH").when(marks[0] | marks[1], "MEDIUM").otherwise("LOW")

    def said(column: str, word: str) -> Column:
        return F.when(F.col(column) > 0, F.concat_ws(" ", F.col(column).cast("string"), F.lit(word)))

    reasons = F.concat_ws(
        " ; ", F.when(broken, "PIPELINE_BROKEN (no merged.json)"), said("merge_errors", "mergeRoomsError"), said("upload_failed", "scanUploadFailed"), said("n_broken", "broken-scan(s)"), said("n_errored", "errored-scan(s)")
    )
    return homes.withColumns({"tier": tier, "reasons": reasons})


def rates_by_bin(rows: DataFrame, hit: str, bins: dict[str, Column], least: int = 20) -> DataFrame:
    """Share of hits in each bin of each feature against the share overall, and features ranked by their spread.

    The spread is between the bins of at least ``least`` rows. Null bins are called ``null``.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(v.cast("string"), F.lit("null")).alias("bin")) for k, v in bins.items()])
    flat = rows.select(F.col(hit).cast("double").alias("hit"), F.explode(pairs).alias("p")).groupBy("p.feature", "p.bin").agg(F.count("*").alias("n"), F.avg("hit").alias("rate"), F.sum("hit").alias("s"))
    feature = Window.partitionBy("feature")
    overall = F.sum("s").over(feature) / F.sum("n").over(feature)
    large = F.when(F.col("n") >= least, F.col("rate"))
    spread = F.coalesce(F.max(large).over(feature) - F.min(large).over(feature), F.lit(0.0))
    out = flat.withColumns({"relative_risk": F.when(overall > 0, F.col("rate") / overall), "spread": spread})
    order = out.select("feature", "spread").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("spread", 9)), "feature")))
    return out.drop("s").join(F.broadcast(order.select("feature", "rank")), "feature")


def binary_metrics(rows: DataFrame, truth: str, score: str, *group: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision and recall by group; 0 where nothing is called or true."""
    yes, said = F.col(truth) == 1, F.col(score) >= threshold
    counts = {"tp": yes & said, "fp": ~yes & said, "fn": yes & ~said, "tn": ~yes & ~said}
    out = rows.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(*group).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, n = F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.withColumns({"accuracy": share(tp + F.col("tn"), n), "precision": share(tp, tp + F.col("fp")), "recall": share(tp, tp + F.col("fn"))})


def calibration_curve(rows: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of true rows in equal steps of the score from 0 to 1."""
    step = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(score).between(0, 1) & F.col(truth).isNotNull()).groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(truth), 6).alias("rate"))


def sweep_report(outcomes: DataFrame) -> DataFrame:
    """Rates of outcomes by setting, their score, and which setting is best (ties to the first by name).

    ``outcomes`` has ``setting`` and the marks ``complete, emitted, error, low_coverage``.
    """
    marks = ("complete", "emitted", "error", "low_coverage")
    rows = outcomes.groupBy("setting").agg(F.count("*").alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in marks])
    rows = rows.withColumn("score", 2 * F.col("complete") + F.col("emitted") - 2 * F.col("error") - F.col("low_coverage"))
    best = rows.orderBy(F.desc(F.round("score", 9)), "setting").limit(1).select("setting", F.lit(True).alias("best"))
    return rows.join(F.broadcast(best), "setting", "left").withColumn("best", F.coalesce("best", F.lit(False)))
