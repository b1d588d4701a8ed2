"""Reviews of scans: severity from several sources, the room context of a scan, label histories, and dismissed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import COMPLETED, ERRORS, REINIT, STARTED, room_outcomes, sessionize

# fixed values: from which count on a metric makes a home ORANGE, and RED, on its own (None: never)
LIMITS: dict[str, tuple[int | None, int | None]] = {
    "incomplete_scans": (2, 4),
    "stopped_not_done": (2, 4),
    "ar_reopens": (2, 5),
    "gaps_over_1day": (1, 2),
    "merge_errors": (None, 1),
    "scan_errors": (None, 1),
    "scan_retry_after_error": (None, 1),
    "upload_failed": (None, 1),
    "bursts_under_10s": (None, 1),
    "bursts_under_60s": (2, 4),
    "bursts_under_5min": (4, None),
}
REINIT_LIMIT = 6  # fixed value: re-initialisations that count; alone they make a home ORANGE


def _reached(limits: dict[str, tuple[int | None, int | None]], which: int) -> Column:
    """Whether any metric reaches its limit; absent metrics do not."""
    return F.coalesce(F.greatest(F.lit(False), *[F.col(c) >= limit[which] for c, limit in limits.items() if limit[which] is not None]), F.lit(False))


def combined_severity(metrics: DataFrame, limits: dict[str, tuple[int | None, int | None]] = LIMITS, reinits: int = REINIT_LIMIT) -> DataFrame:
    """Adds ``severity`` to rows with the metrics of ``limits``, ``ar_reinit, local, recon_class, recon_flags`` (text).

    A missing reconciliation and several capture sessions are RED; re-initialisations are RED only beside another sign.
    YELLOW comes from the local detector alone. Nulls count as nothing.
    """
    local, recon = F.coalesce("local", F.lit("")), F.coalesce("recon_class", F.lit(""))
    sessions = F.coalesce(F.col("recon_flags").contains("multi_session"), F.lit(False))
    orange, red = _reached(limits, 0), _reached(limits, 1)
    restarts = F.coalesce(F.col("ar_reinit") >= reinits, F.lit(False))
    missing = recon == "MISSING"
    beside = orange | red | sessions | missing | local.isin("RED", "ORANGE", "YELLOW")
    severity = F.when(missing | sessions | red | (local == "RED") | (restarts & beside), "RED").when((local == "ORANGE") | orange | restarts, "ORANGE").when(local == "YELLOW", "YELLOW").otherwise("GREEN")
    return metrics.withColumn("severity", severity)


def trouble_by_home(events: DataFrame, troubles: tuple[str, ...] = (REINIT, *ERRORS)) -> DataFrame:
    """Counts of each trouble event per home, and its distinct error texts in order, joined with `` | ``."""
    rows = events.where(F.col("event").isin(*troubles))
    return rows.groupBy("home_id").agg(*[F.count_if(F.col("event") == e).alias(f"n_{e}") for e in troubles], F.array_join(F.array_sort(F.collect_set("error_text")), " | ").alias("error_texts"))


def room_context(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """First start of each room of a home, with what the session and the home had seen before it.

    Session age counts from the session's first event of any kind. The last story that is not empty and the gap to the
    previous room run over the whole home; an empty story is no change.
    """
    rows = sessionize(events, gap_seconds)
    session, order = ["home_id", "session"], ["ts", "seq"]
    earlier = Window.partitionBy(*session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "session_began": F.min("ts").over(Window.partitionBy(*session)),
        "reinits_before": F.coalesce(F.sum((F.col("event") == REINIT).cast("int")).over(earlier), F.lit(0)),
    })
    nth = F.row_number().over(Window.partitionBy("home_id", "room_id").orderBy(*order))
    starts = rows.where(F.col("event") == STARTED).withColumn("nth", nth).where("nth = 1").drop("nth")
    known = room_outcomes(events).select("home_id", "room_id", "outcome", "first_start", "last_completed")
    both = starts.join(known, ["home_id", "room_id"])
    home = Window.partitionBy("home_id").orderBy(*order)
    before = home.rowsBetween(Window.unboundedPreceding, -1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    story = F.when(F.col("story_id") != "", F.col("story_id"))
    last_story = F.last(story, ignorenulls=True).over(before)
    both = both.withColumns({"previous_story": last_story, "previous_ts": F.lag("ts").over(home)})
    return both.select(
        "home_id", "room_id", "session", "outcome", F.row_number().over(Window.partitionBy(*session).orderBy(*order)).alias("position"),
        ((micros("ts") - micros("session_began")) / 6e7).alias("session_age_min"), "reinits_before",
        F.coalesce(F.sum((F.col("outcome") == "BROKEN_ROOM").cast("int")).over(earlier), F.lit(0)).alias("broken_before"),
        F.coalesce((F.col("story_id") != "") & (F.col("story_id") != F.col("previous_story")), F.lit(False)).alias("story_change"),
        ((micros("ts") - micros("previous_ts")) / 6e7).alias("gap_min"), ((micros("last_completed") - micros("first_start")) / 1e6).alias("seconds_to_complete"),
        F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"), F.count("*").over(Window.partitionBy(*session)).alias("rooms_in_session"),
    )


def label_spread(labels: DataFrame, *group: str) -> DataFrame:
    """Per group: labelled rows, share accepted, entropy (natural log) and disagreement (1 - share of the commonest label). Null labels do not count."""
    counts = labels.where("label is not null").groupBy(*group, "label").agg(F.count("*").alias("n"))
    rows = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*group)))
    return rows.groupBy(*group).agg(
        F.sum("n").alias("n_labels"), F.round(F.sum(F.when(F.col("label") == "accepted", F.col("p")).otherwise(0.0)), 9).alias("accepted"),
        (F.round(-F.sum(F.col("p") * F.ln("p")), 9) + 0.0).alias("entropy"), F.round(1 - F.max("p"), 9).alias("disagreement"),
    )


def flip_stability(log: DataFrame, *key: str) -> DataFrame:
    """1 - changes of label / pairs of neighbours in time order; 1 for fewer than two labels."""
    order = Window.partitionBy(*key).orderBy("ts", "seq")
    rows = log.where("label is not null").withColumn("flip", (F.col("label") != F.lag("label").over(order)).cast("int"))
    rows = rows.groupBy(*key).agg(F.count("*").alias("n"), F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"))
    return rows.withColumn("stability", 1.0 - F.col("flips") / F.greatest(F.col("n") - 1, F.lit(1)))


def labelled_around(log: DataFrame) -> DataFrame:
    """How many rows of the building were labelled before and after each."""
    building = Window.partitionBy("building_uuid")
    place = F.row_number().over(building.orderBy("ts", "seq"))
    return log.withColumns({"n_before": place - 1, "n_after": F.count("*").over(building) - place})


_FLAG = ["uuid", "locator", "rule"]


def suppress(flags: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Adds ``suppressed``: the flag's locator and rule were dismissed before. Flags without a rule or locator are kept."""
    keys = dismissals.select(*_FLAG).dropna().distinct().withColumn("suppressed", F.lit(True))
    return flags.join(keys, _FLAG, "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def merge_dismissals(dismissals: DataFrame, queue: DataFrame, at: Column) -> DataFrame:
    """Dismissals after those of ``queue`` (with ``seq, note``): new ones are added, old ones renewed at ``at`` and counted; the first note stays."""
    note = F.when(F.col("note") != "", F.col("note"))
    new = queue.dropna(subset=_FLAG).groupBy(*_FLAG).agg(F.count("*").alias("n"), F.min_by(note, F.when(note.isNotNull(), F.col("seq"))).alias("new_note"))
    both = dismissals.dropna(subset=_FLAG).join(new, _FLAG, "full_outer")
    return both.select(
        *_FLAG, F.coalesce("first_dismissed", at).alias("first_dismissed"), F.when(F.col("n").isNotNull(), at).otherwise(F.col("last_dismissed")).alias("last_dismissed"),
        (F.coalesce("dismiss_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("dismiss_count"), F.coalesce(note, "new_note").alias("note"),
    )


def persistent_offenders(dismissals: DataFrame, threshold: int = 3) -> DataFrame:
    return dismissals.where(F.col("dismiss_count") >= threshold)


def diff_runs(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct flags of two runs: ``fixed``, ``persisting`` or ``new``."""
    side = lambda rows, c: rows.select(*_FLAG).dropna().distinct().withColumn(c, F.lit(True))
    both = side(prior, "was").join(side(new, "is"), _FLAG, "full_outer")
    return both.select(*_FLAG, F.when(F.col("is").isNull(), "fixed").when(F.col("was").isNull(), "new").otherwise("persisting").alias("state"))
