"""Event-log operators: attempts, labels, verdicts, sessions, rooms, gaps and bursts.

Input is an event log with ``seq, ts, event, home_id, lead_id, room_id, story_id, distinct_id``.
Order within a home is ``ts``, then ``seq`` (the order of the file). All operators
partition by ``home_id`` only, so one exchange serves those that are used together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names of events
STARTED, COMPLETED, CANCELLED, STOPPED = "roomScanStarted", "roomScanCompleted", "roomScanCancelled", "roomScanStopped"
REINIT, AR_OPENED = "initializingARStateOutOfTheBlue", "roomScanAROpened"
ERRORS = ("roomScanError", "mergeRoomsError", "scanUploadFailed", "roomScanRetryAfterError")
KNOWN = (STARTED, COMPLETED, CANCELLED, STOPPED, REINIT, AR_OPENED, *ERRORS, "roomScanRetakeRequested")

_ORDER = ["ts", "seq"]


def known_events(events: DataFrame, names: tuple[str, ...] = KNOWN) -> DataFrame:
    """Rows of known events that have a home."""
    return events.where(F.col("event").isin(*names) & F.col("home_id").isNotNull())


def _is(*names: str) -> Column:
    return F.col("event").isin(*names)


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def scan_attempts(events: DataFrame) -> DataFrame:
    """One row per start: closed by the first completion or cancellation before the next start, else open."""
    home = Window.partitionBy("home_id").orderBy(*_ORDER)
    rows = events.withColumn("attempt", F.sum(_is(STARTED).cast("int")).over(home)).where("attempt > 0")
    inside = Window.partitionBy("home_id", "attempt").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    closes = _is(COMPLETED, CANCELLED)
    rows = rows.withColumn("done", F.coalesce(F.max(closes.cast("int")).over(inside), F.lit(0))).where("done = 0")
    inner = ~_is(STARTED, COMPLETED, CANCELLED)
    first = lambda c: F.max(F.when(_is(STARTED), F.col(c)))
    return rows.groupBy("home_id", "attempt").agg(
        first("lead_id").alias("lead_id"), first("room_id").alias("room_id"), first("story_id").alias("story_id"), first("distinct_id").alias("surveyor"), first("ts").alias("started_at"),
        F.max(F.when(closes, F.col("event"))).alias("closed_by"),
        F.count_if(_is(REINIT)).alias("ar_reinits"), F.count_if(_is(AR_OPENED)).alias("ar_opens"), F.count_if(_is(STOPPED)).alias("stops"), F.count_if(_is(*ERRORS)).alias("errors"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inner, F.struct("ts", "seq", "event")))), lambda x: x["event"]), ",").alias("inner_events"),
    ).withColumn("label", attempt_label())


def attempt_label() -> Column:
    return F.when(F.col("closed_by").isNull(), "BROKEN").when(F.col("closed_by") == CANCELLED, "CANCELLED").when(F.col("errors") > 0, "ERRORED").when(F.col("ar_reinits") > 0, "RECOVERED").otherwise("CLEAN")


def home_verdict(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """RED, ORANGE or GREEN per home with an event, and why."""
    label = lambda x: F.count_if(F.col("label") == x)
    counts = attempts.groupBy("home_id").agg(*[label(x).alias(f"n_{x.lower()}") for x in ("CLEAN", "RECOVERED", "ERRORED", "BROKEN", "CANCELLED")])
    facts = events.groupBy("home_id").agg(
        F.count_if(_is("mergeRoomsError")).alias("merge_errors"), F.count_if(_is("scanUploadFailed")).alias("upload_failed"),
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count_distinct("distinct_id").alias("n_surveyors"), F.min_by("lead_id", F.struct("ts", "seq")).alias("lead_id"),
    )
    rows = facts.join(counts, "home_id", "left").na.fill(0, ["n_clean", "n_recovered", "n_errored", "n_broken", "n_cancelled"])
    total = F.col("n_clean") + F.col("n_recovered") + F.col("n_errored") + F.col("n_broken") + F.col("n_cancelled")
    say = lambda c, text: F.when(F.col(c) >= 1, F.concat(F.col(c).cast("string"), F.lit(f" {text}")))
    red = F.concat_ws(" ; ", say("n_broken", "broken-scan(s)"), say("n_errored", "errored-scan(s)"), say("merge_errors", "mergeRoomsError"), say("upload_failed", "scanUploadFailed"))
    orange = (
        F.when(F.col("n_recovered") >= 3, F.concat(F.col("n_recovered").cast("string"), F.lit(" recovered-scan(s) (sustained reinit pattern)")))
        .when((F.col("n_recovered") >= 1) & (total >= 3), F.concat(F.col("n_recovered").cast("string"), F.lit(" recovered-scan(s)")))
        .when(F.col("n_cancelled") >= 3, F.concat(F.col("n_cancelled").cast("string"), F.lit(" cancellation(s)")))
    )
    rows = rows.withColumns({"n_scans": total, "red": red, "orange": orange})
    verdict = F.when(F.col("red") != "", "RED").when(F.col("orange").isNotNull(), "ORANGE").otherwise("GREEN")
    return rows.withColumns({"verdict": verdict, "reasons": F.when(F.col("red") != "", F.col("red")).otherwise(F.coalesce("orange", F.lit("")))}).drop("red", "orange")


def verdict_vs_outcome(verdicts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Share of each outcome class per verdict, in percent; no outcome is MISSING."""
    both = verdicts.join(outcomes, "home_id", "left").withColumn("recon_class", F.coalesce("recon_class", F.lit("MISSING")))
    counts = both.groupBy("verdict", "recon_class").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("verdict")))


def sessionize(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Adds ``session`` (from 1): a new one where the gap is longer than ``gap_seconds``."""
    home = Window.partitionBy("home_id").orderBy(*_ORDER)
    gap = _micros(F.col("ts")) - _micros(F.lag("ts").over(home))
    rows = events.withColumn("new", (gap.isNull() | (gap > gap_seconds * 1_000_000)).cast("int"))
    return rows.withColumn("session", F.sum("new").over(home)).drop("new")


def room_outcomes(events: DataFrame) -> DataFrame:
    """Per home and room with a start: whether it was ever completed, and counts."""
    return events.groupBy("home_id", "room_id").agg(
        F.min(F.when(_is(STARTED), F.col("ts"))).alias("first_start"), F.max(F.when(_is(COMPLETED), F.col("ts"))).alias("last_completed"),
        F.count_if(_is(STARTED)).alias("n_starts"), F.count_if(_is(COMPLETED)).alias("n_completes"), F.count_if(_is(*ERRORS)).alias("n_errors"),
    ).where("first_start is not null").withColumn("outcome", F.when(F.col("n_completes") > 0, "COMPLETED").otherwise("BROKEN_ROOM"))


def surveyor_rates(attempts: DataFrame, min_total: int = 10, top: int = 15) -> DataFrame:
    """The ``top`` surveyors by attempts (the limit comes before the minimum) and their broken share."""
    rows = attempts.groupBy("surveyor").agg(F.count("*").alias("total"), F.count_if(F.col("label") == "BROKEN").alias("broken"))
    return rows.orderBy(F.desc("total"), "surveyor").limit(top).where(F.col("total") >= min_total).withColumn("rate", F.col("broken") / F.col("total"))


def completion_by_home(events: DataFrame) -> DataFrame:
    n = lambda *x: F.count_if(_is(*x))
    rows = events.groupBy("home_id").agg(n(STARTED).alias("scans_started"), n(STOPPED).alias("scans_stopped"), n(COMPLETED).alias("scans_completed"), n(AR_OPENED).alias("ar_opens"))
    return rows.withColumns({"incomplete_scans": F.col("scans_started") - F.col("scans_completed"), "stopped_not_done": F.greatest(F.lit(0), F.col("scans_stopped") - F.col("scans_completed")), "ar_reopens": F.col("ar_opens") - F.col("scans_started")})


def gaps_by_home(events: DataFrame) -> DataFrame:
    home = Window.partitionBy("home_id").orderBy(*_ORDER)
    rows = events.withColumn("gap", (_micros(F.col("ts")) - _micros(F.lag("ts").over(home))) / 1e6)
    over = lambda s: F.count_if(F.col("gap") > s)
    return rows.groupBy("home_id").agg((F.max("gap") / 3600).alias("max_gap_hours"), over(600).alias("gaps_over_10min"), over(3600).alias("gaps_over_1hr"), over(86400).alias("gaps_over_1day"))


def bursts_by_home(events: DataFrame, failures: tuple[str, ...] = (REINIT, *ERRORS), limits: tuple[int, int, int] = (10, 60, 300)) -> DataFrame:
    """Consecutive failures that follow each other within each limit (seconds)."""
    home = Window.partitionBy("home_id").orderBy(*_ORDER)
    rows = events.where(_is(*failures)).withColumn("gap", (_micros(F.col("ts")) - _micros(F.lag("ts").over(home))) / 1e6)
    return rows.groupBy("home_id").agg(F.count("*").alias("total_failures"), *[F.count_if(F.col("gap") < s).alias(f"bursts_{i}") for i, s in enumerate(limits, 1)], F.min("gap").alias("min_gap_seconds"))


def break_cascade(rooms: DataFrame) -> DataFrame:
    """``rooms`` with ``home_id, session, outcome``: sessions with a break, breaks, and breaks that an earlier break precedes."""
    broken = rooms.where("outcome = 'BROKEN_ROOM'").groupBy("home_id", "session").agg(F.count("*").alias("n"))
    return broken.agg(F.count("*").alias("sessions_with_break"), F.coalesce(F.sum("n"), F.lit(0)).alias("breaks"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("after_a_break"))
