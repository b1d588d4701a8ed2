"""Queries over the event log, bound to the ``events`` and ``customer`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from .registry import query

_NAMES = {"signup": E.STARTED, "purchase": E.COMPLETED, "click": E.REINIT, "error": "roomScanError", "view": E.AR_OPENED}


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a scan log."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    name = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _NAMES.items()])
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "ts", name.alias("event"), F.col("user_id").alias("home_id"), k.alias("k"), "value")
    return rows.select("seq", "ts", "event", "home_id", (F.col("k") % 10).alias("room_id"), F.when(F.col("k") % 3 == 0, "").otherwise((F.col("k") % 3).cast("string")).alias("story_id"), (F.col("home_id") % 20).alias("distinct_id"), (F.col("home_id") % 50).alias("lead_id"), "k", "value")


_LOG = r"""WITH ev AS (SELECT event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'roomScanStarted' WHEN 'purchase' THEN 'roomScanCompleted' WHEN 'click' THEN 'initializingARStateOutOfTheBlue' WHEN 'error' THEN 'roomScanError' WHEN 'view' THEN 'roomScanAROpened' END AS event,
 user_id AS home_id, k % 10 AS room_id, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 3 AS VARCHAR) END AS story_id, user_id % 20 AS distinct_id, user_id % 50 AS lead_id, k, value FROM (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events))"""
_ATTEMPTS = _LOG + """, a0 AS (SELECT *, sum(CASE WHEN event = 'roomScanStarted' THEN 1 ELSE 0 END) OVER (PARTITION BY home_id ORDER BY ts, seq) AS attempt FROM ev),
a1 AS (SELECT *, coalesce(max(CASE WHEN event = 'roomScanCompleted' THEN 1 ELSE 0 END) OVER (PARTITION BY home_id, attempt ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a0 WHERE attempt > 0),
att AS (SELECT home_id, CAST(attempt AS BIGINT) AS attempt, max(CASE WHEN event = 'roomScanStarted' THEN lead_id END) AS lead_id, max(CASE WHEN event = 'roomScanStarted' THEN room_id END) AS room_id, max(CASE WHEN event = 'roomScanStarted' THEN story_id END) AS story_id,
 max(CASE WHEN event = 'roomScanStarted' THEN distinct_id END) AS surveyor, max(CASE WHEN event = 'roomScanStarted' THEN ts END) AS started_at, max(CASE WHEN event = 'roomScanCompleted' THEN event END) AS closed_by,
 count(*) FILTER (event = 'initializingARStateOutOfTheBlue') AS ar_reinits, count(*) FILTER (event = 'roomScanAROpened') AS ar_opens, count(*) FILTER (event = 'roomScanStopped') AS stops, count(*) FILTER (event = 'roomScanError') AS errors,
 coalesce(string_agg(event, ',' ORDER BY ts, seq) FILTER (event NOT IN ('roomScanStarted', 'roomScanCompleted')), '') AS inner_events FROM a1 WHERE done = 0 GROUP BY home_id, attempt),
lab AS (SELECT *, CASE WHEN closed_by IS NULL THEN 'BROKEN' WHEN errors > 0 THEN 'ERRORED' WHEN ar_reinits > 0 THEN 'RECOVERED' ELSE 'CLEAN' END AS label FROM att)"""
_VERDICT = _ATTEMPTS + """, c AS (SELECT home_id, count(*) FILTER (label = 'CLEAN') AS n_clean, count(*) FILTER (label = 'RECOVERED') AS n_recovered, count(*) FILTER (label = 'ERRORED') AS n_errored, count(*) FILTER (label = 'BROKEN') AS n_broken FROM lab GROUP BY home_id),
f AS (SELECT home_id, min(ts) AS first_event, max(ts) AS last_event, count(DISTINCT distinct_id) AS n_surveyors, arg_min(lead_id, (ts, seq)) AS lead_id FROM ev GROUP BY home_id),
v AS (SELECT f.*, coalesce(n_clean, 0) AS n_clean, coalesce(n_recovered, 0) AS n_recovered, coalesce(n_errored, 0) AS n_errored, coalesce(n_broken, 0) AS n_broken FROM f LEFT JOIN c USING (home_id)),
w AS (SELECT *, CASE WHEN n_broken > 0 OR n_errored > 0 THEN 'RED' WHEN n_recovered >= 3 OR (n_recovered >= 1 AND n_clean + n_recovered >= 3) THEN 'ORANGE' ELSE 'GREEN' END AS verdict FROM v)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.scan_attempts(log(spark, sf_dir))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return E.home_verdict(rows, E.scan_attempts(rows))


@query("a1_known_events", _LOG + " SELECT seq, ts, event, home_id FROM ev WHERE event IS NOT NULL AND home_id IS NOT NULL")
def a1(spark, sf_dir):
    return E.known_events(log(spark, sf_dir)).select("seq", "ts", "event", "home_id")


@query("e1_scan_attempts", _ATTEMPTS + " SELECT home_id, attempt, lead_id, room_id, story_id, surveyor, started_at, closed_by, ar_reinits, ar_opens, stops, errors, inner_events FROM att")
def e1(spark, sf_dir):
    return _attempts(spark, sf_dir).drop("label")


@query("e2_attempt_labels", _ATTEMPTS + " SELECT home_id, attempt, label FROM lab")
def e2(spark, sf_dir):
    return _attempts(spark, sf_dir).select("home_id", "attempt", "label")


@query("e3_home_verdict", _VERDICT + """ SELECT home_id, verdict, CASE WHEN verdict = 'RED' THEN concat_ws(' ; ', CASE WHEN n_broken > 0 THEN n_broken || ' broken-scan(s)' END, CASE WHEN n_errored > 0 THEN n_errored || ' errored-scan(s)' END)
 WHEN n_recovered >= 3 THEN n_recovered || ' recovered-scan(s) (sustained reinit pattern)' WHEN verdict = 'ORANGE' THEN n_recovered || ' recovered-scan(s)' ELSE '' END AS reasons FROM w""")
def e3(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("home_id", "verdict", "reasons")


@query("e4_home_summary", _VERDICT + " SELECT home_id, lead_id, verdict, n_clean, n_recovered, n_errored, n_broken, first_event, last_event, n_surveyors FROM w")
def e4(spark, sf_dir):
    rank = F.when(F.col("verdict") == "RED", 0).when(F.col("verdict") == "ORANGE", 1).otherwise(2)
    rows = _verdicts(spark, sf_dir).orderBy(rank, F.desc("n_broken"), F.desc("merge_errors"), F.desc("n_errored"), F.desc("n_recovered"), "home_id")
    return rows.select("home_id", "lead_id", "verdict", "n_clean", "n_recovered", "n_errored", "n_broken", "first_event", "last_event", "n_surveyors")


@query("e5_verdict_vs_outcome", _VERDICT + """, o AS (SELECT c_custkey AS home_id, CASE WHEN c_acctbal < 0 THEN 'RED' WHEN c_acctbal < 3000 THEN 'YELLOW' WHEN c_acctbal < 9000 THEN 'GREEN' END AS recon_class FROM customer),
n AS (SELECT verdict, coalesce(recon_class, 'MISSING') AS recon_class, count(*) AS n FROM w LEFT JOIN o USING (home_id) GROUP BY ALL) SELECT verdict, recon_class, n, 100.0 * n / sum(n) OVER (PARTITION BY verdict) AS percent FROM n""")
def e5(spark, sf_dir):
    b = F.col("c_acctbal")
    outcomes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("home_id"), F.when(b < 0, "RED").when(b < 3000, "YELLOW").when(b < 9000, "GREEN").alias("recon_class"))
    return E.verdict_vs_outcome(_verdicts(spark, sf_dir), outcomes)


_SESSIONS = _LOG + ", g AS (SELECT *, CASE WHEN lag(ts) OVER h IS NULL OR ts - lag(ts) OVER h > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM ev WINDOW h AS (PARTITION BY home_id ORDER BY ts, seq)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY home_id ORDER BY ts, seq) AS BIGINT) AS session FROM g)"


@query("e6_sessions", _SESSIONS + " SELECT seq, home_id, session FROM s")
def e6(spark, sf_dir):
    return E.sessionize(log(spark, sf_dir), 12 * 3600).select("seq", "home_id", "session")


_ROOMS = "SELECT home_id, room_id{more}, min(ts) FILTER (event = 'roomScanStarted') AS first_start, max(ts) FILTER (event = 'roomScanCompleted') AS last_completed, count(*) FILTER (event = 'roomScanStarted') AS n_starts, count(*) FILTER (event = 'roomScanCompleted') AS n_completes, count(*) FILTER (event = 'roomScanError') AS n_errors, CASE WHEN count(*) FILTER (event = 'roomScanCompleted') > 0 THEN 'COMPLETED' ELSE 'BROKEN_ROOM' END AS outcome FROM {table} GROUP BY ALL HAVING count(*) FILTER (event = 'roomScanStarted') > 0"


@query("e7_room_outcomes", f"{_LOG} {_ROOMS.format(more='', table='ev')}")
def e7(spark, sf_dir):
    return E.room_outcomes(log(spark, sf_dir))


@query("e10_surveyor_rates", _ATTEMPTS + ", r AS (SELECT surveyor, count(*) AS total, count(*) FILTER (label = 'BROKEN') AS broken FROM lab GROUP BY surveyor ORDER BY total DESC, surveyor LIMIT 15) SELECT surveyor, total, broken, broken / total AS rate FROM r WHERE total >= 10")
def e10(spark, sf_dir):
    return E.surveyor_rates(_attempts(spark, sf_dir))


@query("e11_break_cascade", _SESSIONS + ", st AS (SELECT home_id, room_id, arg_min(session, (ts, seq)) AS session FROM s WHERE event = 'roomScanStarted' GROUP BY ALL), ro AS (" + _ROOMS.format(more="", table="ev") + "), b AS (SELECT home_id, session, count(*) AS n FROM ro JOIN st USING (home_id, room_id) WHERE outcome = 'BROKEN_ROOM' GROUP BY ALL) SELECT count(*) AS sessions_with_break, CAST(coalesce(sum(n), 0) AS BIGINT) AS breaks, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS after_a_break FROM b")
def e11(spark, sf_dir):
    rows = log(spark, sf_dir)
    first = E.sessionize(rows, 12 * 3600).where(F.col("event") == E.STARTED).groupBy("home_id", "room_id").agg(F.min_by("session", F.struct("ts", "seq")).alias("session"))
    return E.break_cascade(E.room_outcomes(rows).join(first, ["home_id", "room_id"]))


@query("e13_completion", _LOG + """, c AS (SELECT home_id, count(*) FILTER (event = 'roomScanStarted') AS scans_started, count(*) FILTER (event = 'roomScanStopped') AS scans_stopped, count(*) FILTER (event = 'roomScanCompleted') AS scans_completed, count(*) FILTER (event = 'roomScanAROpened') AS ar_opens FROM ev GROUP BY home_id)
SELECT *, scans_started - scans_completed AS incomplete_scans, greatest(0, scans_stopped - scans_completed) AS stopped_not_done, ar_opens - scans_started AS ar_reopens FROM c""")
def e13(spark, sf_dir):
    return E.completion_by_home(log(spark, sf_dir))


_GAP = "(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY home_id ORDER BY ts, seq))) / 1e6 AS gap"


@query("e14_gaps", _LOG + f", g AS (SELECT home_id, {_GAP} FROM ev) SELECT home_id, max(gap) / 3600 AS max_gap_hours, count(*) FILTER (gap > 600) AS gaps_over_10min, count(*) FILTER (gap > 3600) AS gaps_over_1hr, count(*) FILTER (gap > 86400) AS gaps_over_1day FROM g GROUP BY home_id")
def e14(spark, sf_dir):
    return E.gaps_by_home(log(spark, sf_dir))


@query("e16_bursts", _LOG + f", g AS (SELECT home_id, {_GAP} FROM ev WHERE event IN ('initializingARStateOutOfTheBlue', 'roomScanError')) SELECT home_id, count(*) AS total_failures, count(*) FILTER (gap < 3600) AS bursts_1, count(*) FILTER (gap < 10800) AS bursts_2, count(*) FILTER (gap < 21600) AS bursts_3, min(gap) AS min_gap_seconds FROM g GROUP BY home_id")
def e16(spark, sf_dir):
    return E.bursts_by_home(log(spark, sf_dir), limits=(3600, 10800, 21600))


@query("l1_latest_labels", _LOG + ", d AS (SELECT *, CASE WHEN event IN ('roomScanStarted', 'roomScanCompleted') THEN 'accepted' WHEN event = 'roomScanAROpened' THEN 'skipped' ELSE 'rejected' END AS label, row_number() OVER (PARTITION BY home_id, k ORDER BY ts DESC, seq DESC) AS rn FROM ev) SELECT home_id AS building_uuid, k AS proposal_id, label, ts FROM d WHERE rn = 1 AND label <> 'skipped'")
def l1(spark, sf_dir):
    label = F.when(F.col("event").isin(E.STARTED, E.COMPLETED), "accepted").when(F.col("event") == E.AR_OPENED, "skipped").otherwise("rejected")
    last = log(spark, sf_dir).withColumn("label", label).where("home_id is not null and k is not null").groupBy("home_id", "k").agg(F.max_by(F.struct("label", "ts"), F.struct("ts", "seq")).alias("last"))
    return last.where("last.label != 'skipped'").select(F.col("home_id").alias("building_uuid"), F.col("k").alias("proposal_id"), "last.label", "last.ts")


@query("f20_holdout", "SELECT c_custkey, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 2) < '33' AS holdout FROM customer")
def f20(spark, sf_dir):
    first = F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 2), 16, 10).cast("int")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (first / 255 < 0.2).alias("holdout"))


@query("l8_member_stats", "SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS low, max(value) AS high, max(value) - min(value) AS range_, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def l8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type")
    return rows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("range_"), F.percentile("value", 0.5).alias("median"))
