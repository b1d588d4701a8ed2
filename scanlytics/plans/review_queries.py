"""Queries over severities, room context, label histories and dismissed flags, bound to ``customer, events, lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reviews as R
from .event_queries import _LOG, _SESSIONS, log
from .registry import query

# how the metrics of a home follow from its customer key
_METRICS = {
    "incomplete_scans": "greatest(0, k % 12 - 8)", "stopped_not_done": "greatest(0, k % 14 - 11)", "ar_reopens": "k % 10 - 7", "gaps_over_1day": "CASE WHEN k % 9 = 0 THEN 1 WHEN k % 31 = 0 THEN 2 ELSE 0 END",
    "merge_errors": "CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END", "scan_errors": "CASE WHEN k % 41 = 0 THEN 2 ELSE 0 END", "scan_retry_after_error": "CASE WHEN k % 43 = 0 THEN 1 END", "upload_failed": "CASE WHEN k % 47 = 0 THEN 1 ELSE 0 END",
    "bursts_under_10s": "CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END", "bursts_under_60s": "greatest(0, k % 17 - 14)", "bursts_under_5min": "greatest(0, k % 19 - 14)", "ar_reinit": "k % 8",
    "local": "CASE n WHEN 0 THEN 'RED' WHEN 1 THEN 'ORANGE' WHEN 2 THEN 'YELLOW' WHEN 3 THEN 'YELLOW' ELSE 'GREEN' END", "recon_class": "CASE WHEN k % 59 = 0 THEN 'MISSING' WHEN b < 0 THEN 'RED' WHEN b < 3000 THEN 'YELLOW' WHEN b < 9000 THEN 'GREEN' END", "recon_flags": "CASE WHEN k % 61 = 0 THEN 'height ; multi_session (3)' END",
}
_E17 = "WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS b FROM customer), m AS (SELECT k AS home_id, " + ", ".join(f"{e} AS {c}" for c, e in _METRICS.items()) + " FROM c)" + """,
f AS (SELECT *, incomplete_scans >= 2 OR stopped_not_done >= 2 OR ar_reopens >= 2 OR gaps_over_1day >= 1 OR bursts_under_60s >= 2 OR bursts_under_5min >= 4 AS orange,
 incomplete_scans >= 4 OR stopped_not_done >= 4 OR ar_reopens >= 5 OR gaps_over_1day >= 2 OR merge_errors >= 1 OR scan_errors >= 1 OR coalesce(scan_retry_after_error, 0) >= 1 OR upload_failed >= 1 OR bursts_under_10s >= 1 OR bursts_under_60s >= 4 AS red,
 coalesce(recon_class, '') = 'MISSING' OR coalesce(recon_flags, '') LIKE '%multi_session%' AS broken FROM m)
SELECT home_id, CASE WHEN broken OR red OR local = 'RED' OR (ar_reinit >= 6 AND (orange OR local IN ('ORANGE', 'YELLOW'))) THEN 'RED' WHEN orange OR local = 'ORANGE' OR ar_reinit >= 6 THEN 'ORANGE' WHEN local = 'YELLOW' THEN 'YELLOW' ELSE 'GREEN' END AS severity FROM f"""


@query("e17_combined_severity", _E17)
def e17(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    return R.combined_severity(rows.select(F.col("k").alias("home_id"), *[F.expr(e).alias(c) for c, e in _METRICS.items()])).select("home_id", "severity")


@query("e15_trouble", _LOG + """ SELECT home_id, count(*) FILTER (event = 'initializingARStateOutOfTheBlue') AS n_reinits, count(*) FILTER (event = 'roomScanError') AS n_errors,
 coalesce(string_agg(DISTINCT t, ' | ' ORDER BY t), '') AS error_texts FROM (SELECT *, CASE WHEN event = 'roomScanError' THEN 'code ' || (k % 7) END AS t FROM ev) WHERE event IN ('initializingARStateOutOfTheBlue', 'roomScanError') GROUP BY home_id""")
def e15(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("error_text", F.when(F.col("event") == "roomScanError", F.concat(F.lit("code "), (F.col("k") % 7).cast("string"))))
    return R.trouble_by_home(rows).select("home_id", F.col(f"n_{R.REINIT}").alias("n_reinits"), F.col("n_roomScanError").alias("n_errors"), "error_texts")


_ONE = "(PARTITION BY home_id, session ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("e8_room_context", _SESSIONS + f""", x AS (SELECT *, min(ts) OVER (PARTITION BY home_id, session) AS began, coalesce(sum(CASE WHEN event = 'initializingARStateOutOfTheBlue' THEN 1 ELSE 0 END) OVER {_ONE}, 0) AS reinits_before,
 max(CASE WHEN event = 'roomScanCompleted' THEN ts END) OVER (PARTITION BY home_id, room_id) AS last_completed FROM s),
st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_id, room_id ORDER BY ts, seq) AS rn FROM x WHERE event = 'roomScanStarted') WHERE rn = 1),
w AS (SELECT *, CASE WHEN last_completed IS NULL THEN 'BROKEN_ROOM' ELSE 'COMPLETED' END AS outcome, last_value(CASE WHEN story_id <> '' THEN story_id END IGNORE NULLS) OVER (PARTITION BY home_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps, lag(ts) OVER (PARTITION BY home_id ORDER BY ts, seq) AS pt FROM st)
SELECT home_id, room_id, session, outcome, row_number() OVER (PARTITION BY home_id, session ORDER BY ts, seq) AS position, (epoch_us(ts) - epoch_us(began)) / 6e7 AS session_age_min, CAST(reinits_before AS BIGINT) AS reinits_before,
 CAST(coalesce(sum(CASE WHEN outcome = 'BROKEN_ROOM' THEN 1 ELSE 0 END) OVER {_ONE}, 0) AS BIGINT) AS broken_before, coalesce(story_id <> '' AND story_id <> ps, false) AS story_change, (epoch_us(ts) - epoch_us(pt)) / 6e7 AS gap_min,
 (epoch_us(last_completed) - epoch_us(ts)) / 1e6 AS seconds_to_complete, isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) OVER (PARTITION BY home_id, session) AS rooms_in_session FROM w""")
def e8(spark, sf_dir):
    return R.room_context(log(spark, sf_dir), 12 * 3600)


_LABELS = _LOG + ", d AS (SELECT home_id AS building_uuid, k AS proposal_id, CASE WHEN event IN ('roomScanStarted', 'roomScanCompleted') THEN 'accepted' WHEN event = 'roomScanAROpened' THEN 'skipped' ELSE 'rejected' END AS label, ts, seq, k % 12 AS cluster FROM ev)"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as decisions on proposals."""
    label = F.when(F.col("event").isin(R.STARTED, R.COMPLETED), "accepted").when(F.col("event") == "roomScanAROpened", "skipped").otherwise("rejected")
    return log(spark, sf_dir).select(F.col("home_id").alias("building_uuid"), F.col("k").alias("proposal_id"), label.alias("label"), "ts", "seq", (F.col("k") % 12).alias("cluster"))


@query("l5_label_spread", _LABELS + """, c AS (SELECT building_uuid, cluster, label, count(*) AS n FROM d GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY building_uuid, cluster) AS p FROM c)
SELECT building_uuid, cluster, CAST(sum(n) AS BIGINT) AS n_labels, round(sum(CASE WHEN label = 'accepted' THEN p ELSE 0 END), 9) AS accepted, round(-sum(p * ln(p)), 9) + 0.0 AS entropy, round(1 - max(p), 9) AS disagreement FROM p GROUP BY building_uuid, cluster""")
def l5(spark, sf_dir):
    return R.label_spread(labels(spark, sf_dir), "building_uuid", "cluster")


@query("l6_flip_stability", _LABELS + """, f AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY proposal_id ORDER BY ts, seq) THEN 1 ELSE 0 END AS flip FROM d)
SELECT proposal_id, count(*) AS n, CAST(sum(flip) AS BIGINT) AS flips, 1.0 - sum(flip) / greatest(count(*) - 1, 1) AS stability FROM f GROUP BY proposal_id""")
def l6(spark, sf_dir):
    return R.flip_stability(labels(spark, sf_dir), "proposal_id")


@query("l7_labelled_around", _LABELS + " SELECT building_uuid, seq, row_number() OVER w - 1 AS n_before, count(*) OVER (PARTITION BY building_uuid) - row_number() OVER w AS n_after FROM d WINDOW w AS (PARTITION BY building_uuid ORDER BY ts, seq)")
def l7(spark, sf_dir):
    return R.labelled_around(labels(spark, sf_dir)).select("building_uuid", "seq", "n_before", "n_after")


_FLAGS = """WITH f AS (SELECT l_orderkey AS uuid, l_linenumber AS locator, CASE WHEN l_partkey % 11 > 0 THEN 'rule ' || (l_partkey % 11) END AS rule, l_suppkey AS seq, l_returnflag AS run, CASE WHEN l_suppkey % 3 = 0 THEN 'note ' || l_suppkey ELSE '' END AS note FROM lineitem),
old AS (SELECT uuid, locator, rule, count(*) AS dismiss_count, min(note) AS note FROM f WHERE run <> 'R' AND seq % 2 = 0 AND rule IS NOT NULL GROUP BY ALL),
fresh AS (SELECT uuid, locator, rule, count(*) AS n, arg_min(note, seq) FILTER (note <> '') AS new_note FROM f WHERE run <> 'A' AND rule IS NOT NULL GROUP BY ALL),
merged AS (SELECT uuid, locator, rule, CASE WHEN old.dismiss_count IS NULL THEN 'second' ELSE 'first' END AS first_dismissed, CASE WHEN n IS NULL THEN 'first' ELSE 'second' END AS last_dismissed, coalesce(dismiss_count, 0) + coalesce(n, 0) AS dismiss_count, coalesce(nullif(note, ''), new_note) AS note FROM old FULL JOIN fresh USING (uuid, locator, rule))"""


def flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``lineitem`` as findings of rules, and the dismissals of a first run."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rule = F.when(part % 11 > 0, F.concat(F.lit("rule "), (part % 11).cast("string")))
    note = F.when(supp % 3 == 0, F.concat(F.lit("note "), supp.cast("string"))).otherwise("")
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("uuid"), F.col("l_linenumber").alias("locator"), rule.alias("rule"), supp.alias("seq"), F.col("l_returnflag").alias("run"), note.alias("note"))
    old = found.where("run <> 'R' and seq % 2 = 0 and rule is not null").groupBy("uuid", "locator", "rule").agg(F.count("*").alias("dismiss_count"), F.min("note").alias("note"))
    return found, old.withColumns({"first_dismissed": F.lit("first"), "last_dismissed": F.lit("first")})


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, old = flags(spark, sf_dir)
    return R.merge_dismissals(old, found.where("run <> 'A'"), F.lit("second"))


@query("r18_suppress", _FLAGS + " SELECT f.uuid, f.locator, f.rule, f.seq, old.uuid IS NOT NULL AS suppressed FROM f LEFT JOIN old USING (uuid, locator, rule)")
def r18(spark, sf_dir):
    return R.suppress(*flags(spark, sf_dir)).select("uuid", "locator", "rule", "seq", "suppressed")


@query("r19_merge_dismissals", _FLAGS + " SELECT * FROM merged")
def r19(spark, sf_dir):
    return _merged(spark, sf_dir)


@query("r20_persistent_offenders", _FLAGS + " SELECT uuid, locator, rule, dismiss_count FROM merged WHERE dismiss_count >= 3")
def r20(spark, sf_dir):
    return R.persistent_offenders(_merged(spark, sf_dir)).select("uuid", "locator", "rule", "dismiss_count")


@query("r21_diff_runs", _FLAGS + """, a AS (SELECT DISTINCT uuid, locator, rule, 1 AS was FROM f WHERE run <> 'A' AND rule IS NOT NULL), b AS (SELECT DISTINCT uuid, locator, rule, 1 AS now FROM f WHERE run <> 'R' AND rule IS NOT NULL)
SELECT uuid, locator, rule, CASE WHEN now IS NULL THEN 'fixed' WHEN was IS NULL THEN 'new' ELSE 'persisting' END AS state FROM a FULL JOIN b USING (uuid, locator, rule)""")
def r21(spark, sf_dir):
    found, _ = flags(spark, sf_dir)
    return R.diff_runs(found.where("run <> 'A'"), found.where("run <> 'R'"))
