"""Queries over pairs and groups, bound to ``lineitem, events, customer, orders, documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import captures as C
from ..operators import pairs as P
from ..operators import reports as T
from . import review_queries
from .capture_queries import _ELEMENTS, _ROOMS, _SESSIONS, elements, rooms
from .event_queries import _LOG, _VERDICT, _verdicts, log
from .registry import query


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.yaw_sessions(rooms(spark, sf_dir))


def _walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each room holds one wall; two walls to a building."""
    return rooms(spark, sf_dir).withColumn("wall_id", F.col("x").cast("int") % 2)


_D3 = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
_WALLS = f""", wp AS (SELECT a.uuid, CAST(a.x AS INTEGER) % 2 AS wall_id, a.seq AS seq_a, b.seq AS seq_b, {_D3} AS m, abs(a.yaw - b.yaw) AS t FROM r a JOIN r b ON a.uuid = b.uuid AND CAST(a.x AS INTEGER) % 2 = CAST(b.x AS INTEGER) % 2 AND a.seq < b.seq),
wd AS (SELECT * FROM (SELECT uuid, wall_id, seq_a, seq_b, round(m, 4) AS move_m, round(least(t, 360 - t), 2) AS turn_deg, row_number() OVER (PARTITION BY uuid ORDER BY wall_id, seq_a, seq_b) AS place FROM wp WHERE m > 0.01 OR least(t, 360 - t) > 0.5) WHERE place <= 10)"""


@query("c5_session_alignment", _SESSIONS + f""", n AS (SELECT a.uuid, a.session AS session_a, b.session AS session_b, round(min({_D3}), 6) AS min_dist_m FROM s a JOIN s b ON a.uuid = b.uuid AND a.session < b.session GROUP BY ALL),
c AS (SELECT uuid, session, avg(yaw) AS yaw, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM s GROUP BY uuid, session)
SELECT n.*, round(least(abs(a.yaw - b.yaw), 360 - abs(a.yaw - b.yaw)), 6) AS yaw_diff_deg, round({_D3}, 6) AS center_dist_m FROM n JOIN c a ON n.uuid = a.uuid AND session_a = a.session JOIN c b ON n.uuid = b.uuid AND session_b = b.session""")
def c5(spark, sf_dir):
    return P.session_pair_alignment(_sessions(spark, sf_dir), digits=6)


@query("c6_wall_disagreement", _ROOMS + _WALLS + " SELECT uuid, wall_id, seq_a, seq_b, move_m, turn_deg FROM wd")
def c6(spark, sf_dir):
    return P.shared_wall_disagreement(_walls(spark, sf_dir))


@query("c7_session_audit", _SESSIONS + _WALLS + """, n AS (SELECT uuid, count(DISTINCT session) AS n_sessions FROM s GROUP BY uuid),
gp AS (SELECT uuid, count(*) AS n_gaps FROM (SELECT uuid, round((created - lag(created) OVER (PARTITION BY uuid ORDER BY created, seq)) / 60, 1) AS gap FROM r) WHERE gap > 10 GROUP BY uuid),
sp AS (SELECT uuid, count(*) AS n_spreads FROM (SELECT uuid, story FROM r GROUP BY uuid, story HAVING count(*) >= 2 AND max(y) - min(y) > 1) GROUP BY uuid), wc AS (SELECT uuid, count(*) AS n_walls FROM wd GROUP BY uuid),
al AS (SELECT uuid, n_sessions, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_spreads, 0) AS n_spreads, coalesce(n_walls, 0) AS n_walls FROM n LEFT JOIN gp USING (uuid) LEFT JOIN sp USING (uuid) LEFT JOIN wc USING (uuid))
SELECT *, CASE WHEN n_sessions >= 3 OR n_walls >= 5 THEN 'RED' WHEN n_sessions = 2 AND n_gaps + n_spreads + n_walls > 0 THEN 'ORANGE' WHEN n_sessions = 2 THEN 'YELLOW' ELSE 'GREEN' END AS severity FROM al""")
def c7(spark, sf_dir):
    sessions, all_ = _sessions(spark, sf_dir), rooms(spark, sf_dir)
    return P.session_audit(C.session_summary(sessions), C.room_time_gaps(all_), C.story_y_spread(sessions), P.shared_wall_disagreement(_walls(spark, sf_dir)))


@query("c9_largest_turn", _ROOMS + f" SELECT a.uuid, a.story, round(max(least(abs(a.yaw - b.yaw), 360 - abs(a.yaw - b.yaw))), 4) AS max_turn_deg, round(max({_D3}), 4) AS max_move_m, count(*) AS n_pairs FROM r a JOIN r b ON a.uuid = b.uuid AND a.story = b.story AND a.seq < b.seq GROUP BY a.uuid, a.story")
def c9(spark, sf_dir):
    return P.largest_turn(rooms(spark, sf_dir))


@query("c11_azimuth_jumps", _ROOMS + ", j AS (SELECT uuid, story, seq, lag(seq) OVER w AS from_seq, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS jump FROM r WINDOW w AS (PARTITION BY uuid, story ORDER BY yaw, seq)) SELECT uuid, story, from_seq, seq, round(jump, 4) AS jump_m FROM j WHERE jump > 5")
def c11(spark, sf_dir):
    return P.azimuth_jumps(rooms(spark, sf_dir))


@query("s6_far_walls", _ROOMS + """, m AS (SELECT uuid, avg(x) AS mx, avg(z) AS mz FROM r GROUP BY uuid), f AS (SELECT uuid, max(sqrt(pow(x - mx, 2) + pow(z - mz, 2))) AS furthest FROM r JOIN m USING (uuid) GROUP BY uuid),
w AS (SELECT uuid, seq, story, sqrt(pow(2 * x - mx, 2) + pow(2 * z - mz, 2)) AS dist FROM r JOIN m USING (uuid)) SELECT uuid, seq, story, round(dist, 4) AS dist FROM w JOIN f USING (uuid) WHERE dist > 1.5 * furthest + 1e-9 AND dist > 10""")
def s6(spark, sf_dir):
    all_ = rooms(spark, sf_dir)
    return P.far_walls(all_, all_.withColumns({"x": 2 * F.col("x"), "z": 2 * F.col("z")}))


@query("s7_duplicate_rooms", _ROOMS + ", c AS (SELECT *, round(x / 8, 1) AS cx, round(z / 8, 1) AS cz, round(y, 1) AS cy FROM r) SELECT a.uuid, a.seq AS seq_a, b.seq AS seq_b, a.story AS story_a, b.story AS story_b FROM c a JOIN c b ON a.uuid = b.uuid AND a.seq < b.seq AND abs(a.cx - b.cx) < 0.5 AND abs(a.cy - b.cy) < 0.5 AND abs(a.cz - b.cz) < 0.5")
def s7(spark, sf_dir):
    return P.duplicate_rooms(rooms(spark, sf_dir).withColumns({"x": F.col("x") / 8, "z": F.col("z") / 8}))


@query("m5_wall_moves", _ELEMENTS + """, d AS (SELECT uuid, sqrt(pow(x - raw_x, 2) + pow(y - raw_y, 2) + pow(z - raw_z, 2)) AS v FROM matches WHERE matched), e AS (SELECT *, count(*) OVER (PARTITION BY uuid) AS n, row_number() OVER (PARTITION BY uuid ORDER BY v) AS nth FROM d)
SELECT uuid, count(*) AS n_walls, round(min(v), 6) AS min_m, round(max(v) FILTER (nth = n // 2 + 1), 6) AS median_m, round(max(v), 6) AS max_m, count(*) FILTER (v > 0.1) AS n_large FROM e GROUP BY uuid""")
def m5(spark, sf_dir):
    raw, merged = elements(spark, sf_dir)
    return P.wall_moves(C.match_elements(merged, raw), large_m=0.1)


_LABELLED = "WITH d AS (SELECT documents.*, quality, toxic FROM documents JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


@query("e9_compare_numbers", _LABELLED + """, v AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY quality ORDER BY n_chars) AS nth, count(*) OVER (PARTITION BY quality) AS n FROM d WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
g AS (SELECT *, least(greatest(CAST(floor((n + 1) * 0.75) AS BIGINT), 1), n - 1) AS low FROM v), a AS (SELECT label, n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, max(v) FILTER (nth = low) AS q1, max(v) FILTER (nth = low + 1) AS q2, max(v) AS top, max(CAST((n + 1) * 0.75 - low AS DOUBLE)) AS part FROM g GROUP BY label, n)
SELECT label, n, round(mean, 6) AS mean, median, CASE WHEN n > 4 THEN q1 + part * (q2 - q1) ELSE top END AS p75 FROM a""")
def e9(spark, sf_dir):
    return T.compare_numbers(labelled(spark, sf_dir), "quality", "n_chars")


@query("e9_compare_marks", _LABELLED + ", a AS (SELECT avg(CAST(toxic AS DOUBLE)) FILTER (quality = 0) AS rate, avg(CAST(toxic AS DOUBLE)) FILTER (quality = 1) AS rate_against FROM d) SELECT *, CASE WHEN rate_against > 0 THEN rate / rate_against ELSE 0 END AS lift FROM a")
def e9_marks(spark, sf_dir):
    return T.compare_marks(labelled(spark, sf_dir), "quality", "toxic", 0, 1)


@query("e12_event_context", _LOG + """, p AS (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY ts, seq) AS place FROM ev), f AS (SELECT home_id, min(place) AS first FROM p WHERE event = 'roomScanError' GROUP BY home_id ORDER BY home_id LIMIT 5)
SELECT home_id, place - first AS step, seq, event FROM p JOIN f USING (home_id) WHERE abs(place - first) <= 3""")
def e12(spark, sf_dir):
    return T.event_context(log(spark, sf_dir), "roomScanError")


@query("e19_confidence_tier", f"""WITH t AS ({review_queries._E17}), s AS ({_VERDICT} SELECT home_id, verdict, n_broken, n_errored FROM w), j AS (SELECT c_custkey AS home_id, severity, verdict, n_broken, n_errored, c_acctbal >= 9000 AS missing FROM customer LEFT JOIN t ON t.home_id = c_custkey LEFT JOIN s ON s.home_id = c_custkey)
SELECT home_id, CASE WHEN missing OR (severity = 'RED' AND verdict = 'RED') THEN 'HIGH' WHEN severity = 'RED' OR verdict = 'RED' THEN 'MEDIUM' ELSE 'LOW' END AS tier,
 concat_ws(' ; ', CASE WHEN missing THEN 'PIPELINE_BROKEN (no merged.json)' END, CASE WHEN n_broken > 0 THEN n_broken || ' broken-scan(s)' END, CASE WHEN n_errored > 0 THEN n_errored || ' errored-scan(s)' END) AS reasons FROM j""")
def e19(spark, sf_dir):
    severity = review_queries.e17(spark, sf_dir)
    verdict = _verdicts(spark, sf_dir).select("home_id", "verdict", "n_broken", "n_errored")
    homes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("home_id"), (F.col("c_acctbal") >= 9000).alias("missing"))
    rows = homes.join(severity, "home_id", "left").join(verdict, "home_id", "left").withColumns({"merge_errors": F.lit(0), "upload_failed": F.lit(0)})
    return T.confidence_tier(rows).select("home_id", "tier", "reasons")


@query("g16_rates_by_bin", _LABELLED + """, b AS (SELECT quality AS hit, unnest([{'feature': 'lang', 'bin': coalesce(lang, 'null')}, {'feature': 'length', 'bin': CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END}, {'feature': 'source', 'bin': coalesce(source, 'null')}]) AS p FROM d),
g AS (SELECT p.feature AS feature, p.bin AS bin, count(*) AS n, avg(hit) AS rate, sum(hit) AS s FROM b GROUP BY ALL), o AS (SELECT feature, sum(s) / sum(n) AS overall, coalesce(max(rate) FILTER (n >= 20) - min(rate) FILTER (n >= 20), 0) AS spread FROM g GROUP BY feature),
k AS (SELECT *, row_number() OVER (ORDER BY round(spread, 9) DESC, feature) AS rank FROM o) SELECT feature, bin, n, rate, rate / overall AS relative_risk, spread, rank FROM g JOIN k USING (feature)""")
def g16(spark, sf_dir):
    bins = {"lang": F.col("lang"), "length": K.bin_left_closed(F.col("n_chars"), [200, 2000], ["short", "medium", "long"]), "source": F.col("source")}
    return T.rates_by_bin(labelled(spark, sf_dir), "quality", bins)


_SCORED = _LABELLED + ", e AS (SELECT *, least(1.0, n_chars / 4000) AS score FROM d WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 4000))


@query("l18_binary_metrics", _SCORED + """, c AS (SELECT source, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 0 AND score < 0.5) AS tn FROM e GROUP BY source)
SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c""")
def l18(spark, sf_dir):
    return T.binary_metrics(scored(spark, sf_dir), "quality", "score", "source")


@query("l18_calibration_curve", _SCORED + " SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS rate FROM e GROUP BY ALL")
def l18_curve(spark, sf_dir):
    return T.calibration_curve(scored(spark, sf_dir), "quality", "score")


@query("g21_sweep_report", """WITH a AS (SELECT o_orderpriority AS setting, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS complete, avg(CAST(o_orderstatus = 'O' AS DOUBLE)) AS emitted, avg(CAST(o_orderstatus = 'P' AS DOUBLE)) AS error, avg(CAST(o_totalprice < 50000 AS DOUBLE)) AS low_coverage FROM orders GROUP BY 1),
b AS (SELECT *, 2 * complete + emitted - 2 * error - low_coverage AS score FROM a) SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, setting) = 1 AS best FROM b""")
def g21(spark, sf_dir):
    s = F.col("o_orderstatus")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("setting"), (s == "F").alias("complete"), (s == "O").alias("emitted"), (s == "P").alias("error"), (F.col("o_totalprice") < 50000).alias("low_coverage"))
    return T.sweep_report(rows)


@query("g23_trace_summary", "SELECT o_orderstatus AS status, o_orderpriority AS reason, count(*) AS n, count(DISTINCT o_custkey) AS n_buildings FROM orders GROUP BY ALL")
def g23(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_buildings"))
