"""Queries over several sources of a home or building, cohorts, labels and features, bound to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import cohorts as C
from ..operators import events as E
from .capture_queries import _ROOMS, rooms
from .event_queries import _GAP, _LOG, _VERDICT, _verdicts, log
from .registry import query
from .surface_queries import _SF, surfaces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("f3_translation", _ROOMS + " SELECT uuid, seq, x, y, z FROM r")
def f3(spark, sf_dir):
    return rooms(spark, sf_dir).select("uuid", "seq", K.translation(F.col("t")).alias("p")).select("uuid", "seq", "p.*")


_FLAG = "CASE c_custkey % 4 WHEN 0 THEN 'multi_session (' || c_custkey % 6 || ' scan sessions)' WHEN 1 THEN 'other' WHEN 2 THEN 'multi_session ( scan sessions)' END"


def _flags() -> F.Column:
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("multi_session ("), (k % 6).cast("string"), F.lit(" scan sessions)"))).when(k % 4 == 1, "other").when(k % 4 == 2, "multi_session ( scan sessions)")
    return F.array(F.lit("gap"), F.coalesce(said, F.lit("")), F.lit("multi_session (77 scan session)"))


@query("f17_multi_session", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 6 ELSE 77 END AS sessions FROM customer")
def f17(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.multi_session(_flags()).alias("sessions"))


@query("f19_reasons", "SELECT c_custkey, concat_ws(' ; ', CASE WHEN c_nationkey > 10 THEN 'far' END, CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_custkey % 2 = 0 THEN 'even' END) AS reasons FROM customer")
def f19(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", C.reasons(F.when(F.col("c_nationkey") > 10, "far"), F.when(F.col("c_acctbal") < 0, "debt"), F.when(F.col("c_custkey") % 2 == 0, "even")).alias("reasons"))


@query("e18_impacted_scans", _VERDICT + f""", cc AS (SELECT home_id, count(*) FILTER (event = 'roomScanStarted') - count(*) FILTER (event = 'roomScanCompleted') AS incomplete, greatest(0, count(*) FILTER (event = 'roomScanStopped') - count(*) FILTER (event = 'roomScanCompleted')) AS stopped,
 count(*) FILTER (event = 'roomScanAROpened') - count(*) FILTER (event = 'roomScanStarted') AS reopens, count(*) FILTER (event = 'initializingARStateOutOfTheBlue') AS reinits, greatest(0, count(*) FILTER (event = 'roomScanError') - 2) AS errors FROM ev GROUP BY home_id),
gg AS (SELECT home_id, {_GAP} FROM ev), days AS (SELECT home_id, count(*) FILTER (gap > 86400) AS days FROM gg GROUP BY home_id),
loc AS (SELECT home_id, CASE WHEN home_id % 3 = 0 THEN verdict ELSE 'GREEN' END AS local, home_id % 4 AS sessions, CASE WHEN home_id % 17 = 0 THEN 'MISSING' ELSE 'GREEN' END AS recon FROM w),
j AS (SELECT home_id, local, sessions, recon, incomplete, stopped, reopens, reinits, errors, days FROM loc JOIN cc USING (home_id) JOIN days USING (home_id)),
k AS (SELECT *, coalesce(incomplete >= 4 OR stopped >= 4 OR reopens >= 5 OR days >= 2 OR errors >= 1, false) AS red, coalesce(incomplete >= 2 OR stopped >= 2 OR reopens >= 2 OR days >= 1, false) AS orange, reinits >= 6 AS restarts FROM j),
s AS (SELECT *, CASE WHEN recon = 'MISSING' OR red OR local = 'RED' OR (restarts AND (orange OR local IN ('ORANGE', 'YELLOW'))) THEN 'RED' WHEN local = 'ORANGE' OR orange OR restarts THEN 'ORANGE' WHEN local = 'YELLOW' THEN 'YELLOW' ELSE 'GREEN' END AS severity FROM k)
SELECT home_id, severity, errors AS scan_errors, incomplete AS incomplete_scans, row_number() OVER (ORDER BY CASE severity WHEN 'RED' THEN 0 WHEN 'ORANGE' THEN 1 WHEN 'YELLOW' THEN 2 ELSE 3 END, errors DESC, incomplete DESC, reinits DESC, sessions DESC, home_id) AS rank FROM s""")
def e18(spark, sf_dir):
    rows, home = log(spark, sf_dir), F.col("home_id")
    local = _verdicts(spark, sf_dir).select("home_id", F.when(home % 3 == 0, F.col("verdict")).otherwise("GREEN").alias("local"), (home % 4).alias("sessions"), F.when(home % 17 == 0, "MISSING").otherwise("GREEN").alias("recon_class"), F.lit("").alias("recon_flags"))
    count = lambda name: F.count_if(F.col("event") == name)
    trouble = rows.groupBy("home_id").agg(count(E.REINIT).alias("ar_reinit"), F.greatest(F.lit(0).cast("long"), count("roomScanError") - 2).alias("scan_errors"))
    return C.impacted_scans(local, E.completion_by_home(rows), E.gaps_by_home(rows), trouble).select("home_id", "severity", "scan_errors", "incomplete_scans", "rank")


_STATE = """WITH s AS (SELECT c_custkey AS home_id, CASE WHEN c_custkey % 7 = 0 THEN 'NO_OUTPUT' WHEN c_custkey % 5 = 0 THEN 'PIPELINE_BROKEN' WHEN c_custkey % 3 = 0 THEN 'RECON_BROKEN' WHEN c_custkey % 11 = 0 THEN 'RECON_PARSE_ERR' WHEN c_nationkey % 4 = 0 THEN 'RECON_UNKNOWN' ELSE 'RECON_' || c_mktsegment END AS pipeline_state FROM customer)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    homes = _table(spark, sf_dir, "customer")
    files = homes.where(k % 7 > 0).select(k.alias("home_id"), (k % 5 > 0).alias("has_merged"), (k % 3 > 0).alias("has_recon"))
    results = homes.where(k % 11 > 0).select(k.alias("home_id"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment")).alias("recon_class"))
    return C.pipeline_state(homes.select(k.alias("home_id")), files, results).select("home_id", "pipeline_state")


@query("e20_pipeline_state", _STATE + " SELECT * FROM s")
def e20(spark, sf_dir):
    return _states(spark, sf_dir)


@query("e20_state_shares", _STATE + " SELECT pipeline_state, count(*) AS n, count(*) / (SELECT count(*) FROM s) AS share FROM s GROUP BY pipeline_state")
def e20_shares(spark, sf_dir):
    return C.shares(_states(spark, sf_dir), "pipeline_state")


@query("e21_scan_health", """WITH b AS (SELECT o_custkey AS home_id, count(*) FILTER (o_orderstatus = 'F') % 3 AS broken_rooms FROM orders GROUP BY o_custkey),
t AS (SELECT c_custkey AS home_id, c_nationkey % 3 AS merge_errors, CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END AS upload_failed FROM customer WHERE c_custkey % 2 = 0),
o AS (SELECT c_custkey AS home_id, c_custkey % 13 <> 0 AS has_merged, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 6 ELSE 77 END AS multi, c_custkey % 3 AS storeys FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT home_id, coalesce(broken_rooms, 0) AS broken_rooms, coalesce(merge_errors, 0) AS merge_errors, coalesce(upload_failed, 0) AS upload_failed, NOT has_merged AS pipeline_broken, multi AS multi_session, storeys, CASE WHEN storeys > 0 THEN greatest(0, multi - storeys) ELSE multi END AS excess FROM o LEFT JOIN b USING (home_id) LEFT JOIN t USING (home_id))
SELECT *, concat_ws(' · ', CASE WHEN pipeline_broken THEN 'no merged.json' END, CASE WHEN broken_rooms > 0 THEN broken_rooms || ' broken room' || CASE WHEN broken_rooms = 1 THEN '' ELSE 's' END END, CASE WHEN merge_errors > 0 THEN merge_errors || ' mergeRoomsError' END, CASE WHEN upload_failed > 0 THEN upload_failed || ' scanUploadFailed' END,
 CASE WHEN excess > 0 AND storeys > 0 THEN excess || ' extra ARKit session' || CASE WHEN excess = 1 THEN '' ELSE 's' END || ' (' || multi_session || ' for ' || storeys || ' user storey' || CASE WHEN storeys = 1 THEN '' ELSE 's' END || ')' WHEN excess > 0 THEN multi_session || ' ARKit sessions' END) AS summary
FROM j WHERE broken_rooms > 0 OR merge_errors > 0 OR upload_failed > 0 OR pipeline_broken OR excess > 0""")
def e21(spark, sf_dir):
    k, homes = F.col("c_custkey"), _table(spark, sf_dir, "customer")
    broken = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("home_id")).agg((F.count_if(F.col("o_orderstatus") == "F") % 3).alias("broken_rooms"))
    trouble = homes.where(k % 2 == 0).select(k.alias("home_id"), (F.col("c_nationkey") % 3).alias("merge_errors"), F.when(F.col("c_nationkey") == 7, 1).otherwise(0).alias("upload_failed"))
    outputs = homes.where(k % 5 > 0).select(k.alias("home_id"), (k % 13 > 0).alias("has_merged"), _flags().alias("flags"), (k % 3).alias("storeys"))
    return C.scan_health(outputs, broken, trouble)


_CONTROL = "WITH t AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN 'target' WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0 ORDER BY md5('5:' || c_custkey), c_custkey LIMIT 100) THEN 'control' END AS cohort FROM customer)"


@query("c13_target_vs_control", _CONTROL + " SELECT cohort, 'c_acctbal' AS metric, count(*) AS n, avg(c_acctbal) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM t WHERE cohort IS NOT NULL GROUP BY cohort")
def c13(spark, sf_dir):
    homes = _table(spark, sf_dir, "customer")
    target = homes.where("c_custkey % 10 = 0").withColumn("cohort", F.lit("target"))
    control = C.control_sample(homes.where("c_custkey % 10 > 0"), "c_custkey", 100, 5).withColumn("cohort", F.lit("control"))
    return C.cohort_table(target.unionByName(control), "cohort", ["c_acctbal"]).drop("median")


@query("s8_cohort_metrics", "SELECT l_returnflag AS cohort, metric, count(*) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high FROM (SELECT l_returnflag, unnest(['quantity', 'tax']) AS metric, unnest([CAST(l_quantity AS DOUBLE), CAST(l_tax AS DOUBLE)]) AS v FROM lineitem) GROUP BY ALL")
def s8(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cohort"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return C.cohort_table(rows, "cohort", ["quantity", "tax"]).drop("median")


@query("s3_extreme_buildings", _ROOMS + ", b AS (SELECT uuid, count(*) AS n_rooms, max(x) - min(x) AS span_x, max(y) - min(y) AS span_y, max(z) - min(z) AS span_z FROM r GROUP BY uuid) SELECT *, greatest(span_x, span_z) > 15 AS wide, span_y > 4 AS high, greatest(span_x, span_y, span_z) > 18 AS far FROM b")
def s3(spark, sf_dir):
    return C.extreme_elements(rooms(spark, sf_dir), 15.0, 4.0, 18.0)


_LAB = """WITH lab AS (SELECT event_id, user_id AS building_uuid, user_id || CASE WHEN event_id % 9 = 0 THEN '#' ELSE '-' END || event_id AS proposal_id, CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'skipped' END AS label, event_type AS kind, event_id % 5 AS cluster FROM events),
par AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'p' || CASE WHEN event_id % 8 = 0 THEN 'a' ELSE 'b' END || event_id END AS parent_proposal_id FROM lab)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("building_uuid"), F.concat(F.col("user_id").cast("string"), F.when(e % 9 == 0, "#").otherwise("-"), e.cast("string")).alias("proposal_id"), F.when(e % 3 == 0, "accepted").when(e % 3 == 1, "rejected").otherwise("skipped").alias("label"), F.col("event_type").alias("kind"), (e % 5).alias("cluster"))
    splits = rows.where(e % 4 == 0).select(F.when(e % 8 == 0, F.concat(F.lit("pa"), e.cast("string"))).alias("parent_id"), F.concat(F.lit("pb"), e.cast("string")).alias("original_id"), F.array("proposal_id").alias("children"))
    return C.split_provenance(rows, splits)


@query("l2_split_provenance", _LAB + " SELECT proposal_id, parent_proposal_id, parent_proposal_id IS NOT NULL OR contains(proposal_id, '#') AS is_split_child FROM par")
def l2(spark, sf_dir):
    return _labels(spark, sf_dir).select("proposal_id", "parent_proposal_id", "is_split_child")


@query("l3_resolution_report", _LAB + """ SELECT count(*) AS total, count(DISTINCT building_uuid) AS buildings, count(*) FILTER (parent_proposal_id IS NOT NULL OR contains(proposal_id, '#')) AS split_children, count(*) FILTER (cluster > 0) AS have_members,
 (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM lab GROUP BY label)) AS by_label, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM lab GROUP BY kind)) AS by_kind FROM par""")
def l3(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("members", F.when(F.col("cluster") > 0, F.sequence(F.lit(1).cast("long"), "cluster")))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias(c)
    return C.resolution_report(rows, ["members"]).select("total", "buildings", "split_children", "have_members", text("by_label"), text("by_kind"))


@query("l4_accept_fractions", _LAB + " SELECT proposal_id, avg(CAST(label = 'accepted' AS INTEGER)) OVER (PARTITION BY building_uuid) AS by_building, avg(CAST(label = 'accepted' AS INTEGER)) OVER (PARTITION BY kind, cluster) AS by_family FROM lab")
def l4(spark, sf_dir):
    return C.group_accept_fraction(_labels(spark, sf_dir), {"by_building": ["building_uuid"], "by_family": ["kind", "cluster"]}).select("proposal_id", "by_building", "by_family")


@query("l9_dist_stats", """WITH v AS (SELECT user_id, event_id, value AS v, value - avg(value) OVER (PARTITION BY user_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY abs(value), event_id) AS i FROM events WHERE value IS NOT NULL),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, count(*) AS n, sum(abs(v)) AS total, max(abs(v)) AS top, sum(i * abs(v)) AS iv, stddev_pop(v) AS sd, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4, sum(x * nx) AS xn, sum(x * x) AS xx FROM n GROUP BY user_id)
SELECT user_id, n, round(CASE WHEN top < 1e-9 THEN 0 ELSE (2 * iv - (n + 1) * total) / (n * total) END, 6) AS gini, round(CASE WHEN n >= 3 THEN CASE WHEN sd <= 1e-9 THEN 0 ELSE m3 / pow(sd, 3) END END, 6) AS skewness, round(CASE WHEN n >= 4 THEN CASE WHEN sd <= 1e-9 THEN 0 ELSE m4 / pow(sd, 4) END END, 6) AS kurtosis, round(CASE WHEN xx > 0 THEN xn / xx END, 6) AS autocorrelation FROM s""")
def l9(spark, sf_dir):
    out = C.dist_stats(_table(spark, sf_dir, "events"), "user_id", "value", ["event_id"])
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("gini", "skewness", "kurtosis", "autocorrelation")])


@query("l15_group_folds", "SELECT o_orderkey, o_custkey, CAST(CAST('0x' || substr(md5(o_custkey::VARCHAR), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM orders")
def l15(spark, sf_dir):
    return C.group_folds(_table(spark, sf_dir, "orders"), "o_custkey", 5).select("o_orderkey", "o_custkey", "fold")


_MODEL = {"price": (150_000.0, 80_000.0, -0.9), "day": (15.0, 9.0, 0.4), "status": (0.5, 0.0, 0.3)}


@query("l24_score_quality", """WITH p AS (SELECT o_orderkey, (o_totalprice - 150000) / 80000 * -0.9 AS a, (day(o_orderdate) - 15) / 9.0::DOUBLE * 0.4 AS b, (CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE 0 END - 0.5) * 0.3 AS c FROM orders),
r AS (SELECT *, greatest(1.0::DOUBLE, least(5.0::DOUBLE, 3.0 + a + b + c)) AS rating FROM p)
SELECT o_orderkey, round((rating - 1) / 4, 4) AS score, round(rating, 3) AS predicted_rating, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 'price' WHEN abs(b) >= abs(c) THEN 'day' ELSE 'status' END AS largest FROM r""")
def l24(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.dayofmonth("o_orderdate").alias("day"), status.alias("status"))
    return C.score_quality(rows, "o_orderkey", _MODEL, 3.0, 2).select("o_orderkey", "score", "predicted_rating", F.col("components")[0]["feature"].alias("largest"))


@query("l20_autonomy", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice / 300000 < 0.1 THEN 'reject' WHEN o_totalprice / 300000 > 0.9 THEN 'accept' ELSE 'review' END AS decision FROM orders")
def l20(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("rule_fires"), (F.col("o_totalprice") / 300000).alias("score"))
    return C.autonomy(rows).select("o_orderkey", "decision")


@query("g12_rated_only", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 6 IN (1, 5)")
def g12(spark, sf_dir):
    rating = F.when(F.col("c_nationkey") % 6 == 0, "upstream_error").otherwise((F.col("c_nationkey") % 6).cast("string"))
    ratings = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), rating.alias("rating"))
    return C.with_rating(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uuid"), "o_orderkey"), ratings, ["1", "5"]).select("o_orderkey")


@query("g14_golden_metrics", """WITH a AS (SELECT o_custkey AS uuid, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY o_custkey), e AS (SELECT c_custkey AS uuid, 10 AS n, 150000.0 AS price FROM customer),
l AS (SELECT coalesce(a.uuid, e.uuid) AS uuid, unnest(['n', 'price']) AS metric, unnest([CAST(a.n AS DOUBLE), a.price]) AS actual, unnest([CAST(e.n AS DOUBLE), CAST(e.price AS DOUBLE)]) AS expected, unnest([3.0, 20000.0]) AS tolerance FROM a FULL JOIN e ON a.uuid = e.uuid)
SELECT uuid, metric, coalesce(abs(actual - expected) <= tolerance, false) AS ok FROM l""")
def g14(spark, sf_dir):
    actual = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("uuid")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("price"))
    expected = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.lit(10).alias("n"), F.lit(150000.0).alias("price"))
    return C.compare_to_expected(actual, expected, "uuid", {"n": 3.0, "price": 20000.0}).select("uuid", "metric", "ok")


@query("g22_systematic_holdout", "SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n, count(*) OVER () AS m FROM customer) WHERE n % (m // 30) = 0 ORDER BY n LIMIT 30")
def g22(spark, sf_dir):
    return C.systematic_holdout(_table(spark, sf_dir, "customer"), "c_custkey", 30)


@query("g35_signal_availability", "WITH s AS (SELECT l_orderkey AS uuid, l_linenumber % 3 AS story, CASE WHEN l_tax > 0 THEN l_partkey % 360 - 180 END AS az, l_quantity AS area FROM lineitem), t AS (SELECT uuid, story, sum(area) AS area, count(az) AS n FROM s GROUP BY ALL) SELECT uuid, (SELECT count(DISTINCT floor(((az % 180) + 180) % 180 / 30)) FROM s WHERE s.uuid = t.uuid) AS directions, sum(n) AS n_sloped, max(area) - min(area) AS area_spread FROM t GROUP BY uuid")
def g35(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uuid"), (F.col("l_linenumber") % 3).alias("story"), F.when(F.col("l_tax") > 0, F.col("l_partkey") % 360 - 180.0).alias("azimuth"), F.col("l_quantity").alias("area"))
    return C.signal_availability(rows)


@query("g36_envelope_diff", """WITH i AS (SELECT l_returnflag AS source, l_partkey AS id, sum(l_quantity) FILTER (l_linestatus = 'O') AS was, sum(l_quantity) FILTER (l_linestatus = 'F') AS now FROM lineitem GROUP BY ALL)
SELECT source, coalesce(sum(was), 0) AS area_before, coalesce(sum(now), 0) AS area_after, coalesce(sum(now), 0) - coalesce(sum(was), 0) AS delta, count(*) FILTER (was IS NULL AND now IS NOT NULL) AS added, count(*) FILTER (now IS NULL AND was IS NOT NULL) AS removed FROM i GROUP BY source""")
def g36(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_partkey").alias("locator_id"), F.col("l_linestatus").alias("variant"), F.col("l_quantity").cast("double").alias("area"))
    return C.envelope_diff(rows, ("O", "F"))


@query("g38_feature_coverage", "SELECT coalesce(a.f, b.f) AS feature, CASE WHEN b.f IS NULL THEN 'missing' WHEN a.f IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT p_type || p_size AS f FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT DISTINCT p_type || p_size AS f FROM part WHERE p_partkey % 3 = 0) b ON a.f = b.f")
def g38(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("feature", F.concat("p_type", F.col("p_size").cast("string")))
    return C.feature_coverage(rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 3 = 0"))


_CLASSES = ["FURNITURE", "BUILDING", "no such class"]


@query("p9_overlap_summary", f"SELECT c AS class, count(DISTINCT o_custkey) AS buildings, count(DISTINCT o_custkey) / (SELECT count(*) FROM customer) AS share, count(o_custkey) AS total FROM (SELECT unnest({_CLASSES}) AS c) LEFT JOIN (SELECT o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F') ON c = c_mktsegment GROUP BY c")
def p9(spark, sf_dir):
    homes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uuid"), F.col("c_mktsegment").alias("class"))
    found = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("uuid")).join(homes, "uuid")
    return C.class_summary(found, homes, _CLASSES)


_AXIS = _SF + """, wl AS (SELECT uuid, round(degrees(atan2(CASE WHEN few THEN 0 ELSE d END, w)), 9) AS az0, sqrt(w * w + CASE WHEN few THEN 0 ELSE d * d END) AS len FROM sf WHERE category = 'wall'),
wa AS (SELECT uuid, ((az0 % 90) + 90) % 90 AS az, len FROM wl WHERE len >= 0.2), bn AS (SELECT uuid, (CAST(round_even(az / 2, 0) AS INTEGER) + o + 45) % 45 AS bin, sum(len * wt) AS weight FROM wa, (VALUES (0, 1.0::DOUBLE), (1, 0.5::DOUBLE), (-1, 0.5::DOUBLE)) v(o, wt) GROUP BY ALL),
ax AS (SELECT uuid, arg_min(bin, (-round(weight, 6), bin)) * 2.0::DOUBLE AS axis FROM bn GROUP BY uuid),
cv AS (SELECT uuid, axis, sum(CASE WHEN least(abs((az - axis) % 90), 90 - abs((az - axis) % 90)) <= 12 THEN len ELSE 0 END) / sum(len) AS coverage FROM wa JOIN ax USING (uuid) GROUP BY ALL)"""


@query("p12_principal_axis", _AXIS + " SELECT uuid, axis, round(coverage, 6) AS coverage FROM cv")
def p12(spark, sf_dir):
    return C.principal_axis(surfaces(spark, sf_dir).where("category = 'wall'")).select("uuid", "axis", F.round("coverage", 6).alias("coverage"))


@query("r15_irregular_footprint", _AXIS + " SELECT uuid, 'roof_irregular_footprint' AS rule, round(coverage, 6) AS evidence FROM cv WHERE coverage < 0.7")
def r15(spark, sf_dir):
    return C.irregular_footprint(surfaces(spark, sf_dir).where("category = 'wall'"))


_BANDS = _SF + ", bd AS (SELECT uuid, story, min(y) AS lo, max(y + h) AS hi FROM sf WHERE category = 'wall' GROUP BY ALL)"


@query("r4_knee_wall_misplaced", _BANDS + ", tp AS (SELECT uuid, max(hi) AS top FROM bd GROUP BY uuid) SELECT uuid, seq, locator_id, 'knee_wall_misplaced' AS rule, 'med' AS severity, round(abs(y + h / 2 - top), 6) AS evidence FROM sf JOIN tp USING (uuid) WHERE category = 'knee_wall' AND abs(y + h / 2 - top) > 1")
def r4(spark, sf_dir):
    return C.knee_wall_misplaced(surfaces(spark, sf_dir))


@query("r3_story_ceiling_overcount", _BANDS + """, cg AS (SELECT uuid, seq, min(bd.story) AS story FROM sf JOIN bd USING (uuid) WHERE category = 'ceiling' AND y + h / 2 BETWEEN lo - 0.5 AND hi + 0.5 GROUP BY ALL), nc AS (SELECT uuid, story, count(*) AS n FROM cg GROUP BY ALL),
rm AS (SELECT uuid, story, count(*) AS n_rooms FROM sf WHERE category = 'floor' GROUP BY ALL), j AS (SELECT uuid, story, n_rooms, coalesce(n, 0) AS n_ceilings, max(story) OVER (PARTITION BY uuid) AS top FROM rm LEFT JOIN nc USING (uuid, story))
SELECT uuid, story, 'story_ceiling_overcount' AS rule, CASE WHEN n_rooms <= 2 AND n_ceilings >= 2 THEN CASE WHEN n_ceilings / n_rooms >= 8 THEN 'high' ELSE 'medium' END WHEN n_ceilings / n_rooms > 5 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN n_rooms <= 2 AND n_ceilings >= 2 THEN 'oversaturated' ELSE 'high_ratio' END AS pattern, n_rooms, n_ceilings
FROM j WHERE (n_rooms <= 2 AND n_ceilings >= 2) OR (story <> top AND n_ceilings / n_rooms > 1)""")
def r3(spark, sf_dir):
    rows = surfaces(spark, sf_dir)
    return C.story_ceiling_overcount(rows, rows.where("category = 'floor'").select("uuid", "story"), many=2, ratio=1.0)


@query("g13_height_modes", _ROOMS + """, s AS (SELECT uuid, story, y, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT *, CASE WHEN round(y - lag(y) OVER w, 9) < 0.3 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY uuid, story ORDER BY y)),
m AS (SELECT *, sum(new) OVER (PARTITION BY uuid, story ORDER BY y) AS mode FROM t) SELECT uuid, story, mode, sum(n) AS n_rooms, min(y) AS low, max(y) AS high FROM m GROUP BY ALL""")
def g13(spark, sf_dir):
    return C.height_modes(rooms(spark, sf_dir), 0.3)
