"""Queries that fit models or rank features, bound to ``orders``: buildings are customers, and the label is whether an order is dear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import models as M
from .registry import query


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    return rows.select(F.col("o_custkey").alias("building_uuid"), k.alias("proposal_id"), (price > 250_000).cast("int").alias("label"), (price + k % 50_000).alias("size"), F.when(k % 7 > 0, F.dayofmonth("o_orderdate")).alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (k % 3 + 1).cast("double").alias("weight"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prepare(features(spark, sf_dir), ["size", "day"], ["status", "priority"])


@query("l14_prepare", None)
def l14(spark, sf_dir):
    return _prepared(spark, sf_dir).select("building_uuid", "label", "weight")


@query("l16_oof_scores", None)
def l16(spark, sf_dir):
    return M.oof_scores(_prepared(spark, sf_dir), 3).select("building_uuid", "label", "fold", "boosted", "tree")


@query("l17_calibrated", None)
def l17(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("score", F.col("size") / 600_000)
    return M.calibrated(rows, "score").select("proposal_id", "score", "label", "calibrated")


@query("l19_reject_leaves", None)
def l19(spark, sf_dir):
    return M.reject_leaves(_prepared(spark, sf_dir))


@query("l21_archetypes", None)
def l21(spark, sf_dir):
    return M.archetypes(features(spark, sf_dir), "proposal_id", ["size", "day"], 4)[0]


@query("l23_fit_quality", None)
def l23(spark, sf_dir):
    """Ratings that follow two features, and the fitted model's scores."""
    rows = features(spark, sf_dir).withColumn("rating", F.when(F.col("proposal_id") % 11 == 0, "upstream_error").otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.round(F.col("size") / 80_000))).cast("string")))
    model, intercept = M.fit_quality(rows, ["size", "day"])
    return C.score_quality(rows, "proposal_id", model, intercept).select("proposal_id", "score", "predicted_rating")


_FEATURES = "WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS label, o_totalprice + o_orderkey % 50000 AS size, CASE WHEN o_orderkey % 7 > 0 THEN CAST(day(o_orderdate) AS DOUBLE) END AS day, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderkey % 3 + 1 AS DOUBLE) AS w FROM orders)"


@query("l13_cohens_d", _FEATURES + """, l AS (SELECT label, w, unnest(['size', 'day']) AS feature, unnest([size, day]) AS v FROM f), s AS (SELECT feature, label, sum(w) AS sw, sum(w * v) / sum(w) AS mean, sum(w * v * v) / sum(w) AS sq FROM l WHERE v IS NOT NULL GROUP BY ALL),
b AS (SELECT a.feature, a.mean AS m0, b.mean AS m1, (b.mean - a.mean) / sqrt(((a.sq - a.mean * a.mean) * a.sw + (b.sq - b.mean * b.mean) * b.sw) / (a.sw + b.sw)) AS d FROM s a JOIN s b ON a.feature = b.feature AND a.label = 0 AND b.label = 1)
SELECT feature, round(m0, 4) AS mean_0, round(m1, 4) AS mean_1, round(d, 6) AS cohens_d, row_number() OVER (ORDER BY abs(d) DESC, feature) AS rank FROM b""")
def l13(spark, sf_dir):
    out = M.rank_features(features(spark, sf_dir), ["size", "day"])
    return out.select("feature", F.round("mean_0", 4).alias("mean_0"), F.round("mean_1", 4).alias("mean_1"), F.round("cohens_d", 6).alias("cohens_d"), "rank")


@query("l13_cramers_v", _FEATURES + """, l AS (SELECT label, unnest(['status', 'priority']) AS feature, unnest([status, priority]) AS v FROM f), c AS (SELECT feature, v, label, count(*) AS n FROM l GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS r, sum(n) OVER (PARTITION BY feature, label) AS q FROM c) SELECT feature, round(sqrt(greatest(0, sum(n * n / (r * q)) - 1) / (least(count(DISTINCT v), count(DISTINCT label)) - 1)), 6) AS cramers_v FROM e GROUP BY feature""")
def l13_names(spark, sf_dir):
    return M.cramers_v(features(spark, sf_dir), ["status", "priority"]).select("feature", F.round("cramers_v", 6).alias("cramers_v"))
