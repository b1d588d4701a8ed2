"""Ranks of tables larger than one partition, with rows wide enough for adaptive execution to merge partitions."""

import pytest
from pyspark.sql import functions as F

from scanlytics.operators.cohorts import impacted_scans, ranked, systematic_holdout

ROWS = 500_000


@pytest.fixture()
def adaptive(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def wide(spark, rows=ROWS):
    return spark.range(rows).select(F.xxhash64("id").alias("home_id"), F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("payload"))


def test_ranks_of_wide_rows(adaptive):
    out = ranked(wide(adaptive), [F.col("home_id")]).cache()
    assert out.count() == ROWS and out.select("rank").distinct().count() == ROWS
    assert out.agg(F.min("rank"), F.max("rank")).first() == (1, ROWS)
    wrong = out.select("home_id", "rank").join(out.select(F.col("home_id").alias("after"), (F.col("rank") - 1).alias("rank")), "rank").where("home_id >= after")
    assert wrong.count() == 0
    out.unpersist()


def test_impacted_scans_are_whole(adaptive):
    rows = wide(adaptive).select(F.col("id").alias("home_id"), F.lit("GREEN").alias("local"), F.lit(1).alias("sessions"), F.lit("GREEN").alias("recon_class"), F.col("payload").alias("recon_flags"))
    out = impacted_scans(rows)
    assert out.agg(F.count("*"), F.count_distinct("home_id"), F.max("rank")).first() == (ROWS, ROWS, ROWS)


def test_holdout_takes_every_kth_id(adaptive):
    ids = adaptive.range(300_000).select(F.format_string("%09d", "id").alias("home_id"))
    got = [int(r[0]) for r in systematic_holdout(ids, "home_id", 1000).collect()]
    assert sorted(got) == list(range(0, 300_000, 300))
