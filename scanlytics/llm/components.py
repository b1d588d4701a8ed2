"""Connected components of an edge table by alternating star contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import discard, written

SALTS = 16  # the edges of one centre are dealt to so many tasks


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links every larger neighbour to the least one; small star links the smaller neighbours and the node itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"])
    if large:
        out = both.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: every node of an edge and the least node it reaches. Edges are ``a, b``, in any order."""
    table, before = None, None
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()
    while True:
        seen = Observation()
        following = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), "edges")
        discard(table)
        table, state = following, seen.get
        if state == before or not state["n"]:
            ends = table.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return ends.unionByName(table.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        edges = _stars(_stars(table, True), False)
