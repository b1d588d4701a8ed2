"""Exact nearest neighbours of all rows, in blocks, and what follows from them: mean distances, shares, local outlier factors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

BLOCK = 16384  # rows in a block
AT_ONCE = 1 << 20  # distances that are worked out at the same time


def _squares(vectors: np.ndarray) -> np.ndarray:
    return (vectors * vectors).sum(1)


def standardised(rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """``key, vector``: features minus their mean over the standard deviation (of the population; 1 where there is none); nulls become the median."""
    values = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    rows = rows.select(F.col(f"`{key}`").alias("key"), *values)
    names = rows.columns[1:]
    middle = rows.agg(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)).alias(c) for c in names]).first()
    rows = rows.fillna({c: middle[c] for c in names})
    stats = rows.agg(*[f(c).alias(f"{n}{c}") for c in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(F.col(c) - (stats[f"m{c}"] or 0.0)) / (stats[f"s{c}"] if (stats[f"s{c}"] or 0.0) > 1e-12 else 1.0) for c in names]
    return rows.select("key", F.array(*scaled).alias("vector"))


def nearest(rows: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """``key, rank, other, distance``: the ``k`` nearest other rows of every row (``key, vector``), by distance, then the smaller key. Exact.

    Rows are dealt to blocks by a hash; every two blocks meet once, in one task, which keeps the ``k`` nearest that either has for the other; the best of all blocks
    remain and are written, as all that follows reads them several times. The work grows with the square of the rows, as an exact search without structure must; memory does not.
    """
    table = written(rows.select("key", "vector"), "vectors")
    n = max(1, -(-table.count() // block))
    table = table.withColumn("home", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    asked = table.withColumnRenamed("home", "asked").withColumn("held", F.explode(F.sequence("asked", F.lit(n - 1))))
    held = table.withColumnRenamed("home", "held").where("held > 0").withColumn("asked", F.explode(F.sequence(F.lit(0), F.col("held") - 1)))
    kind = f"key {table.schema['key'].dataType.simpleString()}, other {table.schema['key'].dataType.simpleString()}, distance double"

    def meet(pair: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if pair[0] == pair[1]:
            return best_of(left, left)
        return pd.concat([best_of(left, right), best_of(right, left)])

    def best_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": left.key[:0], "other": left.key[:0], "distance": np.zeros(0)})
        step = max(1, AT_ONCE // len(right))
        right = right.sort_values("key", kind="stable")
        b, names, out = np.stack(right.vector.to_numpy()), right.key.to_numpy(), []
        size = _squares(b)
        for i in range(0, len(left), step):
            part = left.iloc[i : i + step]
            a = np.stack(part.vector.to_numpy())
            near = _squares(a)[:, None] + size - 2 * a @ b.T
            near[part.key.to_numpy()[:, None] == names] = np.inf
            last = np.partition(near, min(k, len(names)) - 1, axis=1)[:, min(k, len(names)) - 1]
            slack = 1e-9 * (1.0 + _squares(a) + size.max())
            row, col = np.nonzero((near <= last[:, None] + slack[:, None]) & np.isfinite(near))  # all that rounding may have put behind the last
            exact = np.sqrt(((a[row] - b[col]) ** 2).sum(1))
            order = np.lexsort((names[col], np.round(exact, 9), row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            out.append(pd.DataFrame({"key": part.key.to_numpy()[row[keep]], "other": names[col[keep]], "distance": exact[keep]}))
        return pd.concat(out)

    found = asked.groupBy("asked", "held").cogroup(held.groupBy("asked", "held")).applyInPandas(meet, kind)
    order = F.struct(F.round("distance", 9).alias("by"), F.col("other"), F.col("distance"))
    best = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("n"))  # k rows of each block
    return written(best.select("key", F.posexplode("n").alias("rank", "n")).select("key", (F.col("rank") + 1).alias("rank"), "n.other", "n.distance"), "neighbours")


def knn_features(neighbours: DataFrame, labels: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Per row: ``knn_distance`` (mean), ``knn_accept`` (share of ``labels`` (``key, accepted``) among the neighbours that is true; no label is false), ``low_density`` (at or beyond the quantile of mean distances)."""
    said = labels.select(F.col("key").alias("other"), F.col("accepted").cast("double").alias("a"))
    rows = neighbours.join(said, "other", "left").groupBy("key").agg(F.avg("distance").alias("knn_distance"), F.avg(F.coalesce("a", F.lit(0.0))).alias("knn_accept"))
    cut = rows.agg(F.percentile("knn_distance", quantile)).first()[0]
    return rows.withColumn("low_density", F.round("knn_distance", 9) >= round(cut, 9) if cut is not None else F.lit(False))


def local_outlier_factor(neighbours: DataFrame) -> DataFrame:
    """``key, factor``: how much thinner the surroundings of a row are than those of its neighbours; about 1 inside an even cloud.

    The reach of a neighbour is its distance, at least the neighbour's own distance to its last neighbour; density is one over the mean reach (with 1e-10 added, so that copies do not divide by 0).
    """
    far = neighbours.groupBy(F.col("key").alias("other")).agg(F.max("distance").alias("far"))
    reach = neighbours.join(far, "other").groupBy("key").agg((1 / (F.avg(F.greatest("distance", "far")) + 1e-10)).alias("density"))
    around = neighbours.join(reach.select(F.col("key").alias("other"), F.col("density").alias("near")), "other").groupBy("key").agg(F.avg("near").alias("near"))
    return around.join(reach, "key").select("key", (F.col("near") / F.col("density")).alias("factor"))
