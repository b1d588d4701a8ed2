"""Models over labelled feature tables, on Spark ML, and statistics that rank features. All fits are seeded."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .cohorts import group_folds

LEAKS = ("label", "decision")  # columns, and prefixes with a dot or underscore, that would tell the label


def prepare(rows: DataFrame, numbers: list[str], names: list[str], building: str = "building_uuid") -> DataFrame:
    """``building, label, weight, features``: numbers with the median in gaps, codes of names, and a weight of 1 over a building's rows. Rows without a building only count for medians and codes."""
    kept = [c for c in numbers if c not in LEAKS and not any(c.startswith((f"{x}_", f"{x}.")) for x in LEAKS)]
    rows = rows.select(building, F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in kept], *names)
    steps = [Imputer(strategy="median", inputCols=kept, outputCols=[f"{c}__full" for c in kept])]
    steps += [StringIndexer(inputCol=c, outputCol=f"{c}__code", handleInvalid="keep") for c in names]
    steps.append(VectorAssembler(inputCols=[f"{c}__full" for c in kept] + [f"{c}__code" for c in names], outputCol="features", handleInvalid="keep"))
    full = Pipeline(stages=steps).fit(rows).transform(rows)
    share = (1.0 / F.count("*").over(Window.partitionBy(building))).alias("weight")  # not joined: counts of all buildings would be broadcast from the driver
    return full.where(F.col(building).isNotNull()).select(building, "label", share, "features")


def oof_scores(rows: DataFrame, folds: int = 5, building: str = "building_uuid", rounds: int = 10) -> DataFrame:
    """Every row with ``fold, boosted, tree``: the probabilities of models that were fitted without its fold; a building lies in one fold.

    Rows are written and read back in large splits: each of a fit's many jobs sends the driver one result a split.
    """
    rows = written(group_folds(rows, building, folds), "folds")
    out = []
    for k in range(folds):
        rest, mine = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        for name, tool in (("boosted", GBTClassifier(maxIter=rounds, maxDepth=4, weightCol="weight", seed=7)), ("tree", DecisionTreeClassifier(maxDepth=4, weightCol="weight", seed=7))):
            mine = tool.fit(rest).transform(mine).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        out.append(mine)
    return reduce(lambda a, b: a.unionByName(b), out)


def calibrated(scored: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """Adds the score on the label's scale, by isotonic regression, between 0 and 1."""
    model = IsotonicRegression(featuresCol=score, labelCol="label", weightCol="weight", predictionCol=name).fit(scored.select(score, "label", "weight"))
    return model.transform(scored).withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), name)))


def reject_leaves(rows: DataFrame, depth: int = 4, support: int = 50, purity: float = 0.95) -> DataFrame:
    """Leaves of one tree with enough rows of which nearly all are rejected (label 0): ``leaf, n, purity``, ranked by both."""
    model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", leafCol="leaf", seed=7).fit(rows)
    leaves = model.transform(rows).groupBy("leaf").agg(F.count("*").alias("n"), F.avg((F.col("label") == 0).cast("double")).alias("purity"))
    good = leaves.where((F.col("n") >= support) & (F.col("purity") >= purity))
    return good.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("n") * F.col("purity")), "leaf")))  # 2^depth rows at most


def archetypes(rows: DataFrame, key: str, features: list[str], k: int = 6) -> tuple[DataFrame, PipelineModel]:
    """``key, cluster`` by k-means on scaled features (gaps: the median)."""
    wide = rows.select(key, *[F.col(c).cast("double").alias(c) for c in features])
    steps = [Imputer(strategy="median", inputCols=features, outputCols=[f"{c}__full" for c in features]), VectorAssembler(inputCols=[f"{c}__full" for c in features], outputCol="raw")]
    steps += [StandardScaler(withMean=True, inputCol="raw", outputCol="features"), KMeans(k=k, seed=7, predictionCol="cluster")]
    model = Pipeline(stages=steps).fit(wide)
    return model.transform(wide).select(key, "cluster"), model


def fit_quality(rows: DataFrame, features: list[str], penalty: float = 1.0) -> tuple[dict[str, tuple[float, float, float]], float]:
    """A ridge model of ``rating`` on scaled features: ``{feature: (mean, std, weight)}`` and the intercept, as ``score_quality`` takes them."""
    wide = rows.select(F.col("rating").try_cast("double").alias("rating"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]).where("rating is not null")
    facts = wide.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = wide.select("rating", *[((F.col(c) - facts[f"m_{c}"]) / (facts[f"s_{c}"] or 1.0)).alias(c) for c in features])
    count = scaled.count()
    model = LinearRegression(labelCol="rating", regParam=penalty / count, elasticNetParam=0.0, standardization=False, solver="normal").fit(VectorAssembler(inputCols=features, outputCol="features").transform(scaled))
    return {c: (facts[f"m_{c}"], facts[f"s_{c}"], float(w)) for c, w in zip(features, model.coefficients, strict=True)}, float(model.intercept)


def rank_features(rows: DataFrame, numbers: list[str], weight: str = "weight") -> DataFrame:
    """Per feature the weighted means of both labels and Cohen's d (difference over pooled deviation), ranked by its size."""
    long = rows.select("label", weight, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("m")).select("label", weight, "m.*").where("v is not null")
    w, v = F.col(weight), F.col("v")
    side = long.groupBy("feature", "label").agg(F.sum(w).alias("w"), (F.sum(w * v) / F.sum(w)).alias("mean"), (F.sum(w * v * v) / F.sum(w)).alias("square"))
    side = side.withColumn("var", F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    one = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
    both = side.groupBy("feature").agg(*[one(i, c).alias(f"{c}_{i}") for i in (0, 1) for c in ("mean", "var", "w")])
    pooled = F.sqrt((F.col("var_0") * F.col("w_0") + F.col("var_1") * F.col("w_1")) / (F.col("w_0") + F.col("w_1")))
    both = both.withColumn("cohens_d", F.when(pooled > 1e-12, (F.col("mean_1") - F.col("mean_0")) / pooled))
    return both.select("feature", "mean_0", "mean_1", "cohens_d").withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("cohens_d")), "feature")))  # a row for each feature


def cramers_v(rows: DataFrame, names: list[str]) -> DataFrame:
    """``feature, cramers_v``: how strongly each category goes with the label, 0 to 1."""
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in names])).alias("m")).select("label", "m.*")
    cell = long.groupBy("feature", "v", "label").agg(F.count("*").alias("n"))
    row, column, total = (cell.groupBy("feature", *by).agg(F.sum("n").alias(name), F.count_distinct(other).alias(f"{name}_kinds")) for by, name, other in ((["v"], "r", "label"), (["label"], "c", "v"), ([], "t", "v")))
    kinds = cell.groupBy("feature").agg(F.count_distinct("v").alias("a"), F.count_distinct("label").alias("b"))
    # chi square is n (sum of n_ij^2 / (r_i c_j) - 1): cells without rows add nothing
    chi = cell.join(row.select("feature", "v", "r"), ["feature", "v"]).join(column.select("feature", "label", "c"), ["feature", "label"]).join(total.select("feature", "t"), "feature")
    chi = chi.groupBy("feature").agg((F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))) - 1).alias("x"))
    return chi.join(kinds, "feature").select("feature", F.when((F.col("a") > 1) & (F.col("b") > 1), F.sqrt(F.greatest(F.lit(0.0), F.col("x")) / (F.least("a", "b") - 1))).otherwise(0.0).alias("cramers_v"))
