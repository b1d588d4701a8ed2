"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return the columns of ``docs``; columns beyond ``doc_id, text, lang, source, n_chars`` pass
through whatever their names. Empty tables pass through every stage. Equal rows get equal decisions, and very
long texts are taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlytics.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from scanlytics.llm.shared import new_path, text_key
from scanlytics.llm.tokens import public_tokenizer

#: SQL cannot express the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Hides the names of all other columns from a stage, so that they clash with none of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"other_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@_carrying
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier calls poor or toxic. Null texts are scored as empty ones."""
    model = quality.fit_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model, carry=docs.columns).where("q_keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def _same_row(docs: DataFrame, other: DataFrame):
    return docs["doc_id"].eqNullSafe(other["__doc"]) & text_key(docs["text"]).eqNullSafe(other["__key"])


@_carrying
def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near duplicates (five words, similarity 0.8).

    Texts without words are no copies of anything and stay. Rows without an id go where their class has one
    with an id; of a class without any, one row stays. Of rows with one id and one text, one stays.
    """
    classes = jaccard_join.jaccard_classes(docs, n=5, percent=80)
    named = classes.where("doc <=> component and (doc is not null or group is null)").select("doc", "key")
    unnamed = classes.where("component is null and group is not null").groupBy("group").agg(F.min("doc").alias("doc"), F.min("key").alias("key")).select("doc", "key")
    chosen = named.unionByName(unnamed).select(F.col("doc").alias("__doc"), F.col("key").alias("__key")).distinct()
    return docs.join(chosen, _same_row(docs, chosen), "left_semi").withColumn("__key", text_key(F.col("text"))).dropDuplicates(["doc_id", "__key"]).drop("__key")


@_carrying
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 13 words or more that an earlier document has; documents of which nothing stays go.

    Null texts and rows without an id stay as they are; equal rows are cut alike.
    """
    names = docs.columns
    out = substring_dedup.dedup_substrings(docs, k=13, keep=names)
    text = F.col("dd_text")
    made = {"text": text, "n_chars": F.when(F.col("dd_n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {"text": text}
    return out.where("dd_n_removed = 0 or dd_n_removed < dd_n_words").withColumns(made).select(*[F.col(f"`{c}`") for c in names])


@_carrying
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a run of ten words of a benchmark item (or a whole shorter item). Null texts hold none."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=10)
    bad = found.where("contaminated").select(F.col("doc").alias("__doc"), F.col("key").alias("__key")).distinct()
    return docs.join(bad, _same_row(docs, bad), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A null text is one end token; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizer()).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("jaccard_join", one_of_each_class),
    ("substring_dedup", cut_repeats),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
