"""The registered queries: each applies an operator to its whole table and returns the agreed digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard_join, licenses, packing, periodic_runs, prefix_trie, quality, sharding, substring_dedup, suffix_dedup, token_counts, token_records
from .shared import text_key, written
from .tokens import public_tokenizer

VERSION = "byte_bpe_50k"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_read(spark, sf_dir, "documents"), k=13)
    return out.select("doc_id", F.col("dd_n_words").alias("n_words"), F.col("dd_n_removed").alias("n_removed"), F.col("dd_kept_sha256").alias("kept_sha256"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit_quality_model(docs, _read(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model)
    return out.select("doc_id", F.col("q_quality").alias("score"), F.col("q_p_content").alias("content_score"), F.col("q_p_meta").alias("metadata_score"), F.col("q_toxic").alias("toxic_score"), F.col("q_keep").alias("keep"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), span=10)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(_read(spark, sf_dir, "documents"), shards=24)
    return out.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of a corpus in batches: inserts by part, one of them sent twice; counts revised for an end
    token; and deletes of exact copies of a document with a smaller id. Null texts are no copies. Returns the totals."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("text").isNotNull(), text_key(F.col("text"))).alias("key"), "text")
    counted = written(token_counts.count_tokens(docs, public_tokenizer()), "counts")
    rollup = token_counts.TokenRollup(spark)
    for part in (0, 1, 2, 3, 1):
        rollup.commit(f"load-{part}", token_counts.inserts(counted.where(F.pmod("doc_id", F.lit(4)) == part), VERSION))
    rollup.commit("load-unnamed", token_counts.inserts(counted.where("doc_id is null"), VERSION))
    rollup.commit("end-token", token_counts.revisions(counted.withColumn("new_tokens", F.col("n_tokens") + 1), VERSION))
    first = counted.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first.select(F.col("first").alias("doc_id")), "doc_id", "left_anti").where("doc_id is not null and key is not null")
    rollup.commit("copies", token_counts.deletes(copies.withColumn("n_tokens", F.col("n_tokens") + 1), VERSION))
    return rollup.totals()


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_records.tokenized_files(_read(spark, sf_dir, "documents"), public_tokenizer())
    return out.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_classes(_read(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizer())
    return out.select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(_read(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(_read(spark, sf_dir, "documents"), alter=True)
    return out.select(F.col("doc").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [op1_substring_dedup, op2_nearest_vectors, op3_quality, op4_decontaminate, op5_shards, op6_token_counts, op7_token_records, op8_licenses, op9_jaccard_join, op10_best_fit_packing, op11_prefix_trie, op12_suffix_dedup, op13_periodic_runs]
    return {f.__name__: f for f in made} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express on whole tables in a reasonable time; the others have brute-force tests."""
    return {"op4_decontaminate": _OP4, "op11_prefix_trie": _OP11}


_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
runs AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM runs),
places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS run FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT p.r, p.i, p.n, p.run FROM places p JOIN runs USING (n, run)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
held AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits JOIN runs USING (n, run) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

_OP11 = r"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, count(*) AS n, c - c % 20 AS lead, xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM own GROUP BY c),
turns AS (SELECT ids.c, i AS p, role, text FROM ids JOIN own ON own.c = lead AND i < h
  UNION ALL SELECT ids.c, i - h + least(h, coalesce(l.n, 0)), role, text FROM ids JOIN own ON own.c = ids.c AND i >= h LEFT JOIN (SELECT c AS head, n FROM ids) l ON head = lead),
seqs AS (SELECT ids.c, coalesce(t, []) AS t FROM ids LEFT JOIN (SELECT c, list({'key': sha256(length(role) || ':' || role || text), 'words': len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))} ORDER BY p) AS t FROM turns GROUP BY c) s ON s.c = ids.c),
pre AS (SELECT c, d, sha256(array_to_string(list_transform(t[1:d], lambda x: x.key), ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(t[1:d - 1], lambda x: x.key), ',')) END AS up, CASE WHEN d > 0 THEN t[d].words ELSE 0 END AS words, d = len(t) AS ends FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM seqs)),
nodes AS (SELECT node, d, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS worth, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS sha FROM pre GROUP BY node, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
whole AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids FROM nodes LEFT JOIN kids ON kids.up = nodes.node AND kids.d = nodes.d),
sums AS (SELECT p.node, p.d, count(*) FILTER (WHERE w.kids = 0) AS leaves, sum(w.worth) AS saved FROM whole w JOIN pre p ON p.c = w.c AND p.d <= w.d GROUP BY p.node, p.d)
SELECT w.c AS conv_id, w.d AS depth, u.c AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, w.sha AS ends_sha256
FROM whole w JOIN sums USING (node, d) LEFT JOIN whole u ON u.node = w.up AND u.d = w.d - 1
"""
