import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from scanlytics.llm.shared import written

D = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumns({"size": F.lit("own"), "key": F.lit(7), "doc": F.lit(None).cast("string")})
    names, before = docs.columns, docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, D), "t")
        assert after.columns == names and 0 < after.count() <= before, name
        if name == "quality_classifier":
            kept = {r.doc_id for r in after.collect()}
            clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
            assert sum(d in kept for d in clean) >= 0.9 * len(clean)
        if name == "jaccard_join":
            assert after.select("text").distinct().count() == after.count()
        docs, before = after, after.count()
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    runs = {" ".join(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        assert not any(" ".join(w[i : i + 10]) in runs for i in range(len(w) - 9))
    out = P.STAGES[-1][1](spark, docs, D)
    assert out.columns[0] == "doc_id" and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_odd_rows(spark, stage):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", None, 0), (3, "x " * 3000, "en", "s", 6000), (3, "x " * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = stage[1](spark, docs, D).collect()
    assert got
    if stage[0] != "best_fit_packing":
        odd = docs.withColumns({c: F.lit(c) for c in ("q_keep", "dd_text", "dd_n_removed", "__key", "__doc", "__c0", "group", "component", "key", "contaminated", "other_3")})
        again = stage[1](spark, odd, D)
        assert again.columns == odd.columns
        assert sorted([tuple(r)[:5] for r in again.collect()], key=str) == sorted(map(tuple, got), key=str)
        assert all(r["q_keep"] == "q_keep" and r["__key"] == "__key" and r["dd_text"] == "dd_text" for r in again.collect())
    assert stage[1](spark, docs.limit(0), D).collect() == []
