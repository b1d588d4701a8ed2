import hashlib
import re

import pytest
from pyspark.sql import types as T

from scanlytics.llm import substring_dedup
from scanlytics.llm.substring_dedup import dedup_substrings

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(rows, k=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and least[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, **how):
    df = dedup_substrings(spark.createDataFrame(rows, SCHEMA), **how)
    return sorted([tuple(r)[:4] for r in df.collect()], key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("k", [2, 3, 13])
def test_edges(spark, k):
    a = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(5, a), (3, a.replace(" ", "\n")), (9, "x " + a + " y z"), (None, a), (7, None), (8, ""), (5, a), (5, "b c d e"), (11, "é " * 40), (12, "é " * 39 + "w" * 5000), (13, "a a a a " * 50), (2, "a a a")]
    assert ours(spark, rows, k=k) == brute(rows, k)


def test_kept_text_and_other_columns(spark):
    rows = [(1, "p q r s", "u"), (2, "x  y\np q r s z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dd_text string")
    got = {r[0]: tuple(r) for r in dedup_substrings(df, k=4, keep=["doc_id"]).collect()}
    assert got[1][4] == "p q r s" and got[2][4] == "x  y z"


def test_empty(spark):
    assert ours(spark, []) == []


def test_a_slice_is_gone_before_the_next_one(monkeypatch):
    import weakref

    import numpy as np
    import pyarrow as pa

    seen, alive = [], []

    class Counted(substring_dedup.Words):
        def __init__(self, *args, **options):
            alive.append(sum(w() is not None for w in seen))
            super().__init__(*args, **options)
            seen.append(weakref.ref(self))

    monkeypatch.setattr(substring_dedup, "Words", Counted)
    batch = lambda i: pa.RecordBatch.from_pydict({"doc": [i], "key": [i], "text": [" ".join(f"w{j}" for j in range(40))]})
    out = list(substring_dedup._cutter(13, 2, 4, np.zeros(0, np.uint64))(batch(i) for i in range(3)))
    assert len(out) == 3 and alive == [0, 0, 0]
