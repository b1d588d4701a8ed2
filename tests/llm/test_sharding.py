import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scanlytics.llm.sharding import hypergeometric, shuffle_into_shards


def pmf(total, good, draws):
    from math import comb

    return [comb(good, x) * comb(total - good, draws - x) / comb(total, draws) for x in range(max(0, draws - total + good), min(draws, good) + 1)]


@pytest.mark.parametrize(("total", "good", "draws"), [(10, 4, 5), (100, 30, 7), (50, 50, 20), (9, 0, 4), (1000, 999, 3), (60, 25, 60), (0, 0, 0)])
def test_hypergeometric_distribution(spark, total, good, draws):
    n = 4000
    u = (F.col("id") + 0.5) / n
    got = Counter(r[0] for r in spark.range(n).select(hypergeometric(u, F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"))).collect())
    low = max(0, draws - total + good)
    for x, p in enumerate(pmf(total, good, draws)):
        assert abs(got[x + low] / n - p) < 2 / n + 1e-9
    assert sum(got.values()) == n


@pytest.mark.parametrize(("rows", "shards", "blocks"), [(1000, 24, 32), (7, 24, 4), (997, 5, 64)])
def test_exact_sizes_and_slots(spark, rows, shards, blocks):
    df = spark.createDataFrame([(i, f"é{i}" if i % 5 else None, "x") for i in range(rows)], "doc_id long, text string, shard string")
    out = shuffle_into_shards(df, shards=shards, blocks=blocks).collect()
    sizes = Counter(r.shard for r in out)
    assert sorted(r.doc for r in out) == list(range(rows))
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    for r in out:
        text = f"é{r.doc}" if r.doc % 5 else ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))


def test_uniform(spark):
    """Each document is about as likely in each shard, over seeds."""
    df = spark.createDataFrame([(i, str(i)) for i in range(300)], "doc_id long, text string")
    seen: Counter = Counter()
    for seed in range(5):
        seen.update((r.doc, r.shard) for r in shuffle_into_shards(df, shards=3, blocks=2, seed=seed * 17).collect())
    assert all(abs(sum(seen[d, s] == c for d in range(300) for s in range(3)) / 900 - p) < 0.08 for c, p in enumerate([32 / 243, 80 / 243, 80 / 243, 40 / 243, 10 / 243, 1 / 243]))


def test_edges(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b"), (1, "b")], "doc_id long, text string")
    out = shuffle_into_shards(df, shards=2, blocks=2).collect()
    assert len(out) == 5 and sorted(Counter(r.shard for r in out).values()) == [2, 3]
    assert shuffle_into_shards(df.limit(0), shards=2, blocks=2).collect() == []
