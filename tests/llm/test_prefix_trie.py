import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from scanlytics.llm import queries
from scanlytics.llm.prefix_trie import conversation_trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = c - int(c / 20) * 20
        built[c] = own.get(c - lead, [])[:h] + v[h:] if rebuild else v
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        worth = (len(who) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += worth
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(spark, rows, **how):
    return sorted((tuple(r) for r in conversation_trie(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def test_odd_rows(spark):
    rows = [(0, None, "u", "hi there"), (0, 1, "a", None), (0, 0, None, "x y z"), (0, 0, None, "x y z"), (1, 5, "u", "solo"), (None, 1, "u", "lost"), (-3, 0, "u", "hi there"), (-3, 1, "é", "w" * 3000), (41, 0, "", ""), (23, 0, "u", "one")]
    rows += [(20 + i, t, "u", f"say {t}") for i in range(6) for t in range(i)] + [(60, 0, "u", "a"), (61, 0, "u", "a"), (62, 0, "u", "a\x00b")]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows, rebuild=False) == brute(rows, False)


def test_deep_and_frequent(spark):
    rng = random.Random(1)
    rows = [(c, t, "u", f"say {t % 3}") for c in range(400) for t in range(rng.choice((1, 2, 3, 8, 9)))]
    rows += [(1000, t, "u", "on and on") for t in range(130)] + [(1020, t, "u", "on and on" if t < 100 else f"off {t}") for t in range(300)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows, rebuild=False) == brute(rows, False)


@pytest.mark.parametrize("rebuild", [True, False])
def test_empty_and_clashing_columns(spark, rebuild):
    assert ours(spark, [], rebuild=rebuild) == []
    df = spark.createDataFrame([(1, 0, "u", "a b", 5, 6, 7)], "conv_id long, turn long, role string, text string, conv int, at int, name int")
    assert conversation_trie(df, rebuild=rebuild).count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_prefix_trie(spark, f"/root/testdata/{sf}").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
