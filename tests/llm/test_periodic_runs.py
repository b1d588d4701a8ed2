import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from scanlytics.llm import queries
from scanlytics.llm.periodic_runs import periodic_runs, runs_of

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute_runs(w, shortest=12):
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            if i - start >= max(shortest, 2 * q):
                found.setdefault((start, i - start), q)  # the smallest period comes first
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc, text, alter):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if alter and doc is not None and w:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs, gone = brute_runs(w), set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_words():
    rng = random.Random(3)
    for size in (0, 1, 5, 30, 80):
        for letters in (1, 2, 3, 5):
            for _ in range(30):
                w = [rng.randrange(letters) for _ in range(size)]
                assert runs_of(w, 4) == brute_runs(w, 4)
    for _ in range(60):
        root = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        w = (root * 9)[: rng.randrange(50)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w) + 1) :] += [rng.randrange(4)] + w
        assert runs_of(w[:200]) == brute_runs(w[:200])


def test_edges(spark):
    line = "one two three four five six seven "
    rows = [(1, line * 6), (2, None), (3, ""), (None, line * 9), (5, "a " * 5000), (6, "a b " * 6), (7, "a b " * 5 + "a"), (1, line * 6), (1, "x"), (12, line + "x " + line + "y " + line * 3 + line[:9])]
    rows += [(i, f"w{i} " * 3 + " ".join(f"t{j * i % 17}" for j in range(90))) for i in range(20, 80)] + [(90, "é b  c\td\n" * 40), (91, "w" * 30000)]
    for alter in (False, True):
        got = [tuple(r) for r in periodic_runs(spark.createDataFrame(rows, SCHEMA), alter=alter).collect()]
        assert sorted(got, key=str) == sorted((brute(*r, alter) for r in rows), key=str)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 9, "u", 5)], "doc_id long, text string, doc string, mark int")
    assert [r.n_runs for r in periodic_runs(df).collect()] == [1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, f"/root/testdata/{sf}").collect()}
    for doc, text in docs.collect():
        if len(text or "") > 40_000:
            continue  # the plain version takes the square of the words
        want, r = brute(doc, text, True), got[doc]
        assert (doc, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (want[0], *want[2:])
    assert len(got) == docs.count()
