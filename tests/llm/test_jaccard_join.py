import random
import re

import pytest

from scanlytics.llm import jaccard_join
from scanlytics.llm.jaccard_join import jaccard_classes


LONG = " ".join(f"long{i}" for i in range(30_000))


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for group in by.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[top(i)] = top(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def ours(spark, rows, n, percent):
    df = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent)
    return sorted([(r.doc, r.n_shingles, r.component) for r in df.collect()], key=str)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_whole_table(spark, n, percent):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert ours(spark, rows, n, percent) == brute(rows, n, percent)


def near_copies(rng, count, words, changes):
    """Texts that differ from one base, which is not among them, in some places of their own."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(count):
        other = list(base)
        for _ in range(rng.randrange(*changes)):
            other[rng.randrange(words)] = f"v{i}{rng.random()}"
        out.append(" ".join(other))
    return out


@pytest.mark.parametrize("region", [8, 32])
def test_regions_are_divided(spark, monkeypatch, region):
    """A chain of near copies and groups around texts that are missing, with regions small enough to recurse."""
    monkeypatch.setattr(jaccard_join, "REGION", region)
    rng = random.Random(5)
    texts, text = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        text[rng.randrange(120)] = f"c{i}"
        texts.append(" ".join(text))
    texts += near_copies(rng, 80, 120, (1, 5)) + near_copies(rng, 60, 40, (0, 4)) + [f"the same line of words again and again for all {i % 50} {i}" for i in range(100)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert ours(spark, rows, 2, 80) == brute(rows, 2, 80)


def test_near_copies_that_are_not_linked(spark):
    """5000 copies within reach of a text that is missing, but not of each other: no class, and no pairs of all with all."""
    rng = random.Random(3)
    rows = list(enumerate(near_copies(rng, 5000, 200, (4, 5))))
    got = ours(spark, rows, 3, 90)
    sets = [shingles(t, 3) for _, t in rows]
    classes = {d: c for d, _, c in got}
    by: dict = {}
    for d, c in classes.items():
        by.setdefault(c, []).append(d)
    for group in by.values():  # whatever is linked is near something of its class
        assert len(group) == 1 or all(any(10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]) for j in group if j != i) for i in group)
    for i in rng.sample(range(5000), 60):  # and what is near has been linked
        for j in range(5000):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                assert classes[i] == classes[j]


def test_sets_that_share_a_hash(spark):
    rng = random.Random(8)
    rows = list(enumerate(near_copies(rng, 40, 60, (0, 3)) + [f"alone {i} {i + 1} {i}" for i in range(60)]))
    want = brute(rows, 3, 90)
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90, node_bits=5)
    assert sorted([(r.doc, r.n_shingles, r.component) for r in got.collect()], key=str) == want


def test_edges(spark):
    rows = [(4, None), (3, ""), (2, " \n"), (9, "A b"), (8, "a  B"), (None, "a b"), (7, "a"), (6, "a"), (6, "a"), (None, "x y z q"), (1, "a b c"), (30, LONG), (None, LONG + " end"), (31, LONG + " other end"), (None, "only null ids " * 30), (None, "only null ids " * 30 + "x")]
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert ours(spark, [], 3, 90) == []
