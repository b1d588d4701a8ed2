import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanlytics.llm import ann, quality, token_counts
from scanlytics.llm.tokens import public_tokenizer

D = "/root/testdata/sf0.01"
LARGE = "/root/testdata/check_l/embeddings.parquet"


def exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x[i] * x).sum(1)
        s[i] = -np.inf
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        true = dict(want[q])
        assert all(abs(true[v] - s) < 1e-12 for v, s in found if v in true)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-3.0, 1.0]), (8, [2.0, 5.0]), (8, [2.0, 5.0]), (None, [9.0, 9.0]), (40, None), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 2.0), (0, 2, 8, 2.0), (0, 3, 1, 1.0), (20, 1, 8, 2.0), (20, 2, 8, 2.0), (20, 3, 0, 1.0)]
    assert ann.nearest(df.limit(0), df).collect() == []
    # an odd dimension takes no part; other rows of a query's id do, and so do clashing columns
    odd = spark.createDataFrame([(0, [1.0], 1), (0, [1.0, 2.0], 2), (0, [1.0, 3.0], 3), (1, [0.5, 2.0], 4)], "vec_id long, embedding array<double>, score int").withColumns({"list": F.lit(1), "v": F.lit("x"), "rank": F.lit(2)})
    got = [(r.query_id, r.vec_id, r.score) for r in ann.nearest(odd, odd.where("vec_id = 0"), k=5).collect()]
    assert sorted(got) == [(0, 0, 7.0), (0, 0, 7.0), (0, 1, 4.5), (0, 1, 6.5)]


@pytest.mark.parametrize(("n", "structured"), [(50_000, False), (200_000, False), (400_000, False), (50_000, True)])
def test_recall_on_tables_made_here(spark, n, structured):
    """Vectors without structure, and clustered ones: recall of at least 0.9, and lists are pruned."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    if structured:
        x = rng.normal(size=(300, 64)).astype(np.float32)[rng.integers(0, 300, n)] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    df = spark.createDataFrame(table)
    asked = df.where(f"vec_id % {n // 200} = 7")
    probes = []
    real = ann._limits
    ann._limits = lambda *a: probes.append(real(*a)) or probes[-1]
    try:
        found: dict = {}
        for r in ann.nearest(df, asked).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        ann._limits = real
    right = []
    for i in range(7, n, n // 200):
        s = x[i].astype(float) @ x.T.astype(float)
        s[i] = -np.inf
        right.append(len(found[i] & set(np.argpartition(-s, 20)[:20].tolist())) / 20)
    print(n, structured, "recall", np.mean(right), "limits", probes)
    assert np.mean(right) >= 0.9 and probes[0][0] < n // ann.LIST_ROWS


def test_exact_search_of_all_lists(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), lists=40, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [v for v, _ in w[:20]] for q, w in want.items()}


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs a table of 50,000 vectors")
def test_recall_where_lists_are_pruned(spark):
    df = spark.read.parquet(LARGE)
    x = {r.vec_id: r.embedding for r in df.collect()}
    ids, x = np.array(list(x)), np.array(list(x.values()), float)
    asked = df.where("vec_id % 400 = 0")
    got: dict = {}
    for r in ann.nearest(df, asked).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = []
    for i in np.flatnonzero(ids % 400 == 0):
        s = x[i] @ x.T
        s[i] = -np.inf
        right.append(len(got[int(ids[i])] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert len(ids) > 50_000 and np.mean(right) >= 0.9
    top = np.sqrt((x**2).sum(1).max())
    part = x[:: max(1, len(x) // 16_384)]
    centres = ann.fit_centroids(np.c_[part, np.sqrt(np.maximum(top**2 - (part**2).sum(1), 0))], len(x) // ann.LIST_ROWS)
    some = x[ids % 400 == 0]
    _, away = ann.graph_search(np.c_[some, np.zeros(len(some))], centres, ann.neighbour_graph(centres), 104)
    assert ann.chosen_lists(away, 96, 1.15).sum(1).mean() < 0.4 * len(centres)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    test = (F.xxhash64("doc_id") % 3) == 0
    model = quality.fit_quality_model(docs, labels.where(~test))
    rows = quality.score_quality(docs, model).join(labels.where(test), "doc_id").collect()
    good = np.array([r.quality for r in rows])
    for column, truth, least in (("q_quality", good, 0.9), ("q_toxic", np.array([r.toxic for r in rows]), 0.9)):
        s = np.array([r[column] for r in rows])
        a, b = s[truth == 1], s[truth == 0]
        assert (a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2 >= least
    clean = [r.q_keep for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) >= 0.97


def test_views_teach_each_other(spark):
    """Labelled documents have no source, so only the exchange can teach the metadata view what sources say."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        good = i % 2
        text = " ".join([*rng.choice(words, 30), *(["fine", "clear"] if good else ["junk", "dirty"])])
        rows.append((i, text, "en", None if i < 200 else ("library" if good else "farm")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, None if i % 3 else 0) for i in range(200)], "doc_id long, quality int, toxic int")
    gap = []
    for rounds in (0, 3):
        model = quality.fit_quality_model(docs, labels, rounds=rounds)
        said = model.quality.meta.logit(quality.metadata(*quality.buckets(["en", "en"], ["library", "farm"]), np.array([200, 200])))
        gap.append(said[0] - said[1])
    assert abs(gap[0]) < 0.1 and gap[1] > 1
    few = quality.fit_quality_model(docs, labels, rounds=1, pseudo=4)  # the same exchange, whatever the partitions
    again = quality.fit_quality_model(docs.repartition(7), labels, rounds=1, pseudo=4)
    assert np.allclose(few.quality.meta.weight, again.quality.meta.weight)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (None, "", "en", "s", "y"), (2, "w " * 9000, "en", "s", "z"), (2, "w " * 9000, "en", "s", "z")], "doc_id long, text string, lang string, source string, q_keep string")
    model = quality.fit_quality_model(docs, spark.createDataFrame([(1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    assert [r.q_quality for r in quality.score_quality(docs, model).collect()] == [1.0] * 4
    assert quality.score_quality(docs.limit(0), quality.fit_quality_model(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []
    full = quality.fit_quality_model(*[spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels")])
    got = quality.score_quality(docs, full).collect()
    assert len(got) == 4 and all(0 <= r.q_quality <= 1 for r in got)


def test_rollup(spark):
    rows = [("a", "en", "t1", 1, 10), ("a", "en", "t1", 1, 5), (None, "en", "t1", 1, None), ("b", "fr", "t2", 1, 7)]
    changes = spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    rollup = token_counts.TokenRollup(spark)
    assert rollup.totals().collect() == []
    assert rollup.commit("one", changes) and not rollup.commit("one", changes)
    assert rollup.commit("none", changes.limit(0))
    back = changes.where("source = 'b'").withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})
    assert rollup.commit("two", back)
    assert rollup.commit("odd/name.. %2F é", changes.limit(0)) and not rollup.commit("odd/name.. %2F é", changes)
    assert rollup.batches() == ["none", "odd/name.. %2F é", "one", "two"]
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == [("a", "en", "t1", 2, 15), (None, "en", "t1", 1, 0)]


def test_versions_are_counted_apart(spark):
    docs = spark.createDataFrame([("s", "en", "a b", 9), ("s", "en", "c <|endoftext|>", 9)], "source string, lang string, text string, n_tokens int")
    rollup = token_counts.TokenRollup(spark)
    for version, added in (("v1", True), ("v2", False)):
        rollup.commit(version, token_counts.inserts(token_counts.count_tokens(docs, public_tokenizer(), added_tokens=added), version))
    got = {r.tokenizer: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert got["v1"] == (2, 5) and got["v2"][0] == 2 and got["v2"][1] > 5


def test_counts_query_against_brute_force(spark):
    from tokenizers import Tokenizer

    from scanlytics.llm.queries import op6_token_counts

    tool = Tokenizer.from_file(public_tokenizer())
    want: dict = {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    first: dict = {}
    for r in docs:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    for r in docs:
        if first[r.text] == r.doc_id:
            n = want.setdefault((r.source, r.lang), [0, 0])
            n[0] += 1
            n[1] += len(tool.encode(r.text, add_special_tokens=False).ids) + 1
    got = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_rollup_survives_a_stop_at_every_step(spark, monkeypatch):
    changes = spark.createDataFrame([("s", "en", "v", 1, 10)], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
    total = lambda r: [tuple(x)[3:] for x in r.totals().collect()]

    class Stop(Exception):
        pass

    def stopping(at, step):
        """``step`` with a stop at its ``at``-th call of the file system."""
        count = [0]
        real = token_counts._fs

        def fs(session, path):
            count[0] += 1
            if count[0] > at:
                raise Stop
            return real(session, path)

        monkeypatch.setattr(token_counts, "_fs", fs)
        try:
            step()
            return True
        except Stop:
            return False
        finally:
            monkeypatch.setattr(token_counts, "_fs", real)

    rollup = token_counts.TokenRollup(spark)
    assert rollup.commit("one", changes)
    for at in range(9):
        stopping(at, lambda: rollup.commit(f"two-{at}", changes))
        rollup.commit(f"two-{at}", changes)
        assert total(rollup) == [(at + 2, 10 * (at + 2))]
    fs, place = token_counts._fs(spark, rollup.path)
    for torn in (b"", b"rows-12"):
        out = fs.create(place(f"{rollup.path}/torn{len(torn)}.commit"), False)
        out.write(bytearray(torn))
        out.close()
        assert f"torn{len(torn)}" not in rollup.batches() and rollup.commit(f"torn{len(torn)}", changes) and not rollup.commit(f"torn{len(torn)}", changes)
    assert total(rollup) == [(12, 120)]
    for at in range(9):
        stopping(at, rollup.compact)
        assert total(rollup) == [(12 + at, 120 + 10 * at)]
        assert rollup.commit(f"three-{at}", changes) and not rollup.commit("one", changes)
    while rollup.compact():
        pass
    assert total(rollup) == [(21, 210)] and len(rollup.batches()) == 21 and rollup._files(".commit") == [] and not rollup.commit("torn0", changes)
    assert token_counts.TokenRollup(spark).totals().collect() == [] and not token_counts.TokenRollup(spark).compact()
