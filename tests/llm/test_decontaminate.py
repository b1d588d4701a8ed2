import re

import pytest

from scanlytics.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    runs: dict = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        if n and i is not None:
            for j in range(len(w) - n + 1):
                runs.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(r) for r in runs}:
            for j in range(len(w) - n + 1):
                if (r := tuple(w[j : j + n])) in runs:
                    hit.update(range(j, j + n))
                    found |= runs[r]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def ours(spark, docs, items):
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = out.collect()
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) for r in got)
    return sorted([(r.doc, r.n_words, r.n_hit, r["items"]) for r in got], key=str)


@pytest.mark.parametrize("few", [True, False])
def test_whole_table(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "SEND_FINGERPRINTS", 10**6 if few else 0)
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert ours(spark, docs, items) == brute(docs, items)


def test_edges(spark):
    a = " ".join(f"w{i}" for i in range(30))
    items = [(1, a), (2, "Short ITEM"), (3, "one"), (4, ""), (5, None), (None, "zz zz zz"), (11, " ".join(f"w{i}" for i in range(5, 16))), (1, "É x " * 3), (7, "a a a a")]
    docs = [(1, a.upper()), (2, a.replace(" ", "-,")), (3, "x " + " ".join(f"w{i}" for i in range(3, 12)) + " y"), (4, " ".join(f"w{i}" for i in range(3, 13))), (5, "short item! one"), (6, None), (7, ""), (None, "ONE é x é x é x"), (8, "a a a a a a a"), (8, "a a a a a a a"), (9, "É x É x É x É x"), (10, "zz zz zz")]
    assert ours(spark, docs, items) == brute(docs, items)
    assert ours(spark, docs, []) == brute(docs, [])
    assert ours(spark, [], items) == []


def test_words_are_counted_without_matching_each(spark):
    texts = [None, "", " ", "a", "--a--", "A1 b_C\tÉa'é 𝔘x\x7fy", "x" * 50, "a\u0085b c d", "1,234.5", "日本 語\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.contamination(docs, spark.createDataFrame([("i", "not in any")], "item_id string, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    assert {r.doc: r.n_words for r in out.collect()} == {i: len(word.findall(t or "")) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
