
import zlib

import numpy as np
import pytest

import corpus_pipeline
from scanlytics.llm import licenses, queries
from scanlytics.llm.tokens import Encoder, public_tokenizer
from tests.llm.test_jaccard_join import brute, ours

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, rows, schema=DOCS, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_by_the_library(spark, tmp_path, library):
    texts = ["end <|endoftext|> x", "<|endoftext|> x", "a<|endoftext|>b c", "x  <|endoftext|>\n", "<|endoftext|>", "<|endoftext| > x", "plain text of words", None]
    assert library(texts[0]) == [437, 220, 50256, 2124]
    own = Encoder(public_tokenizer(), added_tokens=True)
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode([t or "" for t in texts])] == [library(t) for t in texts]
    d = table(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    records = queries.op7_token_records(spark, d).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(records, texts, strict=True):
        ids = [*library(t), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    crcs = [zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()) for t in texts]
    for out in (queries.op10_best_fit_packing(spark, d), corpus_pipeline.packed(spark, spark.read.parquet(f"{d}/documents.parquet"), d)):
        assert [r.ids_crc32 for r in out.orderBy("doc_id").collect()] == crcs
    assert [r.n_tokens for r in queries.op6_token_counts(spark, d).collect()] == [sum(len(library(t)) + 1 for t in texts)]


def test_near_copies_without_an_id_are_linked(spark):
    def near(k):  # a chain: only neighbours are linked
        return " ".join(f"{'x' if i < 2 * k + 2 else 'w'}{i}" for i in range(80))

    def alone(k):
        return " ".join(f"y{i}" for i in range(80)) + f" z{k}" * (k > 0)

    rows = [(1, near(0)), (None, near(1)), (2, near(2)), (None, near(3)), (None, alone(0)), (None, alone(1)), (None, alone(1)), (3, "other text here"), (None, ""), (None, None)]
    assert ours(spark, rows, 3, 90) == brute(rows, 3, 90)
    assert [r[2] for r in ours(spark, rows[:4], 3, 90)] == [1] * 4
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_class(spark, docs, "").collect()]
    assert sorted(x for x in kept if x[0] is not None) == [(1, near(0)), (3, "other text here")]
    assert sum("y1 " in (t or "") for _, t in kept) == 1 and len(kept) == 5


def test_null_texts_are_no_copies(spark, tmp_path, library):
    rows = [(1, None, "en", "s", 0), (2, None, "en", "s", 0), (None, None, "en", "s", 0), (3, "a b", "en", "s", 3), (4, "a b", "en", "s", 3), (4, None, "en", "s", 0)]
    got = queries.op6_token_counts(spark, table(spark, tmp_path, rows)).collect()
    assert [(r.n_docs, r.n_tokens) for r in got] == [(5, 5 + len(library("a b")))]


def test_license_gate_takes_every_separator(spark):
    words = [c for c in map(chr, range(128)) if not c.isalnum()]
    phrases = {"in the public{}domain": "public-domain", "same{}terms as perl itself": "perl", "mit no{}attribution": "mit-0"}
    rows = [(i, p.format(c), x) for i, (c, (p, x)) in enumerate((c, px) for c in words for px in phrases.items())]
    got = {r.doc: r.labels for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [r for r in rows if got[r[0]] != r[2]] == []
