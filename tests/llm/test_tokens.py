import random
import zlib

import numpy as np
import pytest

from scanlytics.llm import packing, token_records
from scanlytics.llm.shared import new_path, written
from scanlytics.llm.tokens import Encoder, public_tokenizer

ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n b", "x  y", "x  y", "don't we'll 's", "é Ünï 中文 テスト", "\n", "\n\na", "\u3000\na", ",\n\tb", "x,\ny;\r\nz", "it's't 9th (a)b, 'tis", "a1b2", "\na", "a\tb c", "1 22 333,4", "a | b | c", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "end <|endoftext|>", " lead", "“ quoted ” text", "a \u2003b", "a \u205f", "a \u3000 c \xa0", "x \x85y", " x 　y", "w" * 3000, "a  " * 40, "\x1c \x85"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_library(spark, plain):
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    own = Encoder(public_tokenizer())
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [plain(x) for x in texts]


def test_encoder_on_random_texts(plain):
    rng = random.Random(4)
    parts = ["a", "Word", " ", " ", "  ", "\n", "\t", ",", "'", "'s", "'ll", "1", "é", "中", "\u00a0", "\u3000", "(", "...", "<|endoftext|>", "\x1c", "x1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(5000)]
    own = Encoder(public_tokenizer())
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [plain(x) for x in texts]


def test_records_round_trip(spark, plain, monkeypatch):
    monkeypatch.setattr(token_records, "FILE_BYTES", 4000)
    rows = [(i * 7 % 31, t) for i, t in enumerate(ODD)] + [(None, "null id"), (500, None), (500, "twice"), (500, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in token_records.tokenized_files(df, public_tokenizer()).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array([*plain(r[1]), 0], "<u4").tobytes())) for r in rows)
    assert sorted((g[0] if g[0] is not None else -1, g[3]) for g in got) == want
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]


def test_shuffled_read_and_damage(spark, plain):
    df = spark.createDataFrame([(i, f"text {i} " * i) for i in range(50)], "doc_id long, text string")
    path = new_path(spark, "t")
    index = token_records.write_token_records(df, public_tokenizer(), path)
    some = index.where("doc % 7 = 3").orderBy("size", ascending=False)
    got = {r.doc: r.ids for r in token_records.read_token_records(some, path, with_ids=True).collect()}
    assert got == {i: [*plain(f"text {i} " * i), 0] for i in range(3, 50, 7)}
    record = bytearray(token_records.frame(b"payload"))
    for i in range(len(record)):
        bad = bytearray(record)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(bytes(bad))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_records.tokenized_files(df, public_tokenizer()).collect() == []
    assert packing.pack_documents(df, public_tokenizer()).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    histogram: dict[int, int] = {}
    for _ in range(20000):
        x = min(1024, max(1, int(rng.lognormvariate(5 + seed / 2, 1))))
        histogram[x] = histogram.get(x, 0) + 1
    rows = packing.plan(histogram)
    have: dict[int, set] = {}
    where: dict[int, list] = {}
    for x, lo, hi, base, offset in rows:
        for r in range(lo, hi):
            assert r not in have.setdefault(x, set())
            have[x].add(r)
            where.setdefault(base + r - lo, []).append((offset, x))
    assert {x: len(s) for x, s in have.items()} == histogram and all(max(s) == len(s) - 1 for s in have.values())
    for parts in where.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x
        assert at <= 1024
    least = -(-sum(x * n for x, n in histogram.items()) // 1024)
    assert len(where) <= 1.03 * least + 3
    runs, rooms = {}, []
    for x in sorted(histogram, reverse=True):
        packing._fit(runs, rooms, x, 0, histogram[x], 1024)
    assert len(where) <= packing._size(runs)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_no_more_sequences_than_best_fit(spark, sf):
    cut = packing.token_pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), public_tokenizer())
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, rooms = {}, []
    for x in sorted(histogram, reverse=True):
        packing._fit(runs, rooms, x, 0, histogram[x], 1024)
    assert max(base + hi - lo for _, lo, hi, base, _ in packing.plan(histogram)) <= packing._size(runs)


def test_ranks_of_a_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    cut = spark.createDataFrame([(i, i * 31, 0, 1024 if i % 3 else 40 + i % 5) for i in range(300)], "doc long, key long, piece int, length long")
    out = packing.pack(cut).collect()
    assert len(out) == 300 and len({(r.sequence_id, r.offset) for r in out}) == 300


def test_packing_of_a_table(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(9000, None), (9001, ""), (None, "x"), (9001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df, public_tokenizer()).collect()
    ids = {d: [*plain(t), 2] for d, t in rows}
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(len([*plain(t), 2]) for _, t in rows)
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    cut = written(packing.token_pieces(df, public_tokenizer(), with_ids=True), "cut")
    assert sum(len(r.ids) for r in packing.sequences(packing.pack(cut)).collect()) == sum(r.length for r in out)
