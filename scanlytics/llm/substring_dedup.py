"""Exact removal of passages that an earlier document already holds.

Super-k-mers: every document is cut into runs of consecutive k-word windows
that share a minimiser (the least hash of the m-grams in a window). A run
travels once, as one packed string, to the bucket of its minimiser; equal
windows have equal minimisers, so a bucket sees all occurrences of its windows
and finds repeats by sorting them. Equal hashes are compared word by word.

Windows of a minimiser with more than half a bucket's share of all runs, as
counted on a sample, are told apart by a second, longer minimiser; so a frequent
pair of words does not fill one bucket. What is found does not depend on the
sample.

Heavy repetition is met before the shuffle: a run that occurs several times in
one slice of a task's input is sent for its smallest document only, and the
others are settled on the spot. A passage that a third of all documents share
therefore reaches its bucket at most once per slice, not once per document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shuffle_partitions, small_batches, text_key, written
from .textops import BLANK, Words, grams, mix, pieces, runs, sliding_min, trimmed

SLICE_BYTES = 6 << 20
BUCKETS_PER_PARTITION = 6
SAMPLE_EACH = 4  # minimisers are counted in one document of so many for each partition
_SPANS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_BLOBS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])


def _pack(doc, key, start, strings: list[bytes], settled: tuple | None = None) -> bytes:
    done = settled or (np.zeros(0, "<i8"),) * 4
    parts = [struct.pack("<II", len(strings), len(done[0])), doc.tobytes(), key.tobytes(), start.astype("<i4").tobytes()]
    parts += [done[0].astype("<i8").tobytes(), done[1].astype("<i8").tobytes(), done[2].astype("<i4").tobytes(), done[3].astype("<i4").tobytes()]
    return zstandard.ZstdCompressor(level=6).compress(b"".join([*parts, b"\n".join(strings)]))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<II", raw)
    at, out = 8, []
    for kind, size, count in (("<i8", 8, n), ("<i8", 8, n), ("<i4", 4, n), ("<i8", 8, m), ("<i8", 8, m), ("<i4", 4, m), ("<i4", 4, m)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += size * count
    return (*out, raw[at:])


def _windows(words: Words, k: int, m: int, known: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and where windows begin and their minimisers."""
    hashes = words.hashes()
    least = sliding_min(grams(hashes, m), k - m + 1)
    begin = np.flatnonzero((words.row[: len(least)] == words.row[k - 1 :]) & known[words.row[: len(least)]])
    low = least[begin]
    often = np.isin(low, heavy)
    if often.any():
        wide = min(2 * m, k)
        second = sliding_min(grams(hashes, wide), k - wide + 1)
        low[often] = mix(low[often] ^ mix(second[begin[often]] + np.uint64(1)))
    return hashes, begin, low


def _run_starts(words: Words, begin: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1] + 1) | (low[1:] != low[:-1]) | (words.row[begin[1:]] != words.row[begin[:-1]])])


def _counter(k: int, m: int):
    """Runs by minimiser."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            words = Words(batch.column("text"), fold=BLANK)
            if len(words) < k:
                continue
            _, begin, low = _windows(words, k, m, np.ones(batch.num_rows, bool), np.zeros(0, np.uint64))
            if len(begin):
                least, n = np.unique(low[_run_starts(words, begin, low)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"least": least.view(np.int64), "n": n.astype(np.int64)})

    return count


def _cutter(k: int, m: int, buckets: int, heavy: np.ndarray):
    """Documents to packed super-k-mers, by bucket."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows: dict[str, list] = {"bucket": [], "packed": []}
        known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("doc").fill_null(0).to_numpy().astype("<i8")
        keys = batch.column("key").to_numpy().astype("<i8")
        words = Words(batch.column("text"), fold=BLANK)
        if len(words) < k:
            return None
        hashes, begin, low = _windows(words, k, m, known, heavy)
        if not len(begin):
            return None
        new = _run_starts(words, begin, low)
        lead, tail, low = begin[new], begin[np.r_[new[1:], len(begin)] - 1] + k, low[new]
        row = words.row[lead]
        text, byte, stop = words.buf.tobytes(), words.start[lead], words.end[tail - 1]
        # a fingerprint of each run, from sums of word hashes that stand in the same order
        power = np.cumprod(np.full(len(hashes) + 1, 0xD1342543DE82EF95, np.uint64))
        total = np.r_[np.uint64(0), np.cumsum(hashes * power[:-1])]
        back = np.cumprod(np.full(len(hashes) + 1, pow(0xD1342543DE82EF95, -1, 2**64), np.uint64))
        print_ = mix((total[tail] - total[lead]) * back[lead] + (tail - lead).astype(np.uint64))
        del hashes, power, total, back, begin
        order = np.lexsort((lead, ids[row], print_))
        edge = runs(print_[order])
        best = np.repeat(order[edge], np.diff(np.r_[edge, len(order)]))
        later = ids[row[order]] > ids[row[best]]
        same = np.fromiter((text[byte[a] : stop[a]] == text[byte[b] : stop[b]] for a, b in zip(order[later], best[later], strict=True)), bool, int(later.sum()))
        done = order[np.flatnonzero(later)[same]]
        keep = np.ones(len(lead), bool)
        keep[done] = False
        settled = (ids[row[done]], keys[row[done]], lead[done] - words.first[row[done]], tail[done] - words.first[row[done]])
        to = (mix(low) % np.uint64(buckets)).astype(np.int32)
        sent = np.flatnonzero(keep)
        sent = sent[np.argsort(to[sent], kind="stable")]
        edge = runs(to[sent])
        for a, b in zip(edge, np.r_[edge[1:], len(sent)], strict=True):
            part = sent[a:b]
            rows["bucket"].append(int(to[part[0]]))
            strings = [text[x:y] for x, y in zip(byte[part], stop[part], strict=True)]
            rows["packed"].append(_pack(ids[row[part]], keys[row[part]], lead[part] - words.first[row[part]], strings, settled))
            settled = None
        return pa.RecordBatch.from_pydict(rows, schema=_BLOBS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            # a slice's arrays are gone before the next slice makes its own, and their memory is the system's again
            made = one(batch)
            trimmed()
            if made is not None:
                yield made

    return cut


def _sorter(k: int):
    """One bucket: all occurrences of its windows, sorted; spans of those that a smaller document has."""

    def sort(table: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in table.column("packed").to_pylist()]
        docs, keys, starts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        spans = [np.concatenate([p[i] for p in parts]) for i in range(3, 7)]
        text = b"\n".join(p[7] for p in parts if len(p[0]))
        if text:
            data = np.frombuffer(text, np.uint8)
            edges = np.r_[0, np.flatnonzero(data == 10) + 1, len(data)]
            words = Words.of_bytes(data, edges)
            print_ = grams(words.hashes(), k)
            at = np.flatnonzero(words.row[: len(print_)] == words.row[k - 1 :])
            doc, print_ = docs[words.row[at]], print_[at]
            order = np.lexsort((doc, print_))
            edge = runs(print_[order])
            best = np.repeat(order[edge], np.diff(np.r_[edge, len(order)]))
            later = np.flatnonzero(doc[order] > doc[best])
            mine, other = at[order[later]], at[best[later]]
            a, b, c, d = words.start[mine], words.end[mine + k - 1], words.start[other], words.end[other + k - 1]
            same = np.fromiter((text[p:q] == text[r:s] or text[p:q].split() == text[r:s].split() for p, q, r, s in zip(a, b, c, d, strict=True)), bool, len(later))
            hit = np.zeros(len(at), bool)
            hit[order[later[same]]] = True
            for odd in set(print_[order[later[~same]]].tolist()):  # equal hashes of different words: compare them all
                group = np.flatnonzero(print_ == np.uint64(odd))
                word = [tuple(text[words.start[i] : words.end[i + k - 1]].split()) for i in at[group]]
                least: dict[tuple, int] = {}
                for w, x in zip(word, doc[group], strict=True):
                    least[w] = min(least.get(w, x), x)
                hit[group] = [x > least[w] for w, x in zip(word, doc[group], strict=True)]
            got = at[hit]
            lead = np.flatnonzero(np.r_[True, (got[1:] != got[:-1] + 1) | (words.row[got[1:]] != words.row[got[:-1]])]) if len(got) else got
            first, last = got[lead], got[np.r_[lead[1:], len(got)] - 1] if len(got) else got
            run = words.row[first]
            shift = starts[run] - words.first[run]
            spans = [np.r_[x, y] for x, y in zip(spans, (docs[run], keys[run], first + shift, last + k + shift), strict=True)]
        return pa.Table.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(spans, _SPANS.types, strict=True)], schema=_SPANS)

    return sort


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 2, buckets: int | None = None) -> DataFrame:
    """Word spans of windows that a document with a smaller id has too.

    Returns ``doc, key, start, stop`` (words from 0, stop exclusive); ``key`` is a hash of the
    text, so that rows of one id with different texts stay apart. Spans may overlap. Rows
    without an id or a text take no part: an unknown id is neither smaller nor larger.
    """
    small_batches(docs.sparkSession)
    n = buckets or BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    m = min(m, k)
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE_EACH * shuffle_partitions(docs.sparkSession))) == 0).select("text")
    counts = sample.mapInArrow(_counter(k, m), "least long, n long").groupBy("least").agg(F.sum("n").alias("n"))
    counts = written(counts, "minimisers")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(2 * n * F.col("n") > total).select("least").toArrow()  # fewer than 2 n rows
    blobs = rows.mapInArrow(_cutter(k, m, n, heavy.column("least").to_numpy().astype(np.int64).view(np.uint64)), "bucket int, packed binary")
    return blobs.groupBy("bucket").applyInArrow(_sorter(k), "doc long, key long, start int, stop int")


def _cleaner(names: list[str], text_col: str, replace: bool, out: pa.Schema):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", SLICE_BYTES):
            words = Words(batch.column("__text"))
            spans = batch.column("__spans")
            change = np.zeros(len(words) + 1, np.int64)
            lengths = np.diff(np.asarray(spans.offsets)) if spans.null_count == 0 else np.array([len(x) if x is not None else 0 for x in spans.to_pylist()])
            flat = spans.flatten()
            if len(flat):
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                start, stop = (flat.field(i).to_numpy() + words.first[owner] for i in (0, 1))
                np.add.at(change, start, 1)
                np.add.at(change, stop, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.first[:-1]) * (words.count > 0) if batch.num_rows else np.zeros(0, np.int64)
            text, kept, sha = words.buf.tobytes(), [], []
            for i in range(batch.num_rows):
                lo, hi = words.first[i], words.first[i + 1]
                whole = text[words.edges[i] : words.edges[i + 1]]
                if not removed[i]:
                    joined = b" ".join(whole.split())
                    kept.append(whole)
                else:
                    stay = np.flatnonzero(~gone[lo:hi]) + lo
                    joined = b" ".join([text[a:b] for a, b in zip(words.start[stay], words.end[stay], strict=True)])
                    cut = np.flatnonzero(np.r_[True, np.diff(stay) > 1]) if len(stay) else stay
                    last = np.r_[cut[1:], len(stay)] - 1 if len(stay) else stay
                    kept.append(b" ".join(text[words.start[stay[a]] : words.end[stay[b]]] for a, b in zip(cut, last, strict=True)))
                sha.append(hashlib.sha256(joined).hexdigest())
            made = {"n_words": pa.array(words.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            texts = pa.compute.if_else(batch.column("__text").is_valid(), texts, pa.scalar(None, pa.string()))
            arrays = [made[f.name[3:]] if f.name.startswith("dd_") and f.name[3:] in made else texts if f.name == "dd_text" else batch.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return clean


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 2, keep: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Every document without the words of windows that a smaller document has.

    A window is ``k`` consecutive words ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input.
    Returns the columns ``keep`` (the id by default) and ``dd_n_words``, ``dd_n_removed``,
    ``dd_kept_sha256`` (of the kept words joined by a space) and ``dd_text``: the kept text, in
    which stretches that stay keep their own white space and are joined by a space.

    Null texts have no words and stay null; rows with a null id are returned whole; equal rows
    get equal results; texts of fewer than ``k`` words are never cut; other columns, whatever
    their names, are left alone. An empty table gives an empty table.
    """
    keep = [id_col] if keep is None else keep
    inner = [f"__c{i}" for i in range(len(keep))]
    spans = repeated_spans(docs, id_col, text_col, k, m, buckets)
    spans = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("__text"), *[F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)])
    both = rows.join(spans, ["doc", "key"], "left").select("__text", F.coalesce("__spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("__spans"), *inner)
    made = [("dd_n_words", T.LongType(), pa.int64()), ("dd_n_removed", T.LongType(), pa.int64()), ("dd_kept_sha256", T.StringType(), pa.string()), ("dd_text", T.StringType(), pa.string())]
    schema = T.StructType([*[T.StructField(x, both.schema[x].dataType) for x in inner], *[T.StructField(n, t) for n, t, _ in made]])
    names = pa.schema([*[(x, pa.null()) for x in inner], *[(n, t) for n, _, t in made]])
    out = both.mapInArrow(_cleaner(inner, text_col, False, names), schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)], *[n for n, _, _ in made])
