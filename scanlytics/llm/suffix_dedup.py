"""Removal of every byte that a string of 100 bytes covers which starts earlier as well, by sorted suffixes.

Not all suffixes are sorted: of each window of 100 bytes one position is chosen by its content alone, that of its least 24-byte
gram, so equal windows have equal positions in them. Consecutive windows of one position travel
once, as the string that they cover. Strings go to ranges of their suffixes from that position: the splitters are sampled
leading tokens (the 24 bytes, as three 8-byte symbols) with the document as the last place, so that a very frequent gram is cut into several ranges.

A bucket sorts its suffixes by multikey quicksort on 8-byte symbols (suffixes that stand alone drop out at once). Equal strings
leave their first one only; of strings that share enough with a neighbour in the order, the windows themselves are sorted the same way.
Where a range ends inside a gram, the first strings of that gram on both sides are compared across the boundary in a second, much smaller step.

Equal strings inside one slice of a task's input are met before the shuffle.
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

from .shared import shuffle_partitions, small_batches, text_key, written
from .textops import _bytes, mix, pieces, runs, sliding_min

SLICE_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 6
SAMPLES_PER_BUCKET = 48
SAMPLE_EACH = 4  # splitters come from one document of so many for each partition
WINDOW, GRAM = 100, 24
WINDOWS_AT_ONCE = 1 << 20
LEVEL = 6  # of zstd for the strings, most of what is shuffled
_BLOBS = pa.schema([("bucket", pa.int32()), ("packed", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int32()), ("packed", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_HEAD = np.array([0, *[((1 << (8 * i)) - 1) << (64 - 8 * i) for i in range(1, 9)]], np.uint64)
_BYTE = mix(np.arange(256, dtype=np.uint64) + _A)
_OF_STRING = ("<i8", "<i8", "<i4", "<u1", "<u2")  # doc, key, start, place of the suffix in the string, bytes of the string
_OF_SPAN = ("<i8", "<i8", "<i4", "<i4")


def symbols(buf: np.ndarray, order: str = ">") -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort like the bytes; ``buf`` ends in spare bytes."""
    return np.ndarray((len(buf) - 7,), f"{order}u8", buf.data, strides=(1,))


def multikey(load: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of ``size`` bytes at ``at`` (inside given groups), and the bytes that each shares with the one before it."""
    order = np.arange(len(at)) if group is None else np.argsort(group, kind="stable")
    group = np.zeros(len(at), np.int64) if group is None else group[order]
    shared, todo, depth = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(todo):
        who = order[todo]
        left = np.minimum(size[who] - depth, 8)
        word = load[at[who] + depth].astype(np.uint64) & _HEAD[left]
        by = np.lexsort((word, group)) if left.min() == 8 else np.lexsort((left, word, group))
        order[todo] = who = who[by]
        word, left, group = word[by], left[by], group[by]
        apart = word[1:] ^ word[:-1]
        near = group[1:] == group[:-1]
        same = near & (apart == 0) & (left[1:] == left[:-1])
        common = np.zeros(len(apart), np.int64)
        for i in range(1, 9):
            common += apart < np.uint64(1 << (64 - 8 * i)) if i < 8 else apart == 0
        shared[todo[1:][near]] = depth + np.minimum(common, np.minimum(left[1:], left[:-1]))[near]
        part = np.cumsum(np.r_[True, ~same]) - 1
        stay = (np.bincount(part)[part] > 1) & (left == 8)
        todo, group, depth = todo[stay], part[stay], depth + 8
    return order, shared


def _pack(strings: tuple, text: bytes, settled: tuple | None = None) -> bytes:
    settled = settled or tuple(np.zeros(0, t) for t in _OF_SPAN)
    parts = [struct.pack("<II", len(strings[0]), len(settled[0]))]
    parts += [np.asarray(a).astype(t).tobytes() for a, t in zip((*strings, *settled), _OF_STRING + _OF_SPAN, strict=True)]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*parts, text]))


def _unpack(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    got, texts = [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m = struct.unpack_from("<II", raw)
        at, row = 8, []
        for kind, count in (*((t, n) for t in _OF_STRING), *((t, m) for t in _OF_SPAN)):
            row.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
            at += np.dtype(kind).itemsize * count
        got.append(row)
        texts.append(np.frombuffer(raw, np.uint8, offset=at))
    columns = [np.concatenate([row[i] for row in got]) for i in range(9)]
    return columns[:5], columns[5:], np.concatenate([*texts, np.zeros(16, np.uint8)])


def _not_first(doc: np.ndarray, key: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which members of their group have an earlier one: of a smaller document, or of the same and an earlier start."""
    by = np.lexsort((start, key, doc, group))
    d, k, s, g = doc[by], key[by], start[by], group[by]
    lead = np.repeat(e := runs(g), np.diff(np.r_[e, len(g)]))
    new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.zeros(0, np.int64)
    own = np.repeat(new, np.diff(np.r_[new, len(g)]))
    out = np.zeros(len(g), bool)
    out[by] = (d > d[lead]) | (s > s[own])
    return out


def _neighbours(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The most bytes that each string shares with any other."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(shared, np.r_[shared[1:], 0])
    return out


def _compare(strings: list[np.ndarray], buf: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Spans of windows that start earlier too, among these strings of one or more grams; and the first one of all equal strings."""
    doc, key, start, front, size = strings
    at = np.cumsum(size) - size
    load, turned = symbols(buf), symbols(np.r_[buf[::-1], np.zeros(8, np.uint8)])
    back = len(buf) - (at + front)  # where the bytes before the suffix begin in the turned buffer
    behind = size - front
    order, shared = multikey(load, at + front, behind)
    near = np.flatnonzero(_neighbours(order, shared) >= WINDOW - front)
    kind = np.empty(len(doc), np.int64)
    kind[order] = np.cumsum(np.r_[True, (shared[1:] < behind[order[1:]]) | (shared[1:] < behind[order[:-1]])]) if len(order) else order
    by, shared = multikey(turned, back[near], front[near], kind[near])
    by = near[by]
    new = np.r_[True, (kind[by][1:] != kind[by][:-1]) | (shared[1:] < front[by][1:]) | (shared[1:] < front[by][:-1])] if len(by) else np.zeros(0, bool)
    gone = by[_not_first(doc[by], key[by], start[by], np.cumsum(new))]
    spans = [[doc[gone], key[gone], start[gone], start[gone] + size[gone]]]
    first = np.ones(len(doc), bool)
    first[gone] = False
    left = near[first[near]]
    right_most = _neighbours(*multikey(load, (at + front)[left], behind[left]))
    left_most = _neighbours(*multikey(turned, back[left], front[left]))
    low, high = np.maximum(WINDOW - behind[left], WINDOW - right_most), np.minimum(front[left], left_most)
    use = low <= high
    left, low, high = left[use], low[use], high[use]
    # equal windows have their suffix at equal places, so places are taken a few at a time
    many = np.cumsum(np.bincount(low, minlength=WINDOW + 1) - np.bincount(high + 1, minlength=WINDOW + 1)[: WINDOW + 1]) if len(left) else np.zeros(0, np.int64)
    share = np.cumsum(many) // WINDOWS_AT_ONCE
    hit_string, hit_at = [], []
    for part in np.unique(share):
        places = np.flatnonzero(share == part)
        a, b = np.maximum(low, places[0]), np.minimum(high, places[-1])
        count = np.maximum(b - a + 1, 0)
        own = np.repeat(left, count)
        if not len(own):
            continue
        place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        begin = front[own] - place
        by, shared = multikey(load, at[own] + begin, np.full(len(own), WINDOW), place)
        again = _not_first(doc[own][by], key[own][by], (start[own] + begin)[by], np.cumsum(np.r_[True, (shared[1:] < WINDOW) | (place[by][1:] != place[by][:-1])]))
        hit_string.append(own[by[again]])
        hit_at.append(begin[by[again]])
    if hit_string:
        own, begin = np.concatenate(hit_string), np.concatenate(hit_at)
        by = np.lexsort((begin, own))
        own, begin = own[by], begin[by]
        lead = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (begin[1:] != begin[:-1] + 1)]) if len(own) else own
        tail = np.r_[lead[1:], len(own)] - 1 if len(own) else own
        spans.append([doc[own[lead]], key[own[lead]], start[own[lead]] + begin[lead], start[own[lead]] + begin[tail] + WINDOW])
    return [np.concatenate(x) for x in zip(*spans, strict=True)], first


def _strings(buf: np.ndarray, edges: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte, suffix and end of the string of each run of windows with one chosen place."""
    n = int(edges[-1])
    none = (np.zeros(0, np.int64),) * 4
    if n < WINDOW:
        return none
    word = symbols(buf, "<")[: n - 7].astype(np.uint64)
    print_ = word[: n - GRAM + 1] * _A
    print_ ^= print_ >> np.uint64(32)
    print_ += word[8 : n - GRAM + 9]
    print_ *= _B
    print_ ^= print_ >> np.uint64(29)
    print_ += word[16 : n - GRAM + 17]
    print_ = mix(print_)
    del word
    width = WINDOW - GRAM + 1
    least = sliding_min(print_, width)
    inside = np.zeros(len(least) + 1, bool)
    for i in np.flatnonzero(known & (np.diff(edges) >= WINDOW)):
        inside[edges[i] : edges[i + 1] - WINDOW + 1] = True
    new = inside.copy()
    new[1:-1] &= ~inside[:-2] | (least[1:] != least[:-1]) | (print_[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | new[1:]))
    if not len(first):
        return none
    place = last.copy()
    far = np.flatnonzero(print_[last] != least[last])
    for i in range(0, len(far), 1 << 15):
        some = last[far[i : i + (1 << 15)]]
        place[far[i : i + (1 << 15)]] += np.argmax(print_[some[:, None] + np.arange(width)] == least[some][:, None], axis=1)
    return np.searchsorted(edges, first, "right") - 1, first, place, last + WINDOW


def _tokens(buf: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The leading tokens of suffixes, with the document, as byte strings that sort."""
    out = np.empty((len(place), 4), ">u8")
    load = symbols(buf)
    for i in range(3):
        out[:, i] = load[place + 8 * i]
    out[:, 3] = doc.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S32").ravel() if len(out) else np.zeros(0, "S32")


def _grams_of(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(tokens).view("S8").reshape(-1, 4)[:, :3]).view("S24").ravel()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches, "text", SLICE_BYTES):
        data, edges = _bytes(batch.column("text"))
        buf = np.concatenate([data, np.zeros(32, np.uint8)])
        known = batch.column("doc").is_valid().to_numpy(zero_copy_only=False)
        ids, keys = batch.column("doc").fill_null(0).to_numpy(), batch.column("key").to_numpy()
        row, begin, place, end = _strings(buf, edges, known)
        if len(row):
            yield buf, edges, ids, keys, row, begin, place, end


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for buf, _, ids, _, row, _, place, _ in _slices(batches):
        some = np.arange(0, len(row), 8)
        tokens = _tokens(buf, place[some], ids[row[some]])
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([x.ljust(32, b"\0") for x in tokens.tolist()], pa.binary()), "draw": mix(_draw(tokens)).view(np.int64)})


def _draw(tokens: np.ndarray) -> np.ndarray:
    """A number for each token string, to draw some of them."""
    return np.bitwise_xor.reduce(mix(tokens.view(">u8").reshape(-1, 4).astype(np.uint64) + np.arange(4, dtype=np.uint64)), axis=1)


def _cutter(splitters: np.ndarray):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, edges, ids, keys, row, begin, place, end in _slices(batches):
            raw = buf.tobytes()
            power = np.cumprod(np.full(len(buf) + 1, _B))
            back = np.cumprod(np.full(len(buf) + 1, np.uint64(pow(int(_B), -1, 2**64))))
            total = np.r_[np.uint64(0), np.cumsum(_BYTE[buf] * power[:-1])]
            print_ = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)) ^ mix((place - begin).astype(np.uint64))
            del power, back, total
            doc, key, start = ids[row], keys[row], begin - edges[row]
            by = np.lexsort((start, key, doc, print_))
            lead = np.repeat(by[e := runs(print_[by])], np.diff(np.r_[e, len(by)]))
            later = np.flatnonzero(by != lead)
            mine, other = by[later], lead[later]
            same = np.fromiter((raw[a:b] == raw[c:d] for a, b, c, d in zip(begin[mine].tolist(), end[mine].tolist(), begin[other].tolist(), end[other].tolist(), strict=True)), bool, len(mine))
            same &= (place - begin)[mine] == (place - begin)[other]
            group = print_.copy()
            group[mine[~same]] = mix(print_[mine[~same]] + mine[~same].astype(np.uint64))  # equal prints of different strings: each for itself
            gone = _not_first(doc, key, start, group)
            settled = tuple(x[gone] for x in (doc, key, start, start + end - begin))
            sent = np.flatnonzero(~gone)
            to = np.searchsorted(splitters, _tokens(buf, place[sent], doc[sent]), "right")
            by = np.argsort(to, kind="stable")
            sent, to = sent[by], to[by]
            edge = runs(to)
            out = {"bucket": to[edge].tolist(), "packed": []}
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(sent)], strict=True):
                part = sent[a:b]
                text = b"".join([raw[x:y] for x, y in zip(begin[part].tolist(), end[part].tolist(), strict=True)])
                out["packed"].append(_pack((doc[part], key[part], start[part], (place - begin)[part], (end - begin)[part]), text, settled))
                settled = None
            yield pa.RecordBatch.from_pydict(out, schema=_BLOBS)

    return cut


def _table(spans: list[np.ndarray], buckets: list[int] = (), packed: list[bytes] = ()) -> pa.Table:
    n, m = len(spans[0]), len(buckets)
    rows = [pa.array([None] * n + list(buckets), pa.int32()), pa.array([None] * n + list(packed), pa.binary())]
    rows += [pa.concat_arrays([pa.array(x.astype(t.to_pandas_dtype()), t), pa.nulls(m, t)]) for x, t in zip(spans, _FOUND.types[2:], strict=True)]
    return pa.Table.from_arrays(rows, schema=_FOUND)


def _sorter(splitters: np.ndarray | None):
    """One range: spans, and packed the first strings of each gram that a splitter cuts."""
    grams = np.unique(_grams_of(splitters)) if splitters is not None and len(splitters) else np.zeros(0, "S24")

    def sort(table: pa.Table) -> pa.Table:
        strings, spans, buf = _unpack(table.column("packed").to_pylist())
        found, first = _compare(strings, buf)
        buckets, packed = [], []
        if len(grams):
            doc, key, start, front, size = strings
            at = np.cumsum(size) - size
            mine = _grams_of(_tokens(buf, at + front, doc))
            slot = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            stay = np.flatnonzero(first & (grams[slot] == mine))
            stay = stay[np.argsort(slot[stay], kind="stable")]
            edge = runs(slot[stay])
            raw = buf.tobytes()
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(stay)], strict=True) if len(stay) else ():
                part = stay[a:b]
                buckets.append(int(slot[part[0]]))
                packed.append(_pack(tuple(x[part] for x in strings), b"".join([raw[x : x + y] for x, y in zip(at[part].tolist(), size[part].tolist(), strict=True)])))
        return _table([np.concatenate(x) for x in zip(spans, found, strict=True)], buckets, packed)

    return sort


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Byte spans ``doc, key, start, stop`` of windows that start earlier too; they may overlap. ``key`` is a hash of the text.

    A window is earlier in a smaller document, or in the same one at an earlier start. Rows without an id or a text take no part;
    of rows with one id and different texts none is earlier than another.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = buckets or BUCKETS_PER_PARTITION * shuffle_partitions(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_key(text).alias("key"), text.cast("binary").alias("text"))
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE_EACH * shuffle_partitions(spark))) == 0)
    drawn = sample.mapInArrow(_sampled, "tokens binary, draw long").orderBy("draw", "tokens").limit(n * SAMPLES_PER_BUCKET).select("tokens").toArrow()
    tokens = np.sort(np.array(drawn.column("tokens").to_pylist() or [b""], "S32"))
    splitters = tokens[np.linspace(0, len(tokens), n + 1)[1:-1].astype(np.int64)] if drawn.num_rows else np.zeros(0, "S32")
    blobs = rows.mapInArrow(_cutter(splitters), "bucket int, packed binary")
    kind = "bucket int, packed binary, doc long, key long, start int, stop int"
    found = written(blobs.groupBy("bucket").applyInArrow(_sorter(splitters), kind), "suffixes")
    across = found.where("packed is not null").select("bucket", "packed").groupBy("bucket").applyInArrow(_sorter(None), kind)
    return found.where("packed is null").unionByName(across).select("doc", "key", "start", "stop")


_CLEAN = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, each packed for itself: Spark's own compression of the shuffle takes off much less."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, "text", SLICE_BYTES):
        packed = [None if x is None else packer.compress(x) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(packed, pa.binary())], names=["doc", "key", "packed"])


def _cleaner(with_kept: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "packed", SLICE_BYTES):
            texts, rows = batch.column("packed"), []
            spans = batch.column("spans")
            count = np.diff(np.asarray(spans.offsets))
            start, stop = (spans.flatten().field(i).to_numpy() for i in range(2))
            at = 0
            for i in range(batch.num_rows):
                raw = opener.decompress(texts[i].as_py()) if texts[i].is_valid else b""
                end, parts, gone, n = 0, [], 0, 0
                if count[i]:
                    by = np.argsort(start[at : at + count[i]], kind="stable") + at
                    a, b = start[by].astype(np.int64), np.maximum.accumulate(stop[by].astype(np.int64))
                    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    for x, y in zip(a[new].tolist(), b[np.r_[new[1:], len(a)] - 1].tolist(), strict=True):
                        parts.append(raw[end:x])
                        gone, n, end = gone + y - x, n + 1, y
                    at += count[i]
                parts.append(raw[end:])
                kept = b"".join(parts)
                rows.append((len(raw), gone, n, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CLEAN.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], names=["doc", *_CLEAN.names])

    return clean


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: bool = False, buckets: int | None = None) -> DataFrame:
    """``doc, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every document, without the bytes of repeated 100-byte strings.

    Texts are UTF-8 bytes; strings never cross documents and are judged on the input. ``n_spans`` counts maximal removed stretches; ``kept`` are
    the bytes that stay, joined (null unless asked for; a cut may fall inside a character). A null text is an empty one; texts under 100 bytes
    and rows without an id are never cut; equal rows get equal rows and are no copies of each other; other columns do not matter; an empty table gives an empty table.
    """
    spans = repeated_bytes(docs, id_col, text_col, buckets).groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text_key(text).alias("key"), text.cast("binary").alias("text"))
    rows = rows.mapInArrow(_packed_texts, "doc long, key long, packed binary")
    both = rows.join(spans, ["doc", "key"], "left").select("doc", "packed", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"))
    return both.mapInArrow(_cleaner(kept), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
