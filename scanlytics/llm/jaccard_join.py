"""Exact Jaccard join of word-shingle sets in their metric space, and its classes.

d(A, B) = 1 - |A n B| / |A u B| is a metric, and |A ^ B| (the symmetric difference)
is another; sets are linked where (100 + p) |A ^ B| <= (100 - p) (|A| + |B|).
Unrelated documents all stand at a distance of about 1 from each other, so a few
document pivots cannot divide a corpus: every document would be a boundary
document of every region. The pivots are therefore chosen as follows.

1. The first pivots are single shingles: d(A, {s}) is 1 - 1/|A| where s is in A
   and 1 elsewhere; of the equally near pivots, a document's own region is that
   of its first shingle in one global order (very frequent ones last). Two linked
   sets can only miss each other in the regions of their first few shingles, so a
   document is replicated to the regions of its first |A| - ceil(t |A|) + 1
   shingles and to no others (a prefix filter). Members of a region are compared
   only inside the windows that their sizes (their distances to the empty set)
   and their places in the order allow.
2. Members of a region of more than ``REGION`` are told apart by parity bits of each
   set, which differ in no more places than |A ^ B|: they fall into groups that no link
   leaves. Groups of all these regions that share a member are one new region, so a set is in one
   of them, however many frequent shingles it has, and sets without any near one in none.
3. A new region of more than ``REGION`` members gets its median set c as its pivot: the
   shingles of more than half of the members. With D = A ^ c, the distance to the
   pivot is |D|. By the triangle inequality A and B are linked where
   f(A) + f(B) <= 0 with f(A) = (100 + p) |D| - (100 - p) |A|: this ball round the
   pivot is linked through its member of least f, without any pairs. All other
   linked pairs share at least (f(A) + f(B)) / (2 (100 + p)) elements of their
   D, so the region is divided again: the new pivots are the sets c ^ {e}, and a
   member is replicated to those of its first few e, rarest in the region first.
   This goes on until every region is small or all of it lies in a ball. It
   ends: all members of the region of e have e in common, which the next pivot
   takes out of every D.

Small regions are sifted by parity bits too; they get the sets of the members that are
left, once each, and are joined whole in one task each, exactly. Equal sets are one node throughout, so groups of copies
never make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import discard, small_batches, text_key, written
from .textops import LOWER, Words, grams, mix, pieces, runs

SLICE_BYTES = 2 << 20
LOCALLY_FREQUENT = 4  # shingles in this many sets of one slice are reported as frequent
FREQUENT_KEPT = 200_000  # so many of the most frequent shingles come last in the order
REGION = 1024  # regions with more members than this are divided again
SEND_NODES = 1_000_000  # lists of wanted texts up to this length (8 bytes each) are broadcast, longer ones are joined by shuffle
SEND_REGIONS = 10_000  # facts of so many divided regions are broadcast, of more joined by shuffle

_SIGNS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("node", pa.int64()), ("proof", pa.int64()), ("bits", pa.list_(pa.int64())), ("gram", pa.int64()), ("n", pa.int64())])
_CELLS = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("at", pa.int64())])
_PAIRS = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("m", pa.int32())])
_KEPT = pa.schema([("region", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("ref", pa.int64())])
_SETS = pa.schema([("node", pa.int64()), ("grams", pa.list_(pa.int64()))])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distinct shingles, sorted by both."""
    hashes = words.hashes()
    whole = grams(hashes, n)
    at = np.flatnonzero(words.row[: len(whole)] == words.row[n - 1 :]) if len(whole) else np.zeros(0, np.int64)
    row, gram = [words.row[at]], [whole[at]]
    for c in range(1, n):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(words.count == c)
        row.append(short)
        gram.append(mix(grams(hashes, c)[words.first[short]] + np.uint64(c)) if len(short) else np.zeros(0, np.uint64))
    row, gram = np.concatenate(row), np.concatenate(gram)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], gram[new]


def _nodes(row: np.ndarray, gram: np.ndarray, rows: int, bits: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: set size, a hash of the set, and an independent one that takes its place where ``shared`` has the first."""
    size = np.bincount(row, minlength=rows)
    first, second = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    np.add.at(first, row, mix(gram + np.uint64(1)))
    np.add.at(second, row, mix(gram ^ np.uint64(0xA5A5A5A5DEADBEEF)))
    node, proof = (mix(first + size.astype(np.uint64)) >> np.uint64(64 - bits)).view(np.int64), mix(second).view(np.int64)
    return size, np.where(np.isin(node, shared), proof, node), proof


def _width(size: np.ndarray) -> np.ndarray:
    """How many 64-bit words of parity bits a set has: a power of two, at least a bit for each shingle and at least 8 words."""
    return 1 << np.ceil(np.log2(np.maximum(size, 512) / 64)).astype(np.int64)


def _parity(row: np.ndarray, gram: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bits of each set: the parity of how many shingles are hashed to each. Those of linked sets differ in few places.

    Bits fold: the exclusive or of both halves is the set's parity bits of half the width.
    """
    wide = _width(size)
    edges = np.r_[0, np.cumsum(wide)]
    place = mix(gram ^ np.uint64(0x5DEECE66D)).view(np.int64) & (wide * 64 - 1)[row]
    at, count = np.unique(edges[row] * 64 + place, return_counts=True)
    at = at[count % 2 == 1]
    words = np.zeros(edges[-1], np.uint64)
    np.bitwise_or.at(words, at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(words.view(np.int64)))


def _once(node: np.ndarray) -> np.ndarray:
    one = np.zeros(len(node), bool)
    one[np.unique(node, return_index=True)[1]] = True
    return one


def _signer(n: int, bits: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            row, gram = _sets(Words(batch.column("text"), fold=LOWER), n)
            size, node, proof = _nodes(row, gram, batch.num_rows, bits, np.zeros(0, np.int64))
            seen = np.sort(gram[_once(node)[row]])
            edge = runs(seen)
            count = np.diff(np.r_[edge, len(seen)])
            often = count >= LOCALLY_FREQUENT
            k, m = batch.num_rows, int(often.sum())
            null = lambda size, kind: pa.nulls(size, kind)
            left = [batch.column("doc"), batch.column("key"), pa.array(size.astype(np.int32)), pa.array(node), pa.array(proof), _parity(row, gram, size), null(k, pa.int64()), null(k, pa.int64())]
            yield pa.RecordBatch.from_arrays(left, schema=_SIGNS)
            if m:
                right = [*[null(m, t) for t in _SIGNS.types[:6]], pa.array(seen[edge[often]].view(np.int64)), pa.array(count[often].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(right, schema=_SIGNS)

    return sign


def _spreader(n: int, percent: int, bits: int, known):
    """To every region that a set must be replicated to; ``at`` holds its size and the shingle's place."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count, shared = known.value
        for batch in pieces(batches, "text", SLICE_BYTES):
            row, gram = _sets(Words(batch.column("text"), fold=LOWER), n)
            size, node, _ = _nodes(row, gram, batch.num_rows, bits, shared)
            keep = _once(node)[row]
            row, gram = row[keep], gram[keep]
            if not len(row):
                continue
            if len(often):
                at = np.minimum(np.searchsorted(often, gram), len(often) - 1)
                rank = np.where(often[at] == gram, count[at], 0)
                order = np.lexsort((gram, rank, row))
                row, gram = row[order], gram[order]
            edge = runs(row)
            pos = np.arange(len(row)) - np.repeat(edge, np.diff(np.r_[edge, len(row)]))
            whole = size[row]
            sent = pos < whole - (percent * whole + 99) // 100 + 1
            yield pa.RecordBatch.from_arrays([pa.array(gram[sent].view(np.int64)), pa.array(node[row[sent]]), pa.array((whole[sent] << 32) | pos[sent])], schema=_CELLS)

    return spread


def _pairer(percent: int, most: int):
    """Rows sorted by cell and node to pairs inside the windows; of cells with over ``most`` nodes, the members (``b`` null)."""

    def within(cell: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = runs(cell)
        m = np.repeat(np.diff(np.r_[edge, len(cell)]), np.diff(np.r_[edge, len(cell)]))
        size, rest = at >> 32, (at >> 32) - (at & 0xFFFFFFFF)
        k, i = 1, np.flatnonzero(cell[1:] == cell[:-1])
        while len(i):
            j = i + k
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            near = (100 * low >= percent * high) & ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (low + high))
            if near.any():
                x, y = i[near], j[near]
                yield pa.RecordBatch.from_arrays([pa.array(cell[x]), pa.array(node[x]), pa.array(node[y]), pa.array(m[x].astype(np.int32))], schema=_PAIRS)
            k += 1
            i = i[i + k < len(cell)]
            i = i[cell[i + k] == cell[i]]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]  # the last cell of what has been read
        waiting, large, last = 0, None, None
        for batch in batches:
            cell, node, at = (c.to_numpy() for c in batch.columns)
            if not len(cell):
                continue
            new = np.r_[last != (cell[0], node[0]), (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])]
            last = (cell[-1], node[-1])
            cell, node, at = cell[new], node[new], at[new]
            if large is not None:  # members of a large cell go on at once
                of = int(np.searchsorted(cell != large, True)) if len(cell) else 0
                yield pa.RecordBatch.from_arrays([pa.array(cell[:of]), pa.array(node[:of]), pa.nulls(of, pa.int64()), pa.nulls(of, pa.int32())], schema=_PAIRS)
                cell, node, at = cell[of:], node[of:], at[of:]
                if not len(cell):
                    continue
                large = None
            for h, x in zip(held, (cell, node, at), strict=True):
                h.append(x)
            waiting += len(cell)
            if len(cell) and len(cell) < 4096 and waiting < 4096:
                continue
            cell, node, at = (np.concatenate(h) for h in held)
            if not len(cell):
                continue
            tail = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
            yield from sift(cell[:tail], node[:tail], at[:tail])
            if len(cell) - tail > most:
                large, of = cell[-1], len(cell) - tail
                yield pa.RecordBatch.from_arrays([pa.array(cell[tail:]), pa.array(node[tail:]), pa.nulls(of, pa.int64()), pa.nulls(of, pa.int32())], schema=_PAIRS)
                tail = len(cell)
            held = [[cell[tail:]], [node[tail:]], [at[tail:]]]
            waiting = len(cell) - tail
        yield from sift(*(np.concatenate(h) if h else np.zeros(0, np.int64) for h in held))

    def sift(cell: np.ndarray, node: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = runs(cell)
        m = np.repeat(np.diff(np.r_[edge, len(cell)]), np.diff(np.r_[edge, len(cell)]))
        some, many = (m > 1) & (m <= most), m > most
        yield from within(cell[some], node[some], at[some])
        of = int(many.sum())
        if of:
            yield pa.RecordBatch.from_arrays([pa.array(cell[many]), pa.array(node[many]), pa.nulls(of, pa.int64()), pa.nulls(of, pa.int32())], schema=_PAIRS)

    return pair


def _sifter(percent: int):
    """Rows ``region, node, size, ref, bits`` sorted by region: those that may be linked with another of their region, by their parity bits."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            region = rows.column("region").to_numpy()
            tail = int(np.flatnonzero(region != region[-1])[-1]) + 1 if len(region) and region[0] != region[-1] else 0
            yield chosen(rows.slice(0, tail))
            held = rows.slice(tail).to_batches()
        if held:
            yield chosen(pa.Table.from_batches(held).combine_chunks())

    def chosen(rows: pa.Table) -> pa.RecordBatch:
        region, size = rows.column("region").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
        wide = _width(size)
        first, keep, folded = np.cumsum(wide) - wide, np.zeros(len(region), bool), {}
        for w in np.unique(wide).tolist():  # sets in one window differ by one width at most
            same, double = np.flatnonzero(wide == w), np.flatnonzero(wide == 2 * w)
            place = np.full(len(wide), -1)
            place[same], place[double] = np.arange(len(same)), len(same) + np.arange(len(double))
            ahead = bits[first[double][:, None] + np.arange(2 * w)]
            folded[w] = place, np.concatenate([bits[first[same][:, None] + np.arange(w)], ahead[:, :w] ^ ahead[:, w:]])
        k, i = 1, np.flatnonzero(region[1:] == region[:-1])
        while len(i):
            fits = i[100 * np.minimum(size[i], size[i + k]) >= percent * np.maximum(size[i], size[i + k])]
            narrow = np.minimum(wide[fits], wide[fits + k])
            for w in np.unique(narrow).tolist():
                place, table = folded[w]
                these = fits[narrow == w]
                for part in np.array_split(these, len(these) * w // 400_000 + 1):
                    differ = np.bitwise_count(table[place[part]] ^ table[place[part + k]]).sum(1, dtype=np.int64)
                    near = part[(100 + percent) * differ <= (100 - percent) * (size[part] + size[part + k])]
                    keep[near] = keep[near + k] = True
            k += 1
            i = i[i + k < len(region)]
            i = i[region[i + k] == region[i]]
        out = rows.select(["region", "node", "size", "ref"]).filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], schema=_KEPT)

    return sift


def _grouper(percent: int):
    """Rows ``region, node, size, bits`` sorted by region, size and node: links ``a, b`` that connect all members of a region that may be linked, by their parity bits."""

    def grouped(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
        node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64)
        wide = _width(size)
        begin, tables = np.cumsum(wide) - wide, {}
        for w in np.unique(wide).tolist():  # larger sets have no narrower bits
            a, b = np.searchsorted(wide, [w, w + 1]).tolist()
            tables[w] = a, b, {w: bits[begin[a] : begin[a] + (b - a) * w].reshape(b - a, w)}

        def folded(w: int, to: int) -> np.ndarray:
            have = tables[w][2]
            if to not in have:
                twice = folded(w, 2 * to)
                have[to] = twice[:, :to] ^ twice[:, to:]
            return have[to]

        low, high = np.searchsorted(100 * size, percent * size).tolist(), np.searchsorted(percent * size, 100 * size, "right").tolist()
        left, out = np.ones(len(node), bool), ([], [])
        for seed in range(len(node)):
            front = [seed] if left[seed] else []
            left[seed] = False
            while front:
                i = front.pop()
                v = int(wide[i])
                for w, (a, b, _) in tables.items():
                    a, b = max(a, low[i]), min(b, high[i])
                    if a >= b:
                        continue
                    these, to = np.flatnonzero(left[a:b]) + a, min(v, w)
                    if not len(these):
                        continue
                    own, table = folded(v, to)[i - tables[v][0]], folded(w, to)
                    for part in np.array_split(these, len(these) * to // 400_000 + 1):
                        differ = np.bitwise_count(table[part - tables[w][0]] ^ own).sum(1, dtype=np.int64)
                        more = part[(100 + percent) * differ <= (100 - percent) * (size[i] + size[part])]
                        left[more] = False
                        out[0].append(np.full(len(more), node[i]))
                        out[1].append(node[more])
                        front += more.tolist()
        return out

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in grouped(pa.Table.from_batches(held).combine_chunks()))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINKS)

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column("region").to_numpy()
            edge = [*runs(region).tolist(), len(region)]
            for a, b in zip(edge, edge[1:], strict=False):
                if held and region[a] != last:
                    yield said(held)
                    held = []
                last = region[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield said(held)

    return group


def _lister(n: int, bits: int, known):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            row, gram = _sets(Words(batch.column("text"), fold=LOWER), n)
            size, node, _ = _nodes(row, gram, batch.num_rows, bits, known.value[2])
            keep = _once(node)
            edges = np.r_[0, np.cumsum(size[keep])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.ListArray.from_arrays(pa.array(edges), pa.array(gram[keep[row]].view(np.int64)))], schema=_SETS)

    return listed


def _joined(node: np.ndarray, size: np.ndarray, own: np.ndarray, element: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links among the members of one region connect; ``own`` are places in ``node``."""
    count = np.bincount(own, minlength=len(node))
    _, code, many = np.unique(element, return_inverse=True, return_counts=True)
    common = many[code] > 1
    _, code = np.unique(code[common], return_inverse=True)
    row, both = own[common], np.zeros((len(node), len(node)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    step = max(1, 2_000_000 // len(node))  # so many elements at once
    for first in range(0, int(code.max(initial=-1)) + 1, step):
        a, b = np.searchsorted(code, [first, first + step])
        table = np.zeros((len(node), step), np.float32)
        table[row[a:b], code[a:b] - first] = 1
        both += table @ table.T
    both = both.astype(np.int64)
    away = count[:, None] + count[None, :] - 2 * both
    near = (100 + percent) * away <= (100 - percent) * (size[:, None] + size[None, :])
    left, out = np.ones(len(node), bool), []
    for i in range(len(node)):
        front = [i] if left[i] else []
        left[i] = False
        while front:
            more = np.flatnonzero(near[front.pop()] & left)
            left[more] = False
            out += [(int(node[i]), int(node[j])) for j in more]
            front += more.tolist()
    return out


def _joiner(percent: int):
    """Rows ``region, node, size, d`` sorted by region to links."""

    def whole(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(rows).combine_chunks()
        d = rows.column("d").combine_chunks()
        count = pa.compute.list_value_length(d).to_numpy()
        if rows.num_rows < 2:
            return []
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        own = np.repeat(np.arange(rows.num_rows), count)
        keep = np.zeros(rows.num_rows, bool)
        keep[at] = True
        to = np.zeros(rows.num_rows, np.int64)
        to[at] = np.arange(len(at))
        element = d.flatten().to_numpy()[keep[own]]
        return _joined(node, rows.column("size").to_numpy().astype(np.int64)[at], to[own[keep[own]]], element, percent)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            region = batch.column("region").to_pandas().to_numpy()
            edge = [*runs(region).tolist(), len(region)]
            out: list[tuple[int, int]] = []
            for a, b in zip(edge, edge[1:], strict=False):
                if held and region[a] != last:
                    out += whole(held)
                    held = []
                last = region[a]
                held.append(batch.slice(a, b - a))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=_LINKS)
        out = whole(held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=_LINKS)

    return join


def _regions_joined(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` of regions with at most ``REGION`` members each."""
    return members.select("region", "node", "size", "d").repartition("region").sortWithinPartitions("region").mapInArrow(_joiner(percent), "a long, b long")


def _few(table: DataFrame, most: int) -> DataFrame:
    """A table for a broadcast if it is not longer than ``most``."""
    return F.broadcast(table) if table.count() <= most else table


def _divided(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of recursion over ``region, node, size, d``: links through the pivots, and the members of the next regions, small and large."""
    total = large.groupBy("region").agg(F.count("*").alias("m"))
    count = large.select("region", F.explode("d").alias("e")).groupBy("region", "e").agg(F.count("*").alias("c"))
    total = written(total, "totals")
    count = written(count.join(_few(total, SEND_REGIONS), "region"), "counts")
    median = written(count.where("2 * c > m").groupBy("region").agg(F.collect_list("e").alias("pivot")), "pivots")
    moved = large.join(_few(median, SEND_REGIONS), "region", "left").withColumn("pivot", F.coalesce("pivot", F.array().cast("array<long>")))
    d = F.concat(F.array_except("d", "pivot"), F.array_except("pivot", "d"))
    moved = moved.select("region", "node", "size", d.alias("d"))
    moved = written(moved.withColumn("f", (100 + percent) * F.size("d") - (100 - percent) * F.col("size")), "moved")
    centre = written(moved.groupBy("region").agg(F.min(F.struct("f", "node")).alias("l")), "centres")
    seen = moved.join(_few(centre, SEND_REGIONS), "region")
    ball = seen.where("f + l.f <= 0 and node != l.node").select(F.col("l.node").alias("a"), F.col("node").alias("b"))

    shared = F.greatest(F.ceil((F.col("f") + F.col("l.f")) / (2 * (100 + percent))), F.lit(1))
    parts = seen.select("region", "node", (F.size("d") - shared + 1).alias("sent"), F.explode("d").alias("e")).where("sent > 0")
    parts = parts.join(count, ["region", "e"]).withColumn("c", F.when(2 * F.col("c") > F.col("m"), F.col("m") - F.col("c")).otherwise(F.col("c")))
    place = F.row_number().over(Window.partitionBy("region", "node").orderBy("c", "e"))
    parts = parts.withColumn("place", place).where("place <= sent and c > 1").select("region", "node", F.concat_ws("/", "region", "e").alias("to"))
    parts = written(parts, "parts")
    sizes = parts.groupBy("to").agg(F.count("*").alias("members")).where("members > 1")
    parts = written(parts.join(sizes, "to"), "parts")
    following = parts.join(moved, ["region", "node"]).select(F.col("to").alias("region"), "node", "size", "d", "members")
    following = written(following, "members")
    ball = written(ball, "ball")
    discard(total, count, median, centre)
    return ball, following.where(F.col("members") <= REGION), following.where(F.col("members") > REGION).drop("members")


def linked_nodes(docs: DataFrame, nodes: DataFrame, known, n: int, percent: int, bits: int) -> DataFrame:
    """``a, b`` so that exactly what all links connect is connected. ``docs`` has ``ref, text``; ``nodes`` the ``ref`` of a text of each node and its ``size``."""
    spread = docs.select("text").mapInArrow(_spreader(n, percent, bits, known), "cell long, node long, at long")
    near = spread.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_pairer(percent, REGION), "cell long, a long, b long, m int")
    near = written(near, "near")
    # a pair meets in the largest of its small regions, so that few regions get the sets of a group
    met = near.where("b is not null").groupBy("a", "b").agg(F.max(F.struct("m", "cell")).alias("at")).select("a", "b", F.col("at.cell").alias("region"))
    met = written(met, "met")
    small = met.select("region", F.col("a").alias("node")).unionByName(met.select("region", F.col("b").alias("node"))).distinct()
    small = small.join(nodes.select("node", "size", "ref", "bits"), "node").select("region", "node", "size", "ref", "bits").repartition("region").sortWithinPartitions("region")
    small = written(small.mapInArrow(_sifter(percent), "region long, node long, size int, ref long"), "members")

    def with_sets(members: DataFrame) -> DataFrame:
        wanted = _few(members.select("ref").distinct(), SEND_NODES)
        texts = docs.join(wanted, "ref", "left_semi").select("text")
        sets = texts.mapInArrow(_lister(n, bits, known), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("d"))
        return members.join(sets, "node").select(F.col("region").cast("string").alias("region"), "node", "size", "d")

    links = [written(_regions_joined(with_sets(small), percent), "links")]
    large = near.where("b is null").select(F.col("cell").alias("region"), F.col("a").alias("node"))
    rest = None
    if not large.isEmpty():
        large = large.join(nodes.select("node", "size", "bits"), "node").select("region", "node", "size", "bits").repartition("region").sortWithinPartitions("region", "size", "node")
        close = written(large.mapInArrow(_grouper(percent), "a long, b long").distinct(), "close")
        groups = components(close).withColumnRenamed("component", "region")
        filled = written(with_sets(written(groups.join(nodes.select("node", "size", "ref"), "node"), "groups")), "filled")
        crowded = written(filled.groupBy("region").agg(F.count("*").alias("m")).where(F.col("m") > REGION).select("region"), "crowded")
        links.append(written(_regions_joined(filled.join(_few(crowded, SEND_REGIONS), "region", "left_anti"), percent), "links"))
        rest = filled.join(_few(crowded, SEND_REGIONS), "region", "left_semi")
        discard(close)
    discard(near, met, small)
    while rest is not None and not rest.isEmpty():
        ball, few, rest = _divided(rest, percent)
        links += [ball, written(_regions_joined(few, percent), "links")]
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, node_bits: int = 64) -> DataFrame:
    """One row per document: ``doc, key, n_shingles, component, group``.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a set holds the distinct
    ``n``-word shingles (a shorter text is one shingle). Sets are linked where
    100 * intersection >= ``percent`` * union; ``component`` is the least id reachable by links.

    Null and blank texts have no shingles, are linked with nothing and form a class of their own.
    A null id never names a class; a class of nothing else is named null. ``group`` tells such classes
    apart too (null for texts without shingles). Equal rows fall into one class. ``key`` is a hash of the
    text. Very long texts are shingled whole, in a slice of their own. Other columns are ignored, whatever
    their names. Rows of an empty table: none. Sets are told apart by a hash of ``node_bits`` bits, and by a second one
    where two sets share the first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    signs = written(rows.mapInArrow(_signer(n, node_bits), "doc long, key long, size int, node long, proof long, bits array<long>, gram long, n long"), "signs")
    own = signs.where(F.col("gram").isNull())
    # sets that share a hash: about (number of sets)^2 / 2^65 of them
    shared = own.where("size > 0").groupBy("node").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo != hi").select("node").toArrow().column("node").to_numpy()
    if len(shared):
        hashes = spark.createDataFrame([(int(x),) for x in shared], "shared long")
        own = own.join(F.broadcast(hashes), F.col("node") == F.col("shared"), "left").withColumn("node", F.when(F.col("shared").isNull(), F.col("node")).otherwise(F.col("proof"))).drop("shared")
    nodes = written(own.where("size > 0").groupBy("node").agg(F.max("size").alias("size"), F.min("doc").alias("least"), F.min(_ref()).alias("ref"), F.first("bits").alias("bits")), "nodes")
    frequent = signs.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(FREQUENT_KEPT).toArrow()
    gram, count = frequent.column("gram").to_numpy().astype(np.int64).view(np.uint64), frequent.column("n").to_numpy().astype(np.int64)
    order = np.argsort(gram)
    known = spark.sparkContext.broadcast((gram[order], count[order], np.sort(shared)))
    links = linked_nodes(rows.select(_ref().alias("ref"), "text"), nodes, known, n, percent, node_bits)
    parts = components(links)
    named = written(parts.join(nodes, "node").groupBy("component").agg(F.min("least").alias("name")), "names")
    parts = parts.join(named, "component").select("node", "name", "component")
    classes = nodes.join(parts, "node", "left").select("node", F.coalesce("name", "least").alias("name"), F.coalesce("component", "node").alias("group"))
    out = own.join(written(classes, "classes"), "node", "left")
    return out.select("doc", "key", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("name")).otherwise(F.col("doc")).alias("component"), "group")


def _ref() -> Column:
    return F.xxhash64("key", "doc")
