"""Runs of a period in the words of each document, by a suffix automaton with link-cut access.

The suffix links of the automaton form a tree in which the path from a prefix to the root holds all its
suffixes. Appending a word recolours the path of the new prefix with its place (an access of a link-cut
tree whose preferred paths have one colour each). A segment of the path that had the colour ``j`` says: the
suffixes of these lengths ended last at ``j``. Where the distance ``p = i - j`` is itself one of the lengths,
the word sequence ends in a square of period ``p``; ``p`` is its smallest period, as a smaller one would have
a later last place. The longest of the lengths gives the left end of the run, comparing on gives the right end.

Most texts have no runs. A run of at least twelve words and twice its period is covered by six-word sequences that occur
twice inside it, so a vectorised sieve keeps only stretches of words that such sequences cover, counted
inside the stretch, until nothing more goes. The automaton reads what is left; nothing that holds a run is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import Words, grams, mix, pieces

SLICE_BYTES = 4 << 20
SHORTEST = 12  # words of the shortest run
_GRAM = SHORTEST // 2
_OUT = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and suffix link of every state, and the state of every prefix. State 0 is the root."""
    size, link, steps, prefix, last = [0], [-1], [{}], [], 0
    for x in ids:
        new = len(size)
        size.append(size[last] + 1)
        steps.append({})
        link.append(0)
        at = last
        while at >= 0 and x not in steps[at]:
            steps[at][x] = new
            at = link[at]
        if at >= 0:
            to = steps[at][x]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(size)
                size.append(size[at] + 1)
                steps.append(dict(steps[to]))
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and steps[at].get(x) == to:
                    steps[at][x] = copy
                    at = link[at]
        prefix.append(new)
        last = new
    return size, link, prefix


class _Paths:
    """The preferred paths of a link-cut tree over the states, as splay trees ordered by depth; 0 stands for none.

    ``up`` leads to the parent in the splay tree or, from its top, to the state above the path. The
    colour of a path stands at the top of its splay tree.
    """

    def __init__(self, link: list[int]) -> None:
        self.up = [max(x, 0) for x in link]
        self.left, self.right, self.colour = [0] * len(link), [0] * len(link), [0] * len(link)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = None
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            deep = g and (left[g] == p or right[g] == p)
            if not deep:
                top = p
                self._turn(x, p)
                break
            if not up[g] or (left[up[g]] != g and right[up[g]] != g):
                top = g
            if (left[g] == p) == (left[p] == x):
                self._turn(p, g)
                self._turn(x, p)
            else:
                self._turn(x, p)
                self._turn(x, g)
            if top is not None:
                break
        if top is not None:
            self.colour[x] = self.colour[top]

    def _turn(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        if left[p] == x:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolours the path from ``state`` to the root; the old colours (0: none) and the deepest state of each, from below."""
        seen, below, x = [], 0, state
        while x:
            self._splay(x)
            old, cut = self.colour[x], self.right[x]
            if cut:
                self.colour[cut] = old
            seen.append((old, x))
            self.right[x] = below
            below, x = x, self.up[x]
        self._splay(state)
        self.colour[state] = colour
        return seen


def runs_of(ids: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of at least ``shortest`` entries and twice the period, by start and period."""
    size, link, prefix = _automaton(ids)
    paths, known, found, n = _Paths(link), {}, [], len(ids)
    for end in range(n):
        seen = paths.access(prefix[end], end + 1)
        for k, (old, state) in enumerate(seen):
            if not old:
                continue
            period, most = end + 1 - old, size[state]
            if period > most or known.get(period, -1) >= end or period <= (size[seen[k + 1][1]] if k + 1 < len(seen) else 0):
                continue
            stop = end + 1
            while stop < n and ids[stop] == ids[stop - period]:
                stop += 1
            known[period] = stop - 1
            start = end + 1 - period - most
            if stop - start >= shortest:
                found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _altered(n: int, h: int) -> np.ndarray:
    """The word that stands at each place once the tail from ``a`` repeats its first ``p`` words."""
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _stretches(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one word of all stretches that may hold a run, by the sieve."""
    at, owner = np.arange(len(hashes)), row  # words that are left, and their stretches
    while len(at) >= SHORTEST:
        print_ = grams(hashes[at], _GRAM)
        whole = np.flatnonzero((owner[: len(print_)] == owner[_GRAM - 1 :]) & (at[_GRAM - 1 :] - at[: len(print_)] == _GRAM - 1))
        key = mix(print_[whole] ^ mix(owner[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(whole), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, whole[again], 1)
        np.add.at(change, whole[again] + _GRAM, -1)
        stay = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        new = np.r_[True, (np.diff(at[stay]) > 1) | (owner[stay][1:] != owner[stay][:-1])] if len(stay) else np.zeros(0, bool)
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= SHORTEST if len(part) else new
        before, at, owner = len(at), at[stay[long]], part[long]
        if len(at) == before:
            break
    else:
        at = at[:0]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[edge], (at[np.r_[edge[1:], len(at)] - 1] + 1 if len(at) else edge)


def _scanner(alter: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            words = Words(batch.column("text"))
            source = np.arange(len(words))
            marks = batch.column("mark").to_pylist()
            changed = set()
            for i in range(batch.num_rows) if alter else ():
                n = int(words.count[i])
                if n and marks[i] is not None and marks[i] % 10 == 0:
                    lo = int(words.first[i])
                    source[lo : lo + n] = lo + _altered(n, marks[i])
                    changed.add(i)
            first, stop = _stretches(words.hashes()[source], words.row)
            raw, found = words.buf.tobytes(), {}
            for a, b in zip(first.tolist(), stop.tolist(), strict=True):
                number: dict[bytes, int] = {}
                ids = [number.setdefault(raw[words.start[s] : words.end[s]], len(number)) for s in source[a:b].tolist()]
                i = int(words.row[a])
                found.setdefault(i, []).extend((s + a - int(words.first[i]), size, p) for s, size, p in runs_of(ids))
            rows = []
            for i in range(batch.num_rows):
                lo, hi, runs = int(words.first[i]), int(words.first[i + 1]), sorted(found.get(i, []), key=lambda r: (r[0], r[2]))
                if i in changed or runs:
                    keep = np.ones(hi - lo, bool)
                    for s, size, p in runs:
                        keep[s + p : s + size] = False
                    own = source[lo:hi][keep]
                    kept = b" ".join([raw[x:y] for x, y in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)])
                else:
                    kept = b" ".join(raw[words.edges[i] : words.edges[i + 1]].split())
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                said = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
                milli = 1000 * best[1] // best[2] if runs else None
                rows.append((hi - lo, len(runs), *best, milli, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], schema=_OUT)

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter: bool = False) -> DataFrame:
    """One row per document: ``doc, n_words, n_runs``, the longest run, digests of all runs and of the collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period ``q`` of at least
    ``max(12, 2 q)`` words that no neighbour extends. Of equally long runs the one of least start, then least period, is
    given; without a run ``start, length, period, exponent_milli`` are null. ``collapsed_sha256`` is that of the
    words, joined by a space, without those that some run holds after its first ``q`` words.

    ``alter`` first makes the tails of a tenth of all documents periodic, by a checksum of the id (rows without an id stay).
    Null and empty texts have no words and no runs; equal rows get equal rows; other columns do not matter,
    whatever their names; an empty table gives an empty table. A document is read by one task, whole.
    """
    small_batches(docs.sparkSession)
    number = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(number.alias("doc"), F.crc32(number.cast("string")).alias("mark"), F.col(f"`{text_col}`").alias("text"))
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return rows.mapInArrow(_scanner(alter), ", ".join(f"{f.name} {kinds[f.type]}" for f in _OUT))
