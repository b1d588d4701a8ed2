"""Packing token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the corpus enters the plan as a
histogram with at most ``capacity`` counts, whatever its size. The plan:

1. Lengths above ``capacity // 8`` are large. In descending order they are cut
   into groups of equal cardinality and rounded up to the longest of their group.
2. Configurations of these few sizes that fill a sequence are chosen by linear
   programming with column generation (an integer knapsack finds each new
   column) and rounded down; what is left is packed by best fit, decreasing.
3. Actual lengths take the places of the rounded ones.
4. The loosest sequences are taken apart again. What they held and all small lengths, longest first, go to the fullest
   sequence that has room. Of several limits of looseness the one with the fewest sequences counts; the last limit takes
   everything apart, so there are never more sequences than best fit alone would make.

Sequences with equal contents are planned once, with a count. So the plan is a
short table: of the documents of one length, those of rank ``lo`` to ``hi`` go
to sequences ``base`` on, at ``offset``. Spark ranks the pieces of each length
and joins the table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, text_key, written
from .textops import pieces
from .tokens import encoder

SLICE_BYTES = 4 << 20
GROUPS = 64
LOOSE = (256, 128, 64, 32, 16, 8, 4, 2, 1, 0, -1)  # room of sequences that are taken apart and filled again
RANK_ROWS = 50_000  # pieces of one length that are ranked together, about
_PIECES = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """A basis of the linear program: least number of sequences that hold ``demand``."""
    n, size, need = len(sizes), np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // size).astype(float)
    for _ in range(rounds):
        price = np.linalg.solve(columns.T, np.ones(n))
        best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(size.min()), capacity + 1):
            fits = size <= c
            value = np.where(fits, best[np.where(fits, c - size, 0)] + price, -1)
            i = int(value.argmax())
            best[c], taken[c] = (value[i], i) if value[i] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(n), capacity
        while c > 0:
            if taken[c] < 0:
                c -= 1
            else:
                new[taken[c]] += 1
                c -= sizes[taken[c]]
        step, have = np.linalg.solve(columns, new), np.linalg.solve(columns, need)
        ratio = np.where(step > 1e-9, np.maximum(have, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(ratio.argmin())] = new
    have = np.linalg.solve(columns, need)
    return [(columns[:, i].astype(int), float(have[i])) for i in range(n)]


def _fit(runs: dict[int, list[dict]], rooms: list[int], length: int, rank: int, count: int, capacity: int) -> None:
    """Best fit of ``count`` pieces of one length into runs of equal sequences, kept by the room they have."""
    while count:
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            run = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
        else:
            room, run = capacity, {"n": -1, "slots": []}
        each = min(room // length, count)
        whole = count // each if run["n"] < 0 else min(run["n"], count // each)
        if run["n"] > whole:
            rest = {"n": run["n"] - whole, "slots": [(x, r + whole) for x, r in run["slots"]]}
            if room not in runs:
                insort(rooms, room)
            runs.setdefault(room, []).append(rest)
        done = {"n": whole, "slots": run["slots"] + [(length, rank + j * whole) for j in range(each)]}
        room -= each * length
        if room not in runs:
            insort(rooms, room)
        runs.setdefault(room, []).append(done)
        rank, count = rank + each * whole, count - each * whole


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Rows ``length, lo, hi, base, offset``; see the module."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if x > capacity // 8]
    total = sum(n for _, n in large)
    queues: list[list[list[int]]] = []
    taken, group = 0, -1
    for x, n in large:
        rank = 0
        while n:
            g = taken * groups // total
            part = min(n, -(-(g + 1) * total // groups) - taken)
            if g != group:
                group = g
                if queues and queues[-1][0][0] == x:  # rounded to the same length: one group
                    pass
                else:
                    queues.append([])
            queues[-1].append([x, rank, part])
            rank, n, taken = rank + part, n - part, taken + part
    sizes = [q[0][0] for q in queues]
    left = [sum(p[2] for p in q) for q in queues]
    chosen: list[tuple[list[int], int]] = []
    if sizes:
        for column, amount in sorted(_configurations(sizes, left, capacity), key=lambda x: -x[1]):
            times = int(amount + 1e-6)
            if times > 0 and column.any():
                chosen.append((column.tolist(), times))
                left = [max(0, a - times * b) for a, b in zip(left, column.tolist(), strict=True)]
    filled: list[dict] = []

    def pull(q: list[list[int]], n: int) -> list[tuple[int, int, int]]:
        out = []
        while n and q:
            x, rank, m = q[0]
            k = min(n, m)
            out.append((x, rank, k))
            n -= k
            if k == m:
                q.pop(0)
            else:
                q[0] = [x, rank + k, m - k]
        return out

    for column, times in chosen:
        places = [pull(queues[g], times) for g, b in enumerate(column) for _ in range(b)]
        edges = sorted({0, times, *[e for p in places for e in np.cumsum([k for _, _, k in p]).tolist()]})
        for a, b in zip(edges, edges[1:], strict=False):
            slots = []
            for p in places:
                done = 0
                for x, rank, k in p:
                    if done <= a < done + k:
                        slots.append((x, rank + a - done))
                    done += k
            if slots:
                filled.append({"n": b - a, "slots": slots})
    rest = [(x, rank, n) for q in queues for x, rank, n in q] + [(x, 0, n) for x, n in counts.items() if x <= capacity // 8]
    best: dict[int, list[dict]] | None = None
    for loosest in (capacity, *LOOSE):
        runs = _refilled(filled, rest, loosest, capacity)
        if best is None or _size(runs) < _size(best):
            best = runs
    rows, base = [], 0
    for room in sorted(best):
        for run in best[room]:
            offset = 0
            for x, rank in run["slots"]:
                rows.append((x, rank, rank + run["n"], base, offset))
                offset += x
            base += run["n"]
    return rows


def _size(runs: dict[int, list[dict]]) -> int:
    return sum(r["n"] for same in runs.values() for r in same)


def _refilled(filled: list[dict], rest: list[tuple[int, int, int]], loosest: int, capacity: int) -> dict[int, list[dict]]:
    """Runs of sequences by room: those with more room than ``loosest`` are taken apart again, and what they held and all the rest goes, longest first, to the fullest sequence that has room."""
    runs: dict[int, list[dict]] = {}
    rooms: list[int] = []
    loose = list(rest)
    for run in filled:
        room = capacity - sum(x for x, _ in run["slots"])
        if room > loosest:
            loose += [(x, rank, run["n"]) for x, rank in run["slots"]]
            continue
        if room not in runs:
            insort(rooms, room)
        runs.setdefault(room, []).append(run)
    for x, rank, n in sorted(loose, key=lambda p: (-p[0], p[1])):
        _fit(runs, rooms, x, rank, n, capacity)
    return runs


def _cutter(tokenizer: str, end_id: int, capacity: int, with_ids: bool, added_tokens: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer, added_tokens)
        end = np.array([end_id], "<u4")
        schema = _PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _PIECES
        for batch in pieces(batches, "text", SLICE_BYTES):
            rows = []
            whole, edges = tool.encode_column(batch.column("text"))
            whole = whole.astype("<u4")
            for doc, key, raw in zip(batch.column("doc").to_pylist(), batch.column("key").to_pylist(), np.split(whole, edges[1:-1]), strict=True):
                ids = np.r_[raw, end]
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, key, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), *[ids[a:b]] * with_ids))
            yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(schema.names)}, schema=schema)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 1024, with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """Pieces ``doc, key, piece, start, length, ids_crc32`` of at most ``capacity`` ids; of a longer text the first may be shorter. ``added_tokens`` as in ``Encoder``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = "doc long, key long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids, added_tokens), kind)


def pack(cut: DataFrame, capacity: int = 1024, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``doc, key, piece, length``.

    Lengths outside 1 to ``capacity`` are an error. Pieces of equal rows are packed each. An empty
    table stays empty. ``cut`` is read several times: give a written table.
    """
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 1).collect()}
    # one length may be that of a third of all pieces, so the ranks are counted in as many parts as the most frequent length needs
    buckets = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS))
    rows = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc", "key", "piece"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    table = spark.createDataFrame(plan(histogram, capacity, groups), "length long, __lo long, __hi long, __base long, offset long")
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "__bucket").orderBy("doc", "key", "piece")
    ranked = rows.join(counts, ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.row_number().over(inside) - 1)
    # the plan has a few thousand rows: no more than configurations and lengths allow
    placed = ranked.alias("p").join(F.broadcast(table.alias("t")), (F.col("p.length") == F.col("t.length")) & (F.col("p.__rank") >= F.col("t.__lo")) & (F.col("p.__rank") < F.col("t.__hi")))
    return placed.select(*[F.col(f"p.{c}") for c in cut.columns], (F.col("t.__base") + F.col("p.__rank") - F.col("t.__lo")).alias("sequence_id"), F.col("t.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """Cuts and packs all texts (null: empty): ``doc, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = written(token_pieces(docs, tokenizer, id_col, text_col, end_id, capacity, added_tokens=added_tokens), "pieces")
    return pack(cut, capacity).select("doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of packed pieces that carry their ids: whole training sequences."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
