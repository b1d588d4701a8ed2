"""Approximate nearest neighbours by inner product over balanced posting lists.

The number of lists grows with the table, so that a list keeps its length.
Centroids are fitted on a bounded sample by k-means in two levels, whose
assignment costs grow with a list's size, so lists stay balanced. Vectors get one
more component that makes all norms equal; the nearest by Euclidean distance is
then the largest by inner product. A vector is written to its nearest list and,
near a border, to those whose centroids are at most ``closeness`` times as far
as the nearest one, ``copies`` at most. Centroids are searched by best-first walks on a neighbour
graph held in memory by each task; searches for very many centroids measure them all. A query scans the lists whose centroids are
within ``ratio`` of the nearest one's distance, ``probes`` at most.

How many lists that must be depends on the table: in vectors without structure the nearest ones lie in many
lists. So ``probes`` and ``ratio`` are measured: for a few queries the true neighbours are found by a scan of all rows, and
the limits are set such that the lists that hold them would have been asked as often as ``recall`` demands. ``exact`` asks all lists.

The nearest lists are scanned first. What a query has found there bounds what the further lists need to give: only candidates at least as near as
its ``k``-th so far, so that asking many lists does not make many rows.

Lists are cut into blocks of bounded size, and so are the queries of a list, so
neither a hot list nor a repeated vector meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, written

LIST_ROWS = 200  # rows for each list, before copies
MOST_LISTS = 65_536  # 34 MB of centroids in 64 dimensions
SAMPLE = 16_384  # or four for each list, if that is more
BLOCK = 2048
QUERY_BLOCK = 1024
DEGREE = 24
ENTRIES = 8
WALK = 128  # lists that a walk keeps at most; for more, all centroids are measured
FIRST = 16  # lists that a query scans before it has a bound
TUNED = 48  # queries whose true neighbours set the limits


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _balanced(sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and the one of each row."""
    lists = min(lists, len(sample))
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    extra, own = np.zeros(lists), np.zeros(len(sample), np.int64)
    for _ in range(rounds):
        norm, spread = (centres**2).sum(1), 0.0
        for a in range(0, len(sample), 8192):
            cost = norm - 2 * sample[a : a + 8192] @ centres.T
            own[a : a + 8192], spread = (cost + extra).argmin(1), cost.std()
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        extra += 0.1 * spread * (count / max(count.mean(), 1e-9) - 1) / 4
    return centres, own


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    if lists <= 512:
        return _balanced(sample, lists, rng, rounds)[0]
    top = int(np.sqrt(lists))
    _, own = _balanced(sample, top, rng, rounds)
    parts = [sample[own == c] for c in range(top)]
    return np.concatenate([_balanced(p, max(1, round(lists * len(p) / len(sample))), rng, rounds)[0] for p in parts if len(p)])


def neighbour_graph(centres: np.ndarray, seed: int = 7) -> np.ndarray:
    """The nearest centroids of each, and a few random ones so that the graph hangs together."""
    rng = np.random.default_rng(seed)
    norm, k, near = (centres**2).sum(1), len(centres), []
    for a in range(0, k, 1024):
        away = norm - 2 * centres[a : a + 1024] @ centres.T
        away[np.arange(len(away)), a + np.arange(len(away))] = np.inf
        degree = min(DEGREE, k - 1)
        near.append(np.argpartition(away, degree - 1, axis=1)[:, :degree] if degree else np.zeros((len(away), 0), np.int64))
    return np.concatenate([np.concatenate(near), rng.integers(0, k, (k, 4))], axis=1)


def graph_search(x: np.ndarray, centres: np.ndarray, graph: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for all rows of ``x`` at once: lists and distances, nearest first.

    Each row keeps the ``width`` nearest lists it has met; a step walks from the ``wide`` nearest of them it has not
    walked from, so only their neighbours are measured. A row ends when it has walked from all it keeps.
    """
    n, k = len(x), len(centres)
    width = min(width, k)
    norm = (centres**2).sum(1)
    entry = np.unique(np.linspace(0, k - 1, ENTRIES).astype(np.int64))
    met = np.full((n, max(width, len(entry))), -1, np.int64)
    away = np.full(met.shape, np.inf)
    met[:, : len(entry)] = entry
    away[:, : len(entry)] = norm[entry] - 2 * x @ centres[entry].T
    walked = met < 0
    live = np.arange(n)
    while len(live):
        open_ = np.where(walked[live], np.inf, away[live])
        best = np.argsort(open_, axis=1)[:, :wide]
        go = np.take_along_axis(open_, best, 1) < np.inf
        live, best, go = live[go[:, 0]], best[go[:, 0]], go[go[:, 0]]
        if not len(live):
            break
        row = np.broadcast_to(live[:, None], best.shape)
        walked[row[go], best[go]] = True
        to = np.where(go[:, :, None], graph[np.maximum(met[live[:, None], best], 0)], -1).reshape(len(live), -1)
        new = np.where(to >= 0, norm[to] - 2 * np.einsum("nd,nmd->nm", x[live], centres[to]), np.inf)
        ids, d = np.concatenate([met[live], to], axis=1), np.concatenate([away[live], new], axis=1)
        done = np.concatenate([walked[live], np.zeros(to.shape, bool)], axis=1)
        order = np.lexsort((~done, ids), axis=1)  # of one list met twice, the walked one first
        ids, d, done = (np.take_along_axis(v, order, 1) for v in (ids, d, done))
        d[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, : met.shape[1]]
        met[live], away[live] = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        walked[live] = np.take_along_axis(done, order, 1) | ~np.isfinite(away[live])
    order = np.argsort(away, axis=1, kind="stable")[:, :width]
    d2 = np.take_along_axis(away, order, 1) + (x**2).sum(1)[:, None]
    return np.take_along_axis(met, order, 1), np.sqrt(np.maximum(d2, 0))


def all_lists(x: np.ndarray, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest lists of each row and their distances, nearest first, by measuring all centroids."""
    away = (centres**2).sum(1) - 2 * x @ centres.T
    most = min(most, len(centres))
    near = np.argpartition(away, most - 1, axis=1)[:, :most] if most < len(centres) else np.broadcast_to(np.arange(len(centres)), away.shape)
    d = np.take_along_axis(away, near, 1)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.sqrt(np.maximum(np.take_along_axis(d, order, 1) + (x**2).sum(1)[:, None], 0))


def _best_of_all(asked: np.ndarray, own: list[tuple[int, int]], k: int):
    """The ``k`` best rows of each batch for a few queries."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids, keys = _matrix(batch.column("v")), batch.column("id").to_numpy(), batch.column("key").to_numpy()
            score = asked @ v.T
            for i, (doc, key) in enumerate(own):
                score[i, (ids == doc) & (keys == key)] = -np.inf
            n = min(k, score.shape[1])
            best = np.argpartition(-score, n - 1, axis=1)[:, :n]
            row = np.repeat(np.arange(len(score)), n)
            yield pa.RecordBatch.from_pydict({"asked": row.astype(np.int32), "id": ids[best.ravel()], "key": keys[best.ravel()], "score": score[row, best.ravel()]})

    return scan


def _limits(wanted: DataFrame, rows: DataFrame, posted: DataFrame, centres: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """``probes`` and ``ratio`` that a few queries need for ``recall``."""
    some = wanted.orderBy(F.xxhash64("id", "key", F.lit(1)), "id").limit(TUNED).select("id", "key", F.col("v")).toArrow()
    if not some.num_rows:
        return 1, 1.0
    x = _matrix(some.column("v").combine_chunks())
    own = list(zip(some.column("id").to_pylist(), some.column("key").to_pylist(), strict=True))
    best = rows.select("id", "key", "v").mapInArrow(_best_of_all(x, own, k), "asked int, id long, key long, score double").where("score > double('-infinity')")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id", "key"))
    true = best.withColumn("place", place).where(F.col("place") <= k).select("asked", "id", "key")  # TUNED times k rows
    held = posted.select("list", "id", "key").join(F.broadcast(true), ["id", "key"]).select("asked", "id", "key", "list").toArrow()
    if not held.num_rows:
        return 1, 1.0
    away = np.sqrt(np.maximum((centres**2).sum(1) - 2 * np.c_[x, np.zeros(len(x))] @ centres.T + (x**2).sum(1)[:, None], 0))
    rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
    asked, lists = held.column("asked").to_numpy(), held.column("list").to_numpy()
    need: dict[tuple, list[float]] = {}
    for q, doc, key, r, d in zip(asked.tolist(), held.column("id").to_pylist(), held.column("key").to_pylist(), rank[asked, lists].tolist(), (away[asked, lists] / np.maximum(away.min(axis=1)[asked], 1e-12)).tolist(), strict=True):
        have = need.setdefault((q, doc, key), [r, d])
        have[0], have[1] = min(have[0], r), min(have[1], d)
    ranks, ratios = np.array(list(need.values())).T
    share = (1 + recall) / 2  # each limit may lose half of what may be lost
    return int(np.quantile(ranks, share, method="higher")) + 1, float(np.quantile(ratios, share, method="higher")) + 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def chosen_lists(away: np.ndarray, most: int, limit: float) -> np.ndarray:
    """Which of the lists found, nearest first, a query asks or a vector is written to: ``most``, within ``limit`` times the nearest one's distance."""
    keep = ((away <= limit * away[:, :1] + 1e-12) if np.isfinite(limit) else np.ones(away.shape, bool)) & np.isfinite(away)
    keep[:, most:] = False
    return keep


def _to_lists(index, most: int, limit: float, query: bool):
    kind = pa.schema([("place", pa.int32()), ("list", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("c", pa.int64()), ("v", pa.list_(pa.float64()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, graph, top = index.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                v = _matrix(batch.column("v"))
                more = np.zeros(len(v)) if query else np.sqrt(np.maximum(top * top - (v**2).sum(1), 0))
                near, away = graph_search(np.c_[v, more], centres, graph, most + 8) if most + 8 <= WALK else all_lists(np.c_[v, more], centres, most)
                row, rank = np.nonzero(chosen_lists(away, most, limit))
                edges = np.arange(0, len(row) * v.shape[1] + 1, v.shape[1], dtype=np.int32)
                same = [batch.column(c).take(pa.array(row)) for c in ("id", "key", "c")]
                yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int32)), pa.array(near[row, rank].astype(np.int32)), *same, pa.ListArray.from_arrays(pa.array(edges), pa.array(v[row].ravel()))], schema=kind)

    return assign


_FOUND = "query_id long, query_key long, query_c long, vec_id long, key long, c long, score double"


def _scan(k: int):
    kind = pa.schema([(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in _FOUND.split(", ")])

    def scan(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return kind.empty_table()
        queries, rows = queries.combine_chunks(), rows.combine_chunks()
        q, v = (_matrix(t.column("v").combine_chunks()) for t in (queries, rows))
        (qid, qkey, qc), (vid, vkey, vc) = ([t.column(c).to_numpy() for c in ("id", "key", "c")] for t in (queries, rows))
        bound = queries.column("bound").to_numpy()
        out: list[list[np.ndarray]] = [[] for _ in kind]
        for a in range(0, len(q), 128):
            score = q[a : a + 128] @ v.T
            own = (qid[a : a + 128, None] == vid[None, :]) & (qkey[a : a + 128, None] == vkey[None, :])
            score[own & (vc == 1)[None, :]] = -np.inf
            n = min(k, score.shape[1])
            least = np.maximum(np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n], bound[a : a + 128])
            slack = 1e-12 * np.sqrt((q[a : a + 128] ** 2).sum(1)) * np.sqrt((v**2).sum(1).max())
            for i in range(len(score)):
                some = np.flatnonzero((score[i] >= least[i] - slack[i]) & (score[i] > -np.inf))
                exact = (q[a + i] * v[some]).sum(1)  # the same for equal vectors, wherever they stand
                some = some[order := np.lexsort((vid[some], -exact))[:k]]
                parts = [np.full(len(some), x[a + i]) for x in (qid, qkey, qc)] + [vid[some], vkey[some], vc[some] - own[i, some], exact[order]]
                for o, x in zip(out, parts, strict=True):
                    o.append(x)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in out], schema=kind)

    return scan


def _scanned(asked: DataFrame, posted: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query in each block of its lists."""
    cuts = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cuts = written(cuts.join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts")), "list"), "cuts")
    # one row for each list: MOST_LISTS bounds it
    cut = F.broadcast(cuts)
    block, part = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(cut, "list").select("list", part.alias("part"), upto("blocks").alias("block"), "id", "key", "c", "v", "bound")
    right = posted.join(cut, "list").select("list", upto("parts").alias("part"), block.alias("block"), "id", "key", "c", "v")
    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan(k), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best different candidates of each query."""
    best = found.groupBy("query_id", "query_key", "vec_id", "key").agg(F.max("score").alias("score"), F.max("c").alias("c"), F.max("query_c").alias("query_c"))
    window = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key")
    return best.withColumn("before", F.row_number().over(window)).where(F.col("before") <= k).select("query_id", "query_key", "query_c", "vec_id", "key", "c", "score")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, lists: int | None = None, copies: int = 4, probes: int | None = None, ratio: float | None = None, closeness: float = 1.03, recall: float = 0.96, exact: bool = False) -> DataFrame:
    """The ``k`` nearest found of each row of ``queries`` among all rows of ``vectors`` but its own: ``query_id, rank, vec_id, score``.

    ``score`` is the inner product in double precision; ties go to the smaller id. Vectors that are
    null, zero or hold null or non-finite components, those of another than the most frequent dimension, and rows
    with a null id, take no part on either side. A query's own row is one of its id and vector; further rows of them, and rows of its id with other
    vectors, are candidates, and rows that are repeated in ``queries`` are answered each. Fewer candidates than ``k`` give fewer rows; an
    empty table gives none. Other columns are ignored, whatever their names. Every vector is indexed; only the centroids are fitted,
    on at most ``SAMPLE`` vectors or four for each list. Without ``probes`` and ``ratio`` these are measured for ``recall``; with ``exact`` all lists are asked.
    """
    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
        return rows.select("id", F.col("v").cast("array<double>").alias("v"))

    common = clean(vectors).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if common is None:
        return spark.createDataFrame([], kind)

    def counted(df: DataFrame) -> DataFrame:
        rows = clean(df).where(F.size("v") == common["size"])
        return rows.groupBy("id", "v").agg(F.count("*").alias("c")).select("id", F.xxhash64("v").alias("key"), "c", "v")

    rows = written(counted(vectors), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.agg(F.count("*").alias("n"), F.sum("c").alias("rows"), F.max(norm).alias("top")).first()
    count = lists or min(MOST_LISTS, max(1, facts["n"] // LIST_ROWS))
    sample = rows.orderBy(F.xxhash64("id", "key"), "id").limit(max(SAMPLE, 4 * count)).select(F.col("v").cast("array<float>").alias("v")).toArrow()
    base = _matrix(sample.column("v").combine_chunks())
    centres = fit_centroids(np.c_[base, np.sqrt(np.maximum(facts["top"] ** 2 - (base**2).sum(1), 0))], count)
    index = spark.sparkContext.broadcast((centres, neighbour_graph(centres), facts["top"]))
    kinds = "place int, list int, id long, key long, c long, v array<double>"
    posted = written(rows.mapInArrow(_to_lists(index, copies, closeness, False), kinds), "postings")
    wanted = written(counted(queries), "queries")
    if exact:
        probes, ratio = len(centres), float("inf")
    elif probes is None or ratio is None:
        measured = _limits(wanted, rows, posted, centres, k, recall)
        probes, ratio = probes or measured[0], ratio or measured[1]
    asked = written(wanted.mapInArrow(_to_lists(index, probes, ratio, True), kinds), "probes")
    none = F.lit(float("-inf")).alias("bound")
    near = written(_best(_scanned(asked.where(F.col("place") < FIRST).select("list", "id", "key", "c", "v", none), posted, k), k), "near")
    bound = near.groupBy(F.col("query_id").alias("id"), F.col("query_key").alias("key")).agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    further = asked.where(F.col("place") >= FIRST).join(bound, ["id", "key"], "left").select("list", "id", "key", "c", "v", F.coalesce("bound", none).alias("bound"))
    found = written(near.unionByName(_scanned(further, posted, k)), "found")
    # queries whose lists held too few candidates: all lists, in the same blocks
    need = min(k, facts["rows"] - 1)
    different = found.groupBy("query_id", "query_key", "vec_id", "key").agg(F.max("c").alias("c"))
    known = different.groupBy("query_id", "query_key").agg(F.sum("c").alias("n")).where(F.col("n") >= need).select(F.col("query_id").alias("id"), F.col("query_key").alias("key"))
    short = written(wanted.join(known, ["id", "key"], "left_anti"), "short")
    if not short.isEmpty():
        rest = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(centres) - 1))).alias("list"), "id", "key", "c", "v", none)
        found = found.unionByName(_scanned(rest, posted, k))
    best = _best(found, k)
    # repeated rows are so many candidates, and so many queries
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("c", F.lit(k).cast("long")).cast("int"))))
    again = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id", "key", "copy")
    best = best.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    discard(asked)
    return best.withColumn("asked", F.explode(F.sequence(F.lit(1), F.col("query_c").cast("int")))).select("query_id", "rank", "vec_id", "score")
