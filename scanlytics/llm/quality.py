"""A quality classifier by co-training of two views of a document.

The content view sees the text: the shape of its words and the presence of the
words that tell labelled classes apart. The metadata view sees language, source
and length. Over rounds each view labels the unlabelled documents of which it
is sure, and the other view learns from them. Both are then calibrated on
held-out labels and their calibrated outputs are combined.

At most ``labelled`` labelled documents, chosen by a hash of the id, are used.
The exchange sees every document: a table of features is written once, each
round scores all of it in Spark, and only the surest documents come back, at
most ``pseudo`` for a view and a round. Every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, small_batches, text_key, written
from .textops import LOWER, SPACES, Words, pieces

SLICE_BYTES = 2 << 20
WORDS_CHOSEN = 256
BUCKETS = 48  # of hashed languages and sources
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASSES = np.full(256, 5)
_CLASSES[[*range(97, 123), *range(128, 256)]] = 0
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[[44, 46]] = 3
_CLASSES[[*range(9, 14), 32]] = 4
SHAPES = 14


def shapes(column: pa.Array) -> np.ndarray:
    """Per text: log lengths, shares of character kinds, word length and the share of words with inner symbols."""
    words = Words(column, table=SPACES)
    n, data = len(column), words.buf[:-8]
    row = np.repeat(np.arange(n), np.diff(words.edges))
    kinds = np.bincount(row * 6 + _CLASSES[data], minlength=6 * n).reshape(n, 6)[:, :6]
    size, count = np.diff(words.edges), words.count
    share = kinds / np.maximum(size, 1)[:, None]
    symbol = np.r_[0, np.cumsum(_CLASSES[data] == 5)]
    marked = np.bincount(words.row, weights=symbol[words.end] > symbol[words.start], minlength=n) / np.maximum(count, 1)
    first = words.buf[words.start] if len(words) else np.zeros(0, np.uint8)
    capital = np.bincount(words.row, weights=(_CLASSES[first] == 1), minlength=n) / np.maximum(count, 1)
    lines = np.bincount(row[data == 10], minlength=n)
    return np.c_[np.log1p(size), np.log1p(count), share, size / np.maximum(count, 1) / 10, marked, capital, np.log1p(lines), count < 8, count == 0].astype(np.float32)


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owners and hashes of the distinct lower-case words."""
    words = Words(column, table=_LETTERS, fold=LOWER)
    hashes, row = words.hashes(), words.row
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], hashes[new]


def buckets(lang: list, source: list) -> list[np.ndarray]:
    return [np.array([zlib.crc32(f"{j}{x}".encode()) % BUCKETS for x in values], np.int32) for j, values in enumerate((lang, source))]


def metadata(lang: np.ndarray, source: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The metadata view, from the buckets of language and source, and the length."""
    out = np.zeros((len(size), BUCKETS + 4), np.float32)
    for values in (lang, source):
        out[np.arange(len(size)), values] = 1
    length = np.log1p(np.maximum(size, 0))
    out[:, BUCKETS:] = np.c_[length, length**2 / 10, size < 60, size > 20_000]
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-3, rounds: int = 150) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = ((x - mean) / scale).clip(-8, 8)
        share = weight if weight is not None else np.ones(len(y))
        share = share / share.sum()
        w, b = np.zeros(z.shape[1]), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for i in range(1, rounds + 1):
            error = (1 / (1 + np.exp(-(z @ w + b).clip(-30, 30))) - y) * share
            g = np.r_[z.T @ error + penalty * w, error.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return cls(mean, scale, w, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.bias).clip(-15, 15)


@dataclass
class CoTrained:
    """Both views of one target, their calibrations, and the combination."""

    content: Logistic
    meta: Logistic
    joint: Logistic
    calibration: list[Logistic]

    @classmethod
    def fit(cls, content: np.ndarray, meta: np.ndarray, y: np.ndarray, views: list[Logistic]) -> CoTrained:
        """Calibrates ``views`` on held-out rows and combines them."""
        raw = [views[0].logit(content), views[1].logit(meta)]
        calibration = [Logistic.fit(r[:, None], y, penalty=1e-4) for r in raw]
        for c in calibration:  # a surer view never lowers the probability
            c.weight = np.maximum(c.weight, 0)
        both = np.c_[calibration[0].logit(raw[0][:, None]), calibration[1].logit(raw[1][:, None])]
        return cls(views[0], views[1], Logistic.fit(both, y, penalty=1e-4), calibration)

    def score(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0].logit(self.content.logit(content)[:, None])
        b = self.calibration[1].logit(self.meta.logit(meta)[:, None])
        return tuple(1 / (1 + np.exp(-x)) for x in (a, b, self.joint.logit(np.c_[a, b])))


_FEATURES = "key long, shape array<float>, present binary, lang int, source int, size long"


def _featured(chosen):
    """The features of each text, as a short row."""
    kind = pa.schema([("key", pa.int64()), ("shape", pa.list_(pa.float32())), ("present", pa.binary()), ("lang", pa.int32()), ("source", pa.int32()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            row, words = plain_words(batch.column("text"))
            present = np.packbits(_presence(row, words, chosen.value, batch.num_rows).astype(bool), axis=1)
            shape = shapes(batch.column("text"))
            edges = np.arange(0, shape.size + 1, shape.shape[1], dtype=np.int32)
            lang, source = buckets(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            arrays = [batch.column("key"), pa.ListArray.from_arrays(pa.array(edges), pa.array(shape.ravel())), pa.array([x.tobytes() for x in present], pa.binary()), pa.array(lang), pa.array(source), batch.column("size")]
            yield pa.RecordBatch.from_arrays(arrays, schema=kind)

    return run


def _views(table: pa.Table | pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Content and metadata of rows of features."""
    column = lambda c: table.column(c).combine_chunks() if isinstance(table, pa.Table) else table.column(c)
    n = table.num_rows
    shape = column("shape").flatten().to_numpy().reshape(n, -1)
    width = (words + 7) // 8
    present = np.frombuffer(b"".join(column("present").to_pylist()), np.uint8).reshape(n, width)
    content = np.c_[shape, np.unpackbits(present, axis=1)[:, :words].astype(np.float32)]
    return content, metadata(column("lang").to_numpy(), column("source").to_numpy(), column("size").to_numpy())


def _sure(models, words: int, most: int, sure: float):
    """Of each batch the surest ``most`` texts for every target, view and label."""
    kind = pa.schema([("target", pa.int32()), ("view", pa.int32()), ("label", pa.int32()), ("p", pa.float64()), ("key", pa.int64()), ("shape", pa.list_(pa.float32())), ("present", pa.binary()), ("lang", pa.int32()), ("source", pa.int32()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, used = models.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            once = np.zeros(len(key), bool)
            once[np.unique(key, return_index=True)[1]] = True
            both = _views(batch, words)
            for target, views in fitted.items():
                free = once & ~np.isin(key, used[target])
                for view in (0, 1):
                    p = 1 / (1 + np.exp(-views[view].logit(both[view])))
                    for label, q in ((1, p), (0, 1 - p)):
                        some = np.flatnonzero(free & (q >= sure))
                        some = some[np.lexsort((key[some], -q[some]))[:most]]
                        n = len(some)
                        head = [pa.array(np.full(n, x, np.int32)) for x in (target, view, label)]
                        yield pa.RecordBatch.from_arrays([*head, pa.array(q[some]), *[c.take(pa.array(some)) for c in batch.columns]], schema=kind)

    return run


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each kind each word is."""
    for batch in pieces(batches, "text", SLICE_BYTES):
        row, words = plain_words(batch.column("text"))
        names, at = np.unique(words, return_inverse=True)
        out = {"word": names.view(np.int64)}
        for name in ("quality", "toxic"):
            y = batch.column(name).fill_null(-1).to_numpy()[row]
            for end, value in (("yes", 1), ("no", 0)):
                out[f"{name}_{end}"] = np.bincount(at[y == value], minlength=len(names))
        yield pa.RecordBatch.from_pydict(out)


def _presence(row: np.ndarray, words: np.ndarray, chosen: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, len(chosen)), np.float32)
    if len(chosen) and len(words):
        at = np.minimum(np.searchsorted(chosen, words), len(chosen) - 1)
        hit = chosen[at] == words
        out[row[hit], at[hit]] = 1
    return out


def _telling(counts: DataFrame, name: str, yes: int, no: int, many: int) -> np.ndarray:
    """The words whose presence tells the classes apart best, by a smoothed log-odds ratio over its error."""
    a, b = F.col(f"{name}_yes") + 0.5, F.col(f"{name}_no") + 0.5
    c, d = yes - F.col(f"{name}_yes") + 0.5, no - F.col(f"{name}_no") + 0.5
    value = F.abs(F.ln(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = counts.where(F.col(f"{name}_yes") + F.col(f"{name}_no") >= 3).orderBy(F.desc(value), "word").limit(many)
    return best.select("word").toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64)


@dataclass
class QualityModel:
    chosen: np.ndarray
    quality: CoTrained | None
    toxic: CoTrained | None

    def score(self, column: pa.Array, meta: np.ndarray) -> list[np.ndarray]:
        row, words = plain_words(column)
        content = np.c_[shapes(column), _presence(row, words, self.chosen, len(column))]
        n, out = len(column), []
        for model, default in ((self.quality, 1.0), (self.toxic, 0.0)):
            out += list(model.score(content, meta)) if model else [np.full(n, default)] * 3
        return out


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"))


def fit_quality_model(docs: DataFrame, labels: DataFrame, labelled: int = 6000, pseudo: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rounds: int = 3, sure: float = 0.97) -> QualityModel:
    """Fits both targets of ``labels`` (``doc_id, quality, toxic``) on the bounded sample and all documents.

    Labels without an id are left out, and for a target those without its value; of several for one id the smallest counts. A target
    with fewer than 10 documents in a class is not learned: then all are good, or none toxic. In each round each view hands
    the other at most ``pseudo`` documents of which it is at least ``sure``, by class as the labels are; copies of a text count once.
    Very long texts enter whole. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col, lang_col, source_col).withColumn("key", F.xxhash64(F.coalesce(text_key(F.col("text")), F.lit(0)), "lang", "source"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc is not null and coalesce(quality, toxic) is not null").groupBy("doc").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    taken = known.join(rows.select("doc").distinct(), "doc", "left_semi").orderBy(F.xxhash64("doc"), "doc").limit(labelled)
    truth = written(taken, "labels")  # ``labelled`` rows at most
    one = rows.join(F.broadcast(truth), "doc").groupBy("doc", "quality", "toxic").agg(F.min_by(F.struct("text", "lang", "source", "size", "key"), "key").alias("r"))
    sample = written(one.select("doc", "quality", "toxic", "r.*"), "sample")
    counts = ", ".join(f"{t}_{e} long" for t in ("quality", "toxic") for e in ("yes", "no"))
    words = sample.select("text", F.signum("quality").cast("int").alias("quality"), F.signum("toxic").cast("int").alias("toxic")).mapInArrow(_worded, f"word long, {counts}")
    words = written(words.groupBy("word").agg(*[F.sum(f"{t}_{e}").alias(f"{t}_{e}") for t in ("quality", "toxic") for e in ("yes", "no")]), "words")
    size = sample.agg(*[F.count_if(F.col(t) > 0 if e else F.col(t) <= 0).alias(f"{t}{e}") for t in ("quality", "toxic") for e in (1, 0)]).first()
    learned = [t for t in ("quality", "toxic") if min(size[f"{t}1"], size[f"{t}0"]) >= 10]
    if not learned:
        return QualityModel(np.zeros(0, np.uint64), None, None)
    chosen = np.unique(np.concatenate([_telling(words, t, size[f"{t}1"], size[f"{t}0"], WORDS_CHOSEN // 2) for t in learned]))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chosen)
    table = sample.select("text", "lang", "source", "size", F.col("doc").alias("key")).mapInArrow(_featured(shared), _FEATURES).toArrow().sort_by("key")
    facts = sample.select("doc", "quality", "toxic", "key").toArrow().sort_by("doc")
    content, meta = _views(table, len(chosen))
    order = np.random.default_rng(1).permutation(len(content))  # so that held-out rows are random ones
    parts, views, added, used = {}, {}, {}, {}
    for i, name in enumerate(("quality", "toxic")):
        if name in learned:
            y = facts.column(name).to_pylist()
            place = np.array([j for j in order if y[j] is not None])
            y, hold = np.array([y[j] > 0 for j in place], float), np.arange(len(place)) % 4 == 0  # for calibration only
            parts[i] = content[place[~hold]], meta[place[~hold]], y[~hold], (content[place[hold]], meta[place[hold]], y[hold])
            views[i] = [Logistic.fit(x, y[~hold]) for x in parts[i][:2]]
            added[i] = [(np.zeros((0, x.shape[1]), np.float32), np.zeros(0)) for x in parts[i][:2]]
            used[i] = facts.column("key").to_numpy()
    pool = written(rows.select("text", "lang", "source", "size", "key").mapInArrow(_featured(shared), _FEATURES), "features") if rounds else None
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((views, used))
        found = pool.mapInArrow(_sure(state, len(chosen), pseudo, sure), f"target int, view int, label int, p double, {_FEATURES}")
        found = found.dropDuplicates(["target", "view", "label", "key"])
        place = F.row_number().over(Window.partitionBy("target", "view", "label").orderBy(F.desc("p"), "key"))
        best = found.withColumn("place", place).where(F.col("place") <= pseudo).toArrow().sort_by([("target", "ascending"), ("view", "ascending"), ("label", "descending"), ("place", "ascending")])
        if not best.num_rows:
            break
        more = _views(best, len(chosen))
        target, view, label, key, at = (best.column(c).to_numpy() for c in ("target", "view", "label", "key", "place"))
        for i in views:
            for me, other in ((0, 1), (1, 0)):
                for value in (1, 0):
                    limit = int(pseudo * (parts[i][2] == value).mean()) + 1
                    mine = np.flatnonzero((target == i) & (view == me) & (label == value) & (at <= limit) & ~np.isin(key, used[i]))
                    used[i] = np.r_[used[i], key[mine]]
                    added[i][other] = np.r_[added[i][other][0], more[other][mine]], np.r_[added[i][other][1], np.full(len(mine), value)]
            views[i] = [Logistic.fit(np.r_[x, extra], np.r_[parts[i][2], label_], np.r_[np.ones(len(x)), np.full(len(extra), 0.5)]) for x, (extra, label_) in zip(parts[i][:2], added[i], strict=True)]
    discard(pool, words, sample, truth)
    models = {i: CoTrained.fit(*parts[i][3], views[i]) for i in views}
    return QualityModel(chosen, models.get(0), models.get(1))


_SCORES = ["p_content", "p_meta", "quality", "t_content", "t_meta", "toxic"]


def _scorer(model, at: float, toxic_at: float, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            meta = metadata(*buckets(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), batch.column("size").to_numpy())
            got = model.value.score(batch.column("text"), meta)
            keep = (got[2] >= at) & (got[5] < toxic_at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(x.astype(float)) for x in got], pa.array(keep)], names=[*others, *_SCORES, "keep"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, at: float = 0.5, toxic_at: float = 0.5, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Scores every row: the columns ``carry`` (the id by default), both views' and the combined probabilities, and ``keep``.

    ``quality`` is the probability of a good document and ``toxic`` of a toxic one. Null texts are
    scored as empty ones, null languages and sources are values of their own, equal rows get equal
    scores. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    carry = [id_col] if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(x) for c, x in zip(carry, inner, strict=True)])
    schema = T.StructType([*[T.StructField(x, rows.schema[x].dataType) for x in inner], *[T.StructField(c, T.DoubleType()) for c in _SCORES], T.StructField("keep", T.BooleanType())])
    out = rows.mapInArrow(_scorer(shared, at, toxic_at, inner), schema)
    return out.select(*[F.col(x).alias(c) for c, x in zip(carry, inner, strict=True)], *[F.col(c).alias(f"q_{c}") for c in [*_SCORES, "keep"]])
