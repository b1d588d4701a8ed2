"""Token counts per source, language and tokenizer version, maintained by deltas.

A change is a signed row: an insert adds a document and its tokens, a delete
takes them away, a revised count takes the old and adds the new. Totals are
sums of changes, so a batch is folded into a few rows per key before it is
committed, and batches can come in any order.

A batch's rows are written to a folder of the attempt. The name of that folder is written, whole, to a file
of the attempt, and the batch is committed by renaming this file to ``<id>.commit``, which only one attempt
can do. So a batch sent twice, or by two drivers at once, counts once, and an attempt that stops at any
step leaves nothing that is read; it can be sent again. A commit file that does not hold
the name of a folder is no commit and is replaced.

``compact`` folds all batches into one snapshot, which keeps their names in a table, so that neither files
nor what the driver reads grow with the life of a corpus.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, small_batches
from .textops import pieces
from .tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
SLICE_BYTES = 4 << 20
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counter(tokenizer: str, others: list[str], column: str, added_tokens: bool):
    size = encoder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = size(tokenizer, added_tokens)
        for batch in pieces(batches, column, SLICE_BYTES):
            n = np.diff(tool.encode_column(batch.column(column))[1])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(n, pa.int64())], names=[*others, "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """All columns but the text, and ``n_tokens`` of it (null: 0), in the place of a column of that name; ``added_tokens`` as in ``Encoder``.

    Repeated rows are counted each, very long texts whole; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, "n_tokens")]
    docs = docs.select(*[F.col(f"`{c}`") for c in [*others, text_col]])
    kind = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(_counter(tokenizer, others, text_col, added_tokens), f"{kind}, n_tokens long")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _named(batch: str) -> str:
    return quote(batch, safe="").replace(".", "%2E")


class TokenRollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "rollup")

    def _publish(self, name: str, content: str) -> bool:
        """Makes the file ``name`` with this content appear at once; False if it is there."""
        fs, place = _fs(self.spark, self.path)
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        draft, final = place(f"{self.path}/draft-{uuid.uuid4().hex}"), place(f"{self.path}/{name}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never onto a file that is there
        except Py4JJavaError:
            fs.delete(draft, False)
            if fs.exists(final):
                return False
            raise
        return True

    def _read(self, name: str) -> str:
        """What a small file holds; empty without the name of a folder in it."""
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
        return rows[0][0] if rows and re.fullmatch(r"(rows|snapshot)-[0-9a-f]{32}", rows[0][0]) else ""

    def _files(self, ending: str) -> list[str]:
        fs, place = _fs(self.spark, self.path)
        if not fs.exists(place(self.path)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(place(self.path))) if n.endswith(ending))

    def _snapshot(self) -> tuple[int, str]:
        """Number and folder of the newest snapshot."""
        for name in reversed(self._files(".snapshot")):
            folder = self._read(name)
            if folder:
                return int(name.removesuffix(".snapshot")), folder
        return 0, ""

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Folds signed rows ``source, lang, tokenizer, n_docs, n_tokens`` into one batch; False if it was there.

        Null keys are keys of their own; a null count is 0; rows that cancel out leave no trace.
        """
        fs, place = _fs(self.spark, self.path)
        name = f"{_named(batch)}.commit"
        if fs.exists(place(f"{self.path}/{name}")):
            if self._read(name):
                return False
            fs.delete(place(f"{self.path}/{name}"), False)
        snapshot = self._snapshot()[1]
        if snapshot and not self.spark.read.parquet(f"{self.path}/{snapshot}/names").where(F.col("batch") == batch).isEmpty():
            return False
        folded = changes.groupBy(*KEYS).agg(F.sum(F.coalesce("n_docs", F.lit(0))).alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
        folder = f"rows-{uuid.uuid4().hex}"
        folded.where("n_docs != 0 or n_tokens != 0").write.parquet(f"{self.path}/{folder}")
        if self._publish(name, folder):
            return True
        fs.delete(place(f"{self.path}/{folder}"), True)  # another driver was first
        return False

    def _committed(self) -> dict[str, str]:
        """Batches since the newest snapshot, and their folders."""
        files = self._files(".commit")
        if not files:
            return {}
        rows = self.spark.read.text([f"{self.path}/{f}" for f in files], wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").collect()
        found = {unquote(unquote(r["file"]).removesuffix(".commit")): r["value"] for r in rows if re.fullmatch(r"rows-[0-9a-f]{32}", r["value"] or "")}
        snapshot = self._snapshot()[1]
        if snapshot and found:  # a compaction may have stopped before it deleted what it had folded
            names = self.spark.createDataFrame([(b,) for b in found], "batch string")
            old = {r[0] for r in names.join(self.spark.read.parquet(f"{self.path}/{snapshot}/names"), "batch", "left_semi").collect()}
            found = {b: f for b, f in found.items() if b not in old}
        return found

    def batches(self) -> list[str]:
        snapshot = self._snapshot()[1]
        old = [r[0] for r in self.spark.read.parquet(f"{self.path}/{snapshot}/names").collect()] if snapshot else []
        return sorted([*self._committed(), *old])

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches; keys whose sums are 0 are gone."""
        found, snapshot = self._committed(), self._snapshot()[1]
        return self._sums(found, snapshot) if found or snapshot else self.spark.createDataFrame([], _DELTA)

    def compact(self) -> bool:
        """Folds everything committed so far into one snapshot, then deletes what it holds; False if another driver was first or there is nothing to do.

        The snapshot appears at once, by a rename; whatever stops before that changes nothing, and whatever stops after it leaves files that are not read.
        """
        number, before = self._snapshot()
        found = self._committed()
        if not found:
            return False
        fs, place = _fs(self.spark, self.path)
        folder = f"snapshot-{uuid.uuid4().hex}"
        self._sums(found, before).write.parquet(f"{self.path}/{folder}/rows")
        names = self.spark.createDataFrame([(b,) for b in found], "batch string")
        names = names.unionByName(self.spark.read.parquet(f"{self.path}/{before}/names")) if before else names
        names.write.parquet(f"{self.path}/{folder}/names")
        if not self._publish(f"{number + 1:012d}.snapshot", folder):
            fs.delete(place(f"{self.path}/{folder}"), True)
            return False
        for batch, rows in found.items():
            fs.delete(place(f"{self.path}/{_named(batch)}.commit"), False)
            fs.delete(place(f"{self.path}/{rows}"), True)
        return True

    def _sums(self, found: dict[str, str], snapshot: str) -> DataFrame:
        folders = [*sorted(found.values()), *([f"{snapshot}/rows"] if snapshot else [])]
        rows = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")


def inserts(counted: DataFrame, tokenizer: str) -> DataFrame:
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deletes(counted: DataFrame, tokenizer: str) -> DataFrame:
    return inserts(counted, tokenizer).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(counted: DataFrame, tokenizer: str, old: str = "n_tokens", new: str = "new_tokens") -> DataFrame:
    return counted.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(0).cast("long").alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))
