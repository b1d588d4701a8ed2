"""Token ids as length-delimited binary records with a separate offset index.

A data file is a row of records, each one

    length of the payload   unsigned 64 bits
    masked CRC-32 of those 8 bytes
    payload
    masked CRC-32 of the payload

all little-endian. A payload is the document's id (signed 64 bits, least value
for null), the bytes of one token id (2 or 4, 32 bits), the number of ids (32
bits) and the ids. The masked checksum of c is ((c >> 15 | c << 17) + a282ead8)
mod 2^32, so that checksums of data holding checksums stay useful. The index is
a Parquet table ``part, file, offset, size, doc`` in the order of the records;
any subset of it, in any order, can be read.

Each task writes its own files under a name of the attempt and renames them when
they are whole; a task run again writes the same bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, shuffle_partitions, small_batches, text_key, written
from .textops import pieces
from .tokens import encoder

FILE_BYTES = 64 << 20
SLICE_BYTES = 4 << 20
_NONE = -(2**63)
_INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("doc", pa.int64())])
_READ = pa.schema([("part", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("doc", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_HEAD = struct.Struct("<QI")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    size, check = _HEAD.unpack_from(data)
    if masked(data[:8]) != check or len(data) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = data[12:-4]
    if masked(payload) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("a record's content is damaged")
    return payload


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _writer(tokenizer: str, end_id: int, path: str, added_tokens: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, context = encoder(tokenizer, added_tokens), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, base = _filesystem(path)
        end, out, name, at, number, rows = np.array([end_id], tool.kind).tobytes(), None, "", 0, 0, []

        def close():
            out.close()
            store.move(f"{base}/_{name}.{attempt}", f"{base}/{name}")
            index = pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(_INDEX.names)}, schema=_INDEX)
            rows.clear()
            return index

        for batch in pieces(batches, "text", SLICE_BYTES):
            ids_of, edges = tool.encode_column(batch.column("text"))
            raw, width = ids_of.tobytes(), tool.kind.itemsize
            for doc, a, b in zip(batch.column("doc").to_pylist(), (edges[:-1] * width).tolist(), (edges[1:] * width).tolist(), strict=True):
                if out is None:
                    name, at = f"tokens-{part:06d}-{number:04d}.bin", 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/_{name}.{attempt}")
                ids = raw[a:b] + end
                record = frame(struct.pack("<qII", _NONE if doc is None else doc, width, len(ids) // width) + ids)
                out.write(record)
                rows.append((part, name, at, len(record), doc))
                at += len(record)
                if at >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return write


def write_token_records(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, added_tokens: bool = True) -> DataFrame:
    """Writes the ids of every text, and ``end_id`` after each, in ascending order of the ids of the documents; returns the index.

    Null texts are empty, null ids come first, rows of one id are ordered by a hash of their texts,
    and equal rows are each written. Other columns are ignored; an empty table writes no file.
    ``added_tokens`` as in ``Encoder``.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc", "key").sortWithinPartitions("doc", "key")
    index = rows.select("doc", "text").mapInArrow(_writer(tokenizer, end_id, f"{path}/data", added_tokens), "part int, file string, offset long, size long, doc long")
    index.write.parquet(f"{path}/index")
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, file string, offset long, size long, doc long").parquet(f"{path}/index")


def _reader(path: str, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(f"{path}/data")
        handles: dict[str, object] = {}
        for batch in batches:
            rows = sorted(zip(*[batch.column(k).to_pylist() for k in ("file", "offset", "size", "part")], strict=True))
            made: dict[str, list] = {k: [] for k in [*_READ.names, *["ids"] * with_ids]}
            for file, offset, size, part in rows:
                if file not in handles:
                    for old in handles.values():
                        old.close()
                    handles = {file: store.open_input_file(f"{base}/{file}")}
                payload = unframe(handles[file].read_at(size, offset))
                doc, width, count = struct.unpack_from("<qII", payload)
                ids = np.frombuffer(payload, f"<u{width}", count, 16).astype("<u4")
                for k, v in zip(made, (part, file, offset, None if doc == _NONE else doc, count, zlib.crc32(ids.tobytes()), ids), strict=False):
                    made[k].append(v)
            yield pa.RecordBatch.from_pydict(made, schema=_READ.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _READ)
        for old in handles.values():
            old.close()

    return read


def read_token_records(index: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """The records that ``index`` names, checked: ``part, file, offset, doc, n_tokens, ids_crc32`` and the ids if asked for."""
    kind = "part int, file string, offset long, doc long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return index.mapInArrow(_reader(path, with_ids), kind)


def with_starts(records: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all records before each: sums within files, and the sums of whole files."""
    records = written(records, "records")
    files = records.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("part", "file", F.coalesce(F.sum("total").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return records.join(before, ["part", "file"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))


def tokenized_files(docs: DataFrame, tokenizer: str, path: str | None = None, added_tokens: bool = True) -> DataFrame:
    """Writes ``docs``, reads the files back: ``doc, start, n_tokens, ids_crc32``."""
    path = path or new_path(docs.sparkSession, "token-records")
    return with_starts(read_token_records(write_token_records(docs, tokenizer, path, added_tokens=added_tokens), path)).select("doc", "start", "n_tokens", "ids_crc32")
