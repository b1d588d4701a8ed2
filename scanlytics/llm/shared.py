"""Where intermediate tables go, and small helpers that several operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shuffles_deleted

BATCH_BYTES = 4 << 20
_OWN: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own only where it is unset and all work is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a shared folder for intermediate tables")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/scanlytics"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_at", None)
        if path:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """From now on Spark hands texts to Python tasks in batches of a few MB, not of 10,000 rows of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_key(text: Column) -> Column:
    """Tells rows with one id but different texts apart."""
    return F.xxhash64(text)


def chain(hashes: Column, shift: int, step) -> Column:
    """``step`` of every element and the one ``shift`` places on; shorter by ``shift``."""
    ahead = F.slice(hashes, F.lit(shift + 1), F.greatest(F.size(hashes) - shift, F.lit(0)))
    both = F.zip_with(hashes, ahead, step)
    return F.slice(both, F.lit(1), F.greatest(F.size(hashes) - shift, F.lit(0)))
