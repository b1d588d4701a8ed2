"""A folder for files that a query writes and reads back."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, label: str) -> str:
    """In the shared folder named by ``spark.checkpoint.dir``; only on one machine, and where it is unset, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-files-"))
    return f"{base.rstrip('/')}/scanlytics-files/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, what a write has shuffled is deleted when the write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(rows: DataFrame, label: str) -> DataFrame:
    """Writes rows to a new folder and reads them back: what follows does not work them out again, and lost executors cost nothing."""
    path = new_folder(rows.sparkSession, label)
    with shuffles_deleted(rows.sparkSession):
        rows.write.parquet(path)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table.written_at = path
    return table


def deleted(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for table in tables:
        path = getattr(table, "written_at", None)
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
