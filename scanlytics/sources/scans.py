"""Readers and sinks for the files of scans: event logs, per-home exports, scan metadata, raw rooms, merged buildings, label logs.

Every reader has a fixed schema. A file that is not there gives an empty table; a line or document that cannot be
decoded is left out, or returned apart where a reader says so. Paths go through Spark's own file systems only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import KNOWN

EVENTS = "event string, timestamp string, home_id string, lead_id string, room_id string, story_id string, distinct_id string, error_text string"
ROOM = "id string, story int, referenceOriginTransform array<double>, walls array<struct<identifier:string>>"
METADATA = (
    "uuid string, homeMetadata struct<floors:array<struct<floorType:string,name:string,rooms:array<struct<id:string,name:string,created:double,jsonPath:string,roomHeatingType:string>>>>,"
    "floorToGradeHeightInCM:double>"
)
MERGED = "uuid string, rooms array<struct<identifier:string,story:int,transform:array<double>>>"
# fixed values: how scan folders are named
UUID = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
ADDRESS = r"^scans_[A-Za-z0-9]+_(.+)_[0-9a-f]{8}-"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def scan_uuid(name: Column) -> Column:
    """The uuid in the name of a scan folder; null without one."""
    return F.nullif(F.regexp_extract(name, UUID, 1), F.lit(""))


def scan_address(name: Column) -> Column:
    """The address in the name of a scan folder; null without one."""
    return F.trim(F.translate(F.nullif(F.regexp_extract(name, ADDRESS, 1), F.lit("")), "_", " "))


def read_events(spark: SparkSession, path: str, names: tuple[str, ...] | None = KNOWN) -> DataFrame:
    """An event log in CSV as ``ts, seq`` and its columns: known events with a home, all events with ``names=None``.

    ``seq`` goes up with the names of the files, and with the lines of each file; times that cannot be read are null.
    """
    if not _there(spark, path):
        return spark.createDataFrame([], f"seq long, ts timestamp, {EVENTS.replace('timestamp string, ', '')}")
    rows = spark.read.schema(EVENTS).csv(path, header=True, escape='"', multiLine=False).withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start") + F.expr("monotonically_increasing_id() & 8589934591")})
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("__file")).distinct().withColumn("__n", F.row_number().over(Window.orderBy("__file")))  # names only, no content
    # a block that is not a file's last fills its partition alone, so lines counted from its start stay before the next block
    rows = rows.join(F.broadcast(files), "__file").withColumn("seq", F.col("__n") * F.lit(1 << 44) + F.col("__at")).drop("__file", "__at", "__n")
    rows = rows.select("seq", F.col("timestamp").try_cast("timestamp").alias("ts"), *[c for c in rows.columns if c not in ("seq", "timestamp")])
    return rows if names is None else rows.where(F.col("event").isin(*names) & F.col("home_id").isNotNull())


def read_metric_export(spark: SparkSession, path: str, metrics: list[str], key: str = "home_id") -> DataFrame:
    """One row per home with ``metrics`` as text. Numbered columns ``x.0, x.1`` make one, joined with `` | ``; of several rows for a home the last wins, by the name of the file and the line in it."""
    empty = ", ".join(f"`{c}` string" for c in (key, *metrics))
    if not _there(spark, path):
        return spark.createDataFrame([], empty)
    rows = spark.read.csv(path, header=True, escape='"')
    parts = {m: sorted((c for c in rows.columns if c == m or (c.startswith(m + ".") and c[len(m) + 1 :].isdigit())), key=lambda c: int(c.rpartition(".")[2]) if c != m else -1) for m in metrics}
    made = [F.concat_ws(" | ", *[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in cs]).alias(m) if cs else F.lit("").alias(m) for m, cs in parts.items()]
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = rows.withColumn("__line", place).where(F.col(key).isNotNull())
    last = rows.groupBy(key).agg(F.max_by(F.struct(*made), "__line").alias("m"))
    return last.select(key, "m.*")


def read_scan_metadata(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Scan metadata documents, one in a line or one in a file."""
    if not _there(spark, path):
        return spark.createDataFrame([], METADATA)
    return spark.read.schema(METADATA).json(path, mode="DROPMALFORMED", multiLine=whole_files).where("uuid is not null")


def metadata_rooms(metadata: DataFrame) -> DataFrame:
    """``uuid, floor, floor_type, id, name, created, json_path, heating`` of every room of every floor."""
    floors = metadata.select("uuid", F.posexplode("homeMetadata.floors").alias("floor", "f"))
    rooms = floors.select("uuid", "floor", F.col("f.floorType").alias("floor_type"), F.explode("f.rooms").alias("r"))
    return rooms.select("uuid", "floor", "floor_type", "r.id", "r.name", "r.created", F.col("r.jsonPath").alias("json_path"), F.col("r.roomHeatingType").alias("heating"))


def read_rooms(spark: SparkSession, metadata: DataFrame, path: str, whole_files: bool = False) -> DataFrame:
    """Rooms of the metadata that have a raw document with a transform of 16 numbers: their columns and ``story, t``."""
    kind = T._parse_datatype_string(ROOM)
    raw = spark.read.schema(kind).json(path, mode="DROPMALFORMED", multiLine=whole_files) if _there(spark, path) else spark.createDataFrame([], kind)
    raw = raw.where(F.size("referenceOriginTransform") == 16).select("id", "story", F.col("referenceOriginTransform").alias("t"))
    return metadata_rooms(metadata).join(raw.dropDuplicates(["id"]), "id")


def scan_flags(metadata: DataFrame) -> DataFrame:
    """``uuid, has_basement, heating``: a basement floor or one above grade, and the heating by room (rooms without one left out)."""
    home = F.col("homeMetadata")
    basement = F.exists(home["floors"], lambda f: F.lower(f["floorType"]) == "basement") | (home["floorToGradeHeightInCM"] > 0)
    rooms = F.flatten(F.transform(home["floors"], lambda f: F.coalesce(f["rooms"], F.array().cast(T.ArrayType(T._parse_datatype_string("struct<id:string,name:string,created:double,jsonPath:string,roomHeatingType:string>"))))))
    heated = F.filter(rooms, lambda r: r["id"].isNotNull() & r["roomHeatingType"].isNotNull())
    return metadata.select("uuid", F.coalesce(basement, F.lit(False)).alias("has_basement"), F.map_from_entries(F.transform(heated, lambda r: F.struct(r["id"], r["roomHeatingType"]))).alias("heating"))


def read_merged(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merged buildings, and ``uuid, reason`` of those that are rejected: no list of rooms, or a room without 16 numbers."""
    kind = T._parse_datatype_string(MERGED)
    rows = spark.read.schema(kind).json(path, mode="DROPMALFORMED", multiLine=whole_files) if _there(spark, path) else spark.createDataFrame([], kind)
    bad = F.exists("rooms", lambda r: F.coalesce(F.size(r["transform"]) != 16, F.lit(True)))
    rows = rows.withColumn("reason", F.when(F.col("rooms").isNull(), "rooms is not a list").when(bad, "a transform has not 16 numbers"))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("uuid", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object in a line; blank lines and lines that cannot be decoded are left out."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def presence(spark: SparkSession, folder: str, names: dict[str, str]) -> DataFrame:
    """``uuid`` of every folder and whether it holds each file: ``{column: file name}``. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = files.select(scan_uuid(F.element_at(F.split("path", "/"), -2)).alias("uuid"), F.element_at(F.split("path", "/"), -1).alias("file")).where("uuid is not null")
    return parts.groupBy("uuid").agg(*[F.max(F.col("file") == name).alias(column) for column, name in names.items()])


def freshness(built: DataFrame, inputs: DataFrame) -> DataFrame:
    """``built`` (``uuid, built_at``) against ``inputs`` (``uuid, modified``): stale where an input is newer, or without a stamp."""
    newest = inputs.groupBy("uuid").agg(F.max("modified").alias("newest_input"))
    return built.join(newest, "uuid", "left").withColumn("stale", F.col("built_at").isNull() | F.coalesce(F.col("newest_input") > F.col("built_at"), F.lit(False)))


def tier_index(on_disk: DataFrame, built: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids on disk and just built, without those that failed, in order."""
    return on_disk.select("uuid").union(built.select("uuid")).distinct().join(failed.select("uuid"), "uuid", "left_anti").orderBy("uuid")


def write_report(rows: DataFrame, path: str, kind: str, order: list[str | Column] | None = None) -> None:
    """CSV (with a header), JSON lines or Parquet; with ``order``, files and lines stand in that order."""
    out = rows.orderBy(*order) if order else rows
    out.write.mode("overwrite").options(**({"header": True, "escape": '"'} if kind == "csv" else {})).format(kind).save(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows without a key go."""
    kept = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return kept.withColumn("__place", place).where("__place = 1").drop("__place")
