"""Reader for built payloads, one JSON document per building, and a profile of the fields of any JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import deleted, written

POINT = "struct<x:double,y:double,z:double>"
RINGS = f"array<array<{POINT}>>"
PIECE = f"struct<locator_id:string,adjacency:string,source:string,kind:string,plane:struct<a:double,b:double,c:double,d:double>,corners:array<{POINT}>,holes:{RINGS},cutouts:{RINGS},support_quality:double>"
ROOM = f"struct<locator_id:string,story:int,floor:variant,walls:array<{PIECE}>>"
# fixed values: the lists of a payload beside its rooms, and what their pieces are called
LISTS = {"gaps": "gap", "ceiling": "ceiling", "knee_walls": "knee_wall", "dormer_faces": "dormer_face", "gable_closures": "gable_closure"}
ANSWERS = ("uuid", "category", "story", "room", "room_locator", "idx", "locator_id", "adjacency", "source", "kind", "plane", "corners", "openings", "support_quality")


def _get(document: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(document, path, kind)


def read_documents(spark: SparkSession, path: str, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """``uuid, payload`` (a VARIANT) of every document, one in a line or one in a file; and ``value, reason`` of what is none or names no building."""
    rows = spark.read.text(path, wholetext=whole_files).where("trim(value) != ''").withColumn("payload", F.try_parse_json("value"))
    rows = rows.withColumn("uuid", _get(F.col("payload"), "$.uuid", "string"))
    return rows.where("uuid is not null").select("uuid", "payload"), rows.where("uuid is null").select("value", F.when(F.col("payload").isNull(), "not JSON").otherwise("no uuid").alias("reason"))


def _floor_pieces(floor: Column) -> Column:
    several = F.transform(_get(floor, "$", "array<variant>"), lambda v: _get(v, "$", PIECE))
    return F.filter(F.coalesce(several, F.array(_get(floor, "$", PIECE))), lambda p: p.isNotNull())


def payload_rooms(documents: DataFrame) -> DataFrame:
    """``uuid, room, room_locator, story, floors, walls``; ``room`` counts from 0. A floor may be one piece or a list of pieces; entries that are no pieces are left out."""
    rooms = documents.select("uuid", F.posexplode(_get(F.col("payload"), "$.rooms", "array<variant>")).alias("room", "v"))
    room = rooms.select("uuid", "room", _get(F.col("v"), "$", ROOM).alias("r"))
    pieces = _floor_pieces(F.col("r.floor"))
    return room.where("r is not null").select("uuid", "room", F.col("r.locator_id").alias("room_locator"), "r.story", pieces.alias("floors"), F.filter("r.walls", lambda p: p.isNotNull()).alias("walls"))


def payload_surfaces(documents: DataFrame) -> DataFrame:
    """All pieces of payloads in one table: floors and walls of rooms, gaps, ceilings, knee walls, dormer faces, gable closures.

    ``idx`` counts from 0 in the list that held the piece. ``openings`` are a ceiling's holes, a wall's or a face's cutouts, else none. Missing fields and lists are
    null or empty; pieces without corners have an empty list of them.
    """
    none = F.array().cast(RINGS)
    kind = f"array<struct<category:string,story:int,room:int,room_locator:string,idx:int,p:{PIECE}>>"
    empty = F.array().cast(kind)

    def entry(category, story, room, locator, idx, p):
        return F.struct(F.lit(category).alias("category"), story.cast("int").alias("story"), room.cast("int").alias("room"), locator.cast("string").alias("room_locator"), idx.alias("idx"), p.alias("p"))

    def inside(x):
        """The floors and walls of a room."""
        def listed(category, pieces):
            return F.coalesce(F.transform(pieces, lambda p, i: entry(category, x["r"]["story"], x["room"], x["r"]["locator_id"], i, p)).cast(kind), empty)

        return F.concat(listed("floor", _floor_pieces(x["r"]["floor"])), listed("wall", F.filter(x["r"]["walls"], lambda p: p.isNotNull())))

    def beside(name, category):
        listed = _get(F.col("payload"), f"$.{name}", "array<variant>")
        return F.coalesce(F.transform(listed, lambda v, i: entry(category, F.lit(None), F.lit(None), F.lit(None), i, _get(v, "$", PIECE))).cast(kind), empty)

    rooms = F.filter(F.transform(_get(F.col("payload"), "$.rooms", "array<variant>"), lambda v, i: F.struct(i.alias("room"), _get(v, "$", ROOM).alias("r"))), lambda x: x["r"].isNotNull())
    every = F.concat(F.coalesce(F.flatten(F.transform(rooms, inside)), empty), *[beside(name, category) for name, category in LISTS.items()])
    rows = documents.select("uuid", F.inline(every)).where("p is not null")  # a document is parsed once, not once for each list
    cut = F.when(F.col("category") == "ceiling", F.col("p.holes")).when(F.col("category").isin("wall", "dormer_face"), F.col("p.cutouts"))
    whole = {"corners": F.coalesce("p.corners", F.array().cast(f"array<{POINT}>")), "openings": F.coalesce(cut, none)}
    return rows.select(*[whole[c].alias(c) if c in whole else F.col(f"p.{c}").alias(c) if c in ("locator_id", "adjacency", "source", "kind", "plane", "support_quality") else F.col(c) for c in ANSWERS])


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """``payload_surfaces`` of a file or folder of documents."""
    return payload_surfaces(read_documents(spark, path, whole_files)[0])


def profile_fields(rows: DataFrame, column: str = "json", family: str | None = None, samples: int = 5) -> DataFrame:
    """Of every leaf path in JSON texts: ``family, path, types`` (how often each type), ``seen`` and the first ``samples`` values in order of their text.

    Members are named ``a.b``, elements of lists ``a[]``; an empty list or object is a leaf. The documents are taken apart one level a round, and what is left is written
    each time, so any depth works. Texts that are no JSON are left out. ``family`` names a column to profile by.
    """
    group = F.lit("") if family is None else F.col(f"`{family}`").cast("string")
    level = written(rows.select(group.alias("family"), F.lit("").alias("path"), F.try_parse_json(F.col(f"`{column}`")).alias("v")).where("v is not null"), "fields")
    leaves = []
    inner = lambda v, kind: F.schema_of_variant(v).startswith(kind)
    while True:
        parts = level.withColumns({"members": F.when(inner(F.col("v"), "OBJECT"), _get(F.col("v"), "$", "map<string,variant>")), "items": F.when(inner(F.col("v"), "ARRAY"), _get(F.col("v"), "$", "array<variant>"))})
        within = (F.size("members") > 0) | (F.size("items") > 0)
        ended = parts.where(~F.coalesce(within, F.lit(False)))
        kind = F.when(F.col("members").isNotNull(), "object").when(F.col("items").isNotNull(), "array").otherwise(F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^[A-Z]+", 0)))
        kind = F.when(kind == "void", "null").when(kind == "bigint", "integer").when(kind.isin("decimal", "double", "float"), "number").otherwise(kind)
        leaf = ended.select("family", "path", kind.alias("type"), F.coalesce(_get(F.col("v"), "$", "string"), F.to_json("v")).alias("value"))
        sums = leaf.groupBy("family", "path", "type", "value").agg(F.count("*").alias("n"))
        first = F.row_number().over(Window.partitionBy("family", "path").orderBy(F.col("value").asc_nulls_first()))
        few = sums.groupBy("family", "path", "value").agg(F.sum("n").alias("n")).withColumn("place", first).where(F.col("place") <= samples)
        listed = few.groupBy("family", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("samples"))
        types = sums.groupBy("family", "path", "type").agg(F.sum("n").alias("n")).groupBy("family", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.sum("n").alias("seen"))
        leaves.append(written(types.join(listed, ["family", "path"], "left").select("family", "path", "types", "seen", "samples"), "leaves"))
        members = parts.where(F.size("members") > 0).select("family", "path", F.explode("members").alias("key", "v")).select("family", F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key").alias("path"), "v")
        items = parts.where(F.size("items") > 0).select("family", F.concat("path", F.lit("[]")).alias("path"), F.explode("items").alias("v"))
        after = written(members.unionByName(items), "fields")
        deleted(level)
        level = after
        if level.isEmpty():
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out  # a path has one depth, so no two rounds share one
