"""Queries over files: each writes one of the given tables in a reader's format and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scans as S
from ..sources.scratch import new_folder
from .event_queries import _LOG, log
from .registry import query


def _uuid(n) -> F.Column:
    text = F.lpad(F.lower(F.hex(n)), 32, "0")
    cut = [F.substring(text, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


_UUID = "(SELECT substr(t, 1, 8) || '-' || substr(t, 9, 4) || '-' || substr(t, 13, 4) || '-' || substr(t, 17, 4) || '-' || substr(t, 21, 12) FROM (SELECT lpad(lower(to_hex({n})), 32, '0') AS t))"


@query("a1_read_events", _LOG + " SELECT event, home_id::VARCHAR AS home_id, room_id::VARCHAR AS room_id, ts, k::VARCHAR AS error_text FROM ev WHERE event IS NOT NULL AND home_id IS NOT NULL")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "events")
    rows = log(spark, sf_dir).select(F.coalesce("event", F.lit("other")).alias("event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "home_id", "lead_id", "room_id", "story_id", "distinct_id", F.col("k").alias("error_text"))
    S.write_report(rows, path, "csv")
    return S.read_events(spark, path).select("event", "home_id", "room_id", "ts", "error_text")


@query("a2_read_metric_export", "SELECT c_custkey::VARCHAR AS home_id, (c_nationkey + 1)::VARCHAR AS merge_errors, 'e' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' | f' || c_custkey END AS error_texts FROM customer")
def a2(spark, sf_dir):
    """Every home stands in the export twice; the second row is the newer one."""
    path = new_folder(spark, "export")
    home = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = home.crossJoin(spark.range(2).withColumnRenamed("id", "again")).select(F.col("c_custkey").alias("home_id"), (F.col("c_nationkey") + F.col("again")).alias("merge_errors"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("f"), F.col("c_custkey"))).alias("error_texts.1"), F.concat(F.lit("e"), F.col("c_nationkey")).alias("error_texts.0"), "again")
    S.write_report(rows, path, "csv", ["again", "home_id"])
    return S.read_metric_export(spark, path, ["merge_errors", "error_texts"])


def metadata(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Scan metadata and raw rooms of ``lineitem``, a room in each row; some rooms have no document, some too short a transform."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    room = F.concat_ws("-", F.lit("room"), "l_orderkey", "l_linenumber")
    heating = F.when(F.col("part") % 4 > 0, F.concat(F.lit("heat"), F.col("part") % 4))
    floor = F.struct(F.when((F.col("supp") % 5 == 0) & (F.col("l_linenumber") % 3 == 0), "basement").otherwise("floor").alias("floorType"), F.array(F.struct(room.alias("id"), F.col("part").cast("double").alias("created"), heating.alias("roomHeatingType"))).alias("rooms"))
    homes = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", floor.alias("f")))).alias("f"))
    home = F.struct(F.transform("f", lambda x: x["f"]).alias("floors"), F.when(F.col("l_orderkey") % 7 == 0, 12.0).when(F.col("l_orderkey") % 7 == 1, -3.0).alias("floorToGradeHeightInCM"))
    about, raw = new_folder(spark, "metadata"), new_folder(spark, "rooms")
    S.write_report(homes.select(F.col("l_orderkey").cast("string").alias("uuid"), home.alias("homeMetadata")), about, "json")
    t = F.transform(F.sequence(F.lit(1), F.when(F.col("part") % 11 == 0, 12).otherwise(16)), lambda i: (i + F.col("supp")).cast("double"))
    S.write_report(rows.where("part % 13 > 0").select(room.alias("id"), (F.col("l_linenumber") % 3).alias("story"), t.alias("referenceOriginTransform")), raw, "json")
    return about, raw


_ROOM_ROWS = "WITH r AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL)"


@query("a3_read_rooms", _ROOM_ROWS + " SELECT l_orderkey::VARCHAR AS uuid, 'room-' || l_orderkey || '-' || l_linenumber AS id, part::DOUBLE AS created, l_linenumber % 3 AS story, CASE WHEN supp % 5 = 0 AND l_linenumber % 3 = 0 THEN 'basement' ELSE 'floor' END AS floor_type, CAST(16 + supp AS DOUBLE) AS last FROM r WHERE part % 13 > 0 AND part % 11 <> 0")
def a3(spark, sf_dir):
    about, raw = metadata(spark, sf_dir)
    return S.read_rooms(spark, S.read_scan_metadata(spark, about), raw).select("uuid", "id", "created", "story", "floor_type", F.col("t")[15].alias("last"))


@query("a5_read_merged", "SELECT c_custkey::VARCHAR AS uuid, CASE WHEN c_custkey % 5 = 0 THEN 'rooms is not a list' WHEN c_custkey % 5 = 1 THEN 'a transform has not 16 numbers' END AS reason, CASE WHEN c_custkey % 5 > 1 THEN 2 END AS n_rooms FROM customer")
def a5(spark, sf_dir):
    path, key = new_folder(spark, "merged"), F.col("c_custkey")
    t = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("double"))
    rooms = F.array(F.struct(t(F.lit(16)).alias("transform")), F.struct(t(F.when(key % 5 == 1, 9).otherwise(16)).alias("transform")))
    S.write_report(spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.cast("string").alias("uuid"), F.when(key % 5 > 0, rooms).alias("rooms")), path, "json")
    good, rejected = S.read_merged(spark, path)
    return good.select("uuid", F.lit(None).cast("string").alias("reason"), F.size("rooms").alias("n_rooms")).unionByName(rejected, allowMissingColumns=True)


@query("a7_read_jsonl", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 > 1")
def a7(spark, sf_dir):
    """A label log with blank lines and lines that were cut off."""
    path = new_folder(spark, "log")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    rows.write.text(path)
    return S.read_jsonl(spark, path, "event_id long, user_id long, event_type string")


@query("a8_scan_names", f"SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN {_UUID.format(n='c_custkey')} END AS uuid, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment || ' ' || c_nationkey END AS address FROM customer")
def a8(spark, sf_dir):
    key = F.col("c_custkey")
    head = F.when(key % 4 == 1, "odd").otherwise("scans_ab12")
    name = F.when(key % 4 == 0, "nothing_here").otherwise(F.concat_ws("_", head, "c_mktsegment", F.col("c_nationkey").cast("string"), _uuid(key)))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.scan_uuid(name).alias("uuid"), S.scan_address(name).alias("address"))


@query("a9_scan_flags", _ROOM_ROWS + " SELECT l_orderkey::VARCHAR AS uuid, coalesce(bool_or(supp % 5 = 0 AND l_linenumber % 3 = 0), false) OR l_orderkey % 7 = 0 AS has_basement, count(*) FILTER (part % 4 > 0) AS n_heated, coalesce(string_agg('heat' || part % 4, ',' ORDER BY 'heat' || part % 4) FILTER (part % 4 > 0), '') AS heating FROM r GROUP BY l_orderkey")
def a9(spark, sf_dir):
    about, _ = metadata(spark, sf_dir)
    return S.scan_flags(S.read_scan_metadata(spark, about)).select("uuid", "has_basement", F.size("heating").cast("long").alias("n_heated"), F.array_join(F.array_sort(F.map_values("heating")), ",").alias("heating"))


@query("a10_presence", f"SELECT {_UUID.format(n='n_nationkey')} AS uuid, n_nationkey % 2 = 0 AS has_merged, n_nationkey % 3 = 0 AS has_payload FROM nation")
def a10(spark, sf_dir):
    """A folder for each nation with some of the files."""
    path = new_folder(spark, "outputs")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(_uuid(F.col("n_nationkey")).alias("uuid"), F.col("n_nationkey").alias("n"))
    jvm = spark._jvm.org.apache.hadoop.fs
    store = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in rows.orderBy("n").collect():  # 25 folders
        for name, there in (("notes.txt", True), ("merged.json", r.n % 2 == 0), ("tier_payload.json", r.n % 3 == 0)):
            if there:
                out = store.create(jvm.Path(f"{path}/{r.uuid}/{name}"))
                out.write(32)  # files without content are not listed
                out.close()
    return S.presence(spark, path, {"has_merged": "merged.json", "has_payload": "tier_payload.json"})


@query("a11_freshness", "SELECT o_custkey AS uuid, max(o_orderdate) AS newest_input, any_value(c.built) AS built_at, any_value(c.built) IS NULL OR max(o_orderdate) > any_value(c.built) AS stale FROM orders JOIN (SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN TIMESTAMP '1998-01-01' - to_days(CAST(c_custkey % 100 AS INTEGER) * 5) END AS built FROM customer) c ON o_custkey = c_custkey GROUP BY o_custkey")
def a11(spark, sf_dir):
    built = F.when(F.col("c_custkey") % 9 > 0, F.lit("1998-01-01").cast("timestamp") - F.make_dt_interval((F.col("c_custkey") % 100 * 5).cast("int")))
    homes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uuid"), built.alias("built_at"))
    inputs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("uuid"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return S.freshness(homes, inputs).where("newest_input is not null")


@query("a12_sinks", "SELECT f.fmt, c_custkey, c_name, c_acctbal FROM customer, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)")
def a12(spark, sf_dir):
    rows, out = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"), []
    for kind in ("csv", "json", "parquet"):
        path = new_folder(spark, kind)
        S.write_report(rows, path, kind, ["c_custkey"])
        out.append(spark.read.schema(rows.schema).options(header=True, escape='"').format(kind).load(path).select(F.lit(kind).alias("fmt"), "*"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a13_tier_index", "SELECT DISTINCT k AS uuid FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def a13(spark, sf_dir):
    homes, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey").alias("uuid")
    return S.tier_index(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("uuid")), homes.where("c_custkey % 3 = 0").select(key), homes.where("c_nationkey = 4").select(key))
