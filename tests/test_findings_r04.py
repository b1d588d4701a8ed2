import contextlib
import io
import random

from pyspark.sql import functions as F

from scanlytics.operators import spatial

_POINT = "array<struct<x:double,y:double,z:double>>"


def _rooms(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        x, z, w, d = (rng.choice([0.0, 0.2, 3.0, 7.9, 8.1, 16.0, 40.0]) + rng.random() / 5 for _ in range(4))
        rows.append((rng.choice([None, 1, 2]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1, 2]), i, [(x, 0.0, z), (x + w, 0.0, z), (x + w, 0.0, z + d), (x, 0.0, z + d)]))
    return spark.createDataFrame(rows, f"uuid long, story int, room int, seq int, corners {_POINT}")


def test_edge_pairs_send_no_side_to_all_tasks(spark, monkeypatch):
    """edges meet by a merge join, not by one side that the driver collects and sends, and pairs are the same with and without cells."""
    floors = _rooms(spark, 90)
    out = []
    for crowd in (0, 64, 10**6):
        monkeypatch.setattr(spatial, "CROWD", crowd)
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            (pairs := spatial.edge_pairs(floors)).explain()
        inner = [x for x in said.getvalue().splitlines() if "Join" in x and "Inner" in x]
        assert inner and all("SortMergeJoin" in x for x in inner)
        out.append(sorted(tuple(r) for r in pairs.select("seq_a", "side_a", "seq_b", "side_b", F.round("gap", 9), "confidence").collect()))
    assert out[0] and out[0] == out[1] == out[2]
    plain = floors.alias("a").join(floors.alias("b"), F.col("a.uuid").eqNullSafe(F.col("b.uuid")) & F.col("a.story").eqNullSafe(F.col("b.story")) & F.expr("a.room < b.room"))
    allowed = {(r[0], r[1]) for r in plain.select("a.seq", "b.seq").collect()}
    assert {(a, b) for a, _, b, _, _, _ in out[0]} <= allowed
    assert not spatial.edge_pairs(floors.limit(0)).collect()


def test_payload_files_are_packed_and_shuffles_go(spark, tmp_path, monkeypatch):
    """the documents that a6 writes are packed, what a write shuffled goes with it, and the rows are those of the SQL."""
    import duckdb

    from scanlytics.plans import registry, roof_queries
    from scanlytics.sources import scratch

    monkeypatch.setattr(roof_queries, "new_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    rows = registry.queries()["a6_read_payloads"](spark, "/root/testdata/sf0.001")
    files = [x.name for x in (tmp_path / "payloads").iterdir() if x.name.startswith("part-")]
    assert files and all(x.endswith(".gz") for x in files)
    db = duckdb.connect()
    db.sql("CREATE VIEW lineitem AS SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet'")
    want = db.sql(registry.oracle_sql()["a6_read_payloads"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, want))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with scratch.shuffles_deleted(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_rules_in_parts_of_the_buildings(spark):
    """a rule over many rows works on a part of the buildings at a time, and finds what it finds over all at once."""
    from scanlytics.plans.spatial_queries import in_parts

    rows = _rooms(spark, 90).where("uuid is not null").withColumn("category", F.when(F.col("seq") % 3 == 0, "floor").otherwise("wall"))
    asked = []

    def flags(some):
        asked.append(sorted(r.uuid for r in some.select("uuid").distinct().collect()))
        return spatial.out_of_envelope(some.where("category = 'wall'"), some.where("category = 'floor'"))

    whole = sorted(map(str, in_parts(rows, flags).collect()))
    parts = sorted(map(str, in_parts(rows, flags, least=10, most=2).collect()))
    assert whole and whole == parts
    assert asked[0] == [1, 2] and len(asked) == 3 and sorted(sum(asked[1:], [])) == [1, 2]
