"""Operators without SQL against plain versions on whole small tables, and readers on odd files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlytics.operators import cohorts as C
from scanlytics.operators import models as M
from scanlytics.operators import spatial as P
from scanlytics.plans import model_queries, registry
from scanlytics.plans.surface_queries import surfaces
from scanlytics.sources import scans as S

D = "/root/testdata/sf0.001"


def test_coplanar_groups_against_search(spark):
    rows = surfaces(spark, D).where("category in ('ceiling', 'dormer_face') and plane is not null").select("uuid", "seq", "plane").collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.uuid, []).append(r)
    want = {}
    for uuid, group in by.items():
        parent = {r.seq: r.seq for r in group}
        changed = True
        while changed:
            changed = False
            for a in group:
                for b in group:
                    near = all(abs(a.plane[k] - b.plane[k]) <= t for k, t in (("a", 0.05), ("b", 0.05), ("c", 0.05), ("d", 0.5)))
                    if near and parent[a.seq] < parent[b.seq]:
                        parent[b.seq] = parent[a.seq]
                        changed = True
        want |= {(uuid, s): p for s, p in parent.items()}
    got = {(r.uuid, r.node): r.component for r in registry.queries()["p6_coplanar_groups"](spark, D).collect()}
    assert got == want and len(set(want.items())) > 10
    alone = {k for k, v in want.items() if sum(1 for j, w in want.items() if j[0] == k[0] and w == v) == 1}
    assert {(r.uuid, r.seq) for r in registry.queries()["r12_roof_fragmented"](spark, D).collect()} == set(want) - alone


def test_edge_pairs(spark):
    def box(room, x, z, w, d, seq):
        return ("u", 1, room, seq, [(float(a), 0.0, float(b)) for a, b in ((x, z), (x + w, z), (x + w, z + d), (x, z + d))])

    rows = [box(1, 0, 0, 4, 3, 1), box(2, 4.2, 0, 3, 3, 2), box(3, 0, 3.3, 1, 2, 3), box(4, 40, 40, 2, 2, 4), box(1, 4.1, 0, 1, 1, 5)]
    df = spark.createDataFrame(rows, "uuid string, story int, room int, seq int, corners array<struct<x:double,y:double,z:double>>")
    got = {(r.seq_a, r.side_a, r.seq_b, r.side_b): (r.thickness_cm, r.confidence) for r in P.edge_pairs(df).collect()}
    assert got[(1, 1, 2, 3)] == (20.0, "high") and got[(1, 2, 3, 0)] == (30.0, "high")
    assert not any(4 in (a, b) for a, _, b, _ in got) and not any({a, b} == {1, 5} for a, _, b, _ in got)


def test_models_on_rows_they_did_not_see(spark):
    rows = M.oof_scores(M.prepare(model_queries.features(spark, D), ["size", "day"], ["status", "priority"]), 3).collect()
    assert len(rows) == model_queries.features(spark, D).count()
    folds: dict = {}
    for r in rows:
        folds.setdefault(r.building_uuid, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    y, p = np.array([r.label for r in rows]), np.array([r.boosted for r in rows])
    assert (p[y == 1][:, None] > p[y == 0][None, :]).mean() > 0.9
    done = registry.queries()["l17_calibrated"](spark, D).orderBy("score").collect()
    values = [r.calibrated for r in done]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
    assert abs(np.mean(values) - np.mean([r.label for r in done])) < 0.05
    assert all(r.n >= 50 and r.purity >= 0.95 for r in registry.queries()["l19_reject_leaves"](spark, D).collect())
    assert 1 < registry.queries()["l21_archetypes"](spark, D).select("cluster").distinct().count() <= 4


def test_quality_fit_on_held_out_rows(spark):
    rows = model_queries.features(spark, "/root/testdata/sf0.01").withColumn("rating", F.col("size") / 80_000 + F.col("proposal_id") % 2)
    held = F.col("proposal_id") % 5 == 0
    model, intercept = M.fit_quality(rows.where(~held), ["size", "day"])
    got = C.score_quality(rows.where(held), "proposal_id", model, intercept).join(rows, "proposal_id").select("predicted_rating", "rating").collect()
    a, b = np.array([r.predicted_rating for r in got]), np.array([min(5, max(1, r.rating)) for r in got])
    assert np.corrcoef(a, b)[0, 1] > 0.8


def test_ranks_are_whole(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    assert [(r.v, r["rank"]) for r in C.ranked(df, [F.col("v")]).orderBy("rank").collect()] == [(i, i + 1) for i in range(1000)]
    assert C.ranked(df.limit(0), [F.col("v")]).collect() == []


def test_readers_on_odd_files(spark, tmp_path):
    none = f"file://{tmp_path}/nothing"
    assert S.read_events(spark, none).collect() == [] and S.read_metric_export(spark, none, ["a"]).columns == ["home_id", "a"] and S.read_scan_metadata(spark, none).collect() == []
    assert S.read_jsonl(spark, none, "a int").collect() == [] and [x.collect() for x in S.read_merged(spark, none)] == [[], []]
    (tmp_path / "e.csv").write_text('event,timestamp,home_id,lead_id,room_id,story_id,distinct_id,error_text\nroomScanStarted,2024-01-01T10:00:00Z,h,l,r,,d,"a ""b"", c"\nroomScanStarted,not a time,h,,,,,\nother,2024-01-01T10:00:00Z,h,,,,,\nroomScanStarted,2024-01-01T10:00:00Z,,,,,,\n')
    got = S.read_events(spark, f"file://{tmp_path}/e.csv").orderBy("seq").collect()
    assert [(r.ts is None, r.error_text) for r in got] == [(False, 'a "b", c'), (True, None)]
    assert S.read_events(spark, f"file://{tmp_path}/e.csv", None).count() == 4
    (tmp_path / "m.json").write_text('{"uuid": "u",\n "homeMetadata": {"floors": [{"rooms": null}, {"floorType": "Basement", "rooms": [{"id": "r", "roomHeatingType": null}, {"id": "s", "roomHeatingType": "x"}]}]}}')
    about = S.read_scan_metadata(spark, f"file://{tmp_path}/m.json", whole_files=True)
    assert [(r.has_basement, r.heating) for r in S.scan_flags(about).collect()] == [(True, {"s": "x"})]
    assert S.read_rooms(spark, about, none).collect() == [] and S.metadata_rooms(about).count() == 2


@pytest.mark.parametrize("name", ["no name", "scans_x_Main_St_1_0123abcd-0000-1111-2222-333344445555"])
def test_folder_names(spark, name):
    got = spark.range(1).select(S.scan_uuid(F.lit(name)).alias("u"), S.scan_address(F.lit(name)).alias("a")).first()
    assert tuple(got) == ((None, None) if name == "no name" else ("0123abcd-0000-1111-2222-333344445555", "Main St 1"))


def test_readers_follow_names_and_lines_of_files(spark, tmp_path):
    """The larger file comes second by name; Spark reads it first."""
    head = "event,timestamp,home_id,lead_id,room_id,story_id,distinct_id,error_text\n"
    line = lambda home, i: f"roomScanStarted,2024-01-01T10:00:00Z,{home},l,{i},,d,\n"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.csv").write_text(head + "".join(line("a", i) for i in range(3)))
    (tmp_path / "log" / "b.csv").write_text(head + "".join(line("b", i) for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = [(r.home_id, int(r.room_id)) for r in S.read_events(spark, f"file://{tmp_path}/log").orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a", i) for i in range(3)] + [("b", i) for i in range(4000)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.csv").write_text("home_id,n\nh,old\n")
    (tmp_path / "x" / "2.csv").write_text("home_id,n\n" + "other,0\n" * 500 + "h,new\nh,newest\n")
    assert {r.home_id: r.n for r in S.read_metric_export(spark, f"file://{tmp_path}/x", ["n"]).collect()} == {"h": "newest", "other": "0"}


def test_gaps_round_half_to_even(spark):
    from scanlytics.operators import captures

    df = spark.createDataFrame([("u", i, t, 0.0) for i, t in enumerate((0.0, 15.0, 60.0, 66.0))], "uuid string, seq int, created double, yaw double")
    assert [r.gap_min for r in captures.room_time_gaps(df).orderBy("seq").collect()] == [0.2, 0.8, 0.1]
