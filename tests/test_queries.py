"""Every registered query with SQL against DuckDB on the same tables, at sf0.01."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from scanlytics.plans import registry

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x) if x is not None else None


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    out = registry.queries()[name](spark, D)
    want = db.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert table(out.columns, out.collect()) == table(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_attempt_cases(spark):
    from scanlytics.operators import events as E

    def labels(*names):
        rows = [(i, datetime.datetime(2024, 1, 1, 0, i // 2), n, "h", "l", "r", "s", "d") for i, n in enumerate(names)]
        df = spark.createDataFrame(rows, "seq long, ts timestamp, event string, home_id string, lead_id string, room_id string, story_id string, distinct_id string")
        return [(r.label, r.stops) for r in E.scan_attempts(df).orderBy("attempt").collect()]

    assert labels(E.STARTED, E.STARTED, E.COMPLETED) == [("BROKEN", 0), ("CLEAN", 0)]
    assert labels(E.STARTED, E.STOPPED, E.COMPLETED) == [("CLEAN", 1)]
    assert labels(E.STARTED, E.CANCELLED, "roomScanError") == [("CANCELLED", 0)]
    assert labels("roomScanError", E.STARTED, E.REINIT, E.COMPLETED) == [("RECOVERED", 0)]


def test_polygon_cases(spark):
    from pyspark.sql import functions as F

    from scanlytics.functions import geometry as G

    square = [(0.0, 1.0, 0.0), (0.0, 1.0, 2.0), (2.0, 1.0, 2.0), (2.0, 1.0, 0.0)]
    rows = [(0, square), (1, square[:2]), (2, []), (3, None), (4, [square[0]] * 4)]
    c = F.col("c")
    df = spark.createDataFrame(rows, "i int, c array<struct<x:double,y:double,z:double>>")
    out = df.select("i", G.area_xz(c), G.area_3d(c), G.unit_normal(c)["y"], G.high(c), G.net_area(c, F.array(c, c))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [(4.0, 4.0, 1.0, 1.0, 0.0), (0.0, 0.0, None, 1.0, 0.0), (0.0, 0.0, None, None, 0.0), (0.0, 0.0, None, None, 0.0), (0.0, 0.0, None, 1.0, 0.0)]


def test_locator_cases(spark):
    from pyspark.sql import functions as F

    from scanlytics.functions import geometry as G

    df = spark.createDataFrame([(0, "a::wall::1:2"), (1, "a::wall::"), (2, "a::wall"), (3, ""), (4, None), (5, "a::b::c::d:e")], "i int, t string")
    out = df.select(G.locator_kind(F.col("t")), G.locator_parts(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("wall", ["1", "2"]), ("wall", []), ("", []), ("", []), ("", []), ("b", ["c", "", "d", "e"])]


def test_cutout_cases(spark):
    from scanlytics.operators import surfaces as S

    def upright(low, high):
        return [(0.0, low, 0.0), (1.0, low, 0.0), (1.0, high, 0.0), (0.0, high, 0.0)]

    rows = [("u", 0, "a", "wall", upright(0.0, 1.5), [upright(0.5, 2.0), upright(0.5, 1.5)]), ("u", 1, "b", "wall", None, None), ("u", 2, "c", "wall", upright(0.0, 1.0), [])]
    polygon = "array<struct<x:double,y:double,z:double>>"
    df = spark.createDataFrame(rows, f"uuid string, seq int, locator_id string, category string, corners {polygon}, openings array<{polygon}>")
    assert [(r.seq, r.cutout, r.evidence) for r in S.cutouts_outside(df).collect()] == [(0, 0, 0.5)]
    assert [r.seq for r in S.silent_drops(df).collect()] == [1]


def test_upper_quartile_cases(spark):
    import statistics

    from scanlytics.operators import reports as T

    groups = {"a": [3, 1, 2, 10, 7, 7], "b": [5, 1], "c": [4], "d": [1, 2, 3, 4, 5], "e": [2, 2, 2, 9, 1, 1, 1, 1]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("a", None), (None, 1)], "label string, v int")
    out = {r.label: (r.n, r["median"], r.p75) for r in T.compare_numbers(df, "label", "v").collect()}
    assert out == {k: (len(v), statistics.median(v), statistics.quantiles(v, n=4)[2] if len(v) > 4 else max(v)) for k, v in groups.items()}


def test_tier_cases(spark):
    from scanlytics.operators import surfaces as S

    rows = [(1, 0, 2, None, None), (4, 0, 0, False, False), (2, 0, 0, True, True), (2, 2, 0, False, True), (2, 2, 1, False, True), (1, 1, 0, False, True), (2, 3, 1, True, False)]
    df = spark.createDataFrame(rows, "n_stories int, n_oblique int, n_flat int, has_half_height boolean, has_gable boolean")
    assert [r.tier for r in S.building_tier(df).collect()] == [1, 8, 4, 6, 7, 5, 8]
