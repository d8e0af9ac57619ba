"""Atomic replacement, few record files, geometry files, long rings, lookups by counting, many requests in one plan."""

import math
import os
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tallyzone.operators import lookup as LK
from tallyzone.operators import rank as R
from tallyzone.operators.knn import knn_neighbors
from tallyzone.operators.layer import layer_centroid
from tallyzone.plans import catalog as CAT
from tallyzone.plans.pipeline import requested_report, requested_reports
from tallyzone.session import shared_dir
from tallyzone.sources import store as S
from tallyzone.sources.layer import layer_from_customers, read_geojson, read_layer, write_geojson
from tallyzone.sources.records import fixture_records, period_scan, read_records, table, write_records

SF = "/root/testdata/sf0.001"
AGG = "zip_code int, borough string, total_crashes long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _agg(spark, n):
    return spark.createDataFrame([(10001, "Queens", n)], AGG)


def test_failed_replacement_keeps_the_old_aggregate(spark):
    path = shared_dir(spark, "test-store")
    S.save_aggregate(_agg(spark, 1), path)
    broken = _agg(spark, 2).withColumn("borough", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        S.save_aggregate(broken, path)
    assert [r["total_crashes"] for r in S.read_aggregate(spark, path).collect()] == [1]
    S.save_aggregate(_agg(spark, 3), path)
    assert [r["total_crashes"] for r in S.read_aggregate(spark, path).collect()] == [3]


def test_two_writers_at_once(spark):
    path = shared_dir(spark, "test-store")
    wait = threading.Barrier(4)

    def write(n):
        wait.wait()
        S.save_aggregate(_agg(spark, n), path)

    writers = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    shown = S.read_aggregate(spark, path).collect()
    assert len(shown) == 1 and shown[0]["total_crashes"] in range(4)
    folder = S._Folder(spark, path)
    numbers = folder.names("commits")
    assert len(numbers) <= S.KEPT_COMMITS + 3 and max(numbers) == "00000004"  # each writer had a number of its own


def test_a_commit_cut_off_is_passed_over(spark):
    path = shared_dir(spark, "test-store")
    S.save_aggregate(_agg(spark, 1), path)
    folder = S._Folder(spark, path)
    assert folder.create("commits/00000002", "half a na") and not folder.create("commits/00000002", "x\n")
    assert S.read_aggregate(spark, path).first()["total_crashes"] == 1
    S.save_aggregate(_agg(spark, 2), path)
    assert S.read_aggregate(spark, path).first()["total_crashes"] == 2


def test_records_are_stored_in_few_sorted_files(spark):
    records, path = fixture_records(spark, SF), shared_dir(spark, "test-records")
    write_records(records, path, rows_per_file=400)
    files = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    years = records.select("year").distinct().count()
    assert len(files) <= -(-records.count() // 400) + years  # 80 months
    found = period_scan(read_records(spark, path), (1995, 11), (1996, 2))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, fixture_records(spark, SF, ((1995, 11), (1996, 2))).collect()))
    assert "year" in _plan(found).split("PartitionFilters")[1].split("PushedFilters")[0]
    year = period_scan(read_records(spark, path), (1996, 3), (1996, 5))
    assert "LessThanOrEqual(month,5)" in _plan(year).split("PushedFilters")[1]
    assert year.count() == fixture_records(spark, SF, ((1996, 3), (1996, 5))).count()


def test_geojson_round_trip_with_parts_and_holes(spark):
    layer, path = layer_from_customers(table(spark, SF, "customer")), shared_dir(spark, "test-geojson")
    write_geojson(layer, path)
    assert sorted(map(tuple, read_geojson(spark, path).collect())) == sorted(map(tuple, layer.collect()))


def test_geojson_polygons_and_lines_without(spark, tmp_path):
    lines = ['\x1e{"type":"Feature","properties":{"modzcta":"10001","n":5},"geometry":{"type":"Polygon","coordinates":'
             '[[[0,0],[2.5,0],[2,2],[0,0]],[[1,1],[1,1.5],[1.25,1],[1,1]]]}}',
             '{"type":"Feature","properties":{"modzcta":"10002"},"geometry":null}', "not json", "",
             '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}']
    (tmp_path / "l.json").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in read_geojson(spark, str(tmp_path)).collect())
    rings = [[(0, 0), (2.5, 0), (2, 2), (0, 0)], [(1, 1), (1, 1.5), (1.25, 1), (1, 1)]]
    assert got == [("10001", 0, r, i, float(x), float(y)) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring)]


VERTEX = "modzcta string, part int, ring int, seq int, x double, y double"


def test_centroid_does_not_depend_on_the_first_seq_or_the_ranges(spark):
    n, r, cx, cy = 300, 1e-3, -74.0, 40.75
    at = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * (1 + (i % 7) / 9) * math.sin(2 * math.pi * i / n))
          for i in range(n)]
    at.append(at[0])
    hole = [(cx + x * r / 9, cy + y * r / 9) for x, y in [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]]

    def layer(first):
        return spark.createDataFrame([("A", 0, 0, first + i, x, y) for i, (x, y) in enumerate(at)]
                                     + [("A", 0, 1, first + 2 * i, x, y) for i, (x, y) in enumerate(hole)], VERTEX)

    want = tuple(layer_centroid(layer(0)).first())
    for first, size in ((1, 1 << 16), (-5, 1 << 16), (0, 7), (3, 64), (0, 1)):
        got = tuple(layer_centroid(layer(first), size).first())
        assert got[0] == "A" and abs(got[1] - want[1]) < 1e-12 and abs(got[2] - want[2]) < 1e-12, (first, size)


def test_vertices_are_shuffled_once_and_long_rings_split(spark):
    n = 1_000_000
    turn = F.col("id") * (2 * math.pi / n)
    ring = spark.range(n + 1).select(
        F.lit("A").alias("modzcta"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("seq"),
        (F.cos(turn) - 74).alias("x"), (F.sin(turn) + 40).alias("y"))
    path = shared_dir(spark, "test-ring")
    ring.write.parquet(path)
    found = layer_centroid(read_layer(spark, path))
    plan = _plan(found)
    assert plan.count("Exchange hashpartitioning(zip_text") == 3 and plan.count("range#") > 0
    first = [line for line in plan.splitlines() if "Exchange hashpartitioning(zip_text" in line]
    assert sum("range#" in line.split("plan_id")[0] for line in first) == 1  # the vertices', by (ring, range)
    zip_text, x, y = found.first()
    assert abs(x + 74) < 1e-9 and abs(y - 40) < 1e-9


def test_prefix_as_ranges():
    for prefix in ("", "0", "1", "10", "-", "-1", "2147483647", "21474836470", "007", "x", "-0", "1 ", "99999"):
        ranges = LK.prefix_ranges(prefix)
        for z in (0, 1, 7, 9, 10, 19, 100, 109, 110, 1000, 1099, 1100, 99999, 999990, 2147483647, -1, -10, -2147483648):
            want = str(z).startswith(prefix)
            assert want == (True if ranges is None else any(a <= z <= b for a, b in ranges)), (prefix, z)


def test_prefix_reaches_the_reader(spark):
    plan = _plan(E.queries()["zip_prefix"](spark, SF))
    assert "GreaterThanOrEqual(zip_code,1010)" in plan.split("PushedFilters")[1]


def test_unknown_borough_is_summed(spark):
    agg = spark.createDataFrame([(1, "Hoboken", 3), (2, "Queens", 4), (3, "Queens", 5)], AGG)
    for rows in (R.area_summary(agg).collect(), R.scope_summary(R.all_scopes(agg)).collect()):
        got = {r["scope"]: tuple(r)[1:] for r in rows}
        assert got["Hoboken"] == (3, 1, 3.0) and got["Citywide"] == (12, 3, 4.0) and got["Queens"] == (9, 2, 4.5)
        assert got["Brooklyn"] == (0, 0, None) and len(rows) == 7


def test_lookup_counts_without_sort_or_write(spark):
    agg = spark.createDataFrame([(i, ("Queens", "Bronx")[i % 2], (i * 7) % 5) for i in range(40)], AGG)
    every = {r["zip_code"]: tuple(r) for r in LK.area_lookup_all(agg).collect()}
    for z in (0, 1, 17, 39):
        found = LK.area_lookup(agg, f" {z}")
        assert [tuple(r) for r in found.collect()] == [every[z]]
        plan = _plan(found)
        assert "Sort [" not in plan and "Window" not in plan and "parquet" not in plan
    assert LK.area_lookup(agg, "40").count() == 0 and LK.area_lookup(agg, "x").count() == 0
    assert LK.area_lookup(agg.where("false"), "1").count() == 0


def test_requests_read_the_records_once(spark, monkeypatch):
    reads = []
    read = CAT.fixture_records

    def counting(*args):
        reads.append(args)
        return read(*args)

    monkeypatch.setattr("tallyzone.plans.pipeline.fixture_records", counting)
    asked = [*CAT.DEMO_REQUESTS, ((1996, 10), (1997, 6))]
    got = requested_reports(spark, SF, asked, CAT.DEMO_AS_OF, earliest=CAT.DEMO_EARLIEST)
    assert len(reads) == 1
    table = sorted(tuple(r) for r in got.table.collect())
    totals = sorted(tuple(r) for r in got.totals.collect())
    each = [(i, requested_report(spark, SF, s, e, CAT.DEMO_AS_OF, earliest=CAT.DEMO_EARLIEST))
            for i, (s, e) in enumerate(asked)]
    assert table == sorted((i, *r) for i, one in each if one for r in one.table.collect())
    assert totals == sorted((i, *one.totals.first()) for i, one in each if one and one.totals.first()[0])
    none = requested_reports(spark, SF, [((1990, 1), (1990, 2))], CAT.DEMO_AS_OF, earliest=CAT.DEMO_EARLIEST)
    assert none.table.count() == 0


def test_knn_writes_the_same_tables_whatever_the_points(spark, monkeypatch):
    names = []
    import tallyzone.operators.knn as K
    import tallyzone.session as session
    monkeypatch.setattr(K, "counted", lambda df, n: names.append(n) or session.counted(df, n))
    monkeypatch.setattr(K, "materialised", lambda df, n: names.append(n) or session.materialised(df, n))
    queries = spark.createDataFrame([(1, 40.0, -74.0)], "qid long, lat double, lon double")
    seen = set()
    for spread in (1e-9, 1.0, 1e4):
        train = spark.range(500).select(F.col("id").alias("tid"), (F.col("id") * spread).alias("lat"),
                                        (-F.col("id") * spread).alias("lon"), F.lit(1).alias("zip"))
        names.clear()
        assert knn_neighbors(train, queries, 5).count() == 5
        seen.add(tuple(names))
    assert seen == {("train", "tiles", "stripes", "home")}


def test_knn_of_several_data_sets_in_one_index(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    train = [(g, i, float(x), float(y), int(i % 4)) for g in range(5) for i, (x, y) in
             enumerate(np.round(rng.normal(g, 1 + g, (3 ** g * 5 - 4, 2)), 2))]
    asked = [(g, float(x), float(y)) for g in range(6) for x, y in np.round(rng.normal(g, 3, (20, 2)), 2)]
    from tallyzone.operators.knn import point_neighbors
    got = {}
    for r in point_neighbors(spark.createDataFrame(train, "g int, tid long, lat double, lon double, zip int"),
                             spark.createDataFrame(asked, "g int, lat double, lon double"), 4, ["g"]).collect():
        got.setdefault((r["g"], r["qlat"], r["qlon"]), []).append((r["j"], r["tid"]))
    for g, x, y in asked:
        near = sorted(((x - a) * (x - a) + (y - b) * (y - b), i) for h, i, a, b, _ in train if h == g)[:4]
        assert [t for _, t in sorted(got.get((g, x, y), []))] == [i for _, i in near]
