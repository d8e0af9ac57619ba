"""Scalar functions, period rules, positions, centroids, invariants."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyzone.functions import periods as P
from tallyzone.functions.positions import with_global_position
from tallyzone.functions.values import pad_zip, parse_zip, rank_group, round2
from tallyzone.operators.layer import layer_centroid


def test_parse_zip(spark):
    texts = ["11207", "11207.0", "11207.", " 10001 ", "+10001", "11207d", "1f", "11207.5", "1e4",
             "N/A", "", None, "99999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_zip("s")).collect()]
    assert got == [11207, 11207, 11207, 10001, 10001, None, None, None, None, None, None, None, None]


def test_round2_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (1.005,), (2.5,)], "x double")
    got = [r[0] for r in df.select(round2("x")).collect()]
    import numpy as np
    assert got == [float(np.round(v, 2)) for v in (0.125, 0.135, 1.005, 2.5)]


def test_rank_group_matches_quantile_bins(spark):
    sizes = sorted({*range(10, 400), *range(400, 1500, 7), 1499})
    df = spark.createDataFrame([(n,) for n in sizes], "n int").select(
        "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("r"))
    got = df.withColumn("d", rank_group("r", "n")).groupBy("n").agg(
        F.array_sort(F.collect_list(F.struct("r", "d"))).alias("rows")).collect()
    for row in got:
        n = row["n"]
        want = (pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1).tolist()
        assert [x["d"] for x in row["rows"]] == want, n


@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_rank_group_of_few(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").cast("int").alias("r"), F.lit(n).alias("n"))
    got = [r[0] for r in df.orderBy("r").select(rank_group("r", "n")).collect()]
    assert got[0] == 1 and got[-1] == (10 if n > 1 else 1) and got == sorted(got)


def test_rank_group_sizes_178(spark):
    df = spark.range(1, 179).select(F.col("id").cast("int").alias("r"), F.lit(178).alias("n"))
    sizes = df.select(rank_group("r", "n").alias("d")).groupBy("d").count().orderBy("d").collect()
    assert [r["count"] for r in sizes] == [18, 18, 18, 17, 18, 18, 17, 18, 18, 18]


def test_pad_zip(spark):
    df = spark.createDataFrame([(123,), (10001,), (123456,)], "z int")
    assert [r[0] for r in df.select(pad_zip("z")).collect()] == ["00123", "10001", "123456"]


# (start month, start year, end month, end year, valid) with as_of 2025-03-15
PERIODS = [
    (7, 2010, 7, 2011, False),
    (8, 2011, 7, 2011, False),
    (3, 2025, 3, 2025, True),
    (3, 2025, 4, 2025, False),
    (8, 2011, 8, 2011, True),
    (8, 2011, 9, 2011, True),
    (8, 2011, 1, 2100, False),
    (2, 2025, 2, 2025, True),
]


def test_period_validity(spark):
    df = spark.createDataFrame([p[:4] for p in PERIODS], "sm int, sy int, em int, ey int")
    got = [r[0] for r in df.select(P.period_valid("sy", "sm", "ey", "em", "2025-03-15")).collect()]
    assert got == [p[4] for p in PERIODS]


def test_previous_month_and_names(spark):
    df = spark.createDataFrame([("2025-01-15",), ("2025-03-01",)], "d string")
    got = df.select(F.year(P.previous_month(F.col("d"))), F.month(P.previous_month(F.col("d"))),
                    P.month_name(F.lit(2))).collect()
    assert [tuple(r) for r in got] == [(2024, 12, "February"), (2025, 2, "February")]


def test_global_position_is_row_number(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"), F.col("id"))
    got = with_global_position(df, [F.col("v").desc(), F.col("id")], "pos").collect()
    want = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    pos = {(r["v"], r["id"]): r["pos"] for r in got}
    assert [pos[t] for t in want] == list(range(1, 5001))


def test_centroid_with_hole_and_parts(spark):
    # 2x2 square with a 1x1 hole at [0.5,1.5]^2 -> centroid (1, 1); plus a two-part shape
    rows = []
    sq = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(0.5, 0.5), (0.5, 1.5), (1.5, 1.5), (1.5, 0.5), (0.5, 0.5)]
    rows += [("A", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(sq)]
    rows += [("A", 0, 1, i, float(x), float(y)) for i, (x, y) in enumerate(hole)]
    a = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    b = [(3, 0), (5, 0), (5, 2), (3, 2), (3, 0)]
    rows += [("B", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(a)]
    rows += [("B", 1, 0, i, float(x), float(y)) for i, (x, y) in enumerate(b)]
    df = spark.createDataFrame(rows, "modzcta string, part int, ring int, seq int, x double, y double")
    got = {r["zip_text"]: (r["centroid_x"], r["centroid_y"]) for r in layer_centroid(df).collect()}
    assert math.isclose(got["A"][0], 1.0) and math.isclose(got["A"][1], 1.0)
    # areas 1 and 4: x = (0.5*1 + 4*4)/5, y = (0.5*1 + 1*4)/5
    assert math.isclose(got["B"][0], 3.3) and math.isclose(got["B"][1], 0.9)


def test_centroid_of_a_tiny_ring_far_from_the_origin(spark):
    n, r, cx, cy = 500, 1e-4, -74.0, 40.75
    at = [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    rows = [("A", 0, 0, i, x, y) for i, (x, y) in enumerate([*at, at[0]])]
    df = spark.createDataFrame(rows, "modzcta string, part int, ring int, seq int, x double, y double")
    got = layer_centroid(df).first()
    assert abs(got["centroid_x"] - cx) < 1e-9 and abs(got["centroid_y"] - cy) < 1e-9


def test_requests_before_any_job():
    for sm, sy, em, ey, valid in PERIODS:
        assert P.request_valid((sy, sm), (ey, em), "2025-03-15") == valid
    assert P.previous_period("2025-01-15") == (2024, 12) and P.previous_period("2025-03-01") == (2025, 2)


def test_empty_scope_has_total_zero(spark):
    from tallyzone.operators import rank as R
    agg = spark.createDataFrame([(10001, "Queens", 3), (10002, "Queens", 4)],
                                "zip_code int, borough string, total_crashes long")
    rows = {r["scope"]: (r["total_crashes"], r["n_areas"], r["average_crashes_per_zip"])
            for r in R.scope_summary(R.all_scopes(agg)).collect()}
    assert rows["Brooklyn"] == (0, 0, None) and rows["Citywide"] == rows["Queens"] == (7, 2, 3.5) and len(rows) == 6
    assert tuple(R.full_report(agg, "Brooklyn").totals.first()) == (0, None)
    table, totals = R.full_report(agg, "Queens")
    assert table.count() == 2 and tuple(totals.first()) == (7, 3.5)


def test_options_for_coordinates_and_boroughs(spark):
    from tallyzone.operators import classify as C
    from tallyzone.operators import repair as RP
    raw = spark.createDataFrame(
        [(1, 2020, 1, "10001", "Queens", 1, 40.7, -73.9), (2, 2020, 1, "10001", None, 1, 40.7, None),
         (3, 2020, 1, None, "Queens", 1, 0.0, 0.0)],
        "id long, year int, month int, zip_code string, borough string, crash_count int, latitude double, longitude double")
    kinds = lambda df, **o: [r["cls"] for r in C.with_class(df, **o).orderBy("id").collect()]
    assert kinds(C.typed_records(raw)) == [C.TRUSTED, C.PARTIAL, C.COORDS_BOROUGH]
    assert kinds(C.typed_records(raw), partial_as_missing=True) == [C.TRUSTED, C.ZIP_ONLY, C.COORDS_BOROUGH]
    boxed = C.typed_records(raw, box=(40.0, -75.0, 41.0, -73.0))
    assert kinds(boxed) == [C.TRUSTED, C.PARTIAL, C.BOROUGH_ONLY]
    rows = spark.createDataFrame([(1, 10001, "Queens"), (2, 10009, "Queens")], "id long, zip_code int, borough string")
    zmap = spark.createDataFrame([(10001, "Bronx")], "zip_code int, borough string")
    got = lambda **o: [r["borough"] for r in RP.borough_repair(rows, zmap, **o).orderBy("id").collect()]
    assert got() == ["Bronx", None] and got(keep_unmapped=True) == ["Bronx", "Queens"]
