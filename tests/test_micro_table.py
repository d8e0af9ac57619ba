"""The hand-worked micro table (k = 5): every presence class and tie rule once."""

from pyspark.sql import functions as F

from tallyzone.operators import classify as C
from tallyzone.operators.aggregate import crashes_by_zip
from tallyzone.operators.rank import area_report, rank_scoped, scope_summary, with_scope
from tallyzone.operators.repair import fill_zip_codes, zip_borough_map
from tallyzone.sources.records import RECORD_SCHEMA

NAN = float("nan")
# id, year, month, zip text, borough, crash_count, lat, lon
ROWS = [
    (1, 2025, 2, "10001", "Manhattan", 1, 40.0, -74.0),
    (2, 2025, 2, "10001", "Manhattan", 2, 40.0, -74.0),
    (3, 2025, 2, "10001", "Bronx", 1, 40.0, -74.0),
    (4, 2025, 2, "10002", "Queens", 1, 41.0, -74.0),
    (5, 2025, 2, "10002", "Bronx", 1, 41.0, -74.0),
    (6, 2025, 2, None, "Queens", 4, 40.1, -74.0),
    (7, 2025, 2, None, None, 1, 40.9, -74.0),
    (8, 2025, 2, "10003", "Brooklyn", 9, None, None),
    (9, 2025, 2, "10002", None, 1, 41.0, -74.0),
    (10, 2025, 2, "10001", None, 1, None, None),
    (11, 2025, 2, "10001", "Manhattan", 5, 40.0, None),
    (12, 2025, 2, None, "Queens", 7, None, None),
    (13, 2025, 2, None, None, 7, None, None),
    (14, 2025, 2, "N/A", "Queens", 1, 41.05, -74.0),
    (15, 2025, 2, "10002.0", "Queens", None, NAN, NAN),
]


def _classified(spark):
    raw = spark.createDataFrame(ROWS, RECORD_SCHEMA)
    return C.with_class(C.typed_records(raw))


def test_classes(spark):
    got = {r["id"]: r["cls"] for r in _classified(spark).collect()}
    assert got[1] == C.TRUSTED
    assert got[6] == C.COORDS_BOROUGH
    assert got[7] == C.COORDS_ONLY
    assert got[8] == C.ZIP_BOROUGH
    assert got[9] == C.ZIP_COORDS
    assert got[10] == C.ZIP_ONLY
    assert got[11] == C.PARTIAL
    assert got[12] == C.BOROUGH_ONLY
    assert got[13] == C.NOTHING
    assert got[14] == C.COORDS_BOROUGH      # "N/A" is not a zip
    assert got[15] == C.ZIP_BOROUGH         # "10002.0" parses, NaN is missing


def test_borough_map_ties(spark):
    m = {r["zip_code"]: r["borough"] for r in
         zip_borough_map(C.of_class(_classified(spark), C.TRUSTED)).collect()}
    assert m == {10001: "Manhattan", 10002: "Bronx"}   # 1-1 tie -> alphabetical


def test_knn_fill(spark):
    cls = _classified(spark)
    got = {r["id"]: r["zip_code"] for r in fill_zip_codes(cls, 5).collect()}
    assert got == {6: 10001, 7: 10001, 14: 10001}
    got3 = {r["id"]: r["zip_code"] for r in fill_zip_codes(cls, 3).collect()}
    assert got3[7] == 10002


def test_report(spark):
    agg = crashes_by_zip(_classified(spark), 5)
    assert [tuple(r) for r in agg.collect()] == [(10001, "Manhattan", 11), (10002, "The Bronx", 3)]
    rep = {r["zip_code"]: r for r in area_report(agg, "Citywide").collect()}
    assert (rep[10001]["rank"], rep[10001]["crash_likelihood"], rep[10001]["decile"]) == (1, 1.57, 1)
    assert (rep[10002]["rank"], rep[10002]["crash_likelihood"], rep[10002]["decile"]) == (2, 0.43, 10)
    summ = scope_summary(with_scope(agg, "Citywide")).collect()[0]
    assert summ["total_crashes"] == 14 and summ["average_crashes_per_zip"] == 7.0


def test_single_area_scope(spark):
    agg = crashes_by_zip(_classified(spark), 5)
    rows = rank_scoped(with_scope(agg, "The Bronx")).collect()
    assert len(rows) == 1 and rows[0]["rank"] == 1 and rows[0]["decile"] == 1
    assert rank_scoped(with_scope(agg, "Queens")).count() == 0


def test_unknown_borough_is_empty(spark):
    agg = crashes_by_zip(_classified(spark), 5)
    assert area_report(agg, "Atlantis").where(F.lit(True)).count() == 0
