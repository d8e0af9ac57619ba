"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (records are derived from ``orders``,
the polygon layer from ``customer``) over their whole extent. Fixed
request parameters (a period, a borough, a zip, a prefix, a reference
date) appear only where the parameter is the feature itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.constants import CITYWIDE, SCOPES
from tallyzone.functions import periods as P
from tallyzone.functions.values import pad_zip, rename_bronx
from tallyzone.operators import classify as C
from tallyzone.operators import layer as L
from tallyzone.operators import lookup as LK
from tallyzone.operators import rank as R
from tallyzone.operators import repair as RP
from tallyzone.operators.knn import knn_neighbors
from tallyzone.plans.pipeline import (classified_records, default_report, fetch_and_aggregate, raw_records,
                                      requested_reports)
from tallyzone.session import materialised, shared_dir
from tallyzone.sources import store as S
from tallyzone.sources.layer import layer_from_customers, read_geojson, read_layer, write_geojson
from tallyzone.sources.records import assign_row_id, fixture_records, period_scan, read_records, table, write_records

# Request parameters of the feature-level queries.
DEMO_PERIOD = ((1995, 1), (1995, 6))
DEMO_SCOPE = "Brooklyn"
DEMO_LAYER_SCOPE = "Queens"
DEMO_ZIP = "10042"
DEMO_PREFIX = "1010"
DEMO_AS_OF = "2000-06-15"
DEMO_EARLIEST = (1996, 8)
DEMO_VISIT = "1998-06-15"
DEMO_REQUESTS = (((1996, 8), (1996, 12)), ((1990, 1), (1990, 2)), ((1997, 3), (1997, 2)), ((2000, 6), (2000, 6)))
EMPTY_PERIOD = ((1990, 1), (1990, 12))
STRESS_K = 5


def _agg(spark, sf):
    return fetch_and_aggregate(spark, sf, sort=False)


def _cls(spark, sf):
    return classified_records(spark, sf)


def _layer(spark, sf):
    return layer_from_customers(table(spark, sf, "customer"))


def _citywide(spark, sf):
    return R.area_report(_agg(spark, sf), CITYWIDE)


def _month_counts(spark, sf) -> DataFrame:
    return raw_records(spark, sf).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_records"))


# --- scans and sources ------------------------------------------------------

def q_period_scan(spark, sf):
    return fixture_records(spark, sf, DEMO_PERIOD)


def q_assign_row_id(spark, sf):
    recs = raw_records(spark, sf).select("id", "year", "month")
    return assign_row_id(recs, ["year", "month", "id"], "row_id")


def q_typed_records(spark, sf):
    return C.typed_records(raw_records(spark, sf))


def q_aggregate_roundtrip(spark, sf):
    path = shared_dir(spark, "aggregate")
    S.save_aggregate(_agg(spark, sf), path)
    return S.read_aggregate(spark, path)


def q_load_or_build(spark, sf):
    base = shared_dir(spark, "store")
    first, last = raw_records(spark, sf).agg(F.min(F.struct("year", "month")), F.max(F.struct("year", "month"))).first()
    start, end = tuple(first), tuple(last)

    def once():
        return S.load_or_build(spark, base, start, end,
                               lambda: fetch_and_aggregate(spark, sf, (start, end), sort=False))

    once()
    return once()  # the stored one


def q_replaced_aggregate(spark, sf):
    path = shared_dir(spark, "aggregate")
    agg = materialised(_agg(spark, sf), "aggregate")
    S.save_aggregate(agg.where(F.col("zip_code") % 2 == 0), path)
    S.save_aggregate(agg, path)
    return S.read_aggregate(spark, path)


def q_stored_period_scan(spark, sf):
    path = shared_dir(spark, "records")
    write_records(raw_records(spark, sf), path)
    return period_scan(read_records(spark, path), *DEMO_PERIOD)


def q_empty_period(spark, sf):
    return fetch_and_aggregate(spark, sf, EMPTY_PERIOD, sort=False)


# --- classes and filters ------------------------------------------------------

def q_class_counts(spark, sf):
    return C.class_counts(_cls(spark, sf))


def q_class_trusted(spark, sf):
    return C.of_class(_cls(spark, sf), C.TRUSTED).select(
        "id", "zip_code", "borough", "crash_count", "latitude", "longitude")


def q_fillable_records(spark, sf):
    return C.fillable_records(_cls(spark, sf)).select(*RP.RECORD_OUT)


def q_null_counts(spark, sf):
    return C.null_crash_counts(_cls(spark, sf)).select("id", "zip_code", "borough", "cls")


# --- repair -------------------------------------------------------------------

def q_zip_borough_counts(spark, sf):
    return RP.zip_borough_counts(C.of_class(_cls(spark, sf), C.TRUSTED))


def q_zip_borough_map(spark, sf):
    return RP.zip_borough_map(C.of_class(_cls(spark, sf), C.TRUSTED))


def q_borough_rename(spark, sf):
    m = RP.zip_borough_map(C.of_class(_cls(spark, sf), C.TRUSTED))
    return m.select("zip_code", rename_bronx("borough").alias("borough"))


def q_borough_repair(spark, sf):
    cls = _cls(spark, sf)
    zmap = RP.stored_borough_map(C.of_class(cls, C.TRUSTED))
    rows = C.of_class(cls, *C.ZIP_PRESENT).select("id", "zip_code", "borough")
    return RP.borough_repair(rows, zmap)


def q_knn_neighbors(spark, sf):
    return RP.zip_neighbors(_cls(spark, sf))


def q_knn_zip_vote(spark, sf):
    return RP.fill_zip_codes(_cls(spark, sf))


def q_repaired_records(spark, sf):
    return RP.repaired_records(_cls(spark, sf))


def q_union_distinct(spark, sf):
    # Six frames, one per fillable class; every third record is in the next class's frame, too.
    rows = materialised(RP.repaired_records(_cls(spark, sf)), "repaired")
    frames = [rows.where((F.col("cls") == own) | ((F.col("cls") == after) & (F.col("id") % 3 == 0)))
              for own, after in zip(C.FILLABLE, [*C.FILLABLE[1:], C.FILLABLE[0]])]
    return RP.union_distinct(frames)


def q_knn_neighbors_search(spark, sf):
    """Clusters and near-ties: the first two entries of every vector; ids divisible by 100 ask all rows, their own too."""
    points = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding")[0].alias("lat"), F.col("embedding")[1].alias("lon"), F.col("label").alias("zip"))
    asked = points.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "qid")
    return knn_neighbors(points.withColumnRenamed("vec_id", "tid"), asked, STRESS_K).select(F.col("qid").alias("id"), "j", "tid", "zip", "d2")


# --- aggregates and reports -------------------------------------------------------

def q_crashes_by_zip(spark, sf):
    return fetch_and_aggregate(spark, sf)


def q_scope_filter(spark, sf):
    return R.scope_filter(_agg(spark, sf), DEMO_SCOPE)


def q_scope_summary(spark, sf):
    return R.area_summary(_agg(spark, sf)).select(
        "scope", "total_crashes", "n_areas", "average_crashes_per_zip")


def q_report_totals(spark, sf):
    agg = materialised(_agg(spark, sf), "aggregate")
    return reduce(DataFrame.unionByName, [
        R.scope_totals(agg, s).select(F.lit(s).alias("scope"), "total_crashes", "average_crashes_per_zip")
        for s in SCOPES])


def q_default_report(spark, sf):
    base = shared_dir(spark, "store")
    default_report(spark, sf, base, DEMO_VISIT)  # the first visit builds and stores
    return default_report(spark, sf, base, DEMO_VISIT).table


def q_validated_request(spark, sf):
    return requested_reports(spark, sf, DEMO_REQUESTS, DEMO_AS_OF, earliest=DEMO_EARLIEST).table


def q_rank_citywide(spark, sf):
    return _citywide(spark, sf).select("zip_code", "total_crashes", "rank")


def q_rank_by_borough(spark, sf):
    agg = _agg(spark, sf)
    return R.rank_scoped(agg.withColumn("scope", F.col("borough"))).select(
        "scope", "zip_code", "total_crashes", "rank")


def q_crash_likelihood(spark, sf):
    return _citywide(spark, sf).select("zip_code", "crash_likelihood")


def q_deciles(spark, sf):
    return _citywide(spark, sf).select("zip_code", "rank", "decile")


def q_area_report(spark, sf):
    return _citywide(spark, sf)


def q_area_report_all(spark, sf):
    return R.area_report_all(_agg(spark, sf))


def q_decile_rollup(spark, sf):
    return R.decile_rollup(R.rank_scoped(R.all_scopes(_agg(spark, sf))))


def q_display_columns(spark, sf):
    return R.display_columns(_citywide(spark, sf))


# --- lookups ------------------------------------------------------------------------

def q_unique_zips(spark, sf):
    return LK.unique_zips(_agg(spark, sf))


def q_zip_prefix(spark, sf):
    return LK.zip_prefix(materialised(_agg(spark, sf), "aggregate"), DEMO_PREFIX)


def q_area_lookup(spark, sf):
    return LK.area_lookup(_agg(spark, sf), DEMO_ZIP)


def q_area_lookup_all(spark, sf):
    return LK.area_lookup_all(_agg(spark, sf))


# --- map layer ------------------------------------------------------------------------

def q_zip_padding(spark, sf):
    return _agg(spark, sf).select("zip_code", pad_zip("zip_code").alias("zip_text"))


def q_layer_semi(spark, sf):
    return L.layer_semi(_layer(spark, sf), _citywide(spark, sf), DEMO_LAYER_SCOPE)


def q_layer_join(spark, sf):
    return L.layer_join(_layer(spark, sf), _citywide(spark, sf), CITYWIDE)


def _rounded(df, digits=9):
    scale = float(10 ** digits)
    return df.withColumns({c: F.rint(F.col(c) * scale) / scale for c in ("centroid_x", "centroid_y")})


def q_layer_centroid(spark, sf):
    return _rounded(L.layer_centroid(_layer(spark, sf)))


def q_stored_layer(spark, sf):
    path = shared_dir(spark, "layer")
    _layer(spark, sf).write.parquet(path)
    return L.layer_keys(read_layer(spark, path)).select("zip_text", "part", "ring", "seq", "x", "y")


def q_geojson_layer(spark, sf):
    path = shared_dir(spark, "geojson")
    write_geojson(_layer(spark, sf), path)
    return L.layer_keys(read_geojson(spark, path)).select("zip_text", "part", "ring", "seq", "x", "y")


def q_layer_labels(spark, sf):
    return L.layer_table(_layer(spark, sf), _citywide(spark, sf), CITYWIDE).select("zip_text", "label")


def q_layer_table(spark, sf):
    return _rounded(L.layer_table(_layer(spark, sf), _citywide(spark, sf), CITYWIDE))


# --- periods ----------------------------------------------------------------------------

def q_valid_years(spark, sf):
    years = spark.range(1).select(F.explode(P.valid_years(DEMO_AS_OF, DEMO_EARLIEST[0])).alias("y")) \
        .select(F.col("y").cast("int").alias("year"))
    counts = raw_records(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n_records"))
    return years.join(counts, "year", "left").select(
        "year", F.coalesce(F.col("n_records"), F.lit(0)).alias("n_records"))


def q_valid_periods(spark, sf):
    m = _month_counts(spark, sf)
    return m.select(
        "year", "month",
        P.month_key("year", "month").alias("month_key"),
        P.month_in_range("year", "month", DEMO_AS_OF, DEMO_EARLIEST).alias("in_range"),
        (P.month_start("year", "month") == P.latest_month(DEMO_AS_OF)).alias("is_latest"),
        "n_records",
    )


def q_period_validity(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    start = F.trunc(F.col("o_orderdate").cast("date"), "month")
    end = F.add_months(start, (F.col("o_orderkey") % 25).cast("int") - 6)
    req = o.select(F.col("o_orderkey").alias("id"),
                   F.year(start).alias("sy"), F.month(start).alias("sm"),
                   F.year(end).alias("ey"), F.month(end).alias("em"))
    return req.select(
        "id", "sy", "sm", "ey", "em",
        P.month_in_range("sy", "sm", DEMO_AS_OF, DEMO_EARLIEST).alias("start_ok"),
        P.month_in_range("ey", "em", DEMO_AS_OF, DEMO_EARLIEST).alias("end_ok"),
        P.start_not_after_end("sy", "sm", "ey", "em").alias("ordered"),
        P.period_valid("sy", "sm", "ey", "em", DEMO_AS_OF, DEMO_EARLIEST).alias("valid"),
    )


def q_current_month(spark, sf):
    """Records of the current month of each year up to now."""
    m = _month_counts(spark, sf)
    return m.where((F.col("month") == P.current_month(DEMO_AS_OF)) & (F.col("year") <= P.current_year(DEMO_AS_OF)))


def q_default_period(spark, sf):
    m = _month_counts(spark, sf)
    visit = P.month_start("year", "month")
    prev = P.previous_month(visit)
    asked = m.select("year", "month",
                     F.year(prev).alias("default_year"), F.month(prev).alias("default_month"))
    have = m.select(F.col("year").alias("default_year"), F.col("month").alias("default_month"),
                    F.col("n_records").alias("n_default_records"))
    return asked.join(have, ["default_year", "default_month"], "left").select(
        "year", "month", "default_year", "default_month",
        F.coalesce(F.col("n_default_records"), F.lit(0)).alias("n_default_records"))


def q_period_label(spark, sf):
    m = _month_counts(spark, sf)
    return m.select("year", "month",
                    F.concat_ws(" ", P.month_name("month"), F.col("year").cast("string")).alias("label"),
                    "n_records")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "period_scan": q_period_scan,
    "assign_row_id": q_assign_row_id,
    "typed_records": q_typed_records,
    "class_counts": q_class_counts,
    "class_trusted": q_class_trusted,
    "fillable_records": q_fillable_records,
    "null_counts": q_null_counts,
    "zip_borough_counts": q_zip_borough_counts,
    "zip_borough_map": q_zip_borough_map,
    "borough_rename": q_borough_rename,
    "borough_repair": q_borough_repair,
    "knn_neighbors": q_knn_neighbors,
    "knn_zip_vote": q_knn_zip_vote,
    "knn_neighbors_search": q_knn_neighbors_search,
    "repaired_records": q_repaired_records,
    "union_distinct": q_union_distinct,
    "crashes_by_zip": q_crashes_by_zip,
    "scope_filter": q_scope_filter,
    "scope_summary": q_scope_summary,
    "rank_citywide": q_rank_citywide,
    "rank_by_borough": q_rank_by_borough,
    "crash_likelihood": q_crash_likelihood,
    "deciles": q_deciles,
    "area_report": q_area_report,
    "area_report_all": q_area_report_all,
    "decile_rollup": q_decile_rollup,
    "display_columns": q_display_columns,
    "unique_zips": q_unique_zips,
    "zip_prefix": q_zip_prefix,
    "area_lookup": q_area_lookup,
    "area_lookup_all": q_area_lookup_all,
    "zip_padding": q_zip_padding,
    "layer_semi": q_layer_semi,
    "layer_join": q_layer_join,
    "layer_centroid": q_layer_centroid,
    "layer_labels": q_layer_labels,
    "layer_table": q_layer_table,
    "aggregate_roundtrip": q_aggregate_roundtrip,
    "load_or_build": q_load_or_build,
    "valid_years": q_valid_years,
    "valid_periods": q_valid_periods,
    "period_validity": q_period_validity,
    "default_period": q_default_period,
    "period_label": q_period_label,
    "replaced_aggregate": q_replaced_aggregate,
    "stored_period_scan": q_stored_period_scan,
    "empty_period": q_empty_period,
    "report_totals": q_report_totals,
    "default_report": q_default_report,
    "validated_request": q_validated_request,
    "stored_layer": q_stored_layer,
    "geojson_layer": q_geojson_layer,
    "current_month": q_current_month,
}
