"""End-to-end compositions (E1-E5) over a folder of given tables.

Building a plan that fills zips or ranks areas runs jobs: what is read more
than once (k-NN cells, the borough map, ranked positions) is written to the
shared folder on the way. Nothing of the data's size is collected. The
record table is derived from ``orders`` (see :mod:`tallyzone.sources.records`);
on a real deployment :func:`tallyzone.sources.records.read_records` takes
its place and everything downstream is unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.constants import DEFAULT_K, EARLIEST_MONTH, EARLIEST_YEAR
from tallyzone.functions.periods import previous_period, request_months, request_valid
from tallyzone.operators import classify as C
from tallyzone.operators.aggregate import crashes_by_zip
from tallyzone.operators.layer import layer_table
from tallyzone.operators.lookup import area_lookup
from tallyzone.operators.rank import (REPORT_COLUMNS, Report, area_report, full_report, rank_scoped, scope_filter,
                                      scope_totals)
from tallyzone.session import materialised
from tallyzone.sources.layer import layer_from_customers
from tallyzone.sources.records import fixture_records, table
from tallyzone.sources.store import load_or_build


def raw_records(spark: SparkSession, sf_dir: str, period=None) -> DataFrame:
    return fixture_records(spark, sf_dir, period)


def classified_records(spark: SparkSession, sf_dir: str, period=None) -> DataFrame:
    """Typed records with their presence class; scans read the columns that a query needs, nothing is cached."""
    return C.with_class(C.typed_records(raw_records(spark, sf_dir, period)))


def fetch_and_aggregate(spark: SparkSession, sf_dir: str, period=None, k: int = DEFAULT_K,
                        sort: bool = True) -> DataFrame:
    """Scan -> type -> classify -> fill -> repair -> sum per area -> rename."""
    return crashes_by_zip(classified_records(spark, sf_dir, period), k, sort=sort)


def report(spark: SparkSession, sf_dir: str, scope: str | None = None, period=None,
           k: int = DEFAULT_K) -> DataFrame:
    """E2 + E3: the ranked table of one scope."""
    return area_report(fetch_and_aggregate(spark, sf_dir, period, k, sort=False), scope)


def search(spark: SparkSession, sf_dir: str, zip_text: str, period=None, k: int = DEFAULT_K) -> DataFrame:
    """The two-scope record of one zip."""
    return area_lookup(fetch_and_aggregate(spark, sf_dir, period, k, sort=False), zip_text)


def map_layer(spark: SparkSession, sf_dir: str, scope: str | None = None, period=None,
              k: int = DEFAULT_K) -> DataFrame:
    """E5: the layer table of one scope."""
    rep = area_report(fetch_and_aggregate(spark, sf_dir, period, k, sort=False), scope)
    return layer_table(layer_from_customers(table(spark, sf_dir, "customer")), rep, scope)


def default_report(spark: SparkSession, sf_dir: str, base: str, as_of, scope: str | None = None) -> Report:
    """First visit: the month before ``as_of``, from its stored aggregate in ``base`` or built and stored there."""
    month = previous_period(as_of)
    agg = load_or_build(spark, base, month, month,
                        lambda: fetch_and_aggregate(spark, sf_dir, (month, month), sort=False))
    return full_report(agg, scope)


def requested_report(spark: SparkSession, sf_dir: str, start, end, as_of, scope: str | None = None,
                     earliest=(EARLIEST_YEAR, EARLIEST_MONTH)) -> Report | None:
    """A request: always fetched anew if the period is valid, None (keep what is shown) if it isn't."""
    if not request_valid(start, end, as_of, earliest):
        return None
    return full_report(materialised(fetch_and_aggregate(spark, sf_dir, (start, end), sort=False), "request"), scope)


def requested_reports(spark: SparkSession, sf_dir: str, requests: Sequence[tuple], as_of, scope: str | None = None,
                      earliest=(EARLIEST_YEAR, EARLIEST_MONTH), k: int = DEFAULT_K) -> Report:
    """Many requests, (start, end) pairs of months, over one read of the records; invalid ones have no rows.

    A record meets the requests that its month lies in by an equi-join with
    the months of each request. From there the request is part of every key:
    one k-NN index, one borough map and one sum hold all requests. Both tables
    of the report begin with ``request``, the place in the list.
    """
    valid = [(i, s, e) for i, (s, e) in enumerate(requests) if request_valid(s, e, as_of, earliest)]
    months = spark.createDataFrame(request_months(valid), "request int, year int, month int")
    period = (min(s for _, s, _ in valid), max(e for _, _, e in valid)) if valid else ((1, 1), (1, 1))
    raw = raw_records(spark, sf_dir, period).join(months, ["year", "month"])
    classified = C.with_class(C.typed_records(raw, keep=["request"]))
    agg = materialised(scope_filter(crashes_by_zip(classified, k, sort=False, by=["request"]), scope), "requests")
    table = rank_scoped(agg.withColumn("scope", F.col("request"))).select(F.col("scope").alias("request"), *REPORT_COLUMNS)
    return Report(table, scope_totals(agg, by=["request"]))
