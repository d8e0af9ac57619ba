"""Scope reports: filter, totals, rank, likelihood, deciles, roll-up.

Ranks are positions in the order (total descending, zip ascending) inside a
scope. They are computed with a distributed global sort (see
:mod:`tallyzone.functions.positions`) instead of an unpartitioned window,
so no stage gathers all areas (or all areas of a big borough) in one task.
Scope statistics (area count, total, first position) are one grouped
aggregate with one row per scope.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyzone.constants import CITYWIDE, DISPLAY_NAMES, SCOPES
from tallyzone.functions.positions import with_global_position
from tallyzone.functions.values import rank_group, round2

REPORT_COLUMNS = ["zip_code", "borough", "total_crashes", "rank", "crash_likelihood", "decile"]


def scope_filter(agg: DataFrame, scope: str | None) -> DataFrame:
    """Citywide (or None) keeps every row, otherwise borough == scope."""
    if scope is None or scope == CITYWIDE:
        return agg
    return agg.where(F.col("borough") == F.lit(scope))


def with_scope(agg: DataFrame, scope: str | None) -> DataFrame:
    """The scope's rows with a ``scope`` column."""
    return scope_filter(agg, scope).withColumn("scope", F.lit(scope or CITYWIDE))


def all_scopes(agg: DataFrame) -> DataFrame:
    """Every row once under Citywide and once under its own borough."""
    return agg.withColumn("scope", F.explode(F.array(F.lit(CITYWIDE), F.col("borough"))))


def likelihood(total: str, average: Column) -> Column:
    """Total over the rounded average of the scope, 2 dp; NULL where the average is 0."""
    return round2(F.try_divide(F.col(total), average))


def _summed(sums: DataFrame, asked: Sequence[str]) -> DataFrame:
    """``scope, total, n`` of the scopes found, and of the asked ones without areas; asked ones first, in their order."""
    scopes = sums.sparkSession.createDataFrame(list(enumerate(asked)), "place int, asked string")
    n = F.coalesce("n", F.lit(0))
    return (
        sums.join(scopes, F.col("scope") == F.col("asked"), "full")
        .select("place", F.coalesce("scope", "asked").alias("scope"),
                F.coalesce("total", F.lit(0)).cast("long").alias("total_crashes"), n.alias("n_areas"))
        .withColumn("average_crashes_per_zip", round2(F.try_divide(F.col("total_crashes"), F.col("n_areas"))))
        .orderBy(F.col("place").asc_nulls_last(), "scope").drop("place")
    )


def scope_summary(scoped: DataFrame, asked: Sequence[str] = SCOPES) -> DataFrame:
    """Total crashes, mean per zip (2 dp, rounded half to even) and area count of every scope.

    Every scope of ``scoped`` appears, whatever its name; an asked one without
    areas has the total 0 and no mean.
    """
    return _summed(scoped.groupBy("scope").agg(F.sum("total_crashes").alias("total"), F.count(F.lit(1)).alias("n")), asked)


def area_summary(agg: DataFrame, asked: Sequence[str] = SCOPES) -> DataFrame:
    """:func:`scope_summary` of Citywide and every borough of an aggregate, by grouping sets in one aggregate.

    Areas without a borough count citywide only.
    """
    sums = agg.groupingSets([[], [F.col("borough")]], F.col("borough")).agg(
        F.grouping("borough").alias("g"), F.sum("total_crashes").alias("total"), F.count(F.lit(1)).alias("n"))
    scope = F.when(F.col("g") == 1, F.lit(CITYWIDE)).otherwise(F.col("borough"))
    return _summed(sums.select(scope.alias("scope"), "total", "n").where("scope IS NOT NULL"), asked)


def scope_totals(agg: DataFrame, scope: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The one row (total, average) that a report of one scope shows; total 0 and no average for an empty one.

    With ``by`` columns one row for each of their values.
    """
    rows = scope_filter(agg, scope)
    return rows.groupBy(*by).agg(F.coalesce(F.sum("total_crashes"), F.lit(0)).cast("long").alias("total_crashes"),
                    round2(F.avg("total_crashes")).alias("average_crashes_per_zip"))


def rank_scoped(scoped: DataFrame) -> DataFrame:
    """W1-W4 for every scope present in ``scoped`` (``scope, zip_code, borough, total_crashes``).

    Adds ``rank`` (1..n, total desc then zip), ``crash_likelihood`` (total /
    rounded scope mean, 2 dp; NULL when the mean is 0), ``decile`` and the
    scope columns ``n_areas``, ``scope_total``, ``scope_average``.
    """
    pos = with_global_position(
        scoped, [F.col("scope"), F.col("total_crashes").desc(), F.col("zip_code")], "pos")
    stats = (
        pos.groupBy("scope")
        .agg(F.min("pos").alias("first_pos"),
             F.count(F.lit(1)).alias("n_areas"),
             F.coalesce(F.sum("total_crashes"), F.lit(0)).cast("long").alias("scope_total"))
        .withColumn("scope_average", round2(F.col("scope_total") / F.col("n_areas")))
    )
    ranked = pos.join(stats, "scope").withColumn(
        "rank", (F.col("pos") - F.col("first_pos") + 1).cast("int"))
    return ranked.select(
        "scope", "zip_code", "borough", "total_crashes", "rank",
        likelihood("total_crashes", F.col("scope_average")).alias("crash_likelihood"),
        rank_group("rank", "n_areas").alias("decile"),
        "n_areas", "scope_total", "scope_average",
    )


def area_report(agg: DataFrame, scope: str | None = None) -> DataFrame:
    """E3 / W4 for one scope: the ranked table of that scope."""
    return rank_scoped(with_scope(agg, scope)).select(*REPORT_COLUMNS)


class Report(NamedTuple):
    """What a report of one scope hands over: the ranked table, and one row with total and average."""

    table: DataFrame
    totals: DataFrame


def full_report(agg: DataFrame, scope: str | None = None) -> Report:
    """Table, total and average of one scope; ``agg`` is best stored, it is read for each."""
    return Report(area_report(agg, scope), scope_totals(agg, scope))


def area_report_all(agg: DataFrame) -> DataFrame:
    """W4 for Citywide and every borough at once."""
    return rank_scoped(all_scopes(agg)).select("scope", *REPORT_COLUMNS)


def decile_rollup(ranked: DataFrame) -> DataFrame:
    """Crashes per decile and share of the scope total in percent, 2 dp."""
    return (
        ranked.groupBy("scope", "decile")
        .agg(F.sum("total_crashes").cast("long").alias("decile_crashes"),
             F.max("scope_total").alias("scope_total"))
        .select("scope", "decile", "decile_crashes",
                round2(F.try_divide(F.col("decile_crashes"), F.col("scope_total")) * 100.0)
                .alias("share_pct"))
        .orderBy("scope", "decile")
    )


def display_columns(report: DataFrame) -> DataFrame:
    """Display names of the ranked table (P5)."""
    return report.withColumnsRenamed(DISPLAY_NAMES)
