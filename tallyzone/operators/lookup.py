"""Area lookups: distinct zips, prefix search, two-scope record."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyzone.constants import AGGREGATE_COLUMNS, CITYWIDE
from tallyzone.functions.values import rank_group, round2
from tallyzone.operators.rank import all_scopes, likelihood, rank_scoped

LOOKUP_COLUMNS = [
    "zip_code", "borough", "accident_count",
    "city_rank", "city_highest_rank", "city_decile", "city_likelihood",
    "borough_rank", "borough_highest_rank", "borough_decile", "borough_likelihood",
]


def unique_zips(agg: DataFrame) -> DataFrame:
    """Distinct zip codes of the aggregate (A10)."""
    return agg.select("zip_code").distinct()


def prefix_ranges(prefix: str) -> list[tuple[int, int]] | None:
    """The integer ranges (both ends included) whose decimal text starts with ``prefix``; None for all integers.

    '10' is 10, 100 to 109, 1000 to 1099 and so on, up to the largest INT.
    """
    if prefix == "":
        return None
    sign, digits = (-1, prefix[1:]) if prefix.startswith("-") else (1, prefix)
    if sign < 0 and digits == "":
        return [(-(1 << 31), -1)]
    if not re.fullmatch("0|[1-9][0-9]*", digits) or (sign < 0 and digits == "0"):
        return []
    if digits == "0":
        return [(0, 0)]
    most, ranges, low, width = (1 << 31) - (sign > 0), [], int(digits), 1
    while low <= most:
        high = min(low + width - 1, most)
        ranges.append((low, high) if sign > 0 else (-high, -low))
        low, width = low * 10, width * 10
    return ranges


def zip_prefix(agg: DataFrame, prefix: str) -> DataFrame:
    """Zips whose decimal text starts with ``prefix``; an empty prefix matches all.

    Written as ranges of the integer, which reach the reader of a stored aggregate.
    """
    ranges = prefix_ranges(prefix)
    if ranges is None:
        return unique_zips(agg)
    zip_code = F.col("zip_code")
    return unique_zips(agg.where(reduce(Column.__or__, [zip_code.between(a, b) for a, b in ranges], F.lit(False))))


def area_lookup_all(agg: DataFrame) -> DataFrame:
    """W5 for every zip at once: citywide and own-borough rank, highest rank, decile, likelihood.

    One ranking over both scope copies; the two copies of each zip are then
    joined on the zip code (each side has one row per zip).
    """
    ranked = rank_scoped(all_scopes(agg))
    city = ranked.where(F.col("scope") == F.lit(CITYWIDE)).select(
        "zip_code", "borough", F.col("total_crashes").alias("accident_count"),
        F.col("rank").alias("city_rank"), F.col("n_areas").cast("int").alias("city_highest_rank"),
        F.col("decile").alias("city_decile"), F.col("crash_likelihood").alias("city_likelihood"))
    own = ranked.where(F.col("scope") == F.col("borough")).select(
        "zip_code", F.col("rank").alias("borough_rank"),
        F.col("n_areas").cast("int").alias("borough_highest_rank"),
        F.col("decile").alias("borough_decile"), F.col("crash_likelihood").alias("borough_likelihood"))
    return city.join(own, "zip_code").select(*LOOKUP_COLUMNS)


def area_lookup(agg: DataFrame, zip_text: str) -> DataFrame:
    """W5 for one requested zip (F14, F15), by counting the areas ahead of it.

    The request must parse as an integer and exist among the aggregate's
    zips; otherwise the result is empty. Nothing is ranked or written: one
    conditional aggregate finds the asked area, a second one counts and sums
    each of its two scopes. Both read the same aggregate, whose last shuffle
    is reused.
    """
    z = F.trim(F.lit(str(zip_text))).try_cast("int")
    row = F.struct("total_crashes", "zip_code", "borough")
    asked = agg.agg(F.max(F.when(F.col("zip_code") == z, row)).alias("a"))  # a filter would be pushed, and nothing reused
    beside = agg.select(*AGGREGATE_COLUMNS, asked.scalar().alias("a"))
    total, own = F.col("total_crashes"), F.col("borough") == F.col("a.borough")
    ahead = (total > F.col("a.total_crashes")) | ((total == F.col("a.total_crashes")) & (F.col("zip_code") < F.col("a.zip_code")))
    sums = beside.agg(F.first("a").alias("a"), *(
        e.alias(f"{scope}_{name}") for scope, inside in (("city", F.lit(True)), ("borough", own)) for name, e in (
            ("rank", (F.count_if(inside & ahead) + 1).cast("int")), ("n", F.count_if(inside)),
            ("total", F.sum(F.when(inside, total))))))
    found = sums.where("a IS NOT NULL").select(
        F.col("a.zip_code").alias("zip_code"), F.col("a.borough").alias("borough"),
        F.col("a.total_crashes").alias("accident_count"), *sums.columns[1:])
    return found.select("zip_code", "borough", "accident_count", *(c for scope in ("city", "borough") for c in (
        F.col(f"{scope}_rank"), F.col(f"{scope}_n").cast("int").alias(f"{scope}_highest_rank"),
        rank_group(f"{scope}_rank", f"{scope}_n").alias(f"{scope}_decile"),
        likelihood("accident_count", round2(F.col(f"{scope}_total") / F.col(f"{scope}_n"))).alias(f"{scope}_likelihood"))))
