"""Scalar column functions (all built-in Spark expressions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyzone.constants import BRONX, COLOUR_BIN_EDGES, LABEL_FORMAT, N_GROUPS, THE_BRONX, ZIP_WIDTH

# Text that a numeric parser reads as a whole number: optional sign, digits,
# optionally a fraction made only of zeros ("11207.0"), surrounding blanks.
# Fractions, exponents, hex and "inf" are not whole numbers -> NULL.
WHOLE_NUMBER_RE = r"^\s*[+-]?[0-9]+([.]0*)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_zip(c: Column | str) -> Column:
    """Zip text -> nullable INT; unparsable or out-of-range text -> NULL."""
    s = _col(c).cast("string")
    digits = F.regexp_extract(s, r"[+-]?[0-9]+", 0)
    return F.when(s.rlike(WHOLE_NUMBER_RE), digits.try_cast("int"))


def clean_coordinate(c: Column | str) -> Column:
    """Coordinate -> float32 with NaN turned into NULL (P3; Spark keeps NaN as a value)."""
    x = _col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None)).otherwise(x).cast("float")


def round2(c: Column | str) -> Column:
    """Round to 2 decimals, half to even on the scaled double."""
    return F.rint(_col(c) * 100.0) / 100.0


def rename_bronx(c: Column | str) -> Column:
    """'Bronx' -> 'The Bronx', exact match only."""
    x = _col(c)
    return F.when(x == F.lit(BRONX), F.lit(THE_BRONX)).otherwise(x)


def rank_group(rank: Column | str, n: Column | str, groups: int = N_GROUPS) -> Column:
    """Rank-quantile group 1..groups, 1 = best rank.

    Quantile binning of the ranks 1..n with right-closed bins: 1 + the number
    of inner quantile edges below the rank. The edges are computed in doubles
    by linear interpolation (from the upper rank at a fraction of a half or
    more), as numeric libraries do, so that ranks next to an edge fall where
    they fall there. It differs from ``ntile``.
    """
    r, m = _col(rank), _col(n)
    group = F.lit(1)
    for q in quantile_points(groups):
        v = F.lit(q) * (m - 1)
        low = F.floor(v)
        g = v - low
        edge = F.when(g >= 0.5, (low + 2) - (F.lit(1.0) - g)).otherwise((low + 1) + g)
        group = group + F.when(r > edge, F.lit(1)).otherwise(F.lit(0))
    return group.cast("int")


def quantile_points(groups: int = N_GROUPS) -> list[float]:
    """The inner quantiles 1/groups ... as doubles, by way of percents."""
    return [i * (1.0 / groups) * 100 / 100 for i in range(1, groups)]


def pad_zip(c: Column | str) -> Column:
    """Zip int -> 5-character zero-padded trimmed text; longer text is kept whole."""
    s = F.trim(_col(c).cast("long").cast("string"))
    return F.when(F.length(s) < ZIP_WIDTH, F.lpad(s, ZIP_WIDTH, "0")).otherwise(s)


def show_value(c: Column | str) -> Column:
    """Text of a number for a label; missing values print as 'nan'."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))


def marker_label(zip_text: Column | str, count: Column | str, decile: Column | str,
                 rank: Column | str) -> Column:
    """Marker text of the map layer.

    Counts, deciles and ranks print as whole numbers, also where other
    polygons have none; a table library that turns such columns into floats
    would print ``54.0``. This is a choice.
    """
    return F.format_string(LABEL_FORMAT, _col(zip_text), show_value(count),
                           show_value(decile), show_value(rank))


def colour_bin(decile: Column | str) -> Column:
    """Colour interval of a decile: edges 1..10 make nine bins, 9 and 10 share the last."""
    return F.least(_col(decile), F.lit(len(COLOUR_BIN_EDGES) - 1)).cast("int")
