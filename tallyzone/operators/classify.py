"""Typing and presence classes of raw records.

Instead of eight filtered copies of the table, every row gets one ``cls``
value; each class filter is then a plain predicate on that column and the
table is never split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyzone.functions.values import clean_coordinate, parse_zip

# Presence classes: (zip, coordinates, borough) present or missing.
TRUSTED = "zip_coords_borough"      # F1: training set of the k-NN vote and the borough map
ZIP_COORDS = "zip_coords"           # F2
ZIP_BOROUGH = "zip_borough"         # F3
ZIP_ONLY = "zip_only"               # F4
COORDS_BOROUGH = "coords_borough"   # F5: zip filled by k-NN
COORDS_ONLY = "coords_only"         # F6: zip filled by k-NN
BOROUGH_ONLY = "borough_only"       # F7: cannot be filled
NOTHING = "nothing"                 # F8: cannot be filled
PARTIAL = "partial_coords"          # F9: exactly one coordinate missing; matches no class

ALL_CLASSES = [TRUSTED, ZIP_COORDS, ZIP_BOROUGH, ZIP_ONLY, COORDS_BOROUGH, COORDS_ONLY,
               BOROUGH_ONLY, NOTHING, PARTIAL]
ZIP_PRESENT = [TRUSTED, ZIP_COORDS, ZIP_BOROUGH, ZIP_ONLY]
NEEDS_ZIP = [COORDS_BOROUGH, COORDS_ONLY]
FILLABLE = ZIP_PRESENT + NEEDS_ZIP
DROPPED = [BOROUGH_ONLY, NOTHING, PARTIAL]


def typed_records(raw: DataFrame, box: tuple[float, float, float, float] | None = None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Zip text -> INT, borough -> string, coordinates -> float32 with NaN as NULL.

    With ``box`` (south, west, north, east) a pair outside of it counts as missing. ``keep`` names further columns to
    carry along.
    """
    typed = raw.select(
        *keep, "id", "year", "month",
        parse_zip("zip_code").alias("zip_code"),
        F.col("borough").cast("string").alias("borough"),
        "crash_count",
        clean_coordinate("latitude").alias("latitude"),
        clean_coordinate("longitude").alias("longitude"),
    )
    if box is None:
        return typed
    south, west, north, east = box
    lat, lon = F.col("latitude"), F.col("longitude")
    outside = ~(lat.between(south, north) & lon.between(west, east))
    return typed.withColumns({c: F.when(outside, F.lit(None)).otherwise(F.col(c)) for c in ("latitude", "longitude")})


def presence_class(partial_as_missing: bool = False):
    """The ``cls`` column. An empty-string borough counts as present.

    A row with one coordinate of two matches no class, or, with
    ``partial_as_missing``, the class without coordinates.
    """
    has = [F.col(c).isNotNull().cast("int") for c in ("zip_code", "borough", "latitude", "longitude")]
    # one look at each column, so a pushed class filter stays as small as the row's parsing
    table = F.array(*[F.lit(_class_of(*(i >> bit & 1 for bit in range(4)), partial_as_missing)) for i in range(16)])
    return F.get(table, has[0] + has[1] * 2 + has[2] * 4 + has[3] * 8)


def _class_of(zip_code: int, borough: int, latitude: int, longitude: int, partial_as_missing: bool) -> str:
    """The class of rows with these columns present (1) or missing (0)."""
    if latitude != longitude and not partial_as_missing:
        return PARTIAL
    if latitude and longitude:
        return [[COORDS_ONLY, COORDS_BOROUGH], [ZIP_COORDS, TRUSTED]][zip_code][borough]
    return [[NOTHING, BOROUGH_ONLY], [ZIP_ONLY, ZIP_BOROUGH]][zip_code][borough]


def with_class(typed: DataFrame, partial_as_missing: bool = False) -> DataFrame:
    return typed.withColumn("cls", presence_class(partial_as_missing))


def of_class(classified: DataFrame, *classes: str) -> DataFrame:
    """Rows of the given presence classes."""
    return classified.where(F.col("cls").isin(*classes))


def fillable_records(classified: DataFrame) -> DataFrame:
    """Keep the six fillable classes; drop F7, F8 and partial coordinates."""
    return of_class(classified, *FILLABLE)


def class_counts(classified: DataFrame) -> DataFrame:
    """Row count per presence class, including the implicit partial class."""
    return classified.groupBy("cls").agg(F.count(F.lit(1)).alias("n_records"))


def null_crash_counts(classified: DataFrame) -> DataFrame:
    """Rows whose crash count is missing."""
    return classified.where(F.col("crash_count").isNull())
