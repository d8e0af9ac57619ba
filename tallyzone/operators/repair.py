"""Repair of records: borough map, zip fill, borough overwrite."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyzone.constants import DEFAULT_K
from tallyzone.operators import classify as C
from tallyzone.operators.knn import knn_fill, knn_neighbors
from tallyzone.session import materialised

RECORD_OUT = ["id", "zip_code", "borough", "crash_count", "latitude", "longitude", "cls"]
POINT_COLUMNS = ["id", "zip_code", "latitude", "longitude"]


# ``by`` names columns that part the records into data sets of their own (requests, say): each has its own map, training
# points and sums, all in the same tables and jobs.


def zip_borough_counts(trusted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (not crashes) per (zip, borough) among trusted rows (A1)."""
    return trusted.groupBy(*by, "zip_code", "borough").agg(F.count(F.lit(1)).alias("n_records"))


def zip_borough_map(trusted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Majority borough per zip; ties go to the alphabetically first borough (A2).

    ``zip_code, borough`` with one row per zip.
    """
    counts = zip_borough_counts(trusted, by)
    best = counts.groupBy(*by, "zip_code").agg(
        F.min(F.struct((-F.col("n_records")).alias("neg"), F.col("borough").alias("b"))).alias("m"))
    return best.select(*by, "zip_code", F.col("m.b").alias("borough"))


def stored_borough_map(trusted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`zip_borough_map`, computed now and written to the shared folder."""
    return materialised(zip_borough_map(trusted, by), "borough-map")


def borough_repair(records: DataFrame, zmap: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """Borough := map[zip] for every row.

    The original keeps a borough only where it already equals the mapped
    one, so the net effect is an unconditional overwrite; a zip missing from
    the map gets NULL, or keeps its borough with ``keep_unmapped``. The map has one row per zip and comes stored
    (:func:`stored_borough_map`), so the planner knows its size: under the
    broadcast threshold no record is shuffled, beyond it the join shuffles
    and adaptive execution splits skewed zips.
    """
    out = records.withColumnRenamed("borough", "_own").join(zmap, "zip_code", "left")
    if keep_unmapped:
        out = out.withColumn("borough", F.coalesce("borough", "_own"))
    return out.select(*records.columns)


def prepared(classified: DataFrame, classes: list[str], columns: list[str]) -> DataFrame:
    """The rows and columns that a k-NN composition reads several times, written once to the shared folder.

    The parsed columns and the class are then plain columns, so no later
    filter repeats the parsing.
    """
    return materialised(C.of_class(classified, *classes).select(*columns, "cls"), "records")


def training_points(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trusted rows as k-NN training points: ``tid, lat, lon, zip``."""
    return C.of_class(classified, C.TRUSTED).select(
        *by, F.col("id").alias("tid"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), F.col("zip_code").alias("zip"))


def query_points(classified: DataFrame) -> DataFrame:
    """Rows that need a zip and have coordinates: ``qid, lat, lon``."""
    return C.of_class(classified, *C.NEEDS_ZIP).select(
        F.col("id").alias("qid"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def zip_neighbors(classified: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The k nearest trusted rows of every row to fill (O3): ``id, j, tid, zip_code, d2``."""
    classified = prepared(classified, [C.TRUSTED, *C.NEEDS_ZIP], POINT_COLUMNS)
    nb = knn_neighbors(training_points(classified), query_points(classified), k)
    return nb.select(F.col("qid").alias("id"), "j", "tid", F.col("zip").alias("zip_code"), "d2")


def fill_zip_codes(classified: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Predicted zip of every row to fill (J2 applied to F5 and F6 together, J3): ``id, zip_code``."""
    classified = prepared(classified, [C.TRUSTED, *C.NEEDS_ZIP], POINT_COLUMNS)
    pred = knn_fill(training_points(classified), query_points(classified), k)
    return pred.select(F.col("qid").alias("id"), F.col("zip").alias("zip_code"))


def filled_rows(classified: DataFrame, columns: list[str], k: int = DEFAULT_K, by: Sequence[str] = ()) -> DataFrame:
    """The rows to fill (F5, F6) with their k-NN zip as ``zip_code`` and the given columns."""
    need = C.of_class(classified, *C.NEEDS_ZIP).select(
        *by, *columns, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return knn_fill(training_points(classified, by), need, k, by) \
        .select(*by, *columns, F.col("zip").alias("zip_code"))


def filled_records(classified: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The six fillable classes, with k-NN zips in place for F5/F6 (U1, before J1).

    Rows that already have a zip pass through untouched; only the rows to
    fill are joined with their predictions (no join over the whole table).
    """
    keep = C.of_class(classified, *C.ZIP_PRESENT).select(*RECORD_OUT)
    payload = [c for c in RECORD_OUT if c != "zip_code"]
    filled = filled_rows(classified, payload, k).select(*RECORD_OUT)
    return keep.unionByName(filled)


def repaired_records(classified: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Fill zips by k-NN, then overwrite boroughs from the map learned on trusted rows."""
    classified = prepared(classified, C.FILLABLE, RECORD_OUT[:-1])
    zmap = stored_borough_map(C.of_class(classified, C.TRUSTED))
    return borough_repair(filled_records(classified, k), zmap)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """Union by name with exact duplicate rows removed."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates()
