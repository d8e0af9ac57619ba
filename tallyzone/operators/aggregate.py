"""Crashes per area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyzone.constants import DEFAULT_K
from tallyzone.functions.values import rename_bronx
from tallyzone.operators import classify as C
from tallyzone.operators.repair import POINT_COLUMNS, filled_rows, prepared, stored_borough_map


def crashes_by_zip(classified: DataFrame, k: int = DEFAULT_K, sort: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """E2 after the scan: repair, sum per area, rename, sort by total (A4, A5, O1).

    Same result as repairing every row and then summing per (zip, borough),
    but planned aggregate-first: since the borough of every row is replaced
    by the map value of its zip, the sum can be taken per zip first (partial
    aggregation on the map side, one shuffle of at most one row per zip and
    partition) and only the per-zip totals are joined with the zip->borough
    map. The rows whose zip is filled carry their crash count through the
    k-NN vote; the bulk of the records is never joined. With ``by`` columns
    every data set that they part is repaired and summed on its own.
    """
    by = list(by)
    classified = prepared(classified, C.FILLABLE, [*by, *POINT_COLUMNS, "borough", "crash_count"])
    zmap = stored_borough_map(C.of_class(classified, C.TRUSTED), by)
    present = C.of_class(classified, *C.ZIP_PRESENT).select(*by, "zip_code", "crash_count")
    filled = filled_rows(classified, ["crash_count"], k, by).select(*by, "zip_code", "crash_count")
    per_zip = (
        present.unionByName(filled)
        .where(F.col("zip_code").isNotNull())
        .groupBy(*by, "zip_code")
        .agg(F.coalesce(F.sum("crash_count"), F.lit(0)).cast("long").alias("total_crashes"))
    )
    out = (
        per_zip.join(zmap, [*by, "zip_code"])
        .where(F.col("borough").isNotNull())
        .select(*by, "zip_code", rename_bronx("borough").alias("borough"), "total_crashes")
    )
    return out.orderBy(F.col("total_crashes").desc(), F.col("zip_code")) if sort else out
