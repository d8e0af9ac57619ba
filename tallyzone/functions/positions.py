"""Distributed global positions (row numbers over a total order).

``row_number()`` over an unpartitioned window sends every row to one task.
Here the rows are range-partitioned and sorted by Spark, every partition
numbers its rows locally (``monotonically_increasing_id`` is
``partition << 33 | local index``), and a table with one row per partition
(size bounded by the partition count) supplies the offsets.

The tagged rows are written to the shared folder before they are read twice:
that pins the partition ids, so the counts and the rows always agree even if
a task is re-run or adaptive execution regroups partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyzone.session import materialised


def with_global_position(df: DataFrame, order_cols: list[Column | str], name: str = "pos",
                         base: int = 1) -> DataFrame:
    """Add ``name`` = position of each row in ``order_cols`` order, starting at ``base``.

    ``order_cols`` must form a unique key, otherwise positions of tied rows
    are arbitrary.
    """
    tagged = materialised(
        df.orderBy(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + local + F.lit(base))
        .drop("_pid", "_mid", "_off")
    )
