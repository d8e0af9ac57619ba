"""Record sources: the raw crash-record table, the period scan and row ids.

A raw record is ``id, year, month, zip_code, borough, crash_count, latitude,
longitude`` (zip code as text, exactly as a remote source hands it over).
On a real table the records are stored by year (:func:`write_records`), sorted
by month and zip, so the period scan prunes partitions and row groups; filters are written on the bare columns so
that they reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyzone.functions.positions import with_global_position

RECORD_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("month", T.IntegerType(), True),
    T.StructField("zip_code", T.StringType(), True),
    T.StructField("borough", T.StringType(), True),
    T.StructField("crash_count", T.IntegerType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
])

RECORD_COLUMNS = [f.name for f in RECORD_SCHEMA.fields]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored record table (Parquet, optionally partitioned by year/month)."""
    return spark.read.schema(RECORD_SCHEMA).parquet(path).select(*RECORD_COLUMNS)


# Rows of one record file: about 128 MB of typical records.
ROWS_PER_FILE = 4_000_000


def write_records(records: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store records by year in few files: at most one per ``rows_per_file`` rows, and one per year besides.

    One range shuffle by (year, month, zip, id) cuts the records into files
    of equal size, so a big month is split over several and small months
    share one. Files are sorted the same way: month and zip filters skip row
    groups by their least and greatest values. The rows are counted first.
    """
    files = max(1, -(-records.count() // rows_per_file))
    order = ["year", "month", "zip_code", "id"]
    (records.select(*RECORD_COLUMNS).repartitionByRange(files, *order).sortWithinPartitions(*order)
     .write.partitionBy("year").parquet(path))


# The test-data record table. It is derived from ``orders`` (the one given
# table with several years of dates and enough keys): 180 zip codes on a
# 15 x 12 lattice, five boroughs, every presence class, partial coordinates,
# NaN, junk and ".0" zip text, wrong boroughs and missing counts. The DuckDB
# oracle uses the very same expressions (see plans/oracle.py).
_FIXTURE_EXPRS = [
    "CAST(o_orderkey AS BIGINT) AS id",
    "CAST(year(o_orderdate) AS INT) AS year",
    "CAST(month(o_orderdate) AS INT) AS month",
    """CASE WHEN o_orderkey % 211 = 0 THEN 'N/A'
            WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 199 = 0 THEN concat(CAST(10001 + o_custkey % 180 AS STRING), '.0')
            ELSE CAST(10001 + o_custkey % 180 AS STRING) END AS zip_code""",
    """CASE WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 53 = 0 THEN 'Queens'
            WHEN (o_custkey % 180) % 15 < 2 THEN 'Staten Island'
            WHEN (o_custkey % 180) % 15 < 6 THEN 'Brooklyn'
            WHEN (o_custkey % 180) % 15 < 10 THEN 'Queens'
            WHEN (o_custkey % 180) % 15 < 13 THEN 'Manhattan'
            ELSE 'Bronx' END AS borough""",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END AS crash_count",
    """CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 101 = 0 OR o_custkey % 180 = 179 THEN NULL
            WHEN o_orderkey % 103 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE 4.05e1 + 3e-2 * floor((o_custkey % 180) / 15) + 4e-5 * ((o_orderkey * 7919) % 1000) END AS latitude""",
    """CASE WHEN o_orderkey % 11 = 0 OR o_custkey % 180 = 179 THEN NULL
            WHEN o_orderkey % 103 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE -7.425e1 + 3.5e-2 * ((o_custkey % 180) % 15) + 4.5e-5 * ((o_orderkey * 6007) % 1000) END AS longitude""",
]


def records_from_orders(orders: DataFrame) -> DataFrame:
    """The raw record table derived from ``orders`` (all periods)."""
    return orders.select("o_orderkey", "o_custkey", "o_orderdate").selectExpr(*_FIXTURE_EXPRS)


def fixture_records(spark: SparkSession, sf_dir: str, period: tuple | None = None) -> DataFrame:
    """Raw records of the test data, optionally restricted to a month period.

    The period is applied on ``o_orderdate`` first (so it reaches the Parquet
    reader as a pushed filter) and then, exactly, by :func:`period_scan`.
    """
    orders = table(spark, sf_dir, "orders")
    if period is not None:
        (sy, sm), (ey, em) = period
        lo = F.make_timestamp_ntz(F.lit(sy), F.lit(sm), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        hi = F.add_months(F.make_date(F.lit(ey), F.lit(em), F.lit(1)), 1).cast("timestamp_ntz")
        orders = orders.where((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi))
    recs = records_from_orders(orders)
    return period_scan(recs, period[0], period[1]) if period is not None else recs


def period_scan(records: DataFrame, start: tuple[int, int], end: tuple[int, int],
                columns: list[str] | None = None) -> DataFrame:
    """Records whose month lies in [start, end], both ends included.

    Written on the bare ``year``/``month`` columns: the year bounds push down
    to Parquet and prune ``year=`` partitions; the month-grain test is exact.
    """
    (sy, sm), (ey, em) = start, end
    y, m = F.col("year"), F.col("month")
    cond = y.between(sy, ey)
    if sy == ey:  # the months reach the reader, too
        cond &= m.between(sm, em)
    else:
        cond &= ((y > sy) | (m >= sm)) & ((y < ey) | (m <= em))
    out = records.where(cond)
    return out.select(*(columns or RECORD_COLUMNS))


def assign_row_id(df: DataFrame, order_cols: list[str], name: str = "row_id") -> DataFrame:
    """0-based position of each row in a total order (S2), computed distributedly.

    The response order of a remote source does not exist in Spark, so the id
    is the position in ``order_cols`` order (which must be unique). The rows
    are range-partitioned and sorted once; each partition's rows are numbered
    locally and shifted by the row count of all earlier partitions. Only the
    per-partition counts (one row per partition, a bounded table) are
    gathered and broadcast. Nothing passes through one task.
    """
    return with_global_position(df, order_cols, name=name, base=0)
