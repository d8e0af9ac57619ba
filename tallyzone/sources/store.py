"""Persisted per-area aggregates.

An aggregate of a period is stored as CSV (header, no index) under a path
named after the period, months not zero-padded, e.g.
``accidents_2_2025-2_2025``. A path holds versions and commits:

    <path>/versions/<name>/...      one finished write each
    <path>/commits/00000007         the name of the version that commit 7 shows

A replacement is written beside the old version and then shown by one small
file, created under the next number and never overwritten. Readers follow the
highest commit that is whole. A write that fails leaves the old aggregate as it
was; of two writers at once the one that loses the race for a number takes the
next, so both commit and the later one shows. Only the latest version and the
one before it (which a reader may still hold) are kept; nothing else is ever
deleted. The file system must create a file at most once (HDFS, local).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyzone.constants import AGGREGATE_COLUMNS

AGGREGATE_SCHEMA = T.StructType([
    T.StructField("zip_code", T.IntegerType(), True),
    T.StructField("borough", T.StringType(), True),
    T.StructField("total_crashes", T.LongType(), True),
])


def period_name(start: tuple[int, int], end: tuple[int, int]) -> str:
    """``accidents_{sm}_{sy}-{em}_{ey}`` (months not padded)."""
    (sy, sm), (ey, em) = start, end
    return f"accidents_{sm}_{sy}-{em}_{ey}"


KEPT_COMMITS = 2


class _Folder:
    """Small file operations below one path, through the session's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file; False if there is one of this name."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _commits(folder: _Folder) -> list[tuple[str, str]]:
    """(number, version) of the whole commits, latest first; one cut off while it was made is passed over."""
    found = []
    for number in reversed(folder.names("commits")):
        if number.isdigit() and (text := folder.read(f"commits/{number}")).endswith("\n"):
            found.append((number, text.strip()))
    return found


def _commit(folder: _Folder, version: str) -> None:
    number = max((int(n) for n in folder.names("commits") if n.isdigit()), default=0) + 1
    while not folder.create(f"commits/{number:08d}", f"{version}\n"):
        number += 1
    for old, name in _commits(folder)[KEPT_COMMITS:]:
        folder.delete(f"commits/{old}")
        folder.delete(f"versions/{name}")


def save_aggregate(agg: DataFrame, path: str) -> None:
    """Write exactly ``zip_code, borough, total_crashes`` with a header, replacing what ``path`` shows."""
    folder, version = _Folder(agg.sparkSession, path), uuid.uuid4().hex
    try:
        agg.select(*AGGREGATE_COLUMNS).write.option("header", True).csv(f"{folder.root}/versions/{version}")
    except Exception:
        folder.delete(f"versions/{version}")
        raise
    _commit(folder, version)


def read_aggregate(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored aggregate, or None when it does not exist."""
    folder = _Folder(spark, path)
    for _, version in _commits(folder):
        if folder.exists(f"versions/{version}/_SUCCESS"):
            return spark.read.schema(AGGREGATE_SCHEMA).option("header", True).csv(f"{folder.root}/versions/{version}")
    return None


def load_or_build(spark: SparkSession, base: str, start: tuple[int, int], end: tuple[int, int],
                  build: Callable[[], DataFrame]) -> DataFrame:
    """The stored aggregate of the period if present, else build, save and read it back."""
    path = f"{base.rstrip('/')}/{period_name(start, end)}"
    got = read_aggregate(spark, path)
    if got is not None:
        return got
    save_aggregate(build(), path)
    return read_aggregate(spark, path)
