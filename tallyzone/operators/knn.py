"""Exact k-nearest-neighbour search and vote (J2, J3, A3, O3) in a fixed number of shuffles.

A cross join with top-k is quadratic. Instead the training points are packed
into tiles of a bounded number of points, and each query meets the tiles
that its neighbours can be in:

1. **Copies.** Training points with identical coordinates are capped at the
   k smallest ids (``row_number() <= k`` per coordinate pair). Under the
   order (distance, id) no other copy can ever be among the k nearest, so
   this is exact; Spark plans it as a partial window-group limit before the
   shuffle, so a coordinate pair holding a third of all rows never lands
   whole in one task.
2. **Tiles.** One range shuffle by (latitude, longitude) cuts the stored
   points into strips of equal size, split at quantiles of the data; a strip
   is sorted by longitude and cut into tiles of ``TILE`` * k points. Ties are split by the other coordinate, so no value, however
   common, makes a strip or tile larger. The bounds of the strips are one
   array, those of a strip's tiles another: about the square root of the
   number of tiles each, searched by halving.
3. **Home.** Each query takes the k nearest of the tile that its own place
   falls to (of those with k points). The k-th of them bounds how far away any neighbour can be.
4. **Border.** Only tiles whose bounds come within that distance can hold a
   nearer point. A query whose circle stays in its own tile's bounds is
   certified and goes no further; the others meet the tiles left, and the k
   best of both are the answer.

Every query takes part in these four steps at most, whatever the
distribution of the points: the number of jobs depends neither on the data
nor on k.

Distances are squared Euclidean distances in DOUBLE on the (float32)
coordinates; ties are broken by the training id. The search runs once per
distinct query coordinate pair, so copies of one query point cost one
search. With ``by`` columns there is one index per value of them, in the
same tables and jobs.

What later steps read more than once is written to the shared folder, so
the plan is a chain of short jobs that survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyzone.constants import DEFAULT_K
from tallyzone.session import counted, materialised

# A tile holds TILE * k training points, the last of a strip what is left.
TILE = 8
# At most this many strips, so that their bounds (24 bytes each) stay a small broadcast at any size.
MOST_STRIPS = 1 << 16
# Relative slack of distances against rounding; it can only add tiles.
_SLACK = 1e-9
_ULP = 1e-15

# Queries are searched once per distinct coordinate pair: the neighbours
# depend only on the coordinates, so copies of one query point (a default
# geocode holding a third of all rows, say) cost one search, not millions.
PKEY = ["qlat", "qlon"]
_TILE = ["strip", "tile"]


def _before(bounds: str, value: str, inclusive: bool) -> str:
    """SQL: how many entries of a rising array are below ``value`` (or equal to it), by halving."""
    entry = f"{bounds}[CAST((r.lo + r.hi) DIV 2 AS INT)] {'<=' if inclusive else '<'} {value}"
    return (f"aggregate(sequence(0, CAST(ceil(log2(size({bounds}) + 1)) AS INT)), struct(0 AS lo, size({bounds}) AS hi), "
            f"(r, i) -> CASE WHEN r.lo >= r.hi THEN r "
            f"WHEN {entry} THEN struct(CAST((r.lo + r.hi) DIV 2 AS INT) + 1 AS lo, r.hi AS hi) "
            f"ELSE struct(r.lo AS lo, CAST((r.lo + r.hi) DIV 2 AS INT) AS hi) END, r -> r.lo)")


def _indexed(train: DataFrame, k: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with their tile, one row per strip with its tiles' bounds, one row per group with its strips' bounds.

    Arrays that begin with ``h`` hold only what has k points or more: where a query may be at home.
    """
    # 1. copies beyond the k smallest ids of a coordinate pair never win
    copies = Window.partitionBy(*by, "tlat", "tlon").orderBy("tid")
    points, n_points = counted(
        train.select(*by, "tid", F.col("lat").cast("double").alias("tlat"), F.col("lon").cast("double").alias("tlon"),
                     "zip").withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k).drop("_c"), "train")

    # 2. strips by latitude, each in the order of the longitude; what is written pins the strips
    tile = TILE * k
    strips = min(MOST_STRIPS, max(1, isqrt(n_points // tile)))
    number = F.monotonically_increasing_id()
    placed = materialised(
        points.repartitionByRange(strips, *by, "tlat", "tlon").sortWithinPartitions(*by, "tlon", "tlat", "tid")
        .withColumn("_n", number)
        .select(*by, F.shiftright("_n", 33).cast("int").alias("strip"),
                F.floor(F.col("_n").bitwiseAND((1 << 33) - 1) / tile).cast("int").alias("tile"),
                "tid", "tlat", "tlon", "zip"), "tiles")
    tiles = placed.groupBy(*by, *_TILE).agg(
        F.min("tlat").alias("xlo"), F.max("tlat").alias("xhi"), F.min("tlon").alias("ylo"), F.max("tlon").alias("yhi"),
        F.count(F.lit(1)).alias("n"))
    stripes, n_stripes = counted(
        tiles.groupBy(*by, "strip")
        .agg(F.min("xlo").alias("xlo"), F.max("xhi").alias("xhi"),
             F.array_sort(F.collect_list(F.struct("tile", "ylo", "yhi", "n"))).alias("t"))
        .withColumn("h", F.expr(f"filter(t, t -> t.n >= {k})"))
        .select(*by, "strip", "xlo", "xhi", F.col("t.tile").alias("tiles"), F.col("t.ylo").alias("ylos"),
                F.col("t.yhi").alias("yhis"), F.col("h.tile").alias("htiles"), F.col("h.ylo").alias("hylos")), "stripes")
    groups = (
        stripes.groupBy(*(by or [F.lit(0).alias("_all")]))
        .agg(F.array_sort(F.collect_list(F.struct("strip", "xlo", "xhi", (F.size("htiles") > 0).alias("h")))).alias("s"))
        .withColumn("h", F.expr("filter(s, s -> s.h)"))
        .select(*(by or ["_all"]), F.col("s.strip").alias("strips"), F.col("s.xlo").alias("xlos"),
                F.col("s.xhi").alias("xhis"), F.col("h.strip").alias("hstrips"), F.col("h.xlo").alias("hxlos")))
    # all bounds together are MOST_STRIPS and one for each further group: counted, then broadcast
    return placed, stripes, F.broadcast(groups) if n_stripes <= 2 * MOST_STRIPS else groups


def _beside(queries: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Queries with the bounds of their group's strips."""
    return queries.join(groups, list(by)) if by else queries.withColumn("_all", F.lit(0)).join(groups, "_all")


def _at(names: str, bounds: str, value: str, otherwise: str) -> Column:
    """The name of the last entry that starts at ``value`` or before, else the first; ``otherwise`` where there is none."""
    return F.expr(f"coalesce(get({names}, greatest({_before(bounds, value, True)} - 1, 0)), get({otherwise}, 0))")


def _distance() -> Column:
    dlat, dlon = F.col("qlat") - F.col("tlat"), F.col("qlon") - F.col("tlon")
    return dlat * dlat + dlon * dlon


def _home(train: DataFrame, points: DataFrame, k: int, by: Sequence[str]):
    """Pairs of queries and the points of their own tile; the index."""
    by = list(by)
    placed, stripes, groups = _indexed(train, k, by)
    queries = points.select(*by, F.col("lat").cast("double").alias("qlat"),
                            F.col("lon").cast("double").alias("qlon")).distinct()
    strip, tile = _at("hstrips", "hxlos", "qlat", "strips"), _at("htiles", "hylos", "qlon", "tiles")
    at = (_beside(queries, groups, by).select(*by, *PKEY, strip.alias("strip"))
          .join(stripes.select(*by, "strip", "tiles", "htiles", "hylos"), [*by, "strip"])
          .select(*by, *PKEY, "strip", tile.alias("tile")))
    pairs = at.join(placed, [*by, *_TILE]).select(*by, *PKEY, *_TILE, "tid", "zip", _distance().alias("d2"))
    return pairs, (placed, stripes, groups)


def _best(pairs: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The k nearest of each query's pairs, numbered ``j``."""
    w = Window.partitionBy(*by, *PKEY).orderBy("d2", "tid")
    return pairs.withColumn("j", F.row_number().over(w)).where(F.col("j") <= k)


def _across(home: DataFrame, placed: DataFrame, stripes: DataFrame, groups: DataFrame, k: int,
            by: Sequence[str]) -> DataFrame:
    """Pairs of queries and the points of other tiles that come within the bound, all tiles where there is none.

    ``u2`` is the bound: the squared distance of the k-th point at home, null where there are fewer.
    """
    by = list(by)
    bound = home.groupBy(*by, *PKEY, *_TILE).agg(F.max(F.when(F.col("j") == k, F.col("d2"))).alias("u2"))
    asked = [*by, *PKEY, "u2", "hs", "ht"]

    def reach(distance, at):
        return f"coalesce({distance} * {1 + _SLACK!r}D + (abs({at}) + sqrt(u2)) * {_ULP!r}D, double('inf'))"

    def span(lows, highs, at, distance):
        return [F.expr(_before(highs, f"{at} - {distance}", False)).alias("a"),
                F.expr(f"{_before(lows, f'{at} + {distance}', True)} - 1").alias("b")]

    strips = (_beside(bound.withColumnsRenamed({"strip": "hs", "tile": "ht"}), groups, by)
              .select(*asked, "strips", *span("xlos", "xhis", "qlat", reach("sqrt(u2)", "qlat")))
              .select(*asked, F.expr("explode(slice(strips, a + 1, greatest(b - a + 1, 0)))").alias("strip"))
              .join(stripes.drop("htiles", "hylos"), [*by, "strip"]))
    left = (f"sqrt(greatest(u2 * {1 + 2 * _SLACK!r}D - pow(greatest(xlo - qlat, qlat - xhi, 0D), 2), 0D))")
    return (strips.select(*asked, "strip", "tiles", *span("ylos", "yhis", "qlon", reach(left, "qlon")))
            .select(*asked, "strip", F.expr("explode(slice(tiles, a + 1, greatest(b - a + 1, 0)))").alias("tile"))
            .where("strip != hs OR tile != ht")
            .join(placed, [*by, *_TILE])
            .select(*by, *PKEY, "u2", "tid", "zip", _distance().alias("d2")))


def point_neighbors(train: DataFrame, points: DataFrame, k: int = DEFAULT_K, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest training points of every distinct query coordinate pair, exactly.

    ``train``: ``tid, lat, lon, zip`` (unique ``tid``); ``points``: ``lat, lon``
    (duplicates are removed here); both with the ``by`` columns, where there
    is one index for each of their values. Coordinates must be non-null.
    Returns ``by..., qlat, qlon, j, tid, zip, d2`` with ``j`` = 1..k in (d2, tid)
    order. With fewer than k training points every point is a neighbour; with
    none a point gets no rows.
    """
    pairs, index = _home(train, points, k, by)
    home = materialised(_best(pairs, k, by), "home")
    across = _across(home, *index, k, by).where(F.col("u2").isNull() | (F.col("d2") <= F.col("u2")))
    columns = [*by, *PKEY, "tid", "zip", "d2"]
    found = home.select(*columns).unionByName(across.select(*columns))
    return _best(found, k, by).select(*by, *PKEY, "j", "tid", "zip", "d2")


def candidates(train: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Every training point that a query is compared with: ``qlat, qlon, tid, zip, d2``."""
    pairs, index = _home(train, points, k, ())
    across = _across(materialised(_best(pairs, k, ()), "home"), *index, k, ())
    return pairs.select(*PKEY, "tid", "zip", "d2").unionByName(across.select(*PKEY, "tid", "zip", "d2"))


def _query_coords(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.col("lat").cast("double").alias("qlat"),
                          F.col("lon").cast("double").alias("qlon"))


def knn_neighbors(train: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The k nearest training points of every query, exactly: ``qid, j, tid, zip, d2``.

    ``queries``: ``qid, lat, lon``. The search runs once per distinct
    coordinate pair (:func:`point_neighbors`); the lists are joined back to
    the query ids on the coordinates.
    """
    nb = point_neighbors(train, queries, k)
    return _query_coords(queries).join(nb, PKEY).select("qid", "j", "tid", "zip", "d2")


def knn_vote(neighbors: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Majority zip among each query's neighbours; ties go to the smallest zip (A3).

    Distance does not weight the vote. ``key`` names the query columns
    (default ``qid``). Returns ``key..., zip``.
    """
    key = key or ["qid"]
    return neighbors.groupBy(*key).agg(F.mode("zip", True).cast("int").alias("zip"))


def knn_fill(train: DataFrame, queries: DataFrame, k: int = DEFAULT_K, by: Sequence[str] = ()) -> DataFrame:
    """Vote of the k nearest neighbours for every query row.

    ``queries`` needs ``lat, lon`` and the ``by`` columns; every other column is carried through
    (so callers need no second join by id). Returns the query rows with a
    ``zip`` column, NULL when there is no training point at all. The vote
    is taken once per distinct coordinate pair and joined back on the
    coordinates (one row per pair on that side, so a hot coordinate is a
    skewed join that adaptive execution splits).
    """
    key = [*by, *PKEY]
    votes = knn_vote(point_neighbors(train, queries, k, by), key)
    rows = queries.withColumns({"qlat": F.col("lat").cast("double"),
                                "qlon": F.col("lon").cast("double")})
    return rows.join(votes, key, "left").drop(*PKEY)
